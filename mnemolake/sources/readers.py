"""Readers and writers. Schemas are stated, never inferred from a sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TURN = "struct<role:string, content:string, has_answer:boolean>"
HAYSTACK = f"question_id string, question_type string, question string, answer string, question_date string, haystack_dates array<string>, haystack_session_ids array<string>, haystack_sessions array<array<{TURN}>>, answer_session_ids array<string>"
USERS = (
    "uuid string, persona_info string, sessions array<struct<start_time:string, end_time:string, is_generated_qa_session:boolean, "
    "dialogue:array<struct<role:string, content:string, timestamp:string>>, "
    "memory_points:array<struct<memory_content:string, memory_type:string, memory_source:string, importance:double, is_update:string, original_memories:array<string>, memories_from_system:array<string>>>, "
    "questions:array<struct<question:string, answer:string, evidence:array<struct<memory_content:string>>, system_response:string>>>>"
)


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that is one JSON array."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def json_lines(spark: SparkSession, path: str, schema: str, tolerant: bool = False) -> DataFrame:
    """A JSON object a line; blank lines are skipped, malformed ones are an error
    or, ``tolerant``, left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").json(path)


def json_map(spark: SparkSession, path: str, value: str = "string") -> DataFrame:
    """``(key, value)`` rows of a file that is one JSON object."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string, {value}>")).alias("key", "value"))


def detect(spark: SparkSession, path: str) -> str:
    """What a JSON file holds: ``array``, ``map`` (one object) or ``lines``. The file is
    read as lines where it lies, whatever their length; only heads come to the driver."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    first = [r.head for r in lines.select(F.substring(F.ltrim("value"), 1, 1).alias("head")).limit(1).collect()]
    if first == ["["]:
        return "array"
    if first == ["{"]:
        # More than one line, and each line an object of its own.
        whole = F.try_parse_json("value").isNotNull() & F.startswith(F.trim("value"), F.lit("{"))
        n, objects = lines.agg(F.count("*"), F.count_if(whole)).first()
        return "lines" if n > 1 and 2 * objects > n else "map"
    raise ValueError(f"{path} holds no JSON")


def turns(haystack: DataFrame) -> DataFrame:
    """``(question_id, session_id, session_date, session_pos, turns)``."""
    z = F.posexplode(F.arrays_zip("haystack_session_ids", "haystack_dates", "haystack_sessions")).alias("session_pos", "s")
    return haystack.select("question_id", z).select("question_id", F.col("s.haystack_session_ids").alias("session_id"), F.col("s.haystack_dates").alias("session_date"), "session_pos", F.col("s.haystack_sessions").alias("turns"))


def graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes ``(name, attrs)`` and edges ``(src, tgt, attrs)`` of a GraphML file."""
    names = spark.read.schema("_id string, `_attr.name` string").option("rowTag", "key").xml(path).select(F.col("_id").alias("k"), F.col("`_attr.name`").alias("v")).collect()
    label = F.create_map(*[F.lit(x) for r in names for x in (r.k, r.v)]) if names else F.create_map().cast("map<string,string>")
    data = "data array<struct<_key:string, _VALUE:string>>"
    attrs = F.map_from_entries(F.transform(F.coalesce("data", F.array()), lambda d: F.struct(F.coalesce(label[d._key], d._key), d._VALUE)))
    nodes = spark.read.schema(f"_id string, {data}").option("rowTag", "node").xml(path).select(F.col("_id").alias("name"), attrs.alias("attrs"))
    edges = spark.read.schema(f"_source string, _target string, {data}").option("rowTag", "edge").xml(path).select(F.col("_source").alias("src"), F.col("_target").alias("tgt"), attrs.alias("attrs"))
    return nodes, edges


def write_keyed(df: DataFrame, path: str, keys: list[str]) -> None:
    """A keyed table: one row a key, sorted by it inside the files."""
    df.dropDuplicates(keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def append_rows(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Append; the commit protocol makes concurrent writers safe."""
    df.write.mode("append").format(fmt).save(path)
