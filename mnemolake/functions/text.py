"""String, JSON and hash functions on columns."""

from __future__ import annotations

import html
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

CONTROL = r"[\x00-\x1f\x7f-\x9f]"


@F.pandas_udf(StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


def clean_text(c: Column) -> Column:
    """Trimmed, HTML entities resolved, control characters removed."""
    return F.regexp_replace(_unescape(F.trim(c)), CONTROL, "")


def strip_controls(c: Column) -> Column:
    """Trimmed, without control characters; stays in the JVM."""
    return F.regexp_replace(F.trim(c), CONTROL, "")


def split_markers(c: Column, markers: list[str]) -> Column:
    """Split on any of the literal markers, parts trimmed, blanks dropped."""
    pattern = "|".join(re.escape(m) for m in markers)
    return F.filter(F.transform(F.split(c, pattern), lambda x: F.trim(x)), lambda x: x != "")


def is_float(c: Column) -> Column:
    return c.rlike(r"^[-+]?[0-9]*\.?[0-9]+$")


def content_id(c: Column, prefix: str = "") -> Column:
    """Prefix and md5 of the content."""
    return F.concat(F.lit(prefix), F.md5(c))


def request_key(*cols: Column) -> Column:
    """Stable key of a request to an external function."""
    return F.md5(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}))


def strip_turn(c: Column) -> Column:
    """Id without its last ``_`` part; empty where there is no ``_``."""
    return F.when(c.contains("_"), F.regexp_replace(c, r"_[^_]*$", "")).otherwise(F.when(c.isNotNull(), F.lit("")))


def yes_label(c: Column) -> Column:
    return F.lower(F.trim(c)).contains("yes")


def strip_quotes(c: Column) -> Column:
    """Trimmed, one matching pair of quotes removed."""
    return F.regexp_replace(F.trim(c), r"""(?s)^(["'])(.*)\1$""", "$2")


def capitalised(c: Column) -> Column:
    """First letter upper, the rest lower."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(c.substr(F.lit(2), F.length(c))))


def words(c: Column) -> Column:
    """Lower-cased words of letters and digits."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def is_empty_component(c: Column) -> Column:
    """Null, blank, or only a separator."""
    return c.isNull() | F.trim(c).isin("", ",", ";")


def name_of_persona(c: Column) -> Column:
    """Value of ``Name:`` before ``; Gender:``; null where there is none."""
    found = F.trim(F.regexp_extract(c, r"Name:\s*(.*?); Gender:", 1))
    return F.when(found != "", found)


def keyphrases(c: Column) -> Column:
    """Parts between semicolons, trimmed, blanks dropped."""
    return split_markers(c, [";"])


def clean_facts(c: Column) -> Column:
    """Lines without bullets or numbers; blank and ``#`` lines dropped."""
    lines = F.transform(F.split(c, "\n"), lambda x: F.trim(x))
    kept = F.filter(lines, lambda x: (x != "") & ~x.startswith("#"))
    return F.filter(F.transform(kept, lambda x: F.trim(F.regexp_replace(x, r"^(?:[-*•]|\d+[.)])\s*", ""))), lambda x: x != "")


def joined_facts(c: Column) -> Column:
    """Facts without closing dots, joined by ``; ``."""
    return F.array_join(F.transform(c, lambda x: F.regexp_replace(x, r"\.+$", "")), "; ")


def session_ids_in(c: Column) -> Column:
    """All session ids named in a text."""
    return F.regexp_extract_all(c, F.lit(r"([0-9a-fA-F\-]{8,}_[sS]ession\d+)"), F.lit(1))


def csv_line(cells: list[tuple[Column, bool]]) -> Column:
    """A line of cells (text, whether the value is a number) with ``,\t`` between: texts
    trimmed, without quotes at their ends, in double quotes, null as an empty one."""

    def cell(c: Column, number: bool) -> Column:
        if number:
            return F.coalesce(c, F.lit('""'))
        bare = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), "^'+|'+$", ""), '^"+|"+$', "")
        return F.concat(F.lit('"'), bare, F.lit('"'))

    return F.concat_ws(",\t", *[cell(*x) for x in cells])


def word_count(c: Column) -> Column:
    """Words between blanks: the tokens of budgets where no tokenizer is given."""
    return F.when(F.trim(F.coalesce(c, F.lit(""))) == "", 0).otherwise(F.size(F.split(F.trim(c), r"\s+")))


def first_words(c: Column, n: int) -> Column:
    """The first ``n`` words, with a blank between where anything is cut."""
    words_ = F.split(F.trim(c), r"\s+")
    return F.when(F.size(words_) > n, F.array_join(F.slice(words_, 1, n), " ")).otherwise(c)


def fenced_json(c: Column) -> Column:
    """First object inside a json fence, else null."""
    found = F.regexp_extract(c, r"(?s)```json\s*(\{.*?\})\s*```", 1)
    return F.when(found != "", found)


def first_json(text: str | None) -> str | None:
    """The first balanced object of a text, line breaks removed."""
    if not text:
        return None
    depth, start = 0, None
    for i, c in enumerate(text):
        if c == "{":
            start = i if depth == 0 else start
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                return text[start : i + 1].replace("\n", "")
    return None


# A key, quoted or not, and a colon.
_KEY = re.compile(r"""["']?(\w+)["']?\s*:\s*""")


def _scalar(raw: str):
    """null, true, false, a number, else the text without its quotes."""
    raw = raw.strip()
    fixed = {"null": None, "true": True, "false": False}
    if raw.lower() in fixed:
        return fixed[raw.lower()]
    for kind in (int, float):
        try:
            return kind(raw)
        except ValueError:
            pass
    return raw.strip("\"'")


def _closing(text: str, at: int) -> int:
    """The end of the value that begins at ``at``: a quoted text, a bracketed part or
    whatever stands before a comma, brace or line end."""
    first = text[at : at + 1]
    if first in ("{", "["):
        depth, quoted, i = 0, False, at
        while i < len(text):
            c = text[i]
            if c == "\\":
                i += 1
            elif c == '"':
                quoted = not quoted
            elif not quoted:
                depth += (c in "{[") - (c in "}]")
                if depth == 0:
                    return i + 1
            i += 1
        return len(text)
    if first == '"':
        i = at + 1
        while i < len(text) and text[i] != '"':
            i += 2 if text[i] == "\\" else 1
        return min(len(text), i + 1)
    m = re.compile(r"[,}\n]").search(text, at)
    return m.start() if m else len(text)


def _pairs(text: str) -> dict:
    """Key-value pairs found in a text, objects within it too."""
    out, at = {}, 0
    while m := _KEY.search(text, at):
        start = m.end()
        at = max(_closing(text, start), start + 1)
        raw = text[start:at]
        if raw[:1] == "{":
            out[m.group(1)] = _pairs(raw[1:])
        elif raw[:1] == "[":
            try:
                out[m.group(1)] = json.loads(raw)
            except ValueError:
                out[m.group(1)] = raw
        else:
            out[m.group(1)] = _scalar(raw)
    return out


def salvage(text: str | None) -> str | None:
    """JSON of the first object; where it does not parse, of all key-value pairs of
    the text, nested ones as objects."""
    if text is None:
        return None
    found = first_json(text)
    if found is not None:
        try:
            return json.dumps(json.loads(found), sort_keys=True, ensure_ascii=False)
        except ValueError:
            pass
    pairs = _pairs(text)
    return json.dumps(pairs, sort_keys=True, ensure_ascii=False) if pairs else None


@F.pandas_udf(StringType())
def json_salvage(s: pd.Series) -> pd.Series:
    return s.map(salvage, na_action="ignore")


def coerced(c: Column, kind: str) -> Column:
    """A JSON scalar text as the named schema type; null where it is none."""
    low = F.lower(F.trim(c))
    return {
        "boolean": F.when(low.isin("true", "yes", "1"), True).when(low.isin("false", "no", "0"), False),
        "integer": c.try_cast("long"),
        "number": c.try_cast("double"),
        "string": c,
    }[kind]


def records_in(c: Column, record: str = "##", field: str = "<|>", end: str = "<|COMPLETE|>") -> Column:
    """Array of field arrays of a delimited extraction text."""
    parts = split_markers(c, [record, end])
    inner = F.transform(parts, lambda p: F.regexp_extract(p, r"\((.*)\)", 1))
    return F.transform(F.filter(inner, lambda p: p != ""), lambda p: split_markers(p, [field]))


def entity_of(fields: Column) -> Column:
    """Struct of an entity record: quoted tag, four or more fields; else null."""
    ok = (F.size(fields) >= 4) & (fields[0] == '"entity"')
    return F.when(ok, F.struct(F.upper(strip_controls(fields[1])).alias("name"), F.upper(strip_controls(fields[2])).alias("type"), strip_controls(fields[3]).alias("description")))


def relationship_of(fields: Column) -> Column:
    """Struct of a relationship record; the weight is the last field if numeric, else 1."""
    ok = (F.size(fields) >= 5) & (fields[0] == '"relationship"')
    last = F.element_at(fields, -1)
    weight = F.when(is_float(last), last.cast("double")).otherwise(F.lit(1.0))
    return F.when(ok, F.struct(F.upper(strip_controls(fields[1])).alias("src"), F.upper(strip_controls(fields[2])).alias("tgt"), strip_controls(fields[3]).alias("description"), weight.alias("weight")))
