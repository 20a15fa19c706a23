"""Variant spellings of names typed by people (problem 3).

Suffix blocking. Names of a scope (a graph) are reduced to their core tokens;
names with equal core are one key. Keys are filed under the last ``SHORTEST`` letters
of each of their tokens (shorter tokens whole), and, refined with the first letter of
another token, under the endings with one letter left out. A block with more than
``BLOCK`` keys is cut over the cells of a grid, so it is compared whole whatever its
size; its pairs grow with the square of its keys. Within a cell pairs are compared
token by token; the ratio of their longest common subsequence, 2 LCS / (length +
length), decides. Nicknames and abbreviations count as equal but ambiguous.

Spellings whose tokens agree are joined first. A group that is known only by a
nickname, abbreviation or acronym then joins the one group of full names it fits;
where relatives or namesakes leave two, it stays by itself. Acronyms are met by the
initials of the words, with and without legal forms. Blocks are worked off in the
executors and only links leave them.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from .cells import in_cells
from .components import connected_groups

SHORTEST = 4
BLOCK = 40
# Least ratio of two tokens, of those up to four letters (one of which is a quarter),
# and of all letters together where several tokens differ.
RATIO, SHORT_RATIO, SEVERAL_RATIO = 0.8, 0.75, 0.85
# Words that are no part of the core of a name.
TITLES = "mr mrs ms miss mx dr prof professor sir madam rev hon"
GENERATIONS = "jr sr junior senior phd md dds esq ii iii iv"
LEGAL_FORMS = "the of and ltd limited inc incorporated llc llp plc corp corporation co company gmbh ag sa"
# Common short forms of given names, by the full name.
NICKNAMES = """
alexander: alex al sandy xander lex sasha
alexandra: alex sandra lexi sandy sasha alexa
andrew: andy drew
anthony: tony ant
barbara: barb babs barbie
benjamin: ben benny
catherine: cathy cate kate katie kitty cat
charles: charlie chuck chas chip
christopher: chris kit topher
daniel: dan danny
david: dave davy
deborah: deb debbie debby debra
dmitri: dima mitya
dorothy: dot dottie dolly dora
edward: ed eddie ted teddy ned
eleanor: ellie nell nellie nora ella lenny
elizabeth: liz beth betty lizzie eliza libby bess betsy lisa
frances: fran fanny frankie
francis: frank fran frankie
frederick: fred freddie freddy fritz
gabriella: gabby gaby ella gabi
gregory: greg gregg
harold: harry hal
isabella: bella izzy isa belle
james: jim jimmy jamie
jennifer: jen jenny
john: jack johnny
jonathan: jon jonny nathan johnny
joseph: joe joey
josephine: jo josie fina
kasimir: kaz kazik
katherine: kate kathy katie kat kit kitty kath
lawrence: larry laurie lars
leopold: leo poldi
margaret: maggie peggy meg marge margie greta rita madge daisy
michael: mike mick mickey micky
nicholas: nick nicky nico klaus
oliver: ollie olly
patricia: pat patty trish tricia patsy
patrick: pat paddy
peter: pete
quentin: quin quint
rebecca: becky becca reba
richard: rick dick rich ricky richie
robert: bob rob bobby robbie bert
samantha: sam sammy
samuel: sam sammy
stephen: steve stevie
susannah: sue susan susie suzy sanna anna
theodore: ted theo teddy
thomas: tom tommy
tobias: toby tobi
ulrich: uli ulli
ursula: ulla uschi
victoria: vicky tori vic vicki
vincent: vince vin vinny vinnie
wilhelmina: mina willa billie minnie wilma
william: bill will billy willy liam
yasmin: yaz jas
zachary: zach zack zak
"""
_STROKES = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe"})
_WORD = re.compile(r"[^\W_]+")
_DROPPED = frozenset(f"{TITLES} {GENERATIONS} {LEGAL_FORMS}".split())
_NICK = {(n, line.split(":")[0]) for line in NICKNAMES.strip().splitlines() for n in line.split(":")[1].split()}
_NICK_FORMS = frozenset(n for n, _ in _NICK)
_GIVEN = frozenset(x for pair in _NICK for x in pair)
_ROOTS: dict[str, set[str]] = {}
for _n, _full in _NICK:
    _ROOTS.setdefault(_n, set()).add(_full[0])
_ORDER = {"same": 0, "typo": 1, "short": 2, "": 9}
_JOINING = frozenset("the of and".split())


def _low(name: str) -> str:
    """Lower case without accents and quotes."""
    low = name.lower().translate(_STROKES)
    if not low.isascii():
        low = "".join(c for c in unicodedata.normalize("NFKD", low) if not unicodedata.combining(c))
    return low.replace("'", "").replace("’", "")


def core(name: str) -> list[str]:
    """The sorted core tokens: lower case without accents, quotes, titles,
    generations and legal forms; initials only where little else is left, and
    joined where nothing else is (an acronym with points)."""
    words = _WORD.findall(_low(name))
    kept = [w for w in words if w not in _DROPPED] or words
    long = [w for w in kept if len(w) > 1]
    if not long and len(kept) > 1:
        return ["".join(kept)]
    return sorted(long if len(long) > 1 else kept)


def initials(name: str) -> list[str]:
    """The acronyms that a name of two or more words may have: of all words,
    without joining words, and of the core alone. What stands before a comma is
    taken to the end, unless only titles, generations or legal forms follow."""
    head, _, tail = _low(name).partition(",")
    first, last = _WORD.findall(head), _WORD.findall(tail)
    words = first + last if all(w in _DROPPED for w in last) else last + first
    if all(len(w) == 1 for w in words):
        return []
    kinds = (words, [w for w in words if w not in _JOINING], [w for w in words if w not in _DROPPED])
    return sorted({"".join(w[0] for w in k) for k in kinds if len(k) > 1})


def is_acronym(name: str) -> bool:
    """Whether a name may be an acronym: one token of two or more letters, a
    familiar given name only where it is written in single letters."""
    tokens = core(name)
    if len(tokens) != 1 or len(tokens[0]) < 2 or not tokens[0].isalpha():
        return False
    return tokens[0] not in _NICK_FORMS or tokens[0] not in _WORD.findall(_low(name))


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & where.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _token(a: str, b: str, organisation: bool) -> tuple[str, int]:
    """How two tokens agree ('same', 'typo', 'short' or '') and in how many letters."""
    if a == b:
        return "same", len(a)
    if len(a) > len(b):
        a, b = b, a
    if (a, b) in _NICK:
        return "short", 0
    if len(a) >= 3 and 2 * len(a) >= SHORT_RATIO * (len(a) + len(b)):
        common = lcs(a, b)
        if 2 * common >= (RATIO if len(b) > 4 else SHORT_RATIO) * (len(a) + len(b)):
            return "typo", common
    if len(a) <= 4 and len(a) < len(b) and b.startswith(a):
        return "short", 0
    if organisation and 3 <= len(a) <= 5 and len(b) >= 6 and a[0] == b[0] and lcs(a, b) == len(a):
        return "short", 0
    return "", 0


def agree(a: list[str], b: list[str]) -> str:
    """Whether two cores name the same: 'full', 'short' (up to an abbreviated
    or familiar given name) or ''."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == 1:
        if len(b) != 1 or min(len(a[0]), len(b[0])) < 5:
            return ""
    organisation = len(b) > 2
    left, typos, shorts, anchor, common, letters = list(b), 0, 0, False, 0, 0
    for t in sorted(a, key=len, reverse=True):
        best, rank, shared = None, 9, 0
        for u in left:
            how, n = _token(t, u, organisation)
            r = _ORDER[how]
            if r < rank or r == rank == 1 and n > shared:
                best, rank, shared = u, r, n
        if best is None:
            return ""
        left.remove(best)
        typos += rank == 1
        shorts += rank == 2
        if rank < 2:
            common += 2 * shared
            letters += len(t) + len(best)
        anchor |= rank == 0 and len(t) >= 2 or rank == 1 and len(t) >= 5
    if not anchor or typos > 1 and common < SEVERAL_RATIO * letters or shorts > 1 + organisation:
        return ""
    if left and len(a) < 2 or len(left) > 1:
        return ""
    if left and shorts and not organisation:
        return ""
    return "short" if shorts and not organisation else "full"


def blocks(tokens: list[str]) -> list[str]:
    """The blocks of a core: of each token its last ``SHORTEST`` letters (a shorter
    token whole, single letters none), and its ending with any one letter left out,
    so that a typo in the ending does not part two names. The latter are many, so
    they are refined with the first letter of another token, or of the full name
    that a familiar one stands for."""
    out = set()
    familiar = [t in _GIVEN for t in tokens]
    for i, t in enumerate(tokens):
        if len(t) < 2:
            continue
        out.add(t[-SHORTEST:])
        # A known given name is met through the other token.
        if len(t) < SHORTEST or familiar[i] and not all(familiar):
            continue
        others = [w for j, w in enumerate(tokens) if j != i]
        heads = {w[0] for w in others}
        if len(others) > 1:
            heads = {min(heads)}
        for w in others if len(others) == 1 else ():
            heads |= _ROOTS.get(w, set())
        tail = t[-SHORTEST - 1 :]
        for k in range(len(tail)):
            out |= {f"{tail[:k]}{tail[k + 1 :]}|{h}" for h in heads or [""]}
    return sorted(out)


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Core and initials of each name, and whether it may be an acronym."""
    for batch in batches:
        names = batch.column("name").to_pylist()
        batch = batch.append_column("core", pa.array([" ".join(core(n)) for n in names], pa.string()))
        batch = batch.append_column("initials", pa.array([initials(n) for n in names], pa.list_(pa.string())))
        yield batch.append_column("acronym", pa.array([is_acronym(n) for n in names], pa.bool_()))


def _file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(slot, scope, core)``: a row for each block of a core; the slot is a hash of
    scope and block, so only names of one scope may be compared in it."""
    for batch in batches:
        slots, rows = [], []
        for i, (scope, c) in enumerate(zip(batch.column("scope").to_pylist(), batch.column("core").to_pylist())):
            own = [xxhash.xxh64_intdigest(f"{scope}\t{b}") for b in blocks(c.split(" "))]
            slots += own
            rows += [i] * len(own)
        at = pa.array(rows, pa.int64())
        yield pa.record_batch({"slot": pa.array(np.array(slots, np.uint64).view(np.int64)), "scope": batch.column("scope").take(at), "core": batch.column("core").take(at)})


def _blocks(cores: DataFrame, scratch: Scratch) -> DataFrame:
    """``(slot, cell, scope, core, filed, asks)``: keys by their blocks, crowded
    blocks over the cells of a grid."""
    rows = scratch.keep(cores.mapInArrow(_file, "slot long, scope string, core string"), "blocks")
    sizes = rows.groupBy("slot").agg(F.count("*").alias("size")).where("size > 1")
    rows = rows.join(sizes, "slot").withColumn("parts", F.ceil(F.col("size") / BLOCK)).drop("size")
    rows = rows.withColumn("key", F.xxhash64("core")).withColumn("filed", F.lit(True))
    return in_cells(rows, "key", "parts", "filed").drop("key")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within the cells of one sorted partition, between a filed and an asking key."""
    at, block, seen = None, [], set()

    def links():
        out = []
        for x, a, filed, _ in block:
            if not filed:
                continue
            for y, b, _, asks in block:
                # Each pair meets twice, once with the smaller key filed.
                if not asks or x >= y:
                    continue
                pair = (at[2], x, y)
                if pair in seen:
                    continue
                seen.add(pair)
                how = agree(b, a)
                if how:
                    out.append((*pair, how == "full"))
        return out

    def batch_of(out):
        cols = list(zip(*out)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.string(), pa.bool_()))], ["scope", "a", "b", "strong"])

    for batch in batches:
        out = []
        for slot, cell, scope, c, filed, asks in zip(*(batch.column(x).to_pylist() for x in ("slot", "cell", "scope", "core", "filed", "asks"))):
            if (slot, cell, scope) != at:
                if len(block) > 1:
                    out += links()
                at, block = (slot, cell, scope), []
                if len(seen) > 500_000:
                    seen.clear()
            block.append((c, c.split(" "), filed, asks))
        yield batch_of(out)
    if len(block) > 1:
        yield batch_of(links())


def link_names(names: DataFrame) -> DataFrame:
    """``(scope, name, group)`` for a table ``(scope, name)``: spellings of one
    node share a group. Null scopes and null or blank names are left out, rows
    repeated count once; names without any letter or digit stand alone."""
    scratch = Scratch(names.sparkSession, "names")
    whole = names.where("scope is not null and name is not null").select("scope", "name").distinct().where(F.regexp_replace("name", r"[\s\p{Z}\"']+", "") != "")
    named = scratch.keep(whole.mapInArrow(_spread, "scope string, name string, core string, initials array<string>, acronym boolean").where("core <> ''"), "named")
    cores = named.select("scope", "core").distinct()
    filed = _blocks(scratch.keep(cores, "cores"), scratch)
    links = filed.repartition("slot", "cell").sortWithinPartitions("slot", "cell", "scope", "core").mapInArrow(_compare, "scope string, a string, b string, strong boolean")
    links = scratch.keep(links.distinct(), "links")
    end = lambda c: F.concat_ws("\t", "scope", c)
    strong = links.where("strong").select(end("a").alias("a"), end("b").alias("b"))
    groups = scratch.keep(connected_groups(strong), "strong")
    weak = links.where("not strong").select(end("a").alias("a"), end("b").alias("b"))

    def grouped(df, c):
        return df.join(groups.select(F.col("id").alias(c), F.col("group_id").alias("g")), c, "left").withColumn(c, F.coalesce("g", c)).drop("g")

    weak = grouped(grouped(weak, "a"), "b").where("a <> b").distinct()
    # The shorter side of each link is the one that may be ambiguous.
    sides = weak.select(F.when(F.length("a") < F.length("b"), F.col("a")).otherwise(F.col("b")).alias("short"), F.when(F.length("a") < F.length("b"), F.col("b")).otherwise(F.col("a")).alias("long")).distinct()
    acronyms = named.where("acronym").select("scope", F.col("core").alias("a")).distinct()
    meant = named.select("scope", F.explode("initials").alias("a"), F.col("core").alias("b")).distinct().join(acronyms, ["scope", "a"]).select(end("a").alias("a"), end("b").alias("b"))
    sides = sides.union(grouped(grouped(meant, "a"), "b").where("a <> b").select("a", "b")).distinct()
    only = sides.join(sides.select(F.col("short").alias("long")).distinct(), "long", "left_anti").groupBy("short").agg(F.count("*").alias("k"), F.min("long").alias("long")).where("k = 1")
    joined = scratch.keep(strong.union(only.select("short", "long")), "joined")
    final = connected_groups(joined).select(F.col("id").alias("key"), "group_id")
    return named.withColumn("key", end("core")).join(final, "key", "left").select("scope", "name", F.coalesce("group_id", "key").alias("group"))


def graph_names(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """``(scope, name)`` of all three name columns."""
    return (
        entities.select(F.col("graph_id").alias("scope"), F.col("entity_name").alias("name"))
        .union(relationships.select("graph_id", F.explode(F.array("src_id", "tgt_id"))))
    )


def same_node_pairs(names: DataFrame) -> DataFrame:
    """``(scope, a, b)``, a < b: all pairs of different spellings of one node."""
    groups = Scratch(names.sparkSession, "pairs").keep(link_names(names), "groups")
    left, right = groups.withColumnRenamed("name", "a"), groups.withColumnRenamed("name", "b")
    return left.join(right, ["scope", "group"]).where("a < b").select("scope", "a", "b")
