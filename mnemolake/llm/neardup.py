"""Near-duplicate records with small edits (problem 6).

Token-group matrix. A record is the set of its words. For each rare word of a
record's prefix the records that carry it are kept in groups of similar records
(alike in size and in word bitmap); a group stores the union of its members'
word bitmaps, a row of the token-group matrix folded to 128 columns. A query
record visits the groups filed under its own prefix words, bounds its overlap
with each group's union, opens only groups that can hold a partner, bounds the
members by their bitmaps, and the few pairs left are checked exactly on words.
Every filter is an upper bound of the overlap, so no pair is lost.

Prefix rule, for a similarity of p/q: two sets of sizes a <= b must share
need(a, b) = ceil(p (a + b) / (p + q)) words, so under any common order of words
they share one among the first a - need(a, a) + 1 words of the smaller and the
first b - ceil(p b / q) + 1 of the larger. The order is: rare words first (by
hash), then words that occur in at least ``floor`` sets, by count. At most
(all word occurrences) / floor words are that frequent, which bounds the
broadcast; ``floor`` rises with the corpus so that the bound stays 500,000.

Sets that are equal are one class: only its representative is searched. Postings
of a word with more than ``POSTINGS_PER_TASK`` sets are split over the cells of a
grid, which the queries visit: a posting of such a word is copied once for every so
many, so the shuffle of one word grows with the square of its sets beyond that number.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from .components import connected_groups

_WORD = re.compile(r"[^\W_]+").findall
MAX_FREQUENT = 500_000
MIN_FLOOR = 1000
POSTINGS_PER_TASK = 8192
POSTINGS_A_TASK = 500_000
GROUP = 16


def note_texts(notes: DataFrame) -> DataFrame:
    """``(id, text)``: content and summary of each note, nulls as empty; rows
    without an id are left out."""
    return notes.where("memory_id is not null").select(F.col("memory_id").alias("id"), F.concat_ws(" ", "content", "summary").alias("text"))


def words_of(text: str | None) -> set[str]:
    """The distinct lower-cased maximal runs of letters and digits."""
    if not text:
        return set()
    return set(_WORD(text.lower())) if text.isascii() else {w.lower() for w in _WORD(text)}


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(id, doc, toks)``: doc is a hash of the whole set, toks are 31-bit hashes
    of its words (words that fall together only raise an upper bound)."""
    known: dict[str, int] = {}
    for batch in batches:
        docs, toks = [], []
        for text in batch.column("text").to_pylist():
            full = []
            for w in words_of(text):
                h = known.get(w)
                if h is None:
                    h = known[w] = xxhash.xxh64_intdigest(w)
                full.append(h)
            full.sort()
            arr = np.array(full, np.uint64)
            docs.append(np.uint64(xxhash.xxh64_intdigest(arr.tobytes())).view(np.int64))
            toks.append((arr & np.uint64(0x7FFFFFFF)).astype(np.int32))
        if len(known) > 1_000_000:
            known.clear()
        offsets = np.r_[0, np.cumsum([len(t) for t in toks])].astype(np.int32)
        values = pa.array(np.concatenate(toks) if toks else np.empty(0, np.int32))
        out = pa.record_batch({"id": batch.column("id"), "doc": pa.array(np.array(docs, np.int64)), "toks": pa.ListArray.from_arrays(pa.array(offsets), values)})
        yield out.filter(pa.array(np.diff(offsets) > 0))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [list(words_of(x)) for x in batch.column("text").to_pylist()]
        yield pa.record_batch({"id": batch.column("id"), "words": pa.array(words, pa.list_(pa.string()))})


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of the words, a batch at a time."""
    for batch in batches:
        tok, n = np.unique(batch.column("toks").flatten().to_numpy(zero_copy_only=False), return_counts=True)
        yield pa.record_batch({"tok": tok.astype(np.int32), "n": n.astype(np.int64)})


def _need(a, b, p: int, q: int):
    return -(-(p * (a + b)) // (p + q))


def _postings(batches: Iterator[pa.RecordBatch], frequent, p: int, q: int, per_task: int) -> Iterator[pa.RecordBatch]:
    """One row for each prefix word (and part of its postings) of each set."""
    names, counts = frequent.value
    for batch in batches:
        col = batch.column("toks")
        n = np.diff(col.offsets.to_numpy()).astype(np.int64)
        toks = col.flatten().to_numpy(zero_copy_only=False)
        if not len(toks):
            continue
        row = np.repeat(np.arange(len(n)), n)
        at = np.minimum(np.searchsorted(names, toks), max(len(names) - 1, 0))
        count = np.where(names[at] == toks, counts[at], 0) if len(names) else np.zeros(len(toks), np.int64)
        bits = (toks.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(57)
        maps = np.zeros((len(n), 2), np.uint64)
        np.bitwise_or.at(maps, (row, (bits >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bits & np.uint64(63)))
        order = np.lexsort((toks, count, row))
        starts = np.cumsum(n) - n
        pos = np.arange(len(toks)) - np.repeat(starts, n)
        size = np.repeat(n, n)
        keep = pos < size + 1 + (-(p * size) // q)
        tok, row, pos, count = toks[order][keep], row[keep], pos[keep], count[order][keep]
        # A frequent word's postings are split into parts, and so are its queries; a cell
        # of the grid holds one part of each. A set is filed in one part, for the
        # queries of all, and asks in one part, the filed of all.
        doc = batch.column("doc").to_numpy(zero_copy_only=False)[row]
        parts = np.maximum(1, -(-count // per_task))
        rows = 2 * parts - 1
        many = np.repeat(np.arange(len(tok)), rows)
        i = np.arange(len(many)) - np.repeat(np.cumsum(rows) - rows, rows)
        n_parts, own = parts[many], (doc % parts)[many]
        asks = i < n_parts
        other = i - n_parts + (i - n_parts >= own)
        filed = ~asks | (i == own)
        cell = np.where(asks, i << 32 | own, own << 32 | other)
        row, pos = row[many], pos[many]
        yield pa.record_batch(
            {
                "tok": tok[many],
                "cell": cell,
                "doc": doc[many],
                "shape": (n[row] << 33) | (pos << 2) | (asks.astype(np.int64) << 1) | filed,
                "m1": maps[row, 0].view(np.int64),
                "m2": maps[row, 1].view(np.int64),
            }
        )


def _may(i, j, c, p: int, q: int):
    """Which pairs (smaller i, larger j) of arrays c can reach the similarity."""
    a, b = c["n"][i], c["n"][j]
    need = _need(a, b, p, q)
    ok = np.minimum(a - c["pos"][i], b - c["pos"][j]) >= need
    i, j, a, b, need = i[ok], j[ok], a[ok], b[ok], need[ok]
    ok = (a < b) | ((a == b) & (c["doc"][i] < c["doc"][j]))
    ok &= a * q >= b * p
    i, j, need = i[ok], j[ok], need[ok]
    a1, a2, b1, b2 = c["m1"][i], c["m2"][i], c["m1"][j], c["m2"][j]
    left = np.bitwise_count(a1 & ~b1).astype(np.int64) + np.bitwise_count(a2 & ~b2)
    ok = c["n"][i] - left >= need
    i, j, need = i[ok], j[ok], need[ok]
    right = np.bitwise_count(c["m1"][j] & ~c["m1"][i]).astype(np.int64) + np.bitwise_count(c["m2"][j] & ~c["m2"][i])
    ok = c["n"][j] - right >= need
    return i[ok], j[ok]


def _open_groups(lo: int, hi: int, c, p: int, q: int, block: int = 512):
    """Candidate pairs within the postings lo..hi of one word (sorted by size and
    bitmap): bound each query against each group's union, then open."""
    members = np.arange(lo, hi)[c["filed"][lo:hi]]
    if not len(members):
        return
    starts = np.arange(0, len(members), GROUP)
    u1, u2 = np.bitwise_or.reduceat(c["m1"][members], starts), np.bitwise_or.reduceat(c["m2"][members], starts)
    least, most = np.minimum.reduceat(c["n"][members], starts), np.maximum.reduceat(c["n"][members], starts)
    first = np.minimum.reduceat(c["pos"][members], starts)
    n1, n2 = ~u1, ~u2
    asking = np.arange(lo, hi)[c["asks"][lo:hi]]
    for at in range(0, len(asking), block):
        ask = asking[at : at + block]
        n = c["n"][ask][:, None]
        need = _need(least[None, :], n, p, q)
        fits = (most[None, :] * q >= n * p) & (least[None, :] <= n) & (1 + np.minimum(most - 1 - first, n - 1 - c["pos"][ask][:, None]) >= need)
        r, g = np.nonzero(fits)
        lost = np.bitwise_count(c["m1"][ask[r]] & n1[g]).astype(np.int64) + np.bitwise_count(c["m2"][ask[r]] & n2[g])
        ok = c["n"][ask[r]] - lost >= need[r, g]
        r, g = r[ok], g[ok]
        j = np.repeat(ask[r], GROUP)
        k = (starts[g][:, None] + np.arange(GROUP)).ravel()
        inside = k < len(members)
        yield _may(members[k[inside]], j[inside], c, p, q)


def _candidates(batches: Iterator[pa.RecordBatch], p: int, q: int) -> Iterator[pa.RecordBatch]:
    """Pairs of sets that may reach the similarity, from one partition of postings."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    raw = {k: table.column(k).to_numpy() for k in table.column_names}
    n = raw["shape"] >> 33
    order = np.lexsort((raw["m1"], n >> 2, raw["cell"], raw["tok"]))
    c = {
        "n": n[order],
        "pos": (raw["shape"][order] >> 2) & 0x7FFFFFFF,
        "asks": (raw["shape"][order] & 2) == 2,
        "doc": raw["doc"][order],
        "m1": raw["m1"][order].view(np.uint64),
        "m2": raw["m2"][order].view(np.uint64),
    }
    # Only words of the shorter prefix are filed; any prefix word is asked for.
    c["filed"] = (c["pos"] <= c["n"] - _need(c["n"], c["n"], p, q)) & ((raw["shape"][order] & 1) == 1)
    tok, cell = raw["tok"][order], raw["cell"][order]
    cut = np.flatnonzero(np.r_[True, (tok[1:] != tok[:-1]) | (cell[1:] != cell[:-1]), True])
    length = np.diff(cut)
    found = []
    for k in np.flatnonzero(length > 64):
        found.extend(_open_groups(cut[k], cut[k + 1], c, p, q))
    small = np.flatnonzero((length > 1) & (length <= 64))
    work = np.cumsum(length[small] ** 2)
    for ids in np.split(small, np.searchsorted(work, np.arange(2_000_000, work[-1], 2_000_000)) if len(work) else []):
        m = length[ids]
        i = np.repeat(np.concatenate([np.arange(a, a + b) for a, b in zip(cut[ids], m)]), np.repeat(m, m)) if len(ids) else np.empty(0, np.int64)
        if not len(i):
            continue
        square = m * m
        offset = np.arange(square.sum()) - np.repeat(np.cumsum(square) - square, square)
        j = np.repeat(cut[ids], square) + offset % np.repeat(m, square)
        ok = c["filed"][i] & c["asks"][j] & (i != j)
        found.append(_may(i[ok], j[ok], c, p, q))
    if not found:
        return
    i, j = np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])
    x, y = c["doc"][i], c["doc"][j]
    pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0)
    yield pa.record_batch({"x": pairs[:, 0], "y": pairs[:, 1]})


class SimilarSets:
    """Pairs of different word sets with a Jaccard similarity of ``least`` or more.

    ``records``: ``(id, text)``, a record being the set of its text's words. ``classes()`` has a row per
    id with the representative (smallest id) of the records with an equal set;
    ``links()`` the pairs of representatives. Records without words belong to no
    class; rows repeated count once; an empty table gives empty results.
    """

    def __init__(self, records: DataFrame, least: str = "0.7"):
        share = Fraction(least)
        if not 0 < share <= 1:
            raise ValueError("the similarity must be over 0 and at most 1")
        self.p, self.q = share.numerator, share.denominator
        self.records, self.spark = records, records.sparkSession
        self.scratch = Scratch(self.spark, "sets")
        kind = records.schema["id"].dataType.simpleString()
        self.sets = self.scratch.keep(records.select("id", "text").mapInArrow(_sets, f"id {kind}, doc long, toks array<int>"), "sets")
        self.first = self.scratch.keep(self.sets.groupBy("doc").agg(F.min("id").alias("rep")), "first")

    def classes(self) -> DataFrame:
        return self.sets.select("id", "doc").distinct().join(self.first, "doc").select("id", "rep")

    def _frequent(self):
        counted = self.sets.select("toks").mapInArrow(_counts, "tok int, n long").groupBy("tok").agg(F.sum("n").alias("n"))
        counted = self.scratch.keep(counted, "counts")
        total = counted.agg(F.sum("n")).first()[0] or 0
        floor = max(MIN_FLOOR, -(-total // MAX_FREQUENT))
        rows = sorted(tuple(r) for r in counted.where(F.col("n") >= floor).collect())  # at most total / floor rows
        return self.spark.sparkContext.broadcast((np.array([r[0] for r in rows], np.int32), np.array([r[1] for r in rows], np.int64)))

    def links(self) -> DataFrame:
        """``(a, b)``, a < b: representatives whose sets reach the similarity."""
        p, q, per_task = self.p, self.q, POSTINGS_PER_TASK
        unique = self.sets.select("doc", "toks").dropDuplicates(["doc"])
        frequent = self._frequent()
        postings = unique.mapInArrow(lambda b: _postings(b, frequent, p, q, per_task), "tok int, cell long, doc long, shape long, m1 long, m2 long")
        # About 20 postings a set; a task's partition is held in memory.
        tasks = max(self.spark.sparkContext.defaultParallelism, -(-20 * self.first.count() // POSTINGS_A_TASK))
        pairs = postings.repartition(tasks, "tok", "cell").mapInArrow(lambda b: _candidates(b, p, q), "x long, y long")
        pairs = self.scratch.keep(pairs.distinct(), "pairs")
        named = pairs.join(self.first.select(F.col("doc").alias("x"), F.col("rep").alias("a")), "x").join(self.first.select(F.col("doc").alias("y"), F.col("rep").alias("b")), "y").select("a", "b")
        return self._checked(named)

    def _checked(self, pairs: DataFrame) -> DataFrame:
        """Exact check of candidate pairs on the words themselves."""
        pairs = self.scratch.keep(pairs, "named")
        asked = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        kind = self.records.schema["id"].dataType.simpleString()
        texts = self.records.select("id", "text").join(asked, "id", "left_semi")
        words = self.scratch.keep(texts.mapInArrow(_words, f"id {kind}, words array<string>").dropDuplicates(["id"]), "words")
        both = pairs.join(words.select(F.col("id").alias("a"), F.col("words").alias("u")), "a").join(words.select(F.col("id").alias("b"), F.col("words").alias("v")), "b")
        shared = F.size(F.array_intersect("u", "v"))
        return both.where(shared * (self.p + self.q) >= self.p * (F.size("u") + F.size("v"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def similar_pairs(records: DataFrame, least: str = "0.7") -> DataFrame:
    """``(a, b)``, a < b: all pairs of ids whose sets reach the similarity, equal
    sets included, as a stated list of cases needs them. A class of n equal
    records has n (n - 1) / 2 pairs; ``similar_groups`` has the compact form."""
    found = SimilarSets(records, least)
    classes = found.scratch.keep(found.classes(), "classes")
    links = found.scratch.keep(found.links(), "links")
    left, right = classes.select(F.col("rep").alias("a"), F.col("id").alias("i")), classes.select(F.col("rep").alias("b"), F.col("id").alias("j"))
    across = links.join(left, "a").join(right, "b").select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"))
    equal = left.join(right.withColumnRenamed("b", "a"), "a").where("i < j").select(F.col("i").alias("a"), F.col("j").alias("b"))
    return across.union(equal)


def similar_groups(records: DataFrame, least: str = "0.7") -> DataFrame:
    """``(id, rep, group_id, n_links)``, one row per record: the representative
    of its equal sets, the smallest id of its group of linked sets, and the
    number of other sets linked to its own."""
    found = SimilarSets(records, least)
    links = found.scratch.keep(found.links(), "links")
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    groups = connected_groups(links).select(F.col("id").alias("rep"), "group_id")
    return found.classes().join(groups, "rep", "left").join(degree, "rep", "left").select("id", "rep", F.coalesce("group_id", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
