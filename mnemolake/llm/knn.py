"""Most similar vectors for every vector (problem 4).

Multi-index hashing. Learned rotations (iterative quantisation), a word of code bits
each, give every vector a binary code, cut into substrings; each substring is an
index table. Substrings are about log2(n) bits wide, so a bucket holds few vectors
whatever their number, and there are rotations enough for ``TABLES`` tables. By the
pigeonhole principle two codes within Hamming distance tables * (s + 1) - 1 agree in
one substring up to s bits: a query probes, in each table, the substrings within s
bits of its own and meets every code of that radius. Step s = 1 is for all; a query
that met fewer than SURE k codes within its radius goes on with s = 2 and 3, and further
while it met fewer than SURE k vectors at all. What is met is ranked by the distance
of vectors in half precision, which travel with the codes, and the shortlist's best are
reranked by the float vectors, in double precision; ties go to the smaller id.

A bucket with more than ``Sizes.crowd`` vectors is a crowd: vectors too alike for the code.
Crowds up to ``Sizes.floats`` are searched on the float vectors; a larger one is a
collection of its own, whose bits have the crowd's mean for a threshold and whose
substrings follow its size, and so on down to crowds that are small.

Layout: a table is cut by the leading bits of its substring, as many as keep a cut
near ``Sizes.rows`` vectors. Probes that flip trailing bits stay in the vector's own cut;
only flips of leading bits send a row elsewhere. A cut that holds more is split over
the cells of a grid, vectors by queries. A pair met in several tables is emitted in
the first only. Equal vectors are searched once.

The rotations are fitted on at most ``SAMPLE`` vectors (smallest id hashes);
every vector is indexed and every vector is a query.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, log2
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch
from .cells import in_cells

TABLES = 8
SAMPLE = 20_000
ROWS_A_TASK = 250_000
MOST_STEPS, MOST_LEVELS = 3, 4
# A query is done with so many times k codes within its radius: codes tell distances roughly.
SURE = 1
FAR, NEAR, ASKS, MEMBER = 0, 1, 2, 3


def usable(vectors: DataFrame, dim: int = 64) -> DataFrame:
    """``(id, vec)`` of the rows with an id and ``dim`` finite values, not all
    zero; of rows with one id the least vector counts."""
    ok = F.size("vec") == dim
    ok &= ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok &= F.exists("vec", lambda x: x != 0)
    return vectors.where(F.col("id").isNotNull() & F.col("vec").isNotNull()).where(ok).groupBy("id").agg(F.min("vec").alias("vec"))


def _unit(col: pa.Array, dim: int) -> np.ndarray:
    x = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Sizes(NamedTuple):
    """Vectors of a cut, of a bucket before it is a crowd, of a crowd that is searched on
    floats and of a cell of it; candidates of a query that are kept of a cut (more than
    the neighbours asked for) and that are reranked."""

    rows: int = 65_536
    crowd: int = 64
    floats: int = 16_384
    cell: int = 4096
    of_cut: int = 8
    shortlist: int = 8


class Layout:
    """How a collection of n vectors is cut: substring width, leading bits, tables."""

    def __init__(self, n: int, word: int, words: int | None = None, rows: int = Sizes().rows):
        self.word = word
        self.width = max(1, min(32, word, max(8, ceil(log2(max(n, 2))))))
        self.a_word = word // self.width
        self.words = words or max(2, -(-TABLES // self.a_word))
        self.tables = self.a_word * self.words
        self.lead = max(0, min(self.width - 2, max(2, ceil(log2(max(1, n / rows))))))
        self.low = self.width - self.lead

    def shift(self, table: int) -> int:
        return self.word - self.width * (table % self.a_word + 1)

    def sub(self, code: np.ndarray, table: int) -> np.ndarray:
        """The substring of a table, of codes ``(n, words)``."""
        return code[:, table // self.a_word] >> np.uint64(self.shift(table)) & np.uint64((1 << self.width) - 1)

    def radius(self, step: int) -> int:
        return self.tables * (step + 1) - 1


def masks(bits: int, flips: int) -> list[int]:
    """All numbers of so many bits with so many ones."""
    return [sum(1 << i for i in c) for c in combinations(range(bits), flips)]


def fit_rotations(sample: np.ndarray, words: int = 2, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Mean and rotations that bring the sample nearest to the corners of a cube."""
    mean = sample.mean(0)
    z = sample - mean
    axes = np.linalg.eigh(z.T @ z)[1][:, ::-1]
    p, out = z @ axes, []
    for seed in range(words):
        r = np.linalg.qr(np.random.default_rng(seed).standard_normal(axes.shape))[0]
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.sign(p @ r).T @ p)
            r = (u @ w).T
        out.append((axes @ r)[:, : min(64, axes.shape[0])])
    return mean, np.hstack(out)


def _mix(a, b) -> np.ndarray:
    """A hash of two columns of numbers, as long."""
    a, b = np.atleast_1d(a), np.atleast_1d(b)
    x = (a.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ b.astype(np.int64).view(np.uint64)
    for k, m in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(k))) * np.uint64(m)
    return (x ^ (x >> np.uint64(31))).view(np.int64)


def _code(batches: Iterator[pa.RecordBatch], model, dim: int) -> Iterator[pa.RecordBatch]:
    """Rows (group, n, key, filed, asks, vec, centre) with their body: the code's
    words, the vector from the centre in half precision and its square length."""
    mean, rotation = model.value
    word = min(64, dim)
    for batch in batches:
        if not batch.num_rows:
            continue
        x = _unit(batch.column("vec"), dim)
        own = batch.column("centre")
        centre = mean if own.null_count else own.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        x = x - centre
        bits = (x @ rotation > 0).reshape(len(x), -1, word)
        packed = np.packbits(np.pad(bits, ((0, 0), (0, 0), (64 - word, 0))), axis=2)
        small = x.astype("<f2")
        square = (small.astype(np.float32) ** 2).sum(1, keepdims=True).astype("<f4")
        body = np.hstack([packed.reshape(len(x), -1), small.view(np.uint8), square.view(np.uint8)])
        data = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1) * body.shape[1]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(body))])
        yield pa.record_batch({**{c: batch.column(c) for c in ("group", "n", "key", "filed", "asks")}, "body": data})


CODED = "group long, n long, key long, filed boolean, asks boolean, body binary"


def _bodies(col: pa.Array) -> np.ndarray:
    """The equally long values of a binary column, as rows of bytes."""
    at = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]
    return np.frombuffer(col.buffers()[2], np.uint8)[at[0] : at[-1]].reshape(len(col), -1)


def _words(body: np.ndarray, words: int) -> np.ndarray:
    return np.ascontiguousarray(body[:, : 8 * words]).view(">u8").astype(np.uint64)


def _slots(batches: Iterator[pa.RecordBatch], dim: int, words: int, sizes: Sizes) -> Iterator[pa.RecordBatch]:
    """``(slot, count)``: filed vectors of each cut, a batch at a time."""
    for batch in batches:
        n, group, filed = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n", "group", "filed"))
        code, out = _words(_bodies(batch.column("body")), words), []
        for size in np.unique(n):
            mine, lay = filed & (n == size), Layout(int(size), min(64, dim), words, sizes.rows)
            for t in range(lay.tables):
                out.append(_mix(_mix(group[mine], np.full(mine.sum(), t)), lay.sub(code[mine], t).astype(np.int64) >> lay.low))
        slot, count = np.unique(np.concatenate(out), return_counts=True)
        yield pa.record_batch({"slot": slot, "count": count.astype(np.int64)})


def _rows(batches: Iterator[pa.RecordBatch], dim: int, words: int, sizes: Sizes, step: int, crowded) -> Iterator[pa.RecordBatch]:
    """Index rows and probing rows: (slot, cell, t, n, group, want, flips, filed, key,
    body); flips is the number of leading bits changed, -1 for a row that asks nothing."""
    names = np.array(sorted(crowded.value), np.int64)
    split = np.array([crowded.value[k] for k in names.tolist()], np.int64)
    for batch in batches:
        n, group, key, filed, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n", "group", "key", "filed", "asks"))
        code, out = _words(_bodies(batch.column("body")), words), []
        for size in np.unique(n):
            mine, lay = np.flatnonzero(n == size), Layout(int(size), min(64, dim), words, sizes.rows)
            for t in range(lay.tables):
                sub = lay.sub(code, t).astype(np.int64)
                for flips in range(-1, step + 1):
                    rows = mine[~asks[mine]] if flips < 0 else mine[asks[mine]]
                    for m in masks(lay.lead, max(0, flips)):
                        want = sub[rows] ^ (m << lay.low)
                        slot = _mix(_mix(group[rows], np.full(len(rows), t)), want >> lay.low)
                        out.append((slot, np.full(len(rows), t), want, np.full(len(rows), flips), filed[rows] & (flips <= 0), rows))
        slot, t, want, flips, home, rows = (np.concatenate(c) for c in zip(*out))
        # A crowded cut is split over the cells of a grid, filed by asking.
        at = np.minimum(np.searchsorted(names, slot), max(0, len(names) - 1))
        parts = np.where(names[at] == slot, split[at], 1) if len(names) else np.ones(len(slot), np.int64)
        copies = np.where(home, 2 * parts - 1, parts)
        many = np.repeat(np.arange(len(slot)), copies)
        i = np.arange(len(many)) - np.repeat(np.cumsum(copies) - copies, copies)
        of, own = parts[many], (key[rows] % parts)[many]
        asking = i < of
        cell = np.where(asking, i << 32 | own, own << 32 | (i - of + (i - of >= own)))
        home = home[many] & (~asking | (i == own))
        flips = np.where(asking, flips[many], -1)
        keep = home | (flips >= 0)
        many = many[keep]
        yield pa.RecordBatch.from_arrays(
            [pa.array(slot[many]), pa.array(cell[keep]), pa.array(t[many].astype(np.int32)), pa.array(n[rows[many]]), pa.array(group[rows[many]]), pa.array(want[many]), pa.array(flips[keep].astype(np.int32)), pa.array(home[keep]), pa.array(key[rows[many]]), batch.column("body").take(pa.array(rows[many]))],
            ["slot", "cell", "t", "n", "group", "want", "flips", "filed", "key", "body"],
        )


ROW = "slot long, cell long, t int, n long, group long, want long, flips int, filed boolean, key long, body binary"


def _best(q, score, limit: int) -> np.ndarray:
    """Positions of the rows with the highest scores of each q."""
    order = np.lexsort((-score, q))
    first = np.r_[True, q[order][1:] != q[order][:-1]]
    start = np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
    return order[np.arange(len(q)) - start < limit]


def _probe(batches: Iterator[pa.RecordBatch], dim: int, words: int, sizes: Sizes, step: int, exact: bool, members: bool) -> Iterator[pa.RecordBatch]:
    """What the queries met in one partition of the index: (q, i, kind, score). Of a
    cut, the best candidates of a query; a crowd it asks or is a member of. ``exact``
    takes substrings at just so many steps, those nearer being known."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    raw = {c: np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in ("slot", "cell", "t", "n", "group", "want", "flips", "filed", "key")}
    body = np.concatenate([_bodies(b.column("body")) for b in held])
    del held
    code = _words(body, words)
    small = np.ascontiguousarray(body[:, 8 * words : 8 * words + 2 * dim]).view("<f2")
    square = np.ascontiguousarray(body[:, 8 * words + 2 * dim :]).view("<f4").ravel()
    order = np.lexsort((raw["want"], raw["cell"], raw["slot"]))
    slot, cell = raw["slot"][order], raw["cell"][order]
    cut = np.flatnonzero(np.r_[True, (slot[1:] != slot[:-1]) | (cell[1:] != cell[:-1]), True])
    key, out = raw["key"], []

    def flushed(found):
        q, i, near, score = (np.concatenate(c) for c in zip(*found))
        top = _best(q, score, sizes.of_cut)
        return q[top], i[top], near[top], score[top]

    for a, b in zip(cut[:-1], cut[1:]):
        rows = order[a:b]
        here = rows[raw["filed"][rows]]
        if not len(here):
            continue
        t, lay = int(raw["t"][here[0]]), Layout(int(raw["n"][here[0]]), min(64, dim), words, sizes.rows)
        subs = raw["want"][here]
        table = _mix(raw["group"][here[0]], t)
        if members:
            value, count = np.unique(subs, return_counts=True)
            full = here[np.isin(subs, value[count > sizes.crowd])]
            out.append((key[full], _mix(np.full(len(full), table[0]), raw["want"][full]), np.full(len(full), MEMBER), np.zeros(len(full), np.float32)))
        found, met_so_far = [], 0
        for flips in range(step + 1):
            asking = rows[raw["flips"][rows] == flips]
            if not len(asking):
                continue
            for inside in [step - flips] if exact else range(step - flips + 1):
                for m in masks(lay.low, inside):
                    want = raw["want"][asking] ^ m
                    first, last = np.searchsorted(subs, want, "left"), np.searchsorted(subs, want, "right")
                    size = last - first
                    many = size > sizes.crowd
                    if many.any():
                        out.append((key[asking[many]], _mix(np.full(many.sum(), table[0]), want[many]), np.full(many.sum(), ASKS), np.zeros(many.sum(), np.float32)))
                    few = (size > 0) & ~many
                    n = size[few]
                    q = np.repeat(asking[few], n)
                    i = here[np.repeat(first[few], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                    for k in range(0, len(q), 500_000):
                        x, y = q[k : k + 500_000], i[k : k + 500_000]
                        differ = code[x] ^ code[y]
                        met, d = key[x] == key[y], np.zeros(len(x), np.int32)
                        for u in range(lay.tables):
                            off = np.bitwise_count(lay.sub(differ, u)).astype(np.int32)
                            d += off
                            if u < t:
                                met |= off <= step
                            elif exact:
                                met |= off < step
                        x, y, d = x[~met], y[~met], d[~met]
                        score = np.einsum("ij,ij->i", small[x].astype(np.float32), small[y].astype(np.float32)) * 2 - square[x] - square[y]
                        found.append((x, y, d <= lay.radius(step), score))
                        met_so_far += len(x)
                    if met_so_far > 2_000_000:
                        found = [flushed(found)]
                        met_so_far = 0
        if found:
            q, i, near, score = flushed(found)
            out.append((key[q], key[i], np.where(near, NEAR, FAR), score))
    if out:
        q, i, kind, score = (np.concatenate(c) for c in zip(*out))
        yield pa.record_batch({"q": q, "i": i, "kind": kind.astype(np.int32), "score": score.astype(np.float32)})


def _crowds(batches: Iterator[pa.RecordBatch], dim: int, k: int) -> Iterator[pa.RecordBatch]:
    """The k best of each crowd for each vector that probes it."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    crowd, cell = table.column("crowd").to_numpy(), table.column("cell").to_numpy()
    key, filed, asks = (table.column(c).to_numpy() for c in ("key", "filed", "asks"))
    unit = _unit(table.column("vec").combine_chunks(), dim)
    order = np.lexsort((cell, crowd))
    crowd, cell = crowd[order], cell[order]
    cut = np.flatnonzero(np.r_[True, (crowd[1:] != crowd[:-1]) | (cell[1:] != cell[:-1]), True])
    for a, b in zip(cut[:-1], cut[1:]):
        rows = order[a:b]
        here = rows[filed[rows]]
        if not len(here):
            continue
        rows = rows[asks[rows]]
        rows = rows[np.unique(key[rows], return_index=True)[1]]
        for at in range(0, len(rows), 512):
            q = rows[at : at + 512]
            cos = unit[q] @ unit[here].T
            cos[key[q][:, None] == key[here][None, :]] = -9
            best = np.argpartition(-cos, min(k, len(here)) - 1, axis=1)[:, :k]
            value = np.take_along_axis(cos, best, 1)
            r, c = np.nonzero(value > -9)
            yield pa.record_batch({"q": key[q[r]], "i": key[here[best[r, c]]], "cos": value[r, c]})


def _cosines(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            cos = np.einsum("ij,ij->i", _unit(batch.column("u"), dim), _unit(batch.column("v"), dim))
            yield pa.record_batch({"x": batch.column("x"), "y": batch.column("y"), "cos": cos})


def _top(df: DataFrame, by: str, k: int, *order) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


class _Search:
    """One run over the distinct vectors ``(key, vec)``."""

    def __init__(self, unique: DataFrame, total: int, model, words: int, dim: int, k: int, scratch: Scratch, sizes: Sizes):
        self.unique, self.total, self.model, self.words, self.dim, self.k, self.scratch, self.sizes = unique, total, model, words, dim, k, scratch, sizes
        self.cores = unique.sparkSession.sparkContext.defaultParallelism
        self.runs = 0
        # Whether a crowd was searched as a collection: then a pair may be met more than once.
        self.deep = False

    def coded(self, rows: DataFrame, name: str) -> DataFrame:
        model, dim = self.model, self.dim
        return self.scratch.keep(rows.mapInArrow(lambda b: _code(b, model, dim), CODED), name)

    def probe(self, coded: DataFrame, step: int, exact: bool, n: int, asking: int, members: bool) -> DataFrame:
        """What is met by the rows that ask among those filed; n of them and how many ask
        size the tasks."""
        dim, words, sizes = self.dim, self.words, self.sizes
        self.runs += 1
        lay = Layout(n, min(64, dim), words, sizes.rows)
        # A cut is crowded beyond four times its size, so there are few, which bounds what is collected.
        most = 4 * sizes.rows
        cuts = coded.mapInArrow(lambda b: _slots(b, dim, words, sizes), "slot long, count long").groupBy("slot").agg(F.sum("count").alias("n")).where(F.col("n") > most)
        crowded = coded.sparkSession.sparkContext.broadcast({r.slot: -(-r.n // most) for r in cuts.collect()})
        rows = coded.mapInArrow(lambda b: _rows(b, dim, words, sizes, step, crowded), ROW)
        count = lay.tables * (n + asking * sum(len(masks(lay.lead, f)) for f in range(1, step + 1)))
        tasks = max(self.cores, -(-count // ROWS_A_TASK))
        return self.scratch.keep(rows.repartition(tasks, "slot", "cell").mapInArrow(lambda b: _probe(b, dim, words, sizes, step, exact, members), "q long, i long, kind int, score float"), f"met{self.runs}")

    def memberships(self, met: DataFrame, known: DataFrame | None, starved: DataFrame | None) -> DataFrame:
        """``(key, crowd, filed, asks)``: members of crowds and who asks them; with the
        crowds known from nearer steps, the starved asking theirs again."""
        rows = met.where(F.col("kind") >= ASKS).groupBy(F.col("q").alias("key"), F.col("i").alias("crowd")).agg((F.max("kind") == MEMBER).alias("filed"), (F.min("kind") == ASKS).alias("asks"))
        if known is not None:
            again = known.join(starved.withColumn("hungry", F.lit(True)), "key", "left").select("key", "crowd", "filed", (F.col("asks") & F.col("hungry").isNotNull()).alias("asks"))
            rows = rows.union(again).groupBy("key", "crowd").agg(F.max("filed").alias("filed"), F.max("asks").alias("asks"))
        return self.scratch.keep(rows, f"crowded{self.runs}")

    def compared(self, crowded: DataFrame, sizes: DataFrame) -> DataFrame:
        """``(q, i, cos)`` within crowds, on the float vectors."""
        dim, k = self.dim, self.k
        rows = crowded.join(sizes.select("crowd", F.ceil(F.col("n") / self.sizes.cell).cast("int").alias("parts")), "crowd").withColumn("may", F.col("asks")).drop("asks")
        rows = in_cells(rows, "key", "parts", "filed").withColumn("asks", F.col("asks") & F.col("may")).where("filed or asks").drop("may").join(self.unique, "key")
        return self.scratch.keep(rows.repartition("crowd", "cell").mapInArrow(lambda b: _crowds(b, dim, k + 1), "q long, i long, cos double"), f"crowds{self.runs}")

    def step(self, step: int, coded: DataFrame, starved: DataFrame | None, asking: int, known: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """``(q, i, kind, score)``, ``(q, i, cos)`` of crowds, and the memberships in
        crowds, of one step at all levels."""
        if starved is not None:
            coded = coded.join(starved.withColumn("hungry", F.lit(True)), "key", "left").withColumn("asks", F.col("hungry").isNotNull()).select("group", "n", "key", "filed", "asks", "body")
        met = self.probe(coded, step, starved is not None, self.total, asking, starved is None)
        found, compared, first = met.where(F.col("kind") <= NEAR), None, None
        for level in range(MOST_LEVELS):
            crowded = self.memberships(met, None if level else known, starved)
            first = crowded if first is None else first
            sizes = self.scratch.keep(crowded.groupBy("crowd").agg(F.count_if("filed").alias("n"), F.count_if("asks").alias("asking")).where("asking > 0 and n > 0"), f"sizes{self.runs}")
            last = level == MOST_LEVELS - 1
            part = self.compared(crowded, sizes if last else sizes.where(F.col("n") <= self.sizes.floats))
            compared = part if compared is None else compared.union(part)
            large = sizes.where(F.col("n") > self.sizes.floats)
            count = large.agg(F.sum("n"), F.sum("asking")).first()
            if last or not count[0]:
                break
            self.deep = True
            inside = crowded.join(large.select("crowd", "n"), "crowd").join(self.unique, "key")
            centre = inside.where("filed").select("crowd", F.posexplode("vec").alias("dim", "x"), F.sqrt(F.aggregate("vec", F.lit(0.0), lambda t, x: t + x.cast("double") * x)).alias("norm"))
            centre = centre.groupBy("crowd", "dim").agg(F.avg(F.col("x") / F.col("norm")).alias("x")).groupBy("crowd").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda e: e.x).alias("centre"))
            inside = inside.join(centre, "crowd").select(F.col("crowd").alias("group"), "n", "key", "filed", "asks", "vec", "centre")
            met = self.probe(self.coded(inside, f"inside{self.runs}"), step, False, *count, True)
            found = found.union(met.where(F.col("kind") <= NEAR))
        return found, compared, first


def nearest(vectors: DataFrame, k: int = 5, dim: int = 64, sizes: Sizes = Sizes()) -> DataFrame:
    """``(id, neighbour, cos, rank)``: the k most similar others of each usable
    vector of a table ``(id, vec)``. Unusable and null vectors have none and are
    nobody's; an empty table gives an empty one; fewer than k others give fewer."""
    spark = vectors.sparkSession
    sizes = sizes._replace(of_cut=max(sizes.of_cut, k + 3), shortlist=max(sizes.shortlist, k + 3))
    scratch = Scratch(spark, "nearest")
    members = scratch.keep(usable(vectors, dim).withColumn("key", F.xxhash64("vec")), "members")
    unique = scratch.keep(members.groupBy("key").agg(F.min("vec").alias("vec")), "unique")
    sample = [r.vec for r in unique.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).collect()]
    if not sample:
        return members.select("id", F.col("id").alias("neighbour"), F.lit(0.0).alias("cos"), F.lit(0).alias("rank")).limit(0)
    total = unique.count()
    lay = Layout(total, min(64, dim), rows=sizes.rows)
    x = np.array(sample, np.float64)
    model = spark.sparkContext.broadcast(fit_rotations(x / np.linalg.norm(x, axis=1, keepdims=True), lay.words))
    search = _Search(unique, total, model, lay.words, dim, k, scratch, sizes)
    every = unique.select(F.lit(0).cast("long").alias("group"), F.lit(total).cast("long").alias("n"), "key", F.lit(True).alias("filed"), F.lit(True).alias("asks"), "vec", F.lit(None).cast("array<double>").alias("centre"))
    coded = search.coded(every, "coded")
    found, crowds, known = search.step(1, coded, None, total, None)
    enough, step = min(SURE * k, total - 1), 1

    def once(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("q", "i").agg(F.max("kind").alias("kind"), F.max("score").alias("score")) if search.deep else pairs

    found = once(found)
    while step < lay.width:
        # Whoever met enough codes within the radius is done; later, whoever met so many vectors. A pair
        # is met once, and whoever asked a crowd met more than k.
        met = found.where(F.col("kind") == NEAR) if step < MOST_STEPS else found
        done = met.select("q").union(crowds.select("q")).groupBy("q").agg(F.count("*").alias("c")).where(F.col("c") >= enough).select(F.col("q").alias("key"))
        starved = scratch.keep(unique.select("key").join(done, "key", "left_anti"), f"starved{step}")
        left = starved.count()
        if not left:
            break
        step += 1
        more, others, known = search.step(step, coded, starved, left, known)
        found, crowds = once(found.union(more)), crowds.union(others)
    listed = _top(found, "q", sizes.shortlist, F.desc("score"), "i")
    near = listed.select(F.least("q", "i").alias("x"), F.greatest("q", "i").alias("y")).distinct()
    left, right = unique.select(F.col("key").alias("x"), F.col("vec").alias("u")), unique.select(F.col("key").alias("y"), F.col("vec").alias("v"))
    scored = near.join(left, "x").join(right, "y").select("x", "y", "u", "v").mapInArrow(lambda b: _cosines(b, dim), "x long, y long, cos double")
    both = scored.select(F.explode(F.array(F.struct(F.col("x").alias("q"), F.col("y").alias("i")), F.struct(F.col("y").alias("q"), F.col("x").alias("i")))).alias("p"), "cos").select("p.q", "p.i", "cos")
    own = unique.select(F.col("key").alias("q"), F.col("key").alias("i"), F.lit(1.0).alias("cos"))
    both = both.union(crowds).groupBy("q", "i").agg(F.max("cos").alias("cos"))
    # Of each class of equal vectors the k + 1 smallest ids can be neighbours.
    firsts = _top(members.select("key", "id"), "key", k + 1, "id").select(F.col("key").alias("i"), F.col("id").alias("neighbour"))
    best = _top(both.union(own).join(firsts, "i"), "q", k + 1, F.desc("cos"), "neighbour").select(F.col("q").alias("key"), "neighbour", "cos")
    each = members.select("key", "id").join(best, "key").where("id <> neighbour")
    return _top(each, "id", k, F.desc("cos"), "neighbour").select("id", "neighbour", "cos", "rank")


def nearest_pairs(vectors: DataFrame, k: int = 5, dim: int = 64, sizes: Sizes = Sizes()) -> DataFrame:
    """``(a, b)``, a < b: pairs of which one is among the k nearest of the other."""
    found = nearest(vectors, k, dim, sizes)
    return found.select(F.least("id", "neighbour").alias("a"), F.greatest("id", "neighbour").alias("b")).distinct()
