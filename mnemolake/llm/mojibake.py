"""Garbled text from wrong character encoding (problem 9).

Minimum description length. A text is cut into segments (lines, then sentences).
For each segment with signs outside ASCII every decoding chain that is valid
gives a candidate. A candidate's description is its size under zstandard with the
best of the per-language dictionaries, with an escape for each character that the
language never shows (a longer one if no language shows its block), plus the cost of its chain; the shortest
description wins, the unchanged segment having no chain cost. Chains of several steps are
searched with a beam, by their total with the costs of all steps.

Two families of steps: UTF-8 bytes read in a one-byte encoding (all garbled
characters are runs outside ASCII, so the runs are decoded and the rest is left),
and bytes of a legacy encoding read in another (whole segments). The latter are open
to every segment with signs outside ASCII, so their chains cost more and must make
the signs less rare by that cost too (``Signs``). Replacement
characters and C1 controls mark a segment as garbled even where no chain restores
it.

Counts, alphabets and dictionaries are learnt from all texts with a language label
but the suspicious ones, then again from those that the first dictionaries leave
unchanged. Where a label has more than ``BLOCK`` characters, each block of its texts
has a dictionary, and that of the label is trained on those of its blocks.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from math import ceil, log2

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 32_000_000
DICTIONARY_BYTES = 65_536
# A sign belongs to a language that shows it in two texts or more, and in more than this share.
LEAST_SHARE = 1 / 400
# A chain costs more where more of them are tried (8 x 13 legacy ones) and where each segment is open to them.
STEP_BITS, LEGACY_BITS = 6, 16
ASCII_BITS, UNSEEN_BITS = 5, 24
ESCAPE_BITS, FOREIGN_BITS = 8, 40
# The least that zstandard writes: its magic number and the heads of frame and block.
FRAME_BITS = 72
# Encodings in which UTF-8 or legacy bytes are commonly misread.
UTF8_READ_AS = "cp1252 latin_1 mac_roman cp437 cp850 cp1250 cp1251 cp1254 iso8859_2 iso8859_15 cp1257 cp866 koi8_r".split()
LEGACY = "cp1251 koi8_r cp866 mac_cyrillic cp932 euc_jp gb18030 big5 cp949 cp1250 cp1252 mac_roman cp850 cp437".split()
LEGACY_READ_AS = "cp1252 latin_1 mac_roman cp437 cp850 cp1251 cp866 koi8_r".split()
MOST_STEPS = 3
# Chains carried on from step to step, and how much longer than the best one may be.
BEAM, SLACK_BITS = 3, 24

_SPLIT = re.compile(r"(?<=\n)|(?<=[.!?。！？])(?=\s)|(?<=。)|(?<=\"<\|>)")
_RUN = re.compile(r"[^\x00-\x7f]{2,}")
_C1 = re.compile("[\x80-\x9f]")
_LOST = re.compile("[�\x80-\x84\x86-\x9f]")
# Two signs of a one-byte encoding close together; much of a text in them keeps it out of what is learnt first.
_DENSE = re.compile(r"[\x80-\x9f¡-ÿŒœŠšŸŽžƒˆ˜–—‘’‚“”„†‡•…‰‹›€™](?:[^\s][^\s]?)?[\x80-\x9f¡-ÿŒœŠšŸŽžƒˆ˜–—‘’‚“”„†‡•…‰‹›€™]")


def to_bytes(text: str, encoding: str) -> bytes | None:
    """The bytes behind a text read in an encoding; signs that an encoding leaves
    undefined stand for the byte of their number, as common decoders do."""
    try:
        return text.encode(encoding)
    except UnicodeEncodeError:
        pass
    out = bytearray()
    if not _C1.search(text):
        return None
    for c in text:
        try:
            out += c.encode(encoding)
        except UnicodeEncodeError:
            if 0x80 <= ord(c) < 0xA0:
                out.append(ord(c))
            else:
                return None
    return bytes(out)


def utf8_step(segment: str, encoding: str) -> str | None:
    """The segment with each run that holds UTF-8 bytes decoded, or None."""
    changed = False

    def decoded(m):
        nonlocal changed
        raw = to_bytes(m.group(), encoding)
        if raw is None:
            return m.group()
        try:
            text = raw.decode("utf-8")
        except UnicodeDecodeError:
            return m.group()
        changed = True
        return text

    out = _RUN.sub(decoded, segment)
    return out if changed else None


# Legacy encodings that write a character in one or more bytes.
_WIDE = [e for e in LEGACY if e in ("cp932", "euc_jp", "gb18030", "big5", "cp949")]
_PAIRS = [(shown, real) for shown in LEGACY_READ_AS for real in LEGACY if real != shown and real not in _WIDE]


def _read(char: str, shown: str, real: str) -> str | None:
    """What a character of a one-byte encoding is in another one."""
    raw = to_bytes(char, shown)
    try:
        out = raw.decode(real) if raw is not None and len(raw) == 1 else None
    except UnicodeDecodeError:
        return None
    return out if out is not None and out.isprintable() else None


def _reread(raw: bytes, real: str) -> str | None:
    try:
        text = raw.decode(real)
    except UnicodeDecodeError:
        return None
    return text if text.isprintable() or "\n" in text else None


class Signs:
    """How rare the signs outside ASCII are, in bits, in the language that shows each
    most. Counts are ruled by the majority of the texts, so some garbled ones among
    them do no harm, as they would in a dictionary."""

    def __init__(self, counts: Iterable[dict[str, int]]):
        self.rare: dict[str, float] = {}
        for seen in counts:
            total = sum(seen.values())
            for c, n in seen.items():
                self.rare[c] = min(self.rare.get(c, UNSEEN_BITS), log2(total / n))

        self._table: np.ndarray | None = None

    def __getstate__(self):
        return self.__dict__ | {"_table": None, "_gain": None, "_writes": None}

    def _prepare(self) -> None:
        self._table = np.full(0x110000, UNSEEN_BITS, np.float32)
        self._table[list(map(ord, self.rare))] = list(self.rare.values())
        self._table[:128] = ASCII_BITS
        # By character and pair of one-byte encodings, the bits that rereading it adds.
        signs = {bytes([i]).decode(e, "ignore") for e in LEGACY_READ_AS for i in range(128, 256)} | {chr(i) for i in range(128, 160)}
        self._row = {c: i for i, c in enumerate(sorted(signs - {""}))}
        self._gain = np.full((len(self._row), len(_PAIRS)), np.inf, np.float32)
        self._writes = np.array([[to_bytes(c, e) is not None for e in LEGACY_READ_AS] for c in self._row])
        for c, i in self._row.items():
            for j, (shown, real) in enumerate(_PAIRS):
                other = _read(c, shown, real)
                if other is not None:
                    self._gain[i, j] = self._table[ord(other)] - self._table[ord(c)]

    def bits(self, text: str) -> float:
        if self._table is None:
            self._prepare()
        return float(self._table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")].sum())

    def better(self, segment: str) -> set[str]:
        """The legacy candidates whose signs are less rare than the segment's by more
        than the cost of the chain."""
        if self._table is None:
            self._prepare()
        signs = Counter(c for c in segment if c > "\x7f")
        rows = [self._row.get(c) for c in signs]
        if None in rows:
            return set()
        n = np.fromiter(signs.values(), np.float32, len(rows))
        raw = {e: to_bytes(segment, e) for e, writes in zip(LEGACY_READ_AS, self._writes[rows].all(0)) if writes}
        narrow = [_PAIRS[j] for j in np.flatnonzero(n @ self._gain[rows] < -LEGACY_BITS)]
        found = {_reread(raw[shown], real) for shown, real in narrow}
        # A wide character takes up two signs or a sign and a letter: no more can be gained.
        if sum(k * (float(self._table[ord(c)]) + ASCII_BITS) for c, k in signs.items()) > LEGACY_BITS:
            found |= {_reread(x, real) for x in set(raw.values()) for real in _WIDE}
        own = self.bits(segment) - LEGACY_BITS
        return {t for t in found if t is not None and self.bits(t) < own}


class Codes:
    """Description lengths under per-language dictionaries."""

    def __init__(self, learnt: Iterable[tuple[str, dict[str, int], str, bytes]]):
        """From ``(label, counts of characters, alphabet, dictionary)`` of each language."""
        learnt = list(learnt)
        self.alphabets = {label: frozenset(known) for label, _, known, _ in learnt}
        self.dictionaries = {label: made for label, _, _, made in learnt}
        self.signs = Signs(counts for _, counts, _, _ in learnt)
        # Blocks of 128 characters of which some language shows any; C1 controls are of none.
        self.known = frozenset(ord(c) >> 7 for known in self.alphabets.values() for c in known)
        self._made: list | None = None

    def __getstate__(self):
        return self.__dict__ | {"_made": None}

    def bits(self, text: str, limit: float = float("inf")) -> float:
        """The description length, or infinity where it is not below ``limit``."""
        if self._made is None:
            plain = {"level": 3, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
            pairs = [(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), **plain), self.alphabets[k]) for k, d in self.dictionaries.items() if len(d) > 8]
            self._made = pairs or [(zstandard.ZstdCompressor(**plain), frozenset())]
        raw = text.encode("utf-8", "surrogatepass")
        other = [c for c in text if c > "\x7f"]
        foreign = FOREIGN_BITS * sum(ord(c) >> 7 not in self.known or c < "\xa0" for c in other)
        if foreign + FRAME_BITS >= limit:
            return float("inf")
        # Languages by their escapes: those whose escapes alone reach the best are not compressed.
        least = limit
        for escapes, z in sorted(((foreign + ESCAPE_BITS * sum(c not in seen for c in other), z) for z, seen in self._made), key=lambda e: e[0]):
            if escapes + FRAME_BITS >= least:
                break
            least = min(least, escapes + 8 * len(z.compress(raw)))
        return least if least < limit else float("inf")

    def restore(self, segment: str) -> str:
        """The segment under the chain of the least total: its description and the cost
        of the steps. Of each step the ``BEAM`` best go on, also those that a further
        step must bear out."""
        least, best, beam, tried = None, segment, [(0, segment)], {segment}
        for _ in range(MOST_STEPS):
            after = []
            for cost, text in beam:
                found = dict.fromkeys(self.signs.better(text), cost + LEGACY_BITS)
                if _RUN.search(text):
                    found |= {t: cost + STEP_BITS for e in UTF8_READ_AS if (t := utf8_step(text, e)) is not None}
                for t in sorted(found.keys() - tried):
                    tried.add(t)
                    if least is None:  # what has no candidates needs no description
                        least = self.bits(segment)
                    total = found[t] + self.bits(t, least + SLACK_BITS - found[t])
                    if total < least + SLACK_BITS:
                        after.append((total, found[t], t))
                    if total < least:
                        least, best = total, t
            if not after:
                break
            beam = [x[1:] for x in sorted(after)[:BEAM]]
        return best

    def text(self, text: str) -> tuple[str, bool]:
        """The restored text, and whether any part was or stays garbled."""
        if text.isascii():
            return text, False
        lost = bool(_LOST.search(text))
        out = [self.restore(s) if not s.isascii() else s for s in _SPLIT.split(text)]
        restored = "".join(out)
        return restored, lost or restored != text


_LEARNT = "label string, texts long, counts string, inside string, made binary"


def _dictionary(pieces: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-DICTIONARY_BYTES:]


def _learn(pdf: pd.DataFrame) -> pd.DataFrame:
    """Counts of characters and of the texts with each, and the dictionary of one block."""
    counts, inside, texts = Counter(), Counter(), sorted(pdf.text)
    for t in texts:
        counts.update(t)
        inside.update(set(t))
    made = _dictionary([s.encode() for t in texts for s in _SPLIT.split(t) if len(s) > 7])
    return pd.DataFrame({"label": [pdf.label.iloc[0]], "texts": [len(texts)], "counts": [json.dumps(counts)], "inside": [json.dumps(inside)], "made": [made]})


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    """The blocks of one label as one."""
    counts, inside, made = Counter(), Counter(), sorted(map(bytes, pdf.made))
    for c, i in zip(pdf.counts, pdf.inside):
        counts.update(json.loads(c))
        inside.update(json.loads(i))
    if len(made) > 1:
        made = [_dictionary([m[i : i + 256] for m in made for i in range(0, len(m), 256)])]
    return pd.DataFrame({"label": [pdf.label.iloc[0]], "texts": [pdf.texts.sum()], "counts": [json.dumps(counts)], "inside": [json.dumps(inside)], "made": made})


def _learnt(rows: DataFrame, blocks: dict[str, int], keep: Callable[[str], bool]) -> list[tuple[str, dict[str, int], str, bytes]]:
    """What the kept texts of each label teach: texts are judged in all tasks, each block
    of a label is learnt in one."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([keep(t) for t in batch.column("text").to_pylist()], pa.bool_()))

    if not blocks:
        return []
    of = F.create_map(*[F.lit(x) for pair in sorted(blocks.items()) for x in pair])
    kept = rows.mapInArrow(judge, "label string, text string").withColumn("block", F.pmod(F.xxhash64("text"), of[F.col("label")]))
    each = kept.groupBy("label", "block").applyInPandas(lambda pdf: _learn(pdf), _LEARNT)
    made = each.groupBy("label").applyInPandas(lambda pdf: _merge(pdf), _LEARNT).collect()
    known = lambda r: "".join(sorted(c for c, n in json.loads(r.inside).items() if n > max(1, r.texts * LEAST_SHARE) or c.isascii()))
    return [(r.label, json.loads(r.counts), known(r), bytes(r.made)) for r in sorted(made, key=lambda r: r.label)]


def train(documents: DataFrame, text: str = "text", label: str = "lang") -> Codes:
    """A dictionary for each language label of two letters, on all its texts but the
    shortest. Texts stay in the executors; the driver gets dictionaries and counts."""
    name = F.lower(F.trim(F.col(label)))
    rows = documents.select(name.alias("label"), F.col(text).alias("text")).where("label is not null and label rlike '^[a-z]{2}$' and length(text) >= 40")
    by = _counts(rows)
    seen = Signs(by.values())
    blocks = {k: ceil(sum(n.values()) / BLOCK) for k, n in by.items()}
    first = Codes(_learnt(rows, blocks, lambda t: not _suspicious(t, seen)))
    return Codes(_learnt(rows, blocks, lambda t: not first.text(t)[1]))


def _counts(rows: DataFrame) -> dict[str, dict[str, int]]:
    """Characters of all texts by label."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[str, Counter] = {}
        for batch in batches:
            for name, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist()):
                by.setdefault(name, Counter()).update(text)
        flat = [(name, c, n) for name, seen in by.items() for c, n in seen.items()]
        yield pa.record_batch([pa.array(x, t) for x, t in zip(list(zip(*flat)) or [[]] * 3, (pa.string(), pa.string(), pa.int64()))], ["label", "c", "n"])

    by: dict[str, dict[str, int]] = {}
    for r in rows.mapInArrow(count, "label string, c string, n long").groupBy("label", "c").agg(F.sum("n").alias("n")).collect():
        by.setdefault(r.label, {})[r.c] = r.n
    return by


def _suspicious(text: str, signs: Signs) -> bool:
    """Whether a text might hold garbled parts, to keep it out of what is learnt first."""
    if text.isascii():
        return False
    if _LOST.search(text) or any(utf8_step(text, e) is not None for e in UTF8_READ_AS):
        return True
    parts = [s for s in _SPLIT.split(text) if len(s) > 7]
    if any(len(_DENSE.findall(s)) * 5 > len(s) for s in parts):
        return True
    # A bit and more for each sign that the least rare candidate would gain.
    return any(signs.bits(t) + len(s) < signs.bits(s) for s in parts if not s.isascii() for t in signs.better(s))


def restore_texts(documents: DataFrame, codes: Codes | None = None) -> DataFrame:
    """``(doc_id, text, garbled, restored)`` of the rows with any garbled part:
    ``text`` is restored where a chain was found, ``restored`` tells whether
    nothing lost is left in it. Null and empty texts are never garbled."""
    shared = documents.sparkSession.sparkContext.broadcast(codes or train(documents))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts, whole = [], [], []
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if text:
                    best, garbled = shared.value.text(text)
                    if garbled:
                        keys.append(key)
                        texts.append(best)
                        whole.append(not _LOST.search(best))
            yield pa.record_batch({"doc_id": pa.array(keys, pa.int64()), "text": pa.array(texts, pa.string()), "restored": pa.array(whole, pa.bool_())})

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, text string, restored boolean")
