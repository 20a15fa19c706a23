"""Personal information inside free text (problem 2).

Information-theoretic sanitisation. A grammar proposes terms (spans that look
like an address, a number, a name ...); counts over the whole corpus decide what
they disclose.

* Numbers: a term's form is its digits and letters blanked ("AA 99 99 99 A").
  Pointwise mutual information of the form with cue words in a window around it,
  PMI(f, k) = log2(n(f, k) N / (n(f) n(k))), is taken for the kinds phone,
  identity number and other. A form is disclosed as the kind of highest PMI if
  that exceeds the threshold; then each of its occurrences is, cued or not. A
  form's counts lean on those of its shape (its signs and the number of its
  digits), which decides forms that nobody comments on.
* E-mail and street addresses: a term's form is the way it is written (an address
  with its street word and a capitalised word that follows it at once: "Road" is
  not "Road Race"). The rate of the kind's cue words around the form is compared
  with their rate anywhere in the corpus; the form is disclosed if the logarithm
  of the quotient, its PMI with the cues, exceeds the threshold. Rare forms lean
  on the kind as a whole.
* Names: a word reveals a person as a given name if, capitalised, it is followed
  by many different capitalised words (its followers carry information: the
  branching of the word, its distinct followers, exceeds a threshold).
  A word beside a given name, a title or an initial is the family name unless it
  is common; a frequent word is common unless half of its uses are beside one.

Terms found are replaced by a placeholder of their type, everything else is left
as it is. Words of high document frequency reach the driver (at most 2 ** bits times
the average length), and forms, given names and followers of streets where there are
at most ``MOST_TERMS`` of them. Where there are more, every one is judged in the
executors by the same totals, and what is disclosed is looked up in a file (``Terms``).
"""

from __future__ import annotations

import atexit
import re
import shutil
import sqlite3
import tempfile
import unicodedata
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import log2, prod
from pathlib import Path

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Cue words of the kinds of number.
PHONE_CUES = "answers call called calls cell contact dial fax landline mobile number phone reach reached ring sms tel telephone text"
ID_CUES = "card citizen dni id identification identity licence license national nif nino passport security social ssn tax taxpayer"
MAIL_CUES = "account address contact email emails login mail reach reached receipt send sends write writes"
ADDRESS_CUES = "address deliver delivered delivery goes home house invoice letter live lived lives living move moved moves moving pick post residence send sent ship stays visit"
OTHER_CUES = "account article barcode batch book booking catalogue code error index invoice isbn issn item log marker model order parcel part pulse reading receipt sensor serial shipment sku station steps ticket tracking version"
# Titles, street words, joining words of street names.
TITLES = "Mr Mrs Ms Miss Mx Dr Prof Professor Doctor Sir Madam Herr Frau Señor Señora Sr Sra Dona Don Mme Mlle Monsieur Madame"
STREETS = "Street St Road Rd Avenue Ave Lane Ln Drive Dr Court Ct Terrace Ter Boulevard Blvd Way Close Place Pl Square Sq Crescent Highway Hwy Parkway Row Walk Gardens Grove Alley"
PREFIX_STREETS = "Calle Avenida Rua Via Viale Carrer Plaza Paseo Praça"
FRENCH_STREETS = "rue avenue boulevard allée impasse place chemin quai"
GERMAN_STREETS = "straße strasse str\\. weg platz allee gasse"
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "person_name": "[PERSON]"}

COMMON_BITS = 7.0
LEAST_FOLLOWERS = 3
LEAST_SHARE = 0.02
LEAST_PMI = 0.5
# Cue words so rare in the corpus that their rate says little count as this frequent.
LEAST_RATE = 0.1
# More terms than these are held in a file, of which each worker remembers some.
MOST_TERMS = 500_000
REMEMBERED = 100_000
# Fixed value: the longest international number; more digits are two numbers side by side.
MOST_DIGITS = 15
WINDOW = 40

_alt = lambda words: "|".join(words.split())
_NAME = r"[^\W\d_][\w’'-]*"
_TOWN = rf"{_NAME}(?:[ -](?!(?:is|at|on|in|and|until|since|for|the|where|when)\b){_NAME}){{0,1}}"

_DIGIT = re.compile(r"\d")
_AT = re.compile(r"@|\s?[\[(]\s?at\s?[\])]| at (?=[\w-]+ dot )", re.I)
_LOCAL = re.compile(r"[\w.+-]*\w\s?$")
_HOST = re.compile(r"\s?[\w-]+(?:(?:\.|\s?[\[(]\s?dot\s?[\])]\s?| dot )[\w-]+)+", re.I)
_HOUSE = r"\d{1,5}\s?[A-Za-z]?"
_AT_START = tuple(f"{w} " for w in PREFIX_STREETS.lower().split())
_IN_TOWN = rf"(?:,\s*(?:\d{{4,5}}\s+)?{_NAME})?"
# Each address form with the words of which one must occur for it to be tried.
ADDRESSES = [
    (("box",), re.compile(rf"\bP\.?\s?O\.?\s?Box\s+\d+{_IN_TOWN}", re.I)),
    (
        (),
        re.compile(
            rf"\d{{1,5}}\s?[A-Za-z]?\s+(?:{_NAME}\s+){{1,2}}(?P<street>{_alt(STREETS)})\b\.?"
            rf"(?:,?\s*(?:Flat|Apt\.?|Apartment|Unit|Suite|\#)\s*\d+[A-Za-z]?)?(?:(?:,\s*|\n){_NAME}(?:\s+\d{{4,5}}\b)?)?",
            re.I,
        ),
    ),
    (_AT_START, re.compile(rf"\b(?:{_alt(PREFIX_STREETS)})\s+{_NAME}(?:\s+{_NAME})?,?\s+{_HOUSE}\b{_IN_TOWN}", re.I)),
    (tuple(f" {w} " for w in FRENCH_STREETS.split()), re.compile(rf"\d{{1,5}}\s?[A-Za-z]?,?\s+(?:{_alt(FRENCH_STREETS)})\s+(?:(?:des|de la|du|de|de l[’'])\s*)?{_NAME}{_IN_TOWN}", re.I)),
    (("straße", "strasse", "str.", "weg ", "platz ", "allee ", "gasse "), re.compile(rf"\b[^\W\d_]+[ -]?(?:{_alt(GERMAN_STREETS)})\s*{_HOUSE}\b{_IN_TOWN}", re.I)),
]
# What a street name continues with: a capitalised word right behind the street word.
_NUMBERED = re.compile(rf"\d[^.;:!?\d]{{2,60}}\b(?:{_alt(STREETS.lower())})\b")
_FOLLOWS = re.compile(r" ([A-ZÀ-ÖØ-Þ][^\W\d_]+)")
_FLAT = re.compile(r"\b(?:Flat|Apt\.?|Apartment|Unit|Suite)\s+\d+[A-Za-z]?,\s*$", re.I)
# Short words that stand before a number and are no part of it.
_NO_PREFIX = frozenset("is on at to in no id of by or as be it so we up an a i my me".split())
_CORE = re.compile(r"\d(?:[\d ()‑-]|\.(?=\d)){4,}\d")
_BEFORE = re.compile(r"(?:\b([A-Za-z]{1,2})[ -]?|\+|\(|\+\()$")
_LETTER = re.compile(r"[ -]?[A-Za-z]\b(?![’'-])")
_EXTENSION = re.compile(r"\s*(?:ext\.?|x)\s*\d+", re.I)
_DATE = re.compile(r"\d{4}-\d\d-\d\d|\d{1,2}[.-]\d{1,2}[.-]\d{4}")
_EXT = re.compile(r"(?<=\d)\s*(?:ext\.?|x)\s*\d+$", re.I)
_WORD = re.compile(r"[^\W\d_]+")
_NAMED = re.compile(r"[^\W\d_][^\W\d_’'-]*(?:[’'-][^\W\d_]+)*")
_CAP = r"[A-ZÀ-ÖØ-Þ][^\W\d_A-ZÀ-ÖØ-Þ]+"
_PAIR = re.compile(rf"\b({_CAP}(?:-{_CAP})?)\b(?: (?:[A-Z]\. )?(?=({_CAP})))?")
_INITIAL = re.compile(r"\b[A-ZÀ-ÖØ-Þ]\. ?[A-ZÀ-ÖØ-Þ]")
_STROKES = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe"})
_MAIL, _STREET = frozenset(MAIL_CUES.split()), frozenset(ADDRESS_CUES.split())
_CUES = {w: k for k, ws in (("phone", PHONE_CUES), ("id_number", ID_CUES), ("other", OTHER_CUES)) for w in ws.split()}


def form_of(term: str) -> str:
    """The term with digits as 9 and letters as A; an extension is no part of it."""
    term = _EXT.sub("", term).replace("‑", "-")
    return "".join("9" if c.isdigit() else "A" if c.isalpha() else c for c in term)


def shape_of(form: str) -> str:
    """What is left of a form without its grouping: signs, letters, digits."""
    return f"{form[0] if form[0] in '+(' else ''}{'A' if 'A' in form else ''}{''.join(sorted(set(form) - set('9A+(')))}{form.count('9')}"


def _numbers(text: str) -> list[tuple[int, int, str]]:
    """Spans of six or more digits with their forms; an own letter before or
    behind belongs to the span, dates are left out."""
    found = []
    for m in _CORE.finditer(text):
        s, e = m.span()
        core = m.group()
        if sum(map(str.isdigit, core)) < 6 or _DATE.match(core):
            continue
        b = _BEFORE.search(text, max(0, s - 4), s)
        prefix = bool(b and b.group(1))
        if b and not (prefix and b.group(1).lower() in _NO_PREFIX):
            s = b.start()
        else:
            prefix = False
        if s and (text[s - 1].isalnum() or text[s - 1] in "_#/@.‑-"):
            continue
        tail = _LETTER.match(text, e) if prefix else _EXTENSION.match(text, e)
        if tail:
            e = tail.end()
        if e < len(text) and (text[e].isalnum() or text[e] in "_/@"):
            continue
        found.append((s, e, form_of(text[s:e])))
    return found


def _cues(text: str, start: int, end: int) -> set[str]:
    return {_CUES[w] for w in _around(text, start, end) if w in _CUES}


def fold(word: str) -> str:
    """Lower case without accents."""
    if word.isascii():
        return word.lower()
    plain = unicodedata.normalize("NFKD", word.lower().translate(_STROKES))
    return "".join(c for c in plain if not unicodedata.combining(c))


_TITLE = frozenset(fold(x) for x in TITLES.split())


def _masked(text: str, spans: list) -> str:
    if not spans:
        return text
    out, at = [], 0
    for s, e, *_ in sorted(spans):
        if s >= at:
            out += [text[at:s], "\x00" * (e - s)]
            at = e
    return "".join(out) + text[at:]


def _starts(words, pattern, low: str, text: str):
    """Matches of a pattern that begins with one of the words."""
    if len(low) != len(text):
        yield from pattern.finditer(text)
        return
    for w in words:
        at = low.find(w)
        while at >= 0:
            m = pattern.match(text, at) if not at or not low[at - 1].isalnum() else None
            if m:
                yield m
            at = low.find(w, at + 1)


def _structured(text: str, disclosed=None) -> list[tuple[int, int, str, str]]:
    """E-mail and street addresses with their forms, those alone whose form is
    disclosed where a test is given."""
    spans = []
    low = text.lower()
    if not _DIGIT.search(text):
        low = low if "@" in text or "at]" in low or "at)" in low or " dot " in low else ""
    if not low:
        return spans
    if "@" in text or "at]" in low or "at)" in low or " dot " in low:
        for m in _AT.finditer(text):
            host = _HOST.match(text, m.end())
            local = host and _LOCAL.search(text, max(0, m.start() - 80), m.start())
            if local and not (local.group()[-1].isspace() and m.group() == "@" and not text[m.end()].isspace()):
                form = f"email {m.group().strip().lower()}"
                if disclosed is None or disclosed(form):
                    spans.append((local.start(), host.end(), "email", form))
    for number, (words, pattern) in enumerate(ADDRESSES):
        if not (any(w in low for w in words) if words else _NUMBERED.search(low)):
            continue
        work = _masked(text, spans)
        for m in _starts(words, pattern, low, work) if words is _AT_START else pattern.finditer(work):
            s, e = m.span()
            if s and (work[s - 1].isalnum() or work[s - 1] in "-#/.:"):
                continue
            form = f"address {number}"
            if number == 1:
                after = _FOLLOWS.match(work, m.end("street"))
                form = f"address {m.group('street').lower()} {after.group(1).lower()}" if after else f"address {m.group('street').lower()}"
            if disclosed is None or disclosed(form):
                flat = _FLAT.search(work, max(0, s - 24), s)
                spans.append((flat.start() if flat else s, e, "address", form))
    return spans


def _around(text: str, start: int, end: int) -> list[str]:
    return _WORD.findall((text[max(0, start - WINDOW) : start] + " " + text[end : end + WINDOW // 2]).lower())


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of one partition: (kind, key, value, n)."""
    counts: Counter = Counter()
    words: Counter = Counter()
    for batch in batches:
        for text in batch.column("text").to_pylist():
            if not text:
                continue
            for s, e, form in _numbers(text):
                counts["form", form, ""] += 1
                for kind in _cues(text, s, e):
                    counts["cue", form, kind] += 1
            for s, e, kind, form in _structured(text):
                counts["place", form, ""] += 1
                if not (_MAIL if kind == "email" else _STREET).isdisjoint(_around(text, s, e)):
                    counts["near", form, kind] += 1
            counts.update([("pair", a, b) for a, b in _PAIR.findall(text)])
            words.update(set(text.lower().split(" ")))
        if len(counts) + len(words) > 200_000:
            yield _count_batch(counts, words)
            counts, words = Counter(), Counter()
    yield _count_batch(counts, words)


def _count_batch(counts: Counter, words: Counter) -> pa.RecordBatch:
    for word, n in words.items():
        counts["word", word.strip(".,;:!?()\"'"), ""] += n
    keys = list(counts)
    return pa.record_batch(
        {
            "kind": pa.array([k[0] for k in keys], pa.string()),
            "key": pa.array([k[1] for k in keys], pa.string()),
            "value": pa.array([k[2] for k in keys], pa.string()),
            "n": pa.array([counts[k] for k in keys], pa.int64()),
        }
    )


class Terms:
    """Any number of terms of one kind with a value each, in a file that Spark hands to
    every executor; those looked up last are remembered."""

    def __init__(self, file: str, kind: str, always: frozenset[str] = frozenset()):
        self.file, self.kind, self.always = file, kind, always
        self._find: Callable | None = None

    def __getstate__(self):
        return self.__dict__ | {"_find": None}

    def get(self, key: str) -> str | None:
        """The term's value, None for any other word."""
        if self._find is None:
            base = sqlite3.connect(f"{Path(SparkFiles.get(self.file)).as_uri()}?mode=ro&immutable=1", uri=True, check_same_thread=False)
            self._find = lru_cache(REMEMBERED)(lambda k: base.execute("select value from term where kind = ? and key = ?", (self.kind, k)).fetchone())
        found = self._find(key)
        return found and found[0]

    def __contains__(self, key: str) -> bool:
        return key in self.always or self.get(key) is not None

    @staticmethod
    def written(rows: DataFrame) -> str:
        """A file of ``(kind, key, value)``, row by row; the name that executors know it by."""
        folder = Path(tempfile.mkdtemp(prefix="mnemolake-terms-"))
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        file = folder / f"terms-{uuid.uuid4().hex}.sqlite"
        base = sqlite3.connect(file)
        base.execute("pragma journal_mode = off")
        base.execute("create table term (kind text, key text, value text, primary key (kind, key)) without rowid")
        base.executemany("insert or ignore into term values (?, ?, ?)", (tuple(r) for r in rows.select("kind", "key", "value").toLocalIterator()))
        base.commit()
        base.close()
        rows.sparkSession.sparkContext.addFile(str(file))
        return file.name


def _ends(name: str) -> set[str]:
    """The first and the last part of a given name."""
    return {name.split("-")[0], name.split("-")[-1]}


class Lexicon:
    """The corpus statistics that decide about terms."""

    def __init__(self, forms: "dict[str, str] | Terms", given: "frozenset[str] | Terms", common: frozenset[str], places: "Places", parts: "Terms | None" = None):
        self.forms, self.given, self.common, self.places = forms, given, common, places
        self.parts = parts or _TITLE.union(*map(_ends, given))

    def names(self, text: str) -> list[tuple[int, int, str]]:
        """Person names: a family name with a given name, an initial or a title."""
        if not self._may_name(text):
            return []
        tokens = [(m.start(), m.end(), m.group(), fold(m.group())) for m in _NAMED.finditer(text)]
        spans, i, n = [], 0, len(tokens)
        while i < n:
            s, e, word, low = tokens[i]
            end = None
            if low in _TITLE:
                end = self._after_title(text, tokens, i)
            elif low in self.given:
                end = self._after_given(text, tokens, i)
            elif len(word) == 1 and word.isupper() and text[e : e + 2] == ". " and i + 1 < n and tokens[i + 1][0] == e + 2:
                if self._family(tokens, i + 1, cased=True):
                    end = i + 1
            if end is None and i + 1 < n and text[e : tokens[i + 1][0]] in (", ", ",") and tokens[i + 1][3] in self.given and self._family(tokens, i, like=tokens[i + 1][2]):
                end = i + 1
                if end + 1 < n and len(tokens[end + 1][2]) == 1 and tokens[end + 1][2].isupper() and text[tokens[end][1] : tokens[end + 1][0]] == " " and text[tokens[end + 1][1] : tokens[end + 1][1] + 1] == ".":
                    end += 1
            if end is None:
                i += 1
            else:
                spans.append((s, tokens[end][1], "person_name"))
                i = end + 1
        return spans

    def _may_name(self, text: str) -> bool:
        """Whether a given name or title has a neighbour that is no common word."""
        words = _WORD.findall(text.lower()) if text.isascii() else [fold(w) for w in _WORD.findall(text)]
        keys, common, n = self.parts, self.common, len(words)
        for i, w in enumerate(words):
            if w in keys:
                if i + 1 < n and (words[i + 1] not in common or len(words[i + 1]) == 1) or i and words[i - 1] not in common:
                    return True
        return bool(_INITIAL.search(text))

    def _family(self, tokens, i, like: str = "", cased: bool = False) -> bool:
        word, low = tokens[i][2], tokens[i][3]
        if len(word) < 2 or low in self.common or low in _TITLE:
            return False
        if len(word) == 2 and not (word[0].isupper() and (word[1].islower() or len(like) > 1 and like.isupper())):
            return False
        if cased or (like[:1].isupper() and not (len(like) > 1 and like.isupper())):
            return word[0].isupper()
        return not word[1:].islower() or not like or like.islower() or word.isupper() == like.isupper()

    def _initial(self, text, tokens, i) -> int:
        """The token after any initials from i on."""
        n = len(tokens)
        while i < n and len(tokens[i][2]) == 1 and text[tokens[i][1] : tokens[i][1] + 1] in (".", " "):
            step = text[tokens[i][1] : tokens[i + 1][0]] if i + 1 < n else ""
            if step not in (". ", ".", " ") or (step == " " and not (tokens[i][2].isupper() and tokens[i - 1][2][1:].islower())):
                break
            i += 1
        return i

    def _after_title(self, text, tokens, i):
        n = len(tokens)
        j = i + 1
        if j >= n or text[tokens[i][1] : tokens[j][0]] not in (" ", ". ", "."):
            return None
        if tokens[j][3] in _TITLE and j + 1 < n:
            j += 1
        if tokens[j][3] in self.given:
            end = self._after_given(text, tokens, j)
            if end is not None:
                return end
        j = self._initial(text, tokens, j)
        return j if j < n and self._family(tokens, j, like=tokens[i][2]) else None

    def _after_given(self, text, tokens, i):
        n = len(tokens)
        j = i + 1
        if j >= n or text[tokens[i][1] : tokens[j][0]] not in (" ", "  ", "\n"):
            return None
        j = self._initial(text, tokens, j)
        if j < n and j > i + 1 and text[tokens[j - 1][1] : tokens[j][0]] not in (" ", ". ", "."):
            return None
        return j if j < n and self._family(tokens, j, like=tokens[i][2]) else None

    def _split(self, text: str, s: int, e: int) -> list[tuple[int, int, str]]:
        """Two disclosed numbers that stand side by side."""
        for i in range(s + 6, e - 6):
            if text[i] in " \n":
                a, b = self.forms.get(form_of(text[s:i])), self.forms.get(form_of(text[i + 1 : e]))
                if a and b:
                    return [(s, i, a), (i + 1, e, b)]
        return []

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """All terms disclosed in the text, in reading order, without overlap."""
        found = [x[:3] for x in _structured(text, self.places.disclosed)]
        work = _masked(text, found)
        for s, e, form in _numbers(work):
            kind = self.forms.get(form)
            if kind:
                found.append((s, e, kind))
            else:
                found += self._split(text, s, e)
        return sorted(found + self.names(_masked(work, found)))


class Places:
    """Which forms of e-mail and street addresses are disclosed: those with a PMI of
    the kind's cues over the threshold. A form leans with one occurrence on all forms
    of its kind that are followed too, these on the rate anywhere; a form without a
    follower leans on the kind, the kind on one cue."""

    def __init__(self, seen: dict[str, int], near: dict[str, int], anywhere: dict[str, float], decided: Terms | None = None):
        self.seen, self.near, self.anywhere, self.decided = Counter(seen), Counter(near), anywhere, decided
        for form, n in seen.items():
            for above in self.above(form):
                self.seen[above] += n
                self.near[above] += near.get(form, 0)

    @staticmethod
    def above(form: str) -> list[str]:
        kind = form.split(" ")[0]
        return [kind, f"{kind} *"] if len(form.split(" ")) > 2 and kind == "address" else [kind]

    def pmi(self, form: str, seen: int | None = None, near: int = 0) -> float:
        """The PMI of a form with the cues, by its own counts where they are given."""
        levels = [*self.above(form), form]
        rate = 1.0
        if levels[1].endswith("*"):
            # A street word with a follower is not told for an address by other addresses.
            rate, levels = self.anywhere[levels[0]], levels[1:]
        for level in levels:
            own = (near, seen) if seen is not None and level == form else (self.near[level], self.seen[level])
            rate = (own[0] + rate) / (own[1] + 1)
        return log2(rate / self.anywhere[form.split(" ")[0]])

    def disclosed(self, form: str) -> bool:
        decided = self.decided and self.decided.get(form)
        return decided == "yes" if decided else self.pmi(form) > LEAST_PMI


_NO_GIVEN = _TITLE | frozenset(fold(x) for x in f"{STREETS} {PREFIX_STREETS} {FRENCH_STREETS}".split())
_TERM = "kind string, key string, value string"


def _each(rows: DataFrame, judge: Callable, schema: str) -> DataFrame:
    """What ``judge`` yields for each row."""

    def run(batches):
        for batch in batches:
            made = [x for row in zip(*(c.to_pylist() for c in batch.columns)) for x in judge(*row)]
            types = [f.split(" ")[1] for f in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if t == "long" else pa.string()) for c, t in zip(list(zip(*made)) or [[]] * len(types), types)], [f.split(" ")[0] for f in schema.split(", ")])

    return rows.mapInArrow(run, schema)


def _given_terms(key: str):
    if (name := fold(key)) not in _NO_GIVEN:
        yield "given", name, ""
        for part in _ends(name):
            yield "part", part, ""


def _form_terms(numbers: DataFrame) -> DataFrame:
    """The disclosed ones of any number of forms, by the totals of their shapes."""
    each = numbers.groupBy("key").agg(*[F.sum(F.when((F.col("kind") == "cue") & (F.col("value") == k), F.col("n")).otherwise(0)).alias(k) for k in KINDS])
    shaped = _each(each, lambda key, *n: [(shape_of(key), *n)], f"shape string, {', '.join(f'{k} long' for k in KINDS)}")
    totals = shaped.groupBy("shape").agg(F.count("*").alias("forms"), *[F.sum(k).alias(k) for k in KINDS]).collect()
    shapes = Shapes({r.shape: (r.forms, Counter({k: r[k] for k in KINDS})) for r in totals})
    return _each(each, lambda key, *n: [("form", key, kind)] if (kind := shapes.kind(key, Counter(dict(zip(KINDS, n))))) else [], _TERM)


def _place_terms(places: DataFrame, anywhere: dict[str, float]) -> tuple[DataFrame, dict[str, int], dict[str, int]]:
    """The forms of any number that are decided otherwise than one never seen, and the
    totals of all forms above them, seen and near a cue."""
    count = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("n")).otherwise(0))
    each = places.groupBy("key").agg(count("place").alias("seen"), count("near").alias("near"))
    above = _each(each, lambda key, seen, near: [(a, seen, near) for a in Places.above(key)], "key string, seen long, near long")
    totals = above.groupBy("key").agg(F.sum("seen").alias("seen"), F.sum("near").alias("near")).collect()
    seen, near = {r.key: r.seen for r in totals}, {r.key: r.near for r in totals}
    known = Places({}, {}, anywhere)
    known.seen.update(seen)
    known.near.update(near)

    def judge(key, n, m):
        own = known.pmi(key, n, m) > LEAST_PMI
        if own != (known.pmi(key) > LEAST_PMI):
            yield "place", key, "yes" if own else "no"

    return _each(each, judge, _TERM), seen, near


def _beside(pairs: DataFrame, hot: list[str], given: "frozenset[str] | Terms") -> DataFrame:
    """How often each hot word follows a given name, a title or an initial."""
    rows = pairs.where(F.lower("value").isin(hot)).select(F.lower("key").alias("a"), F.lower("value").alias("b"), "n")
    found = _each(rows, lambda a, b, n: [(b, n)] if fold(a) in given or fold(a) in _TITLE or len(a) == 1 else [], "b string, n long")
    return found.groupBy("b").agg(F.sum("n").alias("n"))


def learn(texts: DataFrame) -> Lexicon:
    """Corpus statistics of a column ``text``, over all rows."""
    stats = texts.mapInArrow(_statistics, "kind string, key string, value string, n long").groupBy("kind", "key", "value").agg(F.sum("n").alias("n")).persist()
    size = texts.agg(F.count("*").alias("n"), F.avg(F.length("text")).alias("length")).first()
    total = max(1, size.n)
    floor = max(3, int(total * 2**-COMMON_BITS))
    cues = sorted(_MAIL | _STREET)
    words = {r.key: r.n for r in stats.where("kind = 'word'").where((F.col("n") >= floor) | F.col("key").isin(cues)).select("key", "n").collect()}
    counted = {w: n for w, n in words.items() if n >= floor}
    frequent = list(counted)
    common = frozenset(fold(w) for w in frequent)
    pairs = stats.where("kind = 'pair'")
    # Frequent words of which half or more stand second in a pair may be the name of a hot person.
    second = pairs.groupBy(F.lower("value").alias("w")).agg(F.sum("n").alias("n")).where(F.col("n") >= floor / 2)
    hot = [r.w for r in second.collect() if r.w in counted and 2 * r.n >= counted[r.w]]
    known = [*frequent, *STREETS.lower().split()]
    informative = (F.col("value") != "") & ~F.lower("value").isin(known)
    branching = (
        pairs.groupBy("key")
        .agg(F.sum("n").alias("all"), F.sum(informative.cast("int")).alias("followers"), F.sum(F.when(informative, F.col("n"))).alias("n"))
        .where((F.col("followers") >= LEAST_FOLLOWERS) & (F.col("n") >= LEAST_SHARE * F.col("all")))
    )
    numbers = stats.where("kind in ('form', 'cue')").where(F.length(F.regexp_replace("key", "[^9]", "")) <= MOST_DIGITS)
    places = stats.where("kind in ('place', 'near')")
    share = min(1.0, 1.5 * WINDOW / max(1.0, size.length or 1.0))
    anywhere = {kind: 1 - prod(1 - min(1.0, words.get(w, 0) / total) * share for w in own) for kind, own in (("email", _MAIL), ("address", _STREET))}
    anywhere = {k: min(0.5, max(v, LEAST_RATE)) for k, v in anywhere.items()}
    kinds = {r.kind: r["count"] for r in stats.groupBy("kind").count().collect()}
    # A given name has three pairs or more.
    many = kinds.get("form", 0) + kinds.get("place", 0) + kinds.get("pair", 0) // LEAST_FOLLOWERS > MOST_TERMS and kinds.get("form", 0) + kinds.get("place", 0) + branching.count() > MOST_TERMS
    if many:
        odd, seen, near = _place_terms(places, anywhere)
        file = Terms.written(_each(branching.select("key"), _given_terms, _TERM).union(_form_terms(numbers)).union(odd))
        forms, given, parts = Terms(file, "form"), Terms(file, "given"), Terms(file, "part", _TITLE)
        decided = Places({}, {}, anywhere, Terms(file, "place"))
        decided.seen.update(seen)
        decided.near.update(near)
    else:
        given, parts = frozenset(fold(r.key) for r in branching.select("key").collect()) - _NO_GIVEN, None
        forms = disclosed_forms(numbers.collect())
        held = places.collect()
        decided = Places(*({r.key: r.n for r in held if r.kind == kind} for kind in ("place", "near")), anywhere)
    # A hot word is a family name where half or more of it follows a given name, a title or an initial.
    named = {r.b: r.n for r in _beside(pairs, hot, given).collect()} if hot else {}
    common -= {fold(w) for w, n in named.items() if 2 * n >= counted[w]}
    stats.unpersist()
    return Lexicon(forms, given, frozenset(w for w in common if w not in given), decided, parts)


KINDS = ("phone", "id_number", "other")


def _leaning(own: Counter, prior: dict[str, float]) -> dict[str, float]:
    n = sum(own[k] for k in KINDS)
    return {k: (own[k] + prior[k]) / (n + 1) for k in KINDS}


class Shapes:
    """What decides about forms: of each shape the number of its forms and their cues. A
    form leans with one cue on the kinds of its shape, a shape on those of all numbers
    with its signs and letters."""

    def __init__(self, shapes: dict[str, tuple[int, Counter]]):
        signs: dict[str, Counter] = {}
        for shape, (_, n) in shapes.items():
            signs.setdefault(shape.rstrip("0123456789"), Counter()).update(n)
        self.shared = {shape: _leaning(n, _leaning(signs[shape.rstrip("0123456789")], dict.fromkeys(KINDS, 1 / 3))) for shape, (_, n) in shapes.items()}
        self.n_kind = {k: sum(n[k] + forms * self.shared[shape][k] for shape, (forms, n) in sorted(shapes.items())) for k in KINDS}

    def kind(self, form: str, own: Counter) -> str | None:
        """The kind as which a form with these cues is disclosed."""
        total = sum(self.n_kind.values())
        p = _leaning(own, self.shared[shape_of(form)])
        score = {k: log2(p[k] * total / self.n_kind[k]) if p[k] and self.n_kind[k] else -99.0 for k in KINDS}
        best = max(score, key=lambda k: score[k])
        return best if best != "other" and score[best] > LEAST_PMI else None


def disclosed_forms(rows) -> dict[str, str]:
    """Kind of each form whose PMI with the cues of a kind exceeds the threshold."""
    joint = {form: Counter() for form in {r["key"] for r in rows}}
    for r in rows:
        if r["kind"] == "cue":
            joint[r["key"]][r["value"]] += r["n"]
    shapes: dict[str, tuple[int, Counter]] = {}
    for form, n in joint.items():
        forms, cues = shapes.get(shape_of(form), (0, Counter()))
        shapes[shape_of(form)] = forms + 1, cues + n
    decided = Shapes(shapes)
    return {form: kind for form, own in joint.items() if (kind := decided.kind(form, own))}


def _texts(notes: DataFrame) -> DataFrame:
    return notes.select(F.explode(F.array("content", "facts")).alias("text")).where("text is not null and text <> ''")


def find(notes: DataFrame) -> DataFrame:
    """``(memory_id, note_field, pii_type, nth, start, stop, term)``, a row per
    occurrence; start and stop count code points. Null or empty fields have none;
    rows delivered twice count once."""
    lexicon = notes.sparkSession.sparkContext.broadcast(learn(_texts(notes)))

    def scan(batches):
        for batch in batches:
            out = []
            ids = batch.column("memory_id").to_pylist()
            for field in ("content", "facts"):
                for key, text in zip(ids, batch.column(field).to_pylist()):
                    if text:
                        seen: Counter = Counter()
                        for s, e, kind in lexicon.value.spans(text):
                            seen[kind] += 1
                            out.append((key, field, kind, seen[kind], s, e, text[s:e]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 7, (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()))], ["memory_id", "note_field", "pii_type", "nth", "start", "stop", "term"])

    rows = notes.select("memory_id", "content", "facts").mapInArrow(scan, "memory_id string, note_field string, pii_type string, nth int, start int, stop int, term string")
    return rows.distinct()


def sanitise(notes: DataFrame) -> DataFrame:
    """The notes with ``content`` and ``facts`` replaced by texts in which each
    disclosed term is a placeholder of its type; other columns are kept."""
    lexicon = notes.sparkSession.sparkContext.broadcast(learn(_texts(notes)))

    def clean(text):
        if not text:
            return text
        out, at = [], 0
        for s, e, kind in lexicon.value.spans(text):
            out += [text[at:s], PLACEHOLDER[kind]]
            at = e
        return "".join(out) + text[at:]

    def run(batches):
        for batch in batches:
            for field in ("content", "facts"):
                i = batch.schema.get_field_index(field)
                batch = batch.set_column(i, field, pa.array([clean(x) for x in batch.column(i).to_pylist()], pa.string()))
            yield batch

    return notes.mapInArrow(run, notes.schema)
