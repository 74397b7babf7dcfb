"""One consistent form of texts that look alike but consist of different characters.

First compatibility normalisation: full-width, half-width, non-breaking and styled forms,
ligatures and Roman numeral signs become ordinary characters, all blanks of one width or
another a space, ignorable characters are deleted, accents composed (NFC). Signs that do
look different (raised digits, fractions, other layout, case, accents) stay.

Then every token that holds a letter with a twin in another script becomes a lattice of its
look-alike readings, and Viterbi's algorithm picks the reading with the best character
trigram score. The counts come from all texts; a trigram that mixes scripts is never
counted, and a change of script within a token costs extra.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlloom.sources.scratch import written

# Letters that look like the Latin letter (or digit) under them.
_TWINS = (
    ("асԁеһіјӏорԛѕԝхуѵ", "acdehijlopqswxyv"),  # Cyrillic
    ("АВСЕНІЈКМОРԚЅТԜХУҮѴԌӀ", "ABCEHIJKMOPQSTWXYYVGI"),
    ("ονϲϳια", "ovcjia"),  # Greek
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ", "ABEZHIKMNOPTYXCJ"),
    ("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᎽᏀᏃᏒᏔᏕᏙᏚᏞᏟᏢᏦᏴ", "DRTAJEWMHYGZRWSVSLCPKB"),  # Cherokee
    ("ոսօհցզՕՍ", "nuohgqOU"),  # Armenian
    ("ꓮꓐꓚꓓꓰꓝꓖꓧꓲꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜ", "ABCDEFGHIJKLMNOPRSTUVWXYZ"),  # Lisu
    ("ɑɡı", "agi"),  # further Latin
)
_SPACES = "               　"
_EXTRA = {"‘": "'", "’": "'", "‛": "'", "“": '"', "”": '"', "‟": '"', "‐": "-", "‑": "-", "−": "-", "µ": "μ"}
_IGNORABLE = [0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]
_SAME_SHAPE = ("<wide>", "<narrow>", "<noBreak>", "<font>", "<small>")

TABLE_BITS = 18  # the trigram and the bigram table have 2**18 places each, whatever the input


def _translation() -> dict[int, str | None]:
    table: dict[int, str | None] = {ord(c): " " for c in _SPACES}
    table |= {ord(a): b for a, b in _EXTRA.items()}
    for c in range(0x80, 0x20000):
        ch = chr(c)
        if c in table:
            continue
        if unicodedata.category(ch) == "Cf":
            table[c] = None
        elif unicodedata.decomposition(ch).startswith(_SAME_SHAPE) or 0xFB00 <= c <= 0xFB06 or 0x2160 <= c <= 0x217F:
            table[c] = unicodedata.normalize("NFKC", ch)
    table |= {c: None for c in [*_IGNORABLE, *range(0xE0000, 0xE0080)]}
    return table


_TABLE = _translation()
#: Readings of a letter: its Latin form, and the letters of other scripts that share it.
_LATIN = {a: b for there, here in _TWINS for a, b in zip(there, here)}
_OTHERS: dict[str, list[str]] = {}
for _a, _b in _LATIN.items():
    _OTHERS.setdefault(_b, []).append(_a)
TWINS = "[" + "".join(_LATIN) + "]"
_TWIN = re.compile(TWINS)
_TOKEN = re.compile(r"\w+")


@lru_cache(maxsize=4096)
def script(c: str) -> str:
    """Script of a letter by the first word of its name; other signs have none."""
    if not c.isalpha():
        return ""
    name = unicodedata.name(c, "").split(" ")[0]
    return "CJK" if name in ("HIRAGANA", "KATAKANA", "BOPOMOFO") else name


def compatible(text: str) -> str:
    """The compatibility normalisation alone."""
    return text if text.isascii() else unicodedata.normalize("NFC", unicodedata.normalize("NFC", text.translate(_TABLE)))


# --- trigram counts -------------------------------------------------------------------------


@lru_cache(maxsize=1)
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """For code points below 0x10000: letter class (lower case; 1 for other signs, 0 between tokens) and script number."""
    scripts: dict[str, int] = {"": 0}
    cls, scr = np.ones(0x10000, np.uint32), np.zeros(0x10000, np.uint8)
    for c in range(0x10000):
        if 0xD800 <= c < 0xE000:
            continue
        ch = chr(c)
        if ch.isdigit():
            cls[c] = 2
        elif ch == "_":
            cls[c] = 3
        elif ch.isalpha():
            s = script(ch)
            low = ch.lower()
            scr[c] = scripts.setdefault(s, len(scripts) % 250 + 1)
            cls[c] = ord(low) if s not in ("CJK", "HANGUL") and len(low) == 1 else 1
        elif not ch.isalnum():
            cls[c] = 0
    return cls, scr


def _slot(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    x = (a.astype(np.uint64) * np.uint64(0x9E3779B1) + b.astype(np.uint64)) * np.uint64(0x85EBCA77) + c.astype(np.uint64)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cls, scr = _classes()
    tri, bi = np.zeros(1 << TABLE_BITS, np.int64), np.zeros(1 << TABLE_BITS, np.int64)

    def add(texts: list[str]) -> None:
        # Without ignorable characters a disguised token can look whole; only its pure trigrams count anyhow.
        codes = np.frombuffer("\n".join(["", *texts, ""]).encode("utf-32-le", "replace"), np.uint32)
        codes = np.minimum(codes, 0xFFFF)
        k, s = cls[codes], scr[codes]
        a, b, c = k[:-2], k[1:-1], k[2:]
        x, y, z = s[:-2], s[1:-1], s[2:]
        pure = (b != 0) & ((x == y) | (x == 0) | (y == 0)) & ((y == z) | (y == 0) | (z == 0)) & ((x == z) | (x == 0) | (z == 0) | (y == 0))
        a, b, c = a[pure], b[pure], c[pure]
        np.add(tri, np.bincount(_slot(a, b, c), minlength=len(tri)), out=tri)
        np.add(bi, np.bincount(_slot(a, b, np.full_like(b, 7)), minlength=len(bi)), out=bi)

    for batch in batches:
        texts, size = [], 0
        for t in batch.column(0).to_pylist():
            if t:
                texts.append(t)
                size += len(t)
                if size > 1 << 20:
                    add(texts)
                    texts, size = [], 0
        add(texts)
    for kind, table in enumerate((tri, bi)):
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), pa.array(at.astype(np.int32)), pa.array(table[at])], ["kind", "slot", "n"])


def trigram_counts(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Trigram and bigram counts of all texts of a one-column DataFrame, in two tables of fixed size."""
    out = np.zeros((2, 1 << TABLE_BITS), np.float32)
    sums = texts.mapInArrow(_count, "kind int, slot int, n long").groupBy("kind", "slot").agg(F.sum("n").alias("n"))
    for b in sums.toArrow().to_batches():  # at most 2**19 rows
        kind, slot, n = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        out[kind, slot] = n
    return out[0], out[1]


# --- Viterbi --------------------------------------------------------------------------------


class Reader:
    """Picks readings by trigram counts; keeps what it picked for each token."""

    SWITCH = -8.0  # log cost of a change of script between neighbouring letters
    CHANGE = -0.5  # log cost of each letter read as another

    def __init__(self, tri: np.ndarray, bi: np.ndarray):
        self.tri, self.bi = tri, bi
        self.known: dict[str, str] = {}
        self.scores: dict[tuple[str, str, str], float] = {}

    def _class(self, c: str) -> int:
        return 0 if not c else int(_classes()[0][min(ord(c), 0xFFFF)])

    def score(self, a: str, b: str, c: str) -> float:
        key = (a, b, c)
        if (found := self.scores.get(key)) is None:
            x, y, z = (np.array([self._class(s)], np.uint32) for s in key)
            tri, bi = self.tri[_slot(x, y, z)[0]], self.bi[_slot(x, y, np.full_like(y, 7))[0]]
            found = self.scores[key] = math.log((tri + 0.02) / (bi + 1.0)) + 0.5 * math.log(bi + 0.5)
        return found

    def read(self, token: str) -> str:
        """The best reading of a token of any length: states are two letters and the script last met."""
        if (found := self.known.get(token)) is not None:
            return found
        # A state's score, and the way to it as (letter, way before).
        states: dict[tuple[str, str, str], tuple[float, tuple | None]] = {("", "", ""): (0.0, None)}
        for own in (*token, ""):
            latin = _LATIN.get(own, own)
            choices = [(c, script(c) if c else "", self.CHANGE if c != own else 0.0) for c in dict.fromkeys([own, latin, *_OTHERS.get(latin, ())])]
            after: dict[tuple[str, str, str], tuple[float, tuple | None]] = {}
            for (a, b, before), (score, way) in states.items():
                for c, s, cost in choices:
                    new = score + cost + (self.score(a, b, c) if b else 0.0) + (self.SWITCH if s and before and s != before else 0.0)
                    state = (b, c, s or before)
                    if (old := after.get(state)) is None or new > old[0]:
                        after[state] = (new, (c, way))
            states = after
        way = max(states.values(), key=lambda x: x[0])[1]
        letters = []
        while way is not None:
            letters.append(way[0])
            way = way[1]
        best = "".join(reversed(letters))
        if len(self.known) < 200_000:
            self.known[token] = best
        return best

    def __call__(self, text: str) -> str:
        text = compatible(text)
        if text.isascii() or not _TWIN.search(text):
            return text
        return _TOKEN.sub(lambda m: m.group() if m.group().isascii() or not _TWIN.search(m.group()) else self.read(m.group()), text)


# --- DataFrames -----------------------------------------------------------------------------


def _ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def one_form(df: DataFrame, key: str, text: str, counts: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``key``, ``text`` and ``form`` of every row with a text that isn't null or blank.

    Texts of ASCII alone have their form already and stay in the JVM. Repeated rows give repeated rows.
    """
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).where(F.col("text").rlike(r"\S"))
    shared = df.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Reader(*shared.value)
        for b in batches:
            forms = [read(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(forms, pa.string())], ["key", "text", "form"])

    other = rows.where(~_ascii(F.col("text"))).mapInArrow(run, "key long, text string, form string").where(F.col("form").rlike(r"\S"))
    return rows.where(_ascii(F.col("text"))).withColumn("form", F.col("text")).unionByName(other)


def same_looking(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of keys of two results of ``one_form`` with equal form and different text, each pair once.

    Only 128-bit hashes of the forms and 64-bit hashes of the texts are shuffled. Rows are first
    collapsed to classes of equal text; classes of equal form and different text are joined, and
    only those are expanded to keys, so that texts met unchanged on both sides cost nothing.
    """
    form = ["h1", "h2"]

    def hashed(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col("key").alias(name), F.xxhash64("form").alias("h1"), F.xxhash64(F.lit(7), "form").alias("h2"), F.xxhash64("text").alias(f"raw_{name}"))

    a, b = written(hashed(left, "left_key").dropDuplicates()), written(hashed(right, "right_key").dropDuplicates())
    classes = a.select(*form, "raw_left_key").dropDuplicates().join(b.select(*form, "raw_right_key").dropDuplicates(), form).where("raw_left_key <> raw_right_key")
    return classes.join(a, [*form, "raw_left_key"]).join(b, [*form, "raw_right_key"]).select("left_key", "right_key")


def same_looking_classes(left: DataFrame, right: DataFrame) -> DataFrame:
    """The same result in linear size: ``side, key, class_id, writing`` of every row whose form occurs in different texts.

    ``class_id`` is the hash of the form, ``writing`` that of the text: members of one class with
    different writings look alike.
    """
    rows = reduce(DataFrame.unionByName, (df.select(F.lit(n).alias("side"), "key", F.xxhash64("form").alias("class_id"), F.xxhash64("text").alias("writing")) for n, df in (("left", left), ("right", right))))
    rows = written(rows.dropDuplicates())
    mixed = rows.groupBy("class_id").agg(F.min("writing").alias("a"), F.max("writing").alias("z")).where("a <> z").select("class_id")
    return rows.join(mixed, "class_id", "left_semi")
