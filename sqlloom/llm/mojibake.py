"""Texts decoded with a wrong character encoding: found, and restored where that is possible.

A multinomial classifier on hashed byte bigrams tells, for each piece of a text that holds
other characters than ASCII, by which chain of encodings it was garbled, or that it is sound.
It is trained here: pieces are counted over all texts, the ``SAMPLE_PIECES`` most frequent
are garbled by every chain of ``CHAINS``, and the classifier learns to tell the results apart.
Pieces of the sample that a first round takes for garbled are left out of the second.

The predicted chain is then inverted. A piece counts as restored only if every step of the
inversion is strict and gives a text that is sound to the same classifier.

The sample only fits the classifier. Which pieces are known to be sound comes from the counts of
all pieces (``sound_pieces``); pieces and their inversions are joined to them by hash.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlloom.llm.lookalike import TWINS
from sqlloom.sources.scratch import written

SAMPLE_PIECES = 3000
BUCKETS = 1 << 15

# Chains of (encoding of the bytes, encoding they were read with), one pair for each pass.
CHAINS: tuple[tuple[tuple[str, str], ...], ...] = (
    *(((("utf-8", wrong),)) for wrong in ("latin-1", "cp1252", "cp1250", "cp1251", "cp437", "cp850", "cp866", "koi8-r", "mac_roman", "gbk", "cp950", "cp932", "cp949")),
    (("utf-8", "cp1252"), ("utf-8", "cp1252")),
    (("utf-8", "latin-1"), ("utf-8", "latin-1")),
    (("utf-8", "latin-1"), ("utf-8", "cp1252")),
    (("utf-8", "cp1252"), ("utf-8", "latin-1")),
    *((("cp950", wrong),) for wrong in ("latin-1", "cp1252", "gbk", "cp932", "cp949", "cp1251", "cp437", "cp850", "utf-8")),
    *((("gbk", wrong),) for wrong in ("latin-1", "cp1252", "cp950", "cp932", "cp949", "cp1251", "cp437", "cp850", "utf-8")),
    *((("cp932", wrong),) for wrong in ("latin-1", "cp1252", "gbk", "utf-8")),
    *((("cp1251", wrong),) for wrong in ("latin-1", "cp1252", "koi8-r", "cp866", "utf-8")),
    *((("koi8-r", wrong),) for wrong in ("cp1251", "cp1252")),
    *((("cp1253", wrong),) for wrong in ("cp1252", "cp1251", "utf-8")),
    *((("cp1252", wrong),) for wrong in ("utf-8", "cp437", "cp850", "cp1251", "gbk", "cp950", "cp932", "mac_roman")),
    *((("cp1250", wrong),) for wrong in ("cp1252", "latin-1", "utf-8")),
)
_EDGE = re.compile(r"[\n\r'\"]+")
#: Ranges of full-width forms, blanks, ignorable signs and combining accents: disguises of problem 2, no signs of a wrong encoding.
_DISGUISE_RANGES = ((0xFF01, 0xFF5E), (0x3000, 0x3000), (0xA0, 0xA0), (0xAD, 0xAD), (0x2000, 0x200F), (0x202F, 0x202F), (0x205F, 0x2064), (0xFEFF, 0xFEFF), (0xFE00, 0xFE0F), (0x300, 0x36F))
_DISGUISE = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in _DISGUISE_RANGES) + "]")
#: Words of ASCII letters and their twins in other scripts.
_TWIN_WORD = re.compile(rf"(?<!\w)(?=\w*{TWINS})(?:[A-Za-z0-9_]|{TWINS})+(?!\w)")
_LOST = "\ufffd"


def name(chain: tuple[tuple[str, str], ...]) -> str:
    return "+".join(f"{true}>{wrong}" for true, wrong in chain)


@lru_cache(maxsize=None)
def _single(wrong: str) -> dict[int, str] | None:
    """Bytes that a one-byte code page leaves undefined are kept as control characters, as browsers do."""
    if wrong in ("utf-8", "gbk", "cp950", "cp932", "cp949"):
        return None
    out = {}
    for b in range(256):
        try:
            out[b] = bytes([b]).decode(wrong)
        except UnicodeDecodeError:
            out[b] = chr(b)
    return out


def _read(data: bytes, wrong: str) -> str:
    table = _single(wrong)
    return data.decode(wrong, "replace") if table is None else "".join(map(table.__getitem__, data))


def garble(text: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    """The text as it looks after the chain; None where its bytes can't be formed or nothing changes."""
    now = text
    for true, wrong in chain:
        try:
            now = _read(now.encode(true), wrong)
        except UnicodeEncodeError:
            return None
    return None if now == text else now


@lru_cache(maxsize=None)
def _bytes_of(wrong: str) -> dict[str, int]:
    return {c: b for b, c in _single(wrong).items()}


def invert(text: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    """The text before the chain, or None unless every step is strictly possible."""
    for true, wrong in reversed(chain):
        try:
            if _single(wrong) is None:
                data = text.encode(wrong)
            else:
                data = bytes(map(_bytes_of(wrong).__getitem__, text))
            text = data.decode(true)
        except (UnicodeError, KeyError):
            return None
    return text


def _letterwise(chain: tuple[tuple[str, str], ...]) -> bool:
    """Whether each letter becomes one other letter, so that a letter or two are no evidence."""
    return all(_single(e) is not None for step in chain for e in step)


def _far(p: str) -> int:
    return sum(c > "\x7f" for c in plain(p))


def normal(p: str) -> str:
    """A piece as it is counted: trimmed, numbers as 0."""
    return re.sub(r"[0-9]+", "0", p).strip()


def hashed(p: str) -> bytes:
    return hashlib.blake2b(p.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def pieces(text: str) -> list[str]:
    """Parts between line ends and quotation marks that hold other characters than ASCII."""
    return [p for p in _EDGE.split(text) if not p.isascii()]


def plain(text: str) -> str:
    """The text without disguises."""
    return _TWIN_WORD.sub("a", _DISGUISE.sub("", text))


def _features(data: bytes) -> np.ndarray:
    """Buckets of the byte bigrams with a byte outside ASCII."""
    x = np.frombuffer(b" " + data + b" ", np.uint8).astype(np.uint32)
    a, b = x[:-1], x[1:]
    far = (a > 127) | (b > 127)
    code = (a[far] << 8 | b[far]).astype(np.uint64)
    # The byte before joins in: a sequence of three tells code pages apart.
    before = np.concatenate([[32], x[:-2]])[far].astype(np.uint64)
    two = (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 14)
    three = ((code | before << np.uint64(16)) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - 14)
    return np.concatenate([two, three + np.uint64(1 << 14)]).astype(np.int64)


class Classifier:
    """Log likelihoods of the bigram buckets for ``sound`` (column 0) and each chain."""

    SMOOTH, MASS = 0.3, 60_000.0

    def __init__(self, weights: np.ndarray, sound: frozenset[str] = frozenset()):
        self.weights = weights
        self.sound = sound  # the sample's sound pieces
        self.first: Classifier | None = None  # the round that told them from garbled ones

    @classmethod
    def fit(cls, sound: dict[str, int], garbled: list[dict[str, int]]) -> Classifier:
        """From texts with their weights, for sound ones and for each chain."""
        table = np.zeros((BUCKETS, 1 + len(garbled)), np.float32)
        for k, texts in enumerate([sound, *garbled]):
            n = np.zeros(BUCKETS)
            for t, w in texts.items():
                np.add.at(n, _features(plain(t).encode("utf-8", "replace")), w)
            n *= cls.MASS / max(n.sum(), 1.0)  # equal mass, so that unknown bigrams favour no class
            table[:, k] = np.log((n + cls.SMOOTH) / (cls.MASS + cls.SMOOTH * BUCKETS))
        return cls(table, frozenset(sound))

    PRIOR = 3.0  # log odds of sound against any one chain

    def doubts(self, piece: str) -> bool:
        """Whether a counted piece is rather garbled; short ones are no evidence."""
        return _far(piece) >= 3 and bool((s := self.scores(piece))[1:].max() > s[0] + 2.0)

    def scores(self, piece: str) -> np.ndarray:
        s = self.weights[_features(plain(piece).encode("utf-8", "replace"))].sum(axis=0)
        s[0] += self.PRIOR
        return s


def train(found: dict[str, int]) -> Classifier:
    """Fits on pieces with their counts; see the module's description."""
    sound = {p: n for p, n in sorted(found.items()) if _LOST not in p and not re.search("[\x80-\x9f]", p)}
    # A piece that a chain leads back to a more frequent one, or to ASCII alone, is that one garbled.
    worse = {p for p, n in sound.items() for chain in CHAINS if (q := invert(p, chain)) is not None and q != p and (found.get(q, 0) > n or not _letterwise(chain) and q.replace(chr(0xFEFF), "").isascii())}
    sound = {p: n for p, n in sound.items() if p not in worse}
    model = None
    for _ in range(2):
        if model is not None:
            sound = {p: n for p, n in sound.items() if not model.doubts(p)}
        garbled = []
        for chain in CHAINS:
            texts: dict[str, int] = {}
            for p, n in sound.items():
                if (g := garble(p, chain)) is None:
                    continue
                texts[g] = texts.get(g, 0) + n
                if chain[-1][1] in ("latin-1", "cp1252"):  # control characters dropped, hard blanks made soft
                    g = re.sub("[\x80-\x9f]", "", g).replace("\xa0", " ")
                    texts[g] = texts.get(g, 0) + n
            garbled.append(texts)
        before, model = model, Classifier.fit(sound, garbled)
        model.first = before
    return model


class Judge:
    """Verdicts on pieces, kept for repeated ones."""

    def __init__(self, model: Classifier, sound: frozenset[bytes] | None = None):
        self.model = model
        self.sound = frozenset(map(hashed, model.sound)) if sound is None else sound
        self.listed: frozenset[bytes] = frozenset()  # further sound pieces that the text at hand may need
        self.known: dict[str, tuple[int, str | None]] = {}

    def piece(self, p: str) -> tuple[int, str | None]:
        """(chain number from 1, restored piece or None); chain 0 is sound."""
        if plain(p).isascii():
            return 0, None
        if (v := self.known.get(p)) is not None:
            return v
        v = self._judge(p)
        if len(self.known) < 100_000:
            self.known[p] = v
        return v

    def _known(self, p: str) -> bool:
        return (h := hashed(normal(p))) in self.sound or h in self.listed

    def _judge(self, p: str) -> tuple[int, str | None]:
        if self._known(p):
            return 0, None
        s = self.model.scores(p)
        order = np.argsort(-s[1:], kind="stable") + 1
        best = int(order[0])
        if s[best] <= s[0]:
            if _LOST in p:
                return best, None
            for k in map(int, order):  # too short to tell, unless it leads to a known piece
                if not _letterwise(CHAINS[k - 1]) and (back := invert(p, CHAINS[k - 1])) is not None and self._known(back):
                    return k, back
            return 0, None
        far = _far(p)
        for k in map(int, order):
            if s[k] <= s[0]:
                break
            back = None if _LOST in p else invert(p, CHAINS[k - 1])
            if _letterwise(CHAINS[k - 1]) and far < 3 and (back is None or not self._known(back)):
                continue
            if back is None or back == p or _LOST in back or re.search("[\x00-\x08\x0e-\x1f\x80-\x9f]", back):
                continue
            if self._known(back):
                return k, back
            # What comes out has to be sound, and sounder for its length than what went in.
            after = self.model.scores(back)
            if plain(back).isascii() or after[0] >= after[1:].max() - 6.0 and self._mean(after, back) > self._mean(s, p) + 0.7:
                return k, back
        # Nothing decodes strictly: bytes were lost, or the text is sound after all.
        if far < 3 and _LOST not in p and not re.search("[\x80-\x9f]", p):
            return 0, None
        sure = _LOST in p or bool(re.search("[\x80-\x9f]", p)) or s[best] - s[0] > self.SURE
        return (best, None) if sure else (0, None)

    SURE = 12.0  # log odds from which a piece counts as garbled though no chain decodes strictly

    def _mean(self, scores: np.ndarray, piece: str) -> float:
        return float(scores[0] - self.model.PRIOR) / max(1, len(_features(plain(piece).encode("utf-8", "replace"))))

    def text(self, t: str) -> tuple[list[str], str] | None:
        """Chains found in a text and the text with all that could be restored; None for sound texts."""
        if t.isascii():
            return None
        chains, out, at = [], [], 0
        for m in re.finditer(r"[^\n\r'\"]+", t):
            p = m.group()
            if p.isascii():
                continue
            k, back = self.piece(p)
            if k:
                chains.append(name(CHAINS[k - 1]) + ("" if back is not None else "?"))
                if back is not None:
                    out += [t[at : m.start()], back]
                    at = m.end()
        return (chains, "".join([*out, t[at:]])) if chains else None


def piece_counts(texts: DataFrame) -> DataFrame:
    """``piece, n, short`` of all pieces of a column of texts, numbers written as 0; ``short`` counts those of at most 400 characters."""
    c = texts.columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            count, short = Counter(), Counter()
            for p in (p for t in b.column(0).to_pylist() for p in pieces(t) if not plain(p).isascii()):
                count[q := normal(p)] += 1
                short[q] += len(p) <= 400
            yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64()), pa.array([short[q] for q in count], pa.int64())], ["piece", "n", "short"])

    rows = texts.where(F.octet_length(c) != F.length(c)).select(c).mapInArrow(run, "piece string, n long, short long")
    return rows.groupBy("piece").agg(F.sum("n").alias("n"), F.sum("short").alias("short"))


def most_frequent(counts: DataFrame, most: int = SAMPLE_PIECES) -> dict[str, int]:
    """The sample: the most frequent pieces of ``piece_counts`` with their counts."""
    top = counts.where("short > 0").orderBy(F.col("short").desc(), "piece").limit(most)
    return {r.piece: r.short for r in top.collect()}


def sample_pieces(texts: DataFrame, most: int = SAMPLE_PIECES) -> dict[str, int]:
    """The most frequent pieces of a column of texts, numbers written as 0, with their counts over all texts."""
    return most_frequent(piece_counts(texts), most)


def sound_pieces(counts: DataFrame, model: Classifier) -> DataFrame:
    """``h, n`` of all pieces of ``piece_counts`` that are sound by the rules of ``train``: hashes, written once."""
    shared = counts.sparkSession.sparkContext.broadcast((model.first or model).weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Classifier(shared.value)
        for b in batches:
            keys, oks, backs = [], [], []
            for p in b.column(0).to_pylist():
                ok, led = _LOST not in p and not re.search("[\x80-\x9f]", p), []
                for chain in CHAINS if ok else ():
                    if (q := invert(p, chain)) is not None and q != p:
                        ok = ok and (_letterwise(chain) or not q.replace(chr(0xFEFF), "").isascii())
                        led.append(hashed(q))
                ok = ok and not judge.doubts(p)
                keys.append(hashed(p))
                oks.append(ok)
                backs.append(led if ok else [])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), b.column(1), pa.array(oks, pa.bool_()), pa.array(backs, pa.list_(pa.binary()))], ["h", "n", "ok", "backs"])

    rows = written(counts.select("piece", "n").mapInArrow(run, "h binary, n long, ok boolean, backs array<binary>"))
    # A piece that a chain leads back to a more frequent one is that one garbled.
    led = rows.where("ok").select(F.col("h").alias("garbled"), F.col("n").alias("own"), F.explode("backs").alias("h"))
    worse = led.join(rows.select("h", "n"), "h").where("n > own").select(F.col("garbled").alias("h")).distinct()
    return written(rows.where("ok").select("h", "n").join(worse, "h", "left_anti"))


def lookups(p: str) -> list[bytes]:
    """Hashes of a piece and of all that the chains lead it back to."""
    out = {hashed(normal(p))}
    out.update(hashed(normal(q)) for chain in CHAINS if (q := invert(p, chain)) is not None)
    return list(out)


def _with_listed(rows: DataFrame, sound: DataFrame, cached: frozenset[bytes]) -> DataFrame:
    """``key, text, listed``: texts with a piece that is not in the cache, and the sound pieces of ``sound`` that they need."""
    shared = rows.sparkSession.sparkContext.broadcast(cached)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = shared.value

        @lru_cache(maxsize=20_000)
        def needs(p: str) -> tuple[bytes, ...]:
            return () if plain(p).isascii() or hashed(normal(p)) in cache else tuple(lookups(p))

        for b in batches:
            keys, texts, wanted = [], [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if found := {h for p in pieces(t) for h in needs(p)}:
                    keys.append(k)
                    texts.append(t)
                    wanted.append(list(found - cache))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(texts, pa.string()), pa.array(wanted, pa.list_(pa.binary()))], ["key", "text", "wanted"])

    held = written(rows.mapInArrow(run, "key long, text string, wanted array<binary>"))
    asked = held.select(F.col("key").alias("of"), F.explode("wanted").alias("h")).distinct()
    listed = asked.join(sound.select("h"), "h", "left_semi").groupBy("of").agg(F.collect_set("h").alias("listed"))
    return held.join(listed, F.col("key").eqNullSafe(F.col("of")), "left").select("key", "text", "listed")


def garbled_rows(df: DataFrame, key: str, text: str, model: Classifier, sound: DataFrame | None = None) -> DataFrame:
    """``key``, ``chains``, ``recovered`` and ``restored`` of every row with garbled text.

    ``sound`` holds the known sound pieces (``sound_pieces``), without it those of the sample count.
    ``chains`` names the chain of each garbled piece, with ``?`` where it can't be inverted strictly;
    ``recovered`` is true if all could. Null, empty and sound texts give no rows; a row delivered
    twice gives equal rows.
    """
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).where(F.octet_length("text") != F.length("text"))
    if sound is None:
        cached = frozenset(map(hashed, model.sound))
        rows = rows.withColumn("listed", F.lit(None).cast("array<binary>"))
    else:  # the most frequent ones are held in memory, all others joined
        cached = frozenset(bytes(r.h) for r in sound.orderBy(F.col("n").desc(), "h").limit(SAMPLE_PIECES).collect())
        rows = _with_listed(rows, sound, cached)
    shared = df.sparkSession.sparkContext.broadcast((model.weights, cached))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, known = shared.value
        judge = Judge(Classifier(weights), known)
        for b in batches:
            keys, chains, whole, restored = [], [], [], []
            for k, t, listed in zip(*(b.column(i).to_pylist() for i in range(3))):
                judge.listed = frozenset(listed or ())
                if found := judge.text(t):
                    keys.append(k)
                    chains.append("; ".join(dict.fromkeys(found[0])))
                    whole.append(not any(c.endswith("?") for c in found[0]))
                    restored.append(found[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(chains, pa.string()), pa.array(whole, pa.bool_()), pa.array(restored, pa.string())], ["key", "chains", "recovered", "restored"])

    return rows.mapInArrow(run, "key long, chains string, recovered boolean, restored string")
