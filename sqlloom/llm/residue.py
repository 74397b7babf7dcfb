"""Template residue, filler, server pages and script notices in a corpus of documents.

Labelled exemplars of residue (``exemplars``) are tokenised and held in an inverted index. A
document's passages (lines, sentences, windows in long ones, and spans between template signs
or brackets) retrieve exemplars by shared telling tokens. TF-IDF containment says how much of
an exemplar is in the passage, coverage how much of the passage is from the retrieved
exemplars together. A passage with both high is residue; one that only mentions an error page
is covered too little. Tokens are word stems, so that exemplars match other wording as well.

Weights come from the document frequencies of all words in all documents. They also tell
dummy text: in a passage that retrieves the printers' dummy Latin, words that hardly occur
outside such documents count as covered, whatever they are.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlloom.llm import exemplars
from sqlloom.sources.scratch import written

RETRIEVED = 0.5  # least share of an exemplar's weight in a passage that retrieves it
CONTAINED = 0.6  # the same for the best of the retrieved exemplars
COVERED = 0.52  # least share of a passage's weight that the retrieved exemplars hold
WINDOW = 0.85  # least containment and coverage of a window inside a longer passage
WINDOW_TOKENS = 6  # different tokens that a window and its exemplar need at least
SPAN = 0.5  # least containment of span exemplars
COVERED_ORDER = 0.2  # least coverage of spans with an order to the writer, whose object is free
COVERED_SIGN = 0.12  # the same of spans between template signs
COVERED_FIELD = 0.6  # the same of spans with a field name
NAMED = 0.2  # least share of a name's spans that stand in template signs, for it to be a field in brackets
FILLER = 0.7  # least share of filler and unnatural words of a filler passage
FILLER_SEEDS = 0.06  # least share of words of the dummy Latin alone
FILLER_WORDS = 5
COMMON = 1000  # a word in more than one of so many documents is common; so many words a document at most are common
STEM = 6
RAREST = 6.5  # most weight of a token: what is in one of 700 documents and less counts alike, whatever the size of the corpus
ASSOCIATED = 10_000  # a word in more than one of so many documents, at least half of them with dummy Latin, is dummy text as well

_TOKEN = re.compile(r"[^\W\d_]+|\d+")
_RUN = re.compile(r"\w+")
_PERCENT = re.compile(r"%[A-Za-z%]")
_HAN = re.compile("[一-鿿㐀-䶿]+")
_SENTENCE = re.compile(r"(?<=[.!?;])\s+|(?<=[。！？；])|\s*:\s+(?=\S{3,}[^:]*$)")

# Spans between template signs, of any length within a line.
_SIGNED = re.compile(
    r"\{\{[^{}\n]*\}\}|\{%[^{}\n]*%\}|\{![^{}\n]*!\}|\{#[^{}\n]*#\}|[#$]\{[^{}\n]*\}|<%[^<>\n]*%>|<\?[^<>\n]*\?>|<<[^<>\n]+>>|\[\[[^\[\]\n]+\]\]|&lt;[^&\n]+&gt;|\{[A-Za-z_\d][^{}\n]*\}"
    r"|@@\w[^@\n]*@@|%%\w[^%\n]*%%|(?<!\w)__[A-Za-z](?:[^_\n]|_(?!_))*__(?!\w)"
    r"|(?<![\w#])#[A-Za-z]\w*(?:[ _]\w+)*#(?![\w#])|(?<![\w@])@[A-Za-z]\w*(?:[ _]\w+)*@(?!\w)|(?<![\w%])%[A-Za-z]\w*(?:[ _]\w+)*%(?!\w)|(?<![\w~])~[A-Za-z]\w*(?:[ _]\w+)*~(?!\w)|(?<![\w$])\$[A-Za-z]\w*(?:[ _]\w+)*\$(?!\w)"
)
_BRACKETED = re.compile(r"\[[^\[\]\n]+\]|<[^<>\n]+>|«[^«»\n]+»|［[^［］\n]+］|【[^【】\n]+】|‹[^‹›\n]+›")
# A date or time with its figures left open.
_BLANK_DATE = re.compile(r"(?<!\w)(?:[Xx]{2}[/.\-][Xx]{2}[/.\-][\dXx]{2,4}|[Xx]{4}-[Xx]{2}-[Xx]{2}|[DdTtJj]{2}[/.\-][Mm]{2}[/.\-][YyJjAa]{4}|[Yy]{4}-[Mm]{2}-[Dd]{2})(?!\w)")
_SIGN = re.compile(r"[^\w\s]+|_+")


def stem(word: str) -> str:
    return word[:STEM]


def words(text: str) -> list[str]:
    """Tokens of a passage: stems of words, pairs of Chinese characters, runs of x, and numbers that could be an HTTP status."""
    out = []
    for w in _TOKEN.findall(text.lower()):
        if w.isdigit():
            if len(w) == 3 and w[0] in "45":
                out.append("#status")
        elif _HAN.match(w):
            for run in _HAN.findall(w):
                out += [run[i : i + 2] for i in range(max(1, len(run) - 1))]
            out += [stem(x) for x in _HAN.split(w) if x]
        elif len(w) > 1 and not w.strip("x"):
            out.append("#xx")
        else:
            out.append(stem(w))
    return out


_KEPT = 300_000  # words a worker remembers
_tokens_of: dict[str, str | tuple[str, ...]] = {}


def distinct_words(text: str) -> set[str]:
    """``set(words(text))``, in less time: each run of letters and digits is cut once."""
    known, out = _tokens_of, set()
    for run in set(_RUN.findall(text.lower())):
        t = known.get(run)
        if t is None:
            cut = words(run)
            t = cut[0] if len(cut) == 1 else tuple(cut)
            if len(known) >= _KEPT:
                known.clear()
            known[run] = t
        if t.__class__ is str:
            out.add(t)
        else:
            out.update(t)
    return out


def signed_spans(text: str) -> list[str]:
    """Spans between template signs, and dates with open figures."""
    out = _SIGNED.findall(text) if any(c in text for c in "{<@~#$") or "%" in text and _PERCENT.search(text) or "[[" in text or "__" in text or "&lt;" in text else []
    if "xx" in (low := text.lower()) or "mm" in low:
        out += _BLANK_DATE.findall(text)
    return out


def opening(span: str) -> str:
    """The token of the signs that open a span."""
    if _BLANK_DATE.fullmatch(span):
        return "#open:date"
    head = _SIGN.match(span)
    return "#open:" + (span[:4] if span.startswith("&lt;") else head.group()[:2] if head else "")


def shape(span: str) -> str:
    """The token of how the inside of a span is written."""
    inside = span.strip("[]<>«»［］【】‹›{}%#$@~!?=& ").strip()
    if re.search(r"[^\W_]_[^\W_]", inside):
        return "#shape:joined"
    if re.fullmatch(r"[a-z]+[A-Z]\w*", inside):
        return "#shape:camel"
    if re.fullmatch(r"[a-z]\w*(?:\.[a-z]\w*)+", inside):
        return "#shape:dotted"
    return "#shape:words" if " " in inside else "#shape:word"


def span_words(span: str) -> set[str]:
    return {"s:" + w for w in words(span.replace("_", " "))}


def span_name(span: str) -> str:
    """The words of a span, lower case with single blanks."""
    return re.sub(r"[\W_]+", " ", span).strip().lower()


class Index:
    """Exemplars by id: tokens and kind."""

    def __init__(self) -> None:
        self.messages: list[tuple[frozenset[str], str]] = []
        for kind, block in (("server", exemplars.SERVER), ("script", exemplars.SCRIPT), ("standin", exemplars.STANDIN)):
            self.messages += [(frozenset(words(e)), kind) for e in exemplars.expanded(block)]
        self.messages = list(dict.fromkeys(self.messages))
        self.filler = frozenset(map(stem, exemplars.FILLER.split()))
        self.spans = [(frozenset([opening(e.replace("*", "name"))]), "sign") for e in exemplars.SYNTAX.split()] + [(frozenset(["#open:date"]), "sign")]
        self.spans += [(frozenset([s]), "field") for s in ("#shape:joined", "#shape:camel", "#shape:dotted")]
        for kind, block in (("order", exemplars.COMMAND), ("field", exemplars.FIELD)):
            self.spans += [(frozenset(span_words(e)), kind) for e in exemplars.expanded(block)]
        self.spans = list(dict.fromkeys(self.spans))
        self.vocabulary = frozenset(t for tokens, _ in (*self.messages, *self.spans) for t in tokens) | self.filler


INDEX = Index()


def word_counts(df: DataFrame, text: str) -> DataFrame:
    """``token, n, n_filler``: in how many documents each word and span token occurs, and in how many of those that hold dummy Latin.

    The row of the empty token counts the documents. Pre-aggregated in each task, which passes
    its counts on when they reach a fixed number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter[str] = Counter()
        latin: Counter[str] = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64()), pa.array([latin[t] for t in count], pa.int64())], ["token", "n", "n_filler"])

        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    found = distinct_words(t)
                    for g in signed_spans(t):
                        found.add(opening(g))
                    if "[" in t or "<" in t or not t.isascii():
                        for g in _BRACKETED.findall(t):
                            found.add(shape(g))
                            found |= span_words(g)
                    found.add("")
                    count.update(found)
                    if len(found & INDEX.filler) > 1:
                        latin.update(found)
                    if len(count) > 500_000:
                        yield rows()
                        count.clear()
                        latin.clear()
        yield rows()

    return df.select(text).mapInArrow(run, "token string, n long, n_filler long").groupBy("token").agg(F.sum("n").alias("n"), F.sum("n_filler").alias("n_filler"))


class Frequencies:
    """Document frequencies of the exemplars' tokens, the common words outside dummy text, and words that go with it.

    Bounded: with documents of ``k`` words on average at most ``k * COMMON`` words are common, and
    ``k * ASSOCIATED`` associated.
    """

    def __init__(self, documents: int = 0, known: dict[str, int] | None = None, natural: frozenset[str] = frozenset(), latin: frozenset[str] = frozenset()):
        self.documents, self.known, self.natural, self.latin = documents, known or {}, natural, latin


def frequencies(df: DataFrame, text: str) -> Frequencies:
    counts = written(word_counts(df, text))
    whole = counts.where("token = ''").collect()
    n = int(whole[0].n) if whole else 0
    listed = df.sparkSession.createDataFrame([(t,) for t in INDEX.vocabulary], "token string")
    known = {r.token: r.n for r in counts.join(F.broadcast(listed), "token", "left_semi").collect()}
    common = counts.where((F.col("n") > 1) & (F.col("n") * COMMON >= n) & (F.col("n_filler") * 2 < F.col("n")) & ~F.col("token").rlike("^(#|s:)") & (F.col("token") != ""))
    latin = counts.where((F.col("n") > 2) & (F.col("n") * ASSOCIATED >= n) & (F.col("n_filler") * 2 >= F.col("n")) & ~F.col("token").rlike("^(#|s:)") & (F.col("token") != ""))
    return Frequencies(n, known, *(frozenset(r.token for r in x.select("token").collect()) for x in (common, latin)))


class Matcher:
    def __init__(self, counted: Frequencies = Frequencies()):
        self.natural = counted.natural - INDEX.filler
        self.latin = counted.latin | INDEX.filler
        n = counted.documents
        self.idf = {t: min(math.log((n + 1) / (counted.known.get(t, 0) + 1)), RAREST) + 0.1 for t in INDEX.vocabulary}
        self.other = 3.0  # weight of words that no exemplar has
        self.weight = [sum(self.idf[t] for t in tokens) for tokens, _ in INDEX.messages]
        #: Each exemplar under tokens of which a passage must hold one to retrieve it.
        self.posting: dict[str, list[int]] = {}
        for i, (tokens, _) in enumerate(INDEX.messages):
            left = self.weight[i]
            for t in sorted(tokens, key=lambda t: (-self.idf[t], t)):
                self.posting.setdefault(t, []).append(i)
                left -= self.idf[t]
                if left < RETRIEVED * self.weight[i]:
                    break
        self.telling = frozenset(self.posting)
        self.span_posting: dict[str, list[int]] = {}
        self.span_weight = [sum(self.idf[t] for t in tokens) for tokens, _ in INDEX.spans]
        for i, (tokens, _) in enumerate(INDEX.spans):
            for t in tokens:
                self.span_posting.setdefault(t, []).append(i)

    def told(self, distinct: set[str]) -> set[str]:
        """The telling tokens of a document by which it could hold an exemplar: those of exemplars it contains with all its passages together."""
        found = distinct & self.telling
        near = {i for t in found for i in self.posting[t]}
        held = {i for i in near if sum(self.idf[t] for t in distinct & INDEX.messages[i][0]) >= CONTAINED * self.weight[i]}
        return {t for t in found if not held.isdisjoint(self.posting[t])} if held else set()

    def passage(self, text: str) -> str | None:
        """Kind of the best matching exemplar if a passage is residue."""
        return self.match(words(text))

    def match(self, tokens: list[str], least: int = 1, contained: float = CONTAINED, covered: float = COVERED) -> str | None:
        distinct = set(tokens)
        found = distinct & self.telling
        if not found:
            return None
        total = sum(self.idf.get(t, self.other) for t in distinct)
        held: dict[str, set[str]] = {}
        best: dict[str, float] = {}
        for i in {i for t in found for i in self.posting[t]}:
            e, kind = INDEX.messages[i]
            if len(e) < least:
                continue
            shared = distinct & e
            part = sum(self.idf[t] for t in shared) / self.weight[i]
            if part >= RETRIEVED:
                held.setdefault(kind, set()).update(shared)
                best[kind] = max(best.get(kind, 0.0), part)
        for kind in sorted(best, key=best.get, reverse=True):
            if best[kind] >= contained and len(held[kind]) >= least and sum(self.idf[t] for t in held[kind]) >= covered * total:
                return kind
        return None

    def windows(self, tokens: list[str]) -> str | None:
        """The same for windows around the telling tokens of a long passage: a message that runs on into other text."""
        at = [i for i, t in enumerate(tokens) if t in self.telling]
        size = 2 * WINDOW_TOKENS
        if len(tokens) <= size or not at:
            return None
        ends = [0]
        for a, b in zip(at, at[1:]):
            if b - a > WINDOW_TOKENS:
                ends.append(b)
        for start in ends:
            run = [i for i in at if i >= start]
            stop = next((a for a, b in zip(run, run[1:]) if b - a > WINDOW_TOKENS), run[-1])
            first = run[0]
            for i in range(max(0, first - 2), stop + 1):
                for width in (WINDOW_TOKENS, 9, 14):
                    if kind := self.match(tokens[i : i + width], WINDOW_TOKENS, WINDOW, WINDOW):
                        return kind
        return None

    def filler(self, text: str) -> bool:
        tokens = [t for t in words(text) if t[0] != "#"]
        if len(tokens) < FILLER_WORDS:
            return False
        seeds = sum(t in self.latin for t in tokens)
        if seeds < 3 or len(set(tokens) & self.latin) < 2 or seeds < FILLER_SEEDS * len(tokens):
            return False
        return sum(t in self.latin or t not in self.natural for t in tokens) >= FILLER * len(tokens)

    def span(self, tokens: set[str]) -> bool:
        """Whether the tokens of a span hold and are covered by an exemplar of spans."""
        total = sum(self.idf.get(t, 1.0) for t in tokens if not t.startswith("#shape"))
        for i in {i for t in tokens for i in self.span_posting.get(t, ())}:
            e, kind = INDEX.spans[i]
            matched = sum(self.idf[t] for t in tokens & e)
            if matched < SPAN * self.span_weight[i] or not e <= tokens:
                continue
            if kind == "sign" and matched >= COVERED_SIGN * total or kind == "order" and matched >= COVERED_ORDER * total:
                return True
            if kind == "field" and (matched >= COVERED_FIELD * total or any(t.startswith("#shape") for t in e) and matched >= COVERED_ORDER * total):
                return True
        return False

    def document(self, text: str | None) -> tuple[set[str], set[str], set[str]]:
        """Kinds of residue in a text, and the names in brackets and in template signs that are still to be compared."""
        found: set[str] = set()
        open_names: set[str] = set()
        names: set[str] = set()
        if not text or text.isspace():
            return found, open_names, names
        rest = text
        if spans := signed_spans(text):
            for g in spans:
                if self.span({opening(g)} | span_words(g)):
                    found.add("slot")
                    if re.search(r"[^\W\d_]{3}", g):
                        names.add(span_name(g))
            rest = _BLANK_DATE.sub(" ", _SIGNED.sub(" ", text))
        if "[" in rest or "<" in rest or not rest.isascii():
            for g in _BRACKETED.findall(rest):
                if self.span({shape(g)} | span_words(g)):
                    found.add("slot")
                else:
                    open_names.add(span_name(g))
            rest = _BRACKETED.sub(" ", rest)
        distinct = distinct_words(rest)
        if len(distinct & self.latin) > 1 and any(self.filler(p) for p in rest.split("\n")):
            found.add("filler")
        told = self.told(distinct)
        if not told:
            return found, open_names, names
        # Tokens as they stand in text; those made of several signs are looked for by what they are made of.
        signs = {"x" if t == "#xx" else t for t in told if t != "#status"}
        seen: set[str] = set()
        joined = re.sub(r"-\n", "", rest)
        whole = re.sub(r"(?<![.!?:;。！？\n])[ \t]*\n[ \t]*(?=[a-zà-ÿ0-9])(?![45]\d\d [A-Z])", " ", joined)  # lines that a scan broke within a sentence
        # Lines as they stand count only if they hold little else: they may be parts of sentences.
        for part, least in ((joined, WINDOW), (whole, None), (re.sub(r"\n(?!\n)", " ", joined), None)):
            for line in part.split("\n"):
                low = line.lower()
                if not ("#status" in told and ("4" in low or "5" in low) or any(s in low for s in signs)):
                    continue
                if least:
                    if kind := self.match(words(line), 1, least, least):
                        found.add(kind)
                    continue
                for p in (line, *_SENTENCE.split(line)):
                    if p and p not in seen:
                        seen.add(p)
                        if kind := self.match(tokens := words(p)) or self.windows(tokens):
                            found.add(kind)
        return found, open_names, names


def residue(df: DataFrame, key: str, text: str, matcher: Matcher) -> DataFrame:
    """``key`` and ``kinds`` (joined by commas) of each document with residue; null, empty and blank texts have none.

    A name in ordinary brackets is a field too if at least ``NAMED`` of its spans in the corpus
    stand in template signs: the names of both are compared as rows, however many there are.
    """
    shared = df.sparkSession.sparkContext.broadcast(matcher)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            rows = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found, open_names, names = m.document(t)
                if found or open_names or names:
                    rows.append((k, ",".join(sorted(found)) or None, sorted(open_names), sorted(names)))
            if rows:
                k, kinds, a, z = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(kinds, pa.string()), pa.array(a, pa.list_(pa.string())), pa.array(z, pa.list_(pa.string()))], [key, "kinds", "open_names", "names"])

    rows = df.select(F.col(key).cast("long").alias(key), F.col(text)).where(F.col(text).isNotNull())
    judged = written(rows.mapInArrow(run, f"`{key}` long, kinds string, open_names array<string>, names array<string>"))
    opened = judged.where(F.size("open_names") > 0).select(key, F.explode("open_names").alias("name"))
    fields = judged.where(F.size("names") > 0).select(F.explode("names").alias("name")).groupBy("name").agg(F.count("*").alias("signed"))
    # The names that stand in signs are joined to the counts of all bracketed names; a name that
    # is common in brackets, as notes are, has one row by then.
    in_brackets = opened.groupBy("name").agg(F.count("*").alias("bracketed"))
    slots = fields.join(in_brackets, "name").where(F.col("signed") >= NAMED * (F.col("signed") + F.col("bracketed"))).select("name")
    more = opened.join(slots, "name", "left_semi").select(key, F.lit("slot").alias("kinds"))
    both = judged.where("kinds IS NOT NULL").select(key, "kinds").unionByName(more)
    return both.groupBy(key).agg(F.concat_ws(",", F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.split("kinds", ",")))))).alias("kinds"))
