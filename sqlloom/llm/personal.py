"""Personal data in free text: found by how strongly its terms reveal protected entities, and generalised.

1. One pass over the texts collects *mentions* from comments, literals, predicates and notes:
   spans that could be an e-mail address, a phone or identity number, a street address or a
   name, each with its terms: the cue before it (words, or the column a literal is compared
   with), the shape of its digits, its last word, its name parts. Mentions are few and short;
   they are written once to a table in the shared folder, the texts are not.
2. Seeds are mentions that one of their terms suggests: names both of whose parts are listed,
   numbers behind words like "phone", written-out e-mail addresses. They decide nothing by
   themselves. Their co-occurrence with the other terms over the whole corpus gives each term's
   disclosure: the smoothed share of its mentions that are protected, so how much it reveals.
   The disclosure of a cue comes from the shapes of what stands behind it, that of a shape from
   the cues before it, that of a name part from cues, titles and, of a listed one, the other part; lists of words
   count only as ``PRIOR`` earlier mentions, which contrary ones outweigh.
3. Mentions whose terms disclose more than the thresholds are the cases, whether seeds or not;
   in the text they are generalised to the placeholder of their kind.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlloom.sources.once import first_of, key_hash, repeated, split
from sqlloom.sources.scratch import written

# Thresholds: the least share of protected mentions from which a term discloses its entity.
SHAPE = 0.15  # digit shapes, street types, ends of e-mail addresses
BEHIND = 0.5  # cues of numbers and addresses
CUE = 0.2  # cues of names, titles, first signs of Chinese names
PART = 0.5  # name parts, alone or together behind a cue
JOINT = 0.75  # two name parts together without a cue
CONTRARY = 0.05  # a part with less is mostly no name
LEAST = 3  # mentions a cue or an unlisted part needs before its share counts
PRIOR = 2.0  # mentions that a place in a list of words counts for
LISTED = 0.9  # share of protected ones among those

# Words that announce an entity, and common street types.
PHONE_CUES = frozenset("tel telephone phone call mobile cell fax 電話 手機 傳真".split())
ID_CUES = frozenset("id idno ssn passport identity 身分證 證號 身分證字號".split())
ADDRESS_CUES = frozenset("address lives addr 地址 住址".split())
STREETS = frozenset("street st road rd avenue ave lane ln close crescent terrace way boulevard blvd square sq drive dr court ct place pl row".split())
TITLES = "Mr|Mrs|Ms|Miss|Mx|Dr|Prof|Herr|Frau|Mme|Sr|Sra"

_HAN = "一-鿿"
_QUOTED = r"'((?:[^']|'')*)'"
_SQL_PART = re.compile(_QUOTED + r"|(--[^\n]*|/\*(?:[^*]|\*(?!/))*(?:\*/|\Z)|^[ \t]*(?:[Rr][Ee][Mm]|[Pp][Rr][Oo][Mm][Pp][Tt]|[Rr][Ee][Mm][Aa][Rr][Kk])\b[^\n]*)", re.M)
_REMARK = re.compile(r"^[ \t]*(?:REM|PROMPT)", re.M | re.I)
_LITERAL = re.compile(_QUOTED)
_COLUMN = re.compile(r"([A-Za-z_][\w$#]*)\"*(?:\s*,\s*\d+)*\s*\)?\s*(?:[=<>!^]{1,2}|\b[Ll][Ii][Kk][Ee]|\b[Ii][Nn]\s*\()\s*$")
_AT = re.compile(r"[(\[{]at[)\]}]", re.I)
#: Literals, comments, and brackets with the column whose IN list they open.
_BRACKET = re.compile(_QUOTED + r"|--[^\n]*|/\*(?:[^*]|\*(?!/))*(?:\*/|\Z)|([A-Za-z_][\w$#]*)\"*\s+[Ii][Nn]\s*\(|([()])")
_PREAMBLE = re.compile(r"\s*(?:Plan hash value: \d+\s*)?[-\s|]*")

_MAIL = re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+|[\w.+-]+\s?[(\[{]\s?at\s?[)\]}]\s?[\w-]+(?:(?:\.|\s?[(\[{]?\s?\bdot\b\s?[)\]}]?\s?)[\w-]+)+|\b[\w.+-]+ at [\w-]+(?: dot [\w-]+)+", re.I)
_NUMBER = re.compile(r"(?<![\w.,:-])(?:[A-Za-z][ -]?(?=\d{9}(?!\d)|\d{3}-\d{3}-\d{3}(?!\d)))?(?:\+|\()?\d(?:[ .()-]{0,2}\d){6,}(?:\s?(?:ext\.?|x)\s?\d+)?(?![\w])", re.I)
_STREET = re.compile(
    r"(?<!\w)(?:No\.? ?\d+[A-Za-z]?, (?:(?:Lane|Alley) \d+, )?|\d+[A-Za-z]? )(?:[A-Z][\w'’]*\.? ){1,3}?[A-Z][A-Za-z]+\b\.?(?:,? (?i:flat|floor|unit|apt|apartment|suite|room|level)\.? ?\w+)?(?:, [A-Z][A-Za-z]+(?: [A-Z][A-Za-z]+)?(?: \d{4,6})?(?![\w]))?"
)
_FULL = re.compile(r"(?i:\b(?:flat|floor|unit|apt|apartment|suite|room|level)\.? ?\w+)|, [A-Z]|[樓楼層层]|[市縣县區区].*[路街道巷段弄]")  # written out: with a flat or a place
_HAN_STREET = re.compile(rf"[{_HAN}]{{2,12}}[路街道巷段弄](?:[一二三四五六七八九十0-9０-９]+[段巷弄])*\s*[0-9０-９]+(?:之\d+)?[號号](?:[0-9０-９]+[樓楼层層F])?(?:之[0-9０-９]+)?")
_NAME = r"(?:[A-Z][a-zà-ÿ'’]+(?:-[A-Z][a-zà-ÿ]+)?|[A-Z]{2,}(?:-[A-Z]+)?)(?![\w])"
_PERSON = re.compile(rf"(?<![\w.@-])(?:({TITLES})\.? ({_NAME})(?: (?:[A-Z]\.? )?({_NAME}))?|({_NAME})(?:,? )(?:[A-Z]\. )?({_NAME}))")
_HAN_PERSON = re.compile(rf"(?<![{_HAN}])[{_HAN}]{{2,4}}(?![{_HAN}])")
_CUE = re.compile(rf"(?:([A-Za-z_]+)\.? )?([A-Za-z_]+)[.:：]?\s*[(<\[]?\s*$|([{_HAN}]{{1,12}})\s*[:：]?\s*[(<\[]?\s*$")


def cue_before(text: str, at: int) -> str:
    """The word that leads to a span, lower case (of Chinese text its last three characters)."""
    width = 48
    while True:
        before = text[max(0, at - width) : at]
        m = _CUE.search(before.replace("\n", " "))
        if len(before) < width or m and m.start() > 0 or not m and before[-1:].strip():
            break
        width *= 2  # the match may begin further back
    if not m:
        return ""
    if m.group(3):
        return m.group(3)[-3:]
    last, prev = m.group(2).lower(), (m.group(1) or "").lower()
    return prev if last in ("no", "number", "nr") and prev else "" if last in ("rem", "prompt", "and", "or") else last


def shape(span: str) -> str:
    s = re.sub(r"\d", "9", span.lower())
    s = re.sub(r"^[a-z]", "a", s)
    return re.sub(r"(ext\.?|x)\s?9+$", "x9", s)


def _seed(kinds: tuple[tuple[frozenset[str], str], ...], cue: str) -> str | None:
    words = {w for w in re.split(r"[ _\d]+", cue) if w != "id"} | {cue}  # "id" tells by itself, not at the end of a column's name
    return next((k for cues, k in kinds if words & cues or any(c in cue for c in cues if c > "一")), None)


_NUMBER_SEEDS = ((PHONE_CUES, "phone"), (ID_CUES, "id_number"))
_STREET_SEEDS = ((ADDRESS_CUES, "address"),)
_Mention = tuple[int, int, str, str, str, str | None, str | None, str | None]


def _in_columns(t: str) -> dict[int, str]:
    """The column of each literal (by the place of its content) that stands right in an IN list, however long."""
    out, opened = {}, []
    for m in _BRACKET.finditer(t):
        if m.group(1) is not None:
            if opened and opened[-1]:
                out[m.start(1)] = opened[-1]
        elif m.group(2) or m.group(3) == "(":
            opened.append(m.group(2))
        elif m.group(3) and opened:
            opened.pop()
    return out


class Collector:
    """Mentions of texts; what it made of a literal is kept for its next occurrence."""

    def __init__(self) -> None:
        self.literals: dict[str, tuple] = {}
        self.listed: tuple[str | None, dict[int, str]] = (None, {})  # the last text with long lists and the columns of their entries

    def spans(self, text: str, whole: bool) -> list[_Mention]:
        """(start, end, class, cue or '', sign, first part, second part, seed) within a comment or a whole literal."""
        out: list[_Mention] = []
        rest = text
        if "@" in text or "at" in text or "AT" in text:
            for m in _MAIL.finditer(text):
                out.append((m.start(), m.end(), "mail", "", re.split(r"\W+", m.group())[-1].lower(), None, None, "email" if "@" in m.group() else None))
                rest = rest[: m.start()] + "·" * (m.end() - m.start()) + rest[m.end() :]
        digits = any(c.isdigit() for c in rest)
        if digits:
            for pattern in (_STREET, _HAN_STREET):
                for m in pattern.finditer(rest):
                    if pattern is _STREET:
                        body = re.split(r",(?! (?:Lane|Alley))", re.sub(r"^No\.? ?\d+[A-Za-z]?, (?:(?:Lane|Alley) \d+, )?", "", m.group()))[0]
                        body = re.split(r" (?i:flat|floor|unit|apt|suite|room)\b", body)[0]
                        sign = body.rstrip(".").rpartition(" ")[2].lower()
                    else:
                        sign = "號"
                    cue = "" if whole else cue_before(rest, m.start())
                    out.append((m.start(), m.end(), "street", cue, sign, None, None, "address" if whole and len(m.group()) == len(text.strip()) or _FULL.search(m.group()) else _seed(_STREET_SEEDS, cue) if cue else None))
                    rest = rest[: m.start()] + "·" * (m.end() - m.start()) + rest[m.end() :]
            for m in _NUMBER.finditer(rest):
                if sum(c.isdigit() for c in m.group()) < 7:
                    continue
                cue = "" if whole else cue_before(rest, m.start())
                out.append((m.start(), m.end(), "number", cue, shape(m.group()), None, None, _seed(_NUMBER_SEEDS, cue) if cue else None))
        if not rest.isascii():
            for m in _HAN_PERSON.finditer(rest):
                if whole and len(m.group()) != len(rest.strip()):
                    continue
                cue = "" if whole else cue_before(rest, m.start())
                if whole or cue:
                    first = m.group()[0]
                    out.append((m.start(), m.end(), "han", cue, str(len(m.group())), first, m.group(), None))
        at = 0
        while m := _PERSON.search(rest, at):
            title, a, b = m.group(1), m.group(2) or m.group(4), m.group(3) or m.group(5)
            x, y = a.lower(), b.lower() if b else None
            if not title and a.isupper() != b.isupper():
                at = m.end(4)  # a capital word before a name is no part of it
                continue
            sign = "title:" + title.lower() if title else "comma" if "," in m.group() else "pair"
            cue = "" if whole else cue_before(rest, m.start())
            out.append((m.start(), m.end(), "name", cue, sign, x, y, None))
            # Without a cue the first word may be none of the name, so the next pair begins at the second.
            at = m.end(4) if not title and not whole and not cue else m.end()
        return out

    def literal(self, value: str) -> tuple:
        if (found := self.literals.get(value)) is None:
            if len(value) < 2 or len(value) > 400:
                return tuple(self.spans(value, True)) if len(value) > 400 else ()
            body = value.strip("%")
            # One word of letters and few digits holds nothing, nor does a key with a letter before, nor a date.
            if body.isascii() and "@" not in body and " " not in body and sum(c.isdigit() for c in body) < 7 and not _AT.search(body) or re.fullmatch(r"[A-Z]-\d{1,8}|\d{4}-\d\d-\d\d", body):
                found = ()
            else:
                lead = len(value) - len(value.lstrip("%"))
                found = tuple((lead + a, lead + b, *rest) for a, b, *rest in self.spans(body, True))
            if len(self.literals) < 100_000:
                self.literals[value] = found
        return found

    def text(self, t: str, plan: bool) -> list[_Mention]:
        out: list[_Mention] = []
        if plan:
            if "peration" not in t and "PERATION" not in t:
                return self.spans(t, False)
            self._literals(t, out)
            head = t.rfind("\n", 0, max(t.find("peration"), t.find("PERATION"))) + 1
            if head and not _PREAMBLE.fullmatch(t, 0, head):
                out = [m for m in out if m[0] >= head] + self.spans(t[:head], False)
            if (note := t.find("Note", head)) >= 0:  # quoted text in notes is no literal of the statement
                out = [m for m in out if m[0] < note]
                out += [(note + a, note + b, *rest) for a, b, *rest in self.spans(t[note:], False)]
        elif "--" in t or "/*" in t or _REMARK.search(t):
            for m in _SQL_PART.finditer(t):
                if m.group(1) is not None:
                    if found := self.literal(m.group(1)):
                        self._add(t, m.start(1), found, out)
                else:
                    base = m.start(2)
                    out += [(base + a, base + b, *rest) for a, b, *rest in self.spans(m.group(2), False)]
        else:
            self._literals(t, out)
        return out

    def _add(self, t: str, base: int, found: tuple, out: list[_Mention]) -> None:
        width, name = 60, None
        while True:
            before = t[max(0, base - 1 - width) : base - 1]
            column = _COLUMN.search(before)
            if len(before) < width or column and column.start() > 0 or not column and before.rstrip()[-1:] == ",":
                break
            if not column and before.strip() and before.rstrip()[-1] not in "=<>!^(eEnN":
                break
            width *= 2  # the column may begin further back
        name = column.group(1) if column else None
        if name is None and before.rstrip()[-1:] == ",":
            if self.listed[0] is not t:
                self.listed = t, _in_columns(t)
            name = self.listed[1].get(base)
        cue = (name or "literal").lower()
        for a, b, cls, _, sign, x, y, seed in found:
            out.append((base + a, base + b, cls, cue, sign, x, y, _seed(_NUMBER_SEEDS, cue) if cls == "number" else seed or _seed(_STREET_SEEDS, cue) if cls == "street" else seed))

    def _literals(self, t: str, out: list[_Mention]) -> None:
        if "''" in t or t.count("'") % 2:
            for m in _LITERAL.finditer(t):
                if found := self.literal(m.group(1)):
                    self._add(t, m.start(1), found, out)
            return
        at = 0
        for k, part in enumerate(t.split("'")):
            if k & 1 and (found := self.literal(part)):
                self._add(t, at, found, out)
            at += len(part) + 1


_SCHEMA = "key long, field string, start int, stop int, cls string, cue string, sign string, part1 string, part2 string, seed string"


def collect(df: DataFrame, key: str, fields: tuple[tuple[str, bool], ...]) -> DataFrame:
    """All mentions in the text columns ``fields`` (name, whether it holds plans)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Collector()
        schema = pa.schema([("key", pa.int64()), ("field", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), *((n, pa.string()) for n in ("cls", "cue", "sign", "part1", "part2", "seed"))])
        for b in batches:
            rows = []
            keys = b.column(0).to_pylist()
            for i, (field, plan) in enumerate(fields):
                for k, t in zip(keys, b.column(i + 1).to_pylist()):
                    if t:
                        rows += [(k, field, *m) for m in c.text(t, plan)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    return df.select(F.col(key).cast("long"), *(F.col(f) for f, _ in fields)).where(" OR ".join(f"`{f}` IS NOT NULL" for f, _ in fields)).mapInArrow(run, _SCHEMA)


def _smoothed(support: Column, prior: Column | float) -> Column:
    """The share of supported mentions of a group, with ``PRIOR`` earlier ones of which a share ``prior`` was supported."""
    return (F.sum(support) + PRIOR * (F.lit(prior) if isinstance(prior, float) else prior)) / (F.count("*") + PRIOR)


def _shaped(mentions: DataFrame) -> DataFrame:
    """Numbers, addresses and e-mails with the ``kind`` that their shape or their cue discloses."""
    kinds = ("phone", "id_number", "address", "email")
    rows = mentions.where("cls IN ('number', 'street', 'mail')")
    listed = F.max((F.col("cls") == "street") & F.col("sign").isin("號", *STREETS)).cast("double") * LISTED
    shapes = rows.groupBy("cls", "sign").agg(*(_smoothed((F.coalesce("seed", F.lit("")) == k).cast("int"), listed if k == "address" else 0.0).alias(f"s_{k}") for k in kinds))
    rows = rows.join(shapes, ["cls", "sign"])
    told = rows.where("cue NOT IN ('', 'literal')")
    cues = told.groupBy("cls", "cue").agg(F.count("*").alias("n"), *(_smoothed(F.col(f"s_{k}"), F.max(F.coalesce(F.col("seed") == k, F.lit(False))).cast("double")).alias(f"c_{k}") for k in kinds)).where(F.col("n") >= LEAST).drop("n")
    rows = rows.join(cues, ["cls", "cue"], "left").na.fill(0.0, [f"c_{k}" for k in kinds])
    # A kind that a shape or a cue discloses; of several the strongest.
    scores = [F.when((F.col(f"s_{k}") >= SHAPE) | (F.col(f"c_{k}") >= BEHIND), F.greatest(f"s_{k}", f"c_{k}")) for k in kinds]
    best = F.greatest(*(F.coalesce(s, F.lit(0.0)) for s in scores))
    kind = F.coalesce(*(F.when((s == best) & (best > 0), k) for s, k in zip(scores, kinds)))
    return rows.withColumn("kind", kind).where("kind IS NOT NULL")


def _people(mentions: DataFrame, names: DataFrame) -> DataFrame:
    """Names that their cue, title and parts disclose."""
    listed = names.where("part_text IS NOT NULL").groupBy(F.lower("part_text").alias("part")).agg(F.max(F.col("part_kind") == "given").alias("given"), F.max(F.col("part_kind") == "family").alias("family"))
    rows = mentions.where("cls IN ('name', 'han')")
    for p in ("1", "2"):
        rows = rows.join(listed.select(F.col("part").alias("part" + p), F.col("given").alias("given" + p), F.col("family").alias("family" + p)), "part" + p, "left").na.fill(False, ["given" + p, "family" + p])
    known1, known2 = F.col("given1") | F.col("family1"), F.col("given2") | F.col("family2")
    title = F.col("sign").startswith("title:")
    seed = F.when(F.col("cls") == "han", F.col("family1")).otherwise((F.col("given1") & F.col("family2")) | (F.col("family1") & F.col("given2")) | (title & (F.col("family1") | F.col("family2"))))
    rows = rows.withColumn("known1", known1).withColumn("known2", known2).withColumn("seeded", seed.cast("int"))
    # Cues and titles disclose by the seeds behind them.
    cues = rows.groupBy("cue").agg(F.count("*").alias("n"), F.sum("seeded").alias("s")).where((F.col("n") >= LEAST) & (F.col("s") >= CUE * F.col("n"))).select("cue", F.lit(True).alias("strong"))
    titles = rows.where(title).groupBy("sign").agg(_smoothed(F.col("seeded"), LISTED).alias("d")).where(F.col("d") >= CUE).select("sign", F.lit(True).alias("titled"))
    rows = rows.join(cues, "cue", "left").join(titles, "sign", "left").na.fill(False, ["strong", "titled"])
    # A part discloses by the cue and the title of its mentions; a listed one by another listed one too.
    outside = F.col("strong") | F.col("titled")
    both = (F.col("cls") == "name") & F.col("known1") & F.col("known2")
    one = rows.where("part1 IS NOT NULL").select("cls", F.col("part1").alias("part"), F.col("known1").alias("known"), (outside | both).cast("int").alias("support"))
    two = rows.where("part2 IS NOT NULL AND cls = 'name'").select("cls", F.col("part2").alias("part"), F.col("known2").alias("known"), (outside | both).cast("int").alias("support"))
    parts = one.unionByName(two).groupBy("cls", "part").agg(_smoothed(F.col("support"), F.max(F.col("known").cast("double")) * LISTED).alias("d"), F.max("known").alias("known"), F.count("*").alias("n"))
    parts = parts.where(F.col("known") | (F.col("n") >= LEAST))
    for p in ("1", "2"):
        rows = rows.join(parts.select("cls", F.col("part").alias("part" + p), F.col("d").alias("d" + p)), ["cls", "part" + p], "left").na.fill(0.0, ["d" + p])
    d1, d2 = F.col("d1"), F.col("d2")
    joint = 1 - (1 - d1) * (1 - d2)
    person = (  # a name that stands behind no telling cue needs two telling parts, one of them listed
        F.when(F.col("cls") == "han", F.col("strong") & (d1 >= CUE))
        .when(F.col("titled"), F.lit(True))
        .when(F.col("strong"), joint >= PART)
        .otherwise((joint >= JOINT) & (F.least(d1, d2) >= CONTRARY) & (F.col("known1") | (d1 >= PART)) & (F.col("known2") | (d2 >= PART)) & (F.col("known1") | F.col("known2")))
    )
    return rows.where(person).withColumn("kind", F.lit("person"))


def judged(mentions: DataFrame, names: DataFrame) -> DataFrame:
    """The mentions that disclose a protected entity, with its ``kind``.

    ``mentions`` should be a written table, for it is read several times. Every statistic is a
    pre-aggregated count over all mentions.
    """
    columns = ["key", "field", "start", "stop", "kind"]
    return _shaped(mentions).select(columns).unionByName(_people(mentions, names).select(columns))


def redacted(df: DataFrame, key: str, fields: tuple[tuple[str, bool], ...], found: DataFrame) -> DataFrame:
    """``key`` and the text columns with typed placeholders in place of the findings; all else unchanged.

    Null and empty texts stay as they are. Of overlapping findings the first and longest counts.
    Of a row delivered twice the least by its texts stays. Only rows that may hold a finding or be
    delivered twice are shuffled with their texts; the others stay where they are.
    """
    found = written(found.select("key", "field", "start", "stop", "kind").dropDuplicates())
    spans = found.groupBy(F.col("key").alias("_key")).agg(F.collect_list(F.struct("field", "start", "stop", "kind")).alias("_spans"))  # those of one text
    rows = df.select(F.col(key).cast("long").alias(key), *(F.col(f) for f, _ in fields))
    alone, maybe = split(rows, key, repeated(rows, key).union(found.select(key_hash("key")).distinct()))
    maybe = first_of(maybe, key).join(spans, F.col(key) == F.col("_key"), "left").drop("_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [b.column(i + 1).to_pylist() for i in range(len(fields))]
            for r, spans in enumerate(b.column(len(fields) + 1).to_pylist()):
                for i, (f, _) in enumerate(fields):
                    mine = sorted(((s["start"], -s["stop"], s["kind"]) for s in spans or () if s["field"] == f))
                    if mine and texts[i][r]:
                        out, at = [], 0
                        for a, z, kind in mine:
                            if a >= at:
                                out += [texts[i][r][at:a], f"<{kind.upper()}>"]
                                at = -z
                        texts[i][r] = "".join([*out, texts[i][r][at:]])
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(t, pa.string()) for t in texts)], [key, *(f for f, _ in fields)])

    return alone.unionByName(maybe.mapInArrow(run, f"`{key}` long, " + ", ".join(f"`{f}` string" for f, _ in fields)))
