"""Attachments: validation, decoding, DOCX and simple PDF text, page furniture, truncation."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = ("sql", "txt", "md", "markdown", "csv", "docx", "pdf")
PLAN_EXTENSIONS = ("txt", "csv")
# First bytes of programs.
PROGRAMS = ("4D5A", "7F454C46", "CAFEBABE", "FEEDFA")
MAX_BYTES = 10 << 20
MAX_CHARS = 300_000
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def error_code(path: Column, content: Column, allowed: tuple[str, ...] = EXTENSIONS, max_bytes: int = MAX_BYTES) -> Column:
    """The first failing check, in this order: extension, empty, size, program, wrong format; null if none fails."""
    ext, head = extension(path), F.hex(F.substring(content, 1, 4))
    program = F.lit(False)
    for p in PROGRAMS:
        program = program | head.startswith(p)
    return (
        F.when(~ext.isin(*allowed), "bad_extension").when(content.isNull() | (F.length(content) == 0), "empty").when(F.length(content) > max_bytes, "too_large").when(program, "program")
        .when((ext == "pdf") & ~head.startswith("25504446"), "not_pdf").when((ext == "docx") & (head != "504B0304"), "not_docx")
    )


def decode(data: bytes) -> str:
    """BOM, UTF-8, CP950, a statistical guess, CP950 with replacement: the first that works."""
    if data.startswith((b"\xff\xfe", b"\xfe\xff")):
        return data.decode("utf-16", "replace")
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        pass
    try:
        return data.decode("cp950")
    except UnicodeDecodeError:
        pass
    try:
        from charset_normalizer import from_bytes

        if (best := from_bytes(data).best()) is not None:
            return str(best)
    except ImportError:
        pass
    return data.decode("cp950", "replace")


def docx_text(data: bytes, max_total: int = 80 << 20, max_ratio: int = 100) -> tuple[str | None, str | None]:
    """(text, error) of a DOCX: paragraphs and table cells in document order, blank ones left out."""
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
        infos = z.infolist()
        if any(i.filename.lower().endswith("vbaproject.bin") for i in infos):
            return None, "macro"
        if sum(i.file_size for i in infos) > max_total or any(i.file_size > max_ratio * max(i.compress_size, 1) for i in infos):
            return None, "compression_bomb"
        root = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, zlib.error, NotImplementedError, RuntimeError):
        return None, "corrupt"
    lines = []
    for p in root.iter(f"{_W}p"):
        text = "".join(t.text or "" if t.tag == f"{_W}t" else "\t" if t.tag == f"{_W}tab" else "\n" for t in p.iter() if t.tag in (f"{_W}t", f"{_W}tab", f"{_W}br"))
        if text.strip():
            lines.append(text)
    return "\n".join(lines), None


_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.S)
_SHOWN = re.compile(rb"\((?:\\.|[^\\()])*\)\s*(?:Tj|')|\[(?:[^\]\\]|\\.)*\]\s*TJ|T\*|\bT[dD]\b")
_STRING = re.compile(rb"\((?:\\.|[^\\()])*\)")


def pdf_pages(data: bytes) -> tuple[list[str], str | None]:
    """(pages, error) of a PDF whose streams are plain or Flate and whose text is shown as simple strings."""
    if b"/Encrypt" in data:
        return [], "encrypted"
    pages = []
    for m in _STREAM.finditer(data):
        body = m.group(1)
        try:
            body = zlib.decompress(body)
        except zlib.error:
            pass
        if b"BT" not in body:
            continue
        out = []
        for s in _SHOWN.finditer(body):
            text = b"".join(re.sub(rb"\\([()\\])", rb"\1", x[1:-1]) for x in _STRING.findall(s.group()))
            out.append("\n" + text.decode("latin-1") if s.group().endswith(b"'") else text.decode("latin-1") if text else "\n")
        pages.append(re.sub(r"\n+", "\n", "".join(out)).strip())
    if not pages:
        return [], "unsupported_pdf"
    return (pages, None) if any(len(re.findall(r"\w", p)) >= 10 for p in pages) else ([], "scanned")


def texts(df: DataFrame) -> DataFrame:
    """``path, page, text, error_code`` of attachments (path, content); one row a page, unreadable ones with their error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ext = path.lower().rpartition(".")[2]
                if ext == "docx":
                    text, error = docx_text(data)
                    rows.append((path, 0, text, error))
                elif ext == "pdf":
                    pages, error = pdf_pages(data)
                    rows += [(path, i, p, None) for i, p in enumerate(pages)] if not error else [(path, 0, None, error)]
                else:
                    rows.append((path, 0, decode(data), None))
            columns = list(zip(*rows)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.string()))], ["path", "page", "text", "error_code"])

    checked = df.withColumn("error_code", error_code(F.col("path"), F.col("content")))
    good = checked.where("error_code IS NULL").select("path", "content").mapInArrow(run, "path string, page int, text string, error_code string")
    return good.unionByName(checked.where("error_code IS NOT NULL").select("path", F.lit(0).alias("page"), F.lit(None).cast("string").alias("text"), "error_code"))


def without_furniture(pages: DataFrame, key: str = "path", short: int = 80) -> DataFrame:
    """``key, text``: pages joined in order without lines that repeat on nearly all pages, and without page numbers.

    A line is furniture if it is shorter than ``short`` and stands on at least max(2, n-1) of n >= 2 pages.
    """
    lines = pages.select(key, "page", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("bare", F.trim("line"))
    n = pages.groupBy(key).agg(F.countDistinct("page").alias("n"))
    often = lines.where((F.length("bare") > 0) & (F.length("bare") < short)).groupBy(key, "bare").agg(F.countDistinct("page").alias("on")).join(n, key)
    drop = often.where((F.col("n") >= 2) & (F.col("on") >= F.greatest(F.lit(2), F.col("n") - 1))).select(key, "bare")
    number = F.col("bare").rlike(r"^(?:[-–—]?\s*\d+\s*[-–—]?|(?i:page)\s+\d+(\s*(/|of)\s*\d+)?|第\s*\d+\s*頁.*)$")
    kept = lines.join(n, key).where(~((F.col("n") >= 2) & number)).join(drop, [key, "bare"], "left_anti")
    ordered = F.array_sort(F.collect_list(F.struct("page", "pos", "line")))
    text = kept.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))
    return pages.select(key).dropDuplicates().join(text, key, "left").select(key, F.coalesce("text", F.lit("")).alias("text"))


def truncated(df: DataFrame, text: str = "text", most: int = MAX_CHARS) -> DataFrame:
    return df.withColumn("truncated", F.coalesce(F.length(text) > most, F.lit(False))).withColumn(text, F.substring(text, 1, most))
