"""Files as rows: discovery, uploads, text lines, CSV, JSON, DOCX and PDF words."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions.text import basename

EXTENSIONS = (".pdf", ".docx")
MAX_UPLOAD = 15 * 1024 * 1024


def suffix(c):
    return F.lower(F.regexp_extract(basename(c), r"^.+(\.[^.]+)$", 1))


def discover(spark: SparkSession, *paths: str, extensions: tuple = EXTENSIONS) -> DataFrame:
    """(path, length, modificationTime, content) of files under the paths, each path once.
    Directories are walked; names are matched whatever the case of their suffix."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths))
    return found.where(suffix(F.col("path")).isin(*extensions)).dropDuplicates(["path"])


def listing(spark: SparkSession, *paths: str, extensions: tuple = EXTENSIONS) -> DataFrame:
    """Sorted paths alone; contents aren't read."""
    return discover(spark, *paths, extensions=extensions).select("path").orderBy("path")


def screen_uploads(uploads: DataFrame, most: int = MAX_UPLOAD, extensions: tuple = EXTENSIONS) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with ``reason`` and ``status``) of uploads (filename, content)."""
    n = F.coalesce(F.octet_length("content"), F.lit(0))
    reason = F.when(~suffix(F.col("filename")).isin(*extensions), "unsupported extension").when(n == 0, "empty file").when(n > most, "too large")
    at = uploads.withColumn("reason", reason)
    return at.where("reason is null").drop("reason"), at.where("reason is not null").withColumn("status", F.when(F.col("reason") == "too large", 413).otherwise(400))


def gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """Phrases, one a line; blank lines and comments (#) go."""
    at = spark.read.text(path).select(F.regexp_replace("value", r"(?U)^\s+|\s+$", "").alias("phrase"))
    return at.where((F.col("phrase") != "") & ~F.col("phrase").startswith("#"))


def resume_csv(spark: SparkSession, path: str) -> DataFrame:
    """(ID, Resume_str, Category); malformed rows are skipped, a null text is empty."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("ID", "Resume_str", "Category")])
    at = spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"', mode="DROPMALFORMED", enforceSchema=False)
    return at.withColumn("Resume_str", F.coalesce("Resume_str", F.lit("")))


def vacancies_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vacancies, bad) of a directory of JSON files with one object each. Bad: not JSON, or
    without title or description."""
    fields = [T.StructField(n, T.StringType()) for n in ("title", "experience", "description", "_corrupt_record")]
    read = spark.read.schema(T.StructType(fields)).option("multiLine", True).option("mode", "PERMISSIVE")
    try:
        # the directory's own files by name: tables kept below it are no partitions of it
        at = read.json(f"{path.rstrip('/')}/*.json").withColumn("source_filename", F.col("_metadata.file_name"))
    except AnalysisException as none:
        if none.getCondition() != "PATH_NOT_FOUND":
            raise
        at = spark.createDataFrame([], T.StructType([*fields, T.StructField("source_filename", T.StringType())]))
    ok = F.col("_corrupt_record").isNull() & F.col("title").isNotNull() & F.col("description").isNotNull()
    return at.where(ok).drop("_corrupt_record").orderBy("source_filename"), at.where(~ok).select("source_filename", "_corrupt_record")


# --- DOCX --------------------------------------------------------------------------------

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_lines(content: bytes) -> list[tuple]:
    """(text, size, bold, top, column) of each paragraph that isn't blank, in body order;
    tables go column by column, a merged cell once."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{_W}body")
    out: list[tuple] = []

    def on(element) -> bool:
        return element is not None and element.get(f"{_W}val", "true") not in ("0", "false", "off")

    def paragraph(p, column: int) -> None:
        text = "".join("\t" if x.tag == f"{_W}tab" else "\n" if x.tag in (f"{_W}br", f"{_W}cr") else x.text or "" for x in p.iter() if x.tag in (f"{_W}t", f"{_W}tab", f"{_W}br", f"{_W}cr")).strip()
        if text:
            runs = [r.find(f"{_W}rPr") for r in p.iter(f"{_W}r")]
            runs = [r for r in runs if r is not None]
            sizes = [int(s.get(f"{_W}val")) / 2 for r in runs if (s := r.find(f"{_W}sz")) is not None]
            out.append((text, max(sizes, default=10.0), any(on(r.find(f"{_W}b")) for r in runs), float(len(out)), column))

    for child in body if body is not None else ():
        if child.tag == f"{_W}p":
            paragraph(child, 0)
        elif child.tag == f"{_W}tbl":
            grid: list[list] = []
            for row in child.iter(f"{_W}tr"):
                cells, at = [], 0
                for cell in row.findall(f"{_W}tc"):
                    props = cell.find(f"{_W}tcPr")
                    wide = props.find(f"{_W}gridSpan") if props is not None else None
                    down = props.find(f"{_W}vMerge") if props is not None else None
                    go_on = down is not None and down.get(f"{_W}val", "continue") == "continue"
                    own = grid[-1][at] if go_on and grid and at < len(grid[-1]) else cell
                    for _ in range(int(wide.get(f"{_W}val")) if wide is not None else 1):
                        cells.append(own)
                        at += 1
                grid.append(cells)
            seen = set()
            for column in range(max(map(len, grid), default=0)):
                for cells in grid:
                    if column < len(cells) and id(cells[column]) not in seen:
                        seen.add(id(cells[column]))
                        for p in cells[column].findall(f"{_W}p"):
                            paragraph(p, column)
    return out


def extract_lines(files: DataFrame, pdf_words=None) -> tuple[DataFrame, DataFrame]:
    """(lines, failed) of files (doc_id, path, content). A file that can't be read is a row
    of ``failed`` with its error, and doesn't stop the others.

    ``pdf_words`` is a provider from bytes to (page, text, x0, x1, top, size, fontname,
    page_width) tuples; without one, PDF files fail.
    """
    from ..operators import layout, scratch

    def run(batches):
        for batch in batches:
            rows = []
            for doc, path, content in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    if path.lower().endswith(".docx"):
                        got = docx_lines(content)
                        if not got:
                            raise ValueError("no text")
                        rows += [(doc, path, "line", i, t, s, b, top, col, 0, None, None, None, None, None) for i, (t, s, b, top, col) in enumerate(got, 1)]
                    elif path.lower().endswith(".pdf") and pdf_words:
                        got = list(pdf_words(content))
                        if not got:
                            raise ValueError("no text")
                        rows += [(doc, path, "word", i, t, size, None, top, None, page, x0, x1, font, width, None) for i, (page, t, x0, x1, top, size, font, width) in enumerate(got)]
                    else:
                        raise ValueError("unsupported file")
                except Exception as e:  # noqa: BLE001  one file's failure is its own
                    rows.append((doc, path, "error", *[None] * 11, f"{type(e).__name__}: {e}"))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(_PARTS)], [n for n, _ in _PARTS])

    names = {pa.int64(): "bigint", pa.int32(): "int", pa.string(): "string", pa.float64(): "double", pa.bool_(): "boolean"}
    parts = files.select("doc_id", "path", "content").mapInArrow(run, ", ".join(f"{n} {names[t]}" for n, t in _PARTS))
    spark, folder = files.sparkSession, scratch.folder(files.sparkSession, "extracted")
    parts.write.parquet(folder)  # each file is opened once, however many read its lines
    at = spark.read.schema(parts.schema).parquet(folder)
    lines = at.where("kind = 'line'").select("doc_id", F.col("seq").alias("line_no"), "text", F.col("size").alias("max_font_size"), "is_bold", "top", "col", "page")
    words = at.where("kind = 'word'").select("doc_id", "page", "seq", "text", "x0", "x1", "top", "size", "fontname", "page_width")
    return lines.unionByName(layout.lines(words)), at.where("kind = 'error'").select("doc_id", "path", "error")


_PARTS = [
    ("doc_id", pa.int64()), ("path", pa.string()), ("kind", pa.string()), ("seq", pa.int32()), ("text", pa.string()), ("size", pa.float64()), ("is_bold", pa.bool_()), ("top", pa.float64()),
    ("col", pa.int32()), ("page", pa.int32()), ("x0", pa.float64()), ("x1", pa.float64()), ("fontname", pa.string()), ("page_width", pa.float64()), ("error", pa.string()),
]


def text_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Plain texts as lines, without typographic signals."""
    at = docs.select(F.col(doc).alias("doc_id"), F.posexplode(F.split(text, "\r?\n")).alias("i", "text")).where(F.trim("text") != "")
    return at.select("doc_id", (F.col("i") + 1).alias("line_no"), "text", F.lit(10.0).alias("max_font_size"), F.lit(False).alias("is_bold"), F.col("i").cast("double").alias("top"), F.lit(0).alias("col"), F.lit(0).alias("page"))


_SAFE = re.compile(r"[A-Za-z0-9_]+")


def table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    at = spark.read.parquet(path)
    return at.select(*columns) if columns else at


def by_id(df: DataFrame, id_: int, column: str = "id") -> DataFrame:
    return df.where(F.col(column) == id_).limit(1)


LINES_SCHEMA = schemas.LINES
