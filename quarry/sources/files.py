"""File loaders: text, Markdown, DOCX and (with a parser) PDF as segments."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T

#: Bytes of file contents that a task turns into texts at once, but for a larger file.
SLICE_BYTES = 4 << 20
FORMATS = [".pdf", ".txt", ".md", ".docx"]
_GLOB = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in f[1:]) for f in FORMATS) + "}"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _docx(data: bytes) -> str:
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return ""
    return "\n".join("".join(t.text or "" for t in p.iter(f"{_W}t")) for p in root.iter(f"{_W}p"))


def docx_of(text: str) -> bytes:
    """A file of one paragraph a line, as ``_docx`` reads it."""
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(line)}</w:t></w:r></w:p>' for line in text.split("\n"))
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{_W[1:-1]}"><w:body>{body}</w:body></w:document>')
    return data.getvalue()


def _pdf(data: bytes) -> list[tuple[str, int]]:
    try:
        from pypdf import PdfReader
    except ImportError:
        return [(data.decode("utf-8", "ignore"), 1)]
    try:
        pages = [(p.extract_text() or "", i) for i, p in enumerate(PdfReader(io.BytesIO(data)).pages, 1)]
    except Exception:  # a broken file has no pages; the others still load
        return []
    return [(t, i) for t, i in pages if t.strip()]


def segments_of(path: str, data: bytes) -> list[tuple[str, int | None]]:
    """(text, page) of a file's content; unsupported kinds have none."""
    kind = (re.search(r"\.[^.]+$", path.lower()) or [""])[0]
    if kind in (".txt", ".md"):
        return [(data.decode("utf-8", "ignore"), None)]
    if kind == ".docx":
        text = _docx(data)
        return [(text, None)] if text.strip() else []
    return _pdf(data) if kind == ".pdf" else []


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """(source_file, size_bytes, extension, content), one level deep; a missing folder
    is empty. Files of other kinds are not read."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    empty = spark.createDataFrame([], "source_file string, size_bytes long, extension string, content binary")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return empty
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").option("pathGlobFilter", _GLOB).load(folder)
    ext = T.suffix(F.col("path"))
    return files.select(F.col("path").alias("source_file"), F.col("length").alias("size_bytes"), ext.alias("extension"), "content").where(ext.isin(FORMATS))


def in_order(files: DataFrame) -> DataFrame:
    """By kind in the order of FORMATS, then by name."""
    kind = F.array_position(F.array(*[F.lit(f) for f in FORMATS]), F.col("extension"))
    return files.orderBy(kind, "source_file")


def listing(files: DataFrame) -> DataFrame:
    return files.select(T.basename(F.col("source_file")).alias("name"), "size_bytes", "extension").orderBy(F.lower("name"))


def served(requests: DataFrame, files: DataFrame) -> DataFrame:
    """(name, status, source_file) of requested names: only plain names of scanned
    files are served. A name with a folder in it is refused (403), one that no file
    has is unknown (404); of several files of a name the first is served."""
    plain = (T.basename(F.col("name")) == F.col("name")) & ~F.col("name").isin("", ".", "..") & ~F.contains("name", F.lit("\\"))
    asked = requests.select("name", F.coalesce(plain, F.lit(False)).alias("plain"))
    known = files.groupBy(T.basename(F.col("source_file")).alias("name")).agg(F.min("source_file").alias("source_file"))
    both = asked.join(known, "name", "left")
    status = F.when(~F.col("plain"), 403).when(F.col("source_file").isNull(), 404).otherwise(200)
    return both.select("name", status.alias("status"), F.when(F.col("plain"), F.col("source_file")).alias("source_file"))


def slices(batch, column: str, most: int = SLICE_BYTES):
    """An Arrow batch in slices of about ``most`` bytes in ``column``, one row at least."""
    import numpy as np
    import pyarrow.compute as pc

    upto = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + most, "right")))
        yield batch.slice(a, b - a)
        a = b


def segments(files: DataFrame, domain: str) -> DataFrame:
    """(domain, source_file, page, text) of scanned files."""

    def run(batches):
        import pyarrow as pa

        for b in (part for batch in batches for part in slices(batch, "content")):
            rows = [(p, page, text) for p, d in zip(b.column("source_file").to_pylist(), b.column("content").to_pylist()) for text, page in segments_of(p, d)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.string()))], ["source_file", "page", "text"])

    return files.select("source_file", "content").mapInArrow(run, "source_file string, page int, text string").withColumn("domain", F.lit(domain))


def load_and_chunk(spark: SparkSession, folder: str, domain: str, size: int = T.CHUNK_WORDS, overlap: int = T.CHUNK_OVERLAP) -> DataFrame:
    return T.chunks(segments(scan(spark, folder), domain), size, overlap)
