"""Reading a corpus of books, data sets of chunks, and uploaded files; bad files become rows with an error."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


CHUNKS = T.StructType([
    T.StructField("author", T.StringType()), T.StructField("book", T.StringType()), T.StructField("chunk_id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("word_count", T.IntegerType()),
    T.StructField("n_paragraphs", T.IntegerType()), T.StructField("starts_with_dialogue", T.BooleanType()), T.StructField("ends_with_dialogue", T.BooleanType()), T.StructField("starts_new_chapter", T.BooleanType()),
    T.StructField("chapter_span", T.ArrayType(T.IntegerType())), T.StructField("scale", T.StringType()),
])
ENCODINGS = ("utf-8-sig", "cp1252", "latin-1")
# Limits on uploads.
MAX_BYTES, MAX_PARAGRAPHS, MAX_WORDS = 20 * 1024 * 1024, 50_000, 60_000
#: Bytes of a document's text part when unpacked.
MAX_UNPACKED = 200 * 1024 * 1024
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def decode_bytes(content: bytes) -> str:
    """The text of bytes in the first encoding that fits, with line ends levelled."""
    for encoding in ENCODINGS:
        try:
            return content.decode(encoding).replace("\r\n", "\n").replace("\r", "\n")
        except UnicodeDecodeError:
            continue
    return content.decode("latin-1", "replace")


@F.pandas_udf(T.StringType())
def decoded(content: pd.Series) -> pd.Series:
    return content.map(lambda b: None if b is None else decode_bytes(bytes(b)))


def read_books(spark: SparkSession, root: str) -> DataFrame:
    """(author, book, text) of every .txt file one directory below root; directories that start with _ or . are skipped, and so are files of no bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(f"{root}/*/")
    parts = F.split("path", "/")
    named = files.select(F.element_at(parts, -2).alias("author"), F.regexp_replace(F.element_at(parts, -1), r"\.txt$", "").alias("book"), "content")
    return named.where(~F.col("author").rlike("^[_.]")).select("author", "book", decoded("content").alias("text"))


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """A data set of chunks in JSON lines: declared columns, `large` where no scale is named, and the book's group."""
    rows = spark.read.schema(CHUNKS).json(path)
    return rows.where(F.col("text").isNotNull()).withColumn("scale", F.coalesce("scale", F.lit("large"))).withColumn("group", F.concat_ws("::", "author", "book"))


def read_large(spark: SparkSession, path: str) -> DataFrame:
    return read_chunks(spark, path).where(F.col("scale") == "large")


def sniff(content: bytes) -> str:
    """pdf, docx, unknown (another archive) or text, by the first bytes and an archive's directory."""
    if content[:5] == b"%PDF-":
        return "pdf"
    if content[:2] == b"PK" and content[2:4] in (b"\x03\x04", b"\x05\x06", b"\x07\x08"):
        try:
            names = zipfile.ZipFile(io.BytesIO(content)).namelist()
        except zipfile.BadZipFile:
            return "unknown"
        return "docx" if "[Content_Types].xml" in names and any(n.startswith("word/") for n in names) else "unknown"
    return "text"


def docx_text(content: bytes) -> str:
    """The non-empty paragraphs of a document, a blank line between each two."""
    archive = zipfile.ZipFile(io.BytesIO(content))
    if archive.getinfo("word/document.xml").file_size > MAX_UNPACKED:
        raise ValueError("file too large when unpacked")
    root = ElementTree.fromstring(archive.read("word/document.xml"))
    texts = ["".join(t.text or "" for t in p.iter(f"{_WORD}t")) for p in root.iter(f"{_WORD}p")]
    if len(texts) > MAX_PARAGRAPHS:
        raise ValueError("too many paragraphs")
    return "\n\n".join(t for t in texts if t.strip())


def extract_text(name: str, content: bytes) -> tuple[str | None, str | None]:
    """(text, error) of an upload: what its name says it is must be what it is, and within the limits."""
    try:
        if len(content) > MAX_BYTES:
            raise ValueError("file too large")
        kind, suffix = sniff(content), (re.search(r"\.(\w+)$", name.lower()) or [None, ""])[1]
        if {"txt": "text", "docx": "docx", "pdf": "pdf"}.get(suffix) != kind:
            raise ValueError(f"content is {kind}, not what the name says")
        if kind == "pdf":
            raise ValueError("unsupported: pdf")
        text = docx_text(content) if kind == "docx" else content.decode("utf-8", "replace")
        if len(text.split()) > MAX_WORDS:
            raise ValueError("too many words")
        if not text.strip():
            raise ValueError("no text")
        return text, None
    except Exception as e:  # noqa: BLE001  any fault of a file is that file's result
        return None, str(e) or type(e).__name__


def extract_uploads(files: DataFrame, name: str = "path", content: str = "content") -> DataFrame:
    """files with the columns text and error."""

    @F.pandas_udf("text string, error string")
    def extracted(names: pd.Series, contents: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([extract_text(n, bytes(c)) for n, c in zip(names, contents)], columns=["text", "error"])

    return files.withColumn("got", extracted(F.col(name), F.col(content))).select(*files.columns, "got.text", "got.error")
