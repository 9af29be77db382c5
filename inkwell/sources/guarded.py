"""Readers that lose nothing: what can't be used goes to a table of errors beside the rows, and models come from trusted folders alone."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.sources.corpus import CHUNKS, decode_bytes, sniff
from inkwell.storage import materialize

ERRORS = "source string, kind string, detail string"
#: Characters of a bad line that its error row keeps, which tell it; the file itself is named.
DETAIL = 1000


class UntrustedPath(ValueError):
    """A path outside the folder that it must lie in."""


def _resolved(spark: SparkSession, path: str) -> str:
    """The path with scheme, without `..`; links of the local file system are followed."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toUri().normalize()
    place = full.getPath()
    if full.getScheme() == "file":
        place = os.path.realpath(place)
    return f"{full.getScheme()}://{full.getAuthority() or ''}{place.rstrip('/')}"


def trusted(spark: SparkSession, path: str, allowed: str) -> str:
    """path, if it lies in the allowed folder or is it; else UntrustedPath, before anything of it is read."""
    inside, folder = _resolved(spark, path), _resolved(spark, allowed)
    if inside != folder and not inside.startswith(folder + "/"):
        raise UntrustedPath(f"{inside} is outside {folder}")
    return path


def load_trusted(load: Callable, spark: SparkSession, path: str, allowed: str):
    """What a loader (of encoders, verifiers, stacks) gives for a path in the allowed folder."""
    return load(spark, trusted(spark, path, allowed))


def chunks_with_errors(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of a data set of chunks in JSON lines: each line that is not blank is in one of the two.

    Lines that are no JSON or whose fields have other types are `corrupt`, those without text are `no text`. A field
    that the data set doesn't declare is left out.
    """
    schema = T.StructType([*CHUNKS, T.StructField("_bad", T.StringType())])
    read = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    parsed = materialize(read.withColumn("_source", F.input_file_name()), "parsed")  # what is corrupt is known only once whole lines are parsed
    fine = F.col("_bad").isNull() & F.col("text").isNotNull()
    rows = parsed.where(fine).drop("_bad", "_source").withColumn("scale", F.coalesce("scale", F.lit("large"))).withColumn("group", F.concat_ws("::", "author", "book"))
    named = F.concat_ws("::", "author", "book", "chunk_id")
    errors = parsed.where(~fine).select(F.col("_source").alias("source"), F.when(F.col("_bad").isNotNull(), "corrupt").otherwise("no text").alias("kind"), F.substring(F.coalesce("_bad", named), 1, DETAIL).alias("detail"))
    return rows, errors


def books_with_errors(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(rows, errors): author, book, text of the .txt files one directory below root, and of each that gives no text, why.

    Files of no bytes or of blanks alone are `empty`; those that are another format under the name are `not text`.
    Directories that start with _ or . are no part of the corpus and give neither.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(f"{root}/*/").select("path", "content")
    parts = F.split("path", "/")
    named = files.select(F.element_at(parts, -2).alias("author"), F.regexp_replace(F.element_at(parts, -1), r"\.txt$", "").alias("book"), "path", "content").where(~F.col("author").rlike("^[_.]"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kinds, texts = [], []
            for content in batch["content"]:
                what = sniff(bytes(content)) if content is not None else "text"
                text = decode_bytes(bytes(content)) if content is not None and what == "text" else None
                texts.append(text if text and text.strip() else None)
                kinds.append(f"not text: {what}" if what != "text" else None if texts[-1] else "empty")
            yield batch[["author", "book", "path"]].assign(text=texts, kind=kinds)

    read = materialize(named.mapInPandas(run, "author string, book string, path string, text string, kind string"), "books-read")
    # A scan skips files of no bytes: those that it listed and never read. It lists names on the driver anyway.
    listed = spark.createDataFrame([(re.sub("^file:/+", "file:/", unquote(p)),) for p in files.inputFiles()], "path string").where(~F.element_at(F.split("path", "/"), -2).rlike("^[_.]"))
    unread = listed.join(read.select("path"), "path", "left_anti").select(F.col("path").alias("source"), F.lit("empty").alias("kind"), F.lit("empty").alias("detail"))
    errors = unread.unionByName(read.where("kind is not null").select(F.col("path").alias("source"), F.substring_index("kind", ":", 1).alias("kind"), F.col("kind").alias("detail")))
    return read.where("kind is null").select("author", "book", "text"), errors


def upload_errors(extracted: DataFrame, name: str = "path") -> DataFrame:
    """The error rows of uploads that extract_uploads made."""
    return extracted.where(F.col("error").isNotNull()).select(F.col(name).alias("source"), F.lit("upload").alias("kind"), F.col("error").alias("detail"))


def write_with_errors(rows: DataFrame, errors: DataFrame, path: str) -> None:
    """The rows and, beside them, the errors, which are written even where there are none."""
    rows.write.mode("overwrite").parquet(f"{path}/rows")
    errors.write.mode("overwrite").parquet(f"{path}/errors")
