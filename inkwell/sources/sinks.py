"""Writing data sets, reports and the overlap index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.operators.books import multiscale
from inkwell.operators.encoder import exists
from inkwell.storage import materialize


def write_chunks(chunks: DataFrame, path: str) -> None:
    """A data set of chunks as JSON lines; chunk_id is a chunk's ordinal in its book as a string.

    Chunks follow the number of their chunk_id; those whose id is no number come after, by name.
    """
    order = Window.partitionBy("author", "book").orderBy(F.expr("try_cast(chunk_id AS long)").asc_nulls_last(), "chunk_id")
    chunks.withColumn("chunk_id", (F.row_number().over(order) - 1).cast("string")).write.mode("overwrite").json(path)


def write_shuffled(rows: DataFrame, path: str, key: str, seed: str = "42") -> None:
    """A multiscale data set in hash order, dealt to ranges of hashes."""
    rows.withColumn("_h", F.md5(F.concat_ws("|", F.lit(seed), F.col(key)).cast("binary"))).repartitionByRange("_h").sortWithinPartitions("_h").drop("_h").write.mode("overwrite").json(path)


def write_chunk_texts(chunks: DataFrame, path: str) -> None:
    """The texts alone, in a directory for each author."""
    chunks.select("author", F.regexp_replace("text", "\n", "\\\\n").alias("value")).write.mode("overwrite").partitionBy("author").text(path)


def write_reports(quality: DataFrame, duplicates: DataFrame, path: str) -> None:
    quality.write.mode("overwrite").json(f"{path}/quality_report")
    duplicates.write.mode("overwrite").json(f"{path}/duplicates_report")


def write_index(index: DataFrame, path: str, parts: int) -> None:
    """The overlap index, sorted by gram in ranges, so that a lookup reads few row groups."""
    index.repartitionByRange(parts, "gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(path)


def append_texts(texts: DataFrame, path: str, candidate: str, source: str = "upload", registered_by: str | None = None) -> DataFrame:
    """Append texts (candidate, text) to the store at a path and return the rows as written.

    Texts are only ever appended, in a directory for each candidate: id, text, source, registered_by, added_at.
    Ids go on from the largest there; a run's rows are numbered within the tasks that write them, whose first
    numbers come from their counts, so no task sees them all. One run at a time may append to a store.
    """
    spark = texts.sparkSession
    last = read_store(spark, path).agg(F.max("id")).first()[0] if exists(spark, path) else None
    rows = materialize(texts.select(candidate, "text").withColumn("_part", F.spark_partition_id()).withColumn("_own", F.monotonically_increasing_id()), "registered")
    sums = rows.groupBy("_part").agg(F.count("*").alias("n"), F.min("_own").alias("_first"))  # a row for each task
    ahead = sums.select("_part", "_first", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    number = F.lit((last or 0) + 1) + F.col("_ahead") + F.col("_own") - F.col("_first")
    made = rows.join(F.broadcast(ahead), "_part").select(candidate, number.cast("long").alias("id"), "text", F.lit(source).alias("source"), F.lit(registered_by).cast("string").alias("registered_by"), F.current_timestamp().alias("added_at"))
    made = materialize(made, "numbered")
    made.write.mode("append").partitionBy(candidate).parquet(path)
    return made


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The registered texts; a filter on the candidate reads its directory alone."""
    return spark.read.parquet(path)


def write_store(texts: DataFrame, path: str, candidate: str = "candidate", id_col: str = "id") -> None:
    """Texts in the order of their ids, a directory for each candidate; one of very many texts has a file for each range of ids."""
    texts.repartitionByRange(candidate, id_col).sortWithinPartitions(candidate, id_col).write.mode("overwrite").partitionBy(candidate).parquet(path)


def compact_store(spark: SparkSession, path: str, to: str, candidate: str = "candidate") -> None:
    """The store at a path written anew at another one: many small appends become few sorted files, ids stay."""
    if path.rstrip("/") == to.rstrip("/"):
        raise ValueError("a store is compacted to another path")
    write_store(read_store(spark, path), to, candidate)


def texts_of(spark: SparkSession, path: str, name: str, first: int | None = None, last: int | None = None, candidate: str = "candidate", id_col: str = "id") -> DataFrame:
    """A candidate's texts in the order of their ids, from the first to the last id if given; other candidates' files and other ranges are not read."""
    rows = read_store(spark, path).where(F.col(candidate) == name)
    if first is not None:
        rows = rows.where(F.col(id_col) >= first)
    if last is not None:
        rows = rows.where(F.col(id_col) <= last)
    return rows.orderBy(id_col)


def write_multiscale(chunks: DataFrame, path: str) -> None:
    """The multiscale data set of chunks, in hash order."""
    write_shuffled(multiscale(chunks), path, "chunk_id")
