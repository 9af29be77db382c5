"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.line_dedup import LONG_SITES, drop_boilerplate
from inkwell.llm.mixing import TARGETS, in_order
from inkwell.llm.near_copies import near_copies
from inkwell.llm.pieces import encode
from inkwell.llm.toxicity import clean_documents
from inkwell.storage import materialize


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that the toxicity score rejects.

    Each row is judged by its own whole text, so ties and repeated rows fare alike; null and empty texts have no
    evidence and stay, and so do rows without id where their text is clean. An empty table gives an empty one.
    """
    return clean_documents(spark, docs, sf_dir)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with cross-site boilerplate lines taken out, passages from a few sites on; n_chars follows the text that stays.

    No row goes. Null texts and rows without id are left as they are; a null source is a site of its own; of
    documents tied for a line the smallest id keeps it; repeated rows, and rows that share an id, are each cut by
    their own text. An empty table gives an empty one.
    """
    cut = drop_boilerplate(docs, long_sites=LONG_SITES)
    return cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word Jaccard 0.8 or more): that with the smallest id.

    A row goes by its id and its own text: another text that shares its id is judged by itself. Rows without id
    stay; texts that are null or hold no word are copies of each other; rows repeated with the id that stays all
    stay. An empty table gives an empty one.
    """
    found = near_copies(docs.select("doc_id", "text"))
    gone = found.where(F.col("id") != F.col("component_id")).select(F.col("id").alias("_gone"), F.col("row").alias("_row")).distinct()
    own = (F.col("doc_id").cast("long") == F.col("_gone")) & (F.xxhash64("text") == F.col("_row"))
    return docs.join(gone.hint("merge"), own, "left_anti").select(*docs.columns)  # gone grows with the copies: never broadcast


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All docs in the order that interleaves their sources at the target weights.

    No row goes or is repeated. A null source is in the pool of the unnamed, null texts take no room, null ids are
    placed by their text, and rows alike in id, source and text share a place. An empty table gives an empty one.
    """
    return in_order(docs, TARGETS)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_ids, n_bytes, round_trip of all docs.

    A null text has null ids and round_trip, an empty one no ids; null ids of documents and repeated rows are rows
    like any other. An empty table gives an empty one.
    """
    return encode(docs).withColumnRenamed("id", "doc_id")


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("simhash", simhash), ("mixing", mixing), ("sentencepiece", sentencepiece)]
#: Scores and fingerprints have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages on the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
