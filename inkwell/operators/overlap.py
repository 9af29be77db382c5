"""How much of a text already stands in a corpus: sampled word 8-grams as an inverted index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.text import matches, rounded
from inkwell.storage import materialize

GRAM, ONE_IN, LEAST_WORDS, TOP = 8, 4, 20, 5


def overlap_words(text: Column) -> Column:
    return matches(F.lower(text), "[a-z0-9']+")


def sampled_grams(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pos, gram): every position whose gram falls in the sample, by a hash of the gram alone."""
    words = rows.select(F.col(id_col).alias("id"), overlap_words(F.col(text_col)).alias("w"))
    at = F.when(F.size("w") >= GRAM, F.sequence(F.lit(1), F.size("w") - (GRAM - 1))).otherwise(F.array().cast("array<int>"))
    # The outer form: the inner one makes the whole array a second time, for a filter of its size.
    grams = words.select("id", F.posexplode_outer(F.transform(at, lambda i: F.md5(F.array_join(F.slice("w", i, F.lit(GRAM)), " ").cast("binary")))).alias("pos", "gram"))
    return grams.where(F.conv(F.substring("gram", 1, 4), 16, 10).cast("int") % ONE_IN == 0)


def build_index(corpus: DataFrame, id_col: str = "doc_id", text_col: str = "text", queries: DataFrame | None = None, query_col: str = "text") -> DataFrame:
    """(gram, chunk): which texts hold a gram; write it partitioned and sorted by gram to keep it.

    With the queries at hand only their grams are kept, before anything of the corpus is shuffled or made distinct
    if their grams are few enough for Spark to send them to all tasks.
    """
    grams = sampled_grams(corpus, id_col, text_col).select("gram", F.col("id").alias("chunk"))
    if queries is not None:
        wanted = sampled_grams(queries.select(F.lit(0).alias("id"), query_col), "id", query_col).select("gram").distinct()
        grams = grams.join(materialize(wanted, "wanted-grams"), "gram", "left_semi")
    return grams.distinct()


def overlap(index: DataFrame, queries: DataFrame, id_col: str, text_col: str, gated: bool = False, sample=sampled_grams) -> DataFrame:
    """(id, positions, hits, percent): sampled positions of each query, and how many stand in the corpus.

    gated leaves texts of fewer than LEAST_WORDS words unasked, as the service does: they have no position.
    sample is the function that gave the index its grams.
    """
    asked = queries.where(F.size(overlap_words(F.col(text_col))) >= LEAST_WORDS) if gated else queries
    grams = sample(asked, id_col, text_col)
    wanted = grams.select("gram").distinct()
    known = index.join(wanted, "gram", "left_semi").select("gram").distinct().withColumn("hit", F.lit(1))
    per = grams.join(known, "gram", "left").groupBy("id").agg(F.count("*").alias("positions"), F.count("hit").alias("hits"))
    every = queries.select(F.col(id_col).alias("id")).join(per, "id", "left")
    hits, n = F.coalesce("hits", F.lit(0)), F.coalesce("positions", F.lit(0))
    return every.select("id", n.alias("positions"), hits.alias("hits"), F.when(n > 0, rounded(100.0 * hits / n, 1)).otherwise(F.lit(0.0)).alias("percent"))


def top_sources(index: DataFrame, queries: DataFrame, id_col: str, text_col: str, k: int = TOP, sample=sampled_grams) -> DataFrame:
    """(id, chunk, n, percent, rank): the k texts of the corpus that hold most of a query's sampled positions."""
    grams = sample(queries, id_col, text_col)
    total = grams.groupBy("id").agg(F.count("*").alias("positions"))
    counted = grams.groupBy("id", "gram").agg(F.count("*").alias("m")).join(index, "gram").groupBy("id", "chunk").agg(F.sum("m").alias("n"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), "chunk"))
    best = counted.withColumn("rank", rank).where(F.col("rank") <= k).join(total, "id")
    return best.select("id", "chunk", "n", rounded(100.0 * F.col("n") / F.col("positions"), 1).alias("percent"), F.col("rank").cast("long").alias("rank"))
