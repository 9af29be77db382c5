"""What a request takes of a portfolio and of a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.text import long_size


def first_works(works: DataFrame, owner: str, order: str, text: str, most: int, chars: int) -> DataFrame:
    """The first `most` works of each owner, each cut to `chars` characters.

    Every task keeps the first works of an owner that it holds before anything is shuffled, so an owner of any
    number of works brings `most` from each task. Works without owner have no portfolio.
    """
    r = F.row_number().over(Window.partitionBy(owner).orderBy(order))
    return works.where(F.col(owner).isNotNull()).withColumn("_r", r).where(F.col("_r") <= most).drop("_r").withColumn(text, F.substring(text, 1, chars))


def portfolios(works: DataFrame, owner: str, order: str, text: str, most: int, chars: int, total: int) -> DataFrame:
    """(owner, n_works, n_used, n_chars, accepted): a portfolio is accepted if its cut works have text and at most `total` characters.

    Null texts count as empty. Only lengths are shuffled.
    """
    sized = works.select(owner, order, F.least(F.coalesce(F.length(text), F.lit(0)), F.lit(chars)).cast("long").alias("_n"))
    r = F.row_number().over(Window.partitionBy(owner).orderBy(order))
    used = sized.where(F.col(owner).isNotNull()).withColumn("_r", r).where(F.col("_r") <= most)
    per = used.groupBy(owner).agg(F.count("*").alias("n_used"), F.sum("_n").alias("n_chars"))
    all_works = sized.groupBy(owner).agg(F.count("*").alias("n_works"))
    return all_works.join(per, owner).select(owner, "n_works", "n_used", "n_chars", ((F.col("n_chars") > 0) & (F.col("n_chars") <= total)).alias("accepted"))


def _previews(p: Column, chars: int) -> Column:
    return F.transform(p, lambda x: F.substring(x, 1, chars))


def first_paragraphs(rows: DataFrame, paragraphs: str, most: int, preview: int = 220) -> DataFrame:
    """rows with n_paragraphs, and of the first `most` paragraphs: n_used, n_chars and previews_sha256, in the row itself."""
    others = [c for c in rows.columns if c != paragraphs]
    used = rows.withColumn("_u", F.slice(paragraphs, 1, most))
    return used.select(
        *others, long_size(F.col(paragraphs)).alias("n_paragraphs"), long_size(F.col("_u")).alias("n_used"),
        F.aggregate("_u", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("n_chars"),
        F.sha2(F.array_join(_previews(F.col("_u"), preview), "\n").cast("binary"), 256).alias("previews_sha256"),
    )
