"""Exact dedup by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.ascii import ascii_lower
from inkwell.operators.skew import join_groups
from inkwell.storage import materialize

#: Characters of the beginning that the second step hashes.
PREFIX = 256


def _prefix(text: Column) -> Column:
    return F.xxhash64(ascii_lower(F.substring(text, 1, PREFIX)))


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(ascii_lower(text).cast("binary"), 256))


def refined(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(seen, groups) of rows (id, t, and what else they carry).

    The first step counts lengths in bytes, which case does not change; the second hashes the beginnings of the
    rows whose length stands more than once, and of no others. seen has every row's columns but the text, its
    length and its prefix, null where the length is its alone. groups has (length, prefix, n_rows) where more
    than one row is left.
    """
    sized = rows.withColumn("length", F.octet_length("t").cast("long"))
    lengths = materialize(sized.groupBy("length").agg(F.count("*").alias("n_rows")).where("n_rows > 1"), "lengths")
    others = [c for c in rows.columns if c != "t"]
    heads = sized.select(*others, "length", F.substring("t", 1, PREFIX).alias("head"))
    marked = join_groups(heads, lengths, ["length"], "n_rows", "id", "left")
    seen = materialize(marked.select(*others, "length", F.when(F.col("n_rows").isNotNull(), _prefix(F.col("head"))).alias("prefix")), "prefixes")
    groups = seen.where("prefix is not null").groupBy("length", "prefix").agg(F.count("*").alias("n_rows")).where("n_rows > 1")
    return seen, materialize(groups, "open-groups")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False) -> DataFrame:
    """(id, keep_id, group_size, kept, digest) for every row of docs.

    Texts are equal when identical after lower-casing A-Z; null counts as the empty text. Of equal texts the
    row with the largest id stays. Lengths are counted first; only rows whose length repeats have the hash of
    their first 256 characters taken, and only those that share both with another row have their whole content
    hashed (SHA-256) and compared. With digest_all the digest is given for other rows too, which then all are
    hashed; else it is null there. A row without id is kept only if no equal row has an id. Repeated rows count
    each and share kept; very long texts are hashed whole; an empty table gives an empty one; extra columns
    are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("t"))
    key = ["length", "prefix"]
    if digest_all:
        seen, groups = refined(rows.withColumn("digest", _digest(F.col("t"))))
    else:
        seen, groups = refined(rows)
        seen = seen.withColumn("digest", F.lit(None).cast("binary"))
    several = seen.where("prefix is not null")
    alone = seen.where("prefix is null").unionByName(join_groups(several, groups, key, "n_rows", "id", "left_anti"))
    if digest_all:
        open_ = join_groups(several, groups, key, "n_rows", "id", "left_semi").select("id", "digest")
    else:
        texts = rows.select("id", F.octet_length("t").cast("long").alias("length"), _prefix(F.col("t")).alias("prefix"), "t")
        open_ = join_groups(texts, groups, key, "n_rows", "id", "left_semi").select("id", _digest(F.col("t")).alias("digest"))
    open_ = materialize(open_, "digests")
    copies = open_.groupBy("digest").agg(F.max("id").alias("last"), F.count("*").alias("n_rows"))
    joined = join_groups(open_, materialize(copies, "copies"), ["digest"], "n_rows", "id")
    found = joined.select("id", F.col("last").alias("keep_id"), F.col("n_rows").alias("group_size"), F.col("last").eqNullSafe(F.col("id")).alias("kept"), "digest")
    single = alone.select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    return found.unionByName(single)


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every document."""
    found = exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest_all=True)
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP3_SQL = """
WITH n AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)
"""
