"""Joins of rows with a table of their groups that hold up when one group has most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot when it has more than one row in so many; so fewer keys than this can be hot.
HOT_SHARE = 1000
#: Groups smaller than this are never worth splitting.
HOT_LEAST = 5_000


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, spread: str, how: str = "inner", salts: int = 64) -> DataFrame:
    """rows joined with groups (one row per key, its row count in column size).

    Keys holding more than 1/HOT_SHARE of all rows are found from the counts: there are fewer than
    HOT_SHARE of them, which bounds the broadcast. Their rows are dealt to parts by the column `spread` and the
    task that read them, so that equal or null values of it spread too; a key has as many parts as its rows
    are more than one key may hold, `salts` at least, and its group row is repeated for each. groups is read
    two or three times: pass a written table. Keys must not be null where a match is wanted.
    """
    total, most = groups.agg(F.sum(size), F.max(size)).first()
    floor = max((total or 0) // HOT_SHARE, HOT_LEAST)
    if (most or 0) <= floor:
        return rows.join(groups, keys, how)
    parts = F.greatest(F.ceil(F.col(size) / floor).cast("int"), F.lit(salts))
    hot = groups.where(F.col(size) > floor).select(*keys, parts.alias("_ink_parts"))
    tagged = rows.withColumn("_ink_task", F.spark_partition_id()).join(F.broadcast(hot), keys, "left")
    salt = F.when(F.col("_ink_parts").isNotNull(), F.pmod(F.xxhash64(spread, "_ink_task"), F.col("_ink_parts"))).otherwise(F.lit(0)).cast("int")
    every = F.when(F.col(size) > floor, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.lit(0)))
    left = tagged.withColumn("_ink_salt", salt).drop("_ink_parts", "_ink_task")
    return left.join(groups.withColumn("_ink_salt", F.explode(every)), [*keys, "_ink_salt"], how).drop("_ink_salt")
