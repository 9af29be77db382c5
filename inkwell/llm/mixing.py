"""Mixing sources to target weights by Pfair scheduling of their blocks."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.storage import materialize

#: Target weights of the production query; "*" stands for all other sources together.
TARGETS = {"src0": 4, "src1": 2, "src2": 2, "src3": 1, "*": 11}
#: Characters of a block.
BLOCK = 100_000
#: Parts that the documents of a source are dealt to, in whose order they are taken.
PARTS = 4096
_PRIME, _STEP = 2147483647, 48271


def schedule(weights: dict[str, int]) -> list[tuple[str, int, int]]:
    """(source, k, slot): when the k-th block of each period runs; the period has as many slots as the weights' sum.

    Block k of a source of weight w is released at slot floor(k * period / w) and due by ceil((k + 1) * period / w);
    in each slot the released block that is due first runs, ties by the order of sources. All meet their deadlines,
    so at any time a source has had less than one block more or less than its share.
    """
    import heapq

    if any(not isinstance(w, int) or w < 1 for w in weights.values()):
        raise ValueError("target weights are whole numbers of at least 1")
    period, out, ready = sum(weights.values()), [], []
    releases: dict[int, list] = {}
    for rank, (source, w) in enumerate(weights.items()):
        for k in range(w):
            releases.setdefault(k * period // w, []).append((-(-(k + 1) * period // w), rank, k, source))
    for slot in range(period):
        for block in releases.get(slot, []):
            heapq.heappush(ready, block)
        _, _, k, source = heapq.heappop(ready)
        out.append((source, k, slot))
    return out


def mix(docs: DataFrame, weights: dict[str, int], id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK) -> DataFrame:
    """(id, source, row, pool, before, block, slot) of every row: the order of the mixed corpus is by slot, then before.

    A source's documents are taken in a fixed scattered order (a multiplicative hash of the id in PARTS parts,
    then the id). `before` is the characters of its pool ahead of a document, and its block is the one that
    these reach; blocks run in the slots of the schedule, period after period. A source with no more blocks
    leaves its slots empty and the others go on in their proportions: no row is dropped or repeated.
    Sources not named (and null ones) share the pool "*", whose weight is 1 where none is given. Null texts
    count no character; rows of null id are dealt to the parts by `row`, the hash of their text, which also
    tells rows apart that share an id; repeated rows are rows of their own; an empty table gives an empty one;
    extra columns are not read. Running sums are taken in parts, so a source with most
    rows is spread over PARTS windows; what is joined to them has a row for each pool and part.
    """
    spark = docs.sparkSession
    weights = weights if "*" in weights else weights | {"*": 1}
    pool = F.when(F.col("source").isin([s for s in weights if s != "*"]), F.col("source")).otherwise(F.lit("*"))
    part = F.coalesce(F.pmod(F.pmod(F.col("id"), F.lit(_PRIME)) * _STEP, F.lit(_PRIME)) % PARTS, F.pmod(F.col("row"), F.lit(PARTS))).cast("int")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).alias("source"), F.xxhash64(text_col).alias("row"), F.coalesce(F.length(text_col), F.lit(0)).cast("long").alias("size"))
    rows = materialize(rows.withColumns({"pool": pool, "part": part}), "sizes")
    sums = rows.groupBy("pool", "part").agg(F.sum("size").alias("part_size"))
    ahead = F.sum("part_size").over(Window.partitionBy("pool").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select("pool", "part", F.coalesce(ahead, F.lit(0)).alias("offset"))
    own = F.sum("size").over(Window.partitionBy("pool", "part").orderBy("id", "size", "row").rowsBetween(Window.unboundedPreceding, -1))
    placed = rows.withColumn("own", F.coalesce(own, F.lit(0))).join(F.broadcast(offsets), ["pool", "part"])
    placed = placed.select("id", "source", "row", "pool", (F.col("offset") + F.col("own")).alias("before")).withColumn("block", F.floor(F.col("before") / block).cast("long"))
    period = sum(weights.values())
    plan = spark.createDataFrame(schedule(weights), "pool string, k long, at long")  # a row for each slot of the period
    weight = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))[F.col("pool")].cast("long")
    placed = placed.withColumns({"k": F.col("block") % weight, "round": F.floor(F.col("block") / weight)})
    mixed = placed.join(F.broadcast(plan), ["pool", "k"])
    return mixed.select("id", "source", "row", "pool", "before", "block", (F.col("round") * period + F.col("at")).cast("long").alias("slot"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, pool, before, block, slot of every document."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), TARGETS).drop("row").withColumnRenamed("id", "doc_id")


def in_order(docs: DataFrame, weights: dict[str, int], id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with their own columns in the mixed order: dealt to ranges of slots, and sorted within each.

    A row finds its place by its id, its source and the hash of its text, nulls included; only rows alike in all
    three share one, the first of them. No row is dropped or repeated; an empty table gives an empty one.
    """
    keys = {"id": F.col(id_col).cast("long"), "source": F.col(source_col), "row": F.xxhash64(text_col)}
    order = mix(docs, weights, id_col, text_col, source_col).groupBy(*(F.col(k).alias(f"_ink_{k}") for k in keys)).agg(F.min(F.struct("slot", "before")).alias("_ink_at"))
    joined = docs.join(order, reduce(and_, (c.eqNullSafe(F.col(f"_ink_{k}")) for k, c in keys.items())), "left")
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return joined.repartitionByRange(ranges, "_ink_at", F.xxhash64(text_col)).sortWithinPartitions("_ink_at", id_col).drop("_ink_at", *(f"_ink_{k}" for k in keys))


OP2_SQL = f"""
WITH s AS (SELECT doc_id, source, coalesce(length(text), 0) AS size, CASE WHEN source IN ({", ".join(f"'{s}'" for s in TARGETS if s != "*")}) THEN source ELSE '*' END AS pool,
             ((doc_id % {_PRIME}) * {_STEP}) % {_PRIME} % {PARTS} AS part FROM documents),
b AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY pool ORDER BY part, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM s),
w(pool, weight) AS (VALUES {", ".join(f"('{s}', {w})" for s, w in TARGETS.items())}),
p(pool, k, offset_slot) AS (VALUES {", ".join(f"('{s}', {k}, {t})" for s, k, t in schedule(TARGETS))})
SELECT doc_id, source, b.pool, before, before // {BLOCK} AS block, before // {BLOCK} // weight * {sum(TARGETS.values())} + offset_slot AS slot
FROM b JOIN w USING (pool) JOIN p ON p.pool = b.pool AND p.k = before // {BLOCK} % weight
"""
