"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.operators.skew import HOT_LEAST, join_groups
from inkwell.storage import drop, materialize

MAX_ROUNDS = 60


def local_forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that the edges (i, j) reach from it."""
    label = np.arange(n)
    while len(i):
        a, b = label[i], label[j]
        open_ = a != b
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label != (up := label[label])).any():
            label = up
    return label


#: Edges up to which one task finds the components.
FEW_EDGES = 5_000


def _solve(batches):
    """Arrow function: all of a few edges (u, v) to (node, component)."""
    edges = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
    u, v = (np.concatenate([e[k] for e in edges] + [np.empty(0, np.int64)]) for k in (0, 1))
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    label = local_forest(len(nodes), at[: len(u)], at[len(u) :])
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], names=["node", "component"])


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of edges (src, dst: long); component is the smallest node reachable.

    FEW_EDGES or fewer are solved by one task. Of more,
    each round writes its edges to the shared folder and lasts two aggregations by node and two joins of
    edges with their node's smallest neighbour. Partial sums keep a node with very many neighbours from
    reaching one task in the former; in the latter such a node is dealt to parts by its count of neighbours,
    as every centre of a large component is from the first round on. Null ends and loops are ignored; an
    empty table gives an empty result. Rounds grow with the logarithm of the longest path.
    """
    u, v = F.col("u"), F.col("v")
    now = edges.where(F.col("src") != F.col("dst")).select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    now, before = materialize(now, "edges"), None
    n_edges = now.count()
    if n_edges <= FEW_EDGES:
        return now.coalesce(1).mapInArrow(_solve, "node long, component long")
    for _ in range(MAX_ROUNDS):
        made = []

        def met(rows: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
            if n_edges <= HOT_LEAST:  # no node can have more neighbours than there are edges
                return rows.join(nodes.drop("n"), "u")
            made.append(materialize(nodes, name))
            return join_groups(rows, made[-1], ["u"], "n", "v").drop("n")

        # Large star: every larger neighbour of a node points to the node's smallest neighbour.
        both = now.unionByName(now.select(v.alias("u"), u.alias("v")))
        larger = F.count_if(v > u).alias("n")
        least = both.groupBy("u").agg(F.least(F.min("v"), u).alias("m"), larger).where("n > 0")
        large = met(both.where(v > u), least, "least").select(v.alias("u"), F.col("m").alias("v")).where(u != v).distinct()
        # Small star: every smaller neighbour points to the smallest one.
        if n_edges > HOT_LEAST:
            made.append(large := materialize(large, "large"))  # both read below and in the search for hot nodes
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = met(large, low, "low").select(v.alias("u"), F.col("m").alias("v")).where(u != v).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        after = materialize(small, "edges")
        mark = after.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("u").cast("decimal(38,0)"))).first()
        n_edges = mark[0]
        for old in (now, *made):
            drop(old)
        now = after
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components still change after {MAX_ROUNDS} rounds")
    return now.select(u.alias("node"), v.alias("component")).unionByName(now.select(v.alias("node"), v.alias("component")).distinct())
