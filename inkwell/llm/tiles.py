"""Packing the rows of a bucket into tiles of bounded size, and pairing the tiles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.operators.components import local_forest

#: Most rows of a tile on average; what one task holds of a bucket is bounded by two tiles.
TILE = 8192


def tile_no(size: str, spread: str, rows: int = TILE):
    """The tile of a row in a bucket with `size` rows: dealt by a hash of the column `spread`."""
    return F.pmod(F.xxhash64(spread), F.ceil(F.col(size) / rows)).cast("int")


def pack(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row per tile with the arrays of its columns; keys include the tile number."""
    packed = rows.groupBy(*keys).agg(F.collect_list(F.struct(*columns)).alias("_items"))
    return packed.select(*keys, *(F.col(f"_items.{c}").alias(c) for c in columns))


class Forest:
    """The components of n places as links come in, so a step's links are all that is held at a time."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        a, b = self.label[i], self.label[j]
        new = a != b
        if new.any():
            self.label = local_forest(len(self.label), a[new], b[new])[self.label]

    def edges(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id, smallest id of its component) of every place that is linked to a smaller id."""
        least = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(least, self.label, ids)
        root = least[self.label]
        return ids[ids != root], root[ids != root]
