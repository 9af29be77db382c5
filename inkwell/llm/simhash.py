"""SimHash near-dedup by tiled exact comparison of 64-bit fingerprints."""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.operators.components import connected_components
from inkwell.operators.skew import join_groups
from inkwell.storage import materialize

from .tiles import Forest, pack, tile_no

SHINGLE_WORDS = 3
SEED = 42
RADIUS = 3
#: The four 16-bit parts of a fingerprint whose population counts name its cell.
PARTS = 4
_SIDE = 64 // PARTS + 1
_STEP = 65536


def fingerprint_of(text: bytes, words_per_shingle: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The unsigned SimHash of a UTF-8 text; 0 where it has no word."""
    import re

    import xxhash

    words = re.findall(rb"[^\x20\x09-\x0D]+", text.lower())  # bytes.lower() changes A-Z only
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= words_per_shingle:
        shingles = [line]
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes)[: len(words) - words_per_shingle + 1].tolist()
        shingles = map(line.__getitem__, map(slice, starts, ends[words_per_shingle - 1 :].tolist()))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, seed) for s in shingles], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _STEP):
        part = hashes[at : at + _STEP]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint of each whole text as a signed long. A null text has no words: fp 0."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            fps = np.fromiter((fingerprint_of(t.as_py() or b"") for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(run, "id long, fp long")


def _cell() -> Column:
    cell = F.lit(0)
    for k in range(PARTS):
        bits = F.shiftrightunsigned("fp", k * (64 // PARTS)).bitwiseAND(F.lit((1 << (64 // PARTS)) - 1))
        cell = cell * _SIDE + F.bit_count(bits)
    return cell.cast("int")


def _offsets(radius: int) -> list[tuple[int, ...]]:
    """The cells within the radius that come after a cell, besides itself: one of each pair of opposites."""
    return [d for d in product(range(-radius, radius + 1), repeat=PARTS) if sum(map(abs, d)) <= radius and d > (0,) * PARTS]


def _near_forest(radius: int):
    """Arrow function: pairs of tiles to the edges of a spanning forest of their links."""

    def run(batches):
        for batch in batches:
            src, dst = [], []
            a_fp, a_id, b_fp, b_id = (batch.column(k) for k in range(4))
            for k in range(batch.num_rows):
                fa, ia = a_fp[k].values.to_numpy(zero_copy_only=False).view(np.uint64), a_id[k].values.to_numpy(zero_copy_only=False)
                same = not b_fp[k].is_valid
                fb, ib = (fa, ia) if same else (b_fp[k].values.to_numpy(zero_copy_only=False).view(np.uint64), b_id[k].values.to_numpy(zero_copy_only=False))
                ids, cut = (ia, 0) if same else (np.concatenate([ia, ib]), len(ia))
                forest = Forest(len(ids))
                for at in range(0, len(fa), 64):  # the matrix of a step stays within a few MB
                    i, j = np.nonzero(np.bitwise_count(fa[at : at + 64, None] ^ fb[None, :]) <= radius)
                    forest.add(i + at, j + cut)
                child, root = forest.edges(ids)
                src.append(child)
                dst.append(root)
            edges = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (src, dst)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in edges], names=["src", "dst"])

    return run


def near_edges(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (src, dst) between the ids of distinct fingerprints (fp, rep) that connect what links within radius.

    Fingerprints at most `radius` bits apart have cells (population counts of four parts) at most `radius`
    apart, so only tiles of such cells are compared, each pair once and in full. Cells number 17^4 at most,
    which bounds what is broadcast of them.
    """
    celled = nodes.where(F.col("rep").isNotNull()).withColumn("cell", _cell())
    sizes = materialize(celled.groupBy("cell").agg(F.count("*").alias("cell_rows")), "cells")
    placed = celled.join(F.broadcast(sizes), "cell").withColumn("tile", tile_no("cell_rows", "fp"))
    tiles = materialize(pack(placed, ["cell", "tile"], ["fp", "rep"]), "tiles")

    own = tiles.select(F.col("fp").alias("a_fp"), F.col("rep").alias("a_id"), F.lit(None).cast("array<long>").alias("b_fp"), F.lit(None).cast("array<long>").alias("b_id"))
    own = own.where(F.size("a_fp") > 1)
    other = tiles.select(F.col("cell").alias("b_cell"), F.col("tile").alias("b_tile"), F.col("fp").alias("b_fp"), F.col("rep").alias("b_id"))
    # Neighbouring cells: digits of the cell number must stay within their range.
    digits = [F.floor(F.col("cell") / _SIDE ** (PARTS - 1 - k)) % _SIDE for k in range(PARTS)]
    steps = F.explode(F.array(*(F.struct(*(F.lit(x).alias(f"d{k}") for k, x in enumerate(d))) for d in [(0,) * PARTS, *_offsets(radius)])))
    inside = F.lit(True)
    b_cell = F.lit(0)
    for k in range(PARTS):
        digit = digits[k] + F.col(f"step.d{k}")
        inside = inside & digit.between(0, _SIDE - 1)
        b_cell = b_cell * _SIDE + digit
    known = sizes.select(F.col("cell").alias("b_cell"), F.ceil(F.col("cell_rows") / 1).alias("b_rows"))
    wanted = (
        tiles.select("cell", "tile").withColumn("step", steps).where(inside).withColumn("b_cell", b_cell.cast("int"))
        .join(F.broadcast(known), "b_cell").select("cell", "tile", "b_cell")
    )
    wanted = wanted.join(other.select("b_cell", "b_tile"), "b_cell").where((F.col("cell") != F.col("b_cell")) | (F.col("tile") < F.col("b_tile")))
    pairs = (
        wanted.join(tiles.select("cell", "tile", F.col("fp").alias("a_fp"), F.col("rep").alias("a_id")), ["cell", "tile"])
        .join(other, ["b_cell", "b_tile"]).select("a_fp", "a_id", "b_fp", "b_id")
    )
    run = _near_forest(radius)
    return own.unionByName(pairs).mapInArrow(run, "src long, dst long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(id, fp, component_id) for every row of docs.

    component_id is the smallest id reachable over links of `radius` or fewer differing bits, itself included.
    Texts that are null or hold no word have fingerprint 0 and link with each other like any other; a row
    without id keeps a fingerprint and gets the component of its fingerprint (null where no row of it has an
    id). Repeated rows are rows of their own; extra columns are not read; an empty table gives an empty one.
    """
    prints = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("n_rows")), "nodes")
    roots = connected_components(near_edges(nodes, radius)).select(F.col("node").alias("rep"), "component")
    classes = nodes.join(roots, "rep", "left").select("fp", "n_rows", F.coalesce("component", "rep").alias("component_id"))
    classes = materialize(classes, "classes")
    return join_groups(prints, classes, ["fp"], "n_rows", "id").select("id", "fp", "component_id")


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
