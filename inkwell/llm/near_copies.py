"""Near copies by the Jaccard similarity of word shingles: wide SimHash candidates, tile by tile, and an exact check."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.operators.components import connected_components
from inkwell.operators.skew import join_groups
from inkwell.storage import materialize

from .tiles import Forest, pack, tile_no

SHINGLE_WORDS = 5
SIMILARITY = 0.8
SEED = 42
#: Words of 64 bits of a fingerprint, and the differing bits of a candidate. Two sets of Jaccard 0.8 differ in a
#: bit with a chance of 0.15, and of 0.1875 at most (4 shingles of 5): 48 bits of 256 on average with a deviation
#: of 6.2, so the radius is 3.8 deviations above it and misses about 1 such pair in 10,000.
LANES, RADIUS = 4, 72
#: Fingerprints of a tile, and shingle sets of one.
TILE_ROWS, SET_ROWS = 16_384, 256
#: Sizes of sets fall into steps of this ratio; similar sets are at most STEPS apart.
STEPS = 4
_RATIO = (1 / SIMILARITY + 1e-4) ** (1 / STEPS)
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingle_set(text: bytes, k: int = SHINGLE_WORDS) -> np.ndarray:
    """The sorted distinct hashes of a UTF-8 text's shingles; of the whole text if it has fewer words, empty if none."""
    words = _WORD.findall(text.lower())  # bytes.lower() changes A-Z only
    if not words:
        return np.empty(0, np.uint64)
    line, sizes = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: max(len(words) - k + 1, 1)].tolist()
    shingles = map(line.__getitem__, map(slice, starts, ends[min(k, len(words)) - 1 :].tolist()))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, len(starts)))


def wide_print(hashes: np.ndarray) -> np.ndarray:
    """LANES words of the SimHash of a set of hashes, each of which is mixed anew for every word."""
    n, out = len(hashes), np.empty(LANES, np.uint64)
    for lane in range(LANES):
        z = hashes + np.uint64((lane + 1) * 0x9E3779B97F4A7C15 & 2**64 - 1)
        z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        bits = np.unpackbits((z ^ z >> np.uint64(31)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = n // 255 * 255
        ones = bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64) + bits[whole:].sum(axis=0, dtype=np.int64)
        out[lane] = np.packbits(2 * ones > n, bitorder="little").view("<u8")[0]
    return out


def _key(hashes: np.ndarray) -> int:
    return int(hashes.sum(dtype=np.uint64).view(np.int64)) if len(hashes) else 0


def prints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, row, key, n, fp) of every row: the sum of its set's hashes and their number tell equal sets; fp is its wide print.

    row is the hash of the text, which tells apart the rows that share an id or have none.
    """

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t.as_py() or b"") for t in batch.column(2)]
            made = [pa.array([_key(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([wide_print(s).tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["id", "row", "key", "n", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("row"), F.col(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(run, "id long, row long, key long, n long, fp binary")


def _edges(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """The edges (src, dst) of spanning forests."""
    none = np.empty(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *x])) for x in ([f[0] for f in found], [f[1] for f in found])], names=["src", "dst"])


def _near(batches):
    """Arrow function: pairs of tiles to the edges of a spanning forest of the prints within RADIUS."""
    for batch in batches:
        found = []
        for k in range(batch.num_rows):
            got = {c: batch.column(c)[k] for c in batch.schema.names}
            read = lambda s, got=got: (np.frombuffer(b"".join(x.as_py() for x in got[f"{s}_fp"]), np.uint64).reshape(-1, LANES).T.copy(), got[f"{s}_rep"].values.to_numpy(zero_copy_only=False))
            fa, ia = read("a")
            same = not got["b_rep"].is_valid
            fb, ib = (fa, ia) if same else read("b")
            ids, cut = (ia, 0) if same else (np.concatenate([ia, ib]), len(ia))
            forest = Forest(len(ids))
            for at in range(0, len(ia), 64):  # the matrices of a step stay within a few MB
                bits = np.zeros((len(ia[at : at + 64]), len(ib)), np.uint16)
                for lane in range(LANES):
                    bits += np.bitwise_count(fa[lane, at : at + 64, None] ^ fb[lane][None])
                i, j = np.nonzero(bits <= RADIUS)
                forest.add(i + at, j + cut)
            found.append(forest.edges(ids))
        yield _edges(found)


def _similar(similarity: float):
    """Arrow function: pairs of tiles of sets to the edges of a spanning forest of those at least so similar."""

    def run(batches):
        for batch in batches:
            found = []
            for k in range(batch.num_rows):
                got = {c: batch.column(c)[k] for c in batch.schema.names}
                read = lambda s, got=got: ([np.frombuffer(x.as_py(), np.uint64) for x in got[f"{s}_set"]], got[f"{s}_rep"].values.to_numpy(zero_copy_only=False))
                sets, ids = read("a")
                cut = len(sets)
                same = not got["b_rep"].is_valid
                if not same:
                    more, others = read("b")
                    sets, ids = sets + more, np.concatenate([ids, others])
                sizes, forest = np.array([len(s) for s in sets]), Forest(len(sets))
                for x in range(cut):
                    y = np.arange(x + 1, len(sets)) if same else np.arange(cut, len(sets))
                    least, most = np.minimum(sizes[x], sizes[y]), np.maximum(sizes[x], sizes[y])
                    for z in y[least >= similarity * most - 1e-9].tolist():
                        if forest.label[x] == forest.label[z]:  # linked already, if by others: no more to learn
                            continue
                        inter = len(np.intersect1d(sets[x], sets[z], assume_unique=True))
                        if inter >= similarity * (sizes[x] + sizes[z] - inter) - 1e-9:
                            forest.add(np.array([x]), np.array([z]))
                found.append(forest.edges(ids))
            yield _edges(found)

    return run


def _sides(tiles: DataFrame, items: list[str], pairs: DataFrame) -> DataFrame:
    """Tiles of more than one row with no partner, and the pairs of tiles."""
    none = [F.lit(None).cast(dict(tiles.dtypes)[c]).alias(f"b_{c}") for c in items]
    own = tiles.where(F.size("rep") > 1).select(*(F.col(c).alias(f"a_{c}") for c in items), *none)
    return own.unionByName(pairs.select(*own.columns))


def candidate_edges(nodes: DataFrame) -> DataFrame:
    """Edges (src, dst) that connect the ids of distinct sets (rep, n, fp) whose prints link within RADIUS.

    Sets of the wanted similarity have sizes within its ratio, so only tiles of such sizes are compared, each
    pair once and in full. Steps of size number under 300 for sets of any length, which bounds what is broadcast.
    """
    step = F.floor(F.log(F.col("n").cast("double")) / math.log(_RATIO)).cast("int")
    stepped = nodes.where("rep is not null and n > 0").withColumn("step", step)
    sizes = materialize(stepped.groupBy("step").agg(F.count("*").alias("step_rows")), "steps")
    placed = stepped.join(F.broadcast(sizes), "step").withColumn("tile", tile_no("step_rows", "rep", TILE_ROWS))
    items = ["fp", "rep"]
    tiles = materialize(pack(placed, ["step", "tile"], items), "tiles")
    side = lambda s: tiles.select(F.col("step").alias(f"{s}_step"), F.col("tile").alias(f"{s}_tile"), *(F.col(c).alias(f"{s}_{c}") for c in items))
    known = sizes.select(F.col("step").alias("b_step"), F.ceil(F.col("step_rows") / TILE_ROWS).cast("int").alias("b_tiles"))
    wanted = tiles.select(F.col("step").alias("a_step"), F.col("tile").alias("a_tile"), F.explode(F.sequence(F.col("step"), F.col("step") + STEPS)).alias("b_step")).join(F.broadcast(known), "b_step")
    wanted = wanted.select("a_step", "a_tile", "b_step", F.explode(F.sequence(F.lit(0), F.col("b_tiles") - 1)).alias("b_tile")).where("b_step > a_step or b_tile > a_tile")
    pairs = wanted.join(side("a").hint("merge"), ["a_step", "a_tile"]).join(side("b").hint("merge"), ["b_step", "b_tile"])
    return _sides(tiles, items, pairs).mapInArrow(_near, "src long, dst long")


def similar_edges(docs: DataFrame, members: DataFrame, id_col: str, text_col: str, similarity: float) -> DataFrame:
    """Edges (src, dst) that connect the ids of members (rep, key, n, bucket) whose sets are at least so similar.

    Sets are made again from the texts of the members alone and compared within their bucket, exactly.
    """

    def sets(batches):
        for batch in batches:
            made = [shingle_set(t.as_py() or b"") for t in batch.column(4)]
            keys, sizes = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            # An id may stand on rows of other texts: those are not the member.
            good = pa.array([_key(s) == key and len(s) == n for s, key, n in zip(made, keys, sizes)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array([s.tobytes() for s in made], pa.binary())], names=["rep", "bucket", "set"]).filter(good)

    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).cast("binary").alias("t"))
    rows = members.join(texts.hint("merge"), "rep").select("rep", "key", "n", "bucket", "t").mapInArrow(sets, "rep long, bucket long, set binary")
    rows = materialize(rows.dropDuplicates(["rep", "bucket"]), "sets")
    counts = materialize(rows.groupBy("bucket").agg(F.count("*").alias("bucket_rows")), "buckets")
    placed = join_groups(rows, counts, ["bucket"], "bucket_rows", "rep").withColumn("tile", tile_no("bucket_rows", "rep", SET_ROWS)).withColumn("tiles", F.ceil(F.col("bucket_rows") / SET_ROWS).cast("int"))
    items = ["rep", "set"]
    tiles = materialize(pack(placed, ["bucket", "tiles", "tile"], items), "set-tiles")
    many = tiles.where("tiles > 1")
    ahead = F.explode(F.expr("filter(sequence(0, tiles - 1), t -> t > tile)")).alias("tile")
    pairs = many.select("bucket", ahead, *(F.col(c).alias(f"a_{c}") for c in items)).join(many.select("bucket", "tile", *(F.col(c).alias(f"b_{c}") for c in items)), ["bucket", "tile"])
    return _sides(tiles, items, pairs).mapInArrow(_similar(similarity), "src long, dst long")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, component_id) for every row of docs: the smallest id reachable over links of Jaccard SIMILARITY or more.

    Texts of equal shingle sets are one class; so are those that are null or hold no word. Prints find the
    candidates, whose components are then compared set by set, so every link is exact and only a pair whose
    prints are farther apart than RADIUS can be missed. A row without id gets the component of its set (null
    where no row of it has an id). Rows that share an id are judged by their own text, whose hash is `row`.
    Repeated rows are rows of their own; an empty table gives an empty one; extra columns are not read.
    """
    rows = materialize(prints(docs, id_col, text_col), "prints")
    nodes = materialize(rows.groupBy("key", "n").agg(F.min("id").alias("rep"), F.first("fp").alias("fp"), F.count("*").alias("n_rows")), "nodes")
    bucket = connected_components(candidate_edges(nodes)).select(F.col("node").alias("rep"), F.col("component").alias("bucket"))
    members = materialize(nodes.select("rep", "key", "n").join(bucket, "rep"), "members")
    roots = connected_components(similar_edges(docs, members, id_col, text_col, SIMILARITY)).select(F.col("node").alias("rep"), "component")
    classes = nodes.join(roots, "rep", "left").select("key", "n", "n_rows", F.coalesce("component", "rep").alias("component_id"))
    return join_groups(rows, materialize(classes, "classes"), ["key", "n"], "n_rows", "row").select("id", "row", "component_id")
