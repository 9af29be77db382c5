"""Embedding near-dedup with spherical-cap filters from structured random product codes."""

from __future__ import annotations

from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.operators.components import connected_components, local_forest
from inkwell.operators.skew import join_groups
from inkwell.storage import materialize

from .tiles import pack, tile_no

COSINE = 0.93
#: Filters that a vector of uniform direction exceeds on average, and the fewest that any vector takes.
FILTERS, LEAST_FILTERS = 6, 6
#: Pairs at the threshold itself that may share no filter, and the pairs made from a seed that tell so.
MISSED, TRIAL_PAIRS = 0.01, 2000
#: Code words of a half, and the rows of the largest label that a group (the filters of one first word) should hold.
LEAST_WORDS, MOST_WORDS, GROUP = 16, 4096, 16_384
#: Rows of a group that are compared in one task; a larger one is cut into its filters, and these into tiles.
GROUP_ROWS, TILE_ROWS = 65_536, 8_192
#: Rows decoded at a time, and rows of a block of cosines.
_SLICE, _BLOCK = 256, 1024
#: Best words of a half that are looked at first when filters are listed.
_BEST = 96
SEED = 20


def codebook(dim: int, words: int, seed: int = SEED) -> np.ndarray:
    """`words` unit vectors of a block: rows of random orthogonal matrices and their negatives."""
    rng, rows = np.random.default_rng([seed, dim, words]), []
    while sum(map(len, rows)) < words:
        q = np.linalg.qr(rng.standard_normal((max(dim, 1), max(dim, 1))))[0]
        rows += [q, -q]
    return np.concatenate(rows)[:words]


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision; the largest component first, so squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _ranked(scores: np.ndarray, most: int) -> np.ndarray:
    """The places of the `most` best scores of each row, best first."""
    if most < scores.shape[1]:
        some = np.argpartition(-scores, most, axis=1)[:, :most]
        return np.take_along_axis(some, np.argsort(-np.take_along_axis(scores, some, axis=1), axis=1, kind="stable"), axis=1)
    return np.argsort(-scores, axis=1, kind="stable")


def list_decode(unit: np.ndarray, books: list[np.ndarray], bar: float, least: int = LEAST_FILTERS) -> list[np.ndarray]:
    """For each unit vector the sorted numbers of the product filters whose direction it exceeds by the bar.

    A filter's direction is a code word of the first half followed by one of the second, over sqrt 2. The best
    words of both halves are ranked once a vector, so each first word takes a prefix of the second ones; where
    a word that was not ranked could still exceed the bar, all are. A vector with fewer than `least` such
    filters takes its best ones. Vectors are decoded in slices, which bounds the memory at any number of words.
    """
    half, words, out = unit.shape[1] // 2, len(books[1]), []
    least, need = min(least, words * words), bar * np.sqrt(2)
    for lo in range(0, len(unit), _SLICE):
        some = unit[lo : lo + _SLICE]
        first, second = some[:, :half] @ books[0].T, some[:, half:] @ books[1].T
        best = max(_BEST, least)
        at_a, at_b = _ranked(first, best), _ranked(second, best)
        for k in range(len(some)):
            oa, ob = at_a[k], at_b[k]
            a, b = first[k, oa], second[k, ob]
            if len(oa) < words and (a[-1] + b[0] >= need or a[0] + b[-1] >= need):
                oa, ob = np.argsort(-first[k], kind="stable"), np.argsort(-second[k], kind="stable")
                a, b = first[k, oa], second[k, ob]
            strong = int(np.searchsorted(-a, b[0] - need, side="right"))
            takes = np.searchsorted(-b, a[:strong] - need, side="right")
            if takes.sum() < least:
                n = min(least, words)
                sums = a[:n, None] + b[None, :n]
                top = np.argsort(-sums, axis=None, kind="stable")[:least]
                found = oa[top // n] * words + ob[top % n]
            else:
                found = np.concatenate([i * words + ob[:n] for i, n in zip(oa[:strong].tolist(), takes.tolist())])
            out.append(np.sort(found).astype(np.int32))
    return out


def _bar(dim: int, words: int) -> float:
    return NormalDist().inv_cdf(1 - min(0.5, FILTERS / words**2)) / np.sqrt(dim)


def _books(dim: int, words: int) -> list[np.ndarray]:
    return [codebook(dim // 2, words), codebook(dim - dim // 2, words, SEED + 1)]


def trial_pairs(dim: int, cosine: float, pairs: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of uniform direction and for each another one at exactly the cosine."""
    rng = np.random.default_rng([seed, dim])
    x = _unit(rng.standard_normal((pairs, dim)))
    y = rng.standard_normal((pairs, dim))
    y = _unit(y - (x * y).sum(axis=1, keepdims=True) * x)
    return x, cosine * x + np.sqrt(max(1 - cosine**2, 0.0)) * y


def miss_share(dim: int, words: int, least: int, cosine: float = COSINE, pairs: int = TRIAL_PAIRS, seed: int = SEED) -> float:
    """The share of pairs at the cosine that have no filter in common."""
    books, bar = _books(dim, words), _bar(dim, words)
    a, b = (list_decode(x, books, bar, least) for x in trial_pairs(dim, cosine, pairs, seed))
    return float(np.mean([not np.intersect1d(x, y, assume_unique=True).size for x, y in zip(a, b)]))


@lru_cache(maxsize=256)
def least_filters(dim: int, words: int, cosine: float = COSINE) -> int:
    """The fewest filters a vector must take, LEAST_FILTERS or more, so that at most MISSED of the pairs at the cosine share none.

    The bar rises with the number of words and leaves most vectors with their best filters alone, so it is
    these that must grow with it for recall to be the same at every size.
    """
    if dim < 2:
        return 1
    least = LEAST_FILTERS
    while least < words**2 and miss_share(dim, words, least, cosine) > MISSED:
        least += max(least // 4, 1)
    return min(least, words**2)


def words_for(rows: int) -> int:
    """Code words of a half for a label of so many vectors: the fewest that keep its groups about GROUP rows."""
    words = LEAST_WORDS
    while words < MOST_WORDS and rows * 4 > GROUP * words:  # a vector's filters have some four first words
        words *= 2
    return words


def _decode(words: int, threshold: float, least: dict[int, int], kind: type):
    """Arrow function: classes of equal vectors with their filters and their vector as bytes."""

    def run(batches):
        books: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            vec = batch.column("vec")
            values, starts = vec.values.to_numpy(zero_copy_only=False), vec.offsets.to_numpy()
            sizes = np.diff(starts)
            fids, raw = [None] * len(sizes), [b""] * len(sizes)
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                own = values[starts[at][:, None] + np.arange(dim)].astype(kind)
                if dim not in books:
                    books[dim] = _books(dim, words) if dim > 1 else []
                found = list_decode(_unit(own.astype(np.float64)), books[dim], _bar(dim, words), least.get(dim) or least_filters(dim, words, threshold)) if dim > 1 else [np.zeros(1, np.int32)] * len(at)
                for k, f, x in zip(at.tolist(), found, own):
                    fids[k], raw[k] = f, x.tobytes()
            made = [pa.array(sizes.astype(np.int32)), pa.array(fids, pa.list_(pa.int32())), pa.array(raw, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in _CLASS] + made, names=[*_CLASS, "dim", "fids", "vec"])

    return run


_CLASS = ["label", "h1", "h2", "rep", "n_rows"]


class _Rows:
    """Vectors of a group or tile: unit vectors, ids, rows of their classes, and their filters."""

    def __init__(self, got: dict, side: str, kind: type):
        vec, fids = got[f"{side}vec"].values, got[f"{side}fids"].values
        self.ids, self.n = (got[f"{side}{c}"].values.to_numpy(zero_copy_only=False) for c in ("rep", "n_rows"))
        self.x = _unit(np.frombuffer(b"".join(v.as_py() for v in vec), kind).reshape(len(vec), -1).astype(np.float64))
        self.ends, self.flat = fids.offsets.to_numpy(), fids.values.to_numpy(zero_copy_only=False)

    def fids(self, k: int) -> np.ndarray:
        return self.flat[self.ends[k] : self.ends[k + 1]]


def _earlier(fids: list[np.ndarray], cut: int, fid: int) -> np.ndarray:
    """Whether a row of the first `cut` and one of the rest share a filter before this one, which then counts their link."""
    own = [f[: np.searchsorted(f, fid)] for f in fids]
    rows = np.repeat(np.arange(len(own)), [len(f) for f in own])
    names, where = np.unique(np.concatenate([*own, np.empty(0, np.int32)]), return_inverse=True)
    held = np.zeros((len(own), len(names)), np.float32)
    held[rows, where] = 1
    return held[:cut] @ held[cut:].T > 0


class _Links:
    """What comparisons find: (id, smallest id of its local component, links) a row."""

    def __init__(self, threshold: float):
        self.threshold, self.node, self.peer, self.links = threshold, [], [], []

    def compare(self, a: _Rows, at_a: np.ndarray, b: _Rows, at_b: np.ndarray, fid: int) -> None:
        """Rows of one filter, all pairs in blocks; the same rows on both sides are compared once."""
        same = a is b and at_a is at_b
        for lo in range(0, len(at_a), _BLOCK):
            for hi in range(lo if same else 0, len(at_b), _BLOCK):
                p, q = at_a[lo : lo + _BLOCK], at_b[hi : hi + _BLOCK]
                near = a.x[p] @ b.x[q].T >= self.threshold
                if same and lo == hi:
                    near &= np.tri(len(p), k=-1, dtype=bool).T
                i, j = np.nonzero(near)
                if len(i):
                    self._add(a, p[i], b, q[j], fid)

    def _add(self, a: _Rows, i: np.ndarray, b: _Rows, j: np.ndarray, fid: int) -> None:
        rows_i, rows_j = np.unique(i), np.unique(j)
        seen = _earlier([a.fids(k) for k in rows_i.tolist()] + [b.fids(k) for k in rows_j.tolist()], len(rows_i), fid)
        new = ~seen[np.searchsorted(rows_i, i), np.searchsorted(rows_j, j)]
        i, j = i[new], j[new]
        ids, where = np.unique(np.concatenate([a.ids[i], b.ids[j]]), return_inverse=True)
        src, dst = where[: len(i)], where[len(i) :]
        degree = np.bincount(src, b.n[j], len(ids)) + np.bincount(dst, a.n[i], len(ids))
        self.node.append(ids)
        self.peer.append(ids[local_forest(len(ids), src, dst)])
        self.links.append(degree.astype(np.int64))

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([*x, np.empty(0, np.int64)])) for x in (self.node, self.peer, self.links)], names=["id", "other", "links"])


def _verify_groups(words: int, threshold: float, kind: type):
    """Arrow function: groups, of which each filter's rows are compared; links are counted in the first filter of both rows."""

    def run(batches):
        for batch in batches:
            links = _Links(threshold)
            for k in range(batch.num_rows):
                got = {c: batch.column(c)[k] for c in batch.schema.names}
                rows, first = _Rows(got, "", kind), got["first"].as_py()
                row = np.repeat(np.arange(len(rows.ids)), np.diff(rows.ends))
                flat = rows.flat[rows.ends[0] : rows.ends[-1]]
                here = flat // words == first
                row, fid = row[here], flat[here]
                order = np.lexsort((row, fid))
                row, fid = row[order], fid[order]
                cuts = np.flatnonzero(np.diff(fid)) + 1
                for at, f in zip(np.split(row, cuts), fid[np.concatenate([[0], cuts])].tolist()):
                    if len(at) > 1:
                        links.compare(rows, at, rows, at, f)
            yield links.batch()

    return run


def _verify_tiles(threshold: float, kind: type):
    """Arrow function: tiles of one filter, alone or in pairs."""

    def run(batches):
        for batch in batches:
            links = _Links(threshold)
            for k in range(batch.num_rows):
                got = {c: batch.column(c)[k] for c in batch.schema.names}
                a = _Rows(got, "a_", kind)
                at = np.arange(len(a.ids))
                if got["b_rep"].is_valid:
                    b = _Rows(got, "b_", kind)
                    links.compare(a, at, b, np.arange(len(b.ids)), got["fid"].as_py())
                else:
                    links.compare(a, at, a, at, got["fid"].as_py())
            yield links.batch()

    return run


_ITEMS = ["rep", "n_rows", "fids", "vec"]
_LINKS = "id long, other long, links long"


def _tile_links(rows: DataFrame, verify) -> DataFrame:
    """Links within the filters of rows (label, dim, fid and _ITEMS), by tiles of a filter and all pairs of its tiles."""
    bucket = ["label", "dim", "fid"]
    sizes = materialize(rows.groupBy(*bucket).agg(F.count("*").alias("bucket_rows")).where("bucket_rows > 1"), "buckets")
    placed = join_groups(rows, sizes, bucket, "bucket_rows", "rep")
    placed = placed.withColumn("tile", tile_no("bucket_rows", "rep", TILE_ROWS)).withColumn("tiles", F.ceil(F.col("bucket_rows") / TILE_ROWS).cast("int"))
    tiles = materialize(pack(placed, [*bucket, "tiles", "tile"], _ITEMS), "tiles")
    side = lambda s: [F.col(c).alias(f"{s}_{c}") for c in _ITEMS]
    none = [F.lit(None).cast(dict(tiles.dtypes)[c]).alias(f"b_{c}") for c in _ITEMS]
    own = tiles.where(F.size("rep") > 1).select("dim", "fid", *side("a"), *none)
    many = tiles.where("tiles > 1")
    ahead = F.explode(F.expr("filter(sequence(0, tiles - 1), t -> t > tile)")).alias("tile")
    pairs = many.select(*bucket, ahead, *side("a")).join(many.select(*bucket, "tile", *side("b")).hint("merge"), [*bucket, "tile"])
    return own.unionByName(pairs.select(*own.columns)).mapInArrow(verify, _LINKS)


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = COSINE, words: int | None = None) -> DataFrame:
    """(id, n_links, component_id) for every row: vectors of one label link at a cosine of threshold or more.

    Equal vectors of a label (by 128 bits of hash) are one class; classes meet in the spherical-cap filters that
    both exceed, each pair is verified by its cosine in double precision and counted in the first filter that
    both share. A class is sent once for each first word of its filters, and the filters of that word are
    compared together; a group of more than GROUP_ROWS is cut into its filters and these into tiles, which are
    compared whole. The number of words follows the largest label (or is given), and with it the filters a
    vector takes, so that misses at the threshold stay at MISSED whatever the size.
    Vectors that are null, empty, zero or hold null or non-finite components, and rows of null label or id, link
    with nothing (n_links 0, own component); so do vectors of different lengths. Repeated rows link as equal
    vectors. An empty table gives an empty one; extra columns are not read.
    """
    single = dict(vectors.dtypes)[vec_col] == "array<float>"
    kind, cast = (np.float32, "array<float>") if single else (np.float64, "array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast(cast).alias("raw"))
    finite = F.forall("raw", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    sound = F.col("label").isNotNull() & F.col("raw").isNotNull() & finite & F.exists("raw", lambda x: x != 0)
    good = F.coalesce(sound, F.lit(False)) & F.col("id").isNotNull()
    # Adding zero makes one of the two zeros; the hashes stand for the vector.
    zero = F.lit(0.0).cast("float" if single else "double")
    keyed = rows.where(good).select("id", "label", F.transform("raw", lambda x: x + zero).alias("vec"))
    keyed = keyed.select("id", "label", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(7), "vec").alias("h2"), "vec")
    key = ["label", "h1", "h2"]
    if words is None:
        words = words_for(keyed.groupBy("label").agg(F.approx_count_distinct("h1").alias("n")).agg(F.max("n")).first()[0] or 0)
    classes = keyed.groupBy(*key).agg(F.min("id").alias("rep"), F.count("*").alias("n_rows"), F.first("vec").alias("vec"))
    # Filters a vector by its length, for the commonest lengths; a task finds out the others by itself.
    dims = [r[0] for r in keyed.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count")).limit(16).collect()]
    decode = _decode(words, threshold, {dim: least_filters(dim, words, threshold) for dim in dims}, kind)
    decoded = classes.select(*_CLASS, "vec").mapInArrow(decode, f"label {dict(rows.dtypes)['label']}, h1 long, h2 long, rep long, n_rows long, dim int, fids array<int>, vec binary")
    decoded = materialize(decoded, "filters")
    group = ["label", "dim", "first"]
    firsts = F.explode(F.array_distinct(F.transform("fids", lambda f: F.floor(f / words).cast("int"))))
    sizes = decoded.select("label", "dim", firsts.alias("first")).groupBy(*group).agg(F.count("*").alias("group_rows"))
    hot = materialize(sizes.where(F.col("group_rows") > GROUP_ROWS).select(*group, F.lit(True).alias("hot")), "hot-groups")
    spread = decoded.select("label", "dim", firsts.alias("first"), *_ITEMS)
    if hot.isEmpty():
        cold, links = spread, None
    else:
        tagged = spread.join(hot, group, "left")
        cold = tagged.where("hot is null")
        fid = F.explode(F.filter("fids", lambda f: F.floor(f / words) == F.col("first")))
        links = _tile_links(tagged.where("hot").select("label", "dim", fid.alias("fid"), *_ITEMS), _verify_tiles(threshold, kind))
    found = pack(cold, group, _ITEMS).where(F.size("rep") > 1).mapInArrow(_verify_groups(words, threshold, kind), _LINKS)
    links = materialize(found if links is None else found.unionByName(links), "links")
    counts = links.groupBy(F.col("id").alias("rep")).agg(F.sum("links").alias("links"))
    roots = connected_components(links.select(F.col("id").alias("src"), F.col("other").alias("dst"))).select(F.col("node").alias("rep"), "component")
    known = decoded.select(*_CLASS).join(counts, "rep", "left").join(roots, "rep", "left").select(
        *key, "n_rows", (F.coalesce("links", F.lit(0)) + F.col("n_rows") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )
    linked = join_groups(keyed.drop("vec"), materialize(known, "classes"), key, "n_rows", "id").select("id", "n_links", "component_id")
    alone = rows.where(~good).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone)


def op4_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    found = near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


OP4_SQL = """
WITH v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e, label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok
  FROM embeddings),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE a.ok AND b.ok AND list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (
  WITH RECURSIVE reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a)
  SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id) AS n_links, r.component_id, v.vec_id = r.component_id AS kept
FROM v JOIN r ON r.a = v.vec_id
"""
