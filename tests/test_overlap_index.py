"""The kept overlap index against plain loops, and what a request takes."""

import glob
import random
import re
import zlib
from collections import defaultdict

from inkwell.operators import budgets, overlap
from inkwell.operators import overlap_index as ix

MASK = (1 << 64) - 1


def plain_hashes(text):
    """(position, hash) of the sampled grams, word by word."""
    codes = [zlib.crc32(w.encode()) for w in re.findall(r"[a-z0-9']+", text.lower())]
    out = []
    for i in range(len(codes) - 7):
        h = 0
        for c in codes[i : i + 8]:
            h = (h * ix.ROLL + c) & MASK
        h ^= h >> 29
        h = (h * ix.MIX) & MASK
        h ^= h >> 32
        if h % 4 == 0:
            out.append((i, h))
    return out


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def test_hashes_equal_a_plain_loop(spark):
    rnd = random.Random(3)
    words = ["a", "don't", "Ünder", "x1", "naïve", "THE", "b-c", "the", "ok.", "27", "'"]
    texts = [" ".join(rnd.choices(words, k=rnd.choice([0, 1, 7, 8, 9, 40, 120]))) for _ in range(1000)] + [None, "", "a " * 50_000]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = sorted((r.id, r.pos, r.gram) for r in ix.hashed_grams(rows, "doc_id", "text").collect())
    assert got == sorted((k, i, signed(h)) for k, t in enumerate(texts) for i, h in plain_hashes(t or ""))
    assert ix.hashed_grams(rows.limit(0), "doc_id", "text").count() == 0


def test_kept_index_is_looked_up_in_few_files_grown_and_compacted(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first, second, path, packed = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"), str(tmp_path / "index"), str(tmp_path / "packed")
    ix.write(ix.entries(first), path, 16)
    before = set(glob.glob(f"{path}/grams/part=*/*.parquet"))
    ix.add(ix.entries(second), path)
    ix.add(ix.entries(second.limit(5)), path)  # texts that are there already
    assert before < set(glob.glob(f"{path}/grams/part=*/*.parquet"))
    ix.compact(spark, path, packed)
    expected = defaultdict(set)
    for r in docs.collect():
        for _, h in plain_hashes(r.text or ""):
            expected[signed(h)].add(r.doc_id)
    every = sorted((g, c) for g, held in expected.items() for c in held)
    assert sorted(map(tuple, ix.read(spark, path).distinct().collect())) == every == sorted(map(tuple, ix.read(spark, packed).collect()))
    wanted = sorted(expected)[:3]
    for place in (path, packed):
        found = ix.lookup(spark, place, spark.createDataFrame([(g,) for g in [*wanted, 12345]], "gram long"))
        assert sorted(map(tuple, found.collect())) == sorted((g, c) for g in wanted for c in expected[g])
        met = {((g & MASK) >> 60) for g in [*wanted, 12345]}
        assert len(met) < 4
        read = found.select("chunk").inputFiles()
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [part" in plan and read
    # Each range is one sorted run after compacting: the row groups of a range don't overlap.
    for folder in glob.glob(f"{packed}/grams/part=*"):
        import pyarrow.parquet as pq

        spans = sorted((s.min, s.max) for f in glob.glob(f"{folder}/*.parquet") for m in [pq.read_metadata(f)] for g in range(m.num_row_groups) for s in [m.row_group(g).column(0).statistics])
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_overlap_by_the_kept_index(spark, sf_dir, tmp_path):
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), str(tmp_path / "index")
    one = next(r for r in docs.collect() if len(plain_hashes(r.text or "")) > 20)
    asked = spark.createDataFrame([(1, one.text), (2, "nothing of this kind stands in any text that was ever kept there before"), (3, "short"), (4, None)], "id long, text string")
    ix.write(ix.entries(docs), path, 4)
    index = ix.lookup(spark, path, ix.hashed_grams(asked, "id", "text"))
    got = {r.id: r for r in overlap.overlap(index, asked, "id", "text", sample=ix.hashed_grams).collect()}
    n = len(plain_hashes(one.text))
    assert (got[1].positions, got[1].hits, got[1].percent) == (n, n, 100.0)
    assert got[2].percent == got[3].percent == got[4].percent == 0.0 and got[3].positions == got[4].positions == 0
    best = {r.chunk: r for r in overlap.top_sources(index, asked, "id", "text", sample=ix.hashed_grams).where("id = 1").collect()}
    assert max(r.percent for r in best.values()) == 100.0 and len(best) <= 5


def test_portfolios_keep_their_first_works_and_must_fit(spark):
    works = [("a", k, "x" * 10) for k in range(40)] + [("b", k, "y" * 30) for k in range(5)] + [("c", 1, None), ("c", 2, ""), (None, 1, "z")]
    rows = spark.createDataFrame(works, "owner string, k long, text string").repartition(5)
    got = {r.owner: tuple(r)[1:] for r in budgets.portfolios(rows, "owner", "k", "text", 3, 20, 50).collect()}
    assert got == {"a": (40, 3, 30, True), "b": (5, 3, 60, False), "c": (2, 2, 0, False)}
    used = budgets.first_works(rows, "owner", "k", "text", 3, 20)
    assert sorted((r.owner, r.k, len(r.text or "")) for r in used.collect()) == [("a", 0, 10), ("a", 1, 10), ("a", 2, 10), ("b", 0, 20), ("b", 1, 20), ("b", 2, 20), ("c", 1, 0), ("c", 2, 0)]
    assert "WindowGroupLimit" in used._jdf.queryExecution().executedPlan().toString()
