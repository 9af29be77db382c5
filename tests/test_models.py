"""Books from raw text, the style encoder, the verifier, attribution and stores: results, not counts."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.functions import lexicons as lx
from inkwell.operators import attribution, books, chunking, encoder, learning, linear, machine_text, metrics, novelty, overlap, verifier
from inkwell.plans import learning as plans
from inkwell.sources import corpus, sinks

VOICES = {"ann": "gale moor heather stone wind cold walk".split(), "bob": "ship sail harbour rope tide salt deck".split(), "cyd": "court lord lady dance silk fan letter".split()}


def written(author, rng, n=260):
    """A text in an author's voice: own words, own length of sentences and marks."""
    out, own = [], VOICES[author]
    while len(out) < n:
        size = {"ann": 6, "bob": 14, "cyd": 24}[author] + rng.randint(-2, 2)
        words = [rng.choice(own) if rng.random() < 0.35 else rng.choice("the a of and to in was he she it that with as for on".split()) for _ in range(size)]
        out += [words[0].capitalize(), *words[1:-1], words[-1] + {"ann": ".", "bob": "!", "cyd": "; indeed."}[author]]
    return " ".join(out)


@pytest.fixture(scope="module")
def library(spark):
    """36 texts of three authors, six books each: (author, book, id, text)."""
    rng = random.Random(1)
    rows = [(a, f"b{b}", 100 * k + 10 * b + c, written(a, rng)) for k, a in enumerate(VOICES) for b in range(6) for c in range(3)]
    return spark.createDataFrame(rows, "author string, book string, id long, text string").cache()


RAW = """junk
*** START OF THE PROJECT GUTENBERG EBOOK X ***
Produced by A. Typist
Title: The Book

CHAPTER ONE

It was “cold” [12] in the hyphen-
ated morning.  Very cold.

CHAPTER TWO

She said no [Footnote 3: not so] word—none.

 41

The end came.

NOTES

1. a note
*** END OF THIS PROJECT GUTENBERG EBOOK X ***
licence
"""


def test_a_raw_book(spark, tmp_path):
    (tmp_path / "Ann").mkdir()
    (tmp_path / "Ann" / "first.txt").write_text(RAW)
    (tmp_path / "Ann" / "empty.txt").write_text(" \n")
    (tmp_path / "Bob").mkdir()
    (tmp_path / "Bob" / "copy.txt").write_text(RAW)
    made = books.process(corpus.read_books(spark, str(tmp_path)))
    text = 'It was "cold" in the hyphenated morning. Very cold.\n\nShe said no word--none.\n\nThe end came.'
    got = {(r.author, r.book): r for r in made.chunks.collect()}
    assert set(got) == {("Ann", "first"), ("Bob", "copy")} and got["Ann", "first"].text == text
    assert (got["Ann", "first"].word_count, got["Ann", "first"].n_paragraphs, got["Ann", "first"].last_chapter) == (16, 3, 2)
    quality = {(r.author, r.book): r for r in made.quality.collect()}
    assert quality["Ann", "first"].n_chapters == 2 and quality["Ann", "first"].total_words == 16 and "short" in quality["Ann", "first"].warnings
    assert quality["Ann", "empty"].total_words == 0 and quality["Ann", "empty"].n_chapters == 0
    assert [(r.a_author, r.b_author, r.jaccard) for r in made.duplicates().select(F.least("a_author", "b_author").alias("a_author"), F.greatest("a_author", "b_author").alias("b_author"), "jaccard").collect()] == [("Ann", "Bob", 1.0)]
    assert {(r.author, r.book): r.n_words for r in made.summary().collect()}[None, None] == 32
    sinks.write_chunks(books.dataset(made.chunks), str(tmp_path / "out"))
    assert sorted((r.author, r.chunk_id, r.chapter_span) for r in corpus.read_chunks(spark, str(tmp_path / "out")).collect()) == [("Ann", "0", [1, 2]), ("Bob", "0", [1, 2])]


def test_chunks_keep_the_order_of_their_numbers(spark, tmp_path):
    chunks = spark.createDataFrame([("A", "b", str(k), f"t{k}", 1) for k in range(25)], "author string, book string, chunk_id string, text string, word_count int").repartition(4)
    sinks.write_chunks(chunks, str(tmp_path / "out"))
    assert {r.text: r.chunk_id for r in corpus.read_chunks(spark, str(tmp_path / "out")).collect()} == {f"t{k}": str(k) for k in range(25)}


def test_multiscale_rows_come_from_their_chunk(spark, tmp_path):
    rng = random.Random(2)
    texts = [written("ann", rng, 700) for _ in range(3)]
    chunks = spark.createDataFrame([("ann", "b", k, t, len(t.split())) for k, t in enumerate(texts)], "author string, book string, chunk_id long, text string, word_count long")
    rows = books.multiscale(chunks)
    got, whole = rows.collect(), {str(r.chunk_id): " ".join(r.text.split()) for r in chunks.collect()}
    most = {"large": 1, "medium": 2, "semi_small": 3, "window": 3, "phrase": 4, "sentence": 6}
    count = Counter((r.chunk_id.split("-")[0], r.scale) for r in got)
    assert {s for _, s in count} == set(most) and all(n <= most[s] for (_, s), n in count.items())
    assert all(" ".join(r.text.split()) in whole[r.chunk_id.split("-")[0]] and r.word_count == len(r.text.split()) for r in got)
    sinks.write_multiscale(chunks, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).count() == len(got)


def test_store_numbers_its_texts(spark, tmp_path):
    path = str(tmp_path / "store")
    first = sinks.append_texts(spark.range(20).select(F.concat(F.lit("c"), (F.col("id") % 3).cast("string")).alias("candidate"), F.col("id").cast("string").alias("text")).repartition(5), path, "candidate", "upload", "ann")
    second = sinks.append_texts(spark.createDataFrame([("c9", "last")], "candidate string, text string"), path, "candidate", "form")
    assert sorted(r.id for r in first.collect()) == list(range(1, 21)) and second.first().id == 21
    back = sinks.read_store(spark, path)
    assert back.count() == 21 and back.where("candidate = 'c9'").first().source == "form" and back.where("added_at is null").count() == 0


def plain_tfidf(texts, asked):
    """Word TF-IDF by dictionaries: (terms of words and pairs, min 2 texts, at most 90 %)."""
    def terms(t):
        w = re.findall(r"(?u)\b\w\w+\b", t.lower())
        return Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])])

    counts = [terms(t) for t in texts]
    df = Counter(t for c in counts for t in c)
    idf = {t: math.log((1 + len(texts)) / (1 + n)) + 1 for t, n in df.items() if 2 <= n <= 0.9 * len(texts)}
    out = []
    for t in asked:
        v = {k: (1 + math.log(n)) * idf[k] for k, n in terms(t).items() if k in idf}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        out.append({k: x / norm for k, x in v.items()})
    return out


def test_encoder_knows_only_what_it_was_fitted_on(spark, library, tmp_path):
    fitted, rest = library.where("book < 'b3'"), library.where("book >= 'b3'")
    enc = encoder.StyleEncoder.fit(fitted, "id")
    enc.save(str(tmp_path / "enc"))
    kept = encoder.StyleEncoder.load(spark, str(tmp_path / "enc"))
    assert kept.n_texts == enc.n_texts == 27 and encoder.StyleEncoder.load(spark, str(tmp_path / "none")) is None
    encoded = kept.encode(library, "id")
    assert encoded.count() == library.count()
    members = fitted.select(F.col("author").alias("profile"), "id")
    made = encoder.profiles(encoded, members)
    pairs = rest.select("id").withColumn("profile", F.explode(F.array(*map(F.lit, VOICES))))
    got = {(r.id, r.profile): r for r in encoder.similarity(pairs, encoded, made, kept).collect()}
    old, new = {r.id: r for r in fitted.collect()}, {r.id: r for r in rest.collect()}
    vectors = dict(zip(new, plain_tfidf([r.text for r in old.values()], [r.text for r in new.values()])))
    own = dict(zip(old, plain_tfidf([r.text for r in old.values()], [r.text for r in old.values()])))
    for (i, author), r in got.items():
        mean = Counter()
        for j, o in old.items():
            if o.author == author:
                mean.update(own[j])
        dot = sum(x * mean[t] for t, x in vectors[i].items()) / math.sqrt(sum(x * x for x in mean.values()))
        assert abs(r.sim_word - dot) < 1e-9
        assert abs(r.lq - math.log1p(len(new[i].text.split()))) < 1e-9 and r.n_texts == 9 and abs(r.ln - math.log(9)) < 1e-9
        assert abs(r.sim_char_x_lq - r.sim_char * r.lq) < 1e-12 and all(0 <= r[c] <= 1 + 1e-9 for c in encoder.SIMILARITIES)
    words = {i: re.findall("[a-z']+", r.text.lower()) for i, r in {**old, **new}.items()}
    share = {i: np.array([w.count(f) / max(len(w), 1) for f in lx.FUNCTION_WORDS]) for i, w in words.items()}
    basis = np.stack([share[i] for i in old])
    mu, sd = basis.mean(axis=0), basis.std(axis=0) + 1e-6
    for (i, author), r in list(got.items())[:12]:
        z, p = (share[i] - mu) / sd, np.mean([(share[j] - mu) / sd for j, o in old.items() if o.author == author], axis=0)
        assert abs(r.fw_delta - 1 / (1 + np.abs(z - p).mean())) < 1e-9
        assert abs(r.fw_cos - (float(z @ p / math.sqrt((z @ z) * (p @ p))) + 1) / 2) < 1e-9


def test_profiles_of_any_size_equal_the_listed_ones(spark, library):
    """Partial sums and bounded windows give what a list of all texts gives, copies and texts without terms included."""
    more = spark.createDataFrame([("ann", "b9", 900, " THE sea  and the tide. "), ("ann", "b9", 901, "the sea and the tide."), ("bob", "b9", 902, "")], library.schema)
    texts = library.unionByName(more)
    enc = encoder.StyleEncoder.fit(library, "id")
    encoded = enc.encode(texts, "id")
    members = texts.select(F.col("author").alias("profile"), "id")
    whole = {r.profile: r.asDict() for r in encoder.profiles(encoded, members).collect()}
    listed = {r.profile: r.asDict() for r in encoder.few_profiles(encoded, members, 1000).collect()}
    assert set(whole) == set(listed) == set(VOICES) and whole["ann"]["n_texts"] == 19 and whole["ann"]["n_given"] == 20
    for name, row in listed.items():
        for field, value in row.items():
            if field != "profile":
                assert np.allclose(whole[name][field], value, rtol=1e-9, atol=1e-9), (name, field)


def test_a_text_registered_long_ago_and_profiles_of_many_names(spark):
    """The 60th text of an author is known as such when it is handed in again, and each of ten authors is asked about."""
    rng = random.Random(4)
    rows = [(f"a{k}", 1000 * k + c, written(rng.choice(list(VOICES)), rng, 90)) for k in range(10) for c in range(60 if k == 0 else 3)]
    texts = spark.createDataFrame(rows, "author string, id long, text string")
    enc = encoder.StyleEncoder.fit(texts, "id")
    asked = spark.createDataFrame([(k, rows[k][2].upper()) for k in (0, 41, 59)], "id long, text string")
    names = texts.select("author").distinct()
    pairs, pool = verifier.with_every(asked, names), verifier.impostor_pool(names)
    assert pairs.distinct().count() == 30 and {r["count"] for r in pool.groupBy("profile").count().collect()} == {8} and pool.where("profile = impostor").count() == 0
    got = {(int(r.id), r.profile): r for r in verifier.verdicts(asked, texts, pairs, enc, verifier.Verifier(), pool).collect()}
    assert len(got) == 30 and {k for k, r in got.items() if r.error == "leakage"} == {(0, "a0"), (41, "a0"), (59, "a0")} and got[0, "a0"].n_texts == 60


def test_drawn_pairs_never_ask_about_their_profile(spark, library):
    pairs, members = verifier.drawn_pairs(library.drop("text"), draws=8)
    rows, inside = pairs.collect(), {}
    for m in members.collect():
        inside.setdefault(m.profile, set()).add(m.id)
    of = {r.id: (r.author, r.book) for r in library.collect()}
    assert Counter(r.label for r in rows) == {1.0: 24, 0.0: 24}
    for r in rows:
        authors = {of[i][0] for i in inside[r.profile]}
        n_books = len({of[i] for i in inside[r.profile]})
        assert len(authors) == 1 and (authors == {of[r.id][0]}) == (r.label == 1) and 2 <= n_books <= 6
        assert r.label == 0 or of[r.id] not in {of[i] for i in inside[r.profile]}
    assert len({len({of[i] for i in inside[r.profile]}) for r in rows}) > 1


def test_verifier_out_of_sample_kept_and_used(spark, library, tmp_path):
    enc, ver, scores = verifier.train(library, draws=12)
    rows = scores.collect()
    pos, neg = np.array([r.score for r in rows if r.positive]), np.array([r.score for r in rows if not r.positive])
    auc = np.mean((pos[:, None] > neg[None]) + 0.5 * (pos[:, None] == neg[None]))
    assert auc > 0.95 and abs(ver.report["roc_auc"] - auc) < 1e-9 and ver.match >= ver.mismatch
    ver.save(spark, str(tmp_path / "v"))
    again = verifier.Verifier.load(spark, str(tmp_path / "v"))
    none = verifier.Verifier.load(spark, str(tmp_path / "none"))
    assert (again.match, again.mismatch) == (ver.match, ver.mismatch) and (none.model, none.match, none.mismatch) == (None, 0.70, 0.35)

    rng = random.Random(9)
    known = library.where("id = 11").first().text
    texts = spark.createDataFrame([(1, written("ann", rng, 900)), (2, known.upper() + " "), (3, "too short"), (4, " ".join(known.split()[:200]) + " " + written("ann", rng, 60))], "id long, text string")
    pairs = texts.select("id").withColumn("profile", F.explode(F.array(F.lit("ann"), F.lit("bob"))))
    pool = spark.createDataFrame([("ann", "bob"), ("ann", "cyd")], "profile string, impostor string")
    got = {(int(r.id), r.profile): r for r in verifier.verdicts(texts, library, pairs, enc, again, pool).collect()}
    assert len(got) == 8
    assert got[2, "ann"].error == "leakage" and got[2, "ann"].score is None and got[2, "ann"].verdict is None and got[2, "bob"].error is None
    assert got[3, "ann"].verdict == "UNCERTAIN" and got[3, "ann"].reason == "short" and got[3, "ann"].confidence == "very_low"
    assert got[4, "ann"].near_duplicate > 0.3 and got[1, "ann"].near_duplicate == 0 and got[4, "bob"].near_duplicate == 0
    assert got[1, "ann"].score > got[1, "bob"].score and got[1, "ann"].impostor_score > 0.9 and got[1, "bob"].impostor_score == 0.5
    plain = {(int(r.id), r.profile): r for r in verifier.verdicts(texts, library, pairs, enc, none).collect()}
    assert 0 <= plain[1, "ann"].score <= 1 and plain[1, "ann"].score > plain[1, "bob"].score


def test_attribution_of_held_out_books(spark, library, tmp_path):
    rows = library.withColumn("work", F.concat("author", "book"))
    model = attribution.Attribution.fit(rows.where("book <> 'b5'").select("id", "author", "work", "text"))
    attribution.save(model, str(tmp_path / "a"))
    back = attribution.load(spark, str(tmp_path / "a"))
    assert back.authors == ["ann", "bob", "cyd"] and attribution.load(spark, str(tmp_path / "none")) is None and back.folds == 3
    asked = library.where("book = 'b5'")
    best = {r.id: r for r in back.predict(asked.select("id", "text"), chunking.Sizes(100, 90, 110, 130, 40)).where("rank = 1").collect()}
    assert {i: r.author for i, r in best.items()} == {r.id: r.author for r in asked.collect()}
    first = asked.where("id = 50").first().text
    words = " ".join(w[::-1] + "zq" for w in first.split())
    strange = spark.createDataFrame([(1, words), (2, "Produced by A. Typist\n\n" + first), (3, " \n")], "id long, text string")
    every = {}
    for r in back.predict(strange).collect():
        every.setdefault(r.id, []).append(r)
    assert set(every) == {1, 2} and all(len(x) == 3 and abs(sum(r.p for r in x) - 1) < 1e-9 for x in every.values())
    assert every[2][0].n_chunks == 1 and next(r.author for r in every[2] if r.rank == 1) == "ann"
    assert all(0 <= r.novelty_pct <= 100 for x in every.values() for r in x)
    assert model.outside.out_of_fold and (back.outside.p01, back.outside.p50) == (model.outside.p01, model.outside.p50)
    same = {r.id: r.p for r in model.scores(asked.select("id", "text")).collect()}
    assert all(np.allclose(r.p, same[r.id], atol=1e-9) for r in back.scores(asked.select("id", "text")).collect())


def test_gradient_and_calibration(spark):
    """The gradient of the modified Huber loss against differences, its fit against plain steps, and Platt's scaling against a plain one."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    label = np.arange(120) % 3
    dense = rng.standard_normal((120, 6)) * (rng.random((120, 6)) < 0.6) + 1.5 * np.eye(6)[label]
    rows = [([int(j) for j in np.flatnonzero(x)], [float(v) for v in x[x != 0]], float(y), float(1 + y / 2)) for x, y in zip(dense, label)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.float64())), pa.array([r[2] for r in rows]), pa.array([r[3] for r in rows])], names=["ix", "w", "label", "weight"])
    weights, bias = rng.standard_normal((6, 3)), rng.standard_normal(3)
    _, slope = linear.huber_gradient(batch, weights, bias)
    for i, k in ((0, 0), (3, 1), (5, 2), (6, 1)):
        up, down = (np.vstack([weights, bias]) for _ in range(2))
        up[i, k] += 1e-6
        down[i, k] -= 1e-6
        numeric = (linear.huber_gradient(batch, up[:-1], up[-1])[0] - linear.huber_gradient(batch, down[:-1], down[-1])[0]) / 2e-6
        assert abs(numeric - slope[i, k]) < 1e-4 * max(1, abs(numeric))
    df = spark.createDataFrame(rows, "ix array<int>, w array<double>, label double, weight double").repartition(3).cache()
    weights, bias = linear.fit_huber(df, 6, 3, alpha=1e-2, steps=100)
    total = sum(r[3] for r in rows)
    loss, slope = linear.huber_gradient(batch, weights, bias)
    slope /= total
    slope[:-1] += 1e-2 * weights
    assert np.abs(slope).max() < 5e-3 and (linear.margins_of(batch, weights, bias).argmax(axis=1) == label).mean() > 0.85
    m = linear.margins_of(batch, weights, bias)
    platt = linear.fit_platt(spark.createDataFrame([(float(y), x.tolist()) for y, x in zip(label, m)], "label double, m array<double>"))
    for k, (a, b) in platt.items():
        y = label == k
        t = np.where(y, (y.sum() + 1) / (y.sum() + 2), 1 / ((~y).sum() + 2))
        p = 1 / (1 + np.exp(-(a * m[:, k] + b)))
        assert abs((p - t).sum()) < 1e-2 and abs(((p - t) * m[:, k]).sum()) < 1e-2  # where both derivatives vanish
    got = spark.createDataFrame([(m[0].tolist(),)], "m array<double>").select(linear.calibrated(F.col("m"), platt)).first()[0]
    assert abs(sum(got) - 1) < 1e-12 and np.argmax(got) == np.argmax(m[0])


def test_directions_of_sparse_rows_and_what_lies_outside(spark, tmp_path):
    rng = np.random.default_rng(6)
    low = rng.standard_normal((300, 5)) @ rng.standard_normal((5, 40)) * (rng.random((300, 40)) < 0.7)
    rows = [(k, f"g{k % 12}", [int(j) for j in np.flatnonzero(x)], [float(v) for v in x[x != 0]]) for k, x in enumerate(low)]
    df = spark.createDataFrame(rows, "id long, group string, ix array<int>, w array<double>").repartition(3)
    found = novelty.basis(df, 40, 300, 8)
    exact = np.linalg.svd(low)[2][:8].T
    assert np.allclose(found.T @ found, np.eye(8), atol=1e-4)
    assert np.linalg.norm(low @ found) >= 0.98 * np.linalg.norm(low @ exact)
    detector, scores = novelty.Detector.fit(df, 40, 8, 60, 64)
    assert detector.out_of_fold and scores.count() == 300 and len(detector.trees) == 60
    raw = np.array([r.raw for r in scores.collect()])
    assert abs(detector.p50 - np.percentile(raw, 50)) < 1e-5 and abs(detector.p01 - np.percentile(raw, 1)) < 1e-5
    detector.save(spark, str(tmp_path / "n"))
    kept = novelty.Detector.load(spark, str(tmp_path / "n"))
    asked = spark.createDataFrame([(1, [0, 1, 2, 3], [25.0, -25.0, 30.0, 25.0]), (2, rows[0][2], rows[0][3])], "id long, ix array<int>, w array<double>")
    got, same = ({r.id: r.pct for r in d.score(asked).collect()} for d in (detector, kept))
    assert got == same and got[1] < 5 < 20 < got[2]
    few, scores = novelty.Detector.fit(df.limit(12), 40, 8, 10, 64)
    one, _ = novelty.Detector.fit(df.withColumn("group", F.lit("g")), 40, 8, 10, 64)
    assert not few.out_of_fold and scores.count() == 12 and not one.out_of_fold


def test_a_strange_language_lies_outside(spark):
    """Texts of a language kept out get less than the median of what the detector knows, in every fold."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", F.col("source").alias("group"), "lang", "text").where("n_chars between 600 and 8000")
    known, strange = docs.where("lang <> 'es'"), docs.where("lang = 'es'")
    enc = encoder.StyleEncoder.fit(known, "doc_id", sizes={"char": 4000, "word": 2000})
    sizes = {kind: enc.vocabularies[kind].count() for kind in encoder.KINDS}
    x = attribution.union(enc.encode(known, "doc_id"), enc, sizes).join(known.select(F.col("doc_id").alias("id"), "group"), "id")
    detector, scores = novelty.Detector.fit(x, attribution.width(sizes), 50, 100)
    folds = {}
    for r in scores.join(known.select(F.col("doc_id").alias("id"), "group"), "id").withColumn("fold", F.pmod(F.xxhash64("group"), F.lit(5))).collect():
        folds.setdefault(r.fold, []).append(r.raw)
    got = [r.raw for r in detector.score(attribution.union(enc.encode(strange, "doc_id"), enc, sizes)).collect()]
    assert len(got) > 50 and np.median(got) < min(np.median(v) for v in folds.values())


@pytest.mark.parametrize("blocks", [4096, 10])
def test_stratified_folds(spark, monkeypatch, blocks):
    """No group straddles, every fold has its share of each class, the same whatever the partitions; plain hashes where classes are too few."""
    monkeypatch.setattr(learning, "DEALT_GROUPS", blocks)
    rng = random.Random(8)
    rows = [(f"g{g}", "abc"[(g % 7) % 3], k) for g in range(60) for k in range(rng.randint(5, 40))] + [(None, "a", 0), ("g1", None, 0)]
    df = spark.createDataFrame(rows, "work string, author string, k int")
    got = {r.work: r.fold for r in learning.stratified_folds(df.repartition(5), "work", "author", 5).collect()}
    assert got == {r.work: r.fold for r in learning.stratified_folds(df, "work", "author", 5).collect()} and set(got) == {f"g{g}" for g in range(60)}
    share = Counter((a, got[g]) for g, a, _ in rows if g and a)
    for a in "abc":
        total = sum(n for (c, _), n in share.items() if c == a)
        assert all(abs(share[a, f] / total - 0.2) < (0.06 if blocks == 4096 else 0.12) for f in range(5))
    few = learning.stratified_folds(spark.createDataFrame([("x", "a"), ("y", "b")], "work string, author string"), "work", "author", 5)
    assert {r.work for r in few.collect()} == {"x", "y"}


def test_exact_curve_against_all_thresholds(spark):
    rng = np.random.default_rng(3)
    rows = [(float(round(x, 6)), bool(p)) for x, p in zip(np.concatenate([rng.beta(4, 2, 200), rng.beta(2, 4, 300), [0.5] * 10]), [True] * 200 + [False] * 300 + [True, False] * 5)] + [(None, True)]
    curve = metrics.exact_curve(spark.createDataFrame(rows, "score double, positive boolean"), parts=7).cache()
    pos, neg = np.array([s for s, p in rows if p and s is not None]), np.array([s for s, p in rows if not p])
    best = min((abs((neg >= t).mean() - (pos < t).mean()), t) for t in sorted({s for s, _ in rows if s is not None}))
    got = metrics.equal_error(curve).first()
    assert got.eer_threshold == best[1] and abs(got.eer - ((neg >= best[1]).mean() + (pos < best[1]).mean()) / 2) < 1e-12
    auc = np.mean((pos[:, None] > neg[None]) + 0.5 * (pos[:, None] == neg[None]))
    assert abs(metrics.areas(curve).first().roc_auc - auc) < 1e-12
    at = metrics.thresholds(curve).first()
    assert at.match == np.sort(neg)[min(math.ceil(0.98 * len(neg)), len(neg) - 1)] and abs(at.mismatch - np.percentile(pos, 5)) < 1e-12


def test_numbers_of_names_and_trees_of_any_size(spark):
    names = spark.createDataFrame([(f"n{k:03}",) for k in range(100)] + [(None,)], "name string").repartition(7)
    assert {r.name: r.at for r in learning.numbered(names, "name", "at").collect()} == {f"n{k:03}": k for k in range(100)}
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(rng.standard_normal((400, 2)))] + [(999, 9.0, -9.0)], "id long, a double, b double")
    trees = learning.grow_trees(rows, ["a", "b"], 40, 64)
    assert len(trees) == 40 and 40 <= np.mean([t.n for t in trees]) <= 90
    raw = {r.id: r.raw for r in learning.novelty(rows, ["a", "b"], trees).collect()}
    assert min(raw, key=raw.get) == 999
    assert int(min(1.0, 256 / 1e12) * (1 << 53)) > 1_000_000  # a share of rows can be drawn at any size


def test_short_texts_are_not_asked_about(spark):
    texts = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(40))), (2, " ".join(f"w{k}" for k in range(15)))], "id long, text string")
    index = overlap.build_index(texts, "id", "text", texts)
    open_, gated = ({r.id: r.positions for r in overlap.overlap(index, texts, "id", "text", g).collect()} for g in (False, True))
    assert open_[1] == gated[1] > 0 and gated[2] == 0
    assert index.distinct().count() == overlap.build_index(texts, "id").count()


def test_learned_queries_give_what_they_should(spark):
    """Held-out books of the documents: languages are told apart by each of the queries that learn."""
    sf = "/root/testdata/sf0.01"
    got = plans.attribution_predictions(spark, sf).collect()
    assert len(got) == 1000 and np.mean([r.predicted == r.label for r in got]) > 0.8
    report = plans.verifier_validation(spark, sf).first()
    assert report.roc_auc > 0.9 and report.match >= report.mismatch
    turns = plans.ai_classifier_scores(spark, sf).collect()
    assert all(r.p is not None and 0 <= r.p <= 1 for r in turns) and any(r.p_machine is None for r in turns)


def test_lexicon_hits_and_structural_measures(spark):
    texts = spark.createDataFrame([(1, "Moreover, we delve and DELVE online. An applet, not an app."), (2, "Nothing here."), (3, None)], "doc_id long, text string")
    got = {(r.id, r.kind, r.phrase): r.n for r in machine_text.lexicon_hits(texts).collect()}
    assert got == {(1, "weak", "moreover"): 1, (1, "strong", "delve"): 2, (1, "modern", "online"): 1, (1, "modern", "app"): 1}
    whole, part = machine_text.surface(texts.where("text is not null")), machine_text.structural(texts.where("text is not null"))
    assert len(part.columns) == 14 and [c for c in whole.columns if c not in part.columns] == ["lexicon", "discourse"]
