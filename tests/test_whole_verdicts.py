"""Verdicts take all registered texts and all held-out texts, and write no vectors of theirs."""

import numpy as np
from pyspark.sql import functions as F

from inkwell import storage
from inkwell.operators import encoder as en
from inkwell.operators import verifier as vf


def _copy_rows():
    """120 registered texts of two profiles; the 77th of the first and its copy; what is asked shares half of it."""
    texts = [(f"a{k:03d}", "ann" if k < 100 else "bob", " ".join(f"w{k}x{j}" for j in range(150))) for k in range(120)]
    texts.append(("a200", "bob", texts[77][2]))
    half = " ".join(texts[77][2].split()[:100]) + " " + " ".join(f"new{j}" for j in range(50))
    return texts, [("q1", half), ("q2", half.upper()), ("q3", "nothing of the kind")]


def test_copies_of_any_registered_text_are_found(spark):
    texts, asked = _copy_rows()
    key = lambda of, i: {"of": of, "id": i}
    kind = "id struct<of string, id string>"
    both = spark.createDataFrame([(key("r", i), t) for i, _, t in texts] + [(key("q", i), t) for i, t in asked], f"{kind}, text string")
    members = spark.createDataFrame([(a, key("r", i)) for i, a, _ in texts], f"profile string, {kind}")
    pairs = spark.createDataFrame([(key("q", i), p) for i, _ in asked for p in ("ann", "bob", "cyd")], f"{kind}, profile string")

    def grams(text):
        w = text.lower().split()
        return {tuple(w[k : k + 50]) for k in range(0, max(len(w) - 50, 0) + 1, 25)}

    expected = {}
    for i, t in asked:
        for _, p, u in texts:
            a, b = grams(t), grams(u)
            if a & b:
                expected[i, p] = max(expected.get((i, p), 0), len(a & b) / len(a | b))
    got = {(r.id.id, r.profile): r.near_duplicate for r in vf.nearest(pairs, members, both).collect()}
    assert set(got) == set(expected) == {(q, p) for q in ("q1", "q2") for p in ("ann", "bob")}
    assert all(abs(got[k] - v) < 1e-12 for k, v in expected.items())


def test_all_texts_of_held_out_books_are_asked_about(spark):
    train = spark.range(90).select(F.element_at(F.array(F.lit("ann"), F.lit("bob")), (F.col("id") % 2 + 1).cast("int")).alias("author"), "id")
    held = train.select("author", (F.col("id") + 1000).alias("id")).unionByName(spark.range(2000, 2060).select(F.lit("ann").alias("author"), "id"))
    pairs, members = vf.validation_pairs(train, held)
    rows = pairs.collect()
    assert len(rows) == 2 * held.count() and {(r.id, r.label) for r in rows} == {(r.id, k) for r in held.collect() for k in (0.0, 1.0)}
    assert members.count() == train.count()


def _voices(spark):
    words = {"ann": "the sea and the tide of a long night", "bob": "however one must, perhaps, consider it again; so be it"}
    rows = [(a, k + 500 * (a == "bob"), " ".join(w for j in range(12) for w in (t, f"n{(k * 7 + j) % 31}."))) for a, t in words.items() for k in range(30)]
    rows += [("ann", 900, " " + rows[3][2].upper()), ("bob", 901, ""), ("bob", 902, "so be it")]
    return spark.createDataFrame(rows, "profile string, id long, text string")


def test_profiles_and_likenesses_without_vectors_equal_those_of_vectors(spark, monkeypatch):
    texts = _voices(spark)
    enc = en.StyleEncoder.fit(texts, "id")
    encoded, members = enc.encode(texts.select("id", "text"), "id"), texts.select("profile", "id")
    plain = {r.profile: r.asDict() for r in en.profiles(encoded, members).collect()}
    written = []
    monkeypatch.setattr(en, "materialize", lambda df, name: written.append(df.columns) or storage.materialize(df, name))
    made, sums = en.text_profiles(texts, enc)
    got = {r.profile: r.asDict() for r in made.collect()}
    assert set(got) == set(plain) == {"ann", "bob"} and got["ann"]["n_texts"] == 30 and got["ann"]["n_given"] == 31
    for name, row in plain.items():
        for field, value in row.items():
            if field != "profile":
                some = value[: len(got[name][field])] if field in ("sd", "median", "mad") else value
                assert np.allclose(got[name][field], some, rtol=1e-9, atol=1e-9), (name, field)
    pairs = texts.select("id", F.explode(F.array(F.lit("ann"), F.lit("bob"))).alias("profile"), F.lit(1.0).alias("label"))
    key = lambda r: (r.id, r.profile)
    near = {key(r): r.asDict() for r in en.likeness(pairs, texts.select("id", "text"), made, sums, enc).collect()}
    assert all("char_ix" not in columns or "n_texts" in columns for columns in written)
    listed = en.similarity(pairs, encoded, en.few_profiles(encoded, members, 1000), enc).collect()
    assert len(listed) == len(near) == 2 * texts.count()
    for r in listed:
        assert set(r.asDict()) == set(near[key(r)])
        for field, value in r.asDict().items():
            other = near[key(r)][field]
            assert other == value or abs(other - value) < 1e-9, (field, value, other)
