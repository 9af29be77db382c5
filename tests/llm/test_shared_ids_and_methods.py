"""Rows that share an id, empty tables, and what the methods of the operators promise, each against brute force."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.llm import cap_filters, exact_dedup, licenses, line_dedup, mixing, near_copies, pieces, secrets_scan, simhash, toxicity, url_rules

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


def test_lines_of_a_shared_id(spark):
    """A line that one row loses takes nothing from another row of the same id, nor from rows without id."""
    rows = [(0, "boiler", "s0"), (1, "boiler", "s1"), (1, "precious own line", "s2"), (1, "precious own line\nboiler", "s2"), (None, "boiler\nmine", "s3")]
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in line_dedup.drop_boilerplate(docs_of(spark, rows), min_sites=3).collect())
    assert got == [(-1, "boiler\nmine"), (0, "boiler"), (1, ""), (1, "precious own line"), (1, "precious own line")]


def test_near_copies_of_a_shared_id(spark):
    import corpus_pipeline as cp

    words = [f"w{k}" for k in range(60)]
    text, other = " ".join(words), " ".join(reversed(words))
    rows = [(2, text, "a"), (5, text, "a"), (5, other, "a"), (None, text, "b"), (9, text, "b"), (9, text, "b")]
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in dict(cp.STAGES)["simhash"](spark, docs_of(spark, rows), "").collect())
    assert got == [(-1, text), (2, text), (5, other)]


def test_order_of_a_shared_id(spark):
    rows = [(1, "x" * 10, "a"), (1, "y" * 500, "b"), (None, "p", "a"), (None, "q", None), (None, None, "a"), (1, "x" * 10, "a")]
    docs = docs_of(spark, rows)
    got = mixing.in_order(docs, {"a": 1, "b": 1})
    assert sorted(map(repr, got.collect())) == sorted(map(repr, docs.collect())) and got.columns == docs.columns
    many = docs_of(spark, [(None, f"text {k}", "a") for k in range(300)])
    assert mixing.mix(many, {"a": 1}, block=50).select("before").distinct().count() == 300


@pytest.mark.parametrize("words", [16, 32, 64, 128, 256, 512, 1024, 2048, 4096])
def test_filters_find_pairs_at_the_threshold(words):
    assert cap_filters.miss_share(64, words, cap_filters.least_filters(64, words), pairs=1000, seed=78) <= 0.03


@pytest.mark.parametrize("group_rows, words", [(65_536, None), (65_536, 256), (8, None), (8, 64)])
def test_vectors_at_any_cut(spark, monkeypatch, group_rows, words):
    """Groups whole and cut into filters and tiles, at few and many words: the links of brute force but for MISSED, none too many."""
    monkeypatch.setattr(cap_filters, "GROUP_ROWS", group_rows)
    monkeypatch.setattr(cap_filters, "TILE_ROWS", 16)
    monkeypatch.setattr(cap_filters, "_BLOCK", 7)
    rng = np.random.default_rng(5)
    base = rng.standard_normal((40, 24))
    x = np.concatenate([base[np.repeat(np.arange(40), 4)] + 0.2 * rng.standard_normal((160, 24)), np.ones((30, 24)) + 0.05 * rng.standard_normal((30, 24))]).astype(np.float32)
    rows = [(k, x[k].tolist(), k % 2) for k in range(len(x))] + [(k, x[k].tolist(), k % 2) for k in range(3)]
    got = cap_filters.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), words=words).collect()
    y = np.stack([np.array(r[1], np.float64) for r in rows])
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    near = (y @ y.T >= 0.93) & (np.array([r[2] for r in rows])[:, None] == np.array([r[2] for r in rows])[None])
    np.fill_diagonal(near, False)
    want = {}
    for k, r in enumerate(rows):
        want.setdefault(r[0], []).append(int(near[k].sum()))
    found = {}
    for r in got:
        found.setdefault(r.id, []).append(r.n_links)
    assert near.sum() > 400 and len(got) == len(rows)
    assert all(a <= b for i in want for a, b in zip(sorted(found[i]), sorted(want[i])))
    assert sum(map(sum, found.values())) >= 0.98 * near.sum()


def test_vectors_of_an_empty_table_and_of_doubles(spark):
    kind = "vec_id long, embedding array<double>, label string"
    assert cap_filters.near_vectors(spark.createDataFrame([], kind)).count() == 0
    rows = [(1, [1.0, 0.0, -0.0], "a"), (2, [1.0, -0.0, 0.0], "a"), (2, [1.0, 1e-300, 0.0], "a"), (3, [1e200, 1e190, 0.0], "a"), (4, [0.0, 1.0, 0.0], "a"), (None, [1.0, 0.0, 0.0], "a")]
    got = sorted((r.id or 0, r.n_links, r.component_id) for r in cap_filters.near_vectors(spark.createDataFrame(rows, kind)).collect())
    assert got == [(0, 0, None), (1, 3, 1), (2, 3, 1), (2, 3, 1), (3, 3, 1), (4, 0, 4)]


def test_exact_steps_leave_rows_out(spark, sf_dir):
    """Rows whose length is theirs alone have no prefix, those whose beginning differs are in no group."""
    same = "a" * 300
    rows = [(1, same + "x"), (2, same + "y"), (3, same + "Y"), (4, "b" * 301), (5, "short"), (6, None), (7, "")]
    seen, groups = exact_dedup.refined(spark.createDataFrame(rows, "id long, text string").select("id", F.coalesce("text", F.lit("")).alias("t")))
    prefix = {r.id: r.prefix for r in seen.collect()}
    assert prefix[5] is None and all(prefix[i] is not None for i in (1, 2, 3, 4, 6, 7))
    assert sorted(r.n_rows for r in groups.collect()) == [2, 3]
    for every in (False, True):
        got = {r.id: r for r in exact_dedup.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), digest_all=every).collect()}
        assert {i: (r.keep_id, r.group_size, r.kept) for i, r in got.items()} == {1: (1, 1, True), 2: (3, 2, False), 3: (3, 2, True), 4: (4, 1, True), 5: (5, 1, True), 6: (7, 2, False), 7: (7, 2, True)}
        assert (got[5].digest is None) == (not every) and got[1].digest is not None
    plan = exact_dedup.op3_exact_dedup(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and "CartesianProduct" not in plan


def line_of(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    return " " + "  ".join(words) + " "


def brute_licenses(text):
    """Every rule tried everywhere, every pair of finds compared: labels and score."""
    line = line_of(text)
    found = []
    for rule in licenses.signatures():
        for m in re.finditer(rule.pattern, line):
            hit = (m.start(), m.end(), rule.priority, rule.score, rule.label) if rule.alone else None
            if rule.is_name:
                before = line[max(0, m.start() - licenses._REACH) : m.start()] + " "
                for priority, score, wording in licenses.WORDINGS:
                    if w := re.search(f" {licenses._spaced(wording)}  $", before):
                        hit = (m.start() + 1 - len(w[0]), m.end(), priority, score, rule.label)
                        break
            if hit:
                found.append(hit)
    inside = lambda x, y: y[0] <= x[0] and x[1] <= y[1] and (y[:2] != x[:2] or (-y[2], y[3], y[4]) < (-x[2], x[3], x[4]))
    kept = [x for x in found if not any(inside(x, y) for y in found)]
    return ",".join(sorted({x[4] for x in kept})), max((x[3] for x in kept), default=0.0)


def sample_of(pattern, rng):
    """A text that a rule's pattern matches, its options and alternatives drawn."""
    while m := re.search(r"\(\?:([^()]*)\)(\?|\+|\{\d+,\d+\})?", pattern):
        one = rng.choice(m[1].split("|")) if m[2] != "?" or rng.random() < 0.5 else ""
        pattern = pattern[: m.start()] + one + pattern[m.end() :]
    pattern = re.sub(r"\[\^ \]\+", lambda _: rng.choice(["foo", "bar"]), pattern)
    pattern = re.sub(r"\[(.)-?([^]]*)\]", lambda m: rng.choice(m[1] + m[2]), pattern)
    return re.sub(r"(.)\?", lambda m: m[1] if rng.random() < 0.5 else "", pattern)


def test_license_rules_against_brute_force(spark):
    """Samples of every rule, alone and joined: none is lost by roots and keywords, and overlaps are resolved as all pairs say."""
    rng = random.Random(3)
    rules = licenses.signatures()
    texts = [f"lorem {rng.choice(['licensed under the', 'SPDX-License-Identifier:', 'see', 'it is', 'by the terms of'])} {sample_of(r.pattern, rng)} ipsum" for r in rules for _ in range(2)]
    texts += [" ".join(rng.choice(texts) for _ in range(rng.randint(2, 4))) for _ in range(200)]
    texts += ["license mit license mit license", "mit license mit license", "licensed under the licensed under the mit license", "", "er kam mit dem Rad"]
    every = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = {r.id: r for r in licenses.scan(every).collect()}
    base = {"mit", "apache-2", "cc-by-nc"}
    wrong = []
    for k, text in enumerate(texts):
        labels, score = brute_licenses(text)
        mine = set(filter(None, got[k].labels.split(",")))
        has = set(filter(None, got[k].base_labels.split(",")))
        if mine != set(filter(None, labels.split(","))) | has or got[k].score != max(score, 0.85 if has else 0):
            wrong.append((text, labels, score, got[k].labels, got[k].score))
    assert not wrong and has <= base
    alone = [k for k, r in enumerate(rules) for _ in range(2) if r.alone]
    assert len(rules) > 250 and all(brute_licenses(texts[2 * k])[0] for k in alone)


def test_license_notices(spark):
    cases = {
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.": "apache-2",
        "released under Apache 2.0": "apache-2",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License": "gpl-3",
        "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3": "gfdl",
        "https://creativecommons.org/licenses/by-nc-sa/4.0/": "cc-by-nc-sa", "see http://www.apache.org/licenses/LICENSE-2.0": "apache-2", "https://opensource.org/licenses/MIT": "mit",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "mpl-2", "\"license\": \"ISC\"": "isc", "Redistributions of source code must retain the above copyright notice, this list of conditions": "bsd",
        "The Software shall be used for Good, not Evil.": "json", "Unauthorized copying of this file, via any medium is strictly prohibited": "proprietary",
    }
    got = {r.id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")).collect()}
    assert {t: got[k].labels for k, t in enumerate(cases)} == cases and all(r.score >= 0.8 for r in got.values())
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    plan = licenses.scan(spark.createDataFrame([(1, "x")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan


def test_secrets_of_unseen_kinds(spark):
    """Kinds that no training finding has, planted in real documents, also late in a run and cut by a base span; and what is found where none is."""
    detector = secrets_scan.Detector.train()
    rng = random.Random(4)
    up, low, digit = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    every = up + low + digit
    kinds = [
        lambda: "AIza" + pick(every + "_-", 35), lambda: f"SG.{pick(every, 22)}.{pick(every, 43)}", lambda: f"xapp-1-{pick(up + digit, 11)}-{pick(digit, 13)}-{pick(low + digit, 40)}", lambda: "key_live." + pick(low + digit, 32),
        lambda: "config/prod/service/settings/values/current.yaml=" + pick(every, 40),
    ]
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()]
    clean = detector.spans(texts)
    assert sum(k == 3 for f in clean for _, k, _ in f) <= 5e-6 * sum(map(len, texts)) + 1
    for kind in kinds:
        planted = []
        for text in texts[:100]:
            value, at = kind(), len(text) // 2
            planted.append((text[:at] + " " + value + " " + text[at:], at + 1, at + 1 + len(value)))
        found = detector.spans([t for t, _, _ in planted])
        assert np.mean([any(a < hi and b > lo for a, _, b in f) for f, (_, lo, hi) in zip(found, planted)]) >= 0.9
    text = "see " + "0a" * 16 + "/" + pick(every, 40) + " there"
    assert [k for _, k, _ in detector.spans([text])[0]] == [2, 3]
    assert secrets_scan.windows(5, 200)[0][0] == 5 and secrets_scan.windows(5, 200)[-1][1] == 200
    assert all(b >= c for (_, b), (c, _) in zip(secrets_scan.windows(5, 200), secrets_scan.windows(5, 200)[1:]))
    assert secrets_scan.scan(spark.createDataFrame([], "doc_id long, text string"), detector).count() == 0


def test_toxicity_against_a_plain_scorer(spark):
    """Every score of a table by one loop over words, with distances computed in full."""
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    memo = {}

    def term_of(word):
        if word not in memo:
            found = []
            for i, (t, stem) in enumerate(model.terms):
                if stem and word.startswith(t):
                    found.append((0, i))
                elif not stem and abs(len(t) - len(word)) <= 2 and (d := distance(word, t)) <= toxicity.edits_allowed(t):
                    found.append((d, i))
            memo[word] = min(found, default=None)
        return memo[word]

    def plain(text):
        low = text.lower()
        spans = [m.span() for m in re.finditer(r"[^\W_]+", low)]
        values = []
        for k, (a, b) in enumerate(spans):
            if not (hit := term_of(low[a:b])):
                continue
            lo, hi = max(0, k - toxicity.WINDOW), min(len(spans), k + toxicity.WINDOW + 1)
            near = {low[x:y] for x, y in spans[lo:hi]}
            left, right = low[spans[lo][0] : a], low[b : spans[hi - 1][1] + 1]
            quoted = (any(q in left for q in toxicity.QUOTES) and any(q in right for q in toxicity.QUOTES)) or near & toxicity.REPORTING
            factor = toxicity.QUOTED_FACTOR if quoted else toxicity.AIMED_FACTOR if near & toxicity.ADDRESS else 1.0
            if (w := min(0.99, model.weights.get((hit[1], hit[0]), 0.0) * factor)) > 0:
                values.append((hit[1], w))
        x = [0.0] * 5
        if values:
            x = [min(20.0, -sum(np.log(1 - w) for _, w in values)), np.log1p(len(values)), min(1.0, 20 * len(values) / (len(spans) + 20)), np.log1p(len({t for t, _ in values})), max(w for _, w in values)]
        return 1 / (1 + np.exp(-np.clip(model.coefficients[0] + np.dot(model.coefficients[1:], x), -30, 30)))

    some = docs.where("doc_id % 9 = 0")
    got = {r.id: r.score for r in toxicity.score(some, model).collect()}
    want = {r.doc_id: plain(r.text or "") for r in some.collect()}
    assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in want) < 1e-9
    held = {r.id: r.held_out for r in got_held(spark).collect()}
    assert held == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in held}


def got_held(spark):
    return spark.range(200).select("id", toxicity.held_out("id").alias("held_out"))


def test_unigram_model_against_the_library(tmp_path):
    """A true unigram model, written out here: the ids of the piece library, or others of the same score."""
    import sentencepiece as spm
    from sentencepiece import sentencepiece_model_pb2 as pb

    words = ["▁the", "▁", "t", "h", "e", "he", "th", "the", "▁th", "ing", "i", "n", "g", "in", "s", "▁s", "er", "r", "a", "an", "▁an", "d", "and", "▁and", "é"]
    model = pb.ModelProto()
    add = lambda piece, score, kind: model.pieces.add(piece=piece, score=score, type=kind)
    kinds = pb.ModelProto.SentencePiece
    add("<unk>", 0.0, kinds.UNKNOWN), add("<s>", 0.0, kinds.CONTROL), add("</s>", 0.0, kinds.CONTROL)
    for k in range(256):
        add(f"<0x{k:02X}>", 0.0, kinds.BYTE)
    rng = random.Random(2)
    for w in words:
        add(w, -2.0 - 6 * rng.random() / len(w), kinds.NORMAL)
    model.trainer_spec.model_type, model.trainer_spec.byte_fallback = 1, True
    model.trainer_spec.vocab_size = len(model.pieces)
    model.normalizer_spec.name, model.normalizer_spec.remove_extra_whitespaces = "identity", False
    model.normalizer_spec.add_dummy_prefix, model.normalizer_spec.escape_whitespaces = True, True
    path = tmp_path / "u.model"
    path.write_bytes(model.SerializeToString())
    library, vocab = spm.SentencePieceProcessor(model_file=str(path)), pieces.Vocabulary.load(str(path))
    total = lambda ids: sum(vocab.scores[i] for i in ids if i >= 259)
    texts = ["the thing and sand", "theres", "an é", "a  the", "xyz the", "ing" * 40, "日本 the"] + ["".join(rng.choice("thesinga rd") for _ in range(60)) for _ in range(80)]
    for text, ids in zip(texts, vocab.encode_batch([t.encode() for t in texts])):
        theirs = library.encode(text)
        assert vocab.decode(ids.tolist()).decode() == text
        assert ids.tolist() == theirs or (abs(total(ids) - total(theirs)) < 1e-4 and sum(i < 259 for i in ids) == sum(i < 259 for i in theirs)), text


def test_urls_of_repeated_rows_and_long_ones(spark):
    long = "http://example.org/es/" + "x" * 200_000
    rows = [(1, long), (1, long), (None, "http://a.com/fr/"), (2, None)]
    rules = spark.createDataFrame(url_rules.RULES, "host string, path string, verdict string")
    got = sorted((r.id or 0, r.rule, r.verdict) for r in url_rules.judge(spark.createDataFrame(rows, "page_id long, url string"), rules).collect())
    assert got == sorted([(0, "com/fr/", "allow"), (1, "example.org/es/", "block"), (1, "example.org/es/", "block"), (2, None, "allow")], key=repr) or got == [(0, "com/fr/", "allow"), (1, "example.org/es/", "block"), (1, "example.org/es/", "block"), (2, None, "allow")]


def test_fingerprints_beside_clashing_columns(spark):
    docs = docs_of(spark, [(1, "a b c d", "s"), (2, "a b c d", "s"), (3, None, "s")]).withColumns({c: F.lit("x") for c in ("id", "fp", "rep", "n_rows", "component", "node", "cell", "tile", "row", "t")})
    assert sorted((r.id, r.component_id) for r in simhash.near_duplicates(docs).collect()) == [(1, 1), (2, 1), (3, 3)]
    assert sorted((r.id, r.component_id) for r in near_copies.near_copies(docs).collect()) == [(1, 1), (2, 1), (3, 3)]
