"""Sets are left out before their grams are counted, and none that is similar to another."""

import random
from itertools import combinations

import pytest

from inkwell.operators import neardup


@pytest.mark.parametrize("similarity", [0.4, 0.6, 0.8])
def test_sets_without_enough_in_common_are_left_out_and_no_similar_ones(spark, similarity):
    draw, texts = random.Random(5), []
    for k in range(40):
        words = [f"w{draw.randrange(400)}" for _ in range(draw.choice([5, 12, 60, 90]))]
        texts.append(words)
        if k % 2:
            texts.append([w if draw.random() > draw.choice([0.0, 0.02, 0.1]) else "x" for w in words])
    texts += [[f"alone{k}x{i}" for i in range(40)] for k in range(10)] + [["all", "the", "same", "line", "here", f"z{k}", *(f"own{k}x{i}" for i in range(40))] for k in range(6)]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    sets = [{tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} for t in texts]
    firsts = [k for k, s in enumerate(sets) if s not in sets[:k]]
    near = {(a, b) for a, b in combinations(firsts, 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= similarity}
    classes = neardup.written_classes(docs, "doc_id", "text", 5, 1)
    assert sorted(r.rep for r in classes.collect()) == firsts
    kept = {r.rep for r in neardup.with_shared_prefix(classes, similarity).collect()}
    assert near and {x for p in near for x in p} <= kept
    assert not kept & set(range(len(texts) - 16, len(texts)))
    assert {(r.a_id, r.b_id) for r in neardup.similar_pairs(docs, k=5, stride=1, similarity=similarity).collect()} == near


def test_rows_that_share_an_id_or_have_none_are_told_apart(spark):
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(1, long), (1, long), (1, long + " y"), (2, long + " y"), (None, long), (None, "a b c d e f")]
    classes = neardup.written_classes(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 5, 1).collect()
    assert sorted((r.rep is None, r.rep or 0, r.n) for r in classes) == [(False, 1, 56), (False, 1, 57), (True, 0, 2)]
