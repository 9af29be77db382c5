"""Counts of terms in tasks: equal to plain ones, and no dearer than the different terms that there are."""

import random
from collections import Counter

import pyarrow as pa
import pytest

from inkwell.operators import tfidf

TEXTS = ["banana bandana banana", "", None, "a\x00 \x00b na\U0001F600na", "漢字漢字 ana", "banana"]


class Asked(dict):
    times = 0

    def setdefault(self, *given):
        self.times += 1
        return super().setdefault(*given)


def plain_grams(text):
    padded = [f" {t} " for t in (text or "").split(" ") if t]
    return [w[o : o + n] for w in padded for n in range(2, 6) for o in range(len(w) - n + 1)]


def test_grams_are_cut_out_once_a_set_of_rows_not_once_a_token():
    lists = pa.array([None if t is None else [w for w in t.split(" ") if w] for t in TEXTS])
    held = tfidf.GramSums()
    held.numbers = Asked()
    held.add(lists)
    df, cf = (Counter(g for t in TEXTS for g in of(plain_grams(t))) for of in (set, list))
    assert {t: (d, c) for t, d, c in zip(*(x.to_pylist() for x in held.sums()))} == {t: (df[t], cf[t]) for t in cf}
    assert held.numbers.times == len(cf)
    known = {t: k for k, t in enumerate(sorted(cf))}
    found = {(lo + r, k): n for lo, _, rows, numbers, times in tfidf.KnownTerms("char", known).count(lists) for r, k, n in zip(rows.tolist(), numbers.tolist(), times.tolist())}
    assert found == {(r, known[g]): n for r, t in enumerate(TEXTS) for g, n in Counter(plain_grams(t)).items()}


def chosen(texts, most, share):
    split = [(t or "").split() for t in texts]
    terms = [w + [f"{a} {b}" for a, b in zip(w, w[1:])] for w in split]
    df, cf = (Counter(g for t in terms for g in of(t)) for of in (set, list))
    return set(sorted((t for t in cf if 2 <= df[t] <= share * len(texts)), key=lambda t: (-cf[t], t))[:most])


@pytest.mark.parametrize("most", [6, 40, 5000])
def test_pairs_of_words_are_counted_only_where_they_may_be_chosen(spark, monkeypatch, most):
    draw = random.Random(3)
    texts = [" ".join(draw.choice(["in", "of", *(f"w{int(60 * draw.random() ** 3)}" for _ in range(3))]) for _ in range(draw.randint(0, 60))) for _ in range(50)] + ["", None, "in of", "\U0001F600漢字 in"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    expected = chosen(texts, most, tfidf.WORD[1])
    assert {r.term for r in tfidf.vocabulary(docs, "word", most=most).collect()} == expected
    monkeypatch.setattr(tfidf, "term_sums", None)
    assert {r.term for r in tfidf.vocabulary(docs, "word", most=most).collect()} == expected
    sums = tfidf.common_terms(docs, "text", most, tfidf.WORD[1], len(texts)).collect()
    every = {f"{a} {b}" for t in texts for a, b in zip((t or "").split(), (t or "").split()[1:])}
    assert most > 6 or sum(" " in r.term for r in sums) < len(every) / 4


def test_too_many_words_as_rare_as_the_last_are_counted_with_all_their_pairs(spark, monkeypatch):
    texts = ["a1 b1 c1 a1 b1", "a1 b1 c1", "c1 b1"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    monkeypatch.setattr(tfidf, "PAIRED_WORDS", 1)
    assert {r.term for r in tfidf.vocabulary(docs, "word", most=4).collect()} == chosen(texts, 4, tfidf.WORD[1])
