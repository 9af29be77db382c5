"""Spelling variants, periodic runs and byte-level BPE against brute force and the library, on odd rows too."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.llm import byte_bpe, queries, runs, spelling

ODD = [(1, "", "a"), (2, None, None), (None, "some text here", "a"), (4, "Some Text here", "b"), (4, "Some Text here", "b"), (5, " \t\n ", "b"), (6, "long " * 20_000, "a"), (7, "😀 naïve K▁x <|endoftext|>", None), (8, "x" * 30_000, "a")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, ties, repeated rows, empty and long texts, and columns whose names clash with inner ones."""
    clash = {c: F.lit("x") for c in ("id", "ids", "word", "n", "runs", "best", "key", "digest", "decoded")}
    return spark.createDataFrame(ODD, "doc_id long, text string, source string").withColumns(clash)


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def at_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    c = 0
    while c < len(a) and a[c] == b[c]:
        c += 1
    return a != b and (len(b) == len(a) and a[c + 1 :] == b[c + 1 :] or len(b) == len(a) + 1 and a[c:] == b[c + 1 :])


def plain_variants(counts):
    near = {w: [v for v in counts if abs(len(v) - len(w)) < 2 and at_one(v, w)] for w in counts}
    form = {w: b for w in counts if near[w] and counts[b := min(near[w], key=lambda v: (-counts[v], v))] >= 5 * counts[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), n, len(near[w]), counts[form[w]] if w in form else None) for w, n in counts.items()}


def as_map(df):
    rows = df.collect()
    found = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(rows) == len(found)
    return found


def test_op11_against_brute_force(spark, sf_dir, texts):
    counts = Counter()
    for i, text in texts.items():
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    want = plain_variants({w: n for w, n in counts.items() if len(w) >= 6 and n >= 5})
    assert as_map(queries.QUERIES["op11_spelling_variants"](spark, sf_dir)) == want and any(w[0] for w in want.values())


@pytest.mark.parametrize("most", [2, 40, 8192])
def test_near_words_of_small_and_halved_groups(spark, monkeypatch, most):
    """All pairs once each way, whatever the size of tries: words of one letter, of many, of one beginning, of two letters only."""
    monkeypatch.setattr(spelling, "TRIE_WORDS", most)
    random.seed(3)
    words = {"".join(random.choice("abé") for _ in range(random.randint(1, 9))) for _ in range(400)} | {"same" + "".join(random.choice("xyz") for _ in range(4)) for _ in range(60)} | {"x" * 9000, "x" * 8999}
    got = [(r.word, r.near) for r in spelling.near_pairs(spark.createDataFrame([(w, 1, "c") for w in words], "word string, n long, key string")).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in words for b in words if abs(len(a) - len(b)) < 2 and at_one(a, b)}


def test_chains_of_forms_and_odd_words(spark, odd):
    counts = {"colour": 1, "color": 5, "colors": 30, "colores": 200, "cologes": 1000, "cat": 7, "bat": 7, "": 3}
    df = spark.createDataFrame([(w, n) for w, n in counts.items()] + [(None, 4)], "word string, n long")
    got = as_map(spelling.variants(df.where("word <> ''")))
    assert got == plain_variants({w: n for w, n in counts.items() if w}) and got["colour"][1] == "cologes" and got["colour"][0] == "color"
    assert spelling.near_pairs(df).where("word is null or near = ''").count() == 0
    assert spelling.variants(df.limit(0)).count() == 0 and spelling.word_counts(odd.limit(0)).count() == 0
    words = {r.word: r.n for r in spelling.word_counts(odd, altered_by=1, least_letters=4).collect()}
    assert words.pop("x" * 29_999) == 1 and words["some"] == words["text"] == words["here"] == 1  # the row without id is not altered
    assert {r.word: r.n for r in spelling.word_counts(odd, least_letters=4).collect()} == {"some": 3, "text": 3, "here": 3, "long": 20_000, "naïve": 1, "endoftext": 1, "x" * 30_000: 1}


def plain_runs(words):
    out = []
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            piece = words[i : j + q]
            if len(piece) >= max(6, 4 * q) and not any(piece[p:] == piece[:-p] for p in range(1, q)):
                out.append((i, len(piece), q))
            i = j + 1
    return sorted(out)


@pytest.mark.parametrize("short", [1, 4, 64])
def test_runs_against_brute_force(monkeypatch, short):
    """Texts of few and many words with loops of all sizes, with all lags tried and with blocks that choose them."""
    monkeypatch.setattr(runs, "SHORT_LAGS", short)
    random.seed(5)
    for _ in range(600):
        n, k = random.randint(0, 150), random.choice([1, 2, 3, 40])
        words = [str(random.randrange(k)) for _ in range(n)]
        for _ in range(random.randint(0, 3) if n > 8 else 0):
            a, p = random.randrange(n - 4), random.randint(1, max(1, n // 5))
            for i in range(a, min(n, a + random.randint(4, n))):
                words[i] = words[a + (i - a) % p]
        assert runs.periodic_runs(words) == plain_runs(words)


def test_runs_of_very_long_texts():
    random.seed(6)
    noise = [str(random.randrange(10**9)) for _ in range(100_000)]
    assert runs.periodic_runs(["a"] * 200_000) == [(0, 200_000, 1)]
    assert runs.periodic_runs(["a", "b"] * 50_000 + ["c"] + ["a", "b"] * 50_000) == [(0, 100_000, 2), (100_001, 100_000, 2)]
    assert runs.periodic_runs(noise[:20_000] * 5 + noise) == [(0, 120_000, 20_000)] and runs.periodic_runs(noise) == []


def test_op12_against_brute_force(spark, sf_dir, texts):
    got = {r.doc_id: r for r in queries.QUERIES["op12_periodic_runs"](spark, sf_dir).collect()}
    assert set(got) == set(texts)
    looped = 0
    for i, text in texts.items():
        words = re.findall("[^\x20\x09-\x0d]+", text or "")
        n, h = len(words), zlib.crc32(str(i).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (k - a) % p] for k in range(a, n)]
        found = plain_runs(words)
        best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        gone = {k for s, m, q in found for k in range(s + q, s + m)}
        r, looped = got[i], looped + bool(found)
        assert r.n_runs == len(found) and (r.start, r.length, r.period) == (best or (None,) * 3)
        assert r.exponent_milli == (best and 1000 * best[1] // best[2])
        assert r.runs_sha256 == hashlib.sha256("".join("%d,%d,%d\n" % x for x in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(w for k, w in enumerate(words) if k not in gone).encode()).hexdigest()
    assert looped > 5


def test_runs_of_odd_rows(odd):
    got = runs.find_runs(odd).collect()
    assert len(got) == len(ODD) and [r.n_words for r in got if r.id in (1, 2, 5)] == [0, 0, 0]
    long = next(r for r in got if r.id == 6)
    assert tuple(long.best) == (0, 20_000, 1) and long.collapsed == "long"
    assert {r.collapsed for r in got if r.id in (1, 2, 5)} == {""} and all(r.best is None for r in got if r.id != 6)
    assert runs.find_runs(odd.limit(0)).count() == 0
    assert runs.strongest([(0, 10, 3), (5, 20, 6), (9, 8, 2)]) == (9, 8, 2)


@pytest.fixture(scope="module")
def library():
    import tiktoken

    vocab = byte_bpe.Ranks.load()
    return vocab, tiktoken.Encoding("own", pat_str=vocab.pattern, mergeable_ranks=vocab.ranks, special_tokens={})


@pytest.mark.parametrize("segment, leaf", [(1, 2), (3, 32), (7, 2), (1 << 16, 3)])
def test_tree_of_parts_against_the_library(library, monkeypatch, segment, leaf):
    vocab, encoding = library
    monkeypatch.setattr(byte_bpe, "SEGMENT", segment)
    monkeypatch.setattr(byte_bpe, "LEAF_BYTES", leaf)
    random.seed(7)
    for _ in range(250):
        letters = random.choice(["x", "ab", "aA' \n1", "'ll're \t", "é😀a ", "the in er", "0 1\n\n "])
        text = "".join(random.choice(letters) for _ in range(random.choice([1, 5, 40, 100, 400])))
        ids = vocab.encode_batch([text])[0].tolist()
        assert ids == encoding.encode_ordinary(text) and vocab.decode(ids) == text.encode()


def test_matches_of_every_character(library):
    vocab, encoding = library
    for lo in range(0, 0x110000, 512):
        text = "".join(f"a{c}a 1{c}1 !{c}! {c}{c} x{c}\n{c}y" for c in map(chr, range(lo, lo + 512)) if not 0xD800 <= ord(c) < 0xE000)
        if lo < 0x3000 or lo % 8192 == 0:
            assert vocab.encode_batch([text])[0].tolist() == encoding.encode_ordinary(text)


def test_every_token_codes_itself(library):
    vocab, _ = library
    assert all(vocab.merged(raw) == [rank] for raw, rank in vocab.ranks.items())  # what joining rests on


def test_op13_against_the_library(spark, sf_dir, texts, library):
    _, encoding = library
    got = {r.doc_id: r for r in queries.QUERIES["op13_byte_bpe"](spark, sf_dir).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        ids = np.array(encoding.encode_ordinary(text or ""), "<u4")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())


def test_bpe_of_odd_rows(spark, odd, library):
    _, encoding = library
    coded = byte_bpe.encode(odd)
    got = coded.collect()
    assert len(got) == len(ODD) and sorted(r.ids for r in got) == sorted(encoding.encode_ordinary(t or "") for _, t, _ in ODD)
    back = byte_bpe.decode(coded).collect()
    assert sorted(bytes(r.decoded) for r in back) == sorted((t or "").encode() for _, t, _ in ODD) and set(back[0].asDict()) == {"id", "n_tokens", "digest", "decoded"}
    assert byte_bpe.decode(coded.limit(0)).count() == byte_bpe.encode(odd.limit(0)).count() == 0
    assert byte_bpe.decode(spark.createDataFrame([(1, None), (2, []), (3, [255])], "id long, ids array<int>")).collect()[0].decoded is None
