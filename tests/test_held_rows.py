"""What tasks hold of a batch: texts are worked on some at a time, whatever the size of the batch."""

import unicodedata

import pyarrow as pa

from inkwell.functions import unicode
from inkwell.operators import chunking, overlap_index


def test_texts_are_composed_some_at_a_time(monkeypatch):
    asked, whole = [], unicode._composed
    monkeypatch.setattr(unicode, "_composed", lambda part: asked.append(len(part)) or whole(part))
    texts = ["é", None, "", "plain", "Å"] * 100
    assert unicode.composed.func(pa.array(texts)).to_pylist() == [t and unicodedata.normalize("NFC", t) for t in texts]
    assert max(asked) == unicode.ROWS and sum(asked) == len(texts)
    assert unicode.composed.func(pa.array([], pa.string())).to_pylist() == []


def test_chunks_and_windows_are_passed_on_some_texts_at_a_time(spark, monkeypatch):
    ran = []

    def kept(self, run, schema):
        ran.append(run)
        return whole(self, run, schema)

    whole = type(spark.range(1)).mapInArrow
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", kept)
    docs = spark.createDataFrame([(1, "a text")], "doc_id long, text string")
    chunking.chunk_records(docs)
    chunking.spans(docs, "window")
    n = 3 * chunking.ROWS + 1
    texts = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(["One line here.\nAnother line."] * n)], names=["id", "t"])
    sents = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([["word " * 70]] * n)], names=["id", "s"])
    for run, batch in zip(ran, (texts, sents)):
        got = list(run([batch]))
        assert [b.num_rows for b in got] == [chunking.ROWS] * 3 + [1]
        assert [x for b in got for x in b.column(0).to_pylist()] == list(range(n))


def test_grams_are_made_some_texts_at_a_time(spark, monkeypatch):
    sizes, whole = [], overlap_index.gram_hashes
    monkeypatch.setattr(overlap_index, "gram_hashes", lambda codes: sizes.append(len(codes)) or whole(codes))
    ran, spread = [], type(spark.range(1)).mapInArrow
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda self, run, schema: ran.append(run) or spread(self, run, schema))
    overlap_index.hashed_grams(spark.createDataFrame([(1, "a text")], "id long, text string"), "id", "text")
    n, codes = 2 * overlap_index.ROWS + 5, list(range(100, 120))
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([[c + k for c in codes] for k in range(n)], pa.list_(pa.int64()))], names=["id", "codes"])
    got = {(i, p, g) for b in ran[0]([batch]) for i, p, g in zip(*(c.to_pylist() for c in b.columns))}
    one = {(i, p, g) for k in range(n) for b in ran[0]([batch.slice(k, 1)]) for i, p, g in zip(*(c.to_pylist() for c in b.columns))}
    assert got == one and got
    assert sizes[:3] == [20 * overlap_index.ROWS] * 2 + [20 * 5]
