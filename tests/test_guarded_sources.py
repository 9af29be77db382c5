"""Error tables beside rows, trusted folders, the compacted store, and the sinks of texts and reports."""

import json
import os

import pytest
from pyspark.sql import functions as F

from inkwell.sources import corpus, guarded, sinks


def test_lines_are_rows_or_errors(spark, tmp_path):
    good = [{"author": "a", "book": "b", "chunk_id": str(k), "text": f"text {k}", "word_count": 2} for k in range(20)]
    lines = [json.dumps(g) for g in good] + ["{not json", '{"author": "a", "text": "t", "word_count": "many"}', '{"author": "a", "book": "b", "chunk_id": "x"}', "[1, 2", "", json.dumps({"text": "new", "scale": "small", "other": 1})]
    (tmp_path / "c.jsonl").write_text("\n".join(lines))
    rows, errors = guarded.chunks_with_errors(spark, str(tmp_path / "c.jsonl"))
    guarded.write_with_errors(rows, errors, str(tmp_path / "out"))
    kept, lost = spark.read.parquet(str(tmp_path / "out/rows")), spark.read.parquet(str(tmp_path / "out/errors"))
    assert kept.count() + lost.count() == len([x for x in lines if x]) and kept.count() == 21
    assert sorted((r.kind, r.detail) for r in lost.collect()) == sorted([("corrupt", lines[20]), ("corrupt", lines[21]), ("no text", "a::b::x"), ("corrupt", lines[23])])
    assert {r.scale for r in kept.collect()} == {"large", "small"} and all(r.source.endswith("c.jsonl") for r in lost.collect())


def test_files_are_books_or_errors(spark, tmp_path):
    files = {"ann/one.txt": b"A text.\r\nMore.", "ann/two.txt": b"", "bob/three.txt": b" \n\t", "bob/four.txt": b"%PDF-1.4 x", "bob/fi ve%20.txt": b"caf\xe9", "_no/six.txt": b"x", "bob/zip.txt": b"PK\x03\x04zz"}
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    rows, errors = guarded.books_with_errors(spark, str(tmp_path))
    assert sorted((r.author, r.book, r.text) for r in rows.collect()) == [("ann", "one", "A text.\nMore."), ("bob", "fi ve%20", "café")]
    assert sorted((r.source.rsplit("/", 1)[1], r.kind, r.detail) for r in errors.collect()) == [("four.txt", "not text", "not text: pdf"), ("three.txt", "empty", "empty"), ("two.txt", "empty", "empty"), ("zip.txt", "not text", "not text: unknown")]
    ups = corpus.extract_uploads(spark.createDataFrame([("a.txt", bytearray(b"words")), ("b.pdf", bytearray(b"%PDF-1.4"))], "path string, content binary"))
    assert [tuple(r) for r in guarded.upload_errors(ups).collect()] == [("b.pdf", "upload", "unsupported: pdf")]


def test_models_come_from_trusted_folders_alone(spark, tmp_path):
    inside, outside = tmp_path / "models", tmp_path / "models2"
    inside.mkdir(), outside.mkdir()
    os.symlink(outside, inside / "link")
    seen = []
    load = lambda session, path: seen.append(path) or path
    assert guarded.load_trusted(load, spark, str(inside / "m"), str(inside)) == str(inside / "m")
    assert guarded.trusted(spark, f"file:{inside}", str(inside))
    for bad in (outside, inside / ".." / "models2", inside / "link" / "m", tmp_path):
        with pytest.raises(guarded.UntrustedPath):
            guarded.load_trusted(load, spark, str(bad), str(inside))
    assert seen == [str(inside / "m")]


def _files(path):
    return [os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")]


def test_store_is_compacted_and_read_in_order(spark, tmp_path):
    path, packed = str(tmp_path / "store"), str(tmp_path / "packed")
    for k in range(3):
        texts = spark.range(k * 40, k * 40 + 40).select(F.concat(F.lit("c"), (F.col("id") % 3).cast("string")).alias("candidate"), F.col("id").cast("string").alias("text"))
        sinks.append_texts(texts.repartition(6), path, "candidate")
    sinks.compact_store(spark, path, packed)
    with pytest.raises(ValueError):
        sinks.compact_store(spark, path, path + "/")
    whole = lambda p: sorted((r.candidate, r.id, r.text, r.added_at) for r in sinks.read_store(spark, p).collect())
    assert whole(path) == whole(packed) and len(whole(path)) == 120 and len(_files(packed)) < len(_files(path))
    got = sinks.texts_of(spark, packed, "c1", 30, 90)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(candidate" in plan and "GreaterThanOrEqual(id,30)" in plan and "LessThanOrEqual(id,90)" in plan
    ids = [r.id for r in got.collect()]
    assert ids == sorted(i for c, i, _, _ in whole(path) if c == "c1" and 30 <= i <= 90)


def test_sinks_of_texts_and_reports(spark, tmp_path):
    chunks = spark.createDataFrame([("ann", "b1", "0", "one\ntwo"), ("ann", "b1", "1", "three"), ("bob", "b2", "0", "four")], "author string, book string, chunk_id string, text string")
    sinks.write_chunk_texts(chunks, str(tmp_path / "texts"))
    assert sorted((r.author, r.value) for r in spark.read.text(str(tmp_path / "texts")).collect()) == [("ann", "one\\ntwo"), ("ann", "three"), ("bob", "four")]
    sinks.write_reports(chunks.select("author", "book").distinct(), chunks.limit(0).select("author"), str(tmp_path / "reports"))
    assert spark.read.json(str(tmp_path / "reports/quality_report")).count() == 2 and os.path.isdir(tmp_path / "reports/duplicates_report")
    index = spark.createDataFrame([(f"{k:04x}", k) for k in range(200)], "gram string, chunk long")
    sinks.write_index(index, str(tmp_path / "index"), 4)
    back = spark.read.parquet(str(tmp_path / "index"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, index.collect())) and len(_files(tmp_path / "index")) == 4
