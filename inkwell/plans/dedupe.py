"""Fingerprints, exact and near duplicates, and overlap with a corpus."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from inkwell.functions.text import fingerprint, gram_set, hashes, long_size, rounded, tokens
from inkwell.operators import neardup, overlap
from inkwell.operators import overlap_index as index
from inkwell.operators.skew import join_groups
from inkwell.plans import snippets as sq
from inkwell.plans.registry import query
from inkwell.storage import materialize, shared_folder, table

_FP = f"sha256(regexp_replace(lower({sq.trimmed('text')}), '\\s+', ' ', 'g'))"


@query("text_fingerprints", f"SELECT doc_id, {_FP} AS fingerprint FROM documents")
def text_fingerprints(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fingerprint(F.col("text")).alias("fingerprint"))


@query("exact_duplicates", f"SELECT {_FP} AS fingerprint, count(*) AS n_docs, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark, sf_dir):
    prints = text_fingerprints(spark, sf_dir)
    return prints.groupBy("fingerprint").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_id")).where("n_docs > 1")


@query(
    "dedupe_keep_first",
    f"WITH f AS (SELECT source, doc_id, {_FP} AS fp FROM documents) SELECT source, count(*) AS n_texts, count(DISTINCT fp) AS n_kept, count(*) - count(DISTINCT fp) AS n_removed FROM f GROUP BY source",
)
def dedupe_keep_first(spark, sf_dir):
    """Texts of each source, those that stay when the first of equal ones does, and those removed."""
    rows = table(spark, sf_dir, "documents").select("source", fingerprint(F.col("text")).alias("fp"))
    per = rows.groupBy("source", "fp").agg(F.count("*").alias("n"))
    return per.groupBy("source").agg(F.sum("n").alias("n_texts"), F.count("*").alias("n_kept")).withColumn("n_removed", F.col("n_texts") - F.col("n_kept"))


@query(
    "leakage_check",
    f"WITH f AS (SELECT doc_id, source, {_FP} AS fp FROM documents) SELECT doc_id, EXISTS (SELECT 1 FROM f g WHERE g.fp = f.fp AND g.source = f.source AND g.doc_id <> f.doc_id) AS leaked FROM f",
)
def leakage_check(spark, sf_dir):
    """Whether a text, taken as new, already stands in the profile of its source."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", fingerprint(F.col("text")).alias("fp"))
    groups = materialize(rows.groupBy("source", "fp").agg(F.count("*").alias("n")), "leaks")
    return join_groups(rows, groups, ["source", "fp"], "n", "doc_id").select("doc_id", (F.col("n") > 1).alias("leaked"))


_GRAMS = f"""w AS (SELECT doc_id, {sq.tokens('lower(text)')} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 50 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 48, 25), lambda i: array_to_string(list_slice(w, i, i + 49), ' ')) END) AS g FROM w)"""


@query("shingle_counts", f"WITH {_GRAMS} SELECT w.doc_id, count(g) AS n_shingles FROM w LEFT JOIN s USING (doc_id) GROUP BY 1")
def shingle_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", tokens(F.lower("text")).alias("words"))
    rows = rows.select("doc_id", hashes(F.col("words")).alias("hashed"))
    return rows.select("doc_id", long_size(gram_set(F.col("hashed"), neardup.WORDS, neardup.STRIDE)).alias("n_shingles"))


_CLASSES = f"""{_GRAMS}, k AS (SELECT doc_id, md5(string_agg(g, '|' ORDER BY g)) AS k, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT min(doc_id) AS rep, any_value(n) AS n FROM k GROUP BY k), x AS (SELECT s.doc_id, g FROM s JOIN c ON c.rep = s.doc_id),
p AS (SELECT a.doc_id AS a_id, b.doc_id AS b_id, count(*) AS m FROM x a JOIN x b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2)"""


@query(
    "near_duplicate_pairs",
    f"WITH {_CLASSES} SELECT a_id, b_id, {sq.rounded('m / (a.n + b.n - m)')} AS jaccard FROM p JOIN c a ON a.rep = a_id JOIN c b ON b.rep = b_id WHERE m / (a.n + b.n - m) >= 0.6",
)
def near_duplicate_pairs(spark, sf_dir):
    """Pairs of near-duplicate classes of documents; near_duplicate_classes tells who is in a class."""
    found = neardup.similar_pairs(table(spark, sf_dir, "documents"))
    return found.select("a_id", "b_id", rounded(F.col("jaccard")).alias("jaccard"))


_FIVE = _CLASSES.replace("< 50", "< 5").replace("len(w) - 48, 25", "len(w) - 3, 1").replace("i + 49", "i + 4")


@query(
    "near_duplicate_pairs_5_words",
    f"WITH {_FIVE} SELECT a_id, b_id, {sq.rounded('m / (a.n + b.n - m)')} AS jaccard FROM p JOIN c a ON a.rep = a_id JOIN c b ON b.rep = b_id WHERE m / (a.n + b.n - m) >= 0.8",
)
def near_duplicate_pairs_5_words(spark, sf_dir):
    """The same with five-word shingles at every word and a similarity of 0.8."""
    found = neardup.similar_pairs(table(spark, sf_dir, "documents"), k=5, stride=1, similarity=0.8)
    return found.select("a_id", "b_id", rounded(F.col("jaccard")).alias("jaccard"))


@query("near_duplicate_classes", f"WITH {_GRAMS}, k AS (SELECT doc_id, md5(string_agg(g, '|' ORDER BY g)) AS k FROM s GROUP BY 1) SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS rep FROM k")
def near_duplicate_classes(spark, sf_dir):
    return neardup.memberships(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "rep")


@query(
    "near_dup_max",
    f"""WITH {_CLASSES}, j AS (SELECT a_id, b_id, m / (a.n + b.n - m) AS jaccard FROM p JOIN c a ON a.rep = a_id JOIN c b ON b.rep = b_id WHERE m / (a.n + b.n - m) >= 0.6)
SELECT rep AS doc_id, {sq.rounded('max(jaccard)')} AS near_dup_ratio FROM c JOIN j ON rep IN (a_id, b_id) GROUP BY rep""",
)
def near_dup_max(spark, sf_dir):
    """The greatest similarity of each class that has a near duplicate."""
    pairs = neardup.similar_pairs(table(spark, sf_dir, "documents"))
    both = pairs.select(F.explode(F.array("a_id", "b_id")).alias("doc_id"), "jaccard")
    return both.groupBy("doc_id").agg(rounded(F.max("jaccard")).alias("near_dup_ratio"))


def _sampled(table_name: str, key: str) -> str:
    return f"""(SELECT id, unnest(list_transform(range(1, len(w) - 6), lambda i: md5(array_to_string(list_slice(w, i, i + 7), ' ')))) AS gram
FROM (SELECT {key} AS id, regexp_extract_all(lower(text), '[a-z0-9'']+') AS w FROM {table_name}) WHERE len(w) >= 8)"""


_KEEP = "('0x' || substr(gram, 1, 4))::INTEGER % 4 = 0"
_OVER = f"d AS (SELECT id AS chunk, gram FROM {_sampled('documents', 'doc_id')} WHERE {_KEEP}), q AS (SELECT id, gram FROM {_sampled('benchmark', 'item_id')} WHERE {_KEEP}), i AS (SELECT DISTINCT gram, chunk FROM d)"


@query(
    "benchmark_overlap",
    f"""WITH {_OVER}, c AS (SELECT id, count(*) AS positions, count(*) FILTER (gram IN (SELECT gram FROM i)) AS hits FROM q GROUP BY id)
SELECT item_id, coalesce(positions, 0) AS positions, coalesce(hits, 0) AS hits, coalesce({sq.rounded('100.0::DOUBLE * hits / positions', 1)}, 0.0) AS percent FROM benchmark LEFT JOIN c ON id = item_id""",
)
def benchmark_overlap(spark, sf_dir):
    """How much of each benchmark item stands in the documents."""
    index = overlap.build_index(table(spark, sf_dir, "documents"), queries=table(spark, sf_dir, "benchmark"))
    return overlap.overlap(index, table(spark, sf_dir, "benchmark"), "item_id", "text").withColumnRenamed("id", "item_id")


@query(
    "benchmark_overlap_top5",
    f"""WITH {_OVER}, t AS (SELECT id, count(*) AS positions FROM q GROUP BY id), c AS (SELECT id, chunk, count(*) AS n FROM q JOIN i USING (gram) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, chunk) AS rank FROM c)
SELECT id AS item_id, chunk, n, {sq.rounded('100.0::DOUBLE * n / positions', 1)} AS percent, rank FROM r JOIN t USING (id) WHERE rank <= 5""",
)
def benchmark_overlap_top5(spark, sf_dir):
    index = overlap.build_index(table(spark, sf_dir, "documents"), queries=table(spark, sf_dir, "benchmark"))
    return overlap.top_sources(index, table(spark, sf_dir, "benchmark"), "item_id", "text").withColumnRenamed("id", "item_id")


@query("overlap_index_stats", f"WITH {_OVER} SELECT (SELECT count(*) FROM d) AS n_positions, count(*) AS n_entries, count(DISTINCT gram) AS n_grams, count(DISTINCT chunk) AS n_chunks FROM i")
def overlap_index_stats(spark, sf_dir):
    grams = overlap.sampled_grams(table(spark, sf_dir, "documents"), "doc_id", "text")
    entries = grams.groupBy("gram", "id").agg(F.count("*").alias("m"))
    return entries.agg(F.sum("m").alias("n_positions"), F.count("*").alias("n_entries"), F.count_distinct("gram").alias("n_grams"), F.count_distinct("id").alias("n_chunks"))


_WRAP = "18446744073709551616::UHUGEINT"
# The rolling hash in SQL: CRC-32 of each distinct word by eight steps a byte, the sum of codes times powers that wraps at 64 bits, and the mixing.
_HASHED = f"""texts AS (SELECT 'd' AS side, doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9'']+') AS w FROM documents UNION ALL SELECT 'q', item_id, regexp_extract_all(lower(text), '[a-z0-9'']+') FROM benchmark),
placed AS (SELECT side, id, unnest(w) AS word, unnest(range(0, len(w))) AS pos FROM texts),
crc AS (SELECT word, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(word, ''), lambda c: list_concat([ascii(c)::BIGINT], [-1::BIGINT, -1, -1, -1, -1, -1, -1])))),
  lambda s, x: CASE WHEN x < 0 THEN xor(s >> 1, 3988292384 * (s & 1)) ELSE xor(xor(s, x) >> 1, 3988292384 * (xor(s, x) & 1)) END), 4294967295::BIGINT) AS code FROM (SELECT DISTINCT word FROM placed)),
coded AS (SELECT side, id, pos, list(code) OVER (PARTITION BY side, id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS codes FROM placed JOIN crc USING (word)),
rolled AS (SELECT side, id, pos, list_reduce(list_transform(codes, lambda c: c::UHUGEINT), lambda h, c: (h * {index.ROLL}::UHUGEINT + c) % {_WRAP}) AS h FROM coded WHERE len(codes) = 8),
half AS (SELECT side, id, pos, (xor(h, h >> 29) * {index.MIX}::UHUGEINT) % {_WRAP} AS h FROM rolled), grams AS (SELECT side, id, xor(h, h >> 32) AS gram FROM half WHERE xor(h, h >> 32) % 4 = 0),
i AS (SELECT DISTINCT gram, id AS chunk FROM grams WHERE side = 'd'), q AS (SELECT id, gram FROM grams WHERE side = 'q')"""


def _looked_up(spark, sf_dir):
    """What an index of all documents, written and kept, knows of the benchmark's grams."""
    path = f"{shared_folder(spark)}/inkwell-overlap-{uuid.uuid4().hex}"
    index.write(index.entries(table(spark, sf_dir, "documents")), path, 16)
    return index.lookup(spark, path, index.hashed_grams(table(spark, sf_dir, "benchmark"), "item_id", "text"))


@query(
    "kept_index_overlap",
    f"""WITH {_HASHED}, c AS (SELECT id, count(*) AS positions, count(*) FILTER (gram IN (SELECT gram FROM i)) AS hits FROM q GROUP BY id)
SELECT item_id, coalesce(positions, 0) AS positions, coalesce(hits, 0) AS hits, coalesce({sq.rounded('100.0::DOUBLE * hits / positions', 1)}, 0.0) AS percent FROM benchmark LEFT JOIN c ON id = item_id""",
)
def kept_index_overlap(spark, sf_dir):
    """How much of each benchmark item stands in the documents, by the rolling hash and an index that is kept."""
    return overlap.overlap(_looked_up(spark, sf_dir), table(spark, sf_dir, "benchmark"), "item_id", "text", sample=index.hashed_grams).withColumnRenamed("id", "item_id")


@query(
    "kept_index_top5",
    f"""WITH {_HASHED}, t AS (SELECT id, count(*) AS positions FROM q GROUP BY id), c AS (SELECT id, chunk, count(*) AS n FROM q JOIN i USING (gram) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, chunk) AS rank FROM c)
SELECT id AS item_id, chunk, n, {sq.rounded('100.0::DOUBLE * n / positions', 1)} AS percent, rank FROM r JOIN t USING (id) WHERE rank <= 5""",
)
def kept_index_top5(spark, sf_dir):
    return overlap.top_sources(_looked_up(spark, sf_dir), table(spark, sf_dir, "benchmark"), "item_id", "text", sample=index.hashed_grams).withColumnRenamed("id", "item_id")


@query("latest_per_source", "SELECT source, doc_id, rank FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS rank FROM documents) WHERE rank <= 5")
def latest_per_source(spark, sf_dir):
    """The five newest texts of each source."""
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("doc_id")))
    return table(spark, sf_dir, "documents").select("source", "doc_id", rank.cast("long").alias("rank")).where("rank <= 5")
