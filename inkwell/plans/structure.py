"""Tokens, sentences, scripts, dialogue, chapters and word windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from inkwell.functions import lexicons as lx
from inkwell.functions import text as tx
from inkwell.plans import snippets as sq
from inkwell.plans.registry import query
from inkwell.storage import table


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query(
    "word_counts",
    f"""SELECT doc_id, len({sq.tokens('text')}) AS n_words, len({sq.alphabetic('text')}) AS n_alphabetic, len({sq.stripped_lower(sq.alphabetic('text'))}) AS n_stripped,
len(regexp_extract_all(text, '[A-Za-z'']+')) AS n_ascii, len(regexp_extract_all(lower(text), '[a-z0-9'']+')) AS n_overlap FROM documents""",
)
def word_counts(spark, sf_dir):
    """Words of each text by each of the tokenizers."""
    t = F.col("text")
    rows = _docs(spark, sf_dir).select("doc_id", "text", tx.alphabetic(tx.tokens(t)).alias("alpha"))
    return rows.select("doc_id", tx.word_count(t).alias("n_words"), tx.long_size(F.col("alpha")).alias("n_alphabetic"), tx.long_size(tx.stripped_lower(F.col("alpha"))).alias("n_stripped"), tx.long_size(tx.matches(t, "[A-Za-z']+")).alias("n_ascii"), tx.long_size(tx.matches(F.lower(t), "[a-z0-9']+")).alias("n_overlap"))


_ABBR = "Dr. Smith met Mr. Jones at no. 5. \"Yes!\" He left. i.e. Then vs. Them? Ok."
_ABBR_SQL = _ABBR.replace("'", "''")


@query("sentence_counts", f"SELECT doc_id, len({sq.sentences(f''' '{_ABBR_SQL}' || ' ' || text ''')}) AS n_sentences FROM documents")
def sentence_counts(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", tx.long_size(tx.sentences(F.concat(F.lit(_ABBR + " "), F.col("text")))).alias("n_sentences"))


@query("sentence_lengths", f"WITH s AS (SELECT doc_id, unnest({sq.sentences('text')}) AS s FROM documents) SELECT doc_id, count(*) AS n_sentences, sum(len({sq.tokens('s')}))::BIGINT AS n_words, max(len({sq.tokens('s')})) AS longest FROM s GROUP BY 1")
def sentence_lengths(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", F.transform(tx.sentences(F.col("text")), tx.word_count).alias("n")).where(F.size("n") > 0)
    return rows.select("doc_id", tx.long_size(F.col("n")).alias("n_sentences"), F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_words"), F.array_max("n").alias("longest"))


@query(
    "script_detection",
    f"""WITH c AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN repeat('Привет это текст ', 1 + length(text) // 60) || text ELSE text END AS t FROM documents),
n AS (SELECT doc_id, len(regexp_extract_all(t, '\\p{{L}}')) AS n, len(regexp_extract_all(t, '[Ѐ-ӿ]')) AS c, len(regexp_extract_all(t, '[A-Za-z]')) AS l FROM c)
SELECT doc_id, coalesce({sq.rounded('c / nullif(n, 0)', 4)}, 0.0) AS cyrillic_ratio, coalesce({sq.rounded('l / nullif(n, 0)', 4)}, 0.0) AS latin_ratio, coalesce(c / nullif(n, 0) >= 0.15, false) AS likely_non_english FROM n""",
)
def script_detection(spark, sf_dir):
    """Shares of letters by script; a third of the texts get a Cyrillic beginning in proportion to their length."""
    t = F.when(F.col("doc_id") % 3 == 0, F.concat(F.repeat(F.lit("Привет это текст "), (1 + F.floor(F.length("text") / 60)).cast("int")), F.col("text"))).otherwise(F.col("text"))
    rows = _docs(spark, sf_dir).select("doc_id", t.alias("t")).select("doc_id", *(F.regexp_count("t", F.lit(p)).alias(n) for n, p in (("n", r"\p{L}"), ("c", "[Ѐ-ӿ]"), ("l", "[A-Za-z]"))))
    share = lambda x: tx.ratio(F.col(x), F.col("n"))
    return rows.select("doc_id", tx.rounded(share("c"), 4).alias("cyrillic_ratio"), tx.rounded(share("l"), 4).alias("latin_ratio"), (share("c") >= lx.CYRILLIC_SHARE).alias("likely_non_english"))


@query(
    "dialogue_flags",
    f"""WITH l AS (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda s: CASE WHEN length(s) % 3 = 0 THEN '“' || s || '”' ELSE s END)) AS p FROM documents), t AS (SELECT doc_id, {sq.trimmed('p')} AS p FROM l)
SELECT doc_id, count(*) AS n_paragraphs, count(*) FILTER (left(p, 1) IN ({sq.quoted(lx.DIALOGUE_OPEN)})) AS n_start, count(*) FILTER (right(p, 1) IN ({sq.quoted(lx.DIALOGUE_CLOSE)})) AS n_end FROM t GROUP BY 1""",
)
def dialogue_flags(spark, sf_dir):
    """Lines that open or close with a quotation mark; every line whose length divides by three is quoted."""
    lines = F.transform(F.split("text", "\n"), lambda s: F.trim(F.when(F.length(s) % 3 == 0, F.concat(F.lit("“"), s, F.lit("”"))).otherwise(s), F.lit(" \t\r\n\f\x0b")))
    rows = _docs(spark, sf_dir).select("doc_id", lines.alias("p"))
    opens = F.filter("p", lambda s: F.substring(s, 1, 1).isin(*lx.DIALOGUE_OPEN))
    closes = F.filter("p", lambda s: F.right(s, F.lit(1)).isin(*lx.DIALOGUE_CLOSE))
    return rows.select("doc_id", tx.long_size(F.col("p")).alias("n_paragraphs"), tx.long_size(opens).alias("n_start"), tx.long_size(closes).alias("n_end"))


def _headed(line, pos):
    return F.when(pos % 4 == 0, F.concat(F.lit("Chapter "), line)).otherwise(line)


@query(
    "chapter_index",
    f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
p AS (SELECT doc_id, pos, CASE WHEN pos % 4 = 0 THEN 'Chapter ' || s ELSE s END AS s FROM l),
h AS (SELECT *, regexp_matches(s, '{lx.CHAPTER_HEADING}') AND len({sq.tokens('s')}) <= 10 AS head FROM p),
c AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS chapter FROM h),
k AS (SELECT *, lag(chapter) OVER (PARTITION BY doc_id ORDER BY pos) IS DISTINCT FROM chapter AS opens FROM c WHERE NOT head AND trim(s) <> '')
SELECT doc_id, count(*) AS n_paragraphs, count(DISTINCT chapter) AS n_chapters, count(*) FILTER (opens) AS n_boundaries FROM k GROUP BY 1""",
)
def chapter_index(spark, sf_dir):
    """Paragraphs (lines) by chapter: headings count up and are dropped; every fourth line gets a heading's word, and is one if it is short."""
    rows = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "s")).withColumn("s", _headed(F.col("s"), F.col("pos")))
    w = Window.partitionBy("doc_id").orderBy("pos")
    head = F.col("s").rlike(lx.CHAPTER_HEADING) & (tx.word_count(F.col("s")) <= 10)
    chapters = rows.withColumn("head", head).withColumn("chapter", F.sum(F.col("head").cast("int")).over(w)).where("not head and trim(s) <> ''")
    opens = ~F.lag("chapter").over(w).eqNullSafe(F.col("chapter"))
    return chapters.withColumn("opens", opens).groupBy("doc_id").agg(F.count("*").alias("n_paragraphs"), F.count_distinct("chapter").alias("n_chapters"), F.count_if("opens").alias("n_boundaries"))


@query("tumbling_word_windows", f"WITH w AS (SELECT doc_id, unnest({sq.tokens('text')}) AS w, generate_subscripts({sq.tokens('text')}, 1) - 1 AS pos FROM documents) SELECT doc_id, pos // 1000 AS win, count(*) AS n_words, sum(length(w))::BIGINT AS n_chars FROM w GROUP BY 1, 2 HAVING count(*) >= 10")
def tumbling_word_windows(spark, sf_dir):
    """Windows of a thousand words; those of fewer than ten are left out. Made by row, without a shuffle."""
    rows = _docs(spark, sf_dir).select("doc_id", tx.tokens(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.size("w"), F.lit(1000))
    wins = rows.select("doc_id", F.posexplode(F.transform(starts, lambda i: F.slice("w", i, F.lit(1000)))).alias("win", "w")).where(F.size("w") >= 10)
    return wins.select("doc_id", F.col("win").cast("long").alias("win"), tx.long_size(F.col("w")).alias("n_words"), F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("n_chars"))
