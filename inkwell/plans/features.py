"""Measures of each document, and counts of the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.functions import lexicons as lx
from inkwell.functions import text as tx
from inkwell.operators import stylometry as st
from inkwell.plans import snippets as sq
from inkwell.plans.registry import query
from inkwell.storage import table


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _rounded(df, id_col="doc_id", places=6):
    return df.select(*(tx.rounded(F.col(c), places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


_STYLE = f"""w AS (SELECT doc_id, text, {sq.alphabetic('text')} AS words, {sq.sentences('text')} AS s, list_filter(string_split(text, chr(10) || chr(10)), lambda p: trim(p, ' ' || chr(9) || chr(10) || chr(13)) <> '') AS paras FROM documents),
l AS (SELECT *, {sq.stripped_lower('words')} AS lo, list_transform(s, lambda x: len({sq.tokens('x')})::DOUBLE) AS sent, greatest(len(words), 1) AS n, greatest(len(s), 1) AS ns, greatest(len(paras), 1) AS np FROM w),
m AS (SELECT *, list_transform(lo, lambda x: length(x)::DOUBLE) AS wl, CASE WHEN len(sent) > 0 THEN sent ELSE [n::DOUBLE] END AS sl FROM l)"""
_STYLE_COLS = {
    "avg_sentence_len": "list_avg(sl)", "std_sentence_len": "list_stddev_pop(sl)", "avg_word_len": "coalesce(list_avg(wl), 0.0)", "std_word_len": "coalesce(list_stddev_pop(wl), 0.0)",
    "ttr": "len(list_distinct(lo)) / n", "hapax_ratio": "coalesce(len(list_filter(map_values(list_histogram(lo)), lambda c: c = 1)), 0) / n", "avg_paragraph_len_words": "n / np", "sentences_per_paragraph": "ns / np",
    "dialogue_paragraph_ratio": f"len(list_filter(paras, lambda p: left(trim(p, ' ' || chr(9) || chr(10) || chr(13)), 1) IN ({sq.quoted(lx.DIALOGUE_OPEN)}))) / np",
    **{f"{name}_per_100w": f"100.0::DOUBLE * {sq.occurrences('text', mark)} / n" for name, mark in st.RATES},
    "capitalized_word_ratio": "len(list_filter(words, lambda x: regexp_matches(x, '^\\p{Lu}'))) / n", "long_word_ratio": "len(list_filter(lo, lambda x: length(x) >= 7)) / n", "short_word_ratio": "len(list_filter(lo, lambda x: length(x) <= 3)) / n",
}


@query("stylometry", f"WITH {_STYLE} SELECT doc_id, {', '.join(f'{sq.rounded(x, 5)} AS {c}' for c, x in _STYLE_COLS.items())} FROM m")
def stylometry(spark, sf_dir):
    return _rounded(st.stylometry(_docs(spark, sf_dir)), places=5)


@query(
    "function_word_rates",
    f"""WITH w AS (SELECT doc_id, {sq.alphabetic('text')} AS words FROM documents), x AS (SELECT doc_id, greatest(len(words), 1) AS n, unnest({sq.stripped_lower('words')}) AS word FROM w)
SELECT doc_id, word, {sq.rounded('1000.0::DOUBLE * count(*) / any_value(n)')} AS per_1000 FROM x WHERE word IN ({sq.quoted(lx.FUNCTION_WORDS)}) GROUP BY 1, 2""",
)
def function_word_rates(spark, sf_dir):
    return _rounded(st.function_words(_docs(spark, sf_dir)))


@query(
    "function_word_share",
    f"""WITH x AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z'']+') AS t FROM documents)
SELECT doc_id, len(t) AS n_tokens, {sq.rounded(f"len(list_filter(t, lambda w: w IN ({sq.quoted(lx.FUNCTION_WORDS)}))) / greatest(len(t), 1)")} AS share FROM x""",
)
def function_word_share(spark, sf_dir):
    """The share of function words among runs of letters and apostrophes."""
    rows = _docs(spark, sf_dir).select("doc_id", tx.matches(F.lower("text"), "[a-z']+").alias("t"))
    known = F.size(F.filter("t", lambda w: w.isin(*lx.FUNCTION_WORDS)))
    return rows.select("doc_id", tx.long_size(F.col("t")).alias("n_tokens"), tx.rounded(known / F.greatest(F.size("t"), F.lit(1))).alias("share"))


_TEXT = "text"


@query("punctuation_rates", "SELECT doc_id, " + ", ".join(f"{sq.rounded(f'1000.0::DOUBLE * {sq.occurrences(_TEXT, p)} / greatest(length(text), 1)')} AS p{k}" for k, p in enumerate(lx.PUNCTUATION)) + " FROM documents")
def punctuation_rates(spark, sf_dir):
    """Marks per thousand characters, in the order of the list."""
    n = F.greatest(F.length("text"), F.lit(1))
    return _docs(spark, sf_dir).select("doc_id", *(tx.rounded(1000.0 * tx.occurrences(F.col("text"), p) / n).alias(f"p{k}") for k, p in enumerate(lx.PUNCTUATION)))


def ocr(rows: str) -> str:
    """CTEs that end with o, the scan figures of rows (doc_id, text)."""
    return f"""ot AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z'']+') AS tok FROM {rows}),
oc AS (SELECT doc_id, len(tok) AS n, len(list_filter(tok, lambda t: (length(t) >= 4 AND NOT regexp_matches(t, '[aeiouAEIOU]')) OR (regexp_matches(t, '[A-Z][a-z]*[A-Z]') AND length(t) > 3))) AS odd,
  len(list_filter(tok, lambda t: lower(t) IN ({sq.quoted(lx.COMMON_WORDS)}))) AS known, len(regexp_extract_all(text, '[A-Za-z]')) AS letters, length(text) AS chars FROM ot),
o AS (SELECT doc_id, n AS n_tokens, CASE WHEN n > 0 THEN odd / n ELSE 1.0 END AS suspicious, CASE WHEN n > 0 THEN known / n ELSE 0.0 END AS common, CASE WHEN n > 0 THEN 1 - letters / greatest(chars, 1) END AS non_letter,
  CASE WHEN n > 0 THEN {sq.clip('1.0::DOUBLE - 3 * (odd / n) - greatest(0.0::DOUBLE, 0.25 - known / n) * 2')} ELSE 1.0 END AS ocr_score FROM oc)"""


_OCR = ocr("documents")


@query("ocr_quality", f"WITH {_OCR} SELECT doc_id, n_tokens, {', '.join(f'{sq.rounded(c)} AS {c}' for c in ('suspicious', 'common', 'non_letter', 'ocr_score'))} FROM o")
def ocr_quality(spark, sf_dir):
    return _rounded(st.scan_quality(_docs(spark, sf_dir)))


@query(
    "quality_warnings",
    f"""WITH {_OCR}, w AS (SELECT doc_id, len({sq.tokens('text')}) AS n FROM documents)
SELECT doc_id, concat_ws(',', CASE WHEN n < 3000 THEN 'short' END, CASE WHEN ocr_score < 0.6 THEN 'ocr' END, CASE WHEN common < 0.15 THEN 'language' END) AS warnings FROM o JOIN w USING (doc_id)""",
)
def quality_warnings(spark, sf_dir):
    """What is doubtful about a text: fewer than 3000 words, a poor scan, few common words."""
    docs = _docs(spark, sf_dir)
    scanned = st.scan_quality(docs.select(F.struct("doc_id", tx.word_count(F.col("text")).alias("n")).alias("doc"), "text"), "doc")
    warn = F.concat_ws(",", F.when(F.col("doc.n") < 3000, "short"), F.when(F.col("ocr_score") < 0.6, "ocr"), F.when(F.col("common") < 0.15, "language"))
    return scanned.select(F.col("doc.doc_id").alias("doc_id"), warn.alias("warnings"))


def _case(bounds, last, op="<"):
    return "CASE " + " ".join(f"WHEN n {op} {b} THEN '{x}'" for b, x in bounds) + f" ELSE '{last}' END"


@query("length_bands", f"WITH w AS (SELECT doc_id, len({sq.tokens('text')}) AS n FROM documents) SELECT {_case(lx.LENGTH_BANDS, '>1500')} AS band, {_case(lx.SCALE_BANDS, 'phrase', '>=')} AS scale, count(*) AS n_docs, sum(n)::BIGINT AS n_words FROM w GROUP BY 1, 2")
def length_bands(spark, sf_dir):
    """Documents and words by band of length and by the scale that its size is judged at."""
    n = F.col("n")
    band, scale = F.lit(">1500"), F.lit("phrase")
    for bound, name in reversed(lx.LENGTH_BANDS):
        band = F.when(n < bound, name).otherwise(band)
    for bound, name in reversed(lx.SCALE_BANDS):
        scale = F.when(n >= bound, name).otherwise(scale)
    rows = _docs(spark, sf_dir).select(tx.word_count(F.col("text")).alias("n"))
    return rows.groupBy(band.alias("band"), scale.alias("scale")).agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_words"))


@query(
    "corpus_info_rollup",
    f"""WITH w AS (SELECT source, lang, len({sq.tokens('text')}) AS n FROM documents)
SELECT source, lang, grouping(source, lang) AS level, count(*) AS n_docs, sum(n)::BIGINT AS n_words FROM w GROUP BY ROLLUP (source, lang)""",
)
def corpus_info_rollup(spark, sf_dir):
    """Documents and words of each book, each author and the whole, in one pass."""
    rows = _docs(spark, sf_dir).select("source", "lang", tx.word_count(F.col("text")).alias("n"))
    return rows.rollup("source", "lang").agg(F.grouping_id().alias("level"), F.count("*").alias("n_docs"), F.sum("n").alias("n_words"))
