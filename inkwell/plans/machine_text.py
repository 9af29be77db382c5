"""Machine-writing signals. The tables' texts hold few of the words looked for, so queries put a passage before them that does."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from inkwell.functions import lexicons as lx
from inkwell.functions import text as tx
from inkwell.operators import machine_text as mt
from inkwell.plans import snippets as sq
from inkwell.plans.registry import query
from inkwell.storage import table

PASSAGE = (
    "Moreover, we delve into the rich tapestry of cutting-edge software. However, it is important to note the myriad of apps, sites, and emails. In this essay I don't judge; we're fair -- overall.\n\n"
    "- a point\n- another\n1. first thing\n## Head\n**bold words** and In conclusion, apples, pears, plums or figs.\n\nThus, delves delve delve. Furthermore the website's app online.\n\n"
)
SPARSE = 4  # every so many documents have the passage


def _docs(spark, sf_dir):
    with_passage = F.when(F.col("doc_id") % SPARSE != 0, F.concat(F.lit(PASSAGE), F.col("text"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", with_passage.alias("text"))


def _doubled(words) -> str:
    """Phrases over a text whose marks are doubled, so that neighbouring finds don't share one."""
    once = [re.sub(r"([^a-zA-Z])", r"\1\1", w) for w in words]
    return "|".join(re.escape(w).replace("'", "''") for w in once)


_LITERAL = "'" + PASSAGE.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
_SOURCE = f"SELECT doc_id AS id, CASE WHEN doc_id % {SPARSE} <> 0 THEN {_LITERAL} || text ELSE text END AS text FROM documents"
_FIND = lambda words, ends: f"len(regexp_extract_all(dbl, '(?i)(?:^|[^a-zA-Z])(?:{_doubled(words)})" + ("(?:[^a-zA-Z]|$)" if ends else "") + "'))"
_MARKS = " + ".join(f"len(regexp_extract_all(text, '{p}'))" for p in lx.MARKUP)
_TRIPLE = "[\\p{L}\\p{N}_]+(?:,\\s+[\\p{L}\\p{N}_][\\p{L}\\p{N}_''-]*){1,2},?\\s+(?:and|or)\\s+[\\p{L}\\p{N}_][\\p{L}\\p{N}_''-]*"


def _signals_sql(source: str) -> str:
    even = lambda v, middle, width: f"CASE WHEN len({v}) >= 3 AND list_avg({v}) > 0 THEN {sq.clip(f'({middle} - list_stddev_pop({v}) / list_avg({v})) / {width}')} ELSE 0.0::DOUBLE END"
    opener = mt.opener().replace("'", "''")
    return f"""src AS ({source}), a AS (SELECT id, text, regexp_replace(text, '([^a-zA-Z])', '\\1\\1', 'g') AS dbl, {sq.alphabetic('text')} AS words, {sq.sentences('text')} AS sents, {sq.paragraphs('text')} AS paras FROM src),
b AS (SELECT *, greatest(len(words), 1) AS n, list_transform(sents, lambda x: len({sq.tokens('x')})::DOUBLE) AS sl, list_transform(paras, lambda x: len({sq.tokens('x')})::DOUBLE) AS pl,
  {_FIND(lx.STRONG_MARKERS, True)} AS strong, {_FIND(lx.WEAK_TRANSITIONS, False)} AS weak, {_FIND(lx.ANACHRONISMS, True)} AS modern, len(list_filter(sents, lambda x: regexp_matches(x, '{opener}'))) AS openers,
  len(regexp_extract_all(text, '{_TRIPLE}')) AS triples, {_MARKS} AS marks FROM a),
g AS (SELECT *, {sq.clip('1000.0::DOUBLE * (3.0 * strong + weak + 2.0 * modern) / n / 10.0')} AS lexicon, CASE WHEN len(sents) >= 3 THEN {sq.clip('openers / len(sents) / 0.35')} ELSE 0.0::DOUBLE END AS discourse,
  {sq.clip('500.0::DOUBLE * triples / n / 2.0')} AS list_of_three, {even('sl', 0.55, 0.4)} AS uniformity, {even('pl', 0.7, 0.5)} AS paragraph_uniformity, {sq.clip('300.0::DOUBLE * marks / n')} AS markup FROM b),
z AS (SELECT *, {sq.clip(' + '.join(f'{w} * {k}' for k, w in lx.SIGNAL_WEIGHTS.items()))} AS ai_score FROM g)"""


_Z = _signals_sql(_SOURCE)
_R = lambda *cols: ", ".join(f"{sq.rounded(c)} AS {c}" for c in cols)


def _pick(*cols):
    return lambda spark, sf_dir: mt.score(_docs(spark, sf_dir)).select("doc_id", *(tx.rounded(F.col(c)).alias(c) for c in cols))


for _name, _column in (("ai_discourse", "discourse"), ("ai_list_of_three", "list_of_three"), ("ai_sentence_uniformity", "uniformity"), ("ai_paragraph_uniformity", "paragraph_uniformity"), ("ai_markup", "markup")):
    query(_name, f"WITH {_Z} SELECT id AS doc_id, {_R(_column)} FROM z")(_pick(_column))


@query("ai_lexicon", f"WITH {_Z} SELECT id AS doc_id, strong::BIGINT AS n_strong, weak::BIGINT AS n_weak, modern::BIGINT AS n_modern, {_R('lexicon')} FROM z")
def ai_lexicon(spark, sf_dir):
    """Hits of each list of phrases, and the signal they give."""
    rows = mt.counted(_docs(spark, sf_dir), "doc_id", "text")
    return rows.select("doc_id", *(F.col(c).cast("long").alias(f"n_{c}") for c in ("strong", "weak", "modern")), tx.rounded(mt.signals()["lexicon"]).alias("lexicon"))


@query("ai_heuristic_score", f"WITH {_Z} SELECT id AS doc_id, {_R(*lx.SIGNAL_WEIGHTS, 'ai_score')} FROM z")
def ai_heuristic_score(spark, sf_dir):
    return _pick(*lx.SIGNAL_WEIGHTS, "ai_score")(spark, sf_dir)


_SUFFIXES = sq.quoted(("t", "re", "ve", "ll", "d", "s", "m"))


@query(
    "ai_surface_features",
    f"""WITH {_Z}, s AS (SELECT *, CASE WHEN len(sl) > 0 THEN sl ELSE [0.0::DOUBLE] END AS sl0, list_transform(words, lambda w: length(w)::DOUBLE) AS wl FROM z)
SELECT id AS doc_id, {_R(*lx.SIGNAL_WEIGHTS)}, {sq.rounded('list_avg(sl0)')} AS avg_sentence_len, {sq.rounded('list_stddev_pop(sl0)', 5)} AS std_sentence_len, {sq.rounded('coalesce(list_avg(wl), 0.0)')} AS avg_word_len,
{sq.rounded("len(list_distinct(list_transform(words, lambda w: trim(lower(w), '.,;:!?" + chr(34) + "''()')))) / n")} AS type_token_ratio, {sq.rounded(f"100.0::DOUBLE * {sq.occurrences('text', ',')} / n")} AS comma_per_100w, {sq.rounded(f"100.0::DOUBLE * {sq.occurrences('text', ';')} / n")} AS semicolon_per_100w,
{sq.rounded(f"100.0::DOUBLE * len(list_filter(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+''[\\p{{L}}\\p{{N}}_]+'), lambda w: lower(split_part(w, '''', 2)) IN ({_SUFFIXES}))) / n")} AS contraction_per_100w,
{sq.rounded("100.0::DOUBLE * len(list_filter(regexp_extract_all(text, '[\\p{L}\\p{N}_]+'), lambda w: w IN ('I', 'me', 'my', 'mine', 'we', 'us', 'our'))) / n")} AS first_person_per_100w,
{sq.rounded(f"100.0::DOUBLE * ({sq.occurrences('text', '—')} + len(list_filter(regexp_extract_all(text, '-+'), lambda d: length(d) = 2))) / n")} AS em_dash_per_100w FROM s""",
)
def ai_surface_features(spark, sf_dir):
    got = mt.surface(_docs(spark, sf_dir))
    return got.select("doc_id", *(tx.rounded(F.col(c), 5 if c == "std_sentence_len" else 6).alias(c) for c in got.columns[1:]))


@query(
    "ai_tiers",
    f"""WITH {_Z}, t AS (SELECT id, CASE WHEN len(words) >= 50 THEN ai_score END AS ai_score FROM z)
SELECT id AS doc_id, {_R('ai_score')}, CASE WHEN ai_score >= {mt.RED} THEN 'red' WHEN ai_score <= {mt.GREEN} THEN 'green' WHEN ai_score IS NOT NULL THEN 'yellow' END AS tier FROM t""",
)
def ai_tiers(spark, sf_dir):
    """Score and tier; texts of fewer than 50 words are not judged."""
    docs = _docs(spark, sf_dir)
    scored = mt.counted(docs, "doc_id", "text").select("doc_id", "words", *(v.alias(k) for k, v in mt.signals().items()))
    raw = tx.clip(sum((w * F.col(k) for k, w in lx.SIGNAL_WEIGHTS.items()), F.lit(0.0)))
    judged = scored.select("doc_id", F.when(F.size("words") >= 50, raw).alias("ai_score"))
    return judged.select("doc_id", tx.rounded(F.col("ai_score")).alias("ai_score"), mt.tier(F.col("ai_score")).alias("tier"))


_LINES = f"SELECT doc_id * 1000000 + generate_subscripts(string_split(text, chr(10)), 1) AS id, unnest(string_split(text, chr(10))) AS text FROM ({_SOURCE.replace('doc_id AS id', 'doc_id')})"


@query(
    "ai_paragraph_means",
    f"""WITH {_signals_sql(_LINES)} SELECT id // 1000000 AS doc_id, count(*) AS n_paragraphs, {sq.rounded('avg(ai_score)')} AS ai_mean, {sq.rounded(f'sum(ai_score * len({sq.tokens("text")})) / sum(len({sq.tokens("text")}))')} AS ai_weighted, count(*) FILTER (ai_score >= {mt.RED}) AS n_red
FROM z WHERE len(words) >= 10 GROUP BY 1""",
)
def ai_paragraph_means(spark, sf_dir):
    """Scores of a text's paragraphs (lines of ten words or more): their mean, the mean by words, and how many are red."""
    lines = _docs(spark, sf_dir).select("doc_id", F.explode(F.split("text", "\n")).alias("text"))
    scored = mt.counted(lines.select(F.struct("doc_id", tx.word_count(F.col("text")).alias("w")).alias("id"), "text"), "id", "text").where(F.size("words") >= 10).select("id", *(v.alias(k) for k, v in mt.signals().items()))
    scored = scored.select("id", tx.clip(sum((w * F.col(k) for k, w in lx.SIGNAL_WEIGHTS.items()), F.lit(0.0))).alias("s"))
    return scored.groupBy(F.col("id.doc_id").alias("doc_id")).agg(F.count("*").alias("n_paragraphs"), tx.rounded(F.avg("s")).alias("ai_mean"), tx.rounded(F.sum(F.col("s") * F.col("id.w")) / F.sum("id.w")).alias("ai_weighted"), F.count_if(F.col("s") >= mt.RED).alias("n_red"))
