"""Removal of lines that many sites share, by HyperLogLog sketches per line hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.operators.skew import join_groups
from inkwell.storage import materialize

#: Distinct sites (sources) from which a line counts as boilerplate.
MIN_SITES = 10
#: Words from which a line is a passage, and the distinct sites from which the pipeline takes one for boilerplate.
LONG_WORDS, LONG_SITES = 50, 3
#: Estimates within this share of the threshold (and at least 2 sites) are counted exactly. The sketches'
#: relative error is about 1.6 %, and far smaller for counts in the tens.
NEAR = 0.15
LOG2_BUCKETS = 12
_TRIMMED = " \t\r"


def _line(line):
    return F.trim(line, F.lit(_TRIMMED))


def _row(text):
    return F.xxhash64(text)


def site_lines(docs: DataFrame, id_col: str, text_col: str, site_col: str, min_sites: int = MIN_SITES, long_sites: int | None = None) -> DataFrame:
    """(h1, h2, need, site, id, row, pos): the non-blank lines of every text by a 128-bit hash; a null site is one of its own.

    need is the number of sites that makes a line boilerplate: long_sites, if given, from LONG_WORDS words on.
    row is the hash of the whole text, which tells apart the rows that share an id or have none.
    """
    need = F.lit(min_sites) if long_sites is None else F.when(F.size(F.split("line", r"\s+")) >= LONG_WORDS, long_sites).otherwise(min_sites)
    text = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(site_col), F.lit("")).alias("site"), _row(F.col(text_col)).alias("row"), F.col(text_col).alias("text"))
    base = text.select("id", "site", "row", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    base = base.withColumn("line", _line(F.col("line"))).where("line <> ''")
    return base.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"), need.alias("need"), "site", "id", "row", "pos")


def boilerplate(lines: DataFrame) -> DataFrame:
    """(h1, h2, first_id, n_rows): lines that occur on as many distinct sites as they need, with the rows that have them.

    Sketches of a line's sites are made by task and merged by aggregation, so a line on every page moves one
    small row per task. Lines whose estimate is near the threshold get an exact distinct count; rows of very
    frequent ones among them are dealt to many tasks for it.
    """
    need = F.col("need")
    # Sketches of a few sites hold them as they are, so a line of one site is not near where more are needed.
    band = F.greatest(F.least(F.greatest(F.lit(2.0), NEAR * need), need - 1.5), F.lit(0.5))
    sketched = lines.groupBy("h1", "h2", "need").agg(F.hll_sketch_agg("site", F.lit(LOG2_BUCKETS)).alias("sites"), F.min("id").alias("first_id"), F.count("*").alias("n_rows"))
    judged = sketched.select("h1", "h2", "need", "first_id", "n_rows", F.hll_sketch_estimate("sites").alias("estimate")).where(F.col("estimate") >= need - band)
    judged = materialize(judged, "line-sites")
    near = judged.where(F.col("estimate") <= need + band)
    counted = join_groups(lines.drop("need"), near, ["h1", "h2"], "n_rows", "row", "left_semi").groupBy("h1", "h2", "site").agg(F.count("*").alias("n")).groupBy("h1", "h2").agg(F.count("*").alias("exact"))
    sure = judged.where(F.col("estimate") > need + band).select("h1", "h2", "first_id", "n_rows")
    return sure.unionByName(near.join(counted, ["h1", "h2"]).where(F.col("exact") >= need).select("h1", "h2", "first_id", "n_rows"))


def drop_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, long_sites: int | None = None) -> DataFrame:
    """docs with boilerplate lines taken out of its texts, and the columns n_lines and n_removed.

    Lines are split at \\n and compared without blanks, tabs and carriage returns at their ends; blank lines
    always stay. A line on min_sites or more distinct sites (long_sites, if given, for one of LONG_WORDS words) is removed everywhere but in the document with
    the smallest id that has it, so no content leaves the corpus. What is cut is told by a row's id and the
    hash of its own text, so rows of other texts that share the id lose nothing by it. Null texts stay null
    with 0 lines; rows of null id count for their site and are left as they are; repeated rows are treated
    alike; a line that stands twice in the document that keeps it stays twice. An empty table gives an empty
    one. Columns of docs other than the three named are passed through; those of the added names are replaced.
    """
    lines = site_lines(docs, id_col, text_col, site_col, min_sites, long_sites)
    found = materialize(boilerplate(lines), "boilerplate")
    lines = lines.drop("need")
    hits = join_groups(lines, found, ["h1", "h2"], "n_rows", "row").where(F.col("id") != F.col("first_id"))
    cut = materialize(hits.groupBy(F.col("id").alias("_ink_id"), F.col("row").alias("_ink_row")).agg(F.array_sort(F.collect_set("pos")).alias("_ink_cut")), "cut-lines")
    # The texts are shuffled at every size alike: what is cut has rows in proportion to the documents.
    own = (F.col(id_col) == F.col("_ink_id")) & (_row(F.col(text_col)) == F.col("_ink_row"))
    joined = docs.join(cut.hint("merge"), own, "left").withColumn("_ink_lines", F.split(text_col, "\n"))
    # The lines between each two removed ones, in order; both arrays are columns so that they are made once a row.
    joined = joined.withColumn("_ink_bounds", F.concat(F.array(F.lit(-1)), F.col("_ink_cut"), F.array(F.size("_ink_lines"))))
    at = F.col("_ink_bounds")
    between = F.flatten(F.transform(F.sequence(F.lit(0), F.size("_ink_cut")), lambda k: F.slice("_ink_lines", at[k] + 2, at[k + 1] - at[k] - 1)))
    text = F.when(F.col("_ink_cut").isNull(), F.col(text_col)).otherwise(F.array_join(between, "\n"))
    return joined.withColumns(
        {"n_lines": F.when(F.col(text_col).isNull(), 0).otherwise(F.size("_ink_lines")).cast("long"), "n_removed": F.coalesce(F.size("_ink_cut"), F.lit(0)).cast("long"), text_col: text}
    ).drop("_ink_id", "_ink_row", "_ink_cut", "_ink_lines", "_ink_bounds")


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed and the text that stays, of every document."""
    return drop_boilerplate(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")).select("doc_id", "n_lines", "n_removed", "text")


OP7_SQL = """
WITH l AS (SELECT doc_id, coalesce(source, '') AS site, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
t AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS k FROM l),
b AS (SELECT k, min(doc_id) AS first_id FROM t WHERE k <> '' GROUP BY k HAVING count(DISTINCT site) >= 10),
m AS (SELECT t.doc_id, t.pos, t.line, coalesce(t.doc_id <> b.first_id, false) AS cut FROM t LEFT JOIN b USING (k)),
g AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (cut) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT cut), '') AS text FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(g.n_lines, 0) AS n_lines, coalesce(g.n_removed, 0) AS n_removed, CASE WHEN d.text IS NOT NULL THEN g.text END AS text
FROM documents d LEFT JOIN g USING (doc_id)
"""
