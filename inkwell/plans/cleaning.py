"""Text cleaning. The tables' texts hold none of what is cleaned, so queries wrap them in literal pieces that do."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.functions import lexicons as lx
from inkwell.functions import text as tx
from inkwell.operators import budgets
from inkwell.plans import snippets as sq
from inkwell.plans.registry import query
from inkwell.storage import table

START, END = "*** START OF THE PROJECT GUTENBERG EBOOK ***", "*** END OF THIS PROJECT GUTENBERG EBOOK ***"
CREDITS = "Produced by Someone\nTitle: A Book\nauthor: N. N.\nA line that stays.\nCredits: all\n  Release Date: 1900 \nwww.gutenberg.org\n"
TOC = "Front\nCONTENTS\nI. First ... 3\n\nCHAPTER ONE\n\n"
PROSE = " ".join(["word"] * 20)
NOTES = "[Footnote 1: see\nbelow] a[12]b [ 7 ] [translator's note here] [kept] "
DASHES = "“Quoted”—it’s hyphen-\nated\n 12 \n\ta  b\n\n\n\nend "


def _docs(spark, sf_dir, before: str = "", after: str = ""):
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit(before), F.col("text"), F.lit(after)).alias("text"))


def _sql(before: str = "", after: str = "") -> str:
    literal = lambda s: "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + "'"
    return f"d AS (SELECT doc_id, {literal(before)} || text || {literal(after)} AS text FROM documents)"


def _hash(column):
    return F.md5(column.cast("binary"))


_HEAD, _TAIL = rf"(?is)^(.*?)({lx.BODY_START})", rf"(?is)^(.*?){lx.BODY_END}"


@query(
    "clean_body",
    f"""WITH {_sql('preamble ' + START, END + ' licence')}, c AS (SELECT doc_id, text, length(regexp_extract(text, '{_HEAD}', 1)) + length(regexp_extract(text, '{_HEAD}', 2)) AS a, length(regexp_extract(text, '{_TAIL}', 1)) AS b FROM d),
e AS (SELECT doc_id, CASE WHEN b > a THEN substr(text, a + 1, b - a) ELSE substr(text, a + 1) END AS t FROM c) SELECT doc_id, md5(t) AS h, length(t) AS n FROM e""",
)
def clean_body(spark, sf_dir):
    """E-book text between its start and end marks."""
    t = tx.body(F.col("text"))
    return _docs(spark, sf_dir, "preamble " + START, END + " licence").select("doc_id", t.alias("t")).select("doc_id", _hash(F.col("t")).alias("h"), F.length("t").cast("long").alias("n"))


_OLD = "\n End of the Project Gutenberg Etext of this\nmore"


@query("clean_old_end", f"WITH {_sql('*END*THE SMALL PRINT and so' + chr(10) + 'on' + chr(10) + chr(10), _OLD)}, c AS (SELECT doc_id, chr(10) || chr(10) || text || chr(10) AS t FROM documents) SELECT doc_id, md5(t) AS h, length(t) AS n FROM c")
def clean_old_end(spark, sf_dir):
    """E-book text without marks: the small print is cut out, and what follows the old last line."""
    t = tx.body(F.col("text"))
    return _docs(spark, sf_dir, "*END*THE SMALL PRINT and so\non\n\n", _OLD).select("doc_id", t.alias("t")).select("doc_id", _hash(F.col("t")).alias("h"), F.length("t").cast("long").alias("n"))


_BOILER = " OR ".join("regexp_matches(s, '(?i)" + p.replace("'", "''") + "')" for p in lx.BOILERPLATE_LINES)


@query("clean_boilerplate", f"WITH {_sql(CREDITS)}, c AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda s: NOT ({_BOILER})) AS l FROM d) SELECT doc_id, len(l) AS n_lines, md5(array_to_string(l, chr(10))) AS h FROM c")
def clean_boilerplate(spark, sf_dir):
    rows = _docs(spark, sf_dir, CREDITS).select("doc_id", tx.without_boilerplate(F.col("text")).alias("t"))
    return rows.select("doc_id", tx.long_size(F.split("t", "\n")).alias("n_lines"), _hash(F.col("t")).alias("h"))


@query("strip_toc", f"WITH {_sql('')} SELECT doc_id, md5('Front' || chr(10) || chr(10) || 'CHAPTER ONE' || chr(10) || chr(10) || '{PROSE}' || chr(10) || text) AS h FROM d")
def strip_toc(spark, sf_dir):
    """A table of contents goes; the blank lines and the one heading above the first prose line stay."""
    rows = _docs(spark, sf_dir, TOC + PROSE + "\n").select("doc_id", F.split("text", "\n").alias("lines"))
    return rows.select("doc_id", _hash(F.array_join(tx.without_contents(F.col("lines")), "\n")).alias("h"))


@query("strip_backmatter", "SELECT doc_id, md5(text) AS h FROM documents")
def strip_backmatter(spark, sf_dir):
    """What follows the first back-matter heading goes, also where chapters come after it."""
    rows = _docs(spark, sf_dir, "", "\n Notes. \n1. a note\nCHAPTER TWO\nmore\nINDEX\nz").select("doc_id", F.split("text", "\n").alias("lines"))
    return rows.select("doc_id", _hash(F.array_join(tx.without_back_matter(F.col("lines")), "\n")).alias("h"))


@query("strip_notes", f"WITH {_sql('')} SELECT doc_id, md5('  ab    [kept] ' || text) AS h FROM d")
def strip_notes(spark, sf_dir):
    """Footnotes, their marks and notes of editors and translators."""
    return _docs(spark, sf_dir, NOTES).select("doc_id", _hash(tx.without_notes(F.col("text"))).alias("h"))


_LEVELLED = "regexp_replace(regexp_replace('\"Quoted\"--it''s hyphenated' || chr(10) || chr(9) || 'a  b' || chr(10) || chr(10) || chr(10) || chr(10) || 'end ' || text, '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')"


@query("fix_typography", f"SELECT doc_id, md5({sq.trimmed(_LEVELLED)}) AS h FROM documents")
def fix_typography(spark, sf_dir):
    return _docs(spark, sf_dir, DASHES).select("doc_id", _hash(tx.typography(F.col("text"))).alias("h"))


_PARAS = "First line\n second  line\n \n\n"


@query("paragraphs", f"WITH {_sql(_PARAS)}, p AS (SELECT doc_id, {sq.paragraphs('text')} AS p FROM d) SELECT doc_id, len(p) AS n_paragraphs, list_sum(list_transform(p, lambda x: length(x)))::BIGINT AS n_chars FROM p")
def paragraphs(spark, sf_dir):
    rows = _docs(spark, sf_dir, _PARAS).select("doc_id", tx.paragraphs(F.col("text")).alias("p"))
    return rows.select("doc_id", tx.long_size(F.col("p")).alias("n_paragraphs"), F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("n_chars"))


@query("api_paragraphs", f"WITH {_sql(_PARAS)}, p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda s: {sq.trimmed('s')}), lambda s: s <> '') AS p FROM d) SELECT doc_id, len(p) AS n_paragraphs, length(p[1]) AS first_chars FROM p")
def api_paragraphs(spark, sf_dir):
    """Paragraphs as the service splits them: at two line ends only."""
    rows = _docs(spark, sf_dir, _PARAS).select("doc_id", tx.blank_line_parts(F.col("text")).alias("p"))
    return rows.select("doc_id", tx.long_size(F.col("p")).alias("n_paragraphs"), F.length(F.col("p")[0]).cast("long").alias("first_chars"))


@query("text_previews", "SELECT doc_id, substr(text, 1, 220) AS preview, least(length(text), 400000) AS n_used FROM documents")
def text_previews(spark, sf_dir):
    """The start of each text, and the characters of it that a request takes."""
    return table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 220).alias("preview"), F.least(F.length("text"), F.lit(400000)).cast("long").alias("n_used"))


# What one request takes, in works, characters of a work, characters in all, paragraphs of a text.
MOST_WORKS, WORK_CHARS, TOTAL_CHARS, MOST_PARAGRAPHS = 30, 400_000, 2_500_000, 80


@query(
    "portfolio_budgets",
    f"""WITH r AS (SELECT source, least(length(text), {WORK_CHARS}) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r, count(*) OVER (PARTITION BY source) AS n_works FROM documents WHERE source IS NOT NULL)
SELECT source, n_works, count(*) AS n_used, sum(n)::BIGINT AS n_chars, sum(n) > 0 AND sum(n) <= {TOTAL_CHARS} AS accepted FROM r WHERE r <= {MOST_WORKS} GROUP BY source, n_works""",
)
def portfolio_budgets(spark, sf_dir):
    """Each author's portfolio as a request takes it: the first works, each cut, and whether they fit together."""
    return budgets.portfolios(table(spark, sf_dir, "documents"), "source", "doc_id", "text", MOST_WORKS, WORK_CHARS, TOTAL_CHARS)


_ALL_LINES = "list_filter(list_transform(string_split(text, chr(10)), lambda s: " + sq.trimmed("s") + "), lambda s: s <> '')"


@query(
    "paragraph_budgets",
    f"""SELECT doc_id, len(p) AS n_paragraphs, least(len(p), {MOST_PARAGRAPHS}) AS n_used, coalesce(list_sum(list_transform(list_slice(p, 1, {MOST_PARAGRAPHS}), lambda x: length(x))), 0)::BIGINT AS n_chars,
sha256(array_to_string(list_transform(list_slice(p, 1, {MOST_PARAGRAPHS}), lambda x: substr(x, 1, 220)), chr(10))) AS previews_sha256 FROM (SELECT doc_id, {_ALL_LINES} AS p FROM documents)""",
)
def paragraph_budgets(spark, sf_dir):
    """The first paragraphs (lines) of each text, as many as a request takes, and their previews."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda s: F.trim(s, F.lit(" \t\n\r\x0c\x0b"))), lambda s: s != "")
    return budgets.first_paragraphs(table(spark, sf_dir, "documents").select("doc_id", lines.alias("p")), "p", MOST_PARAGRAPHS)
