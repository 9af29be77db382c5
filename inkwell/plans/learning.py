"""Splits and draws of the documents (books are source and language), and models over their features."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from inkwell.functions import text as tx
from inkwell.operators import analysis as an
from inkwell.operators import attribution as at
from inkwell.operators import books as bk
from inkwell.operators import chunking as ck
from inkwell.operators import encoder as en
from inkwell.operators import learning as ln
from inkwell.operators import machine_text as mt
from inkwell.operators import novelty as nv
from inkwell.operators import stylometry as st
from inkwell.operators import verifier as vf
from inkwell.plans import snippets as sq
from inkwell.plans.chunks import SIZE
from inkwell.plans.registry import query
from inkwell.storage import materialize, table

OPEN_SET = "src4"


def _texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("author"), F.col("lang").alias("book"), "text")


_H = lambda *p: "md5('" + ln.SEED + "|' || " + " || '|' || ".join(p) + ")"


@query(
    "book_split",
    f"""WITH b AS (SELECT DISTINCT source AS author, lang AS book FROM documents), r AS (SELECT author, book, row_number() OVER (PARTITION BY author ORDER BY {_H('author', 'book')}) AS r, count(*) OVER (PARTITION BY author) AS n FROM b),
s AS (SELECT *, CASE WHEN n > 2 THEN least(greatest(2, round_even(n * 0.6, 0)::INT), n - 2) ELSE least(2, n) END AS tr, greatest(1, round_even(n * 0.2, 0)::INT) AS va FROM r)
SELECT author, book, CASE WHEN n = 1 OR n = 2 AND r = 2 THEN 'test' WHEN n = 2 THEN 'validation' WHEN r <= tr THEN 'train' WHEN r <= tr + va THEN 'validation' ELSE 'test' END AS split FROM s""",
)
def book_split(spark, sf_dir):
    return ln.book_split(_texts(spark, sf_dir))


_FOLD = "('0x' || substr(md5(source || '::' || lang), 1, 8))::BIGINT % 7"


@query("grouped_folds", f"SELECT {_FOLD} AS fold, count(*) AS n_docs, count(DISTINCT source || '::' || lang) AS n_books FROM documents GROUP BY 1")
def grouped_folds(spark, sf_dir):
    """Documents and books of each fold; a book is in one fold only."""
    book = F.concat("author", F.lit("::"), "book")
    per = _texts(spark, sf_dir).groupBy("author", "book").agg(F.count("*").alias("n")).withColumn("fold", ln.fold(book))
    return per.groupBy("fold").agg(F.sum("n").alias("n_docs"), F.count("*").alias("n_books"))


@query("label_encoding", "SELECT source, dense_rank() OVER (ORDER BY source) - 1 AS label FROM (SELECT DISTINCT source FROM documents)")
def label_encoding(spark, sf_dir):
    """Authors numbered in the order of their names."""
    names = table(spark, sf_dir, "documents").select("source").distinct()
    return ln.index_labels(names, "source", "x").select("source", F.col("x").cast("long").alias("label"))


@query("inner_cv", "SELECT greatest(2, least(3, min(n) // 2)) AS folds, min(n) AS smallest FROM (SELECT count(*) AS n FROM documents GROUP BY source)")
def inner_cv(spark, sf_dir):
    counts = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return counts.agg(F.greatest(F.lit(2), F.least(F.lit(3), F.floor(F.min("n") / 2))).cast("long").alias("folds"), F.min("n").alias("smallest"))


@query("open_set", f"SELECT source, count(*) AS n FROM documents WHERE source <> '{OPEN_SET}' GROUP BY 1")
def open_set(spark, sf_dir):
    """What is left when one author is kept out of everything."""
    return table(spark, sf_dir, "documents").where(F.col("source") != OPEN_SET).groupBy("source").agg(F.count("*").alias("n"))


@query(
    "training_pairs",
    f"""WITH d AS (SELECT unnest(range(1, {ln.DRAWS + 1})) AS draw), b AS (SELECT DISTINCT source AS author, lang AS book FROM documents), k AS (SELECT author FROM b GROUP BY 1 HAVING count(*) > 1),
h AS (SELECT author, draw, arg_min(book, {_H('draw', 'author', 'book')}) AS held_out FROM b JOIN k USING (author), d GROUP BY 1, 2),
q AS (SELECT author, draw, held_out, arg_min(doc_id, {_H('draw', 'doc_id')}) AS query_id FROM h JOIN documents ON source = author AND lang = held_out GROUP BY 1, 2, 3)
SELECT author, draw::INT AS draw, held_out, query_id, coalesce(lead(author) OVER w, first(author) OVER (PARTITION BY draw ORDER BY {_H('draw', 'author')} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS rival
FROM q WINDOW w AS (PARTITION BY draw ORDER BY {_H('draw', 'author')})""",
)
def training_pairs(spark, sf_dir):
    return ln.draws(_texts(spark, sf_dir))


@query(
    "reference_split",
    f"SELECT author, count(*) FILTER (r <= 21) AS n_profile, count(*) FILTER (r > 21) AS n_unseen FROM (SELECT source AS author, row_number() OVER (PARTITION BY source ORDER BY {_H('doc_id')}) AS r FROM documents) GROUP BY 1",
)
def reference_split(spark, sf_dir):
    """The 21 texts of each author that make the profile, and those left to be shown."""
    texts = _texts(spark, sf_dir).select("author", "doc_id")
    r = F.row_number().over(Window.partitionBy("author").orderBy(ln.keyed_hash("doc_id")))
    profile = texts.withColumn("r", r).where("r <= 21").groupBy("author").agg(F.count("*").alias("n_profile"))  # at most 21 of an author reach a task from each other
    return texts.groupBy("author").agg(F.count("*").alias("n")).join(profile, "author").select("author", "n_profile", (F.col("n") - F.col("n_profile")).alias("n_unseen"))


def _languages(spark, sf_dir):
    """Texts whose author is their language and whose book is their source: sources have no style of their own in these tables."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("author"), F.col("source").alias("book"), F.col("source").alias("work"), "text")


OUT_OF_FOLD = 3


def out_of_fold(rows, names, label, group, reg, keep, folds=OUT_OF_FOLD):
    """keep, predicted and p of every row, each judged by a regression that was fitted on the other folds of its groups."""
    rows = materialize(rows.withColumn("_fold", ln.fold(F.col(group), folds)), "folded")
    out = None
    for k in range(folds):
        train = rows.where(F.col("_fold") != k)
        if train.select(label).distinct().count() < 2:
            continue
        model, _ = ln.logistic(train, names, label, reg)
        part = ln.predictions(model, rows.where(F.col("_fold") == k), keep)
        out = part if out is None else out.unionByName(part)
    return out


@query("attribution_predictions")
def attribution_predictions(spark, sf_dir):
    """Each document's author (language) by a regression on surface measures, fitted on the books of the other folds."""
    texts = _languages(spark, sf_dir)
    measures = st.stylometry(texts.select(F.struct(F.col("id").alias("doc_id"), "author", "work").alias("key"), "text"), "key")
    rows = ln.index_labels(measures.select("key.*", *measures.columns[1:]), "author", "label")
    got = out_of_fold(rows, measures.columns[1:], "label", "work", 0.001, ["doc_id", "author", "label"])
    return got.select("doc_id", "author", F.col("label").cast("int").alias("label"), "predicted", F.array_max("p").alias("p"))


#: Folds of books of which one is held out: 15 % of the rows.
HOLDOUT = 7


@query("stratified_folds")
def stratified_folds(spark, sf_dir):
    """The fold of each book (source), so that every fold has its share of each author (language)."""
    return ln.stratified_folds(_languages(spark, sf_dir), "work", "author", HOLDOUT)


def _attribution(spark, sf_dir, novelty=False):
    texts = _languages(spark, sf_dir)
    texts = materialize(texts.join(ln.stratified_folds(texts, "work", "author", HOLDOUT), "work"), "attribution-texts")
    return at.Attribution.fit(texts.where("fold <> 0").drop("fold"), novelty=novelty), texts.where("fold = 0").drop("fold")


@query("attribution_stack")
def attribution_stack(spark, sf_dir):
    """Held-out documents' authors (languages) by the stack over TF-IDF and surface measures; none of their books was learned from."""
    model, asked = _attribution(spark, sf_dir)
    got = asked.select("id", "author").join(model.scores(asked.select("id", "text")), "id")
    best = F.array_position("p", F.array_max("p")).cast("int")
    return got.select(F.col("id").alias("doc_id"), "author", F.element_at(F.array(*map(F.lit, model.authors)), best).alias("predicted"), F.array_max("p").alias("p"))


@query("attribution_by_scale")
def attribution_by_scale(spark, sf_dir):
    """Accuracy and macro-F1 of the stack on held-out books, for chunks and each of the smaller scales."""
    model, asked = _attribution(spark, sf_dir)
    chunks = ck.chunk_records(asked.select(F.struct("author", F.col("id").cast("string").alias("book")).alias("id"), "text"), SIZE, "id").select("id.author", "id.book", "chunk_id", "text", "word_count")
    spans = bk.multiscale(chunks).select("author", "scale", F.concat_ws("|", "book", "chunk_id").alias("id"), "text")
    spans = materialize(spans, "scales")
    got = spans.select("id", "author", "scale").join(model.scores(spans.select("id", "text")), "id")
    names = F.array(*map(F.lit, model.authors))
    cells = got.groupBy("scale", "author", F.element_at(names, F.array_position("p", F.array_max("p")).cast("int")).alias("predicted")).agg(F.count("*").alias("n"))
    hit = F.when(F.col("author") == F.col("predicted"), F.col("n")).otherwise(0)
    sides = cells.select("scale", F.col("author").alias("name"), F.col("n").alias("t"), F.lit(0).alias("g"), hit.alias("h")).unionByName(cells.select("scale", F.col("predicted").alias("name"), F.lit(0).alias("t"), F.col("n").alias("g"), F.lit(0).alias("h")))
    per = sides.groupBy("scale", "name").agg(F.sum("t").alias("t"), F.sum("g").alias("g"), F.sum("h").alias("h"))
    f1 = F.when(F.col("t") > 0, 2.0 * F.col("h") / (F.col("t") + F.col("g")))
    return per.groupBy("scale").agg(F.sum("t").alias("n_rows"), (F.sum("h") / F.sum("t")).alias("accuracy"), F.avg(f1).alias("macro_f1"))


@query("predicted_authors")
def predicted_authors(spark, sf_dir):
    """The ranked authors (languages) of each text of `benchmark`, by the geometric mean over its chunks."""
    model, _ = _attribution(spark, sf_dir, novelty=True)
    return model.predict(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text"), SIZE).withColumnRenamed("id", "item_id")


def _paragraphs(spark, sf_dir):
    """All documents, their lines as paragraphs and their language as the expected author, by a stack that saw the other books and a machine model of the conversations."""
    model, _ = _attribution(spark, sf_dir)
    turns = table(spark, sf_dir, "conversations").where("role in ('user', 'assistant')")
    machine = an.MachineModel.fit(turns.select((F.col("role") == "assistant").alias("label"), "text"))
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("expected"), F.regexp_replace("text", "\n", "\n\n").alias("text"))
    return an.paragraph_analysis(texts, model, machine)


@query("paragraph_analysis_by_model")
def paragraph_analysis_by_model(spark, sf_dir):
    """Each paragraph's chance of the expected author (language), its likeliest author, and its machine score, by fitted models."""
    return _paragraphs(spark, sf_dir).drop("text").withColumnRenamed("id", "doc_id")


@query("document_analysis_by_model")
def document_analysis_by_model(spark, sf_dir):
    """Documents judged by the means over their paragraphs, by fitted models in place of letter counts."""
    return an.document_analysis(_paragraphs(spark, sf_dir)).withColumnRenamed("id", "doc_id")


@query("full_verdicts")
def full_verdicts(spark, sf_dir):
    """The whole record of each benchmark text against each profile (language): leakage, copies, impostors, verdict and reason."""
    texts = _languages(spark, sf_dir)
    encoder, verifier, _ = vf.train(texts.drop("work"), draws=VERIFIER_DRAWS)
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    names = texts.select("author").distinct()
    return vf.verdicts(asked, texts.select("author", "id", "text"), vf.with_every(asked, names), encoder, verifier, vf.impostor_pool(names)).withColumnRenamed("id", "item_id")


@query("verifier_scores")
def verifier_scores(spark, sf_dir):
    """Chances that held-out texts are of the profile's author (language), by a verifier that saw neither them nor their books."""
    _, _, scores = vf.train(_languages(spark, sf_dir).drop("work"), draws=VERIFIER_DRAWS)
    return scores.select(F.col("id").alias("doc_id"), F.col("profile").alias("to"), F.col("positive").cast("int").alias("label"), F.col("score").alias("p"))


#: Draws an author of the registered queries.
VERIFIER_DRAWS = 60


@query("verifier_validation")
def verifier_validation(spark, sf_dir):
    """The verifier's report and thresholds on books and pairs that it was not fitted on, one author being kept out of everything."""
    _, verifier, _ = vf.train(_languages(spark, sf_dir).drop("work"), "es", VERIFIER_DRAWS)
    names = sorted(verifier.report)
    return spark.createDataFrame([(verifier.match, verifier.mismatch, *(float(verifier.report[n]) for n in names))], ", ".join(f"{n} double" for n in ("match", "mismatch", *names)))


@query("ai_classifier_scores")
def ai_classifier_scores(spark, sf_dir):
    """The chance that a turn is a machine's, by a regression on the surface measures of the other folds' conversations.

    Turns of fewer than 40 alphabetic words have no such chance; p is then the heuristic score.
    """
    turns = table(spark, sf_dir, "conversations").where("role in ('user', 'assistant')").select(F.struct("conv_id", "turn", "role").alias("key"), "text")
    got = mt.surface(turns, "key")
    n = turns.select("key", F.size(tx.alphabetic(tx.tokens(F.col("text")))).alias("n_words"))
    rows = got.select("key.*", *got.columns[1:]).withColumn("label", (F.col("role") == "assistant").cast("double")).withColumn("group", F.col("conv_id").cast("string"))
    scored = out_of_fold(rows, got.columns[1:], "label", "group", 0.01, ["conv_id", "turn", "role"])
    sized = n.select("key.conv_id", "key.turn", "n_words").groupBy("conv_id", "turn").agg(F.max("n_words").alias("n_words"))
    guess = mt.score(turns, "key").select("key.conv_id", "key.turn", F.col("ai_score").alias("guess")).groupBy("conv_id", "turn").agg(F.max("guess").alias("guess"))
    chance = F.when(F.col("n_words") >= mt.LEAST_MODEL_WORDS, F.col("p")[1])
    return scored.join(sized, ["conv_id", "turn"]).join(guess, ["conv_id", "turn"]).select("conv_id", "turn", "role", chance.alias("p_machine"), F.coalesce(chance, "guess").alias("p"))


@query("novelty_pct")
def novelty_pct(spark, sf_dir):
    """How ordinary each document is among all, by a forest that saw none of its book: vectors of terms and measures, reduced, and scaled by two percentiles."""
    texts = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("::", "source", "lang").alias("group"), "text")
    encoder = en.StyleEncoder.fit(texts, "doc_id", sizes=at.TERMS)
    sizes = {kind: encoder.vocabularies[kind].count() for kind in en.KINDS}
    # The group travels in the row of its text: vectors are written once, by the fit, and never shuffled.
    keyed = texts.select(F.struct(F.col("doc_id").alias("id"), "group").alias("id"), "text")
    rows = at.union(encoder.encoding(keyed, "id"), encoder, sizes).select("id.*", "ix", "w")
    detector, scores = nv.Detector.fit(rows, at.width(sizes))
    return scores.select(F.col("id").alias("doc_id"), "raw", nv.percent(F.col("raw"), F.lit(detector.p01), F.lit(detector.p50)).alias("pct"))


@query("novelty_scaling", f"SELECT doc_id, {sq.rounded('least(greatest(70.0::DOUBLE * (v - a) / greatest(b - a, 1e-6), 0.0::DOUBLE), 100.0::DOUBLE)')} AS pct FROM (SELECT doc_id, ln(1 + n_chars) AS v FROM documents), (SELECT quantile_cont(ln(1 + n_chars)::DOUBLE, 0.01) AS a, quantile_cont(ln(1 + n_chars)::DOUBLE, 0.5) AS b FROM documents)")
def novelty_scaling(spark, sf_dir):
    """The scaling alone, over the logarithm of the length."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.log1p("n_chars").alias("v"))
    a, b = rows.agg(F.percentile("v", F.lit([0.01, 0.5]))).first()[0]
    return rows.select("doc_id", tx.rounded(ln.novelty_percent(F.col("v"), F.lit(a), F.lit(b))).alias("pct"))
