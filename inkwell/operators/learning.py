"""Splits without leaks, training draws, and models over the library's features."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.operators import novelty as nv
from inkwell.operators.rings import following
from inkwell.storage import materialize

SEED, FOLDS, DRAWS, PROFILE_TEXTS = "42", 7, 12, 20
TRAIN, VALIDATION = 0.6, 0.2


def keyed_hash(*parts) -> Column:
    """A hash of a seed and columns, the same in every engine."""
    return F.md5(F.concat_ws("|", F.lit(SEED), *(F.col(p).cast("string") if isinstance(p, str) else p for p in parts)).cast("binary"))


def fold(group: Column, k: int = FOLDS) -> Column:
    """The fold of a group: all its rows share it, so none straddles a split."""
    return (F.conv(F.substring(F.md5(group.cast("binary")), 1, 8), 16, 10).cast("long") % k).cast("long")


#: Groups that are dealt to folds by one task.
DEALT_GROUPS = 4096


def stratified_folds(rows: DataFrame, group: str, label: str, k: int) -> DataFrame:
    """(group, fold): groups dealt to k folds so that each fold has about the same share of every class; no group straddles.

    Groups are dealt one by one, those of the most uneven classes first, each to the fold where the shares of the
    classes then vary least, of equal ones to that of the fewest rows. What is dealt are counts of rows by group and
    class, in blocks of groups drawn by hash, so no task sees all groups; ties go by hashes. Where every class has
    fewer rows than there are folds, shares mean nothing and groups go by their hash alone. Rows without group or
    label are left out.
    """
    counts = rows.where(F.col(group).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(group).alias("g"), F.col(label).cast("string").alias("c")).agg(F.count("*").alias("n"))
    counts = materialize(counts, "group-counts")
    largest = counts.groupBy("c").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
    if largest < k:
        return counts.select(F.col("g").alias(group)).distinct().withColumn("fold", fold(F.col(group).cast("string"), k).cast("int"))
    blocks = -(-counts.select("g").distinct().count() // DEALT_GROUPS)

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        table = pdf.pivot(index="g", columns="c", values="n").fillna(0.0)
        x, names = table.to_numpy(float), table.index.to_numpy()
        order = pdf.drop_duplicates("g").set_index("g")["h"].loc[names].to_numpy()
        total, held = x.sum(axis=0), np.zeros((k, x.shape[1]))
        at = np.zeros(len(x), np.int32)
        for i in np.lexsort((order, -x.std(axis=1))):
            tried = np.repeat((held / total)[None], k, axis=0)
            tried[np.arange(k), np.arange(k)] += x[i] / total
            spread = np.round(tried.std(axis=1).mean(axis=1), 12)
            at[i] = np.lexsort((np.arange(k), held.sum(axis=1), spread))[0]
            held[at[i]] += x[i]
        return pd.DataFrame({group: names, "fold": at})

    marked = counts.withColumns({"h": F.xxhash64("g"), "block": F.pmod(F.xxhash64(F.lit("block"), "g"), F.lit(max(blocks, 1)))})
    return materialize(marked.groupBy("block").applyInPandas(deal, f"`{group}` {dict(rows.dtypes)[group]}, fold int"), "folds")


def book_split(books: DataFrame, author: str = "author", book: str = "book") -> DataFrame:
    """(author, book, split): about 60/20/20 of each author's books in hash order, two for training and one for each other at least where they suffice."""
    w = Window.partitionBy(author)
    ranked = books.select(author, book).distinct().withColumns({"r": F.row_number().over(w.orderBy(keyed_hash(author, book))), "n": F.count("*").over(w)})
    n = F.col("n")
    want = F.greatest(F.lit(2), F.rint(n * TRAIN)).cast("int")
    train = F.when(n > 2, F.least(want, n - 2)).otherwise(F.least(want, n))
    val = F.greatest(F.lit(1), F.rint(n * VALIDATION)).cast("int")
    no_test = (train + val >= n).cast("int")
    # Books that training gives up when nothing is left for testing, and then for validation.
    kept = train - no_test - ((train >= n) & (n > 1)).cast("int")
    in_val = F.when(train >= n, F.col("r") == kept + 1).otherwise(F.col("r") <= train + val) & (F.col("r") > kept)
    tested = F.when(no_test == 1, F.col("r") == F.when(train >= n, train).otherwise(kept + 1)).otherwise(F.col("r") > train + val)
    return ranked.select(author, book, F.when(F.col("r") <= kept, "train").when(tested, "test").when(in_val, "validation").otherwise("validation").alias("split"))


def draws(texts: DataFrame, id_col: str = "doc_id", author: str = "author", book: str = "book", n: int = DRAWS) -> DataFrame:
    """(author, draw, held_out, query_id, rival): leave-one-book-out draws.

    In a draw the author's book of the least hash is held out and a text of it asked about; the profile is to be
    made from the other books. The rival is the author that follows in the draw's order of hashes. All draws
    come from hashes, so they are the same whatever the partitions.
    """
    rounds = F.explode(F.sequence(F.lit(1), F.lit(n))).alias("draw")
    held = texts.select(author, book).distinct().select(author, book, rounds)
    held = held.groupBy(author, "draw").agg(F.min_by(book, keyed_hash("draw", author, book)).alias("held_out"), F.count("*").alias("n_books")).where("n_books > 1").drop("n_books")
    asked = texts.select(id_col, author, F.col(book).alias("held_out")).join(held, [author, "held_out"]).groupBy(author, "draw", "held_out").agg(F.min_by(id_col, keyed_hash("draw", id_col)).alias("query_id"))
    return following(asked, "draw", author, keyed_hash("draw", author), "rival")


def logistic(rows: DataFrame, features: list[str], label: str, reg: float, scaled: bool = True, weighted: bool = False) -> tuple[Pipeline, DataFrame]:
    """A fitted pipeline of assembly, scaling and logistic regression, and the rows it was given, with class weights if asked."""
    if weighted:
        counts = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}
        total = sum(counts.values())
        rows = rows.withColumn("w", F.coalesce(*(F.when(F.col(label) == k, F.lit(total / (len(counts) * c))) for k, c in counts.items())))
    stages = [VectorAssembler(inputCols=features, outputCol="raw", handleInvalid="keep")]
    if scaled:
        stages.append(StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True))
    model = LogisticRegression(labelCol=label, featuresCol="features" if scaled else "raw", maxIter=100, regParam=reg, **({"weightCol": "w"} if weighted else {}))
    return Pipeline(stages=[*stages, model]).fit(rows), rows


def predictions(model, rows: DataFrame, keep: list[str]) -> DataFrame:
    """keep, the predicted class and the array of class probabilities."""
    return model.transform(rows).select(*keep, F.col("prediction").cast("int").alias("predicted"), vector_to_array("probability").alias("p"))


def numbered(names: DataFrame, column: str, out: str) -> DataFrame:
    """Distinct names with their places from 0 in order, counted in ranges, so no task or driver holds them all."""
    ranged = materialize(names.select(column).where(F.col(column).isNotNull()).repartitionByRange(column).withColumn("_part", F.spark_partition_id()), "names")
    sums = ranged.groupBy("_part").agg(F.count("*").alias("n"))  # a row for each range
    ahead = sums.select("_part", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("n0"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(column)) - 1
    return ranged.withColumn("_own", own).join(F.broadcast(ahead), "_part").select(column, (F.col("_own") + F.col("n0")).alias(out))


def index_labels(rows: DataFrame, column: str, out: str) -> DataFrame:
    """rows with the place of their label among all in the order of names, as a double; rows without one go."""
    places = numbered(rows.select(column).distinct(), column, out)
    return rows.join(places, column).select(*rows.columns, F.col(out).cast("double").alias(out))


def grow_trees(rows: DataFrame, features: list[str], trees: int = nv.TREES, size: int = nv.TREE_ROWS) -> list:
    """Isolation trees over columns, one task each, from a hash sample of about `size` rows of the whole table."""
    points = rows.select("id", F.array(*(F.col(f).cast("double") for f in features)).alias("x"), F.array(F.lit(0)).alias("forests"))
    return nv.forests(points, trees, size).collect()


def novelty(rows: DataFrame, features: list[str], trees: list) -> DataFrame:
    """(id, raw): minus the isolation score of each row, so that ordinary rows have more."""
    points = rows.select("id", F.array(*(F.col(f).cast("double") for f in features)).alias("x"), F.lit(0).alias("forest"))
    return nv.raw_scores(points, trees).select("id", "raw")


novelty_percent = nv.percent


def scaled_novelty(scores: DataFrame) -> DataFrame:
    """(id, raw, pct): percentiles are exact, over scores kept to 6 places."""
    scores = materialize(scores, "novelty")
    p01, p50 = scores.agg(F.percentile(F.floor(F.col("raw") * 1e6) / 1e6, F.lit([0.01, 0.5]))).first()[0] or (0.0, 0.0)
    return scores.select("id", "raw", novelty_percent(F.col("raw"), F.lit(p01), F.lit(p50)).alias("pct"))
