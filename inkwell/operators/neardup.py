"""Near-duplicate texts by the Jaccard similarity of word shingles, without comparing all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.text import gram_set, hashes, tokens
from inkwell.storage import materialize

WORDS, STRIDE, SIMILARITY = 50, 25, 0.6
#: Share of its grams that a set is to have in common, within a prefix longer by as many, to be compared.
SHARED = 0.2


def gram_sets(docs: DataFrame, id_col: str, text_col: str, k: int, stride: int) -> DataFrame:
    """(id, grams) of the texts that have words."""
    rows = docs.select(F.col(id_col).alias("id"), tokens(F.lower(text_col)).alias("words")).select("id", hashes(F.col("words")).alias("hashed"))
    return rows.where(F.size("hashed") > 0).select("id", gram_set(F.col("hashed"), k, stride).alias("grams"))


def shingle_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, stride: int = STRIDE) -> DataFrame:
    """(rep, members, grams): texts of one shingle set are one class, with its smallest id, its size and its sorted gram hashes.

    Copies thus never meet each other in a join. Texts without words have no set and are in no class.
    """
    grams = gram_sets(docs, id_col, text_col, k, stride)
    return grams.groupBy("grams").agg(F.min("id").alias("rep"), F.count("*").alias("members"))


def written_classes(docs: DataFrame, id_col: str, text_col: str, k: int, stride: int) -> DataFrame:
    """(rep, n, grams): the same classes, written; sets are told apart by 128 bits of hash, so no set is shuffled to find its copies."""
    keyed = gram_sets(docs, id_col, text_col, k, stride).withColumns({"row": F.monotonically_increasing_id(), "k1": F.xxhash64("grams"), "k2": F.xxhash64(F.lit(id_col), F.size("grams"), "grams")})
    rows = materialize(keyed, "shingles")
    first = rows.groupBy("k1", "k2").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))["row"].alias("row"))
    copies = materialize(rows.select("row").join(first, "row", "left_anti"), "copies")  # a number each, so that few are broadcast by Spark
    return rows.join(copies, "row", "left_anti").select(F.col("id").alias("rep"), F.size("grams").alias("n"), "grams")


def _shared_by(n: Column) -> Column:
    """How many grams the longer prefixes of two sets of n grams are to share."""
    return F.greatest(F.floor(SHARED * n), F.lit(1))


def with_shared_prefix(classes: DataFrame, similarity: float) -> DataFrame:
    """Those classes, none of which may be left out, that have enough grams of a prefix in common with the prefixes of others.

    In the order of hashes, sets that share at least `need` grams share k of their first n - need + k; k goes by the
    smaller set of the two. Only these parts of the sets are shuffled, and a gram is counted, never joined.
    """
    need = F.ceil(F.lit(similarity) * F.col("n") - 1e-9)
    posted = classes.select("rep", "n", F.explode(F.slice("grams", F.lit(1), (F.col("n") - need + _shared_by(F.col("n"))).cast("int"))).alias("gram"))
    common = posted.withColumn("df", F.count("*").over(Window.partitionBy("gram"))).where("df > 1")
    enough = common.groupBy("rep").agg(F.count("*").alias("m"), F.min("n").alias("n")).where(F.col("m") >= _shared_by(need))
    return classes.join(materialize(enough.select("rep"), "alive"), "rep", "left_semi")


def similar_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, stride: int = STRIDE, similarity: float = SIMILARITY) -> DataFrame:
    """(a_id, b_id, jaccard) of all pairs of class representatives with at least the similarity, a_id < b_id.

    Prefix filtering: sets that similar share a gram among the rarest |S| - ceil(similarity * |S|) + 1 of each,
    so only those are joined and a gram that stands everywhere joins nothing. Candidates are verified on whole sets.
    Sets that have too few grams in common with any other are left out before grams are counted.
    """
    classes = with_shared_prefix(written_classes(docs, id_col, text_col, k, stride), similarity)
    posted = classes.select("rep", "n", F.explode("grams").alias("gram"))
    # Grams of one text only can't match, but they fill the prefix first: the rest is ordered by frequency.
    common = posted.withColumn("df", F.count("*").over(Window.partitionBy("gram"))).where("df > 1")
    shared = common.groupBy("rep").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("shared"))
    need = F.ceil(F.lit(similarity) * F.col("n") - 1e-9)
    prefix = F.slice("shared", F.lit(1), F.greatest((F.size("shared") - need + 1).cast("int"), F.lit(0)))
    lists = materialize(shared.select("rep", "n", F.col("shared.gram").alias("grams"), prefix["gram"].alias("prefix")).where(F.size("prefix") > 0), "prefixes")
    index = lists.select("rep", "n", F.explode("prefix").alias("gram"))
    # Sets that are too unlike in size can't be similar: such pairs end before any set travels for them.
    alike = F.least("a_n", "b_n") >= F.lit(similarity) * F.greatest("a_n", "b_n") - 1e-9
    met = index.select(F.col("rep").alias("a_id"), F.col("n").alias("a_n"), "gram").join(index.select(F.col("rep").alias("b_id"), F.col("n").alias("b_n"), "gram"), "gram")
    pairs = met.where(F.col("a_id") < F.col("b_id")).where(alike).select("a_id", "b_id").distinct()
    full = pairs.join(lists.select(F.col("rep").alias("a_id"), F.col("n").alias("a_n"), F.col("grams").alias("a_grams")), "a_id").join(lists.select(F.col("rep").alias("b_id"), F.col("n").alias("b_n"), F.col("grams").alias("b_grams")), "b_id")
    inter = F.size(F.array_intersect("a_grams", "b_grams"))
    jaccard = inter / (F.col("a_n") + F.col("b_n") - inter)
    return full.select("a_id", "b_id", jaccard.alias("jaccard")).where(F.col("jaccard") >= similarity)


def memberships(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, stride: int = STRIDE) -> DataFrame:
    """(id, rep): the representative of each text's class."""
    rows = gram_sets(docs, id_col, text_col, k, stride)
    classes = rows.groupBy("grams").agg(F.min("id").alias("rep"))
    return rows.join(classes, "grams").select("id", "rep")
