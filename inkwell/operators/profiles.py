"""Style profiles of authors and how like them a text is."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import lexicons as lx
from inkwell.functions import text as tx
from inkwell.operators import stylometry
from inkwell.operators.medians import medians
from inkwell.operators.skew import join_groups
from inkwell.storage import materialize

MAD_TO_DEVIATION, TINY = 1.4826, 1e-6
# The weights of the heuristic blend, and the thresholds of scores that a fitted verifier gave.
HEURISTIC = {"sim_char": 0.35, "sim_word": 0.25, "stylo_cosine": 0.15, "stylo_delta_sim": 0.25}
MATCH, MISMATCH = 0.9261, 0.7589
SHORT_WORDS, UNSURE_WORDS = 200, 800
LEAST_TEXTS, LEAST_WORDS, GOOD_TEXTS, GOOD_WORDS, SHORT_TEXT, LOOSE = 3, 1500, 5, 4000, 150, 0.15
ROUNDS = 30
#: Measures of a text by view, and where each view stands among them.
VIEWS = {"stylo": 19, "fw": len(lx.FUNCTION_WORDS), "pu": len(lx.PUNCTUATION)}
STYLO = slice(0, 19)
FW = slice(19, 19 + VIEWS["fw"])
PU = slice(19 + VIEWS["fw"], 19 + VIEWS["fw"] + VIEWS["pu"])
ALIKE = ("stylo_cosine", "stylo_delta_sim", "fw_cos", "fw_delta", "pu_cos", "pu_delta")
#: Words from which a paragraph's style is judged, the score up to which its tier is red, and from which it is green.
STYLE_WORDS, STYLE_RED, STYLE_GREEN = 25, 0.33, 0.80


def dense_views(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, views): the surface measures, shares of function words and marks of each text in one array, by row."""
    keyed = texts.select(F.struct(F.col(id_col).alias("id"), F.col(text_col).alias("text")).alias("key"), F.col(text_col).alias("text"))
    stylo = stylometry.stylometry(keyed, "key")
    rows = stylo.select("key.*", F.array(*(F.col(c).cast("double") for c in stylo.columns[1:])).alias("stylo"))
    rows = stylometry.word_shares(rows.withColumn("tok", tx.matches(F.lower("text"), "[a-z']+")))
    n_chars = F.greatest(F.length("text"), F.lit(1))
    pu = F.array(*(tx.occurrences(F.col("text"), p) / n_chars * 1000.0 for p in lx.PUNCTUATION))
    return rows.select("id", "text", F.concat("stylo", "fw", pu).alias("views"))


def profile_stats(rows: DataFrame, n_measures: int) -> DataFrame:
    """(author, n, mean, sd, median, mad), written: arrays over the first measures of rows (author, views); medians are exact, also of authors with most of the texts."""
    keys = ["author", "feature"]
    long = rows.select("author", F.posexplode_outer(F.slice("views", 1, n_measures)).alias("feature", "value")).where("feature is not null and author is not null")
    first = long.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    middle = materialize(medians(long, keys, "value"), "medians")
    packed = middle.groupBy("author").agg(F.array_sort(F.collect_list(F.struct("feature", "median"))).getField("median").alias("middle"))  # a row for each measure
    sizes = long.where("feature = 0").groupBy("author").agg(F.count("*").alias("n_texts"))
    groups = materialize(packed.join(sizes, "author"), "middles")
    wide = join_groups(rows.select("author", F.slice("views", 1, n_measures).alias("views")).where("views is not null"), groups, ["author"], "n_texts", "views")
    gaps = wide.select("author", F.posexplode_outer(F.zip_with("views", "middle", lambda v, m: F.abs(v - m))).alias("feature", "gap")).where("feature is not null")
    spread = medians(materialize(gaps, "gaps"), keys, "gap").select(*keys, (F.col("median") * MAD_TO_DEVIATION).alias("mad"))
    both = first.join(middle, keys).join(spread, keys)
    stats = F.array_sort(F.collect_list(F.struct("feature", "mean", "sd", "median", "mad"))).alias("f")
    return materialize(both.groupBy("author").agg(F.max("n").alias("n"), stats).select("author", "n", *(F.col(f"f.{c}").alias(c) for c in ("mean", "sd", "median", "mad"))), "profiles")


def _alike(mu: np.ndarray, sd: np.ndarray):
    """Arrow function: texts with their author's measures to the six likenesses of views."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                of = {c: part.column(c).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1) for c in ("views", "mean", "smean", "ssd", "median", "mad")}
                z, p = (of["views"] - mu) / sd, (of["mean"] - mu) / sd
                scale = np.where(of["mad"] > TINY, of["mad"], np.where(of["ssd"] > TINY, of["ssd"], 1.0))
                out = []
                for view in (STYLO, FW, PU):
                    a, b = z[:, view], p[:, view]
                    norm = np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
                    dot = (a * b).sum(axis=1)
                    out.append((np.divide(dot, norm, out=np.zeros_like(dot), where=norm > 0) + 1) / 2)
                    out.append(1 / (1 + ((np.abs(of["views"][:, STYLO] - of["median"]) / scale) if view is STYLO else np.abs(a - b)).mean(axis=1)))
                yield pa.RecordBatch.from_arrays([part.column("id"), *map(pa.array, out)], names=["id", *ALIKE])

    return run


def view_similarity(rows: DataFrame) -> DataFrame:
    """(id, stylo_cosine, stylo_delta_sim, fw_cos, fw_delta, pu_cos, pu_delta) of each text with its author's profile; rows is written (id, author, views).

    A text's measures stay in one row; medians are made of the surface measures alone, which are all that is compared by them.
    """
    rows = rows.where("views is not null and author is not null")
    entry = rows.select("author", F.posexplode_outer("views").alias("feature", "value"))
    means = entry.groupBy("author", "feature").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))
    world = entry.groupBy("feature").agg(F.avg("value").alias("mu"), F.stddev_pop("value").alias("sd")).collect()  # a row for each measure
    size = sum(VIEWS.values())
    mu, sd = np.zeros(size), np.ones(size)
    for r in world:
        mu[r["feature"]], spread = r["mu"], r["sd"]
        sd[r["feature"]] = (spread if spread > 0 else 1.0) if r["feature"] < STYLO.stop else spread + TINY
    made = means.groupBy("author").agg(F.array_sort(F.collect_list(F.struct("feature", "mean"))).getField("mean").alias("mean"), F.max("n").alias("n_texts"))
    stats = profile_stats(rows, STYLO.stop).select("author", F.col("mean").alias("smean"), F.col("sd").alias("ssd"), "median", "mad")
    groups = materialize(made.join(stats, "author"), "view-profiles")
    met = join_groups(rows, groups, ["author"], "n_texts", "id").select("id", "views", "mean", "smean", "ssd", "median", "mad")
    return met.mapInArrow(_alike(mu, sd), f"id {dict(rows.dtypes)['id']}, " + ", ".join(f"{c} double" for c in ALIKE))


def quality_level(n_texts: Column, words: Column, n_short: Column, consistency_: Column) -> Column:
    doubt = (n_short == n_texts) | ((consistency_ < LOOSE) & (n_texts >= 2))
    return F.when((n_texts < LEAST_TEXTS) | (words < LEAST_WORDS), "insufficient").when(doubt, "limited").when((n_texts >= GOOD_TEXTS) & (words >= GOOD_WORDS), "good").otherwise("adequate")


def interactions(rows: DataFrame) -> DataFrame:
    """rows with lq, lp, ln and the products of five similarities with lq and ln."""
    for base in ("sim_char", "sim_word", "stylo_delta_sim", "fw_delta", "fw_cos"):
        rows = rows.withColumn(f"{base}_x_lq", F.col(base) * F.col("lq")).withColumn(f"{base}_x_ln", F.col(base) * F.col("ln"))
    return rows


def verdict(words: Column, quality: Column, foreign: Column, score: Column, match: float = MATCH, mismatch: float = MISMATCH) -> Column:
    """In this order: short texts, weak profiles and foreign scripts are uncertain, then the thresholds decide."""
    return F.when((words < SHORT_WORDS) | (quality == "insufficient") | foreign, "UNCERTAIN").when(score >= match, "MATCH").when(score <= mismatch, "MISMATCH").otherwise("UNCERTAIN")


def confidence(words: Column, quality: Column, score: Column, match: float = MATCH, mismatch: float = MISMATCH) -> Column:
    sure = (score >= match) | (score <= mismatch)
    return F.when(words < UNSURE_WORDS, "very_low").when((quality == "insufficient") | ~sure, "low").when(quality == "limited", "medium").otherwise("high")


def blended(score: Column, impostor_score: Column, n_texts: Column) -> Column:
    """The score joined with the share of impostors beaten, which counts for less the more texts a profile has."""
    weight = F.least(F.greatest(0.5 - 0.05 * n_texts, F.lit(0.05)), F.lit(0.45))
    return (1 - weight) * score + weight * impostor_score


def reason(words: Column, quality: Column, foreign: Column) -> Column:
    """Why a verdict is withheld whatever the score: short, profile or script; empty where the score decides."""
    return F.when(words < SHORT_WORDS, "short").when(quality == "insufficient", "profile").when(foreign, "script").otherwise("")


def deduplicated(texts: DataFrame, author: str = "author", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(author, fingerprint, id, n_words, n_copies): of an author's texts that are alike but for case and blanks, the one of the smallest id."""
    rows = texts.select(F.col(author).alias("author"), tx.fingerprint(F.col(text_col)).alias("fingerprint"), F.col(id_col).alias("id"), tx.word_count(F.col(text_col)).alias("n_words"))
    return rows.groupBy("author", "fingerprint").agg(F.min("id").alias("id"), F.min_by("n_words", "id").alias("n_words"), F.count("*").alias("n_copies"))


def style_tier(x: Column) -> Column:
    return F.when(x <= STYLE_RED, "red").when(x >= STYLE_GREEN, "green").when(x.isNotNull(), "yellow")
