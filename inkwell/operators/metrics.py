"""Verification metrics from a histogram of scores: thresholds, error rates and areas."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.storage import materialize

TARGET_FAR, LOW_GENUINE = 0.02, 0.05
#: Places that scores are kept to: the histogram then has 10^PLACES + 1 rows at most, whatever the input.
PLACES = 4


def histogram(scores: DataFrame, score: str = "score", positive: str = "positive") -> DataFrame:
    """(score, pos, neg): pairs by score in [0, 1], kept to PLACES; rows without a score are left out."""
    binned = scores.where(F.col(score).isNotNull()).select(F.floor(F.col(score) * 10**PLACES + 0.5).cast("int").alias("bin"), F.col(positive).alias("p"))
    got = binned.groupBy("bin").agg(F.count_if("p").alias("pos"), F.count_if(~F.col("p")).alias("neg"))
    return materialize(got.select((F.col("bin") / 10**PLACES).alias("score"), "pos", "neg"), "histogram")


def exact_curve(scores: DataFrame, score: str = "score", positive: str = "positive", parts: int = 64) -> DataFrame:
    """The curve over every distinct score, not kept to places: (score, pos, neg, n_pos, n_neg, pos_below, neg_below, far, frr).

    Scores are dealt to ranges and summed within each; the sums of the ranges, `parts` rows, come before them.
    """
    known = scores.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("score")).agg(F.count_if(positive).alias("pos"), F.count_if(~F.col(positive)).alias("neg"))
    ranged = materialize(known.repartitionByRange(parts, "score").withColumn("part", F.spark_partition_id()), "scores")
    sums = ranged.groupBy("part").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    before, all_ = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ahead = sums.select("part", F.coalesce(F.sum("p").over(before), F.lit(0)).alias("p0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.sum("p").over(all_).alias("n_pos"), F.sum("n").over(all_).alias("n_neg"))
    up = Window.partitionBy("part").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.withColumns({"pos_below": F.coalesce(F.sum("pos").over(up), F.lit(0)), "neg_below": F.coalesce(F.sum("neg").over(up), F.lit(0))}).join(F.broadcast(ahead), "part")
    out = out.select("score", "pos", "neg", "n_pos", "n_neg", (F.col("pos_below") + F.col("p0")).alias("pos_below"), (F.col("neg_below") + F.col("n0")).alias("neg_below"))
    return _rates(out)


def _rates(out: DataFrame) -> DataFrame:
    far = F.try_divide((F.col("n_neg") - F.col("neg_below")).cast("double"), F.col("n_neg"))
    return out.withColumns({"far": far, "frr": F.try_divide(F.col("pos_below").cast("double"), F.col("n_pos"))})


def curve(hist: DataFrame) -> DataFrame:
    """hist with totals, pairs below and at or above each score, and FAR and FRR there. One window over the bounded histogram; an exact curve stays as it is."""
    if "far" in hist.columns:
        return hist
    up, all_ = Window.orderBy("score").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("score").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = hist.withColumns({"n_pos": F.sum("pos").over(all_), "n_neg": F.sum("neg").over(all_), "pos_below": F.coalesce(F.sum("pos").over(up), F.lit(0)), "neg_below": F.coalesce(F.sum("neg").over(up), F.lit(0))})
    return _rates(out)


def _at_rank(hits: str, below: str, rank):
    """The least score at which more than `rank` (from 0) of the class lie at or below."""
    return F.min(F.when((F.col(below) + F.col(hits) > rank) & (F.col(hits) > 0), F.col("score")))


def thresholds(c: DataFrame, target: float = TARGET_FAR, low: float = LOW_GENUINE) -> DataFrame:
    """One row: the score that leaves at most the target FAR, and the low percentile of genuine pairs; they meet halfway if crossed."""
    n = F.col("n_neg")
    match = _at_rank("neg", "neg_below", F.least(F.ceil((1 - target) * n), n - 1))
    at = low * (F.col("n_pos") - 1)
    lower, upper = _at_rank("pos", "pos_below", F.floor(at)), _at_rank("pos", "pos_below", F.ceil(at))
    got = c.agg(F.coalesce(match, F.lit(0.5)).alias("match"), lower.alias("a"), upper.alias("b"), F.max(at - F.floor(at)).alias("f"))
    got = got.select("match", F.coalesce(F.col("a") + F.col("f") * (F.col("b") - F.col("a")), F.lit(0.3)).alias("mismatch"))
    crossed = F.col("mismatch") > F.col("match")
    mid = (F.col("match") + F.col("mismatch")) / 2
    return got.select("match", "mismatch", F.when(crossed, mid).otherwise(F.col("match")).alias("use_match"), F.when(crossed, mid).otherwise(F.col("mismatch")).alias("use_mismatch"))


def equal_error(c: DataFrame) -> DataFrame:
    """One row: the first score at which FAR and FRR are nearest, and their mean there."""
    best = c.agg(F.min(F.struct(F.abs(F.col("far") - F.col("frr")).alias("gap"), "score", "far", "frr")).alias("b"))
    return best.select(((F.col("b.far") + F.col("b.frr")) / 2).alias("eer"), F.col("b.score").alias("eer_threshold"))


def areas(c: DataFrame) -> DataFrame:
    """One row: area under the ROC curve (ties count half) and average precision."""
    above_pos, above_neg = F.col("n_pos") - F.col("pos_below"), F.col("n_neg") - F.col("neg_below")
    roc = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0)) / F.max(F.col("n_pos") * F.col("n_neg"))
    ap = F.sum(F.try_divide(F.col("pos") * above_pos.cast("double"), above_pos + above_neg)) / F.max("n_pos")
    return c.agg(roc.alias("roc_auc"), ap.alias("pr_auc"))


def rates_at(c: DataFrame, threshold: float):
    """(FAR, FRR) aggregates at a threshold."""
    far = F.sum(F.when(F.col("score") >= threshold, F.col("neg")).otherwise(0)) / F.max("n_neg")
    frr = F.sum(F.when(F.col("score") < threshold, F.col("pos")).otherwise(0)) / F.max("n_pos")
    return far, frr


def report(c: DataFrame, target: float = TARGET_FAR) -> DataFrame:
    """One row with all metrics. Two passes over the bounded histogram: the thresholds first."""
    t = thresholds(c, target).first()
    far, frr = rates_at(c, t["match"])
    row = c.agg(F.max("n_pos").alias("n_positive"), F.max("n_neg").alias("n_negative"), (F.sum(F.col("score") * F.col("pos")) / F.max("n_pos")).alias("mean_positive_score"), (F.sum(F.col("score") * F.col("neg")) / F.max("n_neg")).alias("mean_negative_score"), far.alias("far_at_match"), frr.alias("frr_at_match"))
    e, a = equal_error(c).first(), areas(c).first()
    return row.withColumns({k: F.lit(v) for k, v in (("roc_auc", a["roc_auc"]), ("pr_auc", a["pr_auc"]), ("eer", e["eer"]), ("eer_threshold", e["eer_threshold"]), ("threshold_match", t["match"]), ("threshold_mismatch", t["mismatch"]))}).withColumn("tpr_at_far", 1 - F.col("frr_at_match"))
