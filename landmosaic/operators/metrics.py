"""Ranking and calibration metrics over scores, computed from pre-aggregated score counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import cross_entropy, probability
from .ranks import running


def views_averaged(scores: DataFrame, key: str = "point_id") -> DataFrame:
    """One row per point: mean logit over its views; the label must be the same in all of them."""
    return scores.groupBy(key).agg(F.avg("logit").alias("logit"), F.min("y").alias("y"), F.max("y").alias("hi_")).where(F.assert_true(F.col("y") == F.col("hi_"), F.lit("a point has two labels")).isNull()).drop("hi_")


def by_score(df: DataFrame, group: tuple[str, ...] = (), score: str = "logit") -> DataFrame:
    """Counts of rows and positives by score: all that ranking metrics need."""
    return df.groupBy(*group, F.col(score).alias("s")).agg(F.count("*").alias("c"), F.sum("y").cast("double").alias("pos"))


def roc_auc(df: DataFrame, group: tuple[str, ...] = (), score: str = "logit") -> DataFrame:
    """Mann-Whitney AUC with average ranks for ties; NULL if one class is missing. Ranks run over distinct scores."""
    r = running(by_score(df, group, score), ["s"], group, ("c",)).withColumn("rank", F.col("run_c") - F.col("c") + (F.col("c") + 1) / 2)
    p, n = F.sum("pos"), F.sum(F.col("c") - F.col("pos"))
    auc = F.when((p > 0) & (n > 0), (F.sum(F.col("rank") * F.col("pos")) - p * (p + 1) / 2) / (p * n))
    return r.groupBy(*group).agg(auc.alias("auc"))


def average_precision(df: DataFrame, key: str = "point_id", group: tuple[str, ...] = (), score: str = "logit") -> DataFrame:
    """Mean precision at the positives, by descending score, ties by key."""
    at = running(df, [F.desc(score), F.col(key)], group, ("y",))
    return at.groupBy(*group).agg((F.sum(F.when(F.col("y") == 1, F.col("run_y") / F.col("pos_"))) / F.sum("y")).alias("ap"))


def best_threshold(df: DataFrame, score: str = "logit") -> DataFrame:
    """threshold, accuracy of the first accuracy maximum: midway between neighbouring scores, 1e-6 beyond the ends."""
    c = running(by_score(df, (), score), ["s"], (), ("c", "pos"))
    totals = c.agg(F.sum("c").alias("n_"), F.sum("pos").alias("p_"), F.max("s").alias("top_"))
    previous = c.select((F.col("pos_") + 1).alias("pos_"), F.col("s").alias("prev"))
    lost = F.col("run_pos") - F.col("pos")
    low = c.join(previous, "pos_", "left").withColumns({"lost": lost, "below": F.col("run_c") - F.col("c") - lost}).crossJoin(F.broadcast(totals))
    cut = low.select(F.coalesce((F.col("s") + F.col("prev")) / 2, F.col("s") - 1e-6).alias("threshold"), ((F.col("below") + F.col("p_") - F.col("lost")) / F.col("n_")).alias("accuracy"))
    end = totals.select((F.col("top_") + 1e-6).alias("threshold"), ((F.col("n_") - F.col("p_")) / F.col("n_")).alias("accuracy"))
    return cut.unionByName(end).orderBy(F.desc("accuracy"), "threshold").limit(1)


def best_cut(df: DataFrame, key: str = "point_id", score: str = "logit") -> DataFrame:
    """threshold, correct of the first best place to cut the rows in order of score (ties by key): places inside a tie count too.

    Midway between the scores at the place, 1e-6 beyond the ends.
    """
    at = running(df.select(key, score, "y"), [score, key], (), ("y",)).select(F.col("pos_").alias("k"), F.col(score).alias("s"), F.col("run_y").alias("below"))
    totals = F.broadcast(df.agg(F.sum("y").alias("p_"), F.count("*").alias("n_"), F.min(score).alias("low_"), F.max(score).alias("top_")))
    cuts = at.crossJoin(totals).select("k", (F.col("k") - 2 * F.col("below") + F.col("p_")).alias("correct")).unionByName(totals.select(F.lit(0).cast("long").alias("k"), F.col("p_").alias("correct")))
    best = cuts.orderBy(F.desc("correct"), "k").limit(1).crossJoin(totals).withColumnRenamed("k", "cut_")
    near = at.join(F.broadcast(best), F.expr("k BETWEEN cut_ AND cut_ + 1")).groupBy("cut_").agg(F.avg("s").alias("mid_"), F.first("correct").alias("correct"), F.first("n_").alias("n_"), F.first("low_").alias("low_"), F.first("top_").alias("top_"))
    threshold = F.when(F.col("cut_") == 0, F.col("low_") - 1e-6).when(F.col("cut_") >= F.col("n_"), F.col("top_") + 1e-6).otherwise(F.col("mid_"))
    return near.select(threshold.alias("threshold"), "correct")


def summary(df: DataFrame) -> DataFrame:
    """Accuracy, strict accuracy (0.75 / 0.25 band), hedged share, predicted-positive share, logit mean and deviation, losses, collapse flag."""
    p, y = probability(F.col("logit")), F.col("y")
    strict = (p >= 0.75) & (y == 1) | (p <= 0.25) & (y == 0)
    share = lambda c: 100.0 * F.avg(c.cast("double"))
    out = df.agg(
        share((F.col("logit") > 0) == (y == 1)).alias("accuracy"), share(strict).alias("strict"), share((p > 0.25) & (p < 0.75)).alias("hedged"),
        share(F.col("logit") > 0).alias("predicted_positive"), F.avg("logit").alias("logit_mean"), F.stddev_pop("logit").alias("logit_std"),
        F.avg((p - y) ** 2).alias("brier"), F.avg(cross_entropy(F.col("logit"), y)).alias("nll"),
    )
    return out.withColumn("collapsed", (F.col("predicted_positive") < 5) | (F.col("predicted_positive") > 95) | (F.col("logit_std") < 0.05))


def reliability(df: DataFrame, bins: int = 15, temperature: float = 1.0) -> DataFrame:
    """bin, bin_lo, bin_hi, count, mean_pred, observed, gap; empty bins are there with count 0."""
    p = probability(F.col("logit"), temperature)
    got = df.select(F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int").alias("bin"), p.alias("p"), "y").groupBy("bin").agg(F.count("*").alias("count"), F.avg("p").alias("mean_pred"), F.avg("y").alias("observed"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = every.join(F.broadcast(got), "bin", "left").select("bin", (F.col("bin") / bins).alias("bin_lo"), ((F.col("bin") + 1) / bins).alias("bin_hi"), F.coalesce("count", F.lit(0)).alias("count"), "mean_pred", "observed")
    return out.withColumn("gap", F.abs(F.col("mean_pred") - F.col("observed")))


def calibration_error(bins: DataFrame) -> DataFrame:
    return bins.agg((F.sum(F.col("gap") * F.col("count")) / F.sum("count")).alias("ece"), F.max("gap").alias("mce"))


def fit_temperature(df: DataFrame, low: float = 0.02, high: float = 20.0, points: int = 33, rounds: int = 6) -> float:
    """The scale on the logits that minimises the NLL (convex): each round evaluates a geometric grid in one aggregate and narrows it."""
    counts = df.groupBy("logit", "y").agg(F.count("*").alias("c")).cache()
    lo, hi = low, high
    for _ in range(rounds):
        grid = [lo * (hi / lo) ** (i / (points - 1)) for i in range(points)]
        scales = F.broadcast(df.sparkSession.createDataFrame(list(enumerate(grid)), "i int, g double"))
        loss = F.sum(F.col("c") * cross_entropy(F.col("logit") * F.col("g"), F.col("y")))
        row = counts.crossJoin(scales).groupBy("i").agg(loss.alias("loss")).where("loss is not null").orderBy("loss", "i").first()
        if row is None:
            counts.unpersist()
            return 1.0
        lo, hi = grid[max(0, row["i"] - 1)], grid[min(points - 1, row["i"] + 1)]
    counts.unpersist()
    return (lo * hi) ** 0.5


def calibration_report(df: DataFrame, key: str = "point_id", bins: int = 15) -> DataFrame:
    """stage (before, after), temperature, brier, nll, ece, mce, auc, ap, ranking_preserved (both stages have the same AUC) and verdict.

    The temperature divides the logits; above 1.05 the scores were overconfident, below 0.95 underconfident.
    """
    temperature = 1 / fit_temperature(df)
    verdict = "overconfident" if temperature > 1.05 else "underconfident" if temperature < 0.95 else "calibrated"
    both = None
    for stage, t in (("before", 1.0), ("after", temperature)):
        at = df.withColumn("logit", F.col("logit") / t)
        row = summary(at).select(F.lit(stage).alias("stage"), F.lit(temperature).alias("temperature"), "brier", "nll")
        row = row.crossJoin(calibration_error(reliability(at, bins))).crossJoin(roc_auc(at)).crossJoin(average_precision(at, key))
        both = row if both is None else both.unionByName(row)
    every = Window.partitionBy(F.lit(1))  # two rows
    same = F.max("auc").over(every) - F.min("auc").over(every) < 1e-9
    return both.withColumn("ranking_preserved", same).withColumn("verdict", F.lit(verdict))


def divergence(history: DataFrame, patience: int = 3) -> DataFrame:
    """run_id, epoch at which the guard fires: strict rises while auc and ap fall for `patience` epochs; the streak then starts anew."""
    by = Window.partitionBy("run_id").orderBy("epoch")
    bad = (F.col("strict") > F.lag("strict").over(by)) & (F.col("auc") < F.lag("auc").over(by)) & (F.col("ap") < F.lag("ap").over(by))
    marked = history.withColumn("bad_", F.coalesce(bad, F.lit(False))).withColumn("seq_", F.row_number().over(by))
    island = marked.where("bad_").withColumn("isle_", F.col("seq_") - F.row_number().over(by))
    place = F.row_number().over(Window.partitionBy("run_id", "isle_").orderBy("epoch"))
    return island.withColumn("place_", place).where(F.col("place_") % patience == 0).select("run_id", "epoch")


def best_so_far(history: DataFrame, metric: str = "auc") -> DataFrame:
    """history rows that strictly improve the metric of their run."""
    before = Window.partitionBy("run_id").orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    return history.withColumn("best_", F.max(metric).over(before)).where(F.col("best_").isNull() | (F.col(metric) > F.col("best_"))).drop("best_")


def ensemble(members: DataFrame) -> DataFrame:
    """point_id, y, logit: members' logits z-scored within each member (population deviation + 1e-9), then averaged."""
    stats = members.groupBy("member").agg(F.avg("logit").alias("m_"), (F.stddev_pop("logit") + 1e-9).alias("s_"))
    z = members.join(F.broadcast(stats), "member").withColumn("z_", (F.col("logit") - F.col("m_")) / F.col("s_"))
    return z.groupBy("point_id", "y").agg(F.avg("z_").alias("logit"))
