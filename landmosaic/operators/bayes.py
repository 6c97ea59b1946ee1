"""A weighted naive Bayes on class codes: grouped log-odds, nothing else."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .patches import few
from .shared import saved


def fitted(rows: DataFrame, features: tuple[str, ...], smoothing: float = 1.0) -> tuple[DataFrame, float]:
    """feature, code, log_odds of every code seen, and the prior log-odds (rows: features, y, weight; NULL weights count as 1).

    log_odds is ln of the code's smoothed share of the positives' weight over that of the negatives'; the smoothing is added to
    each code's weight on both sides. One pass: the rows are grouped to codes before anything is compared.
    """
    weight = F.coalesce(F.col("weight").cast("double"), F.lit(1.0))
    codes = F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("code")) for f in features))
    side = lambda y, w: F.sum(F.when(F.col("y") == y, w).otherwise(0.0))
    each = rows.select("y", weight.alias("w"), F.explode(codes).alias("k")).where("k.code IS NOT NULL").groupBy("k.feature", "k.code").agg(side(1, F.col("w")).alias("pos"), side(0, F.col("w")).alias("neg"))
    totals = each.groupBy("feature").agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"), F.count("*").alias("kinds"))
    share = lambda n, all_n: (F.col(n) + smoothing) / (F.col(all_n) + smoothing * F.col("kinds"))
    table = saved(each.join(F.broadcast(totals), "feature").select("feature", "code", F.log(share("pos", "all_pos") / share("neg", "all_neg")).alias("log_odds")))
    pos, neg = rows.agg(side(1, weight), side(0, weight)).first()
    return table, math.log(((pos or 0.0) + smoothing) / ((neg or 0.0) + smoothing))


def with_logit(df: DataFrame, model: tuple[DataFrame, float], features: tuple[str, ...]) -> DataFrame:
    """df with logit: the prior and the log-odds of each feature's code; codes never seen, and NULL, add nothing."""
    table, prior = model
    out = df
    for f in features:
        one = few(table.where(F.col("feature") == f)).select(F.col("code").alias(f"code_{f}"), F.col("log_odds").alias(f"odds_{f}"))
        out = out.join(one, F.col(f).cast("string") == F.col(f"code_{f}"), "left").drop(f"code_{f}")
    total = reduce(lambda a, b: a + b, (F.coalesce(f"odds_{f}", F.lit(0.0)) for f in features), F.lit(prior))
    return out.withColumn("logit", total).drop(*(f"odds_{f}" for f in features))
