"""Queries over scores: ranking, calibration, histories, ensembles, models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores as C
from ..operators import metrics as M
from ..operators import sampling as S
from ..operators.shared import saved
from .fixtures import fx, with_fx
from .habitat import used
from .registry import query

SC = with_fx("fx_scores")
PT = f"{SC}, pt AS (SELECT point_id, avg(logit) AS logit, min(y) AS y FROM fx_scores GROUP BY 1)"
P_ = "(1 / (1 + exp(-logit)))"


def points(spark, sf):
    return M.views_averaged(fx(spark, sf, "fx_scores"))


@query(f"{PT} SELECT point_id, round(logit, 9) AS logit, y FROM pt")
def view_average(spark, sf):
    """D24, G7."""
    return points(spark, sf).select("point_id", F.round("logit", 9).alias("logit"), "y")


CE = "(greatest(logit, 0) - logit * y + ln(1 + exp(-abs(logit))))"


@query(f"""{SC} SELECT y, round(avg({P_}), 9) AS p, round(avg((CASE WHEN y > 0.5 THEN 0.25 ELSE 0.75 END) * pow(1 - exp(-{CE}), 2) * {CE}), 9) AS focal, round(sum({CE}), 5) AS ce FROM fx_scores GROUP BY y""")
def losses(spark, sf):
    """B27, B28."""
    s = fx(spark, sf, "fx_scores")
    return s.groupBy("y").agg(F.round(F.avg(C.probability(F.col("logit"))), 9).alias("p"), F.round(F.avg(C.focal_loss(F.col("logit"), F.col("y"))), 9).alias("focal"), F.round(F.sum(C.cross_entropy(F.col("logit"), F.col("y"))), 5).alias("ce"))


SHIFT = "(logit - CASE WHEN y > 0.5 THEN ln(3) ELSE -ln(3) END)"
SOFT = "(y * 0.95 + 0.025)"
SOFT_CE = f"(greatest({SHIFT}, 0) - {SHIFT} * {SOFT} + ln(1 + exp(-abs({SHIFT}))))"


@query(f"""{SC} SELECT y, round(avg((CASE WHEN {SOFT} > 0.5 THEN 0.25 ELSE 0.75 END) * pow(1 - exp(-{SOFT_CE}), 2) * {SOFT_CE} * (1 + point_id % 3)), 8) AS loss FROM fx_scores GROUP BY y""")
def training_loss(spark, sf):
    """Smoothing, strict margin, sample weight."""
    return fx(spark, sf, "fx_scores").groupBy("y").agg(F.round(F.avg(C.training_loss(F.col("logit"), F.col("y"), 1.0 + F.col("point_id") % 3)), 8).alias("loss"))


@query(f"""{PT}, r AS (SELECT logit, y, rank() OVER (ORDER BY logit) + (count(*) OVER (PARTITION BY logit) - 1) / 2e0 AS rk FROM pt) SELECT round((sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2e0) / (sum(y) * (count(*) - sum(y))), 9) AS auc FROM r""")
def roc_auc(spark, sf):
    """E4."""
    return M.roc_auc(points(spark, sf)).select(F.round("auc", 9).alias("auc"))


@query(f"""{PT}, r AS (SELECT y, sum(y) OVER w AS h, row_number() OVER w AS n FROM pt WINDOW w AS (ORDER BY logit DESC, point_id ROWS UNBOUNDED PRECEDING)) SELECT round(sum(h / CAST(n AS DOUBLE)) FILTER (y = 1) / sum(y), 9) AS ap FROM r""")
def average_precision(spark, sf):
    """E5."""
    return M.average_precision(points(spark, sf)).select(F.round("ap", 9).alias("ap"))


@query(f"""{PT}, s AS (SELECT DISTINCT logit FROM pt), o AS (SELECT logit, lag(logit) OVER (ORDER BY logit) AS prev FROM s), t AS (SELECT coalesce((logit + prev) / 2, logit - 1e-6) AS th FROM o UNION ALL SELECT max(logit) + 1e-6 FROM s)
SELECT round(th, 6) AS threshold, round(acc, 9) AS accuracy FROM (SELECT th, avg(CASE WHEN (logit > th) = (y = 1) THEN 1e0 ELSE 0e0 END) AS acc FROM t CROSS JOIN pt GROUP BY th) ORDER BY acc DESC, th LIMIT 1""")
def best_threshold(spark, sf):
    """E6."""
    return M.best_threshold(points(spark, sf)).select(F.round("threshold", 6).alias("threshold"), F.round("accuracy", 9).alias("accuracy"))


@query(f"""{PT} SELECT round(100 * avg(CASE WHEN (logit > 0) = (y = 1) THEN 1e0 ELSE 0e0 END), 9) AS accuracy, round(100 * avg(CASE WHEN ({P_} >= 0.75 AND y = 1) OR ({P_} <= 0.25 AND y = 0) THEN 1e0 ELSE 0e0 END), 9) AS strict, round(100 * avg(CASE WHEN {P_} > 0.25 AND {P_} < 0.75 THEN 1e0 ELSE 0e0 END), 9) AS hedged,
 round(100 * avg(CASE WHEN logit > 0 THEN 1e0 ELSE 0e0 END), 9) AS predicted_positive, round(avg(logit), 9) AS logit_mean, round(stddev_pop(logit), 9) AS logit_std, round(avg(pow({P_} - y, 2)), 9) AS brier, round(avg({CE}), 9) AS nll,
 100 * avg(CASE WHEN logit > 0 THEN 1e0 ELSE 0e0 END) < 5 OR 100 * avg(CASE WHEN logit > 0 THEN 1e0 ELSE 0e0 END) > 95 OR stddev_pop(logit) < 0.05 AS collapsed FROM pt""")
def score_summary(spark, sf):
    """D25, D26, D27, D31."""
    s = M.summary(points(spark, sf))
    return s.select(*(F.round(c, 9).alias(c) for c in s.columns if c != "collapsed"), "collapsed")


@query(f"""{PT}, b AS (SELECT CAST(least(floor({P_} * 15), 14) AS INT) AS bin, {P_} AS p, y FROM pt), g AS (SELECT bin, count(*) AS n, avg(p) AS m, avg(y) AS o FROM b GROUP BY bin)
SELECT CAST(d.bin AS INT) AS bin, coalesce(n, 0) AS count, round(m, 9) AS mean_pred, round(o, 9) AS observed, round(abs(m - o), 9) AS gap FROM (SELECT unnest(range(15)) AS bin) d LEFT JOIN g USING (bin)""")
def reliability(spark, sf):
    """D28."""
    return M.reliability(points(spark, sf)).select("bin", "count", *(F.round(c, 9).alias(c) for c in ("mean_pred", "observed", "gap")))


@query(f"""{PT}, b AS (SELECT CAST(least(floor({P_} * 15), 14) AS INT) AS bin, {P_} AS p, y FROM pt), g AS (SELECT count(*) AS n, abs(avg(p) - avg(y)) AS gap FROM b GROUP BY bin) SELECT round(sum(gap * n) / sum(n), 9) AS ece, round(max(gap), 9) AS mce FROM g""")
def calibration_error(spark, sf):
    """ECE and MCE."""
    return M.calibration_error(M.reliability(points(spark, sf))).select(F.round("ece", 9).alias("ece"), F.round("mce", 9).alias("mce"))


def _fit_sql() -> str:
    """Six rounds of a geometric grid of 33 scales, each narrowed to the neighbours of the least loss."""
    out, scaled = ["f0 AS (SELECT 0.02e0 AS lo, 20e0 AS hi)"], CE.replace("logit", "(logit * g)")
    for i in range(6):
        out.append(f"g{i} AS (SELECT i, lo * pow(hi / lo, i / 32e0) AS g FROM f{i}, (SELECT unnest(range(33)) AS i))")
        out.append(f"l{i} AS (SELECT i, any_value(g) AS g, sum({scaled}) AS loss FROM g{i}, pt GROUP BY i)")
        out.append(f"b{i} AS (SELECT arg_min(i, loss) AS b FROM l{i})")
        out.append(f"f{i + 1} AS (SELECT (SELECT g FROM l{i} WHERE i = greatest(0, b - 1)) AS lo, (SELECT g FROM l{i} WHERE i = least(32, b + 1)) AS hi FROM b{i})")
    return ", ".join(out) + ", fit AS (SELECT 1 / sqrt(lo * hi) AS t FROM f6)"


@query(f"""{PT}, {_fit_sql()}, st AS (SELECT 'before' AS stage, point_id, logit, y FROM pt UNION ALL SELECT 'after', point_id, logit / t, y FROM pt, fit), pr AS (SELECT *, {P_} AS p FROM st),
m AS (SELECT stage, avg(pow(p - y, 2)) AS brier, avg({CE}) AS nll FROM pr GROUP BY 1),
g AS (SELECT stage, count(*) AS n, abs(avg(p) - avg(y)) AS gap FROM (SELECT stage, least(floor(p * 15), 14) AS bin, p, y FROM pr) GROUP BY stage, bin), c AS (SELECT stage, sum(gap * n) / sum(n) AS ece, max(gap) AS mce FROM g GROUP BY 1),
k AS (SELECT stage, y, rank() OVER (PARTITION BY stage ORDER BY logit) + (count(*) OVER (PARTITION BY stage, logit) - 1) / 2e0 AS rk, sum(y) OVER w AS h, row_number() OVER w AS i FROM st WINDOW w AS (PARTITION BY stage ORDER BY logit DESC, point_id ROWS UNBOUNDED PRECEDING)),
a AS (SELECT stage, (sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2e0) / (sum(y) * (count(*) - sum(y))) AS auc, sum(h / CAST(i AS DOUBLE)) FILTER (y = 1) / sum(y) AS ap FROM k GROUP BY 1)
SELECT stage, round(t, 3) AS temperature, round(brier, 5) AS brier, round(nll, 5) AS nll, round(auc, 9) AS auc, round(ap, 9) AS ap, CASE WHEN stage = 'before' THEN round(ece, 9) ELSE round(ece, 3) END AS ece, CASE WHEN stage = 'before' THEN round(mce, 9) ELSE round(mce, 2) END AS mce,
 (SELECT max(auc) - min(auc) < 1e-9 FROM a) AS ranking_preserved, CASE WHEN t > 1.05 THEN 'overconfident' WHEN t < 0.95 THEN 'underconfident' ELSE 'calibrated' END AS verdict FROM m JOIN c USING (stage) JOIN a USING (stage), fit""")
def temperature_scaling(spark, sf):
    """The fitted temperature, metrics and ranking of the scores before and after, and the verdict. Figures that hang on the fit's last digits are rounded."""
    r = M.calibration_report(saved(points(spark, sf)))
    first = F.col("stage") == "before"
    return r.select("stage", F.round("temperature", 3).alias("temperature"), F.round("brier", 5).alias("brier"), F.round("nll", 5).alias("nll"), F.round("auc", 9).alias("auc"), F.round("ap", 9).alias("ap"),
                    F.when(first, F.round("ece", 9)).otherwise(F.round("ece", 3)).alias("ece"), F.when(first, F.round("mce", 9)).otherwise(F.round("mce", 2)).alias("mce"), "ranking_preserved", "verdict")


@query(f"""{PT}, o AS (SELECT logit AS s, row_number() OVER w AS k, 2 * sum(y) OVER w AS twice FROM pt WINDOW w AS (ORDER BY logit, point_id ROWS UNBOUNDED PRECEDING)), t AS (SELECT sum(y) AS p, count(*) AS n, min(logit) AS lo, max(logit) AS hi FROM pt),
c AS (SELECT k, k - twice + p AS correct FROM o, t UNION ALL SELECT 0, p FROM t), b AS (SELECT * FROM c ORDER BY correct DESC, k LIMIT 1)
SELECT round(CASE WHEN b.k = 0 THEN lo - 1e-6 WHEN b.k = n THEN hi + 1e-6 ELSE (SELECT avg(s) FROM o WHERE o.k BETWEEN b.k AND b.k + 1) END, 6) AS threshold, CAST(correct AS BIGINT) AS correct FROM b, t""")
def best_cut(spark, sf):
    """E6 with cuts inside ties."""
    return M.best_cut(points(spark, sf)).select(F.round("threshold", 6).alias("threshold"), F.col("correct").cast("long").alias("correct"))


EP = with_fx("fx_epochs")


@query(f"""{EP}, d AS (SELECT *, coalesce(strict > lag(strict) OVER w AND auc < lag(auc) OVER w AND ap < lag(ap) OVER w, false) AS bad, row_number() OVER w AS seq FROM fx_epochs WINDOW w AS (PARTITION BY run_id ORDER BY epoch)),
i AS (SELECT run_id, epoch, seq - row_number() OVER (PARTITION BY run_id ORDER BY epoch) AS isle FROM d WHERE bad), p AS (SELECT run_id, epoch, row_number() OVER (PARTITION BY run_id, isle ORDER BY epoch) AS place FROM i) SELECT k.k AS patience, run_id, epoch FROM p, (SELECT unnest([1, 2, 3]) AS k) k WHERE place % k.k = 0""")
def divergence_guard(spark, sf):
    """E7, with three limits of patience."""
    history = fx(spark, sf, "fx_epochs")
    each = [M.divergence(history, patience=k).select(F.lit(k).alias("patience"), "run_id", "epoch") for k in (1, 2, 3)]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query(f"""{EP} SELECT run_id, epoch, round(auc, 9) AS auc FROM (SELECT *, max(auc) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM fx_epochs) WHERE best IS NULL OR auc > best""")
def best_so_far(spark, sf):
    """E8."""
    return M.best_so_far(fx(spark, sf, "fx_epochs")).select("run_id", "epoch", F.round("auc", 9).alias("auc"))


def members(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    four = F.posexplode(F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double")))
    return e.select(F.col("vec_id").alias("point_id"), (F.col("label") % 2).alias("y"), four.alias("member", "logit"))


@query("""WITH m AS (SELECT vec_id AS point_id, label % 2 AS y, unnest([1, 2, 3, 4]) AS member, unnest([CAST(x AS DOUBLE) FOR x IN embedding[1:4]]) AS logit FROM embeddings),
z AS (SELECT point_id, y, (logit - avg(logit) OVER (PARTITION BY member)) / (stddev_pop(logit) OVER (PARTITION BY member) + 1e-9) AS z FROM m) SELECT point_id, y, round(avg(z), 7) AS logit FROM z GROUP BY 1, 2""")
def ensemble_scores(spark, sf):
    """E10."""
    return M.ensemble(members(spark, sf)).select("point_id", "y", F.round("logit", 7).alias("logit"))


@query(f"""{PT}, n AS (SELECT y, count(*) AS n FROM pt GROUP BY y),
s AS (SELECT b AS batch_id, s AS slot, CASE WHEN s < CASE WHEN b % 2 = 0 THEN 2 ELSE 6 END THEN 1 ELSE 0 END AS y FROM (SELECT unnest(range(0, CAST(2 * ceil((SELECT max(n) FROM n) / 8e0) AS BIGINT))) AS b), (SELECT unnest(range(8)) AS s)),
q AS (SELECT *, (b.batch_id // 2) * 8 + CASE WHEN batch_id % 2 = 1 THEN CASE WHEN y = 1 THEN 2 ELSE 6 END ELSE 0 END + CASE WHEN y = 1 THEN slot ELSE slot - CASE WHEN batch_id % 2 = 0 THEN 2 ELSE 6 END END AS place FROM s b),
c AS (SELECT DISTINCT y, place // n AS cyc FROM q JOIN n USING (y)),
r AS (SELECT point_id, y, cyc, row_number() OVER (PARTITION BY y, cyc ORDER BY ('0x' || substr(md5('42:' || cyc || ':' || point_id), 1, 13))::BIGINT, point_id) - 1 AS pos FROM pt JOIN c USING (y))
SELECT batch_id, CAST(slot AS INT) AS slot, point_id, CAST(r.y AS INT) AS y FROM q JOIN n USING (y) JOIN r ON r.y = q.y AND r.cyc = q.place // n.n AND r.pos = q.place % n.n""")
def balanced_batches(spark, sf):
    """E12."""
    return S.balanced_batches(points(spark, sf), "point_id").select("batch_id", "slot", "point_id", "y")


@query(None)
def suitability_model(spark, sf):
    """Part of M2 and M4: two differently configured, unweighted fits on the pixel under each point, their z-scored average and its AUC per member."""
    from .modelling import suitability

    return suitability(used(spark, sf))


@query("SELECT count(*) AS n, count(CASE WHEN len(embedding) > 0 THEN 1 END) AS usable, round(stddev_pop(CAST(embedding[1] AS DOUBLE)), 7) > 0 AS varied FROM embeddings")
def feed_check(spark, sf):
    """M5: inputs present and not constant."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    return e.agg(F.count("*").alias("n"), F.sum((F.size("embedding") > 0).cast("long")).alias("usable"), (F.round(F.stddev_pop(F.col("embedding")[0].cast("double")), 7) > 0).alias("varied"))
