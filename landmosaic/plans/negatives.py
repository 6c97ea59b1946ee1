"""Queries over candidate records: hygiene, distances, quotas, weighted negatives."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.binning import inverse_weight
from ..functions.geo import albers_sql, projected
from ..operators import points as P
from ..operators import sampling as S
from .fixtures import fx, with_fx
from .points import PROJ, habitat_points
from .registry import query

X, Y = albers_sql("lon", "lat")
CAND = with_fx("fx_candidates")
CERTAIN = "(coord_uncertainty_m IS NULL OR coord_uncertainty_m <= 1000)"
FIRST = f"{CAND}, ok AS (SELECT *, row_number() OVER (PARTITION BY round(lon, 5), round(lat, 5) ORDER BY gbif_id) AS rn FROM fx_candidates WHERE {CERTAIN})"
BOTH = f"{PROJ}, fx_candidates AS ({with_fx('fx_candidates').split('AS (', 1)[1][:-1]}), cand AS (SELECT gbif_id, {X} AS x, {Y} AS y FROM fx_candidates WHERE {CERTAIN})"
D2 = "(c.x - p.x) * (c.x - p.x) + (c.y - p.y) * (c.y - p.y)"


def candidates(spark, sf):
    return S.certain(fx(spark, sf, "fx_candidates"))


@query(f"{FIRST} SELECT gbif_id, year, species FROM ok WHERE rn = 1")
def candidate_hygiene(spark, sf):
    """Uncertain records out (unknown ones stay), the first of each rounded location stays."""
    return S.first_at_location(candidates(spark, sf), "gbif_id").select("gbif_id", "year", "species")


@query(f"{BOTH}, near AS (SELECT c.gbif_id, min(sqrt({D2})) AS d FROM cand c JOIN proj p ON abs(c.x - p.x) <= 1000 AND abs(c.y - p.y) <= 1000 WHERE sqrt({D2}) <= 1000 GROUP BY 1) SELECT c.gbif_id, round(d, 3) AS distance FROM cand c LEFT JOIN near USING (gbif_id)")
def nearest_sighting(spark, sf):
    """C12."""
    out = P.nearest_within(projected(candidates(spark, sf)), habitat_points(spark, sf), "gbif_id", 1000.0)
    return out.select("gbif_id", F.round("distance", 3).alias("distance"))


@query(f"{BOTH} SELECT gbif_id FROM cand c WHERE NOT EXISTS (SELECT 1 FROM proj p WHERE sqrt({D2}) <= 300)")
def buffer_exclusion(spark, sf):
    """C13."""
    return P.buffered_out(projected(candidates(spark, sf)), habitat_points(spark, sf), "gbif_id").select("gbif_id")


@query(f"""{CAND}, r AS (SELECT *, row_number() OVER (PARTITION BY species, year ORDER BY gbif_id) AS r FROM fx_candidates),
o AS (SELECT *, row_number() OVER (PARTITION BY species ORDER BY CASE WHEN r > 20 THEN 1 ELSE 0 END, year, r) AS o FROM r) SELECT gbif_id, species, year FROM o WHERE o <= 150""")
def quota_rollover(spark, sf):
    """E9."""
    return S.quota(fx(spark, sf, "fx_candidates"), ("species",), 20, 150, "gbif_id").select("gbif_id", "species", "year")


@query(f"""{CAND} SELECT species, count(*) AS held, CAST(ceil(200 * 6e0 / 6) AS BIGINT) AS cap, CAST(ceil(ceil(200 * 6e0 / 6) / 6) AS BIGINT) AS year_cap,
  CASE WHEN count(*) >= 200 THEN 'met' WHEN bool_and(species % 2 = 1 OR year % 6 <> 3) AND count(DISTINCT year) = 6 THEN 'exhausted' ELSE 'short' END AS status FROM fx_candidates GROUP BY species""")
def quota_report(spark, sf):
    """A source has run dry for odd species, and in all years but one for even ones."""
    rows = fx(spark, sf, "fx_candidates")
    fetched = rows.select("species", "year", ((F.col("species") % 2 == 1) | (F.col("year") % 6 != 3)).alias("exhausted")).distinct()
    return S.caps(rows, ("species",), 200, 6, 6, fetched=fetched)


WEIGHT = "CASE WHEN species = 0 THEN 10e0 WHEN ratio IS NULL THEN 1e0 ELSE 1e0 / least(greatest(ratio, 0.1e0), 10e0) END"
WEIGHTED = f"{CAND}, w AS (SELECT gbif_id, year, species, CASE WHEN species <> 5 THEN (species * species * 3) / 4e0 END AS ratio FROM fx_candidates)"


def weighted(spark, sf):
    ratio = F.when(F.col("species") != 5, F.col("species") * F.col("species") * 3 / F.lit(4.0))
    base = fx(spark, sf, "fx_candidates").withColumn("ratio", ratio).withColumn("nonveg", F.col("species") == 0)
    weight, basis = inverse_weight(F.col("nonveg"), F.col("ratio"))
    return base.withColumns({"weight": weight, "weight_basis": basis})


@query(f"{WEIGHTED} SELECT gbif_id, round({WEIGHT}, 9) AS weight, CASE WHEN species = 0 THEN 'nonveg' WHEN ratio IS NULL THEN 'neutral' ELSE 'inverse_selection' END AS weight_basis FROM w")
def negative_weights(spark, sf):
    """B23, C16."""
    return weighted(spark, sf).select("gbif_id", F.round("weight", 9).alias("weight"), "weight_basis")


def drawn(spark, sf):
    split = lambda key: F.when(F.col(key) % 5 == 0, "val").otherwise("train")
    rows = weighted(spark, sf).withColumn("split", split("gbif_id"))
    return S.weighted_sample(rows, "gbif_id", S.targets_for(habitat_points(spark, sf).withColumn("split", split("sid")), 0.75))


U = "((('0x' || substr(md5('42:' || gbif_id), 1, 13))::BIGINT + 1) / 4503599627370498e0)"


@query(f"""{PROJ}, {WEIGHTED.removeprefix('WITH ').replace(', w AS (', ', wc AS (')}, goal AS (SELECT CASE WHEN sid % 5 = 0 THEN 'val' ELSE 'train' END AS split, CAST(round_even(count(*) * 0.75e0, 0) AS BIGINT) AS target FROM proj GROUP BY 1), k AS (SELECT *, CASE WHEN gbif_id % 5 = 0 THEN 'val' ELSE 'train' END AS split, species = 0 AS nonveg, -ln({U}) / ({WEIGHT}) AS draw FROM wc),
r AS (SELECT *, row_number() OVER (PARTITION BY split, nonveg ORDER BY draw, gbif_id) AS pos FROM k),
have AS (SELECT split, count(*) FILTER (nonveg) AS bare, count(*) FILTER (NOT nonveg) AS green, any_value(target) AS target FROM k JOIN goal USING (split) GROUP BY split),
pl AS (SELECT *, least(green, target - least(bare, CAST(round_even(target * 0.3e0, 0) AS BIGINT))) AS tg FROM have)
SELECT gbif_id, split, nonveg FROM r JOIN pl USING (split) WHERE pos <= CASE WHEN nonveg THEN least(bare, target - tg) ELSE tg END""")
def weighted_negatives(spark, sf):
    """Weighted sample without replacement with the cap on non-vegetated ground and its top-up."""
    return drawn(spark, sf).select("gbif_id", "split", "nonveg")


@query(f"""{PROJ}, pos AS (SELECT region AS grp, 1 AS label, 1e0 AS weight FROM proj), fx_candidates AS ({CAND.split('AS (', 1)[1][:-1]}),
neg AS (SELECT 'C' AS grp, 0 AS label, CASE WHEN species = 1 THEN 1e0 ELSE CAST(species AS DOUBLE) END AS weight FROM fx_candidates)
SELECT label, count(*) AS n, round(sum(weight), 6) AS weight FROM (SELECT * FROM pos UNION ALL SELECT * FROM neg) GROUP BY label""")
def training_frame(spark, sf):
    """Union of shared columns, weight NULL counts as 1."""
    neg = fx(spark, sf, "fx_candidates").withColumn("weight", F.when(F.col("species") != 1, F.col("species").cast("double")))
    both = S.training_frame(habitat_points(spark, sf), neg)
    return both.groupBy("label").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 6).alias("weight"))


@query(f"""{CAND} SELECT year, CAST(count(*) FILTER (species < 3) AS BIGINT) AS low, CAST(count(*) FILTER (species >= 3) AS BIGINT) AS high,
  round(count(*) FILTER (species >= 3) / nullif(CAST(count(*) FILTER (species < 3) AS DOUBLE), 0), 9) AS ratio FROM fx_candidates GROUP BY year""")
def composition_report(spark, sf):
    """Class counts side by side and their ratio."""
    c = fx(spark, sf, "fx_candidates").groupBy("year").pivot("species", list(range(6))).count().na.fill(0)
    low, high = (sum((F.col(str(i)) for i in part), F.lit(0).cast("long")) for part in ((0, 1, 2), (3, 4, 5)))
    return c.select("year", low.alias("low"), high.alias("high"), F.round(high / F.when(low != 0, low), 9).alias("ratio"))


@query(f"{CAND} SELECT year, species, count(*) AS n FROM fx_candidates WHERE species IN (1, 2, 4) AND year >= 2022 AND gbif_id % 3 = 0 GROUP BY year, species")
def source_predicate(spark, sf):
    """Conjunction of equals, at-least and one-of, pushed to the scan as far as it is on stored columns."""
    return fx(spark, sf, "fx_candidates").where("species in (1, 2, 4) and year >= 2022 and gbif_id % 3 = 0").groupBy("year", "species").agg(F.count("*").alias("n"))


@query("""SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k, min(strftime(ts, '%Y-%m-%d')) AS first_day FROM events WHERE json_extract(props, '$.k') IS NOT NULL GROUP BY event_type""")
def json_records(spark, sf):
    """A5: flat records from JSON; rows without the value are dropped, dates cut to ten characters."""
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("k", F.from_json("props", "k long")["k"]).where("k is not null")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("k"), F.min(F.substring(F.col("ts").cast("string"), 1, 10)).alias("first_day"))


@query(f"""{CAND}, part AS (SELECT *, row_number() OVER (PARTITION BY species ORDER BY gbif_id) AS rn FROM fx_candidates) SELECT gbif_id, species FROM part WHERE rn <= 10""")
def first_per_class(spark, sf):
    """F8: the limit is the feature."""
    from pyspark.sql import Window

    w = Window.partitionBy("species").orderBy("gbif_id")
    return fx(spark, sf, "fx_candidates").withColumn("rn", F.row_number().over(w)).where("rn <= 10").select("gbif_id", "species")


@query(f"{CAND} SELECT gbif_id FROM fx_candidates ORDER BY md5('42:' || gbif_id), gbif_id LIMIT 100")
def random_subsample(spark, sf):
    """a random subsample of n rows by hash; the limit is the feature."""
    return fx(spark, sf, "fx_candidates").orderBy(F.md5(F.concat(F.lit("42:"), F.col("gbif_id").cast("string")).cast("binary")), "gbif_id").limit(100).select("gbif_id")
