"""Habitat envelopes: ids by sightings' edges, used against available, rarity, zones and the scheme sweep."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.binning import MIN_AVAILABLE, env_zone, envelope_id, inner_edges, nonvegetated, right_closed, selection_class
from .ranks import running
from .shared import saved

#: A scheme: column to 'raw' or a number of quantile bins.
SCHEME = {"evt_phys": "raw", "sclass": "raw", "evh": 2}


#: Envelopes are a region's own: its edges, counts, shares and classes.
GROUP = ("region",)
EXCLUDED = "Non-Vegetated (excluded)"


def edges(used: DataFrame, scheme: dict = SCHEME, group: tuple[str, ...] = GROUP) -> DataFrame:
    """A row for each group: the edges of every quantile column, fitted on its used records."""
    return used.groupBy(*group).agg(F.count("*").alias("fitted_n"), *(inner_edges(c, n).alias(f"edges_{c}") for c, n in scheme.items() if n != "raw"))


def with_envelope(df: DataFrame, fitted: DataFrame, scheme: dict = SCHEME, group: tuple[str, ...] = GROUP) -> DataFrame:
    """df with envelope_id by its group's edges (a row for each region, broadcast); groups without edges drop out."""
    parts = {c: (F.coalesce(F.col(c).cast("string"), F.lit("nan")) if n == "raw" else right_closed(F.col(c), F.col(f"edges_{c}"))) for c, n in scheme.items()}
    out = df.join(F.broadcast(fitted), list(group)).withColumn("envelope_id", envelope_id(parts))
    return out.drop(*(c for c in fitted.columns if c not in group))


def with_nonveg(df: DataFrame) -> DataFrame:
    return df.withColumn("nonveg", nonvegetated(F.col("sclass"), F.col("evt_phys")))


def selection(used: DataFrame, available: DataFrame, group: tuple[str, ...] = GROUP) -> DataFrame:
    """Envelope metrics of each group: counts and shares of its used and available records, their ratio (NULL if unavailable) and its class.

    available may be counted already: a column n_ is then the number of records that a row stands for. The counts, a row for each
    envelope, are written: shares and zones read them several times, and a plan would hold the background's sampling as often.
    """
    keys = [*group, "envelope_id"]
    u = used.groupBy(*keys).agg(F.count("*").alias("sightings"))
    a = available.groupBy(*keys).agg((F.sum("n_") if "n_" in available.columns else F.count("*")).alias("avail_n"))
    both = saved(u.join(a, keys, "full_outer").select(*keys, F.coalesce("sightings", F.lit(0)).alias("sightings"), F.coalesce("avail_n", F.lit(0)).alias("avail_n")))
    totals = both.groupBy(*group).agg(F.sum("sightings").alias("nu_"), F.sum("avail_n").alias("na_"))
    share = lambda c, n: F.try_divide(100.0 * F.col(c), F.col(n))
    shares = both.join(F.broadcast(totals), list(group)).withColumn("used_pct", share("sightings", "nu_")).withColumn("avail_pct", share("avail_n", "na_"))
    ratio = shares.withColumn("selection_ratio", F.when(F.col("avail_n") > 0, F.col("used_pct") / F.col("avail_pct")))
    return ratio.withColumn("classification", selection_class(F.col("avail_n"), F.col("selection_ratio"))).drop("nu_", "na_")


def counted(df: DataFrame, viable: int = 30, group: tuple[str, ...] = GROUP) -> DataFrame:
    """A row for each group: number of envelopes, median and greatest count, singletons, viable ones."""
    c = df.groupBy(*group, "envelope_id").agg(F.count("*").alias("n"))
    return c.groupBy(*group).agg(F.count("*").alias("n_envelopes"), F.percentile("n", F.lit(0.5)).alias("median_n"), F.max("n").alias("max_n"), F.sum((F.col("n") == 1).cast("long")).alias("singletons"), F.sum((F.col("n") >= viable).cast("long")).alias("viable"))


def rarest(df: DataFrame, share: float = 10.0, group: tuple[str, ...] = GROUP) -> DataFrame:
    """group, envelope_id, n, cum_pct of each group's rarest envelopes, up to this share of its records (ties by id).

    Envelopes are few next to records, so the running sum goes over the aggregate only.
    """
    c = running(df.groupBy(*group, "envelope_id").agg(F.count("*").alias("n")), ["n", "envelope_id"], group, ("n",))
    total = df.groupBy(*group).agg(F.count("*").alias("t_"))
    return c.join(F.broadcast(total), list(group)).withColumn("cum_pct", 100.0 * F.col("run_n") / F.col("t_")).where(F.col("cum_pct") <= share).select(*group, "envelope_id", "n", "cum_pct")


def extremes(metrics: DataFrame, k: int = 5, least: int = MIN_AVAILABLE, group: tuple[str, ...] = GROUP) -> DataFrame:
    """group, list, place, envelope_id and metrics of the k envelopes with most sightings, and of the k most selected and most avoided of those that can be judged (ties by id)."""
    judged = (F.col("avail_n") >= least) & F.col("selection_ratio").isNotNull()
    lists = {"most seen": (F.lit(True), F.desc("sightings")), "most selected": (judged, F.desc("selection_ratio")), "most avoided": (judged, F.asc("selection_ratio"))}
    out = None
    for name, (which, order) in lists.items():
        place = F.row_number().over(Window.partitionBy(*group).orderBy(order, "envelope_id"))
        part = metrics.where(which).withColumn("place", place).where(F.col("place") <= k).withColumn("list", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def with_zones(used: DataFrame, metrics: DataFrame, group: tuple[str, ...] = GROUP) -> DataFrame:
    """used with env_zone by its envelope's class in its group. In a group without any availability, where selection can't be judged,
    the rarest envelopes (up to a tenth of the records) are the avoided ones and all others proportional."""
    keys = [*group, "envelope_id"]
    judged = metrics.groupBy(*group).agg(F.sum("avail_n").alias("judged_"))
    rare = rarest(used, group=group).select(*keys, F.lit(True).alias("rare_"))
    joined = used.join(metrics.select(*keys, F.col("classification").alias("class_")), keys, "left").join(rare, keys, "left").join(F.broadcast(judged), list(group), "left")
    plain = F.when(F.col("rare_"), "Avoided Envelope").otherwise("Proportional Envelope")
    return joined.withColumn("env_zone", F.when(F.coalesce("judged_", F.lit(0)) > 0, env_zone(F.col("class_"))).otherwise(plain)).drop("class_", "rare_", "judged_")


def with_excluded(zoned: DataFrame, records: DataFrame) -> DataFrame:
    """The habitat records' zones merged back to all records: non-vegetated ones have no envelope and their own label."""
    bare = records.where("nonveg").withColumn("envelope_id", F.lit(None).cast("string")).withColumn("env_zone", F.lit(EXCLUDED))
    return zoned.unionByName(bare, allowMissingColumns=True)


def zone_lift(df: DataFrame) -> DataFrame:
    """For each (region, env_zone): records, their shares of hot and cold spatial zones, those of the whole region, and the ratios (NULL over 0)."""
    parts = {"hot": "Hot", "cold": "Cold"}
    counts = [F.count("*").alias("n"), *(F.sum((F.col("spatial_zone") == z).cast("long")).alias(f"{k}_") for k, z in parts.items())]
    g = saved(df.groupBy("region", "env_zone").agg(*counts))
    base = g.groupBy("region").agg(*((F.sum(f"{k}_") / F.sum("n")).alias(f"{k}_all") for k in parts))
    out = g.join(F.broadcast(base), "region")
    share = lambda k: F.col(f"{k}_") / F.col("n")
    shown = [c for k in parts for c in (F.round(share(k), 9).alias(f"{k}_share"), F.round(f"{k}_all", 9).alias(f"{k}_base"), F.round(share(k) / F.nullif(F.col(f"{k}_all"), F.lit(0.0)), 9).alias(f"{k}_lift"))]
    return out.select("region", "env_zone", "n", *shown)


def breakdown(df: DataFrame) -> DataFrame:
    """Counts of non-vegetated records by class label; those that the physiognomy alone gives away by their physiognomy."""
    labels = F.create_map(*(F.lit(x) for kv in {111: "Water", 112: "Snow", 120: "Developed", 132: "Barren", 180: "Agriculture"}.items() for x in kv))
    return df.where("nonveg").groupBy(F.coalesce(labels[F.col("sclass")], F.concat("evt_phys", F.lit(" (via EVT_PHYS)"))).alias("label")).agg(F.count("*").alias("n"))


def variants(df: DataFrame, columns: dict[str, tuple], group: tuple[str, ...] = GROUP) -> DataFrame:
    """Distinct label tuples of all variants of a group with their counts: columns maps a column to its variants ('raw' or bin numbers)."""
    fitted = df.groupBy(*group).agg(*(inner_edges(c, v).alias(f"e_{c}_{v}") for c, vs in columns.items() for v in vs if v != "raw"), F.count("*").alias("all_"))
    labels = [(F.concat(F.lit(f"{c}:"), F.coalesce(F.col(c).cast("string"), F.lit("nan"))) if v == "raw" else F.concat(F.lit(f"{c}:"), right_closed(F.col(c), F.col(f"e_{c}_{v}"), "NA"))).alias(f"{c}_{v}") for c, vs in columns.items() for v in vs]
    wide = df.join(F.broadcast(fitted), list(group)).select(*group, *labels)
    return wide.groupBy(*wide.columns).agg(F.count("*").alias("n_"))


def schemes(columns: dict[str, tuple]) -> list[tuple[str, ...]]:
    """Every choice of a non-empty subset of columns and one variant of each."""
    options = [[None, *(f"{c}_{v}" for v in vs)] for c, vs in columns.items()]
    return [tuple(x for x in pick if x) for pick in itertools.product(*options) if any(pick)]


def sweep(spark: SparkSession, df: DataFrame, columns: dict[str, tuple], viable: int = 30, batch: int = 256, group: tuple[str, ...] = GROUP) -> DataFrame:
    """bin_tuning rows of all schemes by group. Records are first reduced to distinct label tuples, written once; then each batch of schemes
    explodes only those, and groups by (group, scheme, key)."""
    tuples = saved(variants(df, columns, group))
    names = schemes(columns)
    out = None
    for i in range(0, len(names), batch):
        keys = F.array(*(F.struct(F.lit("+".join(s)).alias("combo"), F.lit(len(s)).alias("n_vars"), F.concat_ws("|", *s).alias("key")) for s in names[i : i + batch]))
        rows = tuples.select(*group, "n_", F.explode(keys).alias("k")).groupBy(*group, "k.combo", "k.n_vars", "k.key").agg(F.sum("n_").alias("c"))
        out = rows if out is None else out.unionByName(rows)
    return scheme_metrics(out, viable, group)


def scheme_metrics(counts: DataFrame, viable: int = 30, group: tuple[str, ...] = GROUP) -> DataFrame:
    """counts (group, combo, n_vars, c) to number, viable ones, their coverage of the records, evenness among them, singleton share, median and score of each scheme.

    evenness is the Shannon entropy of the viable envelopes' shares over the greatest possible; 0 for fewer than two of them.
    """
    keys = [*group, "combo", "n_vars"]
    held = F.when(F.col("c") >= viable, F.col("c"))
    g = counts.groupBy(*keys).agg(
        F.count("*").alias("n_envelopes"),
        F.count(held).alias("n_viable"),
        F.coalesce(F.sum(held), F.lit(0)).alias("held_"),
        (100.0 * F.coalesce(F.sum(held), F.lit(0)) / F.sum("c")).alias("coverage_pct"),
        F.sum(held * F.log(held.cast("double"))).alias("h_"),
        (100.0 * F.sum((F.col("c") == 1).cast("long")) / F.count("*")).alias("singleton_pct"),
        F.percentile("c", F.lit(0.5)).alias("median_per_env"),
    )
    entropy = F.log(F.col("held_").cast("double")) - F.col("h_") / F.col("held_")
    g = g.withColumn("evenness", F.when(F.col("n_viable") > 1, entropy / F.log(F.col("n_viable").cast("double"))).otherwise(0.0)).drop("h_", "held_")
    return g.withColumn("score", F.col("coverage_pct") / 100 * F.col("evenness") * F.log1p(F.col("n_viable").cast("double")))
