"""Block splits, quotas, negatives and balanced batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import hash_share
from .ranks import running


def block_holdout(df: DataFrame, share: float = 0.2, seed: int = 42, group: tuple[str, ...] = ()) -> DataFrame:
    """group, block_id, split: within a group, blocks in hash order go to val until its records reach the rounded share (the crossing block is included)."""
    blocks = df.groupBy(*group, "block_id").agg(F.count("*").alias("c"))
    whole = Window.partitionBy(*group)
    before = whole.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "block_id").cast("binary")), "block_id").rowsBetween(Window.unboundedPreceding, -1)
    held = F.coalesce(F.sum("c").over(before), F.lit(0)) < F.bround(F.sum("c").over(whole) * share)
    return blocks.select(*group, "block_id", F.when(held, "val").otherwise("train").alias("split"))


def with_split(df: DataFrame, blocks: DataFrame, seed: int = 42, group: tuple[str, ...] = ()) -> DataFrame:
    """df with its block's split within its group; blocks without one are drawn by hash at the group's share of val blocks."""
    share = blocks.groupBy(*group).agg(F.avg((F.col("split") == "val").cast("double")).alias("share_"))
    drawn = F.when(hash_share(seed, F.col("block_id")) < F.col("share_") * 10000, "val").otherwise("train")
    joined = df.join(blocks, [*group, "block_id"], "left")
    joined = joined.join(F.broadcast(share), list(group), "left") if group else joined.crossJoin(F.broadcast(share))
    return joined.withColumn("split", F.coalesce("split", drawn)).drop("share_")


def certain(df: DataFrame, metres: float = 1000.0) -> DataFrame:
    """Rows whose coordinate uncertainty isn't known to exceed the limit."""
    return df.where(~F.coalesce(F.col("coord_uncertainty_m") > metres, F.lit(False)))


def first_at_location(df: DataFrame, key: str, places: int = 5) -> DataFrame:
    """The row with the least key at each rounded location."""
    w = Window.partitionBy(F.round("lon", places), F.round("lat", places)).orderBy(key)
    return df.withColumn("rn_", F.row_number().over(w)).where("rn_ = 1").drop("rn_")


def quota(df: DataFrame, group: tuple[str, ...], year_cap: int, cap: int, key: str) -> DataFrame:
    """At most cap rows per group: up to year_cap of each year first, in year order, then left-overs in year order.

    A row with cap rows of its own year before it is never taken, so both ranks are limited within tasks before the shuffle.
    """
    rank = F.row_number().over(Window.partitionBy(*group, "year").orderBy(key))
    order = Window.partitionBy(*group).orderBy((F.col("r_") > year_cap).cast("int"), "year", "r_")
    return df.withColumn("r_", rank).where(F.col("r_") <= cap).withColumn("o_", F.row_number().over(order)).where(F.col("o_") <= cap).drop("r_", "o_")


def caps(df: DataFrame, group: tuple[str, ...], needed: int, species: int, years: int, headroom: float = 6.0, fetched: DataFrame | None = None) -> DataFrame:
    """Rows held against the cap of each group, its yearly cap, and whether it is met; if not, whether the source ran dry.

    fetched: group, year, exhausted. A group is exhausted if that holds for all of its years, else short; without it, short.
    """
    cap = F.ceil(F.lit(needed * headroom / species))
    out = df.groupBy(*group).agg(F.count("*").alias("held")).withColumn("cap", cap).withColumn("year_cap", F.ceil(cap / years))
    if fetched is None:
        return out.withColumn("status", F.when(F.col("held") >= F.col("cap"), "met").otherwise("short"))
    dry = fetched.groupBy(*group).agg((F.bool_and("exhausted") & (F.count_distinct("year") == years)).alias("dry_"))
    status = F.when(F.col("held") >= F.col("cap"), "met").when(F.col("dry_"), "exhausted").otherwise("short")
    return out.join(dry, list(group), "left").withColumn("status", status).drop("dry_")


def uniform(seed: int, key: Column) -> Column:
    """A number in (0, 1) from a hash of the key; the same on every partitioning."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary")), 1, 13), 16, 10).cast("double") + 1) / (16.0**13 + 2)


def background_points(ids: DataFrame, key: str, boxes: DataFrame, seed: int = 1) -> DataFrame:
    """region, key, lon, lat: a point drawn uniformly in every box (a few rows) for each id, by hashes of region and id."""
    place = F.concat_ws(":", "region", F.col(key).cast("string"))
    between = lambda lo, hi, k: F.col(lo) + uniform(seed + k, place) * (F.col(hi) - F.col(lo))
    return ids.select(key).crossJoin(F.broadcast(boxes)).select("region", key, between("min_lon", "max_lon", 0).alias("lon"), between("min_lat", "max_lat", 1).alias("lat"))


def targets_for(positives: DataFrame, ratio: float) -> DataFrame:
    """split, target: so many negatives for the positives of each split, rounded (halves to even)."""
    return positives.groupBy("split").agg(F.bround(F.count("*") * F.lit(float(ratio))).cast("long").alias("target"))


def weighted_sample(df: DataFrame, key: str, targets: DataFrame, nonveg_cap: float = 0.3, seed: int = 42) -> DataFrame:
    """Weighted sampling without replacement per split (exponential keys -ln(u) / w): up to nonveg_cap of the target from
    the non-vegetated pool, the rest vegetated; a shortfall of one pool is topped up from the other.

    targets: split, target (a few rows), as targets_for() gives them. df: split, nonveg, weight.
    """
    draw = df.withColumn("draw_", -F.log(uniform(seed, F.col(key))) / F.col("weight"))
    ranked = running(draw, ["draw_", key], ("split", "nonveg"))
    have = df.groupBy("split").agg(F.sum(F.col("nonveg").cast("long")).alias("bare_"), F.sum((~F.col("nonveg")).cast("long")).alias("green_"))
    plan = have.join(F.broadcast(targets), "split")
    bare = F.least("bare_", F.bround(F.col("target") * nonveg_cap).cast("long"))
    plan = plan.withColumn("take_green", F.least("green_", F.col("target") - bare)).withColumn("take_bare", F.least("bare_", F.col("target") - F.col("take_green")))
    joined = ranked.join(F.broadcast(plan.select("split", "take_green", "take_bare")), "split")
    return joined.where(F.col("pos_") <= F.when(F.col("nonveg"), F.col("take_bare")).otherwise(F.col("take_green"))).drop("draw_", "pos_", "take_green", "take_bare")


def balanced_batches(df: DataFrame, key: str, batch: int = 8, seed: int = 42) -> DataFrame:
    """batch_id, slot, key, y: batches alternate between a quarter and three quarters of positives; a class is dealt anew, in another
    order, each time it is used up, so a cycle holds every row of it once. A missing class is an error."""
    n = {r["y"]: r["n_"] for r in df.groupBy("y").agg(F.count("*").alias("n_")).collect()}  # a row for each class
    if set(n) != {0, 1}:
        raise ValueError(f"balanced batches need both classes; found {sorted(n, key=str)}")
    few, rounds = batch // 4, -(-max(n.values()) // batch)
    cycles = {y: -(-rounds * batch // many) for y, many in n.items()}
    dealt = df.select(key, "y", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("y") == 1, cycles[1] - 1).otherwise(cycles[0] - 1).cast("long"))).alias("cycle_"))
    draw = uniform(seed, F.concat_ws(":", "cycle_", F.col(key).cast("string")))
    rows = running(dealt.withColumn("draw_", draw), ["draw_", key], ("y", "cycle_")).select(key, "y", "cycle_", (F.col("pos_") - 1).alias("pos_"))
    slots = df.sparkSession.range(2 * rounds).select(F.col("id").alias("batch_id"), F.explode(F.sequence(F.lit(0), F.lit(batch - 1))).alias("slot"))
    many = F.when(F.col("batch_id") % 2 == 0, few).otherwise(batch - few)
    y = F.when(F.col("slot") < many, 1).otherwise(0)
    earlier = F.floor(F.col("batch_id") / 2) * batch + F.when(F.col("batch_id") % 2 == 1, F.when(y == 1, few).otherwise(batch - few)).otherwise(0)
    place = earlier + F.when(y == 1, F.col("slot")).otherwise(F.col("slot") - many)
    size = F.when(y == 1, n[1]).otherwise(n[0])
    slots = slots.select("batch_id", "slot", y.alias("y"), F.floor(place / size).alias("cycle_"), (place % size).alias("pos_"))
    return slots.join(rows, ["y", "cycle_", "pos_"]).select("batch_id", "slot", key, "y")


def training_frame(positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """Union on shared columns with label 1 / 0; weight NULL counts as 1; a missing coordinate column is an error."""
    shared = [c for c in positives.columns if c in negatives.columns and c not in ("label", "weight")]
    if not {"lon", "lat"} <= set(shared):
        raise ValueError("both sides need lon and lat")
    side = lambda df, label: df.select(*shared, (F.coalesce(F.col("weight").cast("double"), F.lit(1.0)) if "weight" in df.columns else F.lit(1.0)).alias("weight"), F.lit(label).alias("label"))
    return side(positives, 1).unionByName(side(negatives, 0))


def dated(points: DataFrame, newest: int) -> DataFrame:
    """points whose missing years are the latest year among them; `newest` (the latest layer's year) where none has one."""
    latest = points.agg(F.max("year").alias("latest_"))
    return points.crossJoin(F.broadcast(latest)).withColumn("year", F.coalesce("year", "latest_", F.lit(newest)).cast("int")).drop("latest_")


def balance(rows: DataFrame, group: tuple[str, ...] = ("region", "split"), views: int = 4, severe: float = 3.0) -> DataFrame:
    """group, positives, negatives, seen (positives times their views), ratio of seen to negatives, majority_pct (the accuracy of calling all positive)
    and whether the ratio is severe. rows: group, label; a split without negatives is compared with one."""
    n = rows.groupBy(*group).agg(F.sum((F.col("label") == 1).cast("long")).alias("positives"), F.sum((F.col("label") == 0).cast("long")).alias("negatives"))
    seen = F.col("positives") * views
    return n.withColumns({"seen": seen, "ratio": seen / F.greatest("negatives", F.lit(1)), "majority_pct": 100.0 * seen / F.greatest(seen + F.col("negatives"), F.lit(1)), "severe": seen / F.greatest("negatives", F.lit(1)) > severe})
