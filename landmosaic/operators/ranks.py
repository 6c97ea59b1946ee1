"""Positions and running sums over a whole table or a hot group, without one task that reads all of it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import saved


def running(df: DataFrame, order: list[Column | str], group: tuple[str, ...] = (), sums: tuple[str, ...] = ()) -> DataFrame:
    """df with pos_ (from 1, within the group) and, for each column of sums, run_<column>: its sum up to this row.

    The order must be total within a group. Rows are dealt by ranges of (group, order) and written once; each range's
    counts and sums are accumulated over the ranges, a table of groups times partitions; within a range rows are numbered
    locally. NULL counts as 0 in sums.
    """
    placed = saved(df.repartitionByRange(*group, *order).withColumn("part_", F.spark_partition_id()))
    value = lambda c: F.coalesce(F.col(c), F.lit(0))
    parts = placed.groupBy(*group, "part_").agg(F.count("*").alias("n_"), *(F.sum(value(c)).alias(f"s_{c}") for c in sums))
    before = Window.partitionBy(*group).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    names = [f"key_{c}" for c in (*group, "part_")]
    offsets = parts.select(*(F.col(c).alias(k) for c, k in zip((*group, "part_"), names)), earlier("n_").alias("n_"), *(earlier(f"s_{c}").alias(f"s_{c}") for c in sums))
    local = Window.partitionBy(*group, "part_").orderBy(*order)
    rows = placed.withColumns({"pos_": F.row_number().over(local).cast("long")} | {f"run_{c}": F.sum(value(c)).over(local.rowsBetween(Window.unboundedPreceding, 0)) for c in sums})
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(k)) for c, k in zip((*group, "part_"), names)))
    moved = {"pos_": F.col("pos_") + F.col("n_")} | {f"run_{c}": F.col(f"run_{c}") + F.col(f"s_{c}") for c in sums}
    return rows.join(offsets, same).withColumns(moved).drop("part_", "n_", *(f"s_{c}" for c in sums), *names)


def quantiles(df: DataFrame, column: str, shares: tuple[float, ...], group: tuple[str, ...] = ()) -> DataFrame:
    """group, cuts_: the exact quantiles (linear interpolation) of the column's values that aren't NULL, by selection.

    percentile() keeps every distinct double of a group in one task. Here distinct values with their counts are dealt by ranges of
    the order, and only the values at the wanted positions are brought together. A group without values has no row; without
    groups there is always one, NULL for no values.
    """
    value = F.col(column).cast("double")
    counts = running(df.select(*group, value.alias("v_")).where("v_ IS NOT NULL").groupBy(*group, "v_").agg(F.count("*").alias("n")), ["v_"], group, ("n",))
    kept = saved(counts.select(*group, "v_", (F.col("run_n") - F.col("n")).alias("from_"), F.col("run_n").alias("to_")))
    total = kept.groupBy(*group).agg(F.max("to_").alias("total_")).withColumnsRenamed({c: f"of_{c}" for c in group})
    same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in group]
    placed = kept.join(F.broadcast(total), same) if group else kept.crossJoin(F.broadcast(total))
    at = [(F.col("total_") - 1) * F.lit(float(p)) for p in shares]
    here = lambda k: (F.col("from_") <= k) & (k < F.col("to_"))
    wanted = reduce(lambda a, b: a | b, (here(f(h)) for h in at for f in (F.floor, F.ceil)))

    def cut(h: Column) -> Column:
        low, high = (F.max(F.when(here(f(h)), F.col("v_"))) for f in (F.floor, F.ceil))
        upper, place = F.max(F.ceil(h)), F.max(h)
        return F.when(upper == place, low).otherwise((upper - place) * low + (place - upper + 1) * high)

    return placed.where(wanted).groupBy(*group).agg(F.array(*map(cut, at)).alias("cuts_"))
