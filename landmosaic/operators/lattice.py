"""The sweep over every scheme as a lattice: each scheme's counts come from those of a finer scheme, not from the records."""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.binning import disturbance, inner_edges, right_closed
from .envelopes import GROUP, scheme_metrics
from .shared import saved

#: Every variable of the sweep and its variants (fixed values): its codes as they are, so many quantile bins, or disturbed or not.
VARIABLES = {"evt": ("raw",), "evt_phys": ("raw",), "evt_group": ("raw",), "sclass": ("raw",)} | {c: ("q2", "q3", "q4", "q5") for c in ("evh", "evc", "ch", "cc")} | {"fdist": ("raw", "binary")}

#: Variables that say nothing if all their values are one, as where no attribute table was read.
MACROS = ("evt_phys", "evt_group")


def verdicts(df: DataFrame, variables: tuple[str, ...] = tuple(VARIABLES), group: tuple[str, ...] = GROUP, macros: tuple[str, ...] = MACROS) -> DataFrame:
    """group, variable, n (rows with a value), single (no two values differ), usable: n > 0 and, for macros, not single.

    One pass that keeps count, least and greatest value of each variable: no set of values is held and no row is repeated.
    A variable that df lacks, or that is null throughout, has n = 0 and is single; no rows, no groups.
    """
    at = lambda v: F.col(v) if v in df.columns else F.lit(None).cast("string")
    found = df.groupBy(*group).agg(*(F.struct(F.count(at(v)).alias("n"), F.coalesce(F.min(at(v)) == F.max(at(v)), F.lit(True)).alias("single")).alias(f"u_{v}") for v in variables))
    each = F.explode(F.array(*(F.struct(F.lit(v).alias("variable"), f"u_{v}.n", f"u_{v}.single") for v in variables)))
    rows = found.select(*group, each.alias("v")).select(*group, "v.*")
    return rows.withColumn("usable", (F.col("n") > 0) & ~(F.col("variable").isin(*macros) & F.col("single")))


def without_unusable(swept: DataFrame, judged: DataFrame, group: tuple[str, ...] = GROUP) -> DataFrame:
    """The schemes (combo) of a sweep all of whose variables are usable in their group, by verdicts(): a few rows a group."""
    bad = judged.where("not usable").groupBy(*group).agg(F.collect_set("variable").alias("bad_"))
    named = F.transform(F.split("combo", r" \+ "), lambda c: F.substring_index(c, "(", 1))
    joined = swept.join(bad, list(group), "left")
    return joined.where(F.col("bad_").isNull() | ~F.arrays_overlap(named, "bad_")).drop("bad_")


@dataclass
class Plan:
    """names: variable(variant) of each label column, columns: the label columns of each variable, sizes: number of labels of each column."""

    names: list[str]
    columns: list[list[int]]
    sizes: list[int]

    def schemes(self) -> list[tuple[int | None, ...]]:
        """Every choice of one label column, or none, for each variable, but none at all."""
        return [s for s in itertools.product(*([None, *c] for c in self.columns)) if any(x is not None for x in s)]

    def parent(self, scheme: tuple[int | None, ...]) -> tuple[int, tuple[int | None, ...]]:
        """The variable to add, and the scheme with it: the column with the fewest labels, so that the parent is as small as can be."""
        _, column, v = min((self.sizes[c], c, v) for v, x in enumerate(scheme) if x is None for c in self.columns[v])
        return v, (*scheme[:v], column, *scheme[v + 1 :])

    def radices(self) -> list[int]:
        return [max(self.sizes[c] for c in cs) for cs in self.columns]

    def combo(self, scheme: tuple[int | None, ...]) -> str:
        return " + ".join(self.names[c] for c in scheme if c is not None)


def _labels(df: DataFrame, variables: dict[str, tuple[str, ...]], group: tuple[str, ...]) -> tuple[DataFrame, list[str], list[list[int]]]:
    """df's group and a column of labels for each variant, by the edges of the group."""
    bins = {(v, t): int(t[1:]) for v, ts in variables.items() for t in ts if t[0] == "q"}
    fitted = df.groupBy(*group).agg(F.count("*").alias("all_"), *(inner_edges(v, n).alias(f"e_{v}_{t}") for (v, t), n in bins.items()))

    def label(v: str, t: str) -> Column:
        if (v, t) in bins:
            return right_closed(F.col(v), F.col(f"e_{v}_{t}"), "NA")
        return disturbance(F.coalesce(F.col(v), F.lit(-1))) if t == "binary" else F.coalesce(F.col(v).cast("string"), F.lit("nan"))

    names, columns, out = [], [], []
    for v, ts in variables.items():
        columns.append([])
        for t in ts:
            columns[-1].append(len(names))
            out.append(label(v, t).alias(f"l{len(names)}"))
            names.append(f"{v}({t})")
    return df.join(F.broadcast(fitted), list(group)).select(*group, *out), names, columns


def usable(df: DataFrame, variables: dict[str, tuple[str, ...]] = VARIABLES, named: tuple[str, ...] = MACROS) -> dict[str, tuple[str, ...]]:
    """The variables that are there, have a value and, for the macro classes, more than one."""
    have = [v for v in variables if v in df.columns]
    row = df.agg(*(F.count(v).alias(f"n_{v}") for v in have), *(F.approx_count_distinct(v).alias(f"k_{v}") for v in have if v in named)).first() if have else {}
    return {v: variables[v] for v in have if row[f"n_{v}"] and (v not in named or row[f"k_{v}"] > 1)}


def cells(spark: SparkSession, df: DataFrame, variables: dict[str, tuple[str, ...]], group: tuple[str, ...] = GROUP) -> tuple[DataFrame, DataFrame]:
    """group, scheme, c: the number of records of each envelope of every scheme; and scheme, combo, n_vars.

    Records become distinct label tuples once. Only the schemes with all variables are counted from those; then, variable by
    variable, a scheme is summed from one with one variable more. An envelope is a number with a digit for each variable, so leaving a variable
    out is arithmetic. Levels are written, since each feeds the next and the result.
    """
    wide, names, columns = _labels(df, variables, group)
    tuples = saved(wide.groupBy(*wide.columns).agg(F.count("*").alias("c")))
    many = range(len(names))
    # a label's number, from the distinct labels of its column
    kinds = tuples.select(F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(f"l{i}").alias("label")) for i in many))).alias("k")).select("k.*").distinct()
    kinds = saved(kinds.withColumn("code", F.row_number().over(Window.partitionBy("i").orderBy("label")) - 1))
    found = dict(kinds.groupBy("i").agg(F.max("code") + 1).collect())
    plan = Plan(names, columns, [found.get(i, 1) for i in many])
    numbered = tuples
    for i in many:
        numbered = numbered.join(F.broadcast(kinds.where(F.col("i") == i).select(F.col("label").alias(f"l{i}"), F.col("code").alias(f"c{i}"))), f"l{i}")
    numbered = numbered.select(*group, "c", F.array(*(F.col(f"c{i}") for i in many)).alias("codes"))

    radices, places, place = plan.radices(), [], 1
    for r in radices:
        places.append(place)
        place *= r
    if place >= 2**63:
        raise ValueError("the variables have more label tuples than a 64-bit number can count")
    schemes = plan.schemes()
    ids = {s: i for i, s in enumerate(schemes)}
    named = spark.createDataFrame([(i, plan.combo(s), sum(c is not None for c in s)) for i, s in enumerate(schemes)], "scheme int, combo string, n_vars int")
    top = [s for s in schemes if None not in s]
    steps = [(len(s) - s.count(None), ids[p], i, v) for i, s in enumerate(schemes) if None in s for v, p in [plan.parent(s)]]

    whole = F.explode(F.array(*(F.struct(F.lit(ids[s]).alias("scheme"), F.array(*map(F.lit, s)).alias("use")) for s in top))).alias("t")
    place_of = F.array(*(F.lit(p).cast("long") for p in places))
    key = F.aggregate(F.sequence(F.lit(0), F.lit(len(columns) - 1)), F.lit(0).cast("long"), lambda a, v: a + F.get("codes", F.get("t.use", v)) * F.get(place_of, v))
    level = saved(numbered.select(*group, "c", "codes", whole).select(*group, F.col("t.scheme").alias("scheme"), key.alias("key"), "c").groupBy(*group, "scheme", "key").agg(F.sum("c").alias("c")))
    out = level
    for n in range(len(columns) - 1, 0, -1):
        moves = spark.createDataFrame([(p, i, places[v], radices[v]) for m, p, i, v in steps if m == n], "scheme int, child int, place long, radix long")
        digit = F.expr("(key div place) % radix * place")
        fewer = level.join(F.broadcast(moves), "scheme").select(*group, F.col("child").alias("scheme"), (F.col("key") - digit).alias("key"), "c")
        level = saved(fewer.groupBy(*group, "scheme", "key").agg(F.sum("c").alias("c")))
        out = out.unionByName(level)
    return out.drop("key"), named


def sweep(spark: SparkSession, df: DataFrame, variables: dict[str, tuple[str, ...]] = VARIABLES, viable: int = 30, group: tuple[str, ...] = GROUP) -> DataFrame:
    """group, combo, n_vars and the metrics of every scheme over the usable variables; no rows without any.

    A variable counts as usable here if it is so in all rows together; without_unusable() then drops the schemes of groups where it isn't.
    """
    good = usable(df, variables)
    if not good:
        return scheme_metrics(df.select(*group, F.lit("").alias("combo"), F.lit(0).alias("n_vars"), F.lit(0).cast("long").alias("c")).where("false"), viable, group)
    counts, named = cells(spark, df, good, group)
    slim = scheme_metrics(counts.withColumnRenamed("scheme", "combo").withColumn("n_vars", F.lit(0)), viable, group).drop("n_vars").withColumnRenamed("combo", "scheme")
    return slim.join(F.broadcast(named), "scheme").drop("scheme")
