"""The sweep's lattice against direct grouping."""

import itertools
import math
from collections import Counter

import numpy as np
import pytest

from landmosaic.operators import lattice


def label(values, variant, v):
    if variant == "raw":
        return "nan" if v is None else str(v)
    if variant == "binary":
        return "None" if (v if v is not None else -1) <= 0 else "Disturbed"
    if v is None:
        return "NA"
    inner = sorted(set(np.quantile([x for x in values if x is not None], np.arange(0, int(variant[1:]) + 1) / int(variant[1:]))))[1:-1]
    return f"Q{sum(v > e for e in inner) + 1}"


def test_every_scheme_equals_direct_grouping(spark):
    r = np.random.default_rng(2)
    rows = [("AB"[i % 2], int(r.integers(1, 4)), "one", None if i % 9 == 0 else int(r.integers(0, 30)), int(r.integers(0, 40) ** 2 // 7), None if i % 4 else int(r.integers(-1, 3)), None) for i in range(400)]
    names = ("region", "sclass", "evt_phys", "evh", "ch", "fdist", "cc")
    df = spark.createDataFrame(rows, "region string, sclass int, evt_phys string, evh int, ch int, fdist int, cc int").repartition(6)
    variables = {v: lattice.VARIABLES[v] for v in ("evt_phys", "evt_group", "sclass", "evh", "ch", "cc", "fdist")}
    got = {(x["region"], x["combo"]): x for x in lattice.sweep(spark, df, variables, viable=5).collect()}
    used = [v for v in variables if v in ("sclass", "evh", "ch", "fdist")]  # a single class, a missing column and one without values drop out
    want = {}
    for region in "AB":
        mine = [dict(zip(names, x)) for x in rows if x[0] == region]
        column = {(v, t): [label([m[v] for m in mine], t, m[v]) for m in mine] for v in used for t in variables[v]}
        for n in range(1, len(used) + 1):
            for subset in itertools.combinations(used, n):
                for pick in itertools.product(*(variables[v] for v in subset)):
                    want[region, " + ".join(f"{v}({t})" for v, t in zip(subset, pick))] = Counter(zip(*(column[v, t] for v, t in zip(subset, pick))))
    assert set(got) == set(want) and len(want) == 2 * (2 * 5 * 5 * 3 - 1)
    for k, counts in want.items():
        x, c = got[k], sorted(counts.values())
        big = [n for n in c if n >= 5]
        even = -sum(n / sum(big) * math.log(n / sum(big)) for n in big) / math.log(len(big)) if len(big) > 1 else 0.0
        assert (x["n_envelopes"], x["n_viable"], x["median_per_env"], x["n_vars"]) == (len(c), len(big), np.median(c), k[1].count("(")), k
        assert x["coverage_pct"] == pytest.approx(100 * sum(big) / sum(c)) and x["evenness"] == pytest.approx(even) and x["singleton_pct"] == pytest.approx(100 * c.count(1) / len(c))
        assert x["score"] == pytest.approx(sum(big) / sum(c) * even * math.log1p(len(big)))


def test_plan_covers_all_schemes_and_parents_are_finer():
    columns, names = [], []
    for v, ts in lattice.VARIABLES.items():
        columns.append(list(range(len(names), len(names) + len(ts))))
        names += [f"{v}({t})" for t in ts]
    plan = lattice.Plan(names, columns, [int(n.split("(q")[1][0]) if "(q" in n else 2 if "binary" in n else 9 for n in names])
    schemes = plan.schemes()
    assert len(schemes) == 29_999 == len(set(schemes))
    for s in schemes:
        if None in s:
            v, p = plan.parent(s)
            assert s[v] is None and p[v] is not None and (*p[:v], None, *p[v + 1 :]) == s


def test_nothing_to_sweep(spark):
    assert lattice.sweep(spark, spark.createDataFrame([("A", None)], "region string, evh int")).count() == 0


def test_verdicts_are_by_region(spark):
    """A class that is one value in a region, or a column null throughout there, drops its schemes in that region alone."""
    rows = [("A" if i < 60 else "B", "one" if i < 60 else f"c{i % 3}", i % 4, None if i >= 60 else i % 5) for i in range(120)]
    df = spark.createDataFrame(rows, "region string, evt_phys string, sclass int, ch int")
    variables = {v: lattice.VARIABLES[v] for v in ("evt_phys", "sclass", "ch", "cc")}
    got = {(r["region"], r["variable"]): (r["n"], r["single"], r["usable"]) for r in lattice.verdicts(df, tuple(variables)).collect()}
    assert got == {
        ("A", "evt_phys"): (60, True, False), ("A", "sclass"): (60, False, True), ("A", "ch"): (60, False, True), ("A", "cc"): (0, True, False),
        ("B", "evt_phys"): (60, False, True), ("B", "sclass"): (60, False, True), ("B", "ch"): (0, True, False), ("B", "cc"): (0, True, False),
    }
    swept = lattice.without_unusable(lattice.sweep(spark, df, variables, viable=5), lattice.verdicts(df, tuple(variables))).collect()
    schemes = {r: {x["combo"] for x in swept if x["region"] == r} for r in "AB"}
    assert not any("evt_phys" in c for c in schemes["A"]) and any("ch(" in c for c in schemes["A"]) and "sclass(raw)" in schemes["A"]
    assert schemes["B"] == {"evt_phys(raw)", "sclass(raw)", "evt_phys(raw) + sclass(raw)"}
    assert lattice.verdicts(df.limit(0), tuple(variables)).count() == 0
