"""Map projection, raster indices, grid blocks and distance cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the Albers projection of the continental grid (GRS80; parallels 29.5 and 45.5, origin 23 N 96 W).
A, FLATTENING = 6378137.0, 1 / 298.257222101
PARALLEL_1, PARALLEL_2, ORIGIN_LAT, ORIGIN_LON = 29.5, 45.5, 23.0, -96.0


def _constants(p1: float, p2: float, lat0: float) -> tuple[float, float, float, float]:
    e2 = FLATTENING * (2 - FLATTENING)
    e = math.sqrt(e2)
    m = lambda s: math.sqrt(1 - s * s) / math.sqrt(1 - e2 * s * s)
    q = lambda s: (1 - e2) * (s / (1 - e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))
    s0, s1, s2 = (math.sin(math.radians(x)) for x in (lat0, p1, p2))
    n = (m(s1) ** 2 - m(s2) ** 2) / (q(s2) - q(s1))
    c = m(s1) ** 2 + n * q(s1)
    return e, n, c, A * math.sqrt(c - n * q(s0)) / n


def albers(lon: Column, lat: Column, p1: float = PARALLEL_1, p2: float = PARALLEL_2, lat0: float = ORIGIN_LAT, lon0: float = ORIGIN_LON) -> tuple[Column, Column]:
    """x and y in metres of an ellipsoidal Albers equal-area projection (Snyder's formulas)."""
    e, n, c, rho0 = _constants(p1, p2, lat0)
    s = F.sin(F.radians(lat))
    q = (1 - e * e) * (s / (1 - e * e * s * s) - F.log((1 - e * s) / (1 + e * s)) / (2 * e))
    rho, theta = A * F.sqrt(F.lit(c) - n * q) / n, n * F.radians(lon - lon0)
    return rho * F.sin(theta), rho0 - rho * F.cos(theta)


def albers_sql(lon: str, lat: str) -> tuple[str, str]:
    """The same as SQL text."""
    e, n, c, rho0 = _constants(PARALLEL_1, PARALLEL_2, ORIGIN_LAT)
    s = f"sin(radians({lat}))"
    q = f"({1 - e * e!r} * ({s} / (1 - {e * e!r} * {s} * {s}) - ln((1 - {e!r} * {s}) / (1 + {e!r} * {s})) / {2 * e!r}))"
    rho, theta = f"({A!r} * sqrt({c!r} - {n!r} * {q}) / {n!r})", f"({n!r} * radians({lon} + 96))"
    return f"({rho} * sin({theta}))", f"({rho0!r} - {rho} * cos({theta}))"


def projected(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    x, y = albers(F.col(lon), F.col(lat))
    return df.withColumn("x", x).withColumn("y", y)


def pixel_row(top: Column, y: Column, res: float) -> Column:
    return F.floor((top - y) / res).cast("int")


def pixel_col(left: Column, x: Column, res: float) -> Column:
    return F.floor((x - left) / res).cast("int")


def block_id(x: Column, y: Column, x0: Column, y0: Column, size: float = 3000.0) -> Column:
    """'bx_by' of a square grid anchored at (x0, y0); indices may be negative."""
    return F.concat_ws("_", F.floor((x - x0) / size), F.floor((y - y0) / size))


def hash_share(seed: int, key: Column, parts: int = 10000) -> Column:
    """md5(seed:key) as a number modulo parts, from its two 64-bit halves; the same on every engine and partitioning."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key).cast("binary"))
    high, low = (F.conv(F.substring(digest, i, 16), 16, 10).cast("decimal(20,0)") for i in (1, 17))
    return (((high % parts) * (2**64 % parts) + low % parts) % parts).cast("int")


def cells(df: DataFrame, size: float, neighbours: bool = False) -> DataFrame:
    """df with the square cell (cx, cy) of each point, or a row for each of the nine cells around it.

    Two points within `size` of each other meet in a cell if one side has neighbours=True: an equi-join for distances.
    """
    cx, cy = F.floor(F.col("x") / size), F.floor(F.col("y") / size)
    if not neighbours:
        return df.withColumn("cx", cx).withColumn("cy", cy)
    near = F.array(*(F.struct((cx + i).alias("cx"), (cy + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    return df.withColumn("cell", F.explode(near)).select("*", "cell.cx", "cell.cy").drop("cell")


def albers_terms(p1: Column, p2: Column, lat0: Column) -> dict[str, Column]:
    """n, c and rho0 of an Albers projection whose parallels and origin are columns."""
    e2 = FLATTENING * (2 - FLATTENING)
    e = math.sqrt(e2)
    m = lambda s: F.sqrt(1 - s * s) / F.sqrt(1 - e2 * s * s)
    q = lambda s: (1 - e2) * (s / (1 - e2 * s * s) - F.log((1 - e * s) / (1 + e * s)) / (2 * e))
    s0, s1, s2 = (F.sin(F.radians(v)) for v in (lat0, p1, p2))
    n = (m(s1) ** 2 - m(s2) ** 2) / (q(s2) - q(s1))
    c = m(s1) ** 2 + n * q(s1)
    return {"n_": n, "c_": c, "rho0_": A * F.sqrt(c - n * q(s0)) / n}


def to_albers(lon: Column, lat: Column, n: Column, c: Column, rho0: Column, lon0: Column) -> tuple[Column, Column]:
    """x and y in metres, by the terms of albers_terms()."""
    e = math.sqrt(FLATTENING * (2 - FLATTENING))
    s = F.sin(F.radians(lat))
    q = (1 - e * e) * (s / (1 - e * e * s * s) - F.log((1 - e * s) / (1 + e * s)) / (2 * e))
    rho, theta = A * F.sqrt(c - n * q) / n, n * F.radians(lon - lon0)
    return rho * F.sin(theta), rho0 - rho * F.cos(theta)


def from_albers(x: Column, y: Column, n: Column, c: Column, rho0: Column, lon0: Column) -> tuple[Column, Column]:
    """lon and lat of x and y: the authalic latitude by its series (below a millimetre on the ground)."""
    e2 = FLATTENING * (2 - FLATTENING)
    e = math.sqrt(e2)
    q = (c - (x * x + (rho0 - y) ** 2) * n * n / (A * A)) / n
    pole = 1 - (1 - e2) / (2 * e) * math.log((1 - e) / (1 + e))
    b = F.asin(q / pole)
    lat = b + (e2 / 3 + 31 * e2**2 / 180 + 517 * e2**3 / 5040) * F.sin(2 * b) + (23 * e2**2 / 360 + 251 * e2**3 / 3780) * F.sin(4 * b) + 761 * e2**3 / 45360 * F.sin(6 * b)
    return lon0 + F.degrees(F.atan2(x, rho0 - y) / n), F.degrees(lat)
