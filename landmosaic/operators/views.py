"""The eight views of a square patch, as index permutations that are built once and looked up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def permutation(side: int, quarter: int, flip: bool) -> list[int]:
    """For each place of the turned (anticlockwise, `quarter` times) and then mirrored (left to right) patch, the place it comes from."""
    out = []
    for i in range(side * side):
        r, c = divmod(i, side)
        c = side - 1 - c if flip else c
        for _ in range(quarter % 4):
            r, c = c, side - 1 - r
        out.append(r * side + c)
    return out


def permutations(spark: SparkSession, side: int, flips: bool = True) -> DataFrame:
    """rot, flip, take: four or eight rows of side * side indices."""
    kinds = [(k, f) for f in ((False, True) if flips else (False,)) for k in range(4)]
    return spark.createDataFrame([(k, f, permutation(side, k, f)) for k, f in kinds], "rot int, flip boolean, take array<int>")


def expanded(patches: DataFrame, column: str, side: int, flips: bool = True) -> DataFrame:
    """Each row once for every view, with rot, flip and `column` (a flat side x side array) turned accordingly; all else, label and weight too, repeats.

    The permutations are a table of eight rows that is broadcast; nothing is shuffled. A patch of another length is an error.
    """
    sized = patches.where(F.assert_true(F.col(column).isNull() | (F.size(column) == side * side), F.lit("a patch isn't square")).isNull())
    both = sized.crossJoin(F.broadcast(permutations(patches.sparkSession, side, flips)))
    return both.withColumn(column, F.transform("take", lambda i: F.get(F.col(column), i))).drop("take")
