"""Shared helpers: reading tables, cutting lineage through the shared folder, and bounded broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if it has at most this many rows of fixed width (16 bytes or so each).
BROADCAST_ROWS = 1_000_000
#: Python workers are handed batches of at most so many bytes, whatever the number of rows.
BATCH_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset (tests).

    On a cluster it has to be set: a folder of the driver's own isn't seen by executors.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known
    own = spark.conf.get("landmosaic.shared.dir", None)
    if not own:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="landmosaic-")
        spark.conf.set("landmosaic.shared.dir", own)
    return own


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it back.

    What is read back survives the loss of any executor, and its later readers don't compute it again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def batched(spark: SparkSession) -> None:
    """Bound the batches that go to Python workers by bytes, so that very long texts don't add up to 10,000 rows of them."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).rstrip("bB")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def in_batches(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """df.mapInPandas(run, schema) with batches bounded by bytes."""
    batched(df.sparkSession)
    return df.mapInPandas(run, schema)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if a count shows that it has few rows, else df as it is (Spark then shuffles).

    df should be cheap to count, such as a table that written() returned.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def met(left: DataFrame, right: DataFrame, key: str, weight: str, share: int = 1000) -> DataFrame:
    """left, left-joined by key to right (written; one row a key; weight: how many rows of left have that key).

    Where right is large, its rows that stand for more than a share-th of all rows, at most `share` of them, are broadcast; the rows of
    left that they serve, and those without a key, are spread over all tasks by a salt, so that no key of left makes a task of its own.
    """
    out = [c for c in right.columns if c != key]
    if right.limit(BROADCAST_ROWS // 10 + 1).count() <= BROADCAST_ROWS // 10:
        return left.join(F.broadcast(right), key, "left")
    total = right.agg(F.sum(weight)).first()[0] or 0
    hot = F.col(weight) * share > total
    named = lambda df, name: df.select(F.col(key).alias(f"{name}key"), F.struct(*out).alias(name))
    served = left.join(F.broadcast(named(right.where(hot), "hot_")), F.col(key) == F.col("hot_key"), "left").drop("hot_key")
    salt = F.when(F.col(key).isNull() | F.col("hot_").isNotNull(), F.monotonically_increasing_id() % 4096 + 1).otherwise(0)
    rest = named(right.where(~hot), "rest_").withColumn("salt_r", F.lit(0).cast("long"))
    both = served.withColumn("salt_", salt).join(rest, (F.col(key) == F.col("rest_key")) & (F.col("salt_") == F.col("salt_r")), "left")
    return both.select(*left.columns, *(F.coalesce(F.col("hot_")[c], F.col("rest_")[c]).alias(c) for c in out))


def union(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
