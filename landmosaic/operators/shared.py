"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys of at most so many rows are broadcast (some 10 MB on the driver).
FEW = 100_000


def shared_folder(spark: SparkSession) -> str:
    """The shared checkpoint folder (in local mode one of our own where none is set)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("landmosaic.points.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="landmosaic-")
        spark.conf.set("landmosaic.points.dir", base)
    return base.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """Cut the lineage by a Parquet table in the shared folder."""
    path = f"{shared_folder(df.sparkSession)}/points-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few(df: DataFrame, rows: int = FEW) -> DataFrame:
    """df (written) with a broadcast hint if it has few rows, else with one for a join that shuffles both sides."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df.hint("merge")
