"""One sink for batches and streams of candidate records: ids that it holds are dropped, quotas are recomputed on what it holds."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sampling import caps
from ..sources.tables import CANDIDATES


def sink_rows(spark: SparkSession, sink: str) -> DataFrame | None:
    """What the sink holds, with its run; None where nothing was written yet."""
    try:
        return spark.read.parquet(sink)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def append_new(rows: DataFrame, sink: str, run: str, key: str = "gbif_id") -> None:
    """Write the rows whose key no other run of the sink holds as the sink's partition `run`.

    Of rows that repeat a key the least one is taken, rows without a key are left out. The same run again replaces what it wrote, with the
    same rows, so a run that failed half-way or was delivered twice is simply repeated. Columns and types must be those of the sink. Runs are one after another, not side by side.
    """
    others = [c for c in rows.columns if c != key]
    fresh = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*others)).alias("row_")).select(key, "row_.*").select(*rows.columns)
    before = sink_rows(rows.sparkSession, sink)
    if before is not None:
        want, got = ({f.name: f.dataType for f in df.schema if f.name != "run"} for df in (before, rows))
        if want != got:
            raise ValueError(f"{sink} has {want}, not {got}")
        fresh = fresh.join(before.where(F.col("run").cast("string") != run).select(key), key, "left_anti").select(*rows.columns)
    fresh.write.mode("overwrite").parquet(f"{sink}/run={run}")


def ingest(spark: SparkSession, source: str, sink: str, checkpoint: str) -> None:
    """Append what is new in the files of source (Parquet, CANDIDATES) to sink, once; progress is kept in the checkpoint, ids seen are those of the sink.

    A run's name holds the id of the checkpoint, so a new checkpoint never replaces what an earlier one wrote.
    """

    def append(batch: DataFrame, epoch: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        append_new(batch, sink, f"stream-{query}-{epoch}")

    rows = spark.readStream.schema(CANDIDATES).parquet(source)
    rows.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def held(spark: SparkSession, sink: str, needed: int, species: int, years: int, fetched: DataFrame | None = None) -> DataFrame:
    """Rows held against the caps by state and species; fetched (state, common_name, year, exhausted) tells which sources ran dry."""
    return caps(spark.read.parquet(sink), ("state", "common_name"), needed, species, years, fetched=fetched)
