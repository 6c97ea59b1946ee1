"""Files in, tables out: sightings CSVs, occurrence TSV and JSON, crosswalks, artifacts and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed value: how a sightings file is named.
SIGHTINGS_NAME = r"^([A-Za-z]{2})_sightings_(\d{4})\.csv$"
CANDIDATES = "common_name string, scientific_name string, longitude double, latitude double, obs_date string, year int, month int, state string, gbif_id string, how_many int, coord_uncertainty_m double"
OCCURRENCES = "results array<struct<species:string,scientificName:string,decimalLongitude:double,decimalLatitude:double,eventDate:string,year:int,month:int,stateProvince:string,key:string,individualCount:int,coordinateUncertaintyInMeters:double>>"


def coordinate_columns(columns: list[str]) -> tuple[str, str] | None:
    """The first columns whose names contain lon and lat, in any case; None if one is missing."""
    found = [next((c for c in columns if part in c.lower()), None) for part in ("lon", "lat")]
    return (found[0], found[1]) if all(found) else None


def _files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """The paths under a folder that match, from the listing alone."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path")


def _headers(spark: SparkSession, files: list[str]) -> DataFrame:
    """file, head: the first line of each; at most the first block of a file is read, line by line."""
    lines = spark.read.text(files).where("_metadata.file_block_start = 0").select(F.col("_metadata.file_path").alias("file"), "value", F.monotonically_increasing_id().alias("at"))
    return lines.groupBy("file").agg(F.min_by("value", "at").alias("head"))


def read_sightings(spark: SparkSession, path: str) -> DataFrame:
    """lon, lat, state, year of all CSV files of a folder; state and year come from the file's name (or that of the folder that
    write_sightings() made of it), other names are skipped.

    Files (one a state and year) are listed by Spark and read once per distinct header line (a handful), so columns resolve by header.
    """
    place = lambda c: F.regexp_replace(c, r"^.*[/=]([A-Za-z]{2}_sightings_\d{4}\.csv)(/[^/]*)?$", "$1")
    files = [r["path"] for r in _files(spark, path, "*.csv").where(place("path").rlike(SIGHTINGS_NAME)).collect()]
    out = spark.createDataFrame([], "lon double, lat double, state string, year int")
    for row in _headers(spark, files).groupBy("head").agg(F.collect_list("file").alias("files")).collect() if files else []:
        named = coordinate_columns([c.strip().strip('"') for c in row["head"].split(",")])
        if named:
            name = place(F.col("_metadata.file_path"))
            part = spark.read.csv(row["files"], header=True).select("*", F.upper(F.regexp_extract(name, SIGHTINGS_NAME, 1)).alias("state_"), F.regexp_extract(name, SIGHTINGS_NAME, 2).cast("int").alias("year_"))
            out = out.unionByName(part.select(F.col(named[0]).cast("double").alias("lon"), F.col(named[1]).cast("double").alias("lat"), F.col("state_").alias("state"), F.col("year_").alias("year")))
    return out.dropna(subset=["lon", "lat"])


def write_sightings(df: DataFrame, path: str) -> None:
    """df (state, year and more) as one CSV data set named STATE_sightings_YEAR.csv for each state and year."""
    named = df.withColumn("name", F.concat(F.col("state"), F.lit("_sightings_"), F.col("year").cast("string"), F.lit(".csv"))).drop("state", "year")
    named.repartition("name").write.mode("overwrite").partitionBy("name").csv(path, header=True)


def read_occurrences(spark: SparkSession, path: str, schema: str = "stateProvince string, year int, decimalLongitude double, decimalLatitude double") -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, schema=schema)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Flat CANDIDATES rows from occurrence JSON; records without coordinates are dropped, dates cut to ten characters."""
    r = spark.read.json(path, schema=OCCURRENCES).select(F.explode("results").alias("r")).select("r.*")
    flat = r.select(F.col("species").alias("common_name"), F.col("scientificName").alias("scientific_name"), F.col("decimalLongitude").alias("longitude"), F.col("decimalLatitude").alias("latitude"), F.substring("eventDate", 1, 10).alias("obs_date"), "year", "month", F.col("stateProvince").alias("state"), F.col("key").alias("gbif_id"), F.col("individualCount").alias("how_many"), F.col("coordinateUncertaintyInMeters").alias("coord_uncertainty_m"))
    return flat.dropna(subset=["longitude", "latitude"])


def read_crosswalk(spark: SparkSession, path: str) -> DataFrame:
    """value, evt_phys, evt_group of the newest table (by name, LF*.csv: a file or a folder of parts); headers trimmed and upper-cased; the last duplicate wins."""
    root = F.regexp_extract("path", r"^(.*LF[^/]*\.csv)", 1)
    newest = _files(spark, path, "*.csv").select(root.alias("root")).where("root <> ''").agg(F.max(F.struct(F.substring_index("root", "/", -1), "root"))).first()[0]
    if newest is None:
        raise FileNotFoundError(f"no crosswalk table in {path}")
    df = spark.read.csv(newest["root"], header=True)
    df = df.toDF(*(c.strip().upper() for c in df.columns)).withColumn("ord_", F.monotonically_increasing_id())
    group = F.col("EVT_GP_N") if "EVT_GP_N" in df.columns else F.lit(None).cast("string")
    last = Window.partitionBy("VALUE").orderBy(F.desc("ord_"))
    kept = df.withColumn("rn_", F.row_number().over(last)).where("rn_ = 1")
    return kept.select(F.col("VALUE").cast("int").alias("value"), F.col("EVT_PHYS").alias("evt_phys"), F.coalesce(group, F.col("EVT_PHYS")).alias("evt_group"))


def write_by_state(df: DataFrame, states: DataFrame, path: str) -> None:
    """Partitioned by state and year; rows of unmapped states or without a year are left out. states: stateProvince, state."""
    mapped = df.where("year is not null").join(states, "stateProvince")
    mapped.repartition("state", "year").write.mode("overwrite").partitionBy("state", "year").parquet(path)


def write_artifact(df: DataFrame, folder: str, name: str, by: tuple[str, ...] = ("region",)) -> None:
    df.write.mode("overwrite").partitionBy(*by).parquet(f"{folder}/{name}")


class Artifacts:
    """Named per-region tables of a folder; each is read once and pruned by region."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.known = spark, folder, {}

    def table(self, name: str, region: str | None = None) -> DataFrame:
        if name not in self.known:
            try:
                self.known[name] = self.spark.read.parquet(f"{self.folder}/{name}")
            except Exception as e:
                raise FileNotFoundError(f"no table {name!r} in {self.folder}; write_artifact() makes it") from e
        df = self.known[name]
        return df if region is None else df.where(F.col("region") == region)


def layer_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """region, year, feature of layers named REGION_YEAR_feature.*, from the listing alone."""
    name = r"^([A-Za-z]+)_(\d{4})_([a-z]+)\."
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name")).where(F.col("name").rlike(name))
    return files.select(F.regexp_extract("name", name, 1).alias("region"), F.regexp_extract("name", name, 2).cast("int").alias("year"), F.regexp_extract("name", name, 3).alias("feature")).distinct()


def write_calibration(summary: DataFrame, bins: DataFrame, folder: str) -> None:
    summary.coalesce(1).write.mode("overwrite").json(f"{folder}/summary")
    bins.write.mode("overwrite").partitionBy("stage").parquet(f"{folder}/reliability")
