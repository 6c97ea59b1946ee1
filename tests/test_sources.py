import pytest
from pyspark.sql import functions as F

from landmosaic.sources import tables as T
from landmosaic.streaming.ingest import append_new, held, ingest, sink_rows


def test_sightings(spark, tmp_path):
    (tmp_path / "me_sightings_2020.csv").write_text("Id,Decimal_Longitude,decimal_LATITUDE\n1,-70.5,44.1\n2,,44.2\n")
    (tmp_path / "NH_sightings_2021.csv").write_text("lat,lon\n43.5,-71.5\n")
    (tmp_path / "VT_sightings_2021.csv").write_text("a,b\n1,2\n")
    (tmp_path / "other.csv").write_text("lat,lon\n1,2\n")
    assert sorted(map(tuple, T.read_sightings(spark, str(tmp_path)).collect())) == [(-71.5, 43.5, "NH", 2021), (-70.5, 44.1, "ME", 2020)]


def test_occurrences_and_state_sink(spark, tmp_path):
    (tmp_path / "o.tsv").write_text("stateProvince\tyear\tdecimalLongitude\tdecimalLatitude\nMaine\t2020\t-70\t44\nOntario\t2020\t-80\t45\nMaine\t\t-70\t44\n")
    df = T.read_occurrences(spark, str(tmp_path / "o.tsv"))
    T.write_by_state(df, spark.createDataFrame([("Maine", "ME")], "stateProvince string, state string"), str(tmp_path / "out"))
    assert [(r["state"], r["year"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("ME", 2020)]


def test_json_records(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"results": [{"species": "a", "decimalLongitude": 1.0, "decimalLatitude": 2.0, "eventDate": "2020-01-02T03:04", "key": "9"}, {"species": "b"}]}')
    rows = T.read_records(spark, str(tmp_path / "r.json")).collect()
    assert [(r["common_name"], r["obs_date"], r["gbif_id"]) for r in rows] == [("a", "2020-01-02", "9")]


def test_crosswalk_takes_the_newest_table_and_last_row(spark, tmp_path):
    (tmp_path / "LF2016_EVT.csv").write_text("VALUE,EVT_PHYS\n1,Old\n")
    (tmp_path / "LF2022_EVT.csv").write_text(" value ,evt_phys,EVT_GP_N\n1,First,\n1,Second,Group\n2,Only,\n")
    assert {r["value"]: (r["evt_phys"], r["evt_group"]) for r in T.read_crosswalk(spark, str(tmp_path)).collect()} == {1: ("Second", "Group"), 2: ("Only", "Only")}


def test_artifacts_and_catalog(spark, tmp_path):
    df = spark.createDataFrame([("ME", 1), ("NH", 2)], "region string, v int")
    T.write_artifact(df, str(tmp_path), "metrics")
    a = T.Artifacts(spark, str(tmp_path))
    assert a.table("metrics", "NH").first()["v"] == 2
    with pytest.raises(FileNotFoundError):
        a.table("absent")
    folder = tmp_path / "layers"
    folder.mkdir()
    for n in ("ME_2016_evt.tif", "ME_2020_evt.tif", "notes.txt"):
        (folder / n).write_text("x")
    assert sorted(map(tuple, T.layer_catalog(spark, str(folder)).collect())) == [("ME", 2016, "evt"), ("ME", 2020, "evt")]
    T.write_calibration(df, df.withColumn("stage", F.lit("before")), str(tmp_path / "cal"))
    assert spark.read.json(str(tmp_path / "cal/summary")).count() == 2


def test_ingest_drops_seen_ids_over_runs(spark, tmp_path):
    row = lambda i: ("sp", "S", 1.0, 2.0, "2020-01-01", 2020, 1, "ME", i, 1, None)
    src, sink, cp = (str(tmp_path / n) for n in ("src", "sink", "cp"))
    spark.createDataFrame([row("1"), row("2"), row("2")], T.CANDIDATES).write.parquet(f"{src}/a")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    ingest(spark, f"{src}/*", sink, cp)
    spark.createDataFrame([row("2"), row("3")], T.CANDIDATES).write.parquet(f"{src}/b")
    ingest(spark, f"{src}/*", sink, cp)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert sorted(r["gbif_id"] for r in spark.read.parquet(sink).collect()) == ["1", "2", "3"]
    assert held(spark, sink, 1, 1, 1).first()["held"] == 3


def test_batches_and_streams_share_a_sink(spark, tmp_path):
    row = lambda i, v=1: ("sp", "S", 1.0, 2.0, "2020-01-01", 2020, 1, "ME", i, v, None)
    frame = lambda *rows: spark.createDataFrame(list(rows), T.CANDIDATES)
    src, sink = str(tmp_path / "src"), str(tmp_path / "sink")
    assert sink_rows(spark, sink) is None
    append_new(frame(row("1", 5), row("1", 4), row("2"), row(None)), sink, "a")
    frame(row("2", 9), row("3")).write.parquet(f"{src}/x")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    ingest(spark, f"{src}/*", sink, str(tmp_path / "cp"))
    frame(row("4"), row("1", 0)).write.parquet(f"{src}/y")
    ingest(spark, f"{src}/*", sink, str(tmp_path / "cp"))
    ingest(spark, f"{src}/*", sink, str(tmp_path / "another"))  # from the start again, under another name
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    append_new(frame(row("1", 5), row("1", 4), row("2"), row(None)), sink, "a")  # delivered twice
    got = sorted((r["gbif_id"], r["how_many"]) for r in sink_rows(spark, sink).collect())
    assert got == [("1", 4), ("2", 1), ("3", 1), ("4", 1)]
    with pytest.raises(ValueError, match="not"):
        append_new(frame(row("9")).withColumn("year", F.col("year").cast("string")), sink, "b")
    with pytest.raises(ValueError, match="not"):
        append_new(frame(row("9")).drop("month"), sink, "b")


def test_sightings_sink_is_read_back(spark, tmp_path):
    rows = [(-70.5, 44.0, "ME", 2020), (-71.0, 43.5, "NH", 2021), (-71.5, 43.0, "NH", 2021)]
    T.write_sightings(spark.createDataFrame(rows, "longitude double, latitude double, state string, year int"), str(tmp_path / "s"))
    assert sorted(map(tuple, T.read_sightings(spark, str(tmp_path / "s")).collect())) == sorted(rows)
    (tmp_path / "none").mkdir()
    assert T.read_sightings(spark, str(tmp_path / "none")).count() == 0
