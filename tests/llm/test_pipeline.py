"""The pipeline's stages on a small table: order, columns, what each stage keeps, and SQL oracles of the queries."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from landmosaic.llm import quality, queries
from landmosaic.llm.common import table, written


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    kept = {}
    frame = docs
    for name, stage in corpus_pipeline.STAGES:
        frame = written(stage(spark, frame, sf))
        kept[name] = frame
        if name != "packing":
            assert frame.columns == docs.columns
    ids = {n: {r["doc_id"] for r in f.select("doc_id").collect()} for n, f in kept.items()}
    scored = queries.op8_quality(spark, sf)
    assert ids["quality classifier"] == {r["doc_id"] for r in scored.where("predicted = 1").collect()}
    assert ids["near-duplicates"] < ids["quality classifier"] and ids["personal data"] == ids["near-duplicates"]
    assert ids["mixing"] == ids["personal data"] == ids["packing"]
    assert kept["personal data"].where(F.col("text").rlike(r"[A-Za-z0-9]@[A-Za-z0-9-]+\.")).count() == 0
    assert corpus_pipeline.run(spark, sf).count() == kept["packing"].count()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracles(spark, name):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name]).df()
    got = queries.QUERIES[name](spark, sf).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    key = lambda df: sorted(map(tuple, df[columns].astype(str).to_numpy()))
    assert key(got) == key(want)


def test_dedup_keeps_one_of_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text, "a"), (1, text, "a"), (1, text, "b"), (2, text, "a"), (3, "other words here", None), (None, "no id", "c"), (None, "no id", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(map(str, (tuple(r) for r in corpus_pipeline.dedup_stage(spark, docs, "").collect())))
    assert got == sorted(map(str, [(1, text, "a"), (3, "other words here", None), (None, "no id", "c"), (None, "no id", "c")]))


def test_quality_fit_is_bounded_by_passages(spark):
    words = lambda i, n: " ".join(f"w{(i * 31 + j) % 97}" for j in range(n))
    docs = spark.createDataFrame([(i, words(i, 64 * 3) if i % 2 else "Zz9 " * 64 * 3) for i in range(40)] + [(50, words(1, 64 * 90)), (1, words(1, 64 * 3))], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(50, 0)], "doc_id long, quality int")
    whole = quality.train(docs, labels)
    cut = quality.train(docs, labels.where("doc_id <> 50"), passages=600)
    left = quality.train(docs.where("doc_id <> 50"), labels, passages=600)
    probe = [quality.encode(words(3, 500)), quality.encode("Zz9 " * 90), quality.encode("")]
    assert list(cut.score(probe)) == list(left.score(probe)) and whole.score(probe)[0] > 0.5 > whole.score(probe)[1]
    assert quality.train(docs, labels, passages=50).score(probe)[0] == 0.5
