from landmosaic.llm import pii


def test_pii_columns_of_any_name_stay(spark):
    """Columns named like the operator's own are kept as they are."""
    names = ("pii_row", "pii_mark", "pii_terms", "pii_found", "mark", "term", "copies", "odd.name")
    docs = spark.createDataFrame([(i, f"Ann Smith wrote to ann{i % 2}@x.example.org about Zorgle", *names) for i in range(8)] + [(9, None, *names)], ["doc_id", "text", *names])
    got = pii.sanitised(docs)
    assert got.columns == [*docs.columns, "base", "spans", "clean"]
    rows = got.collect()
    assert len(rows) == 9 and all(tuple(r[c] for c in names) == names for r in rows)
    assert all(r["clean"] is None if r["text"] is None else "@" not in r["clean"] for r in rows)
