"""The corpus pipeline: quality, near-duplicates, personal data, mixture, packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last return the columns
of documents. run() writes each stage's result in the shared folder before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landmosaic.llm import minhash, mixing, packing, pii, quality
from landmosaic.llm.common import small, table, written
from landmosaic.llm.queries import held_out, tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.3 stay."""
    model = quality.train(docs, table(spark, sf_dir, "labels").where(~held_out(5, 0)))
    return quality.scored(docs, model).where("score >= 0.3").select(*docs.columns)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, 0.8) the document with the least doc_id stays.

    Of rows that repeat both doc_id and text, one stays (that with the least other columns as JSON); only ids that repeat are grouped.
    """
    found = minhash.near_duplicates(docs, k=5, percent=80)
    dropped = written(found.where("not kept").select("doc_id").distinct())
    repeated = written(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    kept = docs.join(small(dropped), "doc_id", "left_anti").select(*docs.columns)
    row = F.struct(*docs.columns)
    once = kept.join(small(repeated), "doc_id", "left_anti").select(*docs.columns)
    again = kept.join(small(repeated), "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min_by(row, F.to_json(row)).alias("row"))
    return once.unionByName(again.select("row.*"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and disclosing terms are replaced in the text; n_chars follows the text."""
    clean = pii.sanitised(docs).withColumn("text", F.col("clean"))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, those of smaller sources more often, up to the mixture's weights."""
    return mixing.mixed(docs, entropy=0.9, repetition=4.0)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), end=2, size=4096)


STAGES = [
    ("quality classifier", quality_stage),
    ("near-duplicates", dedup_stage),
    ("personal data", pii_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Trained weights, hashed minima and tokenizers have no SQL form; tests/llm checks the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
