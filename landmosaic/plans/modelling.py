"""Suitability models on tabular patch features with pyspark.ml."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics as M

CATEGORICAL, CONTINUOUS = ("evt_phys", "sclass"), ("evh", "evc", "ch", "cc")


def fitted(df: DataFrame, categorical: tuple[str, ...], continuous: tuple[str, ...], reg: float):
    """A weighted logistic regression on one-hot classes and scaled values (label, weight)."""
    steps = [StringIndexer(inputCols=list(categorical), outputCols=[f"{c}_i" for c in categorical], handleInvalid="keep"), OneHotEncoder(inputCols=[f"{c}_i" for c in categorical], outputCols=[f"{c}_v" for c in categorical])]
    steps += [VectorAssembler(inputCols=[*(f"{c}_v" for c in categorical), *continuous], outputCol="features"), LogisticRegression(weightCol="weight", regParam=reg, maxIter=20)]
    return Pipeline(stages=steps).fit(df)


def logits(model, df: DataFrame) -> DataFrame:
    return model.transform(df).withColumn("logit", vector_to_array("rawPrediction")[1])


def suitability(records: DataFrame) -> DataFrame:
    """member, auc of two fits (label: repeat visits) and of their ensemble, on the records that weren't fitted."""
    rows = records.select("sid", "region", *CATEGORICAL, *CONTINUOUS, (F.col("n_visits") > 1).cast("double").alias("label"), F.lit(1.0).alias("weight")).withColumn("sclass", F.col("sclass").cast("string"))
    held = F.pmod(F.xxhash64("sid"), F.lit(5)) == 0
    train, test = rows.where(~held), rows.where(held)
    parts = []
    for i, (cat, cont, reg) in enumerate(((CATEGORICAL, CONTINUOUS, 0.01), (CATEGORICAL[:1], CONTINUOUS, 0.1))):
        parts.append(logits(fitted(train, cat, cont, reg), test).select(F.concat_ws("-", "region", "sid").alias("point_id"), F.col("label").alias("y"), F.lit(f"fit {i}").alias("member"), "logit"))
    members = parts[0].unionByName(parts[1])
    every = members.unionByName(M.ensemble(members).select("point_id", "y", F.lit("ensemble").alias("member"), "logit"))
    return M.roc_auc(every, ("member",))
