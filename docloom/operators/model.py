"""Interpretable models over feature tables: logistic regression, a forest, importances and a stored artifact.

Feature tables have one row a quarter; Spark ML trains them distributed all the same.
"""

from __future__ import annotations

import json

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.operators import evaluate

# Fixed value: the seed of every random step.
SEED = 42
#: Bins of rows that are numbered one by one.
BINS = 1024


def scaled(train: DataFrame, every: DataFrame, features: list[str]) -> DataFrame:
    """``every`` with a vector ``features``, scaled by the mean and deviation of ``train`` only."""
    assembler = VectorAssembler(inputCols=features, outputCol="raw", handleInvalid="skip")
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(assembler.transform(train))
    return scaler.transform(assembler.transform(every)).drop("raw")


def logistic(data: DataFrame, features: list[str], label: str = "label", split: str = "split", grid: tuple[float, ...] = (0.01, 0.1, 1.0)):
    """L2 logistic regression; the strength with the best validation accuracy wins, never by random folds."""
    rows = scaled(data.where(F.col(split) == "train"), data, features)
    best = None
    for strength in grid:
        model = LogisticRegression(labelCol=label, regParam=strength, elasticNetParam=0.0).fit(rows.where(F.col(split) == "train"))
        hits = model.transform(rows.where(F.col(split) == "validation")).agg(F.avg((F.col("prediction") == F.col(label)).cast("double"))).first()[0] or 0.0
        if best is None or hits > best[0]:
            best = (hits, strength, model)
    return best[2], rows


def forest(data: DataFrame, features: list[str], label: str = "label", split: str = "split"):
    """Random forest with the fixed seed."""
    rows = scaled(data.where(F.col(split) == "train"), data, features)
    return RandomForestClassifier(labelCol=label, seed=SEED, numTrees=20, maxDepth=3).fit(rows.where(F.col(split) == "train")), rows


def coefficients(model, features: list[str]) -> list[tuple[str, float]]:
    """Features by the size of their coefficient."""
    return sorted(zip(features, map(float, model.coefficients)), key=lambda x: -abs(x[1]))


def predictions(model, rows: DataFrame, label: str = "label") -> DataFrame:
    """Label, predicted class and probability."""
    done = model.transform(rows)
    return done.select(*[c for c in rows.columns if c != "features"], F.col("prediction").cast("int").alias("predicted"), vector_to_array("probability")[1].alias("p"))


def _numbered(rows: DataFrame, key: str, salt: str) -> DataFrame:
    """``rows`` with ``__i``, their place in the order of a salted hash of the key, from 1 on.

    Rows are dealt to ``BINS`` bins by their hash and ranked within them; only the bins' counts are summed up in one task.
    """
    h = F.xxhash64(F.col(key).cast("string"), F.lit(salt))
    dealt = rows.withColumn("__bin", F.pmod(h, F.lit(BINS)))
    before = Window.orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    start = dealt.groupBy("__bin").agg(F.count("*").alias("__n")).select("__bin", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    ranked = dealt.withColumn("__k", F.row_number().over(Window.partitionBy("__bin").orderBy(h, key)))
    return ranked.join(F.broadcast(start), "__bin").withColumn("__i", F.col("__start") + F.col("__k")).drop("__bin", "__k", "__start")


def permutation_importance(model, rows: DataFrame, features: list[str], label: str = "label", key: str = "quarter_start") -> list[tuple[str, float]]:
    """Accuracy lost when one feature takes another row's value; which row's, follows from hashes of the key.

    One job: each row is judged as it is and once for every feature, and only the shares come to the driver.
    """
    held = rows.select(key, label, vector_to_array("features").alias("__x"))
    other = _numbered(held, key, "other").select("__i", F.col("__x").alias("__other"))
    every = _numbered(held, key, "own").join(other, "__i").withColumn("__f", F.explode(F.sequence(F.lit(-1), F.lit(len(features) - 1))))
    moved = F.transform("__x", lambda x, k: F.when(k == F.col("__f"), F.get("__other", k)).otherwise(x))
    judged = model.transform(every.withColumn("features", array_to_vector(moved)))
    hits = dict(judged.groupBy("__f").agg(F.avg((F.col("prediction") == F.col(label)).cast("double"))).collect())
    return sorted(((name, hits[-1] - hits[i]) for i, name in enumerate(features) if hits), key=lambda x: -x[1])


def report(predicted: DataFrame, label: str = "label") -> str:
    """Metrics as Markdown."""
    m = evaluate.classification(predicted, label, "predicted").first().asDict()
    return "| metric | value |\n| --- | --- |\n" + "\n".join(f"| {k} | {'-' if v is None else round(v, 4)} |" for k, v in m.items()) + "\n"


def save(model, path: str, features: list[str], data_hash: int) -> None:
    """The model with its features, seed and the hash of its training data."""
    model.write().overwrite().save(f"{path.rstrip('/')}/model")
    meta = json.dumps({"features": features, "seed": SEED, "data_hash": data_hash})
    SparkSession.active().createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path.rstrip('/')}/metadata")
