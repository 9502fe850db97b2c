"""Registered queries of models and resampling (no SQL; tests compare with numpy)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import models
from .sql import rounded
from .tape_queries import tidy

#: All components of an embedding.
AXES = [f"e{i}" for i in range(64)]


def _axes(s: SparkSession, d: str) -> DataFrame:
    e = s.read.parquet(f"{d}/embeddings.parquet")
    return e.select("vec_id", "label", *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(AXES)])


def _labelled(s: SparkSession, d: str) -> DataFrame:
    """Labels with numeric text features."""
    docs = s.read.parquet(f"{d}/documents.parquet")
    n = F.greatest(F.length("text"), F.lit(1))
    share = lambda p: F.regexp_count("text", F.lit(p)) / n
    features = docs.select("doc_id", F.log1p("n_chars").alias("size"), share("[#$%&*]").alias("junk"), share("[0-9]").alias("digits"), share("[A-Z]").alias("upper"), share("\\n").alias("lines"))
    return s.read.parquet(f"{d}/labels.parquet").join(features, "doc_id")


FEATURES = ["size", "junk", "digits", "upper", "lines"]


def pca(s: SparkSession, d: str) -> DataFrame:
    rows = _axes(s, d)
    return tidy(models.fit_pca(rows, AXES, 4).transform(rows).select("vec_id", "z0", "z1", "z2", "z3"))


def kmeans(s: SparkSession, d: str) -> DataFrame:
    rows = _axes(s, d)
    return models.fit_kmeans(rows, AXES, 5, "vec_id").transform(rows).select("vec_id", "regime")


def ridge(s: SparkSession, d: str) -> DataFrame:
    rows = _axes(s, d)
    model = models.fit_ridge(rows.where("vec_id % 5 <> 0"), AXES[:-1], ["e63"], 1.0)
    mean = rows.where("vec_id % 5 <> 0").agg(F.avg("e63")).first()[0]
    return tidy(models.r2(model.transform(rows.where("vec_id % 5 = 0")), "e63", "e63_hat", mean))


def _series(s: SparkSession, d: str) -> np.ndarray:
    """Hourly means over all events: a clock whose length follows the period, not the rows."""
    hour = F.date_trunc("hour", F.col("ts"))
    rows = s.read.parquet(f"{d}/events.parquet").groupBy(hour.alias("h")).agg(F.avg("value").alias("v")).orderBy("h").collect()
    return np.array([r.v for r in rows])


def dcor(s: SparkSession, d: str) -> DataFrame:
    x = _series(s, d)
    return tidy(s.createDataFrame([(models.distance_correlation(x[:-1], x[1:]), models.distance_correlation(x, x))], "lagged double, own double"))


def permutation(s: SparkSession, d: str) -> DataFrame:
    x = _series(s, d)
    return tidy(models.permutation_test(s, x[: len(x) // 2], x[len(x) // 2 :], 500))


def bootstrap(s: SparkSession, d: str) -> DataFrame:
    x = _series(s, d)
    return tidy(models.bootstrap_ci(s, x, 500).unionByName(models.bootstrap_ci(s, x, 500, block=32)))


def logistic(s: SparkSession, d: str) -> DataFrame:
    rows = _labelled(s, d)
    train, test = rows.where("doc_id % 4 <> 0"), rows.where("doc_id % 4 = 0")
    model = models.fit_logistic(train, FEATURES, "quality", [1, 0])
    return tidy(model.transform(test).select("doc_id", "quality", F.col("p_1").alias("p")))


def competing(s: SparkSession, d: str) -> DataFrame:
    rows = _labelled(s, d).withColumn("class", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").otherwise("poor"))
    model = models.fit_logistic(rows.where("doc_id % 4 IN (1, 2)"), FEATURES, "class", ["toxic", "good", "poor"])
    model = models.fit_temperature(rows.where("doc_id % 4 = 3"), model, "class")
    return tidy(model.transform(rows.where("doc_id % 4 = 0")).select("doc_id", "class", "p_toxic", "p_good", "p_poor"))


def platt(s: SparkSession, d: str) -> DataFrame:
    rows = _labelled(s, d)
    model = models.fit_logistic(rows.where("doc_id % 4 IN (1, 2)"), FEATURES, "quality", [1, 0])
    calibrate = models.fit_platt(model.transform(rows.where("doc_id % 4 = 3")), "p_1", "quality")
    return tidy(model.transform(rows.where("doc_id % 4 = 0")).select("doc_id", "quality", calibrate(F.col("p_1")).alias("p_cal")))


def ablation(s: SparkSession, d: str) -> DataFrame:
    """Held-out metrics of growing feature stacks on the same split."""
    rows, out = _labelled(s, d), None
    for k in range(1, len(FEATURES) + 1):
        model = models.fit_logistic(rows.where("doc_id % 4 <> 0"), FEATURES[:k], "quality", [1, 0])
        held = stats.scored(model.transform(rows.where("doc_id % 4 = 0")), "quality", "p_1")
        part = held.agg(F.lit(k).alias("n_features"), F.count(F.lit(1)).alias("n"), stats.brier().alias("brier"), stats.log_loss().alias("log_loss")).crossJoin(stats.roc_auc(held))
        out = part if out is None else out.unionByName(part)
    return tidy(out)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"pca": pca, "kmeans": kmeans, "ridge": ridge, "dcor": dcor, "permutation_p": permutation, "bootstrap_ci": bootstrap, "logistic_l2": logistic, "competing_risk": competing, "platt": platt, "ablation": ablation}
SQL: dict[str, str] = {
    "dcor": rounded("""WITH h AS (SELECT date_trunc('hour', ts) AS h, avg(value) AS v FROM events GROUP BY 1), s AS (SELECT h, v AS x, lead(v) OVER (ORDER BY h) AS y FROM h), r AS (SELECT row_number() OVER (ORDER BY h) AS i, x, y FROM s WHERE y IS NOT NULL),
d AS (SELECT a.i AS i, b.i AS j, abs(a.x - b.x) AS a, abs(a.y - b.y) AS b FROM r a, r b), c AS (SELECT a - avg(a) OVER (PARTITION BY i) - avg(a) OVER (PARTITION BY j) + avg(a) OVER () AS a, b - avg(b) OVER (PARTITION BY i) - avg(b) OVER (PARTITION BY j) + avg(b) OVER () AS b FROM d)
SELECT sqrt(greatest(avg(a * b), 0) / sqrt(avg(a * a) * avg(b * b))) AS lagged, 1.0::DOUBLE AS own FROM c""", "lagged", "own")
}
