"""Quality by a regularised quadratic discriminant over document statistics.

Each class of the labels is a normal density over the transformed statistics. Its covariance is shrunk twice: towards
the pooled one by ``POOL`` and towards a multiple of the identity by ``RIDGE`` (over statistics scaled to pooled unit
variance). The score is the posterior of label 1, from the difference of the log densities by Mahalanobis distances
under Cholesky factors that are computed once and sent along with the task.

Class counts, sums and cross products are summed in Spark over *all* labelled rows that may be learned from; only those
sums, whose number depends on the statistics alone, reach the driver. Rows with crc32(doc_id as text) mod 4 = 2 are never learned from.

Null and empty texts have a row of statistics as any other and get its score. A null doc_id is not held out and has no label.
Repeated doc_ids are scored row by row. If a class has no labelled row, the score is 0.5 everywhere. Null labels are no labels.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from codegrid.llm.common import batches, staged
from codegrid.llm.stats import NAMES, statistics

POOL, RIDGE = 0.05, 0.01
THRESHOLD = 0.7
HELD_OUT = "coalesce(crc32(cast(cast(doc_id as string) as binary)) % 4 = 2, false)"


def _statistics(frames):
    for pdf in batches(frames, 500_000):
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "no_id": pdf["no_id"], "x": [statistics(t) for t in pdf["text"]]})


def with_statistics(docs: DataFrame) -> DataFrame:
    src = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"),
                      F.col("text").cast("string").alias("text"))
    x = src.mapInPandas(_statistics, "doc_id long, no_id boolean, x array<double>")
    return x.select(F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "x")


def _moments(frames):
    """Counts, sums and cross products of this task's rows, by class."""
    total: dict[int, np.ndarray] = {}
    for pdf in frames:
        for label, part in pdf.groupby("label"):
            x = np.column_stack([np.ones(len(part)), np.stack(part["x"])])
            total[int(label)] = total.get(int(label), 0) + x.T @ x
    for label, m in total.items():
        yield pd.DataFrame({"label": label, "at": np.arange(m.size), "value": m.ravel()})


class Discriminant:
    def __init__(self, moments: dict[int, np.ndarray]) -> None:
        """moments: for class 0 and 1 the sums of (1, x) (1, x)'."""
        self.classes = []
        if len(moments) < 2 or min(m[0, 0] for m in moments.values()) < 2:
            return
        n = {k: m[0, 0] for k, m in moments.items()}
        mean = {k: m[0, 1:] / n[k] for k, m in moments.items()}
        within = {k: m[1:, 1:] - n[k] * np.outer(mean[k], mean[k]) for k, m in moments.items()}
        pooled = sum(within.values()) / sum(n.values())
        self.scale = np.sqrt(np.maximum(np.diag(pooled), 1e-12))
        pooled = pooled / np.outer(self.scale, self.scale)
        for k in (0, 1):
            cov = (1 - POOL) * within[k] / n[k] / np.outer(self.scale, self.scale) + POOL * pooled
            cov = (1 - RIDGE) * cov + RIDGE * np.trace(cov) / len(cov) * np.eye(len(cov))
            factor = np.linalg.cholesky(cov)
            self.classes.append((mean[k] / self.scale, np.linalg.inv(factor), np.log(np.diag(factor)).sum(), np.log(n[k] / sum(n.values()))))

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.classes:
            return np.full(len(x), 0.5)
        log = []
        for mean, whiten, half_log_det, prior in self.classes:
            z = (x / self.scale - mean) @ whiten.T
            log.append(prior - half_log_det - 0.5 * (z * z).sum(axis=1))
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def fit(stats: DataFrame, labels: DataFrame) -> Discriminant:
    """stats: doc_id, x; labels: doc_id, label (0 or 1)."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label")).where("label IN (0, 1)")
    rows = stats.join(known, "doc_id").where(f"NOT {HELD_OUT}").select("label", "x")
    sums = rows.mapInPandas(_moments, "label int, at int, value double").groupBy("label", "at").agg(F.sum("value").alias("value"))
    d = len(NAMES) + 1
    moments: dict[int, np.ndarray] = {}
    for r in sums.collect():  # 2 * (statistics + 1) ** 2 numbers
        moments.setdefault(r.label, np.zeros(d * d))[r.at] = r.value
    return Discriminant({k: m.reshape(d, d) for k, m in moments.items()})


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``."""
    stats = staged(with_statistics(docs), "qda-stats")
    model = fit(stats, labels)

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.stack(x)) if len(x) else [], dtype="float64")

    out = stats.withColumn("score", score("x")).withColumn("held_out", F.expr(HELD_OUT))
    return out.select("doc_id", "held_out", "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
