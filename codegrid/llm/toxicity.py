"""Toxicity by a classifier chain: one linear model per category, in a fixed order, each fed the probabilities of the
categories before it.

The categories are 0/1 columns of the labels. Inputs are the document statistics, whether the ``WORDS`` words that tell a
category best (by chi-square over the labelled documents) occur in the whole text, and the earlier probabilities. A
later model is trained on *out-of-fold* probabilities: each labelled row's comes from a model of the earlier category fitted without the row's fold,
so the later model sees them as noisy as they will be on new documents.

Fitting uses at most about ``SAMPLE`` labelled rows, drawn by a hash of the doc_id (a documented bound; word counts and models come from
these rows alone); logistic regressions run on Spark. Scoring covers all rows and whole texts.

Null and empty texts are scored on their zero statistics. Rows with null labels are not learned from; repeated labels of one doc_id
count once (the largest of each category). A category whose labels are all alike has that label as its probability;
without any labels it is 0. Extra columns stay.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from codegrid.llm.common import batches, drop, lean, staged
from codegrid.llm.stats import NAMES, statistics

SAMPLE, WORDS, FOLDS = 30_000, 256, 3
THRESHOLD = 0.5
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def _word_counts(categories: list[str]):
    """How many of this batch's documents hold a word, in all and of each category."""
    @lean
    def run(frames):
        for pdf in batches(frames, 500_000):
            got: dict[str, np.ndarray] = {}
            for row in zip(pdf["text"], *[pdf[c] for c in categories]):
                one = np.array((1, *row[1:]), np.int64)
                for w in words(row[0]):
                    got[w] = got[w] + one if w in got else one
            if got:
                m = np.stack(list(got.values()))
                yield pd.DataFrame({"word": list(got), "n": m[:, 0], **{f"n_{c}": m[:, i + 1] for i, c in enumerate(categories)}})
    return run


def telling_words(rows: DataFrame, categories: list[str]) -> list[str]:
    """The words that tell each category best, at most WORDS of each."""
    schema = ", ".join(["word string", "n long", *[f"`n_{c}` long" for c in categories]])
    counts = (rows.select("text", *categories).mapInPandas(_word_counts(categories), schema)
              .groupBy("word").agg(*[F.sum(c).alias(c) for c in ("n", *[f"n_{c}" for c in categories])]).where("n >= 4"))
    size = rows.agg(F.count(F.lit(1)), *[F.sum(c) for c in categories]).first()
    found: set[str] = set()
    counts = staged(counts, "tox-words")
    for c, positive in zip(categories, size[1:]):
        total, positive = float(size[0]), float(positive or 0)
        if not 0 < positive < total:
            continue
        a, n = F.col(f"n_{c}").cast("double"), F.col("n").cast("double")
        off = a * total - n * positive
        chi = off * off / (n * (F.lit(total) - n + 1e-9) * positive * (total - positive))
        found |= {r.word for r in counts.orderBy(F.desc(chi), "word").limit(WORDS).collect()}
    return sorted(found)


def features(texts, vocabulary: dict[str, int]) -> np.ndarray:
    x = np.zeros((len(texts), len(NAMES) + len(vocabulary)))
    for i, t in enumerate(texts):
        x[i, :len(NAMES)] = statistics(t)
        for w in words(t):
            j = vocabulary.get(w)
            if j is not None:
                x[i, len(NAMES) + j] = 1.0
    return x


def _inputs(vocabulary: dict[str, int], categories: list[str]):
    """Rows of inputs, a few hundred at a time: they are far wider than the texts' own columns."""
    @lean
    def run(frames):
        for pdf in batches(frames, 500_000):
            for a in range(0, len(pdf), 256):
                part = pdf.iloc[a:a + 256]
                yield pd.DataFrame({"x": list(features(part["text"].tolist(), vocabulary)), "fold": part["fold"].to_numpy(),
                                    **{c: part[c].to_numpy() for c in categories}})
    return run


class Linear:
    """Logistic model; without both labels, the one that there is."""

    def __init__(self, rows: DataFrame, column: str, inputs) -> None:
        counts = {r[0]: r[1] for r in rows.groupBy(column).count().collect()}
        self.weights, self.constant = None, float(max(counts, default=0))
        if len(counts) == 2:
            fit = LogisticRegression(featuresCol="f", labelCol="y", regParam=1e-3, maxIter=60, aggregationDepth=2).fit(
                rows.select(array_to_vector(inputs).alias("f"), F.col(column).cast("double").alias("y")))
            self.weights, self.intercept = fit.coefficients.toArray(), float(fit.intercept)

    def column(self, x):
        """The probability as a column of the inputs ``x``."""
        if self.weights is None:
            return F.lit(self.constant)
        terms = F.zip_with(x, F.lit(self.weights.tolist()), lambda a, b: a * b)
        return 1 / (1 + F.exp(-F.aggregate(terms, F.lit(self.intercept), lambda total, t: total + t)))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.intercept, -700, 700)))


class Chain:
    def __init__(self, docs: DataFrame, labels: DataFrame, categories: list[str]) -> None:
        self.categories = categories
        known = labels.select(F.col("doc_id").cast("long").alias("label_id"), *[F.col(c).cast("int").alias(c) for c in categories])
        known = known.na.drop().where(" AND ".join(f"`{c}` IN (0, 1)" for c in categories)).groupBy("label_id").agg(*[F.max(c).alias(c) for c in categories])
        share = min(1.0, SAMPLE / max(1, known.count()))
        known = known.where(F.pmod(F.xxhash64("label_id"), F.lit(1_000_000)) < int(share * 1_000_000))
        # at most about SAMPLE rows of a few bytes: small by that parameter, whatever the data
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        rows = staged(texts.join(F.broadcast(known), F.col("doc_id") == F.col("label_id")).drop("label_id"), "tox-rows")
        self.vocabulary = {w: i for i, w in enumerate(telling_words(rows, categories))}
        vocabulary = self.vocabulary

        kept = rows.select("text", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold"), *categories)
        schema = ", ".join(["x array<double>", "fold int", *[f"`{c}` int" for c in categories]])
        x = staged(kept.mapInPandas(_inputs(vocabulary, categories), schema), "tox-inputs")
        drop(rows)
        self.models: list[Linear] = []
        for i, c in enumerate(categories):
            self.models.append(Linear(x, c, F.col("x")))
            if i + 1 < len(categories):
                folds = [Linear(x.where(F.col("fold") != k), c, F.col("x")) for k in range(FOLDS)]

                p = F.lit(None).cast("double")
                for k, model in enumerate(folds):
                    p = F.when(F.col("fold") == k, model.column(F.col("x"))).otherwise(p)
                x = staged(x.withColumn("x", F.array_append("x", p)), "tox-inputs")

    def probabilities(self, texts) -> np.ndarray:
        x, out = features(texts, self.vocabulary), []
        for model in self.models:
            out.append(model(x))
            x = np.column_stack([x, out[-1]])
        return np.column_stack(out)


def _score(chain: Chain, keep_text: bool):
    @lean
    def run(frames):
        for pdf in frames:
            for a in range(0, len(pdf), 512):
                part = pdf.iloc[a:a + 512]
                p = chain.probabilities(part["text"].tolist())
                kept = {"text": part["text"]} if keep_text else {}
                yield pd.DataFrame({"row": part["row"], **kept, **{f"p{i}": p[:, i] for i in range(p.shape[1])}})
    return run


def score_documents(docs: DataFrame, labels: DataFrame, categories: list[str] = ("low_quality", "toxic"), keep_text: bool = False) -> DataFrame:
    """``docs`` with the probability of each category as ``p_<category>`` and ``toxic``: whether the last one's reaches THRESHOLD.
    The text is only carried along with ``keep_text``."""
    categories = list(categories)
    chain = Chain(docs, labels, categories)
    new = {f"p_{c}" for c in categories} | {"toxic"}
    shown = [c for c in docs.columns if c not in new and (keep_text or c != "text")]
    # the text goes to the tasks once, beside the other columns
    rows = docs.select(F.struct(*[c for c in shown if c != "text"]).alias("row"), F.col("text").cast("string").alias("text"))
    kind = rows.schema["row"].dataType
    schema = f"row {kind.simpleString()}, " + "text string, " * keep_text + ", ".join(f"p{i} double" for i in range(len(categories)))
    out = rows.mapInPandas(_score(chain, keep_text), schema)
    return out.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in shown], *[F.col(f"p{i}").alias(f"p_{c}") for i, c in enumerate(categories)],
                      (F.col(f"p{len(categories) - 1}") >= THRESHOLD).alias("toxic"))
