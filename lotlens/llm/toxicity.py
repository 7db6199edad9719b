"""Toxicity severity by cumulative-link ordinal regression on words and word beginnings.

One weight per feature is shared by all thresholds: P(grade > k) = sigmoid(w.x - theta_k) with ordered theta. The result
is the expected severity, the sum of those probabilities.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

WORD = re.compile(r"[^\W\d_]+")
BEGINNINGS = (4, 5, 6)


def words_of(text: str | None) -> Counter[str]:
    return Counter(WORD.findall(text.lower()) if text else ())


def values_of(words: Counter[str], place: dict[str, int]) -> dict[int, float]:
    """Each known feature's occurrences over the square root of all words: between a count and a share."""
    found: Counter[int] = Counter()
    for w, k in words.items():
        for f in features_of(w):
            if f in place:
                found[place[f]] += k
    size = max(1, words.total()) ** 0.5
    return {i: k / size for i, k in found.items()}


def features_of(word: str) -> list[str]:
    """A word and its beginnings (marked by a hyphen), which inflected forms share."""
    return [word, *(word[:k] + "-" for k in BEGINNINGS if len(word) > k)]


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def severity(self, score: np.ndarray) -> np.ndarray:
        """Expected grade at each score."""
        return (1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -60, 60)))).sum(1)


def fit_weights(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, grades: np.ndarray, n_features: int, ridge: float = 1e-5, rounds: int = 400,
                rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds that minimise the mean ordinal log loss plus a ridge, from (row, feature, value).

    Gradient steps with momentum and per-coordinate scale; gaps between thresholds are exponentials, so they stay ordered.
    """
    levels = int(grades.max(initial=0))
    weights, thetas = np.zeros(n_features), np.linspace(2.0, 3.0, max(levels, 1))[:levels]
    if not levels:
        return weights, thetas
    n = len(grades)
    state = np.concatenate([weights, thetas[:1], np.log(np.diff(thetas))])
    speed, scale = np.zeros_like(state), np.zeros_like(state)
    share = np.bincount(grades, minlength=levels + 1) / n
    balance = (1 / np.maximum(share, 1 / n) ** 0.5)[grades]
    balance /= balance.mean()
    for step in range(1, rounds + 1):
        w, theta = state[:n_features], state[n_features] + np.concatenate([[0], np.cumsum(np.exp(state[n_features + 1:]))])
        score = np.bincount(rows, w[columns] * values, n)
        over = np.concatenate([np.ones((n, 1)), 1 / (1 + np.exp(-np.clip(score[:, None] - theta[None, :], -60, 60))), np.zeros((n, 1))], axis=1)
        here = np.maximum(over[np.arange(n), grades] - over[np.arange(n), grades + 1], 1e-12)
        slope = over * (1 - over)
        up, down = slope[np.arange(n), grades], slope[np.arange(n), grades + 1]
        by_score = -balance * (up - down) / here / n
        by_theta = np.zeros(levels + 2)
        np.add.at(by_theta, grades, balance * up / here / n)
        np.add.at(by_theta, grades + 1, -balance * down / here / n)
        by_theta = by_theta[1:-1]
        tail = np.cumsum(by_theta[::-1])[::-1]
        gradient = np.concatenate([np.bincount(columns, by_score[rows] * values, n_features) + ridge * w, tail[:1], tail[1:] * np.exp(state[n_features + 1:])])
        speed = 0.9 * speed + 0.1 * gradient
        scale = 0.999 * scale + 0.001 * gradient**2
        state = state - rate * (speed / (1 - 0.9**step)) / (np.sqrt(scale / (1 - 0.999**step)) + 1e-8)
    return state[:n_features], state[n_features] + np.concatenate([[0], np.cumsum(np.exp(state[n_features + 1:]))])


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[bool, Counter] = {False: Counter(), True: Counter()}

    def rows(toxic):
        return pa.RecordBatch.from_arrays([pa.array(counts[toxic].keys(), pa.string()), pa.array([toxic] * len(counts[toxic]), pa.bool_()), pa.array(counts[toxic].values(), pa.int64())],
                                          names=["feature", "toxic", "k"])
    for batch in batches:
        for text, grade in zip(batch.column("text"), batch.column("grade").to_pylist(), strict=True):
            counts[grade > 0].update({f for w in words_of(text.as_py()) for f in features_of(w)})
            for toxic in (False, True):
                if len(counts[toxic]) > 200_000:
                    yield rows(toxic)
                    counts[toxic].clear()
    yield rows(False)
    yield rows(True)


def _places(shared: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = shared.value
        for batch in batches:
            found = [values_of(words_of(t.as_py()), place) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("grade"), pa.array([np.fromiter(x, np.int32, len(x)).tobytes() for x in found], pa.binary()),
                                              pa.array([np.fromiter(x.values(), np.float64, len(x)).tobytes() for x in found], pa.binary())], names=["grade", "places", "sizes"])
    return run


def train(docs: DataFrame, grades: DataFrame, rows_per_grade: int = 8000, most: int = 4096, least: float = 4.0) -> Model:
    """Fits on docs (doc_id, text) with grades (doc_id, grade 0, 1, 2, ...).

    A hash of doc_id draws about `rows_per_grade` labelled rows of each grade (all, where there are fewer): the sample, its
    broadcast side and the fit are bounded at any input size. Equal texts count once. Features whose document share
    differs between grade 0 and the others by `least` standard errors enter, the `most` strongest of them. Several
    grades for one doc_id: the highest counts. Null ids and grades teach nothing; without both a toxic and a clean row
    the model finds everything clean.
    """
    spark = docs.sparkSession
    grades = grades.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("grade").cast("int").alias("grade")).where("doc_id is not null and grade >= 0")
    sizes = {r.grade: r.n for r in grades.groupBy("grade").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2 or 0 not in sizes:
        return Model()
    share = F.create_map(*[F.lit(x) for g, n in sizes.items() for x in (g, rows_per_grade / n)])[F.col("grade")]
    drawn = grades.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 52)) / float(1 << 52) < share).groupBy("doc_id").agg(F.max("grade").alias("grade"))
    taught = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").join(F.broadcast(drawn), "doc_id").select("text", "grade")
    once = taught.withColumn("mark", F.xxhash64("text")).dropDuplicates(["mark"]).select("text", "grade")
    counted = once.mapInArrow(_feature_counts, "feature string, toxic boolean, k long").groupBy("feature").agg(
        F.sum(F.when(F.col("toxic"), F.col("k")).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic"), 0).otherwise(F.col("k"))).alias("b")).where("a + b >= 4")
    totals = {r.toxic: r.n for r in once.groupBy((F.col("grade") > 0).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    n1, n0 = totals.get(True, 0), totals.get(False, 0)
    if not n1 or not n0:
        return Model()
    both = (F.col("a") + F.col("b") + 1) / float(n1 + n0 + 2)
    z = F.abs((F.col("a") + 0.5) / float(n1 + 1) - (F.col("b") + 0.5) / float(n0 + 1)) / F.sqrt(both * (1 - both) * (1 / n1 + 1 / n0))
    names = sorted(r.feature for r in counted.withColumn("z", z).where(F.col("z") >= least).orderBy(F.desc("z"), "feature").limit(most).collect())
    shared = spark.sparkContext.broadcast({f: i for i, f in enumerate(names)})
    got = once.mapInArrow(_places(shared), "grade int, places binary, sizes binary").collect()
    shared.unpersist()
    grade_of = np.array([r.grade for r in got])
    present = np.unique(grade_of)
    lengths = np.array([len(r.places) // 4 for r in got])
    columns, values = np.frombuffer(b"".join(r.places for r in got), np.int32).astype(np.int64), np.frombuffer(b"".join(r.sizes for r in got), np.float64)
    del got
    weights, thresholds = fit_weights(np.repeat(np.arange(len(lengths)), lengths), columns, values, np.searchsorted(present, grade_of), len(names))
    # A grade nobody has shares the threshold of the next one that somebody has.
    every = np.array([thresholds[np.searchsorted(present, g) - 1] for g in range(1, int(present.max()) + 1)])
    return Model({f: float(w) for f, w in zip(names, weights, strict=True) if abs(w) > 1e-4}, every)


RESULT = "struct<severity: double, grade: int, toxic: boolean>"


def grade(docs: DataFrame, model: Model, text: str = "text", limit: float = 0.5) -> Column:
    """Expected severity, its nearest grade and whether it reaches `limit`, as a struct column of `docs`.

    All words of the whole text count. Null or empty text, or one without a known word, has the severity of no evidence.
    Without a trained model severity is 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @arrow_udf(RESULT)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model, known = shared.value, {}
        weight = model.weights.get
        for batch in batches:
            scores = np.zeros(len(batch))
            for i, t in enumerate(batch):
                words, total = words_of(t.as_py()), 0.0
                for w, k in words.items():
                    got = known.get(w)
                    if got is None:
                        if len(known) > 100_000:
                            known.clear()
                        known[w] = got = sum(weight(f, 0.0) for f in features_of(w))
                    total += got * k
                scores[i] = total / max(1, words.total()) ** 0.5
            severity = model.severity(scores)
            yield pa.StructArray.from_arrays([pa.array(severity), pa.array(np.rint(severity).astype(np.int32)), pa.array(severity >= limit)], names=["severity", "grade", "toxic"])
    return run(F.col(text))
