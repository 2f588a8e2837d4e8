r"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes ratios.

Features are the n-grams of code points (``ORDERS``) of the lower-cased text, present or
not, hashed to ``BUCKETS``. Each is scaled by its log-count ratio

    r = log((p / |p|) / (q / |q|)),   p, q = texts of either class with it, plus 1

and a logistic regression with an L2 penalty on the scaled features gives the score.
Only n-grams whose shares in the classes differ by ``MIN_Z`` standard errors are used, the
``MAX_FEATURES`` most significant at most. An n-gram lies inside one text and the delimiter
behind it, so a score depends on its own text alone.

Training sees labelled rows outside the held-out fold, ``MAX_PER_CLASS`` of each class
at most, the ones with the smallest hash of their id; of several rows with one id the
text that comes first is read. The sampled texts are written once. Counting is a Spark
job; what reaches the driver is the feature table and, per training row, the numbers of
the features that it has: both bounded by these parameters, not by the corpus. Scoring is
one pass over the whole texts with a table of fixed size.

Defined cases: null and blank texts get the score of a text without features; a missing
or null label, or one of an unknown document, is ignored; of several labels of one
document the highest counts; without two classes among the labels the score is the share
of label 1, or 0 without labels; a null doc_id is not held out and not labelled; equal
rows score alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactspark.llm.common import text_slices, whole
from pactspark.session import materialise

ORDERS = (3, 4, 5, 6)
BUCKET_BITS = 20
MAX_PER_CLASS = 4_000
#: The most significant features that the model takes: its size, whatever the corpus.
MAX_FEATURES = 4_096
MIN_Z = 4.0
THRESHOLD = 0.7
PENALTY = 0.02
ROUNDS = 400

BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 2**64)
#: Closes each text.
DELIMITER = "\0"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, bucket) of every n-gram, one pair of arrays per order."""
    lowered = [t.lower() for t in texts]
    points = np.frombuffer("".join(t + DELIMITER for t in lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    sizes = np.array([len(t) + 1 for t in lowered], dtype=np.int64)
    owner = np.repeat(np.arange(len(lowered), dtype=np.int32), sizes)
    n = len(points)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(n)  # code points from here to the end of the own text
    shrink = np.cumprod(np.full(n, BASE_INVERSE, dtype=np.uint64)) * np.uint64(BASE)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((points + np.uint64(1)) * (np.cumprod(np.full(n, BASE, dtype=np.uint64)) * np.uint64(BASE_INVERSE)), out=sums[1:])
    for order in ORDERS:
        x = (sums[order:] - sums[:-order]) * shrink[: n + 1 - order] + np.uint64(order)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        own = left[: len(x)] >= order
        yield owner[: len(x)][own], (x[own] >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)


def present(texts: list[str], slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) of the features that each text has, each once."""
    pairs = []
    for owner, bucket in grams(texts):
        slot = slots[bucket]
        at = np.flatnonzero(slot >= 0)
        pairs.append(owner[at].astype(np.int64) << 32 | slot[at])
    pairs = np.unique(np.concatenate(pairs))
    return (pairs >> 32).astype(np.int64), (pairs & 0xFFFFFFFF).astype(np.int64)


@dataclass
class Model:
    """``slots``: feature of each bucket or -1; ``weights``: regression weight times ratio."""

    slots: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        text, feature = present(texts, self.slots)
        z = self.bias + np.bincount(text, weights=self.weights[feature], minlength=len(texts))
        return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def training_rows(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS) -> DataFrame:
    """(text, label) of the training sample, without the held-out fold."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label")).where(~held_out(F.col("doc_id")))
    ids = docs.select(F.col("doc_id").alias("_id")).where("_id is not null").distinct()
    known = known.join(ids, F.col("doc_id") == F.col("_id"), "left_semi")
    order = F.xxhash64(F.lit(11), "doc_id")
    sample = known.where("label = 1").orderBy(order, "doc_id").limit(max_per_class).union(known.where("label = 0").orderBy(order, "doc_id").limit(max_per_class))
    # At most twice max_per_class rows of two numbers: small whatever the corpus.
    found = docs.select("doc_id", "text").join(F.broadcast(sample.withColumnRenamed("doc_id", "_id")), F.col("doc_id") == F.col("_id"))
    return found.groupBy("_id", "label").agg(F.min("text").alias("text")).select("text", "label")


def counted(rows: DataFrame) -> DataFrame:
    """(bucket, p, q): texts of label 1 and 0 with an n-gram of the bucket; bucket -1 holds the numbers of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 2**BUCKET_BITS), dtype=np.int32)
        totals = np.zeros(2, dtype=np.int64)
        for batch in batches:
            for part, texts in text_slices(batch, chars=200_000):
                label = part.column("label").to_numpy()
                totals += np.bincount(label, minlength=2)
                pairs = [owner.astype(np.int64) << 32 | bucket for owner, bucket in grams(texts)]
                pairs = np.unique(np.concatenate(pairs))
                bucket, of = pairs & 0xFFFFFFFF, label[pairs >> 32]
                for x in (0, 1):
                    counts[x] += np.bincount(bucket[of == x], minlength=2**BUCKET_BITS).astype(np.int32)
        at = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(counts[1, at], totals[1]), pa.int64()),
                                          pa.array(np.append(counts[0, at], totals[0]), pa.int64())], ["bucket", "p", "q"])

    return rows.mapInArrow(run, "bucket int, p bigint, q bigint").groupBy("bucket").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))


def train(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS) -> Model:
    """The model; see the module for what bounds it."""
    rows = materialise(training_rows(docs, labels, max_per_class), "training-rows")
    counts = counted(rows).persist()
    try:
        total = counts.where("bucket = -1").first()
        positive, negative = (total.p, total.q) if total else (0, 0)
        slots = np.full(2**BUCKET_BITS, -1, dtype=np.int32)
        if not positive or not negative:
            rate = positive / max(1, positive + negative)
            return Model(slots, np.zeros(1), float(np.log(max(rate, 1e-6) / max(1 - rate, 1e-6))))
        share = (F.col("p") + F.col("q")) / (positive + negative)
        error = F.sqrt(share * (1 - share) * (1 / positive + 1 / negative)) + 1e-9
        z = F.abs(F.col("p") / positive - F.col("q") / negative) / error
        chosen = counts.where("bucket >= 0").withColumn("z", z).where(F.col("z") >= MIN_Z).orderBy(F.desc("z"), "bucket").limit(MAX_FEATURES).toPandas()
    finally:
        counts.unpersist()
    if chosen.empty:
        return Model(slots, np.zeros(1), float(np.log(positive / negative)))
    slots[chosen["bucket"].to_numpy()] = np.arange(len(chosen), dtype=np.int32)
    p, q = chosen["p"].to_numpy() + 1.0, chosen["q"].to_numpy() + 1.0
    ratio = np.log((p / p.sum()) / (q / q.sum()))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, chars=200_000):
                text, feature = present(texts, slots)
                cuts = np.searchsorted(text, np.arange(len(texts) + 1))
                lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(feature, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("label"), lists], ["label", "features"])

    sample = rows.mapInArrow(features, "label int, features array<int>").toPandas()
    return Model(slots, *regression(sample, ratio))


def regression(sample: pd.DataFrame, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights (times ratio) and bias, by accelerated gradient steps; classes weigh alike."""
    sample = sample.assign(k=[tuple(f) for f in sample["features"]]).sort_values(["label", "k"], kind="stable")  # whatever the order of arrival
    label = sample["label"].to_numpy(dtype=np.float64)
    sizes = np.array([len(f) for f in sample["features"]])
    feature = np.concatenate([np.asarray(f, dtype=np.int64) for f in sample["features"]]) if sizes.sum() else np.empty(0, np.int64)
    row = np.repeat(np.arange(len(label)), sizes)
    value = ratio[feature]
    weight = np.where(label == 1, 0.5 / label.sum(), 0.5 / (len(label) - label.sum()))
    norm = np.bincount(row, weights=value**2, minlength=len(label))
    step = 4.0 / (np.dot(weight, norm + 1) + PENALTY)
    w, bias, look_w, look_b, momentum = np.zeros(len(ratio)), 0.0, np.zeros(len(ratio)), 0.0, 1.0
    for _ in range(ROUNDS):
        z = look_b + np.bincount(row, weights=value * look_w[feature], minlength=len(label))
        miss = weight * (1.0 / (1.0 + np.exp(-np.clip(z, -500, 500))) - label)
        new_w = look_w - step * (np.bincount(feature, weights=value * miss[row], minlength=len(ratio)) + PENALTY * look_w / len(label))
        new_b = look_b - step * miss.sum()
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        look_w, look_b = new_w + (momentum - 1) / after * (new_w - w), new_b + (momentum - 1) / after * (new_b - bias)
        w, bias, momentum = new_w, new_b, after
    return w * ratio, float(bias)


def score_column(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """The score of every whole text; null reads as empty."""
    shared = docs.sparkSession.sparkContext.broadcast((model.slots, model.weights, model.bias))  # 2**BUCKET_BITS numbers

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Model(*shared.value)
        for texts in batches:
            batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string(), from_pandas=True)], ["text"])
            parts = [own.scores(t) for _, t in text_slices(batch, chars=200_000)]
            yield pd.Series(np.concatenate(parts) if parts else np.empty(0))

    return score.asNondeterministic()(F.col(text))  # so that it is evaluated once


def scored(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    model = train(docs, labels, max_per_class)
    rows = docs.select("doc_id", score_column(docs, model).alias("score"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """The documents below the threshold, with their columns."""
    model = train(docs, labels, max_per_class)
    return whole(docs, toxicity=score_column(docs, model)).where(F.col("toxicity") < threshold).select("row.*")
