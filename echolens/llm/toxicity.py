"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the distinct hashed words, word pairs and pairs that skip one word (A-Z lower-cased, 2**20
slots). Training keeps a gradient sum and a squared-gradient sum per coordinate, so every coordinate has a rate of
its own, and a coordinate whose gradients never exceed the L1 bound keeps the weight zero. The model is therefore a
short list of (slot, weight) pairs, at most 2**20 of them, small enough to broadcast.

The fit reads a bounded sample: the ``FIT_ROWS`` labelled keys with the smallest hash, and of these, in the same order,
the rows whose features add up to ``FIT_SLOTS`` at most. One task reads them one after the other, as the method is
sequential, and holds one copy of them in 32-bit slots. The L1 bound grows with the square root of the rows, as the noise of
a gradient sum does. Scoring reads every whole text.

Cases: null or empty text has no feature and gets the model's bias; a null label is not learned from; of several
labels of one document the largest counts; without labelled rows every score is 0; repeated
documents are scored each. Columns of the input pass through, result columns replace any of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .frames import give_back, table, written
from .ragged import NOT_SPACE, Words, blocks, sequence_hash

BITS = 20
FIT_ROWS, EPOCHS = 20_000, 4
FIT_SLOTS = 1 << 26  # features of the sample; 256 MB
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.3, 1.0
BIAS = 1 << BITS  # slot of the intercept


@dataclass
class Model:
    slots: np.ndarray
    weights: np.ndarray

    def dense(self) -> np.ndarray:
        out = np.zeros(BIAS + 1)
        out[self.slots] = self.weights
        return out


def feature_slots(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all words, pairs and skip pairs of a block, and the text that holds each."""
    slots, owners = [], []
    for kind, gap in ((1, 0), (2, 1), (3, 2)):
        n = len(w.hash) - gap
        if n <= 0:
            continue
        at = np.flatnonzero(w.text[:n] == w.text[gap:])
        seed = np.full(len(at), kind, np.uint64)
        h = sequence_hash([seed, w.hash[at]] if gap == 0 else [seed, w.hash[at], w.hash[at + gap]])
        slots.append((h >> np.uint64(64 - BITS)).astype(np.int64))
        owners.append(w.text[at])
    none = np.zeros(0, np.int64)
    return (np.concatenate(slots), np.concatenate(owners)) if slots else (none, none)


def text_features(column: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct slots of every text."""
    for block in blocks(column):
        slot, owner = feature_slots(Words(block, NOT_SPACE))
        both = np.unique(owner << (BITS + 1) | slot)
        cut = np.searchsorted(both >> (BITS + 1), np.arange(len(block) + 1))
        for i in range(len(block)):
            yield both[cut[i] : cut[i + 1]] & ((1 << (BITS + 1)) - 1)


def ftrl(slots: np.ndarray, ends: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS) -> Model:
    """Train on sparse binary rows, rows shuffled by a fixed seed in each epoch.

    Row k holds the slots up to ``ends[k]`` from where row k - 1 ends, the intercept included.
    """
    z, n = np.zeros(BIAS + 1), np.zeros(BIAS + 1)
    positive = labels.mean()
    bound = L1 * np.sqrt(len(ends))
    starts = np.append(0, ends[:-1])
    weight = np.where(labels == 1, min(10.0, np.sqrt((1 - positive) / positive)) if positive else 1.0, 1.0)
    order = np.random.default_rng(7)

    def value(i):
        zi = z[i]
        return np.where(np.abs(zi) <= bound, 0.0, -(zi - np.sign(zi) * bound) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(epochs):
        for k in order.permutation(len(ends)):
            i = slots[starts[k] : ends[k]]
            w = value(i)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = weight[k] * (p - labels[k])
            rate = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - rate * w
            n[i] += g * g
    w = value(np.arange(BIAS + 1))
    used = np.flatnonzero(w)
    return Model(used, w[used])


def packed_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, label, text) to (key, label, slots as 32-bit integers)."""
    for batch in batches:
        slots = [x.astype(np.int32).tobytes() for x in text_features(batch.column(2))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(slots, pa.binary())], names=["key", "label", "slots"])


def train(batches: Iterator[pa.RecordBatch], limit: int = 0) -> Iterator[pa.RecordBatch]:
    """(key, label, slots) rows in the order of the sample to the model's (slot, weight) rows."""
    limit = limit or FIT_SLOTS
    held, ends, labels, total, full = np.zeros(1 << 16, np.int32), [], [], 0, False
    for batch in batches:
        if full:
            continue  # what lies beyond the limit is read and left
        for label, raw in zip(batch.column(1).to_pylist(), batch.column(2)):
            row = np.frombuffer(raw.as_buffer(), np.int32)
            size = len(row) + 1
            full = bool(ends) and total + size > limit
            if full:
                break
            if total + size > len(held):
                held = np.concatenate([held, np.zeros(max(len(held) // 2, size), np.int32)])
            held[total : total + size - 1], held[total + size - 1] = row, BIAS
            total += size
            ends.append(total), labels.append(label)
    if ends:
        model = ftrl(held, np.array(ends), np.array(labels, float))
        del held
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array(model.slots), pa.array(model.weights)], names=["slot", "weight"])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = FIT_ROWS) -> Model:
    """Train on at most ``max_rows`` labelled keys of ``docs``."""
    known = labels.select(F.col(key).cast("bigint").alias("key"), F.col(label).cast("int").alias("label")).filter("key IS NOT NULL AND label IN (0, 1)")
    chosen = known.groupBy("key").agg(F.max("label").alias("label")).orderBy(F.xxhash64("key"), "key").limit(max_rows)
    chosen = written(chosen, "toxicity-sample")  # max_rows short rows
    texts = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("text"))
    sample = texts.join(F.broadcast(chosen), "key").select("key", "label", "text")
    rows = sample.mapInArrow(packed_features, "key bigint, label int, slots binary")
    weights = rows.repartition(1).sortWithinPartitions(F.xxhash64("key"), "key", "slots").mapInArrow(lambda it: train(it), "slot long, weight double")
    model = weights.toArrow()  # 2**20 + 1 rows at most
    return Model(model["slot"].to_numpy(), model["weight"].to_numpy())


def scores(column: pa.Array, weights: np.ndarray, used: np.ndarray) -> np.ndarray:
    """Probability of label 1 of every text; only slots with a weight are made distinct."""
    out = []
    for block in blocks(column):
        slot, owner = feature_slots(Words(block, NOT_SPACE))
        kept = used[slot]
        both = np.unique(owner[kept] << (BITS + 1) | slot[kept])
        out.append(np.bincount(both >> (BITS + 1), weights[both & ((1 << (BITS + 1)) - 1)], len(block)))
    total = np.concatenate(out) if out else np.zeros(0)
    return 1 / (1 + np.exp(-np.clip(total + weights[BIAS], -35, 35)))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of ``docs`` plus ``score`` and ``predicted`` (1 if the score is 0.5 or more)."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("score", "predicted")])
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)
    trained = len(model.slots) > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = held.value.dense()
        used = weights != 0
        for batch in batches:
            p = scores(batch.column(at), weights, used) if trained else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], names=[*batch.schema.names, "score"])

    out = docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("score", DoubleType())]))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def held_out(key: str = "doc_id"):
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def learned(spark: SparkSession, folder: str, docs: DataFrame) -> Model:
    return fit(docs, table(spark, folder, "labels").filter(~held_out()))


def op5(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return score(docs, learned(spark, folder, docs)).select("doc_id", held_out().alias("held_out"), "score", "predicted")
