"""Language identification: nearest of several clustered centroids per language, by cosine.

A text's vector holds the hashed 1- to 3-byte n-grams of its lower-cased (A-Z) UTF-8 bytes in ``SLOTS`` slots, weighted
log(1 + count) * idf and brought to length one. Document frequencies are counted over all learnable texts. Per
language, a bounded sample (``PER_LANGUAGE`` texts with the smallest key hash) is clustered by spherical k-means into
``CLUSTERS`` centroids. A text gets the language of the nearest centroid; one that is further from it than all but
``STRAY`` of the centroid's own texts, with ``SLACK`` more, is marked ``rejected``.

Cases: null text or text without a letter is ``und`` with score 0; with nothing learned every text is ``und``; ties go
to the first language in order; a null language is not learned from; repeated documents are labelled each; very long
texts are read whole. Other columns pass through; result columns replace any of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from .frames import checked, table, written
from .ragged import LOWER, Block, blocks

SLOTS = 4096
PER_LANGUAGE, CLUSTERS, ROUNDS = 1000, 4, 10
STRAY, SLACK = 0.01, 0.1
TEXTS = 512  # vectors at a time
SALTS = 64  # parts of a language that are cut to size before they meet
ADDED = "lang_pred string, score double, rejected boolean"


def small_blocks(column: pa.Array) -> Iterator[Block]:
    """Blocks of at most ``TEXTS`` texts."""
    for block in blocks(column):
        for low in range(0, len(block), TEXTS):
            at = block.starts[low : low + TEXTS + 1]
            yield Block(block.lo + low, block.data[at[0] : at[-1]], at - at[0])


def counts(block: Block) -> np.ndarray:
    """Texts by slots: how often each hashed n-gram occurs."""
    data = LOWER[block.data].astype(np.uint32)
    owner = np.repeat(np.arange(len(block)), np.diff(block.starts))
    out = np.zeros(len(block) * SLOTS, np.float32)
    code = np.zeros(len(data), np.uint32)
    for n in (1, 2, 3):
        if len(data) < n:
            break
        code = code[: len(data) - n + 1] * np.uint32(256) + data[n - 1 :]
        slot = ((code + np.uint32(n << 28)) * np.uint32(0x9E3779B1)) >> np.uint32(20)
        same = owner[: len(code)] == owner[n - 1 :]
        out += np.bincount(owner[: len(code)][same] * SLOTS + slot[same], minlength=len(out))
    return out.reshape(len(block), SLOTS)


def vectors(block: Block, idf: np.ndarray) -> np.ndarray:
    """Rows of length one (zero for an empty text)."""
    x = np.log1p(counts(block)) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def frequencies(texts: DataFrame) -> np.ndarray:
    """Document frequency of every slot and, last, the number of texts; summed per task, then over the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS + 1, np.int64)
        for batch in batches:
            total[SLOTS] += batch.num_rows
            for block in small_blocks(batch.column(0)):
                total[:SLOTS] += (counts(block) > 0).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SLOTS + 1)), pa.array(total)], names=["slot", "n"])

    summed = texts.mapInArrow(run, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    out = np.zeros(SLOTS + 1, np.int64)
    out[summed["slot"]] = summed["n"]
    return out


def cluster(x: np.ndarray, k: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means with farthest-first starts: centroids of length one and each row's nearest."""
    mean = x.mean(axis=0)
    near = x @ (mean / max(np.linalg.norm(mean), 1e-12))
    starts = [int(near.argmax())]
    far = x @ x[starts[0]]  # nearest start so far
    while len(starts) < min(k, len(x)) and far.min() <= 1 - 1e-9:
        starts.append(int(far.argmin()))
        far = np.maximum(far, x @ x[starts[-1]])
    centroids = x[starts]
    for _ in range(rounds):
        own = (x @ centroids.T).argmax(axis=1)
        sums = np.stack([x[own == j].sum(axis=0) if (own == j).any() else centroids[j] for j in range(len(centroids))])
        centroids = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centroids, (x @ centroids.T).argmax(axis=1)


def centroids_of(frame: pd.DataFrame, idf: np.ndarray) -> pd.DataFrame:
    frame = frame.sort_values("key")
    x = np.concatenate([vectors(b, idf) for b in small_blocks(pa.array(frame["text"], pa.large_string()))])
    centroids, own = cluster(x, CLUSTERS)
    near = (x * centroids[own]).sum(axis=1)
    floors = [float(np.quantile(near[own == j], STRAY)) - SLACK if (own == j).any() else 1.0 for j in range(len(centroids))]
    return pd.DataFrame({"lang": frame["lang"].iloc[0], "vector": list(centroids.astype(np.float32)), "floor": floors})


class Model:
    def __init__(self, idf: np.ndarray, langs: list[str], centroids: np.ndarray, floors: np.ndarray):
        self.idf, self.langs, self.centroids, self.floors = idf, langs, centroids, floors


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Learn from every row of ``docs`` with a language and a text with a letter."""
    known = docs.select(F.col(key).cast("bigint").alias("key"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    known = known.filter("key IS NOT NULL AND lang IS NOT NULL").filter(F.col("text").rlike(r"\p{L}"))
    seen = frequencies(known.select("text"))
    idf = np.log((1 + seen[SLOTS]) / (1 + seen[:SLOTS])).astype(np.float32) + np.float32(1)
    # First within salts of a language, then among what these keep: no task sees more than SALTS * per_language rows of one.
    order = (F.xxhash64("key"), "key")
    chosen = known.select("key", "lang").distinct().withColumn("salt", F.pmod(F.xxhash64("key", F.lit(1)), F.lit(SALTS)))
    for by in (("lang", "salt"), ("lang",)):
        chosen = chosen.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("place") <= per_language).drop("place")
    chosen = chosen.select("key", "lang")
    chosen = written(chosen, "language-sample")
    sample = known.join(checked(chosen, F.length("lang") + 16), ["key", "lang"])
    found = sample.groupBy("lang").applyInPandas(lambda f: centroids_of(f, idf), "lang string, vector array<float>, floor double")
    rows = found.toArrow().to_pandas().sort_values("lang", kind="stable")  # ``CLUSTERS`` rows per language
    centroids = np.array(rows["vector"].tolist(), np.float32).reshape(len(rows), SLOTS)
    return Model(idf, rows["lang"].tolist(), centroids, rows["floor"].to_numpy(float))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of ``docs`` plus ``lang_pred``, ``score`` (cosine with the nearest centroid) and ``rejected``."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("lang_pred", "score", "rejected", "_letter")])
    docs = docs.withColumn("_letter", F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    at, held = docs.columns.index(text), docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*docs.schema.fields[:-1], *_parse_datatype_string(ADDED).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        names = np.array([*m.langs, "und"], object)
        for batch in batches:
            best, near = np.full(batch.num_rows, len(m.langs)), np.zeros(batch.num_rows)
            if m.langs:
                for block in small_blocks(batch.column(at)):
                    cos = vectors(block, m.idf) @ m.centroids.T
                    best[block.lo : block.lo + len(block)], near[block.lo : block.lo + len(block)] = cos.argmax(axis=1), cos.max(axis=1)
            letter = np.array(batch.column(batch.num_columns - 1).to_pylist(), bool)
            best, near = np.where(letter, best, len(m.langs)), np.where(letter, np.clip(near, 0, 1), 0)
            rejected = near < np.append(m.floors, 2.0)[best]
            made = [pa.array(names[best], pa.string()), pa.array(near, pa.float64()), pa.array(rejected)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[f.name for f in schema])

    return docs.mapInArrow(run, schema)


def held_out(key: str = "doc_id"):
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op6(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = fit(docs.filter(~held_out()))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
