"""Vectors: corpus vectorisation, search and micro-topic clusters."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import HashingTF, IDF, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import settled
from .ordering import top_per_group
from .words import tokens

LOW_SAMPLE = 30


def _words(rows: DataFrame, text: str, *keep: str) -> DataFrame:
    return rows.select(*keep, F.transform(tokens(F.coalesce(F.col(text), F.lit(""))), F.lower).alias("_words"))


@dataclass(frozen=True)
class Space:
    """V1: one fitted vector space: hashed term counts, IDF weights, length one.

    The weights are fitted once and kept as a pipeline model under ``folder/name``; every landing and every query loads them, so
    their vectors can be compared. The name goes into each vector row and is what ``guard`` and the search check.
    """

    name: str
    dim: int
    model: PipelineModel

    @staticmethod
    def fitted(rows: DataFrame, text: str, name: str, dim: int = 512, folder: str | None = None) -> Space:
        words = _words(rows, text)
        hashed = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dim)
        weights = IDF(inputCol="_tf", outputCol="_idf").fit(hashed.transform(words))
        model = PipelineModel([hashed, weights, Normalizer(inputCol="_idf", outputCol="_unit", p=2.0)])
        if folder:
            model.write().save(f"{folder}/{name}")  # fails if the name is taken: a space is never refitted under its name
        return Space(name, dim, model)

    @staticmethod
    def load(spark: SparkSession, folder: str, name: str) -> Space:
        model = PipelineModel.read().session(spark).load(f"{folder}/{name}")
        return Space(name, model.stages[0].getNumFeatures(), model)

    def vectors(self, rows: DataFrame, text: str, id: str = "id") -> DataFrame:
        """(id, vector); a blank text gives a zero vector."""
        unit = self.model.transform(_words(rows, text, id))
        return unit.select(id, vector_to_array("_unit", "float32").alias("vector"))


def vectorise(rows: DataFrame, text: str, dim: int = 512, id: str = "id") -> DataFrame:
    """V1 for rows that are compared among themselves only: a space fitted on them and thrown away."""
    return Space.fitted(rows, text, "once", dim).vectors(rows, text, id)


def guard(vectors: DataFrame, name: str, dim: int | None = None) -> DataFrame:
    """V3: per model and length found: rows, and whether they belong to the space asked for."""
    fits = F.col("model").eqNullSafe(F.lit(name)) & (F.col("dim").eqNullSafe(F.lit(dim)) if dim is not None else F.lit(True))
    return vectors.groupBy("model", "dim").agg(F.count("*").alias("n")).withColumn("ok", fits)


def foreign(vectors: DataFrame, name: str, dim: int | None = None) -> list[str]:
    """Models that keep ``vectors`` from being one space; an empty list if there are none."""
    found = guard(vectors, name, dim).filter("NOT ok").select(F.coalesce("model", F.lit("(none)")).alias("model")).distinct()
    return sorted(r["model"] for r in found.orderBy("model").limit(10).collect())


def of_space(vectors: DataFrame, model: str | None) -> DataFrame:
    """The vectors, with a check that fails the job at the first one of another model; it takes no pass of its own."""
    if model is None:
        return vectors
    same = F.assert_true(F.col("model").eqNullSafe(F.lit(model)), F.concat(F.lit(f"more than one space: expected {model}, found "), F.coalesce("model", F.lit("none"))))
    return vectors.withColumn("vector", F.when(same.isNull(), F.col("vector")))  # assert_true is null or fails


def scored(vectors: DataFrame, query: list[float], top: int, vector: str = "vector", id: str = "comment_id") -> DataFrame:
    """Inner products with one query, in Arrow batches; each batch hands on its ``top`` best rows only.

    Interpreted array lambdas cost about a hundred times a dense product per row, hence the Arrow step.
    """
    q = np.asarray(query, dtype=np.float64)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            matrix = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, q.size)
            scores = matrix @ q
            if batch.num_rows > top:
                # Ties at the edge are all handed on; the final sort settles them by id.
                edge = np.partition(scores, batch.num_rows - top)[batch.num_rows - top]
                keep = np.flatnonzero(scores >= edge)
            else:
                keep = np.arange(batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keep)), pa.array(scores[keep])], names=["comment_id", "score"])

    same = F.assert_true(F.size(vector) == q.size, F.lit("a vector and the query differ in length: more than one space"))
    checked = F.when(same.isNull(), F.col(vector)).alias(vector)  # assert_true is null or fails
    usable = vectors.select(F.col(id).cast("bigint").alias("comment_id"), checked)
    return usable.mapInArrow(best, "comment_id bigint, score double")


def semantic_search(
    vectors: DataFrame, comments: DataFrame, query: list[float], top: int = 10, columns: tuple[str, ...] = ("content",), model: str | None = None,
) -> DataFrame:
    """V2: the ``top`` comments by cosine (vectors are stored normalised), score to 4 digits. ``model`` is the space they must be of."""
    hits = scored(of_space(vectors, model), query, top).orderBy(F.desc("score"), "comment_id").limit(top)
    side = comments.select(F.col("id").alias("comment_id"), *columns)
    found = hits.join(side, "comment_id").orderBy(F.desc("score"), "comment_id")
    return found.withColumn("score", F.round("score", 4))


QUERY_BYTES = 64 << 20  # queries sent to every task at a time
QUERY_BLOCK, ROW_BLOCK = 256, 4096  # sides of one matrix product


def best_of(held: tuple[np.ndarray, ...], top: int) -> tuple[np.ndarray, ...]:
    """Of (query, id, score) entries the ``top`` of each query: highest score, then lowest id."""
    query, ids, score = held
    order = np.lexsort((ids, -score, query))
    query = query[order]
    rank = np.arange(len(query)) - np.searchsorted(query, query)
    kept = order[rank < top]
    return tuple(x[kept] for x in held)


def many_scored(vectors: DataFrame, queries: DataFrame, top: int, id: str = "comment_id", query_id: str = "query_id") -> DataFrame:
    """(query_id, comment_id, score): the ``top`` vectors of every query by inner product to 9 digits, ties by id.

    One pass over the vectors: each task multiplies its rows with the queries block by block and keeps the best of each
    query so far, so it hands on ``top`` rows a query, whatever it read. Queries beyond ``QUERY_BYTES`` take one more
    pass for each such amount.
    """
    asked = settled(queries.filter(F.col(query_id).isNotNull()).select(F.col(query_id).cast("bigint").alias("query_id"), F.col("vector").cast("array<float>").alias("vector")))
    size = asked.agg(F.sum(4 * F.size("vector") + 16)).first()[0] or 0
    passes = -(-size // QUERY_BYTES)
    found = None
    for part in range(passes):
        rows = asked if passes == 1 else asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == part)
        one = _one_pass(vectors, rows.toArrow(), top, id)  # bounded by QUERY_BYTES
        found = one if found is None else found.unionByName(one)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, comment_id bigint, score double")
    return top_per_group(found, ["query_id"], [F.desc("score"), F.asc("comment_id")], top, "_rank").drop("_rank")


def _one_pass(vectors: DataFrame, queries: pa.Table, top: int, id: str) -> DataFrame:
    lengths = {len(x) for x in queries["vector"].to_pylist()}
    if len(lengths) > 1:
        raise ValueError("the queries differ in length: more than one space")
    dim = lengths.pop() if lengths else 0
    sent = vectors.sparkSession.sparkContext.broadcast((queries["query_id"].to_numpy(), queries["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = sent.value
        none = np.zeros(0, np.int64)
        held = [(none, none, np.zeros(0)) for _ in range(0, len(names), QUERY_BLOCK)]
        edges = np.full(len(names), -np.inf)  # what a row must reach to be among the best of a query
        for batch in batches:
            ids = batch.column(0).to_numpy()
            rows = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, dim)
            for low in range(0, len(ids), ROW_BLOCK):
                part, part_ids = rows[low : low + ROW_BLOCK], ids[low : low + ROW_BLOCK]
                for block in range(len(held)):
                    at = slice(block * QUERY_BLOCK, (block + 1) * QUERY_BLOCK)
                    scores = np.round(matrix[at] @ part.T, 9)
                    edge = edges[at]
                    if len(part) > top:
                        edge = np.maximum(edge, np.partition(scores, len(part) - top, axis=1)[:, len(part) - top])
                    q, r = np.nonzero(scores >= edge[:, None])
                    held[block] = best_of(tuple(map(np.concatenate, zip(held[block], (q, part_ids[r], scores[q, r])))), top)
                    counts = np.bincount(held[block][0], minlength=len(edge))
                    full = np.flatnonzero(counts == top)
                    edges[at][full] = held[block][2][np.cumsum(counts)[full] - 1]
        for block, (q, found, score) in enumerate(held):
            yield pa.RecordBatch.from_arrays([pa.array(names[q + block * QUERY_BLOCK]), pa.array(found), pa.array(score)], names=["query_id", "comment_id", "score"])

    same = F.assert_true(F.size("vector") == dim, F.lit("a vector and the queries differ in length: more than one space"))
    usable = vectors.select(F.col(id).cast("bigint").alias("comment_id"), F.when(same.isNull(), F.col("vector")).alias("vector")).filter("comment_id IS NOT NULL AND vector IS NOT NULL")
    return usable.mapInArrow(best, "query_id bigint, comment_id bigint, score double")


def semantic_search_many(
    vectors: DataFrame, comments: DataFrame, queries: DataFrame, top: int = 10, columns: tuple[str, ...] = ("content",), model: str | None = None,
) -> DataFrame:
    """V2 for (query_id, vector) rows: the ``top`` comments of each query by cosine, score to 4 digits."""
    hits = many_scored(of_space(vectors, model), queries, top)
    side = comments.select(F.col("id").alias("comment_id"), *columns)
    return hits.join(side, "comment_id").withColumn("score", F.round("score", 4))


def centroids(labelled: DataFrame, label: str = "label", vector: str = "vector") -> DataFrame:
    """Mean vector per label, scaled to length one; partial sums combine on the map side."""
    means = labelled.groupBy(label).agg(
        Summarizer.mean(array_to_vector(vector)).alias("_mean"), F.count("*").alias("size"))
    center = vector_to_array("_mean")
    norm = F.sqrt(F.aggregate("_m", F.lit(0.0), lambda a, x: a + x * x)) + 1e-8
    return means.withColumn("_m", center).select(label, "size", F.transform("_m", lambda x: x / norm).alias("center"))


def dot(a: str, b: str):
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda total, x: total + x)


def cluster_report(labelled: DataFrame, id: str, top: int = 5, label: str = "label", vector: str = "vector") -> DataFrame:
    """Size, low-sample flag and the ``top`` members nearest to the mean of each cluster."""
    near = labelled.join(centroids(labelled, label, vector), label).withColumn("score", F.round(dot(vector, "center"), 6))
    best = top_per_group(near.select(label, "size", id, "score"), [label], [F.desc("score"), F.asc(id)], top, "rank")
    return best.withColumn("low_sample", F.col("size") < LOW_SAMPLE)


def cluster_shares(labelled: DataFrame, label: str = "label") -> DataFrame:
    """V6: members and share of the anchor's volume; one row per cluster, so the total is a small step."""
    counts = labelled.groupBy(label).agg(F.count("*").alias("hit_count"))
    total = F.sum("hit_count").over(Window.partitionBy())
    return counts.withColumn("volume_ratio", F.round(F.col("hit_count") / total, 4))


def anchored(opinions: DataFrame, comments: DataFrame, anchor: str, target: str | None = None, limit: int | None = None) -> DataFrame:
    """V4: opinions whose path holds the anchor; with a limit the lowest ids only. A blank quote gets its comment's content."""
    rows = opinions.filter(F.contains("full_path", F.lit(anchor)))
    side = comments.filter(F.col("target_id") == target) if target else comments
    text = side.select(F.col("id").alias("comment_id"), F.col("content").alias("_content"))
    blank = F.trim(F.coalesce("quote", F.lit(""))) == ""
    joined = rows.join(text, "comment_id").withColumn("quote", F.when(blank, F.col("_content")).otherwise(F.col("quote"))).drop("_content")
    return joined if limit is None else joined.orderBy("id").limit(limit)


def micro_topics(vectors: DataFrame, k: int = 5, rounds: int = 25, seed: int = 42, id: str = "id") -> DataFrame:
    """V4: cosine k-means labels; with no more rows than clusters every row is its own cluster.

    A zero vector has no direction; such rows get label -1.
    """
    every = settled(vectors)  # read again in every round
    some = F.exists("vector", lambda x: x != 0)
    rows, none = every.filter(some), every.filter(~some).select(id, "vector", F.lit(-1).alias("label"))
    n = rows.limit(k + 1).count()
    if n <= k:
        order = Window.partitionBy().orderBy(id)  # at most k rows
        return rows.withColumn("label", F.row_number().over(order) - 1).select(id, "vector", "label").unionByName(none)
    features = rows.withColumn("features", array_to_vector("vector"))
    model = KMeans(k=k, maxIter=rounds, seed=seed, distanceMeasure="cosine", predictionCol="label").fit(features)
    return model.transform(features).select(id, "vector", "label").unionByName(none)


def assign(vectors: DataFrame, seeds: list[list[float]], vector: str = "vector") -> DataFrame:
    """One assignment step: the seed with the highest inner product (the first on a tie)."""
    literal = F.from_json(F.lit(str([[float(x) for x in s] for s in seeds])), "array<array<double>>")
    score = lambda s: F.aggregate(
        F.zip_with(F.col(vector), s, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda a, x: a + x)
    scored_seeds = F.transform(literal, lambda s, i: F.struct(F.round(score(s), 9).alias("score"), (-i).alias("rank")))
    return vectors.withColumn("label", -F.array_max(scored_seeds)["rank"])
