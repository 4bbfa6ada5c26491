"""Joins between the core tables. No side is hinted: Catalyst and AQE decide on measured sizes,
and AQE splits a hot ``comment_id`` in the shuffled case. The key side of a semi or anti join is made
distinct first: that combines on the map side and leaves one row of a hot key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import values as v


def with_comment(opinions: DataFrame, comments: DataFrame, *columns: str) -> DataFrame:
    """Opinions with columns of their comment."""
    side = comments.select(F.col("id").alias("comment_id"), *columns)
    return opinions.join(side, "comment_id")


def missing_vectors(comments: DataFrame, vectors: DataFrame, limit: int | None = None, **equals: str) -> DataFrame:
    """Comments without a vector, lowest id first when limited."""
    rows = comments
    for name, value in equals.items():
        rows = rows.filter(F.col(name) == value)
    rows = rows.join(vectors.select(F.col("comment_id").alias("id")), "id", "left_anti")
    return rows.orderBy("id").limit(limit) if limit is not None else rows


def having_opinions(comments: DataFrame, opinions: DataFrame) -> DataFrame:
    """J3"""
    return comments.join(opinions.select(F.col("comment_id").alias("id")).distinct(), "id", "left_semi")


def opinions_of_platform(opinions: DataFrame, comments: DataFrame, platform: str) -> DataFrame:
    chosen = comments.filter(F.col("platform") == platform).select(F.col("id").alias("comment_id"))
    return opinions.join(chosen, "comment_id", "left_semi")


def lookup(rows: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    """Rows whose id is listed."""
    return rows.join(ids.select(column).distinct(), column, "left_semi")


def named_targets(comments: DataFrame, names: DataFrame) -> DataFrame:
    """JSON name, else the configured name of the app, else the id itself."""
    app = F.element_at(F.split("target_id", ":"), -1)
    return (
        comments.withColumn("appid", app)
        .join(names.select("appid", F.col("name").alias("_name")), "appid", "left")
        .withColumn("target_name", v.meta_name(F.col("extra_meta"), F.coalesce("_name", "appid")))
        .drop("_name")
    )


def reconcile(due: DataFrame, remote: DataFrame, keys: tuple[str, ...] = ("platform", "source_id")) -> DataFrame:
    """Each key as ``matched``, ``only_remote`` (skipped) or ``only_local`` (not covered)."""
    local = due.select(*keys).distinct().withColumn("_l", F.lit(1))
    there = remote.select(*keys).distinct().withColumn("_r", F.lit(1))
    state = (
        F.when(F.col("_l").isNull(), "only_remote").when(F.col("_r").isNull(), "only_local").otherwise("matched")
    )
    return local.join(there, list(keys), "full").withColumn("state", state).drop("_l", "_r")


def layered_view(cleaned: DataFrame, tagged: DataFrame, raw: DataFrame, targets: DataFrame) -> DataFrame:
    """Cleaned, tagged and raw layers with the target's name and type where known."""
    names = targets.select("target_id", F.col("name").alias("target_name"), F.col("type").alias("target_type"))
    return (
        cleaned.join(tagged, "clean_id").join(raw, "raw_id").join(names, "target_id", "left")
        .withColumnRenamed("clean_id", "id").withColumnRenamed("cleaned_text", "content")
    )


def zero_filled(dim: DataFrame, counts: DataFrame, keys: list[str], column: str = "n") -> DataFrame:
    """J9"""
    return dim.join(counts, keys, "left").withColumn(column, F.coalesce(column, F.lit(0)))


def agreement(predicted: DataFrame, expected: DataFrame, key: str, label: str) -> DataFrame:
    """Null-safe comparison of two labelings."""
    other = expected.select(key, F.col(label).alias("expected"))
    return predicted.join(other, key).withColumn("ok", F.col(label).eqNullSafe(F.col("expected")))
