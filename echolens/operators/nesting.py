"""Opinions nested per comment: whole lists, or on request slices of bounded length."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.paths import resolve_paths
from ..session import small
from .ordering import ranked

SLICE = 1000


def in_id_order():
    return F.sort_array(F.collect_list(F.struct("id", F.col("full_path").alias("path"), "sentiment", "quote"))).alias("opinions")


def whole_opinions(opinions: DataFrame) -> DataFrame:
    """One row per comment with all its opinions in id order, however many: one comment is one output row by nature."""
    return opinions.groupBy("comment_id").agg(in_id_order())


def nested_opinions(opinions: DataFrame, per_row: int = SLICE) -> DataFrame:
    """The opinions of each comment in id order, in slices for a reader that wants bounded arrays (no report does).

    A comment with more than ``per_row`` opinions is spread over several rows (``slice`` 0, 1, ...) by rank, so no
    array and no task grows with a single comment; slices in order, and the opinions in each, are in id order.
    """
    large = opinions.groupBy("comment_id").agg(F.count("*").alias("_n")).filter(F.col("_n") > per_row).select("comment_id")
    many = opinions.join(small(large), "comment_id", "left_semi").select("comment_id", "id")
    rank = ranked(many, ["comment_id"], [F.col("id")], "_rank")
    place = rank.select("id", F.floor((F.col("_rank") - 1) / per_row).alias("slice"))
    return (
        opinions.join(place, "id", "left").withColumn("slice", F.coalesce("slice", F.lit(0)))
        .repartition("comment_id", "slice")  # not by comment alone, which the join may have left behind
        .groupBy("comment_id", "slice")
        .agg(in_id_order())
    )


def opinion_counts(opinions: DataFrame) -> DataFrame:
    return opinions.groupBy("comment_id").agg(F.count("*").alias("opinion_count"))


def second_levels(opinions: DataFrame, tax: DataFrame) -> DataFrame:
    """Distinct sorted second levels per comment; the taxonomy bounds the set."""
    known = resolve_paths(opinions.select("comment_id", "full_path").distinct(), tax).filter(F.col("l2").isNotNull())
    return known.groupBy("comment_id").agg(F.sort_array(F.collect_set("l2")).alias("sub_topics"))
