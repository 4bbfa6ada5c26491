"""Ordered work that must hold up when one group carries a large part of the rows.

``top_per_group`` relies on Spark's window group limit: each map task keeps at most ``k`` rows of a
group before the shuffle. ``ranked`` gives the exact position of *every* row without sorting a group
in one task: rows are range-partitioned on (keys, order), so a hot group spans many partitions, and
only one count per (group, partition) is summed up afterwards.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import cut, strip
from ..session import settled, small

GROUP_LIMIT = 1000  # spark.sql.optimizer.windowGroupLimitThreshold


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rn") -> DataFrame:
    """Rows ranked 1..k within ``keys``. ``order`` must end in a unique column."""
    if k > GROUP_LIMIT:
        return ranked(df, keys, order, name).filter(F.col(name) <= k)
    window = Window.partitionBy(*keys).orderBy(*order)
    kept = df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= k)
    return kept.withColumn(name, F.col(name).cast("bigint"))


def first_per_group(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_per_group(df, keys, order, 1, "_rn").drop("_rn")


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str = "rn") -> DataFrame:
    """Exact 1-based position of every row within ``keys`` (over everything when ``keys`` is empty).

    The laid-out rows are checkpointed, since both branches below must see the same partitions.
    Pass narrow rows: they go through one range shuffle and one write.
    """
    layout = [F.col(k).asc() for k in keys] + list(order)
    laid = settled(
        df.repartitionByRange(*layout).sortWithinPartitions(*layout).withColumn("_at", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_at", 33))
    runs = laid.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    # One row per group and partition: a group that fills every partition has as many rows as partitions.
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = runs.select(
        *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)),
        F.col("_part").alias("_p"),
        (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift"),
    )
    same = reduce(
        lambda a, b: a & b,
        [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)],
        F.col("_part") == F.col("_p"),
    )
    return (
        laid.join(shifts, same)
        .withColumn(name, F.col("_at") + F.col("_shift"))
        .drop("_at", "_part", "_p", "_shift", *(f"_k{i}" for i in range(len(keys))))
    )


def neighbourhoods(df: DataFrame, position: str, back: int, ahead: int, size: int = 100_000) -> DataFrame:
    """Cut ranked rows into blocks of ``size`` positions, each with its neighbours copied in.

    Windows over (keys, ``_block``) then see ``back`` rows before and ``ahead`` rows after every row
    that has ``_own`` set, and no block outgrows a task.
    """
    spots = F.array_distinct(
        F.transform(F.sequence(F.lit(-ahead), F.lit(back)), lambda d: F.floor((F.col(position) + d) / size))
    )
    return df.withColumn("_block", F.explode(spots)).withColumn("_own", F.floor(F.col(position) / size) == F.col("_block"))


def page(df: DataFrame, order: list[Column], number: int, size: int = 20) -> DataFrame:
    """One page; a number past the end gives the last page."""
    placed = ranked(df, [], order, "position")
    total = placed.count()  # the rows were settled above, so this reads them once
    last = max(1, -(-total // size))
    current = min(max(1, number), last)
    return placed.filter(F.col("position").between((current - 1) * size + 1, current * size)).withColumn(
        "page", F.lit(current)
    )


def every_nth(df: DataFrame, keys: list[str], order: list[Column], limit: int) -> DataFrame:
    """Groups larger than ``limit`` are cut to ``limit`` evenly spaced rows (index ``int(i * n / limit)``)."""
    placed = ranked(df, keys, order, "_rn")
    sizes = placed.groupBy(*keys).agg(F.count("*").alias("_n"))
    step = F.col("_n") / limit
    guess = F.floor((F.col("_rn") - 1) / step)
    hit = reduce(
        lambda a, b: a | b,
        [(F.floor((guess + d) * step) == F.col("_rn") - 1) & (guess + d).between(0, limit - 1) for d in (0, 1)],
    )
    joined = placed.join(small(sizes), keys)
    return joined.filter((F.col("_n") <= limit) | hit).drop("_n", "_rn")


def batches(df: DataFrame, order: list[Column], size: int) -> DataFrame:
    """Consecutive batches of ``size`` rows with the index inside the batch."""
    placed = ranked(df, [], order, "_rn")
    return placed.select(
        *df.columns,
        F.floor((F.col("_rn") - 1) / size).alias("batch"),
        ((F.col("_rn") - 1) % size).cast("int").alias("idx"),
    )


def hybrid_sample(
    comments: DataFrame, key: str = "target_id", whole_up_to: int = 1000, by_likes: int = 600,
    by_time: int = 400, max_count: int | None = None,
) -> DataFrame:
    """Small groups whole; of a larger group the most liked plus the newest not already taken."""
    cap = min(whole_up_to, max_count) if max_count else whole_up_to
    liked_n = min(by_likes, cap)
    newest_n = min(by_time, max(0, cap - liked_n))
    sizes = comments.groupBy(key).agg(F.count("*").alias("_n"))
    narrow = comments.select(key, "id", "likes", "posted_at").join(small(sizes), key)
    large = narrow.filter(F.col("_n") > whole_up_to)
    liked = top_per_group(large, [key], [F.desc_nulls_last("likes"), F.asc("id")], liked_n).select(key, "id")
    # The newest rows outside the first stratum lie within the newest (liked_n + newest_n) rows.
    recent = top_per_group(
        large, [key], [F.desc_nulls_last("posted_at"), F.asc("id")], liked_n + newest_n, "_recent"
    ).select(key, "id", "posted_at")
    newest = top_per_group(
        recent.join(liked, [key, "id"], "left_anti"), [key], [F.desc_nulls_last("posted_at"), F.asc("id")], newest_n
    ).select(key, "id")
    tagged = [
        narrow.filter(F.col("_n") <= whole_up_to).select(key, "id", F.lit("all").alias("stratum")),
        liked.withColumn("stratum", F.lit("liked")),
        newest.withColumn("stratum", F.lit("newest")),
    ]
    return reduce(DataFrame.unionByName, tagged)


def seeded_sample(df: DataFrame, n: int, seed: int, key: str = "id") -> DataFrame:
    """The same ``n`` rows for the same seed, whatever the partitioning."""
    draw = F.xxhash64(F.col(key), F.lit(seed))
    return df.orderBy(draw, F.col(key)).limit(n)


def order_breaks(comments: DataFrame, key: str = "target_id") -> DataFrame:
    """Rows in insertion order with the sign of the time step and the start of triple rises."""
    placed = ranked(comments.select(key, "id", "posted_at"), [key], [F.asc("id")], "position")
    blocks = neighbourhoods(placed, "position", back=1, ahead=2)
    window = Window.partitionBy(key, "_block").orderBy("position")
    before = F.lag("posted_at").over(window)
    one, two = F.lead("posted_at", 1).over(window), F.lead("posted_at", 2).over(window)
    step = F.when(F.col("posted_at") > before, 1).when(F.col("posted_at") < before, -1).when(before.isNotNull(), 0)
    return (
        blocks.withColumn("step", step)
        .withColumn("triple_rise", F.coalesce((F.col("posted_at") < one) & (one < two), F.lit(False)))
        .filter("_own")
        .select(key, "id", "position", "step", "triple_rise")
    )


def order_break_summary(comments: DataFrame, key: str = "target_id") -> DataFrame:
    return order_breaks(comments, key).groupBy(key).agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("step") == 1).alias("violations"),
        F.count_if(F.col("step") == 0).alias("equal_times"),
        F.count_if("triple_rise").alias("triple_rises"),
    )


def latest_reviews(comments: DataFrame, chars: int = 200) -> DataFrame:
    """Newest non-blank review of each target, cut to ``chars`` characters."""
    full = comments.withColumn("_text", strip(F.coalesce("content", F.lit("")))).filter(F.col("_text") != "")
    newest = first_per_group(
        full.select("target_id", "id", "posted_at", "rating", "_text"), ["target_id"],
        [F.desc_nulls_last("posted_at"), F.asc("id")])
    return newest.select("target_id", "id", cut(F.col("_text"), chars).alias("text"), "rating")
