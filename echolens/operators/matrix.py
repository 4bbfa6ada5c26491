"""Topic by target counts, tag trees and topic drill-downs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed_values as fixed, values as v
from ..functions.paths import level_column, path_dim, resolve_paths, segment
from ..session import settled
from .filters import parsed_list
from .joins import with_comment
from .metrics import top_game_ids
from .ordering import top_per_group


def topic_counts(
    opinions: DataFrame, comments: DataFrame, level: str = "L1", sentiment: str | None = None,
    meta_l1: str | None = fixed.META_L1, targets: list[str] | None = None, tax: DataFrame | None = None,
) -> DataFrame:
    """Opinion counts by topic and target, without the meta bucket (pass ``meta_l1=None`` to keep it)."""
    rows = opinions.select("comment_id", "full_path", "sentiment")
    if meta_l1:
        rows = rows.filter(~F.startswith("full_path", F.lit(meta_l1)))
    if sentiment:
        rows = rows.filter(F.col("sentiment") == sentiment)
    side = comments.filter(F.col("target_id").isin(targets)) if targets is not None else comments
    joined = with_comment(rows, side, "target_id")
    # Paths first: the taxonomy bounds them, and the level is then cut out of few rows.
    by_path = joined.groupBy("target_id", "full_path").agg(F.count("*").alias("n"))
    return level_column(by_path, level, tax).groupBy("topic", "target_id").agg(F.sum("n").alias("n"))


def opinion_matrix(opinions: DataFrame, comments: DataFrame, targets: list[str], **options) -> DataFrame:
    """A3 for display: one row per topic, one zero-filled column per chosen target."""
    cells = topic_counts(opinions, comments, targets=targets, **options)
    return cells.groupBy("topic").pivot("target_id", targets).agg(F.sum("n")).fillna(0, targets)


def filled(cells: DataFrame) -> DataFrame:
    """A3 in long form: (topic, target_id, n) with zeros, for any number of targets.

    The topics that occur (the taxonomy bounds them) are one scalar; each target explodes it.
    """
    held = settled(cells)
    topics = held.agg(F.collect_set("topic").alias("topics")).scalar()
    grid = held.select("target_id").distinct().select("target_id", F.explode(topics).alias("topic"))
    return grid.join(held, ["topic", "target_id"], "left").select("topic", "target_id", F.coalesce("n", F.lit(0)).alias("n"))


def shares(long: DataFrame) -> DataFrame:
    """A4: percentage within the target."""
    total = F.sum("n").over(Window.partitionBy("target_id"))
    return long.withColumn("share", F.col("n") / F.when(total == 0, 1).otherwise(total) * 100)


def deviations(long: DataFrame) -> DataFrame:
    """A5: share minus the plain mean of the topic's shares over all columns."""
    return shares(long).withColumn("deviation", F.col("share") - F.avg("share").over(Window.partitionBy("topic")))


def pain_points(opinions: DataFrame, comments: DataFrame, level: str = "L2", top: int = 5, **options) -> DataFrame:
    """A6"""
    counts = topic_counts(opinions, comments, level, sentiment="negative", **options)
    return top_per_group(counts, ["target_id"], [F.desc("n"), F.asc("topic")], top)


def tag_counts(comments: DataFrame, opinions: DataFrame, tax: DataFrame) -> DataFrame:
    """First level by topic, second by sub-topics, third by opinion path; zero where unused."""
    l1 = comments.filter(F.col("topic").isNotNull()).groupBy(F.col("topic").alias("name")).agg(F.count("*").alias("n"))
    l2 = comments.select(F.explode(parsed_list("sub_topics")).alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    parts = F.split("full_path", "/")
    l3 = opinions.filter(F.size(parts) >= 3).groupBy(
        F.array_join(F.slice(parts, 1, 3), "/").alias("name")).agg(F.count("*").alias("n"))
    names = {
        "L1": (tax.select(F.col("l1").alias("name")).distinct(), l1),
        "L2": (tax.select(F.col("l2").alias("name")).distinct(), l2),
        "L3": (tax.select(F.concat_ws("/", "l1", "l2", "l3").alias("name")), l3),
    }
    filled = [
        dim.join(counts, "name", "left").select(F.lit(level).alias("level"), "name", F.coalesce("n", F.lit(0)).alias("n"))
        for level, (dim, counts) in names.items()
    ]
    return filled[0].unionByName(filled[1]).unionByName(filled[2])


def tag_rollup(opinions: DataFrame, tax: DataFrame) -> DataFrame:
    """Counts summed upward from resolved opinion paths."""
    by_path = opinions.groupBy("full_path").agg(F.count("*").alias("n"))
    known = resolve_paths(by_path, tax).filter(F.col("l1").isNotNull())
    return (
        known.rollup("l1", "l2", "l3").agg(F.sum("n").alias("n"), F.grouping_id().alias("_g"))
        .filter(F.col("_g").isin(0, 1, 3))
        .select(F.when(F.col("_g") == 0, "L3").when(F.col("_g") == 1, "L2").otherwise("L1").alias("level"), "l1", "l2", "l3", "n")
    )


def opinion_topics(level: str, drill: list[str]) -> tuple[Column, Column]:
    """Topic column and row condition at opinion grain."""
    seg = F.split("full_path", "/")
    part = lambda i: F.try_element_at(seg, F.lit(i))
    if level == "L1":
        return part(1), F.lit(True)
    if level == "L2":
        return part(2), (part(1) == drill[0]) if drill else F.lit(True)
    if len(drill) < 2:
        return part(1), F.lit(False)
    return F.col("full_path"), (part(1) == drill[0]) & (part(2) == drill[1])


def voice_topics(voices: DataFrame, opinions: DataFrame, level: str, drill: list[str]) -> DataFrame:
    """(id, target_id, topic) rows at comment grain."""
    if level == "L1":
        return voices.filter(F.col("topic").isNotNull()).select("id", "target_id", "topic")
    under = voices.filter(F.col("topic") == drill[0]) if drill else voices
    if level == "L2":
        return under.select("id", "target_id", F.explode(parsed_list("sub_topics")).alias("topic"))
    if len(drill) < 2:
        return voices.filter(F.lit(False)).select("id", "target_id", "topic")
    under = under.filter(F.array_contains(parsed_list("sub_topics"), drill[1]))
    last = F.element_at(F.split("full_path", "/"), -1)
    return with_comment(opinions, under, "target_id").select(
        F.col("comment_id").alias("id"), "target_id", last.alias("topic"))


def drill_topics(units: DataFrame, level: str = "L1", drill: list[str] = (), top: int = 5) -> DataFrame:
    """A21 at opinion grain."""
    topic, keep = opinion_topics(level, list(drill))
    return top_topics(units.filter(keep).withColumn("topic", topic), top)


def top_topics(rows: DataFrame, top: int = 5) -> DataFrame:
    return rows.filter(F.coalesce("topic", F.lit("")) != "").groupBy("topic").agg(F.count("*").alias("n")).orderBy(
        F.desc("n"), "topic").limit(top)


def topic_by_game(units: DataFrame, topic: Column, keep: Column, top: int = 5) -> DataFrame:
    """The largest topics by the largest games, zero-filled.

    The units are read once, into a count per game and topic; largest games, largest topics and cells come from these.
    """
    cells = settled(units.groupBy("target_id", F.when(keep, topic).alias("topic")).agg(F.count("*").alias("n")))
    largest = lambda key: cells.filter(F.coalesce(key, F.lit("")) != "").groupBy(key).agg(F.sum("n").alias("_n")).orderBy(F.desc("_n"), key).limit(top).drop("_n")
    # A grid of ``top`` squared cells: every topic carries the list of games.
    games = largest("target_id").agg(F.sort_array(F.collect_list("target_id")).alias("games")).first()["games"]
    grid = largest("topic").select("topic", F.explode(F.array(*map(F.lit, games)).cast("array<string>")).alias("target_id"))
    return grid.join(cells, ["topic", "target_id"], "left").select("topic", "target_id", F.coalesce("n", F.lit(0)).alias("n"))


def sentiment_rows(units: DataFrame, top: int = 5) -> DataFrame:
    """Overall row plus the largest games; neutral takes up rows without sentiment."""
    games = top_game_ids(units, top)
    overall = F.lit("(all)")
    counts = (
        units.withColumn("_game", F.when(F.col("target_id").isin(games), F.col("target_id")).otherwise(""))
        .rollup("_game")
        .agg(
            F.grouping("_game").alias("_all"), F.count("*").alias("total"),
            F.count_if(F.col("sentiment") == "positive").alias("pos"), F.count_if(F.col("sentiment") == "negative").alias("neg"),
        )
        .filter((F.col("_all") == 1) | (F.col("_game") != ""))
    )
    return counts.select(
        F.when(F.col("_all") == 1, overall).otherwise(F.col("_game")).alias("name"), "total", "pos",
        (F.col("total") - F.col("pos") - F.col("neg")).alias("neu"), "neg",
    )
