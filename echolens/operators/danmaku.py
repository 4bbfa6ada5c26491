"""Bullet comments: label distribution and 30-second windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import values as v
from ..functions.paths import segment
from ..session import settled
from .lexicon import Lexicon
from .matching import labelled, tone
from .metrics import over_all

WINDOW_SECONDS = 30


def label_distribution(danmaku: DataFrame, lex: Lexicon, top: int = 15) -> DataFrame:
    """Matched and unmatched rows, L1, the largest L2 and the largest paths in long form.

    Everything derives from one count per label, which the dictionary bounds. A label outside the taxonomy is matched
    but has no path.
    """
    by_path = settled(labelled(danmaku, "content", lex).groupBy("l3", "full_path").agg(F.count("*").alias("n")))
    state = F.when(F.col("l3").isNull(), "unmatched").otherwise("matched")
    match = by_path.groupBy(state.alias("label")).agg(F.sum("n").alias("n")).withColumn(
        "pct", v.percent(F.col("n"), over_all("n")))
    hit = by_path.filter(F.col("full_path").isNotNull())

    def level(name: str, key) -> DataFrame:
        return hit.groupBy(key.alias("label")).agg(F.sum("n").alias("n")).withColumn(
            "pct", v.percent(F.col("n"), over_all("n"))).select(F.lit(name).alias("kind"), "label", "n", "pct")

    largest = lambda df: df.orderBy(F.desc("n"), "label").limit(top)
    return (
        match.select(F.lit("match").alias("kind"), "label", "n", "pct")
        .unionByName(level("L1", segment(F.col("full_path"), "L1")))
        .unionByName(largest(level("L2", segment(F.col("full_path"), "L2"))))
        .unionByName(largest(level("path", F.col("full_path"))))
    )


def windows(danmaku: DataFrame, lex: Lexicon, seconds: int = WINDOW_SECONDS, per_video: bool = False) -> DataFrame:
    """Volume, largest label and tone per window; windows without rows do not appear."""
    keys = (["video_id"] if per_video else []) + ["window"]
    cells = (
        labelled(danmaku, "content", lex)
        .withColumn("window", F.floor(F.col("progress") / seconds))
        .withColumn("_tone", tone(F.col("content"), lex))
        .groupBy(*keys, "full_path")
        .agg(
            F.count("*").alias("n"), F.count_if(F.col("_tone") == "positive").alias("pos"),
            F.count_if(F.col("_tone") == "negative").alias("neg"),
        )
    )
    # ``cells`` has at most one row per window and path, so the largest label is a small step.
    best = F.min_by(F.struct("full_path", "n"), F.when(F.col("full_path").isNotNull(), F.struct(-F.col("n"), F.col("full_path"))))
    return cells.groupBy(*keys).agg(
        F.sum("n").alias("volume"), best.alias("_top"), F.sum("pos").alias("praise"), F.sum("neg").alias("criticize"),
    ).select(
        *keys, (F.col("window") * seconds).alias("start"), "volume", F.col("_top.full_path").alias("top_path"),
        F.when(F.col("_top.full_path").isNotNull(), F.col("_top.n")).alias("top_n"), "praise", "criticize",
    )


def tone_windows(danmaku: DataFrame, lex: Lexicon, seconds: int = WINDOW_SECONDS, newest: str | None = None) -> DataFrame:
    """Volume and tone per video and window: the part of A29 that a stream can keep up to date.

    ``newest`` names a time column whose maximum per window is added.
    """
    sign = tone(F.col("content"), lex)
    counts = [
        F.count("*").alias("volume"), F.count_if(F.col("_tone") == "positive").alias("praise"),
        F.count_if(F.col("_tone") == "negative").alias("criticize"),
    ]
    return (
        danmaku.withColumn("window", F.floor(F.col("progress") / seconds)).withColumn("_tone", sign)
        .groupBy("video_id", "window").agg(*counts, *([F.max(newest).alias("newest")] if newest else []))
    )
