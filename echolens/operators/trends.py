"""Volume and positive rate over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import values as v
from .metrics import top_game_ids


def bucket(mode: str = "day"):
    """Day, or the Monday of the ISO week."""
    return F.to_date(F.date_trunc(mode, F.col("posted_at").cast("timestamp")))


def measures():
    return [
        F.count("*").alias("total"),
        F.count_if(F.col("sentiment") == "positive").alias("pos"),
        F.count_if(F.col("rating") == 1).alias("rec"),
    ]


def time_series(units: DataFrame, mode: str = "day", by_game: bool = False) -> DataFrame:
    """A18"""
    keys = [bucket(mode).alias("bucket")] + (["target_id"] if by_game else [])
    return units.filter(F.col("posted_at").isNotNull()).groupBy(*keys).agg(*measures())


def top_game_trend(units: DataFrame, mode: str = "day", top: int = 5) -> DataFrame:
    """Every bucket by every one of the largest games in one aggregate, missing cells as zero."""
    games = top_game_ids(units, top)
    of = lambda g: F.col("target_id") == g
    cells = F.array(*[
        F.struct(
            F.lit(g).alias("target_id"), F.count_if(of(g)).alias("total"),
            F.count_if(of(g) & (F.col("sentiment") == "positive")).alias("pos"),
        )
        for g in games
    ])
    grid = units.filter(F.col("posted_at").isNotNull()).groupBy(bucket(mode).alias("bucket")).agg(cells.alias("cells"))
    return grid.select("bucket", F.inline("cells")).withColumn(
        "positive_rate", v.percent(F.col("pos"), F.col("total"), 1, 0.0))
