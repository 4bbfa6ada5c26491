"""Scorecards and distributions. Every aggregate combines on the map side first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import values as v



def tallies() -> list[Column]:
    return [
        F.count_if(F.col("sentiment") == full).alias(short)
        for full, short in (("positive", "pos"), ("negative", "neg"), ("neutral", "neu"))
    ]


def over_all(column: str) -> Column:
    """Total over an aggregated frame; only used where a label set bounds its rows."""
    return F.sum(column).over(Window.partitionBy())


def target_overview(comments: DataFrame, platform: str | None = None) -> DataFrame:
    """A1: scorecard per target; the recommendation rate counts rated comments only."""
    rows = comments.filter(F.col("platform") == platform) if platform else comments
    totals = rows.groupBy("target_id").agg(
        F.count("*").alias("total"),
        F.count("analyzed_at").alias("analyzed"),
        F.sum("rating").alias("_liked"),
        F.count("rating").alias("_rated"),
        F.round(F.avg("sentiment_score"), 3).alias("avg_score"),
        *tallies(),
        F.max("extra_meta").alias("_meta"),
    )
    app = F.when(F.contains("target_id", F.lit(":")), F.regexp_replace("target_id", "^[^:]*:", "")).otherwise(F.col("target_id"))
    return totals.select(
        "target_id", v.meta_name(F.col("_meta"), F.col("target_id")).alias("name"), app.alias("appid"),
        "total", "analyzed", v.percent(F.col("_liked"), F.col("_rated")).alias("recommend_rate"),
        "avg_score", "pos", "neg", "neu",
    ).orderBy(F.desc("total"), "target_id")


def sentiment_share(comments: DataFrame, targets: list[str] | None = None) -> DataFrame:
    """A2"""
    rows = comments.filter(F.col("target_id").isin(targets)) if targets is not None else comments
    n = F.col("pos") + F.col("neg") + F.col("neu")
    share = lambda c: v.percent(F.col(c), F.col("n"), 1, 0.0)
    return (
        rows.groupBy("target_id").agg(*tallies()).withColumn("n", n)
        .select("target_id", share("pos").alias("positive"), share("neu").alias("neutral"), share("neg").alias("negative"), "n")
    )


def sentiment_distribution(comments: DataFrame) -> DataFrame:
    """A7"""
    counts = comments.filter(F.col("sentiment").isNotNull()).groupBy("sentiment").agg(F.count("*").alias("n"))
    return counts.withColumn("ratio", v.percent(F.col("n"), over_all("n")))


def topic_distribution(comments: DataFrame, top: int = 10) -> DataFrame:
    """A8"""
    return comments.filter(F.col("topic").isNotNull()).groupBy("topic").agg(F.count("*").alias("n")).orderBy(
        F.desc("n"), "topic").limit(top)


def single_target_kpis(comments: DataFrame) -> DataFrame:
    """Shares over all rows."""
    return comments.agg(F.count("*").alias("n"), F.avg("sentiment_score").alias("_s"), *tallies()).select(
        "n", v.percent(F.col("pos"), F.col("n")).alias("positive_pct"),
        v.percent(F.col("neg"), F.col("n")).alias("negative_pct"), F.round("_s", 2).alias("avg_score"),
    )


def compare_kpis(comments: DataFrame) -> DataFrame:
    """A10: shares over rows that carry a sentiment."""
    n = F.col("pos") + F.col("neg") + F.col("neu")
    return target_overview(comments).select(
        "name", "target_id", "total", "recommend_rate", F.round("avg_score", 2).alias("avg_score"),
        v.percent(F.col("pos"), n, 1, 0.0).alias("positive_pct"), v.percent(F.col("neg"), n, 1, 0.0).alias("negative_pct"),
    )


def score_histogram(comments: DataFrame, bins: int = 30) -> DataFrame:
    """Equal bins on [-1, 1], the top edge in the last bin."""
    place = F.least(F.lit(bins - 1), F.floor((F.col("sentiment_score") + 1) * bins / 2)).cast("int")
    return comments.filter(F.col("sentiment_score").isNotNull()).groupBy(place.alias("bin"), "sentiment").agg(
        F.count("*").alias("n"))


def rating_card(comments: DataFrame) -> DataFrame:
    """Share of positive ratings over *all* comments of the target, in words."""
    pct = v.percent(F.coalesce("_liked", F.lit(0)), F.col("local_count"), 1, 0.0)
    return (
        comments.groupBy("target_id").agg(F.count("*").alias("local_count"), F.sum("rating").alias("_liked"))
        .withColumn("local_recommend_pct", pct).withColumn("local_rating", v.rating_tier(F.col("local_recommend_pct")))
        .drop("_liked")
    )


def games_list(comments: DataFrame) -> DataFrame:
    """A16"""
    return comments.groupBy("target_id").agg(F.count("*").alias("n"), F.min("extra_meta").alias("_meta")).select(
        "target_id", v.meta_name(F.col("_meta"), F.col("target_id")).alias("name"), "n").orderBy(F.desc("n"), "target_id")


def report_kpis(units: DataFrame) -> DataFrame:
    """Works at either grain (comments, or opinions with their ``target_id``)."""
    return units.agg(
        F.count("*").alias("total"), F.countDistinct("target_id").alias("games"),
        F.count_if(F.col("sentiment") == "positive").alias("positive"),
    ).withColumn("positive_rate", v.percent(F.col("positive"), F.col("total"), 1, 0.0))


def top_games(units: DataFrame, n: int = 5) -> DataFrame:
    """The largest games with their positive rate."""
    return (
        units.groupBy("target_id")
        .agg(F.count("*").alias("n"), F.count_if(F.col("sentiment") == "positive").alias("positive"))
        .orderBy(F.desc("n"), "target_id").limit(n)
        .withColumn("positive_rate", v.percent(F.col("positive"), F.col("n"), 1, 0.0))
    )


def top_game_ids(units: DataFrame, n: int = 5) -> list[str]:
    return [r["target_id"] for r in top_games(units, n).select("target_id").collect()]


def store_stats(comments: DataFrame, opinions: DataFrame) -> DataFrame:
    """Totals as one row."""
    zero = F.lit(0).cast("bigint")
    c = comments.agg(F.count("*").alias("comments"), F.count("analyzed_at").alias("analyzed")).withColumn("opinions", zero)
    o = opinions.agg(F.count("*").alias("opinions")).select(zero.alias("comments"), zero.alias("analyzed"), "opinions")
    return c.unionByName(o).agg(*(F.sum(x).alias(x) for x in c.columns)).select(
        "comments", "analyzed", "opinions", v.percent(F.col("analyzed"), F.col("comments")).alias("analyzed_pct"),
        F.when(F.col("analyzed") > 0, F.round(F.col("opinions") / F.col("analyzed"), 1)).alias("opinions_per_comment"),
    )


def path_sentiment_top(opinions: DataFrame, n: int = 10) -> DataFrame:
    """A26"""
    return opinions.groupBy("full_path", "sentiment").agg(F.count("*").alias("n")).orderBy(
        F.desc("n"), "full_path", "sentiment").limit(n)


def small_sample_flag(df: DataFrame, count: str, below: int) -> DataFrame:
    """A37"""
    return df.withColumn("small_sample", F.col(count) < below)


def plain_counts(df: DataFrame, *keys: str) -> DataFrame:
    """A42"""
    return df.groupBy(*keys).agg(F.count("*").alias("n"))
