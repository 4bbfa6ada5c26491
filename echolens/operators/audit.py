"""Audits of what was landed, refreshed, labelled or purged."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as fixed, text as tx, values as v
from ..functions.paths import segment
from .filters import purge_rules, within
from .lexicon import Lexicon
from .matching import with_label
from .metrics import over_all
from .vectors import foreign


def ingest_by_day(comments: DataFrame, column: str = "posted_at") -> DataFrame:
    """Rows and time range per day."""
    return comments.groupBy(F.to_date(column).alias("day")).agg(
        F.count("*").alias("n"), F.min(column).alias("first"), F.max(column).alias("last"))


def null_states(comments: DataFrame) -> DataFrame:
    """Likes filled or not, and refresh stamps, over the window given."""
    return comments.agg(
        F.count("*").alias("n"), F.count_if(F.col("likes").isNull()).alias("null_likes"),
        F.count("likes").alias("has_likes"), F.count_if(F.col("analyzed_at").isNull()).alias("not_analyzed"),
    )


def fallback_share(opinions: DataFrame, meta_l1: str = fixed.META_L1) -> DataFrame:
    """Opinions by first level with their share, meta bucket marked."""
    counts = opinions.groupBy(segment(F.col("full_path"), "L1").alias("l1")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", v.percent(F.col("n"), over_all("n"))).withColumn("is_meta", F.col("l1") == meta_l1)


def fallback_composition(opinions: DataFrame, meta_l1: str = fixed.META_L1) -> DataFrame:
    """Paths inside the meta bucket."""
    return opinions.filter(segment(F.col("full_path"), "L1") == meta_l1).groupBy("full_path").agg(F.count("*").alias("n"))


def topic_share(comments: DataFrame) -> DataFrame:
    """A27 at comment grain: share over all comments, those without a topic too."""
    counts = comments.groupBy("topic").agg(F.count("*").alias("n"))
    return counts.withColumn("share", v.percent(F.col("n"), over_all("n")))


def ends_with_label(opinions: DataFrame, labels: list[str]) -> DataFrame:
    """Opinions per chosen third-level label."""
    counts = [F.count_if(F.endswith("full_path", F.lit(x))).alias("n") for x in labels]
    packed = F.array(*[F.struct(F.lit(x).alias("l3"), c) for x, c in zip(labels, counts)])
    return opinions.agg(packed.alias("cells")).select(F.inline("cells"))


def fallback_opinions(opinions: DataFrame, fallback_path: str, comments: DataFrame | None = None, platform: str | None = None) -> DataFrame:
    """Opinions under the fallback path; with a platform those of its comments only."""
    rows = opinions.filter(F.startswith("full_path", F.lit(fallback_path)))
    if platform is None:
        return rows
    ids = comments.filter(F.col("platform") == platform).select(F.col("id").alias("comment_id")).distinct()
    return rows.join(ids, "comment_id", "left_semi")


def dictionary_gaps(
    opinions: DataFrame, lex: Lexicon, fallback_path: str, min_length: int = 6, min_count: int = 1,
    comments: DataFrame | None = None, platform: str | None = None,
) -> DataFrame:
    """Fallback quotes with their count, sorted into rescued, overall, noise and candidate.

    Quotes are counted before matching, so each is matched once.
    """
    rows = fallback_opinions(opinions, fallback_path, comments, platform)
    counts = rows.groupBy("quote").agg(F.count("*").alias("n")).filter(F.length("quote") >= min_length)
    words = [*lex.overall_words, *lex.recommend_words]
    general = [lex.overall_label, lex.recommend_label]
    kind = (
        F.when(F.col("l3").isNotNull() & ~F.col("l3").isin(general), "rescued")
        .when(tx.is_overall(F.col("quote"), words), "overall")
        .when(tx.is_noise(F.col("quote")), "noise")
        .when(F.col("n") >= min_count, "candidate")
        .otherwise("rare")
    )
    return with_label(counts, "quote", lex).withColumn("kind", kind).withColumn("chars", F.length("quote"))


def gap_candidates(gaps: DataFrame, limit: int = 200) -> DataFrame:
    return gaps.filter(F.col("kind") == "candidate").orderBy(F.desc("n"), F.desc("chars"), "quote").limit(limit)


def gap_summary(gaps: DataFrame) -> DataFrame:
    return gaps.groupBy("kind").agg(F.count("*").alias("phrases"), F.sum("n").alias("opinions"))


def gap_totals(opinions: DataFrame, gaps: DataFrame, fallback_path: str, comments: DataFrame | None = None, platform: str | None = None) -> DataFrame:
    """The summary with one more row, ``total``: all fallback opinions, those too short to be mined too."""
    every = fallback_opinions(opinions, fallback_path, comments, platform)
    total = every.agg(F.count_distinct("quote").alias("phrases"), F.count("*").alias("opinions"))
    return gap_summary(gaps).unionByName(total.select(F.lit("total").alias("kind"), "phrases", "opinions"))


def refresh_coverage(comments: DataFrame, now: datetime) -> DataFrame:
    """A31"""
    age = lambda ts: F.date_diff(F.lit(now).cast("timestamp_ntz"), ts)
    return comments.groupBy("target_id").agg(
        F.count_if(F.col("likes").isNull()).alias("null_likes"), F.count("likes").alias("filled_likes"),
        F.min("posted_at").alias("first"), F.max("posted_at").alias("last"),
        age(F.min("posted_at")).alias("oldest_days"), age(F.max("posted_at")).alias("newest_days"),
        F.min("likes").alias("min_likes"), F.max("likes").alias("max_likes"), F.round(F.avg("likes"), 2).alias("avg_likes"),
    )


def run_summary(run_log: DataFrame) -> DataFrame:
    """A32"""
    return run_log.agg(
        F.count_if("ok").alias("ok_targets"), F.count_if(~F.col("ok")).alias("failed_targets"),
        F.sum("fetched").alias("fetched"), F.sum("analyzed").alias("analyzed"),
    )


def annotation_distribution(comments: DataFrame, opinions: DataFrame, top_paths: int = 20) -> DataFrame:
    """Long form over topic, sentiment, top paths and unmatched comments."""
    done = comments.filter(F.col("analyzed_at").isNotNull())
    entry = lambda kind, column: F.struct(F.lit(kind).alias("kind"), F.coalesce(column, F.lit("(none)")).alias("label"))
    labels = done.select(F.inline(F.array(entry("topic", "topic"), entry("sentiment", "sentiment"))))
    counts = labels.groupBy("kind", "label").agg(F.count("*").alias("n"))
    paths = opinions.select(F.lit("path").alias("kind"), F.col("full_path").alias("label")).groupBy("kind", "label").agg(
        F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(top_paths)
    with_opinion = opinions.select(F.col("comment_id").alias("id")).distinct()
    unmatched = done.join(with_opinion, "id", "left_anti").agg(F.count("*").alias("n")).select(
        F.lit("unmatched").alias("kind"), F.lit("comments").alias("label"), "n")
    return counts.unionByName(paths).unionByName(unmatched)


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """A35"""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def purge_report(comments: DataFrame, cutoff: datetime, language: str) -> DataFrame:
    """Rows removed by each rule (age first) and rows left."""
    old, foreign = purge_rules(cutoff, language)
    return comments.agg(
        F.count_if(old).alias("removed_old"), F.count_if(~old & foreign).alias("removed_language"),
        F.count_if(~old & ~foreign).alias("remaining"),
    )


def coverage(comments: DataFrame, language: str, after: datetime, before: datetime) -> DataFrame:
    """Per-target check of one collection window."""
    return comments.groupBy("target_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("language") != language).alias("other_language"),
        F.to_date(F.min("posted_at")).alias("first_day"), F.to_date(F.max("posted_at")).alias("last_day"),
        F.count_if(within(F.col("posted_at"), after, before)).alias("in_window"),
        F.count_if(F.col("rating") == 1).alias("liked"), F.count_if(F.col("rating") == 0).alias("disliked"),
        F.count_if(F.col("rating").isNull()).alias("unrated"),
    )


def hourly_volume(comments: DataFrame, target_id: str) -> DataFrame:
    """A40"""
    hour = F.date_trunc("hour", F.col("posted_at").cast("timestamp")).cast("timestamp_ntz")
    return comments.filter(F.col("target_id") == target_id).groupBy(hour.alias("hour")).agg(F.count("*").alias("n"))


def window_volume(comments: DataFrame, targets: DataFrame, after: datetime, before: datetime) -> DataFrame:
    """Expected rows per configured target; a target without any shows zero."""
    inside = comments.filter(within(F.col("posted_at"), after, before)).groupBy("target_id").agg(F.count("*").alias("n"))
    return targets.select("target_id").join(inside, "target_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def rating_split(comments: DataFrame) -> DataFrame:
    return comments.groupBy("target_id", "rating").agg(F.count("*").alias("n"))


def single_space(vectors: DataFrame, current: str, dim: int | None = None) -> None:
    """Refuse to mix vector spaces."""
    other = foreign(vectors, current, dim)
    if other:
        raise ValueError(f"vectors of another model present: {other}; expected only {current!r}")


def label_coverage(used: DataFrame, known: DataFrame, column: str = "l3") -> DataFrame:
    """Labels missing from the dictionary and labels it has in excess."""
    a, b = used.select(column).distinct(), known.select(column).distinct()
    return a.subtract(b).select(column, F.lit("missing").alias("state")).unionByName(
        b.subtract(a).select(column, F.lit("extra").alias("state")))
