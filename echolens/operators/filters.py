"""Projections and predicates."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx, values as v
from ..functions.paths import path_dim
from .dictionary import KeyIndex
from .lexicon import MAX_LEAVES

PUBLIC = [
    "id", "platform", "source_id", "target_id", "content", "author", "rating", "language", "likes", "replies",
    "sentiment", "sentiment_score", "sentiment_confidence", "topic",
]


def parsed_list(column: str) -> Column:
    return F.coalesce(F.from_json(F.col(column), "array<string>"), F.array().cast("array<string>"))


def iso(column: str) -> Column:
    return F.date_format(F.col(column), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def public_projection(comments: DataFrame) -> DataFrame:
    """the fields shown outside, ISO times, ``sub_topics`` as a list."""
    kept = [c for c in PUBLIC if c in comments.columns]
    return comments.select(*kept, parsed_list("sub_topics").alias("sub_topics"), iso("posted_at").alias("posted_at"))


def summary_frame(rows: DataFrame, column: str = "posted_at") -> DataFrame:
    """parse a text time; a bad value gives NULL."""
    return rows.withColumn(column, F.col(column).try_cast("timestamp_ntz"))


def lineage_projection(comments: DataFrame) -> DataFrame:
    """A_ collected, B_ derived, C_ annotated."""
    groups = {
        "A": ["source_id", "content", "author_id", "rating", "language", "likes", "replies", "posted_at"],
        "B": ["id", "platform", "target_id", "extra_meta", "extra_json", "fetched_at"],
        "C": ["sentiment", "sentiment_score", "sentiment_confidence", "topic", "sub_topics", "analyzed_at"],
    }
    alias = {"extra_meta": "target_meta"}
    times = {"posted_at", "fetched_at", "analyzed_at"}
    return comments.select(
        *(
            (iso(c) if c in times else F.col(c)).alias(f"{prefix}_{alias.get(c, c)}")
            for prefix, names in groups.items() for c in names if c in comments.columns
        )
    )


def derived_target(platform: Column, key: Column, extra_json: Column) -> Column:
    """``platform:key``; a store app id or a video id in the extras takes precedence."""
    field_of = lambda name: F.nullif(F.get_json_object(extra_json, f"$.{name}"), F.lit(""))
    app, video = field_of("appid"), field_of("aid")
    return (
        F.when((platform == "steam") & app.isNotNull(), F.concat(F.lit("steam:"), app))
        .when((platform == "bilibili") & video.isNotNull(), F.concat(F.lit("bilibili:video:"), video))
        .otherwise(F.concat(platform, F.lit(":"), F.coalesce(key, F.lit(""))))
    )


def within(ts: Column, after: Column | datetime | None, before: Column | datetime | None) -> Column:
    """``[after, before)``; a missing time fails a lower bound and passes an upper bound."""
    keep = F.lit(True)
    if after is not None:
        low = after if isinstance(after, Column) else F.lit(after).cast("timestamp_ntz")
        keep = keep & F.coalesce(ts >= low, low.isNull())
    if before is not None:
        high = before if isinstance(before, Column) else F.lit(before).cast("timestamp_ntz")
        keep = keep & F.coalesce(ts < high, F.lit(True))
    return keep


@dataclass
class ReportFilter:
    """conditions of a report; an empty set means no condition."""

    start: date | None = None
    end: date | None = None
    games: set[str] = field(default_factory=set)
    votes: set[int] = field(default_factory=set)
    sentiments: set[str] = field(default_factory=set)
    tags: set[str] = field(default_factory=set)

    def condition(self, paths: Column | None = None) -> Column:
        keep = F.lit(True)
        # Bounds stay on the raw column, so they reach the scan.
        if self.start:
            keep = keep & (F.col("posted_at") >= F.lit(self.start).cast("timestamp_ntz"))
        if self.end:
            keep = keep & (F.col("posted_at") < F.date_add(F.lit(self.end), 1).cast("timestamp_ntz"))
        for name, chosen in (("target_id", self.games), ("rating", self.votes), ("sentiment", self.sentiments)):
            if chosen:
                keep = keep & F.col(name).isin(*sorted(chosen))
        if self.tags and paths is not None:
            keep = keep & tag_hit(paths, self.tags)
        return keep


def tag_hit(paths: Column, tags: set[str]) -> Column:
    """a path equals a tag, or one is a prefix of the other at a ``/``."""
    chosen = F.array(*[F.lit(t) for t in sorted(tags)])
    slash = F.lit("/")
    meets = lambda p, t: (p == t) | F.startswith(p, F.concat(t, slash)) | F.startswith(t, F.concat(p, slash))
    return F.exists(paths, lambda p: F.exists(chosen, lambda t: meets(p, t)))


def path_hit(path: Column, tags: set[str]) -> Column:
    """F7 for one path column: equalities and prefixes only, which reach the scan."""
    above = {t[:i] for t in tags for i, c in enumerate(t) if c == "/"}
    return reduce(lambda a, b: a | b, [F.startswith(path, F.lit(f"{t}/")) for t in sorted(tags)], path.isin(*sorted(tags | above)))


def sub_topic_paths(tax: DataFrame) -> Column:
    """Sub-topics of a comment as ``L1/L2`` where the taxonomy knows them."""
    pairs = tax.select("l1", "l2").distinct().limit(MAX_LEAVES + 1).collect()
    if len(pairs) > MAX_LEAVES:
        raise ValueError("the taxonomy is sent to every task; split it or raise the limits knowingly")
    index = KeyIndex({r["l2"]: r["l1"] for r in pairs})
    return F.transform(parsed_list("sub_topics"), lambda s: F.coalesce(F.concat(index.value(s), F.lit("/"), s), s))


def tagged_voices(voices: DataFrame, opinions: DataFrame, tax: DataFrame, tags: set[str]) -> DataFrame:
    """comments hit by their topic, their sub-topics or the path of any opinion.

    No comment's paths are gathered: opinions are cut to those that hit, by a predicate pushed to their scan, and only their
    comment ids are joined.
    """
    ids = opinions.filter(path_hit(F.col("full_path"), tags)).select(F.col("comment_id").alias("id")).distinct().withColumn("_hit", F.lit(True))
    own = F.coalesce(path_hit(F.col("topic"), tags), F.lit(False)) | F.coalesce(tag_hit(sub_topic_paths(tax), tags), F.lit(False))
    return voices.join(ids, "id", "left").filter(F.col("_hit").isNotNull() | own).drop("_hit")


def split_ids(raw: str) -> list[str]:
    """Ids typed by a user, separated by blanks, commas or semicolons of either width."""
    for mark in ",;，；、":
        raw = raw.replace(mark, " ")
    return list(dict.fromkeys(raw.split()))


def id_kind(voices: DataFrame, opinions: DataFrame, ids: list[str]) -> str:
    """F8: what the typed ids name: ``voice``, ``opinion``, ``mixed`` or ``none``."""
    voice = not voices.filter(F.col("source_id").isin(ids)).limit(1).isEmpty()
    opinion = not opinions.filter(F.col("id").cast("string").isin(ids)).limit(1).isEmpty()
    return "mixed" if voice and opinion else "voice" if voice else "opinion" if opinion else "none"


def by_ids(voices: DataFrame, opinions: DataFrame, raw: str, grain: str = "voice") -> DataFrame:
    """F8: rows of the grain that the typed ids select."""
    ids = split_ids(raw)
    rows = voices if grain == "voice" else opinions
    if not ids:
        return rows
    kind = id_kind(voices, opinions, ids)
    if kind in ("mixed", "none"):
        return rows.filter(F.lit(False))
    if kind == "voice":
        chosen = voices.filter(F.col("source_id").isin(ids))
        return chosen if grain == "voice" else opinions.join(
            chosen.select(F.col("id").alias("comment_id")), "comment_id", "left_semi")
    chosen = opinions.filter(F.col("id").cast("string").isin(ids))
    return chosen if grain == "opinion" else voices.join(
        chosen.select(F.col("comment_id").alias("id")).distinct(), "id", "left_semi")


def newest_of_target(comments: DataFrame, target_id: str, n: int = 500) -> DataFrame:
    """F9"""
    return comments.filter(F.col("target_id") == target_id).orderBy(F.desc("posted_at"), "id").limit(n)


def unanalyzed(comments: DataFrame, n: int = 100, platform: str | None = None) -> DataFrame:
    """work queue, lowest id first."""
    rows = comments.filter(F.col("analyzed_at").isNull())
    if platform:
        rows = rows.filter(F.col("platform") == platform)
    return rows.orderBy("id").limit(n)


def analyzed_feed(comments: DataFrame, n: int = 1000, platform: str | None = None) -> DataFrame:
    """F11"""
    rows = comments.filter(F.col("analyzed_at").isNotNull())
    if platform:
        rows = rows.filter(F.col("platform") == platform)
    return rows.orderBy(F.desc("analyzed_at"), "id").limit(n)


def refresh_due(comments: DataFrame, now: datetime, min_age_days: int = 7) -> DataFrame:
    """old enough and a refresh stamp missing."""
    cutoff = F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {int(min_age_days)} days")
    stamps = F.col("likes_refreshed_at").isNull() | F.col("developer_response_refreshed_at").isNull()
    return comments.filter((F.col("posted_at") < cutoff) & stamps)


def carries_label(label: str) -> Column:
    return (F.col("topic") == label) | F.array_contains(parsed_list("sub_topics"), label)


def with_topic_or_sub(comments: DataFrame, label: str) -> DataFrame:
    """F13"""
    return comments.filter(F.col("analyzed_at").isNotNull() & carries_label(label))


def labelled_dump(
    comments: DataFrame, label: str | None = None, target_id: str | None = None, sentiment: str | None = None, id: int | None = None, limit: int = 10,
) -> DataFrame:
    """analyzed comments by label, target, sentiment and id, each if given; the last analyzed first."""
    rows = comments.filter(F.col("analyzed_at").isNotNull())
    for name, value in (("id", id), ("target_id", target_id), ("sentiment", sentiment)):
        if value is not None and value != "":
            rows = rows.filter(F.col(name) == value)
    if label:
        rows = rows.filter(carries_label(label))
    return rows.orderBy(F.desc("analyzed_at"), "id").limit(limit)


def purge_rules(cutoff: datetime, language: str) -> tuple[Column, Column]:
    """too old; wrong language (an unknown language stays)."""
    old = F.coalesce(F.col("posted_at") <= F.lit(cutoff).cast("timestamp_ntz"), F.lit(False))
    foreign = F.coalesce(F.col("language") != language, F.lit(False))
    return old, foreign


def retained(comments: DataFrame, cutoff: datetime, language: str, target_id: str | None = None) -> DataFrame:
    old, foreign = purge_rules(cutoff, language)
    drop = old | foreign
    return comments.filter(~(drop & (F.col("target_id") == target_id)) if target_id else ~drop)


def label_sets(tax: DataFrame) -> tuple[list[str], list[str]]:
    """Valid first- and second-level labels: the taxonomy is configuration, a few dozen names."""
    rows = tax.select("l1", "l2").distinct().collect()
    return sorted({r["l1"] for r in rows}), sorted({r["l2"] for r in rows})


def outliers(comments: DataFrame, tax: DataFrame, only_sub: bool = False) -> DataFrame:
    """analyzed comments whose topic or any sub-topic is not in the taxonomy."""
    l1, l2 = label_sets(tax)
    bad_subs = F.filter(parsed_list("sub_topics"), lambda s: ~s.isin(l2))
    bad_topic = F.when(~F.col("topic").isin(l1), F.col("topic"))
    flagged = comments.filter(F.col("analyzed_at").isNotNull()).withColumns({"bad_topic": bad_topic, "bad_subs": bad_subs})
    has_sub = F.size("bad_subs") > 0
    return flagged.filter(has_sub if only_sub else has_sub | F.col("bad_topic").isNotNull())


def outlier_counts(comments: DataFrame, tax: DataFrame) -> DataFrame:
    found = outliers(comments, tax)
    topics = found.filter(F.col("bad_topic").isNotNull()).select(F.lit("topic").alias("kind"), F.col("bad_topic").alias("label"))
    subs = found.select(F.lit("sub_topic").alias("kind"), F.explode("bad_subs").alias("label"))
    return topics.unionByName(subs).groupBy("kind", "label").agg(F.count("*").alias("n"))


def typical_samples(comments: DataFrame, sentiments: list[str], n: int = 10, chars: int = 300) -> DataFrame:
    """F16"""
    return (
        comments.filter(F.col("sentiment").isin(sentiments))
        .orderBy(F.desc_nulls_last("sentiment_confidence"), "id").limit(n)
        .select("id", "sentiment", "sentiment_score", "sentiment_confidence", tx.cut(F.col("content"), chars).alias("snippet"))
    )


def phrase_class(phrase: Column, words: list[str]) -> Column:
    """F17"""
    return F.when(tx.is_overall(phrase, words), "overall").when(tx.is_noise(phrase), "noise").otherwise("other")


def whitelisted(comments: DataFrame, tax: DataFrame) -> DataFrame:
    """unknown topic becomes NULL, unknown sub-topics are dropped in place."""
    l1, l2 = label_sets(tax)
    return comments.withColumns({
        "topic": F.when(F.col("topic").isin(l1), F.col("topic")),
        "sub_topics": F.filter(parsed_list("sub_topics"), lambda s: s.isin(l2)),
    })


def answered(comments: DataFrame, n: int = 5) -> DataFrame:
    """comments with a developer reply."""
    reply = F.get_json_object("extra_json", "$.developer_response")
    return comments.filter(reply.isNotNull() & (reply != "")).orderBy("id").limit(n).select(
        "id", F.substring("content", 1, 50).alias("content"), F.substring(reply, 1, 60).alias("reply"),
        F.get_json_object("extra_json", "$.timestamp_dev_responded").alias("replied_at"),
    )


def top_json_values(comments: DataFrame, name: str, n: int = 5) -> DataFrame:
    """most high-ranking values of a JSON field, with their counts."""
    value = F.get_json_object("extra_json", f"$.{name}")
    return comments.filter(value.isNotNull()).groupBy(value.alias("value")).agg(F.count("*").alias("n")).orderBy(
        F.desc("value")).limit(n)


def taxonomy_search(leaves: DataFrame, query: str) -> DataFrame:
    """leaves under or above a name that holds the query, whatever the case."""
    q = F.lit(query.lower())
    return leaves.filter(
        F.contains(F.lower("l1"), q) | F.contains(F.lower("l2"), q) | F.contains(F.lower("l3"), q)
    )


def all_paths(tax: DataFrame) -> DataFrame:
    return path_dim(tax)
