"""Merges: each takes the old table and a batch and gives the new table.

Callers write the result to a new folder and switch over (``sources.snapshots`` does both); nothing is overwritten while it is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx, values as v
from ..functions.paths import segment
from ..session import settled
from ..sources.snapshots import Snapshots
from .filters import derived_target
from .lexicon import Lexicon
from .matching import labelled, with_path
from .ordering import first_per_group

KEY = ["platform", "source_id"]
RAW_FIELDS = ["content", "author", "author_id", "rating", "language", "posted_at", "extra_json"]
ANALYSIS = ["sentiment", "sentiment_score", "sentiment_confidence", "topic", "sub_topics", "analyzed_at"]


def first_seen(rows: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """Keep the first arrival of each key."""
    return first_per_group(rows, keys, [F.asc(arrival)])


def last_seen(rows: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    return first_per_group(rows, keys, [F.desc(arrival)])


def upsert_comments(current: DataFrame, batch: DataFrame, now: Column, arrival: str = "arrival", meta: Column | None = None) -> DataFrame:
    """M1: merge on (platform, source_id).

    Raw fields are replaced and analysis fields kept. Likes and replies are replaced only by a number,
    which also sets the refresh stamp; the reply stamp is set when the extras carry the reply key.
    The batch is reduced to the last arrival of each key first, so both sides are unique.
    """
    new = last_seen(batch, KEY, arrival).drop(arrival)
    new = new.withColumn("_meta", meta if meta is not None else F.lit(None).cast("string"))
    # Text search for the key: a present key with a null value counts, which get_json_object cannot tell.
    new = new.withColumn("_replied", F.coalesce(F.array_contains(F.json_object_keys("extra_json"), "developer_response"), F.lit(False)))
    n = new.select(*KEY, *(F.col(c).alias(f"n_{c}") for c in new.columns if c not in KEY), F.lit(True).alias("_new"))
    j = current.withColumn("_old", F.lit(True)).join(n, KEY, "full")
    old, fresh = F.col("_old").isNotNull(), F.col("_new").isNotNull()
    take = lambda c: F.when(fresh, F.col(f"n_{c}")).otherwise(F.col(c))
    counted = fresh & (F.col("n_likes").isNotNull() | (old & F.col("n_replies").isNotNull()))
    columns = {c: take(c) for c in RAW_FIELDS}
    columns |= {
        "id": F.coalesce("id", v.comment_key(F.col("platform"), F.col("source_id"))),
        "target_id": F.coalesce("target_id", derived_target(F.col("platform"), F.col("n_target_key"), F.col("n_extra_json"))),
        "likes": F.coalesce("n_likes", "likes"),
        "replies": F.coalesce("n_replies", "replies"),
        "likes_refreshed_at": F.when(counted, now).otherwise(F.col("likes_refreshed_at")),
        "developer_response_refreshed_at": F.when(fresh & F.col("n__replied"), now).otherwise(F.col("developer_response_refreshed_at")),
        "fetched_at": F.when(fresh, now).otherwise(F.col("fetched_at")),
        "extra_meta": F.coalesce("n__meta", "extra_meta"),
    }
    return j.select(*[columns[c].alias(c) if c in columns else F.col(c) for c in current.columns])


def replace_analysis(
    comments: DataFrame, opinions: DataFrame, labels: DataFrame, new_opinions: DataFrame, now: Column,
) -> tuple[DataFrame, DataFrame]:
    """M2: set the labels of the given comments and swap their opinions.

    ``labels``: id, sentiment, sentiment_score, sentiment_confidence, topic, sub_topics;
    ``new_opinions``: comment_id, pos, full_path, sentiment, sentiment_confidence, quote, quote_start, quote_end.
    Labels of unknown comments are ignored; opinions without path or quote are skipped.
    """
    known = settled(labels.join(comments.select("id"), "id", "left_semi"))
    side = known.select("id", *(F.col(c).alias(f"n_{c}") for c in ANALYSIS[:-1]), F.lit(True).alias("_hit"))
    hit = F.col("_hit").isNotNull()
    joined = comments.join(side, "id", "left")
    updated = {c: F.when(hit, F.col(f"n_{c}")).otherwise(F.col(c)) for c in ANALYSIS[:-1]}
    updated["analyzed_at"] = F.when(hit, now).otherwise(F.col("analyzed_at"))
    new_comments = joined.select(*[updated[c].alias(c) if c in updated else F.col(c) for c in comments.columns])

    touched = known.select(F.col("id").alias("comment_id"))
    path, quote = tx.strip(F.col("full_path")), tx.strip(F.col("quote"))
    clean = (
        new_opinions.withColumns({"full_path": path, "quote": quote})
        .filter((F.col("full_path") != "") & (F.col("quote") != ""))
        .join(touched, "comment_id", "left_semi")
        .join(comments.select(F.col("id").alias("comment_id"), "content"), "comment_id")
    )
    spans = tx.with_quote_span(clean, F.col("quote"), F.col("content"), F.col("quote_start"), F.col("quote_end"))
    fresh = spans.select(
        F.xxhash64("comment_id", "pos").alias("id"), "comment_id", "full_path",
        v.sentiment_label(F.coalesce("sentiment", F.lit("neutral"))).alias("sentiment"),
        v.stored_confidence(F.col("sentiment_confidence")).alias("sentiment_confidence"), "quote",
        "quote_start", "quote_end", now.alias("created_at"),
    )
    kept = opinions.join(touched, "comment_id", "left_anti").select(*opinions.columns)
    return new_comments, kept.unionByName(fresh.select(*opinions.columns))


def upsert_vectors(current: DataFrame, batch: DataFrame) -> DataFrame:
    """M3"""
    return current.join(batch.select("comment_id"), "comment_id", "left_anti").unionByName(batch)


def replace_vectors(comments: DataFrame, batch: DataFrame) -> DataFrame:
    """M4: the new vectors, refused unless they cover every comment with one model."""
    if not comments.select(F.col("id").alias("comment_id")).join(batch, "comment_id", "left_anti").isEmpty():
        raise ValueError("a full replacement needs a vector for every comment")
    if len(batch.select("model").distinct().limit(2).collect()) > 1:
        raise ValueError("a full replacement holds one model only")
    return batch


def replace_all_vectors(table: Snapshots, comments: DataFrame, batch: DataFrame) -> int:
    """M4 on a versioned table: the new vectors become visible at once and whole, or the old version stays."""
    return table.replace(replace_vectors(comments, batch))


def insert_danmaku(current: DataFrame, batch: DataFrame, arrival: str = "id") -> DataFrame:
    """M5: insert what is not there yet; blank content dropped, a missing user hash is the empty string."""
    clean = batch.withColumns({
        "content": tx.strip(F.col("content")), "user_hash": F.coalesce("user_hash", F.lit(""))
    }).filter(F.col("content") != "")
    keys = ["video_id", "progress", "content", "user_hash"]
    unique = first_seen(clean, keys, arrival)
    old = current.select(*(F.col(c).alias(f"_{c}") for c in keys)).distinct()  # the stored key is not unique
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]
    condition = same[0] & same[1] & same[2] & same[3]
    return unique.join(old, condition, "left_anti")


def migrate_topics(comments: DataFrame, l1_map: DataFrame) -> DataFrame:
    """M6: old to new first-level label; adds ``changed``. ``l1_map``: (old, new)."""
    m = l1_map.select(F.col("old").alias("_old"), F.col("new").alias("_new"))
    return comments.join(m, F.col("topic") == F.col("_old"), "left").withColumns(
        {"changed": F.col("_new").isNotNull(), "topic": F.coalesce("_new", "topic")}).drop("_old", "_new")


def migrate_paths(opinions: DataFrame, l3_map: DataFrame, overrides: DataFrame, lex: Lexicon) -> DataFrame:
    """Change table of path migration: old path, new path, state."""
    o = overrides.select(F.col("old").alias("_old"), F.col("new").alias("_over"))
    m = l3_map.select(F.col("old").alias("_l3_old"), F.col("new").alias("_l3_new"))
    last = F.element_at(F.split("full_path", "/"), -1)
    rows = opinions.withColumnRenamed("full_path", "old_path").withColumn("full_path", F.col("old_path"))
    rows = rows.join(o, F.col("full_path") == F.col("_old"), "left").withColumn(
        "_last", F.when(F.size(F.split("full_path", "/")) >= 3, last)
    ).join(m, F.col("_last") == F.col("_l3_old"), "left").drop("full_path")
    placed = with_path(rows, lex, "_l3_new", "_mapped").withColumn("new_path", F.coalesce("_over", "_mapped"))
    state = F.when(F.col("new_path").isNull(), "unmapped").when(F.col("new_path") == F.col("old_path"), "same").otherwise("changed")
    return placed.withColumn("state", state).withColumn("full_path", F.coalesce("new_path", "old_path")).select(
        *opinions.columns, "old_path", "state")


def rematch(opinions: DataFrame, lex: Lexicon) -> DataFrame:
    """Change table of re-matching; only meta to specific is written back (``write_back``)."""
    rows = opinions.withColumn("_q", tx.strip(F.col("quote"))).filter(F.coalesce("_q", F.lit("")) != "")
    rows = rows.withColumnRenamed("full_path", "old_path")
    new = labelled(rows, "_q", lex).withColumnRenamed("full_path", "new_path")
    l1 = lambda c: segment(F.col(c), "L1")
    return (
        new.filter(F.col("new_path").isNotNull() & ~F.col("new_path").eqNullSafe(F.col("old_path")))
        .withColumn("write_back", (l1("old_path") == lex.meta_l1) & (l1("new_path") != lex.meta_l1))
        .select("id", "comment_id", "quote", "old_path", "new_path", "write_back")
    )


def apply_rematch(opinions: DataFrame, changes: DataFrame) -> DataFrame:
    # By comment too: opinion ids are 64-bit hashes, and among very many of them two may be equal.
    side = changes.filter("write_back").select("comment_id", "id", F.col("new_path").alias("_new"))
    return opinions.join(side, ["comment_id", "id"], "left").withColumn("full_path", F.coalesce("_new", "full_path")).select(*opinions.columns)


def sink_topics(comments: DataFrame, first_l1: DataFrame, meta_l1: str) -> DataFrame:
    """M8: a meta topic becomes the comment's first specific level; adds ``changed``."""
    side = first_l1.select(F.col("comment_id").alias("id"), "first_l1")
    meta = F.col("topic") == meta_l1
    changed = F.coalesce(meta & F.col("first_l1").isNotNull(), F.lit(False))
    return comments.join(side, "id", "left").withColumn("changed", changed).withColumn(
        "topic", F.when(F.col("changed"), F.col("first_l1")).otherwise(F.col("topic"))).drop("first_l1")


def merge_refreshed(current: DataFrame, due: DataFrame, remote: DataFrame, now: Column) -> DataFrame:
    """M9: refreshed counts into the due rows only."""
    return upsert_comments(current, remote.join(due.select(*KEY), KEY, "left_semi"), now)


def fix_name(comments: DataFrame, target_id: str, wrong: str, right: str) -> DataFrame:
    """M10"""
    named = lambda n: F.lit(f'"name": "{n}"')
    hit = (F.col("target_id") == target_id) & F.contains("extra_meta", F.lit(wrong))
    return comments.withColumn(
        "extra_meta", F.when(hit, F.replace(F.col("extra_meta"), named(wrong), named(right))).otherwise(F.col("extra_meta")))


def before_after(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    """M6 report: counts of a label before and after."""
    b = before.groupBy(F.col(column).alias("label")).agg(F.count("*").alias("before"))
    a = after.groupBy(F.col(column).alias("label2")).agg(F.count("*").alias("after"))
    return b.join(a, F.col("label").eqNullSafe(F.col("label2")), "full").select(
        F.coalesce("label", "label2").alias("label"), F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))
