"""Export frames and their file sinks. Files are written by the tasks, one part per partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import values as v
from ..operators.filters import parsed_list
from ..operators.joins import with_comment
from ..operators.nesting import opinion_counts, whole_opinions

SENTIMENT_WORDS = {"positive": "正向", "neutral": "中性", "negative": "负向"}


def sentiment_word(column: str):
    word = F
    for code, text in SENTIMENT_WORDS.items():
        word = word.when(F.col(column) == code, text)
    return word.otherwise(F.coalesce(column, F.lit("")))


def vote_word(column: str):
    return F.when(F.col(column) == 1, "推荐").otherwise("不推荐")


def voices_csv_frame(comments: DataFrame, opinions: DataFrame) -> DataFrame:
    """One export row per comment."""
    counts = opinion_counts(opinions).withColumnRenamed("comment_id", "id")
    minutes = v.review_extras(F.col("extra_json"))["playtime_at_review"]
    return comments.join(counts, "id", "left").select(
        "source_id", v.meta_name(F.col("extra_meta"), F.col("target_id")).alias("game"),
        v.display_time(F.col("posted_at")).alias("posted_at"), vote_word("rating").alias("vote"),
        sentiment_word("sentiment").alias("sentiment"), F.col("sentiment_score"), F.coalesce("topic", F.lit("")).alias("l1"),
        F.array_join(parsed_list("sub_topics"), "|").alias("l2"), F.coalesce("opinion_count", F.lit(0)).alias("opinion_count"),
        v.display_hours(minutes).alias("hours_at_review"), "likes", "replies", "content",
    )


def opinions_csv_frame(comments: DataFrame, opinions: DataFrame) -> DataFrame:
    """One export row per opinion."""
    side = comments.withColumn("overall", F.col("sentiment"))
    joined = with_comment(opinions, side, "source_id", "extra_meta", "target_id", "posted_at", "rating", "overall")
    return joined.select(
        "id", "source_id", F.col("full_path").alias("path"), sentiment_word("sentiment").alias("sentiment"),
        v.meta_name(F.col("extra_meta"), F.col("target_id")).alias("game"), v.display_time(F.col("posted_at")).alias("posted_at"),
        vote_word("rating").alias("vote"), sentiment_word("overall").alias("overall_sentiment"),
        F.coalesce("quote", F.lit("")).alias("quote"),
    )


def write_csv(df: DataFrame, path: str) -> None:
    """Quoted where needed, quotes doubled, headers in every part file."""
    df.write.option("header", True).option("quote", '"').option("escape", '"').option("encoding", "UTF-8").csv(path)


def voices(comments: DataFrame, platform: str) -> DataFrame:
    """Comments with names and typed extras."""
    rows = comments.filter(F.col("platform") == platform)
    names = rows.groupBy("target_id").agg(F.min("extra_meta").alias("_meta"))
    fields = ["id", "source_id", "content", "author", "rating", "language", "sentiment", "sentiment_score", "sentiment_confidence", "topic"]
    # The payload's own id comes first; the target is the fallback.
    own = F.nullif(F.get_json_object("extra_json", "$.appid"), F.lit(""))
    appid = F.coalesce(own, F.element_at(F.split("target_id", ":"), -1))
    return rows.join(names, "target_id").select(
        *fields, parsed_list("sub_topics").alias("sub_topics"), "target_id", appid.alias("appid"), v.meta_name(F.col("_meta"), appid).alias("game"),
        F.date_format("posted_at", "yyyy-MM-dd HH:mm:ss").alias("posted_at"), "likes", "replies", *v.extras_with_defaults(F.col("extra_json")))


def voice_documents(comments: DataFrame, opinions: DataFrame, platform: str = "steam") -> DataFrame:
    """Each comment once, with typed extras and all its opinions (``opinion_documents`` has them as rows)."""
    nested = whole_opinions(opinions).withColumnRenamed("comment_id", "id")
    return voices(comments, platform).join(nested, "id", "left")


def opinion_documents(comments: DataFrame, opinions: DataFrame, platform: str = "steam") -> DataFrame:
    """Opinions with the fields of their comment, by which reports filter and show them."""
    side = voices(comments, platform).withColumnRenamed("sentiment", "overall_sentiment").drop("sentiment_score", "sentiment_confidence", "developer_response")
    own = opinions.select("id", "comment_id", F.col("full_path").alias("path"), "sentiment", "sentiment_confidence", "quote")
    return own.join(side.withColumnRenamed("id", "comment_id"), "comment_id")


def write_json(df: DataFrame, path: str, *partition_by: str) -> None:
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.json(path)


def annotation_tables(comments: DataFrame, opinions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Comments that have opinions with their count, and opinions with comment attributes."""
    counts = opinion_counts(opinions).withColumnRenamed("comment_id", "id")
    left = comments.join(counts, "id").select(
        "id", "target_id", "content", "rating", "language", "posted_at", "sentiment", "topic", "opinion_count")
    side = comments.withColumn("comment_sentiment", F.col("sentiment"))
    right = with_comment(opinions, side, "target_id", "rating", "language", "comment_sentiment").select(
        "id", "comment_id", "target_id", "full_path", "sentiment", "quote", "rating", "language", "comment_sentiment")
    return left, right


def video_comments(comments: DataFrame, platform: str = "bilibili") -> DataFrame:
    """Replies by likes with the author profile."""
    p = F.from_json(
        F.col("extra_json"),
        "profile struct<level: int, sex: string, vip: struct<status: int>, official: struct<title: string>>")["profile"]
    return comments.filter(F.col("platform") == platform).select(
        "id", "source_id", "target_id", "author", "likes", "posted_at", p["level"].alias("level"), p["sex"].alias("sex"),
        F.coalesce(p["vip"]["status"], F.lit(0)).alias("vip"), F.coalesce(p["official"]["title"], F.lit("")).alias("official"), "content",
    ).orderBy(F.desc_nulls_last("likes"), "id")


def video_danmaku(danmaku: DataFrame) -> DataFrame:
    """S11"""
    return danmaku.orderBy("progress", "id")
