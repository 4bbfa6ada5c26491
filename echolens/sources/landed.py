"""Landed JSON and XML payloads to ingest rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import schemas
from ..functions import values as v
from ..functions.text import strip


def normalise_reviews(raw: DataFrame, json: str = "payload", appid: str = "appid", fetch_metadata: bool = False) -> DataFrame:
    """Store-review JSON to ingest rows. Counts and the developer reply are kept only on a refresh run."""
    r = F.col("_r")
    zero = lambda c: F.coalesce(c, F.lit(0))
    a = r["author"]
    extras = [
        F.col(appid).alias("appid"),
        *(zero(a[n]).alias(n) for n in (
            "playtime_forever", "playtime_at_review", "playtime_last_two_weeks", "deck_playtime_at_review")),
        *(r[n].alias(n) for n in (
            "steam_purchase", "received_for_free", "refunded", "written_during_early_access", "primarily_steam_deck",
            "weighted_vote_score", "app_release_date")),
        F.coalesce(r["reactions"], F.array().cast("array<string>")).alias("reactions"),
    ]
    if fetch_metadata:
        extras += [r["developer_response"].alias("developer_response"), r["timestamp_dev_responded"].alias("timestamp_dev_responded")]
    number = lambda c: zero(c).cast("int") if fetch_metadata else F.lit(None).cast("int")
    account = F.nullif(a["steamid"], F.lit(""))
    seconds = r["timestamp_created"]
    return raw.withColumn("_r", F.from_json(json, schemas.REVIEW_JSON)).select(
        F.lit("steam").alias("platform"),
        F.coalesce(r["recommendationid"], F.lit("")).alias("source_id"),
        F.col(appid).alias("target_key"),
        strip(F.coalesce(r["review"], F.lit(""))).alias("content"),
        account.alias("author"), account.alias("author_id"),
        r["voted_up"].cast("int").alias("rating"), r["language"].alias("language"),
        number(r["votes_up"]).alias("likes"), number(r["comment_count"]).alias("replies"),
        v.naive_utc(F.when(seconds != 0, seconds)).alias("posted_at"),
        F.to_json(F.struct(*extras), {"ignoreNullFields": "false"}).alias("extra_json"),
    )


def normalise_replies(raw: DataFrame, json: str = "payload", aid: str = "aid") -> DataFrame:
    """S3: video-reply JSON to ingest rows; no rating, counts stored at once, author profile nested."""
    c = F.col("_c")
    m = c["member"]
    profile = F.struct(
        m["uname"].alias("uname"), m["level_info"]["current_level"].alias("level"), m["vip"].alias("vip"),
        m["sex"].alias("sex"), m["official_verify"].alias("official"),
    )
    return raw.withColumn("_c", F.from_json(json, schemas.REPLY_JSON)).select(
        F.lit("bilibili").alias("platform"), c["rpid"].cast("string").alias("source_id"),
        F.col(aid).cast("string").alias("target_key"),
        F.coalesce(c["content"]["message"], F.lit("")).alias("content"), m["uname"].alias("author"),
        F.nullif(m["mid"], F.lit("")).alias("author_id"), F.lit(None).cast("int").alias("rating"),
        F.lit("zh-CN").alias("language"), c["like"].alias("likes"), c["rcount"].alias("replies"),
        v.naive_utc(F.when(c["ctime"] != 0, c["ctime"])).alias("posted_at"),
        F.to_json(F.struct(F.col(aid).alias("aid"), profile.alias("profile")), {"ignoreNullFields": "false"}).alias("extra_json"),
    )


def parse_danmaku(files: DataFrame, xml: str = "xml", *keys: str) -> DataFrame:
    """``<d p="...">text</d>`` elements to rows. A bad position gives 0, a bad time NULL."""
    pattern = F.lit(r'(?s)<d p="([^"]*)">(.*?)</d>')
    pairs = F.arrays_zip(
        F.regexp_extract_all(xml, pattern, F.lit(1)).alias("p"), F.regexp_extract_all(xml, pattern, F.lit(2)).alias("t"))
    rows = files.select(*keys, F.posexplode(pairs).alias("pos", "_d")).withColumn("_p", F.split("_d.p", ","))
    part = lambda i: F.try_element_at("_p", F.lit(i + 1))
    whole = lambda c: c.try_cast("double").cast("bigint")
    digits = lambda c, signed: F.when(c.rlike(r"^-*\d+$" if signed else r"^\d+$"), c.try_cast("int"))
    seconds = whole(part(4))
    return rows.select(
        *keys, "pos", strip(F.col("_d.t")).alias("content"),
        F.coalesce(whole(part(0)), F.lit(0)).cast("int").alias("progress"),
        digits(part(1), False).alias("mode"), digits(part(3), True).alias("color"), part(6).alias("user_hash"),
        v.naive_utc(F.when(seconds != 0, seconds)).alias("posted_at"),
    )


def probabilities_to_labels(rows: DataFrame, negative: str = "neg_prob", positive: str = "pos_prob") -> DataFrame:
    """C13"""
    label, score, confidence = v.from_probabilities(F.col(negative), F.col(positive))
    return rows.withColumns({"sentiment": label, "sentiment_score": score, "sentiment_confidence": confidence})


