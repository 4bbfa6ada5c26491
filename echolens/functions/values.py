"""Value clean-up and display expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import schemas
from . import fixed_values as fixed
from .text import strip


def percent(part: Column, whole: Column, digits: int | None = 1, empty: float | None = None) -> Column:
    share = part / whole * 100
    value = F.round(share, digits) if digits is not None else share
    return F.when(whole > 0, value).otherwise(F.lit(empty).cast("double"))


def is_sentiment(name: str, column: str = "sentiment") -> Column:
    return F.col(column) == name


def naive_utc(seconds: Column) -> Column:
    """Unix seconds (number or numeric string) to naive UTC; anything else gives NULL."""
    return F.timestamp_seconds(seconds.try_cast("double")).cast("timestamp_ntz")


def sentiment_label(text: Column, stripped: bool = True) -> Column:
    """Lower-cased sentiment, neutral when unknown; blanks around it count unless ``stripped``."""
    low = F.lower(strip(text) if stripped else text)
    return F.when(low.isin(*fixed.SENTIMENTS), low).otherwise("neutral")


def clamped_score(text: Column) -> Column:
    number = F.coalesce(text.try_cast("double"), F.lit(0.0))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), number))


def clean_confidence(text: Column, score: Column) -> Column:
    number = F.coalesce(text.try_cast("double"), F.lit(0.0))
    return F.when((number > 0) & (number <= 1), number).otherwise(F.least(F.lit(1.0), F.abs(score)))


def stored_confidence(text: Column) -> Column:
    """NULL unless a number within 0..1."""
    number = text.try_cast("double")
    return F.when(number.between(0.0, 1.0), number)


def from_probabilities(negative: Column, positive: Column) -> tuple[Column, Column, Column]:
    """Sentiment, score and confidence of a two-class model output."""
    label = F.when(positive > negative, "positive").when(negative > positive, "negative").otherwise("neutral")
    return label, positive - negative, F.greatest(negative, positive)


def display_time(ts: Column) -> Column:
    """C14"""
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd HH:mm"), F.lit("—"))


def display_hours(minutes: Column) -> Column:
    return F.when(minutes.isNotNull(), F.format_string("%.1f", F.round(minutes / 60, 1))).otherwise("")


def display_percent(part: Column, whole: Column) -> Column:
    return F.concat(F.format_string("%.1f", percent(part, whole, 1, 0.0)), F.lit("%"))


def review_extras(extra_json: Column) -> Column:
    """Struct of typed extra fields as stored."""
    return F.from_json(extra_json, schemas.REVIEW_EXTRAS)


def extras_with_defaults(extra_json: Column, vote_default: float | None = None) -> list[Column]:
    """Report fields; missing flags are false, a blank reply is NULL, the vote score default is the caller's."""
    x = review_extras(extra_json)
    no = lambda c: F.coalesce(c, F.lit(False))
    return [
        x["playtime_at_review"].alias("playtime_at_review"),
        x["playtime_forever"].alias("playtime_forever"),
        no(x["refunded"]).alias("refunded"),
        no(x["written_during_early_access"]).alias("early_access"),
        no(x["primarily_steam_deck"]).alias("steam_deck"),
        no(x["received_for_free"]).alias("received_for_free"),
        F.coalesce(x["weighted_vote_score"], F.lit(vote_default).cast("double")).alias("weighted_vote_score"),
        F.nullif(strip(x["developer_response"]), F.lit("")).alias("developer_response"),
    ]


def patched_name(meta: Column, name: Column, kind: str = "game") -> Column:
    """Fill ``name`` and ``type`` of a JSON map where absent."""
    known = F.coalesce(F.from_json(meta, "map<string,string>"), F.create_map().cast("map<string,string>"))
    missing_name = F.coalesce(known["name"], F.lit("")) == ""
    merged = F.map_concat(
        F.map_filter(known, lambda k, _: ~k.isin("name", "type")),
        F.create_map(
            F.lit("name"), F.when(missing_name, name).otherwise(known["name"]),
            F.lit("type"), F.coalesce(known["type"], F.lit(kind)),
        ),
    )
    return F.to_json(merged)


def meta_name(meta: Column, fallback: Column) -> Column:
    return F.coalesce(F.nullif(F.get_json_object(meta, "$.name"), F.lit("")), fallback)


def rating_tier(pct: Column) -> Column:
    """Rating words by percentage."""
    chain = F
    for floor, word in fixed.RATING_TIERS:
        chain = chain.when(pct >= floor, word)
    return chain.otherwise(fixed.LOWEST_TIER)


def store_rating(code: Column) -> Column:
    """Store rating code 1-9 to words."""
    chain = F
    for number, word in fixed.STORE_RATINGS.items():
        chain = chain.when(code == number, word)
    return chain.otherwise(fixed.NO_STORE_RATING)


def comment_key(platform: Column, source_id: Column) -> Column:
    return F.xxhash64(platform, source_id)
