"""From model replies to opinions and comment labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .. import schemas
from ..functions import text as tx, values as v
from ..session import settled
from .lexicon import Lexicon
from .matching import labelled, normalise_opinions, tone
from .ordering import batches

Annotator = Callable[[DataFrame], DataFrame]
"""Takes (id, content); gives opinions (id, pos, phrase, sentiment, sentiment_score, sentiment_confidence, is_core)."""


def prompt_batches(comments: DataFrame, size: int = 10, chars: int = 500) -> DataFrame:
    """T5: one row per batch of ``size`` comments: ids in order and the numbered texts, one per line."""
    # Only ids are put in order; the texts join their number afterwards.
    texts = comments.select("id", F.substring("content", 1, chars).alias("text"))
    numbered = batches(comments.select("id"), [F.asc("id")], size).join(texts, "id")
    line = F.concat(F.lit("["), F.col("idx"), F.lit("] "), F.col("text"))
    # A batch holds at most ``size`` rows.
    packed = numbered.groupBy("batch").agg(
        F.sort_array(F.collect_list(F.struct("idx", "id", line.alias("line")))).alias("rows"))
    return packed.select(
        "batch", F.size("rows").alias("batch_size"), F.col("rows.id").alias("ids"),
        F.array_join("rows.line", "\n").alias("batch_text"),
    )


def parse_responses(responses: DataFrame) -> DataFrame:
    """T4: (batch, batch_size, response) to one row per batch index with cleaned opinions.

    Indexes outside the batch and those that are no JSON integers (true and false count as 1 and 0) are dropped, the last
    of a repeated index wins, missing ones come out empty. The label of a comment counts as it stands, those of opinions are stripped.
    """
    body = F.from_json(tx.response_body(F.col("response")), schemas.MODEL_RESPONSE)
    indexes = F.when(F.col("batch_size") > 0, F.sequence(F.lit(0), F.col("batch_size") - 1))
    results = F.coalesce(F.col("_r.results"), F.array().cast(F_RESULTS))
    # The results of one reply: at most a batch of them, and a model's worth of opinions each.
    item = lambda i: F.try_element_at(F.filter(results, lambda x: whole_number(x["index"]) == i), F.lit(-1))
    slots = F.transform(indexes, lambda i: F.struct(i.alias("idx"), item(i).alias("item")))
    found = responses.select("batch", "batch_size", body.alias("_r")).select("batch", F.inline(slots))
    answered = F.col("item").isNotNull()
    return found.select(
        "batch", "idx",
        v.sentiment_label(F.coalesce(F.col("item.sentiment"), F.lit("neutral")), stripped=False).alias("sentiment"),
        v.clamped_score(F.col("item.sentiment_score")).alias("sentiment_score"),
        F.when(answered, 0.5).otherwise(0.0).alias("sentiment_confidence"),
        cleaned_opinions(F.col("item.opinions")).alias("opinions"),
    )


def whole_number(value: Column) -> Column:
    """A JSON integer, or a truth value as 1 or 0; NULL for a text or a fraction."""
    kind = F.schema_of_variant(value)
    flag = F.try_variant_get(value, "$", "boolean").cast("bigint")
    return F.when(kind == "BIGINT", F.try_variant_get(value, "$", "bigint")).when(kind == "BOOLEAN", flag)


F_OPINION = "struct<phrase: string, sentiment: string, sentiment_score: string, sentiment_confidence: string, is_core: boolean>"
F_RESULTS = f"array<struct<index: variant, sentiment: string, sentiment_score: string, opinions: array<{F_OPINION}>>>"


def cleaned_opinions(raw: Column) -> Column:
    """C7 over the opinions of one reply: blank phrases out, labels and numbers cleaned."""
    def clean(op: Column) -> Column:
        score = v.clamped_score(op["sentiment_score"])
        return F.struct(
            tx.strip(op["phrase"]).alias("phrase"),
            v.sentiment_label(F.coalesce(op["sentiment"], F.lit("neutral"))).alias("sentiment"),
            score.alias("sentiment_score"),
            v.clean_confidence(op["sentiment_confidence"], score).alias("sentiment_confidence"),
            F.coalesce(op["is_core"], F.lit(False)).alias("is_core"),
        )

    present = F.filter(
        F.coalesce(raw, F.array().cast(f"array<{F_OPINION}>")),
        lambda op: F.coalesce(tx.strip(op["phrase"]), F.lit("")) != "",
    )
    return F.transform(present, clean)


def exploded_opinions(parsed: DataFrame, *keys: str) -> DataFrame:
    return parsed.select(*keys, F.posexplode("opinions").alias("pos", "op")).select(*keys, "pos", "op.*")


def core_flags(opinions: DataFrame, key: str = "id") -> DataFrame:
    """One core opinion per comment (first marked one, else the first); works by aggregate and join back."""
    first = F.min(F.struct(~F.col("is_core"), F.col("pos")))
    core = settled(opinions.groupBy(key).agg(first.alias("_c")).select(key, F.col("_c.pos").alias("_core")))
    return opinions.join(core, key).withColumn("is_core", F.col("pos") == F.col("_core")).drop("_core")


def first_specific(opinions: DataFrame, lex_meta: str, valid_l1: list[str], key: str = "comment_id", order: str = "id") -> DataFrame:
    """First level of a comment's first opinion outside the meta bucket."""
    l1 = F.element_at(F.split("full_path", "/"), 1)
    fit = opinions.filter((l1 != lex_meta) & l1.isin(valid_l1))
    return fit.groupBy(key).agg(F.min_by(l1, order).alias("first_l1"))


def finalise(comments: DataFrame, opinions: DataFrame, lex: Lexicon, quote_chars: int = 60) -> tuple[DataFrame, DataFrame]:
    """(id, content, sentiment, sentiment_score) plus cleaned opinions to final comment labels and opinions.

    A comment's core and anchor are found by ``min`` over structs, which combines on the map side;
    no comment's opinions are ever gathered in one place. Labelled rows are checkpointed, as three later
    steps read them and matching is the costly part.
    """
    columns = ["id", "pos", "phrase", "sentiment", "sentiment_score", "sentiment_confidence", "is_core", "l3", "full_path"]
    matched = settled(normalise_opinions(opinions, lex, only_matched=True).select(*columns))
    bare = comments.join(matched.select("id").distinct(), "id", "left_anti")
    placed = settled(
        labelled(bare.select("id", "content", "sentiment", "sentiment_score"), "content", lex, only_matched=True)
        .withColumn("content", F.substring("content", 1, quote_chars))
    )
    whole = placed.filter(F.col("full_path").isNotNull()).select(
        "id", F.lit(0).alias("pos"), F.col("content").alias("phrase"), "sentiment", "sentiment_score",
        F.least(F.lit(1.0), F.abs("sentiment_score")).alias("sentiment_confidence"), F.lit(True).alias("is_core"), "l3", "full_path",
    )
    valid = matched.select(*columns).unionByName(whole)

    fallback = F.col("l3").isin(*lex.fallback)
    picked = F.struct("sentiment", "sentiment_score", "sentiment_confidence", "l3", "full_path", "pos")
    marks = valid.groupBy("id").agg(
        F.min_by(picked, F.struct(~F.col("is_core"), F.col("pos"))).alias("core"),
        F.min_by(F.col("full_path"), F.when(~fallback, F.col("pos"))).alias("specific"),
        F.count_if(~fallback).alias("specifics"),
    )
    anchor = F.when(F.col("core.l3").isin(*lex.fallback) & (F.col("specifics") > 0), F.col("specific")).otherwise(F.col("core.full_path"))
    l1 = F.element_at(F.split(anchor, "/"), 1)
    known_l1 = sorted({t[1] for t in lex.taxonomy})
    labels = settled(comments.join(marks, "id", "left").select(
        "id",
        F.coalesce("core.sentiment", "sentiment").alias("sentiment"),
        F.coalesce("core.sentiment_score", "sentiment_score").alias("sentiment_score"),
        F.coalesce("core.sentiment_confidence", F.lit(0.5)).alias("sentiment_confidence"),
        F.when(l1.isin(known_l1), l1).otherwise(lex.meta_l1).alias("topic"),
        F.col("core.pos").alias("core_pos"),
    ))
    final = (
        valid.join(labels.select("id", "core_pos"), "id").withColumn("is_core", F.col("pos") == F.col("core_pos"))
        .drop("core_pos")
    )
    return labels, final


def lexicon_annotator(lex: Lexicon) -> Annotator:
    """Built-in annotator: sentences as phrases with the coarse tone; needs no model."""
    score = F.when(F.col("sentiment") == "positive", 0.6).when(F.col("sentiment") == "negative", -0.6).otherwise(0.0)

    def annotate(comments: DataFrame) -> DataFrame:
        parts = comments.select("id", F.posexplode(F.split("content", r"[.!?。！？\n]+")).alias("pos", "phrase"))
        rows = parts.withColumn("phrase", tx.strip(F.col("phrase"))).filter(F.length("phrase") > 1)
        return (
            rows.withColumn("sentiment", tone(F.col("phrase"), lex)).withColumn("sentiment_score", score)
            .withColumn("sentiment_confidence", F.abs("sentiment_score")).withColumn("is_core", F.lit(False))
        )

    return annotate


def converge(comments: DataFrame, annotators: list[Annotator]) -> DataFrame:
    """Round ``i`` runs ``annotators[i]`` on the comments the earlier rounds gave no opinion for.

    Rounds are few and fixed; each is checkpointed, so a later round never recomputes an earlier one.
    """
    pending, found = comments, None
    for number, annotate in enumerate(annotators, 1):
        new = settled(annotate(pending).withColumn("round", F.lit(number)))
        found = new if found is None else found.unionByName(new)
        pending = pending.join(new.select("id").distinct(), "id", "left_anti")
    return found


def rebuilt_golden(
    sample: DataFrame, overrides: DataFrame, mechanical: DataFrame, excluded: DataFrame, lex: Lexicon,
) -> DataFrame:
    """Override path, else path of the override label or the mapped old label; excluded rows are marked.

    ``overrides``: (opinion_id, override); ``mechanical``: (old_l3, new_l3); ``excluded``: (opinion_id).
    """
    from .matching import with_path

    old_l3 = F.element_at(F.split("old_full_path", "/"), -1)
    joined = (
        sample.withColumn("old_l3", old_l3).join(overrides, "opinion_id", "left").join(mechanical, "old_l3", "left")
        .join(excluded.select("opinion_id", F.lit(True).alias("excluded")), "opinion_id", "left")
        .withColumn("excluded", F.coalesce("excluded", F.lit(False)))
    )
    is_path = F.coalesce(F.contains("override", F.lit("/")), F.lit(False))
    labelled_rows = with_path(joined.withColumn("l3", F.coalesce("override", "new_l3")), lex)
    return labelled_rows.withColumn(
        "new_full_path", F.when(is_path, F.col("override")).otherwise(F.col("full_path"))
    ).select("opinion_id", "phrase", "old_full_path", "new_full_path", "excluded")
