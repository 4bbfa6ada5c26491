"""I4: one landing to finished tables, with failures kept to their targets.

Order: split off failing targets, dedup, upsert, bullet comments, vectors for the missing, labels for the unanalyzed, run log.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from ..operators import annotate, incremental, joins, merge, vectors
from ..operators.lexicon import Lexicon
from ..session import settled


@dataclass
class Landing:
    comments: DataFrame
    opinions: DataFrame
    vectors: DataFrame
    log: DataFrame
    quarantine: DataFrame
    counts: dict[str, int]
    space: vectors.Space | None
    danmaku: DataFrame | None = None
    errors: list[tuple[str, str]] = field(default_factory=list)


def opinion_rows(final: DataFrame) -> DataFrame:
    none = F.lit(None).cast("int")
    return final.select(
        F.col("id").alias("comment_id"), "pos", "full_path", "sentiment", F.col("sentiment_confidence").cast("string").alias("sentiment_confidence"),
        F.col("phrase").alias("quote"), none.alias("quote_start"), none.alias("quote_end"))


def land(
    raw: DataFrame, comments: DataFrame, opinions: DataFrame, stored: DataFrame, lex: Lexicon, now: datetime,
    annotators: list[annotate.Annotator] | None = None, space: vectors.Space | None = None, dim: int = 512, model: str = "hashed-tfidf",
    arrival: str = "arrival", bullets: DataFrame | None = None, danmaku: DataFrame | None = None,
) -> Landing:
    """Land ``raw`` (and ``bullets`` into ``danmaku``).

    A target with a failed row lands nothing; the others go on. Stages after the upsert are optional: one that
    fails is noted; one that fails for some targets only is run for the others. ``space`` is the fitted vector space of
    earlier landings, the first landing fits one on all comments. Vectors are not written beside those of another space.
    """
    stamp = F.lit(now).cast("timestamp_ntz")
    good, quarantine, failed, counts = incremental.split_by_target(raw)
    batch = merge.first_seen(good, merge.KEY, arrival)
    merged = settled(merge.upsert_comments(comments, batch, stamp, arrival))
    errors: list[tuple[str, str]] = []
    bad: dict[str, str] = {}

    def insert() -> DataFrame:
        new = merge.insert_danmaku(danmaku, bullets)
        return settled(danmaku.unionByName(new.select(*danmaku.columns)))

    def divided(stage: str, rows: DataFrame, step) -> DataFrame | None:
        found, failing = incremental.divided(rows, step)
        for target, error in failing.items():
            errors.append((stage, f"{target}: {error}"))
            bad.setdefault(target, f"{stage}: {error}")
        return found

    def embed() -> DataFrame | None:
        nonlocal space
        space = space or vectors.Space.fitted(merged, "content", model, dim)
        other = vectors.foreign(stored, space.name, space.dim)
        if other:
            raise ValueError(f"stored vectors are of {other}, not of {space.name}: refit or replace them all")
        missing = joins.missing_vectors(merged, stored)
        return divided("vectors", missing, lambda rows: space.vectors(rows, "content").select(
            F.col("id").alias("comment_id"), F.lit(space.name).alias("model"), F.lit(space.dim).alias("dim"), "vector", stamp.alias("created_at")))

    def label() -> tuple[DataFrame, DataFrame] | None:
        todo = merged.filter(F.col("analyzed_at").isNull()).select(
            "id", "target_id", "content", F.lit("neutral").alias("sentiment"), F.lit(0.0).alias("sentiment_score"))
        steps = annotators or [annotate.lexicon_annotator(lex)]
        found = divided("annotate", todo, lambda rows: annotate.converge(rows.drop("target_id"), steps).drop("round"))
        if found is None:
            return None
        done = todo if not bad else todo.filter(~F.coalesce(F.col("target_id"), F.lit("")).isin([t or "" for t in bad]))
        labels, final = annotate.finalise(done.drop("target_id"), found, lex)
        labels = labels.withColumn("sub_topics", F.array().cast("array<string>"))
        return settled(labels), settled(opinion_rows(final))

    if bullets is not None:
        danmaku = incremental.isolated("danmaku", insert, errors) or danmaku
    new_vectors = incremental.isolated("vectors", embed, errors)
    bad.clear()  # a target without vectors is labelled all the same
    labelled = incremental.isolated("annotate", label, errors)
    out_comments, out_opinions = merged, opinions
    if labelled:
        out_comments, out_opinions = merge.replace_analysis(merged, opinions, *labelled, stamp)

    with_target = lambda ids: merged.join(ids, "id", "left_semi").select("target_id", "id")
    nothing = merged.select("target_id", "id").filter(F.lit(False))
    keyed = merged.join(batch.select(*merge.KEY), merge.KEY, "left_semi").select("target_id", *merge.KEY)
    known = failed.select("target_id", "error")
    if bad:  # at most MAX_TARGETS
        known = known.unionByName(known.sparkSession.createDataFrame(list(bad.items()), "target_id string, error string"))
        known = known.groupBy("target_id").agg(F.min("error").alias("error"))
    log = incremental.run_log(
        keyed, comments, with_target(labelled[0].select("id")) if labelled else nothing,
        with_target(new_vectors.select(F.col("comment_id").alias("id"))) if new_vectors is not None else nothing, known)
    out_vectors = merge.upsert_vectors(stored, new_vectors) if new_vectors is not None else stored
    return Landing(out_comments, out_opinions, out_vectors, log, quarantine, counts, space, danmaku, errors)
