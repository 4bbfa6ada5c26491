"""Phrase to topic label.

The dictionary is part of the expression (``dictionary``), so matching is a narrow projection: no join, no shuffle,
one path for dictionaries of any size, and a phrase that makes up a third of the rows costs the same as any other.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as fixed
from ..functions.text import has_any, strip
from .lexicon import Lexicon


def masked(phrase: Column, lex: Lexicon) -> Column:
    bare = strip(phrase)
    for term in lex.masked_terms:
        bare = F.replace(bare, F.lit(term), F.lit(fixed.MASK))
    return bare


def best_label(text: Column, lex: Lexicon) -> Column:
    """Label with the highest sum of matched keyword lengths; the earliest label wins a tie."""
    names = F.from_json(F.lit(json.dumps([l3 for l3, _ in lex.competing()], ensure_ascii=False)), "array<string>")

    # Points are added up in the order of their labels, so one pass has the running total of a label and the best so far.
    start = F.struct(F.lit(-1).alias("rank"), F.lit(0).alias("total"), F.lit(0).alias("score"), F.lit(-1).alias("best"))

    def add(state: Column, point: Column) -> Column:
        total = point["weight"] + F.when(point["rank"] == state["rank"], state["total"]).otherwise(0)
        return F.struct(
            point["rank"].alias("rank"), total.alias("total"), F.greatest(state["score"], total).alias("score"),
            F.when(total > state["score"], point["rank"]).otherwise(state["best"]).alias("best"))

    points = F.sort_array(F.flatten(lex.label_index().found(text)))
    return F.get(names, F.aggregate(points, start, add, lambda state: state["best"]))


def with_label(df: DataFrame, phrase: str, lex: Lexicon, label: str = "l3", only_matched: bool = False) -> DataFrame:
    """Add the label of ``phrase`` (NULL when blank or unmatched; such rows go with ``only_matched``).

    A filter on the label would be pushed below it and label every phrase twice, so unmatched rows are
    dropped by exploding a list of no or one label.
    """
    p = F.col("_phrase")
    general = (
        F.when(has_any(p, lex.recommend_words), lex.recommend_label)
        .when(has_any(p, lex.overall_words), lex.overall_label)
        .when(F.length(p) <= fixed.SHORT_PHRASE, lex.overall_label)
    )
    ladder = (
        F.when(F.coalesce(p, F.lit("")) == "", None)
        .when(has_any(p, lex.meme_words), lex.meme_label)
        .otherwise(F.coalesce(best_label(p, lex), general))
    )
    found = df.withColumn("_phrase", masked(F.col(phrase), lex)).withColumn(label, ladder).drop("_phrase")
    if not only_matched:
        return found
    some = F.filter(F.array("_label"), lambda x: x.isNotNull())
    return found.withColumnRenamed(label, "_label").withColumn(label, F.explode(some)).drop("_label")


def keyword_hits(df: DataFrame, phrase: str, lex: Lexicon) -> DataFrame:
    """One row per phrase row and dictionary entry contained in it."""
    rows = df.withColumn("_phrase", masked(F.col(phrase), lex))
    hits = rows.withColumn("_hit", F.explode(F.flatten(lex.entry_index().found(F.col("_phrase")))))
    return hits.select(*df.columns, "_hit.l3", "_hit.keyword", "_hit.pos")


def with_path(df: DataFrame, lex: Lexicon, label: str = "l3", path: str = "full_path") -> DataFrame:
    """Label to full path by a literal hash table (size checked by ``Lexicon``): no join, so no row moves for its label."""
    return df.withColumn(path, lex.path_index().value(F.col(label)))


def labelled(df: DataFrame, phrase: str, lex: Lexicon, only_matched: bool = False) -> DataFrame:
    return with_path(with_label(df, phrase, lex, only_matched=only_matched), lex)


def normalise_opinions(opinions: DataFrame, lex: Lexicon, phrase: str = "phrase", only_matched: bool = False) -> DataFrame:
    """Blank phrases dropped, the rest stripped and given label and path."""
    bare = opinions.withColumn(phrase, strip(F.col(phrase))).filter(F.col(phrase) != "")
    return labelled(bare, phrase, lex, only_matched)


def tone(text: Column, lex: Lexicon) -> Column:
    """Coarse tone; praise is looked for first."""
    return (
        F.when(has_any(text, lex.praise_words), "positive")
        .when(has_any(text, lex.criticize_words), "negative")
        .otherwise("neutral")
    )


def quality_gate(golden: DataFrame, lex: Lexicon) -> DataFrame:
    """Golden (phrase, full_path) rows with the predicted path and whether both agree."""
    expected = golden.withColumnRenamed("full_path", "expected_path")
    return labelled(expected, "phrase", lex).withColumn("ok", F.col("full_path").eqNullSafe(F.col("expected_path")))
