"""Word counts. Latin text is split into tokens; CJK runs into character n-grams, as there is no segmenter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as fixed, values as v
from ..functions.text import NON_WORD, let, without_urls
from .ordering import top_per_group

CJK = r"[一-鿿]+"


def grams(run: Column, low: int, high: int) -> Column:
    """Substrings of ``run`` of ``low`` to ``high`` characters."""
    n = F.length(run)
    sized = lambda size: F.transform(
        F.when(n >= size, F.sequence(F.lit(1), n - size + 1)).otherwise(F.array().cast("array<int>")),
        lambda at: F.substring(run, at, F.lit(size)),
    )
    return F.concat(*[sized(size) for size in range(low, high + 1)])


def tokens(text: Column, low: int = 2, high: int = 4) -> Column:
    """Word tokens without URLs; a text that holds CJK has those runs widened to n-grams."""
    words = lambda cleaned: F.filter(F.split(cleaned, NON_WORD), lambda w: w != "")
    widened = lambda cleaned: F.flatten(F.transform(
        words(F.regexp_replace(cleaned, rf"({CJK})", " $1 ")),
        lambda w: F.when(w.rlike(f"^{CJK}$"), grams(w, low, high)).otherwise(F.array(w)),
    ))
    return let(without_urls(text), lambda t: F.when(t.rlike(CJK), widened(t)).otherwise(words(t)))


def keyword_frequency(comments: DataFrame, top: int = 50, stopwords: list[str] | None = None) -> DataFrame:
    """Tokens of two characters or more, stop words left out."""
    stop = fixed.CHART_STOPWORDS if stopwords is None else stopwords
    words = comments.select(F.explode(tokens(F.col("content"))).alias("word"))
    kept = words.filter((F.length("word") >= 2) & ~F.lower("word").isin(stop))
    return kept.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(top)


def target_words(
    comments: DataFrame, top: int = 40, keep: int = 30, stopwords: list[str] | None = None, words: Column | None = None,
) -> DataFrame:
    """Words of 2 to 6 CJK characters per target; the top list is cut, then words inside the name go.

    ``words`` may replace the default tokeniser (an array column). The (target, word) counts combine on
    the map side, and the name is joined to the short list only.
    """
    stop = fixed.TARGET_STOPWORDS if stopwords is None else stopwords
    if words is None:
        words = F.flatten(F.transform(F.regexp_extract_all("content", F.lit(f"({CJK})")), lambda r: grams(r, 2, 6)))
    counts = (
        comments.select("target_id", F.explode(words).alias("word")).filter(~F.col("word").isin(stop))
        .groupBy("target_id", "word").agg(F.count("*").alias("n"))
    )
    order = [F.desc("n"), F.asc("word")]
    short = top_per_group(counts, ["target_id"], order, top, "_rank").drop("_rank")
    names = comments.groupBy("target_id").agg(v.meta_name(F.max("extra_meta"), F.col("target_id")).alias("name"))
    return top_per_group(
        short.join(names, "target_id").filter(~F.contains("name", "word")), ["target_id"], order, keep
    ).drop("name")
