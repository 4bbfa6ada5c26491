"""Text expressions. All run inside Spark's own expressions; no Python per row."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# Unicode white space plus the separators 1C-1F, which also count as blank when a phrase is stripped.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
BLANK = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
NON_WORD = r"[^\p{L}\p{N}_]+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``use``.

    Catalyst inlines a column that is named once, even into a lambda that runs per dictionary word, and
    copies it into every branch that names it; a one-element transform keeps it a single evaluation.
    """
    return F.transform(F.array(value), use)[0]


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))


def without_urls(text: Column) -> Column:
    url = F.regexp_replace(text, f"http[^{BLANK}]+", " ")
    return F.when(F.contains(text, F.lit("http")), url).otherwise(text)


def has_any(text: Column, words: list[str] | tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words], F.lit(False))


def clean_text(text: Column) -> Column:
    """Drop URLs, keep word characters and CJK, squeeze blanks."""
    return F.trim(F.regexp_replace(without_urls(text), NON_WORD, " "))


def snippet(text: Column, limit: int = 80, full: int = 200) -> Column:
    """struct(text, full, truncated)."""
    def parts(clean: Column) -> Column:
        long = F.length(clean) > limit
        return F.struct(
            F.when(long, F.concat(F.substring(clean, 1, limit), F.lit("…"))).otherwise(clean).alias("text"),
            F.when(long, F.substring(clean, 1, full)).otherwise(clean).alias("full"),
            long.alias("truncated"),
        )

    return let(squeeze(F.coalesce(text, F.lit(""))), parts)


def cut(text: Column, limit: int, tail: str = "...") -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(tail))).otherwise(text)


def with_quote_span(df: DataFrame, quote: Column, content: Column, start: Column, end: Column) -> DataFrame:
    """Add ``quote_start`` and ``quote_end``, the first occurrence of the quote, only where no start was given.

    The place is a column of its own, so the content is searched once for both ends.
    """
    at = F.col("_at")
    placed = df.withColumn("_at", F.when(start.isNull(), F.instr(F.coalesce(content, F.lit("")), quote) - 1))
    return placed.withColumns({
        "quote_start": F.when(at >= 0, at).otherwise(start).cast("int"),
        "quote_end": F.when(at >= 0, at + F.length(quote)).otherwise(end).cast("int"),
    }).drop("_at")


def response_body(response: Column) -> Column:
    """Model reply without code fences; when that is not JSON, its outermost ``{...}`` block."""
    unfenced = F.regexp_replace(strip(F.regexp_replace(response, f"```(?:json)?[{BLANK}]*", "")), "`+$", "")

    def pick(bare: Column) -> Column:
        block = F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit(""))
        return F.when(F.try_parse_json(bare).isNotNull(), bare).otherwise(block)

    return let(unfenced, pick)


def date_parts(text: Column) -> tuple[Column, Column, Column]:
    """C11: year, month and day of a date text such as ``2024 年 8 月 19 日`` (0 or missing gives NULL)."""
    tokens = F.split(F.regexp_replace(text, "[年月日]", " "), r"(?U)\s+")
    numbers = F.filter(tokens, lambda t: t.rlike(r"^\d+$"))
    picked = [F.try_element_at(numbers, F.lit(i + 1)).try_cast("int") for i in range(3)]
    return tuple(F.when(p != 0, p) for p in picked)


def is_overall(phrase: Column, words: list[str]) -> Column:
    """holds an overall-praise, overall-criticism or recommendation word, whatever the case."""
    return has_any(F.lower(phrase), [w.lower() for w in words])


def is_noise(phrase: Column) -> Column:
    """blank, digits only, ASCII letters only, or one character repeated."""
    return strip(phrase).rlike(r"(?s)^(?:\p{Nd}*|[A-Za-z ]*|(.)\1*)$")
