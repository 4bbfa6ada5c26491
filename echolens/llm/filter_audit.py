"""Filter interaction audit: what each of several filters removes, in every order, from one walk over their subsets.

Every document gets a mask: bit i is set if it fails filter i. Documents are counted per (part, mask), at most 32 cells a
part. A Gray code then visits all subsets of the filters by toggling one filter at a time: a toggle moves the counter of
active failures of those cells only that fail this filter, and a cell whose counter leaves or reaches zero leaves or joins
the running survivors. The 32 survivor counts of a part are stored; every figure of every order is a difference of two of
them. Nothing is evaluated per order.

| filter | a document fails if |
| --- | --- |
| A | it has fewer than 50 words |
| B | 100 * distinct words < 65 * words |
| C | 100 * letters A-Z > 5 * code points |
| D | it holds any of # $ % & * | |
| E | a smaller doc_id has the same text, removed or not |

Words are runs of bytes other than 0x20 and 0x09-0x0D, case-sensitive.

At scale: masks are a projection; texts never leave the scan but as a SHA-256 digest. E needs no join: rows are first
counted per (digest, part, labels) with their smallest key, which combines on the map side, so a text that a third of all
rows share moves as a few rows. The rest is counted per (part, mask). Rows without a key skip the shuffle by key.

Cases: null text counts as empty (fails A, and E beside another empty one); a null part and an empty one are the same part; a null
key has no smaller one and is no smaller one, so it never fails E and is never labelled; rows that repeat a key and text
are counted each and do not fail E through each other; a key with several labels has a label if any row gives it; null
labels count as absent; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .frames import table

FILTERS = "ABCDE"
MEASURES = ("n", "good", "toxic")
SPACES = r"[\x20\x09-\x0D]+"


def failures(text: Column) -> dict[str, Column]:
    """Failure conditions that need the text alone."""
    words = F.array_remove(F.split(text, SPACES), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": n < 50,
        "B": F.lit(100) * distinct < F.lit(65) * n,
        "C": F.lit(100).cast("bigint") * capitals > F.lit(5).cast("bigint") * F.char_length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def cells(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents per part and failure mask; bit i of the mask is filter i."""
    held = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), held.alias("text"))
    bits = [F.when(fails, 1 << FILTERS.index(name)).otherwise(0) for name, fails in failures(F.col("text")).items()]
    rows = rows.select("key", "part", F.unhex(F.sha2("text", 256)).alias("digest"), sum(bits[1:], bits[0]).alias("mask"))
    known = labels.select(F.col(key).cast("bigint").alias("key"), "quality", "toxic").filter("key IS NOT NULL").groupBy("key").agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    marked = rows.filter("key IS NOT NULL").join(known, "key", "left").select(
        "key", "part", "digest", "mask", *[F.coalesce(x, F.lit(False)).alias(x) for x in ("good", "toxic")])
    # One row per key and text: of the copies of a text only those of the smallest key pass E.
    once = marked.groupBy("key", "part", "digest", "mask", "good", "toxic").agg(F.count("*").alias("n"))
    of_text = once.groupBy("digest", "mask", "part", "good", "toxic").agg(F.sum("n").alias("n"), F.min(F.struct("key", "n")).alias("first"))
    least = of_text.groupBy("digest").agg(F.min("first.key").alias("least"))
    of_text = of_text.join(least, "digest")
    passing = F.when(F.col("first.key") == F.col("least"), F.col("first.n")).otherwise(0)
    copy = 1 << FILTERS.index("E")
    split = F.explode(F.array(F.struct(F.col("mask").alias("mask"), passing.alias("n")), F.struct((F.col("mask") + copy).alias("mask"), (F.col("n") - passing).alias("n"))))
    counted = of_text.select("part", "good", "toxic", split.alias("cell")).select("part", "cell.mask", "cell.n", "good", "toxic")
    loose = rows.filter("key IS NULL").groupBy("part", "mask").agg(F.count("*").alias("n")).withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    total = [F.sum("n").alias("n"), *[F.sum(F.when(F.col(x), F.col("n")).otherwise(0)).alias(x) for x in ("good", "toxic")]]
    return counted.unionByName(loose.select(*counted.columns)).groupBy("part", "mask").agg(*total).filter("n > 0")


def gray_walk(masks: np.ndarray, counts: np.ndarray, filters: int) -> np.ndarray:
    """Survivors of every subset of the filters: row s holds the sums of those cells that fail no filter of subset s.

    ``masks`` (cells) and ``counts`` (cells x measures) of one part.
    """
    states = np.zeros((1 << filters, counts.shape[1]), np.int64)
    failing = np.zeros(len(masks), np.int64)  # active filters that a cell fails
    alive = counts.sum(axis=0)
    failed_by = [np.flatnonzero(masks >> f & 1) for f in range(filters)]
    states[0] = alive
    subset = 0
    for i in range(1, 1 << filters):
        f = (i & -i).bit_length() - 1  # the bit that changes between neighbours of the code
        subset ^= 1 << f
        touched = failed_by[f]
        if subset >> f & 1:
            alive = alive - counts[touched[failing[touched] == 0]].sum(axis=0)
            failing[touched] += 1
        else:
            failing[touched] -= 1
            alive = alive + counts[touched[failing[touched] == 0]].sum(axis=0)
        states[subset] = alive
    return states


def subset_states(counted: DataFrame, filters: int = len(FILTERS)) -> DataFrame:
    """(part, n, good, toxic): per part and measure the survivors of all subsets, as arrays indexed by subset."""
    lists = counted.groupBy("part").agg(F.collect_list(F.struct("mask", *MEASURES)).alias("cells"))  # 32 at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.int64())
        for batch in batches:
            out = []
            for cells_of in batch.column(1).to_pylist():
                masks = np.array([c["mask"] for c in cells_of])
                out.append(gray_walk(masks, np.array([[c[m] for m in MEASURES] for c in cells_of], np.int64), filters))
            arrays = [pa.array([s[:, j] for s in out], kind) for j in range(len(MEASURES))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["part", *MEASURES])

    return lists.mapInArrow(run, "part string, n array<bigint>, good array<bigint>, toxic array<bigint>")


def order_steps(states: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order and step, all figures as differences of stored states."""
    m = len(filters)
    every = (1 << m) - 1
    steps = []
    for order in permutations(range(m)):
        before = 0
        for step, f in enumerate(order, 1):
            steps.append({"o": "".join(filters[i] for i in order), "step": step, "f": f + 1, "before": before + 1, "after": (before | 1 << f) + 1})
            before |= 1 << f

    def shapley(f: int) -> str:
        # A subset precedes filter f in (size)! * (m - 1 - size)! of the orders.
        return " + ".join(f"{factorial(s.bit_count()) * factorial(m - 1 - s.bit_count())} * (n[{s}] - n[{s | 1 << f}])" for s in range(1 << m) if not s >> f & 1)

    def per_filter(formula) -> Column:
        return F.expr("array(" + ", ".join(formula(f) for f in range(m)) + ")")

    own = states.withColumns({
        "fails": per_filter(lambda f: f"n[0] - n[{1 << f}]"),
        "alone": per_filter(lambda f: f"n[{every ^ 1 << f}] - n[{every}]"),
        "shapley": per_filter(shapley),
    })
    kind = "array<struct<o: string, step: int, f: int, before: int, after: int>>"
    rows = own.withColumn("s", F.explode(F.from_json(F.lit(json.dumps(steps)), kind)))
    lost = {x: F.element_at(x, F.col("s.before")) - F.element_at(x, F.col("s.after")) for x in MEASURES}
    of_filter = {x: F.element_at(x, F.col("s.f")) for x in ("fails", "alone", "shapley")}
    return rows.select(
        "part", F.col("s.o").alias("filter_order"), "s.step", F.element_at("n", F.col("s.after")).alias("kept"), lost["n"].alias("removed"),
        (of_filter["fails"] - lost["n"]).alias("redundant"), of_filter["alone"].alias("unique_fails"),
        lost["good"].alias("good_lost"), lost["toxic"].alias("toxic_lost"), of_filter["shapley"].alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """Effect of every filter at every step of every order, per part."""
    return order_steps(subset_states(cells(docs, labels, key, text, part)))


def op11(spark: SparkSession, folder: str) -> DataFrame:
    return audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


OP11_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CAST(len(w) < 50 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 65 * len(w) AS INT)
    + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t) AS INT)
    + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT)
    + 16 * CAST(coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false) AS INT) AS mask
  FROM d LEFT JOIN l ON l.doc_id = d.doc_id),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM m GROUP BY ALL),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS f(name, bit)),
p AS (
  SELECT '' AS o, 0 AS used
  UNION ALL SELECT o || name, used + bit FROM p JOIN f ON (used & bit) = 0),
s AS (
  SELECT o AS filter_order, CAST(i AS INT) AS step, f.bit,
    CAST(coalesce((SELECT sum(g.bit) FROM f g WHERE strpos(o, g.name) < i), 0) AS INT) AS before
  FROM p, range(1, 6) AS r(i) JOIN f ON f.name = o[i] WHERE used = 31),
x AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN (mask & (before | bit)) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN (mask & before) = 0 AND (mask & bit) > 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN (mask & before) > 0 AND (mask & bit) > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN (mask & before) = 0 AND (mask & bit) > 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN (mask & before) = 0 AND (mask & bit) > 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM x"""
