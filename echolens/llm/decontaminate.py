"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Every run of ``window`` consecutive words of a test item is a pattern; an item with fewer words is one shorter
pattern. Patterns of equal length share one search machine, whose alphabet is the 64-bit word hash: a block of two
words looks up how far the search may move on (shift table), a block that ends some pattern names a bucket of
patterns by their suffix, and a direct comparison, of the hashes and then of the bytes, confirms each occurrence. The
shift table grows with the patterns, so that most blocks of a text stay unknown to it.

The texts of a batch are searched in lock step: the words are cut into lanes, and numpy moves the cursors of all
lanes at once. Patterns are broadcast in blocks of at most ``PATTERNS`` (about 128 bytes each), whatever the size of
the test table; hits of several blocks are united per document.

Cases: null or empty text has no words and no hit; a null or empty item gives no pattern; a null item_id counts as
the id "" in the digest; repeated items and repeated documents each count by their own row; an empty test table hits
nothing. Columns of the documents other than key and text pass through; result columns replace any of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from .frames import table, written
from .ragged import ALPHANUMERIC, Words, blocks, sequence_hash

WINDOW = 13
PATTERNS = 100_000
TABLE_BITS = (16, 24)  # least and most bits of a shift table; in between, 16 slots per block of a pattern
LANES = 1024
FOUND = "n_words bigint, n_hit bigint, item_ids array<string>, hit_spans array<struct<start:bigint,stop:bigint>>"


class Machine:
    """Shift table, suffix buckets and patterns of one pattern length."""

    def __init__(self, patterns: np.ndarray, texts: list[bytes]):
        self.patterns, self.length, self.texts = patterns, patterns.shape[1], texts
        self.block = min(2, self.length)
        least, most = TABLE_BITS
        self.bits = min(most, max(least, (16 * patterns.size).bit_length()))
        self.shift = np.full(1 << self.bits, self.length - self.block + 1, np.uint8)
        for end in range(self.block, self.length + 1):  # block that ends at word ``end`` of a pattern
            at = self.slot(self.block_hash(patterns[:, end - self.block : end]))
            np.minimum.at(self.shift, at, np.uint8(self.length - end))
        suffix = self.block_hash(patterns[:, -self.block :])
        self.order = np.argsort(suffix, kind="stable")
        self.suffix = suffix[self.order]

    @staticmethod
    def block_hash(words: np.ndarray) -> np.ndarray:
        return sequence_hash(list(words.T))

    def slot(self, block_hash: np.ndarray) -> np.ndarray:
        return (block_hash >> np.uint64(64 - self.bits)).astype(np.int64)

    def occurrences(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (first word, pattern) of all occurrences in the texts of a block, equal byte for byte."""
        at, which = self.candidates(w.hash)
        if not len(at):
            return at, which
        within = w.text[at] == w.text[np.minimum(at + self.length - 1, len(w.text) - 1)]
        at, which = at[within], which[within]
        same = np.fromiter((self.spelt(w, a) == self.texts[p] for a, p in zip(at.tolist(), which.tolist())), bool, len(at))
        return at[same], which[same]

    def spelt(self, w: Words, at: int) -> bytes:
        """The words of a window as bytes, one space between them."""
        ends = slice(at, at + self.length)
        return b" ".join([w.data[a:b].tobytes() for a, b in zip(w.start[ends].tolist(), w.end[ends].tolist())])

    def candidates(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (first word, pattern) whose word hashes agree, in one word sequence."""
        n = len(words) - self.block + 1
        none = np.zeros(0, np.int64)
        if n <= self.length - self.block:
            return none, none
        ends = sequence_hash([words[j : j + n] for j in range(self.block)])
        shift = self.shift[self.slot(ends)]
        first = self.length - self.block  # block start of a pattern at word 0
        lane = np.linspace(first, n, min(LANES, n - first) + 1).astype(np.int64)
        cursor, stop, stops = lane[:-1], lane[1:], []
        while len(cursor):
            step = shift[cursor]
            stops.append(cursor[step == 0])
            cursor = cursor + np.maximum(step, 1)
            live = cursor < stop
            cursor, stop = cursor[live], stop[live]
        at = np.concatenate(stops) if stops else none
        lo, hi = np.searchsorted(self.suffix, ends[at], "left"), np.searchsorted(self.suffix, ends[at], "right")
        at, lo, hi = at[hi > lo], lo[hi > lo], hi[hi > lo]
        starts, found = [none], [none]
        while len(at):  # one candidate of every bucket at a time
            candidate = self.order[lo]
            begin = at - first
            same = np.ones(len(at), bool)
            for j in range(self.length):
                same &= words[begin + j] == self.patterns[candidate, j]
            starts.append(begin[same])
            found.append(candidate[same])
            lo = lo + 1
            at, lo, hi = at[lo < hi], lo[lo < hi], hi[lo < hi]
        return np.concatenate(starts), np.concatenate(found)


def item_patterns(batches: Iterator[pa.RecordBatch], window: int = WINDOW) -> Iterator[pa.RecordBatch]:
    """(item, pattern, spelt) rows of test items; a pattern is its word hashes, beside its words as bytes."""
    for batch in batches:
        items, patterns, spelt = [], [], []
        ids = batch.column(0).to_pylist()
        for block in blocks(batch.column(1)):
            w = Words(block, ALPHANUMERIC)
            for i in range(len(block)):
                h = w.hash[w.first[i] : w.first[i + 1]]
                size = min(window, len(h))
                for j in range(len(h) - size + 1 if size else 0):
                    items.append(ids[block.lo + i])
                    patterns.append(h[j : j + size].tobytes())
                    at = slice(w.first[i] + j, w.first[i] + j + size)
                    spelt.append(b" ".join([w.data[a:b].tobytes() for a, b in zip(w.start[at].tolist(), w.end[at].tolist())]))
        yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(patterns, pa.binary()), pa.array(spelt, pa.binary())], names=["item", "pattern", "spelt"])


class Finder:
    """The machines of one block of patterns and the items that hold each pattern."""

    def __init__(self, rows: list[tuple[bytes, bytes, list[str]]]):
        self.machines = []
        for size in sorted({len(p) for p, _, _ in rows}):
            own = [r for r in rows if len(r[0]) == size]
            words = np.frombuffer(b"".join(p for p, _, _ in own), np.uint64).reshape(len(own), size // 8)
            self.machines.append((Machine(words, [s for _, s, _ in own]), [items for _, _, items in own]))

    def __call__(self, batches: Iterator[pa.RecordBatch], text_at: int, schema: pa.Schema, keep: list[int]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_hit, items, spans = [], [], [], []
            for block in blocks(batch.column(text_at)):
                w = Words(block, ALPHANUMERIC)
                total = np.diff(w.first)
                step = np.zeros(len(w.hash) + 1, np.int32)
                own: list[set] = [set() for _ in range(len(block))]
                for machine, holders in self.machines:
                    at, which = machine.occurrences(w)
                    np.add.at(step, at, 1)
                    np.add.at(step, at + machine.length, -1)
                    pairs = np.unique(np.stack([w.text[at], which]), axis=1) if len(at) else np.zeros((2, 0), np.int64)
                    for text, pattern in pairs.T:
                        own[text].update(holders[pattern])
                hit = np.cumsum(step[:-1]) > 0
                cum = np.concatenate([[0], np.cumsum(hit)])
                n_words += total.tolist()
                n_hit += (cum[w.first[1:]] - cum[w.first[:-1]]).tolist()
                for i in range(len(block)):
                    a, b = w.first[i], w.first[i + 1]
                    if cum[b] == cum[a]:
                        items.append([]), spans.append([])
                        continue
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit[a:b], [False]]).astype(np.int8)))
                    spans.append([{"start": int(s), "stop": int(e)} for s, e in edge.reshape(-1, 2)])
                    items.append(sorted(own[i]))
            made = [pa.array(x, schema.field(n).type) for n, x in (("n_words", n_words), ("n_hit", n_hit), ("item_ids", items), ("hit_spans", spans))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *made], schema=schema)


def pattern_blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, size: int) -> Iterator[list[tuple[bytes, bytes, list[str]]]]:
    """Distinct patterns with the items that hold them, in blocks that never exceed ``size`` patterns."""
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).cast("string").alias("text"))
    pairs = rows.mapInArrow(lambda it: item_patterns(it, window), "item string, pattern binary, spelt binary").distinct()
    held = written(pairs.groupBy("pattern", "spelt").agg(F.sort_array(F.collect_set("item")).alias("items")), "patterns")
    total = held.count()
    if total == 0:
        yield []
    parts = min(total, 1) if total <= size else -(-2 * total // size)  # a hash slice then holds half the size on average
    for part in range(parts):
        block = held if parts == 1 else held.filter(F.pmod(F.xxhash64("pattern"), F.lit(parts)) == part)
        yield [(bytes(r["pattern"]), bytes(r["spelt"]), list(r["items"])) for r in block.toLocalIterator()]


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                  window: int = WINDOW, patterns: int = PATTERNS) -> DataFrame:
    """All columns of ``docs`` plus ``n_words``, ``n_hit``, ``item_ids`` (sorted), ``hit_spans`` (word ranges) and
    ``contaminated`` (5 % of the words or more are hit)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    added = StructType(_parse_datatype_string(FOUND).fields)
    names = [f.name for f in added] + ["contaminated"]
    docs = docs.drop(*[c for c in docs.columns if c.lower() in names])
    sets = pattern_blocks(benchmark, item_id, item_text, window, patterns)
    first, second = next(sets), next(sets, None)

    def searched(rows: DataFrame, keep: list[str], block) -> DataFrame:
        finder = rows.sparkSession.sparkContext.broadcast(Finder(block))
        full = StructType([*(rows.schema[c] for c in keep), *added.fields])
        places, at, schema = [rows.columns.index(c) for c in keep], rows.columns.index(text), to_arrow_schema(full)
        return rows.mapInArrow(lambda it: finder.value(it, at, schema, places), full)

    if second is None:
        out = searched(docs, docs.columns, first)
    else:
        # Several blocks: rows are numbered once, found by their number in each block, and the hits of a number united.
        numbered = written(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")
        found = None
        for block in (first, second, *sets):
            hits = written(searched(numbered.select(ROW, text), [ROW], block).filter("n_hit > 0"), "hits")
            found = hits if found is None else found.unionByName(hits)
        counts = searched(numbered, numbered.columns, []).drop("n_hit", "item_ids", "hit_spans")
        none = {"n_hit": F.lit(0).cast("bigint"), "item_ids": F.array().cast("array<string>"), "hit_spans": F.array().cast(added["hit_spans"].dataType)}
        joined = counts.join(united(found), ROW, "left")
        out = joined.select(*docs.columns, "n_words", *[F.coalesce(F.col(c), other).alias(c) for c, other in none.items()])
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


ROW = "_searched_row"


def united(found: DataFrame) -> DataFrame:
    """Hits of several pattern blocks per row number: spans and items are united."""
    got = found.groupBy(ROW).agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("item_ids"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("hit_spans")))).alias("_spans"))
    merged = F.expr("""aggregate(_spans, cast(array() as array<struct<start:bigint,stop:bigint>>), (acc, s) ->
        CASE WHEN size(acc) > 0 AND element_at(acc, -1).stop >= s.start
             THEN concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start, 'stop', greatest(element_at(acc, -1).stop, s.stop))))
             ELSE concat(acc, array(s)) END)""")
    got = got.withColumn("hit_spans", merged).withColumn("n_hit", F.expr("aggregate(hit_spans, 0L, (a, s) -> a + s.stop - s.start)"))
    return got.select(ROW, "n_hit", "item_ids", "hit_spans")


def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = contamination(docs, table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


OP10_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
pat AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[s : s + least(13, len(w)) - 1], ' ') AS p
  FROM (SELECT *, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM pat),
win AS (
  SELECT doc_id, k, s, array_to_string(w[s : s + k - 1], ' ') AS p
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM dw, sizes WHERE len(w) >= k)),
occ AS (SELECT win.doc_id, win.k, win.s, pat.item_id FROM win JOIN pat USING (k, p)),
hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + k)) AS at FROM (SELECT DISTINCT doc_id, k, s FROM occ)) GROUP BY doc_id),
itm AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM occ) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN itm USING (doc_id)"""
