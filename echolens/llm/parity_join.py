"""N-gram Jaccard join by parity sketches.

A document is the set of its distinct five-word shingles, each a 64-bit hash. Two sets of sizes a and b link when
100 * |A and B| >= 80 * |A or B|; then at most (a + b) / 9 shingles are in one of them only.

**Sketch.** A shingle belongs to one part of the sketch; a part holds the XOR of its shingles. A shingle in both sets
leaves no trace in the comparison, so no more parts differ than shingles do: the number of differing parts (the Hamming
distance over parts) is a lower bound of the symmetric difference. Documents of 2**p to 2**(p+1) shingles form size band
p, whose sketch has 2**p parts; below ``SMALL`` shingles every shingle is a part of its own. A document with a partner
in the next band up also joins there.

**Pigeonhole.** At most d = floor(n / 4) parts can differ from any partner of a document with n shingles. Walk the
non-empty parts of both documents in one order: before the first part that both share, each part differs, so that part
is among the first d + 1 of either. These d + 1 parts are the document's join keys. The order puts parts of frequent
shingles last (frequency from a counting sketch over all documents; it steers cost, never results), so common passages
seldom become keys.

**Hamming test.** A second sketch of parity bits per document, ``BITS`` and at least one per shingle, tests every
candidate pair inside the join: if more bits differ than shingles may, the pair is dropped without its sets. Sketches of
different length are compared at the shorter one's: the halves of the longer, one XORed on the other, are its sketch there.

**Verification.** Each document is first compared, on full shingle sets, with one pivot: of the documents it shares a
key with, the one that shares most keys with others (in a group of near copies, the original). Keys that exactly the
same sets share propose the same pairs, so they are one key. What is linked forms components. Components that still
share a key are compared by one delegate each, twice; at last all members of one key that are in different components
are compared with each other. So each candidate pair is either compared or already connected, and a group of copies
costs its size, not its square.
Documents with equal sets are one class from the start.

Cases: null, empty and word-less text has an empty set and links with nothing; with fewer than five words the whole
sequence is the one shingle; repeated documents are one class; rows that share a doc_id are one node of the graph; a
null doc_id takes no part and is its own (null) component; texts of any length are read whole; an empty table gives no
row. Other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .components import components
from .frames import checked, table, written
from .ragged import mix, shingle_sets

K, PERCENT = 5, 80
SMALL = 64
CELL_BITS, SEGMENT = 21, 1 << 15
BITS = 2048  # parity bits of a set of up to so many shingles; larger ones have up to two per shingle
DELEGATE_ROUNDS = 2  # cost only: what they leave apart is compared in full


def common_cells(texts: DataFrame) -> np.ndarray:
    """Cells of a counting sketch (2**21 cells, of fixed size) that hold far more documents than the mean cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << CELL_BITS, np.int64)
        for batch in batches:
            for s in shingle_sets(batch.column(0), K):
                np.add.at(total, (s >> np.uint64(64 - CELL_BITS)).astype(np.int64), 1)
        segments = [zlib.compress(x.tobytes(), 1) for x in total.reshape(-1, SEGMENT)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(segments)), pa.int32()), pa.array(segments, pa.binary())], names=["segment", "cells"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for segment, cells in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(zlib.decompress(cells.as_buffer()), np.int64)
                sums[segment] = sums[segment] + part if segment in sums else part
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in sums.values()], pa.binary())], names=["segment", "cells"])

    kind = "segment int, cells binary"
    rows = texts.mapInArrow(run, kind).repartition(16, "segment").mapInArrow(add, kind).toArrow()  # 64 segments in all
    total = np.zeros((1 << CELL_BITS) // SEGMENT * SEGMENT, np.int64).reshape(-1, SEGMENT)
    for segment, cells in zip(rows["segment"].to_pylist(), rows["cells"].to_pylist()):
        total[segment] = np.frombuffer(zlib.decompress(cells), np.int64)
    total = total.reshape(-1)
    return total > 2 * total.mean() + 64


def join_keys(s: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Keys of one document's set: its first d + 1 parts in its own band and, where a partner may be there, the next."""
    n = len(s)
    d, band = n // 4, max(n.bit_length() - 1, SMALL.bit_length() - 2)
    bands = [band] if 5 * n < 4 * (2 << band) else [band, band + 1]
    late = common[(s >> np.uint64(64 - CELL_BITS)).astype(np.int64)].astype(np.uint64)
    place = mix(s ^ np.uint64(0x5DEECE66D))
    out = []
    for p in bands:
        if 1 << p < SMALL:  # single shingles, ordinary ones first
            values = s[np.lexsort((place, late))][: d + 1]
            parts = np.zeros(len(values), np.uint64)
        else:
            part = (late << np.uint64(p)) | (place & np.uint64((1 << p) - 1))
            order = np.argsort(part, kind="stable")
            part = part[order]
            first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            values = np.bitwise_xor.reduceat(s[order], first)
            parts = part[first]
            live = values != 0
            values, parts = values[live][: d + 1], parts[live][: d + 1]
            if len(values) <= d:
                raise ValueError(f"{n} shingles fill only {len(values)} parts of band {p}")  # below chance by many orders
        out.append(mix(values + mix(parts + np.uint64(p << 48))))
    return np.concatenate(out)


SIZES = "doc bigint, n int, f1 bigint, f2 bigint, class bigint, bits array<bigint>"
SEEN = 1 << 20  # classes a task remembers having sent


def parity_bits(s: np.ndarray) -> np.ndarray:
    """Bit i is the parity of the number of shingles whose hash falls on i, as 64-bit words. Fewer bits than shingles
    would differ in half of the bits at most, less than large sets may, and so drop nothing."""
    size = max(BITS, 1 << (len(s) - 1).bit_length())
    count = np.bincount((mix(s ^ np.uint64(0x27BB2EE6)) & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return np.packbits((count & 1).astype(np.uint8)).view("<i8")


def digest(s: np.ndarray) -> tuple[np.uint64, np.uint64, np.uint64]:
    """128-bit digest of a set, and both halves and the size in one number: the set's class."""
    if not len(s):
        return np.uint64(0), np.uint64(0), np.uint64(0)
    f1, f2 = mix(s).sum(dtype=np.uint64), mix(s ^ np.uint64(0xA5A5A5A5)).sum(dtype=np.uint64)
    return f1, f2, mix(np.array([f1], np.uint64) + mix(np.array([f2], np.uint64)) + np.uint64(len(s)))[0]


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, set size, digest of the set, class, parity bits)."""
    for batch in batches:
        n, digests, bits = [], [], []
        for s in shingle_sets(batch.column(1), K):
            n.append(len(s))
            digests.append(digest(s))
            bits.append(parity_bits(s))
        f1, f2, cls = zip(*digests) if digests else ((), (), ())
        as_long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), as_long(f1), as_long(f2), as_long(cls), pa.array(bits, pa.list_(pa.int64()))], names=["doc", "n", "f1", "f2", "class", "bits"])


def keys_of(texts: DataFrame, common: np.ndarray) -> DataFrame:
    """(key, class) of every set; a task sends the keys of equal sets once, as long as it remembers their class."""
    held = texts.sparkSession.sparkContext.broadcast(np.packbits(common))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = np.unpackbits(held.value).astype(bool)
        seen: set[int] = set()
        for batch in batches:
            keys, ids = [], []
            for s in shingle_sets(batch.column(0), K):
                own = digest(s)[2]
                if len(s) and int(own) not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(int(own))
                    k = join_keys(s, frequent)
                    keys.append(k)
                    ids.append(np.full(len(k), own).view(np.int64))
                if sum(map(len, keys[-1:])) and len(keys) >= 256:
                    yield _key_batch(keys, ids)
                    keys, ids = [], []
            if keys:
                yield _key_batch(keys, ids)

    return texts.mapInArrow(run, "key bigint, class bigint")


def _key_batch(keys: list[np.ndarray], ids: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(ids))], names=["key", "class"])


def merged_keys(shared: DataFrame) -> DataFrame:
    """(key, class, keys): keys with the same classes become one key, ``keys`` of them. Near copies share most of their
    keys, which all propose the same pairs. A chance collision only proposes more pairs than needed."""
    by_class = Window.partitionBy("key").orderBy("class")
    once = shared.withColumn("before", F.lag("class").over(by_class)).filter("before IS NULL OR before <> class")
    same = once.withColumn("same", F.bit_xor(F.xxhash64("class")).over(Window.partitionBy("key")))
    return same.groupBy(F.col("same").alias("key"), "class").agg(F.count("*").alias("keys"))


def linked(s: np.ndarray, t: np.ndarray) -> bool:
    """Whether two sorted sets link."""
    if not len(s) or not len(t):
        return False
    both = int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum())
    return 100 * both >= PERCENT * (len(s) + len(t) - both)


def verified(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that link, by their full sets; each set is computed once and sent to the b's it meets."""
    meets = pairs.select(F.col("a").alias("doc"), F.col("b").alias("group")).unionByName(pairs.select(F.col("b").alias("doc"), F.col("b").alias("group")))
    meets = written(meets.groupBy("doc").agg(F.collect_set("group").alias("groups")), "meets")
    near = texts.join(checked(meets, 8 * F.size("groups") + 8), "doc").select("doc", "text", "groups")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["group", "member", "doc", "set"]
        for batch in batches:
            ids, groups = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for doc, own, s in zip(ids, groups, shingle_sets(batch.column(1), K)):
                raw = s.tobytes()
                for low in range(0, len(own), 64):
                    part = own[low : low + 64]
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([g != doc for g in part]), pa.array([doc] * len(part), pa.int64()), pa.array([raw] * len(part), pa.binary())], names=names)

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, pivots = None, []  # several where a key has several texts
        for batch in batches:
            a, b = [], []
            sets = batch.column(3)
            for i, (g, member, doc) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                s = np.frombuffer(sets[i].as_buffer(), np.uint64)
                if not member:
                    pivots = [*(pivots if g == group else []), s.copy()]
                    group = g
                elif any(linked(s, pivot) for pivot in pivots):
                    a.append(doc)
                    b.append(group)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    sent = near.mapInArrow(send, "group bigint, member boolean, doc bigint, set binary")
    width = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = sent.repartition(width, "group").sortWithinPartitions("group", "member", "doc")
    return dealt.mapInArrow(test, "a bigint, b bigint")


def may_link(x: str, y: str):
    """Size and Hamming test of two rows (n, least, bits): false only for pairs that cannot link."""
    sizes = (5 * F.col(f"{x}.n") >= 4 * F.col(f"{y}.least")) & (5 * F.col(f"{y}.n") >= 4 * F.col(f"{x}.least"))
    width = F.least(F.size(f"{x}.bits"), F.size(f"{y}.bits"))  # sizes within 4 : 5 differ by one doubling at most

    def folded(bits: Column) -> Column:
        halves = F.zip_with(F.slice(bits, F.lit(1), width), F.slice(bits, width + 1, width), lambda a, b: a.bitwiseXOR(b))
        return F.when(F.size(bits) > width, halves).otherwise(bits)

    differ = F.aggregate(F.zip_with(folded(F.col(f"{x}.bits")), folded(F.col(f"{y}.bits")), lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda total, b: total + b)
    # A key with several texts (least < n) has the bits of one of them only.
    return sizes & ((9 * differ <= F.col(f"{x}.n") + F.col(f"{y}.n")) | (F.col(f"{x}.least") < F.col(f"{x}.n")) | (F.col(f"{y}.least") < F.col(f"{y}.n")))


def similar_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, n_shingles, component) of every row; component is the smallest key reachable by links."""
    texts = docs.select(F.col(key).cast("bigint").alias("doc"), F.col(text).cast("string").alias("text"))
    sizes = written(texts.mapInArrow(_sizes, SIZES), "sets")
    texts = texts.filter("doc IS NOT NULL")
    live = sizes.filter("doc IS NOT NULL AND n > 0")
    same = live.groupBy("f1", "f2", "n").agg(F.min("doc").alias("rep"))
    known = live.select("doc", "n", "f1", "f2").join(same, ["f1", "f2", "n"]).select("doc", F.struct("f1", "f2", "n").alias("class"), "rep")
    # A doc_id with several different texts stands for itself; its edges (doc, rep) connect its classes.
    several = F.min("class") != F.max("class")
    nodes = known.groupBy("doc").agg(F.when(several, F.col("doc")).otherwise(F.min("rep")).alias("rep"), F.collect_set("rep").alias("reps"), several.alias("several"))
    nodes = written(nodes, "nodes")
    equal = nodes.select(F.col("doc").alias("a"), F.explode("reps").alias("b")).filter("a <> b")
    stands = nodes.filter("doc = rep").select("doc", "several")
    sketch = live.select("doc", "n", "bits").join(stands, "doc").groupBy("doc").agg(
        F.max("n").alias("n"), F.when(F.first("several"), F.lit(0)).otherwise(F.max("n")).alias("least"), F.first("bits").alias("bits"))

    # Equal sets have one class and one representative: a key that only they share is of no use.
    keys = keys_of(texts.select("text"), common_cells(texts.select("text")))
    of_key = Window.partitionBy("key")
    shared = keys.withColumn("lo", F.min("class").over(of_key)).withColumn("hi", F.max("class").over(of_key)).filter("lo < hi").select("key", "class")
    classes = live.groupBy("class").agg(F.min("doc").alias("doc"))
    members = written(merged_keys(shared).join(classes, "class").groupBy("key", "doc").agg(F.max("keys").alias("keys")), "members")
    score = members.withColumn("many", F.count("*").over(of_key)).groupBy("doc").agg(F.sum(F.col("many") * F.col("keys")).alias("score"))
    ranked = members.join(score, "doc").withColumn("pivot", F.max(F.struct("score", (-F.col("doc")).alias("doc"))).over(of_key))
    ranked = ranked.filter("pivot.doc <> -doc").groupBy("doc").agg(F.max("pivot").alias("pivot"))
    first = written(ranked.select(F.col("doc").alias("a"), (-F.col("pivot.doc")).alias("b")), "pivots")
    sketch = written(sketch.join(members.select("doc").distinct(), "doc", "left_semi"), "sketches")
    x, y = sketch.select(F.col("doc").alias("a"), F.struct("n", "least", "bits").alias("x")), sketch.select(F.col("doc").alias("b"), F.struct("n", "least", "bits").alias("y"))
    pairs = first.join(x, "a").join(y, "b").filter(may_link("x", "y")).select("a", "b")
    links = written(verified(texts, written(pairs, "candidates")).unionByName(equal), "links")
    group = written(components(links), "components")

    # Groups that still share a key meet by one delegate each, before their members do.
    tried = first.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    rank = F.struct("score", (-F.col("doc")).alias("doc"))
    for _ in range(DELEGATE_ROUNDS):
        of_group = _apart(members, group).join(score, "doc").groupBy("key", "component").agg(F.max(rank).alias("delegate"))
        meet = of_group.withColumn("pivot", F.max("delegate").over(of_key)).filter("delegate.doc <> pivot.doc")
        meet = meet.select((-F.least("delegate.doc", "pivot.doc")).alias("a"), (-F.greatest("delegate.doc", "pivot.doc")).alias("b")).distinct()
        meet = written(meet.join(tried, ["a", "b"], "left_anti").select("a", "b"), "delegates")
        pairs = meet.join(x, "a").join(y, "b").filter(may_link("x", "y")).select("a", "b")
        links = written(verified(texts, written(pairs, "candidates")).unionByName(links), "links")
        group, tried = written(components(links), "components"), tried.unionByName(meet)

    # All members of one key that are still apart.
    left = written(_apart(members, group).join(sketch, "doc"), "apart")
    x, y = left.alias("x"), left.alias("y")
    more = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.component") < F.col("y.component")) & may_link("x", "y"))
    more = more.select(F.greatest("x.doc", "y.doc").alias("a"), F.least("x.doc", "y.doc").alias("b")).distinct()
    more = written(more.join(tried, ["a", "b"], "left_anti"), "residual")
    group = components(links.unionByName(written(verified(texts, more), "more-links")))

    per_row = sizes.select("doc", F.col("n").cast("bigint").alias("n_shingles"))
    return per_row.join(group.withColumnRenamed("id", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))


def _apart(members: DataFrame, group: DataFrame) -> DataFrame:
    """(key, doc, component) of the members of keys that more than one component shares."""
    placed = members.join(group.withColumnRenamed("id", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    several = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("key")
    return placed.join(several, "key")


def op7(spark: SparkSession, folder: str) -> DataFrame:
    found = similar_groups(table(spark, folder, "documents"))
    return found.select(F.col("doc").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS hits FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * hits >= 80 * (x.n + y.n - hits)),
r AS (SELECT a AS id, b AS reached FROM l UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.reached),
c AS (SELECT id, min(reached) AS low FROM r GROUP BY id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(c.low, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.id = w.doc_id"""
