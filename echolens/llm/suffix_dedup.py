"""Suffix-array dedup: removes every byte covered by a 50-byte string that also starts in a document with a smaller id.

The suffixes of all documents are sorted by a distributed merge sort that exchanges front-coded runs and never compares
a known common prefix again. A full suffix array of 100 TB would not fit any cluster, so the array is sparse, without
losing a match: every 50-byte string names one of its 24-byte strings, the one with the smallest hash, as its anchor.
Equal strings have equal anchors, so it is enough to sort the suffixes that start at anchors (one byte in 14), each with
the up to 26 bytes to its left that its strings may reach.

1. ``shared_anchors``: anchors that occur in one document only cannot match; hash counts drop them (exact: a hash
   collision only keeps one too many).
2. ``runs_of``: each task sorts the suffixes at the remaining anchors, cut at 50 bytes, in runs of about ``RUN`` bytes
   of text. Equal records of a run become one with the smallest document (a hot passage costs a run one record). Runs
   are front-coded (common prefix with the record before, then the rest) and dealt by anchor hash.
3. ``merge``: a loser tree merges the runs of a partition. A head whose common prefix with the last output is longer
   wins without a look at its bytes; only heads of equal prefix are compared, beyond it. Neighbours that share 24 bytes
   or more form an anchor group, in which the 50-byte strings are matched and the first document of each is found.
4. ``spans_of``: answers go back to the run that holds the members of the record, where byte spans are united.

Cases: null or empty text has no byte and loses none; texts of fewer than 50 bytes are kept; equal ids do not remove
from each other, whatever their texts; a row without id neither removes nor loses; periodic and very long texts are
searched whole; an empty table gives no row; other columns pass through, result columns replace any of the same name.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from .frames import checked, give_back, table, written
from .ragged import Block, blocks, mix, prefix, span_hash

LENGTH, ANCHOR = 50, 24
REACH = LENGTH - ANCHOR + 1  # anchor positions within a string
RUN = 16 << 20  # bytes of text per sorted run
SHARE = 32 << 20  # bytes of text whose anchors one counting task takes
PART = 16 << 20  # bytes of text whose suffixes one merge task takes
SLICE = 20_000  # records resolved, or decoded, at a time
KEY_BITS = 40


def segments(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal stretches of neighbouring strings with one anchor hash: text, first start, last start, hash; then the hash
    of the 24 bytes at every position, and the prefix sums."""
    data, n = block.data, len(block.data)
    h = prefix(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none, np.zeros(0, np.uint64), np.zeros(0, np.uint64), h
    at = np.arange(n - ANCHOR + 1)
    grams = span_hash(h, at, at + ANCHOR)
    low, width = grams, 1
    while 2 * width <= REACH:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < REACH:
        low = np.minimum(low[: len(low) - (REACH - width)], low[REACH - width :])
    sizes = np.diff(block.starts)
    counts = np.maximum(sizes - LENGTH + 1, 0)
    owner = np.repeat(np.arange(len(block)), counts)
    start = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(block.starts[:-1], counts)
    key = low[start]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(key)) - 1 if len(first) else none
    return owner[first], start[first], start[last], key[first], grams, h


def short(key: np.ndarray) -> np.ndarray:
    """The part of an anchor hash that is exchanged when anchors are counted."""
    return key >> np.uint64(64 - KEY_BITS)


def _bytes5(x: np.ndarray) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _from5(x) -> np.ndarray:
    out = np.zeros((len(x) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(x, np.uint8).reshape(-1, 5)
    return out.reshape(-1).view("<u8")


def shared_anchors(texts: DataFrame, parts: int) -> DataFrame:
    """(doc, sign, keys): the anchors of a document that occur in another document too; ``texts`` is (doc, sign, text)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "docs", "signs", "keys", "owners"]
        kinds = [pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        for batch in batches:
            docs, signs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for block in blocks(batch.column(2), 2 << 20):
                for low in range(0, len(block), 1 << 16):
                    cut = block.starts[low : low + (1 << 16) + 1]
                    part_block = Block(block.lo + low, block.data[cut[0] : cut[-1]], cut - cut[0])
                    owner, _, _, key, _, _ = segments(part_block)
                    key = short(key)
                    key, owner = _distinct(key, owner)
                    part = (key % np.uint64(parts)).astype(np.int64)
                    order = np.argsort(part, kind="stable")
                    at = np.searchsorted(part[order], np.arange(parts + 1))
                    for p in range(parts):
                        mine = order[at[p] : at[p + 1]]
                        if len(mine):
                            used, local = np.unique(owner[mine], return_inverse=True)
                            values = [[p], [docs[used + part_block.lo]], [signs[used + part_block.lo]], [_bytes5(key[mine])], [local.astype("<u2").tobytes()]]
                            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names=names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, docs, signs = [], [], []
        for batch in batches:
            for i in range(batch.num_rows):
                local = np.frombuffer(batch.column(4)[i].as_buffer(), "<u2")
                keys.append(_from5(batch.column(3)[i].as_buffer()))
                docs.append(batch.column(1)[i].values.to_numpy()[local])
                signs.append(batch.column(2)[i].values.to_numpy()[local])
        if not keys:
            return
        key, doc, sign = np.concatenate(keys), np.concatenate(docs), np.concatenate(signs)
        del keys, docs, signs
        order = np.argsort(key, kind="stable")
        key, doc, sign = key[order], doc[order], sign[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        several = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
        live = np.repeat(several, np.diff(np.append(first, len(key))))
        key, doc, sign = key[live], doc[live], sign[live]
        # A row per bucket of documents, not per document: the rows stay few however many parts a document spans.
        bucket = (mix(doc.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        at = np.searchsorted(bucket[order], np.arange(parts + 1))
        for b in range(parts):
            mine = order[at[b] : at[b + 1]]
            if len(mine):
                values = [[b], [doc[mine].tobytes()], [sign[mine].tobytes()], [_bytes5(key[mine])]]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, [pa.int32()] + [pa.binary()] * 3)], names=["bucket", "docs", "signs", "keys"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in batch.to_pylist()]
        if not rows:
            return
        doc, sign = (np.frombuffer(b"".join(r[n] for r in rows), "<i8") for n in ("docs", "signs"))
        key = _from5(b"".join(r["keys"] for r in rows))
        del rows
        order = np.lexsort((sign, doc))
        key, doc, sign = key[order], doc[order], sign[order]
        first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (sign[1:] != sign[:-1])]))
        ends = np.append(first[1:], len(key))
        for low in range(0, len(first), 10_000):
            a, b = first[low : low + 10_000], ends[low : low + 10_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc[a]), pa.array(sign[a]), pa.array([_bytes5(key[i:j]) for i, j in zip(a, b)], pa.binary())], names=["doc", "sign", "keys"])

    rows = texts.mapInArrow(emit, "part int, docs array<bigint>, signs array<bigint>, keys binary, owners binary")
    found = rows.repartition(parts, "part").mapInArrow(count, "bucket int, docs binary, signs binary, keys binary")
    return found.repartition(parts, "bucket").mapInArrow(gather, "doc bigint, sign bigint, keys binary")


def _distinct(key: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (key, owner) pairs, by key."""
    order = np.lexsort((owner, key))
    key, owner = key[order], owner[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    return key[new], owner[new]


RUNS = "part int, run bigint, common binary, sizes binary, tails binary, left_sizes binary, lefts binary, docs binary, records binary, member_docs binary, member_signs binary, starts binary, windows binary"


def runs_of(live: DataFrame, parts: int) -> DataFrame:
    """Front-coded sorted runs (rows with ``part``) and the members of each run's records (rows without)."""
    names = [c.split()[0] for c in RUNS.split(", ")]
    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 11]

    def row(**given) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([given.get(n)], k) for n, k in zip(names, kinds)], names=names)

    def build(held: list[tuple[int, int, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        run = int.from_bytes(os.urandom(8), "little", signed=True)
        seen: dict[str, list[np.ndarray]] = {k: [] for k in ("doc", "sign", "start", "windows", "key", "left", "size", "rows", "mark")}
        for block, docs, signs, keys in _live_blocks(held):
            owner, low, high, key, grams, h = segments(block)
            own = np.zeros(len(key), bool)
            cut = np.searchsorted(owner, np.arange(len(block) + 1))
            for i, k in enumerate(keys):
                own[cut[i] : cut[i + 1]] = np.isin(short(key[cut[i] : cut[i + 1]]), k)
            owner, low, high, key = owner[own], low[own], high[own], key[own]
            while len(low):
                last = np.full(len(low), -1)
                for step in range(REACH):  # the rightmost place of the anchor in the first string
                    last = np.where(grams[low + step] == key, low + step, last)
                stop = np.minimum(high, last)
                at = last[:, None] + np.arange(LENGTH)
                size = stop + LENGTH - last
                suffix = block.data[np.minimum(at, len(block.data) - 1)]
                suffix[np.arange(LENGTH) >= size[:, None]] = 0
                back = low[:, None] + np.arange(REACH - 1)
                left = block.data[back]
                left[np.arange(REACH - 1) >= (last - low)[:, None]] = 0
                for name, x in (("doc", docs[owner]), ("sign", signs[owner]), ("start", low - block.starts[owner]), ("windows", stop - low + 1), ("key", key),
                                ("left", last - low), ("size", size), ("rows", np.concatenate([suffix, left], axis=1)), ("mark", span_hash(h, low, stop + LENGTH))):
                    seen[name].append(x)
                more = high > stop
                owner, low, high, key = owner[more], stop[more] + 1, high[more], key[more]
        if not seen["key"]:
            return
        x = {k: np.concatenate(v) for k, v in seen.items()}
        # Equal records: same bytes (by hash and length) around the same anchor.
        order = np.lexsort((x["doc"], x["left"], x["size"], x["mark"]))
        x = {k: v[order] for k, v in x.items()}
        new = np.ones(len(order), bool)
        new[1:] = (x["mark"][1:] != x["mark"][:-1]) | (x["size"][1:] != x["size"][:-1]) | (x["left"][1:] != x["left"][:-1])
        record = np.cumsum(new) - 1
        at = np.flatnonzero(new)  # the smallest document comes first
        yield row(run=run, records=record.astype("<u4").tobytes(), member_docs=x["doc"].astype("<i8").tobytes(), member_signs=x["sign"].astype("<i8").tobytes(),
                  starts=x["start"].astype("<i8").tobytes(), windows=x["windows"].astype("<u1").tobytes(), docs=x["doc"][at].astype("<i8").tobytes())
        part = (x["key"][at] % np.uint64(parts)).astype(np.int64)
        suffixes = np.ascontiguousarray(x["rows"][at][:, :LENGTH])
        order = np.lexsort((suffixes.view(f"S{LENGTH}").reshape(-1), part))
        cut = np.searchsorted(part[order], np.arange(parts + 1))
        for p in range(parts):
            mine = order[cut[p] : cut[p + 1]]
            if len(mine):
                text, size, left = suffixes[mine], x["size"][at][mine], x["left"][at][mine]
                common = np.zeros(len(mine), np.int64)
                differs = np.concatenate([text[1:] != text[:-1], np.ones((len(mine) - 1, 1), bool)], axis=1)
                common[1:] = np.minimum(differs.argmax(axis=1), np.minimum(size[1:], size[:-1]))
                column = np.arange(LENGTH)
                tails = text[(column >= common[:, None]) & (column < size[:, None])]
                lefts = x["rows"][at][mine][:, LENGTH:][np.arange(REACH - 1) < left[:, None]]
                yield row(part=p, run=run, common=common.astype("<u1").tobytes(), sizes=size.astype("<u1").tobytes(), tails=tails.tobytes(),
                          left_sizes=left.astype("<u1").tobytes(), lefts=lefts.tobytes(), docs=x["doc"][at][mine].astype("<i8").tobytes(), records=mine.astype("<u4").tobytes())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column(2)[i].as_py().encode()
                held.append((batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), text, batch.column(3)[i].as_py()))
                size += len(text)
                if size >= RUN:
                    yield from build(held)
                    held, size = [], 0
        if held:
            yield from build(held)
        del held
        give_back()

    return live.mapInArrow(work, RUNS)


def _live_blocks(held: list) -> Iterator[tuple[Block, np.ndarray, np.ndarray, list[np.ndarray]]]:
    for block in blocks(pa.array([t for _, _, t, _ in held], pa.large_binary()), 2 << 20):
        rows = held[block.lo : block.lo + len(block)]
        yield block, np.array([d for d, _, _, _ in rows], np.int64), np.array([s for _, s, _, _ in rows], np.int64), [_from5(k) for _, _, _, k in rows]


class Run:
    """A front-coded run, decoded: suffixes as integers of 50 bytes, and the common prefix of neighbours."""

    def __init__(self, row: dict):
        self.run = row["run"]
        read = lambda name, kind: np.frombuffer(row[name], kind)
        self.common, self.size, self.left = read("common", "u1").astype(np.int64), read("sizes", "u1").astype(np.int64), read("left_sizes", "u1").astype(np.int64)
        self.docs, self.records = read("docs", "<i8"), read("records", "<u4")
        n, column = len(self.common), np.arange(LENGTH)
        own = (column >= self.common[:, None]) & (column < self.size[:, None])
        self.text = np.zeros((n, LENGTH), np.uint8)
        self.text[own] = read("tails", "u1")
        last = np.zeros((1, LENGTH), np.uint8)  # the record before, with its bytes beyond its size as they were last set
        for low in range(0, n, SLICE):
            part = np.concatenate([last, self.text[low : low + SLICE]])
            at = np.arange(1, len(part), dtype=np.int32)[:, None]
            source = np.maximum.accumulate(np.where(column >= self.common[low : low + SLICE, None], at, 0), axis=0)
            part = part[source, column]
            last = part[-1:].copy()
            self.text[low : low + SLICE] = np.where(column < self.size[low : low + SLICE, None], part, 0)
        self.lefts = np.zeros((n, REACH - 1), np.uint8)
        self.lefts[np.arange(REACH - 1) < self.left[:, None]] = read("lefts", "u1")
        raw = self.text.tobytes()
        self.numbers = [int.from_bytes(raw[i : i + LENGTH]) for i in range(0, len(raw), LENGTH)]
        self.shared = self.common.tolist()


def loser_tree(runs: list[Run]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge sorted runs: (run, place in the run, common prefix with the record before) in sorted order.

    Each head carries its common prefix with the last output. Of two heads the one with the longer prefix is smaller;
    with equal prefixes the bytes beyond decide, and the loser's prefix with the winner is remembered.
    """
    count = max(1, 1 << (len(runs) - 1).bit_length())
    bits, end = 8 * LENGTH, 1 << (8 * LENGTH + 1)  # the end mark is larger than any suffix
    numbers = [[*r.numbers, end] for r in runs] + [[end]] * (count - len(runs))
    shared = [[*r.shared, 0] for r in runs] + [[0]] * (count - len(runs))
    place, head, prefix_ = [0] * count, [x[0] for x in numbers], [0] * count

    def beats(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's prefix becomes the one it shares with the winner."""
        pa_, pb = prefix_[a], prefix_[b]
        if pa_ > pb:
            return a, b
        if pb > pa_:
            return b, a
        x, y = head[a], head[b]
        differ = x ^ y
        common = (bits - differ.bit_length()) >> 3 if differ < end else 0
        if x <= y:
            prefix_[b] = common
            return a, b
        prefix_[a] = common
        return b, a

    tree = [0] * count
    level = list(range(count))
    at = count
    while len(level) > 1:
        at //= 2
        winners = []
        for i in range(0, len(level), 2):
            w, tree[at + i // 2] = beats(level[i], level[i + 1])
            winners.append(w)
        level = winners
    top = level[0]
    total = sum(len(r.numbers) for r in runs)
    out_run, out_place, out_common = [0] * total, [0] * total, [0] * total
    for k in range(total):
        i = place[top]
        out_run[k], out_place[k], out_common[k] = top, i, prefix_[top]
        i += 1
        place[top], head[top], prefix_[top] = i, numbers[top][i], shared[top][i]
        if numbers[top][i] == end:
            prefix_[top] = -1
        node = (count + top) >> 1
        while node:
            other = tree[node]
            mine, theirs = prefix_[top], prefix_[other]
            if theirs > mine:
                tree[node], top = top, other
            elif theirs == mine:
                x, y = head[top], head[other]
                differ = x ^ y
                common = (bits - differ.bit_length()) >> 3 if differ < end else -1
                if y < x:
                    prefix_[top] = common
                    tree[node], top = top, other
                else:
                    prefix_[other] = common
            node >>= 1
    return np.array(out_run, np.int64), np.array(out_place, np.int64), np.array(out_common, np.int64)


FAN_IN = 256
ANSWERS = "run bigint, answers binary"


def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All runs of one partition to answers: per run the strings of its records that an earlier document holds."""
    by_part: dict[int, list[Run]] = {}
    give_back()
    for batch in batches:
        for r in batch.to_pylist():
            by_part.setdefault(r["part"], []).append(Run(r))
    while by_part:
        _, runs = by_part.popitem()
        run, place, common = merged(runs)
        # Per record in sorted order: its bytes, document and home.
        base = np.cumsum([0, *[len(r.numbers) for r in runs]])[run] + place
        take = lambda f: np.concatenate([f(r) for r in runs])[base]
        for r in runs:  # the tree is done with them
            r.numbers, r.shared = [], []
        text, lefts, size, left, docs, records = (take(f) for f in (lambda r: r.text, lambda r: r.lefts, lambda r: r.size, lambda r: r.left, lambda r: r.docs, lambda r: r.records))
        groups = np.flatnonzero(common < ANCHOR)
        cuts, low = [0], 0
        for g in groups.tolist():
            if g - low >= SLICE:
                cuts.append(g)
                low = g
        cuts.append(len(run))
        found: list[tuple[np.ndarray, ...]] = []
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                rec, lo, hi, first = earlier(text[a:b], lefts[a:b], size[a:b], left[a:b], docs[a:b])
                found.append((run[a:b][rec], records[a:b][rec], lo, hi, first))
        if not found:
            continue
        home, record, lo, hi, first = (np.concatenate(x) for x in zip(*found))
        for i, r in enumerate(runs):
            mine = home == i
            if mine.any():
                answer = np.stack([record[mine].astype(np.int64), lo[mine], hi[mine], first[mine]], axis=1).astype("<i8")
                yield pa.RecordBatch.from_arrays([pa.array([r.run], pa.int64()), pa.array([answer.tobytes()], pa.binary())], names=["run", "answers"])
        del runs, run, place, common, base, text, lefts, size, left, docs, records, groups, found, home, record, lo, hi, first
    give_back()


def merged(runs: list[Run]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The loser tree; beyond ``FAN_IN`` runs in rounds, so the tree stays small."""
    if len(runs) <= FAN_IN:
        return loser_tree(runs)
    parts = []
    for low in range(0, len(runs), FAN_IN):
        some = runs[low : low + FAN_IN]
        run, place, common = loser_tree(some)
        r = object.__new__(Run)
        r.numbers = [some[i].numbers[j] for i, j in zip(run, place)]
        r.shared, r.source = common.tolist(), (run + low, place)
        parts.append(r)
    run, place, common = merged(parts)
    pick = lambda k: np.array([parts[i].source[k][j] for i, j in zip(run, place)], np.int64)
    return pick(0), pick(1), common


def earlier(text: np.ndarray, lefts: np.ndarray, size: np.ndarray, left: np.ndarray, docs: np.ndarray):
    """Among records of whole anchor groups: (record, first string, last string + 1, document) where a document before
    the record's own holds the strings. Strings are counted from the record's left end."""
    n, total = len(size), left + size
    mask_left, mask_text = np.arange(REACH - 1) < left[:, None], np.arange(LENGTH) < size[:, None]
    flat = np.concatenate([lefts, text], axis=1)[np.concatenate([mask_left, mask_text], axis=1)]
    begin = np.cumsum(total) - total
    windows = total - LENGTH + 1
    owner = np.repeat(np.arange(n), windows)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = begin[owner] + offset
    h = prefix(flat)
    mark = span_hash(h, at, at + LENGTH)
    order = np.argsort(mark, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], mark[order][1:] != mark[order][:-1]]))
    least = np.minimum.reduceat(docs[owner][order], first)
    found = np.empty(len(owner), np.int64)
    found[order] = np.repeat(least, np.diff(np.append(first, len(owner))))
    hit = found < docs[owner]
    owner, offset, found = owner[hit], offset[hit], found[hit]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (offset[1:] != offset[:-1] + 1) | (found[1:] != found[:-1])
    a = np.flatnonzero(new)
    b = np.append(a[1:], len(owner)) - 1 if len(a) else a
    return owner[a], offset[a], offset[b] + 1, found[a]


SPANS = "doc bigint, sign bigint, starts array<bigint>, ends array<bigint>"


def spans_of(members: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    """One run: byte spans to remove, per document."""
    if not len(members):
        return pd.DataFrame({"doc": [], "sign": [], "starts": [], "ends": []})
    m = members.iloc[0]
    record = np.frombuffer(m["records"], "<u4").astype(np.int64)
    doc, sign = np.frombuffer(m["member_docs"], "<i8"), np.frombuffer(m["member_signs"], "<i8")
    start, windows, own = np.frombuffer(m["starts"], "<i8"), np.frombuffer(m["windows"], "u1").astype(np.int64), np.frombuffer(m["docs"], "<i8")
    later = doc > own[record]  # another document of this run holds the whole record
    parts = [(doc[later], sign[later], start[later], start[later] + windows[later] - 1 + LENGTH)]
    for answer in answers["answers"]:
        rec, lo, hi, first = np.frombuffer(answer, "<i8").reshape(-1, 4).T
        a, b = np.searchsorted(record, rec, "left"), np.searchsorted(record, rec, "right")
        which = np.repeat(np.arange(len(rec)), b - a)
        at = np.arange(len(which)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + a[which]
        keep = doc[at] > first[which]
        at, which = at[keep], which[keep]
        parts.append((doc[at], sign[at], start[at] + lo[which], start[at] + hi[which] - 1 + LENGTH))
    doc, sign, low, high = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((low, sign, doc))
    doc, sign, low, high = doc[order], sign[order], low[order], high[order]
    rows: dict[str, list] = {"doc": [], "sign": [], "starts": [], "ends": []}
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (sign[1:] != sign[:-1])])) if len(doc) else []
    for a, b in zip(new, np.append(new[1:], len(doc)) if len(new) else []):
        s, e = united(low[a:b], high[a:b])
        for name, x in (("doc", doc[a]), ("sign", sign[a]), ("starts", s), ("ends", e)):
            rows[name].append(x)
    return pd.DataFrame(rows)


def united(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of spans sorted by their start; touching spans become one."""
    reach = np.maximum.accumulate(high)
    new = np.concatenate([[True], low[1:] > reach[:-1]])
    at = np.flatnonzero(new)
    return low[at], reach[np.append(at[1:], len(low)) - 1]


ADDED = "kept binary, kept_text string, n_bytes bigint, n_removed bigint, n_spans bigint, removed array<struct<start:bigint,stop:bigint>>"


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``docs`` plus ``kept`` (remaining bytes), ``kept_text`` (without characters cut in two), ``n_bytes``, ``n_removed``, ``n_spans``, ``removed``."""
    names = [f.name for f in _parse_datatype_string(ADDED).fields]
    docs = docs.drop(*[c for c in docs.columns if c.lower() in [*names, "_doc", "_sign", "_starts", "_ends"]])
    docs = docs.withColumns({"_doc": F.col(key).cast("bigint"), "_sign": F.xxhash64(text)})
    texts = docs.filter(f"_doc IS NOT NULL AND octet_length(`{text}`) >= {LENGTH}").select(F.col("_doc").alias("doc"), F.col("_sign").alias("sign"), F.col(text).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    anchors = shared_anchors(texts, max(1, size // SHARE))
    live = texts.join(anchors, ["doc", "sign"]).select("doc", "sign", "text", "keys")
    parts = max(1, size // PART)
    runs = written(runs_of(live, parts), "suffix-runs")
    coded = runs.filter("part IS NOT NULL").select("part", "run", "common", "sizes", "tails", "left_sizes", "lefts", "docs", "records")
    answers = coded.repartition(parts, "part").mapInArrow(merge, ANSWERS)
    members = runs.filter("part IS NULL").select("run", "records", "member_docs", "member_signs", "starts", "windows", "docs")
    spans = members.groupBy("run").cogroup(answers.groupBy("run")).applyInPandas(spans_of, SPANS)
    spans = written(spans.dropDuplicates(["doc", "sign"]), "spans").select(F.col("doc").alias("_doc"), F.col("sign").alias("_sign"), F.col("starts").alias("_starts"), F.col("ends").alias("_ends"))
    joined = docs.join(checked(spans, 16 * F.size("_starts") + 16), ["_doc", "_sign"], "left").select(*docs.columns, "_starts", "_ends")
    at = joined.columns.index(text)
    first, last = joined.columns.index("_starts"), joined.columns.index("_ends")
    keep = [i for i, c in enumerate(joined.columns) if not c.startswith("_") or c in docs.columns and c not in ("_doc", "_sign")]
    schema = StructType([*(joined.schema.fields[i] for i in keep), *_parse_datatype_string(ADDED).fields])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            made: list[list] = [[] for _ in names]
            for value, starts, ends in zip(batch.column(at), batch.column(first).to_pylist(), batch.column(last).to_pylist()):
                raw = value.as_buffer().to_pybytes() if value.is_valid else b""
                starts, ends = starts or [], ends or []
                kept = b"".join(raw[a:b] for a, b in zip([0, *ends], [*starts, len(raw)]))
                for to, x in zip(made, (kept, kept.decode("utf-8", "ignore") if value.is_valid else None, len(raw), len(raw) - len(kept), len(starts), [{"start": a, "stop": b} for a, b in zip(starts, ends)])):
                    to.append(x)
            added = [pa.array(x, arrow.field(n).type) for x, n in zip(made, names)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *added], schema=arrow)

    return joined.mapInArrow(cut, schema)


def op8(spark: SparkSession, folder: str) -> DataFrame:
    found = deduplicated(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP8_SQL = """
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
s AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT *, unnest(range(0, n - 49)) AS p FROM d WHERE n >= 50)),
f AS (SELECT s, min(doc_id) AS first FROM s GROUP BY s),
m AS (SELECT s.doc_id, s.p, s.p - row_number() OVER (PARTITION BY s.doc_id ORDER BY s.p) AS g FROM s JOIN f USING (s) WHERE f.first < s.doc_id),
i AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM m GROUP BY doc_id, g),
j AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY doc_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM i),
k AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY a) AS g FROM j),
u AS (SELECT doc_id, g, min(a) AS a, max(b) AS b FROM k GROUP BY doc_id, g),
gap AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM u),
kept AS (
  SELECT d.doc_id, d.n, sum(gap.b - gap.a) AS n_removed, count(*) AS n_spans,
    string_agg(substr(d.h, 2 * before + 1, 2 * (gap.a - before)), '' ORDER BY gap.a) || substr(any_value(d.h), 2 * max(gap.b) + 1) AS hex
  FROM d JOIN gap USING (doc_id) GROUP BY d.doc_id, d.n)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept.hex, d.h))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""
