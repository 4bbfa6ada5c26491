"""Token-id output: fixed-width bit packing in blocks with offsets.

Format: a folder of Parquet files, one row per block, written by Spark (so a lost or repeated task leaves no half
file). A block holds whole documents in ascending key order, about ``BLOCK_IDS`` ids:

| column | content |
| --- | --- |
| shard, block | place of the block; shards ascend with the key, blocks ascend within a shard |
| bits, count | width of an id (the least that holds the vocabulary) and ids in the block |
| keys, ends | keys of the documents and the id offset at which each ends |
| payload | the ids, ``bits`` wide, in little-endian 64-bit words |

``unpack`` reads a block with a few numpy operations; ``take`` reads any range of ids without the rest.

Cases: null or empty text is stored as the end id alone; a null key sorts first; repeated keys are stored each, in
no fixed order among themselves; a text longer than a block is a block of its own; an empty table gives no block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .frames import table, written
from .library_ids import byte_bpe, encoder, groups

BLOCK_IDS = 1 << 16
FORMAT = "shard int, block int, bits int, count int, keys array<bigint>, ends array<int>, payload binary"


def width(vocab_size: int) -> int:
    """Fewest bits that hold every id below ``vocab_size``."""
    return max(1, (vocab_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Store ids ``bits`` wide; 64 ids fill ``bits`` words exactly, so groups of 64 are packed side by side."""
    groups = -(-len(ids) // 64)
    values = np.zeros(groups * 64, np.uint64)
    values[: len(ids)] = ids
    values = values.reshape(groups, 64)
    words = np.zeros((groups, bits), np.uint64)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        words[:, word] |= values[:, j] << np.uint64(shift)
        if shift + bits > 64:
            words[:, word + 1] |= values[:, j] >> np.uint64(64 - shift)
    return words.astype("<u8").tobytes()[: (len(ids) * bits + 63) // 64 * 8]


def take(payload: bytes, bits: int, low: int, high: int) -> np.ndarray:
    """Ids low..high of a block."""
    words = np.append(np.frombuffer(payload, "<u8"), np.uint64(0))
    at = np.arange(low, high, dtype=np.int64) * bits
    word, shift = at >> 6, (at & 63).astype(np.uint64)
    upper = np.where(shift > 0, words[np.minimum(word + 1, len(words) - 1)] << (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
    return ((words[word] >> shift | upper) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def unpack(payload: bytes, bits: int, count: int) -> np.ndarray:
    return take(payload, bits, 0, count)


def write(docs: DataFrame, path: str, end_id: int, key: str = "doc_id", text: str = "text", label: str = "packed") -> DataFrame:
    """Encode, append the end id, pack and write; returns the blocks as read back from the files."""
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("text"))
    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(shards, "key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard = encoder(path), TaskContext.get().partitionId()
        bits = width(max(encode.vocab_size, end_id + 1))
        end = np.array([end_id], "<u4").tobytes()
        keys, parts, ends, block = [], [], [0], 0

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(parts), "<u4")
            values = [[shard], [block], [bits], [len(ids)], [list(keys)], [ends[1:]], [pack(ids, bits)]]
            kinds = [pa.int32()] * 4 + [pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names=[c.split()[0] for c in FORMAT.split(", ")])

        for batch in batches:
            for low, texts in groups(batch.column(1)):
                for i, ids in enumerate(encode.many(texts), low):
                    if keys and ends[-1] + len(ids) // 4 + 1 > BLOCK_IDS:
                        yield flush()
                        keys, parts, ends, block = [], [], [0], block + 1
                    keys.append(batch.column(0)[i].as_py())
                    parts += ids, end
                    ends.append(ends[-1] + len(ids) // 4 + 1)
        if keys:
            yield flush()

    return written(ordered.mapInArrow(run, FORMAT), label)


def places(blocks: DataFrame) -> DataFrame:
    """(shard, block, first): the ids of all blocks before each block. Only counts are summed: per shard, then over the shards."""
    per_shard = blocks.groupBy("shard").agg(F.sum(F.col("count").cast("bigint")).alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard
    shard = per_shard.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_shard_first"))
    within = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    place = blocks.select("shard", "block", "count").withColumn("_block_first", F.coalesce(F.sum(F.col("count").cast("bigint")).over(within), F.lit(0)))
    place = place.join(F.broadcast(shard), "shard").select("shard", "block", (F.col("_shard_first") + F.col("_block_first")).alias("first"))
    return place


def read(blocks: DataFrame) -> DataFrame:
    """(key, shard, block, offset in the block, n_tokens, ids_crc32) of every stored document."""
    names = ["key", "shard", "block", "offset", "n_tokens", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(row["payload"], row["bits"], row["count"]).astype("<u4")
                ends = np.array(row["ends"], np.int64)
                starts = np.concatenate([[0], ends[:-1]])
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends)]
                n = len(ends)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["keys"], pa.int64()), pa.array([row["shard"]] * n, pa.int32()), pa.array([row["block"]] * n, pa.int32()),
                     pa.array(starts), pa.array(ends - starts), pa.array(crc, pa.int64())], names=names)

    return blocks.mapInArrow(run, "key bigint, shard int, block int, offset bigint, n_tokens bigint, ids_crc32 bigint")


def op3(spark: SparkSession, folder: str, path: str | None = None) -> DataFrame:
    blocks = write(table(spark, folder, "documents"), path or byte_bpe(), end_id=2)
    return read(blocks).join(places(blocks), ["shard", "block"]).select(
        F.col("key").alias("doc_id"), (F.col("first") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
