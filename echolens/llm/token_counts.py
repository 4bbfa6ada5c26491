"""Token counts by separator scan over flat, unindexed token files.

A token file is a plain run of ids, documents ended by a separator id, with no index. It is read as equal blocks of
``BLOCK_IDS`` ids cut without regard to documents: rows (file, block, payload). Each block is searched for the
separator with one vectorised comparison. A two-level prefix scan (blocks within a stretch of ``STRETCH`` blocks, then
stretches within a file) carries the ids and separators before each block and the start of the document left open, so
documents that cross any number of blocks are stitched together and no task sees more than a stretch of block sums.

Cases: an empty document (two separators in a row) counts 0; ids after the last separator are one more document with
``closed`` false; a file that ends in a separator has none; an empty table has no row; ids are never separators in
the query, as special strings are encoded as ordinary text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .frames import table, written
from .library_ids import byte_bpe, encoder, groups

BLOCK_IDS = 1 << 18
STRETCH = 1024
SEPARATOR = 50256
BLOCKS = "file int, block bigint, payload binary, first_doc bigint, doc_ids array<bigint>"


def write_flat(docs: DataFrame, path: str, separator: int, key: str = "doc_id", text: str = "text", label: str = "flat") -> DataFrame:
    """Encode documents into one flat file per input partition: 16-bit ids where they fit, else 32-bit.

    The only trace of the documents is their order: rows with ``doc_ids`` name them, ``first_doc`` onwards.
    """
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, file = encoder(path, True), TaskContext.get().partitionId()
        kind = np.dtype("<u2") if max(encode.vocab_size, separator + 1) <= 1 << 16 else np.dtype("<u4")
        end = np.array([separator], kind).tobytes()
        size, held, block, docs_before = BLOCK_IDS * kind.itemsize, bytearray(), 0, 0

        def row(payload, keys) -> pa.RecordBatch:
            values = [[file], [block if payload is not None else None], [payload], [docs_before if keys is not None else None], [keys]]
            kinds = [pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names=[c.split()[0] for c in BLOCKS.split(", ")])

        for batch in batches:
            for _, texts in groups(batch.column(1)):
                for ids in encode.many(texts):
                    held += np.frombuffer(ids, "<u4").astype(kind).tobytes() + end
                while len(held) >= size:
                    yield row(bytes(held[:size]), None)
                    del held[:size]
                    block += 1
            yield row(None, batch.column(0).to_pylist())
            docs_before += batch.num_rows
        if held:
            yield row(bytes(held), None)

    return written(rows.mapInArrow(run, BLOCKS), label)


def scan(blocks: DataFrame, separator: int, id_bytes: int) -> DataFrame:
    """Per block: ids, and the positions of the separators."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(x.as_buffer(), f"<u{id_bytes}") for x in batch.column(2)]
            ends = pa.array([np.flatnonzero(x == separator).astype(np.int32) for x in ids], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) for x in ids], pa.int64()), ends], names=["file", "block", "n_ids", "ends"])

    return blocks.select("file", "block", "payload").mapInArrow(run, "file int, block bigint, n_ids bigint, ends array<int>")


def documents(found: DataFrame) -> DataFrame:
    """(file, ordinal, start, n_tokens, closed) of every document; ``n_tokens`` is without the separator."""
    found = written(found, "separators")
    sums = found.select("file", "block", "n_ids", F.size("ends").cast("bigint").alias("n_ends"),
                        F.expr("CASE WHEN size(ends) > 0 THEN CAST(element_at(ends, -1) AS BIGINT) END").alias("last"),
                        F.floor(F.col("block") / STRETCH).alias("stretch"))
    inner = Window.partitionBy("file", "stretch").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("file").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    local = sums.withColumns({
        "ids_in": F.coalesce(F.sum("n_ids").over(inner), F.lit(0)), "ends_in": F.coalesce(F.sum("n_ends").over(inner), F.lit(0))})
    local = local.withColumn("last_in", F.max(F.col("ids_in") + F.col("last")).over(inner))
    stretches = local.groupBy("file", "stretch").agg(
        F.sum("n_ids").alias("n_ids"), F.sum("n_ends").alias("n_ends"), F.max(F.col("ids_in") + F.col("last")).alias("last"))
    stretches = stretches.withColumns({
        "ids_out": F.coalesce(F.sum("n_ids").over(outer), F.lit(0)), "ends_out": F.coalesce(F.sum("n_ends").over(outer), F.lit(0))})
    stretches = stretches.withColumn("last_out", F.max(F.col("ids_out") + F.col("last")).over(outer))
    carried = local.join(stretches.select("file", "stretch", "ids_out", "ends_out", "last_out"), ["file", "stretch"]).select(
        "file", "block", (F.col("ids_in") + F.col("ids_out")).alias("ids_before"), (F.col("ends_in") + F.col("ends_out")).alias("ends_before"),
        (F.coalesce(F.col("last_in") + F.col("ids_out"), F.col("last_out"), F.lit(-1)) + 1).alias("open_at"))
    placed = found.join(carried, ["file", "block"])
    each = placed.select("file", "ids_before", "ends_before", "open_at", "ends", F.posexplode("ends").alias("k", "end"))
    closed = each.select(
        "file", (F.col("ends_before") + F.col("k")).alias("ordinal"),
        F.when(F.col("k") == 0, F.col("open_at")).otherwise(F.col("ids_before") + F.expr("ends[k - 1]") + 1).alias("start"),
        (F.col("ids_before") + F.col("end")).alias("stop"))
    closed = closed.select("file", "ordinal", "start", (F.col("stop") - F.col("start")).alias("n_tokens"), F.lit(True).alias("closed"))
    whole = stretches.groupBy("file").agg(F.sum("n_ids").alias("n_ids"), F.sum("n_ends").alias("ordinal"), (F.coalesce(F.max(F.col("ids_out") + F.col("last")), F.lit(-1)) + 1).alias("start"))
    rest = whole.filter("n_ids > start").select("file", "ordinal", "start", (F.col("n_ids") - F.col("start")).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(rest)


def op2(spark: SparkSession, folder: str, path: str | None = None) -> DataFrame:
    path = path or byte_bpe()
    flat = write_flat(table(spark, folder, "documents"), path, SEPARATOR)
    counts = documents(scan(flat.filter("payload IS NOT NULL"), SEPARATOR, 2))
    names = flat.filter("doc_ids IS NOT NULL").select("file", "first_doc", F.posexplode("doc_ids").alias("k", "doc_id"))
    names = names.select("file", (F.col("first_doc") + F.col("k")).alias("ordinal"), "doc_id")
    return names.join(counts, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "start", "n_tokens")
