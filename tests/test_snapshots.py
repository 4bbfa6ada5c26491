"""Bucketed versions, pinned readers, full replacement and windows that end."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from echolens import schemas
from echolens.operators import merge
from echolens.operators.danmaku import tone_windows
from echolens.plans.tables import LEXICON
from echolens.session import run_dir
from echolens.sources.snapshots import Snapshots
from echolens.streaming import jobs

KIND = "k bigint, v string"


def table(spark, buckets=8):
    return Snapshots(spark, run_dir(spark, "snap"), spark.createDataFrame([], KIND).schema, ["k"], buckets)


def put(current, batch):
    return current.join(batch.select("k"), "k", "left_anti").unionByName(batch)


def rows(df):
    return sorted(map(tuple, df.collect()))


def files(root):
    return {os.path.join(at, n) for at, _, names in os.walk(root) for n in names if n.endswith(".parquet")}


def test_untouched_buckets_keep_their_files(spark):
    t = table(spark)
    t.replace(spark.range(1000).select(F.col("id").alias("k"), F.lit("old").alias("v")))
    first = t.manifest(1)["buckets"]
    assert len(first) == 8
    before = {f: os.stat(f).st_mtime_ns for f in files(t.root)}
    assert t.merge(put, spark.createDataFrame([(5, "new"), (5000, "new")], KIND), 2) <= 2
    second = t.manifest(2)["buckets"]
    changed = {b for b in second if first.get(b) != second[b]}
    assert 1 <= len(changed) <= 2
    assert {f: os.stat(f).st_mtime_ns for f in before} == before
    got = dict(rows(t.read()))
    assert len(got) == 1001 and got[5] == got[5000] == "new" and got[6] == "old"
    assert dict(rows(t.read(1)))[5] == "old"


def test_a_repeated_batch_and_an_empty_one_change_nothing(spark):
    t = table(spark)
    t.merge(put, spark.createDataFrame([(1, "a"), (2, "b")], KIND), 1)
    held = files(t.root)
    assert t.merge(put, spark.createDataFrame([(1, "z")], KIND), 1) == 0
    assert files(t.root) == held and rows(t.read()) == [(1, "a"), (2, "b")]
    t.merge(put, spark.createDataFrame([], KIND), 2)
    assert files(t.root) == held and t.manifest(2)["buckets"] == t.manifest(1)["buckets"]
    assert rows(table(spark).read()) == []


def test_merges_equal_merging_whole_tables(spark):
    r, t, want = random.Random(1), table(spark, 5), {}
    for version in range(1, 6):
        batch = {r.randrange(40): str(r.random()) for _ in range(r.randrange(1, 12))}
        t.merge(put, spark.createDataFrame(list(batch.items()), KIND), version)
        want |= batch
    assert dict(rows(t.read())) == want


def test_a_failed_merge_leaves_the_old_version(spark):
    t = table(spark)
    t.replace(spark.createDataFrame([(1, "a")], KIND))

    def broken(current, batch):
        return put(current, batch).withColumn("v", F.raise_error(F.lit("lost")))

    with pytest.raises(Exception, match="lost"):
        t.merge(broken, spark.createDataFrame([(1, "b")], KIND), 2)
    assert t.versions() == [1] and rows(t.read()) == [(1, "a")]
    t.merge(put, spark.createDataFrame([(1, "b")], KIND), 2)
    assert rows(t.read()) == [(1, "b")]
    with pytest.raises(ValueError, match="key"):
        t.merge(lambda current, batch: spark.range(50).select(F.col("id").alias("k"), F.lit("b").alias("v")), spark.createDataFrame([(1, "b")], KIND), 3)
    assert t.versions() == [1, 2]


def test_a_second_writer_of_a_version_is_refused(spark):
    t = table(spark)
    made = t._write(spark.createDataFrame([(1, "a")], KIND), 1, 1)
    t._commit(1, made)
    with pytest.raises(RuntimeError, match="another writer"):
        t._commit(1, {})
    assert rows(t.read()) == [(1, "a")]


def test_pinned_versions_outlive_expiry(spark):
    t = table(spark)
    for version in range(1, 5):
        t.merge(put, spark.createDataFrame([(i, f"{version}") for i in range(version, 40)], KIND), version)
    old = t.read(2)
    t.pin("report", 2)
    assert t.expire(keep=1) == [1, 3] and t.versions() == [2, 4]
    assert dict(rows(old))[20] == "2" and dict(rows(t.read()))[20] == "4"
    t.unpin("report")
    assert t.expire(keep=1) == [2]
    assert files(t.root) == {f for p in t.manifest(4)["buckets"].values() for f in files(p)}
    with pytest.raises(ValueError):
        t.pin("report", 2)


VECTORS = schemas.EMBEDDINGS


def vector_rows(spark, ids, model="m-1"):
    return spark.createDataFrame([(i, model, 2, [1.0, 0.0], datetime(2024, 1, 1)) for i in ids], VECTORS)


def test_full_replacement_is_all_or_nothing(spark):
    comments = spark.range(20).withColumn("content", F.lit("x"))
    t = Snapshots(spark, run_dir(spark, "vec"), spark.createDataFrame([], VECTORS).schema, ["comment_id"], 4)
    merge.replace_all_vectors(t, comments, vector_rows(spark, range(20)))
    t.pin("search", 1)
    with pytest.raises(ValueError, match="every comment"):
        merge.replace_all_vectors(t, comments, vector_rows(spark, [i for i in range(20) if i != 13], "m-2"))
    with pytest.raises(ValueError, match="one model"):
        merge.replace_all_vectors(t, comments, vector_rows(spark, range(10), "m-2").union(vector_rows(spark, range(10, 20), "m-3")))
    lost = vector_rows(spark, range(20), "m-2").withColumn("dim", F.when(F.col("comment_id") == 7, F.raise_error(F.lit("executor lost"))).otherwise(F.col("dim")).cast("int"))
    with pytest.raises(Exception, match="executor lost"):
        merge.replace_all_vectors(t, comments, lost)
    assert t.versions() == [1] and {r["model"] for r in t.read().collect()} == {"m-1"}
    merge.replace_all_vectors(t, comments, vector_rows(spark, range(20), "m-2"))
    assert {r["model"] for r in t.read().collect()} == {"m-2"} and {r["model"] for r in t.read(1).collect()} == {"m-1"}


DM = "id bigint, video_id string, content string, progress int, posted_at timestamp_ntz"
DAY = datetime(2024, 1, 1)


def counted(df):
    return {(r["video_id"], r["window"]): (r["volume"], r["praise"], r["criticize"]) for r in df.collect()}


def test_windows_end_and_late_rows_are_counted_beside(spark):
    w = jobs.EndingWindows(spark, run_dir(spark, "ending"), LEXICON, "2 days", buckets=2)
    batches = [
        [(1, "v", "ing", 3, DAY), (2, "v", "er", 40, DAY)],
        [(3, "v", "zz", 3, DAY + timedelta(days=5)), (4, "u", "ing", 3, None)],
        [(5, "v", "er", 45, DAY), (6, "v", "ing", 3, DAY + timedelta(days=5)), (7, None, "x", None, DAY + timedelta(days=9))],
        [],
    ]
    for n, batch in enumerate(batches):
        for _ in range(2):  # every batch runs twice
            w.body(spark.createDataFrame(batch, DM), n)
    assert counted(w.output("late")) == {("v", 1): (1, 0, 1)}
    closed = sorted((r["video_id"], r["window"], r["volume"]) for r in w.output("closed").collect())
    assert closed == [("u", 0, 1), ("v", 0, 3), ("v", 1, 1)]
    assert counted(w.open.read()) == {(None, None): (1, 0, 0)}
    every = spark.createDataFrame(sum(batches, []), DM)
    assert counted(w.totals()) == counted(tone_windows(every, LEXICON))


def test_state_stays_constant_over_a_thousand_windows(spark):
    w = jobs.EndingWindows(spark, run_dir(spark, "ending"), LEXICON, "1 hour", buckets=2)
    sizes, every = [], None
    for n in range(10):  # a hundred new windows a batch, an hour a batch
        batch = spark.range(200).select(
            "id", F.lit("v").alias("video_id"), F.lit("ing").alias("content"), (30 * (n * 100 + F.col("id") % 100)).cast("int").alias("progress"),
            F.lit(DAY + timedelta(hours=2 * n)).cast("timestamp_ntz").alias("posted_at"))
        w.body(batch, n)
        sizes.append(w.open.read().count())
        every = batch if every is None else every.unionByName(batch)
    assert sizes == [100] * 10
    assert w.open.versions() == [9, 10]
    want = counted(tone_windows(every, LEXICON))
    assert len(want) == 1000 and counted(w.totals()) == want
