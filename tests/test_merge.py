"""Merge semantics: lifecycle of a comment, in-batch duplicates, null-safe keys, refused partial input."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from echolens import schemas
from echolens.operators import filters, incremental, merge

T1, T2 = datetime(2024, 1, 1), datetime(2024, 1, 2)


def stamp(t):
    return F.lit(t).cast("timestamp_ntz")


def raw(spark, *rows):
    """(source_id, content, likes, replies, extra, arrival)"""
    return spark.createDataFrame(
        [("steam", s, "730", c, None, None, 1, "en", likes, replies, None, x, a) for s, c, likes, replies, x, a in rows],
        schemas.RAW_COMMENTS + ", arrival int")


def empty(spark):
    return spark.createDataFrame([], schemas.COMMENTS)


def test_lifecycle(spark):
    first = merge.upsert_comments(empty(spark), raw(spark, ("1", "a", None, None, '{"appid": "9"}', 0)), stamp(T1))
    r = first.first()
    assert (r["likes"], r["likes_refreshed_at"], r["target_id"], r["fetched_at"]) == (None, None, "steam:9", T1)
    labelled = first.withColumn("topic", F.lit("X")).withColumn("likes", F.lit(3)).withColumn("likes_refreshed_at", stamp(T1))
    # A rerun without counts keeps them, with their stamp; analysis stays; the text is replaced.
    again = merge.upsert_comments(labelled, raw(spark, ("1", "b", None, None, None, 0)), stamp(T2)).first()
    assert (again["content"], again["topic"], again["likes"], again["likes_refreshed_at"], again["fetched_at"]) == ("b", "X", 3, T1, T2)
    # A refresh replaces counts and stamps both; a null reply under its key still counts as looked at.
    fresh = merge.upsert_comments(labelled, raw(spark, ("1", "b", 0, 2, '{"developer_response": null}', 0)), stamp(T2)).first()
    assert (fresh["likes"], fresh["replies"], fresh["likes_refreshed_at"], fresh["developer_response_refreshed_at"]) == (0, 2, T2, T2)


def test_replies_alone_stamp_only_known_rows(spark):
    new = merge.upsert_comments(empty(spark), raw(spark, ("1", "a", None, 4, None, 0)), stamp(T1))
    assert new.first()["likes_refreshed_at"] is None
    assert merge.upsert_comments(new, raw(spark, ("1", "a", None, 4, None, 0)), stamp(T2)).first()["likes_refreshed_at"] == T2


def test_last_of_a_batch_wins(spark):
    batch = raw(spark, *[("1", f"v{i}", None, None, None, i) for i in (2, 0, 1)], ("2", "x", None, None, None, 3)).repartition(4)
    got = merge.upsert_comments(empty(spark), batch, stamp(T1)).collect()
    assert {r["source_id"]: r["content"] for r in got} == {"1": "v2", "2": "x"}
    kept = merge.first_seen(batch, merge.KEY, "arrival").collect()
    assert {r["source_id"]: r["content"] for r in kept} == {"1": "v0", "2": "x"}


def test_ids_do_not_depend_on_partitioning(spark):
    batch = raw(spark, *[(str(i), "c", None, None, None, i) for i in range(50)])
    ids = lambda b: {(r["source_id"], r["id"]) for r in merge.upsert_comments(empty(spark), b, stamp(T1)).collect()}
    assert ids(batch) == ids(batch.repartition(7))


def test_danmaku_keys(spark):
    schema = "id bigint, video_id string, progress int, content string, user_hash string"
    stored = spark.createDataFrame([(1, "v", None, "hi", ""), (2, "v", None, "hi", "")], schema)
    batch = spark.createDataFrame(
        [(3, "v", None, "　hi ", None), (4, "v", 5, "hi", None), (5, "v", 5, "hi ", ""), (6, "v", 5, " 　", "u")], schema)
    got = merge.insert_danmaku(stored, batch).collect()
    assert [(r["id"], r["content"], r["user_hash"]) for r in got] == [(4, "hi", "")]


def test_partial_vector_replacement_is_refused(spark):
    comments = spark.createDataFrame([(1,), (2,)], "id bigint")
    vector = lambda *ids: spark.createDataFrame([(i, "m") for i in ids], "comment_id bigint, model string")
    with pytest.raises(ValueError):
        merge.replace_vectors(comments, vector(1))
    mixed = spark.createDataFrame([(1, "m"), (2, "n")], "comment_id bigint, model string")
    with pytest.raises(ValueError):
        merge.replace_vectors(comments, mixed)
    assert merge.replace_vectors(comments, vector(1, 2)).count() == 2


def test_time_window_edges(spark):
    rows = spark.createDataFrame([(1, T1), (2, T2), (3, None)], "id int, t timestamp_ntz")
    ids = lambda a, b: [r["id"] for r in rows.filter(filters.within(F.col("t"), a, b)).orderBy("id").collect()]
    assert ids(T1, T2) == [1] and ids(T1, None) == [1, 2] and ids(None, T2) == [1, 3] and ids(None, None) == [1, 2, 3]


def test_bounds_and_slices(spark):
    stored = spark.createDataFrame([("a", T2)], "target_id string, posted_at timestamp_ntz")
    targets = spark.createDataFrame([("a", 1), ("new", None)], "target_id string, count int")
    bounds = incremental.lower_bounds(targets, stored)
    assert {r["target_id"]: r["posted_after"] for r in bounds.collect()} == {"a": T1, "new": None}
    remote = spark.createDataFrame(
        [(1, "a", datetime(2023, 12, 31)), (2, "a", T1), (3, "a", T2), (4, "new", None), (5, "new", T1)], "id bigint, target_id string, posted_at timestamp_ntz")
    assert sorted(r["id"] for r in incremental.slices(remote, bounds).collect()) == [3, 4, 5]


def test_one_failed_stage_does_not_stop_the_rest():
    errors = []
    assert incremental.isolated("a", lambda: 1 / 0, errors) is None
    assert incremental.isolated("b", lambda: 7, errors) == 7
    assert errors == [("a", "division by zero")]


def test_purge_keeps_unknown_language(spark):
    rows = spark.createDataFrame([(1, None, T2), (2, "de", T2), (3, "en", T1), (4, "en", T2)], "id int, language string, posted_at timestamp_ntz")
    assert [r["id"] for r in filters.retained(rows, T1, "en").orderBy("id").collect()] == [1, 4]


def test_quote_spans_and_replacement(spark):
    comments = empty(spark).unionByName(spark.createDataFrame(
        [(1, "steam", "1", "手感😀很好")], "id bigint, platform string, source_id string, content string"), allowMissingColumns=True)
    labels = spark.createDataFrame([(1, "positive", 0.5, 0.5, "X", []), (9, "positive", 0.5, 0.5, "X", [])],
        "id bigint, sentiment string, sentiment_score double, sentiment_confidence double, topic string, sub_topics array<string>")
    new = spark.createDataFrame(
        [(1, 0, "a/b/c", " POSITIVE", "0.5", "很好", None, None), (1, 1, "a/b/c", "odd", "nan?", "没有", None, None), (1, 2, " ", "positive", "1", "很好", None, None),
         (9, 0, "a/b/c", "positive", "1", "很好", None, None), (1, 3, "a/b/c", None, "2", "手感", 7, 9)],
        "comment_id bigint, pos int, full_path string, sentiment string, sentiment_confidence string, quote string, quote_start int, quote_end int")
    old = spark.createDataFrame([(5, 1, "old", None, None, "q", None, None, None), (6, 2, "old", None, None, "q", None, None, None)], schemas.OPINIONS)
    _, got = merge.replace_analysis(comments, old, labels, new, stamp(T1))
    rows = {(r["comment_id"], r["quote"], r["sentiment"], r["sentiment_confidence"], r["quote_start"], r["quote_end"]) for r in got.collect()}
    assert rows == {(2, "q", None, None, None, None), (1, "很好", "positive", 0.5, 3, 5), (1, "没有", "neutral", None, None, None), (1, "手感", "neutral", None, 7, 9)}


def test_a_quote_is_searched_once(spark):
    """Start and end come from one search of the content, in the optimised plan too."""
    from pyspark.sql import functions as F

    from echolens.functions import text as tx

    rows = spark.createDataFrame(
        [(1, "bb", "abbabb", None, None), (2, "", "ab", None, None), (3, "x", None, None, None), (4, None, "ab", None, None), (5, "b", "ab", 7, 9), (6, "😀b", "a😀b", None, 5)],
        "id int, quote string, content string, s int, e int")
    spans = tx.with_quote_span(rows, F.col("quote"), F.col("content"), F.col("s"), F.col("e"))
    got = spans.select("id", "quote_start", "quote_end")
    assert sorted(map(tuple, got.collect())) == [(1, 1, 3), (2, 0, 0), (3, None, None), (4, None, None), (5, 7, 9), (6, 1, 3)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("instr(") == 1
