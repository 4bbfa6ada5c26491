"""Streams against their batch twins, the landing job, and vector properties."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from echolens import schemas
from echolens.operators import annotate, audit, merge, vectors
from echolens.operators.danmaku import tone_windows
from echolens.plans import daily
from echolens.plans.tables import LEXICON
from echolens.sources.snapshots import Snapshots
from echolens.streaming import jobs

NOW = datetime(2024, 3, 1)


def stamp():
    return F.lit(NOW).cast("timestamp_ntz")


def landing(spark, folder, batches, schema):
    """One file per batch, in order of modification time."""
    import os
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        for name in sorted(os.listdir(folder)):
            path = f"{folder}/{name}"
            if name.endswith(".parquet") and os.path.getmtime(path) > 1_000_000_000:
                os.utime(path, (1000 + i, 1000 + i))
    return jobs.read_landed(spark, folder, spark.createDataFrame([], schema).schema, files_per_trigger=1)


RAW = schemas.RAW_COMMENTS + ", arrival int"


def raw(source, content, likes, arrival):
    return ("steam", source, "730", content, None, None, None, "en", likes, None, None, None, arrival)


def test_stream_ingest_equals_sequential_merges(spark, tmp_path):
    batches = [[raw("1", "a", None, 0), raw("2", "b", None, 1), raw("1", "a2", 4, 2)], [raw("2", "b2", None, 3)], [raw("1", "a3", None, 4), raw("3", "c", 1, 5)]]
    stream = landing(spark, str(tmp_path / "in"), batches, RAW)
    empty = spark.createDataFrame([], schemas.COMMENTS)
    root, checkpoint = jobs.folders(spark, "t")
    got = jobs.finished(spark, jobs.ingest(stream, root, empty, stamp(), checkpoint), root, empty)
    want = empty
    for rows in batches:
        want = merge.upsert_comments(want, spark.createDataFrame(rows, RAW), stamp())
    key = lambda df: sorted(map(tuple, df.select("source_id", "content", "likes", "target_id", "likes_refreshed_at").collect()), key=str)
    assert key(got) == key(want) and Snapshots(spark, root, empty.schema).versions() == [1, 2, 3]


def test_a_repeated_batch_changes_nothing(spark):
    empty = spark.createDataFrame([], schemas.COMMENTS)
    root, _ = jobs.folders(spark, "r")
    body = jobs.merge_into(root, empty, lambda cur, b: merge.upsert_comments(cur, b, stamp()), merge.KEY)
    body(spark.createDataFrame([raw("1", "a", 2, 0)], RAW), 0)
    for _ in range(2):
        body(spark.createDataFrame([raw("1", "b", None, 0), raw("2", "c", None, 1)], RAW), 1)
    got = jobs.current_table(spark, root, empty)
    assert sorted((r["source_id"], r["content"], r["likes"]) for r in got.collect()) == [("1", "b", 2), ("2", "c", None)]


DM = "id bigint, video_id string, content string, progress int, user_hash string, posted_at timestamp_ntz"


def dm(i, content, progress, user="u", day=0):
    return (i, "v", content, progress, user, datetime(2024, 1, 1) + timedelta(days=day))


def test_tone_stream_equals_batch(spark, tmp_path):
    batches = [[dm(1, "ing", 3), dm(2, "er", 4), dm(3, "zz", 40)], [dm(4, "er", 5), dm(5, "ing", 99)]]
    stream = landing(spark, str(tmp_path / "in"), batches, DM)
    root, checkpoint = jobs.folders(spark, "t")
    jobs.tone_stream(stream, LEXICON, root, checkpoint).awaitTermination()
    want = tone_windows(spark.createDataFrame(sum(batches, []), DM), LEXICON)
    got = jobs.current_table(spark, root, want.limit(0))
    rows = lambda df: sorted((r["window"], r["volume"], r["praise"], r["criticize"]) for r in df.collect())
    assert rows(got) == rows(want) == [(0, 3, 1, 2), (1, 1, 0, 0), (3, 1, 1, 0)]


def test_danmaku_streams(spark, tmp_path):
    batches = [[dm(1, " a", 1), dm(2, "a", 1), dm(3, "", 1)], [dm(4, "a", 1), dm(5, "b", None)], [dm(6, "c", 1, day=9)], [dm(7, "d", 1, day=9)], [dm(8, "b", None, day=9)]]
    stream = landing(spark, str(tmp_path / "in"), batches, DM)
    root, checkpoint = jobs.folders(spark, "t")
    empty = spark.createDataFrame([], DM)
    got = jobs.finished(spark, jobs.danmaku_inserts(stream, root, empty, checkpoint), root, empty)
    assert sorted(r["id"] for r in got.collect()) == [1, 5, 6, 7]
    out, checkpoint = jobs.folders(spark, "d")
    result = jobs.deduplicated_danmaku(stream)
    jobs.append_files(result, out, checkpoint).awaitTermination()
    # Within the watermark a repeat is dropped; nine days later the key has been forgotten.
    assert sorted(r["content"] for r in spark.read.schema(result.schema).parquet(out).collect()) == ["a", "b", "b", "c", "d"]


def test_trend_drops_rows_behind_the_watermark(spark, tmp_path):
    # Spark judges lateness by the watermark of the batch before, hence the third batch.
    schema = "posted_at timestamp_ntz, target_id string, sentiment string"
    day = lambda n: datetime(2024, 1, n, 12)
    batches = [[(day(1), "t", "positive"), (day(1), "t", None)], [(day(8), "t", "positive")], [(day(8), "t", None)],
               [(day(1), "t", "positive"), (day(20), "t", "negative")]]
    stream = landing(spark, str(tmp_path / "in"), batches, schema)
    out, checkpoint = jobs.folders(spark, "t")
    result = jobs.daily_trend(stream)
    jobs.append_files(result, out, checkpoint).awaitTermination()
    got = {str(r["bucket"]): (r["total"], r["pos"]) for r in spark.read.schema(result.schema).parquet(out).collect()}
    assert got == {"2024-01-01": (2, 1), "2024-01-08": (2, 1)}


def test_landing_job(spark):
    empty, opinions = spark.createDataFrame([], schemas.COMMENTS), spark.createDataFrame([], schemas.OPINIONS)
    stored = spark.createDataFrame([], schemas.EMBEDDINGS)
    batch = spark.createDataFrame([raw("1", "thatin orre. fine", None, 0), raw("2", "x" * 50, None, 1), raw("1", "late copy", None, 2)], RAW)
    done = daily.land(batch, empty, opinions, stored, LEXICON, NOW, dim=64)
    assert done.errors == []
    got = {r["source_id"]: (r["content"], r["topic"], r["analyzed_at"]) for r in done.comments.collect()}
    assert got == {"1": ("thatin orre. fine", "Mechanics", NOW), "2": ("x" * 50, "Meta", NOW)}
    assert sorted(r["full_path"] for r in done.opinions.collect()) == ["Mechanics/Core/Combat", "Meta/Impression/Overall"]
    assert done.vectors.count() == 2
    log = done.log.first()
    assert (log["fetched"], log["inserted"], log["analyzed"], log["embedded"], log["ok"]) == (2, 2, 2, 2, True)
    # A second landing of the same rows inserts, embeds and labels nothing.
    again = daily.land(batch, done.comments, done.opinions, done.vectors, LEXICON, NOW, space=done.space)
    log = again.log.first()
    assert (log["fetched"], log["inserted"], log["analyzed"], log["embedded"]) == (2, 0, 0, 0)
    assert again.opinions.count() == 2


def test_a_failing_annotator_is_isolated(spark):
    def broken(df):
        raise RuntimeError("model away")

    batch = spark.createDataFrame([raw("1", "a", None, 0)], RAW)
    none = lambda s: spark.createDataFrame([], s)
    done = daily.land(batch, none(schemas.COMMENTS), none(schemas.OPINIONS), none(schemas.EMBEDDINGS), LEXICON, NOW, [broken], dim=16)
    assert done.errors == [("annotate", "steam:730: model away")]
    assert done.comments.count() == 1 and done.vectors.count() == 1 and done.opinions.count() == 0


def both(a, b):
    return ("steam", a, "730" if a < "5" else "bad", f"text {b}", None, None, None, "en", None, None, None, None, int(a))


def test_one_bad_target_does_not_stop_the_others(spark):
    none = lambda s: spark.createDataFrame([], s)
    rows = [(*both(str(i), i), "timeout" if i == 7 else None) for i in range(10)] + [("steam", " ", "9", *[None] * 9, 11, None), ("steam", "x", "8", *[None] * 8, "{", 12, None), (None, "y", "7", *[None] * 9, 13, None)]
    batch = spark.createDataFrame(rows, RAW + ", failure string")
    done = daily.land(batch, none(schemas.COMMENTS), none(schemas.OPINIONS), none(schemas.EMBEDDINGS), LEXICON, NOW, dim=16)
    assert sorted(r["source_id"] for r in done.comments.collect()) == list("01234") and done.errors == []
    assert done.counts == {"rows": 13, "failed": 4}
    log = {r["target_id"]: (r["ok"], r["fetched"], r["inserted"], r["analyzed"], r["embedded"], r["error"]) for r in done.log.collect()}
    assert log == {
        "steam:730": (True, 5, 5, 5, 5, None), "steam:bad": (False, 0, 0, 0, 0, "timeout"), "steam:9": (False, 0, 0, 0, 0, "no source id"),
        "steam:8": (False, 0, 0, 0, 0, "extras are no JSON"), "(unknown)": (False, 0, 0, 0, 0, "no platform")}
    held = sorted((r["source_id"], r["failure"]) for r in done.quarantine.filter("target_id = 'steam:bad'").collect())
    assert held == [(str(i), "timeout" if i == 7 else "held back: timeout") for i in range(5, 10)]


def test_an_annotator_that_fails_for_one_target(spark):
    def picky(df):
        assert_fine = F.when(F.contains("content", F.lit("poison")), F.raise_error(F.lit("cannot read"))).otherwise(F.col("content"))
        return annotate.lexicon_annotator(LEXICON)(df.withColumn("content", assert_fine))

    none = lambda s: spark.createDataFrame([], s)
    rows = [("steam", f"{t}-{i}", f"t{t}", "poison" if t == 3 and i == 1 else "thatin. fine", None, None, None, "en", None, None, None, None, 10 * t + i) for t in range(6) for i in range(3)]
    done = daily.land(spark.createDataFrame(rows, RAW), none(schemas.COMMENTS), none(schemas.OPINIONS), none(schemas.EMBEDDINGS), LEXICON, NOW, [picky], dim=16)
    log = {r["target_id"]: (r["ok"], r["fetched"], r["analyzed"], r["embedded"]) for r in done.log.collect()}
    assert log == {f"steam:t{t}": (t != 3, 3, 0 if t == 3 else 3, 3) for t in range(6)}
    assert len(done.errors) == 1 and done.errors[0][1].startswith("steam:t3: ") and "cannot read" in done.errors[0][1]
    todo = {r["target_id"] for r in done.comments.filter("analyzed_at IS NULL").collect()}
    assert todo == {"steam:t3"}  # next time again


def test_vectors_are_not_written_beside_another_space(spark):
    none = lambda s: spark.createDataFrame([], s)
    stored = spark.createDataFrame([(99, "old-model", 16, [0.0] * 16, NOW)], schemas.EMBEDDINGS)
    done = daily.land(spark.createDataFrame([raw("1", "a", None, 0)], RAW), none(schemas.COMMENTS), none(schemas.OPINIONS), stored, LEXICON, NOW, dim=16)
    assert [s for s, _ in done.errors] == ["vectors"] and "old-model" in done.errors[0][1]
    assert done.vectors.count() == 1 and done.comments.count() == 1 and done.opinions.count() == 1


def test_bullet_comments_land_and_fail_alone(spark):
    none = lambda s: spark.createDataFrame([], s)
    old = spark.createDataFrame([(1, "v", "c", "a", 1, 0, 0, "u", NOW, NOW)], schemas.DANMAKU)
    new = spark.createDataFrame([(2, "v", "c", " a", 1, 0, 0, "u", NOW, NOW), (3, "v", "c", "b", 1, 0, 0, None, NOW, NOW), (4, "v", "c", " ", 1, 0, 0, "u", NOW, NOW)], schemas.DANMAKU)
    args = (spark.createDataFrame([raw("1", "a", None, 0)], RAW), none(schemas.COMMENTS), none(schemas.OPINIONS), none(schemas.EMBEDDINGS), LEXICON, NOW)
    done = daily.land(*args, dim=16, bullets=new, danmaku=old)
    assert sorted((r["id"], r["user_hash"]) for r in done.danmaku.collect()) == [(1, "u"), (3, "")] and done.errors == []
    broken = new.withColumn("content", F.raise_error(F.lit("torn file")).cast("string"))
    done = daily.land(*args, dim=16, bullets=broken, danmaku=old)
    assert [s for s, _ in done.errors] == ["danmaku"] and done.danmaku.count() == 1 and done.comments.count() == 1


def test_prompts_and_replies_round_trip(spark):
    comments = spark.createDataFrame([(i, f"text {i}") for i in range(5)], "id bigint, content string")
    rows = {r["batch"]: r for r in annotate.prompt_batches(comments, size=3).collect()}
    assert rows[0]["batch_text"] == "[0] text 0\n[1] text 1\n[2] text 2" and rows[1]["ids"] == [3, 4] and rows[1]["batch_size"] == 2
    replies = spark.createDataFrame([(0, 3, '{"results": [{"index": 2, "sentiment": "Negative", "opinions": [{"phrase": "　p "}]}]}'), (1, 2, "sorry")],
                                    "batch bigint, batch_size int, response string")
    parsed = annotate.parse_responses(replies)
    assert [(r["batch"], r["idx"], r["sentiment"], len(r["opinions"])) for r in parsed.orderBy("batch", "idx").collect()] == [
        (0, 0, "neutral", 0), (0, 1, "neutral", 0), (0, 2, "negative", 1), (1, 0, "neutral", 0), (1, 1, "neutral", 0)]
    assert annotate.exploded_opinions(parsed, "batch").first()["phrase"] == "p"


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(
        [(1, "server lag disconnect"), (2, "great music"), (3, "lovely art and music"), (4, ""), (5, "lag lag server")], "id bigint, content string")


def test_vectors_have_unit_length_whatever_the_partitioning(spark, texts):
    got = lambda df: {r["id"]: [round(x, 5) for x in r["vector"]] for r in vectors.vectorise(df, "content", 64).collect()}
    one = got(texts)
    assert one == got(texts.repartition(4))
    norms = {i: round(sum(x * x for x in vec) ** 0.5, 3) for i, vec in one.items()}
    assert norms == {1: 1.0, 2: 1.0, 3: 1.0, 4: 0.0, 5: 1.0}


def test_search_finds_the_nearest(spark, texts):
    rows = vectors.vectorise(texts, "content", 256).withColumnRenamed("id", "comment_id")
    query = rows.filter("comment_id = 1").first()["vector"]
    got = vectors.semantic_search(rows, texts, query, 2).orderBy(F.desc("score")).collect()
    assert [r["comment_id"] for r in got] == [1, 5] and got[0]["score"] == 1.0


def test_search_keeps_ties_by_id_across_batches(spark):
    same = [(i, [1.0, 0.0]) for i in range(500)]
    rows = spark.createDataFrame(same, "comment_id bigint, vector array<float>").repartition(8)
    got = vectors.scored(rows, [1.0, 0.0], 5).orderBy(F.desc("score"), "comment_id").limit(5)
    assert [r["comment_id"] for r in got.collect()] == [0, 1, 2, 3, 4]


def test_micro_topics(spark, texts):
    rows = vectors.vectorise(texts, "content", 64)
    got = vectors.micro_topics(rows, k=2)
    labels = {r["id"]: r["label"] for r in got.collect()}
    assert set(labels.values()) == {-1, 0, 1} and len(labels) == 5 and labels[4] == -1  # the blank text has no direction
    assert sorted(r["label"] for r in vectors.micro_topics(rows, k=9).collect()) == [-1, 0, 1, 2, 3]


def test_search_refuses_another_space(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0])], "comment_id bigint, vector array<float>")
    with pytest.raises(Exception, match="more than one space"):
        vectors.scored(rows, [1.0, 0.0], 5).collect()


def test_anchored_takes_all_and_falls_back_to_the_content(spark):
    opinions = spark.createDataFrame([(i, i % 3, "A/B/C", "" if i == 5 else f"q{i}") for i in range(700)], "id bigint, comment_id bigint, full_path string, quote string")
    comments = spark.createDataFrame([(i, "t", f"content {i}") for i in range(3)], "id bigint, target_id string, content string")
    got = {r["id"]: r["quote"] for r in vectors.anchored(opinions, comments, "B").collect()}
    assert len(got) == 700 and got[5] == "content 2" and got[6] == "q6"
    assert vectors.anchored(opinions, comments, "B", limit=10).count() == 10


def test_one_space_for_two_landings(spark, texts, tmp_path):
    space = vectors.Space.fitted(texts, "content", "tfidf-1", 128, str(tmp_path))
    again = vectors.Space.load(spark, str(tmp_path), "tfidf-1")
    assert (again.name, again.dim) == ("tfidf-1", 128)
    get = lambda s, df: {r["id"]: list(r["vector"]) for r in s.vectors(df, "content").collect()}
    whole = get(space, texts)
    parts = get(again, texts.filter("id < 3")) | get(again, texts.filter("id >= 3"))
    assert parts == whole and any(x for x in parts[1])  # a landing of few rows has the weights of all
    with pytest.raises(Exception):
        vectors.Space.fitted(texts.filter("id = 1"), "content", "tfidf-1", 128, str(tmp_path))


def test_guard_and_search_refuse_another_model(spark):
    rows = spark.createDataFrame([(1, "a", 2, [1.0, 0.0]), (2, "b", 2, [0.0, 1.0]), (3, None, 2, [0.0, 1.0]), (4, "a", 3, [0.0, 1.0, 0.0])], "comment_id bigint, model string, dim int, vector array<float>")
    comments = spark.createDataFrame([(1, "x")], "id bigint, content string")
    assert {(r["model"], r["dim"], r["n"], r["ok"]) for r in vectors.guard(rows, "a", 2).collect()} == {("a", 2, 1, True), ("b", 2, 1, False), (None, 2, 1, False), ("a", 3, 1, False)}
    assert vectors.foreign(rows, "a") == ["(none)", "b"] and vectors.foreign(rows.filter("model = 'a'"), "a", 2) == ["a"]
    assert vectors.foreign(rows.limit(0), "a") == []
    with pytest.raises(ValueError, match="another model"):
        audit.single_space(rows, "a")
    with pytest.raises(Exception, match="more than one space"):  # equal length, other model
        vectors.semantic_search(rows.filter("dim = 2"), comments, [1.0, 0.0], 1, model="a").collect()
    with pytest.raises(Exception, match="more than one space"):
        vectors.semantic_search_many(rows.filter("dim = 2"), comments, rows.filter("comment_id = 1").selectExpr("1 AS query_id", "vector"), 1, model="a").collect()
    assert vectors.semantic_search(rows.filter("comment_id = 1"), comments, [1.0, 0.0], 1, model="a").count() == 1


@pytest.mark.parametrize("rows_n,queries_n,top", [(3000, 40, 7), (50, 600, 3), (4, 3, 9)])
def test_many_queries_against_every_product(spark, monkeypatch, rows_n, queries_n, top):
    import numpy as np

    monkeypatch.setattr(vectors, "ROW_BLOCK", 64)
    r = np.random.default_rng(rows_n)
    m = r.integers(-2, 3, (rows_n, 6)).astype(float)  # many ties
    q = r.integers(-2, 3, (queries_n, 6)).astype(float)
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "comment_id bigint, vector array<float>").repartition(5)
    asked = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "query_id bigint, vector array<float>")
    want = {(k, int(i)) for k, x in enumerate(q) for i in np.lexsort((np.arange(rows_n), -(m @ x)))[:top]}
    assert {(x["query_id"], x["comment_id"]) for x in vectors.many_scored(table, asked, top).collect()} == want
    monkeypatch.setattr(vectors, "QUERY_BYTES", 400)  # several passes
    assert {(x["query_id"], x["comment_id"]) for x in vectors.many_scored(table, asked, top).collect()} == want


def test_many_queries_of_empty_tables(spark):
    table = spark.createDataFrame([(1, [1.0]), (None, [1.0]), (2, None)], "comment_id bigint, vector array<float>")
    asked = spark.createDataFrame([(1, [1.0]), (None, [1.0])], "query_id bigint, vector array<float>")
    with pytest.raises(Exception, match="more than one space"):
        vectors.many_scored(table, asked, 3).collect()  # a missing vector is of no space
    table = table.filter("vector IS NOT NULL")
    assert [(r["query_id"], r["comment_id"]) for r in vectors.many_scored(table, asked, 3).collect()] == [(1, 1)]
    assert vectors.many_scored(table, asked.limit(0), 3).count() == 0 and vectors.many_scored(table.limit(0), asked, 3).count() == 0
