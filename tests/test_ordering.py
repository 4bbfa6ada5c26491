"""Ordered operators against brute force, with one group holding most rows and massive ties."""

import random

import pytest
from pyspark.sql import functions as F

from echolens.operators import nesting, ordering


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    return [(("hot" if rng.random() < 0.7 else rng.choice(["a", "b", None])), i, rng.choice([0, 0, 0, 1, 5])) for i in range(3000)]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "k string, id bigint, v int").repartition(13)


def grouped(rows):
    out = {}
    for k, i, v in rows:
        out.setdefault(k, []).append((v, i))
    return {k: sorted(x) for k, x in out.items()}


def test_ranked(df, rows):
    got = {r["id"]: r["rn"] for r in ordering.ranked(df, ["k"], [F.asc("v"), F.asc("id")]).collect()}
    want = {i: n for g in grouped(rows).values() for n, (_, i) in enumerate(g, 1)}
    assert got == want


def test_ranked_over_everything(df, rows):
    got = {r["id"]: r["rn"] for r in ordering.ranked(df, [], [F.desc("v"), F.asc("id")]).collect()}
    want = {i: n for n, (_, i) in enumerate(sorted((-v, i) for _, i, v in rows), 1)}
    assert got == want


@pytest.mark.parametrize("limit", [7, 100, 999])
def test_every_nth(spark, rows, limit):
    named = [(k or "none", i, v) for k, i, v in rows]
    df = spark.createDataFrame(named, "k string, id bigint, v int")
    got = {r["id"] for r in ordering.every_nth(df, ["k"], [F.asc("v"), F.asc("id")], limit).collect()}
    want = set()
    for g in grouped(named).values():
        want |= {g[int(j * (len(g) / limit))][1] for j in range(limit)} if len(g) > limit else {i for _, i in g}
    assert got == want


def test_top_beyond_the_group_limit(df, rows):
    got = {r["id"] for r in ordering.top_per_group(df, ["k"], [F.asc("v"), F.asc("id")], 1500).collect()}
    assert got == {i for g in grouped(rows).values() for _, i in g[:1500]}


def test_top_is_cut_before_the_shuffle(df):
    plan = ordering.top_per_group(df, ["k"], [F.asc("id")], 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_batches_and_pages(df, rows):
    got = ordering.batches(df.select("id"), [F.asc("id")], 7).collect()
    assert {(r["id"], r["batch"], r["idx"]) for r in got} == {(i, i // 7, i % 7) for _, i, _ in rows}
    page = ordering.page(df.select("id"), [F.asc("id")], 2)
    assert sorted(r["id"] for r in page.collect()) == list(range(20, 40))
    last = ordering.page(df.select("id"), [F.asc("id")], 10**6).collect()
    assert sorted(r["id"] for r in last) == list(range(2980, 3000)) and {r["page"] for r in last} == {150}


def test_neighbourhoods_see_across_blocks(spark):
    times = [random.Random(9).randint(0, 50) for _ in range(1)]
    rng = random.Random(9)
    times = [rng.randint(0, 50) for _ in range(500)]
    df = spark.createDataFrame([("t", i, x, i + 1) for i, x in enumerate(times)], "target_id string, id bigint, posted_at int, position bigint")
    blocks = ordering.neighbourhoods(df, "position", back=1, ahead=2, size=16)
    assert blocks.filter("_own").count() == 500
    assert blocks.groupBy("_block").count().agg(F.max("count")).first()[0] <= 19
    got = ordering.order_break_summary(df.drop("position").withColumn("posted_at", F.timestamp_seconds("posted_at").cast("timestamp_ntz"))).first()
    assert got["violations"] == sum(b > a for a, b in zip(times, times[1:]))
    assert got["equal_times"] == sum(b == a for a, b in zip(times, times[1:]))
    assert got["triple_rises"] == sum(a < b < c for a, b, c in zip(times, times[1:], times[2:]))


def test_hybrid_sample_limits(spark):
    rng = random.Random(1)
    data = [("hot", i, rng.choice([None, 0, 0, 3, 9]), i % 40) for i in range(400)] + [("small", i, 1, i) for i in range(1000, 1010)]
    df = spark.createDataFrame(data, "target_id string, id bigint, likes int, t int").withColumn("posted_at", F.timestamp_seconds("t"))
    got = ordering.hybrid_sample(df, whole_up_to=50, by_likes=30, by_time=20)
    by = {(r["target_id"], r["stratum"]): r["n"] for r in got.groupBy("target_id", "stratum").agg(F.count("*").alias("n")).collect()}
    assert by == {("hot", "liked"): 30, ("hot", "newest"): 20, ("small", "all"): 10}
    assert got.select("id").distinct().count() == 60
    assert ordering.hybrid_sample(df, whole_up_to=50, by_likes=30, by_time=20, max_count=35).filter("target_id = 'hot'").count() == 35


def test_seeded_sample_ignores_partitioning(df):
    pick = lambda d: sorted(r["id"] for r in ordering.seeded_sample(d, 50, 7).collect())
    assert pick(df) == pick(df.repartition(3)) and pick(df) != sorted(r["id"] for r in ordering.seeded_sample(df, 50, 8).collect())


def test_long_opinion_lists_are_sliced(spark):
    data = [(i, 1 if i < 900 else i, "a/b/c", "neutral", "q") for i in range(1000)]
    df = spark.createDataFrame(data, "id bigint, comment_id bigint, full_path string, sentiment string, quote string")
    rows = nesting.nested_opinions(df, per_row=100).collect()
    assert sum(len(r["opinions"]) for r in rows) == 1000
    assert len({o["id"] for r in rows for o in r["opinions"]}) == 1000
    assert max(len(r["opinions"]) for r in rows) < 250 and sum(r["comment_id"] == 1 for r in rows) == 9
    assert all([o["id"] for o in r["opinions"]] == sorted(o["id"] for o in r["opinions"]) for r in rows)


def test_slices_follow_the_id_order(spark):
    data = [(i, 7, "a/b/c", "neutral", "q") for i in range(2500)]
    df = spark.createDataFrame(data, "id bigint, comment_id bigint, full_path string, sentiment string, quote string").repartition(8)
    rows = sorted(nesting.nested_opinions(df).collect(), key=lambda r: r["slice"])
    assert [r["slice"] for r in rows] == [0, 1, 2]
    assert [o["id"] for r in rows for o in r["opinions"]] == list(range(2500))


def test_matrices_take_any_number_of_targets(spark):
    from echolens.operators import matrix

    cells = spark.range(20_000).selectExpr("CASE WHEN id % 2 = 0 THEN 'a' ELSE 'b' END AS topic", "concat('t', id) AS target_id", "id + 1 AS n")
    got = matrix.filled(cells)
    assert got.count() == 40_000 and got.filter("n = 0").count() == 20_000
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "Cartesian" not in plan


def test_pages_read_the_files_they_lie_in(spark):
    import random

    from echolens.session import run_dir
    from echolens.sources.pages import Pages

    r = random.Random(2)
    rows = [(i, r.randrange(50)) for i in range(1000)]
    order = [F.desc("score"), F.asc("id")]
    pages = Pages.laid_out(spark.createDataFrame(rows, "id bigint, score int"), order, run_dir(spark, "pages"), 40)
    want = [i for i, _ in sorted(rows, key=lambda x: (-x[1], x[0]))]
    assert pages.total == 1000 and len(pages.paths) >= 25
    for number, size in ((1, 20), (7, 20), (50, 20), (10**9, 30), (0, 20), (3, 100)):
        got = pages.page(number, size)
        page, low, high = pages.span(number, size)
        assert [(x["id"], x["position"], x["page"]) for x in got.orderBy("position").collect()] == [(want[k], k + 1, page) for k in range(low, high)]
        # Files are 40 rows at most, and shorter only at the end of a range.
        assert len(got.inputFiles()) <= 2 + size // 8
    first, last = pages.page(1), pages.page(10**9)
    assert len(first.inputFiles()) <= 3 and len(last.inputFiles()) <= 3
    none = Pages.laid_out(spark.createDataFrame([], "id bigint, score int"), order, run_dir(spark, "pages"))
    assert none.page(5).collect() == [] and none.page(5).columns == ["id", "score", "position", "page"]
