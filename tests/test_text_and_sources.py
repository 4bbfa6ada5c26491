"""Column functions, landed payloads and configuration."""

import json
from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from echolens.functions import paths, text as tx, values as v
from echolens.operators import filters, words
from echolens.sources import config, exports, landed


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@given(st.lists(st.text(alphabet=" \t\n\x0b\x0c\r\x1c\x1f\x85\xa0 　ab卡", max_size=12), min_size=1, max_size=60))
@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_strip_is_pythons(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    got = {r["i"]: r["x"] for r in df.select("i", tx.strip(F.col("s")).alias("x")).collect()}
    assert [got[i] for i in range(len(texts))] == [t.strip() for t in texts]


def test_clean_text_and_snippet(spark):
    assert one(spark, tx.clean_text(F.lit("看 http://a.b/c?d 好玩!!　 real_good…"))) == "看 好玩 real_good"
    s = one(spark, tx.snippet(F.lit("　a \n b" + "c" * 300)))
    assert (s["text"], len(s["full"]), s["truncated"]) == ("a b" + "c" * 77 + "…", 200, True)
    assert one(spark, tx.snippet(F.lit(None).cast("string")))["text"] == ""


@pytest.mark.parametrize("text, noise", [
    ("666", True), ("GOOD game", True), ("♥♥♥", True), ("", True), ("好玩", False), ("a1", False), ("😀😀", True), ("１２", True)])
def test_noise(spark, text, noise):
    assert one(spark, tx.is_noise(F.lit(text))) is noise


def test_response_bodies(spark):
    assert json.loads(one(spark, tx.response_body(F.lit('```json\n{"a": 1}\n```')))) == {"a": 1}
    assert json.loads(one(spark, tx.response_body(F.lit('well: {"a": {"b": 2}} done')))) == {"a": {"b": 2}}
    assert one(spark, tx.response_body(F.lit("nothing"))) is None


def test_dates(spark):
    parts = lambda s: tuple(one(spark, c) for c in tx.date_parts(F.lit(s)))
    assert parts("2024 年 8 月 19 日") == (2024, 8, 19)
    assert parts("2024年8月") == (2024, 8, None)
    assert parts("即将推出") == (None, None, None)


def test_path_levels(spark):
    p = F.lit("操控/界面(UI/UX)/菜单")
    seg = lambda c, level: one(spark, paths.segment(c, level))
    # The plain split is the compatible default; the taxonomy resolves the slash rightly.
    assert (seg(p, "L1"), seg(p, "L2"), seg(p, "L3")) == ("操控", "界面(UI", "UX)/菜单")
    assert (seg(F.lit("solo"), "L2"), seg(F.lit("a/b"), "L3"), seg(F.lit(""), "L1")) == ("solo", "b", "")
    tax = spark.createDataFrame([(0, "操控", "界面(UI/UX)", "菜单")], "ord int, l1 string, l2 string, l3 string")
    rows = spark.createDataFrame([("操控/界面(UI/UX)/菜单",), ("a/b/c",), ("a/b",), ("a",), ("a/b/c/d",)], "full_path string")
    got = {r["full_path"]: (r["l1"], r["l2"], r["l3"]) for r in paths.resolve_paths(rows, tax).collect()}
    assert got == {"操控/界面(UI/UX)/菜单": ("操控", "界面(UI/UX)", "菜单"), "a/b/c": ("a", "b", "c"), "a/b": ("a", "b", "b"),
                   "a": (None, None, None), "a/b/c/d": (None, None, None)}


def test_values(spark):
    assert one(spark, v.naive_utc(F.lit("1700000000"))) == datetime(2023, 11, 14, 22, 13, 20)
    assert one(spark, v.naive_utc(F.lit("soon"))) is None
    assert one(spark, v.clean_confidence(F.lit("0"), F.lit(-0.4))) == 0.4
    assert one(spark, v.display_time(F.lit(None).cast("timestamp_ntz"))) == "—"
    assert [one(spark, v.rating_tier(F.lit(x))) for x in (95.0, 94.9, 20.0, 19.9)] == ["好评如潮", "特别好评", "多半差评", "差评"]
    assert json.loads(one(spark, v.patched_name(F.lit('{"x": "1", "name": ""}'), F.lit("N")))) == {"x": "1", "name": "N", "type": "game"}
    extras = spark.createDataFrame([('{"refunded": true, "developer_response": "  "}',), (None,)], "x string").select(
        *v.extras_with_defaults(F.col("x"), 0.5)).collect()
    assert [(r["refunded"], r["developer_response"], r["weighted_vote_score"]) for r in extras] == [(True, None, 0.5), (False, None, 0.5)]


def test_tag_hit_needs_a_boundary(spark):
    hit = lambda path, tag: one(spark, filters.tag_hit(F.array(F.lit(path)), {tag}))
    assert hit("a/b", "a") and hit("a", "a/b") and hit("a", "a") and not hit("ab/c", "a")


def test_typed_ids():
    assert filters.split_ids(" 1,2；3、1\n4 ") == ["1", "2", "3", "4"]


def test_cjk_words(spark):
    got = one(spark, words.tokens(F.lit("GPU卡顿了 ok http://x.y")))
    assert sorted(got) == sorted(["GPU", "卡顿", "顿了", "卡顿了", "ok"])


def test_reviews(spark):
    payload = {"recommendationid": "7", "timestamp_created": 0, "voted_up": False, "review": "　好\n", "author": {"steamid": ""}}
    raw = spark.createDataFrame([(json.dumps(payload), "730")], "payload string, appid string")
    r = landed.normalise_reviews(raw).first()
    assert (r["source_id"], r["content"], r["rating"], r["posted_at"], r["author"], r["likes"]) == ("7", "好", 0, None, None, None)
    extra = json.loads(r["extra_json"])
    assert len(extra) == 13 and extra["playtime_forever"] == 0 and extra["reactions"] == []
    again = landed.normalise_reviews(raw, fetch_metadata=True).first()
    assert again["likes"] == 0 and "developer_response" in json.loads(again["extra_json"])


def test_danmaku_xml(spark):
    xml = '<i><d p="12.9,1,25,-1,1700000000,0,h,9">　hi\nthere </d><d p="bad">x</d></i>'
    rows = landed.parse_danmaku(spark.createDataFrame([(xml,)], "xml string")).orderBy("pos").collect()
    assert [(r["content"], r["progress"], r["mode"], r["color"], r["user_hash"]) for r in rows] == [("hi\nthere", 12, 1, -1, "h"), ("x", 0, None, None, None)]
    assert rows[1]["posted_at"] is None


def test_targets_and_yaml(spark, tmp_path):
    file = tmp_path / "t.yaml"
    file.write_text("targets:\n- {platform: steam, id: 1}\n- {platform: steam, id: 2, enabled: false}\n- {platform: bilibili, id: x, enabled: true, count: 9}\n")
    rows = config.target_rows(spark, config.read_config(str(file))).orderBy("ord").collect()
    assert [(r["target_id"], r["count"]) for r in rows] == [("steam:1", None), ("bilibili:x", 9)]


def test_csv_quoting(spark, tmp_path):
    texts = ['say "hi", ok', "two\nlines", "plain", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    exports.write_csv(df, str(tmp_path / "out"))
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(str(tmp_path / "out"))
    assert {r["i"]: r["s"] for r in back.collect()} == {str(i): t for i, t in enumerate(texts)}
    assert '"say ""hi"", ok"' in "".join(p.read_text() for p in (tmp_path / "out").glob("*.csv"))


def test_json_export(spark, tmp_path):
    df = spark.createDataFrame([("steam", 1), ("bilibili", 2)], "platform string, id int")
    exports.write_json(df, str(tmp_path / "out"), "platform")
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_tagged_voices_gather_no_paths(spark, tmp_path):
    voices = spark.createDataFrame([(1, "A", None), (2, None, '["y"]'), (3, "B", '["z"]'), (4, None, None), (5, "A/x", None)], "id bigint, topic string, sub_topics string")
    opinions = spark.createDataFrame([(1, 3, "A/x/k"), (2, 4, "A/xx"), (3, 9, "A/x/k"), (4, 4, None), (5, 3, "A/x/k")], "id bigint, comment_id bigint, full_path string")
    opinions.write.parquet(str(tmp_path / "o"))
    opinions = spark.read.parquet(str(tmp_path / "o"))
    tax = spark.createDataFrame([("A", "x", "k"), ("A", "y", "k")], "l1 string, l2 string, l3 string")
    hit = lambda *tags: sorted(r["id"] for r in filters.tagged_voices(voices, opinions, tax, set(tags)).collect())
    assert hit("A/x") == [1, 3, 5] and hit("A/y") == [1, 2] and hit("A/x/k") == [1, 3, 5] and hit("z") == [3] and hit("A/xx") == [1, 4] and hit("Q") == []
    plan = filters.tagged_voices(voices, opinions, tax, {"A/x"})._jdf.queryExecution().executedPlan().toString()
    assert "collect_set" not in plan and "StringStartsWith(full_path,A/x/)" in plan


def test_label_dump(spark):
    from datetime import datetime

    day = lambda n: datetime(2024, 1, n)
    rows = [(1, "t", "positive", "A", None, day(1)), (2, "t", "negative", None, '["A"]', day(3)), (3, "u", "positive", "B", '["AA"]', day(2)), (4, "t", "positive", "A", None, None)]
    df = spark.createDataFrame(rows, "id bigint, target_id string, sentiment string, topic string, sub_topics string, analyzed_at timestamp")
    got = lambda **kw: [r["id"] for r in filters.labelled_dump(df, **kw).collect()]
    assert got() == [2, 3, 1] and got(label="A") == [2, 1] and got(label="A", sentiment="positive") == [1] and got(target_id="u") == [3]
    assert got(id=2) == [2] and got(id=4) == [] and got(limit=1) == [2] and got(sentiment="") == [2, 3, 1]


def test_reply_indexes_must_be_integers(spark):
    from echolens.operators import annotate

    reply = '{"results": [{"index": "0", "sentiment": "positive"}, {"index": 1.0, "sentiment": "positive"}, {"index": true, "sentiment": " positive"}, {"index": 2, "sentiment": "POSITIVE"}, {"sentiment": "positive"}, {"index": null}]}'
    rows = spark.createDataFrame([(0, 4, reply)], "batch bigint, batch_size int, response string")
    got = {r["idx"]: (r["sentiment"], r["sentiment_confidence"]) for r in annotate.parse_responses(rows).collect()}
    assert got == {0: ("neutral", 0.0), 1: ("neutral", 0.5), 2: ("positive", 0.5), 3: ("neutral", 0.0)}


def test_a_label_without_path_is_matched(spark):
    from echolens.operators import danmaku
    from echolens.operators.lexicon import Lexicon

    lex = Lexicon(((0, "A", "B", "C", False),), (("C", "cc", 0), ("Lost", "lost", 0)), meme_words=(), recommend_words=(), praise_words=(), criticize_words=(), masked_terms=())
    rows = spark.createDataFrame([("cc " + "." * 30,), ("lost " + "." * 30,), ("." * 30,)], "content string")
    got = {(r["kind"], r["label"]): r["n"] for r in danmaku.label_distribution(rows, lex).collect()}
    assert got == {("match", "matched"): 2, ("match", "unmatched"): 1, ("L1", "A"): 1, ("L2", "B"): 1, ("path", "A/B/C"): 1}
