"""Sources, projections, predicates and joins."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from ..functions import paths, text as tx, values as v
from ..operators import audit, filters, joins, matching
from ..sources import config, exports, landed
from .registry import report
from .tables import LARGE, Tables, labels_sql, strip_sql

PARSED = "from_json(sub_topics, '[\"VARCHAR\"]')"
JAN = datetime(2024, 1, 10), datetime(2024, 1, 20)


@report("s1_scan_comments", """
    SELECT id, platform, source_id, target_id, language, rating, likes, posted_at, sentiment FROM vc""")
def s1(t: Tables):
    return t.vc.select("id", "platform", "source_id", "target_id", "language", "rating", "likes", "posted_at", "sentiment")


@report("s1_scan_row_counts", """
    SELECT 'comments' AS name, count(*) AS n FROM vc UNION ALL SELECT 'opinions', count(*) FROM vo
    UNION ALL SELECT 'embeddings', count(*) FROM ve UNION ALL SELECT 'danmaku', count(*) FROM vd""")
def s1b(t: Tables):
    from functools import reduce
    named = {"comments": t.vc, "opinions": t.vo, "embeddings": t.ve, "danmaku": t.vd}
    return reduce(lambda a, b: a.unionByName(b), [
        df.agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n, df in named.items()])


def review_payloads(t: Tables):
    """Store reviews as landed: one JSON text per document."""
    author = F.struct(
        F.concat(F.lit("u"), (F.col("id") % 97).cast("string")).alias("steamid"), (F.col("id") % 500).alias("playtime_at_review"))
    review = F.struct(
        F.col("source_id").alias("recommendationid"),
        F.when(F.col("id") % 11 != 0, F.lit(1_700_000_000) + F.col("id") * 60).alias("timestamp_created"),
        F.when(F.col("rating").isNotNull(), F.col("rating") == 1).alias("voted_up"),
        F.concat(F.lit(" \t"), "content", F.lit("\n")).alias("review"), "language",
        F.col("likes").alias("votes_up"), author.alias("author"), (F.col("id") % 5 == 0).alias("refunded"),
    )
    return t.vc.filter(F.col("platform") == "steam").select(
        F.to_json(review).alias("payload"), F.element_at(F.split("target_id", ":"), -1).alias("appid"))


def s2_sql(likes: str) -> str:
    return f"""
    SELECT platform, source_id, {strip_sql('content')} AS content, concat('u', CAST(id % 97 AS VARCHAR)) AS author_id,
      rating, language, {likes} AS likes,
      CASE WHEN id % 11 <> 0 THEN make_timestamp((1700000000 + id * 60) * 1000000) END AS posted_at,
      split_part(target_id, ':', 2) AS appid, CAST(id % 500 AS VARCHAR) AS playtime,
      CASE WHEN id % 5 = 0 THEN 'true' ELSE 'false' END AS refunded
    FROM vc WHERE platform = 'steam'"""


def normalised(t: Tables, fetch_metadata: bool):
    rows = landed.normalise_reviews(review_payloads(t), fetch_metadata=fetch_metadata)
    field = lambda n: F.get_json_object("extra_json", f"$.{n}")
    return rows.select(
        "platform", "source_id", "content", "author_id", "rating", "language", "likes", "posted_at",
        field("appid").alias("appid"), field("playtime_at_review").alias("playtime"), field("refunded").alias("refunded"))


report("s2_normalise_reviews", s2_sql("CAST(NULL AS INT)"))(lambda t: normalised(t, False))
report("s2_normalise_reviews_refresh", s2_sql("coalesce(likes, 0)"))(lambda t: normalised(t, True))


@report("s3_normalise_replies", """
    SELECT 'bilibili' AS platform, CAST(conv_id * 1000 + turn AS VARCHAR) AS source_id, text AS content, role AS author,
      CAST(conv_id AS VARCHAR) AS author_id, CAST(NULL AS INT) AS rating, 'zh-CN' AS language, CAST(turn AS INT) AS likes,
      CASE WHEN turn > 0 THEN make_timestamp((1700000000 + turn) * 1000000) END AS posted_at,
      CAST(conv_id % 10 AS VARCHAR) AS level
    FROM conversations""")
def s3(t: Tables):
    member = F.struct(
        F.col("conv_id").cast("string").alias("mid"), F.col("role").alias("uname"),
        F.struct((F.col("conv_id") % 10).alias("current_level")).alias("level_info"))
    reply = F.struct(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("rpid"), F.when(F.col("turn") > 0, F.lit(1_700_000_000) + F.col("turn")).alias("ctime"),
        F.col("turn").alias("like"), F.struct(F.col("text").alias("message")).alias("content"), member.alias("member"))
    raw = t.conversations.select(F.to_json(reply).alias("payload"), F.col("conv_id").alias("aid"))
    return landed.normalise_replies(raw).select(
        "platform", "source_id", "content", "author", "author_id", "rating", "language", "likes", "posted_at",
        F.get_json_object("extra_json", "$.profile.level").alias("level"))


@report("s4_parse_danmaku", """
    SELECT event_id, 0 AS pos, event_type AS content, CAST(floor(value) AS INT) AS progress, CAST(event_id % 7 AS INT) AS mode,
      16777215 AS color, CAST(user_id AS VARCHAR) AS user_hash, make_timestamp((1700000000 + event_id) * 1000000) AS posted_at FROM events
    UNION ALL
    SELECT event_id, 1, 'late', 0, CAST(NULL AS INT), -1, 'h', CAST(NULL AS TIMESTAMP) FROM events""")
def s4(t: Tables):
    text = F.concat(
        F.lit('<i><d p="'), F.concat_ws(",", F.col("value"), F.col("event_id") % 7, F.lit("25"), F.lit("16777215"),
        F.lit(1_700_000_000) + F.col("event_id"), F.lit("0"), F.col("user_id"), F.lit("9")), F.lit('"> '), "event_type",
        F.lit(' </d><d p="x,y,25,-1,z,0,h">late</d></i>'))
    return landed.parse_danmaku(t.events.select("event_id", text.alias("xml")), "xml", "event_id")


@report("s5_taxonomy_of_opinions", """
    SELECT t.ord, t.l1, t.l2, t.l3, count(o.id) AS n FROM tax t LEFT JOIN vo o ON o.full_path = concat(t.l1, '/', t.l2, '/', t.l3)
    GROUP BY t.ord, t.l1, t.l2, t.l3""")
def s5(t: Tables):
    tree: dict = {}
    for _, l1, l2, l3, _ in t.lex.taxonomy:
        tree.setdefault(l1, {}).setdefault(l2, []).append(l3)
    rows = config.taxonomy_rows({"hierarchy": tree}, fallback=list(t.lex.fallback))
    dim = t.spark.createDataFrame(rows, "ord int, l1 string, l2 string, l3 string, is_fallback boolean")
    counts = t.vo.groupBy("full_path").agg(F.count("*").alias("n"))
    return joins.zero_filled(paths.path_dim(dim), counts, ["full_path"]).select("ord", "l1", "l2", "l3", "n")


@report("s6_keyword_mentions", """
    WITH own AS (SELECT * FROM kw WHERE keyword <> l3 OR pos = 1),
    k AS (SELECT * FROM own UNION ALL SELECT l3, l3, CAST(count(*) AS INT) FROM own GROUP BY l3)
    SELECT k.l3, k.keyword, k.pos, count(c.id) AS n FROM k LEFT JOIN vc c ON contains(c.content, k.keyword)
    GROUP BY k.l3, k.keyword, k.pos""")
def s6(t: Tables):
    # As a file lists them: the label's own name is added by the reader.
    listed: dict = {}
    for l3, word, pos in t.lex.keywords:
        if word != l3 or pos == 1:
            listed.setdefault(l3, {"keywords": []})["keywords"].append(word)
    entries = config.keyword_rows({"definitions": listed})
    # One conditional count per dictionary entry: a single scan, no join.
    cells = F.array(*[
        F.struct(F.lit(l3).alias("l3"), F.lit(k).alias("keyword"), F.lit(p).alias("pos"), F.count_if(F.contains("content", F.lit(k))).alias("n"))
        for l3, k, p in entries])
    return t.vc.agg(cells.alias("cells")).select(F.inline("cells"))


@report("s7_enabled_targets", """
    SELECT target_id, min(id) AS ord, count(*) AS n FROM vc GROUP BY target_id HAVING min(id) % 3 <> 0""")
def s7(t: Tables):
    listed = t.vc.groupBy("target_id").agg(F.min("id").alias("ord"), F.count("*").alias("n")).withColumns({
        "platform": F.element_at(F.split("target_id", ":"), 1), "key": F.regexp_replace("target_id", "^[^:]*:", ""),
        "enabled": F.when(F.col("ord") % 3 == 0, False).when(F.col("ord") % 3 == 1, True)})
    return config.enabled_targets(listed).select("target_id", "ord", "n")


SENT_WORD = "CASE {0} WHEN 'positive' THEN '正向' WHEN 'neutral' THEN '中性' WHEN 'negative' THEN '负向' ELSE coalesce({0}, '') END"


@report("s8_voices_csv", f"""
    SELECT f.source_id, json_extract_string(f.extra_meta, '$.name') AS game, strftime(f.posted_at, '%Y-%m-%d %H:%M') AS posted_at,
      CASE WHEN f.rating = 1 THEN '推荐' ELSE '不推荐' END AS vote, {SENT_WORD.format('f.sentiment')} AS sentiment, f.sentiment_score,
      coalesce(f.topic, '') AS l1, coalesce(array_to_string(from_json(f.sub_topics, '["VARCHAR"]'), '|'), '') AS l2,
      coalesce(o.n, 0) AS opinion_count,
      coalesce(format('{{:.1f}}', round(CAST(json_extract_string(f.extra_json, '$.playtime_at_review') AS BIGINT) / 60, 1)), '') AS hours_at_review,
      f.likes, f.replies, f.content
    FROM vf f LEFT JOIN (SELECT comment_id, count(*) AS n FROM vo GROUP BY comment_id) o ON o.comment_id = f.id""")
def s8(t: Tables):
    return exports.voices_csv_frame(t.vf, t.vo)


@report("s8_opinions_csv", f"""
    SELECT o.id, f.source_id, o.full_path AS path, {SENT_WORD.format('o.sentiment')} AS sentiment,
      json_extract_string(f.extra_meta, '$.name') AS game, strftime(f.posted_at, '%Y-%m-%d %H:%M') AS posted_at,
      CASE WHEN f.rating = 1 THEN '推荐' ELSE '不推荐' END AS vote, {SENT_WORD.format('f.sentiment')} AS overall_sentiment,
      coalesce(o.quote, '') AS quote
    FROM vo o JOIN vf f ON f.id = o.comment_id""")
def s8b(t: Tables):
    return exports.opinions_csv_frame(t.vf, t.vo)


@report("s9_voice_documents", """
    SELECT f.id, f.source_id, f.rating, f.topic, coalesce(nullif(json_extract_string(f.extra_json, '$.appid'), ''), split_part(f.target_id, ':', 2)) AS appid, json_extract_string(f.extra_meta, '$.name') AS game,
      strftime(f.posted_at, '%Y-%m-%d %H:%M:%S') AS posted_at, f.likes,
      CAST(json_extract_string(f.extra_json, '$.playtime_at_review') AS BIGINT) AS playtime_at_review,
      coalesce(CAST(json_extract_string(f.extra_json, '$.refunded') AS BOOLEAN), false) AS refunded,
      nullif(trim(json_extract_string(f.extra_json, '$.developer_response')), '') AS developer_response,
      coalesce(o.ids, '') AS opinion_ids
    FROM vf f LEFT JOIN (SELECT comment_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM vo GROUP BY comment_id) o
      ON o.comment_id = f.id WHERE f.platform = 'steam'""")
def s9(t: Tables):
    return exports.voice_documents(t.vf, t.vo).select(
        "id", "source_id", "rating", "topic", "appid", "game", "posted_at", "likes", "playtime_at_review", "refunded", "developer_response",
        F.coalesce(F.array_join(F.col("opinions.id").cast("array<string>"), ","), F.lit("")).alias("opinion_ids"))


@report("s9_opinion_documents", """
    SELECT o.id, o.comment_id, o.full_path AS path, o.sentiment, o.sentiment_confidence, o.quote, f.source_id, f.target_id,
      coalesce(nullif(json_extract_string(f.extra_json, '$.appid'), ''), split_part(f.target_id, ':', 2)) AS appid, json_extract_string(f.extra_meta, '$.name') AS game,
      strftime(f.posted_at, '%Y-%m-%d %H:%M:%S') AS posted_at, f.rating, f.author, f.content, f.sentiment AS overall_sentiment, f.topic,
      coalesce(array_to_string(CAST(json_extract_string(f.sub_topics, '$[*]') AS VARCHAR[]), '|'), '') AS sub_topics,
      CAST(json_extract_string(f.extra_json, '$.playtime_at_review') AS BIGINT) AS playtime_at_review, CAST(json_extract_string(f.extra_json, '$.playtime_forever') AS BIGINT) AS playtime_forever,
      f.likes, f.replies, coalesce(CAST(json_extract_string(f.extra_json, '$.refunded') AS BOOLEAN), false) AS refunded, false AS early_access, false AS steam_deck, false AS received_for_free,
      CAST(json_extract_string(f.extra_json, '$.weighted_vote_score') AS DOUBLE) AS weighted_vote_score, f.language
    FROM vo o JOIN vf f ON f.id = o.comment_id WHERE f.platform = 'steam'""")
def s9b(t: Tables):
    return exports.opinion_documents(t.vf, t.vo).withColumn("sub_topics", F.array_join("sub_topics", "|"))


@report("s10_annotated_comments", """
    SELECT f.id, f.target_id, f.content, f.rating, f.language, f.posted_at, f.sentiment, f.topic, count(*) AS opinion_count
    FROM vf f JOIN vo o ON o.comment_id = f.id GROUP BY ALL""")
def s10(t: Tables):
    return exports.annotation_tables(t.vf, t.vo)[0]


@report("s10_annotated_opinions", """
    SELECT o.id, o.comment_id, f.target_id, o.full_path, o.sentiment, o.quote, f.rating, f.language, f.sentiment AS comment_sentiment
    FROM vo o JOIN vf f ON f.id = o.comment_id""")
def s10b(t: Tables):
    return exports.annotation_tables(t.vf, t.vo)[1]


@report("s11_video_comments", """
    SELECT id, source_id, target_id, author, likes, posted_at, CAST(json_extract_string(extra_json, '$.profile.level') AS INT) AS level,
      json_extract_string(extra_json, '$.profile.sex') AS sex,
      coalesce(CAST(json_extract_string(extra_json, '$.profile.vip.status') AS INT), 0) AS vip, '' AS official, content
    FROM vf WHERE platform = 'bilibili'""")
def s11(t: Tables):
    return exports.video_comments(t.vf)


@report("s11_video_danmaku", "SELECT id, video_id, content, progress, mode, user_hash, posted_at FROM vd ORDER BY progress, id")
def s11b(t: Tables):
    return exports.video_danmaku(t.vd)


@report("f1_public_projection", f"""
    SELECT id, platform, source_id, target_id, author, rating, likes, sentiment, topic,
      coalesce(array_to_string({PARSED}, '|'), '') AS sub_topics, strftime(posted_at, '%Y-%m-%dT%H:%M:%S.%f') AS posted_at FROM vf""")
def f1(t: Tables):
    return filters.public_projection(t.vf).select(
        "id", "platform", "source_id", "target_id", "author", "rating", "likes", "sentiment", "topic",
        F.array_join("sub_topics", "|").alias("sub_topics"), "posted_at")


@report("f2_summary_frame", """
    SELECT id, CASE WHEN id % 10 = 0 THEN NULL ELSE posted_at END AS posted_at, sentiment FROM vc""")
def f2(t: Tables):
    texts = t.vc.select("id", F.when(F.col("id") % 10 == 0, "not a time").otherwise(F.col("posted_at").cast("string")).alias("posted_at"), "sentiment")
    return filters.summary_frame(texts)


@report("f3_lineage_projection", """
    SELECT source_id AS "A_source_id", content AS "A_content", author_id AS "A_author_id", rating AS "A_rating", language AS "A_language",
      likes AS "A_likes", replies AS "A_replies", strftime(posted_at, '%Y-%m-%dT%H:%M:%S.%f') AS "A_posted_at", id AS "B_id", platform AS "B_platform",
      target_id AS "B_target_id", extra_meta AS "B_target_meta", extra_json AS "B_extra_json", strftime(fetched_at, '%Y-%m-%dT%H:%M:%S.%f') AS "B_fetched_at",
      sentiment AS "C_sentiment", sentiment_score AS "C_sentiment_score", sentiment_confidence AS "C_sentiment_confidence", topic AS "C_topic",
      sub_topics AS "C_sub_topics", strftime(analyzed_at, '%Y-%m-%dT%H:%M:%S.%f') AS "C_analyzed_at" FROM vf""")
def f3(t: Tables):
    return filters.lineage_projection(t.vf)


@report("f4_derived_target", """
    SELECT id, CASE WHEN platform = 'steam' AND extra_json IS NOT NULL THEN concat('steam:', CAST(id % 9 AS VARCHAR))
      ELSE concat(platform, ':', language) END AS target FROM vf""")
def f4(t: Tables):
    return t.vf.select("id", filters.derived_target(F.col("platform"), F.col("language"), F.col("extra_json")).alias("target"))


@report("f5_time_window", """
    SELECT id, posted_at FROM vc WHERE posted_at >= TIMESTAMP '2024-01-10' AND posted_at < TIMESTAMP '2024-01-20'""")
def f5(t: Tables):
    return t.vc.filter(filters.within(F.col("posted_at"), *JAN)).select("id", "posted_at")


@report("f6_report_filter", """
    SELECT id, target_id, rating, sentiment, posted_at FROM vc
    WHERE strftime(posted_at, '%Y-%m-%d') BETWEEN '2024-01-01' AND '2024-01-25'
      AND target_id IN ('steam:src1', 'steam:src2', 'bilibili:video:src3') AND rating IN (1) AND sentiment IN ('positive', 'neutral')""")
def f6(t: Tables):
    spec = filters.ReportFilter(date(2024, 1, 1), date(2024, 1, 25), {"steam:src1", "steam:src2", "bilibili:video:src3"}, {1}, {"positive", "neutral"})
    return t.vc.filter(spec.condition()).select("id", "target_id", "rating", "sentiment", "posted_at")


@report("f7_tag_hit_opinions", """
    SELECT id, full_path FROM vo WHERE full_path LIKE 'Mechanics/%' OR full_path = 'Art/Visual/Style'""")
def f7(t: Tables):
    return t.vo.filter(filters.path_hit(F.col("full_path"), {"Mechanics", "Art/Visual/Style"})).select("id", "full_path")


@report("f7_tag_hit_voices", f"""
    WITH p AS (
      SELECT id, topic AS path FROM vf WHERE topic IS NOT NULL UNION ALL
      SELECT s.id, coalesce(x.l1 || '/' || s.sub, s.sub) FROM (SELECT id, unnest({PARSED}) AS sub FROM vf) s
        LEFT JOIN (SELECT DISTINCT l1, l2 FROM tax) x ON x.l2 = s.sub UNION ALL
      SELECT f.id, o.full_path FROM vf f JOIN vo o ON o.comment_id = f.id),
    s AS (SELECT unnest(['Audio/Music', 'Tech/Frames/Stutter']) AS tag)
    SELECT DISTINCT p.id FROM p JOIN s ON p.path = s.tag OR starts_with(p.path, s.tag || '/') OR starts_with(s.tag, p.path || '/')""")
def f7b(t: Tables):
    return filters.tagged_voices(t.vf, t.vo, t.tax, {"Audio/Music", "Tech/Frames/Stutter"}).select("id")


@report("f8_voices_by_opinion_ids", "SELECT DISTINCT c.id FROM vc c JOIN vo o ON o.comment_id = c.id WHERE o.id IN (1001, 3001, 5000)")
def f8(t: Tables):
    voices = t.vc.withColumn("source_id", F.concat(F.lit("v"), "source_id"))  # ids of both grains must differ
    return filters.by_ids(voices, t.vo, "1001；3001, 5000 zzz", "voice").select("id")


@report("f8_mixed_ids", "SELECT id FROM vc WHERE false")
def f8b(t: Tables):
    return filters.by_ids(t.vc, t.vo, "1 1001", "voice").select("id")


@report("f9_newest_of_target", """
    SELECT id, posted_at FROM vc WHERE target_id = 'steam:src1' ORDER BY posted_at DESC, id LIMIT 500""")
def f9(t: Tables):
    return filters.newest_of_target(t.vc, "steam:src1").select("id", "posted_at")


@report("f10_unanalyzed", "SELECT id, platform FROM vc WHERE analyzed_at IS NULL AND platform = 'steam' ORDER BY id LIMIT 100")
def f10(t: Tables):
    return filters.unanalyzed(t.vc, 100, "steam").select("id", "platform")


@report("f11_analyzed_feed", "SELECT id, analyzed_at FROM vc WHERE analyzed_at IS NOT NULL ORDER BY analyzed_at DESC, id LIMIT 1000")
def f11(t: Tables):
    return filters.analyzed_feed(t.vc).select("id", "analyzed_at")


@report("f12_refresh_due", """
    SELECT id, posted_at FROM vf WHERE posted_at < TIMESTAMP '2024-01-18'
      AND (likes_refreshed_at IS NULL OR developer_response_refreshed_at IS NULL)""")
def f12(t: Tables):
    return filters.refresh_due(t.vf, datetime(2024, 1, 25), 7).select("id", "posted_at")


@report("f13_label_filter", f"""
    SELECT id, topic FROM vf WHERE analyzed_at IS NOT NULL AND (topic = 'Audio' OR list_contains({PARSED}, 'Visual'))""")
def f13(t: Tables):
    either = filters.with_topic_or_sub(t.vf, "Audio").select("id", "topic").unionByName(
        filters.with_topic_or_sub(t.vf, "Visual").select("id", "topic"))
    return either.distinct()


@report("f13_label_dump", f"""
    SELECT id, target_id, topic, analyzed_at FROM vf WHERE analyzed_at IS NOT NULL AND sentiment = 'positive' AND (topic = 'Audio' OR list_contains({PARSED}, 'Music'))
    ORDER BY analyzed_at DESC, id LIMIT 10""")
def f13b(t: Tables):
    return filters.labelled_dump(t.vf, "Audio", sentiment="positive").unionByName(
        filters.labelled_dump(t.vf, "Music", sentiment="positive")).distinct().orderBy(F.desc("analyzed_at"), "id").limit(10).select("id", "target_id", "topic", "analyzed_at")


@report("f13_target_dump", """
    SELECT id, sentiment FROM vf WHERE analyzed_at IS NOT NULL AND target_id = 'steam:src3' ORDER BY analyzed_at DESC, id LIMIT 25""")
def f13c(t: Tables):
    return filters.labelled_dump(t.vf, target_id="steam:src3", limit=25).select("id", "sentiment")


@report("f14_retention", "SELECT id FROM vc WHERE NOT (posted_at <= TIMESTAMP '2024-01-10' OR coalesce(language <> 'en', false))")
def f14(t: Tables):
    return filters.retained(t.vc, datetime(2024, 1, 10), "en").select("id")


F15 = f"""
    WITH s AS (SELECT id, unnest({PARSED}) AS sub FROM vf WHERE analyzed_at IS NOT NULL),
    b AS (SELECT id, string_agg(sub, '|') AS bad FROM s WHERE sub NOT IN (SELECT l2 FROM tax) GROUP BY id),
    x AS (SELECT f.id, CASE WHEN f.topic NOT IN (SELECT l1 FROM tax) THEN f.topic END AS bad_topic, coalesce(b.bad, '') AS bad_subs
          FROM vf f LEFT JOIN b ON b.id = f.id WHERE f.analyzed_at IS NOT NULL)"""


@report("f15_outliers", F15 + " SELECT * FROM x WHERE bad_topic IS NOT NULL OR bad_subs <> ''")
def f15(t: Tables):
    return filters.outliers(t.vf, t.tax).select("id", "bad_topic", F.array_join("bad_subs", "|").alias("bad_subs"))


@report("f15_outliers_only_sub", F15 + " SELECT id, bad_subs FROM x WHERE bad_subs <> ''")
def f15b(t: Tables):
    return filters.outliers(t.vf, t.tax, only_sub=True).select("id", F.array_join("bad_subs", "|").alias("bad_subs"))


@report("f15_outlier_counts", F15 + """
    SELECT 'topic' AS kind, bad_topic AS label, count(*) AS n FROM x WHERE bad_topic IS NOT NULL GROUP BY bad_topic
    UNION ALL SELECT 'sub_topic', bad_subs, count(*) FROM x WHERE bad_subs <> '' GROUP BY bad_subs""")
def f15c(t: Tables):
    return filters.outlier_counts(t.vf, t.tax)


@report("f16_typical_samples", """
    SELECT id, sentiment, sentiment_score, sentiment_confidence,
      CASE WHEN length(content) > 300 THEN concat(substr(content, 1, 300), '...') ELSE content END AS snippet
    FROM vc WHERE sentiment IN ('positive', 'negative') ORDER BY sentiment_confidence DESC, id LIMIT 10""")
def f16(t: Tables):
    return filters.typical_samples(t.vc, ["positive", "negative"])


@report("f17_phrase_classes", r"""
    SELECT class, count(*) AS n FROM (
      SELECT CASE WHEN contains(lower(phrase), 'anti') OR contains(lower(phrase), 'ing') OR contains(lower(phrase), 'er') THEN 'overall'
        WHEN regexp_full_match(phrase, '\d+') OR regexp_full_match(replace(phrase, ' ', ''), '[A-Za-z]+')
          OR len(list_distinct(string_split(phrase, ''))) = 1 THEN 'noise' ELSE 'other' END AS class FROM vp) GROUP BY class""")
def f17(t: Tables):
    words = [*t.lex.overall_words, *t.lex.recommend_words]
    return t.vp.groupBy(filters.phrase_class(F.col("phrase"), words).alias("class")).agg(F.count("*").alias("n"))


@report("f18_whitelist", f"""
    WITH s AS (SELECT id, unnest({PARSED}) AS sub, generate_subscripts({PARSED}, 1) AS i FROM vf),
    k AS (SELECT id, string_agg(sub, '|' ORDER BY i) AS subs FROM s WHERE sub IN (SELECT l2 FROM tax) GROUP BY id)
    SELECT f.id, CASE WHEN topic IN (SELECT l1 FROM tax) THEN topic END AS topic, coalesce(k.subs, '') AS sub_topics FROM vf f LEFT JOIN k ON k.id = f.id""")
def f18(t: Tables):
    return filters.whitelisted(t.vf, t.tax).select("id", "topic", F.array_join("sub_topics", "|").alias("sub_topics"))


@report("f19_answered", """
    SELECT id, substr(content, 1, 50) AS content, substr(json_extract_string(extra_json, '$.developer_response'), 1, 60) AS reply,
      json_extract_string(extra_json, '$.timestamp_dev_responded') AS replied_at
    FROM vf WHERE json_extract_string(extra_json, '$.developer_response') <> '' ORDER BY id LIMIT 5""")
def f19(t: Tables):
    return filters.answered(t.vf)


@report("f19_top_vote_scores", """
    SELECT json_extract_string(extra_json, '$.weighted_vote_score') AS value, count(*) AS n FROM vf WHERE extra_json IS NOT NULL
    GROUP BY value ORDER BY value DESC LIMIT 5""")
def f19b(t: Tables):
    return filters.top_json_values(t.vf, "weighted_vote_score")


@report("f20_taxonomy_search", """
    SELECT t.l1, t.l2, t.l3, count(*) AS n FROM vo o JOIN tax t ON o.full_path = concat(t.l1, '/', t.l2, '/', t.l3)
    WHERE contains(lower(t.l1), 'me') OR contains(lower(t.l2), 'me') OR contains(lower(t.l3), 'me') GROUP BY ALL""")
def f20(t: Tables):
    counts = t.vo.groupBy("full_path").agg(F.count("*").alias("n"))
    return filters.taxonomy_search(paths.resolve_paths(counts, t.tax), "Me").select("l1", "l2", "l3", "n")


@report("j1_opinions_with_comment", """
    SELECT o.id, o.comment_id, o.full_path, c.target_id, c.platform FROM vo o JOIN vc c ON c.id = o.comment_id""")
def j1(t: Tables):
    return joins.with_comment(t.vo, t.vc, "target_id", "platform").select("id", "comment_id", "full_path", "target_id", "platform")


@report("j2_missing_vectors", "SELECT id FROM vc WHERE id NOT IN (SELECT comment_id FROM ve)")
def j2(t: Tables):
    return joins.missing_vectors(t.vc, t.ve).select("id")


@report("j2_missing_vectors_queue", "SELECT id FROM vc WHERE platform = 'steam' AND id NOT IN (SELECT comment_id FROM ve) ORDER BY id LIMIT 100")
def j2b(t: Tables):
    return joins.missing_vectors(t.vc, t.ve, 100, platform="steam").select("id")


@report("j3_having_opinions", "SELECT id FROM vc WHERE EXISTS (SELECT 1 FROM vo WHERE vo.comment_id = vc.id)")
def j3(t: Tables):
    return joins.having_opinions(t.vc, t.vo).select("id")


@report("j3_opinions_of_platform", "SELECT id FROM vo WHERE comment_id IN (SELECT id FROM vc WHERE platform = 'steam')")
def j3b(t: Tables):
    return joins.opinions_of_platform(t.vo, t.vc, "steam").select("id")


@report("j4_id_lookup", "SELECT id, target_id FROM vc WHERE id IN (SELECT DISTINCT comment_id FROM vo)")
def j4(t: Tables):
    return joins.lookup(t.vc, t.vo.select(F.col("comment_id").alias("id"))).select("id", "target_id")


@report("j5_named_targets", """
    SELECT c.id, CASE WHEN c.id % 2 = 0 THEN json_extract_string(c.extra_meta, '$.name') ELSE coalesce(n.name, split_part(c.target_id, ':', -1)) END AS target_name
    FROM vc c LEFT JOIN (SELECT DISTINCT source AS appid, concat('Named ', source) AS name FROM documents WHERE length(source) = 4) n
      ON n.appid = split_part(c.target_id, ':', -1)""")
def j5(t: Tables):
    names = t.documents.filter(F.length("source") == 4).select(F.col("source").alias("appid"), F.concat(F.lit("Named "), "source").alias("name")).distinct()
    some = t.vc.withColumn("extra_meta", F.when(F.col("id") % 2 == 0, F.col("extra_meta")))
    return joins.named_targets(some, names).select("id", "target_name")


@report("j6_keyword_hits", r"""
    SELECT l3, keyword, pos, count(*) AS n FROM (SELECT replace(phrase, 'orreon', '×') AS p FROM vp) JOIN kw ON contains(p, keyword) GROUP BY ALL""")
def j6(t: Tables):
    return matching.keyword_hits(t.vp.select("phrase"), "phrase", t.lex).groupBy("l3", "keyword", "pos").agg(F.count("*").alias("n"))


@report("j6_large_dictionary", r"""
    SELECT k.l3, k.keyword, k.pos, count(*) AS n FROM (SELECT replace(phrase, 'orreon', '×') AS p FROM vp) JOIN kwl k ON contains(p, k.keyword) JOIN taxl t ON t.l3 = k.l3
    WHERE NOT t.is_fallback GROUP BY ALL""")
def j6b(t: Tables):
    return matching.keyword_hits(t.vp.select("phrase"), "phrase", LARGE).groupBy("l3", "keyword", "pos").agg(F.count("*").alias("n"))


@report("j7_reconcile", """
    SELECT platform, source_id, CASE WHEN d.id IS NULL THEN 'only_remote' WHEN r.id IS NULL THEN 'only_local' ELSE 'matched' END AS state
    FROM (SELECT * FROM vc WHERE likes IS NULL) d FULL JOIN (SELECT * FROM vc WHERE rating IS NOT NULL) r USING (platform, source_id)""")
def j7(t: Tables):
    return joins.reconcile(t.vc.filter(F.col("likes").isNull()), t.vc.filter(F.col("rating").isNotNull()))


@report("j8_layered_view", """
    SELECT c.id, c.target_id, CASE WHEN length(d.source) = 4 THEN concat('T ', d.source) END AS target_name, c.platform, c.content, c.sentiment, c.posted_at, c.likes
    FROM vc c JOIN documents d ON d.doc_id = c.id WHERE c.analyzed_at IS NOT NULL""")
def j8(t: Tables):
    cleaned = t.vc.select(F.col("id").alias("clean_id"), F.col("id").alias("raw_id"), "target_id", "platform", F.col("content").alias("cleaned_text"))
    tagged = t.vc.filter(F.col("analyzed_at").isNotNull()).select(F.col("id").alias("clean_id"), "sentiment")
    raw = t.vc.select(F.col("id").alias("raw_id"), "posted_at", "likes")
    source = F.element_at(F.split("target_id", ":"), -1)
    targets = t.vc.select("target_id").distinct().filter(F.length(source) == 4).select("target_id", F.concat(F.lit("T "), source).alias("name"), F.lit("game").alias("type"))
    return joins.layered_view(cleaned, tagged, raw, targets).select("id", "target_id", "target_name", "platform", "content", "sentiment", "posted_at", "likes")


@report("j9_zero_filled_tree", """
    SELECT t.l1, t.l2, t.l3, count(o.id) AS n FROM tax t LEFT JOIN (SELECT * FROM vo WHERE sentiment = 'neutral') o
      ON o.full_path = concat(t.l1, '/', t.l2, '/', t.l3) GROUP BY ALL""")
def j9(t: Tables):
    counts = t.vo.filter(F.col("sentiment") == "neutral").groupBy("full_path").agg(F.count("*").alias("n"))
    return joins.zero_filled(paths.path_dim(t.tax), counts, ["full_path"]).select("l1", "l2", "l3", "n")


@report("j10_label_agreement", f"""
    WITH {labels_sql("SELECT id, full_path AS expected, quote AS phrase FROM vo")}
    SELECT id, l3, split_part(expected, '/', -1) AS expected, l3 IS NOT DISTINCT FROM split_part(expected, '/', -1) AS ok FROM lab""")
def j10(t: Tables):
    predicted = matching.with_label(t.vo.select("id", "quote"), "quote", t.lex).select("id", "l3")
    expected = t.vo.select("id", F.element_at(F.split("full_path", "/"), -1).alias("l3"))
    return joins.agreement(predicted, expected, "id", "l3")


@report("u1_label_coverage", """
    SELECT l3, 'missing' AS state FROM (SELECT DISTINCT split_part(full_path, '/', -1) AS l3 FROM vo WHERE sentiment = 'neutral') WHERE l3 NOT IN (SELECT l3 FROM kw)
    UNION ALL SELECT l3, 'extra' FROM (SELECT DISTINCT l3 FROM kw) WHERE l3 NOT IN (SELECT split_part(full_path, '/', -1) FROM vo WHERE sentiment = 'neutral')""")
def u1(t: Tables):
    used = t.vo.filter(F.col("sentiment") == "neutral").select(F.element_at(F.split("full_path", "/"), -1).alias("l3"))
    return audit.label_coverage(used, t.kw)


@report("u2_vector_models", "SELECT model, count(*) AS n, min(dim) AS dim FROM ve GROUP BY model")
def u2(t: Tables):
    audit.single_space(t.ve, "m-1")
    return t.ve.groupBy("model").agg(F.count("*").alias("n"), F.min("dim").alias("dim"))


@report("c1_clean_text", r"""
    SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(content, 'http[^\s\x0b\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g'),
      '[^\p{L}\p{N}_\s\x0b\x1c-\x1f\x{85}\p{Z}]', ' ', 'g'), '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g')) AS clean FROM vc""")
def c1(t: Tables):
    return t.vc.select("id", tx.clean_text(F.col("content")).alias("clean"))


@report("c2_snippet", r"""
    WITH s AS (SELECT id, trim(regexp_replace(content, '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g')) AS c FROM vc)
    SELECT id, CASE WHEN length(c) > 80 THEN concat(substr(c, 1, 80), '…') ELSE c END AS text,
      CASE WHEN length(c) > 80 THEN substr(c, 1, 200) ELSE c END AS "full", length(c) > 80 AS truncated FROM s""")
def c2(t: Tables):
    return t.vc.select("id", tx.snippet(F.col("content")).alias("s")).select("id", "s.*")


@report("c3_path_segments", """
    SELECT id, split_part(full_path, '/', 1) AS l1, split_part(full_path, '/', 2) AS l2,
      substr(full_path, length(split_part(full_path, '/', 1)) + length(split_part(full_path, '/', 2)) + 3) AS l3 FROM vo""")
def c3(t: Tables):
    return t.vo.select("id", *(paths.segment(F.col("full_path"), x).alias(x.lower()) for x in ("L1", "L2", "L3")))


@report("c4_resolved_paths", """
    SELECT o.id, t.l1, t.l2, t.l3 FROM vo o JOIN tax t ON o.full_path = concat(t.l1, '/', t.l2, '/', t.l3) WHERE o.id % 2 = 0
    UNION ALL SELECT id, split_part(full_path, '/', 1), 'Other', 'Other' FROM vo WHERE id % 2 = 1""")
def c4(t: Tables):
    two = F.concat(F.element_at(F.split("full_path", "/"), 1), F.lit("/Other"))
    return paths.resolve_paths(t.vo.withColumn("full_path", F.when(F.col("id") % 2 == 1, two).otherwise(F.col("full_path"))), t.tax).select("id", "l1", "l2", "l3")


@report("c5_label_paths", """
    SELECT o.id, concat(t.l1, '/', t.l2, '/', t.l3) AS full_path FROM vo o JOIN tax t ON t.l3 = split_part(o.full_path, '/', -1)""")
def c5(t: Tables):
    labels = t.vo.select("id", F.element_at(F.split("full_path", "/"), -1).alias("l3"))
    return matching.with_path(labels, t.lex).select("id", "full_path")


@report("c6_naive_utc", """
    SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE make_timestamp((1700000000 + event_id) * 1000000) END AS ts FROM events""")
def c6(t: Tables):
    text = F.when(F.col("event_id") % 3 == 0, "n/a").otherwise((F.lit(1_700_000_000) + F.col("event_id")).cast("string"))
    return t.events.select("event_id", v.naive_utc(text).alias("ts"))


@report("c7_cleaned_sentiment", """
    SELECT event_id, CASE WHEN event_type = 'click' THEN 'positive' ELSE 'neutral' END AS sentiment,
      greatest(-1.0, least(1.0, value / 100 - 1)) AS score,
      CASE WHEN value / 50 > 0 AND value / 50 <= 1 THEN value / 50 ELSE least(1.0, abs(greatest(-1.0, least(1.0, value / 100 - 1)))) END AS confidence FROM events""")
def c7(t: Tables):
    score = v.clamped_score((F.col("value") / 100 - 1).cast("string"))
    return t.events.select(
        "event_id", v.sentiment_label(F.when(F.col("event_type") == "click", " POSITIVE ").otherwise(F.col("event_type"))).alias("sentiment"),
        score.alias("score"), v.clean_confidence((F.col("value") / 50).cast("string"), score).alias("confidence"))


@report("c8_stored_confidence", "SELECT event_id, CASE WHEN event_id % 4 <> 0 AND value / 100 BETWEEN 0 AND 1 THEN value / 100 END AS confidence FROM events")
def c8(t: Tables):
    text = F.when(F.col("event_id") % 4 == 0, "high").otherwise((F.col("value") / 100).cast("string"))
    return t.events.select("event_id", v.stored_confidence(text).alias("confidence"))


@report("c9_quote_spans", """
    SELECT p.id, p.pos, CAST(position(p.phrase IN c.content) - 1 AS INT) AS quote_start, CAST(position(p.phrase IN c.content) - 1 + length(p.phrase) AS INT) AS quote_end
    FROM vp p JOIN vc c ON c.id = p.id""")
def c9(t: Tables):
    none = F.lit(None).cast("int")
    pieces = t.vc.select("id", "content", F.posexplode(F.split("content", "[.]")).alias("pos", "phrase"))
    stripped = pieces.withColumn("phrase", tx.strip(F.col("phrase"))).filter(F.col("phrase") != "")
    return tx.with_quote_span(stripped, F.col("phrase"), F.col("content"), none, none).select("id", "pos", "quote_start", "quote_end")


@report("c10_response_bodies", """
    SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE concat('{"results": [{"index": 0, "sentiment": "', event_type, '"}]}') END AS body FROM events""")
def c10(t: Tables):
    json = F.concat(F.lit('{"results": [{"index": 0, "sentiment": "'), "event_type", F.lit('"}]}'))
    reply = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), json, F.lit("\n```"))).when(
        F.col("event_id") % 3 == 1, F.concat(F.lit("Here it is: "), json, F.lit(" done"))).otherwise("no answer")
    return t.events.select("event_id", tx.response_body(reply).alias("body"))


@report("c11_date_parts", """
    SELECT event_id, CAST(year(ts) AS INT) AS y, CAST(month(ts) AS INT) AS m, CASE WHEN event_id % 2 = 0 THEN CAST(day(ts) AS INT) END AS d FROM events""")
def c11(t: Tables):
    text = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy 年 M 月 d 日")).otherwise(F.date_format("ts", "yyyy年M月"))
    y, m, d = tx.date_parts(text)
    return t.events.select("event_id", y.alias("y"), m.alias("m"), d.alias("d"))


@report("c12_review_extras", """
    SELECT id, CAST(json_extract_string(extra_json, '$.playtime_at_review') AS BIGINT) AS playtime_at_review,
      coalesce(CAST(json_extract_string(extra_json, '$.refunded') AS BOOLEAN), false) AS refunded, false AS early_access,
      coalesce(CAST(json_extract_string(extra_json, '$.weighted_vote_score') AS DOUBLE), 0.5) AS weighted_vote_score,
      nullif(trim(json_extract_string(extra_json, '$.developer_response')), '') AS developer_response FROM vf""")
def c12(t: Tables):
    return t.vf.select("id", *v.extras_with_defaults(F.col("extra_json"), 0.5)).select(
        "id", "playtime_at_review", "refunded", "early_access", "weighted_vote_score", "developer_response")


@report("c13_probabilities", """
    SELECT event_id, CASE WHEN p > 0.5 THEN 'positive' WHEN p < 0.5 THEN 'negative' ELSE 'neutral' END AS sentiment,
      round(p - (1 - p), 9) AS sentiment_score, greatest(1 - p, p) AS sentiment_confidence
    FROM (SELECT event_id, CAST(event_id % 101 AS DOUBLE) / 100 AS p FROM events)""")
def c13(t: Tables):
    p = (F.col("event_id") % 101).cast("double") / 100
    rows = landed.probabilities_to_labels(t.events.select("event_id", (1 - p).alias("neg_prob"), p.alias("pos_prob")))
    return rows.select("event_id", "sentiment", F.round("sentiment_score", 9).alias("sentiment_score"), "sentiment_confidence")


@report("c14_display", """
    SELECT id, coalesce(strftime(analyzed_at, '%Y-%m-%d %H:%M'), '—') AS analyzed, format('{:.1f}', round(id / 60, 1)) AS hours,
      concat(format('{:.1f}', coalesce(round(likes / 50 * 100, 1), 0.0)), '%') AS pct FROM vc""")
def c14(t: Tables):
    return t.vc.select(
        "id", v.display_time(F.col("analyzed_at")).alias("analyzed"), v.display_hours(F.col("id")).alias("hours"),
        v.display_percent(F.coalesce("likes", F.lit(0)), F.lit(50)).alias("pct"))


@report("c15_patched_names", """
    SELECT id, CASE WHEN id % 2 = 0 THEN json_extract_string(extra_meta, '$.name') ELSE concat('App ', source_id) END AS name, 'game' AS type FROM vc""")
def c15(t: Tables):
    patched = v.patched_name(F.when(F.col("id") % 2 == 0, F.col("extra_meta")), F.concat(F.lit("App "), "source_id"))
    return t.vc.select("id", patched.alias("m")).select(
        "id", F.get_json_object("m", "$.name").alias("name"), F.get_json_object("m", "$.type").alias("type"))
