"""Scorecards, matrices, trends, word counts, audits and bullet comments."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions import values as v
from ..operators import audit, danmaku, filters, joins, matrix, metrics, nesting, trends, words
from .registry import report
from .tables import Tables, labels_sql
from .reports_core import PARSED

OVERVIEW = """
    SELECT target_id, coalesce(json_extract_string(max(extra_meta), '$.name'), target_id) AS name,
      substr(target_id, position(':' IN target_id) + 1) AS appid, count(*) AS total, count(analyzed_at) AS analyzed,
      round(CASE WHEN count(rating) > 0 THEN sum(rating) / count(rating) * 100 END, 1) AS recommend_rate, round(avg(sentiment_score), 3) AS avg_score,
      count(*) FILTER (WHERE sentiment = 'positive') AS pos, count(*) FILTER (WHERE sentiment = 'negative') AS neg,
      count(*) FILTER (WHERE sentiment = 'neutral') AS neu
    FROM vc GROUP BY target_id"""


@report("a1_target_overview", OVERVIEW)
def a1(t: Tables):
    return metrics.target_overview(t.vc)


@report("a1_target_overview_platform", OVERVIEW.replace("FROM vc", "FROM vc WHERE platform = 'steam'"))
def a1b(t: Tables):
    return metrics.target_overview(t.vc, "steam")


@report("a2_sentiment_share", f"""
    SELECT target_id, coalesce(round(pos / nullif(n, 0) * 100, 1), 0) AS positive, coalesce(round(neu / nullif(n, 0) * 100, 1), 0) AS neutral,
      coalesce(round(neg / nullif(n, 0) * 100, 1), 0) AS negative, n
    FROM (SELECT *, pos + neg + neu AS n FROM ({OVERVIEW}))""")
def a2(t: Tables):
    return metrics.sentiment_share(t.vc)


def cells_sql(level: str, extra: str = "") -> str:
    key = {"L1": "split_part(o.full_path, '/', 1)", "L2": "split_part(o.full_path, '/', 2)",
           "L3": "substr(o.full_path, length(split_part(o.full_path, '/', 1)) + length(split_part(o.full_path, '/', 2)) + 3)"}[level]
    return f"""
    c AS (SELECT {key} AS topic, v.target_id, count(*) AS n FROM vo o JOIN vc v ON v.id = o.comment_id
          WHERE o.full_path NOT LIKE 'Meta%' {extra} GROUP BY ALL),
    g AS (SELECT a.topic, b.target_id, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT topic FROM c) a
          CROSS JOIN (SELECT DISTINCT target_id FROM c) b LEFT JOIN c ON c.topic = a.topic AND c.target_id = b.target_id)"""


def long(t: Tables, level: str, **options):
    return matrix.filled(matrix.topic_counts(t.vo, t.vc, level, meta_l1="Meta", **options))


for _level in ("L1", "L2", "L3"):
    report(f"a3_topic_matrix_{_level.lower()}", f"WITH {cells_sql(_level)} SELECT * FROM g")(
        lambda t, level=_level: long(t, level))
report("a3_topic_matrix_negative", f"""WITH {cells_sql("L2", "AND o.sentiment = 'negative'")} SELECT * FROM g""")(
    lambda t: long(t, "L2", sentiment="negative"))


@report("a3_topic_matrix_exact", """
    SELECT x.l2 AS topic, v.target_id, count(*) AS n FROM vo o JOIN vc v ON v.id = o.comment_id
    JOIN tax x ON o.full_path = concat(x.l1, '/', x.l2, '/', x.l3) WHERE x.l1 <> 'Meta' GROUP BY ALL""")
def a3x(t: Tables):
    return matrix.topic_counts(t.vo, t.vc, "L2", meta_l1="Meta", tax=t.tax)


SHARES = f"""WITH {cells_sql("L2")},
    s AS (SELECT topic, target_id, n, n / (CASE WHEN sum(n) OVER w = 0 THEN 1 ELSE sum(n) OVER w END) * 100 AS share FROM g WINDOW w AS (PARTITION BY target_id))"""


@report("a4_matrix_shares", SHARES + " SELECT topic, target_id, n, round(share, 6) AS share FROM s")
def a4(t: Tables):
    return matrix.shares(long(t, "L2")).withColumn("share", F.round("share", 6))


@report("a5_matrix_deviations", SHARES + """
    SELECT topic, target_id, round(share, 6) AS share, round(share - avg(share) OVER (PARTITION BY topic), 6) AS deviation FROM s""")
def a5(t: Tables):
    return matrix.deviations(long(t, "L2")).select("topic", "target_id", F.round("share", 6).alias("share"), F.round("deviation", 6).alias("deviation"))


@report("a6_pain_points", f"""
    WITH {cells_sql("L2", "AND o.sentiment = 'negative'")}
    SELECT * FROM (SELECT target_id, topic, n, row_number() OVER (PARTITION BY target_id ORDER BY n DESC, topic) AS rn FROM c) WHERE rn <= 5""")
def a6(t: Tables):
    return matrix.pain_points(t.vo, t.vc, meta_l1="Meta").select("target_id", "topic", "n", "rn")


@report("a7_sentiment_distribution", """
    SELECT sentiment, count(*) AS n, round(count(*) / (sum(count(*)) OVER ()) * 100, 1) AS ratio FROM vc WHERE sentiment IS NOT NULL GROUP BY sentiment""")
def a7(t: Tables):
    return metrics.sentiment_distribution(t.vc)


@report("a8_topic_distribution", "SELECT topic, count(*) AS n FROM vf WHERE topic IS NOT NULL GROUP BY topic ORDER BY n DESC, topic LIMIT 10")
def a8(t: Tables):
    return metrics.topic_distribution(t.vf)


@report("a9_single_target_kpis", """
    SELECT count(*) AS n, round(count(*) FILTER (WHERE sentiment = 'positive') / count(*) * 100, 1) AS positive_pct,
      round(count(*) FILTER (WHERE sentiment = 'negative') / count(*) * 100, 1) AS negative_pct, round(avg(sentiment_score), 2) AS avg_score FROM vc""")
def a9(t: Tables):
    return metrics.single_target_kpis(t.vc)


@report("a10_compare_kpis", f"""
    SELECT name, target_id, total, recommend_rate, round(avg_score, 2) AS avg_score, coalesce(round(pos / nullif(pos + neg + neu, 0) * 100, 1), 0) AS positive_pct,
      coalesce(round(neg / nullif(pos + neg + neu, 0) * 100, 1), 0) AS negative_pct FROM ({OVERVIEW})""")
def a10(t: Tables):
    return metrics.compare_kpis(t.vc)


@report("a11_score_histogram", """
    SELECT CAST(least(29, floor((sentiment_score + 1) * 30 / 2)) AS INT) AS bin, sentiment, count(*) AS n FROM vc
    WHERE sentiment_score IS NOT NULL GROUP BY ALL""")
def a11(t: Tables):
    return metrics.score_histogram(t.vc)


@report("a12_keyword_frequency", r"""
    WITH c AS (SELECT trim(regexp_replace(regexp_replace(regexp_replace(content, 'http[^\s\x0b\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g'),
      '[^\p{L}\p{N}_\s\x0b\x1c-\x1f\x{85}\p{Z}]', ' ', 'g'), '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g')) AS clean FROM vc),
    w AS (SELECT unnest(string_split(clean, ' ')) AS word FROM c)
    SELECT word, count(*) AS n FROM w WHERE length(word) >= 2 AND lower(word) NOT IN ('the', 'of', 'and', 'steam')
    GROUP BY word ORDER BY n DESC, word LIMIT 50""")
def a12(t: Tables):
    return words.keyword_frequency(t.vc, stopwords=["the", "of", "and", "steam"])


LETTERS, GLYPHS = "abcdefghijklmnopqrstuvwxyz", "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏闰余"


@report("a13_target_words", f"""
    WITH s AS (SELECT concat('steam:', role) AS target_id, regexp_extract_all(translate(lower(text), '{LETTERS}', '{GLYPHS}'), '[一-鿿]+') AS runs FROM conversations),
    r AS (SELECT target_id, unnest(runs) AS run FROM s),
    g AS (SELECT target_id, substr(run, CAST(i AS BIGINT), CAST(k AS BIGINT)) AS word
          FROM r, (SELECT unnest(range(2, 7)) AS k) ks, unnest(range(1, length(run) - ks.k + 2)) AS u(i)),
    c AS (SELECT target_id, word, count(*) AS n FROM g WHERE word <> '来宙' GROUP BY ALL),
    t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY n DESC, word) AS k FROM c) WHERE k <= 40)
    SELECT target_id, word, n, rn FROM (
      SELECT target_id, word, n, row_number() OVER (PARTITION BY target_id ORDER BY n DESC, word) AS rn FROM t
      WHERE NOT contains('名来来', word)) WHERE rn <= 30""")
def a13(t: Tables):
    rows = t.conversations.select(
        F.concat(F.lit("steam:"), "role").alias("target_id"), F.translate(F.lower("text"), LETTERS, GLYPHS).alias("content"),
        F.lit('{"name": "名来来"}').alias("extra_meta"))
    return words.target_words(rows, stopwords=["来宙"])


@report("a14_rating_cards", """
    SELECT target_id, local_count, pct AS local_recommend_pct, CASE WHEN pct >= 95 THEN '好评如潮' WHEN pct >= 90 THEN '特别好评' WHEN pct >= 80 THEN '好评'
      WHEN pct >= 70 THEN '多半好评' WHEN pct >= 40 THEN '褒贬不一' WHEN pct >= 20 THEN '多半差评' ELSE '差评' END AS local_rating
    FROM (SELECT target_id, count(*) AS local_count, round(coalesce(sum(rating), 0) / count(*) * 100, 1) AS pct FROM vc GROUP BY target_id)""")
def a14(t: Tables):
    return metrics.rating_card(t.vc)


@report("a15_tag_counts", f"""
    WITH s AS (SELECT unnest({PARSED}) AS sub FROM vf)
    SELECT 'L1' AS level, d.name, count(f.id) AS n FROM (SELECT DISTINCT l1 AS name FROM tax) d LEFT JOIN vf f ON f.topic = d.name GROUP BY d.name
    UNION ALL SELECT 'L2', d.name, count(s.sub) FROM (SELECT DISTINCT l2 AS name FROM tax) d LEFT JOIN s ON s.sub = d.name GROUP BY d.name
    UNION ALL SELECT 'L3', d.name, count(o.id) FROM (SELECT concat(l1, '/', l2, '/', l3) AS name FROM tax) d
      LEFT JOIN vo o ON concat(split_part(o.full_path, '/', 1), '/', split_part(o.full_path, '/', 2), '/', split_part(o.full_path, '/', 3)) = d.name GROUP BY d.name""")
def a15(t: Tables):
    return matrix.tag_counts(t.vf, t.vo, t.tax)


@report("a15_tag_rollup", """
    WITH r AS (SELECT x.l1, x.l2, x.l3, count(*) AS n FROM vo o JOIN tax x ON o.full_path = concat(x.l1, '/', x.l2, '/', x.l3) GROUP BY ALL)
    SELECT 'L3' AS level, l1, l2, l3, n FROM r UNION ALL
    SELECT 'L2', l1, l2, NULL, CAST(sum(n) AS BIGINT) FROM r GROUP BY l1, l2 UNION ALL SELECT 'L1', l1, NULL, NULL, CAST(sum(n) AS BIGINT) FROM r GROUP BY l1""")
def a15b(t: Tables):
    return matrix.tag_rollup(t.vo, t.tax)


@report("a16_games_list", """
    SELECT target_id, json_extract_string(min(extra_meta), '$.name') AS name, count(*) AS n FROM vc GROUP BY target_id""")
def a16(t: Tables):
    return metrics.games_list(t.vc)


KPI = """
    SELECT count(*) AS total, count(DISTINCT target_id) AS games, count(*) FILTER (WHERE sentiment = 'positive') AS positive,
      round(count(*) FILTER (WHERE sentiment = 'positive') / count(*) * 100, 1) AS positive_rate FROM """
UNITS = "(SELECT o.*, v.target_id, v.posted_at, v.rating FROM vo o JOIN vc v ON v.id = o.comment_id)"


def opinion_units(t: Tables):
    return joins.with_comment(t.vo, t.vc, "target_id", "posted_at", "rating")


@report("a17_report_kpis_voices", KPI + "vc")
def a17(t: Tables):
    return metrics.report_kpis(t.vc)


@report("a17_report_kpis_opinions", KPI + UNITS)
def a17b(t: Tables):
    return metrics.report_kpis(opinion_units(t))


def series_sql(mode: str, key: str = "") -> str:
    return f"""
    SELECT CAST(date_trunc('{mode}', posted_at) AS DATE) AS bucket, {key} count(*) AS total, count(*) FILTER (WHERE sentiment = 'positive') AS pos,
      count(*) FILTER (WHERE rating = 1) AS rec FROM vc GROUP BY ALL"""


@report("a18_series_day", series_sql("day"))
def a18(t: Tables):
    return trends.time_series(t.vc)


@report("a18_series_week_by_game", series_sql("week", "target_id,"))
def a18b(t: Tables):
    return trends.time_series(t.vc, "week", by_game=True)


TOP5 = "top5 AS (SELECT target_id FROM vc GROUP BY target_id ORDER BY count(*) DESC, target_id LIMIT 5)"


@report("a19_top_game_trend", f"""
    WITH {TOP5}, b AS (SELECT DISTINCT CAST(date_trunc('day', posted_at) AS DATE) AS bucket FROM vc),
    c AS (SELECT CAST(date_trunc('day', posted_at) AS DATE) AS bucket, target_id, count(*) AS total, count(*) FILTER (WHERE sentiment = 'positive') AS pos FROM vc GROUP BY ALL)
    SELECT b.bucket, g.target_id, coalesce(c.total, 0) AS total, coalesce(c.pos, 0) AS pos, coalesce(round(c.pos / c.total * 100, 1), 0) AS positive_rate
    FROM b CROSS JOIN top5 g LEFT JOIN c ON c.bucket = b.bucket AND c.target_id = g.target_id""")
def a19(t: Tables):
    return trends.top_game_trend(t.vc)


@report("a20_sentiment_rows", f"""
    WITH {TOP5}, r AS (SELECT '(all)' AS name, sentiment FROM vc UNION ALL SELECT target_id, sentiment FROM vc WHERE target_id IN (SELECT target_id FROM top5))
    SELECT name, count(*) AS total, count(*) FILTER (WHERE sentiment = 'positive') AS pos,
      count(*) - count(*) FILTER (WHERE sentiment = 'positive') - count(*) FILTER (WHERE sentiment = 'negative') AS neu,
      count(*) FILTER (WHERE sentiment = 'negative') AS neg FROM r GROUP BY name""")
def a20(t: Tables):
    return matrix.sentiment_rows(t.vc)


def drill_sql(key: str, where: str = "true") -> str:
    return f"SELECT topic, count(*) AS n FROM (SELECT {key} AS topic FROM vo WHERE {where}) GROUP BY topic ORDER BY n DESC, topic LIMIT 5"


report("a21_drill_l1", drill_sql("split_part(full_path, '/', 1)"))(lambda t: matrix.drill_topics(t.vo, "L1"))
report("a21_drill_l2", drill_sql("split_part(full_path, '/', 2)", "split_part(full_path, '/', 1) = 'Meta'"))(
    lambda t: matrix.drill_topics(t.vo, "L2", ["Meta"]))
report("a21_drill_l3", drill_sql("full_path", "full_path LIKE 'Mechanics/Core/%'"))(
    lambda t: matrix.drill_topics(t.vo, "L3", ["Mechanics", "Core"]))


@report("a21_drill_voices_l2", f"""
    SELECT topic, count(*) AS n FROM (SELECT unnest({PARSED}) AS topic FROM vf WHERE topic = 'Meta') GROUP BY topic ORDER BY n DESC, topic LIMIT 5""")
def a21v(t: Tables):
    return matrix.top_topics(matrix.voice_topics(t.vf, t.vo, "L2", ["Meta"]))


@report("a21_drill_voices_l3", f"""
    SELECT split_part(o.full_path, '/', -1) AS topic, count(*) AS n FROM vo o JOIN vf f ON f.id = o.comment_id
    WHERE f.topic = 'Mechanics' AND list_contains({PARSED}, 'Core') GROUP BY ALL ORDER BY n DESC, topic LIMIT 5""")
def a21w(t: Tables):
    return matrix.top_topics(matrix.voice_topics(t.vf, t.vo, "L3", ["Mechanics", "Core"]))


@report("a22_topic_by_game", f"""
    WITH u AS {UNITS}, g AS (SELECT target_id FROM u GROUP BY target_id ORDER BY count(*) DESC, target_id LIMIT 5),
    p AS (SELECT split_part(full_path, '/', 1) AS topic FROM u GROUP BY topic ORDER BY count(*) DESC, topic LIMIT 5)
    SELECT p.topic, g.target_id, count(u.id) AS n FROM p CROSS JOIN g LEFT JOIN u ON split_part(u.full_path, '/', 1) = p.topic AND u.target_id = g.target_id GROUP BY ALL""")
def a22(t: Tables):
    units = opinion_units(t)
    topic, keep = matrix.opinion_topics("L1", [])
    return matrix.topic_by_game(units, topic, keep)


@report("a23_top_games", """
    SELECT target_id, count(*) AS n, count(*) FILTER (WHERE sentiment = 'positive') AS positive,
      round(count(*) FILTER (WHERE sentiment = 'positive') / count(*) * 100, 1) AS positive_rate FROM vc GROUP BY target_id ORDER BY n DESC, target_id LIMIT 5""")
def a23(t: Tables):
    return metrics.top_games(t.vc)


@report("a24_ingest_by_day", "SELECT CAST(posted_at AS DATE) AS day, count(*) AS n, min(posted_at) AS first, max(posted_at) AS last FROM vc GROUP BY ALL")
def a24(t: Tables):
    return audit.ingest_by_day(t.vc)


@report("a24_null_states", """
    SELECT count(*) AS n, count(*) FILTER (WHERE likes IS NULL) AS null_likes, count(likes) AS has_likes, count(*) FILTER (WHERE analyzed_at IS NULL) AS not_analyzed
    FROM vc WHERE posted_at >= TIMESTAMP '2024-01-10' AND posted_at < TIMESTAMP '2024-01-20'""")
def a24b(t: Tables):
    return audit.null_states(t.vc.filter(filters.within(F.col("posted_at"), datetime(2024, 1, 10), datetime(2024, 1, 20))))


@report("a24_by_rating_and_language", "SELECT rating, language, count(*) AS n FROM vc GROUP BY ALL")
def a24c(t: Tables):
    return metrics.plain_counts(t.vc, "rating", "language")


@report("a25_store_stats", """
    SELECT *, round(analyzed / comments * 100, 1) AS analyzed_pct, round(opinions / analyzed, 1) AS opinions_per_comment
    FROM (SELECT (SELECT count(*) FROM vc) AS comments, (SELECT count(analyzed_at) FROM vc) AS analyzed, (SELECT count(*) FROM vo) AS opinions)""")
def a25(t: Tables):
    return metrics.store_stats(t.vc, t.vo)


@report("a25_by_topic_and_target", "SELECT topic, target_id, count(*) AS n FROM vf GROUP BY ALL")
def a25b(t: Tables):
    return metrics.plain_counts(t.vf, "topic", "target_id")


@report("a26_path_sentiment_top", "SELECT full_path, sentiment, count(*) AS n FROM vo GROUP BY ALL ORDER BY n DESC, full_path, sentiment LIMIT 10")
def a26(t: Tables):
    return metrics.path_sentiment_top(t.vo)


@report("a27_fallback_share", """
    SELECT split_part(full_path, '/', 1) AS l1, count(*) AS n, round(count(*) / (sum(count(*)) OVER ()) * 100, 1) AS share, split_part(full_path, '/', 1) = 'Meta' AS is_meta
    FROM vo GROUP BY ALL""")
def a27(t: Tables):
    return audit.fallback_share(t.vo, "Meta")


@report("a27_topic_share", "SELECT topic, count(*) AS n, round(count(*) / (sum(count(*)) OVER ()) * 100, 1) AS share FROM vf GROUP BY topic")
def a27b(t: Tables):
    return audit.topic_share(t.vf)


@report("a27_fallback_composition", "SELECT full_path, count(*) AS n FROM vo WHERE full_path LIKE 'Meta/%' GROUP BY full_path")
def a27c(t: Tables):
    return audit.fallback_composition(t.vo, "Meta")


@report("a27_label_counts", """
    SELECT x.l3, count(o.id) AS n FROM (SELECT unnest(['Combat', 'Score', 'Nowhere']) AS l3) x LEFT JOIN vo o ON ends_with(o.full_path, x.l3) GROUP BY x.l3""")
def a27d(t: Tables):
    return audit.ends_with_label(t.vo, ["Combat", "Score", "Nowhere"])


VD_LABELS = labels_sql("SELECT *, content AS phrase FROM vd")


@report("a28_danmaku_labels", f"""
    WITH {VD_LABELS}, p AS (SELECT full_path, count(*) AS n FROM labp GROUP BY full_path), h AS (SELECT * FROM p WHERE full_path IS NOT NULL),
    m AS (SELECT CASE WHEN full_path IS NULL THEN 'unmatched' ELSE 'matched' END AS label, CAST(sum(n) AS BIGINT) AS n FROM p GROUP BY ALL),
    a AS (SELECT split_part(full_path, '/', 1) AS label, CAST(sum(n) AS BIGINT) AS n FROM h GROUP BY ALL),
    b AS (SELECT split_part(full_path, '/', 2) AS label, CAST(sum(n) AS BIGINT) AS n FROM h GROUP BY ALL)
    SELECT 'match' AS kind, label, n, round(n / (sum(n) OVER ()) * 100, 1) AS pct FROM m
    UNION ALL SELECT 'L1', label, n, round(n / (sum(n) OVER ()) * 100, 1) FROM a
    UNION ALL SELECT * FROM (SELECT 'L2', label, n, round(n / (sum(n) OVER ()) * 100, 1) FROM b ORDER BY n DESC, label LIMIT 15)
    UNION ALL SELECT * FROM (SELECT 'path', full_path, n, round(n / (sum(n) OVER ()) * 100, 1) FROM h ORDER BY n DESC, full_path LIMIT 15)""")
def a28(t: Tables):
    return danmaku.label_distribution(t.vd, t.lex)


TONE_SQL = "CASE WHEN contains(content, 'ing') THEN 'positive' WHEN contains(content, 'er') THEN 'negative' ELSE 'neutral' END"


def window_sql(keys: str) -> str:
    return f"""
    WITH {VD_LABELS}, w AS (SELECT *, CAST(floor(progress / 30) AS BIGINT) AS "window", {TONE_SQL} AS tone FROM labp),
    c AS (SELECT {keys}, full_path, count(*) AS n FROM w WHERE full_path IS NOT NULL GROUP BY ALL),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY n DESC, full_path) AS rn FROM c) WHERE rn = 1),
    a AS (SELECT {keys}, count(*) AS volume, count(*) FILTER (WHERE tone = 'positive') AS praise, count(*) FILTER (WHERE tone = 'negative') AS criticize FROM w GROUP BY ALL)
    SELECT {keys}, "window" * 30 AS start, volume, b.full_path AS top_path, b.n AS top_n, praise, criticize FROM a LEFT JOIN b USING ({keys})"""


@report("a29_danmaku_windows", window_sql('"window"'))
def a29(t: Tables):
    return danmaku.windows(t.vd, t.lex)


@report("a29_danmaku_windows_by_video", window_sql('video_id, "window"'))
def a29b(t: Tables):
    return danmaku.windows(t.vd, t.lex, per_video=True)


GAPS = f"""
    WITH {labels_sql("SELECT quote, quote AS phrase, count(*) AS n FROM vo WHERE full_path LIKE 'Meta/Impression/Overall%' AND length(quote) >= 6 GROUP BY quote")},
    k AS (SELECT quote, n, l3, length(quote) AS chars, CASE WHEN l3 IS NOT NULL AND l3 NOT IN ('Overall', 'Recommend') THEN 'rescued'
      WHEN contains(lower(quote), 'ing') OR contains(lower(quote), 'er') OR contains(lower(quote), 'anti') THEN 'overall'
      WHEN regexp_full_match(quote, '\\d+') OR regexp_full_match(replace(quote, ' ', ''), '[A-Za-z]+') THEN 'noise' ELSE 'candidate' END AS kind FROM lab)"""


def gaps(t: Tables):
    return audit.dictionary_gaps(t.vo, t.lex, "Meta/Impression/Overall")


@report("a30_dictionary_gaps", GAPS + " SELECT quote, n, kind FROM k")
def a30(t: Tables):
    return gaps(t).select("quote", "n", "kind")


@report("a30_gap_summary", GAPS + " SELECT kind, count(*) AS phrases, CAST(sum(n) AS BIGINT) AS opinions FROM k GROUP BY kind")
def a30b(t: Tables):
    return audit.gap_summary(gaps(t))


@report("a30_gap_candidates", GAPS + " SELECT quote, n FROM k WHERE kind = 'candidate' ORDER BY n DESC, chars DESC, quote LIMIT 200")
def a30c(t: Tables):
    return audit.gap_candidates(gaps(t)).select("quote", "n")


STEAM = "comment_id IN (SELECT id FROM vc WHERE platform = 'steam') AND full_path LIKE 'Meta/Impression/Overall%'"


@report("a30_gap_totals", GAPS.replace("FROM vo WHERE", f"FROM vo WHERE {STEAM} AND") + f"""
    SELECT kind, count(*) AS phrases, CAST(sum(n) AS BIGINT) AS opinions FROM k GROUP BY kind
    UNION ALL SELECT 'total', count(DISTINCT quote), count(*) FROM vo WHERE {STEAM}""")
def a30d(t: Tables):
    """One platform, with the total."""
    path, only = "Meta/Impression/Overall", {"comments": t.vc, "platform": "steam"}
    return audit.gap_totals(t.vo, audit.dictionary_gaps(t.vo, t.lex, path, **only), path, **only)


@report("a31_refresh_coverage", """
    SELECT target_id, count(*) FILTER (WHERE likes IS NULL) AS null_likes, count(likes) AS filled_likes, min(posted_at) AS first, max(posted_at) AS last,
      CAST(date_diff('day', min(posted_at), TIMESTAMP '2024-02-01') AS INT) AS oldest_days, CAST(date_diff('day', max(posted_at), TIMESTAMP '2024-02-01') AS INT) AS newest_days,
      min(likes) AS min_likes, max(likes) AS max_likes, round(avg(likes), 2) AS avg_likes FROM vc GROUP BY target_id""")
def a31(t: Tables):
    return audit.refresh_coverage(t.vc, datetime(2024, 2, 1))


@report("a32_run_summary", """
    WITH g AS (SELECT target_id, count(*) AS fetched, count(analyzed_at) AS analyzed, min(id) % 5 <> 0 AS ok FROM vc GROUP BY target_id)
    SELECT count(*) FILTER (WHERE ok) AS ok_targets, count(*) FILTER (WHERE NOT ok) AS failed_targets, CAST(sum(fetched) AS BIGINT) AS fetched, CAST(sum(analyzed) AS BIGINT) AS analyzed FROM g""")
def a32(t: Tables):
    return audit.run_summary(t.vc.groupBy("target_id").agg(
        F.count("*").alias("fetched"), F.count("analyzed_at").alias("analyzed"), (F.min("id") % 5 != 0).alias("ok")))


@report("a33_annotation_distribution", """
    WITH d AS (SELECT * FROM vf WHERE analyzed_at IS NOT NULL)
    SELECT 'topic' AS kind, coalesce(topic, '(none)') AS label, count(*) AS n FROM d GROUP BY ALL
    UNION ALL SELECT 'sentiment', coalesce(sentiment, '(none)'), count(*) FROM d GROUP BY ALL
    UNION ALL SELECT * FROM (SELECT 'path', full_path, count(*) AS n FROM vo GROUP BY full_path ORDER BY n DESC, full_path LIMIT 20)
    UNION ALL SELECT 'unmatched', 'comments', count(*) FROM d WHERE id NOT IN (SELECT comment_id FROM vo)""")
def a33(t: Tables):
    return audit.annotation_distribution(t.vf, t.vo)


@report("a34_nested_opinions", """
    SELECT comment_id, CAST(0 AS BIGINT) AS slice, CAST(count(*) AS INT) AS size, string_agg(concat(CAST(id AS VARCHAR), '=', full_path), '|' ORDER BY id) AS opinions FROM vo GROUP BY comment_id""")
def a34(t: Tables):
    rows = nesting.whole_opinions(t.vo)
    shown = F.transform("opinions", lambda o: F.concat(o["id"].cast("string"), F.lit("="), o["path"]))
    return rows.select("comment_id", F.lit(0).cast("bigint").alias("slice"), F.size("opinions").alias("size"), F.array_join(shown, "|").alias("opinions"))


@report("a34_second_levels", """
    SELECT comment_id, string_agg(l2, '|' ORDER BY l2) AS sub_topics FROM (
      SELECT DISTINCT o.comment_id, t.l2 FROM vo o JOIN tax t ON o.full_path = concat(t.l1, '/', t.l2, '/', t.l3)) GROUP BY comment_id""")
def a34b(t: Tables):
    return nesting.second_levels(t.vo, t.tax).select("comment_id", F.array_join("sub_topics", "|").alias("sub_topics"))


@report("a35_duplicate_keys", "SELECT video_id, progress, content, user_hash, count(*) AS n FROM vd GROUP BY ALL HAVING count(*) > 1")
def a35(t: Tables):
    return audit.duplicate_keys(t.vd, "video_id", "progress", "content", "user_hash")


@report("a36_store_ratings", """
    SELECT id, CASE WHEN id % 11 IN (1, 2) THEN '差评' WHEN id % 11 IN (3, 4, 5) THEN '褒贬不一' WHEN id % 11 IN (6, 7) THEN '好评'
      WHEN id % 11 = 8 THEN '特别好评' WHEN id % 11 = 9 THEN '好评如潮' ELSE '无' END AS rating_text FROM vc""")
def a36(t: Tables):
    return t.vc.select("id", v.store_rating(F.col("id") % 11).alias("rating_text"))


@report("a37_small_samples", "SELECT target_id, count(*) AS n, count(*) < 100 AS small_sample FROM vc GROUP BY target_id")
def a37(t: Tables):
    return metrics.small_sample_flag(metrics.plain_counts(t.vc, "target_id"), "n", 100)


@report("a38_purge_report", """
    SELECT count(*) FILTER (WHERE posted_at <= TIMESTAMP '2024-01-02') AS removed_old,
      count(*) FILTER (WHERE posted_at > TIMESTAMP '2024-01-02' AND language <> 'en') AS removed_language,
      count(*) FILTER (WHERE posted_at > TIMESTAMP '2024-01-02' AND language = 'en') AS remaining FROM vc""")
def a38(t: Tables):
    return audit.purge_report(t.vc, datetime(2024, 1, 2), "en")


@report("a38_remaining_by_day", """
    SELECT CAST(posted_at AS DATE) AS day, count(*) AS n FROM vc WHERE posted_at > TIMESTAMP '2024-01-02' AND language = 'en' GROUP BY ALL""")
def a38b(t: Tables):
    return audit.ingest_by_day(filters.retained(t.vc, datetime(2024, 1, 2), "en")).select("day", "n")


@report("a39_coverage", """
    SELECT target_id, count(*) AS total, count(*) FILTER (WHERE language <> 'en') AS other_language, CAST(min(posted_at) AS DATE) AS first_day,
      CAST(max(posted_at) AS DATE) AS last_day, count(*) FILTER (WHERE posted_at >= TIMESTAMP '2024-01-02' AND posted_at < TIMESTAMP '2024-01-03') AS in_window,
      count(*) FILTER (WHERE rating = 1) AS liked, count(*) FILTER (WHERE rating = 0) AS disliked, count(*) FILTER (WHERE rating IS NULL) AS unrated
    FROM vc GROUP BY target_id""")
def a39(t: Tables):
    return audit.coverage(t.vc, "en", datetime(2024, 1, 2), datetime(2024, 1, 3))


@report("a39_landing_days", "SELECT CAST(fetched_at AS DATE) AS day, count(*) AS n FROM vf GROUP BY ALL")
def a39b(t: Tables):
    return audit.ingest_by_day(t.vf, "fetched_at").select("day", "n")


@report("a40_hourly_volume", "SELECT date_trunc('hour', posted_at) AS hour, count(*) AS n FROM vc WHERE target_id = 'steam:src1' GROUP BY ALL")
def a40(t: Tables):
    return audit.hourly_volume(t.vc, "steam:src1")


@report("a41_window_volume", """
    SELECT g.target_id, count(c.id) AS n FROM (SELECT DISTINCT target_id FROM vc) g
    LEFT JOIN vc c ON c.target_id = g.target_id AND c.posted_at >= TIMESTAMP '2024-01-02' AND c.posted_at < TIMESTAMP '2024-01-03' GROUP BY ALL""")
def a41(t: Tables):
    return audit.window_volume(t.vc, t.vc.select("target_id").distinct(), datetime(2024, 1, 2), datetime(2024, 1, 3))


@report("a42_comments_by_platform", "SELECT platform, count(*) AS n FROM vc GROUP BY platform")
def a42(t: Tables):
    return metrics.plain_counts(t.vc, "platform")


@report("a42_danmaku_by_video", "SELECT video_id, count(*) AS n FROM vd GROUP BY video_id")
def a42b(t: Tables):
    return metrics.plain_counts(t.vd, "video_id")


@report("a42_vectors", "SELECT count(*) AS n FROM ve")
def a42c(t: Tables):
    return metrics.plain_counts(t.ve)
