"""Ordered computations, annotation, merges, vectors, incremental and streaming jobs."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from .. import schemas
from ..operators import annotate, incremental, matching, merge, ordering, vectors
from ..session import run_dir
from ..sources.pages import Pages
from ..sources.snapshots import Snapshots
from ..streaming import jobs
from . import daily
from .registry import report
from .tables import LARGE, Tables, labels_sql, strip_sql

NOW = datetime(2024, 3, 1)
NOW_SQL = "TIMESTAMP '2024-03-01'"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


# ---- ordered computations

@report("w1_best_labels", rf"""
    WITH p AS (SELECT id, pos, replace({strip_sql('phrase')}, 'orreon', '×') AS m FROM vp),
    s AS (SELECT p.id, p.pos, k.l3, sum(length(k.keyword)) AS score, min(t.ord) AS ord FROM p JOIN kw k ON contains(p.m, k.keyword) JOIN tax t ON t.l3 = k.l3
          WHERE NOT t.is_fallback GROUP BY ALL)
    SELECT id, pos, l3 FROM (SELECT *, row_number() OVER (PARTITION BY id, pos ORDER BY score DESC, ord) AS rn FROM s) WHERE rn = 1""")
def w1(t: Tables):
    rows = t.vp.withColumn("m", matching.masked(F.col("phrase"), t.lex))
    found = F.filter(F.array(matching.best_label(F.col("m"), t.lex)), lambda x: x.isNotNull())
    return rows.select("id", "pos", F.explode(found).alias("l3"))


def replies(t: Tables) -> DataFrame:
    """Opinions as a model would return them."""
    turn = (F.col("id") % 1000).cast("int")
    return t.vo.select(
        F.col("comment_id").alias("id"), turn.alias("pos"), F.col("quote").alias("phrase"), "sentiment",
        (F.col("sentiment_confidence") - 0.5).alias("sentiment_score"), "sentiment_confidence", (turn >= 2).alias("is_core"), "full_path")


REPLIES_SQL = """SELECT comment_id AS id, CAST(id % 1000 AS INT) AS pos, quote AS phrase, sentiment, sentiment_confidence - 0.5 AS sentiment_score,
    sentiment_confidence, id % 1000 >= 2 AS is_core, full_path AS given FROM vo"""


@report("w2_core_opinions", f"""
    WITH r AS ({REPLIES_SQL})
    SELECT id, pos, row_number() OVER (PARTITION BY id ORDER BY is_core DESC, pos) = 1 AS is_core FROM r""")
def w2(t: Tables):
    return annotate.core_flags(replies(t)).select("id", "pos", "is_core")


@report("w3_first_specific", """
    SELECT comment_id, split_part(full_path, '/', 1) AS first_l1 FROM (
      SELECT *, row_number() OVER (PARTITION BY comment_id ORDER BY id) AS rn FROM vo WHERE full_path NOT LIKE 'Meta/%') WHERE rn = 1""")
def w3(t: Tables):
    return annotate.first_specific(t.vo, "Meta", [x[1] for x in t.lex.taxonomy])


SHUFFLED = "SELECT id, target_id, posted_at + to_minutes((id * 7919) % 100000) AS posted_at FROM vc"


def shuffled_times(t: Tables) -> DataFrame:
    late = F.make_dt_interval(mins=((F.col("id") * 7919) % 100000).cast("int"))
    return t.vc.select("id", "target_id", (F.col("posted_at") + late).alias("posted_at"))


BREAKS = f"""
    WITH s AS ({SHUFFLED}), o AS (
      SELECT *, row_number() OVER w AS position, lag(posted_at) OVER w AS prev, lead(posted_at) OVER w AS n1, lead(posted_at, 2) OVER w AS n2
      FROM s WINDOW w AS (PARTITION BY target_id ORDER BY id)),
    b AS (SELECT target_id, id, position, CASE WHEN posted_at > prev THEN 1 WHEN posted_at < prev THEN -1 WHEN prev IS NOT NULL THEN 0 END AS step,
      coalesce(posted_at < n1 AND n1 < n2, false) AS triple_rise FROM o)"""


@report("w4_order_breaks", BREAKS + " SELECT target_id, id, position, CAST(step AS INT) AS step, triple_rise FROM b")
def w4(t: Tables):
    return ordering.order_breaks(shuffled_times(t))


@report("w4_order_break_summary", BREAKS + """
    SELECT target_id, count(*) AS rows, count(*) FILTER (WHERE step = 1) AS violations, count(*) FILTER (WHERE step = 0) AS equal_times,
      count(*) FILTER (WHERE triple_rise) AS triple_rises FROM b GROUP BY target_id""")
def w4b(t: Tables):
    return ordering.order_break_summary(shuffled_times(t))


@report("w5_hybrid_sample", """
    WITH c AS (SELECT id, target_id, likes, posted_at, count(*) OVER (PARTITION BY target_id) AS n FROM vc),
    a AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY likes DESC NULLS LAST, id) AS r FROM c WHERE n > 20),
    rest AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY posted_at DESC, id) AS q FROM a WHERE r > 12)
    SELECT target_id, id, 'all' AS stratum FROM c WHERE n <= 20 UNION ALL SELECT target_id, id, 'liked' FROM a WHERE r <= 12
    UNION ALL SELECT target_id, id, 'newest' FROM rest WHERE q <= 8""")
def w5(t: Tables):
    return ordering.hybrid_sample(t.vc, whole_up_to=20, by_likes=12, by_time=8)


@report("u3_sample_strata", """
    WITH c AS (SELECT id, target_id, likes, count(*) OVER (PARTITION BY target_id) AS n FROM vc)
    SELECT 'all' AS kind, CAST(count(*) AS INT) AS rows FROM c WHERE n <= 20 HAVING count(*) > 0
    UNION ALL SELECT 'cut', CAST(20 * count(DISTINCT target_id) AS INT) FROM c WHERE n > 20 HAVING count(*) > 0""")
def u3(t: Tables):
    sample = ordering.hybrid_sample(t.vc, whole_up_to=20, by_likes=12, by_time=8)
    return sample.groupBy(F.when(F.col("stratum") == "all", "all").otherwise("cut").alias("kind")).agg(F.count("*").cast("int").alias("rows"))


@report("w6_even_stride", """
    WITH r AS (SELECT id, video_id, row_number() OVER (PARTITION BY video_id ORDER BY progress, id) - 1 AS j, count(*) OVER (PARTITION BY video_id) AS n FROM vd)
    SELECT r.id, r.video_id FROM r WHERE n <= 30
    UNION ALL SELECT r.id, r.video_id FROM r JOIN (SELECT unnest(range(0, 30)) AS i) k ON r.j = CAST(floor(k.i * (r.n / 30)) AS BIGINT) WHERE n > 30""")
def w6(t: Tables):
    return ordering.every_nth(t.vd.select("id", "video_id", "progress"), ["video_id"], [F.asc("progress"), F.asc("id")], 30).select("id", "video_id")


@report("w7_latest_reviews", f"""
    SELECT target_id, id, CASE WHEN length(c) > 200 THEN concat(substr(c, 1, 200), '...') ELSE c END AS text, rating FROM (
      SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY posted_at DESC, id) AS rn FROM (SELECT *, {strip_sql('content')} AS c FROM vc) WHERE c <> '') WHERE rn = 1""")
def w7(t: Tables):
    return ordering.latest_reviews(t.vc)


@report("w8_first_seen", "SELECT video_id, content, min(id) AS id FROM vd GROUP BY video_id, content")
def w8(t: Tables):
    return merge.first_seen(t.vd, ["video_id", "content"], "id").select("video_id", "content", "id")


@report("w9_batches", "SELECT id, (row_number() OVER (ORDER BY id) - 1) // 10 AS batch, CAST((row_number() OVER (ORDER BY id) - 1) % 10 AS INT) AS idx FROM vc")
def w9(t: Tables):
    return ordering.batches(t.vc.select("id"), [F.asc("id")], 10)


@report("w10_page", """
    SELECT id, position, CAST(3 AS INT) AS page FROM (SELECT id, row_number() OVER (ORDER BY posted_at DESC, id) AS position FROM vc) WHERE position BETWEEN 41 AND 60""")
def w10(t: Tables):
    return ordering.page(t.vc.select("id", "posted_at"), [F.desc("posted_at"), F.asc("id")], 3).select("id", "position", "page")


@report("w10_indexed_pages", """
    WITH p AS (SELECT id, row_number() OVER (ORDER BY posted_at DESC, id) AS position, count(*) OVER () AS n FROM vc)
    SELECT id, position, CAST((position - 1) // 20 + 1 AS INT) AS page FROM p WHERE position <= 20 OR position BETWEEN 141 AND 160 OR position > (ceil(n / 20) - 1) * 20""")
def w10c(t: Tables):
    """First, eighth and last page from one layout; each reads the files it lies in."""
    order = [F.desc("posted_at"), F.asc("id")]
    pages = Pages.laid_out(t.vc.select("id", "posted_at"), order, run_dir(t.spark, "pages"), 100)
    return pages.page(1).unionByName(pages.page(8)).unionByName(pages.page(10**9)).select("id", "position", "page")


@report("w10_page_clamped", """
    WITH p AS (SELECT id, row_number() OVER (ORDER BY posted_at DESC, id) AS position, count(*) OVER () AS n FROM vc)
    SELECT id, position, CAST(ceil(n / 20) AS INT) AS page FROM p WHERE position > (ceil(n / 20) - 1) * 20""")
def w10b(t: Tables):
    return ordering.page(t.vc.select("id", "posted_at"), [F.desc("posted_at"), F.asc("id")], 10**9).select("id", "position", "page")


@report("w11_seeded_sample")
def w11(t: Tables):
    return ordering.seeded_sample(t.vc.select("id", "target_id"), 500, 42)


@report("w11_sample_checks", """
    SELECT least(500, count(*)) AS n, least(500, count(*)) AS n_distinct, least(500, count(*)) AS n_known, CAST(0 AS BIGINT) AS n_moved FROM vc""")
def w11_checks(t: Tables):
    """A seeded sample has its size, no row twice, only rows of the table, and the same rows under another layout."""
    rows = t.vc.select("id", "target_id")
    one = ordering.seeded_sample(rows, 500, 42).select("id")
    two = ordering.seeded_sample(rows.repartition(7, "target_id"), 500, 42).select(F.col("id"), F.lit(1).alias("again"))
    seen = one.join(two, "id", "left").join(rows.select("id", F.lit(1).alias("known")), "id", "left")
    return seen.agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_distinct"), F.count("known").alias("n_known"),
                    F.count_if(F.col("again").isNull()).alias("n_moved"))


# ---- annotation

@report("t1_match_labels", f"WITH {labels_sql('SELECT id, pos, phrase FROM vp')} SELECT id, pos, l3 FROM lab")
def t1(t: Tables):
    return matching.with_label(t.vp, "phrase", t.lex).select("id", "pos", "l3")


@report("t1_large_dictionary", f"WITH {labels_sql('SELECT id, pos, phrase FROM vp', 'kwl', 'taxl')} SELECT id, pos, l3, full_path FROM labp")
def t1b(t: Tables):
    """The same ladder with 1,573 dictionary entries."""
    return matching.labelled(t.vp, "phrase", LARGE).select("id", "pos", "l3", "full_path")


@report("t2_normalised_opinions", f"WITH {labels_sql('SELECT id, quote AS phrase FROM vo')} SELECT id, l3, full_path FROM labp WHERE m <> ''")
def t2(t: Tables):
    return matching.normalise_opinions(t.vo.select("id", F.col("quote").alias("phrase")), t.lex).select("id", "l3", "full_path")


FINAL = f"""
    WITH {labels_sql(REPLIES_SQL)}, matched AS (SELECT id, pos, {strip_sql('phrase')} AS phrase, sentiment, sentiment_score, sentiment_confidence, is_core, l3, full_path FROM labp WHERE l3 IS NOT NULL),
    {labels_sql("SELECT id, content AS phrase FROM vc WHERE id NOT IN (SELECT id FROM matched)").replace('lab_', 'whole_').replace('lab ', 'whole ').replace('lab.', 'whole.').replace('labp', 'wholep')},
    valid AS (SELECT * FROM matched UNION ALL
      SELECT id, 0, substr(phrase, 1, 60), 'neutral', CAST(-0.2 AS DOUBLE), CAST(0.2 AS DOUBLE), true, l3, full_path FROM wholep WHERE full_path IS NOT NULL),
    ranked AS (SELECT v.*, t.is_fallback, row_number() OVER (PARTITION BY id ORDER BY is_core DESC, pos) AS rn FROM valid v JOIN tax t ON t.l3 = v.l3),
    spec AS (SELECT id, full_path FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS k FROM ranked WHERE NOT is_fallback) WHERE k = 1)"""


def finalised(t: Tables):
    todo = t.vc.select("id", "content", F.lit("neutral").alias("sentiment"), F.lit(-0.2).alias("sentiment_score"))
    return annotate.finalise(todo, replies(t).drop("full_path"), t.lex)


@report("t3_final_labels", FINAL + """
    SELECT c.id, coalesce(r.sentiment, 'neutral') AS sentiment, coalesce(r.sentiment_score, -0.2) AS sentiment_score,
      coalesce(r.sentiment_confidence, 0.5) AS sentiment_confidence,
      coalesce(split_part(CASE WHEN r.is_fallback AND s.full_path IS NOT NULL THEN s.full_path ELSE r.full_path END, '/', 1), 'Meta') AS topic
    FROM vc c LEFT JOIN ranked r ON r.id = c.id AND r.rn = 1 LEFT JOIN spec s ON s.id = c.id""")
def t3(t: Tables):
    return finalised(t)[0].select("id", "sentiment", "sentiment_score", "sentiment_confidence", "topic")


@report("t3_final_opinions", FINAL + " SELECT id, pos, phrase, l3, full_path, rn = 1 AS is_core FROM ranked WHERE id IN (SELECT id FROM vc)")
def t3b(t: Tables):
    return finalised(t)[1].select("id", "pos", "phrase", "l3", "full_path", "is_core")


def model_replies(t: Tables) -> DataFrame:
    """Batched replies: fenced, with an index out of range and a repeated index 0."""
    response = F.concat(
        F.lit('```json\n{"results": [{"index": '), (F.col("event_id") % 5).cast("string"), F.lit(', "sentiment": "Positive", "sentiment_score": '),
        (F.col("value") / 100).cast("string"), F.lit(', "opinions": [{"phrase": " '), "event_type",
        F.lit(' ", "sentiment": "odd", "sentiment_score": 0.4, "is_core": true}, {"phrase": "  "}]}, {"index": 0, "sentiment": "negative", "sentiment_score": -2, '
              '"opinions": [{"phrase": "last", "sentiment": "negative", "sentiment_score": "bad", "sentiment_confidence": 0.7}]}]}\n```'))
    return t.events.select(F.col("event_id").alias("batch"), F.lit(3).alias("batch_size"), response.alias("response"))


@report("t4_parsed_responses", """
    SELECT event_id AS batch, CAST(i AS INT) AS idx, CASE WHEN i = 0 THEN 'negative' WHEN i = event_id % 5 THEN 'positive' ELSE 'neutral' END AS sentiment,
      CASE WHEN i = 0 THEN -1.0 WHEN i = event_id % 5 THEN least(1.0, value / 100) ELSE 0.0 END AS sentiment_score,
      CASE WHEN i = 0 OR i = event_id % 5 THEN 0.5 ELSE 0.0 END AS sentiment_confidence, CAST(CASE WHEN i = 0 OR i = event_id % 5 THEN 1 ELSE 0 END AS INT) AS opinions
    FROM events, (SELECT unnest(range(0, 3)) AS i)""".replace("-1.0", "CAST(-1 AS DOUBLE)").replace("least(1.0,", "least(CAST(1 AS DOUBLE),").replace("ELSE 0.0", "ELSE CAST(0 AS DOUBLE)").replace("THEN 0.5", "THEN CAST(0.5 AS DOUBLE)"))
def t4(t: Tables):
    return annotate.parse_responses(model_replies(t)).withColumn("opinions", F.size("opinions"))


@report("t4_response_opinions", """
    SELECT event_id AS batch, CAST(0 AS INT) AS idx, CAST(0 AS INT) AS pos, 'last' AS phrase, 'negative' AS sentiment, CAST(0 AS DOUBLE) AS sentiment_score, CAST(0.7 AS DOUBLE) AS sentiment_confidence, false AS is_core FROM events
    UNION ALL SELECT event_id, CAST(event_id % 5 AS INT), 0, event_type, 'neutral', CAST(0.4 AS DOUBLE), CAST(0.4 AS DOUBLE), true FROM events WHERE event_id % 5 IN (1, 2)""")
def t4b(t: Tables):
    return annotate.exploded_opinions(annotate.parse_responses(model_replies(t)), "batch", "idx")


@report("t5_prompt_batches", """
    WITH n AS (SELECT id, content, row_number() OVER (ORDER BY id) - 1 AS r FROM vc)
    SELECT r // 10 AS batch, CAST(count(*) AS INT) AS batch_size, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids,
      string_agg(concat('[', CAST(r % 10 AS VARCHAR), '] ', substr(content, 1, 500)), chr(10) ORDER BY id) AS batch_text FROM n GROUP BY r // 10""")
def t5(t: Tables):
    return annotate.prompt_batches(t.vc).withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


@report("t6_tone", """
    SELECT id, pos, CASE WHEN contains(phrase, 'ing') THEN 'positive' WHEN contains(phrase, 'er') THEN 'negative' ELSE 'neutral' END AS tone FROM vp""")
def t6(t: Tables):
    return t.vp.select("id", "pos", matching.tone(F.col("phrase"), t.lex).alias("tone"))


@report("t7_convergence", f"""
    WITH p AS (SELECT id, {strip_sql("unnest(string_split_regex(content, '[.!?。！？\\n]+'))")} AS x FROM vc),
    k AS (SELECT id, CASE WHEN contains(x, 'ing') THEN 'positive' WHEN contains(x, 'er') THEN 'negative' ELSE 'neutral' END AS tone, contains(x, 'anti') AS a FROM p WHERE length(x) > 1),
    r AS (SELECT id, CASE WHEN bool_or(a AND tone = 'positive') THEN 1 WHEN bool_or(a) THEN 2 ELSE 3 END AS round, count(*) FILTER (WHERE a AND tone = 'positive') AS n1, count(*) FILTER (WHERE a) AS n2, count(*) AS n3 FROM k GROUP BY id)
    SELECT id, CAST(round AS INT) AS round, CASE round WHEN 1 THEN n1 WHEN 2 THEN n2 ELSE n3 END AS n FROM r""")
def t7(t: Tables):
    base = annotate.lexicon_annotator(t.lex)
    has = F.contains("phrase", F.lit("anti"))
    rounds = [lambda c: base(c).filter(has & (F.col("sentiment") == "positive")), lambda c: base(c).filter(has), base]
    return annotate.converge(t.vc.select("id", "content"), rounds).groupBy("id", "round").agg(F.count("*").alias("n"))


@report("t8_quality_gate", f"""
    WITH {labels_sql('SELECT full_path AS expected_path, quote AS phrase FROM vo')}
    SELECT expected_path, count(*) AS n, count(*) FILTER (WHERE full_path = expected_path) AS ok FROM labp GROUP BY expected_path""")
def t8(t: Tables):
    gate = matching.quality_gate(t.vo.select(F.col("quote").alias("phrase"), "full_path"), t.lex)
    return gate.groupBy("expected_path").agg(F.count("*").alias("n"), F.count_if("ok").alias("ok"))


@report("t9_rebuilt_golden", """
    WITH s AS (SELECT id, full_path, sentiment, sentiment_confidence, split_part(full_path, '/', -1) AS l3 FROM vo),
    m AS (SELECT a.l3 AS old_l3, b.l3 AS new_l3 FROM tax a JOIN tax b ON b.ord = a.ord + 1 WHERE a.ord % 2 = 0),
    g AS (SELECT s.*, CASE WHEN sentiment_confidence = 0.3 THEN 'Score' ELSE m.new_l3 END AS label FROM s LEFT JOIN m ON m.old_l3 = s.l3)
    SELECT g.id AS opinion_id, g.full_path AS old_full_path, CASE WHEN g.sentiment = 'neutral' THEN 'Own/Path/Here' WHEN x.l3 IS NOT NULL THEN concat(x.l1, '/', x.l2, '/', x.l3) END AS new_full_path,
      g.sentiment_confidence >= 0.6 AS excluded FROM g LEFT JOIN tax x ON x.l3 = g.label""")
def t9(t: Tables):
    sample = t.vo.select(F.col("id").alias("opinion_id"), F.col("quote").alias("phrase"), F.col("full_path").alias("old_full_path"))
    ids = t.vo.select(F.col("id").alias("opinion_id"), "sentiment", "sentiment_confidence")
    neutral, third = F.col("sentiment") == "neutral", F.col("sentiment_confidence") == 0.3
    overrides = ids.filter(neutral | third).select("opinion_id", F.when(neutral, "Own/Path/Here").otherwise("Score").alias("override"))
    a, b = t.tax.filter("ord % 2 = 0").select((F.col("ord") + 1).alias("ord"), F.col("l3").alias("old_l3")), t.tax.select("ord", F.col("l3").alias("new_l3"))
    mechanical = a.join(b, "ord").select("old_l3", "new_l3")
    return annotate.rebuilt_golden(sample, overrides, mechanical, ids.filter("sentiment_confidence >= 0.6").select("opinion_id"), t.lex).drop("phrase")


# ---- merges

def full_comments(t: Tables) -> DataFrame:
    return t.vf.withColumn("sub_topics", F.from_json("sub_topics", "array<string>")).select(
        *[F.col(c) for c in t.spark.createDataFrame([], schemas.COMMENTS).columns])


def landed_rows(t: Tables) -> DataFrame:
    """A landed batch of every comment; those of one platform arrive twice, with other values first."""
    base = t.vf.select(
        "platform", "source_id", F.lit("key").alias("target_key"), "content", "author", "author_id", "rating", "language",
        "likes", "replies", "posted_at", "extra_json", "id")
    first = base.withColumns({"content": F.lit("early"), "likes": F.lit(7), "arrival": F.col("id") * 2}).filter(F.col("platform") == "steam")
    last = base.withColumns({
        "content": F.concat(F.lit("new "), "language"), "replies": F.when(F.col("id") % 8 == 0, 9), "likes": F.when(F.col("id") % 6 == 0, 5), "arrival": F.col("id") * 2 + 1})
    return first.unionByName(last).drop("id")


UPSERT = f"""
    WITH cur AS (SELECT * FROM vf WHERE likes IS NOT NULL),
    n AS (SELECT platform, source_id, concat('new ', language) AS content, CASE WHEN id % 6 = 0 THEN 5 END AS likes, CASE WHEN id % 8 = 0 THEN 9 END AS replies, extra_json,
      CASE WHEN platform = 'steam' AND extra_json IS NOT NULL THEN concat('steam:', CAST(id % 9 AS VARCHAR)) ELSE concat(platform, ':key') END AS derived FROM vf)
    SELECT platform, source_id, coalesce(cur.target_id, n.derived) AS target_id, coalesce(n.content, cur.content) AS content,
      CAST(coalesce(n.likes, cur.likes) AS INT) AS likes, CAST(coalesce(n.replies, cur.replies) AS INT) AS replies, cur.sentiment, cur.topic,
      CASE WHEN n.content IS NOT NULL AND (n.likes IS NOT NULL OR (cur.id IS NOT NULL AND n.replies IS NOT NULL)) THEN {NOW_SQL} ELSE cur.likes_refreshed_at END AS likes_refreshed_at,
      CASE WHEN n.extra_json IS NOT NULL THEN {NOW_SQL} ELSE cur.developer_response_refreshed_at END AS developer_response_refreshed_at,
      CASE WHEN n.content IS NOT NULL THEN {NOW_SQL} ELSE cur.fetched_at END AS fetched_at
    FROM cur FULL JOIN n USING (platform, source_id)"""
UPSERT_COLUMNS = ["platform", "source_id", "target_id", "content", "likes", "replies", "sentiment", "topic", "likes_refreshed_at", "developer_response_refreshed_at", "fetched_at"]


@report("m1_upsert_comments", UPSERT)
def m1(t: Tables):
    return merge.upsert_comments(full_comments(t).filter(F.col("likes").isNotNull()), landed_rows(t), now()).select(*UPSERT_COLUMNS)


@report("m1_bucketed_upsert", UPSERT)
def m1c(t: Tables):
    """M1 on a table of buckets: a first version, then a merge that rewrites the buckets it touches."""
    current = full_comments(t).filter(F.col("likes").isNotNull())
    table = Snapshots(t.spark, run_dir(t.spark, "buckets"), current.schema, merge.KEY, 16)
    first = table.replace(current)
    table.merge(lambda old, batch: merge.upsert_comments(old, batch, now()), landed_rows(t), first + 1)
    return table.read().select(*UPSERT_COLUMNS)


def replaced(t: Tables):
    labels = t.vc.filter(F.col("language") == "en").select(
        F.when(F.col("id") % 10 == 0, -F.col("id") - 1).otherwise(F.col("id")).alias("id"), F.lit("negative").alias("sentiment"), F.lit(-0.3).alias("sentiment_score"),
        F.lit(0.3).alias("sentiment_confidence"), F.lit("Tech").alias("topic"), F.array(F.lit("Frames")).alias("sub_topics"))
    word = F.element_at(F.split("content", " "), 2)
    new = t.vc.select(
        F.col("id").alias("comment_id"), F.lit(0).alias("pos"), F.when(F.col("id") % 4 != 0, "Tech/Frames/Stutter").otherwise(" ").alias("full_path"),
        F.lit("NEGATIVE ").alias("sentiment"), F.lit("1.5").alias("sentiment_confidence"), F.try_element_at(F.split("content", " "), F.lit(2)).alias("quote"),
        F.lit(None).cast("int").alias("quote_start"), F.lit(None).cast("int").alias("quote_end"))
    old = t.vo.withColumns({"quote_start": F.lit(None).cast("int"), "quote_end": F.lit(None).cast("int"), "created_at": now()})
    return merge.replace_analysis(full_comments(t), old, labels, new, now())


@report("m2_replaced_labels", f"""
    SELECT id, CASE WHEN h THEN 'negative' ELSE sentiment END AS sentiment, CASE WHEN h THEN CAST(0.3 AS DOUBLE) ELSE sentiment_confidence END AS sentiment_confidence,
      CASE WHEN h THEN 'Tech' ELSE topic END AS topic, CASE WHEN h THEN {NOW_SQL} ELSE analyzed_at END AS analyzed_at
    FROM (SELECT *, language = 'en' AND id % 10 <> 0 AS h FROM vf)""")
def m2(t: Tables):
    return replaced(t)[0].select("id", "sentiment", "sentiment_confidence", "topic", "analyzed_at")


@report("m2_replaced_opinions", f"""
    WITH q AS (SELECT id, content, {strip_sql("split_part(content, ' ', 2)")} AS quote FROM vc WHERE language = 'en' AND id % 10 <> 0 AND id % 4 <> 0)
    SELECT comment_id, full_path, sentiment, sentiment_confidence, quote, CAST(NULL AS INT) AS quote_start, CAST(NULL AS INT) AS quote_end FROM vo
    WHERE NOT (comment_id IN (SELECT id FROM vc WHERE language = 'en' AND id % 10 <> 0))
    UNION ALL SELECT id, 'Tech/Frames/Stutter', 'negative', CAST(NULL AS DOUBLE), quote, CAST(position(quote IN content) - 1 AS INT), CAST(position(quote IN content) - 1 + length(quote) AS INT) FROM q WHERE quote <> ''""")
def m2b(t: Tables):
    return replaced(t)[1].select("comment_id", "full_path", "sentiment", "sentiment_confidence", "quote", "quote_start", "quote_end")


def vector_batch(t: Tables, where: str, model: str) -> DataFrame:
    return t.ve.filter(where).select("comment_id", F.lit(model).alias("model"), "dim", "vector")


@report("m3_upsert_vectors", """
    SELECT comment_id, CASE WHEN label >= 3 THEN 'm-2' ELSE 'm-1' END AS model, dim FROM ve""")
def m3(t: Tables):
    current, batch = vector_batch(t, "label < 6", "m-1"), vector_batch(t, "label >= 3", "m-2")
    return merge.upsert_vectors(current, batch).select("comment_id", "model", "dim")


@report("m4_replace_vectors", "SELECT comment_id, 'm-2' AS model FROM ve")
def m4(t: Tables):
    batch = vector_batch(t, "true", "m-2")
    return merge.replace_vectors(t.ve.select(F.col("comment_id").alias("id")), batch).select("comment_id", "model")


@report("m5_insert_danmaku", """
    SELECT video_id, progress, content, user_hash, min(id) AS id FROM (SELECT id, video_id, CASE WHEN id % 9 = 0 THEN NULL ELSE progress END AS progress,
      content, CASE WHEN id % 5 = 0 THEN '' ELSE user_hash END AS user_hash FROM vd WHERE id % 11 <> 0) b
    WHERE NOT EXISTS (SELECT 1 FROM vd o WHERE o.content IN ('click', 'view') AND o.video_id = b.video_id AND o.progress = b.progress AND o.content = b.content AND o.user_hash = b.user_hash)
    GROUP BY video_id, progress, content, user_hash""")
def m5(t: Tables):
    batch = t.vd.withColumns({
        "content": F.when(F.col("id") % 11 == 0, "　 ").otherwise(F.concat(F.lit(" "), "content", F.lit("　"))),
        "progress": F.when(F.col("id") % 9 != 0, F.col("progress")), "user_hash": F.when(F.col("id") % 5 != 0, F.col("user_hash"))})
    return merge.insert_danmaku(t.vd.filter(F.col("content").isin("click", "view")), batch).select("video_id", "progress", "content", "user_hash", "id")


def dim(t: Tables, where: str, shift: int = 1) -> DataFrame:
    """(old, new) labels: each chosen label maps to the next one of the taxonomy."""
    a, b = t.tax.filter(where).select((F.col("ord") + shift).alias("ord"), F.col("l3").alias("old")), t.tax.select("ord", F.col("l3").alias("new"))
    return a.join(b, "ord").select("old", "new")


@report("m6_migrated_topics", "SELECT id, CASE topic WHEN 'Ghost' THEN 'Meta' WHEN 'Tech' THEN 'Platform' ELSE topic END AS topic, coalesce(topic IN ('Ghost', 'Tech'), false) AS changed FROM vf")
def m6(t: Tables):
    l1 = t.vf.filter(F.col("topic").isin("Ghost", "Tech")).select(F.col("topic").alias("old")).distinct().withColumn(
        "new", F.when(F.col("old") == "Ghost", "Meta").otherwise("Platform"))
    return merge.migrate_topics(t.vf, l1).select("id", "topic", "changed")


MIGRATED = """
    WITH m AS (SELECT a.l3 AS old, b.l3 AS new FROM tax a JOIN tax b ON b.ord = a.ord + 1 WHERE a.ord % 2 = 0),
    r AS (SELECT o.id, o.full_path AS old_path, CASE WHEN o.full_path = 'Audio/Music/Score' THEN 'Meta/Irony/Meme' WHEN x.l3 IS NOT NULL THEN concat(x.l1, '/', x.l2, '/', x.l3) END AS new_path
      FROM vo o LEFT JOIN m ON m.old = split_part(o.full_path, '/', -1) LEFT JOIN tax x ON x.l3 = m.new)"""


def migrated(t: Tables):
    over = t.vo.filter(F.col("full_path") == "Audio/Music/Score").select(F.col("full_path").alias("old")).distinct().withColumn("new", F.lit("Meta/Irony/Meme"))
    return merge.migrate_paths(t.vo, dim(t, "ord % 2 = 0"), over, t.lex)


@report("m6_migrated_paths", MIGRATED + """
    SELECT id, old_path, coalesce(new_path, old_path) AS full_path, CASE WHEN new_path IS NULL THEN 'unmapped' WHEN new_path = old_path THEN 'same' ELSE 'changed' END AS state FROM r""")
def m6b(t: Tables):
    return migrated(t).select("id", "old_path", "full_path", "state")


@report("m6_before_after", MIGRATED + """
    , a AS (SELECT coalesce(new_path, old_path) AS label, count(*) AS after FROM r GROUP BY ALL), b AS (SELECT old_path AS label, count(*) AS before FROM r GROUP BY ALL)
    SELECT label, coalesce(before, 0) AS before, coalesce(after, 0) AS after FROM a FULL JOIN b USING (label)""")
def m6c(t: Tables):
    return merge.before_after(t.vo, migrated(t), "full_path")


REMATCH = f"""
    WITH {labels_sql('SELECT id, comment_id, full_path AS old_path, quote AS phrase FROM vo')},
    ch AS (SELECT id, old_path, full_path AS new_path, old_path LIKE 'Meta/%' AND full_path NOT LIKE 'Meta/%' AS write_back FROM labp
      WHERE m <> '' AND full_path IS NOT NULL AND full_path <> old_path)"""


@report("m7_rematch_changes", REMATCH + " SELECT id, old_path, new_path, write_back FROM ch")
def m7(t: Tables):
    return merge.rematch(t.vo, t.lex).select("id", "old_path", "new_path", "write_back")


@report("m7_rematch_applied", REMATCH + " SELECT o.id, CASE WHEN ch.write_back THEN ch.new_path ELSE o.full_path END AS full_path FROM vo o LEFT JOIN ch ON ch.id = o.id")
def m7b(t: Tables):
    return merge.apply_rematch(t.vo, merge.rematch(t.vo, t.lex)).select("id", "full_path")


SUNK = """
    WITH s AS (SELECT comment_id, split_part(full_path, '/', 1) AS l1 FROM (
      SELECT *, row_number() OVER (PARTITION BY comment_id ORDER BY id) AS rn FROM vo WHERE full_path NOT LIKE 'Meta/%') WHERE rn = 1),
    r AS (SELECT f.id, CASE WHEN f.topic = 'Meta' AND s.l1 IS NOT NULL THEN s.l1 ELSE f.topic END AS topic, coalesce(f.topic = 'Meta' AND s.l1 IS NOT NULL, false) AS changed
      FROM vf f LEFT JOIN s ON s.comment_id = f.id)"""


def sunk(t: Tables):
    return merge.sink_topics(t.vf, annotate.first_specific(t.vo, "Meta", [x[1] for x in t.lex.taxonomy]), "Meta")


@report("m8_sunk_topics", SUNK + " SELECT * FROM r")
def m8(t: Tables):
    return sunk(t).select("id", "topic", "changed")


@report("m9_merge_refreshed", f"""
    SELECT id, CASE WHEN platform = 'steam' AND likes_refreshed_at IS NULL THEN CAST(3 AS INT) ELSE likes END AS likes,
      CASE WHEN platform = 'steam' AND likes_refreshed_at IS NULL THEN {NOW_SQL} ELSE likes_refreshed_at END AS likes_refreshed_at FROM vf""")
def m9(t: Tables):
    current = full_comments(t)
    remote = current.filter(F.col("platform") == "steam").select(
        "platform", "source_id", F.lit("k").alias("target_key"), "content", "author", "author_id", "rating", "language", F.lit(3).alias("likes"),
        F.lit(None).cast("int").alias("replies"), "posted_at", "extra_json", F.col("id").alias("arrival"))
    due = current.filter(F.col("likes_refreshed_at").isNull())
    return merge.merge_refreshed(current, due, remote, now()).select("id", "likes", "likes_refreshed_at")


@report("m10_fixed_names", """
    SELECT id, CASE WHEN target_id = 'steam:src1' THEN replace(extra_meta, '"name": "Game src1"', '"name": "Right"') ELSE extra_meta END AS extra_meta FROM vc""")
def m10(t: Tables):
    return merge.fix_name(t.vc, "steam:src1", "Game src1", "Right").select("id", "extra_meta")


@report("m11_dry_run", REMATCH + """
    SELECT 'rematch' AS job, count(*) FILTER (WHERE write_back) AS changes FROM ch""")
def m11(t: Tables):
    return merge.rematch(t.vo, t.lex).agg(F.count_if("write_back").alias("changes")).select(F.lit("rematch").alias("job"), "changes")


# ---- vectors

@report("v1_vector_norms")
def v1(t: Tables):
    rows = vectors.vectorise(t.vc, "content", 256)
    return rows.select("id", F.size("vector").alias("dim"), F.round(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))), 4).alias("norm"))


@report("v2_semantic_search", """
    WITH q AS (SELECT CAST(vector AS DOUBLE[]) AS q FROM ve WHERE comment_id = 7)
    SELECT h.comment_id, round(h.s, 4) AS score, c.target_id FROM (
      SELECT comment_id, list_dot_product(CAST(vector AS DOUBLE[]), q.q) AS s FROM ve, q ORDER BY s DESC, comment_id LIMIT 10) h JOIN vc c ON c.id = h.comment_id""")
def v2(t: Tables):
    query = t.ve.filter("comment_id = 7").select("vector").first()["vector"]
    return vectors.semantic_search(t.ve, t.vc, query, 10, ("target_id",), "m-1")


@report("v2_many_queries", """
    WITH q AS (SELECT comment_id AS query_id, CAST(vector AS DOUBLE[]) AS q FROM ve WHERE comment_id % 20 = 0),
    s AS (SELECT query_id, comment_id, round(list_dot_product(CAST(vector AS DOUBLE[]), q), 9) AS s FROM ve, q),
    h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, comment_id) AS rn FROM s)
    SELECT h.query_id, h.comment_id, round(h.s, 4) AS score, c.target_id FROM h JOIN vc c ON c.id = h.comment_id WHERE rn <= 10""")
def v2b(t: Tables):
    """Every twentieth vector as a query against all."""
    queries = t.ve.filter("comment_id % 20 = 0").select(F.col("comment_id").alias("query_id"), "vector")
    return vectors.semantic_search_many(t.ve, t.vc, queries, 10, ("target_id",), "m-1")


@report("v1_space_norms", """
    SELECT id, CASE WHEN regexp_matches(regexp_replace(content, 'http[^\\s]+', ' ', 'g'), '[\\p{L}\\p{N}_]') THEN 1.0::DOUBLE ELSE 0.0 END AS norm FROM vc""")
def v1b(t: Tables):
    """A space fitted once on one platform, kept, loaded and used for all comments: vectors of length one, or zero without words."""
    folder = run_dir(t.spark, "space")
    vectors.Space.fitted(t.vc, "content", "tfidf-1", 128, folder)
    found = vectors.Space.load(t.spark, folder, "tfidf-1").vectors(t.vc, "content")
    return found.select("id", F.round(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))), 3).alias("norm"))


@report("v1_two_landings", """
    WITH x AS (SELECT id, max(id) OVER (PARTITION BY content) AS top FROM vc WHERE id < 400 AND language = 'en') SELECT id, top = id AS newest FROM x""")
def v1c(t: Tables):
    """Two landings in one space are searched together: equal texts of different landings have one vector."""
    rows = t.vc.filter("id < 400 AND language = 'en'").select("id", "content")
    space = vectors.Space.fitted(rows, "content", "tfidf-1", 256)
    landed = [space.vectors(rows.filter(f"id % 2 = {i}"), "content") for i in (0, 1)]
    both = landed[0].unionByName(landed[1])
    newest = Window.partitionBy("vector")
    return both.withColumn("top", F.max("id").over(newest)).select("id", (F.col("top") == F.col("id")).alias("newest"))


MIXED = "SELECT comment_id, vector, CASE WHEN label >= 8 THEN 'm-2' ELSE 'm-1' END AS model, CASE WHEN label = 5 THEN 32 ELSE 64 END AS dim FROM ve"


@report("v3_single_space", f"SELECT model, dim, count(*) AS n, model = 'm-1' AND dim = 64 AS ok FROM ({MIXED}) GROUP BY ALL")
def v3(t: Tables):
    """The guard's verdict per model and length of a table that mixes two models."""
    return vectors.guard(t.sql(MIXED), "m-1", 64)


@report("v4_assigned", """
    WITH s AS (SELECT comment_id AS k, CAST(vector AS DOUBLE[]) AS c FROM ve WHERE comment_id < 5),
    d AS (SELECT e.comment_id, s.k, round(list_dot_product(CAST(e.vector AS DOUBLE[]), s.c), 9) AS p FROM ve e, s)
    SELECT comment_id, CAST(k AS INT) AS label FROM (SELECT *, row_number() OVER (PARTITION BY comment_id ORDER BY p DESC, k) AS rn FROM d) WHERE rn = 1""")
def v4(t: Tables):
    seeds = [r["vector"] for r in t.ve.filter("comment_id < 5").orderBy("comment_id").select("vector").collect()]
    return vectors.assign(t.ve, seeds).select("comment_id", "label")


@report("v4_micro_topics")
def v4b(t: Tables):
    rows = vectors.anchored(t.vo, t.vc, "Combat").select("id", "quote")
    return vectors.micro_topics(vectors.vectorise(rows, "quote", 128)).groupBy("label").agg(F.count("*").alias("n"))


@report("v4_micro_topic_coverage", """
    SELECT count(*) AS n, count(DISTINCT o.id) AS n_opinions FROM vo o JOIN vc c ON c.id = o.comment_id WHERE contains(o.full_path, 'Combat')""")
def v4c(t: Tables):
    """Every anchored opinion gets one label."""
    rows = vectors.anchored(t.vo, t.vc, "Combat").select("id", "quote")
    labels = vectors.micro_topics(vectors.vectorise(rows, "quote", 128)).filter("label IS NOT NULL")
    return labels.agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_opinions"))


CENTERS = """
    WITH u AS (SELECT comment_id, label, unnest(CAST(vector AS DOUBLE[])) AS x, generate_subscripts(vector, 1) AS i FROM ve),
    m AS (SELECT label, i, avg(x) AS x FROM u GROUP BY ALL), n AS (SELECT label, sqrt(sum(x * x)) + 1e-8 AS norm FROM m GROUP BY label),
    d AS (SELECT u.comment_id, u.label, round(sum(u.x * m.x / n.norm), 6) AS score FROM u JOIN m ON m.label = u.label AND m.i = u.i JOIN n ON n.label = u.label GROUP BY ALL)"""


@report("v5_cluster_report", CENTERS + """
    SELECT label, size, comment_id, score, rank, size < 30 AS low_sample FROM (
      SELECT d.*, count(*) OVER (PARTITION BY label) AS size, row_number() OVER (PARTITION BY label ORDER BY score DESC, comment_id) AS rank FROM d) WHERE rank <= 5""")
def v5(t: Tables):
    return vectors.cluster_report(t.ve.select("comment_id", "label", "vector"), "comment_id")


@report("v6_cluster_shares", "SELECT label, count(*) AS hit_count, round(count(*) / sum(count(*)) OVER (), 4) AS volume_ratio FROM ve GROUP BY label")
def v6(t: Tables):
    return vectors.cluster_shares(t.ve)


# ---- incremental and streaming

def targets(t: Tables) -> DataFrame:
    """Known targets with their own row limits, plus one new target per language."""
    known = t.vc.groupBy("target_id").agg(F.min("id").alias("m")).select("target_id", F.when(F.col("m") % 2 == 0, 3).alias("count"))
    new = t.vc.select("language").distinct().select(F.concat(F.lit("new:"), "language").alias("target_id"), F.lit(5).alias("count"))
    return known.unionByName(new)


BOUNDS = """
    WITH g AS (SELECT target_id, CASE WHEN min(id) % 2 = 0 THEN 3 END AS count FROM vc GROUP BY target_id UNION ALL SELECT DISTINCT concat('new:', language), 5 FROM vc),
    b AS (SELECT g.target_id, g.count, x.m - INTERVAL 1 DAY AS posted_after FROM g LEFT JOIN (SELECT target_id, max(posted_at) AS m FROM vc WHERE rating IS NOT NULL GROUP BY target_id) x ON x.target_id = g.target_id)"""


def bounds(t: Tables) -> DataFrame:
    return incremental.lower_bounds(targets(t), t.vc.filter(F.col("rating").isNotNull()))


@report("i1_lower_bounds", BOUNDS + " SELECT target_id, posted_after FROM b")
def i1(t: Tables):
    return bounds(t).select("target_id", "posted_after")


@report("i2_slices", BOUNDS + """
    , r AS (SELECT c.id, c.target_id, row_number() OVER (PARTITION BY c.target_id ORDER BY c.posted_at DESC, c.id) AS rn, coalesce(b.count, 50) AS k
      FROM vc c JOIN b ON b.target_id = c.target_id WHERE b.posted_after IS NULL OR c.posted_at >= b.posted_after)
    SELECT id, target_id FROM r WHERE rn <= k""")
def i2(t: Tables):
    return incremental.slices(t.vc, bounds(t)).select("id", "target_id")


@report("i3_run_log", """
    WITH f AS (SELECT target_id, count(*) AS fetched, count(*) FILTER (WHERE likes IS NULL) AS inserted, count(analyzed_at) AS analyzed FROM vc GROUP BY target_id),
    e AS (SELECT c.target_id, count(*) AS embedded FROM vc c JOIN ve ON ve.comment_id = c.id GROUP BY ALL),
    x AS (SELECT target_id FROM vc GROUP BY target_id HAVING min(id) % 5 = 0)
    SELECT f.target_id, x.target_id IS NULL AS ok, fetched, inserted, analyzed, coalesce(embedded, 0) AS embedded, CASE WHEN x.target_id IS NOT NULL THEN 'timeout' END AS error
    FROM f LEFT JOIN e ON e.target_id = f.target_id LEFT JOIN x ON x.target_id = f.target_id""")
def i3(t: Tables):
    embedded = t.vc.join(t.ve.select(F.col("comment_id").alias("id")), "id", "left_semi").select("target_id", "id")
    failed = t.vc.groupBy("target_id").agg(F.min("id").alias("m")).filter("m % 5 = 0").select("target_id", F.lit("timeout").alias("error"))
    return incremental.run_log(
        t.vc, t.vc.filter(F.col("likes").isNotNull()), t.vc.filter(F.col("analyzed_at").isNotNull()).select("target_id", "id"), embedded, failed)


# A landing in which one target fails: the reader could not fetch some rows of store app 4.
LANDED = f"""
    k AS (SELECT v.*, CASE WHEN platform = 'steam' AND extra_json IS NOT NULL THEN concat('steam:', CAST(id % 9 AS VARCHAR)) ELSE concat(platform, ':key') END AS derived FROM vf v),
    good AS (SELECT *, likes IS NULL AS new FROM k WHERE derived <> 'steam:4'),
    landed AS (SELECT id, CASE WHEN new THEN derived ELSE target_id END AS target_id, CASE WHEN platform = 'steam' THEN 'early' ELSE concat('new ', language) END AS content,
      new OR analyzed_at IS NULL AS todo, sentiment, topic, platform, source_id FROM good
      UNION ALL SELECT id, target_id, content, analyzed_at IS NULL, sentiment, topic, platform, source_id FROM k WHERE derived = 'steam:4' AND likes IS NOT NULL)"""


def landing(t: Tables):
    failure = F.when(F.startswith("extra_json", F.lit('{"appid": "4"')) & (F.col("platform") == "steam") & (F.col("arrival") % 5 == 0), "timeout")
    raw = landed_rows(t).withColumn("failure", failure)
    stored, opinions = t.spark.createDataFrame([], schemas.EMBEDDINGS), t.spark.createDataFrame([], schemas.OPINIONS)
    bullets = t.vd.withColumns({"cid": F.lit("c"), "color": F.lit(0), "fetched_at": now()})
    none = t.spark.createDataFrame([], schemas.DANMAKU)
    done = daily.land(raw, full_comments(t).filter(F.col("likes").isNotNull()), opinions, stored, t.lex, NOW, dim=128, bullets=bullets, danmaku=none)
    if done.errors:
        raise RuntimeError(done.errors)
    return done


@report("i4_landing_log", f"""
    WITH {LANDED}, b AS (SELECT DISTINCT platform, source_id FROM good)
    SELECT coalesce(l.target_id, 'steam:4') AS target_id, l.target_id IS NOT NULL AS ok, coalesce(fetched, 0) AS fetched, coalesce(inserted, 0) AS inserted, coalesce(analyzed, 0) AS analyzed,
      coalesce(embedded, 0) AS embedded, CASE WHEN l.target_id IS NULL THEN 'timeout' END AS error
    FROM (SELECT l.target_id, count(*) FILTER (WHERE b.platform IS NOT NULL) AS fetched, count(*) FILTER (WHERE b.platform IS NOT NULL AND v.likes IS NULL) AS inserted,
        count(*) FILTER (WHERE todo) AS analyzed, count(*) AS embedded
      FROM landed l JOIN vf v ON v.id = l.id LEFT JOIN b ON b.platform = l.platform AND b.source_id = l.source_id GROUP BY l.target_id) l
    FULL JOIN (SELECT DISTINCT derived FROM k WHERE derived = 'steam:4') f ON f.derived = l.target_id""")
def i4(t: Tables):
    return landing(t).log


TODO = "SELECT id, content FROM landed WHERE todo"
PIECES = f"""SELECT id, CAST(generate_subscripts(parts, 1) - 1 AS INT) AS pos, unnest(parts) AS phrase FROM (SELECT id, regexp_split_to_array(content, '[.!?。！？\n]+') AS parts FROM ({TODO}))"""
LAND_LABELS = f"""
    WITH {LANDED}, pieces AS (SELECT id, pos, {strip_sql('phrase')} AS phrase FROM ({PIECES})),
    {labels_sql("SELECT * FROM pieces WHERE length(phrase) > 1")},
    toned AS (SELECT id, pos, m AS masked, phrase, l3, full_path, CASE WHEN contains(phrase, 'ing') THEN 'positive' WHEN contains(phrase, 'er') THEN 'negative' ELSE 'neutral' END AS sentiment
      FROM labp WHERE l3 IS NOT NULL),
    {labels_sql("SELECT id, content AS phrase FROM landed WHERE todo AND id NOT IN (SELECT id FROM toned)").replace('lab_', 'whole_').replace('lab ', 'whole ').replace('lab.', 'whole.').replace('labp', 'wholep')},
    valid AS (SELECT id, pos, phrase, sentiment, CASE sentiment WHEN 'neutral' THEN 0.0 ELSE 0.6 END::DOUBLE AS confidence, l3, full_path FROM toned
      UNION ALL SELECT id, 0, substr(phrase, 1, 60), 'neutral', 0.0::DOUBLE, l3, full_path FROM wholep WHERE full_path IS NOT NULL),
    ranked AS (SELECT v.*, t.is_fallback, row_number() OVER (PARTITION BY id ORDER BY pos) AS rn FROM valid v JOIN tax t ON t.l3 = v.l3),
    spec AS (SELECT id, full_path FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS k FROM ranked WHERE NOT is_fallback) WHERE k = 1)"""


@report("i4_landing_comments", LAND_LABELS + f"""
    SELECT l.platform, l.source_id, l.target_id, l.content, CASE WHEN todo THEN coalesce(r.sentiment, 'neutral') ELSE l.sentiment END AS sentiment,
      CASE WHEN todo THEN coalesce(split_part(CASE WHEN r.is_fallback AND s.full_path IS NOT NULL THEN s.full_path ELSE r.full_path END, '/', 1), 'Meta') ELSE l.topic END AS topic
    FROM landed l LEFT JOIN ranked r ON r.id = l.id AND r.rn = 1 LEFT JOIN spec s ON s.id = l.id""")
def i4b(t: Tables):
    return landing(t).comments.select("platform", "source_id", "target_id", "content", "sentiment", "topic")


@report("i4_landing_opinions", LAND_LABELS + """
    SELECT l.platform, l.source_id, r.full_path, r.sentiment, r.confidence AS sentiment_confidence, trim(r.phrase) AS quote FROM ranked r JOIN landed l ON l.id = r.id""")
def i4c(t: Tables):
    done = landing(t)
    key = done.comments.select(F.col("id").alias("comment_id"), "platform", "source_id")
    return done.opinions.join(key, "comment_id").select("platform", "source_id", "full_path", "sentiment", "sentiment_confidence", "quote")


@report("i4_landing_quarantine", f"""
    WITH {LANDED}, a AS (SELECT *, id * 2 + 1 AS arrival FROM k WHERE derived = 'steam:4' UNION ALL SELECT *, id * 2 FROM k WHERE derived = 'steam:4')
    SELECT derived AS target_id, source_id, arrival, CASE WHEN arrival % 5 = 0 THEN 'timeout' ELSE 'held back: timeout' END AS failure FROM a""")
def i4d(t: Tables):
    return landing(t).quarantine.select("target_id", "source_id", "arrival", "failure")


@report("i4_landing_danmaku", "SELECT video_id, progress, content, user_hash, min(id) AS id FROM vd GROUP BY ALL")
def i4e(t: Tables):
    return landing(t).danmaku.select("video_id", "progress", "content", "user_hash", "id")


def stream_of(t: Tables, name: str) -> DataFrame:
    return jobs.read_landed(t.spark, t.folder, getattr(t, name).schema, f"{name}.parquet")


def danmaku_stream(t: Tables) -> DataFrame:
    return stream_of(t, "events").select(
        F.col("event_id").alias("id"), F.concat(F.lit("bilibili:video:"), F.col("user_id").cast("string")).alias("video_id"),
        F.col("event_type").alias("content"), F.floor("value").cast("int").alias("progress"), (F.col("event_id") % 7).cast("int").alias("mode"),
        (F.col("user_id") % 13).cast("string").alias("user_hash"), F.col("ts").alias("posted_at"))


@report("i5_stream_ingest", f"""
    SELECT CASE WHEN lang = 'en' THEN 'steam' ELSE 'bilibili' END AS platform, CAST(doc_id AS VARCHAR) AS source_id,
      concat(CASE WHEN lang = 'en' THEN 'steam:' ELSE 'bilibili:' END, source) AS target_id, text AS content, {NOW_SQL} AS fetched_at FROM documents""")
def i5(t: Tables):
    none = lambda kind: F.lit(None).cast(kind)
    rows = stream_of(t, "documents").select(
        F.when(F.col("lang") == "en", "steam").otherwise("bilibili").alias("platform"), F.col("doc_id").cast("string").alias("source_id"),
        F.col("source").alias("target_key"), F.col("text").alias("content"), none("string").alias("author"), none("string").alias("author_id"),
        none("int").alias("rating"), F.col("lang").alias("language"), none("int").alias("likes"), none("int").alias("replies"),
        none("timestamp_ntz").alias("posted_at"), none("string").alias("extra_json"), F.col("doc_id").alias("arrival"))
    root, checkpoint = jobs.folders(t.spark, "ingest")
    empty = t.spark.createDataFrame([], schemas.COMMENTS)
    query = jobs.ingest(rows, root, empty, now(), checkpoint)
    return jobs.finished(t.spark, query, root, empty).select("platform", "source_id", "target_id", "content", "fetched_at")


@report("i6_stream_trend", """
    WITH e AS (SELECT CAST(ts AS DATE) AS bucket, event_type AS target_id, count(*) AS total, count(*) FILTER (WHERE value > 50) AS pos FROM events GROUP BY ALL)
    SELECT *, round(pos / total * 100, 1) AS positive_rate FROM e WHERE bucket + INTERVAL 2 DAY <= (SELECT max(ts) FROM events)""")
def i6(t: Tables):
    rows = stream_of(t, "events").select(
        F.col("ts").alias("posted_at"), F.col("event_type").alias("target_id"), F.when(F.col("value") > 50, "positive").otherwise("neutral").alias("sentiment"))
    path, checkpoint = jobs.folders(t.spark, "trend")
    result = jobs.daily_trend(rows)
    jobs.append_files(result, path, checkpoint).awaitTermination()
    return t.spark.read.schema(result.schema).parquet(path)


@report("i7_stream_tone_windows", """
    SELECT video_id, CAST(floor(progress / 30) AS BIGINT) AS "window", count(*) AS volume, count(*) FILTER (WHERE contains(content, 'ing')) AS praise,
      count(*) FILTER (WHERE contains(content, 'er') AND NOT contains(content, 'ing')) AS criticize FROM vd GROUP BY ALL""")
def i7(t: Tables):
    rows = danmaku_stream(t)
    root, checkpoint = jobs.folders(t.spark, "tone")
    query = jobs.tone_stream(rows, t.lex, root, checkpoint)
    query.awaitTermination()
    return jobs.current_table(t.spark, root, t.spark.createDataFrame([], "video_id string, window bigint, volume bigint, praise bigint, criticize bigint"))


@report("i7_ending_windows", """
    SELECT video_id, CAST(floor(progress / 30) AS BIGINT) AS "window", count(*) AS volume, count(*) FILTER (WHERE contains(content, 'ing')) AS praise,
      count(*) FILTER (WHERE contains(content, 'er') AND NOT contains(content, 'ing')) AS criticize FROM vd GROUP BY ALL""")
def i7b(t: Tables):
    """Closed, late and open windows together."""
    root, checkpoint = jobs.folders(t.spark, "ending")
    windows = jobs.EndingWindows(t.spark, root, t.lex, "1 day")
    windows.start(danmaku_stream(t), checkpoint).awaitTermination()
    return windows.totals()


@report("i8_stream_inserts", "SELECT video_id, progress, content, user_hash, min(id) AS id FROM vd GROUP BY ALL")
def i8(t: Tables):
    rows = danmaku_stream(t)
    root, checkpoint = jobs.folders(t.spark, "danmaku")
    empty = t.spark.createDataFrame([], rows.schema)
    query = jobs.danmaku_inserts(rows, root, empty, checkpoint)
    return jobs.finished(t.spark, query, root, empty).select("video_id", "progress", "content", "user_hash", "id")


@report("i8_stream_dedup", "SELECT DISTINCT video_id, progress, content, user_hash FROM vd")
def i8b(t: Tables):
    result = jobs.deduplicated_danmaku(danmaku_stream(t))
    path, checkpoint = jobs.folders(t.spark, "dedup")
    jobs.append_files(result, path, checkpoint).awaitTermination()
    return t.spark.read.schema(result.schema).parquet(path).select("video_id", "progress", "content", "user_hash")
