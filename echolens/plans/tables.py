"""Driver tables seen as comments, opinions, bullet comments and vectors.

The view texts run unchanged in Spark and DuckDB, so report and SQL twin start from the same rows.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import strip
from ..operators.lexicon import Lexicon

BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

TAXONOMY = (
    (0, "Mechanics", "Core", "Combat", False), (1, "Mechanics", "Core", "Movement", False),
    (2, "Control", "Interface(UI/UX)", "Layout", False), (3, "Art", "Visual", "Style", False),
    (4, "Story", "Plot", "MainPlot", False), (5, "Audio", "Music", "Score", False),
    (6, "Tech", "Frames", "Stutter", False), (7, "Platform", "Network", "Latency", False),
    (8, "Meta", "Impression", "Recommend", True), (9, "Meta", "Impression", "Overall", True),
    (10, "Meta", "Irony", "Meme", True),
)
KEYWORDS = (
    ("Combat", "thatin", 0), ("Combat", "Combat", 1), ("Combat", "Combat", 2), ("Movement", "orantion", 0),
    ("Movement", "rewh", 1), ("Layout", "inoran", 0), ("Style", "hehely", 0), ("MainPlot", "ononst", 0),
    ("Score", "edth", 0), ("Stutter", "ndth", 0), ("Latency", "orre", 0), ("Latency", "q", 1),
)
LEXICON = Lexicon(
    TAXONOMY, KEYWORDS, meme_words=("onon",), recommend_words=("anti",), praise_words=("ing",), criticize_words=("er",),
    masked_terms=("orreon",), meme_label="Meme", recommend_label="Recommend", overall_label="Overall", meta_l1="Meta",
)

# A dictionary of realistic size: every word of three syllables, labelled by its first two, which is a keyword twice more.
SYLLABLES = ("th", "er", "an", "on", "in", "at", "st", "re", "ha", "en", "ou")
LARGE = Lexicon(
    tuple((11 * i + j, f"Group{i}", f"Part{j}", a + b, (11 * i + j) % 40 == 39) for i, a in enumerate(SYLLABLES) for j, b in enumerate(SYLLABLES)),
    tuple((a + b, a + b + c, k) for a in SYLLABLES for b in SYLLABLES for k, c in enumerate(SYLLABLES))
    + tuple((a + b, a + b, 11 + k) for a in SYLLABLES for b in SYLLABLES for k in range(2)),
    meme_words=("onon",), recommend_words=("anti",), praise_words=("ing",), criticize_words=("er",),
    masked_terms=("orreon",), meme_label="Meme", recommend_label="Recommend", overall_label="Overall", meta_l1="Meta",
)


def values(rows) -> str:
    cell = lambda x: "true" if x is True else "false" if x is False else f"'{x}'" if isinstance(x, str) else str(x)
    return ", ".join("(" + ", ".join(cell(x) for x in row) + ")" for row in rows)


_PARTS = f"(SELECT * FROM (VALUES {values(enumerate(SYLLABLES))}) AS t(i, s))"
VIEWS = {
    "tax": f"SELECT * FROM (VALUES {values(TAXONOMY)}) AS t(ord, l1, l2, l3, is_fallback)",
    "kw": f"SELECT * FROM (VALUES {values(KEYWORDS)}) AS t(l3, keyword, pos)",
    "taxl": f"""SELECT 11 * a.i + b.i AS ord, concat('Group', CAST(a.i AS VARCHAR(9))) AS l1, concat('Part', CAST(b.i AS VARCHAR(9))) AS l2, concat(a.s, b.s) AS l3,
          (11 * a.i + b.i) % 40 = 39 AS is_fallback FROM {_PARTS} a CROSS JOIN {_PARTS} b""",
    "kwl": f"""SELECT concat(a.s, b.s) AS l3, concat(a.s, b.s, c.s) AS keyword, c.i AS pos FROM {_PARTS} a CROSS JOIN {_PARTS} b CROSS JOIN {_PARTS} c
          UNION ALL SELECT concat(a.s, b.s), concat(a.s, b.s), 11 + c.i FROM {_PARTS} a CROSS JOIN {_PARTS} b CROSS JOIN {_PARTS} c WHERE c.i < 2""",
    # Comments.
    "vc": """
        SELECT d.doc_id AS id,
          CASE WHEN d.lang = 'en' THEN 'steam' ELSE 'bilibili' END AS platform,
          CAST(d.doc_id AS VARCHAR(20)) AS source_id,
          concat(CASE WHEN d.lang = 'en' THEN 'steam:' ELSE 'bilibili:video:' END, d.source) AS target_id,
          d.text AS content, d.lang AS language, l.quality AS rating,
          CASE WHEN d.doc_id % 3 = 0 THEN NULL ELSE CAST(d.n_chars % 50 AS INT) END AS likes,
          e.ts AS posted_at, concat('{"name": "Game ', d.source, '"}') AS extra_meta,
          CASE WHEN l.doc_id IS NULL THEN NULL WHEN l.toxic = 1 THEN 'negative'
               WHEN l.quality = 1 THEN 'positive' ELSE 'neutral' END AS sentiment,
          CAST(CASE WHEN l.doc_id IS NULL THEN NULL WHEN l.toxic = 1 THEN -0.5
               WHEN l.quality = 1 THEN 0.75 ELSE 0.0 END AS DOUBLE) AS sentiment_score,
          CASE WHEN l.doc_id IS NULL THEN NULL ELSE CAST(d.n_chars % 101 AS DOUBLE) / CAST(100 AS DOUBLE) END AS sentiment_confidence,
          CASE WHEN l.doc_id IS NULL THEN NULL ELSE e.ts END AS analyzed_at
        FROM documents d
        LEFT JOIN labels l ON l.doc_id = d.doc_id
        JOIN events e ON e.event_id = d.doc_id""",
    # Comments with the remaining columns of the comment table.
    "vf": """
        SELECT c.*, concat('user-', CAST(c.id % 97 AS VARCHAR(20))) AS author,
          CAST(c.id % 97 AS VARCHAR(20)) AS author_id,
          CASE WHEN c.likes IS NULL THEN NULL ELSE CAST(c.id % 4 AS INT) END AS replies,
          CASE WHEN c.id % 4 = 0 THEN NULL ELSE concat(
            '{"appid": "', CAST(c.id % 9 AS VARCHAR(20)), '", "playtime_at_review": ', CAST((c.id * 7) % 3000 AS VARCHAR(20)),
            ', "refunded": ', CASE WHEN c.id % 5 = 0 THEN 'true' ELSE 'false' END,
            ', "weighted_vote_score": 0.', CAST(c.id % 9 AS VARCHAR(20)),
            ', "developer_response": ', CASE WHEN c.id % 6 = 1 THEN '" thanks "' WHEN c.id % 6 = 2 THEN '"  "' ELSE 'null' END,
            ', "timestamp_dev_responded": ', CAST(1700000000 + c.id AS VARCHAR(20)),
            ', "profile": {"level": ', CAST(c.id % 7 AS VARCHAR(20)), ', "sex": "x", "vip": {"status": ', CAST(c.id % 2 AS VARCHAR(20)), '}}}') END AS extra_json,
          CASE WHEN c.analyzed_at IS NULL THEN NULL WHEN c.id % 13 = 0 THEN 'Ghost' ELSE t.l1 END AS topic,
          CASE WHEN c.analyzed_at IS NULL OR c.id % 5 = 0 THEN NULL
               WHEN c.id % 7 = 0 THEN concat('["', t.l2, '", "Phantom"]')
               ELSE concat('["', t.l2, '", "', u.l2, '"]') END AS sub_topics,
          c.posted_at AS fetched_at,
          CASE WHEN c.likes IS NULL THEN NULL ELSE c.posted_at END AS likes_refreshed_at,
          CASE WHEN c.id % 6 = 0 THEN c.posted_at END AS developer_response_refreshed_at
        FROM vc c JOIN tax t ON t.ord = c.id % 11 JOIN tax u ON u.ord = (c.id + 4) % 11""",
    # Opinions.
    "vo": """
        SELECT c.conv_id * 1000 + c.turn AS id, c.conv_id AS comment_id,
          concat(t.l1, '/', t.l2, '/', t.l3) AS full_path,
          CASE c.role WHEN 'user' THEN 'negative' WHEN 'assistant' THEN 'positive' ELSE 'neutral' END AS sentiment,
          CAST(c.turn % 10 AS DOUBLE) / CAST(10 AS DOUBLE) AS sentiment_confidence, c.text AS quote
        FROM conversations c JOIN tax t ON t.ord = (c.conv_id * 7 + c.turn) % 11""",
    # Bullet comments.
    "vd": """
        SELECT event_id AS id, concat('bilibili:video:', CAST(user_id AS VARCHAR(20))) AS video_id,
          event_type AS content, CAST(floor(value) AS INT) AS progress,
          CAST(event_id % 7 AS INT) AS mode, CAST(user_id % 13 AS VARCHAR(20)) AS user_hash, ts AS posted_at
        FROM events""",
    # Vectors.
    "ve": "SELECT vec_id AS comment_id, 'm-1' AS model, 64 AS dim, embedding AS vector, label FROM embeddings",
}

# White space that a strip removes, in RE2 syntax.
BLANK_SQL = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def strip_sql(expr: str) -> str:
    return f"regexp_replace({expr}, '^{BLANK_SQL}+|{BLANK_SQL}+$', '', 'g')"


# Phrases: the stripped, non-empty pieces of a comment between full stops (the split differs per engine).
DUCK_VIEWS = {
    **VIEWS,
    "vp": f"""
        SELECT id, pos, phrase FROM (
          SELECT id, CAST(generate_subscripts(parts, 1) - 1 AS INT) AS pos, {strip_sql('unnest(parts)')} AS phrase
          FROM (SELECT id, string_split(content, '.') AS parts FROM vc)) WHERE phrase <> ''""",
}


def mentioned(sql: str, names) -> list[str]:
    return [n for n in names if re.search(rf"\b(FROM|JOIN)\s+{n}\b", sql)]


def with_views(sql: str) -> str:
    """Prefix the view texts a query needs, in dependency order."""
    needed: list[str] = []

    def add(text: str) -> None:
        for name in mentioned(text, DUCK_VIEWS):
            add(DUCK_VIEWS[name])
            if name not in needed:
                needed.append(name)

    add(sql)
    if not needed:
        return sql
    head = ",\n".join(f"{n} AS ({DUCK_VIEWS[n]})" for n in needed)
    body = sql.strip()
    return f"WITH {head},\n{body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head}\n{body}"


def labels_sql(source: str, kw: str = "kw", tax: str = "tax") -> str:
    """Common table expressions that label ``phrase`` of ``source``: result ``labp`` adds l3 and full_path."""
    return f"""
        lab_m AS (SELECT *, replace({strip_sql('phrase')}, 'orreon', '×') AS m FROM ({source})),
        lab_hit AS (
          SELECT d.m, k.l3, sum(length(k.keyword)) AS score, min(t.ord) AS ord
          FROM (SELECT DISTINCT m FROM lab_m) d JOIN {kw} k ON contains(d.m, k.keyword) JOIN {tax} t ON t.l3 = k.l3
          WHERE NOT t.is_fallback GROUP BY d.m, k.l3),
        lab_best AS (
          SELECT m, l3 AS best FROM (SELECT *, row_number() OVER (PARTITION BY m ORDER BY score DESC, ord) AS rn FROM lab_hit)
          WHERE rn = 1),
        lab AS (
          SELECT lab_m.*, CASE WHEN m IS NULL OR m = '' THEN NULL WHEN contains(m, 'onon') THEN 'Meme'
            WHEN best IS NOT NULL THEN best WHEN contains(m, 'anti') THEN 'Recommend'
            WHEN contains(m, 'ing') OR contains(m, 'er') THEN 'Overall' WHEN length(m) <= 20 THEN 'Overall' END AS l3
          FROM lab_m LEFT JOIN lab_best USING (m)),
        labp AS (
          SELECT lab.*, CASE WHEN t.l3 IS NULL THEN NULL ELSE concat(t.l1, '/', t.l2, '/', t.l3) END AS full_path, t.l1
          FROM lab LEFT JOIN {tax} t ON t.l3 = lab.l3)"""


class Tables:
    """Lazily resolved tables and views of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.lex = spark, folder, LEXICON
        self._seen: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self._seen:
            if name in BASE:
                frame = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            elif name in VIEWS:
                frame = self.sql(VIEWS[name])
            elif name == "vp":
                pieces = self.vc.select("id", F.posexplode(F.split("content", "[.]")).alias("pos", "phrase"))
                frame = pieces.withColumn("phrase", strip(F.col("phrase"))).filter(F.col("phrase") != "")
            else:
                raise AttributeError(name)
            self._seen[name] = frame
        return self._seen[name]

    def sql(self, text: str) -> DataFrame:
        names = mentioned(text, [*BASE, *VIEWS])
        ready = text.replace("{", "{{").replace("}", "}}")
        ready = reduce(lambda s, n: re.sub(rf"\b(FROM|JOIN)(\s+){n}\b", rf"\1\2{{{n}}}", s), names, ready)
        return self.spark.sql(ready, **{n: getattr(self, n) for n in names})
