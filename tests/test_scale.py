"""Plans under skew: one comment holds most opinions, and AQE must split it in every join on comments."""

import pytest
from pyspark.sql import functions as F

from echolens import schemas
from echolens.operators import annotate, joins, matrix, merge, nesting
from echolens.plans.tables import LEXICON

SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
}


@pytest.fixture()
def skewed(spark):
    before = {k: spark.conf.get(k, None) for k in SMALL}
    for k, x in SMALL.items():
        spark.conf.set(k, x)
    yield spark
    for k, x in before.items():
        spark.conf.unset(k) if x is None else spark.conf.set(k, x)


@pytest.fixture()
def tables(skewed):
    spark = skewed
    opinions = spark.range(0, 20000, 1, 16).select(
        "id", F.when(F.col("id") % 3 != 0, 7).otherwise(F.col("id")).cast("bigint").alias("comment_id"),
        F.concat(F.lit("Mechanics/Core/"), F.sha2(F.col("id").cast("string"), 256)).alias("full_path"),
        F.lit("negative").alias("sentiment"), F.lit(0.5).alias("sentiment_confidence"), F.sha2(F.col("id").cast("string"), 512).alias("quote"),
        F.lit(None).cast("int").alias("quote_start"), F.lit(None).cast("int").alias("quote_end"), F.lit(None).cast("timestamp_ntz").alias("created_at"))
    comments = spark.createDataFrame([], schemas.COMMENTS).unionByName(
        spark.range(0, 20000, 1, 4).select("id", F.lit("text").alias("content"), F.lit("steam:1").alias("target_id")), allowMissingColumns=True)
    return opinions, comments


def final_plan(df):
    """Run the query, then read the plan that AQE ended with."""
    df._jdf.queryExecution().executedPlan().execute().count()
    return df._jdf.queryExecution().executedPlan().toString()


def test_join_of_opinions_and_comments_is_split(tables):
    assert "skew=true" in final_plan(joins.with_comment(tables[0], tables[1], "target_id"))


def test_counts_after_the_join_are_split_too(tables):
    assert "skew=true" in final_plan(matrix.topic_counts(*tables, meta_l1=None))


def test_core_flags_are_split(tables):
    rows = tables[0].select(F.col("comment_id").alias("id"), F.col("id").cast("int").alias("pos"), F.lit(False).alias("is_core"), "quote")
    assert "skew=true" in final_plan(annotate.core_flags(rows))


def test_final_opinions_are_split(tables):
    opinions, comments = tables
    rows = opinions.select(
        F.col("comment_id").alias("id"), F.col("id").cast("int").alias("pos"), F.concat(F.lit("thatin "), "quote").alias("phrase"), "sentiment",
        F.lit(0.1).alias("sentiment_score"), "sentiment_confidence", F.lit(False).alias("is_core"))
    todo = comments.select("id", "content", F.lit("neutral").alias("sentiment"), F.lit(0.0).alias("sentiment_score"))
    labels, final = annotate.finalise(todo, rows, LEXICON)
    assert "skew=true" in final_plan(final)
    assert labels.count() == 20000 and final.filter("is_core").count() == final.select("id").distinct().count() == 20000


def test_replaced_opinions_are_split(tables):
    opinions, comments = tables
    labels = comments.filter("id % 2 = 1").select(
        "id", F.lit("negative").alias("sentiment"), F.lit(0.1).alias("sentiment_score"), F.lit(0.1).alias("sentiment_confidence"),
        F.lit("X").alias("topic"), F.array(F.lit("Y")).alias("sub_topics"))
    new = opinions.select("comment_id", F.col("id").cast("int").alias("pos"), "full_path", "sentiment", F.lit("0.5").alias("sentiment_confidence"), "quote", "quote_start", "quote_end")
    _, out = merge.replace_analysis(comments, opinions, labels, new, F.lit(None).cast("timestamp_ntz"))
    assert final_plan(out).count("skew=true") >= 2
    assert out.count() == opinions.count()


def test_nested_opinions_spread_a_hot_comment(tables):
    opinions, _ = tables
    rows = nesting.nested_opinions(opinions.drop("created_at"), per_row=100)
    sizes = rows.select("comment_id", F.size("opinions").alias("n"))
    assert sizes.agg(F.sum("n")).first()[0] == 20000 and sizes.agg(F.max("n")).first()[0] < 200
    assert sizes.filter("comment_id = 7").count() > 100
