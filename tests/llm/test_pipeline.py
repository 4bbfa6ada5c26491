"""The pipeline stage by stage against brute force, and the registered queries against their SQL."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from echolens.llm import catalog, toxicity
from echolens.llm.frames import table, written

from .. import twins
from . import brute

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return twins.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_against_sql(name, spark, duck):
    df = catalog.queries()[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert twins.differences(df, duck, catalog.oracle_sql()[name]) == []


def test_all_are_registered():
    names = set(entry.queries())
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_stages(spark):
    docs = table(spark, FOLDER, "documents")
    bench = [tuple(r) for r in table(spark, FOLDER, "benchmark").select("item_id", "text").collect()]
    model = toxicity.learned(spark, FOLDER, docs)
    rejected = {r["doc_id"] for r in toxicity.score(docs, model).filter("score >= 0.5").collect()}
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, before, FOLDER), name)
        rows, kept = before.collect(), {r["doc_id"]: r for r in out.collect()}
        texts = [(r["doc_id"], r["text"]) for r in rows]
        if name != "bpe":
            assert out.columns == docs.columns
        if name == "toxicity":
            want = {d for d, _ in texts} - rejected
        elif name == "ngram_jaccard_join":
            want = {d for d, low in brute.groups(texts).items() if d == low}
        elif name == "suffix_dedup":
            for (d, t), hit in zip(texts, brute.removed(texts)):
                left = bytes(c for p, c in enumerate(t.encode()) if p not in hit).decode("utf-8", "ignore")
                assert kept[d]["text"] == left and (not hit or kept[d]["n_chars"] == len(left))
        elif name == "decontamination":
            found = {d: brute.contaminated(t, bench) for d, t in texts}
            want = {d for d, (n, hit, _) in found.items() if not (hit and 20 * hit >= n)}
        else:
            library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            assert all(kept[d]["n_tokens"] == len(library.encode(t, add_special_tokens=False).ids) for d, t in texts)
        assert set(kept) == want if name not in ("suffix_dedup", "bpe") else len(kept) == len(rows)
        before = out


def test_odd_rows_pass_every_stage(spark, odd_rows):
    rows = [(d, t, None if i % 3 else "en", None, None if i % 2 else 5, "mine", i) for i, (d, t) in enumerate(odd_rows)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, predicted int"
    docs = spark.createDataFrame(rows, schema)
    for source in (docs, docs.filter("false")):
        for name, stage in corpus_pipeline.STAGES:
            out = written(stage(spark, source, FOLDER), "odd")
            if name == "bpe":
                assert out.count() == source.count()
            else:
                assert out.columns == docs.columns and out.filter("kept <> 'mine'").count() == 0
            if source is not docs:
                assert out.count() == 0
            elif name == "ngram_jaccard_join":
                group = brute.groups(odd_rows)
                assert sorted(str(r["doc_id"]) for r in out.collect()) == sorted([str(d) for d, low in group.items() if d == low] + ["None", "None"])
