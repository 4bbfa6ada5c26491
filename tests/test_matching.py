"""The label ladder: hand-made cases for each rule, and random phrases against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from echolens.functions import fixed_values as fixed
from echolens.operators import audit, dictionary, matching
from echolens.operators.lexicon import Lexicon
from echolens.sources import config

TREE = {"hierarchy": {
    "机制": {"战斗": ["打击", "连招"]}, "操控": {"界面(UI/UX)": ["菜单"]}, "技术": {"帧率": ["卡顿"]},
    fixed.META_L1: {"印象": [fixed.RECOMMEND_LABEL, fixed.OVERALL_LABEL], "梗": [fixed.MEME_LABEL], "斜": ["甲/乙"]},
}}
WORDS = {"definitions": {
    "打击": {"keywords": ["打击", "手感"]}, "连招": {"keywords": ["连招", "连击手"]}, "菜单": {"keywords": ["菜单", "按钮"]},
    "卡顿": {"keywords": ["卡顿", "卡"]}, "甲/乙": {"keywords": ["甲乙"]},
    fixed.OVERALL_LABEL: {"keywords": ["评价"]},
}}


@pytest.fixture(scope="module")
def lex(tmp_path_factory):
    import json
    folder = tmp_path_factory.mktemp("cfg")
    for name, value in (("tree.json", TREE), ("words.json", WORDS)):
        (folder / name).write_text(json.dumps(value, ensure_ascii=False), encoding="utf-8")
    return config.load_lexicon(str(folder / "tree.json"), str(folder / "words.json"))


CASES = [
    ("手感很好", "打击"),  # keyword
    ("打击", "打击"),
    ("这个菜单和手感", "菜单"),  # own name listed as keyword counts twice: 4 against 2
    ("手感 按钮", "打击"),  # tie of 2: the earlier label of the dictionary wins
    ("卡总来了", fixed.OVERALL_LABEL),  # masked name, then short phrase
    ("卡总也卡", "卡顿"),  # only the name is masked
    ("这也太抽象了手感", fixed.MEME_LABEL),  # meme words come before keywords
    ("强烈推荐大家都来试一试这个今年最值得期待的作品吧", fixed.RECOMMEND_LABEL),
    ("总的来说这是一个非常神作的作品没有什么可以多说的了", fixed.OVERALL_LABEL),
    ("一二三四五六七八九十一二三四五六七八九十", fixed.OVERALL_LABEL),  # 20 characters
    ("一二三四五六七八九十一二三四五六七八九十一", None),  # 21
    ("😀" * 20, fixed.OVERALL_LABEL), ("😀" * 21, None),  # length in code points
    ("　手感　", "打击"), ("　 \t", None), ("", None), (None, None),  # wide blanks are stripped
    ("NB" + "x" * 30, fixed.OVERALL_LABEL), ("nB" + "x" * 30, None),  # case matters
    ("评价" + "x" * 30, None),  # a general label never competes by keyword
]


def test_cases(spark, lex):
    rows = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(CASES)], "i int, phrase string")
    got = {r["i"]: r["l3"] for r in matching.with_label(rows, "phrase", lex).collect()}
    assert [got[i] for i in range(len(CASES))] == [want for _, want in CASES]


def brute(phrase, lex):
    p = (phrase or "").strip()
    if not p:
        return None
    for term in lex.masked_terms:
        p = p.replace(term, "×")
    if any(w in p for w in lex.meme_words):
        return lex.meme_label
    order, score = [], {}
    for l3, word, _ in lex.keywords:
        if l3 not in lex.fallback:
            if l3 not in score:
                order.append(l3)
                score[l3] = 0
            score[l3] += len(word) if word in p else 0
    best = max(order, key=lambda x: score[x])
    if score[best] > 0:
        return best
    if any(w in p for w in lex.recommend_words):
        return lex.recommend_label
    if any(w in p for w in lex.overall_words) or len(p) <= 20:
        return lex.overall_label
    return None


def test_random_phrases_match_brute_force(spark, lex):
    rng = random.Random(5)
    bits = ["打击", "手感", "连招", "连击手", "菜", "菜单", "按钮", "卡", "卡总", "甲乙", "玩梗", "推荐", "神", "烂", "　", " ", "xxxx", "一二三四五六", "😀"]
    phrases = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 8))) for _ in range(600)]
    rows = spark.createDataFrame(list(enumerate(phrases)), "i int, phrase string").repartition(5)
    got = {r["i"]: r["l3"] for r in matching.with_label(rows, "phrase", lex).collect()}
    assert [got[i] for i in range(len(phrases))] == [brute(p, lex) for p in phrases]


def syllable_lexicon(n):
    """``n`` words of three syllables, a label per first two, some words listed twice, some prefixes of others."""
    parts = ["th", "er", "an", "on", "in", "at", "st", "re", "ha", "en", "卡", "顿"]
    words = [a + b + c for a in parts for b in parts for c in parts][:n]
    names = list(dict.fromkeys(w[:-2] if w.isascii() else w[:-1] for w in words))
    taxonomy = tuple((i, f"L{i % 7}", f"M{i % 20}", name, i % 50 == 49) for i, name in enumerate(names))
    keywords = [(w[:-2] if w.isascii() else w[:-1], w, i) for i, w in enumerate(words)]
    keywords += [(names[0], names[0], n), (names[0], names[0], n + 1), (names[-1], "e", n + 2), (names[-1], words[0], n + 3)]
    return Lexicon(taxonomy, tuple(keywords), meme_words=("qq",), recommend_words=("zz",), praise_words=("yy",), criticize_words=("xx",), masked_terms=("hahaha",))


@pytest.mark.parametrize("size", [1, 12, 1391, 1728])
def test_dictionaries_of_any_size(spark, size):
    rng, lex = random.Random(size), syllable_lexicon(size)
    bits = ["th", "er", "an", "on", "in", "at", "st", "re", "ha", "en", "卡", "顿", " ", "qq", "zz", "yy", "É", "😀"]
    phrases = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(300)] + [None, "", "e", "e" * 5000, "ther" * 3000]
    rows = spark.createDataFrame(list(enumerate(phrases)), "i int, phrase string").repartition(3)
    got = {r["i"]: r["l3"] for r in matching.with_label(rows, "phrase", lex).collect()}
    assert [got[i] for i in range(len(phrases))] == [brute(p, lex) for p in phrases]
    kept = matching.with_label(rows, "phrase", lex, only_matched=True)
    assert kept.count() == sum(brute(p, lex) is not None for p in phrases)
    hits = sorted(map(tuple, matching.keyword_hits(rows, "phrase", lex).select("i", "l3", "keyword", "pos").collect()))
    masked = [(i, p.strip().replace("hahaha", "×")) for i, p in enumerate(phrases) if p]
    assert hits == sorted((i, l3, w, pos) for i, p in masked for l3, w, pos in lex.keywords if l3 not in lex.fallback and w in p)


def test_matching_has_one_plan_without_python(spark):
    for size in (12, 1391):
        plan = matching.labelled(spark.createDataFrame([("x",)], "phrase string"), "phrase", syllable_lexicon(size))._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Exchange", "Join"))


def test_words_are_filed_under_grams_they_hold():
    words = [w for _, w, _ in syllable_lexicon(1728).keywords]
    by_gram = dictionary.filed(dict.fromkeys(words))
    assert sorted(w for members in by_gram.values() for w in members) == sorted(set(words))
    assert all(g in w for g, members in by_gram.items() for w in members)
    assert max(map(len, by_gram.values())) < 40  # a phrase meets few words it does not hold


def test_empty_dictionary(spark):
    lex = Lexicon((), (), meme_words=(), recommend_words=(), praise_words=(), criticize_words=(), masked_terms=())
    rows = spark.createDataFrame([("short",), ("x" * 30,), (None,)], "phrase string")
    assert [r["l3"] for r in matching.labelled(rows, "phrase", lex).collect()] == [lex.overall_label, None, None]
    assert matching.keyword_hits(rows, "phrase", lex).count() == 0


def test_paths_and_unmatched_rows(spark, lex):
    rows = spark.createDataFrame([("按钮",), ("甲乙",), ("x" * 40,)], "phrase string")
    got = {r["phrase"]: r["full_path"] for r in matching.labelled(rows, "phrase", lex).collect()}
    # A label with a slash carries its own second level.
    assert got == {"按钮": "操控/界面(UI/UX)/菜单", "甲乙": f"{fixed.META_L1}/甲/乙", "x" * 40: None}
    assert matching.labelled(rows, "phrase", lex, only_matched=True).count() == 2


def test_fallback_labels_and_tone(spark, lex):
    assert lex.fallback == {fixed.RECOMMEND_LABEL, fixed.OVERALL_LABEL, fixed.MEME_LABEL}
    from pyspark.sql import functions as F
    rows = spark.createDataFrame([("神作但是烂",), ("烂",), ("平",)], "p string")
    assert [r[0] for r in rows.select(matching.tone(F.col("p"), lex)).collect()] == ["positive", "negative", "neutral"]


def test_keyword_hits_keep_duplicates(spark, lex):
    rows = spark.createDataFrame([("打击",)], "phrase string")
    assert matching.keyword_hits(rows, "phrase", lex).count() == 2


def test_gaps(spark, lex):
    path = f"{fixed.META_L1}/印象/{fixed.OVERALL_LABEL}"
    rows = spark.createDataFrame(
        [(path, q) for q in ["手感不好啊啊"] * 2 + ["GREAT stuff 啊"] + ["666666"] + ["hao wan a"] + ["♥♥♥♥♥♥"] + ["某个没收录的东西"]], "full_path string, quote string")
    got = {r["quote"]: (r["kind"], r["n"]) for r in audit.dictionary_gaps(rows, lex, path).collect()}
    assert got == {
        "手感不好啊啊": ("rescued", 2), "GREAT stuff 啊": ("overall", 1), "666666": ("noise", 1), "hao wan a": ("noise", 1),
        "♥♥♥♥♥♥": ("noise", 1), "某个没收录的东西": ("candidate", 1)}


def test_dictionary_size_is_checked():
    with pytest.raises(ValueError):
        Lexicon((), tuple(("a", str(i), i) for i in range(50_001)))


def test_label_to_path_moves_no_row(spark):
    from echolens.plans.tables import LEXICON

    rows = spark.range(1000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'Overall' WHEN id % 7 = 0 THEN 'none' END AS l3")
    got = matching.with_path(rows, LEXICON)
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert {(r["l3"], r["full_path"]) for r in got.collect()} == {("Overall", "Meta/Impression/Overall"), ("none", None), (None, None)}


def test_large_dictionaries_are_searched_by_their_prefix_tree(spark):
    """The work of a text follows its length and hits: no part of the expression runs per word of the dictionary or pair of hits."""
    import re

    words = [w for _, w, _ in syllable_lexicon(1728).keywords]
    index = dictionary.WordIndex({w: [i] for i, w in enumerate(dict.fromkeys(words))}, "array<int>")
    longest = re.compile(index.pattern)  # letters only: the same in Python and Java
    text = "therhahaen卡顿thonatenthe"
    assert {m.group(1) for m in longest.finditer(text)} == {max((w for w in words if text.startswith(w, i)), key=len) for i in range(len(text)) if any(text.startswith(w, i) for w in words)}
    rows = spark.createDataFrame([(text,)], "t string")
    assert sorted(rows.select(index.found(F.col("t"))).first()[0]) == sorted([i] for i, w in enumerate(dict.fromkeys(words)) if w in text)


def test_words_with_special_characters_and_many_branches(spark):
    """Words that are prefixes of each other, hold signs of a pattern, or begin with many different characters."""
    words = ["a", "aa", "aab", "b.c", "(", "[x]", "\\E", "^$", "-", "é", "😀", "😀😀", " ", "\n", "&&", *map(chr, range(0x4E00, 0x4E00 + 300)), *(chr(c) + "z" for c in range(0x4E00, 0x4E00 + 300, 7))]
    index = dictionary.WordIndex({w: w for w in words}, "string")
    rng = random.Random(3)
    texts = ["".join(rng.choice([*words, "q", "bxc", "]"]) for _ in range(rng.randint(0, 12))) for _ in range(200)]
    rows = spark.createDataFrame(list(enumerate([*texts, None])), "i int, t string").repartition(3)
    got = {r["i"]: r["f"] for r in rows.select("i", index.found(F.col("t")).alias("f")).collect()}
    assert [sorted(got[i]) for i in range(len(texts))] == [sorted(w for w in words if w in t) for t in texts]
    assert got[len(texts)] is None
