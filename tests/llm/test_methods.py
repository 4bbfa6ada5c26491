"""Learning against plain loops, hashes against regular texts, patterns in several blocks, empty tables and clashing columns."""

import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from echolens.llm import bpe, decontaminate, langid, packed_ids, parity_join, ragged, token_counts, toxicity

from . import brute
from .conftest import frame

BYTE = public_tokenizers.path("byte_bpe_50k.json")


def thue_morse(n):
    out = "a"
    while len(out) < n:
        out += out.translate(str.maketrans("ab", "ba"))
    return out


SWAPPED = str.maketrans("ab", "ba")


# ---- word hashes

def test_regular_words_do_not_collide():
    word = thue_morse(1024)
    words = [word, word.translate(SWAPPED), thue_morse(256), thue_morse(256).translate(SWAPPED), "a" * 300, "a" * 301, "", "a", "b", "ab", "a" * 8, "a" * 9, "a\0", "x" * 256, "x" * 257]
    text = " ".join(w for w in words if w)
    (block,) = ragged.blocks(pa.array([text]))
    w = ragged.Words(block, ragged.NOT_SPACE)
    assert len(set(w.hash.tolist())) == len([x for x in words if x])
    # The same wherever a word stands.
    (block,) = ragged.blocks(pa.array(["q " + " ".join(reversed(text.split(" "))), text.split(" ")[0]]))
    again = ragged.Words(block, ragged.NOT_SPACE)
    assert again.hash[1:-1].tolist() == w.hash[::-1].tolist() and again.hash[-1] == w.hash[0]


def test_regular_texts_are_neither_copies_nor_contaminated(spark):
    word = thue_morse(1024)
    docs = frame(spark, [(1, word), (2, word.translate(SWAPPED)), (3, word.upper())])
    got = {r["doc"]: r["component"] for r in parity_join.similar_groups(docs).collect()}
    assert got == {1: 1, 2: 2, 3: 1}
    bench = spark.createDataFrame([("t", word)], "item_id string, text string")
    hits = {r["doc_id"]: list(r["item_ids"]) for r in decontaminate.contamination(docs, bench).collect()}
    assert hits == {1: ["t"], 2: [], 3: ["t"]}


def test_equal_hashes_do_not_make_a_hit(monkeypatch):
    """Only the bytes decide: with a hash that knows the first letter only, other words with it are no hit."""
    monkeypatch.setattr(ragged, "word_hashes", lambda data, start, end: data[start].astype(np.uint64))
    (rows,) = decontaminate.item_patterns([pa.RecordBatch.from_arrays([pa.array(["i"]), pa.array(["alpha beta"])], names=["a", "b"])])
    finder = decontaminate.Finder([(rows.column(1)[0].as_py(), rows.column(2)[0].as_py(), ["i"])])
    (machine, _), = finder.machines
    (block,) = ragged.blocks(pa.array(["apple bone alpha beta also big", "Alpha BETA"]))
    at, which = machine.occurrences(ragged.Words(block, ragged.ALPHANUMERIC))
    assert sorted(at.tolist()) == [2, 6] and set(which.tolist()) == {0}


# ---- 10. several blocks of patterns

def test_many_patterns_and_a_variant_column(spark):
    items = [(f"i{i}", " ".join(f"w{i}x{j}" for j in range(14))) for i in range(60)] + [("short", "k1 k2")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    texts = [(1, items[3][1] + " tail k1 k2"), (2, "nothing at all"), (3, None), (3, None), (4, items[3][1].replace("x5", "y5")), (None, items[50][1].upper())]
    docs = frame(spark, texts).withColumn("v", F.parse_json(F.lit('{"a": 1}'))).withColumn("m", F.create_map(F.lit("a"), F.lit(1))).withColumn("n_hit", F.lit("x"))
    one = decontaminate.contamination(docs, bench)
    parts = decontaminate.contamination(docs, bench, patterns=25)
    names = ["doc_id", "text", "n_words", "n_hit", "item_ids", "hit_spans", "contaminated"]
    assert one.columns == parts.columns
    rows = lambda df: sorted((tuple(map(str, r)) for r in df.select(*names, F.to_json("v").alias("v")).collect()))
    assert rows(one) == rows(parts)
    for r in parts.collect():
        n, hit, ids = brute.contaminated(r["text"], items)
        assert (r["n_words"], r["n_hit"], list(r["item_ids"])) == (n, hit, ids)


def test_shift_table_grows_with_the_patterns():
    r = np.random.default_rng(1)
    for n in (1000, 100_000):
        patterns = r.integers(0, 2**63, (n, 13), dtype=np.uint64)
        machine = decontaminate.Machine(patterns, [b""] * n)
        assert (machine.shift == 0).mean() < 0.05 and machine.shift.mean() > 6


# ---- 5. training against a plain per-coordinate loop

def plain_ftrl(rows, labels, epochs):
    z, n = {}, {}
    bound = toxicity.L1 * len(rows) ** 0.5
    share = sum(labels) / len(labels)
    weigh = min(10.0, ((1 - share) / share) ** 0.5)

    def w(i):
        if abs(z.get(i, 0.0)) <= bound:
            return 0.0
        return -(z[i] - np.sign(z[i]) * bound) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            row = [*rows[k], toxicity.BIAS]
            held = {i: w(i) for i in row}
            p = 1 / (1 + np.exp(-sum(held.values())))
            g = (weigh if labels[k] == 1 else 1.0) * (p - labels[k])
            for i in row:
                old = n.get(i, 0.0)
                rate = ((old + g * g) ** 0.5 - old**0.5) / toxicity.ALPHA
                z[i] = z.get(i, 0.0) + g - rate * held[i]
                n[i] = old + g * g
    return {i: w(i) for i in z if w(i) != 0}


def packed(rows, labels):
    return [pa.RecordBatch.from_arrays([pa.array([k]), pa.array([label], pa.int32()), pa.array([np.array(row, np.int32).tobytes()], pa.binary())], names=["key", "label", "slots"])
            for k, (row, label) in enumerate(zip(rows, labels))]


def test_training_against_a_plain_loop():
    r = np.random.default_rng(3)
    labels = [int(x) for x in r.integers(0, 5, 120) == 0]
    rows = [sorted({int(x) for x in r.integers(0, 40, 6)} | ({900} if label else set())) for label in labels]
    (out,) = toxicity.train(iter(packed(rows, labels)))
    got = dict(zip(out.column(0).to_pylist(), out.column(1).to_pylist()))
    want = plain_ftrl(rows, labels, toxicity.EPOCHS)
    assert set(got) == set(want) and 900 in got
    assert all(got[i] == pytest.approx(want[i]) for i in got)


def test_the_sample_is_bounded_in_features_too():
    rows, labels = [[1, 2, 3], [2, 900], [1], [900, 5]] * 20, [0, 1, 0, 1] * 20
    (short,) = toxicity.train(iter(packed(rows, labels)), limit=4 + 3 + 2 + 3)
    (four,) = toxicity.train(iter(packed(rows[:4], labels[:4])))
    assert short.equals(four)
    assert list(toxicity.train(iter([]))) == []


# ---- 6. TF-IDF, clusters and cosine by the letter

def plain_vectors(texts, idf=None):
    """Slots of byte 1- to 3-grams, as a dictionary per text."""
    out = []
    for text in texts:
        raw = re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode())
        held = {}
        for n in (1, 2, 3):
            for i in range(len(raw) - n + 1):
                code = int.from_bytes(raw[i : i + n], "big")
                slot = ((code + (n << 28)) * 0x9E3779B1 % 2**32) >> 20
                held[slot] = held.get(slot, 0) + 1
        out.append(held)
    return out


def test_language_vectors_and_clusters_by_the_letter():
    texts = [brute.prose(i, 12) if i % 2 else "the cat and the dog " * (i + 1) for i in range(12)] + ["", "a"]
    idf = np.linspace(1, 3, langid.SLOTS).astype(np.float32)
    (block,) = langid.small_blocks(pa.array(texts))
    got = langid.vectors(block, idf)
    for row, held in zip(got, plain_vectors(texts)):
        want = {s: np.log1p(c) * idf[s] for s, c in held.items()}
        norm = sum(v * v for v in want.values()) ** 0.5
        assert {int(s) for s in np.flatnonzero(row)} == set(want)
        assert all(row[s] == pytest.approx(v / norm, rel=1e-4) for s, v in want.items())

    # Farthest-first starts, then rounds of nearest centroid and mean direction.
    x = got[:12].astype(float)
    mean = x.mean(axis=0)
    starts = [max(range(12), key=lambda i: float(x[i] @ mean))]
    while len(starts) < 3:
        starts.append(min(range(12), key=lambda i: max(float(x[i] @ x[s]) for s in starts)))
    centres = [x[s] for s in starts]
    for _ in range(langid.ROUNDS):
        own = [max(range(3), key=lambda j: float(v @ centres[j])) for v in x]
        for j in range(3):
            members = [x[i] for i in range(12) if own[i] == j]
            if members:
                total = np.sum(members, axis=0)
                centres[j] = total / np.linalg.norm(total)
    centroids, owners = langid.cluster(x, 3)
    assert np.allclose(centroids, centres)
    assert owners.tolist() == [max(range(3), key=lambda j: float(v @ centres[j])) for v in x]


def test_language_sample_is_the_same_through_salts(spark):
    rows = [(i, brute.prose(i, 20), "en" if i % 4 else "fr") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model, copies = langid.fit(docs, per_language=30), langid.fit(docs.union(docs), per_language=30)
    assert model.langs == copies.langs == ["en"] * model.langs.count("en") + ["fr"] * model.langs.count("fr")
    keys = [r[0] for r in docs.filter("lang = 'en'").orderBy(F.xxhash64("doc_id"), "doc_id").limit(30).select("doc_id").collect()]
    only = langid.fit(docs.filter((F.col("lang") == "fr") | F.col("doc_id").isin(keys)), per_language=30)
    assert len(only.langs) == len(model.langs)


# ---- 2. to 4. empty tables and clashing columns

def test_token_files_of_an_empty_table(spark, none):
    assert packed_ids.read(packed_ids.write(none, BYTE, end_id=2)).count() == 0
    got = bpe.digests(none, bpe.word_bpe())
    assert got.count() == 0 and got.columns == ["doc_id", "text", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert bpe.encode(none, BYTE).count() == 0 and bpe.decode(bpe.encode(none, BYTE), BYTE).count() == 0


def test_result_columns_replace_clashing_ones(spark):
    docs = frame(spark, [(1, "ab cd"), (1, "ab cd"), (2, None)]).withColumns({"n_tokens": F.lit("x"), "IDS": F.lit(1), "other": F.lit(5)})
    got = bpe.digests(docs, bpe.word_bpe()).orderBy("doc_id").collect()
    assert [r["n_tokens"] > 0 for r in got] == [True, True, False] and {r["other"] for r in got} == {5} and got[0] == got[1]
    assert bpe.encode(docs, BYTE).columns == ["doc_id", "text", "n_tokens", "other", "ids"]
