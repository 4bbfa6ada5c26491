"""Chat formatting, token files, tokenizers and classifiers."""

import itertools
import json
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from echolens.llm import bpe, chat_format, langid, library_ids, packed_ids, token_counts, toxicity

from . import brute
from .conftest import frame

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "a", "<|im_end|>", "\\", "\\l", "\\s<|", "|>x<", "<|im_start|>user\nhi", "é\n\n", "assistant", "\\n", "<", None]


# ---- 1. chat formatting

def test_turns_come_back(spark):
    r = np.random.default_rng(1)
    rows = [(c, t, r.choice(["user", "assistant", "sys\ntem", "a<|b", None]), ODD[r.integers(len(ODD))]) for c in range(60) for t in range(r.integers(1, 9))]
    rows += [(99, 1, "assistant", "tie b"), (99, 1, "assistant", "tie a"), (99, None, "user", "first"), (99, 1, "assistant", "tie a"), (None, 0, "user", "x"), (7, 0, "user", "w" * 200_000)]
    chats = frame(spark, rows, "conv_id bigint, turn bigint, role string, text string").withColumn("formatted", F.lit(1))
    got = {x["conv_id"]: x for x in chat_format.read_back(chat_format.formatted(chat_format.row_turns(chats))).collect()}
    key = lambda x: (x[1] is not None, x[1] or 0, (x[2] or "").encode(), (x[3] or "").encode())
    for conv in {x[0] for x in rows}:
        turns = [(x[2] or "", x[3] or "") for x in sorted((x for x in rows if x[0] == conv), key=key)]
        assert [(t["role"], t["text"]) for t in got[conv]["read_turns"]] == turns
        assert got[conv]["loss_text"] == "".join(t for role, t in turns if role == "assistant")
        assert sum(x["skip"] + x["take"] for x in got[conv]["runs"]) + 11 * len(turns) == len(got[conv]["formatted"])


def test_layouts_by_fingerprint(spark):
    records = [
        {"prompt": "p", "completion": "c"}, {"prompt": "p", "response": None}, {"instruction": "i", "input": "", "output": "o"}, {"output": "o", "instruction": "i"},
        {"messages": [{"role": "user", "content": "u"}, {"role": "assistant", "content": "a"}]}, {"conversations": [{"from": "human", "value": "u"}, {"from": "gpt", "value": "a"}]},
        {"prompt": "p", "completion": "c", "score": 1}, {"messages": []}, {"messages": "text"}, [], {},
    ]
    rows = [(i, json.dumps(x)) for i, x in enumerate(records)] + [(20, None), (21, "not json"), (22, "")]
    got = {r["id"]: (r["layout"], [(t["role"], t["text"]) for t in r["turns"]]) for r in chat_format.record_turns(frame(spark, rows, "id int, record string").withColumn("layout", F.lit("x"))).collect()}
    both = [("user", "u"), ("assistant", "a")]
    assert [got[i][0] for i in range(7)] == ["prompt_completion", "prompt_response", "instruction_input", "instruction", "messages", "conversations", None]
    assert got[0][1] == [("user", "p"), ("assistant", "c")] and got[1][1] == [("user", "p"), ("assistant", None)] and got[2][1] == [("user", "i"), ("assistant", "o")]
    assert got[4][1] == got[5][1] == both
    assert all(got[i] == (None, []) for i in (6, 7, 8, 9, 10, 20, 21, 22))


def test_fingerprints_cover_every_element_and_object(spark):
    u, a = {"role": "user", "content": "u"}, {"role": "assistant", "content": "a"}
    other = [
        {"messages": [u, {"from": "gpt", "value": "a"}]}, {"messages": [u, a | {"name": "n"}]}, {"messages": [u, "text"]}, {"messages": [u, ["text"]]},
        {"messages": [u, {"role": "assistant", "content": {"text": "a"}}]}, {"messages": [u, {"role": "assistant", "content": ["a"]}]},
        {"prompt": {"text": "p"}, "completion": "c"}, {"prompt": ["p"], "completion": "c"}, {"messages": {"role": "user", "content": "u"}}, {"messages": [[u, a]]},
        {"messages[].role": "user", "messages[].content": "u"}, {"prompt\nresponse": "p"}, {"messages": [u], "conversations": [{"from": "gpt", "value": "a"}]},
    ]
    same = [
        ({"messages": [u, a, {"role": "user", "content": None}, {"content": "late", "role": None}]}, "messages", ["u", "a", None, "late"]),
        ({"messages": [{"role": "user"}, {"content": '{"x": [1]}'}]}, "messages", [None, '{"x": [1]}']), ({"prompt": "[1, 2]", "completion": 5}, "prompt_completion", ["[1, 2]", "5"]),
    ]
    rows = [(i, json.dumps(x)) for i, x in enumerate([*other, *[x for x, _, _ in same]])]
    rows += [(90, '{"prompt": "p", "prompt": "q", "completion": "c"}'), (91, "{'prompt': 'p', 'completion': 'c'}"), (92, '{"prompt": "p", "completion": "c"'), (93, '{"prompt": "p\n", "completion": "c"}')]
    got = {r["id"]: (r["layout"], [t["text"] for t in r["turns"]]) for r in chat_format.record_turns(frame(spark, rows, "id int, record string")).collect()}
    assert [got[i] for i in range(len(other))] == [(None, [])] * len(other)
    assert [got[len(other) + i] for i in range(len(same))] == [(name, texts) for _, name, texts in same]
    assert got[91] == ("prompt_completion", ["p", "c"]) and got[90] == got[92] == got[93] == (None, [])


def test_chat_main_path_is_native_and_empty_tables_pass(spark):
    chats = frame(spark, [], "conv_id bigint, turn bigint, role string, text string")
    out = chat_format.read_back(chat_format.formatted(chat_format.row_turns(chats)))
    assert out.count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
    with pytest.raises(ValueError):
        chat_format.table_layout(frame(spark, [], "a int"))


# ---- 2. and 3. token files

def ids_of(text):
    t = Tokenizer.from_file(BYTE)
    return t.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=300), st.integers(0, 300), st.integers(0, 300))
def test_packing(bits, ids, a, b):
    ids = np.array(ids, np.uint32) & np.uint32((1 << bits) - 1)
    stored = packed_ids.pack(ids, bits)
    assert len(stored) == (len(ids) * bits + 63) // 64 * 8
    assert (packed_ids.unpack(stored, bits, len(ids)) == ids).all()
    low, high = sorted((min(a, len(ids)), min(b, len(ids))))
    assert (packed_ids.take(stored, bits, low, high) == ids[low:high]).all()


def test_width():
    assert [packed_ids.width(n) for n in (1, 2, 3, 256, 257, 50257, 65537)] == [1, 1, 2, 8, 9, 16, 17]


@pytest.mark.parametrize("block", [1 << 16, 50])
def test_packed_files(spark, odd, odd_rows, block, monkeypatch):
    monkeypatch.setattr(packed_ids, "BLOCK_IDS", block)
    blocks = packed_ids.write(odd, BYTE, end_id=2)
    got = packed_ids.read(blocks).join(packed_ids.places(blocks), ["shard", "block"]).withColumn("start", F.col("first") + F.col("offset"))
    got = got.select("key", "start", "n_tokens", "ids_crc32").orderBy("start").collect()
    encoded = sorted(((d, np.array(ids_of(t) + [2], "<u4")) for d, t in odd_rows), key=lambda x: (x[0] is not None, x[0] or 0))
    assert [r["key"] for r in got] == [d for d, _ in encoded]
    assert [r["start"] for r in got] == [0, *itertools.accumulate(len(x) for _, x in encoded)][:-1]
    assert sorted((str(r["key"]), r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((str(d), len(x), zlib.crc32(x.tobytes())) for d, x in encoded)


@pytest.mark.parametrize("block,stretch", [(1 << 18, 1024), (37, 3), (1, 5)])
def test_separator_scan(spark, block, stretch, monkeypatch):
    monkeypatch.setattr(token_counts, "STRETCH", stretch)
    r = np.random.default_rng(block)
    rows, want = [], []
    for file in range(4):
        ids = np.where(r.random(400) < [0.0, 0.02, 0.3, 1.0][file], 9, r.integers(0, 8, 400)).astype("<u2")
        rows += [(file, i, bytearray(ids[i * block : (i + 1) * block].tobytes())) for i in range(-(-400 // block))]
        ends = np.flatnonzero(ids == 9)
        starts = [0, *(ends + 1)]
        want += [(file, k, starts[k], e - starts[k], True) for k, e in enumerate(ends)]
        if starts[-1] < 400:
            want.append((file, len(ends), starts[-1], 400 - starts[-1], False))
    blocks = frame(spark, rows, "file int, block bigint, payload binary").repartition(5)
    got = token_counts.documents(token_counts.scan(blocks, 9, 2)).collect()
    assert sorted(tuple(x) for x in got) == sorted(want)


def test_token_counts_of_odd_documents(spark, odd, odd_rows, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK_IDS", 100)
    flat = token_counts.write_flat(odd, BYTE, token_counts.SEPARATOR)
    got = token_counts.documents(token_counts.scan(flat.filter("payload IS NOT NULL"), token_counts.SEPARATOR, 2))
    assert sorted(r["n_tokens"] for r in got.collect()) == sorted(len(ids_of(t)) for _, t in odd_rows)
    assert got.filter("NOT closed").count() == 0


# ---- 4. BPE

PIECES = st.lists(st.sampled_from(["a", "th", "ing", " ", "  ", "\n", "\n ", "\t", "\x1c", "\x85", "\xa0", "Σ", "İ", "é", "é", "中", "1", "²", "'s", "'", "!", "<|endoftext|>", "<|", "😀", "\x00"]), max_size=40).map("".join)
LIBRARY = {p: Tokenizer.from_file(p) for p in (WORD, BYTE)}


@settings(max_examples=150, deadline=None)
@given(PIECES)
def test_as_the_library_encodes_and_decodes(text):
    for path, library in LIBRARY.items():
        own = bpe.tokenizer(path)
        ids = library.encode(text, add_special_tokens=False).ids
        assert list(own.encode(text)) == ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)
    ids = LIBRARY[BYTE].encode(text, add_special_tokens=False).ids
    assert np.frombuffer(library_ids.encoder(BYTE)(text), "<u4").tolist() == ids


@settings(max_examples=80, deadline=None)
@given(st.text("abdeghinorst", max_size=900), st.integers(1, 40))
def test_streaming_with_a_bounded_buffer(text, chunk):
    for path in LIBRARY:
        merges = bpe.tokenizer(path).merges
        machine, out = bpe.Transducer(merges, chunk), []
        for i in range(0, len(text), 7):
            out += machine.push(text[i : i + 7])
            assert len(machine.buffer) <= merges.lookahead + merges.longest + chunk
        out += machine.close()
        whole = list(text)
        if whole:
            whole[-1] += merges.suffix
        assert out == merges.apply(whole)


def test_lookahead_of_a_chain():
    # b is taken by (b, c), c by (c, d), d by (d, e): each merge hangs on the next.
    merges = bpe.Merges([("d", "e"), ("c", "d"), ("b", "c"), ("a", "b")])
    assert merges.lookahead >= 4
    assert merges.apply(list("abcde")) == ["a", "bc", "de"] and merges.apply(list("abcd")) == ["ab", "cd"]


def test_decoding_by_bytes():
    own = bpe.tokenizer(BYTE)
    decoder = bpe.Decoder(own)
    ids = list(own.encode("😀é"))
    assert "".join([*map(decoder.push, ids), decoder.close()]) == "😀é"
    assert own.decode(ids[:1]) == LIBRARY[BYTE].decode(ids[:1], skip_special_tokens=False)


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_digests_in_short_stretches(path, monkeypatch):
    """Stretches, runs and the memory of words show in no digest: special strings, combining marks after a space, long words."""
    monkeypatch.setattr(bpe, "STRETCH", 7)
    monkeypatch.setattr(bpe, "CHUNK", 5)
    monkeypatch.setattr(bpe, "CACHE", 3)
    work, library = bpe.Digester(bpe.tokenizer(path)), LIBRARY[path]
    texts = [
        "", None, " ", "a", "The cat's 12 naps,  twice\n\ttoo \x1c end ", "e \u0301e\u0301 \u0301x 각 \u1100\u1161\u11a8", "<|endoftext|> x <|endoftext|><|startoftext|>y<|end",
        "word" * 60 + " short " + "naïve😀" * 40, "ΣΑΣ Σ ΟΔΟΣ", " ".join(brute.prose(s, 30) for s in range(4)), "a" * 700 + " " + "-" * 300,
    ]
    for text in texts + texts[::-1]:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert work(text) == (len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(decoded)), text
        one, many = bpe.Decoder(work.tok), bpe.Decoder(work.tok)
        pushed = [one.push(i) for i in ids]
        assert [many.run(ids[:3]), many.run(ids[3:]), many.close()] == ["".join(pushed[:3]), "".join(pushed[3:]), one.close()]


def test_the_digest_hangs_on_the_decoder(monkeypatch):
    monkeypatch.setattr(bpe.Decoder, "run", lambda self, ids: "x" * len(ids))
    assert bpe.Digester(bpe.tokenizer(WORD))("a cat")[2] == brute.sha("xx")


def test_forgotten_words_keep_their_ids(monkeypatch):
    monkeypatch.setattr(library_ids, "CACHE", 2)
    own = library_ids.LibraryEncoder(BYTE)
    texts = ["one two three two", "two four one", None, "", "five  six two", "one two three two"]
    for _ in range(3):
        for text, raw in zip(texts, own.many(texts)):
            assert np.frombuffer(raw, "<u4").tolist() == LIBRARY[BYTE].encode(text or "", add_special_tokens=False).ids


def test_ids_take_one_lookup_per_distinct_word_and_few_library_calls():
    class Counted(dict):
        asked = 0

        def __contains__(self, word):
            self.asked += 1
            return super().__contains__(word)

        def get(self, word, *more):
            self.asked += 1
            return super().get(word, *more)

    class Library:
        calls = 0

        def encode_batch_fast(self, texts, **more):
            self.calls += 1
            return LIBRARY[BYTE].encode_batch_fast(texts, **more)

    own = library_ids.LibraryEncoder(BYTE)
    own.library, own.known = Library(), Counted()
    texts = [f"{a} one two, three{n % 3}\nfour {b}" for n in range(200) for a, b in (("The", "end"), ("two,", "it's!"), ("a", "l'`x}~ _[] naïve, b2! <|x"))] + [None, "", "alone", "two  blanks"]
    assert [np.frombuffer(raw, "<u4").tolist() for raw in own.many(texts)] == [LIBRARY[BYTE].encode(t or "", add_special_tokens=False).ids for t in texts]
    assert own.known.asked <= 60 and own.library.calls <= 5


@pytest.mark.parametrize("cache,stretch", [(500_000, 1 << 16), (3, 20)])
def test_digests_of_many_texts_merge_each_piece_once(monkeypatch, cache, stretch):
    monkeypatch.setattr(bpe, "CACHE", cache)
    monkeypatch.setattr(bpe, "STRETCH", stretch)
    texts = [
        "", None, " ", "The cat's 12 naps,  twice\n\ttoo \x1c end ", "e \u0301e\u0301 \u0301x 각", "<|endoftext|> x<|end", "word" * 60 + " short naïve😀", "ΣΑΣ Σ ΟΔΟΣ",
        *[f"undandanhendes{mark} ertionhaat{mark}" for mark in ("", ",", ".", "!?", ",", ")")], "short " + "-" * 300, "x" * 64 + " " + "y" * 65,
    ]
    merged, apply = [], bpe.Merges.apply
    monkeypatch.setattr(bpe.Merges, "apply", lambda self, symbols: merged.append("".join(symbols)) or apply(self, symbols))
    got = bpe.Digester(bpe.tokenizer(WORD)).many(texts)
    if cache > 3:
        assert merged.count("undandanhendes</w>") == merged.count("ertionhaat</w>") == 1
    for text, found in zip(texts, got, strict=True):
        ids = LIBRARY[WORD].encode(text or "", add_special_tokens=False).ids
        assert found == (len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(LIBRARY[WORD].decode(ids, skip_special_tokens=False))), text


def test_bpe_of_odd_documents(spark, odd, odd_rows):
    want = []
    for d, t in odd_rows:
        ids = LIBRARY[WORD].encode(t or "", add_special_tokens=False).ids
        want.append((str(d), len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(LIBRARY[WORD].decode(ids, skip_special_tokens=False))))
    got = bpe.digests(odd, WORD)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got.collect()) == sorted(want)
    both = bpe.decode(bpe.encode(odd, WORD), WORD).collect()
    assert sorted((str(r["doc_id"]), len(r["ids"]), brute.sha(" ".join(map(str, r["ids"]))), brute.sha(r["decoded"])) for r in both) == sorted(want)


# ---- 5. and 6. classifiers

def labelled(spark, n=600):
    rows, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        text = brute.prose(i, 40)
        rows.append((i, text + (" Awful rotten swine" if bad else "")))
        labels.append((i, int(bad)))
    rows += [(9000, None), (9001, ""), (9002, brute.prose(1, 30_000)), (9003, "the awful rotten swine")]
    labels += [(0, None), (5, 0), (None, 1), (9999, 1)]
    return frame(spark, rows), frame(spark, labels, "doc_id bigint, toxic int")


def test_toxicity(spark, monkeypatch):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels.filter("doc_id < 400"))
    assert 0 < len(model.slots) < 5000
    got = {r["doc_id"]: r for r in toxicity.score(docs.withColumn("predicted", F.lit("x")), model).collect()}
    assert np.mean([got[i]["predicted"] == (i % 5 == 0) for i in range(400, 600)]) > 0.97
    assert got[9000]["score"] == got[9001]["score"] < 0.5 and got[9003]["predicted"] == 1
    weights = model.dense()
    for i in (3, 400, 9002, 9003):  # the plain sum over distinct features
        column = [docs.filter(f"doc_id = {i}").first()["text"]]
        slots = next(toxicity.text_features(__import__("pyarrow").array(column)))
        z = weights[slots].sum() + weights[toxicity.BIAS]
        assert got[i]["score"] == pytest.approx(1 / (1 + np.exp(-z)))


def test_toxicity_with_nothing_to_learn(spark, odd, odd_rows, none):
    model = toxicity.fit(odd, frame(spark, [], "doc_id bigint, toxic int"))
    assert {(r["score"], r["predicted"]) for r in toxicity.score(odd, model).collect()} == {(0.0, 0)}
    assert toxicity.score(none, model).count() == 0


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    found = langid.op6(spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id")
    good = found.filter("held_out").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0]
    assert good > 0.97
    assert found.filter("score < 0 OR score > 1").count() == 0


def test_language(spark, none):
    r = np.random.default_rng(2)
    word = lambda a: "".join(r.choice(list(a), 5))
    rows = [(i, " ".join(word("abcde" if i % 2 else "vwxyz") for _ in range(30)), "aa" if i % 2 else "zz") for i in range(200)]
    rows += [(300, None, "aa"), (301, "", "zz"), (302, "12 34 !?", "aa"), (303, "ABCDE", None), (304, "日本語" * 2000, None)]
    docs = frame(spark, rows, "doc_id bigint, text string, lang string").withColumn("rejected", F.lit(1))
    model = langid.fit(docs)
    got = {x["doc_id"]: x for x in langid.predict(docs, model).collect()}
    assert all(got[i]["lang_pred"] == ("aa" if i % 2 else "zz") and not got[i]["rejected"] for i in range(20))
    assert [(got[i]["lang_pred"], got[i]["score"]) for i in (300, 301, 302)] == [("und", 0.0)] * 3
    assert got[303]["lang_pred"] == "aa" and got[304]["rejected"]
    blank = langid.fit(docs.filter("false"))
    assert {x["lang_pred"] for x in langid.predict(docs, blank).collect()} == {"und"}
    assert langid.predict(none, model).count() == 0
