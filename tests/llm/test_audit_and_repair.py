"""Filter audit, quality classifier and conversation repair."""

import hashlib
import random
import re
import zlib
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from echolens.llm import conversation_repair as cr, filter_audit, quality

from . import brute
from .conftest import frame

# ---- 11. filter audit


def mask_of(doc, text, rows):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    copies = [d for d, t in rows if d is not None and (t or "") == text]
    fails = [
        len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search(r"[#$%&*|]", text)),
        doc is not None and any(d < doc for d in copies),
    ]
    return {"ABCDE"[i] for i in range(5) if fails[i]}


def plain_audit(docs, labels):
    """Filters applied one after the other, for every order."""
    rows = [(d, t) for d, t, _ in docs]
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    per_part = {}
    for d, t, part in docs:
        per_part.setdefault(part or "", []).append((d, mask_of(d, t, rows)))
    out = {}
    for part, members in per_part.items():
        total = dict.fromkeys("ABCDE", 0)
        steps = {}
        for order in permutations("ABCDE"):
            left = members
            for step, f in enumerate(order, 1):
                gone = [m for m in left if f in m[1]]
                left = [m for m in left if f not in m[1]]
                total[f] += len(gone)
                failing = sum(f in m[1] for m in members)
                steps["".join(order), step] = (
                    f, len(left), len(gone), failing - len(gone), sum(m[1] == {f} for m in members), sum(m[0] in good for m in gone), sum(m[0] in toxic for m in gone))
        for (order, step), (f, *values) in steps.items():
            out[part, order, step] = (*values, total[f])
    return out


def audit_rows(df):
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in names) for r in df.collect()}


def audit_documents():
    r = random.Random(3)
    texts = [t for _, t in brute.documents() if t is None or len(t) < 4000]
    texts += ["SHOUT " * 60, "a$ " * 80, " ".join(f"w{i}" for i in range(50)), "A" + "a" * 19, "A" + "a" * 18, "Word word " * 30 + "#", "É" * 40, "x\x0by\x0cz" * 20, "\x00" * 50]
    rows = [(i, t, r.choice(["s1", "s2", "", None])) for i, t in enumerate(texts)]
    rows += [(3, texts[3], "s1"), (3, texts[5], "s2"), (None, texts[0], "s1"), (None, None, None), (500, "", "s1"), (501, None, "s3"), (502, "", None)]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 90, 2)] + [(3, 1, 0), (3, 0, 1), (3, 0, 0), (None, 1, 1), (9999, 1, 1)]
    return rows, labels


def test_audit_equals_filtering_in_every_order(spark):
    rows, labels = audit_documents()
    docs = spark.createDataFrame([(*x, 1, "z") for x in rows], "doc_id bigint, text string, source string, mask int, n string").repartition(5)
    known = spark.createDataFrame([(*x, 7) for x in labels], "doc_id bigint, quality int, toxic int, part int")
    got = filter_audit.audit(docs, known)
    assert len(got.columns) == 10
    assert audit_rows(got) == plain_audit(rows, labels)


def test_audit_of_empty_tables(spark):
    docs, labels = frame(spark, [], "doc_id bigint, text string, source string"), frame(spark, [], "doc_id bigint, quality int, toxic int")
    assert filter_audit.audit(docs, labels).count() == 0
    one = frame(spark, [(1, None, None)], "doc_id bigint, text string, source string")
    got = audit_rows(filter_audit.audit(one, labels))
    assert got == plain_audit([(1, None, None)], []) and len(got) == 600


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.lists(st.tuples(st.integers(0, 31), st.integers(0, 9), st.integers(0, 9)), max_size=40))
def test_gray_walk_visits_every_subset(filters, found):
    masks = np.array([m & ((1 << filters) - 1) for m, _, _ in found], np.int64)
    counts = np.array([c for _, *c in found], np.int64).reshape(len(found), 2)
    states = filter_audit.gray_walk(masks, counts, filters)
    for subset in range(1 << filters):
        assert (states[subset] == counts[(masks & subset) == 0].sum(axis=0)).all()


def test_audit_counts_copies_before_the_shuffle(spark):
    """A text shared by all rows moves as one row per task and label, not as one per document."""
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"), F.lit("s").alias("source"))
    cells = {r["mask"]: r["n"] for r in filter_audit.cells(docs, frame(spark, [], "doc_id bigint, quality int, toxic int")).collect()}
    assert cells == {1: 1, 17: 4999}


# ---- 12. quality classifier

def plain_figures(text):
    """Some of the figures, by the letter."""
    raw = (text or "").encode()
    low = re.sub(rb"[A-Z]", lambda m: m.group().lower(), raw)
    w = re.findall(rb"[^\x20\x09-\x0D]+", low)
    lines = re.findall(rb"[^\n]+", low)
    pairs = list(zip(w, w[1:]))
    part = lambda a, b: a / b if b else 0.0
    return {
        "log_length": np.log1p(len(raw)), "upper_share": part(len(re.findall(rb"[A-Z]", raw)), len(raw)), "digit_share": part(len(re.findall(rb"[0-9]", raw)), len(raw)),
        "newline_share": part(raw.count(b"\n"), len(raw)), "trail_share": part(sum(0x80 <= x < 0xC0 for x in raw), len(raw)), "log_words": np.log1p(len(w)),
        "word_length": part(sum(map(len, w)), len(w)), "long_words": part(sum(len(x) > 12 for x in w), len(w)), "distinct_words": part(len(set(w)), len(w)),
        "distinct_pairs": part(len(set(pairs)), len(pairs)), "top_word": part(max((w.count(x) for x in set(w)), default=0), len(w)), "log_lines": np.log1p(len(lines)),
        "line_length": np.log1p(part(len(raw), len(lines))), "distinct_lines": part(len(set(lines)), len(lines)), "exclaims_per_word": part(len(re.findall(rb"[!?]", raw)), len(w)),
    }


def test_figures(odd_rows):
    import pyarrow as pa

    texts = [t for _, t in odd_rows if t is None or len(t) < 5000] + ["A1! b?\n\nA1! b?\n", "\n", "a b a b a b", "DÉJÀ vu"]
    got = np.concatenate(list(quality.figures(pa.array(texts))))
    for row, text in zip(got, texts):
        for name, value in plain_figures(text).items():
            assert row[quality.FEATURES.index(name)] == pytest.approx(value), (name, text)


def plain_tree(g, h, leaves):
    """Best-first tree by trying every cut of every leaf with sums made anew."""
    gain = lambda a, b: sum(g[a:b]) ** 2 / (sum(h[a:b]) + quality.DAMP)
    parts = [(0, len(g))]
    while len(parts) < leaves:
        options = [
            (gain(a, c) + gain(c, b) - gain(a, b), -i, -c) for i, (a, b) in enumerate(parts) for c in range(a + 1, b)
            if sum(h[a:c]) >= quality.LEAST and sum(h[c:b]) >= quality.LEAST]
        if not options or max(options)[0] <= 1e-12:
            break
        _, i, c = max(options)
        a, b = parts[-i]
        parts[-i : -i + 1] = [(a, -c), (-c, b)]
    return [-sum(g[a:b]) / (sum(h[a:b]) + quality.DAMP) for a, b in parts for _ in range(a, b)]


def plain_cells(g, h):
    best = (-1, None)
    for a in range(1, len(g)):
        for b in range(1, len(g[0])):
            gain, value = 0.0, np.zeros(np.shape(g))
            for rows in (slice(0, a), slice(a, None)):
                for columns in (slice(0, b), slice(b, None)):
                    sg, sh = np.sum(g[rows, columns]), np.sum(h[rows, columns])
                    gain += sg**2 / (sh + quality.DAMP)
                    value[rows, columns] = -sg / (sh + quality.DAMP)
            if gain > best[0] + 1e-12:
                best = (gain, value)
    return best


def test_trees_against_trying_every_cut():
    r = np.random.default_rng(4)
    for n in (1, 2, 5, 12):
        g, h = r.normal(0, 6, n), r.uniform(1, 9, n)
        assert quality.shallow_tree(g, h, 3) == pytest.approx(plain_tree(g, h, 3))
    g, h = r.normal(0, 6, (5, 4)), r.uniform(1, 9, (5, 4))
    gain, value = quality.four_cells(g, h)
    plain = plain_cells(g, h)
    assert value == pytest.approx(plain[1]) and gain == pytest.approx(plain[0] - g.sum() ** 2 / (h.sum() + quality.DAMP))


def test_boosting_against_plain_loops():
    """Cyclic rounds with the sums of every visit made row by row."""
    r = np.random.default_rng(5)
    x = r.normal(size=(300, 3)).round(1)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.2)).astype(float)
    model = quality.boosted(x, y, rounds=4, pair_rounds=3, n_pairs=1)
    assert [p[:2] for p in model.pairs] == [(0, 1)]  # the pair that matters
    share = (y.sum() + 0.5) / 301
    total = np.full(300, np.log(share / (1 - share)))

    def sums(keys, size):
        g, h = np.zeros(size), np.zeros(size)
        for i, key in enumerate(keys):
            p = 1 / (1 + np.exp(-total[i]))
            g[key] += p - y[i]
            h[key] += p * (1 - p)
        return g, h

    for _ in range(4):
        for f in range(3):
            at = [sum(v >= e for e in model.edges[f]) for v in x[:, f]]
            step = plain_tree(*sums(at, len(model.edges[f]) + 1), quality.LEAVES)
            total += quality.RATE * np.array([step[k] for k in at])
    for _ in range(3):
        at = [tuple(sum(x[i, f] >= e for e in model.coarse[f]) for f in (0, 1)) for i in range(300)]
        step = plain_cells(*sums(at, tuple(len(model.coarse[f]) + 1 for f in (0, 1))))[1]
        total += quality.RATE * np.array([step[k] for k in at])
    assert model.scores(x) == pytest.approx(1 / (1 + np.exp(-total)))
    again = quality.Model.from_json(model.to_json())
    assert (again.scores(x) == model.scores(x)).all()


def good_and_bad(n):
    return [(i, brute.prose(i, 80) + ".") if i % 3 else (i, " ".join(w.upper() + "!!" for w in brute.prose(i, 60).split())) for i in range(n)]


def test_quality_of_held_out_rows_and_odd_ones(spark, odd, odd_rows):
    rows = good_and_bad(900)
    docs = frame(spark, rows).withColumn("Score", F.lit("x")).withColumn("predicted", F.lit("y"))
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(600)] + [(5, 0, 1), (7, None, 0), (None, 1, 1), (10**6, 1, 0)], "doc_id bigint, quality int, toxic int")
    model = quality.fit(docs, labels)
    out = quality.score(docs, model)
    assert sorted(out.columns) == ["doc_id", "predicted", "score", "text"]
    found = {r["doc_id"]: r for r in out.collect()}
    assert all(found[i]["predicted"] == int(i % 3 > 0) for i in range(600, 900))
    assert all(0 <= r["score"] <= 1 for r in found.values())
    strange = quality.score(odd, model).collect()
    assert len(strange) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in strange)
    same = {r["score"] for r in strange if not r["text"]}
    assert len(same) == 1


def test_quality_without_labels_rows_or_variety(spark, none):
    docs, no = frame(spark, good_and_bad(6)), frame(spark, [], "doc_id bigint, quality int")
    assert [r["score"] for r in quality.score(docs, quality.fit(docs, no)).collect()] == [0.5] * 6
    model = quality.fit(docs, frame(spark, [(i, 1) for i in range(6)], "doc_id bigint, quality int"))
    assert len({round(r["score"], 12) for r in quality.score(docs, model).collect()}) == 1
    assert quality.score(none, model).count() == 0
    assert quality.fit(none, frame(spark, [(1, 1)], "doc_id bigint, quality int")) is None


def test_quality_query(spark):
    folder = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in quality.op12(spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert set(got) == {r["doc_id"] for r in docs}
    assert all(got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d in got)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    out = [(got[d]["predicted"], q) for d, q in labels.items() if got[d]["held_out"]]
    assert sum(p == q for p, q in out) >= 0.95 * len(out)
    assert all(p == 1 for p, q in out if q == 1)


def test_bounded_sample_takes_each_key_once(spark):
    rows = good_and_bad(60)
    docs = frame(spark, rows * 4)
    labels = frame(spark, [(i, int(i % 3 > 0)) for i in range(60)], "doc_id bigint, quality int")
    a, b = quality.fit(docs, labels), quality.fit(frame(spark, rows), labels)
    assert a.to_json() == b.to_json()
    assert quality.fit(docs, labels, max_rows=10).to_json() != a.to_json()


# ---- 13. conversation repair

def plain_repair(rows):
    """Best (cost, audit, text) of every state, one row after the other."""
    seen, faulty, counts = set(), [], [0, 0, 0]
    for _, role, text in rows:
        last = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)[-1:]
        fault = 0 if not last else 1 if (role, text) in seen else 2 if last not in ".!?" else None
        seen.add((role, text))
        faulty.append(fault)
        if fault is not None:
            counts[fault] += 1
    states = {"": (0, "", ())}  # by what the initials end with: "", s, u, a

    def better(table, key, option):
        if key not in table or option < table[key]:
            table[key] = option

    def inserted(states):
        out = dict(states)
        for _ in range(4):
            for key, (cost, audit, lines) in list(out.items()):
                role = "assistant" if key == "u" else "user"
                better(out, role[0], (cost + 3, audit + "I", (*lines, f"{role}:")))
        return out

    for (_, role, text), fault in zip(rows, faulty):
        after = {}
        for key, (cost, audit, lines) in inserted(states).items():
            better(after, key, (cost + 4, audit + "D", lines))
            if fault in (0, 1):
                continue
            extra = 3 if fault == 2 else 0
            need = "assistant" if key == "u" else "user"
            if role[:1] == need[0] or (key == "" and role[:1] == "s"):
                better(after, role[0], (cost + extra, audit + "K", (*lines, f"{role}:{text}")))
            better(after, need[0], (cost + 3 + extra, audit + "R", (*lines, f"{need}:{text}")))
        states = after
    cost, audit, lines = min(v for k, v in inserted(states).items() if k in ("", "a"))
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    turns = {r[0] for r in rows if r[0] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, *counts, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
ROLES = ["user", "assistant", "system", "tool", "", "s", "umpire", " "]
TEXTS = ["", " \n", "Yes.", "No!  ", "open", " ", "?", "x.\t", "Well", "é.", "."]


def found_rows(df):
    return {r["conv_id"]: tuple(r[n] for n in NAMES) for r in df.collect()}


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def random_chat(r, n, texts=TEXTS):
    return [(None if r.random() < 0.05 else r.randrange(-2, n + 3), r.choice(ROLES[: r.choice([2, 3, 8])]), r.choice(texts) + (str(r.randrange(4)) + "." if r.random() < 0.6 else "")) for _ in range(n)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(ROLES), st.sampled_from(TEXTS)), max_size=14))
def test_plan_against_best_of_every_state(rows):
    rows = [(i, a, b) for i, (a, b) in enumerate(rows)]
    symbols, counts = cr.faults(rows)
    cost, audit = cr.plan(symbols)
    lines = cr.repaired(rows, audit)
    want = plain_repair(rows)
    assert (0, *counts, cr.illegal([r[1][:1] for r in rows]), cost, audit) == (0, *want[1:7])
    assert hashlib.sha256("\n".join(lines).encode()).hexdigest() == want[7]
    assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines if x[0] != ":"))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 8), st.integers(1, 70)), min_size=1, max_size=5))
def test_powers_equal_single_steps(found):
    symbols = b"".join(bytes([s]) * n for s, n in found)
    one = np.where(np.eye(4, dtype=bool), 0, cr.NEVER)
    for s in symbols:
        one = cr.min_plus(one, cr.power(s, 0))
    assert (cr.segment_matrix(symbols) == one).all()
    assert (cr.before_all(symbols, cr.ENDING) == (one + cr.ENDING).min(axis=1)).all()


@pytest.mark.parametrize("size,span", [(256, 4096), (4, 4096), (5, 7)])
def test_conversations_of_one_and_of_many_segments(spark, size, span, monkeypatch):
    monkeypatch.setattr(cr, "SEGMENT", size)
    monkeypatch.setattr(cr, "TURN_SPAN", span)
    r = random.Random(size + span)
    chats = {c: random_chat(r, r.choice([1, 2, 3, 7, 12, 40])) for c in range(60)}
    chats[None] = random_chat(r, 30)
    chats[100] = [(t, "assistant", f"same {t}") for t in range(50)]  # one long run
    chats[101] = [(t, "user", "again.") for t in range(40)]  # duplicates across segments
    chats[102] = [(None, "user", f"t{i % 9}.") for i in range(30)]
    rows = [(c, *x) for c, chat in chats.items() for x in chat]
    monkeypatch.setattr(cr.segments, "__defaults__", (size,))
    got = found_rows(cr.repair(frame(spark, rows, "conv_id bigint, turn bigint, role string, text string").repartition(6)))
    assert got == {c: plain_repair(in_order(chat)) for c, chat in chats.items()}


def plain_damage(rows):
    out = []
    name = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fate = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        if fate:
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            out += [(conv, turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return out


def test_damage_and_repair_of_a_table(spark, tmp_path):
    r = random.Random(9)
    rows = [(c, t, r.choice(["user", "assistant", "system", None]), r.choice([*TEXTS, None])) for c in range(80) for t in range(r.randrange(1, 9))]
    rows += [(None, 1, "user", "x"), (None, None, None, None), (300, 0, "user", "z" * 300_000 + "."), (300, 1, "assistant", "y."), (300, 1, "assistant", "y.")]
    dropped = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((dropped, 0, "user", "gone."))
    frame(spark, [(*x, 1) for x in rows], "conv_id bigint, turn bigint, role string, text string, cost int").write.parquet(f"{tmp_path}/conversations.parquet")
    got = found_rows(cr.op13(spark, str(tmp_path)))
    want = {}
    for c in {x[0] for x in rows}:
        want[c] = plain_repair(in_order([x[1:] for x in plain_damage(rows) if x[0] == c]))
    assert got == want
    assert got[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_no_conversations(spark):
    none = frame(spark, [], "conv_id bigint, turn bigint, role string, text string")
    assert cr.repair(none).count() == 0
