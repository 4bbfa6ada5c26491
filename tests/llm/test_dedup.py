"""Near copies, repeated passages, contamination and vectors against brute force."""

import numpy as np
import pytest

from echolens.llm import components, decontaminate, parity_join, suffix_dedup, vector_dedup

from . import brute
from .conftest import frame


def test_near_copies(odd, odd_rows):
    want = brute.groups(odd_rows)
    got = parity_join.similar_groups(odd).collect()
    assert len(got) == len(odd_rows)
    sizes = {(d, len(brute.shingles(t))) for d, t in odd_rows}
    assert {(r["doc"], r["n_shingles"]) for r in got} == sizes
    assert all(r["component"] == (None if r["doc"] is None else want[r["doc"]]) for r in got)
    assert len({c for c in want.values()}) < len(want) - 20  # the large groups are one each


def test_two_texts_under_one_id(spark):
    a, b = brute.prose(31, 80), brute.prose(32, 80)
    rows = [(5, a), (5, b), (1, brute.near(a, 1, 1)), (2, brute.near(b, 2, 1)), (9, brute.prose(33, 80))]
    got = {(r["doc"], r["component"]) for r in parity_join.similar_groups(frame(spark, rows)).collect()}
    assert got == {(5, 1), (1, 1), (2, 1), (9, 9)} == {(d, brute.groups(rows)[d]) for d, _ in rows}


def test_frequent_shingles_come_last_and_change_nothing(odd, odd_rows, monkeypatch):
    monkeypatch.setattr(parity_join, "common_cells", lambda texts: np.arange(1 << parity_join.CELL_BITS) % 3 == 0)
    want = brute.groups(odd_rows)
    assert all(r["component"] == want[r["doc"]] for r in parity_join.similar_groups(odd).collect() if r["doc"] is not None)


@pytest.mark.parametrize("n", [1, 3, 4, 5, 40, 63, 64, 70, 127, 128, 1000])
def test_every_similar_pair_shares_a_key(n):
    r = np.random.default_rng(n)
    common = r.random(1 << parity_join.CELL_BITS) < 0.3
    for _ in range(60):
        core = r.integers(0, 2**63, n, dtype=np.uint64)
        cut, more = r.integers(0, n // 9 + 1), r.integers(0, n // 9 + 1)
        a, b = np.unique(core), np.unique(np.concatenate([core[cut:], r.integers(0, 2**63, more, dtype=np.uint64)]))
        if parity_join.linked(a, b):
            assert set(parity_join.join_keys(a, common)) & set(parity_join.join_keys(b, common))


def test_keys_of_the_same_sets_are_one_key_and_no_pair_is_lost(spark):
    r = np.random.default_rng(5)
    sets = [frozenset(r.choice(40, size, replace=False).tolist()) for size in (2, 2, 3, 7, 7, 20)]
    of = {key: sets[key % 6] for key in range(300)}
    rows = [(k, c) for k, members in of.items() for c in members for _ in range(1 + (k + c) % 3)]  # some sent by several tasks
    got = parity_join.merged_keys(frame(spark, rows, "key bigint, class bigint").repartition(7)).collect()
    found = {}
    for row in got:
        found.setdefault((row["key"], row["keys"]), []).append(row["class"])
    want = {}
    for members in of.values():
        want[members] = want.get(members, 0) + 1
    assert {(frozenset(c), n) for (_, n), c in found.items()} == set(want.items())
    assert len(got) == sum(map(len, want))


def test_parity_bits_tell_large_sets_apart_and_lose_no_link(spark):
    r = np.random.default_rng(8)
    rows, links = [], []
    for n in (5, 300, 1900, 2048, 2049, 4000, 4096, 4097, 6000, 20_000):
        core, other = (np.unique(r.integers(0, 2**63, n, dtype=np.uint64)) for _ in range(2))
        for cut in (0, n // 10, n // 6, n // 2):
            for x, y in ((core, core[cut:]), (core, np.unique(np.concatenate([core[: n // 3], other[: n - n // 3]]))), (core, np.unique(np.concatenate([core, other[: n // 5]])))):
                sides = [(len(s), len(s), parity_join.parity_bits(s).tolist()) for s in (x, y)]
                rows.append((len(links), *sides, *sides[::-1]))
                links.append(parity_join.linked(x, y))
    kind = "struct<n: int, least: int, bits: array<bigint>>"
    pairs = frame(spark, rows, f"i int, x {kind}, y {kind}, u {kind}, v {kind}")
    got = {p["i"]: (p["there"], p["back"]) for p in pairs.select("i", parity_join.may_link("x", "y").alias("there"), parity_join.may_link("u", "v").alias("back")).collect()}
    assert all(got[i] == (True, True) for i, link in enumerate(links) if link) and sum(links) > 30
    apart = [i for i, (_, x, y, *_) in enumerate(rows) if x[0] >= 300 and not links[i] and 4 * abs(x[0] - y[0]) <= x[0] and i % 3 == 1]
    assert apart and all(got[i] == (False, False) for i in apart)  # a third in common


def test_components_of_a_long_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(100, 180)] + [(1000, i) for i in range(1001, 1100)] + [(7, 7)]
    got = {r["id"]: r["component"] for r in components.components(frame(spark, edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 100 for i in range(100, 181)}, **{i: 1000 for i in range(1000, 1100)}}


@pytest.mark.parametrize("run", [16 << 20, 4000])
def test_repeated_passages(odd, odd_rows, run, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "RUN", run)
    monkeypatch.setattr(suffix_dedup, "PART", 20_000)
    monkeypatch.setattr(suffix_dedup, "SHARE", 20_000)
    want = sorted((str(d), t or "", "".join(map(str, sorted(hit)))) for (d, t), hit in zip(odd_rows, brute.removed(odd_rows)))
    got = suffix_dedup.deduplicated(odd)
    assert "score" in got.columns and "n_words" in got.columns
    found = []
    for r in got.collect():
        raw, hit = (r["text"] or "").encode(), {p for s in r["removed"] for p in range(s["start"], s["stop"])}
        assert bytes(r["kept"]) == bytes(c for p, c in enumerate(raw) if p not in hit)
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (len(raw), len(hit), sum(p - 1 not in hit for p in hit))
        found.append((str(r["doc_id"]), r["text"] or "", "".join(map(str, sorted(hit)))))
    assert sorted(found) == want and any(h for _, _, h in want)


def test_loser_tree_sorts_and_knows_common_prefixes():
    r = np.random.default_rng(3)
    runs = []
    for size in (0, 1, 40, 300, 7):
        x = object.__new__(suffix_dedup.Run)
        texts = sorted(bytes(r.choice([0, 97, 98], suffix_dedup.LENGTH).astype(np.uint8)) if r.random() < 0.5 else b"ab" * 25 for _ in range(size))
        x.numbers = [int.from_bytes(t) for t in texts]
        x.shared = [0, *[len([1 for k in range(50) if a[: k + 1] == b[: k + 1]]) for a, b in zip(texts, texts[1:])]][:size]
        runs.append(x)
    for fan_in in (256, 2):
        suffix_dedup.FAN_IN = fan_in
        run, place, common = suffix_dedup.merged(runs)
        out = [runs[i].numbers[j].to_bytes(50) for i, j in zip(run, place)]
        assert out == sorted(n.to_bytes(50) for x in runs for n in x.numbers)
        assert all(c == len([1 for k in range(50) if a[: k + 1] == b[: k + 1]]) for a, b, c in zip(out, out[1:], common[1:]))
    suffix_dedup.FAN_IN = 256


def items():
    text = brute.documents()[5][1]
    words = text.split(" ")
    return [(1, " ".join(words[20:45])), (2, " ".join(words[40:60]).upper()), (10, "two three"), (None, "one"), (3, None), (4, ""), (5, ".,;"),
            (1, " ".join(words[20:45])), (6, " ".join(words[100:113])), (7, brute.prose(77, 30))]


@pytest.mark.parametrize("patterns", [100_000, 7])
def test_contamination(spark, odd, odd_rows, patterns):
    bench = frame(spark, items(), "item_id bigint, text string")
    found = decontaminate.contamination(odd, bench, patterns=patterns).collect()
    got = sorted((str(r["doc_id"]), r["text"] or "", r["n_words"], r["n_hit"], tuple(r["item_ids"]), r["contaminated"]) for r in found)
    want = []
    for d, t in odd_rows:
        n, hit, ids = brute.contaminated(t, items())
        want.append((str(d), t or "", n, hit, tuple(ids), hit > 0 and 20 * hit >= n))
    assert got == sorted(want)
    assert all(sum(s["stop"] - s["start"] for s in r["hit_spans"]) == r["n_hit"] for r in found)


def test_contamination_without_items(spark, odd, odd_rows):
    found = decontaminate.contamination(odd, frame(spark, [], "item_id bigint, text string"))
    assert found.filter("n_hit > 0 OR contaminated").count() == 0 and found.count() == len(odd_rows)


def vectors(count=400, dim=16, seed=5):
    r = np.random.default_rng(seed)
    base = r.normal(size=(count // 4, dim))
    rows = [(i, (base[i % len(base)] + r.normal(size=dim) * r.choice([0.05, 0.2, 0.4])).tolist()) for i in range(count)]
    rows += [(1000 + i, rows[0][1]) for i in range(30)] + [(2000, [2 * c for c in rows[0][1]])]
    rows += [(3000, None), (3001, []), (3002, [0.0] * dim), (3003, [None] + [1.0] * (dim - 1)), (3004, [float("nan")] * dim), (3005, [float("inf")] * dim)]
    return rows + [(3006, [1.0, 2.0]), (3007, [1.0, 2.1]), (0, rows[0][1]), (None, rows[0][1]), (3008, [-0.0, 1.0]), (3009, [0.0, 1.0])]


@pytest.mark.parametrize("cell,rows", [(2048, 1024), (40, 16)])
def test_vectors(spark, cell, rows, monkeypatch):
    monkeypatch.setattr(vector_dedup, "CELL", cell)
    monkeypatch.setattr(vector_dedup, "ROWS", rows)
    monkeypatch.setattr(vector_dedup, "MEMBERS", 2 * rows)
    monkeypatch.setattr(vector_dedup, "STEP", 7)
    data = vectors()
    links, group = brute.vector_links(data)
    exact = vector_dedup.near_duplicates(frame(spark, data, "vec_id bigint, embedding array<double>"), margin=float(np.sin(np.arccos(0.9))))
    got = exact.collect()
    assert len(got) == len(data)
    want = sorted((str(v), links[i], str(group.get(v)), v is None or group[v] == v) for i, (v, _) in enumerate(data))
    assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in got) == want


@pytest.mark.parametrize("dim,rows", [(2, 16), (3, 4096)])
def test_default_margin_misses_no_link_across_borders(spark, dim, rows, monkeypatch):
    """Many cells on rings, arcs and clumps: links that are spread across borders by up to the angle of the threshold."""
    monkeypatch.setattr(vector_dedup, "CELL", 15)
    monkeypatch.setattr(vector_dedup, "ROWS", rows)
    monkeypatch.setattr(vector_dedup, "MEMBERS", 2 * rows)
    r = np.random.default_rng(dim)
    turn = np.concatenate([r.uniform(0, 6.28, 120), 0.44 * np.arange(14), r.normal(1, 0.02, 60)])
    x = np.stack([np.cos(turn), np.sin(turn)], axis=1)
    if dim == 3:
        x = np.concatenate([np.column_stack([x, r.normal(0, 0.1, len(x))]), r.normal(size=(60, 3))])
    data = [(i, (v * r.uniform(0.5, 2)).tolist()) for i, v in enumerate(x)] + [(900 + i, x[i].tolist()) for i in range(8)]
    links, group = brute.vector_links(data)
    got = vector_dedup.near_duplicates(frame(spark, data, "vec_id bigint, embedding array<double>"))
    assert sorted((g["vec_id"], g["n_links"], g["component_id"]) for g in got.collect()) == [(v, links[i], group[v]) for i, (v, _) in enumerate(data)]


def test_recall_of_the_default_margin(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "CELL", 40)
    data = vectors(800, 64, 9)
    links, _ = brute.vector_links(data)
    got = vector_dedup.near_duplicates(frame(spark, data, "vec_id bigint, embedding array<double>"))
    found = got.agg({"n_links": "sum"}).first()[0]
    assert 0.99 * sum(links.values()) <= found <= sum(links.values())


def test_empty_tables(spark, none):
    assert parity_join.similar_groups(none).count() == 0
    assert suffix_dedup.deduplicated(none).count() == 0
    assert vector_dedup.near_duplicates(frame(spark, [], "vec_id bigint, embedding array<float>")).count() == 0
    assert decontaminate.contamination(none, frame(spark, items(), "item_id bigint, text string")).count() == 0


def test_runs_are_decoded_in_slices_of_little_memory():
    import tracemalloc

    n, size, rng = 50_000, suffix_dedup.LENGTH, np.random.default_rng(1)
    flat = rng.choice(np.frombuffer(b"ab", "u1"), (n, size)).tobytes()
    texts = sorted(flat[i * size : i * size + int(k)] for i, k in enumerate(rng.integers(24, size + 1, n)))
    common = [0, *(next((i for i, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y))) for x, y in zip(texts, texts[1:]))]
    row = {"run": 1, "common": bytes(common), "sizes": bytes(map(len, texts)), "tails": b"".join(t[c:] for t, c in zip(texts, common)), "left_sizes": bytes(n),
           "lefts": b"", "docs": np.zeros(n, "<i8").tobytes(), "records": np.arange(n, dtype="<u4").tobytes()}
    tracemalloc.start()
    run = suffix_dedup.Run(row)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [run.text[i].tobytes() for i in range(0, n, 7)] == [texts[i].ljust(size, b"\0") for i in range(0, n, 7)]
    assert peak < 33 << 20
