"""Plain Python twins of the operators, for small inputs, and the odd rows that every operator must take."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def closure(nodes, links) -> dict:
    low = {n: n for n in nodes}

    def find(n):
        while low[n] != n:
            n = low[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        low[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text: str | None) -> set:
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def groups(rows) -> dict:
    """doc_id to smallest doc_id reachable."""
    sets = [(d, shingles(t)) for d, t in rows if d is not None]
    links = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if x and y and 100 * len(x & y) >= 80 * len(x | y)]
    return closure({d for d, _ in sets}, links)


def removed(rows) -> list[set]:
    """Per row the byte positions to remove."""
    first: dict[bytes, int] = {}
    raw = [(d, (t or "").encode()) for d, t in rows]
    for d, b in raw:
        if d is not None:
            for p in range(len(b) - 49):
                first[b[p : p + 50]] = min(d, first.get(b[p : p + 50], d))
    out = []
    for d, b in raw:
        hit = set()
        if d is not None:
            for p in range(len(b) - 49):
                if first[b[p : p + 50]] < d:
                    hit.update(range(p, p + 50))
        out.append(hit)
    return out


def item_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))


def contaminated(text: str | None, items) -> tuple[int, int, list[str]]:
    """(words, hit words, sorted item ids) of a text."""
    w, hit, held = item_words(text), set(), set()
    for item, item_text in items:
        v = item_words(item_text)
        k = min(13, len(v))
        windows = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if k else set()
        for i in range(len(w) - k + 1 if k else 0):
            if tuple(w[i : i + k]) in windows:
                hit.update(range(i, i + k))
                held.add("" if item is None else str(item))
    return len(w), len(hit), sorted(held)


def vector_links(rows) -> tuple[dict, dict]:
    """Per row index its links; per vec_id its component."""
    ok = {}
    for i, (v, x) in enumerate(rows):
        if v is not None and x and all(c is not None and np.isfinite(c) for c in x) and any(x):
            ok[i] = np.array(x, float)
    links, edges = {i: 0 for i in range(len(rows))}, []
    for i, x in ok.items():
        for j, y in ok.items():
            if i != j and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.9:
                links[i] += 1
                edges.append((rows[i][0], rows[j][0]))
    return links, closure({v for v, _ in rows if v is not None}, edges)


def sha(text) -> str:
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdeéß") for _ in range(r.randint(2, 7))) for _ in range(words))


def near(text: str, seed: int, changes: int) -> str:
    r, w = random.Random(seed), text.split(" ")
    for _ in range(changes):
        w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
    return " ".join(w)


def documents() -> list[tuple]:
    """Copies of many kinds, shared passages, null and empty values, a very long text, a repeated row, periodic text."""
    base, passage = prose(1, 120), prose(2, 60)
    rows = [(0, base), (1, base), (2, near(base, 5, 2)), (3, near(base, 6, 4)), (4, near(base, 7, 9)), (5, prose(3, 300))]
    rows += [(6, None), (7, ""), (8, " \t\n"), (9, "one two three"), (10, "ONE two three"), (11, "one two"), (12, "a" * 400), (13, "b" + "a" * 300 + "c")]
    rows += [(14, prose(4, 40) + " " + passage), (15, passage + " " + prose(5, 200)), (16, prose(6, 30) + " " + passage + " " + prose(7, 30))]
    rows += [(17, prose(8, 9000)), (18, base[:200]), (5, prose(3, 300)), (None, base), (None, None), (19, "é" * 60), (20, "x" + "é" * 60), (21, "w" * 5000)]
    rows += [(30 + i, near(prose(9, 70), 100 + i, i % 4)) for i in range(40)]  # one large group of near copies
    rows += [(80 + i, prose(200 + i, 60 + i) + " " + passage) for i in range(30)]  # unrelated texts that share a passage
    return rows
