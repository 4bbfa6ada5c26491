"""Dictionaries as literal tables inside an expression: whatever their size, a look-up costs the same.

**Words in a text.** The words are one regular expression, their prefix tree: at each place of the text it walks down the tree and
yields the longest word that starts there. Shorter words at that place are prefixes of it and stand beside it in a table.
The work per text grows with its length and the words it holds, not with the dictionary.

**Keys.** A key is filed under its checksum; an equal key is picked within the bucket.

Both are projections of Spark's own expressions: no join, no shuffle, no Python per row.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterable

from pyspark.sql import Column, functions as F

WIDTHS = (1, 2, 3)
FEW = 4  # words per gram up to which a shorter gram is preferred


def _buckets(n: int) -> int:
    size = 4
    while size < 2 * n:
        size *= 2
    return size


def _place(key: str, size: int) -> int:
    return zlib.crc32(key.encode()) % size


def _place_of(key: Column, size: int) -> Column:
    return (F.crc32(key.cast("binary")) % size).cast("int") + 1


def _table(rows: list[list[dict]], kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(rows, ensure_ascii=False)), f"array<array<{kind}>>")


def grams(word: str, width: int) -> set[str]:
    return {word[i : i + width] for i in range(len(word) - width + 1)}


def filed(words: Iterable[str]) -> dict[str, list[str]]:
    """Gram to the words filed under it."""
    out: dict[str, list[str]] = {}
    load = lambda g: len(out.get(g, ()))
    for word in words:
        chosen = None
        for width in WIDTHS[: len(word)]:
            chosen = min(sorted(grams(word, width)), key=load)
            if load(chosen) < FEW:
                break
        out.setdefault(chosen, []).append(word)
    return out


END = ""  # marks a node of the prefix tree where a word ends
FORK = 6  # branches tried one by one; more are halved by a range test first


def prefix_tree(words: Iterable[str]) -> dict:
    tree: dict = {}
    for word in words:
        node = tree
        for c in word:
            node = node.setdefault(c, {})
        node[END] = {}
    return tree


def _quoted(c: str) -> str:
    return c if c.isalnum() or ord(c) > 0x7F and c.isprintable() else f"\\x{{{ord(c):x}}}"


def expression(node: dict) -> str:
    """Regular expression of the longest word below a node."""
    run = ""
    while len(node) == 1 and END not in node:
        c, node = next(iter(node.items()))
        run += _quoted(c)

    def fork(chars: list[str]) -> str:
        if len(chars) <= FORK:
            return "|".join(_quoted(c) + expression(node[c]) for c in chars)
        low, high = chars[: len(chars) // 2], chars[len(chars) // 2 :]
        return f"(?=[{_quoted(low[0])}-{_quoted(low[-1])}])(?:{fork(low)})|{fork(high)}"

    chars = sorted(c for c in node if c != END)
    return run + (f"(?:{fork(chars)})" + "?" * (END in node) if chars else "")


class WordIndex:
    """Words with a payload each; ``kind`` is the payload's Spark type."""

    def __init__(self, words: dict[str, object], kind: str):
        number = {w: i for i, w in enumerate(w for w in words if w)}
        self.pattern = f"(?=({expression(prefix_tree(number))}))" if number else None
        self.size, self.kind = _buckets(len(number)), kind
        self.payloads = [words[w] for w in number]
        self.rows: list[list[dict]] = [[] for _ in range(self.size)]
        for word in number:
            parts = (word[:i] for i in range(1, len(word) + 1))
            self.rows[_place(word, self.size)].append({"word": word, "held": [number[p] for p in parts if p in number]})

    def found(self, text: Column) -> Column:
        """Payloads of the words that the text holds, each word once; NULL for a NULL text."""
        payloads = F.from_json(F.lit(json.dumps(self.payloads, ensure_ascii=False)), f"array<{self.kind}>")
        if self.pattern is None:
            return F.when(text.isNotNull(), payloads)

        def held(word: Column) -> Column:
            bucket = F.element_at(_table(self.rows, "struct<word: string, held: array<int>>"), _place_of(word, self.size))
            return F.filter(bucket, lambda e: e["word"] == word)[0]["held"]

        longest = F.array_distinct(F.regexp_extract_all(text, F.lit(self.pattern), F.lit(1)))
        return F.transform(F.array_distinct(F.flatten(F.transform(longest, held))), lambda i: F.get(payloads, i))


class KeyIndex:
    """Literal map from strings to strings."""

    def __init__(self, pairs: dict[str, str]):
        self.size = _buckets(len(pairs))
        self.rows: list[list[dict]] = [[] for _ in range(self.size)]
        for key, value in pairs.items():
            self.rows[_place(key, self.size)].append({"key": key, "value": value})

    def value(self, key: Column) -> Column:
        """Value of the key; NULL if there is none."""
        bucket = F.element_at(_table(self.rows, "struct<key: string, value: string>"), _place_of(key, self.size))
        return F.try_element_at(F.filter(bucket, lambda e: e["key"] == key), F.lit(1))["value"]
