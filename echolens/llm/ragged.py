"""Vectorised work on the bytes of many texts at once, straight from Arrow buffers.

A block of texts is one byte array plus the offsets of its texts. Words are runs of bytes of a class; a word's
64-bit hash mixes its bytes eight at a time, all words of a block at once, so no Python object is made per word. The
mixing is not linear: unlike a polynomial modulo 2**64, it has no regular texts that collide.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20  # bytes per block; a longer text is a block of its own
BASE = 0x9E3779B97F4A7C15
BACK = pow(BASE, -1, 1 << 64)
STEP = np.uint64(0xD1342543DE82EF95)

_all = np.arange(256)
LOWER = np.where((_all >= 65) & (_all <= 90), _all + 32, _all).astype(np.uint8)  # A-Z only
NOT_SPACE = ~np.isin(_all, [0x20, *range(0x09, 0x0E)])  # [^\x20\x09-\x0D]
ALPHANUMERIC = (_all >= 0x80) | ((_all >= 0x30) & (_all <= 0x39)) | ((_all >= 0x61) & (_all <= 0x7A))  # of lower-cased text


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def run(base):
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return run(BASE), run(BACK)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for n + 1 positions at least."""
    size = BLOCK + (1 << 17)
    while size < n + 1:
        size *= 2
    return _powers(size)


def prefix(data: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = sum of (byte + 1) * base ** position over [i, j)."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data))[0][: len(data)], out=out[1:])
    return out


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes in [start, end), the same wherever they stand."""
    return mix((h[end] - h[start]) * powers(len(h))[1][start])


LONG_WORD = 256  # bytes; longer words are hashed one by one


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes in [start, end) of each word."""
    length = end - start
    out = mix(length.astype(np.uint64) * STEP)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
    short = length <= LONG_WORD
    live = np.flatnonzero(short & (length > 0))
    for at in range(0, LONG_WORD, 8):
        live = live[length[live] > at]
        if not len(live):
            break
        chunk = eight[start[live] + at].view(np.uint64).ravel()
        left = length[live] - at
        cut = np.where(left < 8, (8 - left) * 8, 0).astype(np.uint64)
        chunk = (chunk << cut) >> cut  # bytes behind the word's end count as zero
        out[live] = mix((out[live] ^ chunk) * STEP + np.uint64(at + 1))
    for i in np.flatnonzero(~short):
        out[i] = int.from_bytes(blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


class Block:
    """Texts lo..hi of a column: their bytes and the offsets of each."""

    def __init__(self, lo: int, data: np.ndarray, starts: np.ndarray):
        self.lo, self.data, self.starts = lo, data, starts

    def __len__(self) -> int:
        return len(self.starts) - 1


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[Block]:
    """Cut a string or binary column into blocks of about ``limit`` bytes at text ends. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        hi = min(hi, len(column))
        yield Block(lo, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
        lo = hi


class Words:
    """Words of a block: lower-cased bytes, hash, owning text, and the range of words of each text."""

    def __init__(self, block: Block, is_word: np.ndarray):
        data = LOWER[block.data]
        inside = is_word[data]
        edge = block.starts[:-1][block.starts[:-1] < len(data)]
        before = np.empty_like(inside)
        before[1:], before[:1] = inside[:-1], False
        before[edge] = False
        after = np.empty_like(inside)
        after[:-1], after[-1:] = inside[1:], False
        after[edge[edge > 0] - 1] = False
        self.start, self.end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        self.data, self.hash = data, word_hashes(data, self.start, self.end)
        self.first = np.searchsorted(self.start, block.starts)  # words of text i: first[i] .. first[i + 1]
        self.text = np.repeat(np.arange(len(block)), np.diff(self.first))

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words that stay in one text, and the first word of each."""
        n = len(self.hash)
        if n < k:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.text[: n - k + 1] == self.text[k - 1 :])
        return sequence_hash([self.hash[at + j] for j in range(k)]), at


def sequence_hash(parts: list[np.ndarray]) -> np.ndarray:
    """Order-dependent hash of the columns of equally long sequences; sequences of other length differ."""
    out = np.full(len(parts[0]), len(parts), np.uint64)
    for x in parts:
        out = out * STEP + x
    return mix(out)


def shingle_sets(column: pa.Array, k: int = 5) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes of its k-word shingles; the whole sequence as one where words are fewer."""
    for block in blocks(column):
        w = Words(block, NOT_SPACE)
        h, at = w.windows(k)
        cut = np.searchsorted(at, w.first)
        for i in range(len(block)):
            a, b = w.first[i], w.first[i + 1]
            if b - a >= k:
                yield np.unique(h[cut[i] : cut[i + 1]])
            elif b > a:
                yield sequence_hash([w.hash[j : j + 1] for j in range(a, b)])
            else:
                yield np.zeros(0, np.uint64)
