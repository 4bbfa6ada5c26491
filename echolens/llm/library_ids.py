"""Token ids by the tokenizers library, with the ids of common units remembered per task.

A byte-level BPE works piece by piece, so the ids of a text are the ids of any units cut at piece boundaries, in a
row. Each distinct unit goes through the library once while it stays in a memory of two generations;
a text that holds a special string, or a tokenizer that is not plain byte-level BPE, is encoded by the library whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex

from .bpe import BYTE_LEVEL_PATTERN
from .frames import coded, groups, taken  # noqa: F401

CACHE = 800_000  # units remembered, and as many of the generation before: about 200 bytes each
SPACED = re.compile(r"\s ")
LETTERS = re.compile(r"([A-Za-z]+)([!-&(-/:-@\[-`{-~]*)")  # no apostrophe: the letters are one piece, the marks behind another
BLANK_SPACE = [chr(c) + " " for c in (0x20, *range(0x09, 0x0E), *range(0x1C, 0x20))]  # the same for ASCII


class LibraryEncoder:
    def __init__(self, path: str, special_is_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = special_is_text
        self.model = self.library.model
        self.vocab_size = self.library.get_vocab_size(with_added_tokens=True)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        before = spec["pre_tokenizer"] or {}
        plain = not spec["normalizer"] and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        white = r"\p{White_Space}"
        pattern = BYTE_LEVEL_PATTERN.replace(r"[^\s", rf"[^{white}").replace(r"\s", white).replace(r"\S", r"\P{White_Space}")
        self.pieces = regex.compile(pattern) if plain else None
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        self.widths = None
        if plain:  # a token of a byte-level vocabulary has one character per byte
            self.widths = np.zeros(max(vocabulary.values()) + 1, np.int64)
            self.widths[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self.special = [] if special_is_text else [t["content"] for t in spec["added_tokens"]]
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.odd: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> None:
        """Ids of words as they stand after a space. Letters with or without marks behind are pieces as they are, and go to
        the library's model; the others are joined, one library call encodes them all, and the tokens' byte lengths tell
        where each ends."""
        known, others = self.known, []
        for w in words:
            parts = LETTERS.fullmatch(w)
            if parts is None:
                others.append(w)
                continue
            letters, marks = parts.groups()
            got = known.get(letters)
            if got is None:
                got = known[letters] = self._tokens("\u0120" + letters)  # a space, as the byte-level alphabet writes it
            if marks:
                known[w] = got + (self.marks.get(marks) or self._mark(marks))
        if not others:
            return
        ids = np.frombuffer(self._whole(" " + " ".join(others)), "<u4")
        ends = np.cumsum([len(w.encode()) + 1 for w in others])
        cut = (np.searchsorted(np.cumsum(self.widths[ids]), ends) + 1) * 4
        raw, low = ids.tobytes(), 0
        for w, high in zip(others, cut.tolist()):
            known[w] = raw[low:high]
            low = high

    def _tokens(self, piece: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(piece)]).tobytes()

    def _mark(self, marks: str) -> bytes:
        if len(self.marks) >= CACHE:
            self.marks.clear()
        got = self.marks[marks] = self._tokens(marks)
        return got

    def _whole(self, text: str) -> bytes:
        return array("I", self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()  # no offsets

    def words(self, text: str) -> list[str] | None:
        """The text cut at spaces, if each space surely begins a piece: none follows white space, none ends the text."""
        if self.pieces is None or any(s in text for s in self.special):
            return None
        blank = any(b in text for b in BLANK_SPACE) if text.isascii() else SPACED.search(text)
        return None if blank or text[:1] == " " or text[-1:].isspace() else text.split(" ")

    def many(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as unsigned 32-bit integers in the machine's (little-endian) order."""
        out, spaced, words, firsts = [], [], [], []
        for i, text in enumerate(texts):
            own = self.words(text) if text else []
            out.append(self._pieced(text) if own is None else b"")
            if own:
                spaced.append(i)
                firsts.append(len(words))
                words += own
        if spaced:
            for i, ids in zip(spaced, self._joined(words, np.array(firsts))):
                out[i] = ids
        return out

    def _joined(self, words: list[str], firsts: np.ndarray) -> list[bytes]:
        """Ids of texts whose words stand in a row, each text from one of ``firsts`` on. Each distinct word is looked up once."""
        if len(self.known) > CACHE:  # the oldest half goes; what is still in use moves up
            self.before, self.known = self.known, {}
        known, before = self.known, self.before
        distinct, at = coded(words)
        spaced = np.ones(len(at), bool)
        spaced[firsts] = False  # a first word stands after no space and is not remembered with the others
        used = np.flatnonzero(np.bincount(at[spaced], minlength=len(distinct))).tolist()
        ids: list[bytes] = [b""] * len(distinct)
        missing = [w for w in map(distinct.__getitem__, used) if w not in known]
        if missing:
            known.update({w: before[w] for w in missing if w in before})
            self._learn([w for w in missing if w not in before])
        for j in used:
            ids[j] = known[distinct[j]]
        at[firsts] = len(distinct) + np.arange(len(firsts))
        heads = [words[i] for i in firsts.tolist()]
        alone = self._alone(heads)
        data, ends = taken(pa.array(ids + [alone[w] for w in heads], pa.large_binary()), at)
        cut = ends[[*firsts.tolist(), len(at)]].tolist()
        return [bytes(data[a:b]) for a, b in zip(cut, cut[1:])]

    def _alone(self, units: list[str]) -> dict[str, bytes]:
        """Ids of strings as they stand alone."""
        got = self.odd
        new = list(set(units).difference(got))
        if len(got) + len(new) > CACHE:
            got.clear()
            new = list(set(units))
        got.update((p, array("I", e.ids).tobytes()) for p, e in zip(new, self.library.encode_batch_fast(new, add_special_tokens=False)))
        return got

    def _pieced(self, text: str) -> bytes:
        """A text with runs of white space or special strings: piece by piece, or by the library as a whole."""
        if self.pieces is None or any(s in text for s in self.special):
            return self._whole(text)
        pieces = self.pieces.findall(text)
        got = self._alone(pieces)
        return b"".join([got[p] for p in pieces])

    def __call__(self, text: str | None) -> bytes:
        return self.many([text])[0]


@lru_cache(maxsize=4)
def encoder(path: str, special_is_text: bool = False) -> LibraryEncoder:
    """One encoder per file and Python worker."""
    return LibraryEncoder(path, special_is_text)


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
