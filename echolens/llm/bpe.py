"""BPE encoding and decoding by a bounded-lookahead streaming transducer.

**Encoding.** Merges are applied lowest rank first. Whether a merge at some place happens can depend on the symbols to
its right, but only through a chain of merges of ever lower rank, each taking the symbol the one before it wanted.
``Merges.lookahead`` is the longest such chain in characters, computed from the merge list. A token that ends at least
that far before the end of what has been read can no longer change, so ``Transducer`` emits it and forgets it: the
memory is one buffer of ``lookahead`` plus the longest token plus one chunk, however long the piece. Because no merge
ever crosses a settled boundary, the rest is encoded as if it began there.

**Decoding.** ``Decoder`` turns ids to text one at a time. For a vocabulary with a byte-level decoder it is an
incremental UTF-8 state machine over the token's bytes; without a decoder, tokens are joined by single spaces.

The tokenizer file gives vocabulary, merges, normaliser, piece pattern, end-of-word suffix and special tokens. Special
strings in a text become their ids, as in the library's default.

Cases: null or empty text has no ids and decodes to the empty text; texts and words of any length are encoded whole;
repeated documents are encoded each; a character whose byte symbol is missing from the vocabulary and an id that is
not in it are left out, as the library leaves them out when no unknown token is set. Other columns pass through.
"""

from __future__ import annotations

import codecs
import json
import unicodedata
from bisect import bisect_left
from collections.abc import Iterable, Iterator, Sequence
from functools import cached_property, lru_cache
from hashlib import sha256
from itertools import batched, chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from .frames import coded, give_back, groups, table, taken

CHUNK = 512
CACHE = 500_000  # pieces or words remembered per task, and as many of the generation before: about 250 bytes each
LONG_PIECE = 64  # longer pieces are not remembered
STRETCH = 1 << 16  # characters normalised and cut into words at once


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1 for itself, the rest from U+0100 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


BYTE_CHARS = byte_alphabet()
BYTE_TABLE = {chr(b): c for b, c in enumerate(BYTE_CHARS)}  # Latin-1 view of the bytes to symbols
CHAR_BYTES = {c: b for b, c in enumerate(BYTE_CHARS)}


class Merges:
    """A merge list: pair to (rank, merged symbol), and the lookahead that settles every decision."""

    def __init__(self, pairs: list[tuple[str, str]], suffix: str = ""):
        self.rank = {p: i for i, p in enumerate(pairs)}
        self.suffix = suffix
        self.parts: dict[str, tuple[int, str, str]] = {}
        for i, (a, b) in enumerate(pairs):
            self.parts.setdefault(a + b, (i, a, b))
        self.longest = max([len(a) + len(b) - (len(suffix) if b.endswith(suffix) and suffix else 0) for a, b in pairs], default=1)
        self.lookahead = self._lookahead(pairs)

    def _width(self, symbol: str) -> int:
        return len(symbol) - len(self.suffix) if self.suffix and symbol.endswith(self.suffix) and len(symbol) > len(self.suffix) else len(symbol)

    def _lookahead(self, pairs: list[tuple[str, str]]) -> int:
        """Longest reach to the right of a boundary.

        reach(r) for merge r = (u, v): v itself, plus what can take v, or a symbol on v's right edge before it is merged
        into v, away: a merge of lower rank whose left symbol it is. Ranks fall along the chain, so one pass in rank
        order suffices; per left symbol the reaches so far are kept as running maxima.
        """
        ranks: dict[str, list[int]] = {}
        best: dict[str, list[int]] = {}

        def taken(symbol: str, below: int) -> int:
            at = bisect_left(ranks.get(symbol, ()), below)
            return best[symbol][at - 1] if at else 0

        longest = 1
        for r, (u, v) in enumerate(pairs):
            reach, symbol, limit = 0, v, r
            while True:
                reach = max(reach, taken(symbol, limit))
                if symbol not in self.parts:
                    break
                limit, _, symbol = self.parts[symbol]
            reach += self._width(v)
            longest = max(longest, reach)
            ranks.setdefault(u, []).append(r)
            seen = best.setdefault(u, [])
            seen.append(max(reach, seen[-1] if seen else 0))
        return longest + 1

    def apply(self, symbols: list[str]) -> list[str]:
        """Merge a symbol list in place to its end state, lowest rank first, leftmost first."""
        rank, top = self.rank.get, len(self.rank)
        scores = [rank(p, top) for p in zip(symbols, symbols[1:])]
        while scores:
            low = min(scores)
            if low == top:
                break
            k = scores.index(low)
            symbols[k] += symbols.pop(k + 1)
            del scores[k]
            if k:
                scores[k - 1] = rank((symbols[k - 1], symbols[k]), top)
            if k < len(scores):
                scores[k] = rank((symbols[k], symbols[k + 1]), top)
        return symbols


class Transducer:
    """Streams the characters of one piece in, and its settled tokens out."""

    def __init__(self, merges: Merges, chunk: int = CHUNK):
        self.merges, self.buffer = merges, ""
        self.size = merges.lookahead + merges.longest + chunk

    def push(self, characters: str) -> Iterator[str]:
        at = 0
        while at < len(characters):
            take = self.size - len(self.buffer)
            self.buffer += characters[at : at + take]
            at += take
            if len(self.buffer) >= self.size:
                yield from self._settled()

    def _settled(self) -> Iterator[str]:
        limit, end = len(self.buffer) - self.merges.lookahead, 0
        for token in self.merges.apply(list(self.buffer)):
            if end + len(token) > limit:
                break
            end += len(token)
            yield token
        self.buffer = self.buffer[end:]

    def close(self) -> Iterator[str]:
        if self.buffer:
            symbols = list(self.buffer)
            symbols[-1] += self.merges.suffix
            yield from self.merges.apply(symbols)
        self.buffer = ""

    def whole(self, characters: str) -> list[str]:
        """The tokens of a whole piece; of one that fits the buffer nothing is settled before its end."""
        if len(characters) >= self.size:
            return [*self.push(characters), *self.close()]
        self.buffer = characters
        return list(self.close())


class Decoder:
    """Ids in, text out, with at most three bytes held back."""

    def __init__(self, tokenizer: "Tokenizer"):
        self.tokenizer, self.first = tokenizer, True
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace") if tokenizer.byte_decoder else None

    def push(self, token_id: int) -> str:
        return self.run((token_id,))

    def run(self, ids: Iterable[int]) -> str:
        """The text that the next ids settle; the same as pushing one after the other."""
        tokens = [t for t in map(self.tokenizer.tokens.get, ids) if t is not None]
        if self.utf8:
            return self.utf8.decode(b"".join(map(token_bytes, tokens)))
        if not tokens:
            return ""
        out = " ".join(tokens) if self.first else " ".join(["", *tokens])
        self.first = False
        return out

    def close(self) -> str:
        return self.utf8.decode(b"", True) if self.utf8 else ""

    def many(self, ids: np.ndarray, ends: np.ndarray) -> Iterator[memoryview]:
        """The decoded bytes of whole texts whose ids stand in a row, for tokens that are joined by spaces."""
        data, at = taken(self.tokenizer.spaced, ids)
        for a, b in zip(at[ends[:-1]].tolist(), at[ends[1:]].tolist()):
            yield data[a + 1 if b > a else a : b]


def token_bytes(token: str) -> bytes:
    """Bytes of a byte-level token; one with other characters stands for itself."""
    if any(c not in CHAR_BYTES for c in token):
        return token.encode()
    return bytes([CHAR_BYTES[c] for c in token])


# The piece pattern of a byte-level pre-tokenizer.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Tokenizer:
    """A BPE tokenizer file: byte-level pieces, with or without normaliser and end-of-word suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = Merges(pairs, model.get("end_of_word_suffix") or "")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in {**self.vocab, **self.special}.items()}
        self.byte_decoder = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        steps = spec.get("normalizer") or {}
        self.normal = [s["type"] for s in steps.get("normalizers", [steps] if steps else [])]
        if set(self.normal) - {"NFC", "Lowercase", "Replace"}:
            raise ValueError(f"normaliser {self.normal} is not supported")
        before = spec["pre_tokenizer"]
        split = [s for s in before.get("pretokenizers", [before]) if s["type"] == "Split"]
        pattern = split[0]["pattern"]["Regex"] if split else BYTE_LEVEL_PATTERN
        white = r"\p{White_Space}"
        self.pieces = regex.compile(pattern.replace(r"[^\s", rf"[^{white}").replace(r"\s", white).replace(r"\S", r"\P{White_Space}"))
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known: dict[str, tuple[int, ...]] = {}
        self.machine = Transducer(self.merges)  # for pieces that come whole

    @cached_property
    def spaced(self) -> pa.LargeBinaryArray:
        """A space and the token, by id; nothing for an id that is not in the vocabulary."""
        return pa.array([b"" if i not in self.tokens else b" " + self.tokens[i].encode() for i in range(max(self.tokens, default=-1) + 1)], pa.large_binary())

    def normalise(self, text: str) -> str:
        for step in self.normal:
            if step == "NFC" and not text.isascii():
                text = unicodedata.normalize("NFC", text)
            elif step == "Lowercase":
                text = text.replace("Σ", "σ").lower()  # a final sigma is not special here
        return text  # the white-space replacement only touches what the piece pattern drops

    def piece(self, piece: str) -> Iterator[int]:
        """Ids of one piece, streamed."""
        machine = Transducer(self.merges)
        for at in range(0, len(piece), CHUNK):
            for token in machine.push(piece[at : at + CHUNK].encode().decode("latin-1").translate(_TRANSLATE)):
                yield from self._id(token)
        for token in machine.close():
            yield from self._id(token)

    def short_piece(self, piece: str) -> list[int]:
        """Ids of one piece that is not long."""
        symbols = piece if piece.isascii() and piece.isalnum() else piece.encode().decode("latin-1").translate(_TRANSLATE)
        return [i for i in map(self.vocab.get, self.machine.whole(symbols)) if i is not None]

    def _id(self, token: str) -> tuple[int, ...]:
        got = self.vocab.get(token)
        return () if got is None else (got,)

    def remembered(self, piece: str) -> tuple[int, ...]:
        got = self.known.get(piece)
        if got is None:
            got = tuple(self.piece(piece))
            if len(piece) <= LONG_PIECE:
                if len(self.known) >= CACHE:
                    self.known.clear()
                self.known[piece] = got
        return got

    def segments(self, text: str) -> Iterator[tuple[str, bool]]:
        """The text cut at special strings: (segment, is special)."""
        if self.split_special is None or "<" not in text:
            yield text, False
            return
        for i, part in enumerate(self.split_special.split(text)):
            if part:
                yield part, bool(i % 2)

    def encode(self, text: str) -> Iterator[int]:
        for part, special in self.segments(text):
            if special:
                yield self.special[part]
            else:
                for match in self.pieces.finditer(self.normalise(part)):
                    yield from self.remembered(match.group())

    def decode(self, ids) -> str:
        decoder = Decoder(self)
        return decoder.run(ids) + decoder.close()


_TRANSLATE = {ord(k): v for k, v in BYTE_TABLE.items()}


@lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    """One tokenizer per file and Python worker."""
    return Tokenizer(path)


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """All columns of ``docs`` plus ``ids``."""
    return _mapped(docs, text, "ids array<int>", lambda t: lambda x: list(t.encode(x or "")), path)


def decode(docs: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """All columns of ``docs`` plus ``decoded``."""
    return _mapped(docs, ids, "decoded string", lambda t: lambda x: t.decode(x or ()), path)


def _mapped(docs: DataFrame, source: str, added: str, make, path: str) -> DataFrame:
    name = added.split()[0]
    docs = docs.drop(*[c for c in docs.columns if c.lower() == name and c != source])
    at, schema = docs.columns.index(source), StructType([*docs.schema.fields, *_parse_datatype_string(added).fields])
    kind = pa.string() if added.endswith("string") else pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make(tokenizer(path))
        for batch in batches:
            for low in range(0, batch.num_rows, 64):  # long texts: few rows at a time
                part = batch.slice(low, 64)
                values = pa.array([work(x) for x in part.column(at).to_pylist()], kind)
                yield pa.RecordBatch.from_arrays([*part.columns, values], names=[*part.schema.names, name])

    return docs.mapInArrow(run, schema)


DIGESTS = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def digests(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Encode and decode every text in one pass; per document the number of ids and the digests of ids and decoded text."""
    names = [f.split()[0] for f in DIGESTS.split(", ")]
    docs = docs.drop(*[c for c in docs.columns if c.lower() in names])
    at, schema = docs.columns.index(text), StructType([*docs.schema.fields, *_parse_datatype_string(DIGESTS).fields])
    columns = [*docs.columns, *names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = Digester(tokenizer(path))
        for batch in batches:
            if batch.num_rows == 0:
                continue
            n, a, b = zip(*chain.from_iterable(work.many(texts) for _, texts in groups(batch.column(at))))
            made = [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=columns)
        del work
        tokenizer.cache_clear()
        give_back()

    return docs.mapInArrow(run, schema)


class Digester:
    """Digests of texts. Ids leave the transducer, go through the decoder, and both sides are hashed on the way; only the ids
    of common words and their pieces are remembered, nothing of the decoded text. ``many`` looks each distinct word of some
    texts up once; what does not fit there (long texts and words, special strings, byte-level tokens) is streamed."""

    def __init__(self, tok: Tokenizer):
        self.tok = tok
        self.decimal = [str(i) for i in range(max(tok.tokens, default=-1) + 1)]
        self.spaced = pa.array([b" " + d.encode() for d in self.decimal], pa.large_binary())
        self.parts: dict[str, tuple[int, ...]] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        self.before: dict[str, tuple[int, ...]] = {}

    def _learn(self, word: str) -> tuple[int, ...]:
        """Ids of a short run without white space, which may hold several pieces."""
        got = self.before.get(word)
        if got is None:
            got = tuple(chain.from_iterable([self.parts.get(p) or self._part(p) for p in self.tok.pieces.findall(word)]))
        if len(self.known) >= CACHE:  # the oldest half goes; what is still in use moves up
            self.before, self.known = self.known, {}
        self.known[word] = got
        return got

    def _part(self, piece: str) -> tuple[int, ...]:
        """Ids of a piece of a short run; many runs differ only in a mark at their end."""
        if len(self.parts) >= CACHE:
            self.parts.clear()
        got = self.parts[piece] = tuple(self.tok.short_piece(piece))
        return got

    def _pieces(self, word: str) -> Iterator[int]:
        for match in self.tok.pieces.finditer(word):
            yield from self.tok.piece(match.group())

    def _words(self, text: str) -> list[str]:
        """Runs without white space: no piece crosses them. Four control characters are blank to split() only."""
        return self.tok.pieces.findall(text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()

    def runs(self, text: str) -> Iterator[Sequence[int]]:
        """The ids of a text, some thousands at a time."""
        tok = self.tok
        if tok.byte_decoder:  # pieces hold white space
            yield from batched(tok.encode(text), CHUNK)
            return
        for part, special in tok.segments(text):
            if special:
                yield (tok.special[part],)
                continue
            for stretch in stretches(part):
                words = self._words(tok.normalise(stretch))
                get, learn = self.known.get, self._learn
                if max(map(len, words), default=0) <= LONG_PIECE:
                    yield list(chain.from_iterable([get(w) or learn(w) for w in words]))
                else:
                    for w in words:
                        yield from (self.known.get(w) or learn(w),) if len(w) <= LONG_PIECE else batched(self._pieces(w), CHUNK)

    def __call__(self, text: str | None) -> tuple[int, str, str]:
        n, ids_hash, text_hash, decoder = 0, sha256(), sha256(), Decoder(self.tok)
        for ids in self.runs(text or ""):
            if ids:
                decimal = " ".join(map(self.decimal.__getitem__, ids))
                ids_hash.update((" " + decimal if n else decimal).encode())
                text_hash.update(decoder.run(ids).encode())
                n += len(ids)
        text_hash.update(decoder.close().encode())
        return n, ids_hash.hexdigest(), text_hash.hexdigest()

    def many(self, texts: Sequence[str | None]) -> list[tuple[int, str, str]]:
        """Digests of some texts, as of each alone."""
        tok, words, rows, ends = self.tok, [], [], [0]
        out: list[tuple[int, str, str] | None] = [None] * len(texts)
        for i, text in enumerate(texts):
            text = text or ""
            if tok.byte_decoder or len(text) > STRETCH or any(s in text for s in tok.special):
                out[i] = self(text)
                continue
            words += self._words(tok.normalise(text))
            rows.append(i)
            ends.append(len(words))
        if not rows:
            return out
        distinct, at = coded(words)
        long = np.array([len(w) > LONG_PIECE for w in distinct], bool)
        streamed = {k for k in (np.searchsorted(ends, np.flatnonzero(long[at]), "right") - 1).tolist()} if long.any() else set()
        get, learn = self.known.get, self._learn
        found = [() if skip else get(w) or learn(w) for w, skip in zip(distinct, long.tolist())]
        size = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.int64, int(size.sum()))
        each = size[at]  # ids of each word, and where they end
        stop = np.concatenate([[0], np.cumsum(each)])
        ids = flat[np.repeat((np.cumsum(size) - size)[at] - stop[:-1], each) + np.arange(stop[-1])]
        cut = stop[ends]
        decimal, place = taken(self.spaced, ids)
        place = place[cut].tolist()
        for k, (i, decoded) in enumerate(zip(rows, Decoder(tok).many(ids, cut))):
            if k in streamed:
                out[i] = self(texts[i])
                continue
            low, high = place[k], place[k + 1]
            out[i] = int(cut[k + 1] - cut[k]), sha256(decimal[low + 1 if high > low else low : high]).hexdigest(), sha256(decoded).hexdigest()
        return out


def stretches(text: str) -> Iterator[str]:
    """The text in stretches of about ``STRETCH`` characters, each but the first beginning with a space: neither a piece nor
    a composed character crosses that place."""
    low = 0
    while low < len(text):
        high = text.find(" ", low + STRETCH)
        high = len(text) if high < 0 else high
        yield text[low:high]
        low = high


def op4(spark: SparkSession, folder: str, path: str | None = None) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return digests(docs, path or word_bpe()).drop("text")


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
