"""Byte-level BPE by an Aho-Corasick automaton and backtracking.

Bytes are mapped to the Latin-1 characters of the same numbers, so an automaton over
strings finds, in one pass over a piece, the longest token that begins at each byte. The
encoding takes longest matches and steps back to shorter ones where two neighbouring
tokens could not stand next to each other after the merges. Whether two tokens are
compatible follows from how each was merged and is remembered; a position that was left in
a step back is never entered again, so the work is linear in the length of the piece and
the result is that of the merges.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosstie.llm.common import texts_of

# Characters of all words that a worker remembers and of the longest; when half of it is full, the half
# before is forgotten (a matter of speed only). Ids take a few bytes for each character, so this bounds the memory.
MOST_KNOWN = 16_000_000
LONGEST_KNOWN = 64
# Pairs of neighbouring tokens that a worker remembers.
MOST_PAIRS = 1_000_000


# White space other than single spaces and line feeds between words: there the pattern looks further than one character.
UNUSUAL = ["\0", "  ", "\n\n", " \n", "\n ", *filter(str.isspace, map(chr, [*range(9, 10), *range(11, 32), *range(127, 0x3001)]))]
UNUSUAL_ASCII = [*filter(str.isascii, UNUSUAL)]


def words(text: str) -> list[str]:
    """Parts that the pattern never joins: cut at single spaces and line feeds between words, else the whole text."""
    if not text:
        return []
    if text[0].isspace() or text[-1].isspace() or any(map(text.__contains__, UNUSUAL_ASCII if text.isascii() else UNUSUAL)):
        return [text]
    return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")


class Known(dict):
    """Words with their ids; a new word is encoded when it is first asked for and kept if it is short.

    Words are kept in two generations of half the size. When the newer is full, the older is forgotten;
    what is still in use moves on to the newer when it is asked for, so common words are not encoded again.
    """

    def __init__(self, learn, most: int = MOST_KNOWN, longest: int = LONGEST_KNOWN):
        super().__init__()
        self.learn, self.most, self.longest, self.size, self.older = learn, most, longest, 0, {}

    def __missing__(self, word):
        found = self.older.pop(word, None)
        if found is None:
            found = self.learn(word)
        if len(word) <= self.longest:
            if 2 * self.size > self.most:
                self.older = dict(self)
                self.clear()
                self.size = 0
            self[word] = found
            self.size += len(word) + 8
        return found


class ByteBpe:
    def __init__(self, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.pieces = regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()
        self.prefix: dict[int, int | None] = {}
        self.compatible: dict[tuple[int, int], bool] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self._find_parts()
        self.known = Known(self.learn)

    def shorter(self, token: int) -> int | None:
        """The longest token that is a proper prefix of ``token``."""
        if token not in self.prefix:
            raw = self.tokens[token]
            cuts = (self.ranks.get(raw[:n]) for n in range(len(raw) - 1, 0, -1))
            self.prefix[token] = next((t for t in cuts if t is not None), None)
        return self.prefix[token]

    def _find_parts(self) -> None:
        """For each token the two tokens whose merge makes it, lowest ranks first."""
        for token in sorted(self.tokens):
            raw = self.tokens[token]
            left = self.shorter(token)
            while left is not None:
                right = self.ranks.get(raw[len(self.tokens[left]):])
                if right is not None and left < token and right < token and self._check(left, right):
                    self.merged[left, right] = token
                    self.parts[token] = (left, right)
                    break
                left = self.shorter(left)

    def _check(self, left: int, right: int) -> bool:
        """Whether the merges of ``left`` followed by ``right`` keep the boundary between them.

        The tokens are taken apart along the boundary, latest merge first. A pair of parts
        that merges earlier than the merge just undone would have crossed the boundary.
        """
        limit = 1 << 62
        while True:
            merge = self.merged.get((left, right))
            if merge is not None and merge < limit:
                return False
            if left > right:
                limit, parts = left, self.parts.get(left)
                if parts:
                    left = parts[1]
                    continue
                limit, parts = right + 1, self.parts.get(right)
                if not parts:
                    return True
                right = parts[0]
            else:
                limit, parts = right + 1, self.parts.get(right)
                if parts:
                    right = parts[0]
                    continue
                limit, parts = left, self.parts.get(left)
                if not parts:
                    return True
                left = parts[1]

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        longest: list[int] = [-1] * n
        size = [0] * n
        for end, (length, token) in self.automaton.iter(piece.decode("latin-1")):
            start = end - length + 1
            if length > size[start]:
                size[start], longest[start] = length, token
        closed = bytearray(n + 1)
        out: list[int] = []
        tokens, compatible = self.tokens, self.compatible
        at, token = 0, longest[0]
        while True:
            end = at + len(tokens[token])
            fits = not closed[end]
            if fits and out:
                fits = compatible.get((out[-1], token))
                if fits is None:
                    if len(compatible) > MOST_PAIRS:
                        compatible.clear()
                    fits = compatible[out[-1], token] = self._check(out[-1], token)
            if fits:
                out.append(token)
                if end == n:
                    return out
                at, token = end, longest[end]
                continue
            less = self.shorter(token)
            if less is not None:
                token = less
                continue
            closed[at] = 1
            token = out.pop()
            at -= len(tokens[token])

    def encode(self, text: str) -> list[tuple[str, bytes]]:
        """Decimal ids and little-endian unsigned 32-bit ids of each word of the text, in order."""
        return list(map(self.known.__getitem__, words(text)))

    def learn(self, word: str) -> tuple[str, bytes]:
        """The ids of a new word from those of its pieces."""
        pieces = self.pieces(word)
        if len(pieces) != 1:
            parts = [self.known[p] for p in pieces]
            return " ".join([d for d, _ in parts]), b"".join([r for _, r in parts])
        ids = self.encode_piece(word.encode())
        return " ".join(map(str, ids)), struct.pack(f"<{len(ids)}I", *ids)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def ids_of(found: list[tuple[str, bytes]]) -> list[int]:
    return np.frombuffer(b"".join([r for _, r in found]), "<u4").tolist()


_BPES: dict[tuple[str, str], ByteBpe] = {}


def byte_bpe(ranks_path: str, pattern: str) -> ByteBpe:
    if (ranks_path, pattern) not in _BPES:
        _BPES[ranks_path, pattern] = ByteBpe(ranks_path, pattern)
    return _BPES[ranks_path, pattern]


def encode_column(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ranks_path: str | None = None,
                  pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``doc_id`` and ``ids`` of every document; a missing text is empty and has no ids."""
    ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(ranks_path, pattern)
        for batch in batches:
            ids = [ids_of(bpe.encode(t)) for t in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, f"doc_id {kind}, ids array<int>")


def decode_column(tokens: DataFrame, ranks_path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``doc_id`` and ``bytes`` from ``doc_id`` and ``ids``."""
    ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(ranks_path, pattern)
        for batch in batches:
            raw = [bpe.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ["doc_id", "bytes"])

    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, bytes binary")


def round_trip(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ranks_path: str | None = None,
               pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Digests of the ids of every document and of the bytes decoded from these ids.

    A missing text counts as empty; rows are treated one by one, so missing ids, repeated
    rows and empty tables need no rule; other columns are ignored. No shuffle.
    """
    ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    kind = docs.schema[doc_id].dataType.simpleString()
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(ranks_path, pattern)
        for batch in batches:
            counts, ids_sums, text_sums = [], [], []
            for t in texts_of(batch.column(1)):
                found = bpe.encode(t)
                ids = ids_of(found)
                counts.append(len(ids))
                ids_sums.append(hashlib.sha256(" ".join([d for d, _ in found]).encode()).hexdigest())
                text_sums.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sums), pa.array(text_sums)], names)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
