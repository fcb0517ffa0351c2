"""Token ids of whole texts with the tokenizers library, each distinct word being encoded once per worker.

The pre-tokenizers never join what a single white-space character separates, so a text may
be cut there and the ids of its chunks concatenated. Chunks of Latin letters are cut
further by the pre-tokenizer's own pattern, and the library's merge model gives the ids of
each piece; the worker remembers pieces and chunks. Everything else (other scripts, unusual
white space) goes through the library's whole pipeline.
"""

from __future__ import annotations

from unicodedata import normalize

import numpy as np
import regex
from tokenizers import Tokenizer

from crosstie.llm.byte_bpe import Known, words

# The patterns of the two pre-tokenizers (white space is dropped by the second).
SPACED_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
# Marks that are a piece of their own at the end of a word.
MARKS = ",.;:!?"
# First character after the Latin letters whose case and classes all Unicode versions agree on.
AFTER_LATIN = "ɐ"


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte: itself where printable in Latin-1, else one after U+00FF."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes.

    ``spaced`` tells that a word's leading space belongs to its first token (byte-level
    pre-tokenizers); otherwise texts are lower-cased and white space is dropped.
    """

    def __init__(self, path: str, spaced: bool):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.spaced = spaced
        self.pieces = regex.compile(SPACED_PATTERN if spaced else WORD_PATTERN).findall
        self.letters = byte_letters()
        self.raw = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.known = Known(self.learn)

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return [np.asarray(e.ids, "<u4").tobytes() for e in found]

    def chunks(self, text: str) -> list[str] | None:
        """Chunks whose ids may be concatenated, or None if the text has to be encoded whole."""
        if not self.spaced:
            return text.replace("\n", " ").split(" ")
        found = words(text)
        return found if len(found) != 1 or text.isalpha() else None

    def split(self, plain: str) -> list[str]:
        """The pre-tokenizer's pieces of Latin text; letters with at most one mark behind them need no pattern."""
        word = plain.removeprefix(" ") if self.spaced else plain
        if word.isalpha():
            return [plain]
        if word[:-1].isalpha() and word[-1] in MARKS:
            return [plain[:-1], plain[-1]]
        return self.pieces(plain)

    def learn(self, chunk: str) -> bytes:
        latin = chunk.isascii()
        if not latin and max(chunk) >= AFTER_LATIN:
            return self.whole([chunk])[0]
        plain = chunk if self.spaced else chunk.lower() if latin else normalize("NFC", chunk).lower()
        pieces = self.split(plain)
        if pieces != [chunk]:
            return b"".join(map(self.known.__getitem__, pieces))
        mapped = (chunk if latin else chunk.encode().decode("latin-1")).translate(self.letters)
        return b"".join([self.raw[t.id] for t in self.model.tokenize(mapped)])

    def encode(self, text: str) -> bytes:
        chunks = self.chunks(text)
        if chunks is None:
            return self.whole([text])[0]
        return b"".join(map(self.known.__getitem__, chunks))


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, spaced: bool) -> Encoder:
    """The worker's encoder for a vocabulary file; it is kept between tasks."""
    if (path, spaced) not in _ENCODERS:
        _ENCODERS[path, spaced] = Encoder(path, spaced)
    return _ENCODERS[path, spaced]
