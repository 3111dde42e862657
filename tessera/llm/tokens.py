"""Token ids of whole texts with a published tokenizer file, word by word.

A chunk is a piece of text that the tokenizer encodes alike alone and inside the text, so each distinct chunk is encoded
once per Python worker and looked up afterwards. The table of chunks is bounded: beyond ``MAX_CHUNKS`` it is started anew,
which costs time, never results.

Words of Latin letters, digits and punctuation take a short way: their pre-tokens go straight to a BPE core that holds the
file's vocabulary, with the end-of-word mark as the byte 0xFF, which no UTF-8 text has. All others, and words that could
hold a special string, go through the tokenizer library.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np
import regex

MAX_CHUNKS = 500_000
#: Characters whose lower case and composition don't depend on their neighbours, up to U+024F.
_LATIN = "[\x21-\x7e\xa1-\u012f\u0131-\u024f]"
#: The split pattern of the lower-casing BPE files with word ends (fixed values of that format).
_PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_characters() -> dict[str, int]:
    """The characters that byte-level BPE files use for bytes: printable ones for themselves, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class WordEnds:
    """BPE of single words for files with this split pattern and the word end ``</w>``; None where it can't tell."""

    def __init__(self, file: dict) -> None:
        import tiktoken

        to_byte, end = byte_characters(), "</w>"
        self.pre_tokens = regex.compile(_PRE_TOKENS)
        opening = "".join({t["content"][0] for t in file["added_tokens"]})
        self.fits = re.compile(f"(?:(?![{re.escape(opening)}]){_LATIN})+" if opening else f"{_LATIN}+").fullmatch
        names = {t["content"] for t in file["added_tokens"]}
        ranks = {}
        for token, n in file["model"]["vocab"].items():
            if token not in names:
                bare = token.removesuffix(end)
                ranks[bytes(map(to_byte.__getitem__, bare)) + (b"\xff" if bare != token else b"")] = n
        ranks.setdefault(b"\xff", max(file["model"]["vocab"].values()) + 1)
        self.core = tiktoken.Encoding("word-ends", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.pieces: dict[str, list[int]] = {}

    @staticmethod
    def suits(file: dict) -> bool:
        split = (file.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        steps = [n["type"] for n in (file.get("normalizer") or {}).get("normalizers", [])]
        return file["model"].get("end_of_word_suffix") == "</w>" and steps == ["NFC", "Replace", "Lowercase"] and split.get("pattern") == {"Regex": _PRE_TOKENS} and split.get("behavior") == "Removed"

    def __call__(self, word: str) -> list[int] | None:
        if word.isascii() and word.isalpha():
            return self.core.encode_single_piece(word.lower().encode() + b"\xff")
        if not self.fits(word):
            return None
        word = word.lower()
        if word.isalpha():
            return self.core.encode_single_piece(word.encode() + b"\xff")
        out: list[int] = []
        for piece in self.pre_tokens.findall(word):
            if len(piece) > 2:
                out += self.core.encode_single_piece(piece.encode() + b"\xff")
                continue
            ids = self.pieces.get(piece)
            if ids is None:
                ids = self.pieces[piece] = self.core.encode_single_piece(piece.encode() + b"\xff")
            out += ids
        return out


class Numbers(dict):
    """Numbers keys in order of first sight; ``new`` lists those not met before."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list = []

    def __missing__(self, key: object) -> int:
        n = self[key] = len(self)
        self.new.append(key)
        return n

    def of(self, keys: list) -> tuple[np.ndarray, list]:
        """The numbers of ``keys``, and which of them are new."""
        which = np.fromiter(map(self.__getitem__, keys), np.int64, len(keys))
        new, self.new = self.new, []
        return which, new


class ChunkIds:
    """Ids of chunks, looked up in one flat array."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.short_way = WordEnds(file) if WordEnds.suits(file) else lambda word: None
        self._clear()

    def _clear(self) -> None:
        self.number = Numbers()
        self.flat, self.used = np.zeros(1 << 16, dtype=np.uint32), 0
        self.starts, self.lengths = np.zeros(1 << 14, dtype=np.int64), np.zeros(1 << 14, dtype=np.int64)

    def encode(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``chunks`` in turn, and how many each chunk has."""
        if len(self.number) > MAX_CHUNKS:
            self._clear()
        which, new = self.number.of(chunks)
        known = len(self.number) - len(new)
        for at in range(0, len(new), 4096):
            part = [c.decode() for c in new[at : at + 4096]]
            ids = list(map(self.short_way, part))
            rest = [i for i, x in enumerate(ids) if x is None]
            for i, e in zip(rest, self.tokenizer.encode_batch_fast([part[i] for i in rest], add_special_tokens=False), strict=True):
                ids[i] = e.ids
            self._add(known + at, ids)
        lengths = self.lengths[which]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        source = np.arange(total) + np.repeat(self.starts[which] - (ends - lengths), lengths)
        return self.flat[source], lengths

    def _add(self, first: int, ids: list[list[int]]) -> None:
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(sizes.sum())
        self.flat, self.starts, self.lengths = _room(self.flat, self.used + total), _room(self.starts, first + len(ids)), _room(self.lengths, first + len(ids))
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(ids), np.uint32, total)
        self.lengths[first : first + len(ids)] = sizes
        self.starts[first : first + len(ids)] = self.used + np.cumsum(sizes) - sizes
        self.used += total


def _room(array: np.ndarray, size: int) -> np.ndarray:
    if size <= len(array):
        return array
    out = np.zeros(max(size, 2 * len(array)), dtype=array.dtype)
    out[: len(array)] = array
    return out


_LOADED: dict[str, ChunkIds] = {}


def chunk_ids(path: str) -> ChunkIds:
    """This worker's table for the tokenizer file at ``path``."""
    if path not in _LOADED:
        _LOADED[path] = ChunkIds(path)
    return _LOADED[path]


def spaced_words(text: str) -> list[bytes]:
    """Chunks of tokenizers that drop white space and never match across it: runs without ASCII white space, in UTF-8."""
    return text.encode("utf-8", "replace").split()
