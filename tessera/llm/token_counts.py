"""Exact token counts at every prefix of a text, for byte-level BPE.

The encoding of a prefix of a BPE piece ends in the one token whose pair with the last token of the shorter prefix is left
alone by BPE; so ``last[i]`` and ``count[i] = count[i - len(last[i])] + 1`` follow by dynamic programming, one pass over the
piece. A text is dealt into chunks at spaces that follow a non-space, where pre-tokenization always breaks; a chunk's counts
are computed once per Python worker and chunk. The count at a prefix of a text is the sum over the chunks before plus the
chunk's own entry: truncation and budget questions are answered by search, without encoding again.

Defined cases: null counts as empty, with 0 tokens; ``doc_id`` is carried, so nulls and repeats are kept row by row; an
empty table gives an empty result; other columns are ignored. A chunk whose characters this machine's and the tokenizer's
Unicode tables may class differently takes its pieces, and which characters are white space, from the tokenizer's own
pre-tokenization. A special string is one token between two chunks. Only a file whose special strings strip white space,
want word borders or contain each other has chunks with such a string encoded anew at each prefix.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import slices
from .tokens import Numbers, _room, byte_characters

#: The pre-tokenization pattern of byte-level BPE files with ``use_regex`` (fixed values of that format).
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_CONTRACTIONS = {"'s", "'t", "'re", "'ve", "'m", "'ll", "'d"}
MAX_CHUNKS, MAX_COUNTS, MAX_PREFIXES = 500_000, 8_000_000, 500_000
#: Prefixes of pieces are remembered up to so many bytes.
KNOWN = 24
#: Words of up to half so many characters are counted by whole arrays.
WIDE = 32
_RUN_THEN_SPACE = re.compile(r"\s ")
_PLAIN = re.compile(r"[\x00-\x1b\x20-\u024f\u2010-\u2027]*\Z")


class NumberTable:
    """A hash table from non-zero 64-bit keys to numbers of at least 0, looked up and filled by whole arrays."""

    def __init__(self, bits: int = 12) -> None:
        self.bits, self.n = bits, 0
        self.keys, self.values = np.zeros(1 << bits, dtype=np.uint64), np.zeros(1 << bits, dtype=np.int32)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of the keys, -1 where there is none."""
        slot, out, left = self._home(keys), np.full(len(keys), -1, dtype=np.int32), np.arange(len(keys))
        while len(left):
            at = slot[left]
            there = self.keys[at]
            hit = there == keys[left]
            out[left[hit]] = self.values[at[hit]]
            left = left[~hit & (there != 0)]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Different keys that aren't in the table yet."""
        if 3 * (self.n + len(keys)) > 1 << self.bits:
            old, kept = self.keys != 0, self
            bigger = NumberTable(max(self.bits + 1, int(3 * (self.n + len(keys))).bit_length()))
            bigger.add(kept.keys[old], kept.values[old])
            self.bits, self.keys, self.values = bigger.bits, bigger.keys, bigger.values
        slot, left = self._home(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            at, first = np.unique(slot[free], return_index=True)
            self.keys[at], self.values[at] = keys[free[first]], values[free[first]]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
        self.n += len(keys)


class PrefixCounts:
    """Counts at every prefix of chunks, for one tokenizer file."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        if file["normalizer"] or file["pre_tokenizer"].get("type") != "ByteLevel" or file["pre_tokenizer"].get("add_prefix_space") or not file["pre_tokenizer"].get("use_regex", True):
            raise ValueError("a byte-level BPE file without normalizer is needed")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t["content"] for t in file["added_tokens"]]
        self.by_library = any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in file["added_tokens"]) or any(a in b for a in self.special for b in self.special if a != b)
        self.spaces: dict[str, bool] = {" ": True}
        to_byte = byte_characters()
        raw = lambda token: bytes(map(to_byte.__getitem__, token))
        merges = [m.split(" ") if isinstance(m, str) else m for m in file["model"]["merges"]]
        self.rank = {bytes([b]): b for b in range(256)}
        for left, right in merges:
            self.rank.setdefault(raw(left) + raw(right), len(self.rank))
        self.longest = max(map(len, self.rank))
        self.bytes_of = {v: k for k, v in self.rank.items()}
        self.suffix_lengths = self._suffix_lengths()
        # The same for whole arrays: tokens by hash and length, and by their last two bytes a bit per possible length.
        self.tokens = NumberTable()
        raws = [*self.rank]
        self.tokens.add(np.array([_token_key(np.uint64(_text_hash(t)), len(t)) for t in raws]), np.array([self.rank[t] for t in raws]))
        self.sizes = np.zeros(1 << 16, dtype=np.uint64)
        for end, sizes in self.suffix_lengths.items():
            self.sizes[end[0] << 8 | end[1]] = sum(1 << n for n in sizes if n <= WIDE)
        self.pairs = NumberTable()
        self.bpe = tiktoken.Encoding("prefix-counts", pat_str=r"[\s\S]+", mergeable_ranks=self.rank, special_tokens={})._core_bpe
        self.fits: dict[tuple[int, int], bool] = {}
        self.prefixes: dict[bytes, tuple[list[int], list[int]]] = {}
        self._clear()

    def _suffix_lengths(self) -> dict[bytes, list[int]]:
        """By the last two bytes: the lengths tokens that end so can have, longest first."""
        out: dict[bytes, set[int]] = {}
        for token in self.rank:
            if len(token) > 1:
                out.setdefault(token[-2:], set()).add(len(token))
        return {k: sorted(v, reverse=True) for k, v in out.items()}

    def _clear(self) -> None:
        self.number = Numbers()
        self.flat, self.used = np.zeros(1 << 16, dtype=np.int32), 0
        self.starts, self.lengths, self.full = (np.zeros(1 << 14, dtype=np.int64) for _ in range(3))

    def _fit(self, left: int, right: int) -> bool:
        """Whether BPE leaves this pair of tokens as it is."""
        if len(self.fits) > 1_000_000:
            self.fits.clear()
        known = self.fits[(left, right)] = self.bpe.encode_single_piece(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return known

    def piece_counts(self, piece: bytes) -> list[int]:
        """Token counts of ``piece[:i]`` for i from 0 to its length, each prefix being one BPE piece.

        Starts from the longest prefix another piece has gone through before.
        """
        known, n = self.prefixes, len(piece)
        if len(known) > MAX_PREFIXES:
            known.clear()
        done = min(n, KNOWN)
        while done and (state := known.get(piece[:done])) is None:
            done -= 1
        if done:
            count, last = state[0][: done + 1] + [0] * (n - done), state[1][: done + 1] + [-1] * (n - done)
        else:
            count, last = [0] * (n + 1), [-1] * (n + 1)
        rank, fits, lengths = self.rank, self.fits, self.suffix_lengths
        for i in range(done + 1, n + 1):
            for size in (*lengths.get(piece[i - 2 : i] if i > 1 else b"", ()), 1):
                if size > i or (token := rank.get(piece[i - size : i])) is None:
                    continue
                if size != i:
                    fit = fits.get((last[i - size], token))
                    if fit is None:
                        fit = self._fit(last[i - size], token)
                    if not fit:
                        continue
                count[i], last[i] = count[i - size] + 1, token
                break
        state = (count[: KNOWN + 1], last[: KNOWN + 1])  # a long piece is not kept whole
        for i in range(done + 1, min(n, KNOWN) + 1):
            known[piece[:i]] = state
        return count

    def _fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``_fit`` for arrays of pairs."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | (right.astype(np.uint64) + np.uint64(1))
        out = self.pairs.find(keys)
        if (new := np.unique(keys[out < 0])).size:
            if self.pairs.n > 2_000_000:
                self.pairs = NumberTable()
            known = [self.bpe.encode_single_piece(self.bytes_of[k >> 32] + self.bytes_of[(k & 0xFFFFFFFF) - 1]) == [k >> 32, (k & 0xFFFFFFFF) - 1] for k in new.tolist()]
            self.pairs.add(new, np.array(known, dtype=np.int32))
            out = self.pairs.find(keys) if self.pairs.n == len(new) else np.where(out < 0, self.pairs.find(keys), out)
        return out > 0

    def many_counts(self, pieces: list[bytes]) -> np.ndarray:
        """``piece_counts`` of pieces of at most ``WIDE`` bytes, a row each; longest pieces first."""
        n, sizes = len(pieces), np.fromiter(map(len, pieces), np.int64, len(pieces))
        wide = int(sizes.max(initial=0))
        text = np.frombuffer(b"".join(p.ljust(wide, b"\0") for p in pieces), np.uint8).reshape(n, wide)
        h = np.zeros((wide + 1, n), dtype=np.uint64)
        count, last = np.zeros((wide + 1, n), dtype=np.int32), np.full((wide + 1, n), -1, dtype=np.int32)
        one = np.array([self.rank[bytes([b])] for b in range(256)], dtype=np.int32)
        for i in range(1, wide + 1):
            m = int(np.searchsorted(-sizes, -i, "right"))  # pieces that reach so far
            byte = text[:m, i - 1]
            h[i, :m] = h[i - 1, :m] * np.uint64(_BASE) + byte + np.uint64(1)
            open_ = np.ones(m, dtype=bool)
            possible = self.sizes[text[:m, i - 2].astype(np.int64) << 8 | byte] if i > 1 else np.zeros(m, np.uint64)
            for size in range(i, 0, -1):
                row = np.flatnonzero(open_ & ((possible >> np.uint64(size)) & np.uint64(1)).astype(bool)) if size > 1 else np.flatnonzero(open_)
                if not len(row):
                    continue
                if size > 1:
                    token = self.tokens.find(_token_key(h[i, row] - h[i - size, row] * _POWERS[size], size))
                    row, token = row[token >= 0], token[token >= 0]
                else:
                    token = one[byte[row]]
                if size < i:
                    good = self._fits(last[i - size, row], token)
                    row, token = row[good], token[good]
                count[i, row], last[i, row] = count[i - size, row] + 1, token
                open_[row] = False
        return count.T

    def _word_counts(self, chunks: list[str], marked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts at the ends of characters of words; marked ones have one more character, which is a token of its own.

        Returns the order in which the chunks stand, the counts of all in turn, and how many each has.
        """
        raw = [c.encode() for c in chunks]
        order = np.argsort([-len(r) for r in raw], kind="stable")
        raw, marked = [raw[k] for k in order], marked[order]
        counts, sizes = self.many_counts(raw), np.fromiter(map(len, raw), np.int64, len(raw))
        counts = np.hstack([counts, np.zeros((len(raw), 1), np.int32)])
        at = np.arange(1, counts.shape[1])
        text = np.frombuffer(b"".join(r.ljust(len(at), b"\0") for r in raw), np.uint8).reshape(len(raw), len(at))
        following = np.hstack([text[:, 1:], np.zeros((len(raw), 1), np.uint8)])
        ends = (at <= sizes[:, None]) & (following & 0xC0 != 0x80)
        row = np.flatnonzero(marked)
        counts[row, sizes[row] + 1] = counts[row, sizes[row]] + 1
        ends[row, sizes[row]] = True
        return order, counts[:, 1:][ends], ends.sum(1)

    def chunk_counts(self, chunk: str) -> list[int]:
        """Token counts of ``chunk[:k]`` for k from 1 to its length in characters."""
        out: list[int] = []
        base = 0
        if any(s in chunk for s in self.special):
            if self.by_library:
                return self._by_library(chunk)
            done = 0
            for m in re.finditer("|".join(map(re.escape, self.special)), chunk):
                before = m.start() - done
                counts = [0, *self._plain_counts(chunk[done : m.end() - 1])]  # until its end, a special string is text
                out += [base + n for n in counts[1:]]
                base += counts[before] + 1
                out.append(base)
                done = m.end()
            return out + [base + n for n in self._plain_counts(chunk[done:])]
        return self._plain_counts(chunk)

    def _pieces(self, chunk: str) -> tuple[list[str], list[bool]]:
        """The pieces of a chunk without special strings, and which are white space."""
        if _PLAIN.match(chunk):
            pieces = [m.group() for m in PIECE.finditer(chunk)]
            return pieces, [p.isspace() for p in pieces]
        split = self.library.pre_tokenizer.pre_tokenize_str
        pieces = [chunk[a:b] for _, (a, b) in split(chunk)]
        for c in {p[-1] for p in pieces} - self.spaces.keys():
            self.spaces[c] = len(split(f"!{c}{c}!")) == 4  # one piece if a sign, three if a letter or number
        return pieces, [self.spaces[p[-1]] for p in pieces]

    def _plain_counts(self, chunk: str) -> list[int]:
        """``chunk_counts`` of a chunk without special strings."""
        out: list[int] = []
        base = 0
        pieces, space = self._pieces(chunk)
        k = 0
        while k < len(pieces):
            piece = pieces[k]
            if space[k] and k + 1 < len(pieces):  # a prefix inside a run of white space takes all of it as one piece
                run = piece
                while k + 1 < len(pieces) and space[k + 1]:
                    k += 1
                    run += pieces[k]
                lead = k + 1 < len(pieces) and pieces[k + 1][0] == " "
                whole = self._characters(run + " " if lead else run)
                inside = whole[: len(run)]
                out += [base + n for n in inside]
                base += (whole[len(run) - 1] if lead else (whole[len(run) - 2] if len(run) > 1 else 0) + self._characters(run[-1])[-1])
            elif piece in _CONTRACTIONS:
                quote = self._characters("'")[0]
                out += [base + quote, *(base + quote + n for n in self._characters(piece[1:-1]))]
                base += self._characters(piece)[-1]
                out.append(base)
            else:
                own = self._characters(piece)
                out += [base + n for n in own]
                base += own[-1]
            k += 1
        return out

    def _characters(self, piece: str) -> list[int]:
        """``piece_counts`` at the ends of characters."""
        raw = piece.encode()
        counts = self.piece_counts(raw)
        if len(raw) == len(piece):
            return counts[1:]
        return [counts[k] for k in range(1, len(raw)) if raw[k] & 0xC0 != 0x80] + counts[-1:]

    def _by_library(self, chunk: str) -> list[int]:
        return [len(e.ids) for at in range(1, len(chunk) + 1, 256) for e in self.library.encode_batch_fast([chunk[:k] for k in range(at, min(at + 256, len(chunk) + 1))], add_special_tokens=False)]

    def look_up(self, chunks: list[str]) -> np.ndarray:
        """Numbers of the chunks in the tables ``full``, ``starts`` and ``lengths``. A first chunk is written "\\0" + chunk."""
        if len(self.number) > MAX_CHUNKS or self.used > MAX_COUNTS:
            self._clear()
        which, new = self.number.of(chunks)
        if new:
            self._fill([c[1:] if c[:1] == "\0" else " " + c for c in new])
        return which

    def _fill(self, new: list[str]) -> None:
        """Append the counts of new chunks to the tables: words all at once, the others one by one."""
        words, marked, at_word, others = [], [], [], []
        for n, chunk in enumerate(new):
            mark = chunk[-1:] in (".", ",")
            bare = chunk[:-1] if mark else chunk
            if len(bare) <= WIDE // 2 and bare.lstrip(" ").isalpha() and bare.rfind(" ") <= 0 and _PLAIN.match(bare):
                words.append(bare)
                marked.append(mark)
                at_word.append(n)
            else:
                others.append(n)
        sizes = np.zeros(len(new), dtype=np.int64)
        lists = [self.chunk_counts(new[n]) for n in others]
        sizes[others] = [len(x) for x in lists]
        if words:
            order, counts, many = self._word_counts(words, np.array(marked))
            place = np.array(at_word)[order]
            sizes[place] = many
        first, total = len(self.number) - len(new), int(sizes.sum())
        starts = self.used + np.cumsum(sizes) - sizes
        self.flat = _room(self.flat, self.used + total)
        self.starts, self.lengths, self.full = (_room(x, len(self.number)) for x in (self.starts, self.lengths, self.full))
        if words:
            self.flat[np.repeat(starts[place] - (np.cumsum(many) - many), many) + np.arange(len(counts))] = counts
        for n, x in zip(others, lists, strict=True):
            self.flat[starts[n] : starts[n] + len(x)] = x
        self.used += total
        self.starts[first : len(self.number)], self.lengths[first : len(self.number)] = starts, sizes
        self.full[first : len(self.number)] = np.where(sizes > 0, self.flat[np.maximum(starts + sizes - 1, 0)], 0)

    def index(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per text: its chunks, and the token count before each and at the end."""
        split = [split_chunks(t) for t in texts]
        which = self.look_up([c for chunks in split for c in chunks])
        out, at = [], 0
        for chunks in split:
            mine = which[at : at + len(chunks)]
            out.append((mine, np.concatenate(([0], np.cumsum(self.full[mine])))))
            at += len(chunks)
        return out

    def at_every_prefix(self, text: str) -> np.ndarray:
        """Token counts of ``text[:k]`` for k from 0 to its length. The part before a chunk's own space is that chunk's first entry."""
        ((mine, before),) = self.index([text])
        parts = [before[i] + self.flat[self.starts[c] : self.starts[c] + self.lengths[c]] for i, c in enumerate(mine)]
        return np.concatenate([[0], *parts]).astype(np.int64)

    def longest_within(self, mine: np.ndarray, before: np.ndarray, limit: int) -> int:
        """Characters of the longest prefix of at most ``limit`` tokens, of a text given by ``index``."""
        if before[-1] <= limit:
            return int(self.lengths[mine].sum())
        last = int(np.searchsorted(before, limit))  # the first chunk at or after which no prefix fits
        for i in range(min(last, len(mine) - 1), -1, -1):
            c = mine[i]
            fits = np.flatnonzero(before[i] + self.flat[self.starts[c] : self.starts[c] + self.lengths[c]] <= limit)
            if len(fits):
                return int(self.lengths[mine[:i]].sum() + fits[-1] + 1)
        return 0


_BASE = 0x100000001B3
_POWERS = np.array([pow(_BASE, n, 2**64) for n in range(34)], dtype=np.uint64)


def _text_hash(raw: bytes) -> int:
    """A polynomial over the bytes, whose value for a part follows from those for two prefixes."""
    h = 0
    for b in raw:
        h = (h * _BASE + b + 1) % 2**64
    return h


def _token_key(h: np.ndarray, size: int) -> np.ndarray:
    return h ^ np.uint64(size * 0xD6E8FEB86659FD93 % 2**64)


def split_chunks(text: str) -> list[str]:
    """Chunks of a text, without their leading spaces; the first is marked by a leading NUL."""
    if not text:
        return []
    if not _RUN_THEN_SPACE.search(text) and text[0] != " ":
        first, *rest = text.split(" ")
    else:  # a space that follows white space starts no chunk
        cuts = [m.start() + 1 for m in re.finditer(r"\S ", text)]
        parts = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
        first, rest = parts[0], [p[1:] for p in parts[1:]]
    # A chunk that itself begins with NUL must not pass for a marked one.
    return ["\0" + first, *rest] if not any(c[:1] == "\0" for c in rest) else ["\0" + text]


_LOADED: dict[str, PrefixCounts] = {}


def prefix_counts(path: str) -> PrefixCounts:
    """This worker's tables for the tokenizer file at ``path``."""
    if path not in _LOADED:
        _LOADED[path] = PrefixCounts(path)
    return _LOADED[path]


def _count_udf(path: str, limit: int):
    @F.arrow_udf(T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("n_chars_within", T.LongType())]))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = prefix_counts(path)
        for texts in batches:
            totals, within = [], []
            for part in slices(texts, 2_000_000):
                for mine, before in table.index(part):
                    totals.append(int(before[-1]))
                    within.append(table.longest_within(mine, before, limit))
            yield pa.StructArray.from_arrays([pa.array(totals, pa.int64()), pa.array(within, pa.int64())], names=["n_tokens", "n_chars_within"])

    return run.asNondeterministic()


def _index_udf(path: str):
    @F.arrow_udf(T.ArrayType(T.LongType()))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = prefix_counts(path)
        for texts in batches:
            yield pa.array([table.at_every_prefix(t) for part in slices(texts, 2_000_000) for t in part], pa.list_(pa.int64()))

    return run.asNondeterministic()


def with_prefix_counts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, counts): tokens of each text's prefix of k characters at place k."""
    return docs.select("doc_id", _index_udf(path)("text").alias("counts"))


def count_tokens(docs: DataFrame, path: str, limit: int) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, n_chars_within): the last is the longest prefix of at most ``limit`` tokens."""
    c = F.col("__c")
    n_bytes = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    rows = docs.select("doc_id", n_bytes.alias("n_bytes"), _count_udf(path, limit)("text").alias("__c"))
    return rows.select("doc_id", "n_bytes", c["n_tokens"].alias("n_tokens"), (c["n_tokens"] > limit).alias("over_limit"), c["n_chars_within"].alias("n_chars_within"))
