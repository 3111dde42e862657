"""Packing token pieces into sequences, planned on a histogram of lengths.

Texts are tokenized once into a table of pieces (no token ids in it). A count per length, at most ``LIMIT`` rows, goes to
the driver, which plans best-fit decreasing over counts: from the longest length down, pieces go to the sequences with
the least room that still fits, whole groups of alike sequences at a time. The plan is a list of runs: ranks ``lo`` to
``hi`` of a length take the places first, first + 1, ... Pieces then find their place by joining on their rank within their
length. Ranks are made in chunks (``ranks.running``), so a length that a third of all pieces have is ranked by many tasks;
runs are cut at ranks of ``CELL`` so that the join has an equality on (length, rank // CELL).

Defined cases: null and empty texts are the single id ``END``; a text longer than ``LIMIT`` is cut into pieces of ``LIMIT``
and a rest; repeated rows are documents of their own; pieces that agree in length, id, piece number and content are
interchangeable; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scratch
from .ranks import beside, running, spread
from .text import slices
from .tokens import chunk_ids, spaced_words

LIMIT, END = 2048, 0
CELL = 1 << 16

_PIECES = T.ArrayType(T.StructType([T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]))


def pieces_of(ids: np.ndarray, limit: int = LIMIT) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32 of the little-endian unsigned 32-bit ids) of one document's ids."""
    raw = memoryview(np.ascontiguousarray(ids, dtype="<u4")).cast("B")
    return [(k, at, min(limit, len(ids) - at), zlib.crc32(raw[4 * at : 4 * (at + limit)])) for k, at in enumerate(range(0, len(ids), limit))]


def _tokenize(path: str, limit: int):
    @F.arrow_udf(_PIECES)
    def pieces(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = chunk_ids(path)
        for texts in batches:
            out = []
            for part in slices(texts, 2_000_000):
                words = [spaced_words(t) for t in part]
                ids, lengths = table.encode([w for ws in words for w in ws])
                ends = np.concatenate(([0], np.cumsum(lengths)))[np.cumsum([0, *map(len, words)])]
                for lo, hi in zip(ends[:-1], ends[1:], strict=True):
                    out.append([dict(zip(("piece", "start", "length", "ids_crc32"), p, strict=True)) for p in pieces_of(np.append(ids[lo:hi], np.uint32(END)), limit)])
            yield pa.array(out, type=_ARROW_PIECES)

    return pieces.asNondeterministic()


_ARROW_PIECES = pa.list_(pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]))


def tokenize(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) for all rows of ``docs(doc_id, text)``; ``path``: a tokenizer file on every machine."""
    return docs.select("doc_id", F.explode(_tokenize(path, limit)("text")).alias("p")).select("doc_id", "p.*")


def plan(counts: dict[int, int], limit: int = LIMIT) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best-fit decreasing over counts. Returns runs and the number of sequences.

    A run (length, lo, hi, sequence, each, offset) says: the piece of rank r in [lo, hi) goes to sequence
    ``sequence + (r - lo) // each``, at ``offset + (r - lo) % each * length``.
    """
    runs: list[tuple[int, int, int, int, int, int]] = []
    room: list[list[tuple[int, int]]] = [[] for _ in range(limit + 1)]  # groups of sequences (first, number) by room left
    made = 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        free = length
        while left:
            while free <= limit and not room[free]:
                free += 1
            if free > limit:
                each = limit // length
                opened = -(-left // each)
                room[limit].append((made, opened))
                made += opened
                free = limit
            first, number = room[free].pop()
            each = free // length
            full = min(number, left // each)
            if full:
                runs.append((length, rank, rank + full * each, first, each, limit - free))
                room[free - each * length].append((first, full))
                rank, left = rank + full * each, left - full * each
            if full < number:
                if left and left < each:  # the last pieces of this length share one sequence
                    runs.append((length, rank, rank + left, first + full, each, limit - free))
                    room[free - left * length].append((first + full, 1))
                    left, full = 0, full + 1
                if full < number:
                    room[free].append((first + full, number - full))
    return runs, made


def pack(pieces: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``pieces`` with sequence_id and offset (long). Reads it several times: pass a stored table."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most LIMIT rows
    runs, _ = plan(counts, limit)
    schema = "length long, cell long, lo long, hi long, sequence long, each long, place long"
    cells = [(length, c, lo, hi, s, e, o) for length, lo, hi, s, e, o in runs for c in range(lo // CELL, (hi - 1) // CELL + 1)]
    planned = pieces.sparkSession.createDataFrame(cells, schema)
    keyed = pieces.withColumn("__chunk", spread(F.pmod(F.xxhash64("doc_id", "piece"), F.lit(2**32)), sum(counts.values())))
    ranked = running(keyed, ["length"], "__chunk", ["doc_id", "piece", "ids_crc32"], {"__rank": (F.lit(1), "long")})
    placed = beside(ranked.withColumn("cell", F.floor(F.col("__rank") / CELL)), planned, ["length", "cell"]).where("__rank >= lo and __rank < hi")
    step = F.col("__rank") - F.col("lo")
    return placed.select(*pieces.columns, (F.col("sequence") + F.floor(step / F.col("each"))).alias("sequence_id"), (F.col("place") + step % F.col("each") * F.col("length")).alias("offset"))


def pack_documents(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """Tokenize and pack all rows of ``docs(doc_id, text)``."""
    return pack(scratch.store(tokenize(docs, path, limit), "pack-pieces"), limit)
