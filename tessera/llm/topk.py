"""Exact top-k by integer inner product: tiled matrix products, partial selection per tile, tree merging.

Vectors become floor(scale * x) and are packed into blocks: ``QUERY_ROWS`` queries or ``SHARD_ROWS`` candidates to a row.
Each query block meets each shard once; a tile is one matrix product, from which only k entries per query leave. A task's
share is ``GROUP_QUERIES`` query blocks against ``GROUP_SHARDS`` shards, where the tiles of a query merge; its lists are
then merged ``FAN_IN`` at a time, level by level, so no task gathers more than FAN_IN * k entries of a query. Products are taken in float32 or
float64 where the largest possible sum is exact in it, else in Python integers.

Defined cases: vectors that are null or hold null or non-finite components take no part; only vectors of equal length are
compared; a row never meets rows of its own vec_id; of repeated rows of one vec_id each is a candidate, while as queries
they are asked once each, so their answers repeat; rows with a null vec_id are neither asked nor candidates; equal scores
go to the smaller vec_id; an empty table gives an empty result; other columns are ignored. A score beyond 64 bits raises.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch

QUERY_ROWS, SHARD_ROWS, GROUP_QUERIES, GROUP_SHARDS, FAN_IN = 2048, 2048, 4, 4, 64
_OWN = -(2**63)


def quantised(vectors: DataFrame, scale: float) -> DataFrame:
    """(vec_id, dim, v) of the rows of ``vectors(vec_id, embedding)`` that take part; v holds floor(scale * x)."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    whole = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", odd))
    too_large = F.raise_error(F.concat(F.lit("vector "), F.col("vec_id").cast("string"), F.lit(" is too large for integer scores"))).cast("long")
    v = F.transform("embedding", lambda x: F.when(F.abs(x * scale) < 2.0**62, F.floor(x * scale)).otherwise(too_large))
    return whole.select("vec_id", F.size("embedding").alias("dim"), v.alias("v"))


def _pack(table: pa.Table) -> pa.Table:
    """One row of a whole block, in order of vec_id."""
    table = table.sort_by("vec_id")
    one = {name: table.column(name)[0].as_py() for name in ("dim", "block")}
    ids = table.column("vec_id").to_numpy().astype("<i8")
    return pa.table({"dim": pa.array([one["dim"]], pa.int32()), "block": pa.array([one["block"]], pa.int64()), "ids": pa.array([ids.tobytes()], pa.binary()), "m": pa.array([table.column("v").combine_chunks().flatten().to_numpy().astype("<i8").tobytes()], pa.binary())})


def tile(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per query the k best candidates: positions in ``c`` and scores, best first; a score of _OWN fills up. c_ids ascend."""
    most = int(np.abs(q).max(initial=0)) * int(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    k = min(k, len(c))
    at, score = np.zeros((len(q), k), dtype=np.int64), np.zeros((len(q), k), dtype=np.int64)
    kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else object
    right = c.astype(kind).T
    for lo in range(0, len(q), 256):
        s = q[lo : lo + 256].astype(kind) @ right
        own = q_ids[lo : lo + 256, None] == c_ids[None, :]
        s[own] = 0
        if kind is object and len(s) and max(abs(int(s.max())), abs(int(s.min()))) >= 2**63:
            raise OverflowError("a score exceeds 64 bits")
        s = s.astype(np.int64)
        s[own] = _OWN
        if most * len(c) < 2**62:  # score and place in one number: ties fall to the smaller id, and no two are equal
            key = np.where(s == _OWN, _OWN, s * len(c)) + (len(c) - 1 - np.arange(len(c)))
            best = np.argpartition(-1 - key, k - 1, axis=1)[:, :k]
            order = np.argsort(-1 - np.take_along_axis(key, best, 1), axis=1)
            best = np.take_along_axis(best, order, 1)
        else:
            best = np.argsort(-1 - s, axis=1, kind="stable")[:, :k]
        at[lo : lo + 256], score[lo : lo + 256] = best, np.take_along_axis(s, best, 1)
    return at, score


_TOP = pa.list_(pa.struct([("worse", pa.int64()), ("vec_id", pa.int64())]))


def _tiles(k: int):
    def matrix(raw: bytes, dim: int, rows: int) -> np.ndarray:
        return np.frombuffer(raw, "<i8").reshape(rows, dim)

    def rows(block: int, dim: int, group: int, ids: np.ndarray, score: np.ndarray, vec: np.ndarray) -> pa.RecordBatch:
        real = score != _OWN
        ends = np.concatenate(([0], np.cumsum(real.sum(1))))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(-1 - score[real]), pa.array(vec[real])], names=["worse", "vec_id"]))
        n = len(ids)
        # a query's place in its block tells repeated rows of one vec_id apart
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array([f"{dim}/{block}/{i}" for i in range(n)]), pa.array([group] * n, pa.int64()), lists], names=["query_id", "asked", "part", "top"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                q_ids, c_ids = np.frombuffer(r["q_ids"], "<i8"), np.frombuffer(r["ids"], "<i8")
                at, score = tile(q_ids, matrix(r["q_m"], r["dim"], len(q_ids)), c_ids, matrix(r["m"], r["dim"], len(c_ids)), k)
                vec, key = c_ids[at], (r["q_block"], r["dim"], r["part"])
                if key in held:
                    _, old_score, old_vec = held.pop(key)
                    score, vec = np.hstack([old_score, score]), np.hstack([old_vec, vec])
                    order = np.lexsort((vec, -1 - score), axis=1)[:, :k]
                    score, vec = np.take_along_axis(score, order, 1), np.take_along_axis(vec, order, 1)
                held[key] = (q_ids, score, vec)
                if len(held) > 16:
                    oldest = next(iter(held))
                    yield rows(*oldest, *held.pop(oldest))
        for key, value in held.items():
            yield rows(*key, *value)

    return run


def top_k(vectors: DataFrame, asked: Column, k: int, scale: float = 64.0, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of ``vectors`` for which ``asked`` (over column vec_id) holds."""
    source = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    rows = quantised(source, scale).withColumn("row", F.monotonically_increasing_id())
    rows = scratch.store(rows, "topk-rows")
    n = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(asked, 1)).alias("asked"))
    total = n.agg(F.max("n").alias("n"), F.max("asked").alias("asked")).first()
    shards, blocks = max(1, -(-(total["n"] or 0) // SHARD_ROWS)), max(1, -(-(total["asked"] or 0) // QUERY_ROWS))
    packed = "dim int, block long, ids binary, m binary"
    deal = lambda df, many: df.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(many))).select("vec_id", "dim", "v", "block").groupBy("dim", "block").applyInArrow(_pack, packed)
    candidates = deal(rows, shards).withColumn("part", F.floor(F.col("block") / GROUP_SHARDS)).drop("block")
    parts, sides = -(-shards // GROUP_SHARDS), -(-blocks // GROUP_QUERIES)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    queries = deal(rows.where(asked), blocks).select("dim", F.col("block").alias("q_block"), F.floor(F.col("block") / GROUP_QUERIES).alias("side"), F.col("ids").alias("q_ids"), F.col("m").alias("q_m"), every(parts).alias("part"))
    candidates = candidates.withColumn("side", every(sides))
    found = queries.join(candidates, ["dim", "part", "side"]).drop("side").mapInArrow(_tiles(k), "query_id long, asked string, part long, top array<struct<worse:bigint,vec_id:bigint>>")
    while True:
        found = found.withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy("query_id", "asked", "part").agg(F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k).alias("top"))
        if parts <= FAN_IN:
            break
        parts = -(-parts // FAN_IN)
    ranked = found.select("query_id", F.posexplode("top").alias("at", "t"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("t.vec_id").alias("vec_id"), (-1 - F.col("t.worse")).alias("score"))
