"""Vector similarity: exact search, an inverted file of k-means cells, and navigable graphs per block of rows."""

from __future__ import annotations

import io
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import SqlBindingError

METRICS = ("euclidean", "cosine", "dot")
#: Recall that the default number of probed cells reaches on sampled queries; above the 0.9 asked for, as samples vary.
RECALL = 0.95
#: Most cells of an inverted file; the centres are fitted on the driver from a bounded sample.
MOST_CELLS = 2048
#: Queries that one pass over the rows answers; rows and pairs that are scored at once; queries that walk a graph together.
ASKED, SCORED_ROWS, SCORED_PAIRS, WALKS = 4096, 2048, 1 << 16, 64


def similarity(vector: Column, query: list[float], metric: str) -> Column:
    """Higher is nearer: minus the Euclidean distance, the cosine, or the inner product; in double."""
    q = F.lit([float(x) for x in query])
    add = lambda values: F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)
    dot = add(F.zip_with(vector, q, lambda a, b: a.cast("double") * b))
    if metric == "dot":
        return dot
    if metric == "cosine":
        norm = F.sqrt(add(F.transform(vector, lambda a: a.cast("double") * a.cast("double"))))
        return dot / (norm * math.sqrt(sum(float(x) ** 2 for x in query)))
    return 0.0 - F.sqrt(add(F.zip_with(vector, q, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b))))


def checked_query(query: list[float]) -> list[float]:
    if not query or not np.isfinite(query).all() or not np.any(query):
        raise SqlBindingError("a query vector needs finite numbers and a norm above zero")
    return [float(x) for x in query]


def exact(vectors: DataFrame, query: list[float], k: int, metric: str = "euclidean") -> DataFrame:
    """(id, score): the k nearest of ``vectors(id, vector)``, ties by id. One pass; each task keeps k rows."""
    return vectors.select("id", similarity(F.col("vector"), checked_query(query), metric).alias("score")).orderBy(F.desc("score"), "id").limit(k)


class _Best:
    """The k best rows of each of many queries, among those offered so far, ties by id.

    Products in bulk only exclude rows that are surely too far; what remains is scored row by row, so that equal vectors
    have equal scores wherever they stand.
    """

    def __init__(self, queries: np.ndarray, k: int, metric: str) -> None:
        self.q, self.k, self.metric = queries, k, metric
        self.square = (queries**2).sum(1)
        self.of, self.score, self.ids = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.least = np.full(len(queries), -np.inf)

    def rows(self, ids: np.ndarray, v: np.ndarray, asking: np.ndarray | None = None) -> None:
        """Offers rows to the queries with the numbers ``asking``, by default to all."""
        asking = np.arange(len(self.q)) if asking is None else asking
        for lo in range(0, len(v), SCORED_ROWS):
            part, at = v[lo : lo + SCORED_ROWS], ids[lo : lo + SCORED_ROWS]
            square = (part**2).sum(1)
            for start in range(0, len(asking), SCORED_ROWS):
                who = asking[start : start + SCORED_ROWS]
                near = self.q[who] @ part.T
                slack = 1e-9 * (self.square[who] + square.max())
                least = self.least[who]
                if self.metric == "euclidean":
                    near = 2 * near - square - self.square[who, None]
                    least = np.where(least == -np.inf, -np.inf, -(least**2))
                elif self.metric == "cosine":
                    near /= np.sqrt(self.square[who, None] * square)
                    slack[:] = 1e-9
                if len(part) > self.k:
                    least = np.maximum(least, np.partition(near, len(part) - self.k, axis=1)[:, len(part) - self.k])
                i, j = np.nonzero(near >= (least - slack)[:, None])
                self.pairs(who[i], at[j], part, j)

    def pairs(self, of: np.ndarray, ids: np.ndarray, v: np.ndarray, at: np.ndarray) -> None:
        """Offers single rows, ``v[at]``, to single queries."""
        score = np.empty(len(of))
        for lo in range(0, len(of), SCORED_PAIRS):
            q, x = self.q[of[lo : lo + SCORED_PAIRS]], v[at[lo : lo + SCORED_PAIRS]]
            if self.metric == "euclidean":
                score[lo : lo + SCORED_PAIRS] = 0.0 - np.sqrt(((x - q) ** 2).sum(1))
            else:
                norm = np.sqrt((x**2).sum(1)) * np.sqrt(self.square[of[lo : lo + SCORED_PAIRS]]) if self.metric == "cosine" else 1.0
                score[lo : lo + SCORED_PAIRS] = (x * q).sum(1) / norm
        of, score, ids = np.concatenate([self.of, of]), np.concatenate([self.score, score]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -score, of))
        order = order[np.arange(len(of)) - np.searchsorted(of[order], of[order]) < self.k]
        self.of, self.score, self.ids = of[order], score[order], ids[order]
        many = np.bincount(self.of, minlength=len(self.q))
        full = many >= self.k
        self.least[full] = self.score[np.cumsum(many)[full] - 1]

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.of), pa.array(self.ids), pa.array(self.score)], names=["query", "id", "score"])


_FOUND = "query long, id long, score double"


def _merged(parts: DataFrame, k: int) -> DataFrame:
    """(query, id, score): the k best of what tasks found, a list per query and task."""
    best = F.struct((0.0 - F.col("score")).alias("worse"), "id")
    top = parts.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(best)), 1, k).alias("top"))
    return top.select("query", F.explode("top").alias("t")).select("query", F.col("t.id").alias("id"), (0.0 - F.col("t.worse")).alias("score"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def exact_many(vectors: DataFrame, queries: np.ndarray, k: int, metric: str = "euclidean") -> DataFrame:
    """(query, id, score): ``exact`` for each row of ``queries``, known by its number, in one pass over ``vectors(id, vector)``."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(queries, k, metric)
        for batch in batches:
            best.rows(batch.column("id").to_numpy(), _matrix(batch.column("vector")))
        yield best.batch()

    return _merged(vectors.select(F.col("id").cast("long").alias("id"), "vector").mapInArrow(scored, _FOUND), k)


def check_collection(vectors: DataFrame) -> None:
    """Refuses repeated ids and vectors that are not finite, of zero norm or of different lengths."""
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists("vector", lambda x: x != 0)
    row = vectors.agg(F.count(F.when(F.col("vector").isNull() | bad, 1)), F.min(F.size("vector")), F.max(F.size("vector"))).first()
    if row[0] or row[1] != row[2]:
        raise SqlBindingError("vectors must be finite, not zero and of one length")
    if vectors.groupBy("id").count().where("count > 1").limit(1).count():
        raise SqlBindingError("vector ids must be unique")


def kmeans(points: np.ndarray, k: int, seed: int = 41, rounds: int = 25) -> np.ndarray:
    """Centres by Lloyd's rounds from a k-means++ start; an empty cell takes the point farthest from its centre."""
    rng = np.random.default_rng(seed)
    centres = points[[int(rng.integers(len(points)))]]
    gap = ((points - centres[0]) ** 2).sum(1)
    while len(centres) < k:
        centres = np.vstack([centres, points[int(rng.choice(len(points), p=gap / gap.sum())) if gap.sum() > 0 else int(rng.integers(len(points)))]])
        gap = np.minimum(gap, ((points - centres[-1]) ** 2).sum(1))
    for _ in range(rounds):
        cell, gap = np.empty(len(points), dtype=int), np.empty(len(points))
        for lo in range(0, len(points), 4096):
            part = points[lo : lo + 4096]
            distance = (part**2).sum(1)[:, None] - 2 * part @ centres.T + (centres**2).sum(1)
            cell[lo : lo + 4096], gap[lo : lo + 4096] = distance.argmin(1), distance.min(1)
        new = np.array([points[cell == c].mean(0) if (cell == c).any() else points[gap.argmax()] for c in range(k)])
        if np.allclose(new, centres):
            break
        centres = new
    return centres


@dataclass
class IvfIndex:
    """Cells of a k-means over a bounded sample; every vector is in its nearest cell. ``rows``: (cell, id, vector).

    ``radii``: how far the farthest vector of each cell lies from its centre (for cosine: among unit vectors).
    """

    rows: DataFrame
    centres: np.ndarray
    counts: np.ndarray
    radii: np.ndarray
    metric: str
    points: np.ndarray
    chosen: dict[int, int] = field(default_factory=dict)

    @classmethod
    def build(cls, vectors: DataFrame, metric: str, cells: int | None = None, sample: int = 20_000) -> IvfIndex:
        """sample: vectors the centres are fitted on, those with the least hash of their id; all vectors are indexed."""
        n = vectors.count()
        cells = cells or min(MOST_CELLS, max(1, round(math.sqrt(n))))
        points = np.array([r["vector"] for r in vectors.orderBy(F.xxhash64("id"), "id").limit(sample).collect()], dtype=float)
        centres = kmeans(_unit(points) if metric == "cosine" else points, min(cells, len(points)))
        cosine = metric == "cosine"

        @F.pandas_udf("cell int, far double")
        def nearest(batch: pd.Series) -> pd.DataFrame:
            x = np.array(batch.tolist(), dtype=float)
            x = _unit(x) if cosine else x
            cell = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1).astype("int32")
            return pd.DataFrame({"cell": cell, "far": np.sqrt(((x - centres[cell]) ** 2).sum(1))})

        rows = vectors.select(nearest("vector").alias("at"), "id", "vector")
        counts, radii = np.zeros(len(centres), dtype=int), np.zeros(len(centres))
        for r in rows.groupBy("at.cell").agg(F.count(F.lit(1)).alias("n"), F.max("at.far").alias("far")).collect():  # one row per cell
            counts[r["cell"]], radii[r["cell"]] = r["n"], r["far"]
        return cls(rows.select("at.cell", "id", "vector"), centres, counts, radii, metric, points)

    def save(self, path: str) -> IvfIndex:
        """Partitioned by cell: a search reads only the cells it probes."""
        self.rows.repartition("cell").write.partitionBy("cell").parquet(path)
        return IvfIndex(self.rows.sparkSession.read.parquet(path), self.centres, self.counts, self.radii, self.metric, self.points)

    def _order(self, q: np.ndarray) -> np.ndarray:
        """Cells in the order in which a query probes them."""
        q = q / np.linalg.norm(q) if self.metric == "cosine" else q
        near = -(self.centres @ q) if self.metric == "dot" else ((self.centres - q) ** 2).sum(1)
        return np.argsort(near, kind="stable")

    def probes(self, k: int, asked: int = 200) -> int:
        """The fewest cells that hold ``RECALL`` of the k nearest sampled vectors of sampled ones, themselves left out.

        Where the sample is not the whole table its k nearest lie farther than the table's, so this errs towards more cells.
        """
        x = _unit(self.points) if self.metric == "cosine" else self.points
        k = min(k, len(x) - 1)
        if k < 1:
            return 1
        square = (x**2).sum(1)
        cell = np.concatenate([((self.centres**2).sum(1) - 2 * x[lo : lo + 4096] @ self.centres.T).argmin(1) for lo in range(0, len(x), 4096)])
        places = []
        for i in np.unique(np.linspace(0, len(x) - 1, min(asked, len(x))).astype(int)):
            far = -(x @ x[i]) if self.metric == "dot" else square - 2 * (x @ x[i])
            far[i] = np.inf
            place = np.empty(len(self.centres), dtype=int)
            place[self._order(self.points[i])] = np.arange(len(self.centres))
            places.append(place[cell[np.argpartition(far, k - 1)[:k]]])
        return int(np.quantile(np.concatenate(places), RECALL, method="higher")) + 1

    def _probed(self, q: np.ndarray, k: int, probe: int | None) -> np.ndarray:
        """The nearest cells, by default as many as ``RECALL`` needs, more if they hold too few."""
        order = self._order(q)
        if not probe and k not in self.chosen:
            self.chosen[k] = self.probes(k)
        held = np.cumsum(self.counts[order])
        return order[: max(min(probe or self.chosen[k], len(order)), int(np.searchsorted(held, min(k, held[-1]))) + 1)]

    def _in_cells(self, cells: np.ndarray) -> DataFrame:
        return self.rows.where(F.col("cell").isin([int(c) for c in cells])).select("id", "vector")

    def search(self, query: list[float], k: int, probe: int | None = None) -> DataFrame:
        """Scores the vectors of the probed cells exactly; neighbours in other cells are missed."""
        cells = self._probed(np.array(checked_query(query)), k, probe)
        return exact(self._in_cells(cells), query, k, self.metric)

    def _bounds(self, q: np.ndarray) -> np.ndarray:
        """The score that no vector of a cell exceeds, by the triangle inequality and the cell's radius."""
        q = q / np.linalg.norm(q) if self.metric == "cosine" else q
        size, reach = np.linalg.norm(q), np.linalg.norm(self.centres, axis=1) + self.radii
        slack = 1e-9 * (size + reach)  # far above what rounding can add
        if self.metric == "dot":
            return self.centres @ q + size * (self.radii + slack) + slack
        gap = np.maximum(np.linalg.norm(self.centres - q, axis=1) - self.radii - slack, 0.0)
        return 0.0 - gap if self.metric == "euclidean" else 1 - gap**2 / 2 + slack

    def search_exactly(self, query: list[float], k: int) -> DataFrame:
        """The k nearest of all: after the probed cells, also those that can hold a vector as near as the k-th found."""
        n, least = self.search(query, k).agg(F.count(F.lit(1)), F.min("score")).first()
        bounds = self._bounds(np.array(checked_query(query)))
        return exact(self._in_cells(np.flatnonzero((self.counts > 0) & (bounds >= (least if n >= k else -np.inf)))), query, k, self.metric)

    def search_many(self, queries: np.ndarray, k: int, probe: int | None = None) -> DataFrame:
        """(query, id, score): ``search`` for each row of ``queries``, known by its number, in one pass over the cells."""
        asks = np.zeros((len(self.centres), len(queries)), dtype=bool)
        for i, q in enumerate(queries):
            asks[self._probed(np.array(checked_query(q.tolist())), k, probe), i] = True
        asks, metric = np.packbits(asks, axis=1), self.metric

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = _Best(queries, k, metric)
            for batch in batches:
                cell, ids, v = batch.column("cell").to_numpy(), batch.column("id").to_numpy(), _matrix(batch.column("vector"))
                for c in np.unique(cell):
                    here = np.flatnonzero(cell == c)
                    best.rows(ids[here], v[here], np.flatnonzero(np.unpackbits(asks[c], count=len(queries))))
            yield best.batch()

        return _merged(self.rows.select("cell", F.col("id").cast("long").alias("id"), "vector").mapInArrow(scored, _FOUND), k)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


class Graph:
    """A hierarchical navigable small world over a block of points in Euclidean space, built in bulk.

    Each layer holds a point with a chance of 1 / m of the layer below. As a block is small, a layer's links come from exact
    neighbours by matrix products: of the ``near`` nearest points those are linked, both ways, that lie nearer to the point
    than to any linked before. A chain along the first coordinate joins what stays apart. Equal points are one node.
    """

    def __init__(self, layers: list[tuple[np.ndarray, np.ndarray]], x: np.ndarray, top: np.ndarray, of: np.ndarray) -> None:
        self.layers, self.x, self.top, self.of = layers, x, top, of

    @classmethod
    def build(cls, points: np.ndarray, m: int = 16, near: int = 48, seed: int = 17) -> Graph:
        x, of = np.unique(points, axis=0, return_inverse=True)
        height = (-np.log(1 - np.random.default_rng(seed).random(len(x))) / math.log(m)).astype(int)
        layers, nodes = [], np.arange(len(x))
        while len(nodes):
            layers.append(cls._layer(x, nodes, near, 2 * m if not layers else m))
            top, nodes = nodes, np.flatnonzero(height >= len(layers))
        return cls(layers, x, top if len(x) else nodes, of.reshape(-1))

    @staticmethod
    def _layer(x: np.ndarray, nodes: np.ndarray, near: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Links of a layer: where each node's begin, and their targets."""
        p, pairs = x[nodes], [np.stack([nodes[:-1], nodes[1:]])]  # np.unique sorts by the first coordinate
        square, k = (p**2).sum(1), min(near, len(nodes) - 1)
        for lo in range(0, len(p) if k else 0, 256):
            far = square[lo : lo + 256, None] - 2 * p[lo : lo + 256] @ p.T + square
            rows = np.arange(len(far))
            far[rows, lo + rows] = np.inf
            close = np.argpartition(far, k - 1, axis=1)[:, :k]
            close = np.take_along_axis(close, np.argsort(np.take_along_axis(far, close, 1), axis=1), 1)
            own, c = np.take_along_axis(far, close, 1), p[close]
            between = square[close][:, :, None] - 2 * np.matmul(c, c.transpose(0, 2, 1)) + square[close][:, None, :]
            kept = np.zeros((len(far), k), dtype=bool)
            for j in range(k):
                shade = np.where(kept, between[:, j, :], np.inf).min(1)
                kept[:, j] = (own[:, j] < shade) & (kept.sum(1) < most)
            pairs.append(np.stack([nodes[lo + np.nonzero(kept)[0]], nodes[close[kept]]]))
        one_way = np.hstack(pairs)
        link = np.unique(np.hstack([one_way, one_way[::-1]]), axis=1)
        return np.searchsorted(link[0], np.arange(len(x) + 1)), link[1]

    def _beam(self, q: np.ndarray, layer: int, ids: np.ndarray, width: int, step: int = 4) -> np.ndarray:
        """Per row of q up to ``width`` nodes near it, nearest first, -1 after the last, from those in its row of ``ids``.

        Of each row the nearest nodes that are still closed are opened, some at a time, until none is.
        """
        begin, target = self.layers[layer]
        n = np.int64(len(self.x))
        real, rows = ids >= 0, np.arange(len(q))[:, None]
        seen = np.zeros((len(q), n), dtype=bool)
        seen[np.broadcast_to(rows, ids.shape)[real], ids[real]] = True
        far = np.where(real, ((self.x[ids] - q[:, None]) ** 2).sum(2), np.inf)
        order = np.argsort(far, axis=1, kind="stable")
        ids, far, opened = ids[rows, order], far[rows, order], ~real[rows, order]
        while not opened.all():
            of, at = np.nonzero(~opened & (np.cumsum(~opened, axis=1) <= step))
            node = ids[of, at]
            opened[of, at] = True
            many = begin[node + 1] - begin[node]
            place = np.arange(many.sum()) + np.repeat(begin[node] - np.cumsum(many) + many, many)
            key = np.repeat(of, many) * n + target[place]
            key = np.unique(key[~seen.reshape(-1)[key]])
            seen.reshape(-1)[key] = True
            of, new = key // n, key % n
            many = np.bincount(of, minlength=len(q))
            at = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
            more, gap = np.full((len(q), many.max()), -1), np.full((len(q), many.max()), np.inf)
            more[of, at], gap[of, at] = new, ((self.x[new] - q[of]) ** 2).sum(1)
            ids, far, opened = np.hstack([ids, more]), np.hstack([far, gap]), np.hstack([opened, more < 0])
            order = np.argsort(far, axis=1, kind="stable")[:, :width]
            ids, far, opened = ids[rows, order], far[rows, order], opened[rows, order]
        return ids

    def search_many(self, q: np.ndarray, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """For each row of q places of at least k points (all, if fewer) near it; equal points come together.

        Numbers of rows, ascending, and places.
        """
        of, places = [np.zeros(0, dtype=int)], [np.zeros(0, dtype=int)]
        by_node = np.argsort(self.of, kind="stable")
        begin = np.searchsorted(self.of[by_node], np.arange(len(self.x) + 1))
        for lo in range(0, len(q) if len(self.x) else 0, WALKS):
            part = q[lo : lo + WALKS]
            ids = np.broadcast_to(self.top, (len(part), len(self.top)))
            for layer in range(len(self.layers) - 1, 0, -1):
                ids = self._beam(part, layer, ids, 4)
            ids = self._beam(part, 0, ids, max(width, k))
            who, at = np.nonzero(ids >= 0)
            node = ids[who, at]
            many = begin[node + 1] - begin[node]
            of.append(np.repeat(who + lo, many))
            places.append(by_node[np.arange(many.sum()) + np.repeat(begin[node] - np.cumsum(many) + many, many)])
        return np.concatenate(of), np.concatenate(places)

    def search(self, q: np.ndarray, k: int, width: int) -> np.ndarray:
        """``search_many`` for one point, its places in order."""
        return np.sort(self.search_many(q[None], k, width)[1])

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, top=self.top, of=self.of, x=self.x, **{f"{name}{i}": part for i, layer in enumerate(self.layers) for name, part in zip("bt", layer, strict=True)})
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> Graph:
        held = np.load(io.BytesIO(raw))
        return cls([(held[f"b{i}"], held[f"t{i}"]) for i in range(sum(name.startswith("b") for name in held))], held["x"], held["top"], held["of"])


@dataclass
class HnswIndex:
    """A graph per block of rows, built once: rows (ids, vectors, dim, graph), binary. A search asks each block and merges."""

    blocks: DataFrame
    schema: str
    metric: str

    @classmethod
    def build(cls, vectors: DataFrame, metric: str, path: str | None = None, rows_per_graph: int = 5000) -> HnswIndex:
        """With ``path`` the blocks are written and searches read them from there; else they are kept in memory and on disk.

        Rows are dealt to blocks of about ``rows_per_graph`` by their id, however the table is partitioned. Cosine searches unit vectors; inner product becomes Euclidean by one more coordinate that brings all norms of a block
        to the largest.
        """

        def made(part: pd.DataFrame) -> pd.DataFrame:
            v = np.array(part["vector"].tolist(), dtype=float)
            x = _unit(v) if metric == "cosine" else v
            if metric == "dot":
                lift = (x**2).sum(1)
                x = np.hstack([x, np.sqrt(lift.max() - lift)[:, None]])
            return pd.DataFrame({"ids": [part["id"].to_numpy("<i8").tobytes()], "vectors": [v.astype("<f8").tobytes()], "dim": [v.shape[1]], "graph": [Graph.build(x).dump()]})

        block = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-vectors.count() // rows_per_graph))))
        dealt = vectors.select(F.col("id").cast("long").alias("id"), "vector").withColumn("block", block)
        blocks = dealt.groupBy("block").applyInPandas(made, "ids binary, vectors binary, dim int, graph binary")
        if path:
            blocks.write.parquet(path)
            blocks = vectors.sparkSession.read.parquet(path)
        else:
            blocks = blocks.persist()
        return cls(blocks, f"id long, vector {vectors.schema['vector'].dataType.simpleString()}", metric)

    def _aim(self, q: np.ndarray) -> np.ndarray:
        """Queries as points of the graphs."""
        return _unit(q) if self.metric == "cosine" else np.hstack([q, np.zeros((len(q), 1))]) if self.metric == "dot" else q

    def search(self, query: list[float], k: int, width: int = 128) -> DataFrame:
        """(id, score): each block offers at least k rows near the query, which are scored exactly and merged."""
        aim = self._aim(np.array(checked_query(query))[None])[0]

        def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for ids, raw, dim, graph in zip(batch["ids"], batch["vectors"], batch["dim"], batch["graph"], strict=True):
                    at = Graph.load(graph).search(aim, k, width)
                    yield pd.DataFrame({"id": np.frombuffer(ids, "<i8")[at], "vector": list(np.frombuffer(raw, "<f8").reshape(-1, dim)[at])})

        return exact(self.blocks.mapInPandas(asked, self.schema), query, k, self.metric)

    def search_many(self, queries: np.ndarray, k: int, width: int = 128) -> DataFrame:
        """(query, id, score): ``search`` for each row of ``queries``, known by its number, in one pass over the blocks."""
        aim, metric = self._aim(np.array([checked_query(q) for q in queries.tolist()]).reshape(queries.shape)), self.metric

        def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = _Best(queries, k, metric)
            for batch in batches:
                for i in range(len(batch)):
                    ids, raw, dim, graph = (batch.column(name)[i].as_py() for name in ("ids", "vectors", "dim", "graph"))
                    of, at = Graph.load(graph).search_many(aim, k, width)
                    best.pairs(of, np.frombuffer(ids, "<i8")[at], np.frombuffer(raw, "<f8").reshape(-1, dim), at)
            yield best.batch()

        return _merged(self.blocks.mapInArrow(asked, _FOUND), k)


def recall(found: list[int], true: list[int]) -> float:
    return len(set(found) & set(true)) / len(true) if true else 1.0
