"""Bags of words over local descriptors: a vocabulary of centres, histograms of nearest words, TF-IDF vectors.

A descriptor table has a row per descriptor: (id of its object, vector). Decoding media into descriptors is left to the user.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import SqlBindingError
from .vectors import kmeans

# Fixed value: most descriptors a vocabulary is fitted on.
SAMPLE = 100_000


def check_descriptors(descriptors: DataFrame, dim: int | None = None) -> None:
    """Refuses an empty table, and vectors that are null, not finite or not all of one length (``dim``, if given)."""
    bad = F.col("id").isNull() | F.col("vector").isNull() | F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    row = descriptors.agg(F.count(F.when(bad, 1)), F.min(F.size("vector")), F.max(F.size("vector"))).first()
    if row[1] is None or row[0] or row[1] != row[2] or row[1] < 1 or dim not in (None, row[1]):
        raise SqlBindingError("descriptors must exist, be finite and of one length, that of the vocabulary")


def vocabulary(descriptors: DataFrame, size: int, sample: int = SAMPLE, seed: int = 41) -> np.ndarray:
    """``size`` words: centres of a k-means over the ``sample`` descriptors of least hash, all if there are fewer."""
    if type(size) is not int or size < 1:
        raise SqlBindingError("a vocabulary needs a whole number of words above zero")
    check_descriptors(descriptors)
    rows = descriptors.select("vector").orderBy(F.xxhash64("id", "vector"), "id").limit(sample)
    points = np.array([r["vector"] for r in rows.collect()], dtype=float)
    if len(np.unique(points, axis=0)) < size:
        raise SqlBindingError(f"fewer than {size} different descriptors for as many words")
    return kmeans(points, size, seed).astype(np.float32)


def nearest_words(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The word nearest to each descriptor by Euclidean distance, the lower of equally near ones."""
    best, word = np.full(len(x), np.inf), np.zeros(len(x), dtype="int32")
    for j, centre in enumerate(centres):  # differences, not products: equal words are equally far to the last bit
        far = ((x - centre) ** 2).sum(1)
        near = far < best
        best[near], word[near] = far[near], j
    return word


@dataclass
class Features:
    """counts (id, word, n) of the words an object has; the vocabulary, objects in all, and objects with each word."""

    counts: DataFrame
    centres: np.ndarray
    n: int
    df: np.ndarray

    @classmethod
    def build(cls, descriptors: DataFrame, centres: np.ndarray, path: str | None = None) -> Features:
        """With ``path`` the counts are written, so that descriptors meet the vocabulary once."""
        centres = np.asarray(centres, dtype=float)
        check_descriptors(descriptors, centres.shape[1])

        @F.pandas_udf("int")
        def word(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                yield pd.Series(nearest_words(np.array(batch.tolist(), dtype=float).reshape(len(batch), -1), centres))

        counts = descriptors.select("id", word("vector").alias("word")).groupBy("id", "word").agg(F.count(F.lit(1)).alias("n"))
        if path:
            counts.write.parquet(path)
            counts = descriptors.sparkSession.read.parquet(path)
        df = np.zeros(len(centres), dtype=int)
        for r in counts.groupBy("word").agg(F.count(F.lit(1)).alias("df")).collect():  # one row per word
            df[r["word"]] = r["df"]
        return cls(counts, centres, counts.select("id").distinct().count(), df)

    @property
    def idf(self) -> np.ndarray:
        return 1 + np.log((self.n + 1) / (self.df + 1))

    def weights(self) -> DataFrame:
        """(id, word, n, weight): the words of each object with their TF-IDF weights, (1 + ln n) * idf."""
        idf = F.lit([float(x) for x in self.idf])
        return self.counts.withColumn("weight", (1 + F.log("n")) * F.element_at(idf, F.col("word") + 1))

    def vectors(self) -> DataFrame:
        """(id, vector) as vector search takes it: a weight per word of the vocabulary, 0 for words an object lacks."""
        held = self.weights().groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("word", "weight"))).alias("w"))
        every = F.sequence(F.lit(0), F.lit(len(self.centres) - 1))
        return held.select("id", F.transform(every, lambda j: F.coalesce(F.try_element_at("w", j), F.lit(0.0)).cast("float")).alias("vector"))

    def query(self, descriptors: list[list[float]]) -> list[float]:
        """The vector of one more object, by the words and weights of the collection."""
        x = np.array(descriptors, dtype=float)
        if x.ndim != 2 or x.shape[1] != self.centres.shape[1] or not np.isfinite(x).all():
            raise SqlBindingError("descriptors must be finite and as long as those of the vocabulary")
        n = np.bincount(nearest_words(x, self.centres), minlength=len(self.centres))
        tf = np.where(n > 0, 1 + np.log(np.maximum(n, 1)), 0.0)
        return [float(w) for w in (tf * self.idf).astype(np.float32)]
