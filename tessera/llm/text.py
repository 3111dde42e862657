"""Words and tables shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a longest run of characters outside these: space and U+0009 to U+000D.
WORD_SQL = r"[^\x20\x09-\x0D]+"
_SPACES = " \t\n\x0b\f\r"

#: Texts handed to numpy at once hold about this many characters and are at most so many; a longer text goes alone.
SLICE_CHARS, SLICE_TEXTS = 4_000_000, 1 << 15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """The text from its first word to its last; null counts as empty."""
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(_SPACES))


def word_count(text: Column) -> Column:
    """Number of words, JVM-side; null counts as empty."""
    trimmed = words_of(text)
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")


def slices(texts: pa.Array, limit: int = SLICE_CHARS) -> Iterator[list[str]]:
    """Cut an Arrow array of texts into lists of about ``limit`` bytes each; null texts become empty."""
    if not len(texts):
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        base = ends[start - 1] if start else 0
        stop = min(start + SLICE_TEXTS, max(start + 1, int(np.searchsorted(ends, base + limit, "right"))))
        yield [t or "" for t in texts.slice(start, stop - start).to_pylist()]
        start = stop


def spare(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have yet (names differ without regard to case)."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out
