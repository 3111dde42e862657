"""Ranked full text: an index of postings, TF-IDF cosine and BM25."""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DuplicateError

# Fixed values of BM25.
K1, B = 1.2, 0.75
#: A table below this size is dealt over all cores before its texts are split.
SMALL_BYTES = 1 << 30


def words(text: Column) -> Column:
    """Runs of letters and digits, lower case, JVM-side; for text in composed form (NFC)."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


@F.arrow_udf(T.ArrayType(T.StringType()))
def _exact(texts: pa.Array) -> pa.Array:
    return pa.array([query_words(t or "") for t in texts.to_pylist()], pa.list_(pa.string()))


def query_words(text: str) -> list[str]:
    """The same for any text: composed, lowered, composed again, then runs of alphanumeric characters."""
    text = unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).lower())
    return "".join(c if c.isalnum() else " " for c in text).split()


def _dealt(table: DataFrame) -> DataFrame:
    """``table``, dealt over all cores if it is so small that it may lie in a single row group."""
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return table.repartition(table.sparkSession.sparkContext.defaultParallelism) if size < SMALL_BYTES else table


@dataclass
class TextIndex:
    """postings (id, term, tf), documents (id, length, norm), lexicon (term, df), and the number of documents.

    The norm is that of all TF-IDF weights of a document. Documents without words count in n and the mean length only.
    """

    postings: DataFrame
    documents: DataFrame
    lexicon: DataFrame
    n: int

    @classmethod
    def build(cls, table: DataFrame, id_column: str, text_column: str, exact: bool = False, path: str | None = None) -> TextIndex:
        """With ``path`` the tables are written, so that texts are split once and queries start from the tables.

        Postings are sorted by term: a query reads the row groups of its words only. Repeated ids are refused.
        """
        spark = table.sparkSession
        ids = table.groupBy(F.col(id_column).alias("id")).agg(F.count(F.lit(1)).alias("n"))
        n, most = ids.agg(F.sum("n"), F.max("n")).first()
        if (most or 0) > 1:
            raise DuplicateError(f"{id_column} names several documents {ids.where('n > 1').first()['id']}")
        source = _dealt(table.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")))
        split = _exact(F.col("text")) if exact else words(F.coalesce(F.col("text"), F.lit("")))
        postings = source.select("id", F.explode(split).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
        if path:
            postings.repartitionByRange("term").sortWithinPartitions("term", "id").write.parquet(f"{path}/postings")
            postings = spark.read.parquet(f"{path}/postings")
        lexicon = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        weight = (1 + F.log("tf")) * (1 + F.log(F.lit((n or 0) + 1.0) / (F.col("df") + 1)))
        if path:
            lexicon.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/lexicon")
            lexicon = spark.read.parquet(f"{path}/lexicon")
        documents = postings.join(lexicon, "term").groupBy("id").agg(F.sum("tf").alias("length"), F.sqrt(F.sum(weight * weight)).alias("norm"))
        if path:
            documents.write.parquet(f"{path}/documents")
            documents = spark.read.parquet(f"{path}/documents")
        return cls(postings, documents, lexicon, n or 0)

    @cached_property
    def mean_length(self) -> float:
        total = self.documents.agg(F.sum("length")).first()[0] or 0
        return total / self.n if self.n else 0.0

    def search(self, query: str, model: str, limit: int | None = None) -> DataFrame:
        """(id, score) of the documents with a word of the query, best first, then by id."""
        terms = Counter(query_words(query))
        found = {r["term"]: r["df"] for r in self.lexicon.where(F.col("term").isin([*terms])).collect()} if terms else {}  # at most the query's words
        known = self.postings.where(F.col("term").isin([*found]))
        df = F.col("df").cast("double")
        rows = self.postings.sparkSession.createDataFrame([(t, terms[t], d) for t, d in found.items()], "term string, qtf long, df long")
        hits = known.join(F.broadcast(rows), "term").join(self.documents, "id")  # the query's words
        if model == "BM25":
            idf = F.log(1 + (self.n - df + 0.5) / (df + 0.5))
            part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / max(self.mean_length, 1e-300)))
            scored = self._sum(hits, part)
        else:
            idf = 1 + F.log(F.lit(self.n + 1.0) / (df + 1))
            q = lambda tf: (1 + F.log(tf)) * idf
            length = math.sqrt(sum(((1 + math.log(terms[t])) * (1 + math.log((self.n + 1) / (d + 1)))) ** 2 for t, d in found.items())) or 1.0
            scored = self._sum(hits, q(F.col("tf")) * q(F.col("qtf")) / (F.col("norm") * length))
        return scored.orderBy(F.desc("score"), "id").limit(limit) if limit is not None else scored.orderBy(F.desc("score"), "id")

    @staticmethod
    def _sum(hits: DataFrame, part: Column) -> DataFrame:
        """Parts of a document added in order of term, so that equal documents have equal scores."""
        parts = hits.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("term", part.alias("x")))).alias("p"))
        return parts.select("id", F.aggregate("p", F.lit(0.0), lambda acc, p: acc + p["x"]).alias("score"))
