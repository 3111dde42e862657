"""Passages for question answering: balanced chunks, BM25 retrieval, labelled context, citation check."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .errors import SqlBindingError
from .operators.text import TextIndex

# Words of a chunk, passages of an answer, characters of a question.
MINIMUM, TARGET, MAXIMUM, TOP, QUESTION = 200, 250, 500, 3, 4096
ROW_BYTES = 4079


def chunks(papers: DataFrame, id_column: str, text_column: str, row_bytes: int | None = ROW_BYTES, overhead: int = 64, refuse: bool = True) -> DataFrame:
    """(paper id, position from 1, content): chunks of nearly equal word counts, about ``TARGET`` each.

    A text is cut into more parts, of ``MINIMUM`` words at least, as long as a part has more than ``row_bytes - overhead``
    bytes; without ``row_bytes`` words alone decide. Texts below ``MINIMUM`` words, and texts that no such cut fits, raise an
    error; without ``refuse`` they give one row instead, with position 0 and no content.
    """
    words = F.filter(F.split(F.col(text_column), r"\s+"), lambda w: w != "")
    base = papers.select(F.col(id_column).alias("paper_id"), F.coalesce(words, F.array().cast("array<string>")).alias("w"))
    total = F.size("w")
    top = F.floor(total / MINIMUM).cast("int")
    first = F.least(F.greatest(F.floor(total / TARGET + 0.5), F.ceil(total / MAXIMUM)), top).cast("int")

    def parts(count: Column) -> Column:
        size, extra = F.floor(total / count).cast("int"), (total % count).cast("int")
        return F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.array_join(F.slice("w", k * size + F.least(k, extra) + 1, size + F.when(k < extra, 1).otherwise(0)), " "))

    fitted = base.withColumn("c", F.greatest(first, F.lit(0)))
    if row_bytes is not None:
        too_long = lambda n: F.exists(parts(n), lambda p: F.octet_length(p) > row_bytes - overhead)
        # Further counts are tried only for texts whose first count fails, from the least that the bytes allow, until one fits.
        least = F.greatest(F.col("c") + 1, F.ceil(F.octet_length(F.array_join("w", " ")) / (row_bytes - overhead)).cast("int"))
        more = F.when(least <= top, F.sequence(least, top)).otherwise(F.array().cast("array<int>"))
        other = F.aggregate(more, F.lit(0), lambda found, n: F.when(found > 0, found).when(~too_long(n), n).otherwise(0))
        fitted = fitted.withColumn("c", F.when(F.col("c") < 1, 0).when(~too_long(F.col("c")), F.col("c")).otherwise(other))
    if refuse:
        why = F.when(total < MINIMUM, F.lit(f"a text needs {MINIMUM} words")).otherwise(F.lit("no cut fits a row"))
        fitted = fitted.withColumn("c", F.when(F.col("c") > 0, F.col("c")).otherwise(F.raise_error(why).cast("int")))
    cut = F.when(F.col("c") > 0, parts(F.greatest("c", F.lit(1)))).otherwise(F.array(F.lit(None).cast("string")))
    placed = fitted.select("paper_id", "c", F.posexplode(cut).alias("at", "content"))
    return placed.select("paper_id", F.when(F.col("c") > 0, F.col("at") + 1).otherwise(0).cast("long").alias("position"), "content")


def retrieve(index: TextIndex, chunk_rows: DataFrame, papers: DataFrame, question: str, top: int = TOP) -> DataFrame:
    """(label, chunk_id, paper columns, position, content, score) of the best passages; no rows if no word is known."""
    question = question.strip()
    if not 1 <= len(question) <= QUESTION:
        raise SqlBindingError(f"a question has 1 to {QUESTION} characters")
    hits = index.search(question, "BM25", top).withColumnRenamed("id", "chunk_id")
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id"))  # at most ``top`` rows
    labelled = hits.withColumn("label", F.concat(F.lit("S"), rank))
    return labelled.join(chunk_rows, "chunk_id").join(papers, "paper_id").orderBy(F.desc("score"), "chunk_id")


def citations(answer: str, labels: list[str]) -> list[str]:
    """Labels an answer cites, in order; unknown ones are refused."""
    cited = list(dict.fromkeys(re.findall(r"\[(S\d+)\]", answer)))
    unknown = [c for c in cited if c not in labels]
    if unknown or not cited:
        raise SqlBindingError(f"unknown citations: {', '.join(unknown)}" if unknown else "the answer cites nothing")
    return cited
