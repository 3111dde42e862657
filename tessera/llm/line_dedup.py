"""Line deduplication with overlapping three-line windows, DataFrame functions only.

Every three consecutive lines that hold a word form a window (lines without one are stepped over). Windows are hashed to
128 bits; grouping by hash gives each repeated window its first place in the corpus, by doc_id and then line number. All
later occurrences are removed: the lines they cover, and the wordless lines between those, are cut out of the text by
keeping the gaps between covered ranges. Counting is a partial aggregate, so a window that a third of all documents share
travels once per map task; the join that marks occurrences reads plain shuffles on both sides, which adaptive execution
splits where a hash is hot. Only a document's own covered ranges are ever gathered in one row.

Defined cases: a null text stays null and an empty one empty; texts with under three worded lines have no window and stay
as they are; null doc_ids come last in the order; rows that agree in doc_id and text count as one document, and all get
that document's result; an empty table gives an empty result; other columns are carried through unchanged.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import spare

WINDOW = 3
#: Has a character outside the white space of ``text.WORD_SQL``.
_WORDED = r"[^\x20\x09-\x0D]"


def _place(doc_id: Column, text_hash: Column, line: Column) -> Column:
    """One sortable number for (doc_id with nulls last, text, line), so that the minimum is a hash aggregate."""
    doc = F.coalesce(doc_id.cast("decimal(20,0)"), F.lit(Decimal(2**63)).cast("decimal(20,0)"))
    low = F.shiftrightunsigned(text_hash, 33).cast("decimal(10,0)")
    return ((doc * F.lit(2**31).cast("decimal(10,0)") + low).cast("decimal(33,0)") * F.lit(2**31).cast("decimal(10,0)") + line.cast("decimal(10,0)")).cast("decimal(38,0)")


def _with_windows(docs: DataFrame, lines: str, worded: str) -> DataFrame:
    """Adds the lines of column ``text`` and the numbers (from 0) of those that hold a word."""
    split = docs.withColumn(lines, F.split("text", "\n", -1))
    numbered = F.transform(F.col(lines), lambda line, i: F.when(line.rlike(_WORDED), i))
    return split.withColumn(worded, F.filter(numbered, lambda i: i.isNotNull()))


def _windows(docs: DataFrame) -> DataFrame:
    """A row per window: document (id, text hash), first and last line, two hashes."""
    d = _with_windows(docs.select("doc_id", "text"), "lines", "worded")
    at = lambda i: F.col("lines")[F.col("worded")[i]]
    three = lambda i: [at(i + k) for k in range(WINDOW)]
    found = F.transform(
        F.sequence(F.lit(0), F.size("worded") - WINDOW),
        lambda i: F.struct(F.col("worded")[i].alias("first_line"), F.col("worded")[i + WINDOW - 1].alias("last_line"), F.xxhash64(*three(i)).alias("h1"), F.xxhash64(F.lit("line window"), *three(i)).alias("h2")),
    )
    rows = d.where(F.size("worded") >= WINDOW).select("doc_id", F.xxhash64("text").alias("text_hash"), F.explode(found).alias("w"))
    return rows.select("doc_id", "text_hash", "w.*")


def removals(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, ranges): the line ranges each document loses, in order; documents that lose none are absent."""
    windows = _windows(docs)
    place = _place(F.col("doc_id"), F.col("text_hash"), F.col("first_line"))
    firsts = windows.groupBy("h1", "h2").agg(F.min(place).alias("first_place"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    later = windows.join(firsts, ["h1", "h2"]).where(place > F.col("first_place"))
    # set, not list: rows repeated in full bring each range more than once
    return later.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(F.struct("first_line", "last_line"))).alias("ranges"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` cut, and with n_lines and n_removed_lines (long) added unless it has columns so named in any case."""
    text_hash, ranges, other_hash, other_id, lines = spare(docs, "__h", "__ranges", "__h2", "__id2", "__lines")
    cut = removals(docs).select(F.col("doc_id").alias(other_id), F.col("text_hash").alias(other_hash), F.col("ranges").alias(ranges))
    keyed = docs.withColumn(text_hash, F.xxhash64("text"))
    joined = keyed.join(cut, F.col(text_hash).eqNullSafe(F.col(other_hash)) & docs["doc_id"].eqNullSafe(F.col(other_id)), "left").drop(other_hash, other_id)
    r, all_lines = F.col(ranges), F.col(lines)
    length = lambda a, b: F.greatest(b - a, F.lit(0))
    gap = lambda x, i: F.slice(all_lines, x["last_line"] + 2, length(x["last_line"] + 1, F.coalesce(F.get(r, i + 1)["first_line"], F.size(all_lines))))
    kept = F.flatten(F.concat(F.array(F.slice(all_lines, 1, r[0]["first_line"])), F.transform(r, gap)))
    (kept_name,) = spare(joined, "__kept")
    joined = joined.withColumn(lines, F.split("text", "\n", -1)).withColumn(kept_name, F.when(r.isNull(), all_lines).otherwise(kept))
    columns = [F.when(r.isNull(), F.col("text")).otherwise(F.array_join(F.col(kept_name), "\n")).alias("text") if c == "text" else F.col(c) for c in docs.columns]
    counts = [F.coalesce(F.size(lines).cast("long"), F.lit(0)).alias("n_lines"), F.coalesce((F.size(lines) - F.size(kept_name)).cast("long"), F.lit(0)).alias("n_removed_lines")]
    return joined.select(*columns, *[c for c, name in zip(counts, ("n_lines", "n_removed_lines"), strict=True) if name not in [c.lower() for c in docs.columns]])


def cut_documents(docs: DataFrame) -> DataFrame:
    """``dedup_lines`` with the columns of ``docs``; n_chars, if there, follows the text."""
    cut = dedup_lines(docs)
    return cut.select(*[F.char_length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])
