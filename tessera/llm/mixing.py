"""Mixing sources to target weights with a low-discrepancy schedule.

1. Targets: sources in code point order (null last) get weights 3, 1, 2, repeating; ``SHARE`` times all words are shared by
   weight, a source stops at ``MOST`` times its size and its excess is shared again by weight (water filling).
2. Schedule: slot i of ``BLOCK`` words lies at the golden-ratio point of i; the cumulated targets tell whose slot it is.
   There are as many slots as the targets together fill, and a source gets those that fall to it: it is within a few
   blocks of its target (``DEVIATION``), not on it. Slots are ranked per source.
3. Documents of a source are shuffled by a hash of their id and laid end to end, ``MOST`` times. Cut into equal blocks,
   block number r joins the slot of rank r. A document is taken as often and as far as its blocks have slots; slots past
   the end of a source stay empty.

Sizes, not texts, are shuffled for the schedule; ``mix`` then sends each distinct row's text through one shuffle to the
places it takes, and through a second one if the corpus is to lie in order of slots. Sources and chunks of slots or
documents have a row each; a source that holds a third of all rows is ranked in chunks (``ranks.running``).

Defined cases: null text counts as no words; a document without words, or in a source without words, is taken 0 times;
null is a source of its own; repeated rows are documents of their own; null ids are shuffled like any other value; ties of
the hash are settled by id, size and a hash of the whole row; rows equal in all columns are copies of one another (by 64
bits of hash beside doc_id); an empty table gives an empty result;
other columns are ignored by ``taken`` and carried through by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch
from .ranks import beside, running, spread
from .text import spare, word_count

WEIGHTS = (3, 1, 2)
SHARE_HALVES = 3  # 150 %
MOST = 2
BLOCK = 64
#: Blocks by which a source may miss its target: the points' discrepancy, which grows with the logarithm of their number
#: (below 5 at any of the first 2 ** 21 slots, for 60 random shares).
DEVIATION = 8
#: 2 ** 32 divided by the golden ratio: slot i lies at i * GOLDEN mod 2 ** 32. 2 ** 32 slots hit each point once, then begin again.
GOLDEN, POINTS = 2654435769, 2**32
SLOT_CHUNK, CELLS = 1 << 16, 1 << 10


def order_hash(doc_id: Column) -> tuple[Column, Column]:
    """The shuffle: md5 of the id as text, and its first 32 bits as a number."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return digest, F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) for rows (source, size). One row per source goes through single-task windows, which stream and spill."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    weighted = per.withColumn("weight", F.element_at(F.lit(list(WEIGHTS)), ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("int")).cast("double"))
    cap = F.col("source_size") * MOST
    # Sources by the water level at which they are full; before each: what the full ones hold, and who still shares.
    level = Window.partitionBy(F.lit(0)).orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    after = level.rowsBetween(0, Window.unboundedFollowing)
    everyone = Window.partitionBy(F.lit(0))
    held, sharing = F.coalesce(F.sum(cap).over(before), F.lit(0)), F.sum("weight").over(after)
    total = F.sum("source_size").over(everyone) * SHARE_HALVES / F.lit(2.0)
    staged = weighted.select("source", "source_size", "weight", ((total - held) / sharing).alias("if_next_is_open"), (cap / F.col("weight")).alias("full_at"))
    # The level is that of the first source which stays open under it; taking later ones for open too gives lower values.
    water = F.max(F.when(F.col("if_next_is_open") <= F.col("full_at"), F.col("if_next_is_open"))).over(everyone)
    return staged.select("source", "source_size", F.least(F.coalesce(water * F.col("weight"), cap.cast("double")), cap.cast("double")).alias("target"))


def point(slot: Column) -> Column:
    """slot * GOLDEN mod 2 ** 32, without leaving 64 bits."""
    low, high = slot % 2**16, F.floor(slot / 2**16) % 2**16
    return (low * GOLDEN + high * (GOLDEN * 2**16 % POINTS)) % POINTS


def slots(of_sources: DataFrame) -> DataFrame:
    """(slot, source, rank): the schedule over (source, source_size, target). Ranks of a source count from 0 without gaps."""
    spark = of_sources.sparkSession
    wanted = of_sources.select("source", "target").where("target > 0")
    n = int(-(-(wanted.agg(F.sum("target")).first()[0] or 0) // BLOCK))
    upto = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    share = F.sum("target").over(upto) / F.sum("target").over(Window.partitionBy(F.lit(0)))
    ends = wanted.withColumn("hi", F.least(F.round(share * POINTS).cast("long"), F.lit(POINTS)))
    ends = ends.withColumn("lo", F.lag("hi", 1, 0).over(Window.partitionBy(F.lit(0)).orderBy("hi"))).where("hi > lo")
    wide = POINTS // CELLS
    cells = ends.select("source", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / wide), F.floor((F.col("hi") - 1) / wide))).alias("cell"))
    points = spark.range(n).select(F.col("id").alias("slot"), point(F.col("id")).alias("point"))
    owned = points.withColumn("cell", F.floor(F.col("point") / wide)).join(cells, "cell").where("point >= lo and point < hi")
    owned = owned.select("slot", "source", F.floor(F.col("slot") / SLOT_CHUNK).alias("chunk"))
    return running(owned, ["source"], "chunk", ["slot"], {"rank": (F.lit(1), "long")}).select("slot", "source", "rank")


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a hash of the whole row, and its name."""
    (name,) = spare(docs, "__row")
    return docs.withColumn(name, F.xxhash64(*[docs[c] for c in docs.columns])), name


def pieces(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The mix, and the documents it is made of.

    First (source, start, pass, doc_id, row, size, slot, slots, words): the document that starts at ``start`` in its
    source is taken in a pass over the source; from the block of ``slot`` on its first ``words`` words, in ``slots`` slots.
    Then the documents: doc_id, row, size, source, source_size, target, start. Those with words are told apart by (source, start).
    """
    keyed, name = _keyed(docs)
    sizes = scratch.store(keyed.select("doc_id", "source", F.col(name).alias("row"), word_count(docs["text"]).alias("size")), "mix-sizes")
    by_source = scratch.store(targets(sizes), "mix-sources")
    digest, number = order_hash(F.col("doc_id"))
    chunked = sizes.withColumn("__md5", digest).withColumn("__chunk", spread(number, sizes.count()))
    laid = running(chunked, ["source"], "__chunk", ["__md5", "doc_id", "size", "row"], {"start": (F.col("size"), "long")}).drop("__md5", "__chunk")
    placed = scratch.store(beside(laid, by_source, ["source"]), "mix-placed")
    passes = placed.where("size > 0").select("source", "start", "size", "doc_id", "row", "source_size", F.explode(F.lit([*range(MOST)])).alias("pass"))
    lo = F.col("start") + F.col("pass") * F.col("source_size")
    runs = passes.select("source", "start", "pass", "size", "doc_id", "row", lo.alias("lo"), (lo + F.col("size")).alias("hi"))
    cut = runs.select("*", F.explode(F.sequence(F.floor(F.col("lo") / BLOCK), F.floor((F.col("hi") - 1) / BLOCK))).alias("rank"))
    words = F.least("hi", (F.col("rank") + 1) * BLOCK) - F.greatest("lo", F.col("rank") * BLOCK)
    met = beside(cut, slots(by_source), ["source", "rank"])
    got = met.groupBy("source", "start", "pass", "doc_id", "row", "size").agg(F.min("slot").alias("slot"), F.count(F.lit(1)).alias("slots"), F.sum(words).alias("words"))
    return got, placed


def taken(docs: DataFrame) -> DataFrame:
    """Per row of ``docs(doc_id, text, source)``: size, source_size, target of its source, words taken, repeats counted, and its first slot and number of slots."""
    got, placed = pieces(docs)
    per = got.groupBy("source", "start").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"), F.sum("slots").alias("slots"))
    joined = beside(placed, per, ["source", "start"], "left")
    counted = lambda name: F.when(F.col("size") > 0, F.coalesce(name, F.lit(0))).otherwise(0).cast("long").alias(name)
    return joined.select("doc_id", "size", "source_size", "target", counted("taken"), F.when(F.col("size") > 0, F.col("first_slot")).alias("first_slot"), counted("slots"))


def mix(docs: DataFrame, ordered: bool = True, slot: str | None = None) -> DataFrame:
    """The mixed corpus with the columns of ``docs``: a row for each time a document is taken, whole or its first words.

    ordered: rows lie in order of their first slots; else in any order, which saves a shuffle. slot: adds the first slot
    under this name. The slots of a source cover its stream from the start on, so a pass over a document takes a prefix
    of it; the words of a prefix are joined by single spaces. n_chars follows the text.
    """
    got, _ = pieces(docs)
    keyed, name = _keyed(docs)
    take, size, first, held = spare(keyed, "__take", "__size", "__slot", "__held")
    plan = got.select(F.col("row").alias(f"{name}_p"), F.col("doc_id").alias(f"{name}_d"), F.col("words").alias(take), F.col("size").alias(size), F.col("slot").alias(first))
    # One of each row that repeats: it goes to all places that its repeats take.
    one = keyed.groupBy(name, "doc_id").agg(F.first(F.struct(*docs.columns)).alias(held)).select(name, F.col("doc_id").alias(f"{name}_i"), held)
    rows = one.join(plan, (F.col(name) == F.col(f"{name}_p")) & F.col(f"{name}_i").eqNullSafe(F.col(f"{name}_d")))
    rows = rows.select(*[F.col(held)[c].alias(c) for c in docs.columns], take, size, first)
    words = F.split(F.btrim("text", F.lit(" \t\n\x0b\f\r")), r"[\x20\x09-\x0D]+")
    text = F.when(F.col(take) == F.col(size), F.col("text")).otherwise(F.array_join(F.slice(words, F.lit(1), F.col(take).cast("int")), " "))
    out = rows.withColumn("text", text)
    out = out.orderBy(first) if ordered else out
    kept = [F.char_length("text").cast(docs.schema["n_chars"].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return out.select(*kept, *([F.col(first).alias(slot)] if slot else []))
