"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles, banded, verified.

1. Weights. A shingle is five words (all words of a shorter text); its weight is tf * idf, idf = 1 + ln(N / df) / ln(N):
   2 in one text, 1 in all N, whatever N is. df is the number of different texts that hold the shingle and is counted
   for every shingle: texts are dealt into slices of ``SLICE_BYTES`` by their hash, a slice sends its distinct shingles to
   parts of the hash space, a part adds them up and answers each slice. A shingle thus crosses the shuffle once a slice.
2. Signatures. Improved consistent weighted sampling: for each of ``BANDS * ROWS`` samples and each shingle the variates
   r and c (Gamma(2, 1)) and b (uniform) come from a hash of shingle and sample; t = floor(ln w / r + b) and
   ln a = ln c - r * (t - b + 1); the sample is (shingle, t) of the least a. Two texts agree in a sample as often as their
   weighted Jaccard similarity says, whatever their lengths. r, c and b have 2 ** 16 steps each, ties fall by hash.
3. Candidates. Texts that agree in a band share a bucket.
4. Verification, by exact weighted Jaccard similarity. First the least text of each bucket meets its other texts. Where a
   bucket still holds several classes of verified links, all its texts outside its largest class meet all its texts, so no
   pair of one bucket in different classes stays unseen. Both go tile by tile (``BLOCK_LOAD`` words a side), so a
   bucket of any size is many tasks; its pairs are never rows.
5. Classes are the components of the verified links; exact copies are one text from the start.

Defined cases: null text counts as empty; equal texts (so all empty ones) form one class, wordless texts have no other
links; the class id is the least doc_id of the class, null if all are null; repeated rows stay rows; an empty table gives
an empty result; other columns are ignored by ``classes`` and carried through by ``keep_one``. Texts are identified by
64 bits of hash: among n distinct texts n * n / 2 ** 65 false copies are expected, 0.03 at a billion; shingles by 48 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch
from .components import components
from .text import slices, spare, words_of

SHINGLE, SIMILARITY = 5, 0.8
#: At a similarity of 0.8 two texts share a band with probability 1 - (1 - 0.8 ** 6) ** 20 = 0.998.
BANDS, ROWS = 20, 6
SLICE_BYTES, PART_BYTES, LEAST_PARTS = 4_000_000, 24_000_000, 256
BLOCK_LOAD, DOC_LOAD = 400_000, 200
#: Shingles and samples that are worked on at once, so that a tile stays in a core's cache.
_TILE, _SAMPLES = 4096, 8
#: Place of the more significant half of a 64-bit number among two 32-bit ones.
_HIGH = int(np.little_endian)
#: Bits for each text in the filter of texts that a step needs, and the most of them: 32 MiB.
FILTER_BITS, MOST_FILTER_BITS = 16, 1 << 28
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[str], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of at most 2 ** 16 texts, in order of text and hash: text numbers, 48-bit hashes, term frequencies."""
    import xxhash

    number: dict[bytes, int] = {}
    ids, sizes = [], np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        words = text.encode("utf-8", "replace").split()
        sizes[i] = len(words)
        ids.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)))
    if not number:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    of_word = np.fromiter(map(xxhash.xxh3_64_intdigest, number), np.uint64, len(number))
    words, doc = of_word[np.concatenate(ids)], np.repeat(np.arange(len(texts)), sizes)
    ends = np.cumsum(sizes)
    left = np.repeat(ends, sizes) - np.arange(len(words))  # words from here to the text's end
    h = np.zeros(len(words), dtype=np.uint64)
    padded = np.concatenate((words, np.zeros(width, np.uint64)))
    for k in range(width):
        h = mix(h + np.where(left > k, padded[k : k + len(words)], np.uint64(0)) + np.uint64(k + 1))
    begins = (left >= width) | ((np.arange(len(words)) == np.repeat(ends - sizes, sizes)) & (np.repeat(sizes, sizes) < width))
    key = (doc[begins].astype(np.uint64) << np.uint64(48)) | (h[begins] >> np.uint64(16))
    key.sort()
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    tf = np.diff(np.append(first, len(key)))
    return (key[first] >> np.uint64(48)).astype(np.int64), key[first] & np.uint64(2**48 - 1), tf


def _shingles_of(texts: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``shingles`` of any number of texts."""
    out, at = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))], 0
    for part in slices(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts):
        doc, h, tf = shingles(part)
        out.append((doc + at, h, tf))
        at += len(part)
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def idf(df: np.ndarray, texts: int) -> np.ndarray:
    """Weight of one occurrence of a shingle that ``df`` of ``texts`` texts hold."""
    return 1 + np.log(max(texts, 1) / df) / np.log(max(texts, 2))


def pack_df(df: np.ndarray) -> bytes:
    """A byte for each count; those from 255 on follow in full."""
    return np.minimum(df, 255).astype(np.uint8).tobytes() + df[df >= 255].astype("<i8").tobytes()


def unpack_df(raw: bytes, n: int) -> np.ndarray:
    df = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    df[df == 255] = np.frombuffer(raw, "<i8", offset=n)
    return df


def _gamma2() -> np.ndarray:
    """Quantiles of Gamma(2, 1) at the middles of 2 ** 16 equal shares: 1 - (1 + x) * exp(-x) = u, by Newton's method."""
    u = (np.arange(2**16) + 0.5) / 2**16
    x = np.where(u < 0.5, np.sqrt(2 * u), 1 - np.log(1 - u))
    for _ in range(60):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - u) / (x * np.exp(-x)), x / 2)
    return x


_R = _gamma2().astype(np.float32)
#: Raised by 64, so that every ln a is above zero and its bits rise with it.
_LN_C = (np.log(_gamma2()) + 64).astype(np.float32)
_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def signatures(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Samples [texts, BANDS * ROWS], and which texts have any; doc ascends, weight is the whole weight of a shingle in its text."""
    best = np.full((texts, BANDS * ROWS), np.uint64(2**64 - 1))
    key = mix(h + np.uint64(0x632BE59BD9B4E019))
    log_weight = (np.round(np.log(weight) * 4096) / 4096).astype(np.float32)
    low, step = np.uint64(0xFFFF), np.float32(1 / 2**16)
    pair = np.empty((_SAMPLES, _TILE, 2), dtype=np.uint32)
    for at in range(0, len(h), _TILE):
        of, item, ln_w = doc[at : at + _TILE], key[at : at + _TILE], log_weight[at : at + _TILE]
        starts = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        rows = of[starts]
        for s in range(0, BANDS * ROWS, _SAMPLES):
            x = item * _SEEDS[s : s + _SAMPLES, None]
            x ^= x >> np.uint64(32)
            x *= _M1
            x ^= x >> np.uint64(29)
            r = _R.take((x & low).view(np.int64), mode="clip")
            ln_c = _LN_C.take((x >> np.uint64(48)).view(np.int64), mode="clip")
            b = x.astype(np.uint32)  # the low half
            name = (x >> np.uint64(24)).astype(np.uint32)
            b >>= np.uint32(16)
            b = b.astype(np.float32)
            b += np.float32(0.5)
            b *= step
            t = ln_w / r
            t += b
            np.floor(t, out=t)
            name += t.astype(np.int32).view(np.uint32) * np.uint32(0x9E3779B1)
            t -= b
            t += np.float32(1)
            t *= r
            ln_c -= t
            here = pair[: len(x), : len(of)]
            here[:, :, _HIGH], here[:, :, 1 - _HIGH] = ln_c.view(np.uint32), name
            found = np.minimum.reduceat(pair.view(np.uint64)[: len(x), : len(of), 0], starts, axis=1)
            best[rows, s : s + _SAMPLES] = np.minimum(best[rows, s : s + _SAMPLES], found.T)
    has = np.zeros(texts, dtype=bool)
    has[doc] = True
    return best & np.uint64(0xFFFFFFFF), has


def bands(samples: np.ndarray) -> np.ndarray:
    parts = samples.reshape(len(samples), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2])
    for k in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return key.view(np.int64)


def text_id(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drops texts that this task has lately passed on, so that a text with very many copies leaves each task about once."""
    seen: set[int] = set()
    for batch in batches:
        new = []
        for i, x in enumerate(batch.column(0).to_pylist()):
            if x not in seen:
                seen.add(x)
                new.append(i)
        if len(seen) > 1 << 20:
            seen.clear()
        yield batch if len(new) == len(batch) else batch.take(pa.array(new, pa.int64()))


def _send(parts: int):
    """The distinct shingles of a slice and how many of its texts hold each, by parts of the hash space."""
    width = -(-(2**48) // parts)

    def run(table: pa.Table) -> pa.Table:
        _, h, _ = _shingles_of(table.column("text"))
        h, n = np.unique(h, return_counts=True)
        part = (h // np.uint64(width)).astype(np.int64)
        which, first = np.unique(part, return_index=True)
        ends = np.append(first[1:], len(h))
        places = (h - part.astype(np.uint64) * np.uint64(width)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
        blobs = [places[a:b].tobytes() for a, b in zip(first, ends, strict=True)]
        counts = [pack_df(n[a:b]) for a, b in zip(first, ends, strict=True)]
        return pa.table({"part": pa.array(which), "slice": pa.array([table.column("slice")[0].as_py()] * len(which), pa.int64()), "h": pa.array(blobs, pa.binary()), "n": pa.array(counts, pa.binary())})

    return run


def _answer(table: pa.Table) -> pa.Table:
    """For each slice that asks one part: the counts over all slices, in the order of its shingles."""
    blobs = table.column("h").to_pylist()
    sizes = [len(b) // 5 for b in blobs]
    places = np.zeros((sum(sizes), 8), dtype=np.uint8)
    places[:, :5] = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, 5)
    n = np.concatenate([unpack_df(raw, size) for raw, size in zip(table.column("n").to_pylist(), sizes, strict=True)])
    _, inverse = np.unique(places.view("<u8").reshape(-1), return_inverse=True)
    df = np.bincount(inverse, n).astype(np.int64)[inverse]
    return pa.table({"slice": table.column("slice"), "part": table.column("part"), "df": pa.array([pack_df(x) for x in np.split(df, np.cumsum(sizes)[:-1])], pa.binary()), "many": pa.array(sizes, pa.int64())})


def _sign(n_texts: int):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        doc, h, tf = _shingles_of(texts.column("text"))
        _, inverse = np.unique(h, return_inverse=True)
        answers = answers.sort_by("part")
        df = np.concatenate([np.zeros(0, np.int64), *(unpack_df(raw, n) for raw, n in zip(answers.column("df").to_pylist(), answers.column("many").to_pylist(), strict=True))])[inverse]
        texts_here = texts.num_rows
        samples, has = signatures(doc, h, tf * idf(df, n_texts), texts_here)
        at = np.searchsorted(doc, np.arange(texts_here + 1))
        packed = [pack_df(df[a:b]) for a, b in zip(at, at[1:], strict=False)]
        words = np.bincount(doc, tf, texts_here).astype(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(texts_here + 1, dtype=np.int32) * BANDS), pa.array(bands(samples).reshape(-1)))
        out = pa.table({"id": texts.column("id"), "n_words": pa.array(words), "df": pa.array(packed, pa.binary()), "bands": lists})
        return out.filter(pa.array(has))

    return run


def signed_texts(docs: DataFrame) -> tuple[DataFrame, int]:
    """(id, n_words, df, bands) of every distinct text of ``docs(text)`` that has words, and the number of these."""
    rows = docs.select(text_id(docs["text"]).alias("id"), docs["text"].alias("text")).where(words_of(docs["text"]) != "")
    n, size = rows.groupBy("id").agg(F.max(F.octet_length("text")).alias("n")).agg(F.count(F.lit(1)), F.sum("n")).first()
    n_slices, parts = max(1, -(-(size or 0) // SLICE_BYTES)), max(LEAST_PARTS, -(-(size or 0) // PART_BYTES))
    texts = rows.mapInArrow(_once, "id long, text string").withColumn("slice", F.pmod("id", F.lit(n_slices)).cast("long"))
    texts = texts.repartition("slice").dropDuplicates(["slice", "id"])
    sent = texts.groupBy("slice").applyInArrow(_send(parts), "part long, slice long, h binary, n binary")
    answers = sent.groupBy("part").applyInArrow(_answer, "slice long, part long, df binary, many long")
    signed = texts.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(_sign(n), "id long, n_words long, df binary, bands array<long>")
    return scratch.store(signed, "near-dup-texts"), n


def _verify(n_texts: int):
    """Links between texts of one group: each that asks meets all others of its group and of another class."""

    def run(table: pa.Table) -> pa.Table:
        group, row_id, row_class, asks = (table.column(c).to_numpy() for c in ("grp", "id", "class", "asks"))
        ids, first, text = np.unique(row_id, return_index=True, return_inverse=True)
        doc, h, tf = _shingles_of(table.column("text").take(pa.array(first)))
        at = np.searchsorted(doc, np.arange(len(ids) + 1))
        packed = table.column("df").take(pa.array(first)).to_pylist()
        weight = idf(np.concatenate([unpack_df(raw, n) for raw, n in zip(packed, np.diff(at).tolist(), strict=True)]), n_texts)
        total = np.bincount(doc, tf * weight, len(ids))
        _, column = np.unique(h, return_inverse=True)
        have = np.zeros(int(column.max(initial=0)) + 1, dtype=np.int64)
        order = np.lexsort((asks, text, group))
        ends = np.flatnonzero(np.concatenate((group[order][1:] != group[order][:-1], [True]))) + 1
        found: list[tuple[int, int]] = []
        for lo, hi in zip(np.concatenate(([0], ends[:-1])), ends, strict=True):
            here = order[lo:hi]
            members, where = np.unique(text[here], return_index=True)
            classes = row_class[here][where].copy()
            asking = np.unique(text[here][asks[here]])
            starts = np.concatenate(([0], np.cumsum(at[members + 1] - at[members])[:-1]))
            entry = np.concatenate([np.arange(at[m], at[m + 1]) for m in members])
            columns, tfs, weights = column[entry], tf[entry], weight[entry]
            for a, own in zip(asking, np.searchsorted(members, asking), strict=True):
                mine = slice(at[a], at[a + 1])
                have[column[mine]] = tf[mine]
                common = np.add.reduceat(np.minimum(have[columns], tfs) * weights, starts)
                have[column[mine]] = 0
                hit = (common >= (SIMILARITY - 1e-9) * (total[a] + total[members] - common)) & (classes != classes[own])
                if hit.any():
                    joined, one = np.unique(classes[hit], return_index=True)
                    found += [(int(ids[a]), int(ids[m])) for m in members[hit][one]]
                    classes[np.isin(classes, joined)] = classes[own]
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return run


def _among(df: DataFrame, ids: DataFrame, n_texts: int) -> DataFrame:
    """The rows of ``df`` whose id is in ``ids``, and a few others: one pass before a join, so that other rows don't cross its shuffle."""
    words = 1 << 15  # bits of one bitmap
    bits = -(-min(FILTER_BITS * max(n_texts, 1), MOST_FILTER_BITS) // words) * words
    place = F.pmod(F.xxhash64("id"), F.lit(bits).cast("long")) + 1
    parts = ids.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect()
    held = np.zeros((bits // words, words // 8), dtype=np.uint8)
    for r in parts:
        held[r["at"] - 1] = np.frombuffer(r["bits"], np.uint8)
    held = held.reshape(-1)

    @F.pandas_udf("boolean")
    def may_hold(p: pd.Series) -> pd.Series:
        at = p.to_numpy() - 1
        return pd.Series((held[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1)

    return df.where(may_hold(place))


def _links(sides: DataFrame, material: DataFrame, n_texts: int, name: str) -> DataFrame:
    """Verified links within groups of ``sides(grp, id, class, asks)``; groups beyond a block become tiles of blocks."""
    load = F.col("n_words") + DOC_LOAD
    loaded = scratch.store(sides.join(material.select("id", "n_words"), "id"), f"near-dup-{name}-sides")
    blocks = lambda x: F.greatest(F.lit(1), F.ceil(F.coalesce(F.sum(x), F.lit(0)) / BLOCK_LOAD)).cast("long")
    per = loaded.groupBy("grp").agg(blocks(load).alias("nb"), blocks(F.when(F.col("asks"), load)).alias("na"))
    together = max(1, -(-(loaded.agg(F.sum(load)).first()[0] or 0) // BLOCK_LOAD))
    placed = loaded.join(per, "grp")
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    columns = ["grp", "id", "class", "asks", "na", "nb"]
    asked = placed.where("na * nb > 1 or not asks").withColumn("asks", F.lit(False)).select(*columns, block("nb").alias("b"), upto("na").alias("a"))
    asking = placed.where("asks").select(*columns, block("na").alias("a"), upto("nb").alias("b"))
    tile = F.when(F.col("na") * F.col("nb") == 1, F.pmod(F.xxhash64("grp"), F.lit(together))).otherwise(F.xxhash64("grp", "a", "b"))
    tiles = asked.unionByName(asking).select("grp", "id", "class", "asks", tile.alias("tile"))
    needed = _among(material.select("id", "text", "df"), loaded, n_texts)
    found = tiles.join(needed, "id").groupBy("tile").applyInArrow(_verify(n_texts), "a long, b long")
    return scratch.store(found, f"near-dup-{name}-links")


def links(docs: DataFrame) -> DataFrame:
    """Verified links (a, b) between ids of texts: every pair of a bucket that reaches the similarity is linked by a path."""
    signed, n_texts = signed_texts(docs)
    members = signed.select("id", F.explode("bands").alias("band"))
    buckets = members.groupBy("band").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("many")).where("many > 1")
    near = scratch.store(members.join(buckets, "band"), "near-dup-near")
    needed = near.select("id").distinct()
    texts = _among(docs.select(text_id(docs["text"]).alias("id"), docs["text"].alias("text")), near, n_texts).groupBy("id").agg(F.first("text").alias("text"))
    of_near = _among(signed.select("id", "n_words", "df"), near, n_texts).join(needed, "id", "left_semi")
    material = scratch.store(texts.join(of_near, "id"), "near-dup-material")
    hubs = near.select(F.col("hub").alias("grp"), "id").distinct()
    first = _links(hubs.select("grp", "id", F.col("id").alias("class"), (F.col("id") == F.col("grp")).alias("asks")), material, n_texts, "first")
    roots = components(first).select(F.col("node").alias("id"), "root")
    classed = near.where("many > 2").join(roots, "id", "left").select("band", "id", F.coalesce("root", "id").alias("class"))
    classed = scratch.store(classed, "near-dup-classed")
    of_class = classed.groupBy("band", "class").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"))
    largest = of_class.groupBy("band").agg(F.max(F.struct("n", "class"))["class"].alias("main"), F.count(F.lit(1)).alias("classes"), F.sum("n").alias("n"), F.bit_xor("x").alias("x"))
    # The same texts often meet in several bands; one of these will do.
    open_ = largest.where("classes > 1").groupBy("n", "x").agg(F.min(F.struct("band", "main")).alias("b")).select("b.band", "b.main")
    sides = classed.join(open_, "band").select(F.col("band").alias("grp"), "id", "class", (F.col("class") != F.col("main")).alias("asks"))
    return first.unionByName(_links(sides, material, n_texts, "second"))


def _rooted(docs: DataFrame) -> DataFrame:
    """(doc_id, id, root) of every row: its text and the least text of its class."""
    rows = docs.select("doc_id", text_id(docs["text"]).alias("id"))
    roots = components(links(docs)).select(F.col("node").alias("id"), "root")
    return rows.join(roots, "id", "left").select("doc_id", "id", F.coalesce("root", "id").alias("root"))


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, class_size) per row of ``docs(doc_id, text)``; class_id is the least doc_id of the class."""
    rooted = _rooted(docs)
    # Pre-aggregated per task; then the rows meet their class again in a join that can be split where a class is large.
    of_class = rooted.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return rooted.join(of_class, "root").select("doc_id", "class_id", "class_size")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stand for their class: those with its least doc_id, one of each such row's repeats."""
    of_class = _rooted(docs).groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("id").alias("i"))).alias("best"))
    keep = of_class.select(F.col("best.d").alias("__d"), F.col("best.i").alias("__i"))
    (name,) = spare(docs, "__id")
    kept = docs.withColumn(name, text_id(docs["text"])).join(keep, F.col(name).eqNullSafe(F.col("__i")) & docs["doc_id"].eqNullSafe(F.col("__d")), "left_semi")
    return kept.dropDuplicates(["doc_id", name]).drop(name)
