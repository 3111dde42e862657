"""Each operator against brute force, and on nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import line_dedup, mixing, near_dup, packing, quality_rules, site_quality, token_counts, topk, toxicity, warc
from tessera.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD_BPE, BYTE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def prose(rng, n, words=400):
    return " ".join(f"w{int(rng.random() ** 2 * words)}" + ("." if rng.random() < 0.1 else "") for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Ordinary documents, and every odd case at once; extra columns carry names the operators use inside."""
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randint(40, 160)), "en", f"s{i % 3}", 1) for i in range(60)]
    rows += [(100, None, None, None, None), (101, "", "en", "s0", 0), (102, " \n\t ", "en", None, 0), (103, "one two", "en", "s1", 7), (None, prose(rng, 70), "en", "s1", 1), (None, None, None, None, None)]
    rows += [(104, prose(rng, 6000), "en", "s2", 1), rows[3], rows[3], (105, rows[3][1], "fr", "s0", 1), (106, rows[3][1] + " end", "fr", "s0", 1), (-5, "x " * 3000, "en", "s0", 1), (107, "ünï <|endoftext|> 中文   don't", "de", "s1", 1)]
    names = ("n_words", "score", "size", "taken", "piece", "__s", "__h", "lines", "w", "target", "length", "id", "text_hash", "kept", "Quality")
    return spark.createDataFrame(rows, DOCS).select("*", *[F.lit("clash").alias(n) for n in names]).repartition(4)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i // 2) % 2) for i in range(40)] + [(None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_quality_statistics(spark, docs):
    rng = random.Random(21)
    more = ["a $x\n\n a $x \na $x\n" + prose(rng, 60), "#*$%&|<> " * 3 + "\n\t\n" + "É!! ÀB 中文。 x.\"\n" * 3, "one\n" * 4 + prose(rng, 55), "".join(rng.choice("ab #|\n.") for _ in range(3000))]
    frame = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(500 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    for r in rows_of(quality_rules.assess(frame).join(frame.distinct(), "doc_id")):
        text = r["text"] or ""
        words = text.encode().split()
        windows = collections.Counter(zip(words, words[1:], words[2:], strict=False))
        covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
        lines = [line for line in text.split("\n") if line.encode().split()]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(words), sum(len(w.decode()) for w in words), len(covered))
        assert (r["n_symbols"], r["n_dup_lines"]) == (sum(c in "#*$%&|<>" for c in text), sum(line in lines[:i] for i, line in enumerate(lines)))
        assert (r["n_lines"], r["n_dup_chars"]) == (len(lines), sum(len(line) for i, line in enumerate(lines) if line in lines[:i]))
        assert r["n_echoes"] == sum(w in words[max(0, i - 100) : i] for i, w in enumerate(words))
        decoded = [w.decode() for w in words]
        assert r["n_upper"] == sum(c.isupper() for c in text) and r["n_marked"] == sum(any(c in "#*$%&|<>" for c in w) for w in decoded)
        assert r["n_lone"] == sum(not any(c.isalnum() for c in w) for w in decoded) and r["n_long"] == sum(len(w) > 25 for w in decoded)
        assert r["base_failed"] == (len(words) < 50 or 2 * len(covered) > len(words)) and r["kept"] == (not r["base_failed"] and r["quality"] >= 0.5)


def test_quality_votes():
    """Noisy rules, three to a fault: a lone bad vote is outvoted, a fault is found by its votes, or by abstentions alone."""
    rng = np.random.default_rng(0)
    counts, truth = collections.Counter(), collections.defaultdict(list)
    for _ in range(20000):
        fault = int(rng.integers(1, 5)) if rng.random() < 0.2 else 0
        faint = fault and rng.random() < 0.3  # its rules see something but can't decide
        vote = []
        for k in range(quality_rules.N_RULES):
            if fault == k // 3 + 1:
                vote.append(0 if faint or rng.random() < 0.15 else 2)
            else:
                vote.append(int(rng.choice([0, 1, 2], p=[0.02, 0.95, 0.03])))
        p = sum(v * 3**k for k, v in enumerate(vote))
        counts[p] += 1
        truth[p].append(fault == 0)
    quality, model, shares = quality_rules.fit(counts)
    digits = {p: [p // 3**k % 3 for k in range(quality_rules.N_RULES)] for p in counts}
    right = sum(counts[p] for p in counts for g in truth[p][:1] if (quality[p] >= 0.5) == (np.mean(truth[p]) >= 0.5))
    assert right / sum(counts.values()) > 0.98
    kept_despite = sum(n for p, n in counts.items() if 2 in digits[p] and quality[p] >= 0.5)
    dropped_without = sum(n for p, n in counts.items() if 2 not in digits[p] and quality[p] < 0.5)
    all_pass_wrong = sum(len(t) for p, t in truth.items() for t in [[g for g in t if g != (2 not in digits[p])]])
    wrong = sum(len([g for g in t if g != (quality[p] >= 0.5)]) for p, t in truth.items())
    assert kept_despite > 2000 and dropped_without > 300 and wrong < all_pass_wrong / 4
    assert abs(shares[0] - 0.8) < 0.05 and (model[0, :, 2] < model[1, :, 2]).all()


def test_quality_votes_on_texts(spark):
    """From text to verdict: texts without sentence ends stay though one rule votes bad, since their other votes are good; symbols throughout do not."""
    rng = random.Random(22)
    rows = [(i, prose(rng, 120, 3000)) for i in range(400)]
    rows += [(1000 + i, " ".join(w + "##" for w in prose(rng, 120, 3000).split())) for i in range(40)]
    rows += [(2000 + i, "| ".join(prose(rng, 120, 3000).split())) for i in range(40)]
    rows += [(3000 + i, prose(rng, 120, 3000).replace(".", ",")) for i in range(8)]  # no sentence ends: one rule's bad vote
    got = {r["doc_id"]: r for r in rows_of(quality_rules.assess(spark.createDataFrame(rows, "doc_id long, text string")))}
    assert all(r["kept"] == (i < 1000 or i >= 3000) for i, r in got.items())
    assert all(100 * r["n_ended"] < r["n_words"] for i, r in got.items() if i >= 3000)


def test_keep_good(docs):
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns
    want = sorted(str(r["doc_id"]) for r in rows_of(quality_rules.assess(docs)) if r["kept"])
    assert sorted(str(r["doc_id"]) for r in kept.select("doc_id").collect()) == want


def test_line_dedup(spark, docs):
    a = spark.createDataFrame([(1, "a\nb\nc\nd\n\ne"), (2, "x\nb\nc\n\nd\ny"), (3, "q"), (4, None), (5, ""), (None, "a\nb\nc\nd\nz"), (6, "m\nm\nm\nm\nm"), (2, "x\nb\nc\n\nd\ny")], "doc_id long, text string")
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"], r["n_removed_lines"]) for r in rows_of(line_dedup.dedup_lines(a))), key=str)
    assert got == sorted([(False, 1, "a\nb\nc\nd\n\ne", 0), (False, 2, "x\ny", 4), (False, 2, "x\ny", 4), (False, 3, "q", 0), (False, 4, None, 0), (False, 5, "", 0), (True, 0, "z", 4), (False, 6, "m", 4)], key=str)
    clash = line_dedup.dedup_lines(a.withColumn("N_Lines", F.lit("mine")))
    assert clash.columns == ["doc_id", "text", "N_Lines", "n_removed_lines"] and {r["N_Lines"] for r in rows_of(clash)} == {"mine"}
    cut = line_dedup.cut_documents(docs)
    assert cut.columns == docs.columns and cut.count() == docs.count()


def brute_classes(texts):
    """Components of weighted Jaccard >= 0.8 over five-word shingles with tf * idf, all pairs; idf counts different texts."""
    bags = []
    for t in texts:
        w = (t or "").encode().split()
        bags.append(collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else []))
    different = {t or "": b for t, b in zip(texts, bags, strict=True) if b}
    df = collections.Counter(s for b in different.values() for s in b)
    n = len(different)
    idf = {s: 1 + math.log(n / d) / math.log(max(n, 2)) for s, d in df.items()}
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            common = sum(min(bags[i][s], bags[j][s]) * idf[s] for s in bags[i].keys() & bags[j].keys())
            union = sum(max(bags[i][s], bags[j][s]) * idf[s] for s in bags[i].keys() | bags[j].keys())
            if (texts[i] or "") == (texts[j] or "") or union and common / union >= 0.8:
                a, b = root[i], root[j]
                root = [a if r == b else r for r in root]
    return root


def test_near_dup(spark):
    rng = random.Random(4)
    texts = [prose(rng, rng.randint(3, 200)) for _ in range(60)] + [None, "", "", "a b", "a b", "a c"]
    for base in range(12):
        for edits in (1, 2, 4, 9):
            words = texts[base].split()
            for _ in range(edits):
                words[rng.randrange(len(words))] = f"new{rng.random()}"
            texts.append(" ".join(words))
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, id string")
    want = brute_classes(texts)
    least = {}
    for i, r in enumerate(want):
        least.setdefault(r, i)
    got = {r["doc_id"]: r["class_id"] for r in near_dup.classes(df).collect()}
    assert got == {i: least[r] for i, r in enumerate(want)}
    assert sorted(r["doc_id"] for r in near_dup.keep_one(df.unionByName(df)).collect()) == sorted(least.values())


def test_near_dup_repeated_shingles(spark):
    """Texts alike by a passage they repeat, each with words of its own, are found as their weighted Jaccard says."""
    rng = random.Random(11)
    texts = []
    for k in range(8):
        passage = [f"p{k}x{rng.random()}" for _ in range(50)]
        texts += [" ".join([*passage * 20, *(f"own{rng.random()}" for _ in range(50))]) for _ in range(2)]
    want = brute_classes(texts)
    assert len(set(want)) == 8
    got = {r["doc_id"]: r["class_id"] for r in near_dup.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i in range(16)}


def test_near_dup_weights(spark, monkeypatch):
    """Every shingle's df is exact, over several slices and parts; rarity decides between texts that plain counts can't tell apart."""
    rng = random.Random(13)
    texts = [prose(rng, rng.randint(1, 120), 12) for _ in range(300)] + ["", None, "a b"] + ["x y z " * 200] * 3
    monkeypatch.setattr(near_dup, "SLICE_BYTES", 9000)
    signed, n = near_dup.signed_texts(spark.createDataFrame([(t,) for t in texts], "text string"))
    different = sorted({t for t in texts if t})
    doc, h, _ = near_dup.shingles(different)
    df = collections.Counter(h.tolist())
    hashes = {tuple(h[doc == i].tolist()) for i in range(len(different))}
    got = signed.collect()
    assert n == len(different) == len(got) == len({r["id"] for r in got})
    counts = collections.Counter(tuple(near_dup.unpack_df(r["df"], len(r["df"])).tolist()) for r in got)
    assert counts == collections.Counter(tuple(df[x] for x in one) for one in hashes)
    assert near_dup.unpack_df(near_dup.pack_df(np.array([1, 254, 255, 10**12])), 4).tolist() == [1, 254, 255, 10**12]

    common = [" ".join(f"c{i}" for i in range(40))]
    own = [" ".join(f"o{k}x{i}" for i in range(4)) for k in range(60)]
    alike = brute_classes([f"{common[0]} {o}" for o in own])
    assert len(set(alike)) == 60  # 36 of 44 shared, 0.82 by plain counts
    frame = spark.createDataFrame([(k, f"{common[0]} {o}") for k, o in enumerate(own)], "doc_id long, text string")
    assert near_dup.classes(frame).select("class_id").distinct().count() == 60


def test_near_dup_samples_match_similarity():
    """Texts of every length, weights of every kind: samples agree as often as the weighted Jaccard similarity says."""
    rng = np.random.default_rng(14)
    for n, top in ((3, 1), (8, 1), (40, 30), (300, 1), (300, 300), (5000, 4)):
        agree, truth = [], []
        for _ in range(30 if n < 1000 else 6):
            h = rng.integers(0, 2**48, n, dtype=np.uint64)
            w = rng.integers(1, top + 1, (2, n)) * rng.uniform(1, 2, n) * (rng.random((2, n)) < 0.93)
            w[:, 0] = 1
            doc = np.repeat([0, 1], (w > 0).sum(1))
            samples, has = near_dup.signatures(doc, np.concatenate([h[w[0] > 0], h[w[1] > 0]]), np.concatenate([w[0][w[0] > 0], w[1][w[1] > 0]]), 3)
            assert has.tolist() == [True, True, False]
            agree.append((samples[0] == samples[1]).mean())
            truth.append(np.minimum(*w).sum() / np.maximum(*w).sum())
        assert abs(np.mean(agree) - np.mean(truth)) < 4 * np.sqrt(0.25 / (120 * len(agree))), (n, top)
        assert np.std(np.array(agree) - truth) < 1.6 * np.sqrt(0.25 / 120)


def test_near_dup_recall():
    """Pairs just at the threshold meet in a band, whatever their length."""
    rng = random.Random(15)
    for words in (8, 9, 12, 20, 60, 200, 1000):
        shingles = words - 4
        own = max(1, int((shingles - 0.8 * shingles) / 1.8))  # shingles of the second text that the first lacks
        met = []
        for k in range(100):
            base = [f"w{rng.random()}" for _ in range(words)]
            texts = [" ".join(base), " ".join([*base[own:], *(f"n{k}x{i}" for i in range(own))])]
            doc, h, tf = near_dup.shingles(texts)
            keys = near_dup.bands(near_dup.signatures(doc, h, tf * 2.0, 2)[0])
            similarity = len({*h[doc == 0].tolist()} & {*h[doc == 1].tolist()}) / len({*h.tolist()})
            if similarity >= 0.8:
                met.append(bool((keys[0] == keys[1]).any()))
        assert not met or np.mean(met) >= 0.97, words


def test_near_dup_blocks(spark, monkeypatch):
    """A group of many blocks gives the same classes."""
    rng = random.Random(5)
    base = prose(rng, 120).split()
    texts = [" ".join([*base[:k], f"x{k}", *base[k + 1 :]]) for k in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(near_dup, "BLOCK_LOAD", 2000)
    assert {r["class_id"] for r in near_dup.classes(df).collect()} == {0}


def test_components(spark):
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame([(k, k + 1) for k in range(30)] + [(90, 80), (70, 80), (5, 5)], "a long, b long")).collect()}
    assert got == {k: 0 for k in range(1, 31)} | {80: 70, 90: 70}


def test_mixing(docs):
    got, mixed = rows_of(mixing.taken(docs)), mixing.mix(docs, slot="at")
    total = sum(r["size"] for r in got)
    near = 3 * mixing.BLOCK  # so few slots stay well below DEVIATION
    assert len(got) == docs.count()
    assert all(r["taken"] <= 2 * r["size"] and r["target"] <= 2 * r["source_size"] for r in got)
    assert all((r["slots"] > 0) == (r["taken"] > 0) == (r["first_slot"] is not None) for r in got)
    by_source, goal = collections.defaultdict(list), {}
    for r in got:
        by_source[r["source_size"], r["target"]].append(r["taken"])
        goal[r["source_size"]] = r["target"]
    assert abs(sum(goal.values()) - 1.5 * total) < 5
    assert all(abs(sum(t) - target) <= near or size == 0 for (size, target), t in by_source.items())
    assert mixed.columns == [*docs.columns, "at"]
    rows = mixed.collect()
    assert sum(len((r["text"] or "").encode().split()) for r in rows) == sum(r["taken"] for r in got)
    assert [r["at"] for r in rows] == sorted(r["at"] for r in rows)
    assert mixing.mix(docs, ordered=False).columns == docs.columns
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"], str(r["first_slot"]), r["slots"])
    assert sorted(map(key, rows_of(mixing.taken(docs.repartition(3))))) == sorted(map(key, got))


def test_mix_schedule(spark):
    """Slots are where the golden ratio puts them; any stretch of them holds each source in about its share."""
    of = spark.createDataFrame([("a", 10**6, 6e5), ("b", 10**6, 3e5), (None, 10**6, 1e5)], "source string, source_size long, target double")
    slots = mixing.slots(of).orderBy("slot").collect()
    assert [r["slot"] for r in slots] == [*range(-(-(10**6) // mixing.BLOCK))]
    for r in slots:
        at = r["slot"] * mixing.GOLDEN % 2**32 / 2**32
        assert r["source"] == ("a" if at < 0.6 - 1e-9 else "b" if at < 0.9 - 1e-9 else None) or min(abs(at - 0.6), abs(at - 0.9)) < 1e-8
    for at in range(0, len(slots) - 100, 100):
        seen = collections.Counter(r["source"] for r in slots[at : at + 100])
        assert abs(seen["a"] - 60) <= 3 and abs(seen["b"] - 30) <= 3
    for s, words in (("a", 600_000), ("b", 300_000), (None, 100_000)):
        mine = [r for r in slots if r["source"] == s]
        assert [r["rank"] for r in mine] == [*range(len(mine))] and abs(len(mine) * mixing.BLOCK - words) <= mixing.DEVIATION * mixing.BLOCK


def test_mix_deviation():
    """No source of any size misses its share of the slots by more than the stated number of blocks, nor do points break 64 bits."""
    n = 1 << 21
    points = np.arange(n, dtype=np.uint64) * np.uint64(mixing.GOLDEN) % np.uint64(2**32)
    rng = np.random.default_rng(9)
    for _ in range(60):
        lo, hi = np.sort(rng.integers(0, 2**32, 2))
        seen = np.cumsum((points >= lo) & (points < hi))
        want = (np.arange(n) + 1) * ((hi - lo) / 2**32)
        assert np.abs(seen - want).max() < mixing.DEVIATION


def test_mix_follows_schedule(docs, monkeypatch):
    """Other points give another mix."""
    before = {(r["doc_id"], r["first_slot"], r["taken"]) for r in rows_of(mixing.taken(docs))}
    monkeypatch.setattr(mixing, "GOLDEN", 2**31 + 12345)
    assert before != {(r["doc_id"], r["first_slot"], r["taken"]) for r in rows_of(mixing.taken(docs))}


def test_mix_repeated_rows(spark):
    """Repeats and rows of one id with other texts each keep their own place, text and columns."""
    rows = [(7, f"w{k % 3} " * 100, "s", k % 3) for k in range(30)] + [(None, "n " * 100, "s", 9)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, more int")
    want = sum(r["taken"] for r in rows_of(mixing.taken(df)))
    got = rows_of(mixing.mix(df))
    assert sum(len(r["text"].split()) for r in got) == want
    assert all({*r["text"].split()} == {"n" if r["doc_id"] is None else f"w{r['more']}"} for r in got)
    assert collections.Counter(r["more"] for r in got if len(r["text"].split()) == 100).keys() >= {0, 1, 2, 9}


def test_packing(docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD_BPE)
    got = rows_of(packing.pack_documents(docs, WORD_BPE))
    want = collections.Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 0])
        want.update((r["doc_id"], *p) for p in packing.pieces_of(ids))
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= -(-sum(r["length"] for r in got) // 2048) + 1


def test_packing_plan():
    """The plan over counts is the one that best-fit decreasing makes piece by piece."""
    rng = random.Random(2)
    for limit in (10, 37, 200):
        for _ in range(30):
            counts = {rng.randint(1, limit): rng.randint(1, 9) for _ in range(rng.randint(1, 12))}
            room = []
            for length in sorted(counts, reverse=True):
                for _ in range(counts[length]):
                    fit = min((r for r in room if r >= length), default=None)
                    room.remove(fit) if fit is not None else None
                    room.append((limit if fit is None else fit) - length)
            runs, made = packing.plan(counts, limit)
            assert made == len(room)
            left = collections.Counter({k: limit for k in range(made)})
            for length, lo, hi, first, each, offset in runs:
                for k in range(hi - lo):
                    left[first + k // each] -= length
            assert sorted(left.values()) == sorted(room)


@pytest.mark.parametrize("sizes", [{}, {"QUERY_ROWS": 4, "SHARD_ROWS": 10, "GROUP_QUERIES": 2, "GROUP_SHARDS": 3, "FAN_IN": 3}])
def test_top_k(spark, monkeypatch, sizes):
    """In one tile; and over several parts, groups of queries and levels of merging."""
    for name, value in sizes.items():
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 8)).round(1)
    x[50:120] = x[50]
    rows = [(i, [float(v) for v in r], 1) for i, r in enumerate(x)] + [(1000, None, 1), (1020, [None] * 8, 1), (1040, [float("nan")] * 8, 1), (None, [1.0] * 8, 1), (2000, [1.0, 2.0], 1), (2020, [3.0, 1.0], 1), (3000, [1e9] * 8, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int").repartition(3)
    want = set()
    good = [(i, np.floor(np.array(v) * 64)) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    for i, q in good:
        if i % 20 == 0:
            scored = sorted((-int(sum(int(a) * int(b) for a, b in zip(q, c, strict=True))), j) for j, c in good if j != i and len(c) == len(q))
            want |= {(i, k, j, -s) for k, (s, j) in enumerate(scored[:20], 1)}
    assert {tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, 20).collect()} == want


@pytest.mark.parametrize("segment", [64, 1000, warc.SEGMENT])
def test_warc(spark, segment):
    rng = random.Random(6)
    html = ["<p>" + prose(rng, n) + "é中😀\r\n\r\nWARC/1.1\r\n" for n in (1, 50, 3000)]
    pages = [(i, f"http://h/{i} x\r\n", html[i % 3]) for i in range(12)] + [(50, None, None), (51, "u", ""), (52, "u", "short"), (53, "u", "short"), (None, "u", html[2]), (3, "u", html[0])]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, salt string")
    least = {}
    for i, _, h in pages:
        if i is not None:
            least[h or ""] = min(i, least.get(h or "", i))
    got = collections.Counter(tuple(r)[:5] for r in warc.round_trip(df, segment).collect() if r["intact"])
    want = collections.Counter()
    for i, _, h in pages:
        raw = (h or "").encode()
        revisit = len(raw) >= 100 and i != least[h]
        want[i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", least[h] if revisit else None] += 1
    assert got == want


def test_warc_damage():
    payload = prose(random.Random(1), 500).encode()
    assert warc.unchunked(warc.chunked(payload, 64)) == payload and warc.unchunked(warc.chunked(payload)[:-9]) is None and warc.unchunked(b"zz\r\n") is None


def test_token_counts(docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTE_BPE)
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").where("doc_id is not null").collect()}
    got = rows_of(token_counts.count_tokens(docs, BYTE_BPE, 100))
    assert len(got) == docs.count()
    for r in got:
        if r["doc_id"] is not None:
            t = texts[r["doc_id"]]
            assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), count(t), count(t) > 100)
            assert count(t[: r["n_chars_within"]]) <= 100
    table, rng = token_counts.prefix_counts(BYTE_BPE), random.Random(3)
    bits = ["a", "hello", " ", "  ", "\n", "\n\n", "'s", "'re", "'r", "don't", "!!", "1234", "é", "中文", "\t", "<|endoftext|>", "😀", "\0", "''ve", "\x1c", " "]
    for _ in range(300):
        t = "".join(rng.choices(bits, k=rng.randint(0, 8)))
        assert table.at_every_prefix(t).tolist() == [count(t[:k]) for k in range(len(t) + 1)]


def test_token_counts_of_all_scripts(monkeypatch):
    """Every prefix of texts in any script and around special strings, without encoding prefixes anew; long unspaced texts too."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTE_BPE)
    monkeypatch.setattr(token_counts.PrefixCounts, "_by_library", lambda *_: pytest.fail("encodes each prefix anew"))
    table, rng = token_counts.PrefixCounts(BYTE_BPE), random.Random(4)
    bits = ["привет", "Ελλάδα", "مرحبا", "नमस्ते", "中文字", "日本", "。", "，", "😀", "👩\u200d💻", "٣٤", "½", "\u3000", "\u2028", "\xa0", "\x85", "\x1c", "\x1f", "\u180e", "\u200b", "\ufeff", "\u0301", "\U0003fffd", "<|endoftext|>", "<|endo", "'s", "'re", "'", "a", " ", "  ", "\n", "9", "!"]
    for _ in range(1500):
        t = "".join(rng.choices(bits, k=rng.randint(1, 9)))
        want = [len(e.ids) for e in library.encode_batch_fast([t[:k] for k in range(len(t) + 1)], add_special_tokens=False)]
        assert table.at_every_prefix(t).tolist() == want, repr(t)
    long = "".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(60_000))
    got = table.at_every_prefix(long)
    for k in (1, 999, 30_001, 60_000):
        assert got[k] == len(library.encode(long[:k], add_special_tokens=False).ids)


def test_toxicity(spark, docs, labels):
    rng = random.Random(8)
    bad = ["idiotic", "wretch", "vermin"]
    rows, known = [], []
    for i in range(600):
        words = prose(rng, rng.randint(20, 150), 150).split()
        if i % 3 == 0:
            for _ in range(2):
                words[rng.randrange(len(words))] = rng.choice(bad)
        rows.append((i, " ".join(words)))
        known.append((i, int(i % 3 == 0)))
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(known, "doc_id long, toxic int")
    got = rows_of(toxicity.score(df, lab))
    held = [r for r in got if r["held_out"]]
    assert len(held) > 50 and np.mean([r["predicted"] == int(r["doc_id"] % 3 == 0) for r in held]) > 0.9
    odd = rows_of(toxicity.score(docs, labels))
    assert len(odd) == docs.count() and all(0 <= r["score"] <= 1 for r in odd)
    none = rows_of(toxicity.score(docs, labels.where("false")))
    assert {r["score"] for r in none} == {0.0}


def small_network(words, seed=3):
    net = toxicity.Network.fresh({w: i for i, w in enumerate(words, 1)}, np.linspace(-1, 1, len(words)).astype(np.float32), seed)
    rng = np.random.default_rng(seed)
    for name in ("E", "C", "v", "w", "A"):  # away from the flat start
        net.p[name] = (net.p[name] * 3 + rng.standard_normal(net.p[name].shape) * 0.2).astype(np.float32)
    net.p["E"][0] = 0
    return net


def test_toxicity_forward():
    """A window's logit number by number: projections, both gated recurrences, attention, output."""
    words = [f"word{k}".encode() for k in range(12)]
    net = small_network(words[:9])
    p, H = net.p, toxicity.HIDDEN
    text = " ".join(w.decode() for w in (*words, words[2]))
    logits, _, (read,) = toxicity.Scorer(net).window_logits([text])
    x = net.rows(read)[0].astype(float)
    sigmoid = lambda v: 1 / (1 + math.exp(-v))
    states = {}
    for d in "fb":
        h, seen = [0.0] * H, {}
        for t in range(len(read)) if d == "f" else reversed(range(len(read))):
            g = [float(p[f"b{d}"][j]) + sum(x[t][i] * float(p[f"W{d}"][i, j]) for i in range(x.shape[1])) for j in range(3 * H)]
            u = [sum(h[i] * float(p[f"U{d}"][i, j]) for i in range(H)) for j in range(3 * H)]
            z, r = [sigmoid(g[j] + u[j]) for j in range(H)], [sigmoid(g[H + j] + u[H + j]) for j in range(H)]
            c = [math.tanh(g[2 * H + j] + r[j] * u[2 * H + j]) for j in range(H)]
            h = [z[j] * h[j] + (1 - z[j]) * c[j] for j in range(H)]
            seen[t] = h
        states[d] = seen
    both = [states["f"][t] + states["b"][t] for t in range(len(read))]
    pull = [sum(float(p["v"][k]) * math.tanh(float(p["a"][k]) + sum(s[i] * float(p["A"][i, k]) for i in range(2 * H))) for k in range(len(p["v"]))) for s in both]
    share = np.exp(pull) / np.exp(pull).sum()
    pooled = [sum(share[t] * both[t][i] for t in range(len(read))) for i in range(2 * H)]
    want = float(p["o"][0]) + sum(pooled[i] * float(p["w"][i]) for i in range(2 * H))
    assert len(logits) == 1 and logits[0] == pytest.approx(want, rel=1e-4, abs=1e-4)


def test_toxicity_gradients():
    """Each parameter's gradient against differences of the loss."""
    rng = np.random.default_rng(5)
    words = [b"", *(f"w{k}".encode() for k in range(14))]
    net = small_network(words[1:10])
    at, mask = rng.integers(1, len(words), (6, 9)), np.ones((6, 9), np.float32)
    mask[1, 4:], mask[3, 1:] = 0, 0
    at[mask == 0] = 0
    label = np.array([1, 0, 1, 0, 0, 1])

    def loss():
        z = net.forward(net.project(net.rows(words)[0]), at, mask).astype(float)
        return np.mean(np.logaddexp(0, z) - label * z)

    grads = net.gradients(words, at, mask, label)
    for name, g in grads.items():
        way = rng.standard_normal(g.shape).astype(np.float32) * (np.abs(g) > 0)
        way /= np.linalg.norm(way)
        kept, sides = net.p[name].copy(), []
        for sign in (1, -1):
            net.p[name] = kept + np.float32(sign * 0.02) * way
            sides.append(loss())
        net.p[name] = kept
        assert (sides[0] - sides[1]) / 0.04 == pytest.approx(float((g * way).sum()), rel=0.03, abs=2e-5), name


def test_toxicity_sample(spark, monkeypatch):
    """What the driver collects is bounded in rows and bytes a class; a text beyond the bound doesn't keep others out."""
    rows = [(i, "x" * (5000 if i % 10 == 0 else 100), i % 2) for i in range(200)] + [(1, "again", 1)] * 50
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows[:200]], "doc_id long, toxic int")
    learned = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    texts, toxic = toxicity.sample(docs, labels)
    assert sorted(zip(texts, toxic, strict=True)) == sorted((t, y) for _, t, y in learned)
    monkeypatch.setattr(toxicity, "TRAIN_TEXT_BYTES", 1000)
    monkeypatch.setattr(toxicity, "TRAIN_BYTES", 3000)
    texts, toxic = toxicity.sample(docs, labels)
    for label in (0, 1):
        own = [len(t) for t, y in zip(texts, toxic, strict=True) if y == label]
        assert max(own) <= 1000 and 2900 <= sum(own) <= 3000
    assert (texts, toxic) == toxicity.sample(docs.repartition(3), labels.repartition(2))
    assert max(np.bincount(toxicity.sample(docs, labels, per_class=5)[1])) <= 10


def test_toxicity_windows():
    """Windows cover every word and every short passage, and a text's score is that of its worst window alone."""
    for n in (0, 1, 47, 48, 49, 80, 81, 200, 1000):
        begins = toxicity.windows(n)
        assert begins[0] == 0 and {i for b in begins for i in range(b, min(b + toxicity.WINDOW, n))} == {*range(n)}
        assert all(np.diff(begins) < toxicity.WINDOW)
        passage = toxicity.WINDOW - toxicity.STRIDE + 1
        assert all(any(b <= first and first + passage <= b + toxicity.WINDOW for b in begins) for first in range(n - passage + 1))
    words = [f"w{k}".encode() for k in range(30)]
    net = small_network(words[:20])
    rng = random.Random(2)
    text = " ".join(rng.choice(words).decode() for _ in range(300))
    whole, parts = toxicity.Scorer(net).scores([text])[0], text.split()
    alone = [toxicity.Scorer(net).scores([" ".join(parts[b : b + toxicity.WINDOW])])[0] for b in toxicity.windows(300)]
    assert whole == pytest.approx(max(alone), abs=1e-5)


def test_site_quality(spark, docs, labels):
    """Shrinkage and posterior recomputed from the evidence, with sparse, single and null sites."""
    site = lambda i: ("single", "x") if i == 0 else (None, None) if i < 4 else ("sparse", f"p{i}") if i < 8 else (f"h{i % 3}", f"p{i % 12}")
    good = lambda i: int(random.Random(i + 900).random() < 0.35 + 0.15 * (i % 3))
    rows = [(i, ("good words here " if good(i) else "JUNK!! " * (i % 7)) + prose(random.Random(i), 80), *site(i)) for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string, host string, path string")
    got = {r["doc_id"]: r for r in rows_of(site_quality.score(df, spark.createDataFrame([(i, good(i)) for i in range(0, 240, 5)], "doc_id long, quality int"), F.col("host"), F.col("path")))}
    e = {i: r["evidence"] for i, r in got.items()}
    overall = np.mean([*e.values()])

    def strength(groups, above):
        n, k = sum(map(len, groups)), len(groups)
        noise = sum(((np.array(g) - np.mean(g)) ** 2).sum() for g in groups) / (n - k)
        spread = sum(len(g) * (np.mean(g) - m) ** 2 for g, m in zip(groups, above, strict=True))
        tau = (spread - (k - 1) * noise) / (n - sum(len(g) ** 2 for g in groups) / n)
        return min(max(noise / tau, 1.0), site_quality.MOST_PSEUDO) if tau > 0 else site_quality.MOST_PSEUDO

    hosts, paths = collections.defaultdict(list), collections.defaultdict(list)
    for i in e:
        hosts[site(i)[0]].append(e[i])
        paths[site(i)].append(e[i])
    by_host = strength([*hosts.values()], [overall] * len(hosts))
    by_path = strength([*paths.values()], [np.mean(hosts[h]) for h, _ in paths])
    assert 1 < by_host < site_quality.MOST_PSEUDO, (by_host, by_path)
    for i, r in got.items():
        h, s = hosts[site(i)[0]], paths[site(i)]
        host = (by_host * overall + sum(h)) / (by_host + len(h))
        path = (by_path * host + sum(s) - e[i]) / (by_path + len(s) - 1)
        assert r["host_quality"] == pytest.approx(host, rel=1e-6) and r["path_quality"] == pytest.approx(min(max(path, 1e-6), 1 - 1e-6), rel=1e-6)
        own = min(max(e[i], 1e-6), 1 - 1e-6)
        odds = math.log(own / (1 - own)) + math.log(path / (1 - path)) - math.log(overall / (1 - overall))
        assert r["quality"] == pytest.approx(1 / (1 + math.exp(-odds)), abs=1e-6) and r["kept"] == (r["quality"] >= 0.5)
    odd = rows_of(site_quality.score(docs, labels, docs["source"], docs["lang"]))
    assert len(odd) == docs.count() and all(0 <= r["quality"] <= 1 for r in odd)


def test_empty_tables(spark, docs, labels):
    none, no_vectors = docs.where("false"), spark.createDataFrame([], "vec_id long, embedding array<float>")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for df in (
        quality_rules.assess(none), quality_rules.keep_good(none), line_dedup.dedup_lines(none), near_dup.classes(none), near_dup.keep_one(none), mixing.taken(none), mixing.mix(none), packing.pack_documents(none, WORD_BPE),
        topk.top_k(no_vectors, F.col("vec_id") % 20 == 0, 20), warc.round_trip(pages), token_counts.count_tokens(none, BYTE_BPE, 9), toxicity.score(none, labels), site_quality.score(none, labels, F.col("source"), F.col("lang")),
    ):
        assert df.count() == 0


def test_near_dup_filters_before_joins(spark):
    """Every row asked for stays, nearly all others go before the shuffle of a join."""
    from tessera.llm import near_dup

    rows = spark.range(20_000).selectExpr("id * 7919 - 50000 AS id")
    wanted = rows.where("id % 10 = 0")
    got = near_dup._among(rows, wanted.union(wanted), 20_000)
    assert got.join(wanted, "id").count() == wanted.count() and got.count() < wanted.count() + 1000
    assert near_dup._among(rows, wanted.where("false"), 0).count() == 0
