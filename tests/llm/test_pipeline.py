import collections
import hashlib
import math
import random

import corpus_pipeline
import numpy as np
import pytest
from test_operators import WORD_BPE, brute_classes, prose

from tessera.llm import line_dedup, near_dup, packing, quality_rules


@pytest.fixture(scope="module")
def small(spark):
    return "/root/testdata/sf0.001", spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def test_stages(spark, small):
    folder, docs = small
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, folder).cache()
        assert docs.columns == before.columns and docs.count(), name
        if name in ("quality rules", "near-dedup"):
            assert docs.exceptAll(before).count() == 0
        if name == "line dedup":
            assert docs.count() == before.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_run(spark, small):
    folder, docs = small
    good = quality_rules.keep_good(docs)
    kept = near_dup.keep_one(line_dedup.cut_documents(good)).select("doc_id").distinct()
    assert corpus_pipeline.run(spark, folder).select("doc_id").distinct().exceptAll(kept).count() == 0


def brute_lines(docs):
    """Texts (by id) without the later occurrences of three-line windows."""
    seen, out = set(), {}
    for i, text in sorted(docs.items()):
        lines = text.split("\n")
        worded = [k for k, line in enumerate(lines) if line.encode().split()]
        gone = set()
        for a, b, c in zip(worded, worded[1:], worded[2:], strict=False):
            window = lines[a], lines[b], lines[c]
            if window in seen:
                gone.update(range(a, c + 1))
            seen.add(window)
        out[i] = "\n".join(line for k, line in enumerate(lines) if k not in gone)
    return out


def brute_mix(docs, source):
    """(id, text) for each time the mix takes a document."""
    size = {i: len(t.encode().split()) for i, t in docs.items()}
    total = collections.Counter()
    for i in docs:
        total[source[i]] += size[i]
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight, full, left, target = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}, set(), sum(total.values()) * 3 / 2, {}
    while True:
        level = left / (sum(weight[s] for s in names if s not in full) or 1)
        over = [s for s in names if s not in full and level * weight[s] > 2 * total[s]]
        if not over:
            break
        full.update(over)
        left -= sum(2 * total[s] for s in over)
    for s in names:
        target[s] = 2 * total[s] if s in full else level * weight[s]
    whole, edge, at = sum(target.values()), 0, {}
    for s in names:
        at[s] = round(edge * 2**32), round((edge + target[s] / whole) * 2**32)
        edge += target[s] / whole
    slots = collections.Counter(s for i in range(math.ceil(whole / 64)) for s in names if at[s][0] <= i * 2654435769 % 2**32 < at[s][1])
    out = []
    for s in names:
        start = 0
        for i in sorted((i for i in docs if source[i] == s), key=lambda i: hashlib.md5(str(i).encode()).hexdigest()):
            for k in range(2):
                take = min(size[i], 64 * slots[s] - start - k * total[s])
                if take > 0:
                    out.append((i, docs[i] if take == size[i] else b" ".join(docs[i].encode().split()[:take]).decode()))
            start += size[i]
    return out


def test_whole_pipeline(spark, tmp_path):
    """All stages against brute force; the verdict on quality is the operator's, which has a test of its own."""
    from tokenizers import Tokenizer

    rng = random.Random(12)
    shared = "\n".join(prose(rng, 9) for _ in range(4))
    texts = ["\n".join(prose(rng, rng.randint(5, 30), 3000) for _ in range(rng.randint(4, 12))) for _ in range(60)]
    texts += [t + "\n" + shared for t in texts[:8]] + [texts[9], texts[9], texts[10] + " more words"] + ["junk junk junk " * 60, "", None, "short"]
    texts += ["\n".join(prose(rng, 40, 3000) for _ in range(90))]
    rows = [(i, t, "en", (None, "a", "b", "b", "b")[i % 5], len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    kept = {r["doc_id"] for r in quality_rules.assess(spark.read.parquet(f"{tmp_path}/documents.parquet")).where("kept").collect()}
    assert 50 < len(kept) < len(texts) - 3
    docs = brute_lines({i: texts[i] for i in kept})
    ids = sorted(docs)
    roots = brute_classes([docs[i] for i in ids])
    docs = {i: docs[i] for k, i in enumerate(ids) if roots[k] not in roots[:k]}
    mixed = brute_mix(docs, {r[0]: r[3] for r in rows})
    library, want = Tokenizer.from_file(WORD_BPE), collections.Counter()
    for i, text in mixed:
        want.update((i, *p) for p in packing.pieces_of(np.array([*library.encode(text, add_special_tokens=False).ids, 0])))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    ends = collections.Counter()
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert ends[r["sequence_id"]] == r["offset"]
        ends[r["sequence_id"]] += r["length"]
    assert max(ends.values()) <= packing.LIMIT and len(ends) == packing.plan(collections.Counter(r["length"] for r in got))[1]
