"""Quality rules combined by weak supervision.

Twelve rules look at statistics of a text; each votes good, bad or abstains. Several look at one fault in different ways
(symbols, words that hold one, words of nothing else), so that a fault shows in more than one vote and a lone vote may be a
rule's mistake. Votes are packed into one base-3 pattern number, so the corpus reduces to a count per pattern (at most
3 ** 12 rows, whatever the corpus size; some hundreds in practice). Expectation-maximisation over those counts estimates,
without labels, the share of good texts and how often each rule votes good, bad or abstains on good and on bad texts; the
posterior of a pattern is then the quality probability of every text that shows it. No rule has a veto, and a text without
a bad vote can fail, as a rule that abstains more on bad texts says something by abstaining: a text is kept when its
posterior reaches ``KEEP``.

Defined cases: a null text counts as empty; an empty text has only zero statistics, every rule abstains on it and its
posterior is that of this pattern; ``doc_id`` is carried, never used, so nulls and repeats are kept row by row; an empty
table gives an empty result; other columns of the input are ignored by ``assess`` and untouched by ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scratch
from .text import slices, spare

#: Symbols that prose hardly uses.
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
KEEP = 0.5

#: A word echoes when it stands among the ``ECHO`` words before it; a share of echoes doesn't depend on the text's length.
ECHO = 100
LONG_WORD = 25

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_dup_chars", "n_echoes", "n_upper", "n_marked", "n_lone", "n_loud", "n_long", "n_ended")
_OF_WORDS = ("word_chars", "n_symbols", "n_upper", "n_marked", "n_lone", "n_loud", "n_long", "n_ended")
_STATS_TYPE = T.StructType([T.StructField(name, T.LongType()) for name in STATS])


def repeat_words(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per document, the words inside 3-word windows that occur twice or more in it; ids: words of all documents in turn."""
    ends = np.cumsum(sizes)
    out = np.zeros(len(sizes), dtype=np.int64)
    if len(ids) < 3:
        return out
    doc = np.repeat(np.arange(len(sizes)), sizes)
    inside = doc[2:] == doc[:-2]
    start = np.flatnonzero(inside)
    if not len(start):
        return out
    # Two words to one exact pair number, then pair, third word and document to one exact window number.
    pair = np.unique(ids[start] * np.int64(2**31) + ids[start + 1], return_inverse=True)[1]
    window = np.unique(pair * np.int64(2**31) + ids[start + 2], return_inverse=True)[1]
    key = doc[start] * np.int64(window.max() + 1) + window
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    hit = start[count[inverse] > 1]
    covered = np.zeros(len(ids) + 1, dtype=bool)
    for shift in range(3):
        covered[hit + shift] = True
    total = np.concatenate(([0], np.cumsum(covered[:-1])))
    return total[ends] - total[ends - sizes]


def echoes(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per document, the words that stand among the ``ECHO`` words before them."""
    if not len(ids):
        return np.zeros(len(sizes), dtype=np.int64)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    key = doc * np.int64(ids.max() + 1) + ids
    order = np.argsort(key, kind="stable")
    near = (key[order][1:] == key[order][:-1]) & (order[1:] - order[:-1] <= ECHO)
    return np.bincount(doc[order[1:][near]], minlength=len(sizes))


def _of_word(raw: bytes) -> tuple[int, ...]:
    """What a word adds to each of ``_OF_WORDS``."""
    word = raw.decode()
    n = len(word)
    if word.isalpha() and word.islower():
        return n, 0, 0, 0, 0, 0, n > LONG_WORD, 0
    symbols = sum(map(word.count, SYMBOLS))
    upper = sum(map(str.isupper, word))
    loud = n > 2 and upper > 1 and word.isupper() or word.endswith("!!")
    return n, symbols, upper, symbols > 0, not any(map(str.isalnum, word)), loud, n > LONG_WORD, word.rstrip("\"')]»”’").endswith((".", "!", "?", "…", "。", "।", "؟"))


def _rows(texts: list[str]) -> np.ndarray:
    out = dict.fromkeys(STATS, np.zeros(len(texts), dtype=np.int64))
    number: dict[bytes, int] = {}
    ids, lines = [], np.zeros((len(texts), 3), dtype=np.int64)
    for i, text in enumerate(texts):
        words = text.encode().split()  # bytes split at exactly space and 0x09 to 0x0D
        ids.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)))
        worded = [line for line in text.split("\n") if line.strip(" \t\x0b\f\r")]
        once = set(worded)
        lines[i] = len(worded), len(worded) - len(once), 0 if len(once) == len(worded) else sum(map(len, worded)) - sum(map(len, once))
    out["n_lines"], out["n_dup_lines"], out["n_dup_chars"] = lines.T
    sizes = np.array([len(x) for x in ids], dtype=np.int64)
    if number:
        flat, doc = np.concatenate(ids), np.repeat(np.arange(len(texts)), sizes)
        of_word = np.array([_of_word(w) for w in number], dtype=np.int64)
        out |= {name: np.bincount(doc, of_word[flat, k], len(texts)).astype(np.int64) for k, name in enumerate(_OF_WORDS)}
        out |= {"n_words": sizes, "n_repeat_words": repeat_words(flat, sizes), "n_echoes": echoes(flat, sizes)}
    return np.stack([out[name] for name in STATS], axis=1)


@F.arrow_udf(_STATS_TYPE)
def _stats(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        parts = [_rows(part) for part in slices(texts)]
        values = np.concatenate(parts) if parts else np.zeros((0, len(STATS)), np.int64)
        yield pa.StructArray.from_arrays([pa.array(values[:, k]) for k in range(len(STATS))], names=list(STATS))


text_stats = _stats.asNondeterministic()


def base_failed(s: Column) -> Column:
    return (s["n_words"] < MIN_WORDS) | (s["n_repeat_words"] * 100 > s["n_words"] * MAX_REPEAT_PERCENT)


def votes(s: Column) -> list[tuple[str, Column, Column]]:
    """The rules: name, votes bad, votes good. One that does neither abstains; so do all on a text without words."""
    per_word = lambda name: s[name] / F.greatest(s["n_words"], F.lit(1))
    per_char = lambda name: s[name] / F.greatest(s["word_chars"], F.lit(1))
    per_line = s["n_dup_lines"] / F.greatest(s["n_lines"], F.lit(1))
    length = s["word_chars"] / F.greatest(s["n_words"], F.lit(1))
    above = lambda name, x, bad, good: (name, x > bad, x < good)
    return [
        above("symbols", per_char("n_symbols"), 0.05, 0.02),
        above("marked_words", per_word("n_marked"), 0.2, 0.08),
        above("lone_marks", per_word("n_lone"), 0.2, 0.08),
        above("repeats", per_word("n_repeat_words"), 0.4, 0.15),
        above("echoes", per_word("n_echoes"), 0.75, 0.6),
        above("lines", per_line, 0.4, 0.2),
        above("line_chars", per_char("n_dup_chars"), 0.4, 0.2),
        above("case", per_char("n_upper"), 0.3, 0.15),
        above("loud_words", per_word("n_loud"), 0.2, 0.08),
        ("word_length", (length < 2.5) | (length > 14), length.between(3, 12)),
        above("long_words", per_word("n_long"), 0.1, 0.03),
        ("sentences", per_word("n_ended") < 0.01, per_word("n_ended") > 0.02),
    ]


N_RULES = 12
GOOD, BAD = 1, 2


def pattern(s: Column) -> Column:
    """All votes of a text as one number; rule k at digit k in base 3: 0 abstains, 1 good, 2 bad."""
    some = s["n_words"] > 0
    return sum((F.when(some & bad, BAD).when(some & good, GOOD).otherwise(0) * 3**k for k, (_, bad, good) in enumerate(votes(s))), F.lit(0)).cast("int")


def fit(counts: dict[int, int], rules: int = N_RULES, rounds: int = 500, doubt: float = 0.05) -> tuple[dict[int, float], np.ndarray, np.ndarray]:
    """EM over pattern counts. Returns the quality of each counted pattern, the vote model and the shares of its classes.

    Class 0 is good text, class 1 bad. model[c, k, v] is how often rule k votes v (0 abstains, 1 good, 2 bad) on class c.
    A prior worth a share ``doubt`` of the texts says that rules vote bad rarely on good text and more often on bad text,
    where each sees some of the faults only. It tells the classes apart and keeps a rule from counting as infallible where
    the other rules happened to agree with it throughout, so that a lone vote can be outvoted at every size of corpus.
    """
    patterns = np.array(sorted(counts), dtype=np.int64)
    vote = patterns[:, None] // 3 ** np.arange(rules) % 3
    shown = (vote[:, :, None] == np.arange(3)).astype(float).reshape(len(patterns), rules * 3)
    n = np.array([counts[p] for p in patterns.tolist()], dtype=float)
    prior = np.array([[0.04, 0.94, 0.02], [0.15, 0.55, 0.3]])[:, None, :].repeat(rules, 1)
    prior_shares = np.array([0.85, 0.15])
    model, shares, strength = prior, prior_shares, doubt * n.sum() + 1
    for _ in range(rounds):
        weight = n[:, None] * _belief(shown, model, shares)
        seen = (weight.T @ shown).reshape(2, rules, 3) + strength * prior
        new, new_shares = seen / seen.sum(2, keepdims=True), (weight.sum(0) + strength * prior_shares) / (n.sum() + strength)
        moved = max(np.abs(new - model).max(), np.abs(new_shares - shares).max())
        model, shares = new, new_shares
        if moved < 1e-10:
            break
    return dict(zip(patterns.tolist(), _belief(shown, model, shares)[:, 0].tolist(), strict=True)), model, shares


def _belief(shown: np.ndarray, model: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Posterior of each class for each pattern."""
    log = shown @ np.log(model).reshape(len(model), -1).T + np.log(shares)
    each = np.exp(log - log.max(1, keepdims=True))
    return each / each.sum(1, keepdims=True)


def _learn(patterns: DataFrame) -> dict[int, float]:
    """Quality by pattern, from all rows of column ``pattern``; at most 3 ** N_RULES rows come to the driver."""
    return fit({r["pattern"]: r["n"] for r in patterns.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()})[0]


def assess(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: statistics, base_failed, quality (posterior) and kept."""
    s = F.col("__s")
    rows = docs.select("doc_id", text_stats("text").alias("__s")).select("doc_id", *[s[name].alias(name) for name in STATS], pattern(s).alias("pattern"), base_failed(s).alias("base_failed"))
    rows = scratch.store(rows, "quality-rules")
    learned = _learn(rows)
    quality = F.element_at(F.map_from_arrays(F.lit([*learned] or [0]), F.lit([*learned.values()] or [0.0])), F.col("pattern"))
    rows = rows.withColumn("quality", quality)
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= KEEP)).drop("pattern")


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with its own columns. One pass of statistics, no shuffle; the rows are stored with their votes meanwhile."""
    name, shown, failed = spare(docs, "__s", "__pattern", "__failed")
    s = F.col(name)
    voted = docs.withColumn(name, text_stats(docs[text])).withColumn(shown, pattern(s)).withColumn(failed, base_failed(s)).drop(name)
    voted = scratch.store(voted, "quality-rules")
    learned = _learn(voted.select(F.col(shown).alias("pattern")))
    return voted.where(~F.col(failed) & F.col(shown).isin([p for p, quality in learned.items() if quality >= KEEP])).drop(shown, failed)
