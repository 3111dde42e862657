"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs, in numpy.

A word enters as its own embedding (known words) next to the mean embedding of its hashed character 3-grams, so unseen
spellings are not blank. A text is scored through all its windows of ``WINDOW`` words, one every ``STRIDE``, so that any
passage of up to ``WINDOW - STRIDE + 1`` words lies whole in one of them. The network reads each window in both directions,
attention pools the states into one logit, and the largest logit of the text, put through a fitted logistic curve, is its
score.

Training sees whole-text labels only, so it is multiple-instance: a toxic text teaches through its currently highest
window, a clean text through its highest and two other windows. At most ``TRAIN_PER_CLASS`` labelled texts of each class
come to the driver, ``TRAIN_BYTES`` of them at most, by the least hash of their id; rows whose crc32(doc_id) mod 4 is 2 are
held out. What every score depends on is the text alone.

Defined cases: null counts as empty, and a text without words is scored as one window of padding; a null doc_id is not
held out and has no label; repeated rows are scored alike; without labels of both classes every score is the share of
toxic labels (0 if none); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import slices
from .tokens import Numbers

WINDOW, STRIDE = 48, 16
BATCH = 512  # windows the network reads at once: their states stay in a core's cache
#: Bounds of the sample the network is fitted on: labelled texts of a class, their bytes in all, bytes of one of them.
TRAIN_PER_CLASS, TRAIN_BYTES, TRAIN_TEXT_BYTES = 2000, 32 << 20, 1 << 20
WORD_DIM, CHAR_DIM, HIDDEN, ATTENTION, BUCKETS = 8, 12, 12, 8, 1 << 13
THRESHOLD = 0.3
MAX_WORDS = 200_000
#: Training: a word becomes known from so many standard deviations on; weights shrink by DECAY a step, times the rate; so many words lose their 3-grams or their embedding.
MIN_LEAN, DECAY, DROP_CHARS, DROP_WORD = 3.0, 0.05, 0.3, 0.05
_TRIM = b".,;:!?*#$%&()[]{}<>|\"'-_=+~/\\"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").split()


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the 3-grams of each word between marks, and how many each word has."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    raw = np.frombuffer(b"\x02" + b"\x03\x02".join(words) + b"\x03\0", np.uint8).astype(np.uint32)
    starts = np.cumsum(sizes + 2) - sizes - 2
    count = np.maximum(sizes, 1)
    at = np.arange(int(count.sum())) + np.repeat(starts - (np.cumsum(count) - count), count)
    code = raw[at] * np.uint32(0x9E3779B1) + raw[at + 1] * np.uint32(0x85EBCA77) + raw[at + 2] * np.uint32(0xC2B2AE3D)
    return ((code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(19)).astype(np.int64), count


def windows(n: int) -> np.ndarray:
    """First words of the overlapping windows of a text of n words; together they cover it."""
    return np.arange(0, max(n - (WINDOW - STRIDE), 1), STRIDE)


def _by_place(places: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of rows of ``values`` by their place, for ``size`` places."""
    order = np.argsort(places, kind="stable")
    found, first = np.unique(places[order], return_index=True)
    out = np.zeros((size, values.shape[1]), np.float32)
    out[found] = np.add.reduceat(values[order], first, axis=0)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    """Parameters, forward pass and gradients. A batch is word rows ``x`` [rows, dim], places ``at`` [batch, time] in it, and a mask."""

    p: dict[str, np.ndarray] = field(default_factory=dict)
    vocabulary: dict[bytes, int] = field(default_factory=dict)
    scale: tuple[float, float] = (1.0, 0.0)

    @classmethod
    def fresh(cls, vocabulary: dict[bytes, int], lean: np.ndarray, seed: int = 5) -> Network:
        """lean: a first guess of how far each known word speaks for a toxic text; it starts the first number of its embedding."""
        rng = np.random.default_rng(seed)
        draw = lambda *shape, s=0.1: (rng.standard_normal(shape) * s).astype(np.float32)
        p = {"E": draw(len(vocabulary) + 1, WORD_DIM), "C": draw(BUCKETS, CHAR_DIM, s=0.3)}
        p["E"][0] = 0
        p["E"][1:, 0] = lean
        for d in "fb":
            p[f"W{d}"], p[f"U{d}"], p[f"b{d}"] = draw(WORD_DIM + CHAR_DIM, 3 * HIDDEN, s=0.3), draw(HIDDEN, 3 * HIDDEN, s=0.3), np.zeros(3 * HIDDEN, np.float32)
        p["A"], p["a"], p["v"] = draw(2 * HIDDEN, ATTENTION, s=0.3), np.zeros(ATTENTION, np.float32), draw(ATTENTION, s=0.3)
        p["w"], p["o"] = draw(2 * HIDDEN, s=0.3), np.zeros(1, np.float32)
        return cls(p, vocabulary)

    def rows(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Inputs of distinct words, and for the gradients their vocabulary places, 3-gram buckets and counts."""
        trimmed = [w.strip(_TRIM) or w for w in words]
        known = np.fromiter((self.vocabulary.get(w, 0) for w in trimmed), np.int64, len(words))
        buckets, count = grams(trimmed)
        ends = np.cumsum(count)
        chars = np.add.reduceat(self.p["C"][buckets], ends - count, axis=0) / count[:, None] if len(words) else np.zeros((0, CHAR_DIM), np.float32)
        return np.hstack([self.p["E"][known], chars]).astype(np.float32), known, buckets, count

    def project(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {d: x @ self.p[f"W{d}"] + self.p[f"b{d}"] for d in "fb"}

    def _direction(self, d: str, g: np.ndarray, at: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
        U, H = self.p[f"U{d}"], HIDDEN
        n, steps = at.shape
        h = np.zeros((n, H), np.float32)
        out = np.empty((steps, n, H), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            x, u = g[at[:, t]], h @ U
            zr = _sigmoid(x[:, : 2 * H] + u[:, : 2 * H])
            z, r = zr[:, :H], zr[:, H:]
            c = np.tanh(x[:, 2 * H :] + r * u[:, 2 * H :])
            m = mask[:, t, None]
            new = h + m * (1 - z) * (c - h)
            if keep is not None:
                keep.append((t, h, z, r, c, u[:, 2 * H :], m))
            h = new
            out[t] = h
        return out

    def forward(self, g: dict[str, np.ndarray], at: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows."""
        kf, kb = ([], []) if keep is not None else (None, None)
        h = np.concatenate([self._direction("f", g["f"], at, mask, kf), self._direction("b", g["b"], at, mask, kb)], axis=2)
        e = np.tanh(h @ self.p["A"] + self.p["a"])
        s = e @ self.p["v"] + (mask.T - 1) * 30
        s = np.exp(s - s.max(0))
        alpha = s / s.sum(0)
        pooled = (alpha[:, :, None] * h).sum(0)
        if keep is not None:
            keep.update(h=h, e=e, alpha=alpha, pooled=pooled, f=kf, b=kb)
        return pooled @ self.p["w"] + self.p["o"][0]

    def gradients(self, words: list[bytes], at: np.ndarray, mask: np.ndarray, label: np.ndarray, kept: np.ndarray | None = None) -> dict[str, np.ndarray]:
        p, H = self.p, HIDDEN
        x, known, buckets, count = self.rows(words)
        if kept is not None:
            x = x * kept
        k: dict = {}
        logit = self.forward(self.project(x), at, mask, k)
        d_logit = ((_sigmoid(logit) - label) / len(label)).astype(np.float32)
        g = {"w": k["pooled"].T @ d_logit, "o": np.array([d_logit.sum()], np.float32)}
        d_pooled = d_logit[:, None] * p["w"]
        dh = k["alpha"][:, :, None] * d_pooled
        d_alpha = (k["h"] * d_pooled).sum(2)
        d_s = k["alpha"] * (d_alpha - (k["alpha"] * d_alpha).sum(0))
        g["v"] = np.einsum("tn,tna->a", d_s, k["e"])
        d_e = d_s[:, :, None] * p["v"] * (1 - k["e"] ** 2)
        g["a"] = d_e.sum((0, 1))
        g["A"] = k["h"].reshape(-1, 2 * H).T @ d_e.reshape(-1, ATTENTION)
        dh += d_e @ p["A"].T
        dx = np.zeros_like(x)
        for d, part in (("f", dh[:, :, :H]), ("b", dh[:, :, H:])):
            U = p[f"U{d}"]
            d_in, d_U, carry = np.empty((at.shape[1], len(at), 3 * H), np.float32), np.zeros_like(U), np.zeros((len(at), H), np.float32)
            for t, h, z, r, c, uc, m in reversed(k[d]):
                dn = part[t] + carry
                d_c = dn * m * (1 - z) * (1 - c * c)
                d_z = dn * m * (h - c) * z * (1 - z)
                d_r = d_c * uc * r * (1 - r)
                d_u = np.hstack([d_z, d_r, d_c * r])
                carry = dn * (1 - m * (1 - z)) + d_u @ U.T
                d_U += h.T @ d_u
                d_in[t] = np.hstack([d_z, d_r, d_c])
            d_g = _by_place(at.T.reshape(-1), d_in.reshape(-1, 3 * H), len(x))
            g[f"U{d}"], g[f"W{d}"], g[f"b{d}"] = d_U, x.T @ d_g, d_g.sum(0)
            dx += d_g @ p[f"W{d}"].T
        if kept is not None:
            dx = dx * kept
        g["E"] = _by_place(known, dx[:, :WORD_DIM], len(p["E"]))
        g["E"][0] = 0
        g["C"] = _by_place(buckets, np.repeat(dx[:, WORD_DIM:] / count[:, None], count, axis=0), len(p["C"]))
        return g


class Scorer:
    """Scores texts with a network; keeps the projected inputs of words met before, ``MAX_WORDS`` at most."""

    def __init__(self, net: Network) -> None:
        self.net = net
        self._clear()

    def _clear(self) -> None:
        self.number = Numbers()
        self.g = self.net.project(self.net.rows([b""])[0])  # place 0 pads

    def places(self, words: list[bytes]) -> np.ndarray:
        if len(self.number) > MAX_WORDS:
            self._clear()
        which, new = self.number.of(words)
        if new:
            more = self.net.project(self.net.rows(new)[0])
            self.g = {d: np.concatenate([self.g[d], more[d]]) for d in "fb"}
        return which + 1

    def window_logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
        """Logits of all windows of the texts in turn, the text of each, and the words."""
        words = [words_of(t) for t in texts]
        place = np.concatenate([self.places([w for ws in words for w in ws]), np.zeros(WINDOW, np.int64)])
        sizes = np.array([len(w) for w in words])
        begins = [windows(n) for n in sizes]
        text = np.repeat(np.arange(len(texts)), [len(b) for b in begins])
        start = np.concatenate(begins) if begins else np.zeros(0, np.int64)
        base = np.cumsum(sizes) - sizes
        logits = np.empty(len(text), np.float32)
        span = np.arange(WINDOW)
        for lo in range(0, len(text), BATCH):
            t, s = text[lo : lo + BATCH], start[lo : lo + BATCH]
            mask = s[:, None] + span < sizes[t][:, None]
            mask[:, 0] |= ~mask.any(1)  # a text without words: one padding place is read
            at = np.where(mask, place[np.minimum((base[t] + s)[:, None] + span, len(place) - 1)], 0)
            at[sizes[t] == 0] = 0
            used = max(1, int(mask.sum(1).max()))
            logits[lo : lo + BATCH] = self.net.forward(self.g, at[:, :used], mask[:, :used].astype(np.float32))
        return logits, text, words

    def scores(self, texts: list[str]) -> np.ndarray:
        logits, text, _ = self.window_logits(texts)
        if not len(texts):
            return np.zeros(0)
        best = np.maximum.reduceat(logits, np.searchsorted(text, np.arange(len(texts)))).astype(float)
        a, b = self.net.scale
        return 1 / (1 + np.exp(-np.clip(a * best + b, -50, 50)))


def train(texts: list[str], labels: list[int], steps: int = 480, batch: int = 128, rate: float = 0.02, seed: int = 11) -> Network:
    """A network for labelled texts of both classes. The same texts in the same order give the same network."""
    y = np.array(labels)
    words = [words_of(t) for t in texts]
    seen: dict[bytes, list[int]] = {}
    for ws, label in zip(words, labels, strict=True):
        for w in {x.strip(_TRIM) or x for x in ws}:
            seen.setdefault(w, [0, 0])[label] += 1
    # Known words are those that lean to one class beyond chance, by standard deviations of their share of toxic texts.
    base = y.mean()
    lean_of = {w: (n[1] - base * sum(n)) / np.sqrt(sum(n) * base * (1 - base)) for w, n in seen.items() if sum(n) >= 3}
    guess = {w: float(lean_of[w]) for w in sorted(lean_of) if abs(lean_of[w]) >= MIN_LEAN}
    net = Network.fresh({w: i for i, w in enumerate(guess, 1)}, np.clip(np.array([*guess.values()]) / 6, -1, 2))
    rng = np.random.default_rng(seed)
    begins = [windows(len(ws)) for ws in words]
    text = np.repeat(np.arange(len(texts)), [len(b) for b in begins])
    start = np.concatenate(begins)
    first = np.searchsorted(text, np.arange(len(texts)))
    # Before the first epoch the windows of a text are ranked by the most telling word in them.
    value = np.array([max((guess.get(w.strip(_TRIM) or w, 0.0) for w in words[t][s : s + WINDOW]), default=0.0) for t, s in zip(text, start, strict=True)])
    moment, step = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}, 0
    # Toxic texts repeat until they are about a quarter of an epoch; small samples get more epochs.
    often = max(1, round((3 * (y == 0).sum()) / (3 * y.sum())))
    epochs = int(np.clip(np.ceil(steps * batch / (3 * (y == 0).sum() + often * y.sum())), 5, 40))
    for epoch in range(epochs):
        order = np.lexsort((-value, text))  # per text, best windows first
        top = order[first]
        clean = np.flatnonzero(y == 0)
        size = np.diff(np.append(first, len(text)))
        other = first[clean].repeat(2) + (rng.random(2 * len(clean)) * size[clean].repeat(2)).astype(np.int64)
        toxic = np.tile(top[y == 1], often)
        chosen_windows = np.concatenate([toxic, top[clean], other])
        target = np.concatenate([np.ones(len(toxic), int), np.zeros(len(clean) + len(other), int)])
        shuffle = rng.permutation(len(chosen_windows))
        for lo in range(0, len(shuffle), batch):
            part = shuffle[lo : lo + batch]
            picked = [words[text[i]][start[i] : start[i] + WINDOW] for i in chosen_windows[part]]
            distinct = {b"": 0} | {w: i for i, w in enumerate(dict.fromkeys(w for ws in picked for w in ws), 1)}
            at, mask = np.zeros((len(part), WINDOW), np.int64), np.zeros((len(part), WINDOW), np.float32)
            for i, ws in enumerate(picked):
                at[i, : len(ws)], mask[i, : max(1, len(ws))] = [distinct[w] for w in ws], 1
            kept = np.repeat(rng.random((len(distinct), 2)) >= (DROP_WORD, DROP_CHARS), (WORD_DIM, CHAR_DIM), axis=1).astype(np.float32)
            grads = net.gradients([*distinct], at, mask, target[part], kept)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            step += 1
            pace = rate * (1 - 0.8 * epoch / epochs)
            for name, g in grads.items():
                g = g * min(1.0, 5.0 / (norm + 1e-9))
                m, v = moment[name]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                if name in "EC" or name[0] in "WUA":
                    net.p[name] *= np.float32(1 - pace * DECAY)
                net.p[name] -= (pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        scorer = Scorer(net)
        value = np.concatenate([scorer.window_logits(texts[i : i + 200])[0] for i in range(0, len(texts), 200)]).astype(float)
    net.scale = _curve(np.maximum.reduceat(value, first), y)
    return net


def _curve(best: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic curve from the best window's logit to the label, with softened targets and a slope of at least 0."""
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(a * best + b, -50, 50)))
        w = q * (1 - q) + 1e-6
        h = np.array([[(w * best * best).sum() + 1e-2, (w * best).sum()], [(w * best).sum(), w.sum() + 1e-2]])
        da, db = np.linalg.solve(h, [((target - q) * best).sum() - 1e-2 * (a - 1), (target - q).sum()])
        a, b = max(0.05, a + np.clip(da, -0.5, 0.5)), b + np.clip(db, -1, 1)
    return float(a), float(b)


def sample(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS) -> tuple[list[str], list[int]]:
    """At most ``per_class`` labelled texts of each class that are not held out, in a fixed order.

    Of these, texts beyond ``TRAIN_TEXT_BYTES`` teach nothing, and the rest only up to ``TRAIN_BYTES`` a class, by the hash of
    their ids: what the driver collects is bounded in bytes, however long the texts are. Repeated rows count at most twice
    ``per_class`` a class.
    """
    spread = F.xxhash64("doc_id", F.lit("toxicity"))
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    chosen = None
    for label in (0, 1):
        part = known.where(F.col("toxic") == label).distinct().orderBy(spread, "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    size = F.octet_length(F.coalesce("text", F.lit("")))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where(size <= TRAIN_TEXT_BYTES)  # 2 * per_class ids
    before = Window.partitionBy("toxic").orderBy(spread, "doc_id", "text").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("total", F.sum(size).over(before)).withColumn("place", F.count(F.lit(1)).over(before))
    rows = rows.where((F.col("total") <= TRAIN_BYTES) & (F.col("place") <= 2 * per_class)).select("toxic", "doc_id", "text").collect()
    rows = sorted((r["toxic"], r["doc_id"], r["text"] or "") for r in rows)
    return [r[2] for r in rows], [r[0] for r in rows]


def _score_udf(net: Network | None, share: float):
    @F.arrow_udf(T.DoubleType())
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(net) if net else None
        for texts in batches:
            if scorer is None:
                yield pa.array(np.full(len(texts), share))
            else:
                parts = [scorer.scores(part) for part in slices(texts, 2_000_000)]
                yield pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return run.asNondeterministic()


def score(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs(doc_id, text)``; learns from ``labels(doc_id, toxic)``."""
    texts, toxic = sample(docs, labels, per_class)
    both = 0 < sum(toxic) < len(toxic)
    net = train(texts, toxic) if both else None
    rows = docs.select("doc_id", held_out(docs["doc_id"]).alias("held_out"), _score_udf(net, sum(toxic) / max(1, len(toxic)))("text").alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
