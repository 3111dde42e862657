"""Quality classifier with hierarchical empirical Bayes.

1. Document evidence: logistic regression over text statistics, trained on a bounded sample of labelled rows.
2. Sites: the mean evidence of a host is shrunk toward the corpus mean, that of a path toward its host, each by as many
   pseudo-documents as the spread between sites calls for (method of moments over grouped sums). A site with few
   documents thus says little; if sites don't differ, none says anything.
3. Posterior: document log odds plus the path's log odds over the corpus's, the path being taken without the document itself.

Only sums per host and per path are grouped (partial aggregates), so a host with a third of all rows costs a row per task.

Defined cases: null text counts as empty; a null host or path is a site of its own; null and repeated ids are carried row
by row; without labels of both classes the evidence is the share of good labels (one half if none) for every text; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch
from .quality_rules import text_stats
from .ranks import beside

TRAIN_ROWS = 20_000
KEEP = 0.5
MOST_PSEUDO = 1e6


def features(s: Column) -> list[Column]:
    """Numbers of about 0 to 1 from the statistics of ``quality_rules``."""
    part = lambda a, b, top: F.least(s[a] / F.greatest(s[b], F.lit(1)), F.lit(top)) / top
    return [
        F.least(F.log1p(s["n_words"]) / 10, F.lit(1.0)), part("word_chars", "n_words", 12.0), part("n_symbols", "word_chars", 0.1), part("n_dup_lines", "n_lines", 0.5),
        part("n_repeat_words", "n_words", 0.5), part("n_upper", "word_chars", 0.3), part("n_loud", "n_words", 0.2), part("n_echoes", "n_words", 1.0),
    ]


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights (intercept first) of a ridge logistic regression, by Newton's method."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.diag([1e-3, *[1.0] * (x.shape[1] - 1)])
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + penalty * len(x) / 100, x.T @ (y - q) - penalty @ w * len(x) / 100)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _strength(sums: dict[str, float]) -> float:
    """Pseudo-documents to shrink by: variance within sites over variance between them (method of moments)."""
    k, n, n2, within, between = (float(sums[name] or 0) for name in ("k", "n", "n2", "within", "between"))
    if k < 2 or n <= k:
        return MOST_PSEUDO
    noise = within / (n - k)
    tau = (between - (k - 1) * noise) / max(n - n2 / n, 1e-9)
    return float(np.clip(noise / tau, 1.0, MOST_PSEUDO)) if tau > 0 else MOST_PSEUDO


def _sites(rows: DataFrame, over: list[str], inner: list[str], prior: Column) -> dict[str, float]:
    """Sums for ``_strength``. rows: (n, s, ss) per site of ``inner``; prior: the mean of the site above."""
    mean = F.col("s") / F.col("n")
    return rows.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n").cast("double")).alias("n2"), F.sum(F.col("ss") - F.col("s") * mean).alias("within"), F.sum(F.col("n") * F.pow(mean - prior, 2)).alias("between")).first().asDict()


def score(docs: DataFrame, labels: DataFrame, host: Column, path: Column, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, evidence, host_quality, path_quality, quality, kept) for every row of ``docs(doc_id, text)``.

    host and path: expressions over the columns of ``docs``; path counts inside its host. labels: (doc_id, quality).
    """
    s = F.col("__s")
    rows = docs.select("doc_id", host.cast("string").alias("host"), path.cast("string").alias("path"), text_stats("text").alias("__s")).select("doc_id", "host", "path", F.array(*features(s)).alias("x"))
    rows = scratch.store(rows, "site-rows")
    known = labels.select("doc_id", F.col("quality").cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).distinct()
    order = F.xxhash64("doc_id", F.lit("site quality"))
    chosen = known.orderBy(order, "doc_id").limit(train_rows)
    sample = sorted((r["doc_id"], r["y"], *r["x"]) for r in rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "x").orderBy(order, "doc_id").limit(2 * train_rows).collect())
    y = np.array([r[1] for r in sample])
    if len(y) and 0 < y.sum() < len(y):
        w = fit(np.array([r[2:] for r in sample]), y)
    else:
        w = np.zeros(len(features(s)) + 1)
        w[0] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    odds = sum((F.col("x")[i] * float(v) for i, v in enumerate(w[1:])), F.lit(float(w[0])))
    p = 1 / (1 + F.exp(-F.least(F.greatest(odds, F.lit(-12.0)), F.lit(12.0))))
    scored = rows.withColumn("evidence", p)
    paths = scratch.store(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("evidence").alias("s"), F.sum(F.col("evidence") ** 2).alias("ss")), "site-paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    overall = (total["s"] or 0.0) / total["n"] if total["n"] else 0.5
    by_host = _strength(_sites(hosts, [], ["host"], F.lit(overall)))
    in_host = beside(paths, hosts.select("host", (F.col("s") / F.col("n")).alias("host_mean")), ["host"])
    by_path = _strength(_sites(in_host, ["host"], ["host", "path"], F.col("host_mean")))
    hosts = hosts.select("host", ((by_host * F.lit(overall) + F.col("s")) / (by_host + F.col("n"))).alias("host_quality"))
    sites = beside(paths.select("host", "path", "n", "s"), hosts, ["host"])
    joined = beside(scored, sites, ["host", "path"])
    without = (by_path * F.col("host_quality") + F.col("s") - F.col("evidence")) / (by_path + F.col("n") - 1)
    logit = lambda q: F.log(q / (1 - q))
    safe = lambda q: F.least(F.greatest(q, F.lit(1e-6)), F.lit(1 - 1e-6))
    out = joined.withColumn("path_quality", safe(without))
    all_odds = logit(safe(F.col("evidence"))) + logit(F.col("path_quality")) - logit(safe(F.lit(overall)))
    out = out.withColumn("quality", 1 / (1 + F.exp(-all_odds)))
    return out.select("doc_id", "evidence", "host_quality", "path_quality", "quality", (F.col("quality") >= KEEP).alias("kept"))


def site_of(url: Column) -> tuple[Column, Column]:
    """Host and first path segment of a URL, for tables that have one."""
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://([^/:?#]+)", 1)), F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://[^/?#]+(/[^/?#]*)", 1)
