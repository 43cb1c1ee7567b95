"""Quality classifier: a document's own evidence combined with what is known of its site, by hierarchical empirical Bayes.

1. A logistic regression on a dozen figures of the text (capitals, symbols, repeats, variety of words, ...) is fitted on
   at most ``TRAIN_ROWS`` labelled documents, those with the smallest hash of their id. It gives every document a logit.
2. Good-document rates are summed up by host and by path within the host. A host's rate is shrunk toward the global
   rate and a path's rate toward its host's, by as many pseudo-documents as the spread of the rates themselves suggests
   (method of moments), so that a site with few documents says little. A document's own share is taken out of its site.
3. The document's logit moves by how far its path's shrunk rate lies from the global rate. It is kept at a posterior of
   ``KEEP_AT`` or more.

Nulls: a null text counts as empty; null hosts and paths are sites of their own; labels without id or quality are
skipped (of several labels for one id the worst counts). Without labels of both kinds there is no evidence: everything
is kept. In ``kept_documents`` rows without doc_id stay, and of rows that share one all stay unless all are rejected.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, kernels

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bound of the labelled sample that the driver fits the classifier on.
TRAIN_ROWS = 20_000
KEEP_AT = 0.5
RIDGE = 1e-5
#: Logits are held within this, pseudo-documents of a site within these.
LOGIT_BOUND, LEAST_WEIGHT, MOST_WEIGHT = 30.0, 5.0, 1e6
CAPITALS, SYMBOLS, DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"!\"#$%&'()*+-/:;<=>?@[\\]^_`{|}~", b"0123456789"


def figures(text: str | None) -> list[float]:
    """Shares are damped by a constant, so that short texts have no extreme values."""
    raw = kernels.as_bytes(text)
    words = raw.split()
    size, n = len(raw), len(words)
    share = [(size - len(raw.translate(None, some))) / (size + 100) for some in (CAPITALS, SYMBOLS, DIGITS)]
    again = sum(a == b for a, b in zip(words, words[1:])) / (n + 20)
    bare = sum(not w.isalnum() and w.isascii() and not w.strip(SYMBOLS) for w in words) / (n + 20)
    kinds = len(set(words))
    variety = kinds / (n + 20)
    lines = raw.count(b"\n") / (n + 20)
    width = (size - n) / (n + 5)
    return [1.0, *share, *(x**0.5 for x in share[:2]), again, again**0.5, bare, variety, np.log1p(kinds) / 10, np.log1p(n) / 10, lines, width / 10]


FIGURES = 14


def fitted(x: np.ndarray, good: np.ndarray) -> np.ndarray | None:
    """Weights of the logistic regression by Newton's method with a ridge; None without both kinds."""
    if not len(good) or good.min() == good.max():
        return None
    w = np.zeros(x.shape[1])
    ridge = RIDGE * len(good) * np.eye(x.shape[1])
    ridge[0, 0] *= 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -LOGIT_BOUND, LOGIT_BOUND)))
        gradient = x.T @ (good - p) - ridge @ w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, gradient)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _figures_of(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernels.small(batches):
            rows = [figures(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "good", "x"])

    return docs.select("doc_id", "good", "text").mapInArrow(run, "doc_id long, good int, x array<double>")


def trained(docs: DataFrame, labels: DataFrame) -> np.ndarray | None:
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("good"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    # At most TRAIN_ROWS rows of two numbers.
    met = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    rows = sorted((r["doc_id"], r["good"], r["x"]) for r in _figures_of(met).collect())
    if not rows:
        return None
    return fitted(np.array([r[2] for r in rows]), np.array([r[1] for r in rows], dtype=float))


def _logits(docs: DataFrame, host: str, path: str, weights: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernels.small(batches):
            x = np.array([figures(t) for t in batch.column(3).to_pylist()]).reshape(-1, FIGURES)
            logit = np.clip(x @ weights, -LOGIT_BOUND, LOGIT_BOUND)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(logit)], ["doc_id", "host", "path", "logit"])

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), "text"
    )
    return rows.mapInArrow(run, "doc_id long, host string, path string, logit double")


def _chance(logit: Column) -> Column:
    return 1 / (1 + F.exp(-logit))


def _logit(chance: Column) -> Column:
    p = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), chance))
    return F.ln(p / (1 - p))


def _weight(rates: DataFrame, center: Column) -> float:
    """Pseudo-documents of the prior, from the spread of ``good / n`` about ``center`` beyond what chance makes of it."""
    rate = F.col("good") / F.col("n")
    row = rates.agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * (rate - center) * (rate - center)).alias("spread"),
        F.sum(center * (1 - center)).alias("chance"),
        F.sum(F.col("n") * center * (1 - center)).alias("most"),
    ).first()
    if not row["n"] or not row["most"]:
        return MOST_WEIGHT
    between = max(row["spread"] - row["chance"], 0.0) / row["most"]
    return float(min(max(1 / between - 1 if between > 0 else MOST_WEIGHT, LEAST_WEIGHT), MOST_WEIGHT))


def scores(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """One row per row of ``docs``: doc_id, evidence (the classifier's chance), host_rate, path_rate, posterior, kept."""
    scratch = common.Scratch(docs.sparkSession, "quality")
    weights = trained(docs, labels)
    if weights is None:
        none = F.lit(None).cast("double")
        columns = [none.alias(c) for c in ("evidence", "host_rate", "path_rate", "posterior")]
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *columns, F.lit(True).alias("kept"))
    found = scratch.write(_logits(docs, host, path, weights), "logits").withColumn("evidence", _chance(F.col("logit")))

    paths = scratch.write(found.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("evidence").alias("good")), "paths", 16)
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    total = paths.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    overall = (total["good"] or 0.0) / (total["n"] or 1)
    host_weight = _weight(hosts, F.lit(overall))
    shrunk = hosts.select(
        F.col("host").alias("of"),
        F.col("n").alias("host_n"),
        F.col("good").alias("host_good"),
        ((F.col("good") + host_weight * overall) / (F.col("n") + host_weight)).alias("center"),
    )
    sites = scratch.write(paths.join(shrunk, F.col("host").eqNullSafe(F.col("of"))).drop("of"), "sites", 16)
    path_weight = _weight(sites, F.col("center"))

    site = sites.select(F.col("host").alias("sh"), F.col("path").alias("sp"), "n", "good", "host_n", "host_good")
    met = found.join(site, F.col("host").eqNullSafe(F.col("sh")) & F.col("path").eqNullSafe(F.col("sp")), "left")
    own = F.col("evidence")
    host_rate = (F.col("host_good") - own + host_weight * overall) / (F.col("host_n") - 1 + host_weight)
    path_rate = (F.col("good") - own + path_weight * F.col("host_rate")) / (F.col("n") - 1 + path_weight)
    met = met.withColumn("host_rate", host_rate).withColumn("path_rate", path_rate)
    posterior = _chance(F.col("logit") + _logit(F.col("path_rate")) - _logit(F.lit(overall)))
    met = met.withColumn("posterior", posterior)
    return met.select("doc_id", "evidence", "host_rate", "path_rate", "posterior", (F.col("posterior") >= KEEP_AT).alias("kept"))


def kept_documents(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """``docs`` without the rejected ones, all columns as they are."""
    decided = scores(docs, labels, host, path).groupBy("doc_id").agg(F.max("kept").alias("_kept"))
    return common.met_by_id(docs, decided.where("not _kept").select("doc_id"), "left_anti")
