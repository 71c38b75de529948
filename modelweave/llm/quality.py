"""Quality classification with hierarchical empirical Bayes.

Method: a logistic classifier turns properties of a document's text into evidence.  Among them are
two mean log-odds: of its distinct words and of its strings of four bytes, each hashed to SLOTS and
weighed by how labelled documents of either kind hold it (naive Bayes).  The probabilities, summed
per host and per path of a host, give site posteriors: a host's mean is shrunk toward the global
mean and a path's toward its host's, each by as many pseudo-documents as the spread between groups
calls for (method of moments over grouped sums).  A document's quality joins its own evidence with
its path's posterior as the prior, leaving its own probability out of that.

Where the table has a column ``url``, its host and the first part of its path are the site; else,
or if they are named, two columns stand for them (``source``, and ``lang`` within a source).

Defined cases: a null or empty text has the properties of an empty text; a null host or path is a
group of its own; repeated rows are counted once each; without labels of both kinds the evidence is
0.5 for all; an empty table gives no rows; labels with a null are ignored and a document's labels
are averaged; extra columns are ignored.

Fitting: the classifier sees at most FIT_ROWS labelled documents, chosen by a hash of the id among
the labels; one half of them gives the log-odds, the other the weights of the properties.
Site statistics cover all documents.

Scale: one map over the texts, whose small result is written to the shared folder; grouped sums
with map-side combination, so a host with a third of all rows is one row per task; the few columns
of the sites are joined back, by broadcast only if they were counted as few.
"""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from . import common

FIT_ROWS = 20_000
THRESHOLD = 0.5
#: Pseudo-documents: bounds for what the moments give.
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 1000.0

FEATURES = (
    "log_words", "word_length", "distinct_words", "top_word", "symbols", "digits", "upper", "odd_words",
    "sentence_words", "repeated_lines", "repeated_next", "non_ascii", "word_odds", "gram_odds",
)
#: Slots that words are hashed to, and again so many for strings of GRAM bytes.
SLOTS, GRAM = 1 << 15, 4
#: Added to the counts of a slot.
SMOOTHING = 0.5
# classes of bytes: 1 letters, 2 upper case, 3 digits, 4 space, 5 other ASCII signs, 6 beyond ASCII
_CLASS = np.full(256, 5, np.uint8)
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[[9, 10, 11, 12, 13, 32]] = 4
_CLASS[128:] = 6
_ODD = re.compile(r"[^\w\s.,;:!?'\"()-]").search


def slots(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(slots of the distinct words, slots of the distinct strings of GRAM bytes) of a text in lower case."""
    low = text.lower()
    words = np.unique(np.array([crc32(w.encode("utf-8", "replace")) for w in set(low.split())], np.uint32) % np.uint32(SLOTS))
    raw = low.encode("utf-8", "replace")
    if len(raw) < GRAM:
        return words, np.zeros(0, np.uint32)
    grams = np.ndarray(len(raw) - GRAM + 1, "<u4", raw, strides=(1,))
    return words, np.flatnonzero(np.bincount((grams * np.uint32(2654435761)) >> np.uint32(17), minlength=SLOTS)).astype(np.uint32)


def features(text: str | None, odds: np.ndarray | None = None) -> list[float]:
    """Properties of a whole text, in the order of FEATURES; ``odds``: [2, SLOTS] of words and strings of bytes."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    kinds = np.bincount(_CLASS[raw], minlength=7) / max(1, len(raw))
    words = text.split()
    n = max(1, len(words))
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in text.split("\n") if x]
    odd = sum(k for w, k in counts.items() if not w.isalnum() and _ODD(w))
    same = sum(map(str.__eq__, words, words[1:]))
    own = [0.0, 0.0] if odds is None else [float(o[at].mean()) if len(at) else 0.0 for o, at in zip(odds, slots(text))]
    return [
        float(np.log1p(len(words))), len(text) / n, len(counts) / n, max(counts.values(), default=0) / n, float(kinds[5]), float(kinds[3]), float(kinds[2]), odd / n,
        float(np.log1p(n / (1 + text.count(".") + text.count("\n")))), 1 - len(set(lines)) / max(1, len(lines)), same / n, float(kinds[6]), *own,
    ]


def log_odds(counts: np.ndarray, good: float, bad: float) -> np.ndarray:
    """[2, SLOTS] log-odds; ``counts``: [2, SLOTS, 2] documents that are bad and good, by slot; ``good``, ``bad``: all of them."""
    shares = (counts + SMOOTHING) / (np.array([bad, good]) + 2 * SMOOTHING)
    return np.log(shares[..., 1]) - np.log(shares[..., 0])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, np.ndarray]:
    """(intercept, weights) on the raw scale, by Newton steps on standardised columns."""
    if len(y) == 0 or y.min() == y.max():
        return 0.0, np.zeros(x.shape[1] if x.ndim == 2 else len(FEATURES))
    mean, spread = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([np.ones(len(y)), (x - mean) / spread])
    w = np.zeros(z.shape[1])
    penalty = np.diag([0.0, *[ridge] * (z.shape[1] - 1)])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty + 1e-9 * np.eye(len(w)), z.T @ (y - p) - penalty @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    weights = w[1:] / spread
    return float(w[0] - weights @ mean), weights


def site(docs: DataFrame, host: str | None, path: str | None) -> tuple[Column, Column]:
    """Host and path of a document."""
    if host is None and path is None and "url" in docs.columns:
        parts = F.split(F.try_parse_url("url", F.lit("PATH")), "/")
        return F.lower(F.try_parse_url("url", F.lit("HOST"))), F.when(F.size(parts) > 2, parts[1])
    return F.col(host or "source").cast("string"), F.col(path or "lang").cast("string")


def describe(docs: DataFrame, host: str | None, path: str | None, odds: np.ndarray | None) -> DataFrame:
    """key (a hash of id and text), doc_id, host, path and features of all documents."""
    schema = "key long, doc_id long, host string, path string, f array<double>"
    shared = docs.sparkSession.sparkContext.broadcast(odds)  # 2 * SLOTS numbers

    def run(batch: pa.RecordBatch) -> dict:
        return {**{x: batch[x] for x in ("key", "doc_id", "host", "path")}, "f": [features(t, shared.value) for t in batch["text"].to_pylist()]}

    key = F.xxhash64("doc_id", "text").alias("key")
    own = site(docs, host, path)
    rows = docs.select(key, F.col("doc_id").cast("long").alias("doc_id"), own[0].alias("host"), own[1].alias("path"), "text")
    return common.map_arrow(rows, run, schema)


def fit(docs: DataFrame, labels: DataFrame, most: int) -> tuple[np.ndarray | None, float, np.ndarray]:
    """(log-odds of slots, intercept, weights of FEATURES) from at most ``most`` labelled documents."""
    spark = docs.sparkSession
    mean = labels.where(F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.avg("quality").alias("y"))
    chosen = _lowest(mean.where(F.col("id").isNotNull()).withColumn("h", F.xxhash64("id")), most)
    few = spark.createDataFrame([(r["id"], float(r["y"]), r["h"] % 2) for r in chosen], "id long, y double, half int")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(few), F.col("doc_id") == F.col("id"))  # at most ``most`` rows are broadcast
    rows = common.durable(texts.select("y", "half", "text"), "labelled")

    def held(batch: pa.RecordBatch) -> dict:
        """Documents, bad and good ones, that hold each slot: of a slice of documents a row for each slot."""
        total = np.zeros((2 * SLOTS, 2))
        for y, t in zip(batch["y"].to_pylist(), batch["text"].to_pylist()):
            words, grams = slots(t or "")
            total[np.concatenate([words, grams + np.uint32(SLOTS)])] += (1 - y, y)
        some = np.flatnonzero(total.any(1))
        return {"slot": some, "bad": total[some, 0], "good": total[some, 1]}

    own = common.map_arrow(rows.where("half = 0").select("y", "text"), held, "slot int, bad double, good double", 1024)
    sums = own.groupBy("slot").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).collect()  # 2 * SLOTS rows at most
    all_ = rows.where("half = 0").agg(F.sum("y").alias("good"), F.sum(1 - F.col("y")).alias("bad")).first()
    odds = None
    if all_["good"] and all_["bad"]:
        counts = np.zeros((2 * SLOTS, 2))
        for r in sums:
            counts[r["slot"]] = r["bad"], r["good"]
        odds = log_odds(counts.reshape(2, SLOTS, 2), all_["good"], all_["bad"])
    shared = spark.sparkContext.broadcast(odds)

    def described(batch: pa.RecordBatch) -> dict:
        return {"y": batch["y"], "f": [features(t, shared.value) for t in batch["text"].to_pylist()]}

    # without the second half the first serves both
    half = rows.where("half <> 0") if odds is not None else rows
    found = common.map_arrow(half.select("y", "text"), described, "y double, f array<double>").orderBy("y", "f").collect()  # at most ``most`` rows
    common.drop(rows)
    bias, weights = fit_logistic(np.array([r["f"] for r in found]).reshape(len(found), len(FEATURES)), np.array([r["y"] for r in found]))
    return odds, bias, weights


def _logit(p: Column) -> Column:
    bound = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(bound / (1 - bound))


def _strength(groups: DataFrame, mean: str) -> float:
    """Pseudo-documents of the prior: from the spread of group means around ``mean`` (columns n, s)."""
    own = F.col("s") / F.col("n")
    row = groups.select(
        F.sum(F.col("n") * (own - F.col(mean)) ** 2).alias("between"), F.sum(F.col("n") * F.col(mean) * (1 - F.col(mean))).alias("within"),
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("n2"), F.count(F.lit(1)).alias("groups"),
    ).first()
    if not row["n"] or row["groups"] < 2:
        return MOST_STRENGTH
    spread = row["within"] / row["n"]  # variance of a single document
    effective = row["n"] - row["n2"] / row["n"]
    share = (row["between"] - (row["groups"] - 1) * spread) / max(1e-12, effective * spread)
    return float(np.clip(1 / share - 1 if share > 0 else MOST_STRENGTH, LEAST_STRENGTH, MOST_STRENGTH))


def _lowest(rows: DataFrame, most: int) -> list[Row]:
    """The ``most`` rows with the lowest hashes (column h, ties by the other columns).

    Rows whose hash is too high for that stay on the executors: else each task would send ``most`` rows to the driver.
    """
    n = rows.count()
    share = 1.5 * most / max(1, n)
    while True:
        low = rows if share >= 1 else rows.where(F.col("h") <= int(share * 2**64) - 2**63)
        found = low.orderBy("h", *(c for c in rows.columns if c != "h")).limit(most).collect()
        if len(found) >= min(most, n) or share >= 1:
            return found
        share *= 4


def score(docs: DataFrame, labels: DataFrame, host: str | None = None, path: str | None = None, threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS) -> DataFrame:
    """key, doc_id, evidence, host_posterior, path_posterior, quality, kept (quality >= threshold)."""
    odds, bias, weights = fit(docs, labels, fit_rows)
    rows = common.durable(describe(docs, host, path, odds), "features")
    z = F.lit(bias)
    for k, w in enumerate(weights.tolist()):
        z = z + F.lit(w) * F.col("f")[k]
    rows = rows.select("key", "doc_id", "host", "path", (1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-12.0)), F.lit(12.0))))).alias("evidence"))

    total = F.sum("evidence").alias("s"), F.count(F.lit(1)).alias("n")
    paths = common.durable(rows.groupBy("host", "path").agg(*total), "paths")
    hosts = paths.groupBy("host").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    whole = hosts.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    mean = whole["s"] / whole["n"] if whole["n"] else 0.5
    hosts = hosts.withColumn("mean", F.lit(mean))
    k_host = _strength(hosts, "mean")
    hosts = hosts.select("host", ((F.lit(k_host * mean) + F.col("s")) / (k_host + F.col("n"))).alias("host_posterior"))
    both = paths.join(hosts.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h"))).drop("h")
    k_path = _strength(both, "host_posterior")
    both = both.withColumnsRenamed({"host": "h", "path": "p"})
    joined = common.join_checked(rows, both, rows["host"].eqNullSafe(both["h"]) & rows["path"].eqNullSafe(both["p"]), "inner", paths.count())
    # the document's own probability isn't part of its prior
    prior = (k_path * F.col("host_posterior") + F.col("s") - F.col("evidence")) / (k_path + F.col("n") - 1)
    out = joined.withColumn("path_posterior", F.least(F.greatest(prior, F.lit(0.0)), F.lit(1.0)))
    final = _logit(F.col("evidence")) + _logit(F.col("path_posterior")) - _logit(F.lit(mean))
    out = out.withColumn("quality", 1 / (1 + F.exp(-final)))
    return out.select("key", "doc_id", "evidence", "host_posterior", "path_posterior", "quality", (F.col("quality") >= threshold).alias("kept"))


def good(docs: DataFrame, labels: DataFrame, host: str | None = None, path: str | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all their columns, whose quality is at least ``threshold``.

    Rows of one id and text that differ in host are kept if none of them is rejected."""
    bad = common.durable(score(docs, labels, host, path, threshold).where("NOT kept").select("key").distinct(), "rejected")
    return common.join_checked(docs, bad, F.xxhash64(docs["doc_id"], docs["text"]) == bad["key"], "left_anti", bad.count())
