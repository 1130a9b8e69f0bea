"""Quality rules: an isolation forest on rule statistics, its threshold calibrated from labelled rows.

A document's statistics are counted in one pass and staged. The forest is grown on the driver from a pool of the `pool` distinct rows of id and
statistics with the least hash (a documented bound: an isolation tree needs 256 rows whatever the corpus holds); rows found several times are one.
Every document then gets the mean path length over random splits, as the usual score 2^(-E[path]/c(256)): short paths,
high scores, are anomalous. The threshold comes from all labelled documents: a histogram of their scores, by label, is summed
in the cluster, and the cut is the one with the largest (share of bad ones rejected - `clean_weight` * share of good ones rejected).

Defined cases: a null text has no words and fails the base rule; a text of any length is counted whole; repeated rows each get a row; a
score equal to the threshold is kept; of equally good thresholds the middle of the lowest stretch counts; a repeated label counts once, its lowest quality; without labels of both kinds the forest rejects nothing; an empty table gives an empty result. Other
columns of the input are ignored by `score_documents` and kept by `filter_documents`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from prosa.llm.common import stage, unit_hash
from prosa.llm.text_stats import COUNTS, FEATURES, batch_stats

BINS = 4096


@dataclass(frozen=True)
class RulesOptions:
    trees: int = 100
    sample: int = 256
    pool: int = 25_600
    seed: int = 1
    min_words: int = 50
    max_repeat_percent: int = 50
    clean_weight: float = 20.0


def mean_path(n: float) -> float:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    return 0.0 if n <= 1 else 2.0 * (np.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def grow_tree(rows: np.ndarray, depth: int, rng: np.random.Generator) -> np.ndarray:
    """Nodes of one tree as rows (feature or -1, split, left, right, path length at a leaf)."""
    nodes: list[list[float]] = []

    def grow(own: np.ndarray, at: int) -> int:
        k = len(nodes)
        nodes.append([-1, 0.0, 0, 0, at + mean_path(len(own))])
        low, high = (own.min(0), own.max(0)) if len(own) else (np.zeros(1), np.zeros(1))
        varied = np.flatnonzero(high > low)
        if at < depth and len(own) > 1 and len(varied):
            j = int(rng.choice(varied))
            split = float(rng.uniform(low[j], high[j]))
            left = own[:, j] < split
            nodes[k] = [j, split, grow(own[left], at + 1), grow(own[~left], at + 1), 0.0]
        return k

    grow(rows, 0)
    return np.array(nodes)


def grow_forest(pool: np.ndarray, options: RulesOptions) -> list[np.ndarray]:
    rng = np.random.default_rng(options.seed)
    sample = min(options.sample, len(pool))
    depth = max(1, int(np.ceil(np.log2(max(2, options.sample)))))
    return [grow_tree(pool[rng.choice(len(pool), sample, replace=False)], depth, rng) for _ in range(options.trees)] if sample > 1 else []


def anomaly(forest: list[np.ndarray], rows: np.ndarray, options: RulesOptions) -> np.ndarray:
    """Scores in (0, 1) of feature rows; 0.5 without a forest."""
    if not forest or not len(rows):
        return np.full(len(rows), 0.5)
    total, every = np.zeros(len(rows)), np.arange(len(rows))
    for tree in forest:
        feature, left, right = tree[:, 0].astype(np.int64), tree[:, 2].astype(np.int64), tree[:, 3].astype(np.int64)
        at = np.zeros(len(rows), dtype=np.int64)
        while True:
            j = feature[at]
            inner = j >= 0
            if not inner.any():
                break
            at = np.where(inner, np.where(rows[every, np.maximum(j, 0)] < tree[at, 1], left[at], right[at]), at)
        total += tree[at, 4]
    return 2.0 ** (-total / len(forest) / mean_path(options.sample))


def base_failed(counts: np.ndarray, options: RulesOptions) -> np.ndarray:
    return (counts[:, 0] < options.min_words) | (100 * counts[:, 4] > options.max_repeat_percent * counts[:, 0])


@dataclass(frozen=True)
class RulesModel:
    forest: list
    threshold: float
    options: RulesOptions

    def verdict(self, counts: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """base_failed, anomaly score and kept of each row."""
        failed = base_failed(counts, self.options)
        score = anomaly(self.forest, features, self.options)
        return failed, score, ~failed & (score <= self.threshold)


def document_stats(docs: DataFrame) -> DataFrame:
    """doc_id, the COUNTS and the FEATURES of every whole text."""

    def count(batches):
        for batch in batches:
            counts, features = batch_stats(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(counts[:, i]) for i in range(len(COUNTS))), *(pa.array(features[:, i]) for i in range(len(FEATURES)))], names=["doc_id", *COUNTS, *FEATURES])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(count, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", " + ", ".join(f"{c} double" for c in FEATURES))


def columns(batch: pa.RecordBatch, names) -> np.ndarray:
    return np.column_stack([batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names]) if batch.num_rows else np.zeros((0, len(names)))


def choose_threshold(rows: list[tuple[int, int, int]], clean_weight: float) -> float:
    """rows: (bin, quality, count) of labelled documents. The middle of the lowest stretch of best cuts; infinity without both labels."""
    good, bad = np.zeros(BINS + 1), np.zeros(BINS + 1)
    for at, quality, n in rows:
        (good if quality else bad)[at] += n
    if not good.sum() or not bad.sum():
        return float("inf")
    above = lambda x: (x.sum() - np.cumsum(x)) / x.sum()  # noqa: E731  share in bins over each bin
    gain = above(bad) - clean_weight * above(good)
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    run = best[: np.argmax(np.diff(best, append=best[-1] + 2) > 1) + 1]  # the first stretch of equally good cuts: its middle lies between good and bad
    return float((run[len(run) // 2] + 1) / BINS) if gain.max() > 0 else float("inf")


def fit(stats: DataFrame, labels: DataFrame, options: RulesOptions = RulesOptions()) -> RulesModel:
    """The forest from a pool of the documents, the threshold from all labelled ones that pass the base rule."""
    rows = stats.select(unit_hash("doc_id", *COUNTS).alias("draw"), "doc_id", *FEATURES)
    distinct = rows.agg(F.approx_count_distinct("draw", 0.02)).first()[0]
    share = min(1.0, 1.5 * options.pool / max(1, distinct))  # half as much again, so that the least hashes are among them
    drawn = rows.where(F.col("draw") < share).distinct().orderBy("draw", "doc_id", *FEATURES).limit(options.pool).select(*FEATURES).collect()
    forest = grow_forest(np.array(drawn, dtype=np.float64).reshape(len(drawn), len(FEATURES)), options)
    marked = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))

    def binned(batches):
        for batch in batches:
            passed = ~base_failed(columns(batch, COUNTS), options)
            at = np.floor(anomaly(forest, columns(batch, FEATURES), options) * BINS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at[passed]), batch.column(batch.schema.get_field_index("quality")).cast(pa.int64()).filter(pa.array(passed))], names=["bin", "quality"])

    rows = stats.join(marked, "doc_id").select(*COUNTS, *FEATURES, F.col("quality").cast("long")).mapInArrow(binned, "bin long, quality long").groupBy("bin", "quality").count().collect()
    return RulesModel(forest, choose_threshold([(r[0], r[1], r[2]) for r in rows], options.clean_weight), options)


def score_documents(docs: DataFrame, labels: DataFrame, options: RulesOptions = RulesOptions()) -> DataFrame:
    """doc_id, the counts, base_failed, anomaly score and kept, a row per document."""
    stats = stage(document_stats(docs), "rule-stats")
    model = fit(stats, labels, options)

    def score(batches):
        for batch in batches:
            failed, value, kept = model.verdict(columns(batch, COUNTS), columns(batch, FEATURES))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(1 + len(COUNTS))), pa.array(failed), pa.array(kept), pa.array(value)], names=["doc_id", *COUNTS, "base_failed", "kept", "anomaly"])

    return stats.mapInArrow(score, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, anomaly double")


def filter_documents(docs: DataFrame, labels: DataFrame, options: RulesOptions = RulesOptions()) -> DataFrame:
    """The kept documents with all their columns. Texts are counted again rather than shuffled to their verdicts."""
    model = fit(stage(document_stats(docs), "rule-stats"), labels, options)
    at = docs.columns.index("text")

    def keep(batches):
        for batch in batches:
            yield batch.filter(pa.array(model.verdict(*batch_stats(batch.column(at)))[2]))

    return docs.mapInArrow(keep, docs.schema)
