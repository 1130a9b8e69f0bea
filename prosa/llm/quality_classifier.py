"""Quality classifier: random Fourier features, ridge scores by partition-summed normal equations, isotonic calibration.

Labels come only from rows outside the held-out fold (crc32 of the id mod 3 is 1). Of these, four fifths (by a hash of the
id) fit the ridge scores and the rest calibrate them, so the calibration never sees a row that the scores were fitted to.
Each partition sums its own normal equations; what reaches the driver are at most `partials` matrices of (D + 1)^2 (34 MB in all), however
many rows there are. At most `max_labelled` labelled rows are used (a documented bound; rows are drawn by a hash). Features are the
statistics of text_stats, standardised; labels, lang, source and doc_id are no inputs.

Defined cases: a null text is scored as the empty one; a text of any length is counted whole; a score of exactly 0.5 is predicted 1 and kept;
equal raw scores get equal scores; repeated rows each get a row; a repeated label counts once, its lowest
quality; without labels of both kinds every score is 0.5; an empty table gives an empty result; other columns are ignored by
`score_documents` and kept by `filter_documents`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from prosa.llm.common import crc32_of_id, stage, unit_hash
from prosa.llm.quality_rules import columns, document_stats
from prosa.llm.text_stats import FEATURES, batch_stats

BINS = 2048


@dataclass(frozen=True)
class ClassifierOptions:
    dimensions: int = 256
    ridge: float = 1e-3
    seed: int = 7
    folds: int = 3
    held_out: int = 1
    calibration_share: float = 0.2
    max_labelled: int = 1_000_000
    partials: int = 64


@dataclass(frozen=True)
class ClassifierModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    phases: np.ndarray
    beta: np.ndarray | None
    knots: tuple = ()
    values: tuple = ()

    def fourier(self, rows: np.ndarray) -> np.ndarray:
        """Random features whose inner products approximate a Gaussian kernel, and a constant."""
        z = np.clip((rows - self.mean) / self.scale, -8.0, 8.0)
        return np.column_stack([np.sqrt(2.0 / len(self.phases)) * np.cos(z @ self.weights + self.phases), np.ones(len(rows))])

    def raw(self, rows: np.ndarray) -> np.ndarray:
        return np.zeros(len(rows)) if self.beta is None else self.fourier(rows) @ self.beta

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Calibrated scores between 0 and 1."""
        return np.interp(self.raw(rows), self.knots, self.values) if len(self.knots) else np.full(len(rows), 0.5)


def pool_adjacent(at: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of means sums/counts at ascending positions: centres and values of its level stretches."""
    blocks: list[list[float]] = []
    for x, s, n in zip(at, sums, counts):
        blocks.append([s, n, x * n])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s1, n1, x1 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s1, blocks[-1][1] + n1, blocks[-1][2] + x1]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


def training_labels(labels: DataFrame, options: ClassifierOptions = ClassifierOptions()) -> DataFrame:
    """doc_id, label and calibrate of the labelled ids that a fit reads: about `max_labelled` at most, none of the held-out fold."""
    marked = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").cast("double").alias("label"))
    marked = marked.where(crc32_of_id() % options.folds != options.held_out)
    share = min(1.0, options.max_labelled / max(1, marked.count()))
    return marked.where(unit_hash("doc_id") < share).select("doc_id", "label", (F.pmod(F.xxhash64(F.col("doc_id"), F.lit("calibrate")), F.lit(1000)) < int(1000 * options.calibration_share)).alias("calibrate"))


def labelled_stats(docs: DataFrame, labels: DataFrame, options: ClassifierOptions = ClassifierOptions()) -> DataFrame:
    """The statistics of the documents that a fit reads; no other text is counted. The ids broadcast are bounded by `max_labelled` (8 bytes each)."""
    known = F.broadcast(training_labels(labels, options).select("doc_id"))
    return document_stats(docs.join(known, "doc_id", "left_semi")).select("doc_id", *FEATURES)


def fit(stats: DataFrame, labels: DataFrame, options: ClassifierOptions = ClassifierOptions()) -> ClassifierModel:
    """stats: doc_id and FEATURES."""
    marked = training_labels(labels, options)
    known = stage(stats.select("doc_id", *FEATURES).join(marked, "doc_id"), "labelled-stats").coalesce(options.partials)

    moments = known.where("not calibrate").agg(F.count("*"), *(f(c) for c in FEATURES for f in (F.avg, F.stddev_pop))).first()
    rng = np.random.default_rng(options.seed)
    d = len(FEATURES)
    weights, phases = rng.normal(size=(d, options.dimensions)) / np.sqrt(d), rng.uniform(0, 2 * np.pi, options.dimensions)
    if not moments[0]:
        return ClassifierModel(np.zeros(d), np.ones(d), weights, phases, None)
    mean, deviation = np.array(moments[1::2], dtype=float), np.array(moments[2::2], dtype=float)
    model = ClassifierModel(mean, np.where(deviation > 1e-9, deviation, 1.0), weights, phases, None)

    def equations(batches):
        size = options.dimensions + 1
        gram, right = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            z, y = model.fourier(columns(batch, FEATURES)), batch.column(batch.schema.get_field_index("label")).to_numpy()
            gram += z.T @ z
            right += z.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([gram.tobytes()], pa.binary()), pa.array([right.tobytes()], pa.binary())], names=["gram", "right"])

    parts = known.where("not calibrate").select(*FEATURES, "label").mapInArrow(equations, "gram binary, right binary").collect()
    size = options.dimensions + 1
    gram, right = sum(np.frombuffer(p[0]).reshape(size, size) for p in parts), sum(np.frombuffer(p[1]) for p in parts)
    beta = np.linalg.solve(gram + options.ridge * max(1.0, float(moments[0])) * np.diag(np.r_[np.ones(size - 1), 1e-9]), right)
    model = ClassifierModel(model.mean, model.scale, weights, phases, beta)

    def binned(batches):
        for batch in batches:
            at = np.clip(np.floor((model.raw(columns(batch, FEATURES)) + 0.5) / 2.0 * BINS), 0, BINS - 1)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), batch.column(batch.schema.get_field_index("label"))], names=["bin", "label"])

    rows = sorted(known.where("calibrate").select(*FEATURES, "label").mapInArrow(binned, "bin long, label double").groupBy("bin").agg(F.sum("label"), F.count("*")).collect())
    if not rows or not 0 < sum(r[1] for r in rows) < sum(r[2] for r in rows):
        return model
    bins, sums, counts = (np.array([r[i] for r in rows], dtype=float) for i in range(3))
    knots, values = pool_adjacent((bins + 0.5) / BINS * 2.0 - 0.5, sums, counts)
    return ClassifierModel(model.mean, model.scale, weights, phases, beta, tuple(knots), tuple(values))


def score_documents(docs: DataFrame, labels: DataFrame, options: ClassifierOptions = ClassifierOptions()) -> DataFrame:
    """doc_id, held_out, score and predicted, a row per document."""
    stats = stage(document_stats(docs).select("doc_id", *FEATURES), "quality-stats")
    model = fit(stats, labels, options)

    def score(batches):
        for batch in batches:
            value = model.score(columns(batch, FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(value), pa.array((value >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    scored = stats.mapInArrow(score, "doc_id long, score double, predicted int")
    return scored.select("doc_id", (crc32_of_id() % options.folds == options.held_out).alias("held_out"), "score", "predicted")


def filter_documents(docs: DataFrame, labels: DataFrame, options: ClassifierOptions = ClassifierOptions(), least: float = 0.5, labelled: DataFrame | None = None) -> DataFrame:
    """The documents that score at least `least`, with all their columns. labelled: the documents to fit on where docs, being filtered, may lack the bad ones."""
    model = fit(labelled_stats(docs if labelled is None else labelled, labels, options), labels, options)
    at = docs.columns.index("text")

    def keep(batches):
        for batch in batches:
            yield batch.filter(pa.array(model.score(batch_stats(batch.column(at))[1]) >= least))

    return docs.mapInArrow(keep, docs.schema)
