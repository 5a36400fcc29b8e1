"""Quality classifier: naive Bayes support vectors on n-gram indicators, fitted by dual coordinate descent."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tallycast.llm.queries import query, table

FIT_ROWS = 4_000  # labelled rows the model is fitted on at most, the least by a hash of their id
DIMENSIONS = 1 << 18
SMOOTHING = 1.0  # added to each n-gram's document count in either class
COST = 1.0
EPOCHS = 25
FOLDS = 3  # for the margins that the score's scale is fitted on
THRESHOLD = 0.3
FOLD_COUNT = 5
CACHED_WORDS = 200_000  # of one Python worker; a full cache takes no more words
REPEAT = zlib.crc32(b"=")
FORM = [(re.compile("[^\\W\\d_a-z]*[A-ZÀ-ÖØ-Þ][^\\W\\d_a-z]+"), "\x01"), (re.compile("[^\\W\\d_]+"), "a"), (re.compile(r"\d+"), "0")]


class _Words(dict):
    """Word to its hash and, in the upper half, the hash of its form: letters, capitals and digits run together."""

    def __missing__(self, word: str) -> int:
        form = word
        for pattern, sign in FORM:
            form = pattern.sub(sign, form)
        code = zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) | (zlib.crc32(form.encode("utf-8", "surrogatepass")) >> 1) << 32
        if len(self) < CACHED_WORDS:
            self[word] = code
        return code


_words = _Words()
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def _grams(codes: np.ndarray, n: int, salt: int) -> np.ndarray:
    mixed = np.full(max(0, len(codes) - n + 1), salt, dtype=np.uint64)
    for k in range(n):
        mixed = (mixed ^ (codes[k : len(codes) - n + 1 + k] * _MIX[k])) * _MIX[0]
    return (mixed >> np.uint64(40)).astype(np.int64) % DIMENSIONS


def features(text: str | None) -> np.ndarray:
    """Sorted indices of the n-grams a text has: words (1-2) and word forms (1-3), where a word that equals the one
    before has the form of a repeat.  Null and empty texts have none."""
    words = text.split() if text else []
    if not words:
        return np.empty(0, np.int64)
    codes = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    word, form = codes & np.uint64(0xFFFFFFFF), codes >> np.uint64(32)
    form[1:][word[1:] == word[:-1]] = REPEAT
    parts = [_grams(word, 1, 1), _grams(word, 2, 2), _grams(form, 1, 3), _grams(form, 2, 4), _grams(form, 3, 5)]
    return np.unique(np.concatenate(parts))


@dataclass(frozen=True)
class Model:
    """``sigmoid(scale * (weights . x + bias) + shift)`` with x the indicators times ``ratios``, of unit length."""

    ratios: np.ndarray
    weights: np.ndarray
    bias: float
    scale: float
    shift: float

    def margin(self, present: np.ndarray) -> float:
        r = self.ratios[present]
        norm = float(np.sqrt(r @ r))
        return (float(self.weights[present] @ r) / norm if norm else 0.0) + self.bias

    def score(self, text: str | None) -> float:
        z = self.scale * self.margin(features(text)) + self.shift
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -500, 500))))


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """log((p / |p|) / (q / |q|)) of smoothed document counts p of class 1 and q of class 0, per n-gram."""
    counts = np.full((2, DIMENSIONS), SMOOTHING)
    for row, label in zip(rows, labels):
        counts[int(label)][row] += 1
    return (np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())).astype(np.float64)


def dual_descent(rows: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss model with squared norm penalty; the dual variable of a row lies in
    [0, its cost], and the rarer class costs more in proportion.  Rows are visited in a fixed shuffled order."""
    values = [ratios[r] / max(float(np.sqrt(ratios[r] @ ratios[r])), 1e-12) for r in rows]
    signs = np.where(labels > 0, 1.0, -1.0)
    share = np.array([(labels == 0).mean(), (labels > 0).mean()])
    cost = COST * 0.5 / share[(labels > 0).astype(int)]
    alpha, weights, bias = np.zeros(len(rows)), np.zeros(DIMENSIONS), 0.0
    diagonal = np.array([v @ v + 1.0 for v in values])  # the bias is one more feature, always 1
    order = np.random.default_rng(0)
    for _ in range(EPOCHS):
        moved = 0.0
        for i in order.permutation(len(rows)):
            gradient = signs[i] * (weights[rows[i]] @ values[i] + bias) - 1.0
            new = min(max(alpha[i] - gradient / diagonal[i], 0.0), cost[i])
            step = (new - alpha[i]) * signs[i]
            if step:
                weights[rows[i]] += step * values[i]
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return weights, bias


def _scale(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Logistic regression of the label on the margin, targets drawn in by the class counts, by Newton steps."""
    ones, zeros = (labels > 0).sum(), (labels == 0).sum()
    goal = np.where(labels > 0, (ones + 1.0) / (ones + 2.0), 1.0 / (zeros + 2.0))
    x, beta = np.column_stack((margins, np.ones(len(margins)))), np.zeros(2)
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (goal - p))
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def fit_rows(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """Model of feature rows and 0/1 labels; without both classes its score is the share of label 1 (0.5 of none)."""
    if len(set(labels.tolist())) < 2:
        share = float(labels.mean()) if len(labels) else 0.5
        nothing = np.zeros(DIMENSIONS)
        return Model(nothing, nothing, 0.0, 0.0, float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    fold = np.arange(len(rows)) % FOLDS
    margins = np.zeros(len(rows))
    for k in range(FOLDS):
        train, test = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if len(set(labels[train].tolist())) == 2:
            part = [rows[i] for i in train]
            ratios = log_count_ratios(part, labels[train])
            model = Model(ratios, *dual_descent(part, labels[train], ratios), 1.0, 0.0)
            margins[test] = [model.margin(rows[i]) for i in test]
    ratios = log_count_ratios(rows, labels)
    return Model(ratios, *dual_descent(rows, labels, ratios), *_scale(margins, labels))


def _fold(id_column: Column) -> Column:
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % FOLD_COUNT


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows_at_most: int) -> DataFrame:
    """``(doc_id, label, text)`` of labelled rows whose crc32(doc_id) mod 5 is not 0, the ``rows_at_most`` least by hash.

    Null labels do not count, repeated ones are averaged, and of repeated ids one text counts.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (_fold(F.col("doc_id")) != 0))
    known = known.groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_at_most)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", fit_rows_at_most: int = FIT_ROWS) -> Model:
    """Fit on :func:`labelled_sample`; its n-gram indices (not texts) come to the driver, bounded by the parameter."""
    rows = labelled_sample(docs, labels, label, fit_rows_at_most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([features(t.as_py()).astype(np.int32) for t in batch.column(2)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], ["doc_id", "label", "present"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    sample = rows.mapInArrow(run, f"doc_id {kind}, label int, present array<int>").toArrow().sort_by("doc_id")
    present = [np.asarray(v.values.to_numpy(), np.int64) for v in sample["present"].combine_chunks()] if sample.num_rows else []
    return fit_rows(present, sample["label"].to_numpy() if sample.num_rows else np.empty(0))


def with_score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with the score of its whole ``text`` as column ``name`` (replacing one so named), in one pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop(name)
    position = kept.columns.index("text")
    schema = StructType([*kept.schema.fields, StructField(name, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            scores = pa.array([model.score(t.as_py()) for t in batch.column(position)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], [*batch.schema.names, name])

    return kept.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, one row per row of ``docs`` (doc_id, text).

    Labels, language, source and id are no inputs of a score.  Null and empty texts score by the bias alone; a null id
    counts as the empty text for ``held_out``; equal texts score equally; no rows give no rows, and with no usable
    labels every score is 0.5.
    """
    scored = with_score(docs.select("doc_id", "text"), fit(docs, labels, label))
    held = (_fold(F.col("doc_id")) == 0).alias("held_out")
    return scored.select("doc_id", held, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted_documents(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` with all their columns whose score reaches the threshold."""
    name = "_quality_score"
    return with_score(docs, fit(docs, labels, label), name).filter(F.col(name) >= threshold).drop(name)


@query("op6_quality_classifier")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
