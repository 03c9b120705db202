"""Linear text classifiers on n-gram indicators that are scaled by naive Bayes log-count ratios.

The labels used for the fit are a bounded sample (``per_class`` documents of each class, taken by a
hash of their ids). Log-count ratios and the hinge-loss model, fitted by dual coordinate descent,
come from four fifths of it; the other fifth turns margins into probabilities, weighted back to the
class counts of all labels. Every document is scored on its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseek.llm.staging import long_array, on_executors, staged

_rng = np.random.default_rng(20240502)
_FACTORS = _rng.integers(1, 1 << 31, 16, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_scratch: dict[int, np.ndarray] = {}


@dataclass(frozen=True)
class Grams:
    """Which n-grams of a text are features, hashed to ``2 ** bits`` places.

    ``sizes``: lengths in characters. ``folded``: letters are lower-cased. ``repeats``: lengths of n-grams over the
    marks "this word equals the one before it" and "it doesn't".
    """

    sizes: tuple[int, ...]
    folded: bool = False
    repeats: tuple[int, ...] = ()
    bits: int = 20

    def places(self, text: str | None) -> np.ndarray:
        """The distinct features of a text; a null text has none."""
        if not text:
            return np.empty(0, np.int64)
        if self.folded:
            text = text.lower()
        found = [self._of(np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32), n, n)
                 for n in self.sizes]
        if self.repeats:
            words = text.split()
            marks = np.array([a == b for a, b in zip(words, words[1:], strict=False)], np.uint32) + np.uint32(7)
            found += [self._of(marks, n, 100 + n) for n in self.repeats]
        places = np.concatenate(found)
        scratch = _scratch.get(self.bits)
        if scratch is None:
            scratch = _scratch[self.bits] = np.zeros(1 << self.bits, np.int32)
        numbers = np.arange(len(places), dtype=np.int32)
        scratch[places] = numbers  # of equal places the last one stays
        return places[scratch[places] == numbers]

    def _of(self, marks: np.ndarray, n: int, seed: int) -> np.ndarray:
        m = len(marks) - n + 1
        if m <= 0:
            return np.empty(0, np.int64)
        total = np.full(m, seed * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for k in range(n):
            total += marks[k:k + m] * _FACTORS[k]
        total ^= total >> np.uint32(15)
        total *= np.uint32(0x2C1B3C6D)
        return (total >> np.uint32(32 - self.bits)).astype(np.int64)


@dataclass
class Model:
    """``ratio`` scales the features, ``weight`` is the model on scaled features of unit length."""

    grams: Grams
    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, places: np.ndarray) -> float:
        r = self.ratio[places]
        length = float(np.sqrt(np.dot(r, r)))
        if length == 0:
            return self.bias
        return float(np.dot(r, self.weight[places])) / length + self.bias

    def score(self, text: str | None) -> float:
        return 1 / (1 + float(np.exp(-np.clip(self.slope * self.margin(self.grams.places(text)) + self.shift, -50, 50))))


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray, dims: int) -> np.ndarray:
    """log P(feature | 1) / P(feature | 0), smoothed by one."""
    counts = []
    for label in (1, 0):
        total = np.zeros(dims, np.float64)
        for row, own in zip(rows, labels, strict=True):
            if own == label:
                total[row] += 1
        counts.append((total, int((labels == label).sum())))
    (p, n), (q, m) = counts
    ratio = np.log((p + 1) / (n + 2)) - np.log((q + 1) / (m + 2))
    return ratio.astype(np.float32)


def dual_coordinate_descent(
    rows: list[np.ndarray], values: list[np.ndarray], signs: np.ndarray, dims: int, cost: float = 1.0,
    rounds: int = 12,
) -> tuple[np.ndarray, float]:
    """Weights and bias of the L2-regularised linear model of least hinge loss."""
    order = np.random.default_rng(7)
    weight, bias, alpha = np.zeros(dims, np.float32), 0.0, np.zeros(len(rows))
    norms = np.array([float(np.dot(v, v)) + 1.0 for v in values])
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(rows)):
            row, value, y = rows[i], values[i], signs[i]
            slack = y * (float(np.dot(weight[row], value)) + bias) - 1
            new = min(max(alpha[i] - slack / norms[i], 0.0), cost)
            step = (new - alpha[i]) * y
            if step:
                weight[row] += np.float32(step) * value
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-4:
            break
    return weight, bias


def calibrated(margins: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through weighted labels, by Newton steps."""
    slope, shift = 1.0, 0.0
    x = np.stack([margins, np.ones_like(margins)])
    y = np.where(labels == 1, 0.99, 0.01)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * margins + shift, -50, 50)))
        gradient = x @ (weights * (p - y)) + np.array([1e-3 * slope, 0])
        hessian = (x * (weights * p * (1 - p))) @ x.T + np.diag([1e-3, 1e-6])
        step = np.linalg.solve(hessian, gradient)
        step *= min(1.0, 5.0 / max(1e-9, float(np.abs(step).max())))
        slope, shift = slope - step[0], shift - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return max(slope, 1e-3), shift


def fit_rows(rows: list[np.ndarray], labels: np.ndarray, share: float, grams: Grams) -> Model:
    """``share``: the part of label 1 among all labels."""
    dims = 1 << grams.bits
    zero = np.zeros(dims, np.float32)
    if len(set(labels.tolist())) < 2:  # nothing to tell apart
        known = share if len(labels) else 0.5
        known = min(max(known, 0.01), 0.99)
        return Model(grams, zero, zero, 0.0, 1.0, float(np.log(known / (1 - known))))
    order = np.random.default_rng(5).permutation(len(rows))
    rest = np.zeros(len(rows), bool)
    rest[order[: len(rows) // 5]] = True
    if len(set(labels[rest].tolist())) < 2 or len(set(labels[~rest].tolist())) < 2:
        rest[:] = False  # too few for a part of its own
    learn = np.flatnonzero(~rest)
    chosen = [rows[i] for i in learn]
    ratio = log_count_ratios(chosen, labels[learn], dims)
    chosen = [row[ratio[row] != 0] for row in chosen]
    values = []
    for row in chosen:
        v = ratio[row]
        values.append(v / max(float(np.sqrt(np.dot(v, v))), 1e-9))
    weight, bias = dual_coordinate_descent(chosen, values, np.where(labels[learn] == 1, 1.0, -1.0), dims)
    model = Model(grams, ratio, weight, bias, 1.0, 0.0)
    judged = np.flatnonzero(rest) if rest.any() else learn
    margins = np.array([model.margin(rows[i]) for i in judged])
    ones = labels[judged] == 1
    weights = np.where(ones, share / max(1, ones.sum()), (1 - share) / max(1, (~ones).sum())) * len(judged)
    model.slope, model.shift = calibrated(margins, labels[judged], weights)
    return model


def _features(grams: Grams):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 100):
                part = batch.slice(lo, 100)
                blobs = [grams.places(t).astype(np.int32).tobytes() for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(blobs, pa.binary())], ["doc_id", "label", "places"])
    return find


def _fitted(grams: Grams, share: float):
    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {}
        for batch in batches:
            ids, _ = long_array(batch.column(0))
            for doc, label, raw in zip(ids.tolist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                row = raw.as_py()
                known[(doc, label)] = min(known.get((doc, label), row), row)
        keys = sorted(known)
        model = fit_rows([np.frombuffer(known[k], np.int32) for k in keys], np.array([k[1] for k in keys], np.int64), share, grams)
        yield pa.record_batch({
            "ratio": pa.array([model.ratio.tobytes()], pa.binary()),
            "weight": pa.array([model.weight.tobytes()], pa.binary()),
            "bias": [float(model.bias)], "slope": [float(model.slope)], "shift": [float(model.shift)],
        })
    return fit


def train(
    docs: DataFrame, labels: DataFrame, label_col: str, grams: Grams, id_col: str = "doc_id", text_col: str = "text",
    per_class: int = 2500,
) -> Model:
    """The model of a sample of at most ``per_class`` labelled documents of each class.

    ``labels`` has ``id_col`` and ``label_col`` (0 or 1). Rows without id or label are left out, and so are
    documents with both labels. Of rows that repeat an id the one of the least features is taken. With one class only
    the score is that class's share; with no label it is 0.5.
    """
    spark = docs.sparkSession
    on_executors(spark)
    known = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
        .where("doc_id is not null and label in (0, 1)")
        .groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other")
        .select("doc_id", "label")
    )
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    present = staged(known.join(texts.select("doc_id"), "doc_id", "semi"))
    share = present.agg(F.avg("label")).first()[0]
    by_hash = F.xxhash64("doc_id")
    picked = [present.where(F.col("label") == k).orderBy(by_hash, "doc_id").limit(per_class) for k in (0, 1)]
    sample = texts.join(F.broadcast(picked[0].union(picked[1])), "doc_id").select("doc_id", "label", "text")
    row = (
        sample.mapInArrow(_features(grams), "doc_id long, label int, places binary").repartition(1)
        .mapInArrow(_fitted(grams, share or 0.0),
                    "ratio binary, weight binary, bias double, slope double, shift double").first()
    )
    ratio, weight = (np.frombuffer(bytes(b), np.float32) for b in (row.ratio, row.weight))
    return Model(grams, ratio, weight, row.bias, row.slope, row.shift)


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """Each row's probability of label 1, from its whole text."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array([held.value.score(t.as_py()) for t in texts], pa.float64())

    return score(F.col(text_col).cast("string"))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document's label is kept from the fit: a fifth, by crc32 of the id as text."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0
