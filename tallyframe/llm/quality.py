"""Quality classifier: Naive Bayes support vectors.

A text's features are indicators of byte trigrams, of pairs of neighbouring word
shapes, and of how large a share of its pairs each frequent shape pair and plain
repetition has, hashed into ``2**BITS`` slots. The log-count ratio of every slot
is computed over all labelled training rows by grouped aggregation. Indicators
scaled by these ratios go into a linear hinge-loss model, fitted by dual
coordinate descent on at most ``max_rows`` training rows, those with the smallest
hashes of their ids. A sigmoid fitted to held-back margins turns margins into
scores.

Labels are read only for training rows; language, source and id are never
inputs of a score. Edge cases: null and empty texts have no feature and score by
the bias alone; rows without a label, or with several that disagree, don't
train; without training rows of both kinds every score is 0.5 (no evidence) and
no row is rejected; repeated rows score alike; clashing extra columns pass through unread; empty
tables give empty results.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bitmap import build, mix, passing
from ..storage import materialize

BITS = 16
SLOTS = 1 << BITS
#: Rows the hinge-loss model is fitted on at most; the log-count ratios use all.
MAX_ROWS = 8000
THRESHOLD = 0.7

_WORD = re.compile(rb"[^\x20\x09-\x0d]+")
# Character classes of bytes: lower case (and all bytes beyond ASCII), upper case, digits; others are themselves.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[ord("a") : ord("z") + 1] = ord("a")
_CLASS[ord("A") : ord("Z") + 1] = ord("A")
_CLASS[ord("0") : ord("9") + 1] = ord("0")
_CLASS[128:] = ord("a")
_CLASS_TABLE = _CLASS.tobytes()
_RUNS = re.compile(rb"(.)\1+", re.DOTALL)


def _slot(x: np.ndarray) -> np.ndarray:
    """High bits of a multiplicative hash."""
    return ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)


def _shares(share: np.ndarray, code: np.ndarray) -> np.ndarray:
    """A code for every tenth up to the share, from a twentieth on."""
    steps = np.array([0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9])
    which, step = np.nonzero(share[:, None] >= steps)
    return code[which] * np.uint64(31) + np.uint64(7919) + step.astype(np.uint64)


def features(text: bytes, shape_codes: dict | None = None) -> np.ndarray:
    """Sorted distinct slots of the indicators that hold for a text."""
    if not text.strip():
        return np.empty(0, np.int64)
    raw = np.frombuffer(text, dtype=np.uint8).astype(np.uint64)
    seen = np.zeros(SLOTS, dtype=bool)
    with np.errstate(over="ignore"):
        if len(raw) >= 3:
            for at in range(0, len(raw) - 2, 1 << 18):
                part = raw[at : at + (1 << 18) + 2]
                seen[_slot(part[:-2] << np.uint64(16) | part[1:-1] << np.uint64(8) | part[2:])] = True
        words = text.split()
        shapes = _RUNS.sub(rb"\1", text.translate(_CLASS_TABLE)).split()
        codes = np.empty(len(shapes), dtype=np.uint64)
        known = {} if shape_codes is None else shape_codes
        for i, s in enumerate(shapes):
            code = known.get(s)
            if code is None:
                import xxhash

                code = xxhash.xxh64_intdigest(s)
                if len(known) < 100_000:
                    known[s] = code
            codes[i] = code
        if len(codes) > 1 and len(codes) == len(words):
            pairs = codes[:-1] * np.uint64(3) + codes[1:] * np.uint64(1_000_003)
            unique, counts = np.unique(pairs, return_counts=True)
            seen[_slot(unique)] = True
            seen[_slot(_shares(counts / len(pairs), unique))] = True
            same = np.fromiter(map(bytes.__eq__, words, words[1:]), dtype=bool, count=len(words) - 1).mean()
            seen[_slot(_shares(np.array([same]), np.array([5], dtype=np.uint64)))] = True
    return np.flatnonzero(seen)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def plain(self) -> tuple:
        return self.weights, self.bias, self.slope, self.offset


def score_of(model: tuple, slots: np.ndarray) -> float:
    """Score of a text's slots under a model's ``plain()`` values."""
    weights, bias, slope, offset = model
    margin = float(weights[slots].sum()) + bias
    return float(1 / (1 + np.exp(-np.clip(slope * margin + offset, -30, 30))))


NO_EVIDENCE = Model(np.zeros(SLOTS), 0.0, 0.0, 0.0)


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, c: float = 1.0, epochs: int = 30, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights of the scaled indicators and the bias that minimise the hinge loss with an L2 term."""
    rng = np.random.default_rng(seed)
    # Values are looked up again each time: the driver holds the rows' slots only.
    norms = np.array([float(v @ v) + 1.0 for v in (scale[r] for r in rows)])
    alpha, w, bias = np.zeros(len(rows)), np.zeros(len(scale)), 0.0
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            r, v = rows[i], scale[rows[i]]
            gradient = y[i] * (float(w[r] @ v) + bias) - 1.0
            new = min(max(alpha[i] - gradient / norms[i], 0.0), c)
            if step := new - alpha[i]:
                alpha[i] = new
                w[r] += step * y[i] * v
                bias += step * y[i]
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w * scale, bias


def fit_sigmoid(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through smoothed labels, by Newton steps."""
    up, down = label.sum(), (1 - label).sum()
    target = np.where(label == 1, (up + 1) / (up + 2), 1 / (down + 2))
    x, beta = np.stack([margin, np.ones_like(margin)], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        curve = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(curve, x.T @ (target - p))
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(beta[0], 1e-3)), float(beta[1])


def held_out(id_column: Column) -> Column:
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _featurize(batches, filled):
    known: dict = {}
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        batch = batch.take(pa.array(passing(filled.value, mix(ids))))
        out = [
            features(batch.column(1)[i].as_buffer().to_pybytes(), known).astype(np.uint16).tobytes() for i in range(batch.num_rows)
        ]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "slots"])


def _hashed(batches):
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(mix(ids).view(np.int64))], ["hash"])


def _count(batches):
    total = np.zeros((2, SLOTS), dtype=np.int64)
    for batch in batches:
        for label, slots in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            total[label, np.frombuffer(slots.as_buffer(), dtype=np.uint16)] += 1
    held = np.flatnonzero(total.any(axis=0))
    yield pa.RecordBatch.from_arrays(
        [pa.array(held.astype(np.int32)), pa.array(total[0, held]), pa.array(total[1, held])], ["slot", "low", "high"]
    )


def _text(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Fit on the labelled rows of ``docs`` that aren't held out."""
    judged = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
        .agg(F.min("quality").alias("label"), F.max("quality").alias("other"))
        .where("label = other")
        .select("doc_id", F.col("label").cast("int").alias("label"))
    )
    judged = materialize(judged, "judged")
    filled = docs.sparkSession.sparkContext.broadcast(build(judged.select("doc_id").mapInArrow(_hashed, "hash bigint")))
    # Only compact features are shuffled to the labels, not texts, and only of rows that may have a label.
    shown = _text(docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))).mapInArrow(
        lambda b: _featurize(b, filled), "doc_id bigint, slots binary"
    )
    rows = materialize(shown.join(judged, "doc_id").withColumn("order", F.xxhash64("doc_id")), "training")
    counts = (
        rows.select("label", "slots")
        .mapInArrow(_count, "slot int, low bigint, high bigint")
        .groupBy("slot")
        .agg(F.sum("low").alias("low"), F.sum("high").alias("high"))
        .toArrow()
    )
    low, high = np.ones(SLOTS), np.ones(SLOTS)
    at = counts.column("slot").to_numpy()
    low[at] += counts.column("low").to_numpy()
    high[at] += counts.column("high").to_numpy()
    ratio = np.log(high / high.sum()) - np.log(low / low.sum())
    # The order is found on narrow rows; features are fetched up to the last of the sample.
    last = rows.select("order").orderBy("order").limit(max_rows).agg(F.max("order")).first()[0]
    sample = rows.where(F.col("order") <= F.lit(last)).orderBy("order", "doc_id", "slots").limit(max_rows).toArrow()
    y = sample.column("label").to_numpy()
    if len(set(y.tolist())) < 2:
        return NO_EVIDENCE
    sets = [np.frombuffer(s.as_buffer(), dtype=np.uint16) for s in sample.column("slots")]
    # Indicators are brought to unit length, so that long texts don't outweigh short ones.
    scale = ratio / max(1e-9, np.median([np.linalg.norm(ratio[s]) for s in sets if len(s)] or [1.0]))
    sign = np.where(y == 1, 1.0, -1.0)
    fold = np.arange(len(y)) % 5 == 0
    w, b = dual_coordinate_descent([s for s, f in zip(sets, fold, strict=True) if not f], sign[~fold], scale)
    margin = np.array([w[s].sum() + b for s, f in zip(sets, fold, strict=True) if f])
    slope, offset = fit_sigmoid(margin, y[fold]) if len(set(y[fold].tolist())) == 2 else (1.0, 0.0)
    w, b = dual_coordinate_descent(sets, sign, scale)
    return Model(w, b, slope, offset)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model.plain())

    def run(batches):
        known: dict = {}
        for batch in batches:
            out = [
                score_of(shared.value, features(batch.column(1)[i].as_buffer().to_pybytes(), known)) for i in range(batch.num_rows)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])

    return _text(docs).mapInArrow(run, "doc_id bigint, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with their columns; all of them if there is no evidence."""
    if model is NO_EVIDENCE:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model.plain())
    at = docs.columns.index("text")

    def run(batches):
        known: dict = {}
        for batch in batches:
            texts = batch.column(at).cast(pa.large_binary())
            good = [
                score_of(shared.value, features(texts[i].as_buffer().to_pybytes() if texts[i].is_valid else b"", known)) >= threshold
                for i in range(batch.num_rows)
            ]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
