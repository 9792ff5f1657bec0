"""Quality classifier: naive Bayes support vectors on n-gram indicators.

Byte n-grams of the text and n-grams of its character shapes are hashed to a fixed number of indicators. Each is scaled by
its log-count ratio between the classes, rows are normalised, and a linear hinge-loss model is fitted by dual coordinate
descent. A logistic curve, fitted on margins of rows that the model for it has not seen, turns margins into scores.

Fitting takes a bounded sample of labelled rows (max_rows, those with the least hash of their id) and brings only their
feature indices to the driver; scoring is one pass over whole texts without a shuffle.

Defined cases: a null or empty text has no indicators and gets the share of label 1; labels without a quality don't
count; with labels of one class or none, every score is that class's (1.0 with none).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, gives_back, slices

#: Hashed dimensions; lengths of the byte n-grams and of the shape n-grams; labelled rows that a fit takes at most;
#: indicators at which a text's own evidence weighs as much as the classes' shares.
BITS, GRAMS, SHAPES, MAX_ROWS, EVIDENCE = 18, (2, 4), (3, 6), 6000, 40


def shapes() -> np.ndarray:
    """A byte's shape: one value each for small letters, capitals, digits and bytes outside ASCII; others are themselves."""
    table = np.arange(256, dtype=np.uint64)
    for chars, value in ((range(97, 123), 97), (range(65, 91), 65), (range(48, 58), 48), (range(128, 256), 97)):
        table[list(chars)] = value
    return table


_SHAPE, _BYTE = shapes(), np.arange(256, dtype=np.uint64)


def indicators(text: str) -> np.ndarray:
    """Distinct hashed n-grams of the whole text, ascending."""
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    seen = np.zeros(1 << BITS, dtype=bool)
    for table, sizes, salt in ((_BYTE, GRAMS, 1), (_SHAPE, SHAPES, 101)):
        values = table[raw]
        for n in sizes:
            if len(raw) < n:
                continue
            h = np.full(len(raw) - n + 1, salt + n, dtype=np.uint64)
            for k in range(n):
                h = (h ^ values[k : len(raw) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            seen[h >> np.uint64(64 - BITS)] = True
    return np.flatnonzero(seen).astype(np.int32)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # log-count ratios times the linear model's weights
    squares: np.ndarray  # squared log-count ratios, for a row's norm
    bias: float
    slope: float
    shift: float
    prior: float = 0.0

    def margin(self, idx: np.ndarray) -> float:
        norm = float(self.squares[idx].sum(dtype=np.float64)) ** 0.5
        return float(self.weights[idx].sum(dtype=np.float64)) / norm + self.bias if norm else self.bias

    def score(self, idx: np.ndarray) -> float:
        """The calibrated margin, drawn towards the classes' log odds where a text has few indicators."""
        trust = len(idx) / (len(idx) + EVIDENCE)
        logit = trust * (self.slope * self.margin(idx) + self.shift) + (1 - trust) * self.prior
        return float(1.0 / (1.0 + np.exp(-np.clip(logit, -30, 30))))


class Scaled(Sequence):
    """Each row's log-count ratios at norm 1, made when they are asked for: all at once would take as much as all indicators."""

    def __init__(self, rows: list[np.ndarray], ratio: np.ndarray):
        self.rows, self.ratio = rows, ratio
        self.norms = [float(v @ v) ** 0.5 or 1.0 for v in (ratio[r] for r in rows)]

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, i: int) -> np.ndarray:
        return (self.ratio[self.rows[i]] / self.norms[i]).astype(np.float32)


def descend(rows: list[np.ndarray], values: Sequence[np.ndarray], y: np.ndarray, cost: np.ndarray, dims: int, rounds: int = 15) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss with box [0, cost_i]; a constant feature of 1 is the bias."""
    w, bias, alpha = np.zeros(dims), 0.0, np.zeros(len(y))
    square = np.array([float(v @ v) + 1.0 for v in values])
    order = np.random.default_rng(7)
    for _ in range(rounds):
        most = 0.0
        for i in order.permutation(len(y)):
            v = values[i]
            g = y[i] * (float(w[rows[i]] @ v) + bias) - 1.0
            new = min(max(alpha[i] - g / square[i], 0.0), cost[i])
            if (d := (new - alpha[i]) * y[i]) != 0.0:
                w[rows[i]] += d * v
                bias += d
                most = max(most, abs(d))
                alpha[i] = new
        if most < 1e-3:
            break
    return w, bias


def ratios(rows: list[np.ndarray], y: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    counts = {1: np.full(1 << BITS, smooth), -1: np.full(1 << BITS, smooth)}
    # row by row (a row's indicators are distinct): a second copy of all rows would not fit beside the first
    for r, v in zip(rows, y):
        counts[int(v)][r] += 1
    p, q = counts[1], counts[-1]
    return np.log((p / p.sum()) / (q / q.sum()))


def fit_linear(rows: list[np.ndarray], y: np.ndarray, c: float) -> Model:
    ratio = ratios(rows, y)
    w, bias = descend(rows, Scaled(rows, ratio), y, np.full(len(y), c), 1 << BITS)
    return Model((ratio * w).astype(np.float32), (ratio * ratio).astype(np.float32), bias, 1.0, 0.0)


def logistic(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton's method, with the smoothed targets of Platt's scaling."""
    n1, n0 = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        s = p * (1 - p) + 1e-9
        g = np.array([((p - t) * margins).sum() + 1e-6 * a, (p - t).sum()])
        h = np.array([[(s * margins * margins).sum() + 1e-6, (s * margins).sum()], [(s * margins).sum(), s.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def fit(rows: list[np.ndarray], quality: list[int], c: float = 4.0, folds: int = 3) -> Model:
    y = np.where(np.array(quality) == 1, 1.0, -1.0)
    zeros = np.zeros(1 << BITS, dtype=np.float32)
    if len(set(y)) < 2:
        return Model(zeros, zeros, 0.0, 0.0, sure := -30.0 if len(y) and y[0] < 0 else 30.0, sure)
    margins, fold = np.zeros(len(y)), np.zeros(len(y), dtype=int)
    for sign in (1, -1):
        fold[np.flatnonzero(y == sign)] = np.arange((y == sign).sum()) % folds
    if min((y > 0).sum(), (y < 0).sum()) >= folds:
        for k in range(folds):
            part = fit_linear([r for r, f in zip(rows, fold) if f != k], y[fold != k], c)
            for i in np.flatnonzero(fold == k):
                margins[i] = part.margin(rows[i])
        slope, shift = logistic(margins, y)
    else:
        slope, shift = 1.0, 0.0
    whole = fit_linear(rows, y, c)
    return Model(whole.weights, whole.squares, whole.bias, slope, shift, float(np.log((y > 0).sum() / (y < 0).sum())))


def held_out(id_col: str) -> Column:
    """Rows that no label is learnt from: crc32 of the id as text leaves 2 modulo 4 (a null id: false)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS) -> Model:
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(id_col).agg(F.max(label_col).cast("int").alias("__label"))
    sample = known.orderBy(F.xxhash64(id_col), id_col).limit(max_rows)
    # bounded: max_rows rows of an id and a label
    texts = docs.select(id_col, text_col).join(F.broadcast(sample), id_col)

    @gives_back
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            idx = [indicators(t or "").tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(idx, pa.binary())], [id_col, "label", "idx"])

    kind = docs.schema[id_col].dataType.simpleString()
    # repeated ids would lengthen the sample: one row of each id
    found = texts.mapInArrow(features, f"`{id_col}` {kind}, label int, idx binary").groupBy(id_col).agg(F.first("label").alias("label"), F.min("idx").alias("idx"))
    got = found.toArrow()  # bounded by max_rows
    # rows stay where they are, in the order of ids: a sorted table would be a second copy
    order = pc.sort_indices(got.column(id_col)).to_pylist()
    every, quality = [r for chunk in got.column("idx").chunks for r in views(chunk)], got.column("label").to_pylist()
    model = fit([every[i] for i in order], [quality[i] for i in order])
    del got, every
    give_back()
    return model


def views(values: pa.Array) -> list[np.ndarray]:
    """The integers of each binary value where they are (a value taken by itself is a copy)."""
    values = values.cast(pa.large_binary())
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets or bytes(8), dtype=np.int64)[values.offset : values.offset + len(values) + 1]
    whole = np.frombuffer(data or b"", dtype=np.uint8)
    return [whole[a:b].view(np.int32) for a, b in zip(at[:-1], at[1:])]


def quality_scores(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7, keep: list[str] | None = None) -> DataFrame:
    """The columns keep (all, if None) with score and predicted."""
    kept = docs.select(*(c for c in (keep or docs.columns) if c not in ("score", "predicted")), F.col(text_col).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = batch.num_columns - 1
            for part in slices(iter([batch]), last):
                scores = [model.score(indicators(t or "")) for t in part.column(last).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())],
                    [*part.schema.names[:-1], "score", "predicted"],
                )

    return kept.mapInArrow(run, f"{schema}, score double, predicted int")
