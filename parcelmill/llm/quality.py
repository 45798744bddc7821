"""A quality classifier: hashed word n-grams, logistic regression trained by FTRL.

Tokens are runs of letters and digits, and runs of other signs. Features are
hashed single tokens, pairs of tokens, and runs of one to three token shapes
(case, digits, length class, or the signs themselves). Each counts as its share
of the text's features of its kind, so a score is a sparse dot product that
does not grow with the length of a text.

Training uses a bounded sample of the labelled rows (``train_rows``, drawn by a
hash of the id and equal for any table size); follow-the-regularised-leader
updates run over it in one task, which returns the weights. Scoring reads every
whole text in Arrow functions with the weights as a broadcast of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelmill.llm import texts
from parcelmill.llm.common import crc_fold, field, widened

BITS = 18
TRAIN_ROWS = 6_000
EPOCHS = 2
SEED = 42
#: Scores from here on count as label 1.
THRESHOLD = 0.3

_KIND = np.zeros(256, dtype=np.uint8)  # 0: white space and controls, 1: letters and digits, 2: signs
_KIND[0x21:0x7F] = 2
for _low, _high in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    _KIND[_low : _high + 1] = 1
_UPPER = np.zeros(256, dtype=bool)
_UPPER[0x41:0x5B] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[0x30:0x3A] = True

_STREAMS = 5


def _tokens(raw: np.ndarray, offsets: np.ndarray):
    """Hash and shape of every token, and the index of each text's first token."""
    kind = _KIND[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[offsets] = True
    edge[1:-1] |= kind[1:] != kind[:-1]
    bounds = np.flatnonzero(edge)
    if len(bounds) < 2:
        nothing = np.zeros(0, dtype=np.uint64)
        return nothing, nothing, np.zeros(len(offsets), dtype=np.int64)
    starts, ends = bounds[:-1], bounds[1:]
    real = kind[starts] > 0
    starts, ends = starts[real], ends[real]
    hashes = texts.span_hashes(raw, starts, ends)
    uppers = np.concatenate([[0], np.cumsum(_UPPER[raw])])
    digits = np.concatenate([[0], np.cumsum(_DIGIT[raw])])
    up = uppers[ends] - uppers[starts]
    dig = digits[ends] - digits[starts]
    size = ends - starts
    case = np.where(up == 0, 0, np.where(up == size, 2, np.where(_UPPER[raw[starts]] & (up == 1), 1, 3)))
    length = np.minimum(np.log2(size).astype(np.int64), 6)
    code = (case * 8 + length) * 3 + np.where(dig == 0, 0, np.where(dig == size, 2, 1))
    shapes = np.where(kind[starts] == 1, texts.mix(code.astype(np.uint64) + np.uint64(1)), hashes)
    return hashes, shapes, np.searchsorted(starts, offsets)


def features(raw: np.ndarray, offsets: np.ndarray, bits: int = BITS):
    """For each stream of features: slots in the weight table, and the first one of each text (one more at the end).

    Runs that would reach into the next text are not there.
    """
    hashes, shapes, first = _tokens(raw, offsets)
    mask = np.uint64((1 << bits) - 1)
    last = np.repeat(first[1:], first[1:] - first[:-1])  # of each token, the end of its text
    out = []
    for stream, (values, width) in enumerate(((hashes, 1), (hashes, 2), (shapes, 1), (shapes, 2), (shapes, 3))):
        count = max(len(values) - width + 1, 0)
        runs = texts.shingle_hashes(values, width) if len(values) >= width else np.zeros(0, dtype=np.uint64)
        inside = np.arange(count) + width <= last[:count]
        slots = (texts.mix(runs + np.uint64(stream)) & mask).astype(np.int64)[inside]
        out.append((slots, np.concatenate([[0], np.cumsum(inside)])[np.minimum(first, count)]))
    return out


def _scores(raw: np.ndarray, offsets: np.ndarray, weights: np.ndarray, bias: float, bits: int) -> np.ndarray:
    total = np.full(len(offsets) - 1, bias)
    for slots, first in features(raw, offsets, bits):
        sums = np.concatenate([[0.0], np.cumsum(weights[slots])])
        total += (sums[first[1:]] - sums[first[:-1]]) / np.maximum(first[1:] - first[:-1], 1)
    return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


class Ftrl:
    """Per-coordinate follow-the-regularised-leader updates of a logistic model; slot 0 of the end is the bias."""

    def __init__(self, size: int, alpha: float = 3.0, beta: float = 0.05, l1: float = 1e-4, l2: float = 1e-4):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(
            np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        )

    def update(self, at: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ values, -30, 30)))
        g = (p - label) * values
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def _example(text: str | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of a text's features, and of the bias."""
    raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
    at, values = [], []
    for slots, _ in features(raw, np.array([0, len(raw)]), bits):
        if len(slots):
            slot, count = np.unique(slots, return_counts=True)
            at.append(slot)
            values.append(count / len(slots))
    slot, place = np.unique(np.concatenate([*at, [1 << bits]]).astype(np.int64), return_inverse=True)
    return slot, np.bincount(place, np.concatenate([*values, [1.0]]))


def fit_rows(rows: list[tuple[str | None, int]], bits: int = BITS, epochs: int = EPOCHS, seed: int = SEED) -> tuple[np.ndarray, float]:
    """Weights and bias from (text, label) rows, in the order of a seeded shuffle in each epoch.

    Features are made anew in each epoch: those of all rows would take far more memory than the texts.
    """
    model = Ftrl(1 << bits)
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            model.update(*_example(rows[k][0], bits), rows[k][1])
    weights = model.weights()
    return weights[:-1].astype(np.float64), float(weights[-1])


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray
    bias: float
    bits: int


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    folds: int = 5,
    held_out: int = 0,
    train_rows: int = TRAIN_ROWS,
    bits: int = BITS,
) -> QualityModel:
    """Learn from labelled documents whose crc32(id) mod ``folds`` is not ``held_out``.

    At most ``train_rows`` labelled ids are drawn. Labels without id or value are
    left out; of several labels of one id the smallest counts. Documents with
    the same id are all learned from. Without any labelled document every score is 1/2.
    """
    given = (
        labels.select(field(key).alias("of_key"), field(label).cast("int").alias("label"))
        .where("of_key is not null and label is not null")
        .where(crc_fold(F.col("of_key"), folds) != held_out)
        .groupBy("of_key")
        .agg(F.min("label").alias("label"))
    )
    draw = F.xxhash64(F.lit(SEED), "of_key")
    chosen = given.withColumn("draw", draw).orderBy("draw", "of_key").limit(train_rows)
    rows = (
        docs.select(field(key).alias("key"), field(text).alias("text"))
        .join(F.broadcast(chosen), F.col("key") == F.col("of_key"))
        .select("draw", "text", "label")
        # Ids may repeat; the bound holds for documents too.
        .orderBy("draw", F.xxhash64("text"))
        .limit(train_rows)
    )

    def train(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["draw", "text"], kind="stable", na_position="first")
        weights, bias = fit_rows(list(zip(group["text"], group["label"], strict=True)), bits)
        used = np.flatnonzero(weights)
        return pd.DataFrame({"slots": [used], "values": [weights[used]], "bias": [bias]})

    fitted = rows.groupBy(F.lit(0).alias("all")).applyInPandas(
        train, "slots array<long>, values array<double>, bias double"
    ).collect()
    weights = np.zeros(1 << bits)
    if fitted:
        weights[np.array(fitted[0]["slots"], dtype=np.int64)] = fitted[0]["values"]
    return QualityModel(weights, fitted[0]["bias"] if fitted else 0.0, bits)


def score(docs: DataFrame, model: QualityModel, *, text: str = "text", into: str = "score") -> DataFrame:
    """All rows and columns of ``docs`` with the probability of label 1 in a new column ``into``.

    A missing text is scored like an empty one: by the bias. ``into`` must be a new name.
    """
    if into.lower() in map(str.lower, docs.columns):
        raise ValueError(f"{into} is a column already")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for first, end, raw, offsets in texts.text_slices(batch.column(at)):
                scores[first:end] = _scores(raw, offsets, model.weights, model.bias, model.bits)
            columns = [*batch.columns, pa.array(scores)]
            yield pa.record_batch(columns, names=[f"c{k}" for k in range(len(columns))])

    return widened(docs, run, T.StructType().add(into, "double"))
