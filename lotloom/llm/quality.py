"""Quality classifier: naive Bayes support vectors (NB-SVM).

Features are indicators of hashed n-grams: words and pairs of words, and one to three successive word shapes (kinds
of characters, length, closing punctuation, same as the word before). Each indicator is scaled by the log ratio of
its smoothed frequencies in the two classes, rows are brought to length 1, and a linear model with hinge loss is
fitted by dual coordinate descent. A logistic curve fitted on rows kept from the fit turns margins into 0..1.

The fit uses at most `max_rows` labelled rows with `max_numbers` feature numbers, those that come first by MD5 of
their id, and takes place in one task; scoring is one pass over all texts.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotloom.llm.common import OWN, give_back, quoted, small_batches, text_or_empty, written
from lotloom.llm.words import blocks, mix, word_hashes

#: Hashed features; labelled rows that a fit uses at most; smoothing; cost of the hinge loss.
FEATURES, MAX_ROWS, ALPHA, COST, EPOCHS = 1 << 18, 8000, 1.0, 1.0, 25
#: Distinct features of these rows in all that a fit uses at most.
MAX_NUMBERS = 1 << 24
#: Share of the scaled mean weight that each weight is drawn towards, as usual with these models.
BETA = 0.25

_KIND = np.zeros(256, np.uint8)
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = 1, 2, 4, 16
for _c in b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~":
    _KIND[_c] = 8
_SALTS = [np.uint64(x * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) for x in (1, 3, 5, 7, 11)]


def features(texts: list[bytes]) -> list[np.ndarray]:
    """Feature numbers of each text, with repeats."""
    h, of, begin, end, buf = word_hashes(texts)
    if not len(h):
        return [np.empty(0, np.int64)] * len(texts)
    same = np.zeros(len(h), bool)
    in_text = np.zeros(len(h), bool)  # whether the word before is of the same text
    in_text[1:] = of[1:] == of[:-1]
    same[1:] = in_text[1:] & (h[1:] == h[:-1])
    kinds = np.bitwise_or.reduceat(_KIND[buf], begin).astype(np.uint64)
    last = buf[end - 1]
    closing = np.where(_KIND[last] == 8, last, 0).astype(np.uint64)
    size = np.minimum((end - begin) // 3, 7).astype(np.uint64)
    u = np.uint64
    shape = mix(kinds | closing << u(5) | same.astype(np.uint64) << u(13) | size << u(14))
    with np.errstate(over="ignore"):
        # a text's first words have no n-gram before them, wherever in the batch the text stands
        pair = np.zeros_like(h)
        pair[1:] = np.where(in_text[1:], h[1:] + h[:-1] * _SALTS[1], 0)
        two = np.zeros_like(h)
        two[1:] = np.where(in_text[1:], shape[1:] + shape[:-1] * _SALTS[1], 0)
        three = np.zeros_like(h)
        three[2:] = np.where(in_text[2:] & in_text[1:-1], two[2:] + shape[:-2] * _SALTS[2], 0)
        grams = np.stack([mix(x + s) for x, s in zip((h, pair, shape, two, three), _SALTS, strict=True)])
    ids = (grams & u(FEATURES - 1)).astype(np.int64)
    at = np.searchsorted(of, np.arange(len(texts) + 1))
    return [ids[:, at[i] : at[i + 1]].reshape(-1) for i in range(len(texts))]


@dataclass
class Model:
    """Weights of the indicators before rows are brought to length 1, their squared scales, and the curve."""

    weights: np.ndarray
    squares: np.ndarray
    bias: float
    slope: float
    shift: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        out = np.empty(len(texts))
        seen = np.zeros(FEATURES, np.int64)
        for first, run in blocks(texts):
            for i, ids in enumerate(features(run)):
                place = np.arange(len(ids))
                seen[ids] = place
                ids = ids[seen[ids] == place]  # each number once
                margin = float(self.weights[ids].sum(dtype=np.float64)) / max(1e-12, float(self.squares[ids].sum(dtype=np.float64))) ** 0.5 + self.bias
                out[first + i] = margin
        return 1 / (1 + np.exp(-np.clip(self.slope * out + self.shift, -30, 30)))


def _hinge(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, float]:
    """Weights and bias by dual coordinate descent; rows have length 1, and the bias is a constant feature of 1."""
    w, bias, alpha = np.zeros(FEATURES), 0.0, np.zeros(len(rows))
    diag = np.array([float(v @ v) + 1 for v in values])
    for _ in range(EPOCHS):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            x, v = rows[i], values[i]
            gradient = y[i] * (float(w[x] @ v) + bias) - 1
            new = min(max(alpha[i] - gradient / diag[i], 0.0), COST)
            if (step := (new - alpha[i]) * y[i]) != 0:
                w[x] += step * v
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, bias


def _curve(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve, by Newton steps on smoothed targets."""
    n1, n0 = int(label.sum()), int((1 - label).sum())
    target = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, float(np.log((n1 + 1) / (n0 + 1)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([((p - target) * margin).sum() + 1e-3 * a, (p - target).sum()])
        v = p * (1 - p) + 1e-9
        hess = np.array([[(v * margin**2).sum() + 1e-3, (v * margin).sum()], [(v * margin).sum(), v.sum()]])
        step = np.linalg.solve(hess, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 1e-3), b


def fit_rows(rows: list[np.ndarray], labels: np.ndarray, seed: int = 0) -> Model:
    """A model from distinct feature numbers and labels 0/1. With one class or none, every score is the smoothed share of 1."""
    n1 = int(labels.sum())
    if len(set(labels.tolist())) < 2 or len(labels) < 10:
        share = (n1 + 1) / (len(labels) + 2)
        return Model(np.zeros(FEATURES, np.float32), np.zeros(FEATURES, np.float32), 0.0, 0.0, float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    kept = rng.random(len(rows)) < 0.2  # for the curve
    if len(set(labels[kept].tolist())) < 2 or len(set(labels[~kept].tolist())) < 2:
        kept[:] = False
    fit = np.flatnonzero(~kept)
    counts = np.full((2, FEATURES), ALPHA)
    for i in fit:
        counts[labels[i], rows[i]] += 1
    seen = counts.sum(0) > 2 * ALPHA
    ratio = np.where(seen, np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum()), 0.0)
    values = []
    for x in rows:
        v = ratio[x]
        values.append(v / max(1e-12, float(np.sqrt(v @ v))))
    w, bias = _hinge([rows[i] for i in fit], [values[i] for i in fit], labels[fit] * 2.0 - 1, rng)
    w = (1 - BETA) * np.abs(w[seen]).mean() + BETA * w
    on = np.flatnonzero(kept) if kept.any() else np.arange(len(rows))
    margin = np.array([float(w[rows[i]] @ values[i]) + bias for i in on])
    slope, shift = _curve(margin, labels[on])
    return Model((w * ratio).astype(np.float32), (ratio**2).astype(np.float32), bias, slope, shift)


def held_out(id_: Column) -> Column:
    """Whether a row's label is for tests only; a null id is not held out."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    max_rows: int = MAX_ROWS, max_numbers: int = MAX_NUMBERS, seed: int = 0,
) -> Model:
    """Fits on documents with a label 0 or 1 that are not held out: max_rows rows and max_numbers feature numbers at most.

    Rows without id or label are not used; a repeated label row or document counts as often as it is there.
    """
    key = F.col(quoted(id_col))
    chosen = (
        labels.where(key.isNotNull() & F.col(quoted(label_col)).isin(0, 1) & ~held_out(key))
        .select(key.alias(f"{OWN}id"), F.col(quoted(label_col)).cast("int").alias(f"{OWN}label"))
        .orderBy(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary")), key, f"{OWN}label")
        .limit(max_rows)
    )
    rows = docs.select(key.alias(f"{OWN}id"), text_or_empty(quoted(text_col)).alias(f"{OWN}text")).join(
        F.broadcast(chosen), f"{OWN}id"  # max_rows rows of two numbers at most
    )

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for _, run in blocks(batch.column(1).to_pylist()):
                found += [np.unique(ids).astype(np.int32) for ids in features(run)]
            ids = pa.array([x.tobytes() for x in found], pa.binary())
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "label": batch.column(2), "n": pa.array([len(x) for x in found], pa.int64()), "ids": ids})

    small_batches(docs.sparkSession)
    kind = rows.schema[0].dataType.simpleString()
    found = written(rows.mapInArrow(extract, f"id {kind}, label int, n long, ids binary").withColumn("key", F.md5("ids")), "features")
    # repeated documents may be more than max_rows, and long ones more than max_numbers: the first by id stay
    order = Window.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary")), "id", "label", "key")
    used = found.select("id", "label", "key", "n").withColumns({"row": F.row_number().over(order), "sum": F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    used = used.where((F.col("row") <= max_rows) & (F.col("sum") <= max_numbers)).groupBy("id", "label", "key").agg(F.count(F.lit(1)).alias("times"))
    chosen = found.join(used, ["id", "label", "key"]).dropDuplicates(["id", "label", "key"]).select("id", "label", "times", "key", "ids")

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("label", "ascending"), ("key", "ascending")])
        times = np.array(table["times"].to_pylist(), np.int64)
        ids = [np.frombuffer(x.as_buffer(), np.int32) for x in table["ids"]]
        labels = np.array(table["label"].to_pylist(), np.int64)
        give_back()
        model = fit_rows([x for x, t in zip(ids, times, strict=True) for _ in range(t)], np.repeat(labels, times), seed)
        return pa.table({"model": pa.array([pickle.dumps(model)], pa.binary())})

    got = chosen.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(fit, "model binary").collect()  # one model, of fixed size
    return pickle.loads(got[0].model) if got else fit_rows([], np.empty(0, np.int64), seed)


def with_score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with the model's score of each whole text; a null text scores as an empty one, that is by the bias alone.

    Nothing but the text is read. A column of that name is replaced.
    """

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.score(texts.tolist()))
        give_back()

    small_batches(docs.sparkSession)
    kept = [F.col(quoted(c)) for c in docs.columns if c.lower() != name.lower()]
    return docs.select(*kept, scored(F.col(quoted(text_col))).alias(name))
