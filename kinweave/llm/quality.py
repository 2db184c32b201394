"""Quality classifier: a factorisation machine over hashed words, structure and metadata."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import bounded_batches, cut, text_or_empty, within_cells, worker_cache
from kinweave.llm.shingles import WordHasher, row_words, text_pieces

_WORD_BUCKETS = 1 << 14
_LENGTH_BUCKETS = 40
#: Statistics of structure, in the order of _statistics().
_STATS = 14
DIM = _WORD_BUCKETS + _LENGTH_BUCKETS + _STATS


def held_out(id_col: str | Column) -> Column:
    """Whether crc32 of the identifier as text leaves the remainder 1 modulo 3; false for null."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _statistics(data: np.ndarray, words: np.ndarray, buckets: int) -> np.ndarray:
    """Shares of kinds of bytes, and how words repeat; all within 0 and 1."""
    n, m = max(1, len(data)), max(1, len(words))
    count = np.bincount(data, minlength=256)
    upper, lower, digits = count[65:91].sum(), count[97:123].sum(), count[48:58].sum()
    symbols = count[33:48].sum() + count[58:65].sum() + count[91:97].sum() + count[123:127].sum()
    lines = count[10] + 1
    return np.array(
        [
            upper / n, upper / max(1, upper + lower), digits / n, symbols / n, (symbols - count[46] - count[44]) / n, count[124] / n * 4, count[33] / n * 4,
            (count[35] + count[36] + count[37] + count[38] + count[42]) / n * 4, count[128:].sum() / n, min(1.0, lines / m), min(1.0, n / m / 20),
            buckets / m, float((words[1:] == words[:-1]).mean()) if len(words) > 1 else 0.0, (count[46] + count[63]) / m if m else 0.0,
        ],
        np.float32,
    ).clip(0, 1)


def _features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indices, values) of each text, whole."""
    cache = worker_cache("quality")
    if not hasattr(cache, "hasher"):
        cache.hasher = WordHasher()
    for first, end, data, offsets in text_pieces(column):
        words, at, _ = row_words(cache.hasher, data, offsets)
        for k in range(end - first):
            own = words[at[k] : at[k + 1]]
            index, tf = np.unique((own >> np.uint64(40)).astype(np.int64) & (_WORD_BUCKETS - 1), return_counts=True)
            value = np.log1p(tf).astype(np.float32)
            norm = float(np.sqrt((value * value).sum())) or 1.0
            distinct = len(np.unique(own))
            body = data[offsets[k] : offsets[k + 1]]
            length = min(_LENGTH_BUCKETS - 1, 2 * len(body).bit_length() + (len(body) > 1.5 * (1 << max(0, len(body).bit_length() - 1))))
            stats = _statistics(body, own, distinct)
            yield (
                np.concatenate([index, [_WORD_BUCKETS + length], _WORD_BUCKETS + _LENGTH_BUCKETS + np.arange(_STATS)]).astype(np.int32),
                np.concatenate([value / norm, [0.5], stats]).astype(np.float32),
            )


@dataclass
class FactorisationMachine:
    """bias + w.x + the sum over i < j of <v_i, v_j> x_i x_j, as a logit."""

    bias: float
    w: np.ndarray
    v: np.ndarray

    def logit(self, index: np.ndarray, value: np.ndarray) -> float:
        """In time linear in the features: pairs sum to half of (square of sum - sum of squares), for each factor."""
        vx = self.v[index] * value[:, None]
        total = vx.sum(axis=0)
        return float(self.bias + self.w[index] @ value + 0.5 * (total @ total - (vx * vx).sum()))

    @classmethod
    def fit(cls, rows: list[tuple[np.ndarray, np.ndarray, int]], factors: int = 8, epochs: int = 12, rate: float = 0.08, l2: float = 1e-5, seed: int = 5) -> FactorisationMachine:
        """AdaGrad on the logistic loss, one row at a time, in seeded order. One class only: a constant."""
        rng = np.random.default_rng(seed)
        w, v = np.zeros(DIM, np.float32), rng.normal(0, 0.05, (DIM, factors)).astype(np.float32)
        labels = np.array([y for _, _, y in rows], np.float32)
        share = float((labels.sum() + 1) / (len(rows) + 2))
        model = cls(float(np.log(share / (1 - share))), w, v)
        if len(set(labels.tolist())) < 2:
            v[:] = 0
            return model
        gw, gv, gb = np.full(DIM, 1e-3, np.float32), np.full((DIM, factors), 1e-3, np.float32), 1e-3
        for _ in range(epochs):
            for k in rng.permutation(len(rows)):
                index, value, y = rows[k]
                own = v[index]
                vx = own * value[:, None]
                total = vx.sum(axis=0)
                logit = model.bias + w[index] @ value + 0.5 * (total @ total - (vx * vx).sum())
                g = 1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y
                dw = g * value + l2 * w[index]
                dv = g * value[:, None] * (total - vx) + l2 * own
                gw[index] += dw * dw
                gv[index] += dv * dv
                gb += g * g
                w[index] -= rate * dw / np.sqrt(gw[index])
                v[index] -= rate * dv / np.sqrt(gv[index])
                model.bias -= rate * float(g) / gb**0.5
        return model


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 4000, max_cells: int = 8_000_000) -> FactorisationMachine:
    """Fit on at most max_rows labelled documents outside the held-out third, of at most max_cells features in all.

    The sample is the labelled rows whose identifiers have the least seeded hashes, all rows if there are no more; of
    rows that repeat an identifier, the one whose text has the least hash. Their sparse features, computed on the
    executors, are all that reaches the driver.
    """
    chosen = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    chosen = chosen.distinct().orderBy(F.xxhash64(F.lit(5), "doc_id"), "doc_id", "label").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select(F.xxhash64(F.lit(5), "doc_id").alias("h"), "label", "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i.tobytes(), x.tobytes(), len(i)) for i, x in _features(batch.column(2))]
            columns = [pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.binary()), pa.array([f[2] for f in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["h", "label", "i", "x", "cells"])

    sample = cut(texts.mapInArrow(features, "h long, label int, i binary, x binary, cells long"), "quality-sample")
    rows = within_cells(sample, ["h"], "cells", max_cells).collect()
    rows.sort(key=lambda r: (r.h, r.label, bytes(r.i), bytes(r.x)))
    return FactorisationMachine.fit([(np.frombuffer(r.i, np.int32), np.frombuffer(r.x, np.float32), int(r.label > 0)) for r in rows])


def score_quality(docs: DataFrame, model: FactorisationMachine, id_col: str = "doc_id", text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with the model's probability (double) of label 1 in column out, from the text alone."""
    sent = docs.sparkSession.sparkContext.broadcast((model.bias, model.w, model.v))
    names = docs.columns
    text = "__kw_text"
    given = docs.withColumn(text, text_or_empty(text_col))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = FactorisationMachine(*sent.value)
        for batch in batches:
            p = [1 / (1 + np.exp(-np.clip(own.logit(i, x), -30, 30))) for i, x in _features(batch.column(len(names)))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(names))), pa.array(p, pa.float64())], [*names, out])

    schema = docs.select(*names).schema.add(out, "double")
    return given.mapInArrow(score, schema)


def classify_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 4000) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 if score >= 0.5) of every row of docs.

    Only the text is an input of the score: words hashed to 2**14 buckets, statistics of structure, and the length in
    bytes as metadata. A null text is scored as the empty one, which has the length and structure features alone.
    Repeated rows get equal scores. Without labelled rows every score is 0.5; an empty table gives an empty result.
    Other columns, also of labels, are ignored.
    """
    bounded_batches(docs.sparkSession)
    model = fit_quality(docs, labels, id_col, text_col, label_col, max_rows)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return score_quality(rows, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
