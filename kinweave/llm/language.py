"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.llm.common import bounded_batches, cut, salted_lookup, small_enough, text_or_empty, within_cells, worker_cache
from kinweave.llm.quality import held_out
from kinweave.llm.shingles import mix

_DIM = 1 << 13
_PIECE = 1 << 18


def _letters() -> np.ndarray:
    """For each code point whether it is a letter; kept by the worker."""
    cache = worker_cache("language")
    if not hasattr(cache, "letters"):
        cache.letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return cache.letters


def _counts(text: str) -> np.ndarray | None:
    """Counts of hashed 1-, 2- and 3-grams of the lower-cased letters, runs of others as one space; None without letters.

    Long texts are counted in pieces that overlap by two characters, so every n-gram counts once.
    """
    letters, out, any_letter, tail = _letters(), np.zeros(_DIM, np.int64), False, np.zeros(1, np.uint64)
    for at in range(0, max(1, len(text)), _PIECE):
        code = np.frombuffer(text[at : at + _PIECE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = letters[np.minimum(code, 0x10FFFF)]
        any_letter = any_letter or bool(is_letter.any())
        code = np.where(is_letter, code, 0).astype(np.uint64)
        code = np.concatenate([tail, code])
        keep = np.ones(len(code), bool)
        keep[len(tail) :] = (code[len(tail) :] > 0) | (code[len(tail) - 1 : -1] > 0)
        code = code[keep]
        for n in (1, 2, 3):
            # Of the overlap, only n-grams that end beyond it are new.
            gram = np.full(max(0, len(code) - n + 1), n, np.uint64)
            for i in range(n):
                gram = gram * np.uint64(0x100000001B3) + code[i : len(code) - n + 1 + i]
            gram = gram[max(0, len(tail) - n + 1) :]
            out += np.bincount((mix(gram) >> np.uint64(20)).astype(np.int64) & (_DIM - 1), minlength=_DIM)
        tail = code[-2:]
    return out if any_letter else None


def _tfidf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    return (x / (np.sqrt((x * x).sum()) or 1.0)).astype(np.float32)


@dataclass
class LanguageModel:
    langs: list[str]
    idf: np.ndarray
    w: np.ndarray
    temperature: float

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        return _softmax((_tfidf(counts, self.idf) @ self.w) / self.temperature)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _ftrl(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, alpha: float, beta: float, l1: float, l2: float, epochs: int) -> np.ndarray:
    """Follow the regularised leader (proximal): per coordinate, weights are the closed-form minimum of the linearised
    losses so far plus an elastic net, so weights that l1 outweighs are exactly 0."""
    z, n = np.zeros((_DIM, classes)), np.zeros((_DIM, classes))
    rng = np.random.default_rng(9)

    def weights(index) -> np.ndarray:
        zi = z[index]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[index])) / alpha + l2))

    for _ in range(epochs):
        for k in rng.permutation(len(x)):
            index, value = x[k]
            w = weights(index)
            p = _softmax(value @ w)
            p[y[k]] -= 1
            g = value[:, None] * p
            z[index] += g - (np.sqrt(n[index] + g * g) - np.sqrt(n[index])) / alpha * w
            n[index] += g * g
    return weights(slice(None)).astype(np.float32)


def fit_language(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_per_lang: int = 800, max_rows: int = 40_000, max_cells: int = 16_000_000,
    alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, epochs: int = 3,
) -> LanguageModel:
    """Learn every lang value from rows outside the held-out third whose lang and text are not null.

    Document frequencies count all of those rows, in one vector per task. The weights are fitted on a sample of each
    language: the rows with the least hashes, max_per_lang of them or, with very many languages, an equal share of
    max_rows (8 at least), and of at most max_cells n-gram counts in all, four fifths of them; the rest set the
    temperature. Rows that repeat an identifier and language count once, by the text with the least hash. The model
    holds 2**13 weights a language, and the driver three times as many while it fits them.
    """
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    texts = texts.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    sizes = cut(texts.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")), "langs")
    langs = sorted(r[0] for r in sizes.select("lang").collect())
    most = min(max_per_lang, max(8, max_rows // max(1, len(langs))))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows = np.zeros(_DIM, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                counts = _counts(text.as_py())
                if counts is not None:
                    df += counts > 0
                    rows += 1
        found = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"gram": pa.array(np.append(found, -1), pa.int32()), "df": pa.array(np.append(df[found], rows), pa.int64())})

    found = texts.select("text").mapInArrow(frequencies, "gram int, df long").groupBy("gram").agg(F.sum("df")).collect()
    df, total = np.zeros(_DIM), 0
    for gram, n in found:
        if gram < 0:
            total = n
        else:
            df[gram] = n
    idf = np.log((1 + total) / (1 + df)) + 1

    # The window sees a few more rows of each language than it keeps, however many there are.
    hashed = F.xxhash64(F.lit(9), "doc_id")
    near = salted_lookup(texts.select("doc_id", "lang"), sizes, "lang", F.xxhash64("doc_id"), "inner")
    near = near.filter(F.shiftrightunsigned(hashed, 1) / F.lit(2.0**63) * F.col("rows") < 1.25 * most + 64).select("doc_id", "lang").distinct()
    order = Window.partitionBy("lang").orderBy(hashed, "doc_id")
    chosen = cut(near.withColumn("k", F.row_number().over(order).cast("long")).filter(F.col("k") <= most), "language-sample")
    sample = texts.join(F.broadcast(chosen) if small_enough(chosen) else chosen, ["doc_id", "lang"])
    sample = sample.groupBy("doc_id", "lang", "k").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("k", hashed.alias("h"), "lang", "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, h, lang, _counts(t)) for k, h, lang, t in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            rows = [(k, h, lang, np.flatnonzero(c).astype(np.int32), c) for k, h, lang, c in rows if c is not None]
            columns = {"k": pa.array([r[0] for r in rows], pa.int64()), "h": pa.array([r[1] for r in rows], pa.int64()), "lang": pa.array([r[2] for r in rows], pa.string())}
            columns |= {"i": pa.array([r[3].tobytes() for r in rows], pa.binary()), "c": pa.array([r[4][r[3]].astype(np.int32).tobytes() for r in rows], pa.binary()), "cells": pa.array([len(r[3]) for r in rows], pa.int64())}
            yield pa.RecordBatch.from_pydict(columns)

    sample = cut(sample.mapInArrow(features, "k long, h long, lang string, i binary, c binary, cells long"), "language-features")
    rows = within_cells(sample, ["k", "h"], "cells", max_cells).collect()
    rows.sort(key=lambda r: (r.h, r.lang, bytes(r.c)))
    place = {x: k for k, x in enumerate(langs)}
    x, y = [], np.array([place[r.lang] for r in rows], np.int64)
    for r in rows:
        index, counts = np.frombuffer(r.i, np.int32), np.frombuffer(r.c, np.int32)
        value = np.log1p(counts) * idf[index]
        x.append((index, value / (np.sqrt((value * value).sum()) or 1.0)))
    apart = np.arange(len(x)) % 5 == 4
    w = _ftrl([x[k] for k in np.flatnonzero(~apart)], y[~apart], len(langs), alpha, beta, l1, l2, epochs)
    return LanguageModel(langs, idf, w, _temperature([value @ w[index] for (index, value), a in zip(x, apart, strict=True) if a], y[apart]))


def _temperature(logits: list[np.ndarray], y: np.ndarray) -> float:
    """The temperature with the least log loss on rows that the weights were not fitted on."""
    if not logits:
        return 1.0
    z = np.array(logits)
    loss = lambda t: -np.log(np.maximum(_softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean()
    return float(min(np.geomspace(0.05, 5, 61), key=loss))


def identify_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred and score (probability, 0 to 1) of every row of docs, from the text alone.

    A text that is null or has no letters gets `und` and score 0; so does every text if no language was learned. Equal
    probabilities go to the language first in order. Repeated rows get equal results; an empty table gives an empty
    result; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.langs, model.idf, model.w, model.temperature))
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = LanguageModel(*sent.value)
        for batch in batches:
            names, scores = [], []
            for text in batch.column(1):
                counts = _counts(text.as_py()) if own.langs else None
                p = own.probabilities(counts) if counts is not None else None
                names.append("und" if p is None else own.langs[int(p.argmax())])
                scores.append(0.0 if p is None else float(p.max()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    found = rows.mapInArrow(predict, f"doc_id {dict(rows.dtypes)['doc_id']}, lang_pred string, score double")
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
