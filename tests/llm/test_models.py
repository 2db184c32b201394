import zlib

import numpy as np
import pytest

pytest.importorskip("pyarrow")
import pyarrow as pa

from kinweave.llm.language import LanguageModel, _counts, _ftrl, _softmax, _temperature, _tfidf, fit_language, identify_languages
from kinweave.llm.quality import DIM, FactorisationMachine, _features, classify_quality

SF = "/root/testdata/sf0.01"


def test_factorisation_machine_against_the_sum_over_all_pairs():
    rng = np.random.default_rng(1)
    w, v = rng.normal(0, 1, DIM), rng.normal(0, 1, (DIM, 8))
    model = FactorisationMachine(0.3, w, v)
    for index, value in _features(pa.array(["One two two three.", "", None, "AAAA | #### 12", "x " * 40])):
        pairs = sum(v[i] @ v[j] * a * b for p, (i, a) in enumerate(zip(index, value)) for j, b in list(zip(index, value))[p + 1 :])
        assert model.logit(index, value) == pytest.approx(0.3 + sum(w[i] * a for i, a in zip(index, value)) + pairs, rel=1e-5, abs=1e-5)


def test_factorisation_machine_learns_an_interaction():
    # The label is whether both or neither of two features are there: no linear model has it.
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(800):
        a, b = rng.integers(0, 2, 2)
        index = np.array([0] * a + [1] * b + [2 + int(rng.integers(0, 20))], np.int32)
        rows.append((index[: a + b + 1], np.ones(a + b + 1, np.float32), int(a == b)))
    model = FactorisationMachine.fit(rows, epochs=40)
    right = [(model.logit(i, x) > 0) == bool(y) for i, x, y in rows]
    assert np.mean(right) > 0.95


def test_ftrl_against_the_dense_loop():
    rng = np.random.default_rng(3)
    x = [(np.sort(rng.choice(30, 5, replace=False)).astype(np.int32), rng.random(5)) for _ in range(60)]
    y = rng.integers(0, 3, 60)
    alpha, beta, l1, l2, epochs = 0.5, 1.0, 0.3, 0.02, 2
    z, n = np.zeros((30, 3)), np.zeros((30, 3))

    def weight(i, c):
        if abs(z[i, c]) <= l1:
            return 0.0
        return -(z[i, c] - np.sign(z[i, c]) * l1) / ((beta + np.sqrt(n[i, c])) / alpha + l2)

    order = np.random.default_rng(9)
    for _ in range(epochs):
        for k in order.permutation(60):
            full = np.zeros(30)
            full[x[k][0]] = x[k][1]
            w = np.array([[weight(i, c) for c in range(3)] for i in range(30)])
            p = _softmax(full @ w)
            for i in range(30):
                for c in range(3):
                    g = full[i] * (p[c] - (y[k] == c))
                    z[i, c] += g - (np.sqrt(n[i, c] + g * g) - np.sqrt(n[i, c])) / alpha * w[i, c]
                    n[i, c] += g * g
    want = np.array([[weight(i, c) for c in range(3)] for i in range(30)])
    got = _ftrl(x, y, 3, alpha, beta, l1, l2, epochs)
    assert np.allclose(got[:30], want, atol=1e-5) and not got[30:].any() and (want == 0).any()


def test_counts_of_whole_texts_don_t_depend_on_pieces(monkeypatch):
    from kinweave.llm import language

    text = "Das ist ein Text, 123 mit Übung!  Und noch einer…" * 7
    whole = _counts(text)
    monkeypatch.setattr(language, "_PIECE", 16)
    assert (_counts(text) == whole).all() and whole.sum() > 500
    assert _counts("12 --") is None and _counts("") is None


def test_temperature_is_the_best_of_its_grid():
    rng = np.random.default_rng(4)
    y = rng.integers(0, 3, 400)
    z = rng.normal(0, 1, (400, 3))
    z[np.arange(400), y] += 1.0
    t = _temperature(list(z * 7), y)
    loss = lambda t: -np.log(_softmax(z * 7 / t)[np.arange(400), y]).mean()
    assert loss(t) < loss(1.0) and all(loss(t) <= loss(u) + 1e-9 for u in np.geomspace(0.05, 5, 61))
    model = LanguageModel(["a", "b"], np.ones(1 << 13), np.ones((1 << 13, 2), np.float32), t)
    assert model.probabilities(_counts("abc")).tolist() == [0.5, 0.5] and _tfidf(_counts("abc"), np.ones(1 << 13)).dtype == np.float32


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_held_out_accuracy_of_quality(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    found = {r.doc_id: r for r in classify_quality(docs, labels).collect()}
    cases = [(r.quality, found[r.doc_id]) for r in labels.collect() if r.quality is not None and held(r.doc_id) and r.doc_id in found]
    assert len(cases) > 80 and all(r.held_out for _, r in cases)
    assert np.mean([r.predicted == y for y, r in cases]) >= 0.97


def test_held_out_accuracy_of_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = {r.doc_id: r for r in identify_languages(docs, fit_language(docs)).collect()}
    cases = [(r.lang, found[r.doc_id]) for r in docs.filter("lang IS NOT NULL").collect() if held(r.doc_id)]
    cases = [(y, r) for y, r in cases if r.lang_pred != "und"]
    assert len(cases) > 200 and np.mean([r.lang_pred == y for y, r in cases]) >= 0.97
