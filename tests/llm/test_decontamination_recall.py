import random

import duckdb
import pytest

pytest.importorskip("pyarrow")
from kinweave.llm.decontamination import find_contamination

SF = "/root/testdata/sf0.01"


def words_of(text):
    return "".join(c.lower() if c < "\x80" else c for c in text).split()


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


@pytest.fixture(scope="module")
def texts():
    return [t for (t,) in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet' WHERE length(text) > 400 ORDER BY doc_id").fetchall()]


@pytest.fixture(scope="module")
def items():
    return duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet' ORDER BY item_id").fetchall()


def planted(rng, texts, passage):
    words = rng.choice(texts).split()
    at = rng.randrange(len(words))
    return " ".join(words[:at] + passage + words[at:])


def found(spark, texts, docs, items):
    rows = [(k, t) for k, t in enumerate(docs)] + [(10**6 + k, t) for k, t in enumerate(texts)]
    got = find_contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    return {(r.doc_id, r.item_id) for r in got.select("doc_id", "item_id").collect()}


def test_recall_of_planted_paraphrases(spark, texts, items):
    rng = random.Random(5)
    vocabulary = [w for t in texts for w in t.split()]
    docs, want = [], {}
    for item_id, text in items:
        own = text.split()
        n, answer = len(own), max(3, len(own) // 5)
        for share in (1.0, 0.9, 0.8, 0.7, 0.6, 0.5, "inserted"):
            passage = list(own)
            if share == "inserted":
                for _ in own:
                    passage.insert(rng.randrange(len(passage) + 1), rng.choice(vocabulary))
            else:
                for k in rng.sample(range(n - answer), min(n - answer, int(n * (1 - share) + 1e-9))):
                    passage[k] = rng.choice(vocabulary)
            # Brute force: what the operator's own checks accept of the passage.
            there, whole = words_of(" ".join(passage)), words_of(text)
            common = lcs(there, whole) / n
            if common >= 0.8 or common >= 0.5 and lcs(there, whole[-answer:]) >= 0.8 * answer:
                want[len(docs), item_id] = share
            docs.append(planted(rng, texts, passage))
    got = found(spark, texts, docs, items)
    for share in (1.0, 0.9, 0.8, 0.7, 0.6, 0.5, "inserted"):
        cases = [x for x, s in want.items() if s == share]
        recall = sum(x in got for x in cases) / len(cases)
        assert len(cases) >= 30 and recall >= 0.9, (share, recall, len(cases))


def test_exact_copies_of_short_items_are_all_found(spark, texts, items):
    rng = random.Random(6)
    short = [(100 * item_id + n, " ".join(text.split()[:n])) for item_id, text in items for n in range(5, 11)]
    docs = [planted(rng, texts, text.split()) for _, text in short]
    got = found(spark, texts, docs, short)
    assert [x for k, x in enumerate(short) if (k, x[0]) not in got] == []
