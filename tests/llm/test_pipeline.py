import collections
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
import corpus_pipeline
from kinweave.llm.common import cut, shared_root, written
from kinweave.llm.near_dedup import near_duplicates

#: Columns of documents, and others whose names the stages or operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, gone string, key long, label long, cid string, k int, h int, copies long, size long, node long"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def frame(spark, rows):
    """rows: (doc_id, text, source)."""
    return spark.createDataFrame([(i, t, "en", s, 1, f"keep me {i}", 1, 2, "c", 3, 4, 5, 6, 7) for i, t, s in rows], SCHEMA)


def prose(rng, n, good=True):
    return " ".join(rng.choice("bcdfgh") + rng.choice("aeiou") + rng.choice("lmnrst") + rng.choice("aeiou") + rng.choice(["", "", ".", ","]) for _ in range(n)) if good else " ".join(rng.choice(["BUY!!", "$$$", "CLICK!!!", "WIN##"]) for _ in range(n))


ODD = [(None, None, None), (None, "x y z a b c", "s"), (None, "x y z a b c", "s"), (3, "", "s"), (3, "", "s"), (4, " \n ", None), (5, None, "t"), (5, "own words here", "t")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """documents, labels and benchmark as the stages read them; what happens to each document is known."""
    rng, path = random.Random(11), str(tmp_path_factory.mktemp("sf"))
    rows = [(100 + k, prose(rng, 60), f"s{k % 3}") for k in range(240)]
    junk = [(1000 + k, prose(rng, 60, False), "s0") for k in range(120)]
    copies = [(2000 + k, rows[k][1], "s1") for k in range(20)]
    words = [r[1].split() for r in rows[20:40]]
    near = [(2100 + k, " ".join(w[:30] + ["other"] + w[31:]), "s2") for k, w in enumerate(words)]
    items = [(k, prose(rng, 30)) for k in range(6)] + [(50, None), (51, "")]
    leaked = [(3000 + k, f"{prose(rng, 30)} {items[k][1]} {prose(rng, 30)}", "s1") for k in range(6)]
    labels = [(i, 1, 0) for i, *_ in rows] + [(i, 0, 0) for i, *_ in junk] + [(100, None, None)]
    spark.createDataFrame([(k, t) for k, t in items], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    frame(spark, rows + junk + copies + near + leaked + ODD).write.parquet(f"{path}/documents.parquet")
    return path, {i for i, *_ in rows}, {i for i, *_ in junk}, {i for i, *_ in copies + near}, {i for i, *_ in leaked}


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "mixing", "tokens"]
    assert corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("name", ["quality", "near_dedup", "decontamination", "mixing"])
def test_columns_and_odd_rows_of_each_stage(spark, folder, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = frame(spark, ODD * 2 + [(7, "word " * 50_000, "u"), (7, "word " * 50_000, "u")])
    got = stage(spark, docs, folder[0])
    assert got.columns == COLUMNS and got.dtypes == docs.dtypes
    rows = got.collect()
    assert all(r.gone == f"keep me {r.doc_id}" for r in rows)
    assert stage(spark, docs.limit(0), folder[0]).collect() == []
    many = collections.Counter((r.doc_id, r.text) for r in rows)
    if name == "near_dedup":
        # A null text is the empty one, so (5, null) is not (3, '').
        assert many == {(None, None): 1, (None, "x y z a b c"): 1, (3, ""): 1, (4, " \n "): 1, (5, None): 1, (5, "own words here"): 1, (7, "word " * 50_000): 1}
    if name == "decontamination":
        assert many == collections.Counter((r.doc_id, r.text) for r in docs.collect())
    if name == "mixing":
        assert all(t and t.strip() for _, t in many)


def test_which_documents_each_stage_keeps(spark, folder):
    path, good, junk, copies, leaked = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    ids = lambda df: {r.doc_id for r in df.collect()}
    kept = ids(corpus_pipeline.quality(spark, docs, path))
    assert len(good - kept) <= 2 and len(junk & kept) <= 1
    kept = ids(corpus_pipeline.near_dedup(spark, docs, path))
    assert good <= kept and leaked <= kept and not copies & kept
    kept = ids(corpus_pipeline.decontamination(spark, docs, path))
    assert good | junk | copies <= kept and not leaked & kept


def test_near_dedup_where_doc_ids_are_null(spark, folder):
    text = prose(random.Random(3), 40)
    got = corpus_pipeline.near_dedup(spark, frame(spark, [(None, text, "s"), (9, text, "s"), (8, text + " more", "s"), (None, "a b c d e f g", "s"), (None, "A b c d e f g", "s")]), folder[0]).collect()
    assert [r.doc_id for r in got if r.doc_id is not None] == [8] and len(got) == 2


def test_mixing_takes_whole_copies(spark, folder):
    path = folder[0]
    docs = spark.read.parquet(f"{path}/documents.parquet").filter("doc_id >= 100")
    got = collections.Counter(r.doc_id for r in corpus_pipeline.mixing(spark, docs, path).collect())
    assert max(got.values()) <= 3 and min(got.values()) >= 1
    assert sum(got.values()) <= docs.count() * 1.5


def test_tokens_against_the_library_and_whole_run(spark, folder):
    from tokenizers import Tokenizer

    path = folder[0]
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = frame(spark, ODD)
    want = sorted((-1 if i is None else i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, t, _ in ODD for x in [[*plain.encode(t or "", add_special_tokens=False).ids, 0]])
    got = corpus_pipeline.tokens(spark, docs, path).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert corpus_pipeline.tokens(spark, docs.limit(0), path).collect() == []
    before = set(written())
    rows = corpus_pipeline.run(spark, path).orderBy("start").collect()
    _, good, junk, copies, leaked = folder
    ids = {r.doc_id for r in rows}
    assert len(ids & junk) <= 1 and not ids & (copies | leaked) and len(good & ids) > 20
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))
    # Only what the result reads is left.
    left = [x for x in written() if x not in before]
    assert len(left) == 2 and {x.split("-")[-2] for x in left} == {"tokens", "shards"}
    root = shared_root(spark).removeprefix("file://")
    assert {os.path.basename(x) for x in left} <= set(os.listdir(root)) and not [x for x in os.listdir(root) if x.startswith("kinweave-mixing")]


def test_string_ids_are_refused_before_any_work(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    docs.withColumn("doc_id", docs.doc_id.cast("string")).write.parquet(f"{tmp_path}/documents.parquet")
    with pytest.raises(TypeError, match="doc_id is of type string"):
        corpus_pipeline.run(spark, str(tmp_path))


def _probe(spark):
    """What the Python workers keep, by worker."""

    def look(batches):
        import os
        import sys

        for batch in batches:
            kept = sorted(vars(sys.modules["_kinweave_worker_cache"])) if "_kinweave_worker_cache" in sys.modules else []
            yield pa.RecordBatch.from_pydict({"pid": [os.getpid()], "kept": [" ".join(kept)]})

    return {r.pid: r.kept.split() for r in spark.range(0, 16, 1, 16).mapInArrow(look, "pid long, kept string").collect()}


def test_workers_let_go_of_the_tokenizer(spark):
    docs = spark.createDataFrame([(k, f"word{k} and word{k + 1}", "s") for k in range(40)], "doc_id long, text string, source string").repartition(4)
    assert corpus_pipeline.tokens(spark, docs, "").count() == 40
    assert len(corpus_pipeline.tokens(spark, docs, "").collect()) == 40
    near_duplicates(docs).collect()
    kept = _probe(spark)
    assert any("hasher" in x for x in kept.values())
    assert not any("encoder" in x and "hasher" in x for x in kept.values())


def test_tables_and_shuffle_files_go_when_read(spark):
    docs = spark.createDataFrame([(k, " ".join(f"g{k // 4}w{j}" for j in range(60)) + f" end{k}", "s") for k in range(40)], "doc_id long, text string, source string")
    shuffled = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").count("/shuffle_")
    before, files = set(written()), shuffled()
    cut(docs.groupBy("source", "doc_id").count(), "counts")
    assert shuffled() <= files
    found = near_duplicates(docs)
    left = {x.rsplit("/", 1)[1].rsplit("-", 1)[0].removeprefix("kinweave-") for x in written() if x not in before}
    assert not left & {"sketches", "hashed", "buckets", "wanted", "able", "able-buckets", "placed", "sets", "near", "centres", "differences", "prefixes"}
    assert found.filter("kept").count() == 10
