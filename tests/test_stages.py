import pytest
from pyspark.sql import functions as F

from kinweave.__main__ import main
from kinweave.functions import kernels
from kinweave.operators import translit
from kinweave.operators.records import normalize_records
from kinweave.plans import linkage, stages
from kinweave.sources import fixtures, tsv
from kinweave.streaming.incremental import link_stream

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """Source and truth files of both splits, as the reader wants them."""
    data, work = (str(tmp_path_factory.mktemp(x)) for x in ("data", "work"))
    records, truth = fixtures.all_records(spark, SF), fixtures.truth_pairs(spark, SF)
    for split in ("train", "test"):
        for k in (1, 2, 3):
            tsv.write_tsv(records.filter(F.col("src") == k).drop("src"), f"{data}/{split}_source{k}.tsv")
    lists = truth.groupBy(F.col("s1_id").alias("source1_entity_id")).agg(F.array_join(F.collect_list("tgt_id"), ",").alias("matched_entity_ids"))
    tsv.write_tsv(lists, f"{data}/train_ground_truth.tsv")
    return data, work


def test_files_round_trip(spark, folders):
    data, _ = folders
    want = {tuple(r) for r in fixtures.all_records(spark, SF).select(*tsv.RAW_COLUMNS, "src").collect()}
    assert {tuple(r) for r in tsv.load_sources(spark, data, "train").collect()} == want
    assert {tuple(r) for r in tsv.load_ground_truth(spark, data, "train").collect()} == {tuple(r) for r in fixtures.truth_pairs(spark, SF).collect()}


def test_all_stages_from_files_to_lists(spark, folders, capsys):
    data, work = folders
    common = ["--data", data, "--work", work]
    main(["prepare", *common])
    main(["block", *common])
    main(["train", *common, "--share", "0.6", "--rounds", "4"])
    main(["predict", *common])
    main(["diagnose", *common])
    shown = capsys.readouterr().out
    assert "macro F0.5" in shown and all(x in shown for x in ("country_scores", "error_taxonomy", "importances", "confidence"))
    pairs = linkage.load_features(spark, f"{work}/train_features", ["t_id", "n_ratio"], "t_id = 'T7'")
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(t_id), EqualTo(t_id,T7)]" in plan and "ReadSchema: struct<t_id:string,n_ratio:double>" in plan
    meta = linkage.saved_decision(spark, work)
    assert meta["macro_f"] > 0.7 and len(meta["features"]) == 131
    matches = tsv.explode_truth(tsv.read_tsv(spark, f"{work}/out/matching_results.tsv"))
    truth = fixtures.truth_pairs(spark, SF)
    right, found, true = matches.join(truth, ["s1_id", "tgt_id"]).count(), matches.count(), truth.count()
    assert right / found > 0.85 and right / true > 0.7
    records = spark.read.parquet(f"{work}/test_records")
    lists = [tsv.read_tsv(spark, f"{work}/out/{x}.tsv") for x in ("matching_results", "candidate_pairs")]
    assert tuple(tsv.validate_outputs(records.filter("src = 1"), *lists).first()) == (0, 0, 0, 0) and lists[0].count() == records.filter("src = 1").count()
    # Straight from the files, with the saved model.
    linkage.link_files(spark, data, "test", work, f"{work}/direct")
    assert tsv.read_tsv(spark, f"{work}/direct/matching_results.tsv").count() == lists[0].count()


def test_spellings_are_learned_and_applied(spark):
    rows = [("s1", "Ram Seva", "12 Main Road, Pune", "in", 1), ("s2", "Jay Seva", "4 Hill Road, Pune", "in", 1), ("s3", "Ram Traders", "5 Hill Road, Pune", "in", 1), ("t1", "राम सेवा", "12 Main Road, पुणे", "in", 2), ("t2", "जय सेवा", "4 Hill Road, पुणे", "in", 2), ("t3", "राम ट्रेडर्स", "5 Hill Road, पुणे", "in", 2)]
    raw = spark.createDataFrame(rows, "entity_id string, business_name string, business_address string, country string, src int")
    truth = spark.createDataFrame([("s1", "t1"), ("s2", "t2"), ("s3", "t3")], "s1_id string, tgt_id string")
    table = translit.fit_table(raw, truth)
    learned = {(r.native, r.latin) for r in table.collect()}
    assert {("राम", "ram"), ("सेवा", "seva"), ("पुणे", "pune")} <= learned
    got = {r.entity_id: (r.core, r.adw) for r in normalize_records(raw, table).collect()}
    assert got["t1"] == got["s1"] and got["t3"][0].startswith("ram ") and got["t2"][1] == got["s2"][1]
    assert len(translit.fit_table(raw, truth, spark.createDataFrame([("s1",)], "s1_id string")).collect()) == 0


def test_streamed_targets_get_the_candidates_of_a_batch_run(spark, tmp_path):
    targets = fixtures.target_records(spark, SF)
    targets.repartition(3).write.parquet(f"{tmp_path}/in")
    s1 = normalize_records(fixtures.s1_records(spark, SF))
    stream = spark.readStream.schema(targets.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = link_stream(stream, s1, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    query.awaitTermination()
    found = spark.read.parquet(f"{tmp_path}/out")
    truth = fixtures.truth_pairs(spark, SF).withColumnRenamed("tgt_id", "t_id")
    assert found.select("batch").distinct().count() == 3
    assert found.filter("brank = 0").join(truth, ["s1_id", "t_id"]).count() / truth.count() > 0.85
    assert found.groupBy("t_id").count().filter("count > 10").count() == 0


def test_partial_ratio_against_brute_force():
    import random

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        return row[-1]

    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(9)))
    for _ in range(800):
        a, b = word(), word()
        assert kernels.common_length(a, b) == lcs(a, b)
        short, long = sorted((a, b), key=len)
        windows = [long[max(0, i) : i + len(short)] for i in range(1 - len(short), len(long))] if short else []
        want = max((200.0 * lcs(short, w) / (len(short) + len(w)) for w in windows), default=100.0 if not long else 0.0)
        assert kernels.partial_ratio(a, b) == pytest.approx(want)
