import inspect

from pyspark.sql import functions as F

from kinweave.operators import blocking
from kinweave.operators.records import normalize_records
from kinweave.plans import linkage
from kinweave.sources import fixtures
from kinweave.streaming.incremental import link_stream

SF = "/root/testdata/sf0.001"


def test_keys_of_31_to_300_records_yield_candidates(spark):
    records = spark.createDataFrame([(f"s{k:03}", "us", 1) for k in range(100)] + [("t", "us", 2)], "entity_id string, country_n string, src int")
    keys = records.select("entity_id", "src", "country_n", F.lit("n").alias("kind"), F.lit("shared").alias("key"))
    assert [r.s1_id for r in blocking.candidates(records, keys=keys).orderBy("brank").collect()] == [f"s{k:03}" for k in range(10)]
    assert blocking.candidates(records, max_df=30, keys=keys).count() == 0


def test_the_whole_chain_has_the_default_and_passes_it_on():
    for f in (blocking.candidates, linkage.candidate_pairs, linkage.train, linkage.predict, linkage.link_files, link_stream):
        assert inspect.signature(f).parameters["max_df"].default == 300
