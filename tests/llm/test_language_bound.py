import pytest

pytest.importorskip("pyarrow")
from pyspark.sql import functions as F

from kinweave.llm.language import fit_language, identify_languages


def test_every_language_is_learned(spark):
    rows = spark.range(4500).select(F.col("id").alias("doc_id"), F.format_string("%1$s%1$s %1$s", F.char(97 + F.col("id") % 26)).alias("text"), F.concat(F.lit("l"), (F.col("id") % 300).cast("string")).alias("lang"))
    assert len(fit_language(rows, epochs=1).langs) == 300


def test_samples_are_bounded_and_the_same_in_every_run(spark):
    texts = {"aa": "the ing tion and", "bb": "schön lich keit und", "cc": "ção ões não"}
    rows = [(k, texts[x] * (k % 3 + 1), x) for k in range(900) for x in [("aa", "aa", "bb", "cc")[k % 4]]] + [(5, "the the", "aa")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    few = fit_language(docs, max_per_lang=20)
    assert few.langs == ["aa", "bb", "cc"] and (fit_language(docs.repartition(7), max_per_lang=20).w == few.w).all()
    assert all(r.lang_pred == r.lang for r in identify_languages(docs, few).join(docs.dropDuplicates(["doc_id"]).select("doc_id", "lang"), "doc_id").collect())
    assert fit_language(docs, max_cells=0).w.any() == False  # noqa: E712
