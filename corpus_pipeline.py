"""A training corpus from the documents table: quality, near duplicates, decontamination, mixing, token files.

Every stage takes documents with the columns doc_id (a whole number), text and source, and any others, and all but the
last return the same columns. Rows that agree in doc_id and text are one document. Null texts count as empty; empty
tables give empty results. Names that begin with __kw_ are reserved for the stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.common import cut, drop_cuts, small_enough, text_or_empty, written
from kinweave.llm.decontamination import find_contamination
from kinweave.llm.mixing import mix_sources
from kinweave.llm.near_dedup import near_duplicates
from kinweave.llm.quality import fit_quality, score_quality
from kinweave.llm.token_store import require_whole_numbers, tokenize_to_files

#: A document by what it holds (128 bits), for joins back to it: identifiers may be null or repeat.
_KEY, _ID, _COPIES, _SCORE = "__kw_key", "__kw_id", "__kw_copies", "__kw_score"


def _keyed(docs: DataFrame) -> DataFrame:
    name = F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("null"))
    return docs.withColumn(_KEY, F.md5(F.concat(name, F.lit("\0"), text_or_empty("text"))))


def _without(keyed: DataFrame, gone: DataFrame) -> DataFrame:
    return keyed.join(F.broadcast(gone) if small_enough(gone) else gone, _KEY, "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.5 or more, repeated rows included. Empty texts are scored like any other;
    without labelled documents all stay."""
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, model, out=_SCORE).filter(F.col(_SCORE) >= 0.5).drop(_SCORE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8): the one with the least doc_id.

    Documents without words are in no group. Those without a doc_id come behind all others and in order of their text's
    hash among themselves. Of rows that are one document one stays.
    """
    # None first, so that a null doc_id is never least where another is there.
    keyed = _keyed(docs).withColumn(_ID, F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(_KEY).alias("key")))
    found = near_duplicates(keyed, id_col=_ID)
    gone = cut(found.filter(~F.col("kept")).select(F.col("doc_id.key").alias(_KEY)).distinct(), "duplicates")
    return _without(keyed, gone).dropDuplicates([_KEY]).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of the benchmark of three words or more (shorter ones are ordinary prose)."""
    keyed = _keyed(docs)
    found = find_contamination(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=_KEY, min_words=3)
    gone = cut(found.select(F.col("doc_id").alias(_KEY)).distinct(), "contaminated")
    return _without(keyed, gone).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: up to three times (each of its rows), or not at all, as those without
    words. A null source is a source of its own."""
    keyed = _keyed(docs)
    copies = mix_sources(keyed, id_col=_KEY).groupBy(F.col("doc_id").alias(_KEY)).agg(F.sum("copies").alias(_COPIES)).filter(F.col(_COPIES) > 0)
    taken = keyed.dropDuplicates([_KEY]).join(copies, _KEY)
    return taken.withColumn(_COPIES, F.explode(F.sequence(F.lit(1), F.col(_COPIES)))).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """Token files in order of doc_id (null first), and what reading them gives for each row; an empty text has its end id alone."""
    import public_tokenizers

    return tokenize_to_files(docs, public_tokenizers.path(tokenizer))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("tokens", tokens)]

#: SQL can express neither the classifier nor the latent retrieval nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents table; each one's result is written before the next reads it.

    What a stage has written is deleted as soon as its result is. The rows returned are read from the token files.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    require_whole_numbers(docs, "doc_id")
    others = set(written())
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
        result = written()[-1]
        drop_cuts(spark, [x for x in written() if x != result and x not in others])
    found = STAGES[-1][1](spark, docs, sf_dir)
    drop_cuts(spark, [result])
    return found
