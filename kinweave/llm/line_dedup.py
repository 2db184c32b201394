"""Removal of lines that many sites share, found with HyperLogLog sketches."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import WORD, cut, salted_lookup, text_or_empty


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def dedup_lines_across_sites(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = 5, min_words: int = 1, lg_k: int = 10
) -> DataFrame:
    """Texts without the lines that at least min_sites distinct sites have; one row per input row.

    Each line of min_words words or more (any line that isn't blank, by default) is hashed to 128 bits. A HyperLogLog sketch of sites per hash is built in
    the map tasks and merged by the aggregation. Estimates within three standard errors (at least 1) of min_sites are
    settled by exact distinct counts of those lines alone; lines that occur fewer than min_sites times need neither.
    All occurrences of a boilerplate line go, and nothing else changes. A line that a third of all rows have is one
    sketch per map task; look-ups of it are salted.

    Returns doc_id, text, n_lines, n_removed (long). Lines are what \\n separates. A null text gives '' with one
    (empty) line; blank lines always stay, as do those of fewer than min_words words. Null sites count as one site. Repeated rows each get a result.
    An empty table gives an empty result. Other columns are ignored.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"), F.coalesce(F.col(site_col).cast("string"), F.lit("\0")).alias("site")).withColumn("check", F.xxhash64("text"))
    lines = (
        base.select("doc_id", "check", "site", F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
        .filter(F.col("line").rlike(r"[^\x20\x09-\x0D]") if min_words <= 1 else F.regexp_count("line", F.lit(WORD)) >= min_words)
        .select("doc_id", "check", "site", "pos", F.concat(F.hex(F.xxhash64("line")), F.hex(F.xxhash64(F.lit(1), "line"))).alias("line"))
    )
    counted = (
        lines.groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"))
        .filter(F.col("n") >= min_sites)
        .select("line", F.hll_sketch_estimate("sketch").alias("sites"))
    )
    band = max(1, math.ceil(3 * 1.04 / math.sqrt(2**lg_k) * min_sites))
    spread = cut(counted.filter(F.col("sites") >= min_sites - band), "lines")
    near = cut(spread.filter(F.col("sites") <= min_sites + band).select("line", F.lit(True).alias("near")), "near")
    exact = (
        salted_lookup(lines.select("line", "site", "doc_id"), near, "line", F.xxhash64("doc_id"), "inner")
        .select("line", "site").distinct()
        .groupBy("line").agg(F.count(F.lit(1)).alias("sites"))
        .filter(F.col("sites") >= min_sites)
        .select("line")
    )
    boilerplate = cut(spread.filter(F.col("sites") > min_sites + band).select("line").unionByName(exact).withColumn("goes", F.lit(True)), "boilerplate")
    gone = (
        salted_lookup(lines, boilerplate, "line", F.xxhash64("doc_id"), "inner")
        .groupBy(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("id"), "check").agg(F.collect_set("pos").alias("gone"))
    )
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.filter(_lines(F.col("text")), lambda x, i: ~F.array_contains("gone", i)), "\n"))
    return (
        base.withColumn("id", F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).join(gone, ["id", "check"], "left")
        .select("doc_id", kept.alias("text"), F.size(_lines(F.col("text"))).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))
    )
