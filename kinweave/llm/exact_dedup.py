"""Exact deduplication by a tree-merge of sorted digest runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import cut, shuffle_parts, text_or_empty

_KEY = ["digest", "chars", "check"]


def tree_exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", fan_in: int = 16) -> DataFrame:
    """Groups of identical texts; one row per input row.

    Every row belongs to one of fan_in**rounds nodes. A node starts with a run of its distinct digests in order, each
    with the identifier to keep and a count. In round r the fan_in nodes that differ in digit r alone exchange runs:
    a digest moves to the node that has the digest's own digit there, where up to fan_in runs are merged in order of
    digest and equal neighbours become one entry (a sort-based aggregation: the identifier is kept in a struct, which
    a hash aggregation can't update). After the last round each digest is in one node. Entries merge only if SHA-256,
    length and a second, independent 64-bit hash all agree, at every level. Rows are dealt to nodes by their place in
    the input, so a text that a third of the rows share is one entry for each node, never a group of rows in one
    task; the way back joins rows to entries by node and digest.

    Returns doc_id, keep_id, group_size, kept, text_sha256. keep: "smallest" or "largest" identifier stays.
    A null text counts as empty; empty texts equal each other. Null identifiers never win against others; rows that
    repeat the identifier that stays are all marked kept. An empty table gives an empty result. Other columns are
    ignored.
    """
    # A null identifier sorts behind all others, whichever end is kept.
    best, has_id = {"smallest": (F.min, F.col("doc_id").isNull()), "largest": (F.max, F.col("doc_id").isNotNull())}[keep]
    spark = docs.sparkSession
    parts = shuffle_parts(spark)
    rounds = 1
    while fan_in**rounds < 4 * parts:
        rounds += 1
    nodes = fan_in**rounds
    text = text_or_empty(text_col)
    digit = lambda x, r: F.pmod(F.floor(x / F.lit(fan_in**r)), F.lit(fan_in))

    rows = cut(
        docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"), F.char_length(text).cast("long").alias("chars"), F.xxhash64(text).alias("check"))
        .withColumn("node", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(nodes))),
        "digests",
    )

    def merged_runs(runs: DataFrame) -> DataFrame:
        return runs.repartition(parts, "node").groupBy("node", *_KEY).agg(best("entry").alias("entry"), F.sum("group_size").alias("group_size"))

    first = rows.select("node", *_KEY, F.struct(has_id.alias("has_id"), "doc_id").alias("entry"), F.lit(1).cast("long").alias("group_size"))
    leaves = cut(merged_runs(first), "leaves")
    runs = leaves
    home = F.pmod(F.xxhash64("digest"), F.lit(nodes))
    for r in range(rounds):
        runs = merged_runs(runs.withColumn("node", F.col("node") + (digit(home, r) - digit(F.col("node"), r)) * F.lit(fan_in**r)))
    runs = runs.select(*_KEY, F.col("entry.doc_id").alias("keep_id"), "group_size")
    merged = leaves.select("node", *_KEY).join(runs, _KEY)
    return rows.join(merged, ["node", *_KEY]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )
