"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.llm.common import cut, running_sum, salted_lookup, text_or_empty, word_count

#: The cut is sought among at most so many copies at once, after halving the range of finish times so many times over.
_EXACT_ROWS, _BINS = 10_000, 4096


def source_targets(sources: DataFrame, weights: Sequence[int], max_repeats: int) -> DataFrame:
    """Target for each source (columns sk, source, source_size): total shared by weight, capped, excess reshared.

    Weights repeat over the sources in code point order, null last. Sources sorted by cap / weight fill up in that
    order, so the capped ones are a prefix, found with running sums. The table has one row per source; the ordering
    of sources is the only global one.
    """
    whole = Window.partitionBy(F.lit(1))
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("total") - F.col("caps_before")) / (F.col("all_weight") - F.col("weight_before"))
    return (
        ranked.withColumn("weight", w)
        .withColumn("cap", F.col("source_size") * F.lit(max_repeats))
        .withColumn("total", F.sum("source_size").over(whole))
        .withColumn("all_weight", F.sum("weight").over(whole))
        .withColumn("caps_before", F.coalesce(F.sum("cap").over(fill), F.lit(0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(fill), F.lit(0.0)))
        .withColumn("capped", F.col("cap") / F.col("weight") <= level)
        .withColumn("open_total", F.col("total") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(whole))
        .withColumn("open_weight", F.sum(F.when(~F.col("capped"), F.col("weight")).otherwise(0.0)).over(whole))
        .withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("open_total") * F.col("weight") / F.col("open_weight")))
        .select("sk", "source", "source_size", "weight", "target")
    )


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = (5, 2, 1),
    max_repeats: int = 3,
    seed: int = 7,
) -> DataFrame:
    """How many words the mix takes of each document; one row per input row.

    Each source queues its documents in shuffled order (MD5 of seed and identifier, or of the text where that is null),
    up to max_repeats times over.
    A copy's virtual finish time is the source's words up to and including it, divided by the source's target. All
    copies in order of finish time, then digest, identifier and size, are taken until the total budget (the words of
    all documents) would be exceeded; the last copy that fits ends the mix. The place of the cut is found by
    histograms of finish times, each within the bin of the one before, and an exact order of that last bin alone, so
    no task sorts more than a bin.

    Returns doc_id, source, size, source_size, target, copies, taken (size * copies). A null text has size 0 and is
    never taken; a null source is a source of its own, last in order. Repeated rows are separate documents with equal
    keys: they take turns in the running sum and fall on either side of the cut. Nothing is dropped: documents
    outside the mix have taken 0. An empty table gives an empty result. Other columns are ignored.
    """
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.md5("text")))))
    rows = cut(
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text_or_empty(text_col)).alias("size"), text_or_empty(text_col).alias("text"))
        .withColumn("sk", F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source").cast("string"))))
        .withColumn("key", key).drop("text"),
        "sizes",
    )
    sizes = rows.groupBy("sk").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    targets = cut(source_targets(sizes, weights, max_repeats), "targets")
    queued = running_sum(rows, "sk", "key", "size", ["doc_id", "size"], "upto")
    queued = cut(salted_lookup(queued, targets.drop("source", "weight"), "sk", F.xxhash64("key")), "queue")

    budget = targets.agg(F.sum("source_size")).first()[0] or 0
    finish = lambda e: (F.col("source_size") * F.lit(e) + F.col("upto")) / F.col("target")
    copies = (
        queued.filter("size > 0 AND target > 0")
        .select("key", "doc_id", "size", "upto", F.explode(F.array(*[finish(e) for e in range(max_repeats)])).alias("finish"))
    )
    last = _last_taken(copies, budget)
    if last is None:
        taken = F.lit(0)
    else:
        # Copies before or at the last one taken, in the same total order.
        at = F.struct(*[F.lit(last[c]).cast(t).alias(c) for c, t in (("finish", "double"), ("key", "string"), ("doc_id", dict(queued.dtypes)["doc_id"]), ("size", "long"), ("upto", "long"))])
        own = lambda e: F.struct(finish(e).alias("finish"), "key", "doc_id", "size", "upto")
        taken = sum((F.when((F.col("size") > 0) & (F.col("target") > 0) & (own(e) <= at), 1).otherwise(0) for e in range(max_repeats)), F.lit(0))
    return queued.withColumn("copies", taken.cast("int")).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def _last_taken(copies: DataFrame, budget: int) -> dict | None:
    """The last copy, in order of finish time and ties, at which the running sum is within budget."""
    low, high, before = 0.0, None, 0
    while True:
        inside = copies.filter(F.col("finish") >= F.lit(low)) if high is None else copies.filter((F.col("finish") >= F.lit(low)) & (F.col("finish") < F.lit(high)))
        n, top = inside.agg(F.count(F.lit(1)), F.max("finish")).first()
        if n <= _EXACT_ROWS or top <= low:
            break
        # The first histogram stops at 2: the budget is reached near 1.
        end = high if high is not None else min(top, 2.0) if low < min(top, 2.0) else top
        width = (end - low) / _BINS
        if low + width <= low:
            break
        edge = lambda b: low + b * width
        bins = sorted((r[0], r[1]) for r in inside.groupBy(F.least(F.floor((F.col("finish") - F.lit(low)) / F.lit(width)), F.lit(_BINS)).alias("b")).agg(F.sum("size")).collect())
        totals = list(accumulate((size for _, size in bins), initial=before))
        at = next((k for k in range(len(bins)) if totals[k + 1] > budget), None)
        if at is None:
            break
        # One bin to either side: what rounding puts across an edge stays inside.
        b = bins[at][0]
        new_low = edge(max(0, b - 1))
        new_high = high if b >= _BINS else edge(b + 2)
        if (new_low, new_high) == (low, high):
            break
        before += copies.filter((F.col("finish") >= F.lit(low)) & (F.col("finish") < F.lit(new_low))).agg(F.sum("size")).first()[0] or 0
        low, high = new_low, new_high
    order = Window.orderBy("finish", "key", "doc_id", "size", "upto").rowsBetween(Window.unboundedPreceding, 0)
    fits = inside.withColumn("total", F.sum("size").over(order)).filter(F.col("total") + F.lit(before) <= F.lit(budget))
    row = fits.orderBy(F.desc("finish"), F.desc("key"), F.desc("doc_id"), F.desc("size"), F.desc("upto")).limit(1).collect()
    if row:
        return row[0].asDict()
    if not before:
        return None
    row = copies.filter(F.col("finish") < F.lit(low)).orderBy(F.desc("finish"), F.desc("key"), F.desc("doc_id"), F.desc("size"), F.desc("upto")).limit(1).collect()
    return row[0].asDict()
