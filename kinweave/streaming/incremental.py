"""Linking targets as they arrive: every micro-batch is normalised and meets the index of the known S1 records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from kinweave.operators import blocking
from kinweave.operators.records import normalize_records


def link_stream(targets: DataFrame, s1: DataFrame, out: str, checkpoint: str, top_k: int = 10, max_df: int = 300) -> StreamingQuery:
    """Append candidates of streamed raw targets (entity_id, business_name, business_address, country, src) to out.

    s1: normalised S1 records. Their keys, weights and address word frequencies are written once, beside the checkpoint,
    and a batch's own keys meet them; address words that only targets have count as most rare. Each batch overwrites its
    own folder, so a batch that is run again after a failure is written once.
    """
    spark = s1.sparkSession
    words, index = f"{checkpoint}-words", f"{checkpoint}-index"
    blocking.address_word_frequencies(s1).write.mode("overwrite").parquet(words)
    known = spark.read.parquet(words)
    blocking.s1_index(blocking.emit_keys(s1, known), s1, max_df).write.mode("overwrite").parquet(index)

    def one(batch: DataFrame, number: int) -> None:
        records = normalize_records(batch)
        own = blocking.address_word_frequencies(records).join(known.select("country_n", "w"), ["country_n", "w"], "left_anti")
        keys = blocking.emit_keys(records, known.unionByName(own.selectExpr("country_n", "w", "0L AS df")))
        blocking.best_of_index(keys, spark.read.parquet(index), top_k).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return targets.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
