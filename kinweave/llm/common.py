"""What the training-data operators share: cutting lineage, salted look-ups, running sums."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import math
import sys
import tempfile
import types
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A table is broadcast only after a count shows at most so many rows.
BROADCAST_ROWS = 50_000
#: And, if its rows hold arrays, at most so many cells in all (of 8 bytes).
BROADCAST_CELLS = 2_000_000
_written: list[str] = []
#: With this setting Spark deletes a query's shuffle files when it ends, and not when the driver happens to collect garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a session in local mode (one machine, as in tests) gets a folder of its own; on a cluster this
    raises, as each executor would write to its own disk.
    """
    found = spark.conf.get("spark.checkpoint.dir", "")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.gettempdir()}/kinweave-checkpoints"
    return found.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_root(spark)}/kinweave-{label}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again.

    Later jobs then start from files that survive the loss of any executor, and nothing is computed twice. The shuffle
    files of the write go as soon as it ends.
    """
    spark = df.sparkSession
    path, before = shared_path(spark, label), spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    found = spark.read.schema(df.schema).parquet(path)
    found._kw_path = path
    return found


def written() -> list[str]:
    """Paths that cut() and others wrote in this session and that are still there, oldest first."""
    return list(_written)


def drop_cuts(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete what was written, all of it or those paths; results that still read it can't be used afterwards."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for name in written() if paths is None else paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
        _written.remove(name)


def discard(*tables: DataFrame) -> None:
    """Delete tables as cut() returned them, once nothing reads them any more; those that are gone already are left out."""
    for table in tables:
        drop_cuts(table.sparkSession, [x for x in [table._kw_path] if x in _written])


def bounded_batches(spark: SparkSession, most: int = 1000) -> None:
    """At most so many texts reach a Python worker at once; a setting of the session that is lower already stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= most:
        spark.conf.set(name, most)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_enough(table: DataFrame, most: int = BROADCAST_ROWS, cells: Column | None = None) -> bool:
    """Whether table has at most `most` rows (reads no more than one beyond that) and BROADCAST_CELLS array cells."""
    rows, total = table.limit(most + 1).agg(F.count(F.lit(1)), F.sum(F.lit(0) if cells is None else cells)).first()
    return rows <= most and (total or 0) <= BROADCAST_CELLS


def salted_lookup(rows: DataFrame, table: DataFrame, key: str, salt: Column, how: str = "left", salts: int = 64, cells: Column | None = None) -> DataFrame:
    """Join table, unique by key, to rows, however many of the rows share one key.

    Only the distinct pairs of key and salt meet the table, so a key that holds a third of all rows meets it
    `salts` times; the rows then join those pairs and so spread over `salts` tasks. Keys must not be null. cells: how
    many array cells a row of the table has, if any.
    """
    if small_enough(table, cells=cells):
        return rows.join(F.broadcast(table), key, how)
    rows = rows.withColumn("__kw_salt", F.pmod(salt, F.lit(salts)))
    pairs = rows.select(key, "__kw_salt").distinct().join(table, key)
    return rows.join(pairs, [key, "__kw_salt"], how).drop("__kw_salt")


def within_cells(sample: DataFrame, order: list[str], cells: str, most: int) -> DataFrame:
    """The rows of a sample of bounded size that come first, as far as their cells sum to at most `most`.

    order: columns of whole numbers. Only they and the cells reach the driver.
    """
    total, last = 0, None
    for r in sorted(sample.select(*order, cells).collect()):
        total += r[-1]
        if total > most:
            break
        last = r[:-1]
    else:
        return sample
    if last is None:
        return sample.limit(0)
    return sample.filter(F.struct(*order) <= F.struct(*[F.lit(x).cast("long") for x in last]))


def worker_cache(owner: str) -> types.ModuleType:
    """A place for what an operator keeps in a Python worker from one task to the next.

    All operators of a session share the workers. What another owner has kept there goes first, and its memory with it,
    or an executor would hold a tokenizer's tables during all that follows.
    """
    name = "_kinweave_worker_cache"
    cache = sys.modules.get(name)
    if cache is None or cache.owner != owner:
        sys.modules[name] = fresh = types.ModuleType(name)
        fresh.owner = owner
        if cache is not None:
            cache.__dict__.clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # other C libraries than glibc
                ctypes.CDLL(None).malloc_trim(0)
    return sys.modules[name]


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def hex_digits(rows: int, per_bucket: int) -> int:
    """How many leading hex digits of a digest give buckets of about per_bucket rows."""
    return min(8, max(1, math.ceil(math.log(max(rows, 1) / per_bucket, 16)))) if rows > per_bucket else 1


def running_sum(rows: DataFrame, group: str, key: str, value: str, ties: list[str], out: str, per_bucket: int = 20_000) -> DataFrame:
    """Running sum of value within group, in order of key (a hex digest), then ties.

    A group may hold any share of the rows: sums by bucket of leading digits give each bucket its offset, and only
    rows of one bucket are ordered together. group and key must not be null.
    """
    digits = hex_digits(rows.count(), per_bucket)
    rows = rows.withColumn("__kw_bucket", F.substring(key, 1, digits))
    before = Window.partitionBy(group).orderBy("__kw_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(group, "__kw_bucket")
        .agg(F.sum(value).alias("__kw_sum"))
        .select(group, "__kw_bucket", F.coalesce(F.sum("__kw_sum").over(before), F.lit(0)).alias("__kw_offset"))
    )
    within = Window.partitionBy(group, "__kw_bucket").orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.join(offsets, [group, "__kw_bucket"])
        .withColumn(out, F.col("__kw_offset") + F.sum(value).over(within))
        .drop("__kw_bucket", "__kw_offset")
    )
