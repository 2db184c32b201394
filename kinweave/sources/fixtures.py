"""Entity records with known truth, derived from the star-schema tables by arithmetic that both SQL engines share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Syllables of three letters, in order.
_SYL = "'bardenfolgrikaslummornexpolrinstavelwixzantorqua'"


def _syl(n: str) -> str:
    return f"substr({_SYL}, CAST(({n}) % 16 AS INT) * 3 + 1, 3)"


_DIV = "CAST(floor({0} / {1}) AS BIGINT)".format
_NAME = f"{_syl('k')} || {_syl(_DIV('k', '16.0'))} || ' ' || p_name"
_LEGAL = "CASE k % 5 WHEN 0 THEN ' LLC' WHEN 1 THEN ', Inc.' WHEN 2 THEN ' Pvt. Ltd.' WHEN 3 THEN ' Corp' ELSE '' END"
_STREET = f"{_syl('k * 5')} || {_syl(_DIV('k', '7.0'))}"
_HOUSE = "(k * 37) % 997 + 1"

S1 = f"""
SELECT 'S' || CAST(k AS STRING) AS entity_id, {_NAME} || {_LEGAL} AS business_name,
       CAST({_HOUSE} AS STRING) || ' ' || {_STREET} || ' street, ' || n_name AS business_address, r_name AS country, 1 AS src
FROM (SELECT c_custkey AS k, c_nationkey FROM {{customer}}) c JOIN {{part}} p ON p.p_partkey = (k * 7) % 200
JOIN {{nation}} n ON n.n_nationkey = c_nationkey JOIN {{region}} r ON r.r_regionkey = n.n_regionkey
"""

_IS_MATCH = "o_orderkey % 4 <> 0 AND o_custkey % 18 <> 0"
TARGETS = f"""
SELECT 'T' || CAST(o_orderkey AS STRING) AS entity_id,
       CASE o_orderkey % 8 WHEN 1 THEN upper({_NAME} || {_LEGAL}) WHEN 2 THEN {_NAME} WHEN 3 THEN replace({_NAME}, 'l', '1') || {_LEGAL}
            WHEN 5 THEN {_NAME} || ' ' || {_NAME} WHEN 7 THEN {_syl('k * 3')} || ' trading as ' || {_NAME} ELSE {_NAME} || {_LEGAL} END AS business_name,
       CASE o_orderkey % 7 WHEN 3 THEN '' WHEN 5 THEN CAST({_HOUSE} + 1 AS STRING) || ' ' || {_STREET} || ' st, ' || n_name
            ELSE CAST({_HOUSE} AS STRING) || ' ' || {_STREET} || ' street, ' || n_name END AS business_address,
       r_name AS country, CAST(2 + o_orderkey % 2 AS INT) AS src
FROM (SELECT o_orderkey, o_custkey, CASE WHEN {_IS_MATCH} THEN o_custkey ELSE 100000 + o_orderkey % 90000 END AS k FROM {{orders}}) o
JOIN {{customer}} c ON c.c_custkey = o_custkey JOIN {{part}} p ON p.p_partkey = (k * 7) % 200
JOIN {{nation}} n ON n.n_nationkey = c_nationkey JOIN {{region}} r ON r.r_regionkey = n.n_regionkey
"""

TRUTH = f"SELECT 'S' || CAST(o_custkey AS STRING) AS s1_id, 'T' || CAST(o_orderkey AS STRING) AS tgt_id FROM {{orders}} WHERE {_IS_MATCH}"

TABLES = ("customer", "part", "nation", "region", "orders")


def _run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    used = [t for t in TABLES if f"{{{t}}}" in sql]
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def s1_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, S1)


def target_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, TARGETS)


def truth_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, TRUTH)


def all_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s1_records(spark, sf_dir).unionByName(target_records(spark, sf_dir))


def oracle_ctes() -> str:
    """The same views for DuckDB, where tables are known by name."""
    named = {t: t for t in TABLES}
    return f"er_s1 AS ({S1.format(**named)}), er_tgt AS ({TARGETS.format(**named)}), er_truth AS ({TRUTH.format(**named)}), er_all AS (SELECT * FROM er_s1 UNION ALL SELECT * FROM er_tgt)"
