"""Learned spellings of native-script words: mined from matched pairs, applied before normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions.text import INDIC, ZERO_WIDTH, fold, let

_SPLIT = r"[\s,.;:()\[\]{}|/\\\-]+"


def native_tokens(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(text, ZERO_WIDTH, ""), _SPLIT), lambda x: x != "")


def latin_tokens(text: Column) -> Column:
    return F.filter(F.split(fold(text), "[^a-z0-9]+"), lambda x: x != "")


def romanized(token: Column) -> Column:
    """A token's letters one by one, doubled ones once."""
    return F.regexp_replace(F.regexp_replace(fold(token), "[^a-z0-9]", ""), r"(.)\1+", "$1")


def _most_common(weighed: DataFrame, total: Column, least: float, share: float) -> DataFrame:
    """(native, latin): each native text's heaviest latin one, where it weighs `least` and has that share of total."""
    order = Window.partitionBy("native").orderBy(F.desc("weight"), "latin")
    ranked = weighed.withColumn("total", total).withColumn("r", F.row_number().over(order))
    return ranked.filter((F.col("r") == 1) & (F.col("weight") >= least) & (F.col("weight") / F.col("total") >= share)).select("native", "latin")


def mine_tokens(pairs: DataFrame, min_count: float = 2, min_share: float = 0.5) -> DataFrame:
    """(native, latin) from matched texts (columns native, latin): aligned by position where token counts are equal,
    else every native token counts a share for every latin one."""
    rows = pairs.filter(F.col("native").rlike(INDIC)).select(native_tokens(F.col("native")).alias("a"), latin_tokens(F.col("latin")).alias("b"))
    aligned = F.zip_with("a", "b", lambda x, y: F.struct(x.alias("native"), y.alias("latin"), F.lit(1.0).alias("w")))
    crossed = F.flatten(F.transform("a", lambda x: F.transform(F.col("b"), lambda y: F.struct(x.alias("native"), y.alias("latin"), (1.0 / F.greatest(F.size("b"), F.lit(1))).alias("w")))))
    weighed = rows.select(F.explode(F.when(F.size("a") == F.size("b"), aligned).otherwise(crossed)).alias("x")).select("x.*").filter(F.col("native").rlike(INDIC))
    weighed = weighed.groupBy("native", "latin").agg(F.sum(F.col("w").cast("decimal(18,9)")).cast("double").alias("weight"))
    return _most_common(weighed, F.sum("weight").over(Window.partitionBy("native")), min_count, min_share)


def mine_components(pairs: DataFrame, min_count: float = 3, min_share: float = 0.5) -> DataFrame:
    """(native, latin) of whole address parts between commas: a native part with the latin parts of its matches."""
    part = lambda c: F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")
    rows = pairs.filter(F.col("native").rlike(INDIC)).select(F.transform(part("native"), lambda x: F.regexp_replace(x, ZERO_WIDTH, "")).alias("a"), F.array_distinct(F.transform(part("latin"), fold)).alias("b"))
    parts = rows.select(F.explode("a").alias("native"), "b").filter(F.col("native").rlike(INDIC))
    seen = parts.groupBy("native").agg(F.count(F.lit(1)).alias("seen"))
    weighed = parts.select("native", F.explode("b").alias("latin")).groupBy("native", "latin").agg(F.count(F.lit(1)).alias("weight"))
    return _most_common(weighed.join(seen, "native"), F.col("seen"), min_count, min_share)


def fit_table(records: DataFrame, truth: DataFrame, allowed_s1: DataFrame | None = None) -> DataFrame:
    """The table of tokens (from names) and, where those don't have it, of address parts, from true pairs alone."""
    truth = truth if allowed_s1 is None else truth.join(allowed_s1, "s1_id", "left_semi")
    side = lambda key, end: records.select(F.col("entity_id").alias(key), F.col("business_name").alias(f"n{end}"), F.col("business_address").alias(f"a{end}"))
    joined = truth.join(side("tgt_id", "t"), "tgt_id").join(side("s1_id", "s"), "s1_id")
    tokens = mine_tokens(joined.select(F.col("nt").alias("native"), F.col("ns").alias("latin")))
    parts = mine_components(joined.select(F.col("at").alias("native"), F.col("as").alias("latin")))
    return tokens.unionByName(parts.join(tokens, "native", "left_anti"))


def apply_table(df: DataFrame, column: str, out: str, table: DataFrame, most: int = 500_000) -> DataFrame:
    """df with out: column's native parts and tokens by the table, other native tokens letter by letter.

    The table is one row of a map, broadcast; a table of more than `most` rows is refused, not cut.
    """
    if table.limit(most + 1).count() > most:
        raise ValueError(f"the table has more than {most} rows")
    one = table.agg(F.map_from_entries(F.collect_list(F.struct("native", "latin"))).alias("__map"))
    known = lambda x: F.try_element_at(F.col("__map"), x)
    token = lambda x: F.when(x.rlike(INDIC), F.coalesce(known(x), romanized(x))).otherwise(x)
    piece = lambda p: F.when(p.rlike(INDIC), F.coalesce(known(p), F.array_join(F.transform(native_tokens(p), token), " "))).otherwise(p)
    by_piece = lambda part: F.concat(F.lit(" "), F.array_join(F.transform(F.regexp_extract_all(part, F.lit(r"\s+|[;()\[\]]|[^\s;()\[\]]+"), F.lit(0)), piece), ""))
    whole = lambda part: let(F.trim(part), lambda p: F.when(p.rlike(INDIC), F.coalesce(F.concat(F.lit(" "), known(p)), by_piece(part))).otherwise(part))
    text = F.regexp_replace(F.col(column), ZERO_WIDTH, "")
    spelled = F.when(F.col(column).rlike(INDIC), F.array_join(F.transform(F.split(text, ","), whole), ",")).otherwise(F.col(column))
    # A generator of one row, not a projection: a Python function of the result couldn't be planned if this expression, which
    # has lambdas, were merged into its arguments.
    return df.crossJoin(F.broadcast(one)).select(*[c for c in df.columns if c != out], F.explode(F.array(spelled)).alias(out))
