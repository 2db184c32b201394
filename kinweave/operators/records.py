"""Normalised records: the columns that blocking and features work on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions import text as t
from kinweave.functions.fields import normalize_both


def normalize_records(raw: DataFrame, translit: DataFrame | None = None) -> DataFrame:
    """raw with the normalised name (nm, core, alt, legal, is_dom), address (ad, adw, nums, postal, hn) and what follows
    from them (sk, country_n, nsp, ntok, first, acro, is_indic). One pass over the rows: nothing is shuffled.

    translit: table of native and latin spellings (see operators.translit), applied before all else.
    """
    name, address = F.col("business_name"), F.col("business_address")
    if translit is not None:
        from kinweave.operators.translit import apply_table

        raw = apply_table(apply_table(raw, "business_name", "__name", translit), "business_address", "__address", translit)
        name, address = F.col("__name"), F.col("__address")
    made = raw.withColumn("__r", normalize_both(name, address)).select(*raw.columns, "__r.*").drop("__name", "__address")
    initials = F.array_join(F.regexp_extract_all("core", F.lit(r"\b[a-z]"), F.lit(0)), "")
    return made.withColumns(
        {
            "country_n": F.lower(F.trim("country")), "nsp": F.replace("core", F.lit(" "), F.lit("")),
            "ntok": F.regexp_count("core", F.lit(r"\S+")).cast("short"), "first": F.regexp_extract("core", r"^(\S+)", 1),
            "acro": F.when(F.char_length(initials) >= 2, initials).otherwise(""), "is_indic": F.col("business_name").rlike(t.INDIC).cast("byte"),
        }
    )


def country_codes(records: DataFrame) -> DataFrame:
    """(country_n, cc): rank of each country among the distinct ones."""
    from pyspark.sql import Window

    return records.select("country_n").distinct().withColumn("cc", (F.dense_rank().over(Window.orderBy("country_n")) - 1).cast("short"))


def fold_of(id_col: str, folds: int = 5, seed: str = ""):
    """Fold of an identifier: the first 8 hex digits of its MD5, modulo folds."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col(id_col))), 1, 8), 16, 10).cast("long") % folds


def hash_sample(df: DataFrame, id_col: str, per_mille: int, seed: str = "") -> DataFrame:
    """The rows whose identifier hashes below per_mille of 1000: the same ones in every run."""
    return df.filter(fold_of(id_col, 1000, seed) < per_mille)
