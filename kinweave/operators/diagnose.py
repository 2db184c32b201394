"""Reports on scores, assignments and errors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.operators.decide import exclusive_best, per_s1, setting_sums

_THRESHOLDS = [round(0.3 + 0.05 * k, 2) for k in range(14)]


def confidence_profile(pairs: DataFrame, records: DataFrame, t: float, top: int = 6) -> DataFrame:
    """Per country of the targets: how many have a candidate and how sure the best one is; the top largest countries."""
    places = records.filter("src <> 1").select(F.col("entity_id").alias("t_id"), "country_n")
    targets = places.groupBy("country_n").agg(F.count(F.lit(1)).alias("targets"))
    share = lambda c: F.avg(c.cast("double"))
    best = exclusive_best(pairs).join(places, "t_id").groupBy("country_n").agg(
        F.count(F.lit(1)).alias("n"), F.median("p").alias("med_p"), share(F.col("p") >= t).alias("p_ge_t"), share(F.col("p") >= 0.9).alias("p_ge_09"), share((F.col("p") >= 0.2) & (F.col("p") < 0.8)).alias("grey")
    )
    return targets.join(best, "country_n", "left").withColumn("has_cand", F.col("n") / F.col("targets")).drop("n").orderBy(F.desc("targets"), "country_n").limit(top)


def assign_profile(selected: DataFrame, records: DataFrame, top: int = 6) -> DataFrame:
    """Per country of the S1 records: matches per record and share without any; the top largest countries."""
    n = selected.groupBy("s1_id").agg(F.count(F.lit(1)).alias("n"))
    rows = records.filter("src = 1").select(F.col("entity_id").alias("s1_id"), "country_n").join(n, "s1_id", "left").na.fill(0, ["n"])
    return rows.groupBy("country_n").agg(F.count(F.lit(1)).alias("s1"), F.avg("n").alias("matches_per_s1"), F.avg((F.col("n") == 0).cast("double")).alias("empty")).orderBy(F.desc("s1"), "country_n").limit(top)


def country_scores(scored: DataFrame, top: int = 6) -> DataFrame:
    """Per country: mean f, share of S1 records without a true match, share scored perfectly."""
    return scored.groupBy("country_n").agg(
        F.count(F.lit(1)).alias("s1"), F.avg("f").alias("f05"), F.avg((F.col("n_true") == 0).cast("double")).alias("singleton"), F.avg((F.col("f") >= 0.9999).cast("double")).alias("perfect")
    ).orderBy(F.desc("s1"), "country_n").limit(top)


def threshold_sweep(pairs: DataFrame, truth: DataFrame, s1: DataFrame) -> DataFrame:
    """(t, country_n, f05) for thresholds from 0.3 to 0.95, without the alpha rule."""
    grid = pairs.sparkSession.createDataFrame([(t,) for t in _THRESHOLDS], "t double")
    own = s1.select("s1_id", "country_n")
    sums = setting_sums(exclusive_best(pairs).select("s1_id", "t_id", "p"), own, truth, _THRESHOLDS).drop("alpha")
    base = own.join(truth.select("s1_id").distinct().withColumn("has", F.lit(True)), "s1_id", "left").groupBy("country_n").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("has").isNull()).alias("single"))
    rows = base.crossJoin(F.broadcast(grid)).join(sums, ["t", "country_n"], "left")
    return rows.select("t", "country_n", ((F.coalesce("f", F.lit(0.0)) + F.col("single") - F.coalesce("gone", F.lit(0))) / F.col("n")).alias("f05"))


def threshold_table(pairs: DataFrame, truth: DataFrame, s1: DataFrame, countries: list[str]) -> DataFrame:
    """threshold_sweep() with a column for each of the countries."""
    return threshold_sweep(pairs, truth, s1).groupBy("t").pivot("country_n", countries).agg(F.first("f05")).orderBy("t")


def errors(pairs: DataFrame, selected: DataFrame, truth: DataFrame) -> DataFrame:
    """(s1_id, t_id, kind): pairs missed and why, pairs wrongly selected and whose they are."""
    true = truth.select("s1_id", F.col("tgt_id").alias("t_id"))
    best = exclusive_best(pairs).select("t_id", F.col("s1_id").alias("top"))
    missed = true.join(selected.select("s1_id", "t_id"), ["s1_id", "t_id"], "left_anti").join(pairs.select("s1_id", "t_id", "p"), ["s1_id", "t_id"], "left").join(best, "t_id", "left")
    why = F.when(F.col("p").isNull(), "FN blocking miss").when(F.col("top") != F.col("s1_id"), "FN other S1 ranked higher").otherwise("FN best but p < t")
    wrong = selected.select("s1_id", "t_id").join(true, ["s1_id", "t_id"], "left_anti").join(true.select("t_id", F.col("s1_id").alias("owner")), "t_id", "left")
    whose = F.when(F.col("owner").isNull(), "FP distractor merged").otherwise("FP target of another S1")
    return missed.select("s1_id", "t_id", why.alias("kind")).unionByName(wrong.select("s1_id", "t_id", whose.alias("kind")))


def error_taxonomy(pairs: DataFrame, selected: DataFrame, truth: DataFrame, s1: DataFrame) -> DataFrame:
    """(kind, country_n, n) of errors, by country of the S1 record."""
    return errors(pairs, selected, truth).join(s1.select("s1_id", "country_n"), "s1_id").groupBy("kind", "country_n").agg(F.count(F.lit(1)).alias("n"))


def error_sample(pairs: DataFrame, selected: DataFrame, truth: DataFrame, records: DataFrame, kind: str, n: int = 12) -> DataFrame:
    """n errors of a kind with the names and addresses of both sides, the same n in every run."""
    side = lambda key, end: records.select(F.col("entity_id").alias(key), F.col("business_name").alias(f"name_{end}"), F.col("business_address").alias(f"address_{end}"))
    few = errors(pairs, selected, truth).filter(F.col("kind").startswith(kind)).orderBy(F.md5(F.concat("s1_id", "t_id"))).limit(n)
    return few.join(side("s1_id", "s"), "s1_id").join(side("t_id", "t"), "t_id")


def loss_attribution(scored: DataFrame) -> DataFrame:
    """(case, s1, points_lost): what each case of S1 record takes from the macro score."""
    case = (
        F.when(F.col("n_true") == 0, "singleton S1").when(F.col("tp") == 0, "S1 with 0 TP").when(F.col("n_pred") > F.col("tp"), "has FP").when(F.col("tp") < F.col("n_true"), "only FN").otherwise("perfect")
    )
    total = scored.agg(F.count(F.lit(1)).alias("total"))
    lost = scored.groupBy(case.alias("case")).agg(F.count(F.lit(1)).alias("s1"), F.sum(1 - F.col("f")).alias("loss"))
    return lost.crossJoin(F.broadcast(total)).select("case", "s1", (F.col("loss") / F.col("total")).alias("points_lost"))


def compare_profiles(a: DataFrame, b: DataFrame, names: tuple[str, str] = ("validation", "test")) -> DataFrame:
    """Two profiles one below the other, marked by name."""
    return a.withColumn("part", F.lit(names[0])).unionByName(b.withColumn("part", F.lit(names[1])))


__all__ = [
    "assign_profile", "compare_profiles", "confidence_profile", "country_scores", "error_sample", "error_taxonomy", "errors", "loss_attribution", "per_s1", "threshold_sweep", "threshold_table",
]
