"""The chain in five stages, each of which reads what the ones before have written to a work folder.

    <split>_records, <split>_candidates, <split>_features: Parquet; translit: Parquet; model, decider: see linkage.train()
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.operators import blocking, decide, diagnose, translit
from kinweave.operators.records import fold_of, normalize_records
from kinweave.plans import linkage
from kinweave.sources import tsv


def _read(spark: SparkSession, work: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{work}/{name}")


def fit_translit(spark: SparkSession, data: str, work: str, report_fold: int = 0) -> DataFrame:
    """Spellings learned from the true pairs of all folds but the one that is reported on."""
    raw = tsv.load_sources(spark, data, "train")
    allowed = raw.filter("src = 1").filter(fold_of("entity_id") != report_fold).select(F.col("entity_id").alias("s1_id"))
    translit.fit_table(raw, tsv.load_ground_truth(spark, data, "train"), allowed).write.mode("overwrite").parquet(f"{work}/translit")
    return _read(spark, work, "translit")


def prepare(spark: SparkSession, data: str, work: str, splits: tuple[str, ...] = ("train", "test")) -> None:
    """Normalised records of each split, by the spellings learned from the training split."""
    table = fit_translit(spark, data, work)
    for split in splits:
        normalize_records(tsv.load_sources(spark, data, split), table).write.mode("overwrite").parquet(f"{work}/{split}_records")


def block(spark: SparkSession, data: str, work: str, split: str = "train", top_k: int = 10, max_df: int = 300) -> DataFrame | None:
    """Candidates, and for the training split a report on how many true pairs are among them."""
    records = _read(spark, work, f"{split}_records")
    keys = blocking.emit_keys(records, blocking.address_word_frequencies(records)).persist()
    blocking.candidates(records, top_k, max_df, keys).write.mode("overwrite").parquet(f"{work}/{split}_candidates")
    keys.unpersist()
    linkage.store_features(linkage.featured(records, blocking.prune(_read(spark, work, f"{split}_candidates"), top_k)), f"{work}/{split}_features")
    return blocking.recall_report(_read(spark, work, f"{split}_candidates"), tsv.load_ground_truth(spark, data, split)) if split == "train" else None


def train(spark: SparkSession, data: str, work: str, share: float = 0.25, rounds: int = 40, **options) -> float:
    """Model and decision from the stored features of the training split; the macro score of the reported fold."""
    truth, pairs = tsv.load_ground_truth(spark, data, "train"), linkage.load_features(spark, f"{work}/train_features")
    return linkage.train(_read(spark, work, "train_records"), truth, work, pairs=pairs, target_share=share, rounds=rounds, **options)


def predict(spark: SparkSession, work: str, out: str, split: str = "test") -> DataFrame:
    """The two list files of a split, and their validation."""
    records = _read(spark, work, f"{split}_records")
    matches, scored = linkage.predict(records, work, pairs=linkage.load_features(spark, f"{work}/{split}_features"))
    linkage.write_lists(records, matches, scored, out)
    read = lambda name: tsv.read_tsv(spark, f"{out}/{name}.tsv")
    return tsv.validate_outputs(records.filter("src = 1").select("entity_id"), read("matching_results"), read("candidate_pairs"))


def report(spark: SparkSession, data: str, work: str, fold: int = 0) -> dict[str, DataFrame]:
    """Tables on the reported fold: scores, sweep, errors, losses; and how sure the model is there and on the test split."""
    records, truth = _read(spark, work, "train_records"), tsv.load_ground_truth(spark, data, "train")
    meta = linkage.saved_decision(spark, work)
    matches, scored = linkage.predict(records, work, pairs=linkage.load_features(spark, f"{work}/train_features"))
    s1 = records.filter("src = 1").select(F.col("entity_id").alias("s1_id"), "country_n").filter(fold_of("s1_id") == fold)
    own = lambda df: df.join(s1.select("s1_id"), "s1_id", "left_semi")
    true, chosen = own(truth), own(matches)
    per_s1 = decide.per_s1(chosen, true, s1)
    out = {
        "country_scores": diagnose.country_scores(per_s1), "threshold_sweep": diagnose.threshold_sweep(own(scored), true, s1), "error_taxonomy": diagnose.error_taxonomy(scored, chosen, true, s1),
        "loss_attribution": diagnose.loss_attribution(per_s1), "false_positives": diagnose.error_sample(scored, chosen, true, records, "FP"), "false_negatives": diagnose.error_sample(scored, chosen, true, records, "FN"),
        "importances": spark.createDataFrame(meta["importances"], "feature string, weight double"),
    }
    test = _read(spark, work, "test_records")
    _, unseen = linkage.predict(test, work, pairs=linkage.load_features(spark, f"{work}/test_features"))
    profile = lambda pairs, rows: diagnose.confidence_profile(pairs, rows, meta["t"])
    out["confidence"] = diagnose.compare_profiles(profile(scored, records), profile(unseen, test))
    return out
