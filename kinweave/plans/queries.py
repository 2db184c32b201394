"""One query per operator, over the records derived from the star-schema tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions import kernels
from kinweave.functions.fields import normalize_address, normalize_name, skeletons
from kinweave.functions.text import sorted_tokens
from kinweave.operators import blocking, decide, diagnose, features, matcher, translit
from kinweave.operators.records import country_codes, fold_of, hash_sample, normalize_records
from kinweave.plans import linkage
from kinweave.sources import fixtures, tsv

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_T = 0.3
#: What the SQL of oracle.py has; the operators' default is 300.
_MAX_DF = 30


#: What the last query persisted; the next one lets go of it.
_HELD: list[DataFrame] = []


def _query(f: Query) -> Query:
    def fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
        while _HELD:
            _HELD.pop().unpersist()
        return f(spark, sf_dir)

    _QUERIES[f.__name__] = fresh
    return f


def _held(df: DataFrame) -> DataFrame:
    """df persisted until another query begins: what reads it more than once computes it once."""
    _HELD.append(df.persist())
    return df


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised once: everything after reads the persisted records."""
    return _held(normalize_records(fixtures.all_records(spark, sf_dir)))


def _cands(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    records = _records(spark, sf_dir)
    keys = _held(blocking.emit_keys(records, blocking.address_word_frequencies(records)))
    return records, _held(blocking.candidates(records, max_df=_MAX_DF, keys=keys))


def _scored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """records, scored pairs, truth."""
    records, cands = _cands(spark, sf_dir)
    return records, linkage.scored_by_blocking(blocking.prune(cands)), fixtures.truth_pairs(spark, sf_dir)


def _s1(records: DataFrame) -> DataFrame:
    return records.filter("src = 1").select(F.col("entity_id").alias("s1_id"), "country_n")


def _pairs(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Pruned candidates with columns of both sides."""
    records, cands = _cands(spark, sf_dir)
    side = lambda key, end: records.select(F.col("entity_id").alias(key), *[F.col(c).alias(f"{c}_{end}") for c in columns])
    return blocking.prune(cands).join(side("t_id", "t"), "t_id").join(side("s1_id", "s"), "s1_id")


def _of(spark: SparkSession, sf_dir: str, columns: str, **made: Column) -> DataFrame:
    return _rounded(_pairs(spark, sf_dir, *columns.split()).select("t_id", "s1_id", *[c.alias(k) for k, c in made.items()]))


# ---- sources and normalisation
@_query
def tsv_truth_explode(spark, sf_dir):
    lists = fixtures.truth_pairs(spark, sf_dir).groupBy("s1_id").agg(F.array_join(F.collect_list("tgt_id"), ", ").alias("l"))
    return tsv.explode_truth(lists, "s1_id", "l")


@_query
def norm_name(spark, sf_dir):
    return fixtures.all_records(spark, sf_dir).select("entity_id", normalize_name(F.col("business_name")).alias("n")).select("entity_id", "n.*")


@_query
def norm_legal_category(spark, sf_dir):
    return norm_name(spark, sf_dir).groupBy("legal").agg(F.count(F.lit(1)).alias("n"))


@_query
def norm_address(spark, sf_dir):
    return fixtures.all_records(spark, sf_dir).select("entity_id", normalize_address(F.col("business_address")).alias("a")).select("entity_id", "a.*")


@_query
def norm_skeleton(spark, sf_dir):
    return norm_name(spark, sf_dir).select("entity_id", skeletons(F.col("core")).alias("sk"))


@_query
def norm_record_columns(spark, sf_dir):
    return _records(spark, sf_dir).select("entity_id", "country_n", "nsp", "ntok", "first", "acro", "is_indic")


@_query
def norm_literals(spark, sf_dir):
    names = ["capita1", "lnc", "Acme Software software Pvt. Ltd.", "X trading as Y Z", "soclaronflex.com", "#whestate", "Café & Crème", "The Krishna Corp"]
    return spark.createDataFrame([(x,) for x in names], "name string").select("name", normalize_name(F.col("name")).alias("n")).select("name", "n.nm", "n.core", "n.legal")


@_query
def address_literals(spark, sf_dir):
    texts = ["012 Main Street", "Block 4, MG Road 560 001", "77 Elm Ave, New York 12345-6789", "2nd Floor 12B Rue X", ""]
    return spark.createDataFrame([(x,) for x in texts], "address string").select("address", normalize_address(F.col("address")).alias("a")).select("address", "a.ad", "a.nums", "a.postal", "a.hn")


@_query
def translit_token_mining(spark, sf_dir):
    pairs = [("राम सेवा", "Ram Seva"), ("राम ट्रेडर्स", "Ram Traders"), ("जय सेवा", "Jay Seva"), ("Shop", "Shop")]
    return translit.mine_tokens(spark.createDataFrame(pairs, "native string, latin string"))


def _spelled(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Records in two scripts, and the spellings that their true pairs teach."""
    rows = [("s1", "Ram Seva", "12 Main Road, Pune", 1), ("s2", "Jay Seva", "4 Hill Road, Pune", 1), ("s3", "Ram Traders", "5 Hill Road, Pune", 1), ("t1", "राम सेवा", "12 Main Road, पुणे", 2), ("t2", "जय सेवा", "4 Hill Road, पुणे", 2), ("t3", "राम ट्रेडर्स", "5 Hill Road, पुणे", 2)]
    records = spark.createDataFrame(rows, "entity_id string, business_name string, business_address string, src int")
    return records, translit.fit_table(records, spark.createDataFrame([("s1", "t1"), ("s2", "t2"), ("s3", "t3")], "s1_id string, tgt_id string"))


@_query
def translit_fit(spark, sf_dir):
    return _spelled(spark)[1]


@_query
def translit_convert(spark, sf_dir):
    texts = spark.createDataFrame([(x,) for x in ("राम सेवा (राम)", "सेवा जय, पुणे", "Shop राम", "Shop", "नमन")], "text string")
    return translit.apply_table(texts, "text", "latin", _spelled(spark)[1])


@_query
def country_code(spark, sf_dir):
    return country_codes(fixtures.all_records(spark, sf_dir).select(F.lower(F.trim("country")).alias("country_n")))


@_query
def fold_assign(spark, sf_dir):
    return fixtures.s1_records(spark, sf_dir).select("entity_id", fold_of("entity_id").alias("fold"))


@_query
def hash_sampled(spark, sf_dir):
    return hash_sample(fixtures.all_records(spark, sf_dir), "entity_id", 250, "5:").select("entity_id")


# ---- blocking
@_query
def addr_word_df(spark, sf_dir):
    return blocking.address_word_frequencies(_records(spark, sf_dir))


@_query
def rare_words_top4(spark, sf_dir):
    records = _records(spark, sf_dir)
    return blocking.rarest_words(records, blocking.address_word_frequencies(records)).select("entity_id", F.array_join("rare", " ").alias("rare"))


def _s1_keys(spark, sf_dir):
    records = _records(spark, sf_dir)
    s1 = records.filter("src = 1")
    return s1, blocking.emit_keys(records, blocking.address_word_frequencies(records)).filter("src = 1").drop("src")


@_query
def keys_by_kind(spark, sf_dir):
    return _s1_keys(spark, sf_dir)[1].groupBy("country_n", "kind", "key").agg(F.count(F.lit(1)).alias("df"))


@_query
def key_idf(spark, sf_dir):
    s1, keys = _s1_keys(spark, sf_dir)
    return _rounded(blocking.key_weights(keys, s1, _MAX_DF))


@_query
def candidates_topk(spark, sf_dir):
    return _rounded(_cands(spark, sf_dir)[1])


@_query
def candidates_pruned(spark, sf_dir):
    return _rounded(blocking.prune(_cands(spark, sf_dir)[1]).select("t_id", "s1_id", "bscore", "brank"))


@_query
def blocking_recall(spark, sf_dir):
    return _rounded(blocking.recall_report(_cands(spark, sf_dir)[1], fixtures.truth_pairs(spark, sf_dir)))


@_query
def prune_sweep(spark, sf_dir):
    return _rounded(blocking.prune_sweep(spark, _cands(spark, sf_dir)[1], fixtures.truth_pairs(spark, sf_dir)))


@_query
def key_ablation(spark, sf_dir):
    return _rounded(blocking.key_ablation(_cands(spark, sf_dir)[1], fixtures.truth_pairs(spark, sf_dir)))


@_query
def dev_subset(spark, sf_dir):
    every = fixtures.all_records(spark, sf_dir)
    sampled = hash_sample(every, "entity_id", 100)
    return blocking.dev_subset(every, fixtures.truth_pairs(spark, sf_dir), sampled.filter("src = 1"), sampled.filter("src <> 1")).select("entity_id", "src")


# ---- features
@_query
def freq_features(spark, sf_dir):
    return features.add_frequencies(_records(spark, sf_dir)).select("entity_id", *features.FREQUENCIES)


@_query
def token_idf(spark, sf_dir):
    return _rounded(features.token_idf(_records(spark, sf_dir), "core"))


def _overlapped(spark, sf_dir):
    records, cands = _cands(spark, sf_dir)
    side = features.weighted_tokens(records, "core", "tok")
    named = lambda key, end: side.select(F.col("entity_id").alias(key), F.col("tok").alias(f"tok_{end}"))
    return blocking.prune(cands).join(named("t_id", "t"), "t_id").join(named("s1_id", "s"), "s1_id").withColumns(features.idf_overlap("tok_t", "tok_s", "n"))


@_query
def idf_overlap(spark, sf_dir):
    rows = _overlapped(spark, sf_dir)
    return _rounded(rows.select("t_id", "s1_id", *features.idf_overlap("tok_t", "tok_s", "n")))


@_query
def number_agreement(spark, sf_dir):
    c = F.col
    return _of(spark, sf_dir, "nums hn", **features.number_agreement(c("nums_t"), c("nums_s"), c("hn_t"), c("hn_s")))


@_query
def tri_state(spark, sf_dir):
    c = F.col
    return _of(spark, sf_dir, "legal postal hn", n_legal_eq=features.tri_state(c("legal_t"), c("legal_s")), a_postal_eq=features.tri_state(c("postal_t"), c("postal_s")), a_hn_eq=features.tri_state(c("hn_t"), c("hn_s")))


@_query
def domain_cover(spark, sf_dir):
    c = F.col
    return _of(spark, sf_dir, "nsp core", cover=features.domain_cover(F.lit(True), c("nsp_t"), c("core_s"), c("nsp_s"), c("core_t")))


@_query
def acronym_match(spark, sf_dir):
    c = F.col
    return _of(spark, sf_dir, "acro nsp", n_acro=features.acronym_match(c("acro_t"), c("nsp_t"), c("acro_s"), c("nsp_s")))


@_query
def lev_distance(spark, sf_dir):
    return _of(spark, sf_dir, "core", n_lev=F.levenshtein("core_t", "core_s"))


@_query
def token_sort_keys(spark, sf_dir):
    return _records(spark, sf_dir).select("entity_id", sorted_tokens(F.col("core")).alias("core_srt"), sorted_tokens(F.col("adw")).alias("adw_srt"))


@_query
def jaro_winkler(spark, sf_dir):
    return _of(spark, sf_dir, "core", n_jw=kernels.jaro_winkler_udf("core_t", "core_s"))


@_query
def indel_ratio(spark, sf_dir):
    return _of(spark, sf_dir, "core", n_ratio=kernels.indel_ratio_udf("core_t", "core_s"))


@_query
def token_set_ratio(spark, sf_dir):
    return _of(spark, sf_dir, "core", n_tset=kernels.token_set_ratio_udf("core_t", "core_s"))


@_query
def partial_ratio(spark, sf_dir):
    return _of(spark, sf_dir, "nsp", partial=kernels.partial_ratio_udf("nsp_t", "nsp_s"))


@_query
def pair_features(spark, sf_dir):
    records, cands = _cands(spark, sf_dir)
    return _rounded(features.pair_features(blocking.prune(cands), records))


@_query
def pair_features_plain(spark, sf_dir):
    """The pair features that SQL has functions for; with indel_ratio, token_set_ratio and partial_ratio, all kinds there are."""
    records, cands = _cands(spark, sf_dir)
    names = "n_lev n_jw n_first_jw n_has_alt n_legal_eq n_acro n_dom n_dom_cover n_indic n_len_t n_len_s n_ntok_t n_ntok_s a_empty a_len_t a_len_s a_postal_eq a_hn_eq a_num_jac a_num_inter a_num_conf a_hn_prefix is_s3".split()
    names += [f"{p}_{x}" for p in "nka" for x in "idf_jac idf_min idf_t idf_s idf_shared idf_unsh_t idf_unsh_s idf_maxtok_shared idf_maxtok_miss nshared".split()]
    names += [f"{c}_{e}" for c in features.FREQUENCIES for e in "ts"]
    return _rounded(features.pair_features(blocking.prune(cands), records).select("t_id", "s1_id", *names))


def _context(spark, sf_dir, group):
    columns = ("bscore", "n_idf_jac", "nkeys")
    rows = _overlapped(spark, sf_dir).select("t_id", "s1_id", "bscore", F.round("n_idf_jac", 9).alias("n_idf_jac"), "nkeys")
    return _rounded(features.add_context(rows, group, columns).drop(*columns))


@_query
def context_target(spark, sf_dir):
    return _context(spark, sf_dir, "t_id")


@_query
def context_s1(spark, sf_dir):
    return _context(spark, sf_dir, "s1_id")


# ---- decisions and reports
@_query
def decide_exclusive(spark, sf_dir):
    return _rounded(decide.Decider(_T).select(_scored(spark, sf_dir)[1]))


@_query
def decide_alpha(spark, sf_dir):
    return _rounded(decide.Decider(_T, 0.8).select(_scored(spark, sf_dir)[1]).select("t_id", "s1_id", "p"))


def _per_s1(spark, sf_dir):
    records, scored, truth = _scored(spark, sf_dir)
    return decide.per_s1(decide.Decider(_T).select(scored), truth, _s1(records))


@_query
def macro_f05(spark, sf_dir):
    return _rounded(_per_s1(spark, sf_dir).agg(F.avg("f").alias("macro_f")))


@_query
def tune_grid(spark, sf_dir):
    records, scored, truth = _scored(spark, sf_dir)
    return _rounded(decide.tune_grid(scored, truth, _s1(records)))


@_query
def matcher_scores(spark, sf_dir):
    """A reduced demonstration of the matcher: few features, 5 rounds, depth 4; linkage.train has the whole chain."""
    records, cands = _cands(spark, sf_dir)
    pairs = _overlapped(spark, sf_dir).drop("tok_t", "tok_s")
    labelled = matcher.label(features.add_context(pairs, "t_id", ("bscore", "n_idf_jac")), fixtures.truth_pairs(spark, sf_dir))
    model = matcher.train(labelled.filter("fold > 1"), rounds=5, target_share=0.5, early_stop=False, depth=4)
    return _rounded(matcher.score(model, labelled))


@_query
def confidence_profile(spark, sf_dir):
    records, scored, _ = _scored(spark, sf_dir)
    return _rounded(diagnose.confidence_profile(scored, records, _T))


@_query
def assign_profile(spark, sf_dir):
    records, scored, _ = _scored(spark, sf_dir)
    return _rounded(diagnose.assign_profile(decide.Decider(_T).select(scored), records))


@_query
def country_scores(spark, sf_dir):
    return _rounded(diagnose.country_scores(_per_s1(spark, sf_dir)))


@_query
def threshold_sweep(spark, sf_dir):
    records, scored, truth = _scored(spark, sf_dir)
    return _rounded(diagnose.threshold_sweep(scored, truth, _s1(records)))


@_query
def error_taxonomy(spark, sf_dir):
    records, scored, truth = _scored(spark, sf_dir)
    return diagnose.error_taxonomy(scored, decide.Decider(_T).select(scored), truth, _s1(records))


@_query
def loss_attribution(spark, sf_dir):
    return _rounded(diagnose.loss_attribution(_per_s1(spark, sf_dir)))


# ---- outputs
def _lists(spark, sf_dir):
    records, scored, _ = _scored(spark, sf_dir)
    renamed = lambda df: df.select("s1_id", F.col("t_id").alias("tgt_id"), "p")
    s1 = records.filter("src = 1").select("entity_id")
    return s1, tsv.id_lists(s1, renamed(decide.Decider(_T).select(scored)), "matched_entity_ids"), tsv.id_lists(s1, renamed(scored), "candidate_entity_ids")


@_query
def match_lists(spark, sf_dir):
    return _lists(spark, sf_dir)[1]


@_query
def candidate_lists(spark, sf_dir):
    return _lists(spark, sf_dir)[2]


@_query
def output_validation(spark, sf_dir):
    return tsv.validate_outputs(*_lists(spark, sf_dir))


@_query
def near_duplicate_documents(spark, sf_dir):
    """A demonstration of the blocking chain with lines of documents as keys: each odd document's best even one.

    It doesn't find all near duplicates (op8_near_dedup does): documents meet only those of the other parity and the
    same lang, none without a lang, and lines of more than _MAX_DF even documents are no keys.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select(F.concat(F.lit("D"), F.col("doc_id")).alias("entity_id"), F.col("lang").alias("country_n"), F.when(F.col("doc_id") % 2 == 0, 1).otherwise(2).alias("src"), "text")
    lines = F.array_distinct(F.filter(F.transform(F.split(F.lower("text"), "\n"), lambda x: F.trim(x)), lambda x: F.char_length(x) >= 20))
    keys = rows.select("entity_id", "src", "country_n", F.lit("n").alias("kind"), F.explode(lines).alias("key"))
    return _rounded(blocking.candidates(rows.drop("text"), max_df=_MAX_DF, keys=keys).filter("brank = 0").select("t_id", "s1_id", "bscore", "nkeys"))


_QUERIES["hash_sample"] = _QUERIES.pop("hash_sampled")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)
