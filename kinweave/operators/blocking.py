"""Candidate pairs by weighted rare keys: keys of seven kinds, an equi-join on them, the best few per target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions import tables
from kinweave.functions.text import let, tokens_of

KINDS = ("n", "k", "p", "na", "ha", "aa", "x")


def _long(tokens: Column, least: int) -> Column:
    return F.filter(tokens, lambda x: F.char_length(x) >= least)


def _address_words(records: DataFrame) -> Column:
    return F.filter(tokens_of(F.col("adw")), lambda w: (F.char_length(w) >= 3) & ~w.isin(tables.ADDRESS_GENERIC))


def address_word_frequencies(records: DataFrame) -> DataFrame:
    """(country_n, w, df): how many records, of all sources, have the address word."""
    words = records.select("country_n", F.explode(_address_words(records)).alias("w"))
    return words.groupBy("country_n", "w").agg(F.count(F.lit(1)).alias("df"))


def rarest_words(records: DataFrame, frequencies: DataFrame, most: int = 4) -> DataFrame:
    """(entity_id, rare): up to `most` of a record's address words, rarest in its country first, then by word."""
    words = records.select("entity_id", "country_n", F.explode(_address_words(records)).alias("w")).join(frequencies, ["country_n", "w"])
    order = Window.partitionBy("entity_id").orderBy("df", "w")
    top = words.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= most)
    return top.groupBy("entity_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "w"))), lambda x: x["w"]).alias("rare"))


def _pairs(items: Column, sep: str) -> Column:
    """x sep y for all x < y of an array."""
    return let(F.array_sort(items), lambda a: F.flatten(F.transform(a, lambda x, i: F.transform(F.slice(a, i + 2, F.size(a)), lambda y: F.concat(x, F.lit(sep), y)))))


def emit_keys(records: DataFrame, frequencies: DataFrame, rare_words: int = 4) -> DataFrame:
    """(entity_id, src, country_n, kind, key), distinct. All kinds come from one array per record and one explode.

    n: name tokens, also of alternatives; k: their sound; p: pairs of name tokens; na: name token and rare address
    word; ha: house number and rare word; aa: pairs of rare words; x: the whole name, squashed, and alternatives.
    """
    rows = records.select("entity_id", "src", "country_n", "core", "alt", "sk", "adw", "hn", "nsp").join(rarest_words(records, frequencies, rare_words), "entity_id", "left")
    names = _long(tokens_of(F.concat_ws(" ", "core", F.replace("alt", F.lit("|"), F.lit(" ")))), 2)
    rare = F.coalesce("rare", F.array().cast("array<string>"))
    alternatives = F.transform(F.split("alt", r" \| "), lambda x: F.replace(x, F.lit(" "), F.lit("")))
    rows = rows.withColumns({"names": names, "rare": rare})
    crossed = F.flatten(F.transform("names", lambda x: F.transform(F.col("rare"), lambda w: F.concat(x, F.lit("@"), w))))
    by_kind = {
        "n": F.col("names"), "k": _long(tokens_of(F.col("sk")), 3), "p": _pairs(F.col("names"), "|"), "na": crossed,
        "ha": F.when(F.col("hn") != "", F.transform("rare", lambda w: F.concat("hn", F.lit("#"), w))).otherwise(F.array().cast("array<string>")),
        "aa": _pairs(F.col("rare"), "&"), "x": _long(F.concat(F.array("nsp"), alternatives), 4),
    }

    def tag(kind: str, keys: Column) -> Column:
        return F.transform(F.array_distinct(keys), lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key")))

    tagged = F.concat(*[tag(kind, keys) for kind, keys in by_kind.items()])
    return rows.select("entity_id", "src", "country_n", F.explode(tagged).alias("x")).select("entity_id", "src", "country_n", "x.kind", "x.key")


def key_weights(s1_keys: DataFrame, s1: DataFrame, max_df: int) -> DataFrame:
    """(country_n, kind, key, w): ln(1 + S1 records of the country / those with the key), for keys of at most max_df."""
    frequency = s1_keys.groupBy("country_n", "kind", "key").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") <= max_df)
    sizes = s1.groupBy("country_n").agg(F.count(F.lit(1)).alias("n"))
    return frequency.join(sizes, "country_n").select("country_n", "kind", "key", F.ln(1 + F.col("n") / F.col("df")).alias("w"))


def _hashed(keys: DataFrame) -> DataFrame:
    """(entity_id, src, country_n, kind, h): 64 bits for each country, kind and key, which are far cheaper to shuffle and sort."""
    return keys.select("entity_id", "src", "country_n", "kind", F.xxhash64("country_n", "kind", "key").alias("h"))


def s1_index(s1_keys: DataFrame, s1: DataFrame, max_df: int = 300) -> DataFrame:
    """(h, kind, s1_id, w): the S1 records of every key that at most max_df of them have, and the key's weight in units of 1e-9.

    Whole units, so that sums, and with them scores and ranks, don't depend on the order of summation.
    """
    keys = _hashed(s1_keys)
    frequency = keys.groupBy("h").agg(F.count(F.lit(1)).alias("df"), F.first("country_n").alias("country_n")).filter(F.col("df") <= max_df)
    sizes = s1.groupBy("country_n").agg(F.count(F.lit(1)).alias("n"))
    units = (F.ln(1 + F.col("n") / F.col("df")).cast("decimal(18,9)") * 1_000_000_000).cast("long")
    weights = frequency.join(sizes, "country_n").select("h", units.alias("w"))
    return keys.join(weights, "h").select("h", "kind", F.col("entity_id").alias("s1_id"), "w")


def best_of_index(target_keys: DataFrame, index: DataFrame, top_k: int = 10) -> DataFrame:
    """The top_k S1 records of an s1_index() for each target; see candidates().

    What has met on keys is dealt by target once, for the sums by pair and for the ranks.
    """
    met = _hashed(target_keys).select(F.col("entity_id").alias("t_id"), "h").join(index, "h").repartition("t_id")
    scored = met.groupBy("t_id", "s1_id").agg((F.sum("w") / 1e9).alias("bscore"), F.count(F.lit(1)).alias("nkeys"), *[F.count_if(F.col("kind") == k).alias(f"k_{k}") for k in KINDS])
    order = Window.partitionBy("t_id").orderBy(F.desc("bscore"), "s1_id")
    return scored.withColumn("brank", F.row_number().over(order) - 1).filter(F.col("brank") < top_k)


def candidates(records: DataFrame, top_k: int = 10, max_df: int = 300, keys: DataFrame | None = None) -> DataFrame:
    """t_id, s1_id, bscore, nkeys, brank, k_<kind>: for each target the top_k S1 records by the weights of shared keys.

    The join meets at most max_df S1 records per key, so its output is bounded by targets * keys * max_df; a key that
    very many targets have is one that adaptive execution splits, as the other side of it is short. Ties go to the lesser
    S1 id. keys: as emit_keys() makes them; they are read three times.
    """
    keys = emit_keys(records, address_word_frequencies(records)) if keys is None else keys
    return best_of_index(keys.filter("src <> 1"), s1_index(keys.filter("src = 1"), records.filter("src = 1"), max_df), top_k)


def prune(cands: DataFrame, top_k: int = 10, rel_min: float = 0.25) -> DataFrame:
    """Candidates of rank below top_k whose score is at least rel_min of their target's best."""
    best = F.max("bscore").over(Window.partitionBy("t_id"))
    return cands.withColumn("best", best).filter((F.col("brank") < top_k) & (F.col("bscore") >= rel_min * F.col("best"))).drop("best")


def recall_report(cands: DataFrame, truth: DataFrame, ranks: tuple[int, ...] = (1, 2, 3, 5, 10, 20)) -> DataFrame:
    """One row: pairs, candidates per target and per S1, share of true pairs, pair recall, recall within each rank."""
    truth = truth.select(F.col("s1_id"), F.col("tgt_id").alias("t_id"), F.lit(True).alias("true"))
    n = truth.agg(F.count(F.lit(1)).alias("n_true"))
    found = cands.join(truth, ["s1_id", "t_id"], "left").agg(
        F.count(F.lit(1)).alias("pairs"), (F.count(F.lit(1)) / F.count_distinct("t_id")).alias("per_target"), (F.count(F.lit(1)) / F.count_distinct("s1_id")).alias("per_s1"),
        F.count_if("true").alias("found"), F.avg(F.coalesce("true", F.lit(False)).cast("double")).alias("positive_rate"), *[F.count_if(F.col("true") & (F.col("brank") < k)).alias(f"at{k}") for k in ranks],
    )
    return found.crossJoin(F.broadcast(n)).select("pairs", "per_target", "per_s1", "positive_rate", (F.col("found") / F.col("n_true")).alias("recall"), *[(F.col(f"at{k}") / F.col("n_true")).alias(f"recall_{k}") for k in ranks])


def prune_sweep(spark, cands: DataFrame, truth: DataFrame, ks=(3, 5, 8, 10), rels=(0.0, 0.2, 0.3, 0.4, 0.5)) -> DataFrame:
    """Pairs per target and recall for each rank limit and relative score; the grid is joined to one pass of candidates."""
    grid = spark.createDataFrame([(k, r) for k in ks for r in rels], "top_k int, rel_min double")
    truth = truth.select("s1_id", F.col("tgt_id").alias("t_id"), F.lit(1).alias("true"))
    rows = cands.withColumn("rel", F.col("bscore") / F.max("bscore").over(Window.partitionBy("t_id"))).join(truth, ["s1_id", "t_id"], "left")
    kept = rows.crossJoin(F.broadcast(grid)).filter((F.col("brank") < F.col("top_k")) & (F.col("rel") >= F.col("rel_min")))
    n = truth.agg(F.count(F.lit(1)).alias("n_true"))
    per = kept.groupBy("top_k", "rel_min").agg((F.count(F.lit(1)) / F.count_distinct("t_id")).alias("pairs_per_target"), F.count("true").alias("found"))
    return per.crossJoin(F.broadcast(n)).select("top_k", "rel_min", "pairs_per_target", (F.col("found") / F.col("n_true")).alias("recall"))


def key_ablation(cands: DataFrame, truth: DataFrame) -> DataFrame:
    """For each kind of key: share of candidates that have it, and true pairs that no other kind finds."""
    truth = truth.select("s1_id", F.col("tgt_id").alias("t_id"), F.lit(True).alias("true"))
    rows = cands.join(truth, ["s1_id", "t_id"], "left").select("nkeys", "true", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"k_{k}").alias("c")) for k in KINDS])).alias("x"))
    return rows.groupBy("x.kind").agg(F.avg((F.col("x.c") > 0).cast("double")).alias("share"), F.count_if(F.col("true") & (F.col("x.c") > 0) & (F.col("x.c") == F.col("nkeys"))).alias("only_here"))


def dev_subset(records: DataFrame, truth: DataFrame, sampled_s1: DataFrame, sampled_targets: DataFrame) -> DataFrame:
    """Sampled S1 records, all their true targets, and the sampled ones of the targets without a match."""
    mine = truth.join(sampled_s1.select(F.col("entity_id").alias("s1_id")), "s1_id", "left_semi").select(F.col("tgt_id").alias("entity_id"))
    unmatched = sampled_targets.select("entity_id").join(truth.select(F.col("tgt_id").alias("entity_id")), "entity_id", "left_anti")
    chosen = sampled_s1.select("entity_id").unionByName(mine).unionByName(unmatched).distinct()
    return records.join(chosen, "entity_id", "left_semi")
