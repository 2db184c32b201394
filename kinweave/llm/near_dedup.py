"""MinHash near-duplicates by tensored banding, with exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import bounded_batches, cut, discard, salted_lookup, small_enough, text_or_empty, worker_cache
from kinweave.llm.graph import connected_components
from kinweave.llm.shingles import WordHasher, mix, row_words, shingle_set, text_pieces


def _hasher() -> WordHasher:
    cache = worker_cache("near_dedup")
    if not hasattr(cache, "hasher"):
        cache.hasher = WordHasher()
    return cache.hasher


def _sets(column: pa.Array, size: int) -> Iterator[list[np.ndarray]]:
    for first, end, data, offsets in text_pieces(column):
        words, at, _ = row_words(_hasher(), data, offsets)
        yield [shingle_set(words[at[k] : at[k + 1]], size) for k in range(end - first)]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _class_id(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size of each set and two independent 64-bit hashes of its members."""
    n = np.array([len(s) for s in sets], np.int64)
    first = np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64)
    second = np.array([mix(s ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64) for s in sets], np.uint64)
    return n, mix(first ^ n.astype(np.uint64)), mix(second)


def _sketches(docs: DataFrame, size: int, collection: int, depth: int) -> DataFrame:
    """doc_id, n (set size), cid and check (hashes of the set) and two collections of combined minhashes."""
    count = 2 * collection * depth
    rng = np.random.default_rng(8)
    odd = rng.integers(0, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    flip = rng.integers(0, 2**63, count, dtype=np.uint64)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = 0
            for sets in _sets(batch.column(1), size):
                n, cid, check = _class_id(sets)
                halves = np.zeros((2, len(sets), collection), np.uint64)
                full = np.flatnonzero(n)
                if len(full):
                    members = np.concatenate([sets[k] for k in full])
                    starts = np.concatenate([[0], np.cumsum(n[full])[:-1]])
                    for k in range(count):
                        half, rest = divmod(k, collection * depth)
                        low = np.minimum.reduceat((members ^ flip[k]) * odd[k], starts)
                        halves[half, full, rest // depth] = mix(halves[half, full, rest // depth] * np.uint64(31) + low)
                lists = [pa.ListArray.from_arrays(np.arange(0, len(sets) * collection + 1, collection, dtype=np.int32), _signed(h.ravel())) for h in halves]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(sets)), batch.column(2).slice(row, len(sets)), pa.array(n), _signed(cid), _signed(check), *lists], ["doc_id", "text_hash", "n", "cid", "check", "us", "vs"])
                row += len(sets)

    return docs.mapInArrow(sketch, f"doc_id {dict(docs.dtypes)['doc_id']}, text_hash long, n long, cid long, check long, us array<long>, vs array<long>")


def _class_sets(docs: DataFrame, size: int) -> DataFrame:
    """cid, check and the sorted set of each document."""

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sets in _sets(batch.column(0), size):
                n, cid, check = _class_id(sets)
                offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                members = pa.ListArray.from_arrays(offsets, _signed(np.concatenate([*sets, np.zeros(0, np.uint64)])))
                yield pa.RecordBatch.from_arrays([_signed(cid), _signed(check), members], ["cid", "check", "members"])

    return docs.select("text").mapInArrow(sets_of, "cid long, check long, members array<long>")


def _clashes(rows: DataFrame) -> DataFrame | None:
    """The cid that more than one check has, if any: sets that agree in one 64-bit hash alone aren't equal."""
    found = rows.filter("n > 0").groupBy("cid").agg(F.min("check").alias("low"), F.max("check").alias("high")).filter("low <> high").select("cid", F.lit(True).alias("clashes"))
    found = cut(found, "clashes")
    return None if found.isEmpty() else found


def _apart(rows: DataFrame, clash: DataFrame | None) -> DataFrame:
    """rows with a cid of its own for each pair of cid and check."""
    if clash is None:
        return rows
    return salted_lookup(rows, clash, "cid", F.col("check")).withColumn("cid", F.when(F.col("clashes"), F.xxhash64("cid", "check")).otherwise(F.col("cid"))).drop("clashes")


def _cross_links(placed: DataFrame, sets: DataFrame, links: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between different components of classes that share a bucket; all of them, up to connectivity.

    Every bucket's classes belong to the home of its largest component, and a home has a centre: the class of that
    component with most links. With D(a) the symmetric difference of a's set and the centre's, a and b differ in
    |D(a)| + |D(b)| - 2 |D(a) & D(b)| members, so they are linked exactly if

        2 |D(a) & D(b)| >= s(a) + s(b),  s(a) = |D(a)| - n(a) (1 - share) / (1 + share).

    The centre has the least s. A class with s(a) + s(centre) <= 0 is linked with the centre, so of two such classes
    nothing more has to be known; any other pair must have common members in its differences, and how many at least
    follows from s and the sizes. A prefix filter (the rarest members of each difference, as many as a linked pair
    can't all miss) therefore finds every linked pair, while texts that only resemble each other through what all of
    the home has don't meet: their differences are what is rare there.
    """
    up, down = 100 + percent, 100 - percent
    parts = placed.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
    main = parts.groupBy("key").agg(F.max(F.struct("c", "label")).alias("top"), F.count(F.lit(1)).alias("labels"), F.sum("c").alias("c"))
    # A bucket of two has been decided by its star.
    main = main.filter("labels > 1 AND c > 2").select("key", F.col("top.label").alias("home"))
    near = cut(placed.join(main, "key").select("home", "cid", "label", "n").distinct(), "near")
    discard(placed)

    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("d"))
    centres = degree.join(labels, "node").groupBy("label").agg(F.max(F.struct("d", "node")).alias("top")).select(F.col("label").alias("home"), F.col("top.node").alias("centre"))
    centres = near.select("home").distinct().join(centres, "home", "left").select("home", F.coalesce("centre", "home").alias("centre"))
    centres = cut(centres.join(sets.select(F.col("cid").alias("centre"), F.col("members").alias("middle")), "centre"), "centres")
    rows = salted_lookup(near.join(sets.select("cid", "members"), "cid"), centres, "home", F.col("cid"), "inner", cells=F.size("middle"))
    difference = F.concat(F.array_except("members", "middle"), F.array_except("middle", "members"))
    rows = rows.select("home", "cid", "label", "n", "centre", F.size("middle").cast("long").alias("m"), difference.alias("d")).withColumn("s", F.size("d") * up - F.col("n") * down)
    rows = differences = cut(rows.withColumn("inner", F.col("s") <= F.col("m") * down), "differences")
    discard(near, centres)
    to_centre = rows.filter(F.col("inner") & (F.col("label") != F.col("home"))).select(F.least("cid", "centre").alias("a"), F.greatest("cid", "centre").alias("b"))

    # Only what differences of two components have can be common to a pair that matters.
    members = rows.select("home", "cid", "label", F.explode("d").alias("x"))
    common = members.groupBy("home", "x").agg(F.count(F.lit(1)).alias("f"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("home", "x", "f")
    kept = members.join(common, ["home", "x"]).groupBy("home", "cid").agg(F.array_sort(F.collect_list(F.struct("f", "x"))).alias("e"))
    # Of two linked classes at most one is inner, so the other's s is above that limit.
    by_size = F.ceil(F.size("d") - F.col("n") * (down / percent) - 1e-6)
    by_other = F.ceil((F.col("s") + F.col("m") * down + 1) / (2 * up) - 1e-9)
    rows = (
        rows.withColumn("wide", F.greatest(F.lit(1), by_size)).withColumn("narrow", F.greatest("wide", by_other)).drop("d", "m", "centre")
        .join(kept, ["home", "cid"])
        .withColumns({c: F.size("e") + 1 - F.col(c) for c in ("wide", "narrow")}).filter("narrow > 0 OR wide > 0 AND NOT inner")
    )
    rows = cut(rows.withColumn("e", F.transform("e", lambda x: x["x"])), "prefixes")
    reach = F.when(F.col("inner"), F.col("narrow")).otherwise(F.col("wide"))
    flat = rows.select("home", "cid", "label", "n", "s", "inner", "wide", "narrow", F.size("e").alias("k"), F.posexplode(F.slice("e", F.lit(1), reach.cast("int"))).alias("at", "x"))
    other = flat.filter("NOT inner").select("home", "x", *[F.col(c).alias(f"{c}2") for c in ("cid", "label", "n", "s", "wide", "narrow", "k", "at")])
    met = flat.join(other, ["home", "x"]).filter(
        (F.col("label") != F.col("label2"))
        & (F.col("at") < F.col("narrow"))
        & F.when(F.col("inner"), F.col("at2") < F.col("wide2")).otherwise((F.col("at2") < F.col("narrow2")) & (F.col("cid") < F.col("cid2")))
        & (F.least("n", "n2") * 100 >= F.greatest("n", "n2") * percent)
        # From the first common member on, no more than the shorter rest can be common.
        & (F.least(F.col("k") - F.col("at"), F.col("k2") - F.col("at2")) * (2 * up) >= F.col("s") + F.col("s2"))
    )
    pairs = met.select("home", "cid", "cid2").distinct()
    left, right = rows.select("home", "cid", "s", "e"), rows.select("home", F.col("cid").alias("cid2"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    linked = pairs.join(left, ["home", "cid"]).join(right, ["home", "cid2"]).filter(F.size(F.array_intersect("e", "e2")) * (2 * up) >= F.col("s") + F.col("s2"))
    found = cut(to_centre.unionByName(linked.select(F.least("cid", "cid2").alias("a"), F.greatest("cid", "cid2").alias("b"))).distinct(), "cross-links")
    discard(differences, rows)
    return found


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, collection: int = 9, depth: int = 2
) -> DataFrame:
    """Connected components of documents whose shingle sets have a Jaccard similarity of percent / 100 or more.

    Tensored banding: two collections of `collection` minhash tuples, `depth` minhashes each; every pair of tuples, one
    of each collection, is a table key, so collection**2 tables of 2 * depth minhashes cost 2 * collection * depth
    minhashes (81 tables from 36 with the defaults, which miss a pair at 0.8 with probability 2e-4, and one at 0.85
    with 2e-5).

    Documents with equal sets are one class, represented once. Classes that share a key with another are checked on
    full sets. A member that no other set contains can't be in an intersection, so a class with too many of those has
    no link and leaves (exact). Then each bucket's members are compared with one hub of the bucket (a star); links
    between the connected components that this leaves within a bucket are found by _cross_links(), exactly. So a
    bucket of linked near copies costs its size, not its square, and so do texts that resemble each other through
    what most of their bucket shares without being linked.

    Words are maximal runs of characters other than ASCII white space, A-Z lower-cased. With fewer words than a
    shingle the whole sequence is one shingle. Returns per input row doc_id, text_hash (xxhash64), n_shingles, class_id, n_class (documents
    in the class), component_id (smallest doc_id reachable), kept (doc_id = component_id). Null, empty and blank texts
    have no shingle: n_shingles 0, their own doc_id as component. Null identifiers are never smallest unless alone.
    Repeated rows are all marked kept if one is. An empty table gives an empty result; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    sketches = cut(_sketches(texts.select("doc_id", "text", "text_hash"), shingle, collection, depth), "sketches")
    clash = _clashes(sketches)
    rows = _apart(sketches, clash)
    classes = rows.filter("n > 0").groupBy("cid").agg(
        F.first("n").alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("r"), F.count(F.lit(1)).alias("n_class"), F.first("us").alias("us"), F.first("vs").alias("vs")
    )
    hashed = cut(classes.select("cid", "n", F.col("r.doc_id").alias("rep"), "r.text_hash", "n_class", "us", "vs"), "hashed")
    # Minhashes are most of what has been written; from here on each table goes when the last that reads it is written.
    rows = cut(rows.select("doc_id", "text_hash", "n", "cid"), "rows")
    discard(sketches)
    keys = hashed.select("cid", F.explode(F.flatten(F.transform("us", lambda u, i: F.transform(F.col("vs"), lambda v, j: F.xxhash64(u, v, i, j))))).alias("key"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("in_bucket")).filter("in_bucket > 1").select("key")
    buckets = shared_buckets = cut(keys.join(shared, "key"), "buckets")
    classes = cut(hashed.drop("n", "us", "vs"), "classes")
    discard(hashed)

    # One text of each class that shares a bucket: by identifier, and of those without one by the hash of the text.
    wanted = cut(buckets.select("cid").distinct().join(classes.select("cid", F.col("rep").alias("doc_id"), "text_hash"), "cid"), "wanted")
    known = wanted.filter("doc_id IS NOT NULL").select("doc_id", "text_hash").distinct()
    nameless = wanted.filter("doc_id IS NULL").select("text_hash").distinct()
    chosen = texts.filter("doc_id IS NOT NULL").join(F.broadcast(known) if small_enough(known) else known, ["doc_id", "text_hash"], "left_semi").select("text")
    if not nameless.isEmpty():
        more = texts.filter("doc_id IS NULL").join(F.broadcast(nameless) if small_enough(nameless) else nameless, "text_hash", "left_semi")
        chosen = chosen.unionByName(more.dropDuplicates(["text_hash"]).select("text"))
    sets = _apart(_class_sets(chosen, shingle), clash)
    sets = cut(sets.join(wanted.select("cid"), "cid", "left_semi").select("cid", "members").dropDuplicates(["cid"]), "sets")
    discard(wanted)
    lone = sets.select("cid", F.explode("members").alias("m")).groupBy("m").agg(F.count(F.lit(1)).alias("c"), F.first("cid").alias("cid")).filter("c = 1").groupBy("cid").agg(F.count(F.lit(1)).alias("alone"))
    able = cut(
        sets.select("cid", F.size("members").cast("long").alias("n")).join(lone, "cid", "left")
        .select("cid", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("common"))
        .filter(F.col("common") * 100 >= F.col("n") * percent),
        "able",
    )
    buckets = cut(buckets.join(able, "cid"), "able-buckets")
    discard(shared_buckets, able)

    # |intersection| is at most the smaller number of common members; the union is at least the sizes without that.
    most = F.least(F.col("common"), F.col("common2"), F.col("n"), F.col("n2"))
    possible = most * 100 >= (F.col("n") + F.col("n2") - most) * percent
    hubs = buckets.groupBy("key").agg(F.min(F.struct(F.xxhash64("cid", F.pmod(F.col("key"), F.lit(3))), F.col("cid"), F.col("n"), F.col("common"))).alias("hub")).select("key", F.col("hub.cid").alias("cid2"), F.col("hub.n").alias("n2"), F.col("hub.common").alias("common2"))
    pair = [F.least("cid", "cid2").alias("a"), F.greatest("cid", "cid2").alias("b")]
    stars = buckets.join(hubs, "key").filter(possible & (F.col("cid") != F.col("cid2"))).select(*pair).distinct()

    def linked(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets.select(F.col("cid").alias("a"), F.col("members").alias("x")), "a").join(sets.select(F.col("cid").alias("b"), F.col("members").alias("y")), "b")
        inter = F.size(F.array_intersect("x", "y"))
        return both.filter(inter * 100 >= (F.size("x") + F.size("y") - inter) * percent).select("a", "b")

    links = cut(linked(stars), "star-links")
    labels = connected_components(links)
    placed = cut(buckets.join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid")), "placed")
    discard(buckets)
    links = links.unionByName(_cross_links(placed, sets, links, labels, percent))
    discard(sets)

    labels = connected_components(links)
    own = classes.join(labels.withColumnRenamed("node", "cid"), "cid", "left").select("cid", "rep", "n_class", F.coalesce("label", "cid").alias("label"))
    least = cut(own.groupBy("label").agg(F.min("rep").alias("component")), "least")
    found = cut(salted_lookup(own, least, "label", F.col("cid")).select("cid", "n_class", "component"), "components")
    return salted_lookup(rows, found, "cid", F.xxhash64("doc_id")).select(
        "doc_id", "text_hash", F.col("n").alias("n_shingles"), F.col("cid").alias("class_id"), F.coalesce("n_class", F.lit(1)).alias("n_class"),
        F.coalesce("component", "doc_id").alias("component_id"), F.col("doc_id").eqNullSafe(F.coalesce("component", "doc_id")).alias("kept"),
    )
