"""Secret scan with corpus-wide ownership frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import cut, salted_lookup, text_or_empty

#: kind -> (pattern, group of the value, least length of that group). The first three are the base kinds.
KINDS: dict[str, tuple[str, int, int]] = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
    "github": (r"gh[opsu]_[A-Za-z0-9]+", 0, 40),
    # Only where no letter, digit, _ or - comes before: a long run of those is then tried once, not at each eyJ in it.
    "jwt": (r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    "private_key": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
}
BASE = 3
#: Tells whether a text can have a match that is long enough; far cheaper than listing all matches.
_GATE = {"access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}", "github": r"gh[opsu]_[A-Za-z0-9]{36}"}
_SPAN = "struct<kind:int,start:int,end:int,digest:string,varied:boolean>"
_CHUNK = 256


def _spans(text: Column, no: int, kind: str) -> Column:
    """Array of spans of one kind, in code points, leftmost and non-overlapping, failing matches dropped.

    Text between matches comes from split(), matches from regexp_extract_all(); their lengths add up to positions. The
    sums run in chunks, so that a text with very many matches doesn't copy its array of spans for each of them.
    """
    pattern, group, least = KINDS[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zipped = F.zip_with(
        F.zip_with(F.split(text, pattern, -1), found, lambda gap, m: F.struct(F.char_length(gap).alias("gap"), F.char_length(m).alias("size"))),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)),
        lambda at, value: F.struct(at["gap"].alias("gap"), at["size"].alias("size"), value.alias("value")),
    )
    zipped = F.filter(zipped, lambda x: x["size"].isNotNull())
    span = lambda acc, x: F.struct(
        (acc["pos"] + x["gap"] + x["size"]).alias("pos"),
        F.concat(
            acc["spans"],
            F.when(
                F.char_length(x["value"]) >= least,
                F.array(
                    F.struct(
                        F.lit(no).alias("kind"), (acc["pos"] + x["gap"]).alias("start"), (acc["pos"] + x["gap"] + x["size"]).alias("end"),
                        F.sha2(x["value"], 256).alias("digest"), (F.size(F.array_distinct(F.split(x["value"], ""))) >= 8).alias("varied"),
                    )
                ).cast(f"array<{_SPAN}>"),
            ).otherwise(F.array().cast(f"array<{_SPAN}>")),
        ).alias("spans"),
    )
    start = lambda pos: F.struct(pos.alias("pos"), F.array().cast(f"array<{_SPAN}>").alias("spans"))
    chunk = lambda acc, part: F.element_at(
        F.transform(
            F.array(F.aggregate(part, start(acc["pos"]), span)),
            lambda inner: F.struct(inner["pos"].alias("pos"), F.concat(acc["parts"], F.array(inner["spans"])).alias("parts")),
        ),
        1,
    )
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(zipped) - 1) / F.lit(_CHUNK)).cast("int")), lambda c: F.slice(zipped, c * _CHUNK + 1, F.lit(_CHUNK)))
    whole = F.aggregate(chunks, F.struct(F.lit(0).alias("pos"), F.array().cast(f"array<array<{_SPAN}>>").alias("parts")), chunk)
    return F.when(text.rlike(_GATE.get(kind, pattern)), F.flatten(whole["parts"])).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", copied_owners: int = 3, copied_repos: int = 25) -> DataFrame:
    """Spans that look like secrets, and how widely the corpus shares each value; one row per input row.

    Candidates are the matches of KINDS; positions count code points, ends are exclusive. The SHA-256 of each
    candidate's value is aggregated over the corpus: first to distinct (value, owner, repository), then to
    repositories by owner, then to both by value, each step combined before its shuffle, so a value that a third of
    the rows copy is never one task's group. A value with copied_owners owners or copied_repos repositories is a
    widely copied example; any other value of at least 8 different characters is owner-specific and looks live.

    Returns doc_id, n_assign, n_access, n_hex, n_live, n_copied (long), base_sha256 (of kind:start:end of the base
    kinds by start, then kind, comma-joined), spans (all kinds, joined likewise), live_spans.
    A null text is empty: counts 0, base_sha256 of the empty string, spans ''. Null owners and repositories count as
    one owner and one repository each. Repeated rows each get a result; they don't add owners or repositories. An
    empty table gives an empty result. Other columns are ignored.
    """
    text = text_or_empty(text_col)
    found = F.concat(*[_spans(F.col("__text"), no, kind) for no, kind in enumerate(KINDS)])
    by_start = lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["kind"] - b["kind"])
    rows = cut(
        docs.select(F.col(id_col).alias("doc_id"), F.col(owner_col).alias("owner"), F.col(repo_col).alias("repo"), text.alias("__text"))
        .select("doc_id", "owner", "repo", F.monotonically_increasing_id().alias("row"), found.alias("found"))
        .withColumn("found", F.array_sort("found", by_start)),
        "secrets",
    )
    candidates = rows.filter(F.size("found") > 0).select("row", "owner", "repo", F.explode("found").alias("s")).select("row", "owner", "repo", "s.*")
    spread = (
        candidates.select("digest", "owner", "repo").distinct()
        .groupBy("digest", "owner").agg(F.count(F.lit(1)).alias("repos"))
        .groupBy("digest").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repos"))
        .filter((F.col("owners") >= copied_owners) | (F.col("repos") >= copied_repos))
        .select("digest", F.lit(True).alias("copied"))
    )
    judged = salted_lookup(candidates, cut(spread, "copied"), "digest", F.col("row"))
    live = F.col("copied").isNull() & F.col("varied")
    verdicts = judged.groupBy("row").agg(
        F.count_if(live).alias("n_live"), F.count_if(F.col("copied")).alias("n_copied"),
        F.array_sort(F.collect_list(F.when(live, F.struct("start", "kind", "end")))).alias("alive"),
    )
    count = lambda no: F.size(F.filter("found", lambda s: s["kind"] == no)).cast("long")
    return rows.join(verdicts, "row", "left").select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_copied", F.lit(0)).alias("n_copied"),
        F.sha2(_written(F.filter("found", lambda s: s["kind"] < BASE)), 256).alias("base_sha256"), _written(F.col("found")).alias("spans"),
        F.coalesce(_written(F.col("alive")), F.lit("")).alias("live_spans"),
    )
