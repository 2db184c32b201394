import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from kinweave.llm.decontamination import find_contamination
from kinweave.llm.exact_dedup import tree_exact_dedup
from kinweave.llm.html_text import extract_html, visible_text
from kinweave.llm.language import fit_language, identify_languages
from kinweave.llm.line_dedup import dedup_lines_across_sites
from kinweave.llm.mixing import mix_sources
from kinweave.llm.near_dedup import near_duplicates
from kinweave.llm.quality import classify_quality
from kinweave.llm.secrets import scan_secrets
from kinweave.llm.token_store import Encoder, pack_ids, read_document_ids, tokenize_to_files, unpack_ids

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, node long, size long"


def table(spark, texts, schema=DOCS):
    """Rows with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, None, "x", 1, 2) for i, t, s in texts], schema)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and long texts, ties, a repeated row."""
    long = " ".join(f"w{k % 977}" for k in range(60_000))
    return table(spark, [(1, "a b c d e f", "s"), (2, "a b c d e f", None), (3, None, "s"), (4, "", "s"), (None, "x y", "t"), (5, long, "t"), (5, long, "t"), (6, " \n ", None)])


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, [])


def test_exact_dedup(odd, none):
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in tree_exact_dedup(odd, keep="largest").collect()}
    assert got == {(1, 2, 2, False), (2, 2, 2, True), (3, 4, 2, False), (4, 4, 2, True), (None, None, 1, True), (5, 5, 2, True), (6, 6, 1, True)}
    assert tree_exact_dedup(odd).filter("doc_id = 3").first().text_sha256 == hashlib.sha256(b"").hexdigest()
    assert tree_exact_dedup(none).count() == 0
    assert tree_exact_dedup(odd.withColumn("doc_id", odd.doc_id.cast("string"))).filter("doc_id = '5' AND group_size = 2").count() == 2


def test_exact_dedup_merges_sorted_runs(spark):
    """Every merge reads its entries in order of node and digest: an exchange by node, a sort, a sort-based aggregation."""
    rows = table(spark, [(k, f"t{k % 50}", "s") for k in range(400)])
    found = tree_exact_dedup(rows, fan_in=4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    merges = re.findall(r"SortAggregate\(key=\[node#\d+L?, digest#\d+, chars#\d+L?, check#\d+L?\], functions=\[min\(entry", plan)
    sorts = re.findall(r"Sort \[node#\d+L? ASC NULLS FIRST, digest#\d+ ASC NULLS FIRST, chars#\d+L? ASC NULLS FIRST, check#\d+L? ASC NULLS FIRST\]", plan)
    assert len(merges) >= 2 and len(sorts) >= 2 and "HashAggregate" not in plan
    got = found.collect()
    assert all(r.keep_id == r.doc_id % 50 and r.group_size == 8 and r.kept == (r.doc_id < 50) for r in got) and len(got) == 400


def test_line_dedup(spark, odd, none):
    shared = "one two three four"
    rows = table(spark, [(k, f"own words of text {k}\n{shared}\nshort\n \n", f"s{k}") for k in range(6)])
    got = dedup_lines_across_sites(rows, min_sites=5).orderBy("doc_id").collect()
    assert all(r.text == f"own words of text {r.doc_id}\n \n" and r.n_removed == 2 and r.n_lines == 5 for r in got)
    got = dedup_lines_across_sites(rows, min_sites=5, min_words=4).orderBy("doc_id").collect()
    assert all(r.text == f"own words of text {r.doc_id}\nshort\n \n" and r.n_removed == 1 for r in got)
    assert dedup_lines_across_sites(rows, min_sites=7).filter("n_removed > 0").count() == 0
    assert dedup_lines_across_sites(odd).count() == 8 and dedup_lines_across_sites(none).count() == 0
    # A line of a million characters without blanks takes no longer than others of its length.
    began = time.time()
    assert dedup_lines_across_sites(table(spark, [(k, "x" * 1_000_000, f"s{k}") for k in range(6)]), min_words=4).filter("n_removed = 0").count() == 6
    assert dedup_lines_across_sites(table(spark, [(k, "x" * 1_000_000, f"s{k}") for k in range(6)])).filter("n_removed = 1").count() == 6
    assert time.time() - began < 60


def test_mixing(spark, odd, none):
    rows = table(spark, [(k, "w " * (k % 7 + 1), f"s{k % 3}") for k in range(3000)])
    got = mix_sources(rows).toPandas()
    assert (got.taken <= 3 * got["size"]).all()
    for _, part in got.groupby("source"):
        assert abs(part.taken.sum() - part.target.iloc[0]) <= 10
    assert got.taken.sum() <= got["size"].sum()
    assert mix_sources(odd).count() == 8 and mix_sources(none).count() == 0


def test_secrets(spark, odd, none):
    key, hexa = "AKIA" + "B" * 16, "0123456789abcdef" * 2
    text = f'é\U0001f600 token = "abcdef12" secret:x {key} {hexa} AKIASHORT'
    got = scan_secrets(table(spark, [(1, text, "s")])).first()
    assign = re.search(r"token.*abcdef12", text)
    spans = f"assign:{assign.start()}:{assign.end()},access:{text.index(key)}:{text.index(key) + 20},hex:{text.index(hexa)}:{text.index(hexa) + 32}"
    assert got.spans == spans and got.base_sha256 == hashlib.sha256(spans.encode()).hexdigest() and (got.n_assign, got.n_access, got.n_hex) == (1, 1, 1)
    copied = scan_secrets(table(spark, [(k, text, f"s{k}") for k in range(4)])).first()
    assert copied.n_live == 0 and copied.n_copied == 3
    many = scan_secrets(table(spark, [(1, " ".join([hexa] * 1000), "s")])).first()
    assert many.n_hex == 1000 and many.spans.endswith(f"hex:{999 * 33}:{999 * 33 + 32}")
    assert scan_secrets(odd).count() == 8 and scan_secrets(none).count() == 0
    began = time.time()
    token = "eyJhbGciOi.eyJzdWIiOiIxMjM0NTY3ODkwIn0.c2ln"
    got = scan_secrets(table(spark, [(1, "eyJa" * 100_000, "s"), (2, f"x {token} -{token}\n{token}", "s")])).orderBy("doc_id").collect()
    assert got[0].spans == "" and got[1].spans == f"jwt:2:{2 + len(token)},jwt:{5 + 2 * len(token)}:{5 + 3 * len(token)}" and time.time() - began < 60


def test_near_duplicates_against_brute_force(spark, odd, none):
    rng = random.Random(4)
    words, texts = [f"v{k}" for k in range(200)], []
    for base in range(12):
        own = [rng.choice(words) for _ in range(80)]
        for _ in range(6):
            texts.append([rng.choice(words) if rng.random() < 0.03 * (base % 4) else w for w in own])
    rows = table(spark, [(k, " ".join(t).upper() if k % 2 else " ".join(t), "s") for k, t in enumerate(texts)])
    sets = [{tuple(t[i : i + 2]) for i in range(len(t) - 1)} for t in texts]
    root = list(range(len(sets)))
    for _ in sets:
        for a in range(len(sets)):
            for b in range(a):
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    got = near_duplicates(rows, shingle=2).orderBy("doc_id").collect()
    assert [(r.n_shingles, r.component_id, r.kept) for r in got] == [(len(s), root[k], root[k] == k) for k, s in enumerate(sets)]
    found = {(r.doc_id, r.component_id, r.n_shingles) for r in near_duplicates(odd).collect() if r.doc_id is not None}
    assert {(1, 1, 2), (2, 1, 2), (3, 3, 0), (4, 4, 0), (6, 6, 0)} <= found
    assert near_duplicates(none).count() == 0


def test_html(spark):
    assert visible_text("<p>a<p>b<div>c</div>d") == "a\n\nb\n\nc\nd"
    assert visible_text("<ul><li>one<li>two<ol start=3><li>x</ol></ul>z") == "- one\n- two\n  3. x\n\nz"
    assert visible_text("<table><tr><td>a<td>bbb<tr><td>cccc<td>d</table>") == "a    | bbb\ncccc | d"
    assert visible_text("<head><title>T</title></head><div hidden>x</div><script>a<b</script>y<span style='display: none'>q</span>") == "y"
    assert visible_text("<table>loose<tr><td>1</table>") == "loose\n\n1" and visible_text("a < b &amp; <!-- c") == "a < b &"
    pages = spark.createDataFrame([(1, "u", None), (2, "u", ""), (3, "u", "<b>x")], "page_id long, url string, html string")
    assert [(r.text, r.n_lines) for r in extract_html(pages).orderBy("page_id").collect()] == [("", 0), ("", 0), ("x", 1)]


def test_quality_and_language(spark, odd, none):
    rng = random.Random(1)
    good, bad = lambda: " ".join(rng.choice(["plain", "words", "here", "and"]) for _ in range(30)), lambda: " ".join(rng.choice(["PLAIN!!", "WORDS!!"]) for _ in range(30))
    rows = table(spark, [(k, bad() if k % 4 == 0 else good(), "s") for k in range(240)])
    labels = spark.createDataFrame([(k, int(k % 4 > 0)) for k in range(240)] + [(1, None)], "doc_id long, quality int")
    got = classify_quality(rows, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.doc_id % 4 > 0) for r in got)
    assert classify_quality(odd, labels).count() == 8 and classify_quality(none, labels).count() == 0
    assert {r.score for r in classify_quality(odd, labels.limit(0)).collect()} == {0.5}

    sounds = {"aa": "the ing tion", "bb": "schön lich keit"}
    rows = spark.createDataFrame([(k, " ".join(rng.choice(sounds[x].split()) for _ in range(20)), x) for k in range(150) for x in [("aa", "bb")[k % 2]]], "doc_id long, text string, lang string")
    model = fit_language(rows)
    got = identify_languages(rows, model).collect()
    assert all(r.lang_pred == ("aa", "bb")[r.doc_id % 2] and 0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in identify_languages(odd, model).filter("doc_id IN (3, 4, 6)").collect()} == {"und"}
    assert identify_languages(none, model).count() == 0


def test_decontamination(spark, odd, none):
    rng = random.Random(2)
    text = lambda n: " ".join(f"{rng.choice('bcdfgh')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.choice('aeiou')}" for _ in range(n))
    items = [(k, text(40)) for k in range(5)] + [(9, None), (10, "too short")]
    docs = [(k, text(300), "s") for k in range(40)] + [(100 + k, f"{text(77)} {items[k][1]} {text(90)}", "s") for k in range(5)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = find_contamination(table(spark, docs), bench).collect()
    assert {(r.doc_id, r.item_id, r.kind) for r in got} == {(100 + k, k, "copy") for k in range(5)}
    named = find_contamination(table(spark, docs).selectExpr("concat('d', doc_id) AS doc_id", "text"), bench.selectExpr("concat('i', item_id) AS item_id", "text"), block=3).collect()
    assert {(r.doc_id, r.item_id) for r in named} == {(f"d{100 + k}", f"i{k}") for k in range(5)}
    phrases = [(1, "Two plus  two"), (2, "two plus"), (3, "zebra"), (4, ""), (None, "plus two")]
    texts = [(1, "what is two PLUS two", "s"), (2, "two and plus two", "s"), (3, None, "s"), (4, "zebras", "s"), (5, "zebra zebra", "s"), (6, "two", "s"), (7, "plus two", "s")]
    got = find_contamination(table(spark, texts), spark.createDataFrame(phrases, "item_id long, text string"))
    assert {(r.doc_id, r.item_id, r.first_word, r.end_word) for r in got.collect()} == {(1, 1, 2, 5), (1, 2, 2, 4), (1, None, 3, 5), (2, None, 2, 4), (5, 3, 0, 1), (7, None, 0, 2)}
    assert find_contamination(odd, bench).count() == 0 and find_contamination(none, bench).count() == 0 and find_contamination(table(spark, docs), bench.limit(0)).count() == 0


def test_tokens(spark, odd, none, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, own = Tokenizer.from_file(path), Encoder(open(path).read())
    for t in ["", " ", "a  b", "it's 12\n\n x\t", "é²ɏ 　 Ω", "<|endoftext|>", "\x1c a"]:
        assert own.encode([t])[0].tolist() == plain.encode(t, add_special_tokens=False).ids
    for width in (1, 7, 16, 17):
        ids = np.arange(1000, dtype=np.uint32) % 2**width
        assert (unpack_ids(pack_ids(ids, width), width, 13, 900) == ids[13:900]).all()
    got = sorted(tokenize_to_files(odd, path, f"file://{tmp_path}/t", block_ids=100).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 2, 3, 4, 5, 5, 6] and got[3].n_tokens == 1
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:], strict=False))
    ids = [*plain.encode("a b c d e f", add_special_tokens=False).ids, 0]
    assert got[1].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes()) and read_document_ids(spark, f"file://{tmp_path}/t", 1).tolist() == ids
    assert tokenize_to_files(none, path).count() == 0
    with pytest.raises(TypeError, match="doc_id is of type string"):
        tokenize_to_files(odd.withColumn("doc_id", odd.doc_id.cast("string")), path)


def test_tokens_of_all_documents_are_those_of_the_library(spark, tmp_path):
    import duckdb
    from tokenizers import Tokenizer

    path, docs = public_tokenizers.path("byte_bpe_50k.json"), "/root/testdata/sf0.001/documents.parquet"
    plain, want, start = Tokenizer.from_file(path), [], 0
    for doc_id, text in duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{docs}' ORDER BY doc_id").fetchall():
        ids = np.array([*plain.encode(text, add_special_tokens=False).ids, 0], "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = tokenize_to_files(spark.read.parquet(docs), path, f"file://{tmp_path}/t", block_ids=5000)
    assert sorted(map(tuple, got.collect())) == want
    blocks = spark.read.parquet(f"file://{tmp_path}/t")
    assert blocks.count() > 20
    for doc_id, _, n, crc in want[::40]:
        ids = read_document_ids(spark, f"file://{tmp_path}/t", doc_id)
        assert len(ids) == n and zlib.crc32(ids.astype("<u4").tobytes()) == crc
    with pytest.raises(KeyError):
        read_document_ids(spark, f"file://{tmp_path}/t", -1)


def test_encoder_at_every_kind_of_border():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, own, rng = Tokenizer.from_file(path), Encoder(open(path).read()), random.Random(3)
    bits = [" ", "  ", "\n", "\n\n ", "\t", "\x0b", "\x1c", "\x85", "\xa0", "\u2003", "\u3000", "a", "Zé", "'s", "'S", "12", "²", "½x", "--", "Ω", "語", "😀", "\0", "_", "<|endoftext|>", "x" * 70]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(4000)]
    for got, text in zip(own.encode(texts), texts, strict=True):
        assert got.tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)
    assert own.encode([]) == [] and [x.tolist() for x in own.encode(["", ""])] == [[], []]
