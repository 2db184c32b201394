import numpy as np
import pytest

pytest.importorskip("pyarrow")
from kinweave.llm.decontamination import Item, PhraseTable, WordCounts, WordTable, _segment_sums, common_words


def test_segment_sums_are_those_of_reduceat():
    rng = np.random.default_rng(1)
    for lengths in ([1], [1, 1, 1], [40], [3, 700, 1, 16, 17, 5000, 2]):
        index = rng.integers(0, 50, sum(lengths))
        starts = np.cumsum([0, *lengths[:-1]])
        rows = rng.integers(-9, 9, (50, 4)).astype(np.float32)
        assert (_segment_sums(rows, index, starts) == np.add.reduceat(rows[index], starts)).all()


def test_word_table_rules_out_no_region_that_has_enough():
    rng = np.random.default_rng(2)
    vocabulary = rng.integers(0, 2**63, 3000, dtype=np.uint64) * np.uint64(2)
    items = [Item(k, own, own[-3:]) for k, own in enumerate(rng.choice(vocabulary, (30, 20)))]
    table, words = WordTable(items), rng.choice(vocabulary, 20_000)
    for at, x in enumerate(items):
        words[at * 500 : at * 500 + 20] = x.words
    low = np.repeat(np.arange(0, 15_000, 500), 30)
    item = np.tile(np.arange(30), 30)
    got = table.at_least(words, low, low + 40, item, np.full(len(item), 10.0))
    exact = np.array([np.isin(words[a : a + 40], items[k].words).sum() >= 10 for a, k in zip(low, item, strict=True)])
    assert got[exact].all() and exact.sum() >= 30 and got.sum() <= exact.sum() + 5
    assert len(table.at_least(words, low[:0], low[:0], item[:0], np.zeros(0))) == 0


def test_word_counts_are_never_too_small():
    rng = np.random.default_rng(3)
    vocabulary = rng.integers(0, 2**63, 400, dtype=np.uint64) * np.uint64(2)
    items = [Item(k, own, own[-3:]) for k, own in enumerate(rng.choice(vocabulary, (600, 12)))]
    words, counts = rng.choice(vocabulary, 1003), WordCounts(items)
    sums = counts.sums(words)
    assert len(sums) == 3
    low = rng.integers(0, 900, 3000)
    high, item = low + rng.integers(1, 100, 3000), rng.integers(0, 600, 3000)
    got = counts.between(sums, low, high, item)
    exact = np.array([np.isin(words[a:b], items[k].words).sum() for a, b, k in zip(low, high, item, strict=True)])
    assert (got >= exact).all() and (got <= exact + 16).all()


def test_phrases_are_found_where_their_words_follow_one_another():
    rng = np.random.default_rng(4)
    vocabulary = rng.integers(0, 2**63, 6, dtype=np.uint64) * np.uint64(2)
    items = [Item(k, own, own) for k, own in enumerate([rng.choice(vocabulary, n) for n in (1, 2, 2, 3, 3, 4, 4)])]
    words, at = rng.choice(vocabulary, 60), np.array([0, 0, 7, 8, 30, 60])
    got = set(PhraseTable(items).found(words, at))
    want = set()
    for r in range(len(at) - 1):
        own = words[at[r] : at[r + 1]].tolist()
        for k, x in enumerate(items):
            first = next((i for i in range(len(own) - len(x.words) + 1) if own[i : i + len(x.words)] == x.words.tolist()), None)
            if first is not None:
                want.add((r, int(at[r]) + first, k))
    assert got == want and len(got) > 5


def test_word_table_bounds_the_common_subsequence():
    rng = np.random.default_rng(7)
    vocabulary = rng.integers(0, 2**63, 60, dtype=np.uint64) * np.uint64(2)
    items = [Item(k, own, own[-3:]) for k, own in enumerate([rng.choice(vocabulary, int(n)) for n in (5, 20, 64, 65, 150, 300)])]
    table, words = WordTable(items), rng.choice(vocabulary, 3000)
    words[100:400] = items[5].words
    low = rng.integers(0, 2500, 400)
    high, item = low + rng.integers(1, 400, 400), rng.integers(0, 6, 400)
    low[0], high[0], item[0] = 100, 400, 5
    common = np.array([common_words(words[a:b].tolist(), items[k].whole, 0) for a, b, k in zip(low, high, item, strict=True)])
    assert table.at_least(words, low, high, item, common).all() and common.max() == 300
    assert not table.at_least(words, low, high, item, np.array([len(items[k].words) for k in item]) + 500).any()
