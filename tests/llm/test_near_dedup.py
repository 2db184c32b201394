import random

import pytest

pytest.importorskip("pyarrow")
from kinweave.llm.near_dedup import near_duplicates

SCHEMA = "doc_id long, text string, key string, label long, home long"


def shingles(words, size=2):
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)}


def components(sets):
    """Brute force over all pairs: the least index of each one's component."""
    at, root = {}, list(range(len(sets)))
    for k, s in enumerate(sets):
        for x in s:
            at.setdefault(x, []).append(k)

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, s in enumerate(sets):
        for b in {b for x in s for b in at[x] if b < a}:
            inter = len(s & sets[b])
            if 100 * inter >= 80 * (len(s) + len(sets[b]) - inter):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return [find(k) for k in range(len(sets))]


def crowd(rng, n, size, least, most):
    """n variants of one text with `least` to `most` words replaced, from few words, so that replacements are shared too."""
    words = [f"c{k}" for k in range(40)]
    base = [rng.choice(words) + rng.choice("abcdefgh") for _ in range(size)]
    for _ in range(n):
        own = list(base)
        for i in rng.sample(range(size), rng.randint(least, most)):
            own[i] = rng.choice(words[:3])
        yield own


def near(spark, rows):
    got = near_duplicates(spark.createDataFrame([(i, t, "k", 1, 2) for i, t in rows], SCHEMA).repartition(4), shingle=2).collect()
    return {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got}


@pytest.mark.parametrize("seed, size, least, most", [(1, 100, 3, 5), (2, 140, 3, 11), (3, 60, 0, 9)])
def test_crowds_that_are_alike_without_all_being_linked(spark, seed, size, least, most):
    rng = random.Random(seed)
    texts = [w for _ in range(2) for w in crowd(rng, 150, size, least, most)]
    sets = [shingles(w) for w in texts]
    root = components(sets)
    assert len(set(root)) > 10 and max(root.count(r) for r in set(root)) > 10
    assert near(spark, [(k, " ".join(w)) for k, w in enumerate(texts)]) == {(k, len(s), root[k], root[k] == k) for k, s in enumerate(sets)}


def test_rows_without_doc_id_link_others(spark):
    words = [f"w{k}" for k in range(240)]
    # 200 and 199 of the shingles of the text with 201; the first and the last are linked through those without a doc_id.
    got = near(spark, [(7, " ".join(words[:202])), (None, " ".join(words[20:222])), (None, " ".join(words[20:222])), (9, " ".join(words[38:240]))])
    assert got == {(7, 201, 7, True), (None, 201, 7, False), (9, 201, 7, False)}
    got = near(spark, [(None, " ".join(words[:200])), (None, " ".join(words[:201])), (7, " ".join(words[:202]))])
    assert got == {(None, 199, 7, False), (None, 200, 7, False), (7, 201, 7, True)}
    assert near(spark, [(None, "a b c"), (None, "a b c"), (None, None), (None, "")]) == {(None, 2, None, True), (None, 0, None, True)}


def test_repeated_ids_with_different_texts(spark):
    words = [f"w{k}" for k in range(100)]
    got = near(spark, [(1, " ".join(words)), (1, "x y z"), (2, " ".join(words[:97])), (3, "X Y Z")])
    assert got == {(1, 99, 1, True), (1, 2, 1, True), (2, 96, 1, False), (3, 2, 1, False)}
