"""Benchmark decontamination by latent semantic retrieval, longest common subsequence and answer checks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from kinweave.llm.common import bounded_batches, cut, shuffle_parts, text_or_empty, worker_cache
from kinweave.llm.shingles import WordHasher, mix, row_words, text_pieces

#: Terms are words hashed to _DIM buckets; the place _DIM stands for a word that repeats one of the four before it.
_DIM, _RANK, _EXTRA, _PASSAGE = 1 << 13, 32, 8, 48
#: Widths of the windows of documents, three times a power of two; each item is searched at the width nearest its length.
_WIDTHS = (6, 12, 24, 48, 96)
_PIECE, _CHUNK, _ROWS, _PASSAGES = 1 << 17, 20_000, 128, 512
#: Words of items are counted by blocks of so many words, for so many items at once.
_BLOCK, _GROUP = 8, 256


def _hasher() -> WordHasher:
    cache = worker_cache("decontamination")
    if not hasattr(cache, "hasher"):
        cache.hasher = WordHasher()
    return cache.hasher


def _terms(words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    term = (words >> np.uint64(30)).astype(np.int64) & (_DIM - 1)
    place = np.arange(len(words)) - np.repeat(offsets[:-1], np.diff(offsets))
    for back in (1, 2, 3, 4):
        again = np.flatnonzero(words[back:] == words[:-back]) + back
        term[again[place[again] >= back]] = _DIM
    return term


def _segment_sums(rows: np.ndarray, index: np.ndarray, starts: np.ndarray, most: int = 16) -> np.ndarray:
    """Sums of rows[index] over the segments that begin at starts (ascending, the first at 0).

    Segments are cut into pieces of up to `most` rows, the k-th rows of all pieces are added at once, and the pieces'
    sums are summed the same way until each segment is one piece. (Several times as fast as add.reduceat.)
    """
    while True:
        size = np.diff(np.append(starts, len(index)))
        pieces = -(-size // most)
        begin = np.cumsum(pieces) - pieces
        rank = np.arange(pieces.sum()) - np.repeat(begin, pieces)
        length = np.minimum(most, np.repeat(size, pieces) - most * rank)
        order = np.argsort((most - length).astype(np.uint8), kind="stable")
        first = (np.repeat(starts, pieces) + most * rank)[order]
        longer = np.cumsum(np.bincount(length, minlength=most + 1)[::-1])[::-1]
        sums = np.take(rows, index[first], axis=0, mode="clip")
        for k in range(1, most):
            n = longer[k + 1]
            if not n:
                break
            sums[:n] += np.take(rows, index[first[:n] + k], axis=0, mode="clip")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        if len(order) == len(starts):
            return np.take(sums, place, axis=0, mode="clip")
        rows, index, starts = sums, place, begin


def _signs() -> np.ndarray:
    """The random test matrix: signs, so that all sums are whole numbers and don't depend on their order."""
    signs = np.random.default_rng(6).integers(0, 2, (_DIM + 1, _RANK + _EXTRA)) * 2.0 - 1
    signs[_DIM] = 0
    return signs.astype(np.float32)


@dataclass
class LatentSpace:
    """basis[t] is what one occurrence of term t adds to a passage's latent vector."""

    basis: np.ndarray
    idf: np.ndarray

    def vector(self, words: np.ndarray) -> np.ndarray:
        v = self.basis[_terms(words, np.array([0, len(words)]))].sum(axis=0)
        return v / (np.linalg.norm(v) + 1e-9)


def fit_latent_space(docs: DataFrame, text_col: str = "text") -> LatentSpace:
    """Randomised SVD of the TF-IDF matrix of all passages of all documents, in one distributed pass.

    For the counts T (passages by terms) and random signs S every task sums its share of T'(T S) and of the passages
    that contain each term. With D the diagonal of IDF weights, D T'T S is what the TF-IDF Gram matrix does to
    D^-1 S, so a Nystroem step on the driver yields the leading right singular vectors and values; latent coordinates
    are divided by the singular values, so that frequent words don't outweigh the rest. Partial sums of 8192 x 40
    numbers per task are streamed together in two rounds; the driver gets one of them.
    """
    width = _RANK + _EXTRA

    def accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signs, total = _signs(), np.zeros((_DIM + 1, width + 1))
        passages = 0
        for batch in batches:
            for _, _, data, offsets in text_pieces(batch.column(0), _PIECE):
                words, at, _ = row_words(_hasher(), data, offsets)
                if not len(words):
                    continue
                term = _terms(words, at)
                starts = np.flatnonzero((np.arange(len(words)) - np.repeat(at[:-1], np.diff(at))) % _PASSAGE == 0)
                passages += len(starts)
                for k in range(0, len(starts), _PASSAGES):
                    low, high = starts[k], starts[k + _PASSAGES] if k + _PASSAGES < len(starts) else len(words)
                    own, here = term[low:high], starts[k : k + _PASSAGES] - low
                    projected = _segment_sums(signs, own, here)
                    # By term, then passage: each term's passages follow one another.
                    pairs = np.sort(own << 32 | np.repeat(np.arange(len(here)), np.diff(np.append(here, len(own)))))
                    fresh, by_term = np.append(True, pairs[1:] != pairs[:-1]), pairs >> 32
                    total[:, width] += np.bincount(by_term[fresh], minlength=_DIM + 1)
                    runs = np.flatnonzero(np.append(True, by_term[1:] != by_term[:-1]))
                    total[by_term[runs], :width] += _segment_sums(projected, pairs & 0xFFFFFFFF, runs)
        total[_DIM] = 0
        total[_DIM, width] = passages
        yield from _rows({b: total[b * _ROWS : (b + 1) * _ROWS] for b in range(-(-(_DIM + 1) // _ROWS))})

    def _rows(parts: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"block": pa.array(list(parts), pa.int32()), "part": pa.array([x.tobytes() for x in parts.values()], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(x.as_buffer(), np.float64)
                parts[b] = parts[b] + own if b in parts else own
        if parts:
            yield from _rows(parts)

    schema, parts = "block int, part binary", shuffle_parts(docs.sparkSession)
    sums = docs.select(text_or_empty(text_col)).mapInArrow(accumulate, schema)
    sums = sums.repartition(parts, "block", F.spark_partition_id() % 16).mapInArrow(add, schema).repartition(parts, "block").mapInArrow(add, schema)
    total = np.zeros((_DIM + 1, width + 1))
    for r in sums.collect():
        total[r.block * _ROWS : (r.block + 1) * _ROWS] += np.frombuffer(r.part, np.float64).reshape(-1, width + 1)

    z, df, passages = total[:_DIM, :width], total[:_DIM, width], total[_DIM, width]
    idf = np.log((1 + passages) / (1 + df)) + 0.01
    y, test = idf[:, None] * z, _signs()[:_DIM] / idf[:, None]
    shift = 1e-6 * np.linalg.norm(y) + 1e-12
    y = y + shift * test
    value, vector = np.linalg.eigh((test.T @ y + y.T @ test) / 2)
    good = value > value.max() * 1e-10
    u, s, _ = np.linalg.svd(y @ (vector[:, good] / np.sqrt(value[good])), full_matrices=False)
    sigma = np.sqrt(np.maximum(s * s - shift, 1e-12))
    rank = min(_RANK, int((sigma > 1e-6 * max(sigma[0], 1e-12)).sum()))
    basis = np.zeros((_DIM + 1, max(1, rank)), np.float32)
    basis[:_DIM, :rank] = u[:, :rank] * idf[:, None] / sigma[:rank]
    return LatentSpace(basis, idf)


class Item:
    """A benchmark item's words, ready for subsequence checks."""

    def __init__(self, item_id, words: np.ndarray, answer: np.ndarray):
        self.item_id, self.words, self.last = item_id, words, answer
        self.whole, self.answer = self._masks(words), self._masks(answer)

    @staticmethod
    def _masks(words: np.ndarray) -> tuple[int, dict[int, int]]:
        masks: dict[int, int] = {}
        for k, w in enumerate(words.tolist()):
            masks[w] = masks.get(w, 0) | 1 << k
        return len(words), masks


def common_words(region: list[int], of: tuple[int, dict[int, int]], least: float) -> int:
    """Length of the longest common subsequence, bit-parallel over `of`; 0 if it can't reach least.

    It can't be longer than the number of the region's words that `of` has, nor than that of the words of `of` that the
    region has; both are quickly counted.
    """
    size, masks = of
    hits = list(filter(None, map(masks.get, region)))
    if len(hits) < least or reduce(or_, hits, 0).bit_count() < least:
        return 0
    row = full = (1 << size) - 1
    for mask in hits:
        hit = row & mask
        row = (row + hit | row - hit) & full
    return size - row.bit_count()


class WordTable:
    """Which words which items have, and where in the item, as bits in one table of slots.

    An item's bits stand for its places, or for equal stretches of it if it has more than 64 words. Pairs of word and item
    may share a slot; then their bits are united, so none is missing. Regions of a text are ruled out for all candidates at
    once if fewer words than an item needs have bits, or if the bits of all words cover fewer places of the item.
    """

    def __init__(self, items: list[Item]):
        self.salt = np.random.default_rng(66).integers(0, 2**63, len(items), dtype=np.uint64) * np.uint64(2)
        bits = max(12, (32 * sum(len(x.words) for x in items)).bit_length())
        self.shift, self.bits = np.uint64(64 - bits), np.zeros(1 << bits, np.uint64)
        self.stretch = np.array([-(-len(x.words) // 64) for x in items], np.int64)
        for x, salt, stretch in zip(items, self.salt, self.stretch.tolist(), strict=True):
            place = np.uint64(1) << (np.arange(len(x.words)) // stretch).astype(np.uint64)
            np.bitwise_or.at(self.bits, (x.words + salt) >> self.shift, place)

    def at_least(self, words: np.ndarray, low: np.ndarray, high: np.ndarray, item: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Whether words[low:high] may have `least` words of the item, in as many places of it; for each candidate. No region is empty."""
        size = high - low
        ends, out = np.cumsum(size), []
        a = 0
        while a < len(size):
            b = max(a + 1, int(np.searchsorted(ends, ends[a] - size[a] + (1 << 18), "right")))
            own, before = size[a:b], ends[a:b] - size[a:b]
            before = before - before[0]
            at = np.repeat(low[a:b] - before, own) + np.arange(own.sum())
            found = self.bits[(words[at] + np.repeat(self.salt[item[a:b]], own)) >> self.shift]
            places = np.bitwise_count(np.bitwise_or.reduceat(found, before)) * self.stretch[item[a:b]]
            out.append((np.add.reduceat(found != 0, before, dtype=np.int64) >= least[a:b]) & (places >= least[a:b]))
            a = b
        return np.concatenate([*out, np.zeros(0, bool)])


class WordCounts:
    """How many words of each item stand in which stretch of a text, at most: by blocks of _BLOCK words, for _GROUP items at once.

    Each word of the items has a row that marks the items it is in (words whose hashes agree in the bits looked at share
    theirs, so no mark is missing); rows are added up by block, and sums over blocks are differences of running sums.
    """

    def __init__(self, items: list[Item]):
        self.groups = []
        for first in range(0, len(items), _GROUP):
            own = items[first : first + _GROUP]
            bits = max(16, (16 * sum(len(x.words) for x in own)).bit_length())
            slots = [np.unique(x.words >> np.uint64(64 - bits)).astype(np.int64) for x in own]
            used, place = np.unique(np.concatenate(slots), return_inverse=True)
            row = np.zeros(1 << bits, np.int32)
            row[used] = np.arange(1, len(used) + 1)
            marks = np.zeros((len(used) + 1, len(own)), np.uint8)
            marks[place + 1, np.repeat(np.arange(len(own)), [len(x) for x in slots])] = 1
            self.groups.append((np.uint64(64 - bits), row, marks))

    def sums(self, words: np.ndarray) -> list[np.ndarray]:
        """For each group: marks in all blocks before the k-th, by item."""
        words = np.append(words, np.zeros(-len(words) % _BLOCK, np.uint64))
        kind = np.int16 if len(words) <= np.iinfo(np.int16).max else np.int32
        out = []
        for shift, row, marks in self.groups:
            at = row[words >> shift]
            block = np.take(marks, at[::_BLOCK], axis=0)
            for k in range(1, _BLOCK):
                block += np.take(marks, at[k::_BLOCK], axis=0)
            out.append(np.zeros((len(block) + 1, marks.shape[1]), kind))
            np.cumsum(block, axis=0, dtype=kind, out=out[-1][1:])
        return out

    @staticmethod
    def between(sums: list[np.ndarray], low: np.ndarray, high: np.ndarray, item: np.ndarray) -> np.ndarray:
        """No fewer than the words of each item in words[low:high]."""
        group, own = item // _GROUP, item % _GROUP
        first, last = low // _BLOCK, -(-high // _BLOCK)
        if len(sums) == 1:
            flat, width = sums[0].ravel(), sums[0].shape[1]
            return flat[last * width + own] - flat[first * width + own]
        out = np.zeros(len(item), np.int32)
        for g, x in enumerate(sums):
            here = np.flatnonzero(group == g)
            out[here] = x[last[here], own[here]] - x[first[here], own[here]]
        return out


def _width(length: int) -> int:
    return max(w for w in _WIDTHS if w <= max(_WIDTHS[0], length * 1.42))


class PhraseTable:
    """Short items, by length: found where their words follow one another exactly."""

    def __init__(self, items: list[Item]):
        self.items, self.by_length = items, {}
        for n in sorted({len(x.words) for x in items}):
            own = np.array([k for k, x in enumerate(items) if len(x.words) == n])
            keys = self._runs(np.concatenate([items[k].words for k in own]), n)[::n]
            order = np.argsort(keys, kind="stable")
            self.by_length[n] = (keys[order], own[order])

    @staticmethod
    def _runs(words: np.ndarray, n: int) -> np.ndarray:
        total = np.zeros(max(0, len(words) - n + 1), np.uint64)
        for k in range(n):
            total = mix(total + words[k : len(words) - n + 1 + k])
        return total

    def found(self, words: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(row, first word, item): the first place of each item in each row."""
        row = np.repeat(np.arange(len(at) - 1), np.diff(at))
        for n, (keys, own) in self.by_length.items():
            runs = self._runs(words, n)
            low, high = np.searchsorted(keys, runs), np.searchsorted(keys, runs, "right")
            seen = set()
            for first in np.flatnonzero((high > low) & (row[: len(runs)] == row[n - 1 :])).tolist():
                for k in own[low[first] : high[first]].tolist():
                    if (int(row[first]), k) not in seen and (words[first : first + n] == self.items[k].words).all():
                        seen.add((int(row[first]), k))
                        yield int(row[first]), first, k


def _search(docs: DataFrame, items: list[Item], short: list[Item], item_type: DataType, space: LatentSpace, cosine: float, copied: float, paraphrased: float, answered: float) -> tuple[DataFrame, Broadcast]:
    queries: dict[int, tuple[np.ndarray, list[int]]] = {}
    for width in _WIDTHS:
        own = [(space.vector(x.words[a : a + width] if len(x.words) > 1.42 * width else x.words), k) for k, x in enumerate(items) if _width(len(x.words)) == width for a in (range(0, len(x.words) - width // 2, width) if len(x.words) > 1.42 * width else [0])]
        if own:
            queries[width] = (np.array([v for v, _ in own], np.float32).T.copy(), np.array([k for _, k in own]))
    size = np.array([len(x.words) for x in items])
    pads = np.array([n // 2 if n <= 1.42 * _width(n) else n for n in size.tolist()], np.int64)
    plain = lambda items: [(x.item_id, x.words, x.last) for x in items]
    sent = docs.sparkSession.sparkContext.broadcast((plain(items), plain(short), queries, space.basis, size * paraphrased, pads))
    arrow_type = to_arrow_type(item_type)

    def hits(words: np.ndarray, at: np.ndarray, table: WordTable, counts: WordCounts) -> Iterator[tuple[int, int, int, int, float]]:
        """(row, first and end word of the region, item, cosine) of windows near an item that may hold it, in chunks of words."""
        _, _, queries, basis, least, pads = sent.value
        term, row = _terms(words, at), np.repeat(np.arange(len(at) - 1), np.diff(at))
        widest = int(pads.max())
        for low in range(0, len(words), _CHUNK):
            edge = max(0, low - widest)
            sums_of_marks = counts.sums(words[edge : low + _CHUNK + 2 * _WIDTHS[-1] + widest])
            start = np.arange(low, min(len(words), low + _CHUNK + _WIDTHS[-1]))
            sums, index, place = basis, term[low : start[-1] + 1], start - at[row[start]]
            for width in _WIDTHS:
                if width < min(queries, default=0):
                    continue
                # A window is three strides; sums over the strides of each width add up to those of the next.
                stride = width // 3
                groups = np.flatnonzero(place % stride == 0)
                groups = groups if len(groups) and groups[0] == 0 else np.append(0, groups)
                sums, place, start = _segment_sums(sums, index, groups), place[groups], start[groups]
                index = np.arange(len(start))
                if width not in queries:
                    continue
                vectors, of = queries[width]
                # Windows that lie within their text, the last one or the only one shorter.
                own = row[start]
                here = np.flatnonzero((start < low + _CHUNK) & (place % stride == 0) & ((place == 0) | (place + width - stride < at[own + 1] - at[own])))
                window = np.take(sums, here, axis=0)
                for later in (1, 2):
                    then = np.minimum(here + later, len(start) - 1)
                    follows = np.flatnonzero((here + later < len(start)) & (own[then] == own[here]))
                    window[follows] += np.take(sums, then[follows], axis=0)
                window /= np.linalg.norm(window, axis=1, keepdims=True) + 1e-9
                near = window @ vectors
                i, q = np.nonzero(near >= cosine)
                first, of_row, item = start[here[i]], own[here[i]], of[q]
                begin, end = np.maximum(at[of_row], first - pads[item]), np.minimum(at[of_row + 1], first + width + pads[item])
                some = np.flatnonzero(counts.between(sums_of_marks, begin - edge, end - edge, item) >= least[item])
                some = some[table.at_least(words, begin[some], end[some], item[some], least[item[some]])]
                yield from zip(of_row[some].tolist(), begin[some].tolist(), end[some].tolist(), item[some].tolist(), near[i[some], q[some]].tolist(), strict=True)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, short = ([Item(*x) for x in some] for some in sent.value[:2])
        table, counts, phrases = WordTable(items), WordCounts(items), PhraseTable(short)
        for batch in batches:
            for first, _, data, offsets in text_pieces(batch.column(1), _PIECE):
                words, at, _ = row_words(_hasher(), data, offsets)
                plain = words.tolist() if items else []
                best: dict[tuple[int, int], tuple] = {}
                for row, low, k in phrases.found(words, at):
                    best[row, len(items) + k] = (1.0, 1.0, "copy", low - int(at[row]), low - int(at[row]) + len(short[k].words))
                for row, low, high, k, cos in hits(words, at, table, counts) if items else ():
                    item, region = items[k], plain[low:high]
                    n = len(item.words)
                    share = common_words(region, item.whole, paraphrased * n) / n
                    kind = "copy" if share >= copied else None
                    if kind is None and share >= paraphrased and common_words(region, item.answer, 0) >= answered * item.answer[0]:
                        kind = "paraphrase"
                    if kind and (share, cos) > best.get((row, k), (0.0, 0.0))[:2]:
                        best[row, k] = (share, cos, kind, low - int(at[row]), high - int(at[row]))
                if best:
                    keys = list(best)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array([first + row for row, _ in keys])), pa.array([(items[k] if k < len(items) else short[k - len(items)]).item_id for _, k in keys], arrow_type), pa.array([best[x][2] for x in keys], pa.string()),
                            pa.array([best[x][1] for x in keys], pa.float64()), pa.array([best[x][0] for x in keys], pa.float64()), pa.array([best[x][3] for x in keys], pa.int64()), pa.array([best[x][4] for x in keys], pa.int64()),
                        ],
                        ["doc_id", "item_id", "kind", "cosine", "lcs", "first_word", "end_word"],
                    )

    return docs.mapInArrow(search, f"doc_id {dict(docs.dtypes)['doc_id']}, item_id {item_type.simpleString()}, kind string, cosine double, lcs double, first_word long, end_word long"), sent


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", answer_col: str | None = None,
    cosine: float = 0.2, copied: float = 0.8, paraphrased: float = 0.5, answered: float = 0.8, min_words: int = 1, phrase_words: int = 5, block: int = 5000,
) -> DataFrame:
    """Documents that contain benchmark items; one row per document and item found in it.

    Windows of every whole text (a third of their width apart, so one overlaps an item by five sixths) are compared
    with the items in the latent space. From cosine on (low, as a passage that keeps a share s of an item's words has a
    cosine of about s), the window and its surroundings are checked word by word: an
    item whose longest common subsequence with them is the share `copied` of its words is a copy; from `paraphrased`
    on it is a paraphrase if its answer is there too (the share `answered` of it, in order). Without an answer column
    the answer is the last fifth of the item, three words at least. Items of fewer than phrase_words words are found
    where exactly their words follow one another (kind copy, cosine 1). Items are broadcast in blocks of `block`, one
    pass over the documents each.

    Returns doc_id, item_id, kind, cosine, lcs, first_word, end_word (of the place, in words; end exclusive); the best
    place for each pair. Words are ASCII-lower-cased. Null and empty texts contain nothing. Items that are null, empty or
    have fewer than min_words words aren't searched. Identifiers of both tables may be of any simple type and keep it. Repeated rows of either table give repeated results; rows with a null
    identifier are searched as well. Empty tables give an empty result. Other columns are ignored.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    own = benchmark.select(F.col(item_col).alias("item_id"), text_or_empty(item_text_col).alias("text"), (F.col(answer_col) if answer_col else F.lit(None)).cast("string").alias("answer"))
    bounded_batches(docs.sparkSession)
    space = fit_latent_space(texts, "text")
    hasher = _hasher()
    words = lambda x: hasher.words(np.frombuffer(x.encode(), np.uint8), np.array([0]))[0]
    blocks, found = max(1, -(-own.count() // block)), None
    for k in range(blocks):
        items: list[Item] = []
        for r in own.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect():
            own_words = words(r.text)
            if len(own_words) >= max(1, min_words):
                answer = words(r.answer) if r.answer is not None and r.answer.strip() else own_words[-max(3, len(own_words) // 5) :]
                items.append(Item(r.item_id, own_words, answer))
        items.sort(key=lambda x: (x.item_id is None, x.item_id or 0, x.words.tobytes()))
        long, short = ([x for x in items if (len(x.words) >= phrase_words) == whole] for whole in (True, False))
        part, sent = _search(texts, long, short, own.schema["item_id"].dataType, space, cosine, copied, paraphrased, answered)
        if blocks > 1:
            # What one block has found is written before the driver holds the next.
            part = cut(part, "contaminated")
            sent.destroy()
        found = part if found is None else found.unionByName(part)
    return found
