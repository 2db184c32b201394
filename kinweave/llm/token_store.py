"""Token ids in fixed-width bit-packed blocks, with random access."""

from __future__ import annotations

import gc
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinweave.llm.common import bounded_batches, cut, shared_path, shuffle_parts, text_or_empty, worker_cache
from kinweave.llm.shingles import text_pieces

#: Block: magic, width in bits, number of documents, number of ids; then for each document its identifier (int64), a
#: null mark (uint8) and, one more than documents, offsets of first ids (uint64); then the ids, width bits each, least
#: significant bit first, without gaps. All numbers are little-endian.
_HEAD = "<4sIIQ"
_MAGIC = b"KWB1"
#: low_doc and high_doc: least and greatest identifier in the block, so that a reader can skip the others.
_BLOCK_SCHEMA = "shard int, first long, block_ids long, block_docs int, low_doc long, high_doc long, payload binary"
_BLOCK_TYPE = pa.schema(
    [("shard", pa.int32()), ("first", pa.int64()), ("block_ids", pa.int64()), ("block_docs", pa.int32()), ("low_doc", pa.int64()), ("high_doc", pa.int64()), ("payload", pa.binary())]
)
_DOC_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"
#: White space for the tokenizer.
_BLANKS = " \t\n\x0b\x0c\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Texts that aren't split at single blanks: blanks next to other white space, and characters that Python's \s takes for
#: white space and the tokenizer does not.
_ODD = f"[{_BLANKS}] | [{_BLANKS}]|[\x1c-\x1f]"
#: Within Latin text: the borders inside a chunk (fixed values of byte-level BPE: contractions, letters, numbers, others).
_LATIN = "\u024f"
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zªµºÀ-ÖØ-öø-ɏ]+| ?[0-9²³¹¼½¾]+| ?[^\sA-Za-zªµºÀ-ÖØ-öø-ɏ0-9²³¹¼½¾]+|\s+(?!\S)|\s+")
#: Texts are encoded in pieces of rows of about so many bytes.
_PIECE_BYTES = 1 << 23
_MAX_CACHED, _LONGEST_CACHED = 300_000, 64


def id_width(vocabulary: int) -> int:
    """Least bits that hold every id below vocabulary."""
    return max(1, (vocabulary - 1).bit_length())


def pack_ids(ids: np.ndarray, width: int) -> bytes:
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    shifts = np.arange(width, dtype=np.uint32)
    # A multiple of 8 ids fills whole bytes, so slices can be packed one by one.
    return b"".join(np.packbits(((ids[i : i + 65_536, None].astype(np.uint32) >> shifts) & 1).astype(np.uint8).ravel(), bitorder="little").tobytes() for i in range(0, len(ids), 65_536))


def unpack_ids(packed: bytes | memoryview, width: int, start: int, stop: int) -> np.ndarray:
    """Ids start to stop; touches only the bytes that hold them."""
    if width in (8, 16, 32):
        return np.frombuffer(packed, f"<u{width // 8}", stop - start, start * width // 8).astype(np.uint32)
    first = start * width
    bits = np.unpackbits(np.frombuffer(packed, np.uint8, (stop * width + 7) // 8 - first // 8, first // 8), bitorder="little")
    bits = bits[first % 8 : first % 8 + (stop - start) * width].reshape(-1, width)
    return (bits.astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def write_block(doc_ids: list[int | None], ids: list[np.ndarray], width: int) -> bytes:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype("<u8")
    head = struct.pack(_HEAD, _MAGIC, width, len(ids), int(offsets[-1]))
    own = np.array([0 if x is None else x for x in doc_ids], "<i8").tobytes() + bytes(x is None for x in doc_ids)
    return head + own + offsets.tobytes() + pack_ids(np.concatenate(ids), width)


class Block:
    """A block's documents; ids(k) unpacks those of document k alone."""

    def __init__(self, payload: bytes):
        magic, self.width, n, self.size = struct.unpack_from(_HEAD, payload)
        if magic != _MAGIC:
            raise ValueError("not a token block")
        at = struct.calcsize(_HEAD)
        raw = np.frombuffer(payload, "<i8", n, at)
        null = np.frombuffer(payload, np.uint8, n, at + 8 * n)
        self.doc_ids = [None if m else int(x) for x, m in zip(raw, null, strict=True)]
        self.offsets = np.frombuffer(payload, "<u8", n + 1, at + 9 * n).astype(np.int64)
        self._packed = memoryview(payload)[at + 9 * n + 8 * (n + 1) :]

    def ids(self, k: int) -> np.ndarray:
        return unpack_ids(self._packed, self.width, int(self.offsets[k]), int(self.offsets[k + 1]))


class Encoder:
    """Encodes texts with a tokenizers model; ids of chunks are kept from batch to batch, within a bound.

    Byte-level BPE never joins text across the border before a blank that other characters stand around. So a text is
    split at its blanks, and each chunk (with the blank before it) has the same ids alone as in its text. A batch's
    distinct chunks are found and its ids gathered by Arrow and numpy; Python handles each distinct chunk once.
    """

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.model = self.tokenizer.model
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        pre = type(self.tokenizer.pre_tokenizer).__name__
        self.by_chunk = self.tokenizer.normalizer is None and self.tokenizer.post_processor is None and pre == "ByteLevel" and not self.tokenizer.pre_tokenizer.add_prefix_space
        # Byte-level BPE writes printable bytes as themselves and the rest as characters from U+0100 on, in order.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.bytes = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _new(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk, computed."""
        plain = [c.isascii() or max(c) <= _LATIN for c in chunks]
        parts = [_PIECE.findall(c) if p else [] for c, p in zip(chunks, plain, strict=True)]
        known = self.pieces if len(self.pieces) <= _MAX_CACHED else {}
        missing = list(set(chain.from_iterable(parts)).difference(known))
        written = "\0".join(missing).encode().decode("latin-1").translate(self.bytes).split(self.bytes[0])
        tokenize = self.model.tokenize
        # A piece with a null character in it is written alone.
        if len(written) != len(missing):
            written = [x.encode().decode("latin-1").translate(self.bytes) for x in missing]
        if missing:
            known.update(zip(missing, [array("I", [x.id for x in tokenize(w)]).tobytes() for w in written], strict=True))
        own = known.__getitem__
        out = [own(x[0]) if len(x) == 1 else b"".join(map(own, x)) for x in parts]
        for x in missing:
            if len(x) > _LONGEST_CACHED:
                del known[x]
        self.pieces = known
        other = [k for k, p in enumerate(plain) if not p]
        if other:
            for k, e in zip(other, self.tokenizer.encode_batch_fast([chunks[k] for k in other], add_special_tokens=False), strict=True):
                out[k] = array("I", e.ids).tobytes()
        return out

    def _after_blank(self, words: list[str]) -> list[bytes]:
        """The ids of each word with a blank before it; words are distinct."""
        if len(self.known) > _MAX_CACHED:
            self.known, self.older = {}, self.known
        out = list(map(self.known.get, words))
        missing = [k for k, x in enumerate(out) if x is None]
        names = [words[k] for k in missing]
        found = list(map(self.older.get, names))
        new = [j for j, x in enumerate(found) if x is None]
        for j, own in zip(new, self._new([" " + names[j] for j in new]), strict=True):
            found[j] = own
        for k, own in zip(missing, found, strict=True):
            out[k] = own
        self.known.update(zip(names, found, strict=True))
        for x in names:
            if len(x) >= _LONGEST_CACHED:
                del self.known[x]
        return out

    def encode(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        """The ids of each text. The hundreds of thousands of small lists in between hold no cycles to collect."""
        collects = gc.isenabled()
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            if collects:
                gc.enable()

    def _encode(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        odd = pc.match_substring_regex(texts, _ODD) if self.by_chunk else pa.array([True] * len(texts), pa.bool_())
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        odd = odd.to_numpy(zero_copy_only=False).astype(bool)
        out: list[np.ndarray | None] = [None] * len(texts)
        for k in np.flatnonzero(odd).tolist():
            out[k] = np.array(self.tokenizer.encode(texts[k].as_py(), add_special_tokens=False).ids, "<u4")
        plain = np.flatnonzero(~odd)
        if not len(plain):
            return out
        split = pc.split_pattern(texts.take(pa.array(plain)), " ")
        at = split.offsets.to_numpy().astype(np.int64)
        chunks = split.flatten().dictionary_encode()
        index = chunks.indices.to_numpy().copy()
        firsts = self._new(split.flatten().take(pa.array(at[:-1])).to_pylist())
        # The first chunk of a text has no blank before it, so it has an entry of its own.
        index[at[:-1]] = len(chunks.dictionary) + np.arange(len(plain), dtype=np.int32)
        ids = self._after_blank(chunks.dictionary.to_pylist()) + firsts
        ends = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) >> 2, out=ends[1:])
        lists = pa.LargeListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<u4")))
        taken = lists.take(pa.array(index))
        flat, bounds = taken.values.to_numpy(), taken.offsets.to_numpy()[at]
        for j, k in enumerate(plain.tolist()):
            out[k] = flat[bounds[j] : bounds[j + 1]]
        return out


def _encoder(tokenizer_json: str) -> Encoder:
    cache, key = worker_cache("tokenizer"), hash(tokenizer_json)
    if getattr(cache, "encoder_key", None) != key:
        cache.encoder, cache.encoder_key = Encoder(tokenizer_json), key
    return cache.encoder


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about _PIECE_BYTES: the more text at once, the fewer distinct chunks to handle."""
    waiting: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        waiting.append(batch)
        size += batch.nbytes
        if size >= _PIECE_BYTES:
            yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()
            waiting, size = [], 0
    if waiting:
        yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()


def require_whole_numbers(docs: DataFrame, id_col: str) -> None:
    kind = dict(docs.dtypes)[id_col]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"blocks hold whole numbers as identifiers, and {id_col} is of type {kind}")


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, block_ids: int = 65_536) -> None:
    """Encode whole texts, append end_id to each, and write blocks of whole documents in ascending order of identifier.

    Documents are range-partitioned by identifier, with a hash of the text as second key, and each task writes one
    shard: Parquet rows in order, one packed block each. Special tokens are not added. A null text is empty and has
    end_id alone; null identifiers come first; repeated rows are encoded each. An empty table gives no block.
    Identifiers are whole numbers; a column of another type raises a TypeError before any work.
    Memory: a batch of texts and one block.
    """
    spark = docs.sparkSession
    require_whole_numbers(docs, id_col)
    bounded_batches(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        model = spark.sparkContext.broadcast(f.read())
    from tokenizers import Tokenizer

    width = id_width(max(Tokenizer.from_str(model.value).get_vocab_size(), end_id + 1))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = _encoder(model.value), TaskContext.get().partitionId()
        end, first = np.array([end_id], "<u4"), 0
        names: list[int | None] = []
        ids: list[np.ndarray] = []

        def block() -> pa.RecordBatch:
            nonlocal first
            n = sum(map(len, ids))
            named = [x for x in names if x is not None]
            row = {"shard": [shard], "first": [first], "block_ids": [n], "block_docs": [len(ids)], "low_doc": [min(named, default=None)], "high_doc": [max(named, default=None)], "payload": [write_block(names, ids, width)]}
            first += n
            names.clear()
            ids.clear()
            return pa.RecordBatch.from_pydict(row, schema=_BLOCK_TYPE)

        waiting = 0
        for batch in _gathered(batches):
            for a, b, _, _ in text_pieces(batch.column(1), _PIECE_BYTES):
                for name, own in zip(batch.column(0).slice(a, b - a).to_pylist(), encoder.encode(batch.column(1).slice(a, b - a)), strict=True):
                    names.append(name)
                    ids.append(np.concatenate([own, end]))
                    waiting += len(own) + 1
                    if waiting >= block_ids:
                        yield block()
                        waiting = 0
        if ids:
            yield block()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("check", F.xxhash64("text"))
    ordered = rows.repartitionByRange(shuffle_parts(spark), "doc_id", "check").sortWithinPartitions("doc_id", "check").select("doc_id", "text")
    # The ids of text are hardly smaller when compressed again.
    ordered.mapInArrow(encode, _BLOCK_SCHEMA).write.option("compression", "lz4").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document doc_id, start (ids of all documents before it), n_tokens and ids_crc32, from the files alone.

    A block knows its place within its shard; shards get theirs from one row each, whose number is that of write tasks.
    """
    blocks = spark.read.schema(_BLOCK_SCHEMA).parquet(path)
    sizes = blocks.groupBy("shard").agg(F.sum("block_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = cut(sizes.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start")), "shards")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("token files")  # lets go of the tokenizer
        for batch in batches:
            for at, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                block = Block(payload.as_py())
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(block.doc_ids, pa.int64()),
                        "start": pa.array(block.offsets[:-1] + at, pa.int64()),
                        "n_tokens": pa.array(np.diff(block.offsets), pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(block.ids(k).astype("<u4").tobytes()) for k in range(len(block.doc_ids))], pa.int64()),
                    }
                )

    placed = blocks.join(F.broadcast(shards), "shard").select((F.col("shard_start") + F.col("first")).alias("at"), "payload")
    return placed.mapInArrow(decode, _DOC_SCHEMA)


def read_document_ids(spark: SparkSession, path: str, doc_id: int) -> np.ndarray:
    """Ids of one document (the first of that identifier), unpacked by random access into the block that holds it.

    Blocks whose range of identifiers leaves it out are skipped by Parquet's statistics, before their payload is read.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column(0):
                block = Block(payload.as_py())
                if doc_id in block.doc_ids:
                    yield pa.RecordBatch.from_pydict({"ids": pa.array([block.ids(block.doc_ids.index(doc_id))], pa.list_(pa.int64()))})

    blocks = spark.read.schema(_BLOCK_SCHEMA).parquet(path).filter((F.col("low_doc") <= doc_id) & (F.col("high_doc") >= doc_id))
    found = blocks.select("payload").mapInArrow(find, "ids array<long>").limit(1).collect()
    if not found:
        raise KeyError(doc_id)
    return np.array(found[0][0], np.uint32)


def tokenize_to_files(docs: DataFrame, tokenizer_path: str, path: str | None = None, **options) -> DataFrame:
    """Write the token files (by default to the shared folder) and return what read_token_files() reads back."""
    path = path or shared_path(docs.sparkSession, "tokens")
    write_token_files(docs, path, tokenizer_path, **options)
    return read_token_files(docs.sparkSession, path)
