"""Token-ID output: fixed-width bit packing with block offsets.

Each id takes the fewest bits that the vocabulary needs. A shard is one run of bytes:

* header: magic ``FSTK``, then little-endian uint32 width and ids per block, uint64 documents, ids, blocks
* int64 ids of the documents, uint64 end of each document (ids of this shard up to it)
* uint64 byte offset of each block within the payload, then the payload of packed blocks

Blocks hold a multiple of eight ids, so each starts at a byte and is read alone. Shards are rows of
a Parquet table (part, shard, first_doc, n_docs, n_ids, bytes): Spark's committer writes them, so lost
executors leave nothing half done and any store that Spark reaches will do. ``Shard`` reads one.

Defined cases: null text is the empty text, so its document is the end id alone; empty tables give
an empty token table; repeated ids keep one entry a row, ordered by text; null ids come first and are
stored as the least int64. Columns other than the two named ones are never read.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factsheet.llm.common import once, picked

MAGIC = b"FSTK"
HEAD = "<4sIIQQQ"
BLOCK_IDS = 1 << 13
SHARD_IDS = 1 << 18
CACHED_WORDS = 300_000
#: Characters that are encoded in one step, and new words handed to the tokenizer at once.
STEP_CHARS = 1 << 18
NEW_WORDS = 2048
NULL_ID = -(1 << 63)
TABLE = "part int, shard int, first_doc bigint, n_docs bigint, n_ids bigint, bytes binary"
#: White space that no token of the vocabulary contains and no added token crosses.
PIECE = re.compile(r"[^ \t\n\r\x0b\x0c]+")
LATIN = "a-zß-öø-ÿ"
#: Texts of these characters alone are cut further, as the tokenizer's own pattern cuts them (fixed by the vocabulary).
PLAIN = re.compile(r"[\x09-\x0d\x20-\x7eÀ-ÖØ-öø-ÿ]*")
WORD = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{LATIN}]+|[0-9]|[^ \t\n\r\x0b\x0c{LATIN}0-9]+")
#: One word of the tokenizer's pattern that its normalizer leaves alone, so that the model can take it directly.
SINGLE = re.compile(rf"[{LATIN}]+|[0-9]")
#: Code points that the byte-level step gives to the bytes 0 to 255.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTES = {b: b for b in _PRINTED} | {b: 256 + k for k, b in enumerate(sorted({*range(256)} - {*_PRINTED}))}


def bits(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids as consecutive bit fields, lowest bit first; the last group of eight is filled with zeros."""
    n = -(-len(ids) // 8) * 8
    if width == 16:
        return np.concatenate([ids.astype("<u2"), np.zeros(n - len(ids), "<u2")]).tobytes()
    group = np.zeros(n, np.uint64)
    group[: len(ids)] = ids
    group = group.reshape(-1, 8)
    out = np.zeros((len(group), width), np.uint8)
    for byte in range(width):
        value = np.zeros(len(group), np.uint64)
        for k in range(8 * byte // width, min(8, -(-8 * (byte + 1) // width))):
            shift = k * width - 8 * byte
            value |= group[:, k] << np.uint64(shift) if shift >= 0 else group[:, k] >> np.uint64(-shift)
        out[:, byte] = (value & np.uint64(255)).astype(np.uint8)
    return out.tobytes()


def unpack(data, width: int, n: int) -> np.ndarray:
    """The first n ids of packed groups."""
    if width == 16:
        return np.frombuffer(data, "<u2")[:n].astype(np.uint32)
    group = np.frombuffer(data, np.uint8).reshape(-1, width).astype(np.uint64)
    out = np.zeros((len(group), 8), np.uint64)
    for k in range(8):
        low = k * width
        for byte in range(low // 8, -(-(low + width) // 8)):
            shift = 8 * byte - low
            out[:, k] |= group[:, byte] << np.uint64(shift) if shift >= 0 else group[:, byte] >> np.uint64(-shift)
    out &= np.uint64((1 << width) - 1)
    return out.reshape(-1)[:n].astype(np.uint32)


def shard_bytes(doc_ids: list[int], ends: np.ndarray, ids: np.ndarray, width: int) -> bytes:
    blocks = [pack(ids[at : at + BLOCK_IDS], width) for at in range(0, len(ids), BLOCK_IDS)]
    offsets = np.cumsum([0] + [len(b) for b in blocks])[:-1]
    head = struct.pack(HEAD, MAGIC, width, BLOCK_IDS, len(doc_ids), len(ids), len(blocks))
    return b"".join([head, np.array(doc_ids, "<i8").tobytes(), ends.astype("<u8").tobytes(), offsets.astype("<u8").tobytes(), *blocks])


class Shard:
    """Random access to a shard: ids by range, documents by number."""

    def __init__(self, data):
        self.data = memoryview(data)
        magic, self.width, self.block, docs, self.n_ids, blocks = struct.unpack_from(HEAD, self.data)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = struct.calcsize(HEAD)
        self.doc_ids = np.frombuffer(self.data, "<i8", docs, at)
        self.ends = np.frombuffer(self.data, "<u8", docs, at + 8 * docs).astype(np.int64)
        self.offsets = np.frombuffer(self.data, "<u8", blocks, at + 16 * docs).astype(np.int64)
        self.payload = self.data[at + 16 * docs + 8 * blocks :]

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop; only the blocks that hold them are unpacked."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        end = self.offsets[last + 1] if last + 1 < len(self.offsets) else len(self.payload)
        n = min((last + 1) * self.block, self.n_ids) - first * self.block
        got = unpack(self.payload[self.offsets[first] : end], self.width, n)
        return got[start - first * self.block : stop - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


class Numbers(dict):
    """Numbers new words as they are looked up, and lists them."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number


class Encoder:
    """Ids of many texts at once.

    No token crosses the white space of PIECE, nor, in plain Latin text, the bounds of WORD; so each
    such word is encoded alone, once, and looked up afterwards. Texts with other characters, or with the
    signs that added tokens begin with, are cut at white space only. New words that the pattern and the
    normalizer leave as they are go to the model alone. The cache is emptied when it holds CACHED_WORDS words.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.clear()

    def clear(self):
        self.number = Numbers()
        self.flat, self.starts, self.sizes = np.zeros(0, np.uint16 if self.vocabulary <= 1 << 16 else np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def ids_of(self, words: list[str]) -> list[list[int]]:
        single = [SINGLE.fullmatch(w) is not None for w in words]
        others = iter(self.tokenizer.encode_batch_fast([w for w, one in zip(words, single) if not one], add_special_tokens=False))
        tokenize = self.model.tokenize
        return [[t.id for t in tokenize(w.encode().decode("latin-1").translate(BYTES))] if one else next(others).ids for w, one in zip(words, single)]

    def learn(self):
        flat, sizes = [self.flat], [self.sizes]
        new, self.number.new = self.number.new, []
        for at in range(0, len(new), NEW_WORDS):
            found = self.ids_of(new[at : at + NEW_WORDS])
            sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
            flat.append(np.fromiter(chain.from_iterable(found), self.flat.dtype, int(sizes[-1].sum())))
        self.flat, self.sizes = np.concatenate(flat), np.concatenate(sizes)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def encode(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids with the end id behind each text, and each text's end."""
        if len(self.number) > CACHED_WORDS:
            self.clear()
        split = [WORD.findall(t.lower()) if "<|" not in t and PLAIN.fullmatch(t) else PIECE.findall(t) for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        word = np.fromiter(map(self.number.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
        if self.number.new:
            self.learn()
        sizes = self.sizes[word]
        ends_in = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(counts)]
        which = np.repeat(self.starts[word] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        return np.insert(self.flat[which].astype(np.uint32), ends_in, end_id), ends_in + np.arange(1, len(texts) + 1)


def steps(lengths: list[int]):
    """Bounds of runs of about STEP_CHARS characters, from the lengths of the texts."""
    at = size = 0
    for i, length in enumerate(lengths):
        size += length
        if size >= STEP_CHARS:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(lengths):
        yield at, len(lengths)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode all documents in ascending id order and write the token table to ``path``."""
    rows = picked(docs, (doc_id, "doc_id"), (text, "text")).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def write(batches):
        encoder = once(("encoder", tokenizer), lambda: Encoder(tokenizer))
        width, part, shard = bits(encoder.vocabulary), TaskContext.get().partitionId(), 0
        names, ids, ends, size = [], [], [], 0

        def row():
            data = shard_bytes(names, np.concatenate(ends), np.concatenate(ids), width)
            columns = [[part], [shard], [names[0]], [len(names)], [size], [data]]
            types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["part", "shard", "first_doc", "n_docs", "n_ids", "bytes"])

        for batch in batches:
            keys = [NULL_ID if k is None else k for k in batch.column(0).to_pylist()]
            texts = batch.column(1)
            for at, to in steps(pc.utf8_length(texts).to_pylist()):
                got, end = encoder.encode(texts.slice(at, to - at).to_pylist(), end_id)
                names += keys[at:to]
                ids.append(got)
                ends.append(end + size)
                size += len(got)
                if size >= SHARD_IDS:
                    yield row()
                    names, ids, ends, size, shard = [], [], [], 0, shard + 1
        if names:
            yield row()

    rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(write, TABLE).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The token table; all shards of a part lie before those of the next part."""
    return spark.read.schema(TABLE).parquet(path)


def starts(shards: DataFrame) -> DataFrame:
    """(part, shard, base): ids before each shard.

    Only one total for each part, of which there are as many as the writing job had tasks, meets in the driver.
    """
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    bases, at = [], 0
    for r in totals:
        bases.append((r["part"], at))
        at += r["n"]
    spark = shards.sparkSession
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    base = F.broadcast(spark.createDataFrame(bases, "part int, part_base bigint"))
    return shards.select("part", "shard", F.coalesce(inside, F.lit(0)).alias("inside")).join(base, "part").select("part", "shard", (F.col("part_base") + F.col("inside")).alias("base"))


def document_digests(shards: DataFrame) -> DataFrame:
    """From the packed bytes, per document: doc_id, start, n_tokens, ids_crc32, shard place."""

    def read(batches):
        for batch in batches:
            for part, shard, data in zip(*(batch.column(c) for c in ("part", "shard", "bytes"))):
                s = Shard(data.as_buffer())
                ids = s.ids(0, s.n_ids).astype("<u4")
                first = np.concatenate([[0], s.ends[:-1]]).astype(np.int64)
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(first, s.ends)]
                keys = pa.array([None if k == NULL_ID else int(k) for k in s.doc_ids], pa.int64())
                n = len(s.doc_ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, part.as_py(), np.int32)), pa.array(np.full(n, shard.as_py(), np.int32)), keys, pa.array(first), pa.array(s.ends - first), pa.array(crc, pa.int64())],
                    names=["part", "shard", "doc_id", "local_start", "n_tokens", "ids_crc32"],
                )

    schema = "part int, shard int, doc_id bigint, local_start bigint, n_tokens bigint, ids_crc32 bigint"
    found = shards.select("part", "shard", "bytes").mapInArrow(read, schema)
    return found.join(starts(shards), ["part", "shard"]).select(
        "doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32", "part", "shard"
    )
