"""Token ids in shard files whose document boundaries are Elias-Fano coded."""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nucleoflow.llm.common import null_back, partitions, shared_folder, small, texts
from nucleoflow.session import materialize

MAGIC = b"TOKS0001"
SHARD_IDS = 1 << 21
CACHE_WORDS = 1_000_000
SELECT_STEP = 64


class EliasFano:
    """A non-decreasing sequence of n integers below u in about n * (2 + log2(u / n)) bits.

    The low bits of each value are stored as they are; the high bits are
    counted in unary. ``select`` finds the i-th set bit from a sample of every
    64th, so no table of 64-bit offsets is kept.
    """

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        self._samples: np.ndarray | None = None

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = v.size
        if not n:
            return cls(0, 0, b"", b"")
        bits = max(0, (int(v[-1]) // n).bit_length() - 1)
        low = b""
        if bits:
            shifts = np.arange(bits, dtype=np.uint64)
            low = np.packbits(((v[:, None] >> shifts) & np.uint64(1)).astype(np.uint8)).tobytes()
        places = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(places[-1]) + 1, np.uint8)
        unary[places] = 1
        return cls(n, bits, low, np.packbits(unary).tobytes())

    def _lows(self, first: int, last: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(last - first, np.uint64)
        a, b = first * self.low_bits, last * self.low_bits
        bits = np.unpackbits(np.frombuffer(self.low, np.uint8)[a // 8 : -(-b // 8)])[a % 8 : a % 8 + b - a]
        weight = np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64)
        return bits.reshape(-1, self.low_bits).astype(np.uint64) @ weight

    def select(self, i: int) -> int:
        """The i-th value."""
        high = np.frombuffer(self.high, np.uint8)
        if self._samples is None:
            ones = np.flatnonzero(np.unpackbits(high))
            self._samples = ones[::SELECT_STEP].astype(np.uint32)
        block = i // SELECT_STEP
        start = int(self._samples[block])
        stop = int(self._samples[block + 1]) if block + 1 < self._samples.size else high.size * 8 - 1
        inside = np.flatnonzero(np.unpackbits(high[start // 8 : stop // 8 + 1])) + start // 8 * 8
        place = int(inside[inside >= start][i % SELECT_STEP])
        return ((place - i) << self.low_bits) | int(self._lows(i, i + 1)[0])

    def all(self) -> np.ndarray:
        if not self.n:
            return np.zeros(0, np.uint64)
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8)))[: self.n]
        return ((ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)) | self._lows(0, self.n)

    def dump(self) -> bytes:
        return struct.pack("<QBQQ", self.n, self.low_bits, len(self.low), len(self.high)) + self.low + self.high

    @classmethod
    def load(cls, data: bytes, at: int) -> tuple[EliasFano, int]:
        n, bits, a, b = struct.unpack_from("<QBQQ", data, at)
        at += 25
        return cls(n, bits, data[at : at + a], data[at + a : at + a + b]), at + a + b


def pack_shard(doc_ids: list[int], ends: list[int], ids: list[bytes], width: int) -> bytes:
    """One shard: magic, id width, least doc_id, ids and ends in Elias-Fano form, the ids."""
    base = doc_ids[0]
    gaps = (np.array(doc_ids, np.int64).view(np.uint64) - np.array([base], np.int64).view(np.uint64)).astype(np.uint64)
    head = MAGIC + struct.pack("<Bq", width, base)
    return head + EliasFano.of(gaps).dump() + EliasFano.of(np.array(ends, np.uint64)).dump() + b"".join(ids)


def unpack_shard(data: bytes) -> tuple[np.ndarray, EliasFano, np.ndarray]:
    """(doc_ids, ends, ids) of a shard; the ids aren't copied."""
    if data[:8] != MAGIC:
        raise ValueError("not a token shard")
    width, base = struct.unpack_from("<Bq", data, 8)
    docs, at = EliasFano.load(data, 17)
    ends, at = EliasFano.load(data, at)
    doc_ids = (docs.all() + np.array([base], np.int64).view(np.uint64)).view(np.int64)
    return doc_ids, ends, np.frombuffer(data, np.uint16 if width == 2 else np.uint32, offset=at)


class WordEncoder:
    """Encodes texts with a tokenizer that treats chunks between spaces apart.

    Each new chunk is encoded once and kept. A full stop or comma after an
    ASCII letter or digit is a chunk of its own, as it is in the tokenizer.
    Where that lowers case anyway, texts of one-byte characters without special
    tokens are lowered first, so that fewer chunks differ.
    """

    _loaded: dict = {}
    _apart = re.compile(r"(?<=[A-Za-z0-9])([.,])(?=[ \n]|\Z)")
    _other = re.compile(r"[^A-Za-z0-9 \n][.,](?:[ \n]|\Z)")

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.uint32 if self.tokenizer.get_vocab_size() > 65_536 else np.uint16
        self.cache: dict[str, bytes] = {"": b""}
        upper, lower = (self.tokenizer.encode(x, add_special_tokens=False).ids for x in ("Aé É", "aé é"))
        self.lowers = upper == lower

    @classmethod
    def at(cls, path: str) -> WordEncoder:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def _chunks(self, text: str) -> list[str]:
        if self.lowers and "<|" not in text:
            try:
                text.encode("latin-1")
                text = text.lower()
            except UnicodeEncodeError:
                pass
        if self._other.search(text):
            text = self._apart.sub(r" \1", text)
        else:  # every such mark stands after a letter, digit or space
            text = f"{text} ".replace(". ", " . ").replace(", ", " , ").replace(".\n", " . ").replace(",\n", " , ")
        return text.replace("\n", " ").split(" ")

    def _learn(self, new: list[str]) -> None:
        if len(self.cache) > CACHE_WORDS:
            self.cache = {"": b""}
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            found = self.tokenizer.encode_batch_fast(part, add_special_tokens=False)
            kind = "H" if self.dtype is np.uint16 else "I"
            self.cache.update((w, array(kind, e.ids).tobytes()) for w, e in zip(part, found, strict=True))

    def encode(self, many: list[str]) -> list[bytes]:
        split = [self._chunks(t) for t in many]
        coded = [list(map(self.cache.get, words)) for words in split]
        gaps = [[i for i, c in enumerate(ids) if c is None] if None in ids else [] for ids in coded]
        self._learn(list({words[i] for words, at in zip(split, gaps, strict=True) for i in at}))
        for words, ids, at in zip(split, coded, gaps, strict=True):
            for i in at:
                ids[i] = self.cache[words[i]]
        return list(map(b"".join, coded))


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, shard_ids: int = SHARD_IDS) -> None:
    """Write the ids of every text, in ascending doc_id order, as shard files below ``path``.

    A row of the written table is one shard file's bytes with its place and its
    number of ids; a shard closes once it holds ``shard_ids`` ids. Null texts
    count as empty and get the end id alone; null ids come first; repeated ids
    stay as rows of their own. An empty table writes no shard.
    """

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = WordEncoder.at(tokenizer)
        end, width = np.array([end_id], coder.dtype).tobytes(), coder.dtype().itemsize
        part, seq, total = TaskContext.get().partitionId(), 0, 0
        doc_ids: list[int] = []
        ends: list[int] = []
        ids: list[bytes] = []

        def close() -> pa.RecordBatch:
            row = {"part": [part], "seq": [seq], "n_ids": [total], "shard": [pack_shard(doc_ids, ends, ids, width)]}
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("n_ids", pa.int64()), ("shard", pa.binary())]))

        for batch in batches:
            keys, all_texts = batch.column(0).to_pylist(), batch.column(1)
            for i in range(0, len(keys), 500):
                for key, coded in zip(keys[i : i + 500], coder.encode(all_texts.slice(i, 500).to_pylist()), strict=True):
                    ids += (coded, end)
                    total += len(coded) // width + 1
                    doc_ids.append(key)
                    ends.append(total)
                    if total >= shard_ids:
                        yield close()
                        seq, total, doc_ids, ends, ids = seq + 1, 0, [], [], []
        if doc_ids:
            yield close()

    ordered = texts(docs).repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(shards, "part long, seq long, n_ids long, shard binary").write.parquet(path)


def read_tokens(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document below ``path``; ids are little-endian unsigned 32-bit."""
    return _read(spark, path, True)


def read_digests(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document below ``path``."""
    return _read(spark, path, False)


def _read(spark, path: str, whole: bool) -> DataFrame:
    files = spark.read.parquet(path)
    inside = Window.partitionBy("part").orderBy("seq")
    sizes = files.select("part", "seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row a partition
    starts = (
        sizes.withColumn("own", F.sum("n_ids").over(inside) - F.col("n_ids"))
        .join(before, "part")
        .select("part", "seq", (F.col("own") + F.col("before")).alias("base"))
    )
    last = ("ids", pa.binary()) if whole else ("ids_crc32", pa.int64())

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, shard in zip(batch.column("base").to_pylist(), batch.column("shard"), strict=True):
                doc_ids, ends, ids = unpack_shard(shard.as_py())
                stops = ends.all().astype(np.int64)
                starts = np.concatenate([[0], stops[:-1]]).astype(np.int64)
                wide = ids.astype("<u4").data.cast("B")
                spans = [wide[4 * a : 4 * b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
                out = [bytes(x) for x in spans] if whole else [zlib.crc32(x) for x in spans]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids), pa.array(starts + base), pa.array(stops - starts), pa.array(out, last[1])],
                    names=["doc_id", "start", "n_tokens", last[0]],
                )

    kind = "ids binary" if whole else "ids_crc32 long"
    rows = files.join(small(materialize(starts)), ["part", "seq"]).select("base", "shard").mapInArrow(documents, f"doc_id long, start long, n_tokens long, {kind}")
    return rows.withColumn("doc_id", null_back("doc_id"))


def stored(docs: DataFrame, tokenizer: str, end_id: int = 2) -> str:
    """Write to a new folder among the shared ones and return it."""
    path = shared_folder(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, end_id)
    return path
