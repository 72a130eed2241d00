"""SentencePiece encoding as a shortest path through a weighted transducer, and decoding."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from nucleoflow.llm.common import fresh, null_back, texts

SPACE = "▁"
LETTER = "[A-Za-zÀ-ÖØ-öø-ÿ]"
#: Entries of a worker's caches: segments, and boundaries between pieces. About 200 MB in all.
CACHE_SEGMENTS, CACHE_BOUNDARIES = 400_000, 300_000
#: Piece types of the model format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of one protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else 4 if kind == 5 else 8
        yield key >> 3, data[at : at + size]
        at += size


class Transducer:
    """Text to piece ids.

    Three machines are compiled from a model: the normaliser (a space becomes
    the mark, a mark is put first), the pieces with their scores, and byte
    fallback for characters without a piece. A state of their composition with
    an input is (place, last piece); an arc reads the letters of one piece. In a
    model of merge order the weight of an arc is 0 if the merges would leave the
    boundary between the two pieces, else infinite; a boundary holds exactly if
    the two pieces joined are split into the same two, so weights need only the
    last piece. Every place then has one state of finite distance, and the
    shortest path is the model's own segmentation. In a unigram model the weight
    of an arc is minus the piece's score.
    """

    _compiled: dict[str, Transducer] = {}

    def __init__(self, model: bytes):
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.text: list[str] = []
        self.kind: list[int] = []
        self.bytes: dict[int, int] = {}
        self.unigram, self.prefix, self.squeeze, charsmap = True, True, True, b""
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                text, kind = piece[1].decode("utf-8"), piece.get(3, NORMAL)
                if kind == BYTE:
                    self.bytes[int(text[3:5], 16)] = len(self.text)
                elif kind in (NORMAL, USER):
                    self.ids[text] = len(self.text)
                    self.score[text] = float(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0])
                elif kind == UNKNOWN:
                    self.unknown = len(self.text)
                self.text.append(text)
                self.kind.append(kind)
            elif number == 2:
                self.unigram = dict(_fields(value)).get(3, 1) == 1
            elif number == 3:
                norm = dict(_fields(value))
                charsmap = norm.get(2, b"")
                self.prefix, self.squeeze = bool(norm.get(3, 1)), bool(norm.get(4, 1))
        if charsmap or any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("only identity normalisers and pieces with leading marks are compiled")
        self.longest = max(map(len, self.ids))
        self.holds: dict[tuple[str, str], bool] = {}
        self.cache: dict[str, bytes] = {}
        # No piece holds a letter and then one of these marks, or a line break: no merge crosses there.
        met = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        marks = "".join(c for c in ".,;:!?" if not any(re.match(LETTER, x[0]) for x in met if x[1] == c))
        first = rf"{SPACE}*{LETTER}+(?=[{re.escape(marks)}])|" if marks else ""
        line = "" if any("\n" in x for x in met) else "\n"
        self.segments = re.compile(rf"{first}{line and 'LINE|'}{SPACE}*[^{SPACE}{line}]+|{SPACE}+".replace("LINE", line))

    @classmethod
    def of(cls, model: bytes) -> Transducer:
        key = hashlib.sha256(model).hexdigest()
        if key not in cls._compiled:
            cls._compiled[key] = cls(model)
        return cls._compiled[key]

    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        marked = text.replace(" ", SPACE)
        return SPACE + marked if self.prefix and marked else marked

    def merged(self, text: str) -> list[str]:
        """Pieces after merging, best score first, leftmost among equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, place = -np.inf, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and s > best:
                    best, place = s, k
            if place < 0:
                break
            parts[place : place + 2] = [parts[place] + parts[place + 1]]
        return parts

    def weight(self, last: str, piece: str) -> float:
        if self.unigram:
            return -self.score.get(piece, -1e6)
        key = (last, piece)
        if key not in self.holds:
            self.holds[key] = self.merged(last + piece) == ([last, piece] if last else [piece])
        return 0.0 if self.holds[key] else np.inf

    def path(self, segment: str) -> bytes:
        """Ids along the shortest path over one segment, as unsigned 32-bit integers."""
        out: list[int] = []
        for piece in self._least(segment) if self.unigram else self._unbroken(segment):
            if piece in self.ids:
                out.append(self.ids[piece])
            elif self.bytes:
                out += [self.bytes[b] for b in piece.encode("utf-8", "surrogatepass")]
            else:
                out.append(self.unknown)
        return np.array(out, np.uint32).tobytes()

    def _least(self, segment: str) -> list[str]:
        n, known = len(segment), self.ids
        dist, back = [0.0] + [np.inf] * n, [0] * (n + 1)
        for j in range(1, n + 1):
            for i in range(max(0, j - self.longest), j):
                if segment[i:j] in known or j - i == 1:
                    d = dist[i] + self.weight("", segment[i:j])
                    if d < dist[j]:
                        dist[j], back[j] = d, i
        out, j = [], n
        while j:
            out.append(segment[back[j] : j])
            j = back[j]
        return out[::-1]

    def _unbroken(self, segment: str) -> list[str]:
        """The path of weight 0. A place that one piece reaches at weight 0 is reached by no other piece, so a dead end is left for good."""
        n, known, holds = len(segment), self.ids, self.holds
        dead = [False] * (n + 1)
        path: list[str] = []
        i, last, size = 0, "", min(self.longest, n)
        while i < n:
            while size:
                piece = segment[i : i + size]
                if (size == 1 or piece in known) and not dead[i + size]:
                    hold = holds.get((last, piece))
                    if hold or (hold is None and not self.weight(last, piece)):
                        break
                size -= 1
            if size:
                path.append(piece)
                i, last = i + size, piece
                size = min(self.longest, n - i)
            else:
                dead[i] = True
                i, size = i - len(last), len(last) - 1
                path.pop()
                last = path[-1] if path else ""
        return path

    def encode(self, text: str) -> bytes:
        segments = self.segments.findall(self.normalise(text))
        ids = list(map(self.cache.get, segments))
        if None in ids:
            cache = self.cache
            if len(cache) >= CACHE_SEGMENTS:
                cache.clear()
            if len(self.holds) >= CACHE_BOUNDARIES:
                self.holds.clear()
            for k, found in enumerate(ids):
                if found is None:
                    segment = segments[k]
                    if segment not in cache:
                        cache[segment] = self.path(segment)
                    ids[k] = cache[segment]
        return b"".join(ids)

    def decode(self, ids: np.ndarray) -> str:
        if not hasattr(self, "_raw"):
            self._raw = [
                bytes([int(t[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else t.replace(SPACE, " ").encode() for t, k in zip(self.text, self.kind, strict=True)
            ]
        raw = b"".join(map(self._raw.__getitem__, ids.tolist()))
        return raw.removeprefix(b" ").decode("utf-8", "replace") if self.prefix else raw.decode("utf-8", "replace")


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encoded(docs: DataFrame, model: bytes) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, decoded_sha256, round_trip) of every row.

    Null texts count as empty and have no ids. ids_crc32 is over little-endian
    unsigned 32-bit ids. round_trip says whether decoding gives the text back;
    it can't where the text has the mark itself. Equal rows give equal results;
    an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Transducer.of(model)
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                rows = []
                for text in part.column(1).to_pylist():
                    ids = machine.encode(text)
                    back = machine.decode(np.frombuffer(ids, np.uint32))
                    digest = hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest()
                    rows.append((len(ids) // 4, zlib.crc32(ids), digest, back == text))
                n, crc, sha, same = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(sha), pa.array(same)],
                    names=["doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "round_trip"],
                )

    kinds = "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string, round_trip boolean"
    return texts(docs).mapInArrow(run, kinds).withColumn("doc_id", null_back("doc_id"))


def with_ids(docs: DataFrame, model: bytes, name: str = "token_ids") -> DataFrame:
    """``docs`` with the ids of their texts as an array column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Transducer.of(model)
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                coded = [machine.encode(t or "") for t in part.column(text_at).to_pylist()]
                ends = np.concatenate([[0], np.cumsum([len(c) // 4 for c in coded])]).astype(np.int32)
                ids = pa.array(np.frombuffer(b"".join(coded), np.int32))
                columns = [*part.columns, pa.ListArray.from_arrays(pa.array(ends), ids)]
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, name])

    name = fresh(docs, name)
    docs = docs.withColumn("text", F.col("text").cast("string"))
    text_at = [c.lower() for c in docs.columns].index("text")
    schema = StructType([*docs.schema.fields, StructField(name, ArrayType(IntegerType()))])
    return docs.mapInArrow(run, schema)
