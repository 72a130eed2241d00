"""Cross-tokenizer alignment: where two tokenizers cut the same bytes.

Each text is encoded by both. The ends of its tokens are two ascending lists;
the shorter one drives a galloping search through the longer, and the ends they
share cut the text into groups. Pairs of tokens that end together are links, and
links are counted over the corpus.

Null and empty texts, and texts whose tokens don't spell them, have no tokens:
zeros and an empty digest. Rows count as they are; rows that share a doc_id are
separate texts. An empty table gives no rows. A very long text is encoded whole
by its task, with memory in proportion to its length.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nucleoflow.llm.common import null_back, small, stored, texts
from nucleoflow.llm.hashing import byte_chunks

#: Counted pairs that are sent to every task (17 bytes each), the most frequent first; others are joined.
SENT_PAIRS = 1 << 20
#: Every so many ends, the search starts from the beginning of the text.
STRIDE = 32
#: Bytes of words whose tokens a worker remembers.
REMEMBERED = 1 << 23


class Spelled:
    """A vocabulary: the bytes of each token, and its number in decimal digits."""

    def __init__(self, spellings: list[bytes]):
        self.size = len(spellings)
        self.length, self.first, self.data = _flat(spellings)
        self.digits, self.digit_first, self.digit_data = _flat([str(i).encode() for i in range(self.size)])


def _flat(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    length = np.array([len(p) for p in parts], np.int64)
    return length, np.cumsum(length) - length, np.frombuffer(b"".join(parts), np.uint8)


def ragged(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices of runs of ``length`` from ``first``, one run after the other."""
    return np.arange(int(length.sum())) + np.repeat(first - (np.cumsum(length) - length), length)


class ByteTokenizer:
    """A byte-level BPE of the tokenizers library; special tokens in texts are plain text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        # printable Latin-1 stands for itself, the other bytes in order for U+0100 and on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in plain]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
        names = {i: t for t, i in self.model.get_vocab(with_added_tokens=True).items()}
        spelled = [names.get(i, "") for i in range(max(names) + 1)]
        self.spelled = Spelled([bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t in spelled])
        # no token reaches over a single space between visible characters
        self.parts = True

    def encode(self, texts: list[bytes]) -> list[list[int]]:
        """Ids of each text, a space before it."""
        found = self.model.encode_batch_fast([" " + t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return [e.ids for e in found]


#: Bytes with which visible characters begin: none that begins white space beyond ASCII.
_VISIBLE = np.zeros(256, bool)
_VISIBLE[33:127] = _VISIBLE[128:] = True
_BEGINS = _VISIBLE.copy()
_BEGINS[[0xC2, 0xE1, 0xE2, 0xE3]] = False


def word_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where a text begins or a word after a single space does, and which are of the second kind.

    The characters beside the space are visible for sure; where UTF-8 leaves a
    doubt, the space parts nothing. No text may be empty.
    """
    edge = np.zeros(data.size + 1, bool)
    edge[offsets] = True
    space = np.flatnonzero(data == 32)
    space = space[~edge[space] & ~edge[space + 1]]
    one, two, three = (data[np.maximum(space - k, 0)] for k in (1, 2, 3))
    doubtful = (one > 127) & ((two == 0xC2) | ((three >= 0xE1) & (three <= 0xE3)))
    space = space[_VISIBLE[one] & ~doubtful & _BEGINS[data[space + 1]]]
    starts = np.concatenate([offsets[:-1], space + 1])
    order = np.argsort(starts, kind="stable")
    return starts[order], (order >= offsets.size - 1)


class PieceTokenizer:
    """A SentencePiece model; it puts the space before the text itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        pieces = [(self.model.id_to_piece(i), self.model.is_byte(i)) for i in range(self.model.get_piece_size())]
        self.spelled = Spelled([bytes([int(p[3:5], 16)]) if byte else p.replace("▁", " ").encode() for p, byte in pieces])
        self.parts = _parts_words(self.model)

    def encode(self, texts: list[bytes]) -> list[list[int]]:
        """Ids of each text, a space before it."""
        return self.model.encode([t.decode("utf-8", "replace") for t in texts], num_threads=1)


def _parts_words(model) -> bool:
    """Whether a SentencePiece model encodes what lies between spaces by itself: merges of text as it is, none of which takes a space behind a character."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(model.serialized_model_proto())
    rules, bpe = proto.normalizer_spec, sentencepiece_model_pb2.TrainerSpec.BPE
    plain = rules.add_dummy_prefix and rules.escape_whitespaces and not (rules.precompiled_charsmap or rules.remove_extra_whitespaces)
    inside = (i for i, p in enumerate(proto.pieces) if "▁" in p.piece.lstrip("▁") or p.type == p.USER_DEFINED)
    return bool(plain and proto.trainer_spec.model_type == bpe and not proto.trainer_spec.treat_whitespace_as_suffix and next(inside, None) is None)


class Words:
    """Both encodings of the words that a worker has met lately.

    What lies between single spaces beside visible characters is encoded once
    and remembered, by each tokenizer that takes such words by themselves.
    """

    def __init__(self, *tokenizers: ByteTokenizer | PieceTokenizer):
        self.tokenizers = tokenizers
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.held = 0
        self.tables = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in self.tokenizers]

    def _learn(self, words: list[bytes]) -> None:
        for k, tokenizer in enumerate(self.tokenizers):
            if tokenizer.parts:
                ids, n = encoded_words(tokenizer, words)
                flat, count = self.tables[k]
                self.tables[k] = np.append(flat, ids), np.append(count, n)
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words)), strict=True))
        self.held += sum(map(len, words))

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each tokenizer (ids of all texts in ``data``, number of each text's), each with a space before it."""
        starts, inner = word_starts(data, offsets)
        kept = np.ones(data.size, bool)
        kept[starts[inner] - 1] = False  # the spaces between words
        edges = np.append(starts - np.cumsum(inner), data.size - int(inner.sum()))
        packed = pa.Array.from_buffers(pa.large_binary(), starts.size, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(data[kept])])
        coded = packed.dictionary_encode()
        words = coded.dictionary.to_pylist()
        new = [w for w in words if w not in self.known]
        if self.held + sum(map(len, new)) > REMEMBERED or len(self.known) + len(new) > REMEMBERED // 32:
            self._forget()
            new = words
        if new:
            self._learn(new)
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))[coded.indices.to_numpy()]
        firsts, raw = np.flatnonzero(~inner), None
        out = []
        for tokenizer, (flat, count) in zip(self.tokenizers, self.tables, strict=True):
            if tokenizer.parts:
                n = count[at]
                out.append((flat[ragged((np.cumsum(count) - count)[at], n)], np.add.reduceat(n, firsts) if n.size else n))
            else:
                raw = data.tobytes() if raw is None else raw
                out.append(_flat_ids(tokenizer.encode([raw[i:j] for i, j in pairwise(offsets.tolist())])))
        return out


def _flat_ids(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(x) for x in lists], np.int64)
    return np.fromiter(chain.from_iterable(lists), np.int64, int(n.sum())), n


#: Bytes of words that are encoded as one text.
LINE = 1 << 12


def encoded_words(tokenizer: ByteTokenizer | PieceTokenizer, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words, number of each word's).

    Words that begin and end with characters sure to be visible are encoded in
    lines of many and told apart by the bytes their tokens spell, others one by one.
    """
    length = np.array([len(w) for w in words], np.int64)
    first = np.cumsum(length + 1) - length - 1
    joined = np.frombuffer(b" ".join(words), np.uint8)
    apart = np.zeros(joined.size + 2, bool)
    apart[word_starts(joined, np.array([0, joined.size]))[0]] = True
    apart[0] = False
    sure = apart[first] & apart[first + length + 1]
    lined = np.flatnonzero(sure)
    line = np.cumsum(length[lined] + 1) // LINE
    cuts = np.append(np.flatnonzero(np.diff(line, prepend=-1)), lined.size).tolist()
    chosen = [words[k] for k in lined.tolist()]
    ids, _ = _flat_ids(tokenizer.encode([b" ".join(chosen[i:j]) for i, j in pairwise(cuts)]))
    ends, want = np.cumsum(tokenizer.spelled.length[ids]), np.cumsum(length[lined] + 1)
    last = np.searchsorted(ends, want)
    if lined.size and (last[-1] != ids.size - 1 or (ends[last] != want).any()):  # a token that doesn't spell its bytes
        return _flat_ids(tokenizer.encode(words))
    alone = np.flatnonzero(~sure)
    more, n_more = _flat_ids(tokenizer.encode([words[k] for k in alone.tolist()]))
    n = np.empty(len(words), np.int64)
    n[lined], n[alone] = np.diff(last, prepend=-1), n_more
    # ids in the order of the words
    begin = np.empty(len(words), np.int64)
    begin[lined], begin[alone] = np.cumsum(n[lined]) - n[lined], ids.size + np.cumsum(n_more) - n_more
    return np.append(ids, more)[ragged(begin, n)], n


def gallop(drive: np.ndarray, into: np.ndarray, start: np.ndarray) -> np.ndarray:
    """First place in ``into``, from ``start`` on, whose value isn't below ``drive``: doubling steps, then bisection."""
    low, high = start.copy(), start.copy()
    open_, step = np.arange(drive.size), 1
    while open_.size:
        at = high[open_]
        below = at < into.size
        below[below] = into[at[below]] < drive[open_[below]]
        open_ = open_[below]
        low[open_] = high[open_] + 1
        high[open_] += step
        step *= 2
    high = np.minimum(high, into.size)
    open_ = np.flatnonzero(low < high)
    while open_.size:
        middle = (low[open_] + high[open_]) // 2
        below = into[middle] < drive[open_]
        low[open_[below]] = middle[below] + 1
        high[open_[~below]] = middle[~below]
        open_ = open_[low[open_] < high[open_]]
    return low


def common_ends(a: np.ndarray, a_first: np.ndarray, b: np.ndarray, b_first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and in ``b`` of the values both have.

    Both ascend over all texts; ``*_first`` are the places where texts begin, and the end.
    """
    n_a, n_b = np.diff(a_first), np.diff(b_first)
    found = []
    for shorter, (x, x_first, n), (y, y_first, _) in (
        (n_a <= n_b, (a, a_first, n_a), (b, b_first, n_b)),
        (n_a > n_b, (b, b_first, n_b), (a, a_first, n_a)),
    ):
        text = np.flatnonzero(shorter & (n > 0))
        length = n[text]
        place = ragged(x_first[:-1][text], length)
        within = place - np.repeat(x_first[:-1][text], length)
        drive = x[place]
        coarse = np.flatnonzero(within % STRIDE == 0)
        begin = np.repeat(y_first[:-1][text], length)[coarse]
        begin = gallop(drive[coarse], y, begin)
        at = gallop(drive, y, np.repeat(begin, np.diff(np.append(coarse, drive.size))))
        same = at < y.size
        same[same] = y[at[same]] == drive[same]
        found.append((place[same], at[same]))
    (a1, b1), (b2, a2) = found
    a_at, b_at = np.concatenate([a1, a2]), np.concatenate([b1, b2])
    order = np.argsort(a_at, kind="stable")
    return a_at[order], b_at[order]


def _spelling(spelled: Spelled, ids: np.ndarray, n: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts the tokens spell, a space before them."""
    length = spelled.length[ids]
    total = np.bincount(np.repeat(np.arange(n.size), n), length, n.size).astype(np.int64)
    fits = total == np.diff(offsets) + 1
    held = np.repeat(fits, n)
    made = spelled.data[ragged(spelled.first[ids[held]], length[held])]
    text = np.flatnonzero(fits)
    size = total[text]
    first = np.cumsum(size) - size
    want = np.full(made.size, 32, np.uint8)
    inner = ragged(first + 1, size - 1)
    want[inner] = data[ragged(offsets[:-1][text], size - 1)]
    wrong = np.add.reduceat(made != want, first) if first.size else first
    fits[text[wrong > 0]] = False
    return fits


def aligned(words: Words, data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray | list]:
    """Per text in ``data``: n_a, n_b, n_groups, n_links, digest; and per text and pair of linked ids: row, pair, times."""
    rows = offsets.size - 1
    full = np.flatnonzero(np.diff(offsets))
    # empty texts hold no bytes, so the rest lies without gaps
    here = data, np.append(0, np.cumsum(np.diff(offsets)[full]))
    a, b = words.tokenizers
    (ids_a, n_a), (ids_b, n_b) = words.ids(*here)
    good = _spelling(a.spelled, ids_a, n_a, *here) & _spelling(b.spelled, ids_b, n_b, *here)
    ids_a, ids_b = ids_a[np.repeat(good, n_a)], ids_b[np.repeat(good, n_b)]
    full, n_a, n_b = full[good], n_a[good], n_b[good]
    ends_a, ends_b = np.cumsum(a.spelled.length[ids_a]), np.cumsum(b.spelled.length[ids_b])
    first_a, first_b = np.append(0, np.cumsum(n_a)), np.append(0, np.cumsum(n_b))
    at_a, at_b = common_ends(ends_a, first_a, ends_b, first_b)
    # each common end closes a group; the last tokens of its two sides are linked
    group_first = np.append(0, np.searchsorted(at_a, first_a[1:], "left"))
    n_groups = np.diff(group_first)
    text = np.repeat(np.arange(full.size), n_groups)
    base = np.int64(b.spelled.size)
    width = np.int64(a.spelled.size) * base
    key = np.sort(text * width + ids_a[at_a] * base + ids_b[at_b])
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: key.size])
    row, pair = np.divmod(key[new], width)
    out = {k: np.zeros(rows, np.int64) for k in ("n_a", "n_b", "n_groups")}
    out["n_a"][full], out["n_b"][full], out["n_groups"][full] = n_a, n_b, n_groups
    digests = [""] * rows
    for i, d in zip(full.tolist(), _digests(a, b, ids_a, first_a, ids_b, first_b, at_a, at_b, group_first), strict=True):
        digests[i] = d
    times = np.diff(np.append(new, key.size))
    return out | {"digest": digests, "row": full[row], "a": pair // base, "b": pair % base, "times": times}


def _digests(a, b, ids_a, first_a, ids_b, first_b, at_a, at_b, group_first) -> Iterator[str]:
    """Digest of each text's groups: the tokens of both sides in order of group and side, as decimal text."""
    group_a = np.searchsorted(at_a, np.arange(ids_a.size))
    group_b = np.searchsorted(at_b, np.arange(ids_b.size))
    end_a, end_b = np.append(0, at_a + 1), np.append(0, at_b + 1)  # tokens up to each group
    place_a = np.arange(ids_a.size) + end_b[group_a]
    place_b = np.arange(ids_b.size) + end_a[group_b + 1]
    total = ids_a.size + ids_b.size
    length, first = np.empty(total, np.int64), np.empty(total, np.int64)
    mark = np.full(total, ord(","), np.uint8)
    length[place_a], length[place_b] = a.spelled.digits[ids_a], b.spelled.digits[ids_b]
    first[place_a], first[place_b] = a.spelled.digit_first[ids_a], b.spelled.digit_first[ids_b] + a.spelled.digit_data.size
    mark[place_a[at_a]], mark[place_b[at_b]] = ord("|"), ord(";")
    data = np.append(a.spelled.digit_data, b.spelled.digit_data)
    ends = np.cumsum(length + 1)
    out = np.empty(int(ends[-1]) if total else 0, np.uint8)
    out[ragged(ends - length - 1, length)] = data[ragged(first, length)]
    out[ends - 1] = mark
    for t in range(first_a.size - 1):
        x, y = first_a[t] + first_b[t], first_a[t + 1] + first_b[t + 1]
        yield hashlib.sha256(out[ends[x - 1] if x else 0 : ends[y - 1] - 1].tobytes()).hexdigest()


_SCHEMA = "doc_id long, key long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<struct<a:int,b:int,times:int>>"


def encoded(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Both encodings of every text, aligned: sizes, digest and the linked pairs of ids with their numbers.

    ``key`` numbers the rows; it is fixed once the table is written.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(ByteTokenizer(path_a), PieceTokenizer(path_b))
        key = TaskContext.get().partitionId() << 33
        for batch in batches:
            for first, data, offsets in byte_chunks(batch.column(1)):
                rows = offsets.size - 1
                got = aligned(words, data, offsets)
                ends = np.append(0, np.searchsorted(got["row"], np.arange(rows), "right"))
                pairs = pa.StructArray.from_arrays([pa.array(got[k], pa.int32()) for k in ("a", "b", "times")], names=["a", "b", "times"])
                columns = [batch.column(0).slice(first, rows), pa.array(key + np.arange(rows))]
                columns += [pa.array(got[k]) for k in ("n_a", "n_b", "n_groups")] + [pa.array(got["digest"], pa.string())]
                columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs))
                key += rows
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", "n_a", "n_b", "n_groups", "groups_sha256", "pairs"])

    return texts(docs).mapInArrow(run, _SCHEMA)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(a, b, count, best): links of each pair in the corpus, and whether no other pair of its b has more."""
    counts = stored(rows.select(F.inline("pairs")).groupBy("a", "b").agg(F.sum("times").alias("count")), "pair-counts")
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(small(stored(most, "pair-most")), "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def _frequent(counts: DataFrame, limit: int) -> tuple[DataFrame, DataFrame | None]:
    """The most frequent pairs, at most ``limit`` of them, and the others if any.

    Cut at a power of two, so a histogram of 64 rows decides.
    """
    level = F.floor(F.log2("count")).cast("int")
    sizes = {r.level: r["count"] for r in counts.groupBy(level.alias("level")).count().collect()}
    total, least = 0, 64
    for k in sorted(sizes, reverse=True):
        if total + sizes[k] > limit:
            return counts.where(level >= least), counts.where(level < least)
        total, least = total + sizes[k], k
    return counts, None


def with_counts(rows: DataFrame, counts: DataFrame, limit: int = SENT_PAIRS) -> DataFrame:
    """``rows`` of ``encoded`` without pairs, but with n_best and count_sum.

    Frequent pairs are sent to the tasks; the rest, each in few documents, are joined.
    """
    frequent, others = _frequent(counts, limit)
    table = frequent.toArrow()
    code = table.column("a").to_numpy().astype(np.int64) << 32 | table.column("b").to_numpy()
    order = np.argsort(code)
    shared = rows.sparkSession.sparkContext.broadcast((code[order], table.column("count").to_numpy()[order], table.column("best").to_numpy()[order]))
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, count, best = shared.value
        for batch in batches:
            lists = batch.column(names.index("pairs"))
            at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            pairs = lists.flatten()
            a, b, times = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in pairs.flatten())
            row = np.repeat(np.arange(at.size - 1), np.diff(at))
            want = a << 32 | b
            place = np.minimum(np.searchsorted(code, want), max(code.size - 1, 0))
            hit = code[place] == want if code.size else np.zeros(want.size, bool)
            n_best, total = np.zeros(at.size - 1, np.int64), np.zeros(at.size - 1, np.int64)
            place, times = place[hit], times[hit]
            np.add.at(n_best, row[hit], times * best[place])
            np.add.at(total, row[hit], times * count[place])
            ends = np.append(0, np.searchsorted(row[~hit], np.arange(at.size - 1), "right"))
            rest = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs.filter(pa.array(~hit)))
            columns = [rest if n == "pairs" else batch.column(i) for i, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_best), pa.array(total)], names=[*names, "n_best", "count_sum"])

    found = rows.mapInArrow(run, _SCHEMA + ", n_best long, count_sum long")
    if others is None:
        return found.drop("pairs")
    found = stored(found, "pair-sums")
    joined = found.select("key", F.inline("pairs")).join(others, ["a", "b"])
    best = F.when(F.col("best"), F.col("times")).otherwise(0)
    more = joined.groupBy("key").agg(F.sum(best).alias("more_best"), F.sum(F.col("times") * F.col("count")).alias("more_sum"))
    added = [(F.col(n) + F.coalesce(m, F.lit(0))).alias(n) for n, m in (("n_best", "more_best"), ("count_sum", "more_sum"))]
    return found.drop("pairs").join(more, "key", "left").select(*[c for c in names if c != "pairs"], *added)


def compared(docs: DataFrame, path_a: str, path_b: str, limit: int = SENT_PAIRS) -> DataFrame:
    """Per row doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    rows = stored(encoded(docs, path_a, path_b), "alignment")
    found = with_counts(rows, stored(pair_counts(rows), "pairs"), limit)
    return found.select(
        null_back("doc_id").alias("doc_id"), "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256"
    )
