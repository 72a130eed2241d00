"""Nearest neighbours, ranked search and alignment of tokenizers against plain versions."""

import hashlib
import math
import random
import re
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path[:0] = [str(Path(__file__).resolve().parent), str(Path(__file__).resolve().parents[2])]

import brute

from nucleoflow.llm import alignment, nearest, ranking
from nucleoflow.llm.queries import BYTES, PIECES, vocabulary

NULL = -(2**63)
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def rows():
    return brute.corpus() + [(900, "Größe 日本 ａｂｃ\x00zero", None, None, 1, 2, "h", None, 3), (901, "!! -- ..", None, None, 1, 2, "h", None, 3)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, brute.SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], brute.SCHEMA)


# nearest neighbours


def vectors_of(n, dim, seed, scales=False):
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((n, dim))
    return v * rng.uniform(0.5, 2, (n, 1)) if scales else v / np.linalg.norm(v, axis=1)[:, None]


def plain_neighbours(rows, best=20, every=20):
    """(query_id, vec_id, score) over the distinct rows."""
    sound = {(i, tuple(v)) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, v in sound:
        if q is None or q % every:
            continue
        for i, w in sound:
            if i != q:
                out.setdefault(q, set()).add((-sum(a * b for a, b in zip(v, w, strict=False)), NULL if i is None else i))
    return {q: sorted(s)[:best] for q, s in out.items()}


def check_neighbours(found, rows, recall):
    want = plain_neighbours(rows)
    got = {}
    for r in found:
        got.setdefault(r.query_id, []).append((r["rank"], r.score, NULL if r.vec_id is None else r.vec_id))
    assert set(got) == set(want)
    hits = 0
    plain = {}
    for i, v in rows:
        plain.setdefault(NULL if i is None else i, []).append(v)
    for q, ranked in got.items():
        ranked.sort()
        assert [r for r, _, _ in ranked] == list(range(1, len(want[q]) + 1))
        assert ranked == sorted(ranked, key=lambda r: (-r[1], r[2]))
        for _, score, i in ranked:
            assert min(abs(score - sum(a * b for a, b in zip(v, w, strict=False))) for v in plain[q] if v for w in plain[i] if w and None not in w) < 1e-12
        hits += len({i for _, _, i in ranked} & {i for _, i in want[q]})
    assert hits >= recall * sum(len({i for _, i in s}) for s in want.values())


@pytest.mark.parametrize("scales", [False, True])
def test_neighbours_recall(spark, scales):
    rows = [(i, v.tolist()) for i, v in enumerate(vectors_of(3000, 16, 3, scales))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    check_neighbours(nearest.neighbours(df).collect(), rows, 0.9)


def test_neighbours_odd_rows(spark):
    v = vectors_of(30, 4, 5)
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    rows += [(20, v[3].tolist())] + [(40, v[7].tolist())] * 60 + [(41 + i, v[7].tolist()) for i in range(60)]
    rows += [(200, None), (220, [0.0] * 4), (240, [1.0, None, 0.0, 0.0]), (260, [1.0, float("nan"), 0.0, 0.0]), (280, [1.0, float("inf"), 0.0, 0.0]), (300, [])]
    rows += [(None, v[9].tolist()), (320, [0.5, 0.5])]
    schema = "vec_id long, embedding array<double>, cell int, v string, shelf int, query int"
    df = spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], schema)
    check_neighbours(nearest.neighbours(df).collect(), rows, 1.0)
    assert nearest.neighbours(df.limit(0)).count() == 0


def test_neighbours_crowded(spark, monkeypatch):
    """Shelves dealt over several cells give the same."""
    monkeypatch.setattr(nearest, "SHELF_VECTORS", 50)
    monkeypatch.setattr(nearest, "SHELF_QUERIES", 10)
    base = vectors_of(700, 6, 8)
    rows = [(i, base[0 if i % 3 == 0 else i].tolist()) for i in range(700)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    check_neighbours(nearest.neighbours(df).collect(), rows, 0.9)


def test_walk_finds_near_lists():
    points = nearest.lengthened(vectors_of(4000, 12, 2), 1.0)
    index = nearest.fit(points, 120, 1.0)
    sizes = np.bincount(nearest.nearest_of(points, index.centres), minlength=120)
    assert sizes.max() < 5 * sizes.mean()
    point, centre, far = nearest.walk(index, points[:200], 1.2)
    d = np.sqrt(np.maximum(nearest.squares(points[:200], index.centres), 0))
    want = {(i, j) for i, j in zip(*np.nonzero(d <= 1.2 * d.min(1)[:, None]), strict=True)}
    got = set(zip(point.tolist(), centre.tolist(), strict=True))
    assert len(got & want) > 0.98 * len(want)
    assert (far[1:][point[1:] == point[:-1]] >= far[:-1][point[1:] == point[:-1]]).all()


# ranked search


def plain_ranked(items, docs, best=10):
    tokens = lambda t: [w.translate(brute.LOWER) for w in TERM.findall(t or "")]
    counted = [(NULL if i is None else i, Counter(tokens(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in counted:
            m = 10 + (90 * sum(c.values()) * n) // total
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(tokens(text)) if c[t]
            )
            if score > 0:
                scored.append((-score, i))
        out += [(item, k + 1, None if i == NULL else i, -s) for k, (s, i) in enumerate(sorted(scored)[:best])]
    return out


def some_items(rows):
    rng = random.Random(4)
    texts = [r[1] for r in rows if r[1]]
    out = [(i, " ".join(rng.choice(texts).split()[:12]).upper() if i % 2 else rng.choice(texts)[:200]) for i in range(40)]
    return out + [(50, None), (51, ""), (52, "..."), (None, "one two words"), (53, "nowhere found zzzz"), (54, "größe 日本"), (7, texts[3])]


@pytest.mark.parametrize("tiles", [None, (8, 4, 16, 60)])
def test_ranked(spark, docs, rows, empty, monkeypatch, tiles):
    if tiles:
        for name, value in zip(("DOCUMENT_TILE", "ITEM_TILE", "VOCABULARY_TILE", "PASS_TERMS"), tiles, strict=True):
            monkeypatch.setattr(ranking, name, value)
    items = some_items(rows)
    asked = spark.createDataFrame([(*r, 1, 2, 3) for r in items], "item_id long, text string, rank int, score int, doc_id int")
    found = [tuple(r) for r in ranking.ranked(asked, docs).collect()]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(found, key=key) == sorted(plain_ranked(items, [(r[0], r[1]) for r in rows]), key=key)
    if not tiles:
        assert ranking.ranked(asked, empty).count() == 0
        assert ranking.ranked(asked.limit(0), docs).count() == 0


# alignment


def plain_aligned(docs):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer, decoders

    a = Tokenizer.from_file(vocabulary(BYTES))
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=vocabulary(PIECES))
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in plain)}
    assert decoders.ByteLevel().decode(["Ġé"]) is not None
    out, corpus = [], Counter()
    for doc, text in docs:
        one = a.encode(" " + (text or ""), add_special_tokens=False)
        ids_a, bytes_a = one.ids, [bytes(byte[c] for c in t) for t in one.tokens]
        ids_b = b.encode(text or "")
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            out.append((doc, 0, 0, [], []))
            continue
        ends = lambda parts: np.cumsum([len(p) for p in parts]).tolist()
        ends_a, ends_b = ends(bytes_a), ends(bytes_b)
        groups, links, i, j = [], [], 0, 0
        for e in sorted(set(ends_a) & set(ends_b)):
            k, m = ends_a.index(e) + 1, ends_b.index(e) + 1
            groups.append((ids_a[i:k], ids_b[j:m]))
            links.append((ids_a[k - 1], ids_b[m - 1]))
            i, j = k, m
        corpus.update(links)
        out.append((doc, len(ids_a), len(ids_b), groups, links))
    most = {}
    for (_, y), n in corpus.items():
        most[y] = max(most.get(y, 0), n)
    text = lambda g: ",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1]))
    return [
        (d, x, y, len(g), len(k), sum(corpus[p] == most[p[1]] for p in k), sum(corpus[p] for p in k), hashlib.sha256(";".join(map(text, g)).encode()).hexdigest() if g else "")
        for d, x, y, g, k in out
    ]


@pytest.mark.parametrize("limit", [1 << 20, 40, 0])
def test_alignment(spark, rows, empty, limit):
    odd = [(1000, "a▁b"), (1001, "<|endoftext|> <s> </s> <0x41>"), (1002, " two  spaces \n\n\ttab "), (1003, "日本語 🤖 ﬁ é é"), (1004, "x" * 20_000), (1005, "\x00\x01")]
    rows = [(r[0], r[1]) for r in rows] + odd
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, key int, pairs int, n_best int").repartition(3)
    found = [tuple(r) for r in alignment.compared(df, vocabulary(BYTES), vocabulary(PIECES), limit).collect()]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(found, key=key) == sorted(plain_aligned(rows), key=key)
    if not limit:
        assert alignment.compared(empty, vocabulary(BYTES), vocabulary(PIECES)).count() == 0


def test_gallop():
    rng = np.random.default_rng(1)
    for n, m in ((1, 500), (300, 40), (50, 50), (0, 3), (3, 0)):
        into, drive = np.unique(rng.integers(0, 1000, m)), np.unique(rng.integers(0, 1000, n))
        start = np.searchsorted(into, drive) // 2
        assert (alignment.gallop(drive, into, start) == np.searchsorted(into, drive)).all()
