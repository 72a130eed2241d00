"""The whole pipeline against plain versions of its stages."""

import hashlib
import math
import sys
from collections import Counter, defaultdict
from pathlib import Path

sys.path[:0] = [str(Path(__file__).resolve().parent), str(Path(__file__).resolve().parents[2])]

import brute
import corpus_pipeline
import numpy as np

from nucleoflow.llm import lines, quality
from nucleoflow.llm.queries import PIECES, vocabulary


def plain_quality(rows):
    values = {}
    for k, (_, text, lang, source) in enumerate(rows):
        s = dict(zip(quality.FIELDS, quality.text_signals(text), strict=True))
        v = {m: 1000 * s[a] // s[b] if s[b] else 0 for m, (a, b, _, _) in quality.MEASURES.items()}
        values[k] = (lang, source, s, v)

    def quartiles(group, m):
        buckets = Counter(math.ceil(math.log(values[k][3][m] + 1) / math.log(quality.GAMMA) - 1e-9) for k in group)
        total, out, through = sum(buckets.values()), [], 0
        for b in sorted(buckets):
            through += buckets[b]
            while len(out) < 2 and through >= (0.25, 0.75)[len(out)] * total:
                out.append(quality.GAMMA**b - 1)
        return out

    own, per_lang, kept = defaultdict(list), defaultdict(list), []
    for k, (lang, source, _, _) in values.items():
        own[lang, source].append(k)
        per_lang[lang].append(k)
    for k, (lang, source, s, v) in values.items():
        group = own[lang, source] if len(own[lang, source]) >= quality.MIN_GROUP else per_lang[lang]
        good = s["n_words"] >= 20 and 100 * s["n_repeat_words"] <= 30 * s["n_words"]
        for m, (_, _, least, two_sided) in quality.MEASURES.items():
            q1, q3 = quartiles(group, m)
            width = max(4 * (q3 - q1), least)
            good = good and v[m] <= q3 + width and (not two_sided or v[m] >= q1 - min(width, q1 / 2))
        if good:
            kept.append(rows[k])
    return kept


def plain_lines(rows):
    first = {}
    for doc, text, _, _ in sorted(rows, key=lambda r: r[0]):
        for pos, line in enumerate((text or "").split("\n")):
            if norm := lines.normal(line):
                first.setdefault(norm, (doc, pos))
    norms = sorted(first)
    blob = np.frombuffer("\n".join(norms).encode(), np.uint8)
    starts, _, _ = lines.line_table(blob, np.array([0, blob.size]))
    _, _, sims = lines.line_hashes(blob, starts)
    groups = brute.Groups()
    for i, a in enumerate(norms):
        for j, b in enumerate(norms[:i]):
            if bin(int(sims[i]) ^ int(sims[j])).count("1") <= lines.DISTANCE and lines.within_edits(a, b):
                groups.join(a, b)
    best = {}
    for norm, place in first.items():
        g = groups.find(norm)
        best[g] = min(best.get(g, place), place)
    keep, out = set(best.values()), []
    for doc, text, lang, source in rows:
        split = (text or "").split("\n")
        left = [x for p, x in enumerate(split) if (doc, p) in keep or not x.strip(" \t\r\x0b\x0c")]
        if len(left) == len(split) or any(brute.WORD.search(x) for x in left):
            out.append((doc, "\n".join(left), lang, source))
    return out


def plain_mix(rows):
    size = {r[0]: len(brute.WORD.findall(r[1] or "")) for r in rows}
    total = Counter()
    for r in rows:
        total[r[3]] += size[r[0]]
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    full = set()
    while True:
        factor = (1.5 * sum(total.values()) - sum(2 * total[s] for s in full)) / sum(weight[s] for s in order if s not in full)
        more = {s for s in order if s not in full and factor * weight[s] > 2 * total[s]}
        if not more:
            break
        full |= more
    out = []
    for s in order:
        target = 2.0 * total[s] if s in full else factor * weight[s]
        rounds = math.floor(target / total[s])
        budget, through, edge = target - rounds * total[s], 0, False
        code = lambda r: int(hashlib.md5(f"mix:{r[0]}".encode()).hexdigest()[:15], 16)
        for r in sorted((r for r in rows if r[3] == s and size[r[0]]), key=code):
            n = size[r[0]]
            crossing = not edge and through + n > budget
            extra = 0 if edge else int(through + n - budget < budget - through) if crossing else 1
            edge = edge or crossing
            through += n
            out += [r] * (rounds + extra)
    return out


def test_pipeline(spark, tmp_path):
    import sentencepiece

    rows = [r for r in brute.corpus(90, seed=3) if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())
    spark.createDataFrame(rows, brute.SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    want = plain_quality([r[:4] for r in rows])
    want = plain_lines(want)
    near = brute.near_duplicates([(r[0], r[1]) for r in want], 5, 80)
    want = plain_mix([r for r in want if near[r[0]][2]])
    library = sentencepiece.SentencePieceProcessor(model_file=vocabulary(PIECES))
    want = Counter((r[0], r[1], tuple(library.encode(r[1] or ""))) for r in want)
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.text, tuple(r.token_ids)) for r in found) == want and want
    columns = brute.SCHEMA.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), str(tmp_path)).columns == columns
