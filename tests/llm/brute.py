"""Plain versions of the corpus operators, and small corpora for them."""

import hashlib
import random
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, hash string, keep string, _row int"


def corpus(n=60, seed=0):
    """Rows with copies, near copies, shared passages, nulls, empty and odd texts, a repeated row."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(300)]
    sentence = lambda k: " ".join(rng.choices(vocabulary, k=k)).capitalize() + rng.choice([".", ".", "!"])
    passage = sentence(40)
    rows = []
    for i in range(n):
        kind = rng.random()
        if rows and kind < 0.15:
            text = rng.choice(rows)[1]
        elif rows and kind < 0.35 and (base := rng.choice(rows)[1]):
            words = base.split(" ")
            for _ in range(rng.randint(1, 3)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            text = " ".join(words)
        else:
            text = "\n".join(sentence(rng.randint(4, 40)) for _ in range(rng.randint(1, 5)))
            if kind > 0.85:
                text += "\n" + passage + ("" if kind > 0.9 else " Straße é 日本")
        rows.append((i, text))
    rows += [(n, None), (n + 1, ""), (n + 2, "  \n\t "), (n + 3, "one"), (n + 4, "Two words"), (None, "a text without id " * 6)]
    rows += [(n + 5, rows[3][1]), (n + 5, rows[3][1]), (n + 6, "y " * 4000 + "end"), (n + 7, "\n".join(["same line here"] * 5))]
    out = []
    for i, (doc, text) in enumerate(rows):
        source = None if i % 11 == 10 else f"s{i % 4 if i % 3 else 0}"
        out.append((doc, text, None if i % 13 == 12 else "en", source, len(text or ""), -i, "h", None, i))
    rng.shuffle(out)
    return out


class Groups:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def shingle_set(text, size):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def near_duplicates(rows, size=3, percent=85):
    sets, groups, holders = {}, Groups(), defaultdict(set)
    for doc, text in rows:
        sets[doc] = shingle_set(text, size)
    for doc, found in sets.items():
        for x in found:
            holders[x].add(doc)
    for a, found in sets.items():
        for b in {d for x in found for d in holders[x] if d > a}:
            k = len(found & sets[b])
            if 100 * k >= percent * (len(found) + len(sets[b]) - k):
                groups.join(a, b)
    return {d: (len(s), groups.find(d), groups.find(d) == d) for d, s in sets.items()}


def removed_runs(rows, least=50):
    first, out = {}, {}
    for doc, text in sorted(rows):
        raw = (text or "").encode()
        mask, mine = bytearray(len(raw)), []
        for s in range(len(raw) - least + 1):
            w = raw[s : s + least]
            if first.get(w, doc) < doc:
                mask[s : s + least] = b"\1" * least
            else:
                mine.append(w)
        for w in mine:
            first.setdefault(w, doc)
        kept = bytes(c for c, m in zip(raw, mask, strict=True) if not m)
        spans = sum(1 for k in range(len(mask)) if mask[k] and not (k and mask[k - 1]))
        out[doc] = (len(raw), sum(mask), spans, hashlib.sha256(kept).hexdigest())
    return out


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def repeat_words(text):
    words = WORD.findall(text or "")
    seen = defaultdict(list)
    for i in range(len(words) - 7):
        seen[tuple(words[i : i + 8])].append(i)
    return len({k for at in seen.values() if len(at) > 1 for i in at for k in range(i, i + 8)})


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def personal(text):
    out = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                "card": 14 <= len(digits) <= 19 and luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), order, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))
