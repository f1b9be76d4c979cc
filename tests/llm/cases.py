"""Small inputs with the awkward cases, and brute-force versions of the operators."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

DOCS = "doc_id long, text string, lang string, source string, n_chars long, host string, sketch string, bucket int"


def documents(n: int = 60, seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    passage = [rng.choice(vocab) for _ in range(60)]
    rows, base = [], []
    for i in range(n):
        roll = rng.random()
        if roll < 0.35 and base:
            words = list(rng.choice(base))
            for _ in range(rng.randint(0, max(1, len(words) // 12))):
                words[rng.randrange(len(words))] = rng.choice(vocab)
        else:
            words = [rng.choice(vocab) for _ in range(rng.choice([1, 3, 5, 7, 12, 40, 130, 400]))]
            if roll > 0.7:
                words[len(words) // 2 : len(words) // 2] = passage
        base.append(words)
        sep = rng.choice([" ", "\n", "\t ", "  "])
        text = sep.join(w.upper() if rng.random() < 0.1 else w for w in words)
        rows.append(text)
    rows += ["", None, " \n\t ", "one", "One", "ÄÖ ß é日本", "a b c d", "A b c d", "x\x0by\x0cz w", rows[3], rows[3], "w " * 300, "same line\n" * 40]
    out = [(100 - i, t, rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s1", None]), None if t is None else len(t), "h", "k", 1) for i, t in enumerate(rows)]
    return out + [out[5], out[5]]


def components(rows: list[tuple], k: int = 5, percent: int = 75) -> dict:
    sets = defaultdict(list)
    for r in rows:
        w = (r[1] or "").encode().lower().split()
        sets[r[0]].append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    flat = [(d, s) for d, own in sets.items() for s in own if s]
    for i, (a, s) in enumerate(flat):
        for b, t in flat[:i]:
            both = len(s & t)
            if 100 * both >= percent * (len(s) + len(t) - both):
                x, y = find(a), find(b)
                if x != y:
                    parent[max(x, y)] = min(x, y)
    return {d: (sorted(len(s) for s in own), find(d)) for d, own in sets.items()}


def kept_words(rows: list[tuple], k: int = 20) -> Counter:
    first = {}
    for r in sorted({(r[0], r[1]) for r in rows if r[1]}):
        w = r[1].encode().split()
        for i in range(len(w) - k + 1):
            key = tuple(w[i : i + k])
            first[key] = min(first.get(key, (r[0], i)), (r[0], i))
    out = Counter()
    for r in rows:
        w = (r[1] or "").encode().split()
        gone = set()
        for i in range(len(w) - k + 1):
            if first[tuple(w[i : i + k])] < (r[0], i):
                gone.update(range(i, i + k))
        out[r[0], len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()] += 1
    return out
