"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, lower=False):
    text = text or ""
    return WORD.findall(text.translate(LOWER) if lower else text)


def shingles(text, n):
    w = words(text, lower=True)
    if len(w) < n:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def components(docs, n, percent):
    sets = {i: shingles(t, n) for i, t in docs}
    label = {i: i for i in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def repeats(docs, window=20):
    first = {}
    for i, t in sorted(docs):
        w = words(t)
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), (i, k))
    out = {}
    for i, t in docs:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] != (i, k):
                gone[k : k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def remainder(i, n):
    return zlib.crc32(str(i).encode()) % n


def language_model(docs, smoothing):
    """Known tokens, base score and score of each text under a trigram automaton, arc by arc."""
    a2, b2, a3, b3 = smoothing
    streams = {i: [("w", w) for w in words(t, lower=True)] + ["</s>"] for i, t in docs}
    taught = [s for i, s in streams.items() if remainder(i, 7) != 2]
    c1 = Counter(w for s in taught for w in s)
    c2 = Counter(p for s in taught for p in zip(["<s>", *s], s, strict=False))
    c3 = Counter(p for s in taught for p in zip(["<s>", *s], s, s[1:], strict=False))
    n, v = sum(c1.values()), len(c1)
    seen = {**c1, "<s>": len(taught)}
    out = {}
    for i, s in streams.items():
        base = score = 0.0
        first, state = None, "<s>"
        for w in s:
            base += math.log10((c1[w] + 1) / (n + v + 1))
            p = (c1[w] + 1) / (n + v + 1)
            h = seen.get(state, 0)
            m = a2 * max(h, 1) ** b2
            p = (c2[state, w] + m * p) / (h + m) if c2[state, w] else m / (h + m) * p
            if first is not None:
                h = c2[first, state]
                m = a3 * max(h, 1) ** b3
                p = (c3[first, state, w] + m * p) / (h + m) if c3[first, state, w] else m / (h + m) * p
            score += math.log10(p)
            first, state = state, w
        out[i] = (len(s), sum(1 for w in s if c1[w]), n, base, score)
    return out
