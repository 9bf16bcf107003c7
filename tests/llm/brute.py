"""Brute-force versions of the operators, over plain Python rows."""

import hashlib
import re
from collections import Counter, defaultdict

SPACE = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def grams(text, k):
    w = WORD.findall(lower(text or ""))
    if not w:
        return frozenset()
    if len(w) < k:
        return frozenset([tuple(w)])
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def jaccard_join(rows, k, percent):
    """rows (doc_id, text) with distinct ids -> {doc_id: (n, component)}; candidates share a gram."""
    sets = {d: grams(t, k) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    by = defaultdict(list)
    for d, s in sets.items():
        by[s].append(d)
    reps = {}
    for s, ds in by.items():
        if s:
            reps[min(ds)] = s
            for d in ds:
                parent[d] = min(ds)
    post = defaultdict(list)
    for d in sorted(reps):
        seen = Counter(o for g in reps[d] for o in post[g])
        for o, n in seen.items():
            if 100 * n >= percent * (len(reps[d]) + len(reps[o]) - n):
                a, b = sorted((find(d), find(o)))
                parent[b] = a
        for g in reps[d]:
            post[g].append(d)
    return {d: (len(sets[d]), find(d)) for d in sets}


def suffix_dedup(texts, length):
    """list of texts -> list of (n_bytes, n_removed, n_spans, sha256 of what is kept)."""
    raw = [(t or "").encode() for t in texts]
    count = Counter(hashlib.blake2b(r[i : i + length], digest_size=12).digest() for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if count[hashlib.blake2b(r[i : i + length], digest_size=12).digest()] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(r, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(r), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def base_features(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    win = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = set()
    for i in range(len(w) - 7):
        if win[tuple(w[i : i + 8])] > 1:
            hit |= set(range(i, i + 8))
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit))


def targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """{source: size} -> {source: target}: cap, reshare, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        lam = left / sum(w[s] for s in open_)
        over = {s for s in open_ if lam * w[s] >= cap * sizes[s]}
        if not over:
            return out | {s: lam * w[s] for s in open_}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def best_fit_cost(sizes, capacities, costs):
    """The least cost of best-fit decreasing over every way to choose the length that a bin is opened at by the smallest that holds its first piece."""
    import itertools

    cost, best = dict(zip(capacities, costs)), None
    fits = lambda n: [c for c in capacities if c >= n]
    for pick in itertools.product(*[fits(c) for c in capacities]):
        opened, bins = dict(zip(capacities, pick)), []
        for s in sorted(sizes, reverse=True):
            open_ = [b for b in bins if b[0] - b[1] >= s]
            if open_:
                min(open_, key=lambda b: b[0] - b[1])[1] += s
            else:
                bins.append([opened[fits(s)[0]], s])
        paid = sum(cost[fits(b[1])[0]] for b in bins)
        best = paid if best is None else min(best, paid)
    return best


def license_scores(texts, templates, threshold=0.6):
    """texts -> (name, score) of the best (name, template) pair over every line and the whole text, without any filter; (None, None) under the threshold."""
    import math

    tok = lambda t: [x for x in re.split("[^a-z0-9]+", (t or "").lower()) if x]
    n, vocab = len(texts), {t for _, x in templates for t in tok(x)}
    df = Counter(t for x in texts for t in set(tok(x)) & vocab)
    other, weight = math.log(1 + n) + 1, {t: math.log((1 + n) / (1 + df[t])) + 1 for t in vocab}
    vector = lambda ts: {t: k * weight[t] for t, k in Counter(ts).items() if t in vocab}
    norm = lambda v, rest=0: math.sqrt(sum(x * x for x in v.values()) + rest * other * other)
    tv = [vector(tok(x)) for _, x in templates]
    out = []
    for text in texts:
        best = (0.0, 0)
        for s in {*(text or "").split("\n"), text or ""}:
            ts = tok(s)
            v = vector(ts)
            for i, t in enumerate(tv):
                if v:
                    best = max(best, (sum(x * t.get(w, 0) for w, x in v.items()) / (norm(v, sum(w not in vocab for w in ts)) * norm(t)), -i))
        out.append((templates[-best[1]][0], best[0]) if best[0] >= threshold else (None, None))
    return out
