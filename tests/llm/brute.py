"""Plain re-statements of what the operators return, for small tables."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").encode())


def mixed_targets(sizes, share=1.5, most=2.0, cycle=(5, 2, 1)):
    """sizes: {source: words} -> {source: target}"""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(order)}
    capped = set()
    while True:
        free = [s for s in order if s not in capped]
        left = share * sum(sizes.values()) - sum(most * sizes[s] for s in capped)
        level = left / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if level * weight[s] > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in capped else level * weight[s] for s in order}
        capped |= over


def linked(docs, width=3, percent=90):
    """{id: text} -> {id: (set size, smallest id reached)}"""
    sets = {}
    for i, text in docs.items():
        w = [x.lower() for x in words(text)]
        sets[i] = {tuple(w[j:j + width]) for j in range(max(1, len(w) - width + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b]) if a < b else 0
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(sets[i]), find(i)) for i in sets}


def encoded(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def crc(ids):
    return zlib.crc32(ids.tobytes())


def base_counts(text):
    w = [x.decode() for x in words(text)]
    seen = Counter(tuple(w[j:j + 3]) for j in range(len(w) - 2))
    covered = {k for j in range(len(w) - 2) if seen[tuple(w[j:j + 3])] > 1 for k in (j, j + 1, j + 2)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def without_repeats(rows, width=20):
    """[(id, text)] in order -> [(words, removed, sha256 of the kept)]"""
    seen, out = set(), []
    for _, text in rows:
        w = words(text)
        gone = [False] * len(w)
        for j in range(len(w) - width + 1):
            window = tuple(w[j:j + width])
            if window in seen:
                gone[j:j + width] = [True] * width
            seen.add(window)
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def without_strings(texts, length=400):
    """[bytes] -> [(bytes, removed, spans, sha256 of the kept)]"""
    count = Counter(t[j:j + length] for t in texts for j in range(len(t) - length + 1))
    out = []
    for t in texts:
        step = np.zeros(len(t) + 1, int)
        for j in range(len(t) - length + 1):
            if count[t[j:j + length]] > 1:
                step[j] += 1
                step[j + length] -= 1
        gone = np.cumsum(step[:-1]) > 0
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def nearest(ids, vectors, query, k=10):
    distances = np.sqrt(((vectors - vectors[ids == query][0]) ** 2).sum(1))
    rows = [i for i in np.lexsort((ids, distances)) if ids[i] != query][:k]
    return [(int(ids[i]), float(distances[i])) for i in rows]


def drawn(docs, target, buckets=10_000, percent=25, least=20):
    """[(id, text)] -> [(id, n_features, weight, score, rank)] of a draw towards the target's texts."""
    import math

    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def parts(text):
        w = word.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
        return w, [zlib.crc32(x) % buckets for x in [*w, *(a + b" " + b for a, b in zip(w, w[1:]))]]

    told = [(i, *parts(t)) for i, t in docs]
    s = Counter(b for _, _, f in told for b in f)
    t = Counter(b for text in target for b in parts(text)[1])
    n_s, n_t = sum(s.values()), sum(t.values())

    def gain(b):
        return math.floor(1000 * math.log(((t[b] + 1) * (n_s + buckets)) / ((s[b] + 1) * (n_t + buckets))))

    rows = []
    for i, w, f in told:
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(able[:percent * len(able) // 100], 1):
        r[4] = rank
    return [tuple(r[:5]) for r in rows]


def spelling(docs, slip=97, least=3, ratio=2):
    """[(id, text)] -> {word: (n, n_near, form, form_n, root)}"""
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if slip and h % slip == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= least}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(b) == len(a) + 1 and any(b[:j] + b[j + 1:] == a for j in range(len(b)))

    out = {}
    for w in n:
        around = [v for v in n if v != w and abs(len(v) - len(w)) < 2 and near(v, w)]
        best = min(around, key=lambda v: (-n[v], v), default=None)
        form = best if best is not None and n[best] >= ratio * n[w] else None
        out[w] = [n[w], len(around), form, n[form] if form else None]
    for w in n:
        at = w
        while out[at][2] is not None:
            at = out[at][2]
        out[w] = (*out[w][:4], at)
    return out
