"""Plain restatements of the operators' contracts, for small tables."""

import itertools
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def near_duplicates(rows, k, percent=80):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[d] = {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2)
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    root = components(sets, links)
    return {d: (len(sets[d]), root[d], root[d] == d) for d in sets}


def benchmark_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def benchmark_hits(docs, items, window=10):
    windows = {}
    for i, t in items:
        w = benchmark_words(t)
        for x in [tuple(w[a:a + window]) for a in range(len(w) - window + 1)] if len(w) >= window else [tuple(w)] if w else []:
            windows.setdefault(x, set()).add(str(i))
    out = {}
    for d, t in docs:
        w, hit, found = benchmark_words(t), set(), set()
        for n in {len(x) for x in windows}:
            for a in range(len(w) - n + 1):
                if tuple(w[a:a + n]) in windows:
                    hit.update(range(a, a + n))
                    found |= windows[tuple(w[a:a + n])]
        out[d] = (len(w), len(hit), sorted(found))
    return out
