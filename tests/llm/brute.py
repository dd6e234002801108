"""Plain Python versions of the operators, for small fixtures."""

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, width):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def components(rows, width, percent):
    """{doc_id: (set size, smallest doc_id reachable)} by comparing every pair."""
    sets = {i: shingle_set(t, width) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def exact(rows):
    bare = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = defaultdict(list)
    for i, t in rows:
        groups[bare(t)].append((-len(t or ""), i))
    return {i: (min(g)[1], len(g)) for g in groups.values() for _, i in g}


def rake(cells, targets, rounds=400):
    """cells {(a, b, c): tokens} scaled to the marginals, one after another."""
    w = {k: float(v) if all(targets[d].get(k[d], 0) > 0 for d in range(3)) else 0.0 for k, v in cells.items()}
    for _ in range(rounds):
        for d in range(3):
            s = Counter()
            for k, v in w.items():
                s[k[d]] += v
            w = {k: v * targets[d].get(k[d], 0) / s[k[d]] if s[k[d]] else 0.0 for k, v in w.items()}
    return w
