"""Plain versions of what the operators compute, for small tables."""

import re

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", (text or "").translate(LOWER)) if w]


def shingles(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


class Groups:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def tie(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def jaccard_groups(rows, n, num, den):
    """Set size and smallest reachable key per key; rows are (key, text)."""
    sets = [(k, shingles(t, n)) for k, t in rows]
    groups, sizes = Groups(), {}
    for i, (k, s) in enumerate(sets):
        sizes[k] = max(sizes.get(k, 0), len(s))
        if k is None:
            continue
        groups.find(k)
        for other, t in sets[:i]:
            both = len(s & t)
            if other is not None and s and t and den * both >= num * (len(s) + len(t) - both):
                groups.tie(k, other)
    return {k: (size, groups.find(k) if k is not None else None) for k, size in sizes.items()}
