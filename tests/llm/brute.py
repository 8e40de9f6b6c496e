"""Plain-Python versions of the operators, for small tables."""

import collections
import hashlib
import itertools
import re
import string

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def shingle_set(text, k=5):
    w = [x.translate(LOWER) for x in SPACE_WORD.findall(text or "")]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def near(a, b):
    both = len(a & b)
    return both and 100 * both >= 80 * (len(a) + len(b) - both)


def similar(rows):
    """doc_id -> (n_shingles, component_id) for unique ids."""
    sets = {i: shingle_set(t) for i, t in rows}
    holders = collections.defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    common = collections.Counter()
    for ids in holders.values():
        common.update(itertools.combinations(sorted(ids), 2))
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for (a, b), n in common.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def repeated(rows, window=13):
    """(doc_id, n_words, n_removed, kept_sha256) per row; ids may be None or repeat."""
    key = lambda i: (1, 0) if i is None else (0, i)
    words = [(i, SPACE_WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        for j in range(len(w) - window + 1):
            g = tuple(w[j:j + window])
            first[g] = min(first.get(g, key(i)), key(i))
    out = []
    for i, w in words:
        gone = set()
        for j in range(len(w) - window + 1):
            if first[tuple(w[j:j + window])] < key(i):
                gone.update(range(j, j + window))
        out.append((i, len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone))))
    return out


def later_lines(rows):
    """(doc_id, n_lines, n_removed, kept_sha256) per row; ids unique."""
    lines = []
    for i, t in sorted(rows, key=lambda r: r[0]):
        lines += [((i, j), shingle_set(x)) for j, x in enumerate(t.split("\n") if t else [])]
    gone, holders = set(), collections.defaultdict(list)
    for k, (at, s) in enumerate(lines):
        c = collections.Counter(o for g in s for o in holders[g])
        if any(100 * n >= 80 * (len(s) + len(lines[o][1]) - n) for o, n in c.items()):
            gone.add(at)
        for g in s:
            holders[g].append(k)
    out = []
    for i, t in rows:
        parts = t.split("\n") if t else []
        out.append((i, len(parts), sum((i, j) in gone for j in range(len(parts))),
                    sha("\n".join(x for j, x in enumerate(parts) if (i, j) not in gone))))
    return out


def hits(rows, items, window=13):
    """(doc_id, n_words, n_hit, sorted items) per row."""
    wins = []
    for item, t in items:
        w = ALNUM_WORD.findall((t or "").translate(LOWER))
        if w:
            n = min(window, len(w))
            wins += [(str(item), w[j:j + n]) for j in range(len(w) - n + 1)]
    out = []
    for i, t in rows:
        w = ALNUM_WORD.findall((t or "").translate(LOWER))
        hit, found = set(), set()
        for item, g in wins:
            for j in range(len(w) - len(g) + 1):
                if w[j:j + len(g)] == g:
                    hit.update(range(j, j + len(g)))
                    found.add(item)
        out.append((i, len(w), len(hit), sorted(found)))
    return out


def targets(sizes: dict, weights=(1, 2, 3), ceiling=3.0):
    """Targets per source by sharing the excess again and again."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-8")) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(ceiling * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        unit = rest / sum(weight[s] for s in free) if free else 0.0
        target = {s: ceiling * sizes[s] if s in capped else unit * weight[s] for s in order}
        over = {s for s in free if target[s] > ceiling * sizes[s] + 1e-9}
        if not over:
            return target
        capped |= over
