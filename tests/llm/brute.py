"""Plain Python versions of the operators' contracts."""

import collections

ASCII_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
EDGE_TEXTS = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One"), (6, "a b c d e f g h"), (7, "a b c d e f g h"), (8, "A  b\nc d e f g h "),
    (9, "word " * 30_000), (10, "word " * 29_999 + "word"), (11, "é ü ñ 漢字 🙂 x y z"), (12, "<|endoftext|> a  b \n c"), (13, "x"), (None, "no id"),
]


def words(text):
    return (text or "").encode().translate(ASCII_LOWER).split()


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(edges, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def near_components(rows):
    """rows: (id, text).  Candidates are all pairs that share a shingle."""
    sets = {i: shingles(t) for i, t in rows if i is not None}
    by = collections.defaultdict(list)
    for i, s in sets.items():
        for g in s:
            by[g].append(i)
    edges = set()
    for i, s in sets.items():
        counts = collections.Counter(j for g in s for j in by[g] if j < i)
        for j, both in counts.items():
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                edges.add((j, i))
    return sets, components(edges, sets)
