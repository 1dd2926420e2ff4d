"""Small tables with the awkward cases, and brute-force versions."""

import random
from collections import Counter

import numpy as np

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    """Rows (doc_id, text) or (doc_id, text, source) as documents."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s0", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DOCS)


def words(seed, n):
    r = random.Random(seed)
    return [f"{r.choice('bcdfglmnprst')}{r.choice('aeiou')}{r.choice('bcdfglmnprst')}{r.randrange(400)}" for _ in range(n)]


def awkward():
    """Nulls, empties, a very long text, exact and near copies, repeated rows."""
    base = words(1, 120)
    near = [*base[:60], "changed", *base[61:]]
    far = [w if i % 9 else "x" + w for i, w in enumerate(base)]
    long = " ".join(words(2, 60_000))
    rows = [
        (1, " ".join(base)), (2, " ".join(base)), (3, " ".join(near)), (4, " ".join(far)), (5, ""), (6, None), (7, " \t\n"),
        (8, "one two"), (9, "one  two"), (10, long), (11, long + " end"), (12, "é" * 300 + " \U0001f600 ü"), (13, "In. " * 500),
        (14, "short"), (14, "short"), (15, None), (None, "no id here"), (None, "no id here either"), (-5, "negative id"),
    ]
    return [(i, t, s) for (i, t), s in zip(rows, ["s0", "s1", None, "s0", "s2"] * 9)]


def edit(a, b):
    """Edit distance by the plain table, a row at a time."""
    codes = {w: k for k, w in enumerate(dict.fromkeys([*a, *b]))}
    y, steps = np.array([codes[w] for w in b], int), np.arange(len(b) + 1)
    row = steps.copy()
    for i, w in enumerate(a, 1):
        best = np.minimum(row[1:] + 1, row[:-1] + (y != codes[w]))
        row = np.minimum.accumulate(np.concatenate([[i], best]) - steps) + steps  # the cell to the left, plus one
    return int(row[-1])


def near_pairs(texts, least=0.8):
    """Index pairs of different texts with an edit similarity of at least ``least``, each with it, by aligning all pairs of whole texts.

    Only pairs that lack too many of each other's words for any alignment are left out."""
    split = [(t or "").split() for t in texts]
    bags = [Counter(w) for w in split]
    out = []
    for i, x in enumerate(split):
        for j in range(i):
            y = split[j]
            longer = max(len(x), len(y))
            most = int((1 - least) * longer + 1e-9)
            if x and y and texts[i] != texts[j] and longer - min(len(x), len(y)) <= most and (bags[i] & bags[j]).total() >= longer - most:
                d = edit(x, y)
                if d <= most:
                    out.append((j, i, 1 - d / longer))
    return out


def near_classes(rows):
    """Class of each row index by comparing all pairs."""
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    first = {}
    same = [(first.setdefault(t or "", i), i) for i, (_, t) in enumerate(rows)]
    texts = [t or "" for _, t in rows]
    for a, b, *_ in same + near_pairs(texts):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(rows))]
