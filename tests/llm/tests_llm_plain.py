"""Plain versions that several tests hold results against."""

import re


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def grams(text, n):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(text)]
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def linked(rows, n, percent):
    """component by doc_id, all pairs compared"""
    rows = [(d, grams(t, n)) for d, t in {(r[0], r[1]) for r in rows} if d is not None]
    best = {d: d for d, _ in rows}

    def find(x):
        while best[x] != x:
            x = best[x]
        return x

    for i, (a, x) in enumerate(rows):
        for b, y in rows[i + 1:]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                lo, hi = sorted((find(a), find(b)))
                best[hi] = lo
    return {d: find(d) for d, _ in rows}
