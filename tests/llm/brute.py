"""Plain versions of the operators, to test against on small tables."""

from __future__ import annotations

import re


def words(text: str | None) -> list[str]:
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def shingles(text: str | None, k: int) -> frozenset:
    w = words(text)
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def jaccard_components(rows: list[tuple[int, str | None]], k: int = 4, percent: int = 85) -> dict[int, tuple[int, int]]:
    """doc_id -> (n_shingles, component_id)."""
    sets = [(i, shingles(t, k)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by: dict = {}
    for n, (i, s) in enumerate(sets):
        near: dict[int, int] = {}
        for g in s:
            for m in by.get(g, ()):
                near[m] = near.get(m, 0) + 1
            by.setdefault(g, []).append(n)
        for m, both in near.items():
            if 100 * both >= percent * (len(s) + len(sets[m][1]) - both):
                a, b = find(i), find(sets[m][0])
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets}
