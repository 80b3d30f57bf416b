"""Plain versions that the operators are held against."""

from __future__ import annotations

import re


def words(text: str | None) -> list[str]:
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def shingles(text: str | None) -> set[tuple[str, ...]]:
    own = words(text)
    if len(own) < 5:
        return {tuple(own)} if own else set()
    return {tuple(own[i : i + 5]) for i in range(len(own) - 4)}


def components(ids, links) -> dict[int, int]:
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in links:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    return {i: root(i) for i in ids}


def near_duplicates(rows, percent=75):
    """``doc_id -> (set size, component)`` for unique ids, by comparing all that share a shingle."""
    sets = {i: shingles(text) for i, text in rows}
    holders: dict[tuple, list[int]] = {}
    for i, own in sets.items():
        for shingle in own:
            holders.setdefault(shingle, []).append(i)
    links = {(a, b) for group in holders.values() if len(group) < 400 for k, a in enumerate(group) for b in group[:k]}
    links |= {(a, b) for group in holders.values() if len(group) >= 400 for a, b in zip(group, group[1:], strict=False)}
    close = []
    for a, b in links:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            close.append((a, b))
    found = components(sets, close)
    return {i: (len(own), found[i]) for i, own in sets.items()}
