"""Slow, plain versions of the operators, to compare with."""

import itertools
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower_ascii(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingle_set(text, size):
    words = WORD.findall(lower_ascii(text))
    size = min(size, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()


def near_components(docs, size, percent):
    """id -> (set size, smallest reachable id) of a dict of texts."""
    sets = {k: shingle_set(v, size) for k, v in docs.items()}
    at = {}
    for k, own in sets.items():
        for s in own:
            at.setdefault(s, []).append(k)
    parent = {k: k for k in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    shared = {}
    for ids in at.values():
        for a, b in itertools.combinations(sorted(ids), 2):
            shared[a, b] = shared.get((a, b), 0) + 1
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {k: (len(sets[k]), root(k)) for k in docs}


def repeated_bytes(docs, width):
    """id -> (bytes, removed, runs, what stays) of a dict of texts."""
    seen = {}
    data = {k: (v or "").encode() for k, v in docs.items()}
    for own in data.values():
        for i in range(len(own) - width + 1):
            piece = own[i : i + width]
            seen[piece] = seen.get(piece, 0) + 1
    result = {}
    for k, own in data.items():
        gone = bytearray(len(own))
        for i in range(len(own) - width + 1):
            if seen[own[i : i + width]] > 1:
                gone[i : i + width] = b"\x01" * width
        starts = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        result[k] = (len(own), sum(gone), starts, bytes(c for c, g in zip(own, gone) if not g))
    return result
