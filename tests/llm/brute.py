"""Plain single-process versions of the operators' contracts."""

from __future__ import annotations

import hashlib
import random

import numpy as np


class Union:
    def __init__(self, nodes):
        self.up = {n: n for n in nodes}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def shingles(text: str | None, n: int) -> frozenset:
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def near(docs: dict, n: int) -> dict:
    """doc_id -> (n_shingles, component)."""
    sets = {k: shingles(t, n) for k, t in docs.items()}
    union = Union(docs)
    ids = list(docs)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                union.join(a, b)
    return {k: (len(sets[k]), union.find(k)) for k in docs}


def repeats(docs: list[tuple], length: int) -> list[tuple]:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of each row."""
    data = [(k, (t or "").encode()) for k, t in docs]
    seen: dict[bytes, int] = {}
    for _, t in data:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for k, t in data:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((k, len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def prose(rng: random.Random, words: int) -> str:
    return " ".join("".join(rng.choice("abcdeéßn") for _ in range(rng.randint(1, 6))) for _ in range(words))
