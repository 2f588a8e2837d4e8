"""The operators in plain Python, for small tables."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANK = re.compile(r"[\x20\x09-\x0D]")


def words(text):
    return WORD.findall(text or "")


def copied_windows(rows, size=20):
    """doc_id -> (words, removed, kept text)."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        own = words(text)
        gone = [False] * len(own)
        for k in range(len(own) - size + 1):
            window = tuple(own[k : k + size])
            if window in seen:
                gone[k : k + size] = [True] * size
            seen.add(window)
        out[doc_id] = (len(own), sum(gone), " ".join(w for w, g in zip(own, gone) if not g))
    return out


def equal_texts(rows):
    """doc_id -> (keep_id, group size, kept)."""
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(BLANK.sub("", text or ""), []).append((-len(text or ""), doc_id))
    return {i: (min(g)[1], len(g), min(g)[1] == i) for g in groups.values() for _, i in g}


def simhash(text):
    own = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not own:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(own[i : i + 4]).encode(), 42) for i in range(max(1, len(own) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(fps, distance=4):
    """The smallest key reachable from each key of a dict of fingerprints."""
    keys = sorted(fps)
    values = np.array([fps[k] for k in keys], dtype=np.uint64)
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, key in enumerate(keys):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= distance):
            a, b = find(key), find(keys[i + 1 + j])
            root[max(a, b)] = min(a, b)
    return {k: find(k) for k in keys}


def shared_targets(sizes, weights=(1, 2, 3), most=3):
    """Targets by passing on what exceeds a cap, again and again."""
    names = sorted((n for n in sizes if n is not None)) + ([None] if None in sizes else [])
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    capped = {}
    while True:
        left = sum(sizes.values()) - sum(capped.values())
        rest = {n: left * weight[n] / sum(weight[m] for m in names if m not in capped) for n in names if n not in capped}
        over = {n: most * sizes[n] for n in rest if rest[n] > most * sizes[n] + 1e-9}
        if not over:
            return capped | rest
        capped |= over


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def digits(text):
    return re.sub("[^0-9]", "", text)


BASE = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 9 <= len(digits(m)) <= 15),
)


def base_spans(text):
    found = [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for k, (kind, pattern, check) in enumerate(BASE) for m in pattern.finditer(text or "") if check(m[0])]
    return ",".join(s for *_, s in sorted(found))


def repeats(text, size=8):
    own = words(text)
    places = {}
    for k in range(len(own) - size + 1):
        places.setdefault(tuple(own[k : k + size]), []).append(k)
    return len({p for at in places.values() if len(at) > 1 for k in at for p in range(k, k + size)})
