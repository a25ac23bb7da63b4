"""Hashed word shingles and MinHash signatures, over many texts at a time."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

WORDS = 5
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_rng = np.random.default_rng(20240229)
_BYTES = _rng.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = _rng.integers(1, 1 << 63, 16, np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15
    with np.errstate(over="ignore"):
        return tuple(np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n, x, np.uint64)))) for x in (base, pow(base, -1, 1 << 64)))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one text after the other, and where each text begins."""
    encoded = [x.encode("utf-8", "surrogatepass") for x in texts]
    data = np.frombuffer(b"\n".join(encoded) + b"\n", np.uint8)
    white = _WHITE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], white))))
    starts, ends = edge[::2], edge[1::2]
    bounds = np.searchsorted(starts, np.append(0, np.cumsum([len(x) + 1 for x in encoded])))
    forward, back = _powers(1 << max(16, len(data).bit_length()))
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * forward[: len(data)], out=total[1:])
        return mix((total[ends] - total[starts]) * back[starts] ^ (ends - starts).astype(np.uint64) * _ODD[15]), bounds


def word_hashes(texts: list[str]) -> list[np.ndarray]:
    """For each text the 64-bit hashes of its words, in order."""
    if not texts:
        return []
    word, bounds = _words(texts)
    return [word[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def shingles(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles of ``words`` words. A text of fewer words has one
    shingle of all its words, a text without words has none."""
    if not texts:
        return []
    word, bounds = _words(texts)
    with np.errstate(over="ignore"):
        n = max(0, len(word) - words + 1)
        run = np.zeros(n, np.uint64)
        for j in range(words):
            run += word[j : n + j] * _ODD[j]
        run = mix(run)
        out = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= words:
                out.append(np.unique(run[a : b - words + 1]))
            elif b > a:
                out.append(mix((word[a:b] * _ODD[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray], count: int) -> np.ndarray:
    """MinHash values [text, count] as uint32; texts without shingles get the largest value everywhere."""
    rng = np.random.default_rng(7)
    salt, odd = rng.integers(0, 1 << 32, (count, 1), np.uint32), rng.integers(0, 1 << 31, (count, 1), np.uint32) * np.uint32(2) + np.uint32(1)
    out = np.full((len(sets), count), 0xFFFFFFFF, np.uint32)
    most, begin = 1 << 13, 0
    while begin < len(sets):
        stop, n = begin, 0
        while stop < len(sets) and (n == 0 or n + len(sets[stop]) <= most):
            n += len(sets[stop])
            stop += 1
        full = [i for i in range(begin, stop) if len(sets[i])]
        if full:
            flat = np.concatenate([sets[i] for i in full])
            flat = (flat >> np.uint64(32)).astype(np.uint32) ^ flat.astype(np.uint32)
            at = np.cumsum([0, *(len(sets[i]) for i in full)])[:-1]
            for a in range(0, len(flat), most) if len(full) == 1 else [0]:
                part = flat[a : a + most] if len(full) == 1 else flat
                with np.errstate(over="ignore"):
                    low = np.minimum.reduceat((part[None, :] ^ salt) * odd, at, axis=1).T
                out[full] = np.minimum(out[full], low)
        begin = stop
    return out


def apart(one: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, int]:
    """What is in one of two sets alone, and how many are in both."""
    other = np.setxor1d(one, base, assume_unique=True)
    return other, (len(one) + len(base) - len(other)) // 2


def in_common(sets: list[np.ndarray], pairs: np.ndarray | None = None) -> np.ndarray:
    """Matrix of the sizes of the intersections of all pairs of sets, by exact counts; of few sets only where ``pairs``
    says so."""
    n = len(sets)
    sizes = np.array([len(x) for x in sets], np.int64)
    common = np.zeros((n, n), np.int64)
    if n <= 8:
        for i in range(n):
            for j in range(i):
                if pairs is None or pairs[i, j]:
                    common[i, j] = common[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return common
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first = np.concatenate(([True], flat[1:] != flat[:-1])) if len(flat) else np.zeros(0, bool)
    column = np.cumsum(first) - 1
    keep = np.bincount(column)[column] > 1 if len(flat) else first
    owner, column = owner[keep], column[keep]
    if len(column):
        column = np.cumsum(np.concatenate(([0], column[1:] != column[:-1])))
        for a in range(0, int(column[-1]) + 1, 4096):
            lo, hi = np.searchsorted(column, (a, a + 4096))
            block = np.zeros((n, 4096), np.float32)
            block[owner[lo:hi], column[lo:hi] - a] = 1
            common += (block @ block.T).astype(np.int64)
    return common


def similar_pairs(sets: list[np.ndarray], threshold: float, sizes: np.ndarray | None = None, kept: np.ndarray | None = None, base: int = 0) -> np.ndarray:
    """Boolean matrix of the pairs of shingle sets with a Jaccard similarity of ``threshold`` or more, by exact counts.

    Sets may be given as what they have apart from a base set of ``base`` shingles, with their ``sizes`` and how many of
    the base they ``kept``: two sets have in common what both kept of the base, and what both have apart from it and add."""
    n = len(sets)
    sizes = np.array([len(x) for x in sets], np.int64) if sizes is None else sizes
    kept = np.zeros(n, np.int64) if kept is None else kept
    scale = 1_000_000  # in whole numbers, so that a similarity of exactly the threshold counts
    least = np.int64(round(threshold * scale))
    near = np.minimum(sizes[:, None], sizes[None, :]) * scale >= least * np.maximum(sizes[:, None], sizes[None, :])
    common = in_common(sets, near) + kept[:, None] + kept[None, :] - base
    found = near & (common * scale >= least * (sizes[:, None] + sizes[None, :] - common)) & (common > 0)
    np.fill_diagonal(found, False)
    return found
