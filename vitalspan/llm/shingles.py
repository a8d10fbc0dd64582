"""Word shingles and SuperMinHash signatures of texts, as numpy arrays."""

from __future__ import annotations

import numpy as np
import xxhash

from vitalspan.llm.batches import mix64

def words_of(text: str, lower: bool) -> list[bytes]:
    """Words between ASCII blanks; ``lower`` folds A-Z only."""
    data = text.encode("utf-8", "surrogatepass")
    return (data.lower() if lower else data).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_set(text: str | None, k: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's ``k``-word shingles; the whole
    sequence if it has fewer words, nothing without words."""
    words = words_of(text, True) if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words)
    m = max(len(h) - k + 1, 1)
    with np.errstate(over="ignore"):
        total = np.zeros(m, np.uint64)
        for i in range(min(k, len(h))):
            total += mix64(h[i:i + m] + np.uint64(0x9E3779B97F4A7C15 * (i + 1) & 0xFFFFFFFFFFFFFFFF))
        return np.unique(mix64(total + np.uint64(min(k, len(h)))))


def super_minhash(elements: np.ndarray, owner: np.ndarray, n_sets: int, size: int = 128) -> np.ndarray:
    """SuperMinHash signatures of several sets at once.

    Every element walks its own random permutation of the slots; in round
    ``j`` it offers ``j`` plus a fraction to its ``j``-th slot, and a slot keeps
    the least offer. Offers grow with the round, so a set whose slots are all
    taken is finished: rounds run for all elements of the unfinished sets.
    The value of slot ``s`` of set ``i`` is ``out[i, s]``: round in the upper
    bits, fraction in the lower 48.
    """
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(n_sets * size, empty, np.uint64)
    live, own = elements, owner
    places: np.ndarray | None = None
    for j in range(size):
        with np.errstate(over="ignore"):
            draw = mix64(live + np.uint64((j + 1) * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF))
        pick = j + ((draw >> np.uint64(48)) * np.uint64(size - j) >> np.uint64(16)).astype(np.int64)
        offer = np.uint64(j << 48) | (draw & np.uint64((1 << 48) - 1))
        if places is None:
            slot = pick
        else:
            rows = np.arange(len(live))
            slot = places[rows, pick].astype(np.int64)
            places[rows, pick] = places[:, j]
        np.minimum.at(out, own * size + slot, offer)
        full = (out.reshape(n_sets, size) != empty).all(axis=1)
        going = ~full[own]
        if not going.any():
            break
        if places is None:
            live, own, pick = live[going], own[going], pick[going]
            places = np.broadcast_to(np.arange(size, dtype=np.min_scalar_type(size)), (len(live), size)).copy()
            places[np.arange(len(live)), pick] = 0
        elif not going.all():
            live, own, places = live[going], own[going], places[going]
    return out.reshape(n_sets, size)


def signatures(sets: list[np.ndarray], size: int = 128, most: int = 1 << 17) -> np.ndarray:
    """Signatures of many sets, in runs of a bounded number of elements."""
    out = np.full((len(sets), size), np.uint64(0xFFFFFFFFFFFFFFFF))
    start = 0
    while start < len(sets):
        end, held = start, 0
        while end < len(sets) and (end == start or held + len(sets[end]) <= most):
            held += len(sets[end])
            end += 1
        part = sets[start:end]
        owner = np.repeat(np.arange(len(part)), [len(s) for s in part])
        if held:
            out[start:end] = super_minhash(np.concatenate(part), owner, len(part), size)
        start = end
    return out


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band of ``rows`` slots; the band's number is part of
    the key."""
    n, size = signature.shape
    bands = size // rows
    key = np.zeros((n, bands), np.uint64)
    with np.errstate(over="ignore"):
        for r in range(rows):
            key = mix64(key + signature[:, r:bands * rows:rows])
        return mix64(key + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
