"""Word and shingle hashing over raw UTF-8 bytes, a block of documents at a time."""

from __future__ import annotations

import numpy as np

BLOCK = 1 << 18  # bytes hashed at once
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint64) + np.uint64(1)
_LOWER[0x41:0x5B] = np.arange(0x61, 0x7B, dtype=np.uint64) + np.uint64(1)
_EMPTY = np.zeros(0, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            with np.errstate(over="ignore"):
                self.up = np.concatenate(([np.uint64(1)], np.full(n - 1, _BASE))).cumprod(dtype=np.uint64)
                self.down = np.concatenate(([np.uint64(1)], np.full(n - 1, inverse))).cumprod(dtype=np.uint64)
        return self.up, self.down


def _hash_words(data: np.ndarray, breaks: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start offset of each word; a word never crosses a position in ``breaks``."""
    n = len(data)
    if not n:
        return _EMPTY, np.zeros(0, dtype=np.int64)
    inside = ~_SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[breaks] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    s, e = np.flatnonzero(first), np.flatnonzero(last)
    up, down = powers.upto(n)
    with np.errstate(over="ignore"):
        total = np.cumsum(_LOWER[data] * up[:n], dtype=np.uint64)
        before = np.where(s > 0, total[s - 1], np.uint64(0))
        return mix((total[e] - before) * down[s]), s


def _long_words(text: bytes, powers: Powers) -> np.ndarray:
    """Words of a text longer than a block, cut at white space near block ends."""
    data, out, at = np.frombuffer(text, dtype=np.uint8), [], 0
    while at < len(data):
        end = min(at + BLOCK, len(data))
        while end < len(data):
            gap = np.flatnonzero(_SPACE[data[end : end + BLOCK]])
            if len(gap):
                end += int(gap[0])
                break
            end = min(end + BLOCK, len(data))
        out.append(_hash_words(data[at:end], np.zeros(1, dtype=np.int64), powers)[0])
        at = end
    return np.concatenate(out) if out else _EMPTY


def word_hashes(texts: list[bytes | None], powers: Powers) -> list[np.ndarray]:
    """For each text the 64-bit hashes of its words, in order (A-Z folded, split at ASCII white space)."""
    out: list[np.ndarray] = [_EMPTY] * len(texts)
    group: list[int] = []
    held = 0

    def flush() -> None:
        nonlocal group, held
        if group:
            starts = np.cumsum([0, *[len(texts[i]) for i in group]])
            hashes, at = _hash_words(np.frombuffer(b"".join(texts[i] for i in group), dtype=np.uint8), starts, powers)
            cuts = np.searchsorted(at, starts)
            for k, i in enumerate(group):
                out[i] = hashes[cuts[k] : cuts[k + 1]]
        group, held = [], 0

    for i, text in enumerate(texts):
        if not text:
            continue
        if len(text) > BLOCK:
            out[i] = _long_words(text, powers)
            continue
        if held + len(text) > BLOCK:
            flush()
        group.append(i)
        held += len(text)
    flush()
    return out


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; a shorter text is one shingle, an empty one none."""
    n = len(words)
    if not n:
        return _EMPTY
    width = min(n, k)
    with np.errstate(over="ignore"):
        h = np.full(n - width + 1, np.uint64(width), dtype=np.uint64)
        for j in range(width):
            h = h * np.uint64(0xD6E8FEB86659FD93) + words[j : n - width + 1 + j]
    return np.unique(mix(h))
