"""Hashed character trigrams of words, shared by the language and toxicity models."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np

START, STOP = "\x02", "\x03"


def trigrams(words: Sequence[str], dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Word number and bucket of every trigram of the marked words; a word of n characters has n of them."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    marked = START + (STOP + START).join(words) + STOP
    c = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    a, b, d = c[:-2], c[1:-1], c[2:]
    inside = (a != ord(STOP)) & (b != ord(STOP))
    return np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words))), bucket(a[inside], b[inside], d[inside], dims)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct numbers."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def ngrams(words: Sequence[str], sizes: Sequence[int], dims: int, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Word number and bucket of the n-grams of the marked words, each once a word; the whole of a word too short for any.

    Sorted by word. With ``only`` the buckets marked there alone.
    """
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    c = np.frombuffer("".join(START + w + STOP for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    length = np.fromiter(map(len, words), np.int64, len(words)) + 2
    of = np.repeat(np.arange(len(words)), length)
    left = np.repeat(np.cumsum(length), length) - np.arange(len(c))  # characters from here to the end of the word
    first = left == length[of]
    h = np.zeros(len(c), np.uint64)
    found = []
    for n in range(1, min(max(sizes), len(c)) + 1):
        h[: len(c) - n + 1] = h[: len(c) - n + 1] * np.uint64(0x100000001B3) + c[n - 1 :] * np.uint64(0x9E3779B97F4A7C15)
        at = left >= n if n in sizes else first & (left == n) & (n < min(sizes))
        if at.any():
            x = h[at] ^ (h[at] >> np.uint64(31))
            x = (x * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(36)
            x = (x & np.uint64(dims - 1)).astype(np.int64)
            w = of[at]
            if only is not None:
                keep = only[x]
                x, w = x[keep], w[keep]
            found.append(w * dims + x)
    key = distinct(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return key // dims, key % dims


def bucket(a: np.ndarray, b: np.ndarray, c: np.ndarray, dims: int) -> np.ndarray:
    """A bucket below dims (a power of two) for three code points."""
    h = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b * np.uint64(0xC2B2AE3D27D4EB4F) << np.uint64(1)) ^ (c * np.uint64(0x165667B19E3779F9) << np.uint64(2))
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return ((h >> np.uint64(40)) & np.uint64(dims - 1)).astype(np.int64)


def chunks(texts: Iterable[str], most: int = 2_000_000) -> Iterable[list[str]]:
    """Lists of texts of about most characters in all."""
    out, n = [], 0
    for t in texts:
        out.append(t)
        n += len(t)
        if n >= most:
            yield out
            out, n = [], 0
    if out:
        yield out
