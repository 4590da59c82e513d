"""Character arrays of texts, shared by the operators that count n-grams."""

from __future__ import annotations

import numpy as np

#: Characters of text handled at once, so that a batch of long texts needs bounded memory.
CHUNK = 1 << 20


def codes(text: str) -> np.ndarray:
    """Code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)


def letters_table() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def packed_ngrams(text: str, letters: np.ndarray, longest: int = 3) -> np.ndarray:
    """Every n-gram (1 to ``longest`` <= 3) of the lower-cased words of letters, each word between two blanks, as one
    integer of 21 bits a character. Runs of other characters are one blank; the blank alone is no n-gram."""
    c = codes(text.lower())
    c = np.where(letters[c], c, 32)
    blank = c == 32
    c = c[~(blank & np.concatenate(([True], blank[:-1])))]
    if not len(c):
        return np.empty(0, np.int64)
    c = np.concatenate(([32], c, [32])) if c[-1] != 32 else np.concatenate(([32], c))
    two = c[:-1] << 21 | c[1:]
    grams = [c[c != 32]]
    if longest > 1:
        grams.append(two)
    if longest > 2:
        three = two[:-1] << 21 | c[2:]
        grams.append(three[c[1:-1] != 32])  # a blank in the middle joins two words: no n-gram of a word
    return np.concatenate(grams)


def hashed_ngrams(text: str, n: int, bits: int) -> np.ndarray:
    """Buckets (``bits`` wide) of all character n-grams of a text; shorter texts count as one n-gram."""
    c = codes(text).astype(np.uint64) + np.uint64(1)
    if not len(c):
        return np.empty(0, np.int64)
    n = min(n, len(c))
    h = np.zeros(len(c) - n + 1, np.uint64)
    for i in range(n):
        h = (h ^ c[i:len(c) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(64 - bits)).astype(np.int64)
