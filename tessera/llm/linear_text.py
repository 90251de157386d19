"""Sums of per-feature weights over whole texts, vectorised over a batch in blocks of bounded size.

Texts are laid end to end, each between two blanks, and every feature belongs to the position where it starts. A feature never
holds two blanks in a row, so none reaches into the next text, and none is longer than `AHEAD`, so blocks need to see only that far ahead.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

BLOCK, AHEAD = 1 << 18, 72
MIX = np.uint64(0x9E3779B97F4A7C15)

#: (codes, blanks, number of positions) -> arrays of feature numbers for those positions, -1 where there is none
Extract = Callable[[np.ndarray, np.ndarray, int], list[np.ndarray]]


def bucket(value: np.ndarray, order: int, bits: int) -> np.ndarray:
    """A feature number of so many bits from an exact integer form of the feature."""
    mixed = (value + np.uint64(order)) * MIX
    mixed ^= mixed >> np.uint64(29)
    return ((mixed * MIX) >> np.uint64(64 - bits)).astype(np.int64)


def lay_out(texts: list[np.ndarray], blank: int) -> tuple[np.ndarray, np.ndarray]:
    """All codes in a row and the first position of each text."""
    sizes = np.array([len(t) + 2 for t in texts], np.int64)
    firsts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    codes = np.full(int(sizes.sum()), blank, texts[0].dtype if texts else np.uint8)
    for first, text in zip(firsts, texts, strict=True):
        codes[first + 1 : first + 1 + len(text)] = text
    return codes, firsts


def sums(texts: list[np.ndarray], blank: int, is_blank: Callable[[np.ndarray], np.ndarray], extract: Extract, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text the sum of the weight rows of its features, and the number of features. The last row of weights is zeros."""
    out, counts = np.zeros((len(texts), weights.shape[1])), np.zeros(len(texts), np.int64)
    if not texts:
        return out, counts
    codes, firsts = lay_out(texts, blank)
    for start in range(0, len(codes), BLOCK):
        seen = codes[start : start + BLOCK + AHEAD]
        n = min(BLOCK, len(codes) - start)
        value, number = np.zeros((n, weights.shape[1])), np.zeros(n, np.int64)
        for feature in extract(seen, is_blank(seen), n):
            value += weights[feature]
            number += feature >= 0
        low, high = np.searchsorted(firsts, start, "right") - 1, np.searchsorted(firsts, start + n, "left")
        cuts = np.maximum(firsts[low:high] - start, 0)
        out[low:high] += np.add.reduceat(value, cuts)
        counts[low:high] += np.add.reduceat(number, cuts)
    return out, counts


def features(text: np.ndarray, blank: int, is_blank: Callable[[np.ndarray], np.ndarray], extract: Extract) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of one text and their counts."""
    codes, _ = lay_out([text], blank)
    found = [np.zeros(0, np.int64)]
    for start in range(0, len(codes), BLOCK):
        seen = codes[start : start + BLOCK + AHEAD]
        found += [f[f >= 0] for f in extract(seen, is_blank(seen), min(BLOCK, len(codes) - start))]
    return np.unique(np.concatenate(found), return_counts=True)
