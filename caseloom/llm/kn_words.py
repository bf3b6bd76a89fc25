"""Words and n-grams of characters as 64-bit keys."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Marks before and after a word.
BEGIN, END = "\ufdd0", "\ufdd1"
MULTIPLIER, MIXER = np.array([0x9E3779B97F4A7C15], U), U(0xD6E8FEB86659FD93)


class Words:
    """The distinct words of a block as one run of code points, each word between its marks."""

    def __init__(self, words: pa.Array):
        lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 2
        run = "".join([BEGIN + w + END for w in words.to_pylist()])
        self.points = np.frombuffer(run.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.word = np.repeat(np.arange(len(words)), lengths)
        starts = np.cumsum(lengths) - lengths
        self.place = np.arange(len(self.points)) - np.repeat(starts, lengths)
        self.lengths = lengths

    def hashes(self, order: int) -> list[np.ndarray]:
        """For k = 1 to order: the key of the k code points that end at each place."""
        out, total, power = [], np.zeros(len(self.points), U), np.ones(1, U)
        points = self.points.astype(U)
        for k in range(1, order + 1):
            total = total.copy()
            total[k - 1 :] += (points[: len(points) - k + 1] + U(1)) * power
            power = np.multiply(power, MULTIPLIER)
            out.append(mixed(total, k))
        return out


def mixed(x: np.ndarray, k) -> np.ndarray:
    x = (x + np.asarray(k, U) * MIXER) * MIXER
    return x ^ (x >> U(32))


def keys_of(grams: pa.Array) -> np.ndarray:
    """The keys of n-grams given as strings; the same as Words.hashes()."""
    n = pc.utf8_length(grams).to_numpy(zero_copy_only=False).astype(np.int64)
    points = np.frombuffer("".join(grams.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32).astype(U)
    ends = np.cumsum(n)
    total, power = np.zeros(len(n), U), np.ones(1, U)
    for k in range(int(n.max(initial=0))):
        has = n > k
        total[has] += (points[ends[has] - 1 - k] + U(1)) * power
        power = np.multiply(power, MULTIPLIER)
    return mixed(total, n)


def word_keys(words: pa.Array) -> np.ndarray:
    """A 64-bit key of each word, which is not empty."""
    w = Words(words)
    powers = np.multiply.accumulate(np.concatenate((np.ones(1, U), np.full(int(w.lengths.max()), MULTIPLIER[0], U))))
    return mixed(np.add.reduceat((w.points.astype(U) + U(1)) * powers[w.place], np.cumsum(w.lengths) - w.lengths), 7)
