"""Rolling hashes of word sequences in numpy: a sequence's hash is a polynomial modulo 2**64, then mixed."""

from __future__ import annotations

import numpy as np

_U = np.uint64
#: Odd multipliers; a second one makes hashes that are independent of the first's.
BASE = _U(0x9E3779B97F4A7C15)
BASE_2 = _U(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (shift, multiply)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Powers:
    """Powers of an odd base and of its inverse, grown on demand."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse = base, _U(pow(int(base), -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 4096)
            for name, base in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


POWERS, POWERS_2 = Powers(BASE), Powers(BASE_2)


class Sequence:
    """Prefix sums from which the hash of any stretch of the words comes in constant time."""

    def __init__(self, words: np.ndarray, powers: Powers = POWERS):
        up, self.down = powers.upto(len(words) + 1)
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * up[: len(words)], out=self.sums[1:])

    def grams(self, k: int) -> np.ndarray:
        """Hashes of all stretches of k words."""
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)

    def stretch(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.down[start])


class WordHashes(dict):
    """bytes of a word -> its 64-bit hash; forgets all when full."""

    def __init__(self, entries: int = 400_000):
        super().__init__()
        from xxhash import xxh3_64_intdigest

        self.make, self.entries = xxh3_64_intdigest, entries

    def __missing__(self, word: bytes) -> int:
        value = self[word] = self.make(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.entries:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def window_minima(grams: np.ndarray, window: int) -> np.ndarray:
    """For each window of consecutive grams the place of its least one, the first of equals."""
    if len(grams) < window:
        return np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(grams, window)
    out = np.empty(len(view), np.int64)
    for i in range(0, len(view), 1 << 15):  # bounded memory for very long texts
        out[i : i + (1 << 15)] = view[i : i + (1 << 15)].argmin(axis=1)
    return out + np.arange(len(view))


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of equal values."""
    first = np.flatnonzero(np.diff(values, prepend=values[0] - 1)) if len(values) else np.zeros(0, np.int64)
    return first, np.append(first[1:], len(values)) - 1
