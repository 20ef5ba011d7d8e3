"""Recompression of token sequences, and the interior symbols of windows.

A round joins maximal runs of equal symbols, then each pair of neighbours whose left symbol has coin 0 and whose
right one has coin 1. The coin is a bit of the symbol's name: which bit is settled for all documents by a Spark round, as the one of
COINS that joins the most pairs (`joined_pairs`, added up over all blocks). A symbol's name is a hash of the tokens it spells, so that
equal runs and pairs have equal names everywhere.

Whether a border between symbols of the first round stands depends on the two tokens at it; in the second round, on the
two symbols at it, so on the tokens from before the left one to after the right one. A symbol of the second
round is interior to a window that holds all of these for both its borders: equal windows have equal interior
symbols, and equal tokens that decide them, which its name takes in. Without runs a symbol spells at most 4 tokens and is decided by 10, so that every window of 13 has one.
A third round would be decided by up to 22, hence ROUNDS. Windows inside a run, without interior symbols, are named by
all of their tokens.
"""

from __future__ import annotations

import numpy as np

from .repeats import MULTIPLIER, mixed

ROUNDS = 2
COINS = range(8, 24)  # bits of a name
_INVERSE = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))
_SYMBOL = np.uint64(0xD1B54A32D192ED03)


_held: list[np.ndarray] = []


def _powers(n: int) -> np.ndarray:
    """Powers 0 to n or more of the multiplier and of its inverse; a worker keeps the most it has needed, up to a bound."""
    if _held and _held[0].shape[1] > n:
        return _held[0]
    powers = np.full((2, max(n, 1 << 18) + 1), 1, dtype=np.uint64)
    powers[0, 1:], powers[1, 1:] = MULTIPLIER, _INVERSE
    powers = np.multiply.accumulate(powers, axis=1)
    if n <= 1 << 21:
        _held[:] = [powers]
    return powers


class _Spelled:
    """Hashes of tokens[b:e] for arrays b and e."""

    def __init__(self, tokens: np.ndarray):
        n = len(tokens)
        self.letters = mixed(tokens + np.uint64(1))
        up, self.down = _powers(n)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.letters * up[:n], dtype=np.uint64)])

    def __call__(self, b: np.ndarray, e: np.ndarray) -> np.ndarray:
        return mixed((self.sums[e] - self.sums[b]) * self.down[b] + (e - b).astype(np.uint64))


_BYTES = mixed(np.arange(1, 257, dtype=np.uint64))


def spelled(data: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A token for each run of bytes from begin[k] to before begin[k + 1]; equal runs have equal tokens."""
    up, down = _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[: len(data)], out=sums[1:])
    at = sums[begin]
    return mixed((at[1:] - at[:-1]) * down[begin[:-1]] + np.diff(begin).astype(np.uint64))


def _stands(names: np.ndarray, bit: int) -> np.ndarray:
    """Whether the border between each two neighbours stands after a round."""
    coin = (names >> np.uint64(bit)) & np.uint64(1) == 1
    return (names[1:] != names[:-1]) & (coin[:-1] | ~coin[1:])


def _first_round(hashes: _Spelled, bit: int) -> np.ndarray:
    """Where symbols of the first round begin, then the end."""
    return np.concatenate([[0], np.flatnonzero(_stands(hashes.letters, bit)) + 1, [len(hashes.letters)]])


def joined_pairs(tokens: np.ndarray, coins: tuple[int, ...]) -> np.ndarray:
    """How many borders the next round, after those of these coins, would remove by each of COINS."""
    if len(tokens) < 2:
        return np.zeros(len(COINS), np.int64)
    hashes = _Spelled(tokens)
    names = hashes.letters
    if coins:
        begin = _first_round(hashes, coins[0])
        names = hashes(begin[:-1], begin[1:])
    return np.array([np.count_nonzero(~_stands(names, bit)) for bit in COINS])


def window_names(tokens: np.ndarray, window: int, coins: tuple[int, ...] = (COINS[0],) * ROUNDS) -> np.ndarray:
    """The name of each window: the least name of its interior symbols."""
    n = len(tokens)
    if n < window:
        return np.array([], dtype=np.uint64)
    spelled = _Spelled(tokens)
    first = _first_round(spelled, coins[0])
    second = np.flatnonzero(_stands(spelled(first[:-1], first[1:]), coins[1])) + 1
    left, right = second[:-1], second[1:]
    # Named with the tokens that decide it: a few common words alone are shared by chance.
    names = mixed(spelled(np.maximum(first[left - 1] - 1, 0), np.minimum(first[right + 1] + 1, n)) ^ _SYMBOL)
    # A window holds a symbol if it starts before the neighbour on the left and ends after the one on the right.
    low, high = first[right + 1] + 1 - window, np.minimum(first[left - 1] - 1, n - window)
    most = np.uint64(0xFFFFFFFFFFFFFFFF)
    best = np.full(n - window + 1, most, dtype=np.uint64)
    for d in range(int((high - low).max(initial=-1)) + 1):
        at = low + d
        ok = (at >= 0) & (at <= high)
        at = at[ok]  # distinct, as low grows from symbol to symbol
        best[at] = np.minimum(best[at], names[ok])
    bare = np.flatnonzero(best == most)
    best[bare] = spelled(bare, bare + window)
    return best
