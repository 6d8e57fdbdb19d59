"""A compressed FM-index over words: a wavelet matrix of packed bits with counts, searched backwards for many patterns at once."""

from __future__ import annotations

import numpy as np

#: Suffixes are ordered by so many symbols, which serves patterns of fewer.
DEPTH = 64


def ordered_suffixes(text: np.ndarray) -> np.ndarray:
    """Suffixes by their first DEPTH symbols, by doubling."""
    rank = text.astype(np.int64)
    n, width = len(rank), 1
    order = np.argsort(rank, kind="stable")
    while width < DEPTH:
        key = rank * (int(rank.max()) + 2)
        key[: n - width] += rank[width:] + 1
        order = np.argsort(key)
        ordered = key[order]
        fresh = np.ones(n, np.int64)
        fresh[1:] = ordered[1:] != ordered[:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh) - 1
        width *= 2
        if rank[order[-1]] == n - 1:
            break
    return order


class Bits:
    """Packed bits with a running count for each 64; about 1.5 bits for a bit."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = (np.cumsum(np.bitwise_count(self.words), dtype=np.int64) - np.bitwise_count(self.words)).astype(np.int32)

    def ones(self, i: np.ndarray) -> np.ndarray:
        """How many of the first i bits are 1."""
        word = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


class FMIndex:
    """Over a text of symbols from 0 to below sigma. Interval ends are positions among ordered suffixes."""

    def __init__(self, text: np.ndarray, sigma: int):
        order = ordered_suffixes(text)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        last = text[order - 1]  # the symbol before each suffix; the text is taken as a ring
        self.levels: list[tuple[Bits, int]] = []
        self.bits = max(1, int(sigma - 1).bit_length())
        for level in reversed(range(self.bits)):
            one = (last >> level & 1).astype(bool)
            self.levels.append((Bits(one), int(len(one) - one.sum())))
            last = np.concatenate([last[~one], last[one]])
        self.start = self._descend(np.arange(sigma), np.zeros(sigma, np.int64))

    def _descend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, (bits, zeros) in enumerate(self.levels):
            ones = bits.ones(i)
            i = np.where(symbol >> (self.bits - 1 - k) & 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of the symbol among the first i of the transform."""
        return self._descend(symbol, i) - self.start[symbol]

    def one(self, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.first[symbol], self.first[symbol + 1]

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the patterns with a symbol put before each: a backward step."""
        n = len(symbol)
        both = self.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high])) + np.tile(self.first[symbol], 2)
        return both[:n], both[n:]


def occurs(index: FMIndex, text: np.ndarray, begin: np.ndarray, end: np.ndarray, least: int) -> np.ndarray:
    """Whether each text[begin:end] occurs at least so often as a whole in the index's text: one backward search for each."""
    out = np.ones(len(begin), bool)
    own, at = np.arange(len(begin)), end - 1
    low, high = index.one(text[at])
    while len(own):
        fails = high - low < least
        out[own[fails]] = False
        on = ~fails & (at > begin[own])
        own, at, low, high = own[on], at[on] - 1, low[on], high[on]
        low, high = index.extend(text[at], low, high)
    return out


def repeated_windows(index: FMIndex, text: np.ndarray, begin: np.ndarray, end: np.ndarray, window: int) -> np.ndarray:
    """Starts of all windows in text[begin:end] (for each such stretch) that occur at least twice in the index's text.

    Matching statistics: for a place where a window may end, how far back what ends there still occurs twice. Where that falls
    short of a window, all windows over the failing stretch are passed at once."""
    at, stop = begin + window - 1, end  # where a window ends; stretches' ends
    low, high = index.one(text[at])
    depth = np.ones(len(at), np.int64)
    found = []
    while len(at):
        fails = high - low < 2
        done = ~fails & (depth == window)
        if done.any():
            found.append(at[done] - window + 1)
        # after a failure at at - depth + 1, the next window that avoids it begins right behind
        at = np.where(fails, at - depth + 1 + window, np.where(done, at + 1, at))
        anew = fails | done
        depth = np.where(anew, 1, depth + 1)
        keep = at < stop
        if not keep.all():
            at, stop, depth, low, high, anew = at[keep], stop[keep], depth[keep], low[keep], high[keep], anew[keep]
        fresh, more = np.flatnonzero(anew), np.flatnonzero(~anew)
        low[fresh], high[fresh] = index.one(text[at[fresh]])
        low[more], high[more] = index.extend(text[at[more] - depth[more] + 1], low[more], high[more])
    return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)
