"""A run-length index: run-compressed Burrows-Wheeler transform with sampled run ends, and streamed matching statistics.

The text is a row of segments, each with an END byte after it. Its suffixes are sorted; the bytes before them are the
transform, kept as runs: where each starts, its byte, and the text places (samples) of its first and last row. Texts
of repeats have few runs. Neighbouring rows that share `enough` bytes or more are a group; groups of several documents are kept with
the least of these. The sorted order itself isn't kept.

Matching statistics are streamed from right to left: a row and its text place, where the longest match so far starts, go one byte to
the left. If the byte before the row is the query's, both simply move; otherwise the nearest runs of that byte above and
below offer their sampled ends, and the one that shares more with the match so far is taken. Lengths count to `enough`; a match that
long is marked with the least document of its row's group or, where there's none, of its place.

Many queries go side by side, a byte of each at a time.
"""

from __future__ import annotations

import numpy as np

END = 0xFF  # in no UTF-8 text
_NONE = np.iinfo(np.int64).max
_IDS = 21  # bits of a text place


def joined(segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Segments with an END after each, and their starts."""
    sizes = np.fromiter(map(len, segments), np.int64, len(segments)) + 1
    end = bytes([END])
    return np.frombuffer(end.join(segments) + (end if segments else b""), np.uint8), np.cumsum(sizes) - sizes


def sorted_suffixes(text: np.ndarray, enough: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the text in the order of the suffixes there (as if END bytes without end followed the text), and whether each shares `enough` bytes with the next."""
    n = len(text)
    if n > 1 << _IDS:
        raise ValueError(f"a text of {n} bytes: more than {1 << _IDS}")
    held = None
    places, mask = np.arange(n, dtype=np.uint64), np.uint64((1 << _IDS) - 1)
    wide = np.concatenate([text, np.full(8, END, np.uint8)]).astype(np.uint64)
    key, width = np.zeros(n, dtype=np.uint64), 5
    for k in range(width):
        key = key << np.uint64(8) | wide[k : n + k]
    while True:
        # Key and place fit one integer, which sorts several times faster than an order of keys.
        both = np.sort(key << np.uint64(_IDS) | places)
        order = (both & mask).astype(np.int64)
        both >>= np.uint64(_IDS)
        more = both[1:] != both[:-1]
        if more.all():
            if held is None:
                return order, np.zeros(max(0, n - 1), dtype=bool)
            rank, shift = held
            a, b = order[:-1], order[1:]
            return order, (rank[a] == rank[b]) & (rank[a + shift] == rank[b + shift])
        rank = np.empty(n + width, dtype=np.uint64)
        rank[order] = np.concatenate([[0], np.cumsum(more)]).astype(np.uint64)
        rank[n:] = rank[n - 1]  # of nothing but END bytes
        if width <= enough < 2 * width:
            held = rank, enough - width
        key = rank[:n] << np.uint64(_IDS) | rank[width:]
        width *= 2


class RunIndex:
    def __init__(self, segments: list[bytes], documents: np.ndarray, enough: int):
        text, self.starts = joined(segments)
        self.documents = documents
        self.n, self.enough = len(text), enough
        padded = np.concatenate([text, np.full(enough + 24, END, np.uint8)])
        self.words = np.lib.stride_tricks.as_strided(padded[: len(padded) // 8 * 8].view("<u8"), (len(text) + enough + 8,), (1,))
        order, same = sorted_suffixes(text, enough)
        self.origin = int(order[0]) if self.n else 0  # place of row 0, where matches of no bytes may start
        self._group(order, same)
        before = text[order - 1]
        first = np.flatnonzero(np.concatenate([np.ones(min(1, self.n), bool), before[1:] != before[:-1]]))
        last = np.append(first[1:], self.n) - 1
        by = np.argsort(before[first], kind="stable")  # runs of a byte together, in row order
        self.byte = before[first][by].astype(np.int64)
        self.first, self.last = first[by], last[by]
        self.low, self.high = order[self.first], order[self.last]  # sampled run ends
        self.key = self.byte << 32 | self.first
        sizes = self.last - self.first + 1
        # The row of the suffix that a run's first byte starts: after those of smaller bytes and of earlier runs of the byte.
        self.into = np.cumsum(sizes) - sizes

    def _group(self, order: np.ndarray, same: np.ndarray) -> None:
        edges = np.flatnonzero(np.diff(np.concatenate([[0], same.view(np.int8), [0]])))
        first, last = edges[::2], edges[1::2]
        rows = np.concatenate([[0], np.cumsum(last - first + 1)])
        at = np.arange(rows[-1]) + np.repeat(first - rows[:-1], np.diff(rows))
        own = self.document(order[at])
        low = np.minimum.reduceat(own, rows[:-1]) if len(first) else own
        several = low != np.maximum.reduceat(own, rows[:-1]) if len(first) else np.zeros(0, bool)
        self.group_first, self.group_last, self.group_low = first[several], last[several], low[several]

    def document(self, places: np.ndarray) -> np.ndarray:
        return self.documents[np.searchsorted(self.starts, places, side="right") - 1]

    def _least(self, row: np.ndarray, place: np.ndarray) -> np.ndarray:
        out = self.document(place)
        if len(self.group_first):
            group = np.maximum(np.searchsorted(self.group_first, row, side="right") - 1, 0)
            within = (self.group_first[group] <= row) & (row <= self.group_last[group])
            out[within] = self.group_low[group[within]]
        return out

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes that the text from a on and from b on have in common, up to `enough` or a little more."""
        out, alive = np.zeros(len(a), np.int64), np.arange(len(a))
        for k in range(0, self.enough, 8):
            x = self.words[a[alive] + k] ^ self.words[b[alive] + k]
            differ = x != 0
            low = x[differ] & (~x[differ] + np.uint64(1))
            # The lowest bit that differs is in the first byte that does.
            out[alive[differ]] = k + (np.frexp(low.astype(np.float64))[1] - 1) // 8
            alive = alive[~differ]
            if not len(alive):
                return out
        out[alive] = -(-self.enough // 8) * 8
        return out

    def least_documents(self, queries: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The least document that holds the `enough` bytes from each place of the queries (starts, sizes; END after each) on; _NONE if there's none."""
        out = np.full(len(queries), _NONE)
        order = np.argsort(-sizes, kind="stable")  # those still going are the first ones
        ends = (starts + sizes)[order]
        going = np.cumsum(np.bincount(sizes, minlength=int(sizes.max(initial=0)) + 1)[::-1])[::-1]  # queries of each size or more
        row, place, length = np.zeros(len(order), np.int64), np.full(len(order), self.origin), np.zeros(len(order), np.int64)
        for step in range(1, len(going)):
            m = int(going[step])
            at = ends[:m] - step
            c = queries[at].astype(np.int64)
            r, p, n = row[:m], place[:m], length[:m]
            run = np.searchsorted(self.key, c << 32 | r, side="right") - 1
            up = np.maximum(run, 0)
            miss = np.flatnonzero((self.byte[up] != c) | (self.last[up] < r) | (run < 0))
            if len(miss):
                r, p, n = r.copy(), p.copy(), n.copy()
                cm, pm, above = c[miss], p[miss], up[miss]
                below = np.minimum(run[miss] + 1, len(self.byte) - 1)
                has_above, has_below = (self.byte[above] == cm) & (run[miss] >= 0), self.byte[below] == cm
                near_above = np.where(has_above, self.shared(self.high[above], pm), -1)
                near_below = np.where(has_below, self.shared(self.low[below], pm), -1)
                take_above = near_above >= near_below
                chosen = np.where(take_above, above, below)
                gone = ~has_above & ~has_below
                run[miss] = chosen
                r[miss] = np.where(take_above, self.last[chosen], self.first[chosen])
                p[miss] = np.where(take_above, self.high[chosen], self.low[chosen])
                n[miss] = np.where(gone, -1, np.minimum(n[miss], np.maximum(near_above, near_below)))
            run = np.maximum(run, 0)
            inside = np.clip(r - self.first[run], 0, self.last[run] - self.first[run])
            row[:m] = np.where(n < 0, 0, self.into[run] + inside)
            place[:m] = np.where(n < 0, self.origin, p - 1)
            length[:m] = n + 1
            long = np.flatnonzero(length[:m] >= self.enough)
            out[at[long]] = self._least(row[long], place[long])
        return out
