"""Run-length index of a repetitive text: a run-compressed Burrows-Wheeler transform with samples, and matching statistics.

The index covers many short texts, joined in the order of their priority. Suffixes are sorted by their first ``width``
symbols, ties by position, so that equal strings of ``width`` symbols are one class of rows whose first row is their
earliest occurrence. That is all that backward search needs for strings of up to ``width`` symbols.
"""

from __future__ import annotations

import numpy as np

#: Symbols are bytes plus one; 0 ends a text.
_BITS = 9


def _classes(first: np.ndarray, second: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows sorted by (first, second), ties by position; the class of each position; rows that begin a class."""
    key = first * np.int64(n + 1) + second
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    starts = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(starts) - 1
    return order, rank, np.flatnonzero(starts)


def sort_suffixes(symbols: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array by the first ``width`` symbols, class of each position, first row of each class; by prefix doubling."""
    n, have = len(symbols), 63 // _BITS
    padded = np.concatenate([symbols.astype(np.int64), np.zeros(width, np.int64)])
    have = min(have, width)
    key = np.zeros(n, np.int64)
    for i in range(have):
        key = (key << _BITS) | padded[i:i + n]
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    starts = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(starts) - 1
    first = np.flatnonzero(starts)
    while have < width:
        step = min(have, width - have)
        ahead = np.zeros(n, np.int64)
        ahead[:n - step] = rank[step:] + 1
        order, rank, first = _classes(rank, ahead, n)
        have += step
    return order, rank, first


class RunIndex:
    """Run-length Burrows-Wheeler transform of texts, with position samples at the first row of each class.

    ``texts`` is the concatenation of all texts (uint8), ``lengths`` their lengths. Kept are, per run: its first row,
    symbol and the row its first entry maps to; per class: its first row and the earliest position. The suffix
    array itself is dropped.
    """

    def __init__(self, texts: np.ndarray, lengths: np.ndarray, width: int):
        self.width = width
        ends = np.cumsum(lengths + 1)
        self.starts = ends - lengths - 1
        symbols = np.zeros(int(ends[-1]), np.int16)
        inside = np.ones(len(symbols), bool)
        inside[ends - 1] = False
        symbols[inside] = texts.astype(np.int16) + 1
        n = self.n = len(symbols)
        order, _, self.class_row = sort_suffixes(symbols, width)
        self.class_end = np.append(self.class_row[1:], n)
        self.class_at = order[self.class_row]
        before = symbols[order - 1]  # position 0 follows the end of the last text
        edge = np.concatenate([[True], before[1:] != before[:-1]])
        run = np.flatnonzero(edge)
        symbol = before[run].astype(np.int64)
        size = np.diff(np.append(run, n))
        by_symbol = np.argsort(symbol, kind="stable")
        row = np.empty(len(run), np.int64)
        row[by_symbol] = np.concatenate([[0], np.cumsum(size[by_symbol])[:-1]])
        # Runs in the order of (symbol, first row): one sorted key finds a symbol's run at or after a row.
        self.run_key = symbol[by_symbol] * n + run[by_symbol]
        self.run_first, self.run_size, self.run_maps = run[by_symbol], size[by_symbol], row[by_symbol]
        counts = np.bincount(symbols, minlength=258)
        self.symbol_row = np.concatenate([[0], np.cumsum(counts)])
        self.symbols, self.lengths = symbols, lengths

    def _mapped(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Row that follows all rows before ``row`` whose symbol is ``symbol``: the backward step of a bound."""
        k = np.searchsorted(self.run_key, symbol * self.n + row, side="left") - 1
        same = (k >= 0) & (self.run_key[np.maximum(k, 0)] >= symbol * self.n)
        k = np.maximum(k, 0)
        inside = np.minimum(row - self.run_first[k], self.run_size[k])
        return np.where(same, self.run_maps[k] + inside, self.symbol_row[symbol])

    def match(self, reversed_streams: np.ndarray) -> np.ndarray:
        """Matching statistics of equally long streams (one per row, last symbol first), cut at ``width``.

        Returns, per stream and step, the class of the string of ``width`` symbols that begins there, or -1 where
        the match is shorter. All streams advance together, a symbol per step. Symbol 0 ends a match.
        """
        count, steps = reversed_streams.shape
        low, high = np.zeros(count, np.int64), np.full(count, self.n, np.int64)
        size = np.zeros(count, np.int64)
        out = np.full((count, steps), -1, np.int64)
        for step in range(steps):
            symbol = reversed_streams[:, step].astype(np.int64)
            new_low, new_high = self._mapped(symbol, low), self._mapped(symbol, high)
            found = (new_high > new_low) & (symbol > 0)
            low, high = np.where(found, new_low, 0), np.where(found, new_high, self.n)
            size = np.where(found, size + 1, 0)
            full = np.flatnonzero(size >= self.width)
            if len(full):
                # Longer matches are cut to ``width`` symbols: the whole class of the row.
                k = np.searchsorted(self.class_row, low[full], side="right") - 1
                low[full], high[full] = self.class_row[k], self.class_end[k]
                out[full, step] = k
        return out

    def earliest(self, batch: int = 4096) -> np.ndarray:
        """Per position of the joined texts, the earliest position of its string of ``width`` symbols, -1 if it is shorter.

        The texts are streamed through the index in batches of similar length; memory follows the batch.
        """
        out = np.full(self.n, -1, np.int64)
        by_size = np.argsort(self.lengths, kind="stable")
        start = 0
        while start < len(by_size):
            longest = int(self.lengths[by_size[min(start + batch, len(by_size)) - 1]])
            # Few streams at a time where they are long: the batch is bounded in symbols, not only in streams.
            take = max(1, min(batch, (1 << 22) // max(longest, 1)))
            part = by_size[start:start + take]
            start += take
            longest = int(self.lengths[part[-1]])
            steps = np.arange(longest)
            at = self.starts[part][:, None] + self.lengths[part][:, None] - 1 - steps
            known = steps < self.lengths[part][:, None]
            streams = np.where(known, self.symbols[np.maximum(at, 0)], 0)
            found = self.match(streams)
            hit = found >= 0
            out[at[hit]] = self.class_at[found[hit]]
        return out
