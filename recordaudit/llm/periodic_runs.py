"""Periodic runs of words: a suffix automaton and link-cut access find every maximal repetition of a text.

A run is a maximal stretch of words in which words a period apart are equal, at least two periods long. After a
word is appended, the path from the new prefix's state to the root of the suffix links is accessed: its states are
recoloured with the word's number, segment by segment of equal older colour. The deepest state of a segment is the
longest stretch that ends both at its old colour and here; if the distance of the two ends is no longer than that
stretch, the two copies overlap or touch. They are then a square, and the whole of it lies in one run, whose first
word and smallest period are known from length and distance and whose last word is the last place it is seen from.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordaudit.llm.hashing import Words, chunks, lean, mix, prefix, windows
from recordaudit.session import ship

#: Words a run has at least.
MIN_LENGTH = 12

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, text string"


class Automaton:
    """Suffix automaton of a word sequence. Most states have one transition, held in two arrays; the rest is in one table."""

    def __init__(self, words: list[int]):
        n = len(words)
        self.sigma = max(words, default=0) + 1
        self.length, self.link = array("q", [0]), array("q", [-1])
        self._word, self._to = array("q", [-1]), array("q", [-1])
        self._more: dict[int, int] = {}
        self._also: dict[int, list[int]] = {}
        self.prefix = array("q", bytes(8 * n))
        last = 0
        for i, word in enumerate(words):
            last = self.prefix[i] = self._append(last, word, i + 1)

    def _state(self, length: int) -> int:
        self.length.append(length)
        self.link.append(0)
        self._word.append(-1)
        self._to.append(-1)
        return len(self.length) - 1

    def _next(self, state: int, word: int) -> int:
        return self._to[state] if self._word[state] == word else self._more.get(state * self.sigma + word, -1)

    def _set(self, state: int, word: int, to: int) -> None:
        if self._word[state] < 0 or self._word[state] == word:
            self._word[state], self._to[state] = word, to
            return
        key = state * self.sigma + word
        if key not in self._more:
            self._also.setdefault(state, []).append(word)
        self._more[key] = to

    def _append(self, last: int, word: int, length: int) -> int:
        new, state = self._state(length), last
        while state >= 0 and (to := self._next(state, word)) < 0:
            self._set(state, word, new)
            state = self.link[state]
        if state < 0:
            return new
        if self.length[to] == self.length[state] + 1:
            self.link[new] = to
            return new
        twin = self._state(self.length[state] + 1)
        self.link[twin] = self.link[to]
        self._set(twin, self._word[to], self._to[to])
        for other in self._also.get(to, ()):
            self._set(twin, other, self._more[to * self.sigma + other])
        while state >= 0 and self._next(state, word) == to:
            self._set(state, word, twin)
            state = self.link[state]
        self.link[to] = self.link[new] = twin
        return new

    def spans(self) -> tuple[list[int], list[int], list[int]]:
        """Places of the prefixes such that each state's subtree is a range: (place of prefix, first and end by state)."""
        length, link = np.array(self.length), np.array(self.link)
        by_length = np.argsort(length, kind="stable")
        count = [0] * len(length)
        for state in self.prefix:
            count[state] = 1
        links = link.tolist()
        for state in by_length[:0:-1].tolist():
            count[links[state]] += count[state]
        own = set(self.prefix)
        first, free = [0] * len(count), [0] * len(count)
        for state in by_length.tolist():
            if state:
                above = links[state]
                first[state] = free[above]
                free[above] += count[state]
            free[state] = first[state] + (state in own)
        return [first[s] for s in self.prefix], first, [f + c for f, c in zip(first, count)]


def runs_of(words: list[int], min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least ``min_length`` words and two periods, by start and period."""
    n = len(words)
    if n < min_length or n < 2:
        return []
    automaton = Automaton(words)
    place, first, end = automaton.spans()
    length, link = automaton.length.tolist(), automaton.link.tolist()
    # Stretches under half of the least length can't settle a run: their states count as the root.
    least = max(1, (min_length + 1) // 2)
    newest = [-1] * (2 * n)  # the newest colour below every node of a binary tree over the places
    coloured = bytearray(len(length))
    above = [0] * n  # state over the top of each colour's segment
    found: dict[tuple[int, int], int] = {}
    for i in range(n):
        state = link[automaton.prefix[i]]
        coloured[automaton.prefix[i]] = 1
        while length[state] >= least and not coloured[state]:
            coloured[state] = 1
            state = link[state]
        while length[state] >= least:
            low, high, colour = first[state] + n, end[state] + n, -1
            while low < high:
                if low & 1:
                    if newest[low] > colour:
                        colour = newest[low]
                    low += 1
                if high & 1:
                    high -= 1
                    if newest[high] > colour:
                        colour = newest[high]
                low >>= 1
                high >>= 1
            period, stretch = i - colour, length[state]
            if period <= stretch:
                found[i - period - stretch + 1, period] = i
            state, above[colour] = above[colour], state
        node = place[i] + n
        while node:
            newest[node] = i
            node >>= 1
    return sorted((start, last - start + 1, period) for (start, period), last in found.items()
                  if last - start + 1 >= max(min_length, 2 * period))


def _stretches(words: Words, k: int, least: int) -> list[tuple[int, int]]:
    """Word ranges of a chunk that can hold runs: every run lies in one of them.

    A run of ``least`` words has k = least / 2 or more words in a row that are equal a period on, and the period is at most half
    of the range; so words outside such repeated stretches of k words are outside every run. Cuts are repeated until nothing changes.
    """
    grams = windows(prefix(words.hashes), k)
    at = np.arange(len(grams))
    text = np.searchsorted(words.first, at, side="right") - 1
    inside = at + k <= words.first[text + 1]
    at, text = at[inside], text[inside]
    low, high = words.first[text], words.first[text + 1]
    while len(at):
        # The range number makes equal stretches of different ranges differ.
        keys = mix(grams[at] + mix(low.astype(np.uint64)))
        order = np.argsort(keys, kind="stable")
        same = keys[order[1:]] == keys[order[:-1]]
        near = same & ((at[order[1:]] - at[order[:-1]]) * 2 <= (high - low)[order[1:]])
        keep = np.zeros(len(at), bool)
        keep[order[1:][near]] = True
        keep[order[:-1][near]] = True
        if keep.all():
            break
        at, old = at[keep], low[keep]
        if not len(at):
            break
        # Neighbouring stretches of one range join where they touch or overlap.
        starts = np.concatenate([[True], (at[1:] > at[:-1] + k) | (old[1:] != old[:-1])])
        number = np.cumsum(starts) - 1
        firsts = at[starts]
        ends = np.concatenate([at[np.flatnonzero(starts)[1:] - 1], at[-1:]]) + k
        long = (ends - firsts >= least)[number]
        at, low, high = at[long], firsts[number][long], ends[number][long]
    return sorted(set(zip(low.tolist(), high.tolist()))) if len(at) else []


def find(texts: list[bytes | None], min_length: int = MIN_LENGTH) -> Iterator[tuple[int, list[tuple[int, int, int]], bytes]]:
    """Per text: its number of words, its runs, and its words without those after the first period of a run."""
    least = max(2, min_length)
    for a, b in chunks(texts):
        words = Words(texts[a:b])
        ranges = _stretches(words, max(1, least // 2), least)
        owner = np.searchsorted(words.first, [r[0] for r in ranges], side="right") - 1
        mine: dict[int, list[tuple[int, int]]] = {}
        for of, (low, high) in zip(owner.tolist(), ranges):
            mine.setdefault(of, []).append((low - int(words.first[of]), high - int(words.first[of])))
        for k in range(b - a):
            said = (texts[a + k] or b"").split()  # bytes split at exactly 0x20 and 0x09-0x0D
            runs, gone = [], bytearray(len(said))
            for low, high in mine.get(k, ()):
                ids: dict[bytes, int] = {}
                numbers = [ids.setdefault(w, len(ids)) for w in said[low:high]]
                runs += [(low + start, length, period) for start, length, period in runs_of(numbers, min_length)]
            reach = 0
            for start, length, period in runs:
                gone[start + period:start + length] = b"\1" * (length - period)
                reach = max(reach, start + length)
            kept = [w for w, out in zip(said, gone) if not out] if reach else said
            yield len(said), runs, b" ".join(kept)


def collapse_runs(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """(doc_id, n_words, runs, text): the runs of every row's whole text, and the text with each run cut to one period.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0 and compared exactly. ``runs`` is sorted by start and period; a word is
    dropped from ``text`` if any run holds it after that run's first period; kept words are joined by one space. A null
    or empty text has no words, no runs and an empty text. Rows are judged one by one, so ties, repeated or null ids
    change nothing; an empty table gives no rows; other columns are ignored. A row costs n log n steps of its own words
    in possible runs, and nothing is shuffled.
    """
    ship(docs.sparkSession)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(find(batch.column(1).cast(pa.binary()).to_pylist(), min_length))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([n for n, _, _ in found], pa.int64()),
                pa.array([[dict(zip(("start", "length", "period"), r)) for r in runs] for _, runs, _ in found], pa.list_(RUN)),
                pa.array([text for _, _, text in found], pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "text"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(look), SCHEMA)
