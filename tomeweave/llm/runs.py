"""Periodic runs of words, by longest common extensions on suffix trees.

A run is a stretch of consecutive words with smallest period q and at least ``max(LEAST, 2 q)`` words that
no neighbouring word extends. Every run holds a Lyndon root: from one of its places the longest Lyndon word, under one order of
the words or the reversed order, is one period long. Such a word ends before the next smaller suffix. So each
place gives two candidates (place, period); each is extended to the right by the longest common prefix of two suffixes and to
the left by the longest common suffix of two prefixes, both in constant time: the lowest common ancestor
of two leaves of a suffix tree (Ukkonen's, of the words and of their reversal) is the least depth on its Euler tour between them.

Most words of a text lie in no run, and need no tree. In a run each three words begin another occurrence, one
period away, but for at most two places around its middle. So texts fall into stretches where triples recur,
each counted again on its own until it no longer falls apart; a run is never cut by this, and what
is left goes through the trees. Each text is handled in one task, with memory in proportion to its longest stretch.

Defined cases: a null or empty text has no words and no runs, and stays; repeated rows give equal results; an empty
table gives an empty result; added columns give way to columns of the input with the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tomeweave.llm.common import release, slices, spare

#: Words of a run at least; it also has two periods.
LEAST = 12


class SuffixTree:
    """Ukkonen's suffix tree of a row of numbers, ended by a number of its own; its Euler tour answers longest common prefixes."""

    def __init__(self, symbols: list[int]):
        self.symbols = text = [*symbols, -1]
        size = len(text)
        # A node's edge is text[start:stop]; an open stop (size) belongs to a leaf.
        start, stop, link, kids = [0], [0], [0], [{}]
        node, edge, length, pending = 0, 0, 0, 0
        for at, symbol in enumerate(text):
            pending += 1
            waiting = -1
            while pending:
                if not length:
                    edge = at
                child = kids[node].get(text[edge])
                if child is None:
                    kids[node][text[edge]] = len(start)
                    start.append(at), stop.append(size), link.append(0), kids.append(None)
                    if waiting >= 0:
                        link[waiting], waiting = node, -1
                else:
                    span = min(stop[child], at + 1) - start[child]
                    if length >= span:
                        edge, length, node = edge + span, length - span, child
                        continue
                    if text[start[child] + length] == symbol:
                        length += 1
                        if waiting >= 0:
                            link[waiting] = node
                        break
                    inner, leaf = len(start), len(start) + 1
                    first = start[child]
                    start += [first, at]
                    stop += [first + length, size]
                    link += [0, 0]
                    kids += [{text[first + length]: child, symbol: leaf}, None]
                    kids[node][text[edge]] = inner
                    start[child] = first + length
                    if waiting >= 0:
                        link[waiting] = inner
                    waiting = inner
                pending -= 1
                if node:
                    node = link[node]
                elif length:
                    length, edge = length - 1, at - pending + 1
        self.size, self._start, self._stop, self._kids = size - 1, start, stop, kids
        depths, places = [], [0] * size
        for depth, place in self._tour(descending=False):
            if place >= 0:
                places[place] = len(depths)
            depths.append(depth)
        self.places = np.array(places, np.int64)
        self.least = RangeLeast(np.array(depths, np.int64))

    def _tour(self, descending: bool) -> Iterator[tuple[int, int]]:
        """(depth, place of the suffix or -1) along the Euler tour: an inner node stands before, between and after its children."""
        start, stop, kids, end = self._start, self._stop, self._kids, self.size + 1
        stack = [(0, 0, None)]
        while stack:
            node, depth, rest = stack.pop()
            if rest is None:
                own = kids[node]
                depth += stop[node] - start[node]
                if own is None:
                    yield depth, end - depth
                    continue
                names = sorted(own)
                if descending:  # the end stays before all symbols
                    names = names[:1] + names[:0:-1] if names[0] < 0 else names[::-1]
                rest = iter([own[x] for x in names])
            yield depth, -1
            child = next(rest, None)
            if child is not None:
                stack.append((node, depth, rest))
                stack.append((child, depth, None))

    def rank(self, descending: bool = False) -> list[int]:
        """The place of each suffix in their order; under either order of the symbols a suffix is before those it begins."""
        out, k = [0] * (self.size + 1), 0
        for _, place in self._tour(descending):
            if place >= 0:
                out[place] = k
                k += 1
        return out[: self.size]

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The length of the longest common prefix of the suffixes at different places i and j; 0 where one lies beyond the end."""
        a, b = self.places[np.minimum(i, self.size)], self.places[np.minimum(j, self.size)]
        out = self.least(np.minimum(a, b), np.maximum(a, b))
        return np.where((i >= self.size) | (j >= self.size), 0, out)


class RangeLeast:
    """Least values of ranges in constant time: a sparse table over blocks, prefixes and suffixes of blocks; ranges within a block are looked through."""

    BLOCK = 16

    def __init__(self, values: np.ndarray):
        block = self.BLOCK
        n = -(-len(values) // block)
        padded = np.full(n * block, np.iinfo(np.int64).max)
        padded[: len(values)] = values
        grid = padded.reshape(n, block)
        self.values = padded
        self.before = np.minimum.accumulate(grid, axis=1).ravel()
        self.after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        self.table = [grid.min(axis=1)]
        while len(self.table[-1]) > 1 << (len(self.table) - 1):
            last, step = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(last[:-step], last[step:]))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For a <= b, both included."""
        block = self.BLOCK
        x, y = a // block, b // block
        out = np.minimum(self.after[a], self.before[b])
        inside = np.flatnonzero(x == y)
        if len(inside):
            steps = a[inside, None] + np.arange(block)
            steps = np.minimum(steps, b[inside, None])
            out[inside] = self.values[steps].min(axis=1)
        far = np.flatnonzero(y - x > 1)
        if len(far):
            first, count = x[far] + 1, y[far] - x[far] - 1
            level = np.frexp(count.astype(np.float64))[1] - 1
            for k in np.unique(level):
                mine = level == k
                row, begin, many = self.table[k], first[mine], count[mine]
                at = far[mine]
                out[at] = np.minimum(out[at], np.minimum(row[begin], row[begin + many - (1 << int(k))]))
        return out


def next_smaller(rank: list[int]) -> list[int]:
    """For each place the next one with a smaller rank; the end where there is none."""
    out, stack = [len(rank)] * len(rank), []
    for k in range(len(rank) - 1, -1, -1):
        own = rank[k]
        while stack and rank[stack[-1]] > own:
            stack.pop()
        if stack:
            out[k] = stack[-1]
        stack.append(k)
    return out


def runs_of(symbols: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a row of numbers, by start, then period."""
    n = len(symbols)
    if n < max(least, 2):
        return []
    forward = SuffixTree(symbols.tolist())
    backward = SuffixTree(symbols[::-1].tolist())
    place = np.arange(n)
    found = []
    for descending in (False, True):
        period = np.array(next_smaller(forward.rank(descending)), np.int64) - place
        right = forward.common(place, place + period)
        left = backward.common(n - place, n - place - period)
        begin, stop = place - left, place + period + right
        long = stop - begin >= np.maximum(least, 2 * period)
        found.append(np.stack([begin[long], (stop - begin)[long], period[long]], axis=1))
    rows = np.unique(np.concatenate(found), axis=0)
    return [tuple(x) for x in rows[np.lexsort((rows[:, 2], rows[:, 0]))].tolist()]


def _recurring(symbols: np.ndarray) -> np.ndarray:
    """Which triples of a row of small numbers occur twice or more."""
    many = int(symbols.max()) + 1
    if many < 1 << 21:
        triple = (symbols[:-2] * many + symbols[1:-1]) * many + symbols[2:]
    else:  # equal triples stay equal; others may become so, which only leaves more to the trees
        triple = symbols[:-2] * 0x9E3779B97F4A7C15 + symbols[1:-1] * 0x27D4EB2F165667C5 + symbols[2:]
    _, inverse, counts = np.unique(triple, return_inverse=True, return_counts=True)
    return counts[inverse] > 1


def stretches(symbols: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """(start, end) of the stretches that can hold a run: triples recur within them, with gaps of two places at most."""
    out, open_ = [], [(0, len(symbols))]
    while open_:
        start, end = open_.pop()
        if end - start < max(least, 3):
            continue
        at = np.flatnonzero(_recurring(symbols[start:end]))
        if not len(at):
            continue
        breaks = np.flatnonzero(np.diff(at) > 3)
        parts = list(zip(start + at[np.concatenate([[0], breaks + 1])], start + at[np.concatenate([breaks, [len(at) - 1]])] + 3, strict=True))
        if parts == [(start, end)]:
            out.append((start, end))
        else:
            open_ += parts
    return sorted(out)


def find_runs(words: list, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of words, by start, then period."""
    if len(words) < max(least, 3):
        return []
    numbers: dict = {}
    symbols = np.array([numbers.setdefault(x, len(numbers)) for x in words], np.int64)
    return [(start + s, length, period) for start, end in stretches(symbols, least) for s, length, period in runs_of(symbols[start:end], least)]


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay when every run is collapsed to its first period."""
    kept = np.ones(n, bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return kept


_RUN = T.ArrayType(T.StructType([T.StructField(x, T.LongType()) for x in ("start", "length", "period")]))


def _runs(least: int):
    @F.pandas_udf(T.StructType([T.StructField("runs", _RUN), T.StructField("text", T.StringType())]))
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in (part for whole in texts for part in slices(whole)):
            rows = []
            for text in batch:
                words = (text or "").encode().split()
                found = find_runs(words, least)
                if found:
                    text = b" ".join([words[k] for k in np.flatnonzero(kept_words(len(words), found))]).decode()
                elif text is not None:
                    text = b" ".join(words).decode()
                rows.append(([{"start": s, "length": n, "period": p} for s, n, p in found], text))
            yield pd.DataFrame(rows, columns=["runs", "text"])
        release()

    return run.asNondeterministic()


def periodic_runs(docs: DataFrame, text: str = "text", runs: str = "runs", collapsed: str = "collapsed", least: int = LEAST) -> tuple[DataFrame, str, str]:
    """``docs`` with the runs of ``text`` (by start, then period) and its words, each run cut down to its first period, joined by blanks; also returns the columns' names."""
    runs, collapsed, both = spare(docs, runs), spare(docs, collapsed), spare(docs, "both")
    rows = docs.withColumn(both, _runs(least)(F.col(f"`{text}`").cast("string")))
    return rows.withColumns({runs: F.col(both)["runs"], collapsed: F.col(both)["text"]}).drop(both), runs, collapsed
