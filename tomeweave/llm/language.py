"""Language identification by cross-parsing.

A suffix automaton holds the labelled text of each language. A whole text (in lower case, its letters only, with one blank
between words) is parsed into the longest phrases that occur in a language's
text; the number of phrases, times the logarithm of the language's text length, per
letter, estimates the cross entropy (Ziv and Merhav 1993). The language that needs
fewest wins.

The automata are fitted on a bounded sample of labelled rows: of each language the distinct texts of the least
hashes, ``SAMPLE_DOCS`` at most, as long as they have ``SAMPLE_CHARS`` characters together; texts are taken whole, and a text
that would pass that bound is left out (a language that has only longer ones has its shortest). Predictions read
whole texts. The score is the margin to the next language, from 0 to 1.

Defined cases: a null text, one without letters, or no labelled text at all gives ``und`` and
score 0; with one language only, the score is 1; of equal languages the first by name wins; repeated rows are
predicted one by one and are one text of the sample; added columns give way to columns of the input with the same name.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tomeweave.llm.bpe import Pairs
from tomeweave.llm.common import small, spare

SAMPLE_DOCS, SAMPLE_CHARS = 200, 40_000
#: Parts in which the texts of a language are ranked.
SHARES = 32
#: Texts that are parsed in step.
LANES = 4000
#: Moves up to which a table holds them all, by state and letter; beyond (large alphabets), they are hashed.
FULL_MOVES = 1 << 25
UNKNOWN = "und"
#: What parts the texts of a language in a sample.
BETWEEN = "\x1e"
#: Word characters that are neither letters nor decimal digits: fractions, circled and Roman numbers. None stands beyond the second plane;
#: those of the second one are blanked first, as a class with them is slow.
_NUMBERS = [c for c in map(chr, range(0x20000)) if unicodedata.category(c) in ("No", "Nl")]
_FAR, _FAR_NUMBERS = re.compile("[\U00010000-\U0001ffff]"), {ord(c): " " for c in _NUMBERS if c > "\uffff"}
_NO_LETTERS = re.compile(rf"[\W\d_{''.join(c for c in _NUMBERS if c <= chr(0xFFFF))}]+")


class SuffixAutomaton:
    """All substrings of one text: ``moves[state][letter]`` leads to the next state, state 0 begins."""

    def __init__(self, text: str):
        self.moves: list[dict[str, int]] = [{}]
        link, length, last = [-1], [0], 0
        moves = self.moves
        for c in text:
            new = len(moves)
            moves.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in moves[p]:
                moves[p][c] = new
                p = link[p]
            if p >= 0:
                q = moves[p][c]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    clone = len(moves)
                    moves.append(moves[q].copy())
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and moves[p].get(c) == q:
                        moves[p][c] = clone
                        p = link[p]
                    link[q] = link[new] = clone
            last = new

    def phrases(self, text: str) -> int:
        """Phrases of the greedy parse: each the longest match, or one unknown letter."""
        moves, count, state = self.moves, 0, 0
        for c in text:
            to = moves[state].get(c)
            if to is None:
                count += 1
                to = moves[0].get(c)
                if to is None:
                    count += state != 0  # the letter is a phrase of its own
                    to = 0
            state = to
        return count + (state != 0)


def plain(text: str | None) -> str:
    """Letters in lower case, a blank between words and at either end; empty without letters."""
    text = (text or "").lower()
    if _FAR.search(text):
        text = text.translate(_FAR_NUMBERS)
    words = _NO_LETTERS.sub(" ", text).strip()
    return f" {words} " if words else ""


class Model:
    """The automata of all languages in one table of moves. A batch of texts is parsed in step, a lane for each text, by all languages at once."""

    #: Texts that are parsed on one by one once no more are left of a batch.
    FEW = 24

    def __init__(self, samples: tuple[tuple[str, str], ...]):
        # No phrase reaches over a line break, as plain texts have none.
        samples = tuple((name, "\n".join(map(plain, texts.split(BETWEEN)))) for name, texts in samples)
        self.names = [name for name, _ in samples]
        self.weights = np.array([math.log2(max(2, len(text))) for _, text in samples])
        letters = sorted(set("".join(text for _, text in samples)))
        self.codes = np.zeros(0x110000, np.int32)
        for k, c in enumerate(letters):
            self.codes[ord(c)] = k + 1
        self.width = len(letters) + 1
        self.moves: dict[int, int] = {}
        self.begins = np.zeros((len(samples), 1), np.int64)
        self.first = np.full((len(samples), self.width), -1, np.int64)
        begin = 0
        for k, (_, text) in enumerate(samples):
            own = SuffixAutomaton(text).moves
            for state, moves in enumerate(own):
                for c, to in moves.items():
                    self.moves[(begin + state) * self.width + int(self.codes[ord(c)])] = begin + to
            self.begins[k] = begin
            for c, to in own[0].items():
                self.first[k, self.codes[ord(c)]] = begin + to
            begin += len(own)
        self.full = self._filled(begin) if begin * self.width <= FULL_MOVES else None
        self.table = Pairs(self.moves) if self.full is None else None

    def _filled(self, states: int) -> np.ndarray:
        """By state and letter: four times the next state, and the phrases that the step ends."""
        lost = np.where(self.first < 0, self.begins, self.first) * 4 + 1 + (self.first < 0)
        out = np.repeat(lost, np.diff(np.append(self.begins[:, 0], states)), axis=0).astype(np.int32)
        for begin, row in zip(self.begins[:, 0], lost, strict=True):
            out[begin] = row - (row & 3) + 1
        out = out.ravel()
        out[np.fromiter(self.moves.keys(), np.int64, len(self.moves))] = np.fromiter(self.moves.values(), np.int64, len(self.moves)) * 4
        return out

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases by language and plain text."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        letters = self.codes.take(np.frombuffer("".join(texts).encode("utf-32-le"), "<u4"))
        order = np.argsort(-lengths, kind="stable")
        begins, left = (lengths.cumsum() - lengths)[order], lengths[order]
        state = np.repeat(self.begins, len(texts), axis=1)
        count = np.zeros(state.shape, np.int64)
        step, lanes = 0, len(texts)
        while True:
            while lanes and left[lanes - 1] <= step:
                lanes -= 1
            if lanes <= self.FEW:
                break
            c, own = letters.take(begins[:lanes] + step), state[:, :lanes]
            if self.full is not None:
                to = self.full.take(own * self.width + c)
                count[:, :lanes] += to & 3
                state[:, :lanes] = to >> 2
                step += 1
                continue
            to = self.table.find((own * self.width + c).ravel()).reshape(own.shape).astype(np.int64)
            missing = to == Pairs.NONE
            first = self.first.take(c, axis=1)
            unknown = first < 0
            count[:, :lanes] += missing
            count[:, :lanes] += missing & unknown & (own != self.begins)  # the letter is a phrase of its own
            state[:, :lanes] = np.where(missing, np.where(unknown, self.begins, first), to)
            step += 1
        for lane in range(lanes):
            rest = letters[begins[lane] + step : begins[lane] + left[lane]].tolist()
            for k in range(len(self.names)):
                state[k, lane], more = self._rest(rest, int(state[k, lane]), int(self.begins[k, 0]), self.first[k].tolist())
                count[k, lane] += more
        count += state != self.begins
        out = np.empty_like(count)
        out[:, order] = count
        return out

    def _rest(self, letters: list[int], state: int, begin: int, first: list[int]) -> tuple[int, int]:
        get, width, count = self.moves.get, self.width, 0
        for c in letters:
            to = get(state * width + c)
            if to is None:
                count += 1
                to = first[c]
                if to < 0:
                    count += state != begin
                    to = begin
            state = to
        return state, count

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        own = [plain(x) for x in texts]
        if not self.names:
            return [(UNKNOWN, 0.0)] * len(own)
        letters = np.array([len(x) - x.count(" ") for x in own])
        rates = self.phrases(own) * self.weights[:, None] / np.maximum(letters, 1)
        out = []
        for k, n in enumerate(letters):
            if not n:
                out.append((UNKNOWN, 0.0))
                continue
            ranked = sorted(zip(rates[:, k].tolist(), self.names, strict=True))
            score = 1.0 if len(ranked) == 1 else 1 - ranked[0][0] / ranked[1][0] if ranked[1][0] else 0.0
            out.append((ranked[0][1], score))
        return out


@lru_cache(maxsize=2)
def model(samples: tuple[tuple[str, str], ...]) -> Model:
    return Model(samples)


def sample(labelled: DataFrame, text: str = "text", lang: str = "lang") -> tuple[tuple[str, str], ...]:
    """(language, its texts) by name. Only hashes and lengths are ranked; at most SAMPLE_DOCS of them for each language, and then the texts of the bound, go to the driver."""
    rows = labelled.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    rows = rows.withColumn("h", F.xxhash64("text"))
    # Copies share their hash: one row for each distinct text, counted within tasks first.
    texts = rows.groupBy("lang", "h").agg(F.min(F.length("text")).alias("n"))
    # The least of each share first: a language may hold most rows, and the least of all are among them.
    ranked = texts.filter(F.col("n") <= SAMPLE_CHARS).withColumn("share", F.pmod(F.xxhash64("h"), F.lit(SHARES)))
    for keys in (["lang", "share"], ["lang"]):
        ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("h"))).filter(F.col("rank") <= SAMPLE_DOCS)
    chosen: dict[str, tuple[int, list[int]]] = {}
    for r in ranked.orderBy("lang", "rank").collect():
        held, own = chosen.get(r["lang"], (0, []))
        if held + r["n"] <= SAMPLE_CHARS:
            chosen[r["lang"]] = held + r["n"], [*own, r["h"]]
    shortest = texts.groupBy("lang").agg(F.min(F.struct("n", "h")).alias("s")).collect()
    wanted = [(name, h) for name, (_, own) in chosen.items() for h in own] + [(r["lang"], r["s"]["h"]) for r in shortest if r["lang"] not in chosen]
    if not wanted:
        return ()
    named = small(labelled.sparkSession.createDataFrame(wanted, "lang string, h long"))
    taken = rows.join(named, ["lang", "h"], "left_semi").groupBy("lang", "h").agg(F.min("text").alias("text")).orderBy("lang", "h").collect()
    joined: dict[str, list[str]] = {}
    for r in taken:
        joined.setdefault(r["lang"], []).append(r["text"])
    return tuple(sorted((name, BETWEEN.join(own)) for name, own in joined.items()))


def predict(docs: DataFrame, samples: tuple[tuple[str, str], ...], text: str = "text", name: str = "language") -> tuple[DataFrame, str]:
    """``docs`` with a struct (lang, score) more; also returns that column's name."""
    shared, name = docs.sparkSession.sparkContext.broadcast(samples), spare(docs, name)

    @F.pandas_udf(T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())]))
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = model(shared.value)
        for batch in texts:
            for begin in range(0, len(batch), LANES):
                yield pd.DataFrame(own.predict(batch.iloc[begin : begin + LANES].tolist()), columns=["lang", "score"])

    return docs.withColumn(name, run.asNondeterministic()(F.col(f"`{text}`").cast("string"))), name


def held_out(doc_id: Column) -> Column:
    """Whether a document is never learned from: crc32 of its id as text leaves 2 modulo 4 (a null id: the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2
