"""Source divergence audit: how far the term shares of the sources of a language lie apart.

A term is a maximal run of letters A-Z, a-z and characters beyond ASCII, A-Z lower-cased. Each language
keeps the terms of at least ``least`` of its documents (V of them). Every (lang, source) group and
each language as a whole gives a kept term the smoothed share p = 1 + floor(10^9 (count + 2) / (N + 2 V)),
N being its occurrences of kept terms. Two shares differ by f = floor((p - q)^2 / (p + q)).

The group-term counts of a language are a matrix, of which tiles of ``ROWS`` groups and ``COLS`` terms are
K-squared trees (a quadrant without counts is not stored, any other has four quadrants below it). Two tiles of the same terms
are traversed together from their roots: where the quadrants of both are empty, each pair of groups has the same f
for every term, so it is priced once, as V times the f of a zero count; traversal goes on only where either
has counts, and at its leaves adds by how much f differs from that price. So no pair of empty cells is ever visited.

Tasks count the terms of their texts before anything is shuffled. All arithmetic is exact.

Defined cases: null text, language or source counts as the empty string; a group without terms takes part with
counts of zero; a language without kept terms has value 0 for its pairs; one of a single source has no pairs; repeated
rows count as often as they occur; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomeweave.llm.common import SLICE, cut, release, small

#: On the bytes of UTF-8: letters of ASCII and whatever is beyond it.
TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
LEAST_DOCUMENTS, TOP = 10, 10
#: Size of a tile; a task holds ROWS * ROWS * COLS leaves of two tiles at most.
ROWS, COLS = 32, 1024
#: Terms that a task counts before it emits them, and rows that leave it together.
HELD, OUT = 200_000, 20_000


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(lang, source, term, n, documents) as a task knows them; a null term stands for the group itself."""
    n, within = {}, {}

    def emit() -> Iterator[pd.DataFrame]:
        yield pd.DataFrame([(lang, source, None, 0, 0) for lang, source in n], columns=["lang", "source", "term", "n", "documents"])
        for key in list(n):
            counts, documents = n.pop(key), within.pop(key)
            names = list(counts)
            for begin in range(0, len(names), OUT):
                part = names[begin : begin + OUT]
                found = {"n": np.fromiter(map(counts.__getitem__, part), np.int64, len(part)), "documents": np.fromiter(map(documents.__getitem__, part), np.int64, len(part))}
                yield pd.DataFrame({"lang": key[0], "source": key[1], "term": b"\n".join(part).decode().split("\n"), **found})

    for whole in batches:
        for begin in range(0, len(whole), SLICE):
            batch = whole.iloc[begin : begin + SLICE]
            for lang, source, text in zip(batch["lang"], batch["source"], batch["text"], strict=True):
                terms = TERM.findall(text.encode().lower())  # bytes.lower() changes A-Z only
                key = (lang, source)
                n.setdefault(key, Counter()).update(terms)
                within.setdefault(key, Counter()).update(set(terms))
            if sum(map(len, n.values())) > HELD:
                yield from emit()
    yield from emit()
    release()


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, documents), and for every group a row whose term is null."""
    own = docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"), (text, "text"))))
    rows = own.mapInPandas(_counted, "lang string, source string, term string, n long, documents long")
    return cut(rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents")))


def share(n: Column, whole: Column) -> Column:
    """The smoothed share for a count; ``whole`` is N + 2 V."""
    return F.call_function("div", (n + 2).cast("decimal(19,0)") * F.lit(10**9).cast("decimal(10,0)"), whole.cast("decimal(20,0)")) + 1


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


class Tree:
    """A K-squared tree over cells (row, column): per level, the quadrants that hold any cell."""

    def __init__(self, row: np.ndarray, column: np.ndarray, height: int):
        self.levels = [np.unique((row >> (height - k) << k) + (column >> (height - k))) for k in range(height + 1)]

    def holds(self, level: int, row: np.ndarray, column: np.ndarray) -> np.ndarray:
        nodes, wanted = self.levels[level], (row << level) + column
        if not len(nodes):
            return np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(nodes, wanted), len(nodes) - 1)
        return nodes[at] == wanted


def joint_leaves(a: Tree, b: Tree, height: int, rows_a: int, rows_b: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, column) wherever either tree has a cell; of ``same`` rows only those with a before b."""
    ra = rb = column = np.zeros(1, np.int64)
    for level in range(1, height + 1):
        corner = np.arange(8)
        ra, rb, column = ((2 * x[:, None] + (corner >> k & 1)).ravel() for x, k in ((ra, 2), (rb, 1), (column, 0)))
        size = height - level
        inside = (ra << size < rows_a) & (rb << size < rows_b)
        if same:
            inside &= ra <= rb
        ra, rb, column = ra[inside], rb[inside], column[inside]
        either = a.holds(level, ra, column) | b.holds(level, rb, column)
        ra, rb, column = ra[either], rb[either], column[either]
    if same:
        ra, rb, column = (x[ra < rb] for x in (ra, rb, column)) if height else (ra[:0], rb[:0], column[:0])
    return ra, rb, column


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """As ``distance``, inside a task."""
    return (p - q) ** 2 // (p + q)


def _tile(rows: pd.DataFrame) -> pd.DataFrame:
    """By how much the pairs of two row blocks lie further apart in one block of terms than empty cells would. Rows without a term name the groups."""
    lang, block_a, block_b = rows["lang"].iloc[0], rows["block_a"].iloc[0], rows["block_b"].iloc[0]
    cells = rows[rows["term"].notna()]
    # Terms that the same groups use stand together, which keeps empty quadrants large.
    users = cells.groupby("term")["source"].agg(lambda x: tuple(sorted(set(x))))
    column_of = {term: k for k, term in enumerate(sorted(users.index, key=lambda term: (users[term], term)))}
    sides = []
    for block in (block_a, block_b):
        groups = rows[rows["term"].isna() & (rows["block"] == block)].drop_duplicates("source").sort_values("source")
        row_of = {source: k for k, source in enumerate(groups["source"])}
        own = cells[cells["block"] == block].drop_duplicates(["source", "term"])
        sides.append((groups["source"].to_numpy(), groups["p0"].to_numpy(np.int64), own["source"].map(row_of).to_numpy(np.int64), own["term"].map(column_of).to_numpy(np.int64), own["p"].to_numpy(np.int64)))
    (names_a, zero_a, row_a, column_a, p_a), (names_b, zero_b, row_b, column_b, p_b) = sides
    height = max(max(len(names_a), len(names_b), len(column_of)) - 1, 1).bit_length()
    ra, rb, column = joint_leaves(Tree(row_a, column_a, height), Tree(row_b, column_b, height), height, len(names_a), len(names_b), block_a == block_b)

    def filled(zero: np.ndarray, row: np.ndarray, col: np.ndarray, p: np.ndarray) -> np.ndarray:
        grid = np.repeat(zero[:, None], len(column_of), axis=1)
        grid[row, col] = p
        return grid

    p, q = filled(zero_a, row_a, column_a, p_a)[ra, column], filled(zero_b, row_b, column_b, p_b)[rb, column]
    more = np.zeros(len(names_a) * len(names_b), np.int64)
    np.add.at(more, ra * len(names_b) + rb, apart(p, q) - apart(zero_a[ra], zero_b[rb]))
    at = np.flatnonzero(more)
    return pd.DataFrame({"lang": lang, "a": names_a[at // max(len(names_b), 1)], "b": names_b[at % max(len(names_b), 1)], "more": more[at]})


def divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): per group the other sources by how far they lie apart (``pair``), and its ``top`` terms beyond the language's share (``term``)."""
    counts = term_counts(docs, text, lang, source)
    of_lang = counts.filter(F.col("term").isNotNull()).groupBy("lang", "term").agg(F.sum("documents").alias("documents"), F.sum("n").alias("lang_n")).filter(F.col("documents") >= least)
    kept = cut(of_lang.select("lang", "term", "lang_n"))
    cells = cut(counts.filter(F.col("term").isNotNull()).join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"))
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.filter(F.col("term").isNull()).select("lang", "source").join(totals, ["lang", "source"], "left").join(small(sizes), "lang", "left").na.fill(0)
    groups = groups.withColumn("whole", F.col("total") + 2 * F.col("v")).withColumn("p0", F.when(F.col("v") > 0, share(F.lit(0).cast("long"), F.col("whole"))).otherwise(0))
    in_lang = F.count(F.lit(1)).alias("groups")
    groups = small(groups.join(small(groups.groupBy("lang").agg(in_lang)), "lang").withColumn("blocks", F.ceil(F.col("groups") / ROWS).cast("int")).withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")))
    shared = cells.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("whole")))

    # Pairs: a price for empty cells, and what the tiles add to it.
    columns = F.ceil(F.col("v") / COLS).cast("int")
    tiles = lambda df: df.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"block_a": F.least("block", "other"), "block_b": F.greatest("block", "other")})
    fields = ["lang", "strip", "block_a", "block_b", "block", "source", "term", "p", "p0"]
    filled = tiles(shared.withColumn("strip", F.pmod(F.xxhash64("term"), columns).cast("int"))).select(fields)
    named = tiles(groups.filter("v > 0").withColumn("strip", F.explode(F.sequence(F.lit(0), columns - 1)))).withColumns({"term": F.lit(None).cast("string"), "p": F.col("p0")}).select(fields)
    added = filled.unionByName(named).groupBy("lang", "strip", "block_a", "block_b").applyInPandas(_tile, "lang string, a string, b string, more long")
    added = cut(added.groupBy("lang", "a", "b").agg(F.sum("more").alias("more")))
    both = added.unionByName(added.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "more"))
    one = groups.select("lang", F.col("source").alias("a"), F.col("p0").alias("pa"), "v")
    other = groups.select("lang", F.col("source").alias("b"), F.col("p0").alias("pb"))
    pairs = one.join(other, "lang").filter("a <> b").join(both, ["lang", "a", "b"], "left")
    value = F.when(F.col("v") > 0, F.col("v") * distance(F.col("pa"), F.col("pb")) + F.coalesce("more", F.lit(0))).otherwise(0)
    pairs = pairs.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), value.cast("long").alias("value"))

    lang_whole = F.col("lang_total") + 2 * F.col("v")
    terms = shared.withColumn("q", share(F.col("lang_n"), lang_whole)).filter("p > q")
    terms = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    ranked = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(ranked).alias("rank")
    return pairs.select("*", rank).unionByName(terms.select("*", rank).filter(F.col("rank") <= top))
