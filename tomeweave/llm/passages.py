"""Substring dedup by hashing normalised units of text.

A unit is a paragraph (blank lines part them), a line or a sentence of a line, lower-cased and with
its blanks collapsed; units of fewer than ``UNIT_WORDS`` words are taken together with the ones that follow
until there are as many, from every unit on. A text with fewer words is one unit as a whole. Several kinds may be
asked for together: lines, and their sentences for passages that begin and end within lines. Digests are grouped over
all documents; the occurrence in the first document (in it, the first one) stays and all
others are removed. Kept texts come with the removed spans as offsets into the original.

Documents rank by id (null last), then by the digest of their text. Rows of one id and one text are numbered
(they are checkpointed for it, and are few in most tables); all but one of them are repeats as a whole.

Two passes read the texts: their digests are kept in the shared folder, counted and matched, then texts that hold a
repeat are cut. Digests and keys of documents are shuffled by digest, pre-aggregated, with one row per document
and digest however often it repeats there. A digest that very many documents share is one key of that join: AQE parts it.
The texts meet what goes from them in a join by key.

Defined cases: a null text stays null and has no units, nor has one without words; ids may be of any type that orders; an empty table
gives an empty result; added columns give way to columns of the input with the same name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tomeweave.llm.common import SLICE, cut, release, slices, small, spare

UNIT_WORDS = 8
#: Kinds of units, from coarse to fine, each with what parts its units.
KINDS = {"paragraph": re.compile(r"\s*\n\s*\n\s*"), "line": re.compile(r"\s*\n\s*"), "sentence": re.compile(r"\s*\n\s*|(?<=[.!?])\s+")}
Digest = tuple[int, int]


def units(text: str | None, kinds: tuple[str, ...], words: int = UNIT_WORDS) -> list[tuple[Digest, int, int]]:
    """(digest, start, end) of every unit, in code points, by start.

    Words are read once, by the finest kind; a coarser unit is a row of finer ones.
    """
    if not text:
        return []
    order = [kind for kind in KINDS if kind in kinds]
    pieces, at, breaks = [], len(text) - len(text.lstrip()), 2
    for gap in [*KINDS[order[-1]].finditer(text), None]:
        end = gap.start() if gap else len(text.rstrip())
        if own := text[at:end].lower().split():
            pieces.append((at, end, own, breaks))
            breaks = 0
        if gap:
            breaks, at = max(breaks, min(gap[0].count("\n"), 2)), gap.end()
    found = set()
    for kind in order:
        # What opens a unit: two line breaks a paragraph, one a line.
        least = {"paragraph": 2, "line": 1, "sentence": 0}[kind]
        firsts = [k for k, piece in enumerate(pieces) if piece[3] >= least]
        for n, k in enumerate(firsts):
            start, joined, last = pieces[k][0], [], n
            while last < len(firsts) and (last == n or len(joined) < words):
                last += 1
                stop = firsts[last] if last < len(firsts) else len(pieces)
                for piece in pieces[k:stop]:
                    joined += piece[2]
                k = stop
            if len(joined) < words and n:
                break
            h = xxhash.xxh3_128_intdigest(" ".join(joined))
            found.add((start, pieces[k - 1][1], ((h >> 64) - 2**63, (h & 0xFFFFFFFFFFFFFFFF) - 2**63)))
    return [(digest, start, end) for start, end, digest in sorted(found)]


def repeats(text: str | None, elsewhere: set[Digest], kinds: tuple[str, ...], whole: bool = False) -> list[tuple[int, int]]:
    """Spans to remove: units that stand ``elsewhere`` or earlier in the text (all, if it repeats as a ``whole``); touching ones are one span."""
    first, spans = {}, []
    for digest, start, end in units(text, kinds):
        # A line that is one sentence is the same unit twice, at one place.
        if whole or digest in elsewhere or first.setdefault(digest, start) < start:
            if spans and (start <= spans[-1][1] or not text[spans[-1][1] : start].strip()):
                spans[-1] = (spans[-1][0], max(end, spans[-1][1]))
            else:
                spans.append((start, end))
    return spans


def without(text: str, spans: list[tuple[int, int]]) -> str:
    out, past = [], 0
    for start, end in spans:
        out.append(text[past:start])
        past = end
    return "".join([*out, text[past:]])


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def _digests(kinds: tuple[str, ...]):
    """Of each text its distinct digests, and those that stand in it more than once; two numbers each, one after the other."""

    @F.pandas_udf(T.StructType([T.StructField("all", T.ArrayType(T.LongType())), T.StructField("twice", T.ArrayType(T.LongType()))]))
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in (part for whole in texts for part in slices(whole)):
            rows = []
            for text in batch:
                first, twice = {}, set()
                for digest, start, _ in units(text, kinds):
                    if first.setdefault(digest, start) < start:
                        twice.add(digest)
                rows.append(([x for digest in first for x in digest], [x for digest in twice for x in digest]))
            yield pd.DataFrame(rows, columns=["all", "twice"])
        release()

    return run.asNondeterministic()


def _pairs(numbers: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.call_function("div", F.size(numbers), F.lit(2)).cast("int") - 1), lambda i: F.struct(F.get(numbers, (2 * i).cast("int")).alias("h"), F.get(numbers, (2 * i + 1).cast("int")).alias("l")))


def _cut(kinds: tuple[str, ...]):
    @F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("spans", _SPANS)]))
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, gone, again in ((x.iloc[k : k + SLICE] for x in whole) for whole in batches for k in range(0, len(whole[0]), SLICE)):
            rows = []
            for text, digests, whole in zip(texts, gone, again, strict=True):
                spans = repeats(text, {(x["h"], x["l"]) for x in digests} if digests is not None else set(), kinds, bool(whole))
                rows.append((without(text, spans) if spans else text, [{"start": s, "end": e} for s, e in spans]))
            yield pd.DataFrame(rows, columns=["text", "spans"])
        release()

    return run.asNondeterministic()


def _numbered(docs: DataFrame, key: Column, again: str) -> DataFrame:
    """``docs`` with a flag ``again``: of rows with one key, it is false for one only."""
    of, row, first = spare(docs, "key_of"), spare(docs, "row_of"), spare(docs, "first_row")
    several = cut(docs.groupBy(key.alias(of)).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(of))
    if several.isEmpty():
        return docs.withColumn(again, F.lit(False))
    several = small(several)
    keyed = docs.withColumn(of, key)
    once = keyed.join(several, of, "left_anti").withColumn(again, F.lit(False))
    copies = cut(keyed.join(several, of, "left_semi").withColumn(row, F.monotonically_increasing_id()))
    firsts = small(copies.groupBy(of).agg(F.min(row).alias(row)).select(row, F.lit(True).alias(first)))
    flagged = copies.join(firsts, row, "left").withColumn(again, F.col(first).isNull())
    return once.drop(of).unionByName(flagged.drop(of, row, first))


def drop_repeats(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", kept: str = "kept_text", removed: str = "removed", kinds: tuple[str, ...] = ("line", "sentence")
) -> tuple[DataFrame, str, str]:
    """``docs`` with the kept text and an array of removed (start, end); also returns the two columns' names."""
    kept, removed = spare(docs, kept), spare(docs, removed)
    body, own = F.col(f"`{text}`").cast("string"), F.col(f"`{doc_id}`")
    key = F.struct(own.isNull().alias("none"), own.alias("id"), F.xxhash64(body).alias("x"))
    read = cut(docs.select(key.alias("key"), _digests(kinds)(body).alias("u")).select("key", "u.*").filter(F.size("all") > 0))
    found = read.select("key", F.explode(_pairs(F.col("all"))).alias("u")).select("key", "u.h", "u.l")
    several = found.groupBy("h", "l").agg(F.min("key").alias("first"), F.max("key").alias("last")).filter("last > first").select("h", "l", "first")
    gone = found.join(several, ["h", "l"]).filter("key > first").groupBy("key").agg(F.collect_set(F.struct("h", "l")).alias("gone"))
    # Texts that hold a unit twice are cut too, if nothing else of them goes.
    within = read.filter(F.size("twice") > 0).select("key", F.array().cast("array<struct<h: bigint, l: bigint>>").alias("gone"))
    gone = gone.unionByName(within).groupBy("key").agg(F.max_by("gone", F.size("gone")).alias("gone"))
    again = spare(docs, "again")
    rows = _numbered(docs, key, again)
    at, none, id_, x = (spare(rows, name) for name in ("gone", "none_of", "id_of", "x_of"))
    gone = gone.select(F.col("key.none").alias(none), F.col("key.id").alias(id_), F.col("key.x").alias(x), F.col("gone").alias(at))
    joined = rows.join(gone.hint("merge"), (F.xxhash64(body) == F.col(x)) & own.eqNullSafe(F.col(id_)), "left")
    both = spare(docs, "cut")
    touched = F.col(at).isNotNull() | F.col(again)
    parts = _cut(kinds)(F.when(touched, body), F.col(at), F.col(again))
    result = joined.withColumn(both, parts).withColumns({kept: F.when(touched, F.col(both)["text"]).otherwise(body), removed: F.col(both)["spans"]})
    return result.drop(both, at, none, id_, x, again), kept, removed
