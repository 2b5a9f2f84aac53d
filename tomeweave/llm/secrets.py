"""Secret scans with one combined deterministic automaton.

All rule regexes are compiled together, by subset construction and minimisation,
into one transition table over bytes. The table is that of the mirrored rules, so
one pass over a text from its last byte to its first marks, for all rules at once,
every byte where a match begins. At a marked byte the rule's own forward
automaton gives the longest match. Leftmost, longest, non-overlapping matches per
rule follow exactly, and a text without a secret costs the one pass.

Defined cases: a null text counts as empty and has no span; repeated rows are
scanned one by one; positions count code points; added columns give way to columns
of the input with the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tomeweave.llm.automaton import Automaton, Node, compile_rules, mirrored, parse
from tomeweave.llm.common import release, slices, spare


@dataclass(frozen=True)
class Rule:
    """``least``: a match counts if, after the longest match of ``head`` at its start, so many bytes follow."""

    kind: str
    pattern: str
    least: int = 1
    head: str = ""
    any_case_head: bool = False


ASSIGN_HEAD = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
#: In the order of kinds. The first three are the base; the others add well-known formats.
RULES = (
    Rule("assign", r"[A-Za-z0-9+/_.=-]+", 6, ASSIGN_HEAD, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 15),
)
MASK = "[SECRET]"
Span = tuple[str, int, int]


#: A run is marked from this many bytes on (a longer least length is checked on the match itself):
#: every marked byte costs a look, every counted byte multiplies the states.
COUNTED = 8


def _node(rule: Rule) -> Node:
    body = parse(rule.pattern)
    if not rule.head and len(body.parts) == 1 and body.parts[0].kind == "rep":
        # One greedy run: runs under the least length are dropped anyway.
        run = body.parts[0]
        body = Node("rep", run.parts, max(run.least, min(rule.least, COUNTED)), run.most)
    return Node("cat", (parse(rule.head, rule.any_case_head), body)) if rule.head else body


@lru_cache(maxsize=4)
def automata(rules: tuple[Rule, ...]) -> tuple[list, list[int], list[Automaton], list[Automaton | None]]:
    """The combined mirrored table as linked rows, and each rule's forward automata of the match and of its head."""
    nodes = [_node(r) for r in rules]
    back = compile_rules([mirrored(x) for x in nodes], anywhere=True)
    # A row is a list whose entry for a byte is the next row; its last entry holds the accepted rules.
    rows: list[list] = [[] for _ in back.table]
    for row, to, bits in zip(rows, back.table, back.accepts, strict=True):
        row.extend(rows[k] for k in to)
        row.append(bits)
    forward = [compile_rules([x], anywhere=False) for x in nodes]
    heads = [compile_rules([parse(r.head, r.any_case_head)], anywhere=False) if r.head else None for r in rules]
    return rows, back.accepts, forward, heads


def _longest(automaton: Automaton, data: bytes, at: int) -> int:
    """End of the longest match at ``at``, or -1."""
    state, end = 0, -1
    for k in range(at, len(data)):
        state = automaton.table[state][data[k]]
        if state == automaton.dead:
            break
        if automaton.accepts[state]:
            end = k + 1
    return end


def scan(text: str | None, rules: tuple[Rule, ...] = RULES) -> list[Span]:
    """(kind, start, end) in code points, by start and then by the rules' order."""
    data = (text or "").encode()
    rows, _, forward, heads = automata(rules)
    row, marks = rows[0], []
    k = len(data)
    for b in data[::-1]:
        row = row[b]
        k -= 1
        if row[256]:
            marks.append((k, row[256]))
    found = []
    for n, rule in enumerate(rules if marks else ()):
        past = 0
        for at, bits in reversed(marks):
            if at < past or not bits >> n & 1:
                continue
            past = _longest(forward[n], data, at)
            body = _longest(heads[n], data, at) if heads[n] else at
            if past - body >= rule.least:
                found.append((at, n, past))
    found.sort()
    place = (lambda x: x) if len(data) == len(text or "") else (lambda x: len(data[:x].decode()))
    return [(rules[n].kind, place(at), place(end)) for at, n, end in found]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def masked(text: str | None, spans: list[Span]) -> str | None:
    """The text with every span (overlapping ones merged) replaced by ``MASK``; null stays null."""
    if not text or not spans:
        return text
    out, past = [], 0
    merged: list[list[int]] = []
    for _, start, end in sorted(spans, key=lambda x: x[1:]):
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    for start, end in merged:
        out += [text[past:start], MASK]
        past = end
    return "".join([*out, text[past:]])


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


@F.pandas_udf(SPANS)
def _spans(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([[{"kind": k, "start": s, "end": e} for k, s, e in scan(x)] for x in batch], index=batch.index, dtype=object)


@F.pandas_udf(T.StringType())
def _masked(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        for part in slices(batch):
            yield pd.Series([masked(x, scan(x)) for x in part], dtype=object)
    release()


_spans = _spans.asNondeterministic()  # evaluated once, also below a filter


def find_secrets(docs: DataFrame, text: str = "text", name: str = "secrets") -> tuple[DataFrame, str]:
    """``docs`` with an array of (kind, start, end) more; also returns that column's name."""
    name = spare(docs, name)
    return docs.withColumn(name, _spans(F.col(f"`{text}`").cast("string"))), name


def mask_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``MASK``; other columns and the rows stay."""
    return docs.withColumn(text, _masked(F.col(f"`{text}`").cast("string")))
