"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document: the measurements and one bit per
failed rule are stored. Policies are versioned sets of rules; applying one is a
bitwise AND over the ledger, and an ablation is an aggregation of those bits, so
neither reads a text again.

Defined cases: a null text counts as empty (no words, so ``few_words`` fails);
repeated rows are judged one by one; an empty table gives an empty ledger; the
ledger's column names give way to columns of the input with the same name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tomeweave.llm.common import release, spare

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
SYMBOLS = re.compile(r"[#*$%&|<>]")


@dataclass(frozen=True)
class Rule:
    """A rule fails where its SQL over the measurements holds."""

    name: str
    bit: int
    sql: str

    def failed(self, entry: str) -> Column:
        return F.expr(re.sub(r"\b(n_\w+|word_chars)\b", rf"`{entry}`.\1", self.sql))


RULES = (
    Rule("few_words", 1, "n_words < 50"),
    Rule("repeated_windows", 2, "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols_to_words", 4, "100 * n_symbols > 10 * n_words"),
    Rule("duplicate_lines", 8, "100 * n_dup_lines > 50 * n_lines"),
    Rule("short_words", 16, "word_chars < 2 * n_words"),
    Rule("long_words", 32, "word_chars > 15 * n_words"),
)

BASE = 1 | 2
#: Policy name and version: the bits of the rules that it applies.
POLICIES = {"base@1": BASE, "web@1": BASE | 4 | 8, "web@2": BASE | 4 | 8 | 16 | 32}
DEFAULT_POLICY = "web@2"


def repeated_words(words: list[bytes]) -> int:
    """Words covered by 3-word windows that occur at least twice."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    k = len(seen)
    pairs = np.unique(ids[:-1] * k + ids[1:], return_inverse=True)[1]  # k * k may be large, ranks are not
    _, inverse, counts = np.unique(pairs[:-1] * k + ids[2:], return_inverse=True, return_counts=True)
    again = counts[inverse] > 1
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= again
    return int(covered.sum())


def measure_text(text: str | None) -> tuple[int, ...]:
    data = (text or "").encode()
    words = data.split()  # bytes.split() splits at the six ASCII blanks only
    lines = [x for x in data.split(b"\n") if x.split(None, 1)]
    return (
        len(words),
        len(text or "") - sum(map(data.count, b" \t\n\v\f\r")),
        len(SYMBOLS.findall(text or "")),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


@F.pandas_udf(T.StructType([T.StructField(x, T.LongType()) for x in MEASURES]))
def _measure(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        yield pd.DataFrame([measure_text(x) for x in batch], columns=list(MEASURES)).astype("int64")
    release()


_measure = _measure.asNondeterministic()  # evaluated once, also below a filter


def ledger(docs: DataFrame, text: str = "text", name: str = "ledger") -> tuple[DataFrame, str]:
    """``docs`` with one struct column more: the measurements and ``failed``, the bits of the failed rules.

    Returns the frame and the column's name (another one if ``docs`` has it).
    """
    name = spare(docs, name)
    measured = docs.withColumn(name, _measure(F.col(f"`{text}`").cast("string")))
    bits = F.lit(0).cast("long")
    for rule in RULES:
        bits = bits.bitwiseOR(F.when(rule.failed(name), F.lit(rule.bit)).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn(name, F.col(name).withField("failed", bits)), name


def passes(column: str, policy: str = DEFAULT_POLICY) -> Column:
    """Whether the ledger entry passes the policy."""
    return F.col(column)["failed"].bitwiseAND(F.lit(POLICIES[policy]).cast("long")) == 0


def apply_policy(docs: DataFrame, policy: str = DEFAULT_POLICY, text: str = "text") -> DataFrame:
    """The documents that the policy keeps, with their own columns only."""
    with_ledger, name = ledger(docs, text)
    return with_ledger.filter(passes(name, policy)).drop(name)


def ablation(entries: DataFrame, failed: str = "failed", policy: str = DEFAULT_POLICY) -> DataFrame:
    """Per rule of the policy: documents that fail it, that fail only it, and that are kept without it.

    The ledger is first counted by distinct bit mask (at most two to the number of rules), then each rule is a sum over those few rows.
    """
    mask = POLICIES[policy]
    counts = entries.groupBy(F.col(failed).bitwiseAND(F.lit(mask).cast("long")).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = [F.struct(F.lit(r.name).alias("rule"), F.lit(r.bit).cast("long").alias("bit")) for r in RULES if r.bit & mask]
    each = counts.withColumn("r", F.explode(F.array(*rules)))
    hit = F.col("bits").bitwiseAND(F.col("r.bit"))
    rest = F.col("bits") - hit
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    return each.groupBy("r.rule", "r.bit").agg(
        total(hit != 0).alias("n_failed"), total((hit != 0) & (rest == 0)).alias("n_only"), total(rest == 0).alias("n_kept_without")
    )
