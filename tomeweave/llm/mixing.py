"""Mixing sources to target weights, in DataFrame operations only.

Every document gets a hash-random key. The keys of a source are cut into ranges
(their first hexadecimal digits), so a source is range-sorted over many tasks
however large it is. Range totals are summed first, a running sum over them gives
every range its offset within the source, and a running sum inside each range
completes the distributed prefix sum. The mix takes whole epochs of a source and
then its documents in key order until the source's budget is spent, exactly.

Defined cases: a null or empty text has size 0 and takes no words; a null source
is a source of its own, ordered last; rows repeated in the table are documents of
their own (their order among themselves does not matter, as they are equal); a null
id is hashed as the empty string; an empty table gives an empty mix; added columns
give way to columns of the input with the same name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomeweave.llm.common import WORD, spare

#: Hexadecimal digits of the key that name a range: 65,536 ranges in each source.
RANGE_DIGITS = 4
#: Digits of the larger ranges, of which a source has 256.
COARSE_DIGITS = 2
WEIGHTS = (1, 2, 3)
MOST_EPOCHS = 3


@dataclass(frozen=True)
class Mixed:
    """``rows`` and the names of the columns that were added to them."""

    rows: DataFrame
    size: str
    source_size: str
    target: str
    taken: str


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """``sizes`` (source, source_size) with ``target``: shares by weight of all sizes, none over its cap.

    The shares are a water filling: in the order of cap to weight, a source stops at its cap if the
    level without the ones before reaches it. All comparisons are on whole numbers. One row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cap = F.col("source_size") * MOST_EPOCHS
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weighed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("int")).cast("long")).withColumns(
        {"cap": cap, "scaled": cap * F.lit(6) / F.col("weight")}
    )
    before = Window.orderBy("scaled", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    sums = weighed.withColumns(
        {
            "total": F.sum("source_size").over(everything),
            "weights": F.sum("weight").over(everything),
            "cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0)),
            "weight_before": F.coalesce(F.sum("weight").over(before), F.lit(0)),
        }
    ).withColumn("full", (F.col("total") - F.col("cap_before")) * F.col("weight") >= F.col("cap") * (F.col("weights") - F.col("weight_before")))
    over = lambda c: F.coalesce(F.sum(F.when(F.col("full"), F.col(c))).over(everything), F.lit(0))
    level = sums.withColumns({"cap_full": over("cap"), "weight_full": over("weight")})
    share = ((F.col("total") - F.col("cap_full")) * F.col("weight")).cast("double") / (F.col("weights") - F.col("weight_full")).cast("double")
    return level.select("source", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> Mixed:
    """Every row of ``docs`` with its size, its source's size and target, and the words that the mix takes of it."""
    names = {}
    for x in ("size", "source_size", "target", "taken", "key", "range", "offset", "budget", "at_source", "at_range"):
        names[x] = spare(docs.select(*docs.columns, *(F.lit(0).alias(y) for y in names.values())), x)
    size, key, rng = (F.col(names[x]) for x in ("size", "key", "range"))
    src = F.col(f"`{source}`").cast("string")
    keyed = docs.withColumns({names["size"]: words_in(F.col(f"`{text}`")), names["key"]: F.md5(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).cast("binary"))}).withColumn(
        names["range"], F.substring(key, 1, RANGE_DIGITS)
    )
    ranges = keyed.groupBy(src.alias("source"), rng.alias("range")).agg(F.sum(size).alias("range_size"))
    sums = ranges.groupBy("source").agg(F.sum("range_size").alias("source_size"))
    targets = source_targets(sums).select(
        F.col("source").alias("t_source"), "source_size", "target", F.floor("target").cast("long").alias("budget")
    )
    # Ranges are summed in two steps, so that no task holds all ranges of a large source.
    coarse = ranges.withColumn("coarse", F.substring("range", 1, COARSE_DIGITS))
    tops = coarse.groupBy("source", "coarse").agg(F.sum("range_size").alias("coarse_size"))
    top = Window.partitionBy("source").orderBy("coarse").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(F.col("source").alias("c_source"), F.col("coarse").alias("c_coarse"), F.coalesce(F.sum("coarse_size").over(top), F.lit(0)).alias("coarse_offset"))
    tops = tops.join(targets, F.col("c_source").eqNullSafe(F.col("t_source")))
    fine = Window.partitionBy("source", "coarse").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    placed = coarse.withColumn("fine_offset", F.coalesce(F.sum("range_size").over(fine), F.lit(0)))
    offsets = placed.join(tops, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("coarse") == F.col("c_coarse"))).withColumn("offset", F.col("coarse_offset") + F.col("fine_offset"))
    offsets = offsets.select(
        F.col("source").alias(names["at_source"]), F.col("range").alias(names["at_range"]), *(F.col(x).alias(names[x]) for x in ("source_size", "target", "offset", "budget"))
    )
    joined = keyed.join(offsets, src.eqNullSafe(F.col(names["at_source"])) & (rng == F.col(names["at_range"])))
    within = Window.partitionBy(names["at_source"], names["at_range"]).orderBy(key, F.col(f"`{doc_id}`"), size).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col(names["offset"]) + F.coalesce(F.sum(size).over(within), F.lit(0))
    whole, budget = F.col(names["source_size"]), F.col(names["budget"])
    epochs = F.when(whole > 0, F.expr(f"`{names['budget']}` div `{names['source_size']}`")).otherwise(F.lit(0))
    rest = F.greatest(F.lit(0), F.least(size, budget - epochs * whole - before))
    taken = joined.withColumn(names["taken"], epochs * size + rest)
    rows = taken.select(*(F.col(f"`{c}`") for c in docs.columns), *(F.col(names[x]) for x in ("size", "source_size", "target", "taken")))
    return Mixed(rows, *(names[x] for x in ("size", "source_size", "target", "taken")))


def mixed_documents(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """The mix as whole documents: each is repeated as often as it was taken; the one where the cut falls counts as taken if at least half of it was.

    Documents without words cost nothing and come once.
    """
    m = mix(docs, text, source, doc_id)
    size, taken = F.col(m.size), F.col(m.taken)
    copies = F.when(size == 0, F.lit(1)).otherwise(F.expr(f"(2 * `{m.taken}` + `{m.size}`) div (2 * `{m.size}`)")).cast("int")
    extra = spare(m.rows, "copy")
    return m.rows.filter((size == 0) | (2 * taken >= size)).withColumn(extra, F.explode(F.sequence(F.lit(1), copies))).select(*(F.col(f"`{c}`") for c in docs.columns))
