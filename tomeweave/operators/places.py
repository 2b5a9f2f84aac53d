"""Places and running sums within groups of any size.

A window holds a group in one task, and one book may hold a third of all rows. Here rows are cut into ranges of
group and order, so a large group lies in several ranges: a task counts its own range, and what lies before it in
the group comes from the ranges' totals.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomeweave.operators.lineage import cut


def placed(rows: DataFrame, group: list[str], order: list[str], sums: dict[str, Column] | None = None) -> DataFrame:
    """``rows`` with ``place`` (from 1) and ``group_rows`` in their group, and the running sum of each of ``sums``, the row's own value included.

    ``group`` and ``order`` together should name a row; of rows that tie any may be first, but all of these columns agree
    on it. Nulls are a group, and come first in an order. Columns of ``rows`` that have these names are replaced. The ranges are written before they are counted, as their
    bounds are sampled anew whenever they are made.
    """
    names = list(sums or {})
    keys = [F.col(c).asc() for c in (*group, *order)]
    ranged = rows.withColumns({f"_v_{c}": value for c, value in (sums or {}).items()}).repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged = cut(ranged.withColumns({"_range": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}))
    totals = ranged.groupBy("_range", *group).agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"), *(F.sum(f"_v_{c}").alias(f"_t_{c}") for c in names))
    # A group has one row here for each range that it reaches into.
    by_group = Window.partitionBy(*group)
    before = by_group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    shifts = totals.select(
        F.col("_range").alias("_range_"), *(F.col(c).alias(f"_g_{k}") for k, c in enumerate(group)), (so_far("_n") - F.col("_first") + 1).alias("_shift"),
        F.sum("_n").over(by_group).alias("group_rows"), *(so_far(f"_t_{c}").alias(f"_b_{c}") for c in names),
    )
    inside = Window.partitionBy("_range", *group).orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    own = ranged.withColumns({f"_s_{c}": F.coalesce(F.sum(f"_v_{c}").over(inside), F.lit(0)) for c in names}) if names else ranged
    meet = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_g_{k}")) for k, c in enumerate(group)], F.col("_range") == F.col("_range_"))
    out = {"place": F.col("_row") + F.col("_shift"), "group_rows": F.col("group_rows"), **{c: F.col(f"_s_{c}") + F.col(f"_b_{c}") for c in names}}
    kept = [F.col(c) for c in rows.columns if c not in out]
    return own.drop(*(c for c in rows.columns if c in out)).join(shifts, meet).select(*kept, *(value.alias(c) for c, value in out.items()))
