"""Connected components of link tables, for union-find grouping over many tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeweave.llm.common import cut


class Forest:
    """Union-find with path halving; the least member of a set is its root."""

    def __init__(self) -> None:
        self.up: dict = {}

    def find(self, x):
        up = self.up
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


#: Links that a task unites at once; it then emits its forest and begins another.
_HELD = 200_000


def _united(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    forest = Forest()

    def emit() -> pd.DataFrame:
        rows = [(x, forest.find(x)) for x in list(forest.up)]
        return pd.DataFrame([(x, root) for x, root in rows if x != root], columns=["a", "b"])

    for batch in batches:
        for a, b in zip(batch["a"], batch["b"], strict=True):
            forest.join(a, b)
        if len(forest.up) > _HELD:
            yield emit()
            forest = Forest()
    yield emit()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): the least node that it reaches.

    Each task first unites its own links; then labels spread to neighbours and along
    labels (which doubles their reach) until none changes. Only links and labels of nodes that
    have links move, never a component as a whole, and each round's labels are checkpointed.
    """
    schema = f"a {links.schema['a'].dataType.simpleString()}, b {links.schema['b'].dataType.simpleString()}"
    edges = cut(links.filter("a <> b").mapInPandas(_united, schema).distinct())
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("n")).select("node", F.least("node", "n").alias("root")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("n"))
        spread = labels.join(near, "node").select("node", F.least("root", "n").alias("r"), F.col("root").alias("old"))
        onward = labels.select(F.col("node").alias("r"), F.col("root").alias("rr"))
        new = cut(spread.join(onward, "r", "left").select("node", F.least("r", F.coalesce("rr", "r")).alias("root"), "old"))
        if new.filter("root <> old").isEmpty():
            return new.select("node", "root")
        labels = new.select("node", "root")
