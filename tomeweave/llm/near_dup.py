"""Near-duplicate documents: SuperMinHash, banding, verification on full sets, union-find grouping.

Copies with equal shingle sets form one class first. A class has one row from then on:
a digest of its set, 128 SuperMinHash registers and 25 bands of 5. A pair at a Jaccard
similarity of 0.85 shares no band with probability 4e-7, one at 0.5 shares one with 0.55.

Pairs of a bucket are never listed. Each bucket's hub is its member with the most bucket
mates over all its bands (in a group of edited copies: the text closest to all). The
classes that share a bucket under one hub are a cluster, dealt to blocks of bounded size, each with
the hub. A block compares registers (pairs under 80 equal ones of 128 cannot reach 0.85;
the probability to lose one is 2e-10; the three registers beyond the bands count here too), checks the rest on full sets and unites as it goes.
Clusters of several blocks are finished by tiles: members that did not join their hub's
component, against all blocks. So every pair of a bucket is either compared or already in
one component.

Defined cases: null or wordless texts have an empty set, link with nothing and are
kept; repeated rows have equal sets, so they share their component; a null id never
becomes a component's id unless all ids of the component are null (then the id
is null and ``kept`` is true of all its rows, as it goes by id; ``keep_one`` leaves one); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tomeweave.llm.common import cut, release, slices, small, spare
from tomeweave.llm.components import Forest, components
from tomeweave.llm.minhash import REGISTERS, WORDS, forget, overlap, shingles, signature

#: A link needs 100 * intersection >= PERCENT * union.
PERCENT = 85
BANDS = 25
LEAST_EQUAL = 80
#: Bounds of a block: classes and elements of their sets (one larger set is a block's worth alone).
BLOCK_CLASSES, BLOCK_ELEMENTS = 400, 400_000
#: Ids up to which the candidates' texts are found by a broadcast; beyond, by a shuffled join.
BROADCAST_IDS = 1_000_000


def _sketch(with_set: bool):
    fields = [T.StructField("n", T.LongType()), T.StructField("node", T.BinaryType()), T.StructField("registers", T.BinaryType())]
    fields += [T.StructField("elements", T.BinaryType())] * with_set

    @F.pandas_udf(T.StructType(fields))
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in (part for whole in texts for part in slices(whole)):
            rows = []
            for text in batch:
                found = shingles(text, WORDS)
                if len(found):
                    data = found.astype("<u8").tobytes()
                    short = (signature(found) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype("<u2").tobytes()
                    row = (len(found), xxhash.xxh3_128_digest(data), short)
                else:
                    data, row = None, (0, None, None)
                rows.append((*row, data) if with_set else row)
            yield pd.DataFrame(rows, columns=[f.name for f in fields]).astype({"n": "int64"})
        forget()
        release()

    return run.asNondeterministic()


def _equal(registers: np.ndarray, one: np.ndarray) -> np.ndarray:
    return (registers == one).sum(axis=1)


def _linked(a: np.ndarray, b: np.ndarray) -> bool:
    if 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
        return False
    both = overlap(a, b)
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _unite(rows: pd.DataFrame, forest: Forest) -> pd.DataFrame:
    """Links among ``rows``, with only those pairs checked that are not yet in one set; ``side``: 0 hub, 1 asks, 2 is asked only."""
    rows = rows.drop_duplicates("node").reset_index(drop=True)
    nodes = [bytes(x) for x in rows["node"]]
    sets = [np.frombuffer(x, "<u8") for x in rows["elements"]]
    sizes = rows["n"].to_numpy()
    registers = np.stack([np.frombuffer(x, "<u2") for x in rows["registers"]]) if len(rows) else np.empty((0, REGISTERS))
    links = []
    for i in np.argsort(rows["side"].to_numpy(), kind="stable"):
        if rows["side"][i] == 2:
            break
        equal = _equal(registers, registers[i])
        fits = (equal >= LEAST_EQUAL) & (100 * np.minimum(sizes, sizes[i]) >= PERCENT * np.maximum(sizes, sizes[i]))
        near = np.flatnonzero(fits)
        for j in near[np.argsort(-equal[near], kind="stable")]:
            if i != j and forest.find(nodes[i]) != forest.find(nodes[j]) and _linked(sets[i], sets[j]):
                forest.join(nodes[i], nodes[j])
                links.append((nodes[i], nodes[j]))
    return pd.DataFrame(links, columns=["a", "b"])


LINKS = "a binary, b binary"


def _block(rows: pd.DataFrame) -> pd.DataFrame:
    return _unite(rows.sort_values("side"), Forest())


def _tile(rows: pd.DataFrame) -> pd.DataFrame:
    """As a block, with what is already united; the asked rows may repeat the asking ones."""
    forest = Forest()
    for node, label in zip(rows["node"], rows["label"], strict=True):
        forest.join(bytes(node), b"label" + bytes(label))
    return _unite(rows.sort_values("side"), forest)


def _blocks_of(n: Column, classes: Column) -> Column:
    return F.greatest(F.ceil(n / BLOCK_ELEMENTS), F.ceil(classes / BLOCK_CLASSES)).cast("int")


def _numbers(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), n - 1))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id and kept."""
    return _grouped(docs, text, doc_id)[0]


def _grouped(docs: DataFrame, text: str, doc_id: str) -> tuple[DataFrame, DataFrame]:
    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    sketched = cut(own.select("doc_id", _sketch(False)("text").alias("s")).select("doc_id", "s.*"))
    classes = sketched.filter(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("registers").alias("registers"))
    width = REGISTERS * 2 // BANDS
    bucket = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring(F.col("registers"), i * width + 1, F.lit(width))))
    banded = classes.select("node", "n", F.explode(bucket).alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("mates")).filter("mates > 1")
    members = cut(banded.join(shared, "bucket"))
    scores = members.groupBy("node").agg(F.sum("mates").alias("score"))
    hubs = members.join(scores, "node").groupBy("bucket").agg(F.max(F.struct("score", "node"))["node"].alias("hub"))
    clusters = cut(members.join(hubs, "bucket").select("hub", "node", "n").distinct())
    dealt = cut(clusters.groupBy("hub").agg(_blocks_of(F.sum("n"), F.count(F.lit(1))).alias("blocks")))
    # Few hubs have several blocks; only they are joined, so that no task gets a hub as a whole.
    several = small(dealt.filter("blocks > 1"))

    # Sets of the classes that have a bucket mate, made again from one text of each.
    wanted = clusters.select("node").distinct()
    ids = small(classes.select("node", "first").join(wanted, "node", "left_semi").select("first").distinct(), BROADCAST_IDS)
    texts = own.join(ids, own["doc_id"].eqNullSafe(ids["first"]), "left_semi")
    sets = texts.select(_sketch(True)("text").alias("s")).select("s.*").join(wanted, "node", "left_semi")
    sets = cut(sets.groupBy("node").agg(*(F.first(c).alias(c) for c in ("n", "registers", "elements"))))

    placed = clusters.join(several, "hub", "left").na.fill(1, ["blocks"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    inside = placed.filter("node <> hub").select("hub", "block", "node", F.lit(1).alias("side"))
    centre = dealt.select("hub", _numbers(F.col("blocks")).alias("block"), F.col("hub").alias("node"), F.lit(0).alias("side"))
    first = cut(inside.unionByName(centre).join(sets, "node").groupBy("hub", "block").applyInPandas(_block, LINKS))
    united = components(first)

    # Clusters of several blocks: who did not join the hub meets all blocks.
    large = placed.filter("blocks > 1")
    if not large.isEmpty():
        label = united.select("node", "root")
        named = large.join(label, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")
        centres = named.filter("node = hub").select("hub", F.col("label").alias("hub_label"))
        named = cut(named.join(small(centres), "hub"))
        asking = named.filter("label <> hub_label")
        counts = small(asking.groupBy("hub").agg(_blocks_of(F.sum("n"), F.count(F.lit(1))).alias("asks")))
        rows = asking.join(counts, "hub").select("hub", F.pmod(F.xxhash64("node"), F.col("asks")).cast("int").alias("ask"), _numbers(F.col("blocks")).alias("block"), "node", "label", F.lit(1).alias("side"))
        asked = named.join(counts, "hub").select("hub", _numbers(F.col("asks")).alias("ask"), "block", "node", "label", F.lit(2).alias("side"))
        second = rows.unionByName(asked).join(sets, "node").groupBy("hub", "ask", "block").applyInPandas(_tile, LINKS)
        united = components(cut(first.unionByName(second)))

    in_class = classes.select("node", "first").join(united, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = F.min(F.struct(F.col("first").isNull().alias("no_id"), "first", "node"))["node"]
    named = in_class.join(in_class.groupBy("root").agg(F.min("first").alias("component_id"), least.alias("keeper")), "root").select("node", "component_id", "keeper")
    joined = sketched.select("doc_id", "n", "node").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    result = joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "node", "keeper")
    return result.drop("node", "keeper"), result


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each group: of the least id (null last), of the least digest where that id repeats. Rows without words stay.

    What leaves is found on ids and digests alone. An id whose rows all leave is dropped by id, and only the texts of
    ids with rows of both kinds are digested again, to be told apart by (id, digest); equal rows are one.
    """
    rows = _grouped(docs, text, doc_id)[1]
    stays = F.col("node").isNull() | (F.col("node") == F.col("keeper")) & F.col("kept")
    pairs = cut(rows.groupBy("doc_id", "node").agg(F.count(F.lit(1)).alias("n"), F.first(stays).alias("stays")))
    by_id = pairs.groupBy("doc_id").agg(F.max("stays").alias("some"), F.min(F.col("stays") & (F.col("node").isNull() | (F.col("n") == 1))).alias("all"))
    own = F.col(f"`{doc_id}`")
    gone = small(by_id.filter("not some").select(F.col("doc_id").alias("gone")), BROADCAST_IDS)
    left = docs.join(gone, own.eqNullSafe(gone["gone"]), "left_anti")
    mixed = cut(by_id.filter("some and not all").select(F.col("doc_id").alias("mixed")))
    if mixed.isEmpty():
        return left
    staying = pairs.filter("stays and node is not null").join(mixed, F.col("doc_id").eqNullSafe(F.col("mixed")), "left_semi")
    staying = small(staying.select(F.col("doc_id").alias("staying_id"), F.col("node").alias("staying_digest"), "n"), BROADCAST_IDS)
    mixed = small(mixed, BROADCAST_IDS)
    node = spare(docs, "node")
    several = left.join(mixed, own.eqNullSafe(mixed["mixed"]), "left_semi").withColumn(node, _sketch(False)(F.col(f"`{text}`").cast("string"))["node"])
    this = own.eqNullSafe(staying["staying_id"]) & (F.col(node) == staying["staying_digest"])
    once = several.join(staying.filter("n = 1"), this, "left_semi")
    repeated = several.join(staying.filter("n > 1"), this, "left_semi").dropDuplicates([doc_id, node])
    out = left.join(mixed, own.eqNullSafe(mixed["mixed"]), "left_anti")
    for part in (once, repeated, several.filter(F.col(node).isNull())):
        out = out.unionByName(part.drop(node))
    return out
