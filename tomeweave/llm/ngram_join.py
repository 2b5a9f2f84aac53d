"""N-gram Jaccard join on prefix trees: links between sets of word n-grams that share enough of their union.

Texts with equal sets form one class. A global order of n-grams puts rare ones first; of two linked sets
the first ``n - ceil(0.85 n) + 1`` n-grams of each must share one, and an n-gram that no other set has cannot be it.
So frequencies come first:

1. Every task summarises the n-grams of its texts (Misra-Gries), which names all with a share of 3 * 2^-20 of the
   occurrences and none under 2^-20: about a million at most, whatever the input, so they may be broadcast.
2. One text of each class is read again. Batches of sets are dealt, as packed and sorted numbers, to parts by n-gram; a part counts the sets
   of each and returns the shared ones, with their frequency, to the batch. Broadcast ones need no part: each batch
   keeps its own, so no part holds an n-gram of many sets.
3. A batch puts its sets in order. A set with so many n-grams of its own that no other set can link to it leaves here,
   and so do these n-grams: what remains of a set is its shared n-grams, rare ones first, and its size.

Sets that share an n-gram of their prefixes are a bucket. Each bucket's hub is its member with the most bucket mates; the
sets of the buckets of a hub are a cluster, dealt to blocks of bounded size, each with the hub. A block is a prefix tree of its
ordered sets. A set traverses it from the root, with the overlap so far for each path; a subtree is left when
the overlap and what remains of the set and of the longest path below cannot reach the bound for the smallest
set below. What arrives at a set's end has its whole
overlap, as n-grams of one set only match nothing, and is held against its size. Clusters of several blocks
are finished by tiles: members that did not join their hub's component, against all blocks. So each pair of a bucket is either
compared or already in one component, and none is listed.

Defined cases: null or wordless texts have an empty set, link with nothing and are their own component; texts of fewer than
``WORDS`` words have one n-gram, the whole sequence; repeated rows have equal sets, so they share their component; a null id is
a component's id only if all ids of the component are null; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tomeweave.llm.common import cut, release, slices, small
from tomeweave.llm.components import Forest, components
from tomeweave.llm.minhash import forget, shingles

WORDS, PERCENT = 4, 85
#: Counters of a task's summary; an n-gram of more than a 2^-20 share of the occurrences is named by it.
COUNTERS = 1 << 20
#: Occurrences from which an n-gram may be called frequent.
FREQUENT = 64
#: N-grams of a batch, and of a part that counts them.
BATCH, PART = 1_000_000, 1_000_000
#: Bounds of a block: sets and n-grams (one larger set is a block's worth alone).
BLOCK_SETS, BLOCK_GRAMS = 400, 400_000
#: Ids up to which rows are dropped by a broadcast; beyond, by a shuffled join.
BROADCAST_IDS = 1_000_000


def prefix(n: np.ndarray | int):
    """How many of the first n-grams of a set of n must share one with any set it links to."""
    return n - -(-PERCENT * n // 100) + 1


# Frequencies --------------------------------------------------------------------------------------


class Summary:
    """Misra-Gries counts of a stream of numbers: whatever has more than 1 / ``counters`` of it is among them, counted short by that at most."""

    def __init__(self, counters: int = COUNTERS):
        self.counters = counters
        self.keys, self.counts, self.total = np.empty(0, np.uint64), np.empty(0, np.int64), 0

    def add(self, numbers: np.ndarray) -> None:
        self.total += len(numbers)
        keys, counts = np.unique(numbers, return_counts=True)
        both, counts = np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts])
        if not len(both):
            return
        order = np.argsort(both, kind="stable")  # two sorted runs are merged
        both, counts = both[order], counts[order]
        at = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
        self.keys, self.counts = both[at], np.add.reduceat(counts, at)
        if len(self.keys) > self.counters:
            down = np.partition(self.counts, -self.counters - 1)[-self.counters - 1]
            stay = self.counts > down
            self.keys, self.counts = self.keys[stay], self.counts[stay] - down


_SURVEYED = T.StructType([T.StructField("n", T.LongType()), *(T.StructField(x, T.BinaryType()) for x in ("node", "keys", "counts")), T.StructField("total", T.LongType())])


@F.pandas_udf(_SURVEYED)
def _surveyed(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Of each text its set's size and class; a task's last row also has its summary (``keys``, ``counts``, ``total``)."""
    summary, held, waiting, last = Summary(), [], 0, None
    for batch in texts:
        for part in slices(batch):
            if last is not None:
                yield last
            sets = [shingles(x, WORDS) for x in part]
            held += sets
            waiting += sum(map(len, sets))
            if waiting > BATCH:
                summary.add(np.concatenate(held))
                held, waiting = [], 0
            last = pd.DataFrame({"n": [len(x) for x in sets], "node": [xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets], "keys": None, "counts": None, "total": 0})
    if last is not None:
        summary.add(np.concatenate(held) if held else np.empty(0, np.uint64))
        often = summary.counts > max(1, summary.total // (2 * COUNTERS))
        last.loc[len(last) - 1, ["keys", "counts", "total"]] = [summary.keys[often].tobytes(), summary.counts[often].tobytes(), summary.total]
        yield last
    forget()
    release()


def _frequent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for keys, counts in zip(batch["keys"], batch["counts"], strict=True):
            yield pd.DataFrame({"key": np.frombuffer(keys, np.int64), "n": np.frombuffer(counts, np.int64)})


# Ordered sets -------------------------------------------------------------------------------------


def _level(counts: np.ndarray) -> np.ndarray:
    """Frequencies as a byte: eight steps a doubling."""
    return np.minimum(8 * np.log2(np.maximum(counts, 1)), 255).astype(np.uint8)


def _planes(numbers: np.ndarray) -> bytes:
    """Sorted numbers as planes of bytes, from the high ones, which compress well."""
    return numbers.astype(">u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _places(refs: np.ndarray) -> bytes:
    """Small numbers in the same way."""
    return refs.astype(">u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _places_of(planes: bytes) -> np.ndarray:
    return np.frombuffer(planes, np.uint8).reshape(4, -1).T.copy().view(">u4").ravel().astype(np.uint32)


def _numbers_of(planes: bytes) -> np.ndarray:
    return np.frombuffer(planes, np.uint8).reshape(8, -1).T.copy().view(">u8").ravel().astype(np.uint64)


DEALT = "part int, batch binary, grams binary, refs binary, levels binary, nodes binary, sizes binary"


def _dealt(parts: int, frequent: Broadcast):
    """Batches of sets, dealt to parts by n-gram; parts from ``parts`` on hold what needs no counting."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, levels = frequent.value

        def emit(sets: list[np.ndarray]) -> pd.DataFrame:
            nodes = b"".join(xxhash.xxh3_128_digest(x.tobytes()) for x in sets)
            name = xxhash.xxh3_128_digest(nodes)
            sizes = np.array([len(x) for x in sets], np.int64)
            grams, refs = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.uint32), sizes)
            order = np.argsort(grams, kind="stable")
            grams, refs = grams[order], refs[order]
            at = np.minimum(np.searchsorted(known, grams), max(len(known) - 1, 0))
            often = known[at] == grams if len(known) else np.zeros(len(grams), bool)
            home = parts + name[0] % max(parts, 1)
            rows = [(home, name, _planes(grams[often]), _places(refs[often]), levels[at[often]].tobytes() if len(known) else b"", nodes, sizes.tobytes())]
            grams, refs = grams[~often], refs[~often]
            # Parts are ranges of the numbers, which are evenly spread.
            ends = np.searchsorted(grams, np.array([(k << 64) // parts for k in range(1, parts)], np.uint64))
            for part, (g, r) in enumerate(zip(np.split(grams, ends), np.split(refs, ends), strict=True)):
                if len(g):
                    rows.append((part, name, _planes(g), _places(r), None, None, None))
            return pd.DataFrame(rows, columns=[x.split(" ")[0] for x in DEALT.split(", ")])

        held, waiting = [], 0
        for batch in batches:
            for text in batch["text"]:
                found = shingles(text, WORDS)
                if not len(found):
                    continue
                if held and waiting + len(found) > BATCH:
                    yield emit(held)
                    held, waiting = [], 0
                held.append(found)
                waiting += len(found)
        if held:
            yield emit(held)
        forget()
        release()

    return run


def _shared(rows: pd.DataFrame) -> pd.DataFrame:
    """Of a part, the n-grams of several sets with their frequency, back to their batches."""
    rows = rows.drop_duplicates("batch")  # batches of one name have the same sets
    if rows["nodes"].notna().any():
        return rows.drop(columns="part")
    grams = [_numbers_of(x) for x in rows["grams"]]
    _, inverse, counts = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    levels, begin, out = _level(counts)[inverse], 0, []
    for name, own, refs in zip(rows["batch"], grams, rows["refs"], strict=True):
        level = levels[begin : begin + len(own)]
        begin += len(own)
        several = level > 0
        if several.any():
            out.append((name, _planes(own[several]), _places(_places_of(refs)[several]), level[several].tobytes(), None, None))
    return pd.DataFrame(out, columns=["batch", "grams", "refs", "levels", "nodes", "sizes"])


def _ordered(rows: pd.DataFrame) -> pd.DataFrame:
    """A batch's sets that may link to another: their shared n-grams, rare ones first."""
    head = rows[rows["nodes"].notna()].iloc[0]
    sizes = np.frombuffer(head["sizes"], np.int64)
    grams = np.concatenate([_numbers_of(x) for x in rows["grams"]])
    refs = np.concatenate([_places_of(x) for x in rows["refs"]]).astype(np.int64)
    levels = np.concatenate([np.frombuffer(x, np.uint8) for x in rows["levels"]])
    alone = sizes - np.bincount(refs, minlength=len(sizes))
    may = alone < prefix(sizes)
    stay = may[refs]
    grams, refs, levels = grams[stay], refs[stay], levels[stay]
    order = np.lexsort((grams, levels, refs))
    grams, refs = grams[order], refs[order]
    begins = np.searchsorted(refs, np.arange(len(sizes) + 1))
    out = []
    for k in np.flatnonzero(may):
        own = grams[begins[k] : begins[k + 1]]
        out.append((head["nodes"][16 * k : 16 * k + 16], int(sizes[k]), own.astype("<u8").tobytes(), own[: prefix(sizes[k]) - alone[k]].astype(np.int64).tolist()))
    return pd.DataFrame(out, columns=["node", "n", "grams", "first"])


# Prefix trees -------------------------------------------------------------------------------------


class PrefixTree:
    """Ordered sets as paths; a node's edge holds the n-grams it adds to its parent, so chains are one node."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        order = sorted(range(len(sets)), key=lambda k: sets[k].tolist())
        self.edges: list[np.ndarray] = [np.empty(0, np.int64)]
        self.kids: list[list[int]] = [[]]
        self.ends: list[list[int]] = [[]]
        self.depth = [0]
        path, last = [0], np.empty(0, np.int64)
        for k in order:
            own = sets[k]
            same = min(len(own), len(last))
            differ = np.flatnonzero(own[:same] != last[:same])
            common = int(differ[0]) if len(differ) else same
            below = -1
            while self.depth[path[-1]] > common:
                below = path.pop()
            if self.depth[path[-1]] < common:  # an edge parts here
                top, cut_at = path[-1], common - self.depth[path[-1]]
                middle = self._node(self.edges[below][:cut_at], common)
                self.edges[below] = self.edges[below][cut_at:]
                self.kids[top][self.kids[top].index(below)] = middle
                self.kids[middle].append(below)
                path.append(middle)
            if len(own) > common:
                leaf = self._node(own[common:], len(own))
                self.kids[path[-1]].append(leaf)
                path.append(leaf)
            self.ends[path[-1]].append(k)
            last = own
        count = len(self.edges)
        # Of the sets that end at a node or below: the smallest size, and the most n-grams beyond the node.
        self.smallest, self.longest = np.full(count, np.iinfo(np.int64).max), np.zeros(count, np.int64)
        for node in self._upwards():
            below = self.kids[node]
            self.smallest[node] = min([*(sizes[k] for k in self.ends[node]), *(self.smallest[x] for x in below)], default=np.iinfo(np.int64).max)
            self.longest[node] = max((self.longest[x] + len(self.edges[x]) for x in below), default=0)
        lengths = np.array([len(x) for x in self.edges])
        self.begin, self.length, self.flat = np.concatenate([[0], lengths.cumsum()[:-1]]), lengths, np.concatenate(self.edges)
        kids = [len(x) for x in self.kids]
        self.first_kid, self.n_kids, self.all_kids = np.concatenate([[0], np.cumsum(kids)[:-1]]), np.array(kids), np.array([x for own in self.kids for x in own], np.int64)
        self.ending = np.array([bool(x) for x in self.ends])

    def _node(self, edge: np.ndarray, depth: int) -> int:
        self.edges.append(edge), self.kids.append([]), self.ends.append([]), self.depth.append(depth)
        return len(self.edges) - 1

    def _upwards(self) -> list[int]:
        out, stack = [], [0]
        while stack:
            node = stack.pop()
            out.append(node)
            stack += self.kids[node]
        return out[::-1]

    def linked(self, own: np.ndarray, size: int, place: np.ndarray) -> list[tuple[int, int]]:
        """(set, overlap) of all that may have enough in common with ``own``; ``place`` is a table over all numbers, zero before and after."""
        place[own] = np.arange(1, len(own) + 1)
        nodes, overlap, reach, found = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64), []
        while len(nodes):
            for at in np.flatnonzero(self.ending[nodes]):
                found += [(k, int(overlap[at])) for k in self.ends[nodes[at]]]
            many = self.n_kids[nodes]
            parents = np.repeat(np.arange(len(nodes)), many)
            if not len(parents):
                break
            kids = self.all_kids[_spread(self.first_kid[nodes], many)]
            lengths = self.length[kids]
            met, begins = place[self.flat[_spread(self.begin[kids], lengths)]], np.concatenate([[0], lengths.cumsum()[:-1]])
            overlap = overlap[parents] + np.add.reduceat((met > 0).astype(np.int64), begins)
            # What the path has passed in the order cannot come again.
            reach = np.maximum(reach[parents], np.maximum.reduceat(met, begins))
            most = overlap + np.minimum(len(own) - reach, self.longest[kids])
            alive = (100 + PERCENT) * most >= PERCENT * (size + self.smallest[kids])
            nodes, overlap, reach = kids[alive], overlap[alive], reach[alive]
        place[own] = 0
        return found


def _spread(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of the ranges, one after the other."""
    return np.repeat(begins - np.concatenate([[0], lengths.cumsum()[:-1]]), lengths) + np.arange(lengths.sum())


LINKS = "a binary, b binary"


def _joined(rows: pd.DataFrame, forest: Forest) -> pd.DataFrame:
    """Links of the rows that ask (``side`` 0 and 1) with all rows, as far as they unite what is not one yet."""
    rows = rows.sort_values("side").drop_duplicates("node").reset_index(drop=True)
    nodes, sizes, sides = [bytes(x) for x in rows["node"]], rows["n"].to_numpy(np.int64), rows["side"].to_numpy()
    grams = [np.frombuffer(x, "<u8") for x in rows["grams"]]
    # Small numbers; the order in which each set has them stays the global one.
    names, local = np.unique(np.concatenate(grams), return_inverse=True) if grams else (np.empty(0), np.empty(0, np.int64))
    sets = np.split(local, np.cumsum([len(x) for x in grams])[:-1])
    tree, place, links = PrefixTree(sets, sizes), np.zeros(len(names), np.int64), []
    for k in np.flatnonzero(sides < 2):
        for other, both in tree.linked(sets[k], int(sizes[k]), place):
            if 100 * both >= PERCENT * (sizes[k] + sizes[other] - both) and forest.join(nodes[k], nodes[other]):
                links.append((nodes[k], nodes[other]))
    return pd.DataFrame(links, columns=["a", "b"])


def _block(rows: pd.DataFrame) -> pd.DataFrame:
    return _joined(rows, Forest())


def _tile(rows: pd.DataFrame) -> pd.DataFrame:
    """As a block, with what is already united; the asked rows may repeat the asking ones."""
    forest = Forest()
    for node, label in zip(rows["node"], rows["label"], strict=True):
        forest.join(bytes(node), b"label" + bytes(label))
    return _joined(rows, forest)


# The join -----------------------------------------------------------------------------------------


def _blocks_of(n: Column, sets: Column) -> Column:
    return F.greatest(F.ceil(n / BLOCK_GRAMS), F.ceil(sets / BLOCK_SETS)).cast("int")


def _numbers(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), n - 1))


def _ordered_sets(own: DataFrame, surveyed: DataFrame) -> DataFrame:
    """(node, n, grams, first): the sets that may link to another, in the global order, and their prefixes without what only they have."""
    spark = own.sparkSession
    total = surveyed.agg(F.sum("total")).first()[0] or 0
    frequent = surveyed.filter("keys is not null").select("keys", "counts").mapInPandas(_frequent, "key long, n long")
    frequent = frequent.groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= max(FREQUENT, total // COUNTERS))
    rows = frequent.toPandas()  # about COUNTERS rows at most, as their counts do not exceed the total
    keys = rows["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    known = spark.sparkContext.broadcast((keys[order], _level(rows["n"].to_numpy(np.int64)[order])))

    # One text of each class: rows of an id that is no class's least one are left out.
    filled = surveyed.filter("node is not null")
    firsts = filled.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id"))["doc_id"].alias("first")).select("first").distinct()
    ids = filled.select(F.col("doc_id").alias("gone")).distinct()
    gone = small(ids.join(firsts, F.col("gone").eqNullSafe(F.col("first")), "left_anti"), BROADCAST_IDS)
    texts = own.join(gone, own["doc_id"].eqNullSafe(gone["gone"]), "left_anti").select("text")
    parts = max(1, -(-total // PART))
    dealt = texts.mapInPandas(_dealt(parts, known), DEALT)
    shared = dealt.groupBy("part").applyInPandas(_shared, DEALT.removeprefix("part int, "))
    ordered = shared.groupBy("batch").applyInPandas(_ordered, "node binary, n long, grams binary, first array<long>")
    # A class whose id repeats, or is null, may have been read more than once.
    return cut(ordered.dropDuplicates(["node"]))


def jaccard_join(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of ``docs``."""
    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    surveyed = cut(own.select("doc_id", _surveyed.asNondeterministic()("text").alias("s")).select("doc_id", "s.*"))
    sets = _ordered_sets(own, surveyed)

    banded = sets.select("node", F.octet_length("grams").alias("size"), F.explode("first").alias("bucket"))
    mates = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("mates")).filter("mates > 1")
    members = cut(banded.join(mates, "bucket"))
    scores = members.groupBy("node").agg(F.sum("mates").alias("score"))
    hubs = members.join(scores, "node").groupBy("bucket").agg(F.max(F.struct("score", "node"))["node"].alias("hub"))
    clusters = cut(members.join(hubs, "bucket").select("hub", "node", (F.col("size") / 8).cast("long").alias("size")).distinct())
    dealt = cut(clusters.groupBy("hub").agg(_blocks_of(F.sum("size"), F.count(F.lit(1))).alias("blocks")))
    several = small(dealt.filter("blocks > 1"))
    placed = clusters.join(several, "hub", "left").na.fill(1, ["blocks"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    inside = placed.filter("node <> hub").select("hub", "block", "node", F.lit(1).alias("side"))
    centre = dealt.select("hub", _numbers(F.col("blocks")).alias("block"), F.col("hub").alias("node"), F.lit(0).alias("side"))
    whole = sets.select("node", "n", "grams")
    first = cut(inside.unionByName(centre).join(whole, "node").groupBy("hub", "block").applyInPandas(_block, LINKS))
    united = components(first)

    # Clusters of several blocks: who did not join the hub meets all blocks.
    large = placed.filter("blocks > 1")
    if not large.isEmpty():
        named = large.join(united.select("node", "root"), "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")
        centres = named.filter("node = hub").select("hub", F.col("label").alias("hub_label"))
        named = cut(named.join(small(centres), "hub"))
        asking = named.filter("label <> hub_label")
        counts = small(asking.groupBy("hub").agg(_blocks_of(F.sum("size"), F.count(F.lit(1))).alias("asks")))
        ask = F.pmod(F.xxhash64("node", F.lit(1)), F.col("asks")).cast("int").alias("ask")
        asks = asking.join(counts, "hub").select("hub", ask, _numbers(F.col("blocks")).alias("block"), "node", "label", F.lit(1).alias("side"))
        asked = named.join(counts, "hub").select("hub", _numbers(F.col("asks")).alias("ask"), "block", "node", "label", F.lit(2).alias("side"))
        second = asks.unionByName(asked).join(whole, "node").groupBy("hub", "ask", "block").applyInPandas(_tile, LINKS)
        united = components(cut(first.unionByName(second)))

    classes = surveyed.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("first"))
    classes = classes.join(united, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = classes.join(classes.groupBy("root").agg(F.min("first").alias("least")), "root").select("node", "least")
    rows = surveyed.select("doc_id", "n", "node").join(named, "node", "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))
