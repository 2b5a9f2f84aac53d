"""Exact top-k search by inner product with a pivot-distance index.

Vectors get one more component, so that all have the largest length M; then the distance of a
query (with a zero there) and a vector is a falling function of their inner product, and
the triangle inequality bounds it: a vector at distance d from a pivot is at least
``|d(query, pivot) - d|`` from the query.

The index keys every vector by its nearest pivot and its annulus there (the distance in steps of
a fixed width), in blocks of bounded size. Queries come in blocks by nearest pivot. First, the
inner blocks of the own pivot give every query k scores, so a radius that its answers cannot
leave. Then the annuli that this radius reaches are expanded, pivot by pivot; all others are
never touched. One tile is one query block against one index block.

Pivots are chosen from ``SAMPLE`` vectors (the least by hash of the id), farthest first; they
affect the speed only, every row is indexed and answers are exact.

Defined cases: vectors that are null or hold null or non-finite components, or have no id, take no
part; vectors of fewer components count as filled up with zeros; rows repeated with one id are
candidates each, but never of a query with that id, and ask once; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomeweave.llm.common import cut

SAMPLE = 4096
PIVOTS = 16
#: Annuli between distance 0 and the largest possible one, twice M.
ANNULI = 64
INDEX_BLOCK, QUERY_BLOCK = 4096, 1024


def quantised(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) per component as whole numbers; null if the vector takes no part."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.when(fine, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return out


def _farthest_first(points: np.ndarray, count: int) -> np.ndarray:
    chosen = [0]
    near = ((points - points[0]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(points)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return points[chosen]


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a @ b.T of whole numbers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    return (a.astype(float) @ b.T.astype(float)).astype(np.int64) if most < 2**53 else a @ b.T


def _pack(rows: pd.DataFrame, width: int) -> dict:
    rows = rows.sort_values("id")
    return {"n": len(rows), "ids": rows["id"].to_numpy("<i8").tobytes(), "vectors": _matrix(rows["v"], width).astype("<i8").tobytes()}


PACKED = "n int, ids binary, vectors binary, dists binary, bounds binary"


def _tile(k: int, width: int):
    """Of one query block and one index block: each query's k best, if not under its bound."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        q, x = rows[rows["kind"] == 0], rows[rows["kind"] == 1]
        out = []
        if len(q) and len(x):
            q, x = q.iloc[0], x.iloc[0]
            ids, own = np.frombuffer(x["ids"], "<i8"), np.frombuffer(q["ids"], "<i8")
            bounds = np.frombuffer(q["bounds"], "<f8").reshape(-1, 2) if q["bounds"] is not None else np.tile([-np.inf, np.inf], (len(own), 1))
            at = np.frombuffer(q["dists"], "<f8").reshape(len(own), -1)[:, int(x["pivot"])]
            low, high = np.frombuffer(x["dists"], "<f8")
            reach = np.flatnonzero((at - bounds[:, 1] <= high) & (at + bounds[:, 1] >= low))
            if len(reach):
                scores = _products(np.frombuffer(q["vectors"], "<i8").reshape(-1, width)[reach], np.frombuffer(x["vectors"], "<i8").reshape(-1, width))
                for r, row in zip(reach, scores, strict=True):
                    fits = np.flatnonzero((row >= bounds[r, 0]) & (ids != own[r]))
                    if len(fits) > k:
                        least = np.partition(row[fits], len(fits) - k)[len(fits) - k]
                        over = fits[row[fits] > least]  # ids rise along the block: of ties the first stay
                        fits = np.concatenate([over, fits[row[fits] == least][: k - len(over)]])
                    out += [(own[r], ids[f], row[f]) for f in fits]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"], dtype="int64")

    return run


def search(rows: DataFrame, asks: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id and score of each asking row's k best other rows, ties to the smaller id."""
    base = rows.select(F.col(f"`{vec_id}`").cast("long").alias("id"), quantised(F.col(f"`{vector}`"), scale).alias("v"), asks.alias("asks"))
    base = cut(base.filter("id IS NOT NULL AND v IS NOT NULL"))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    width, longest = base.agg(F.max(F.size("v")), F.max(square)).first()
    empty = base.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if width is None:
        return empty
    width = max(width, 1)
    # A bounded sample goes to the driver.
    sample = [r.v for r in base.select("v", F.xxhash64("id").alias("h")).orderBy("h").limit(SAMPLE).collect()]
    points = _matrix(pd.Series(sample), width).astype(float)
    lift = np.sqrt(np.maximum(longest - (points**2).sum(axis=1), 0))
    pivots = _farthest_first(np.column_stack([points, lift]), PIVOTS)
    step = max(2 * math.sqrt(longest), 1.0) / ANNULI
    slack = 1e-6 * (math.sqrt(longest) + 1)

    def distances(m: np.ndarray, lifted: bool) -> np.ndarray:
        m = m.astype(float)
        extra = np.sqrt(np.maximum(longest - (m**2).sum(axis=1), 0)) if lifted else np.zeros(len(m))
        m = np.column_stack([m, extra])
        return np.sqrt(np.maximum((m**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1) - 2 * m @ pivots.T, 0))

    def key(batches):
        for batch in batches:
            d = distances(_matrix(batch["v"], width), True)
            near = d.argmin(axis=1)
            d = d[np.arange(len(d)), near]
            yield batch[["id", "v"]].assign(pivot=near.astype("int32"), annulus=(d / step).astype("int32"), d=d)

    def key_queries(batches):
        for batch in batches:
            d = distances(_matrix(batch["v"], width), False)
            yield batch[["id", "v"]].assign(pivot=d.argmin(axis=1).astype("int32"), dists=list(d), square=[float(np.square(np.array(v, float)).sum()) for v in batch["v"]])

    def pack_index(rows: pd.DataFrame) -> pd.DataFrame:
        low_high = np.array([rows["d"].min() - slack, rows["d"].max() + slack])
        return pd.DataFrame([{"pivot": rows["pivot"].iloc[0], "annulus": rows["annulus"].iloc[0], "block": rows["block"].iloc[0], **_pack(rows, width), "dists": low_high.tobytes(), "bounds": None}])

    def pack_queries(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        bounds = np.column_stack([rows["least"].fillna(-np.inf).to_numpy(float), rows["radius"].fillna(np.inf).to_numpy(float)])
        return pd.DataFrame([{"pivot": rows["pivot"].iloc[0], "block": rows["block"].iloc[0], **_pack(rows, width), "dists": np.stack(rows["dists"]).astype("<f8").tobytes(), "bounds": bounds.astype("<f8").tobytes()}])

    keyed = base.mapInPandas(key, "id long, v array<long>, pivot int, annulus int, d double")
    cells = keyed.groupBy("pivot", "annulus").count()
    blocks = F.ceil(F.col("count") / INDEX_BLOCK)
    dealt = keyed.join(F.broadcast(cells), ["pivot", "annulus"]).withColumn("block", F.pmod(F.xxhash64("id", F.lit(7)), blocks).cast("int"))  # at most PIVOTS * ANNULI cells
    index = cut(dealt.groupBy("pivot", "annulus", "block").applyInPandas(pack_index, f"pivot int, annulus int, block int, {PACKED}"))
    queries = base.filter("asks").dropDuplicates(["id", "v"]).mapInPandas(key_queries, "id long, v array<long>, pivot int, dists array<double>, square double")
    groups = F.broadcast(queries.groupBy("pivot").count())  # at most PIVOTS rows
    queries = cut(queries.join(groups, "pivot").withColumn("block", F.pmod(F.xxhash64("id", F.lit(9)), F.ceil(F.col("count") / QUERY_BLOCK)).cast("int")).drop("count"))
    packing = f"pivot int, block int, {PACKED}"

    def run(pairs: DataFrame, asked: DataFrame) -> DataFrame:
        """The tiles ``pairs`` (q_pivot, q_block, pivot, annulus, block)."""
        tile = ["q_pivot", "q_block", "pivot", "annulus", "block"]
        payload = ["n", "ids", "vectors", "dists", "bounds"]
        q = pairs.join(asked.select(F.col("pivot").alias("q_pivot"), F.col("block").alias("q_block"), *payload), ["q_pivot", "q_block"]).withColumn("kind", F.lit(0))
        x = pairs.join(index, ["pivot", "annulus", "block"]).withColumn("kind", F.lit(1))
        both = q.select(*tile, "kind", *payload).unionByName(x.select(*tile, "kind", *payload))
        return both.groupBy(*tile).applyInPandas(_tile(k, width), "query_id long, vec_id long, score long")

    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    open_ = queries.withColumns({"least": F.lit(None).cast("double"), "radius": F.lit(None).cast("double")})
    packed = open_.groupBy("pivot", "block").applyInPandas(pack_queries, packing)
    meta = index.select("pivot", "annulus", "block")
    own = queries.select(F.col("pivot").alias("q_pivot"), F.col("block").alias("q_block")).distinct().join(meta.filter("block = 0"), F.col("q_pivot") == F.col("pivot"))
    first = cut(run(own, packed).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k))

    # The k-th score so far bounds how far answers can be: radius^2 = |q|^2 + M^2 - 2 score.
    kth = first.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("least"))
    gap = F.col("square") + F.lit(float(longest)) - 2 * F.col("least")
    radius = F.when(gap > 0, F.sqrt(gap) + F.lit(slack)).when(gap <= 0, F.lit(slack))  # null: fewer than k so far
    bounded = cut(queries.join(kth, "id", "left").withColumn("radius", radius))
    reach = bounded.select(F.col("pivot").alias("q_pivot"), F.col("block").alias("q_block"), "radius", F.posexplode("dists").alias("pivot", "at")).withColumns(
        {"low": F.coalesce(F.greatest(F.lit(0), F.floor((F.col("at") - F.col("radius") - 2 * slack) / step)), F.lit(0)), "high": F.coalesce(F.least(F.lit(ANNULI), F.floor((F.col("at") + F.col("radius") + 2 * slack) / step)), F.lit(ANNULI))}
    )
    wide = reach.filter("high >= low").groupBy("q_pivot", "q_block", "pivot").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    wanted = wide.select("q_pivot", "q_block", "pivot", F.explode(F.sequence(F.col("low").cast("int"), F.col("high").cast("int"))).alias("annulus"))
    pairs = wanted.join(meta, ["pivot", "annulus"]).filter("NOT (block = 0 AND pivot = q_pivot)")
    second = run(pairs.select("q_pivot", "q_block", "pivot", "annulus", "block"), bounded.groupBy("pivot", "block").applyInPandas(pack_queries, packing))
    ranked = first.drop("rank").unionByName(second).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
