"""Approximate nearest neighbours by learned partitions.

A balanced partitioning of the neighbour graph of a bounded sample is learned by a small classifier, which then places
every vector and routes every query to its most probable partitions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.common import Shared, first_by_hash
from riskframe.session import durable

#: Vectors that the partitions are learned on: a bound on the driver's work, not on what is indexed or searched.
SAMPLE = 6144
GRAPH_NEIGHBOURS = 10
PARTITIONS = 16
HIDDEN = 128
STEPS = 1500
#: Recall that the number of probed partitions must reach on sample vectors the classifier was not trained on.
RECALL = 0.94
BLOCK_VECTORS = 16_384
BLOCK_QUERIES = 4_096


# Learning on the driver, from the sample only --------------------------------------------------------------------------


def _neighbours(points: np.ndarray, k: int, queries: np.ndarray | None = None) -> np.ndarray:
    """Rows of the ``k`` largest inner products with each query; a point is not its own neighbour."""
    own = queries is None
    queries, out = points if own else queries, []
    for i in range(0, len(queries), 1024):
        scores = queries[i : i + 1024] @ points.T
        if own:
            scores[np.arange(len(scores)), np.arange(i, i + len(scores))] = -np.inf
        k_here = min(k, scores.shape[1] - 1)
        out.append(np.argpartition(-scores, k_here, axis=1)[:, :k_here] if k_here else np.zeros((len(scores), 0), int))
    return np.concatenate(out) if out else np.zeros((0, 0), int)


def balanced_parts(neighbours: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """Parts of equal size, up to one vertex, that cut few edges of the neighbour graph.

    The graph is halved again and again: by the order of vertices along its slowest mode, found by repeated averaging
    over neighbours, and then by swapping pairs of vertices while a swap keeps more edges inside.
    """
    part = np.zeros(len(neighbours), np.int64)
    rounds = int(math.log2(parts))
    edges = np.stack([np.repeat(np.arange(len(neighbours)), neighbours.shape[1]), neighbours.ravel()])
    edges = np.unique(np.concatenate([edges, edges[::-1]], axis=1), axis=1)
    for _ in range(rounds):
        inside = edges[:, part[edges[0]] == part[edges[1]]]
        degree = np.bincount(inside[0], minlength=len(part)) + 1.0
        value = rng.standard_normal(len(part))
        for _ in range(60):
            value = (np.bincount(inside[0], value[inside[1]], len(part)) + value) / degree
            weight = np.bincount(part, degree)
            value -= (np.bincount(part, value * degree) / weight)[part]
            value /= np.sqrt(np.bincount(part, value * value) / np.bincount(part) + 1e-30)[part]
        order = np.lexsort((value, part))
        size = np.bincount(part)
        rank = np.arange(len(part)) - (np.cumsum(size) - size)[part[order]]
        side = np.empty(len(part), np.int64)
        side[order] = (rank >= size[part[order]] / 2).astype(np.int64)
        side = _swapped(inside, part, side)
        part = part * 2 + side
    return part


def _swapped(edges: np.ndarray, part: np.ndarray, side: np.ndarray, rounds: int = 12) -> np.ndarray:
    """Swap as many of the vertices that gain most from the other side as gain together, equally many each way."""
    for _ in range(rounds):
        other = np.bincount(edges[0], side[edges[1]] != side[edges[0]], len(side))
        gain = 2 * other - np.bincount(edges[0], minlength=len(side))
        moved = False
        for p in range(part.max() + 1):
            left = np.flatnonzero((part == p) & (side == 0) & (gain > 0))
            right = np.flatnonzero((part == p) & (side == 1) & (gain > 0))
            n = min(len(left), len(right)) // 2
            if n:
                side[left[np.argsort(-gain[left], kind="stable")[:n]]] = 1
                side[right[np.argsort(-gain[right], kind="stable")[:n]]] = 0
                moved = True
        if not moved:
            break
    return side


class Router:
    """A classifier with one hidden layer over partitions; a few hundred KB."""

    def __init__(self, weights: list[np.ndarray], probes: int):
        self.weights, self.probes = weights, probes

    def logits(self, points: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        length = np.linalg.norm(points, axis=1, keepdims=True)
        scaled = (points / length).astype(np.float32)
        return np.maximum(scaled @ w1 + b1, 0) @ w2 + b2

    def ranked(self, points: np.ndarray) -> np.ndarray:
        return np.argsort(-self.logits(points), axis=1, kind="stable")


def _fit(points: np.ndarray, wanted: np.ndarray, rng: np.random.Generator) -> Router:
    """Adam on the cross entropy between the router and the share of each partition among a point's neighbours."""
    width, parts = points.shape[1], wanted.shape[1]
    weights = [
        (rng.standard_normal((width, HIDDEN)) * math.sqrt(2 / width)).astype(np.float32) * math.sqrt(width) / 2, np.zeros(HIDDEN, np.float32),
        (rng.standard_normal((HIDDEN, parts)) * math.sqrt(1 / HIDDEN)).astype(np.float32), np.zeros(parts, np.float32),
    ]
    router = Router([w.astype(np.float32) for w in weights], parts)
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in router.weights]
    scaled = (points / np.linalg.norm(points, axis=1, keepdims=True)).astype(np.float32)
    for step in range(1, STEPS + 1):
        rows = rng.integers(0, len(points), 256)
        x, y = scaled[rows], wanted[rows]
        w1, b1, w2, b2 = router.weights
        hidden = np.maximum(x @ w1 + b1, 0)
        logits = hidden @ w2 + b2
        shares = np.exp(logits - logits.max(axis=1, keepdims=True))
        error = (shares / shares.sum(axis=1, keepdims=True) - y) / len(rows)
        back = (error @ w2.T) * (hidden > 0)
        rate = 3e-3 * (1 - step / (STEPS + 1))
        for w, (m, v), g in zip(router.weights, moments, [x.T @ back, back.sum(0), hidden.T @ error, error.sum(0)], strict=True):
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            v += 0.001 * g * g
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return router


def learn_router(points: np.ndarray, k: int, parts: int = PARTITIONS, recall: float = RECALL) -> Router:
    """Learn partitions and routing, and how many partitions a query needs.

    A fifth of the sample takes no part in learning.  Those vectors are routed, and the least number of partitions is
    taken that holds the share ``recall`` of their ``k`` nearest sample vectors; all, if none less does.
    """
    rng = np.random.default_rng(11)
    if len(points) < 20 * parts:
        width = points.shape[1]
        return Router([np.zeros((width, 1), np.float32), np.zeros(1, np.float32), np.zeros((1, 1), np.float32), np.zeros(1, np.float32)], 1)
    learned, tested = points[: len(points) * 4 // 5], points[len(points) * 4 // 5 :]
    graph = _neighbours(learned, GRAPH_NEIGHBOURS)
    part = balanced_parts(graph, parts, rng)
    wanted = np.zeros((len(learned), parts), np.float32)
    np.add.at(wanted, (np.repeat(np.arange(len(learned)), graph.shape[1]), part[graph].ravel()), 1.0)
    np.add.at(wanted, (np.arange(len(learned)), part), 2.0)
    router = _fit(learned, wanted / wanted.sum(axis=1, keepdims=True), rng)
    placed = router.ranked(learned)[:, 0]
    near = _neighbours(learned, k, tested)
    ranked = router.ranked(tested)
    place_of = np.empty_like(ranked)
    np.put_along_axis(place_of, ranked, np.arange(parts)[None, :].repeat(len(ranked), 0), axis=1)
    depth = np.take_along_axis(place_of, placed[near], axis=1)
    router.probes = int(np.searchsorted(np.cumsum(np.bincount(depth.ravel(), minlength=parts)) / depth.size, recall) + 1)
    router.probes = min(router.probes, parts)
    return router


# The index and the search, on Spark -------------------------------------------------------------------------------------


def _usable(vector: Column) -> Column:
    """Not null or empty, every component present and finite, and not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64) if len(vectors) else np.zeros((0, 0))


def _placed(shared, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if len(batch):
            yield batch.assign(part=shared.value.ranked(_matrix(batch["vector"]))[:, 0].astype(np.int64))


def _routed(shared, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if len(batch):
            ranked = shared.value.ranked(_matrix(batch["vector"])).astype(np.int64)
            yield batch.assign(part=list(ranked[:, : shared.value.probes]), rest=list(ranked[:, shared.value.probes :]))


def _best(k: int, queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
    """Each query's ``k`` best rows of one block, in double precision; ties to smaller ids, the query's own id left out.

    A vector stands for all rows that hold it, by its ``k + 1`` smallest ids: no other row can be among the best.
    """
    none = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
    if queries.empty or vectors.empty:
        return none
    points, ids = _matrix(vectors["vector"]), vectors["ids"].to_numpy()
    asked, names = _matrix(queries["vector"]), queries["query_id"].to_numpy()
    out = []
    for i in range(0, len(asked), 256):
        scores = asked[i : i + 256] @ points.T
        take = min(k + 1, scores.shape[1])
        # Everything down to the (k + 1)-th best, so that no tie is cut; a hair is left for rounding.
        cut = -np.partition(-scores, take - 1, axis=1)[:, take - 1]
        for row, low in enumerate(cut):
            found = np.flatnonzero(scores[row] >= low - 1e-9)
            exact = [math.fsum(asked[i + row] * points[j]) for j in found]
            pairs = sorted((-score, vec, j) for score, j in zip(exact, found, strict=True) for vec in ids[j] if vec != names[i + row])
            out += [(names[i + row], vec, -score) for score, vec, _ in pairs[:k]]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]) if out else none


def nearest(vectors: DataFrame, query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", parts: int = PARTITIONS) -> DataFrame:
    """The ``k`` nearest rows of every row where ``query`` holds: ``query_id``, ``rank``, ``vec_id``, ``score``.

    Nearness is the inner product in double precision of the original vectors.  Rows with a null key, and vectors that
    are null, empty, zero or hold null or non-finite components take no part.  Vectors of each width are searched among
    themselves, one index after another.  Repeated rows count once.  Without any usable row the result is empty.

    Equal vectors are one entry of the index, with their ``k + 1`` smallest ids, so a vector that a third of all rows share
    is no hot partition; as only ties to the smallest ids can be returned, nothing is lost.  The sample for learning is
    taken by hash and bounded by SAMPLE; every row is indexed.  Partitions are searched in blocks of bounded size.  A query
    whose probed partitions hold fewer than ``k`` other rows is searched in all that are left.
    """
    values = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), values.alias("vector"), F.coalesce(query, F.lit(False)).alias("_query"))
    rows = durable(rows.where(F.col("vec_id").isNotNull() & _usable(F.col("vector"))))
    out = None
    for width in [r[0] for r in rows.select(F.size("vector")).distinct().orderBy(F.size("vector")).collect()]:
        # -0.0 and 0.0 are one value in groupings.
        found = _nearest_of_one_width(rows.where(F.size("vector") == width), k, parts)
        out = found if out is None else out.union(found)
    return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double") if out is None else out


def _nearest_of_one_width(rows: DataFrame, k: int, parts: int) -> DataFrame:
    smallest = Window.partitionBy("vector").orderBy("vec_id")
    distinct = rows.select("vector", "vec_id").withColumn("_rank", F.dense_rank().over(smallest)).where(F.col("_rank") <= k + 1)
    distinct = durable(distinct.groupBy("vector").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")))

    drawn = first_by_hash(distinct.select("vector", F.xxhash64("vector").alias("_h")), SAMPLE).orderBy("_h").toPandas()
    shared = Shared(rows.sparkSession, learn_router(_matrix(drawn["vector"]), k, parts))

    placed = durable(distinct.mapInPandas(lambda it: _placed(shared, it), "vector array<double>, ids array<long>, part long"))
    routed = rows.where("_query").select(F.col("vec_id").alias("query_id"), "vector").dropDuplicates(["query_id", "vector"])
    routed = durable(routed.mapInPandas(lambda it: _routed(shared, it), "query_id long, vector array<double>, part array<long>, rest array<long>"))
    found = durable(_searched(routed.withColumn("part", F.explode("part")), placed, k))
    full = found.groupBy("query_id").agg(F.countDistinct("vec_id").alias("n")).where(F.col("n") >= k)
    short = durable(routed.where(F.size("rest") > 0).join(full, "query_id", "left_anti"))
    if not short.isEmpty():
        found = found.union(_searched(short.withColumn("part", F.explode("rest")), placed, k))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.dropDuplicates(["query_id", "vec_id", "score"]).withColumn("rank", F.row_number().over(best))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _searched(routed: DataFrame, placed: DataFrame, k: int) -> DataFrame:
    """The best of each query in each partition that it is routed to, by blocks of the partition and of its queries."""
    sizes = placed.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / BLOCK_VECTORS).alias("slices"))
    asked = routed.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).alias("chunks"))
    # One row a partition: at most PARTITIONS rows.
    grid = durable(sizes.join(asked, "part"))
    hashed = lambda column, of: F.pmod(F.xxhash64(column), F.col(of))
    every = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.col(of) - 1))
    left = routed.join(grid, "part").withColumn("chunk", hashed("query_id", "chunks")).withColumn("slice", every("slices"))
    right = placed.join(grid, "part").withColumn("slice", hashed("vector", "slices")).withColumn("chunk", every("chunks"))
    block = ["part", "slice", "chunk"]
    left, right = left.select(*block, "query_id", "vector").groupBy(*block), right.select(*block, "vector", "ids").groupBy(*block)
    return left.cogroup(right).applyInPandas(lambda a, b: _best(k, a, b), "query_id long, vec_id long, score double")
