"""Exact nearest neighbours by pivots and the triangle inequality.

Equal vectors are one point, with its lowest keys.  Every point and every query goes to its nearest pivot, and cells that lie
together form blocks.  A query's own block gives it a bound on its ``k``-th distance; after that a block of queries meets the
blocks of points that the ball of any of them can reach and no others:

* a cell of radius ``r`` whose pivot is at distance ``d`` from the query holds nothing nearer than ``d - r``;
* no point of another pivot's cell is nearer than the plane halfway between that pivot and the query's own.

Blocks are compared as matrices, so no pair of rows is ever a row, and rows are sent once for each pair of blocks.  How many
blocks a ball reaches depends on the data: few with few dimensions or clear clusters, all of them where distances hardly differ.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.frames import top_per_key
from riskframe.session import durable

#: Pivots, drawn by hash of the vector: about one for every CELL points, and about MOST_PIVOTS at most; they are broadcast.
CELL = 256
MOST_PIVOTS = 1024
#: Points or queries of a block: a share of all of them, so that rows are sent about BLOCKS times at every size, between these limits.
BLOCKS = 16
LEAST_BLOCK = 1024
BLOCK_POINTS = BLOCK_QUERIES = 32_768
#: Rows and columns of one matrix of distances, and pairs whose exact distances are worked out at once.
PART_QUERIES, PART_POINTS = 1024, 2048
PAIRS = 1 << 17
#: Bounds give way by this share, so that rounding excludes nothing.
SLACK = 1e-9


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0)


def _lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of rows, summed in order as Spark does."""
    apart = a - b
    return np.sqrt(np.cumsum(apart * apart, axis=1)[:, -1])


def _placed(pivots: np.ndarray, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if len(batch):
            points = _matrix(batch["_v"])
            cell = _squared(points, pivots).argmin(axis=1)
            yield batch.assign(_pivot=cell.astype(np.int32), _d=_lengths(points, pivots[cell]))


def _bounded(pivots: np.ndarray, radius: np.ndarray, keys: np.ndarray, k: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The cell of each query, and a distance within which there are ``k`` keys: whole cells, by their far ends."""
    for batch in batches:
        if len(batch):
            points = _matrix(batch["_v"])
            apart = np.sqrt(_squared(points, pivots))
            cell = apart.argmin(axis=1)
            far = np.where(keys > 0, apart + radius, np.inf)
            order = np.argsort(far, axis=1)
            enough = np.cumsum(keys[order], axis=1) >= k
            last = np.where(enough.any(axis=1), enough.argmax(axis=1), 0)
            bound = np.where(enough.any(axis=1), far[np.arange(len(far)), order[np.arange(len(far)), last]], np.inf)
            yield pd.DataFrame({"_q": batch["_q"], "_pivot": cell.astype(np.int32), "_d": _lengths(points, pivots[cell]), "_bound": bound * (1 + SLACK)})


def _grouped(pivots: np.ndarray, sizes: np.ndarray, most: int) -> np.ndarray:
    """The group of each pivot: all are halved along their widest dimension until a group holds at most ``most`` points."""
    group, todo, made = np.zeros(len(pivots), np.int64), [np.arange(len(pivots))], 0
    while todo:
        own = todo.pop()
        if len(own) > 1 and sizes[own].sum() > most:
            own = own[np.argsort(pivots[own, np.ptp(pivots[own], axis=0).argmax()], kind="stable")]
            half = np.cumsum(sizes[own])
            at = min(max(int(np.searchsorted(half, half[-1] / 2)), 1), len(own) - 1)
            todo += [own[at:], own[:at]]
        else:
            group[own] = made
            made += 1
    return group


def _reached(pivots: np.ndarray, radius: np.ndarray, keys: np.ndarray, group: np.ndarray, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Groups of cells that the ball of any query of a block reaches."""
    between = np.sqrt(_squared(pivots, pivots))
    for batch in batches:
        if not len(batch):
            continue
        points, bound = _matrix(batch["_v"]), batch["_bound"].to_numpy()[:, None]
        apart = np.sqrt(_squared(points, pivots))
        own = apart.argmin(axis=1)
        nearest = apart[np.arange(len(own)), own][:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = np.nan_to_num((apart**2 - nearest**2) / (2 * between[own]), nan=0.0, posinf=0.0)
        ease = SLACK * (1 + apart + np.abs(pivots).max(initial=0))
        reached = (keys > 0) & (apart - radius <= bound + ease) & (plane <= bound + ease)
        query, pivot = np.nonzero(reached)
        yield pd.DataFrame({"_asking": batch["_asking"].to_numpy()[query], "_group": group[pivot]}).drop_duplicates()


def _first(k: int, rows: np.ndarray, lengths: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` first (length, name) of each row, rows in order."""
    order = np.lexsort((names, lengths, rows))
    rows, lengths, names = rows[order], lengths[order], names[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[keep], lengths[keep], names[keep]


def _best(k: int, queries: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
    """The ``k`` nearest keys of each query within one block and its bound, ties to the lower key."""
    out = {"_q": [], "_distance": [], "_neighbour": []}
    if len(queries) and len(points):
        queries, points = queries.sort_values(["_pivot", "_d"]), points.sort_values(["_pivot", "_d"])
        asked, found, ids = _matrix(queries["_v"]), _matrix(points["_v"]), queries["_q"].to_numpy()
        limits = queries["_bound"].to_numpy()
        counts = points["_keys"].map(len).to_numpy()
        start = np.cumsum(counts) - counts
        named, ranks = np.unique(np.concatenate(points["_keys"].to_numpy()), return_inverse=True)
        # Half the squared distance, without the query's own length, is one product of matrices.
        half = (found * found).sum(1) / 2
        wide = np.column_stack([found, half])
        parts = [slice(i, i + PART_POINTS) for i in range(0, len(found), PART_POINTS)]
        middles = np.stack([found[p].mean(0) for p in parts])
        reach = np.array([_lengths(found[p], m).max() for p, m in zip(parts, middles)])
        for i in range(0, len(asked), PART_QUERIES):
            own, cut = asked[i : i + PART_QUERIES], limits[i : i + PART_QUERIES].copy()
            turned, size = np.column_stack([-own, np.ones(len(own))]), (own * own).sum(1)
            middle = own.mean(0)
            apart = _lengths(middles, middle)
            gap = (apart - reach - _lengths(own, middle).max()) * (1 - SLACK) - SLACK * (1 + np.sqrt(2 * half.max()) + np.sqrt(size.max()))
            rows, lengths, names = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
            for n, j in enumerate(np.argsort(apart, kind="stable")):
                if gap[j] > cut.max():
                    continue
                rough = turned @ wide[parts[j]].T
                ease = 1e-12 * (size + 2 * half.max())
                limit = (cut * cut * (1 + 4 * SLACK) - size) / 2 + ease
                if n == 0 and rough.shape[1] >= k:
                    # Bounds may still be wide.  These points surely hold the k nearest keys: one key each is enough to say so.
                    kth = np.partition(rough, k - 1, axis=1)[:, k - 1]
                    limit = np.minimum(limit, kth + 2 * ease + SLACK * np.abs(kth + size / 2))
                near = np.flatnonzero(rough <= limit[:, None])
                for at in range(0, len(near), PAIRS):
                    row, point = np.divmod(near[at : at + PAIRS], rough.shape[1])
                    point += parts[j].start
                    length = _lengths(found[point], own[row])
                    # Every key of a point, one after the other.
                    many = counts[point]
                    place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(start[point], many)
                    rows, lengths, names = _first(
                        k, np.concatenate([rows, np.repeat(row, many)]), np.concatenate([lengths, np.repeat(length, many)]), np.concatenate([names, ranks[place]]),
                    )
                if len(near):
                    full = np.flatnonzero(np.bincount(rows, minlength=len(own)) >= k)
                    last = np.searchsorted(rows, full, side="right") - 1
                    cut[full] = np.minimum(cut[full], lengths[last] * (1 + SLACK))
            out["_q"].append(ids[i : i + PART_QUERIES][rows])
            out["_distance"].append(lengths)
            out["_neighbour"].append(named[names])
    return pd.DataFrame({c: np.concatenate(v) if v else np.zeros(0, object) for c, v in out.items()})


def _searched(pairs: DataFrame, asked: DataFrame, placed: DataFrame, k: int, kind: str) -> DataFrame:
    """``(_q, _distance, _neighbour)``: the best of every query in every block that its own block of queries wants."""
    by = ["_asking", "_block"]
    left = asked.join(pairs, "_asking").select(*by, "_q", "_v", "_pivot", "_d", "_bound").groupBy(*by)
    right = placed.join(pairs, "_block").select(*by, "_v", "_keys", "_pivot", "_d").groupBy(*by)
    found = left.cogroup(right).applyInPandas(lambda a, b: _best(k, a, b), f"_q long, _distance double, _neighbour {kind}")
    return durable(found)


def _dealt(df: DataFrame, value: str, group: np.ndarray, sizes: np.ndarray, most: int, name: str) -> tuple[DataFrame, np.ndarray]:
    """Rows with the number of their block, and the first block of every group: a group too large for one is dealt by hash."""
    parts = np.maximum(1, -(-np.bincount(group, sizes) // most)).astype(np.int64)
    first = np.cumsum(parts) - parts
    table = df.sparkSession.createDataFrame(
        pd.DataFrame({"_pivot": np.arange(len(group), dtype=np.int32), "_from": first[group], "_parts": parts[group]}), "_pivot int, _from long, _parts long"
    )
    block = F.col("_from") + F.pmod(F.xxhash64(value), F.col("_parts"))
    return df.join(F.broadcast(table), "_pivot").withColumn(name, block).drop("_from", "_parts"), np.append(first, parts.sum())


def nearest(queries: DataFrame, base: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """``(key, neighbour, distance)``: the ``k`` nearest base rows of every query row, all of them where there are fewer.

    Exact at every size.  A row is never its own neighbour, and ties go to the lower key.  Keys are unique and not null;
    vectors have one width and finite entries.  Rows without a vector neither ask nor answer.
    """
    spark, kind = queries.sparkSession, dict(base.dtypes)[key]
    values = F.col(vector).cast("array<double>")
    rows = base.select(F.col(key).alias("_k"), values.alias("_v")).where("_k IS NOT NULL AND _v IS NOT NULL")
    # A query leaves out its own key, so one more is looked for; of equal vectors no more keys than that can be among the nearest.
    k += 1
    lowest = top_per_key(rows, ["_v"], [F.col("_k")], k)
    points = durable(lowest.groupBy("_v").agg(F.sort_array(F.collect_list("_k")).alias("_keys")))
    asking = queries.select(F.col(key).alias("_key"), values.alias("_v")).where("_v IS NOT NULL")
    many = points.count()
    if not many:
        return asking.where("false").select(F.col("_key").alias(key), F.lit(None).cast(kind).alias("neighbour"), F.lit(0.0).alias("distance"))
    every = max(CELL, many // MOST_PIVOTS)
    drawn = points.where(F.pmod(F.xxhash64("_v"), F.lit(every)) == 0).select("_v").orderBy("_v").collect() or points.select("_v").orderBy("_v").take(1)
    pivots = spark.sparkContext.broadcast(np.array([r["_v"] for r in drawn], np.float64))

    placed = durable(points.mapInPandas(lambda it: _placed(pivots.value, it), f"_v array<double>, _keys array<{kind}>, _pivot int, _d double"))
    radius, keys, sizes = np.zeros(len(drawn)), np.zeros(len(drawn), np.int64), np.zeros(len(drawn), np.int64)
    for r in placed.groupBy("_pivot").agg(F.max("_d").alias("r"), F.sum(F.size("_keys")).alias("n"), F.count(F.lit(1)).alias("points")).collect():
        radius[r["_pivot"]], keys[r["_pivot"]], sizes[r["_pivot"]] = r["r"], r["n"], r["points"]
    share = max(LEAST_BLOCK, many // BLOCKS)
    group = _grouped(pivots.value, sizes, min(share, BLOCK_POINTS))
    placed, first = _dealt(placed, "_v", group, sizes, min(share, BLOCK_POINTS), "_block")

    # Numbers of queries are fixed once the table is written.
    asked = durable(asking.select("_v").distinct().withColumn("_q", F.monotonically_increasing_id()))
    route = "_q long, _pivot int, _d double, _bound double"
    started = durable(asked.mapInPandas(lambda it: _bounded(pivots.value, radius, keys, k, it), route))
    waiting = np.zeros(len(drawn), np.int64)
    for r in started.groupBy("_pivot").count().collect():
        waiting[r["_pivot"]] = r["count"]
    dealt, begin = _dealt(started, "_q", group, waiting, min(share, BLOCK_QUERIES), "_asking")
    asked = durable(dealt.join(asked, "_q"))
    # Blocks of queries with the group that is their own, and its first block.
    owner = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    own = spark.createDataFrame(pd.DataFrame({"_asking": np.arange(len(owner)), "_block": first[owner]}), "_asking long, _block long")
    begun = _searched(own, asked, placed, k, kind)

    kth = begun.groupBy("_q").agg(F.count(F.lit(1)).alias("_n"), F.max("_distance").alias("_far"))
    bound = F.when(F.col("_n") >= k, F.least("_bound", F.col("_far") * (1 + SLACK))).otherwise(F.col("_bound"))
    asked = durable(asked.join(kth, "_q", "left").withColumn("_bound", bound).drop("_n", "_far"))
    cells = asked.mapInPandas(lambda it: _reached(pivots.value, radius, keys, group, it), "_asking long, _group long").distinct()
    blocks = spark.createDataFrame(
        pd.DataFrame({"_group": np.repeat(np.arange(len(first) - 1), np.diff(first)), "_block": np.arange(first[-1])}), "_group long, _block long"
    )
    more = cells.join(F.broadcast(blocks), "_group").select("_asking", "_block").join(own, ["_asking", "_block"], "left_anti")
    found = begun.unionByName(_searched(durable(more), asked, placed, k, kind))

    best = top_per_key(found, ["_q"], [F.col("_distance"), F.col("_neighbour")], k)
    best = best.groupBy("_q").agg(F.sort_array(F.collect_list(F.struct("_distance", "_neighbour"))).alias("_best"))
    answers = durable(best.join(asked, "_q").select("_v", "_best"))
    others = F.slice(F.filter("_best", lambda x: x["_neighbour"] != F.col("_key")), 1, k - 1)
    listed = asking.join(answers, "_v").select("_key", F.explode(others).alias("_n"))
    return listed.select(F.col("_key").alias(key), F.col("_n._neighbour").alias("neighbour"), F.col("_n._distance").alias("distance"))
