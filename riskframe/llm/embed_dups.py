"""Near-duplicate vectors by p-stable hashing of Euclidean distance.

On normalised vectors a cosine is a distance, so vectors are hashed by random projections that are cut into cells
(Gaussian, hence 2-stable).  A bucket of one table is the same cell in all its projections.  Vectors that share a bucket
of any table are compared by exact cosine.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import connected
from riskframe.session import durable

COSINE = 0.93
#: Chance to find a pair that is just near enough; nearer pairs are found more often.
RECALL = 0.97
#: Width of a cell; it gives the least exponent for pairs at COSINE among vectors that are at right angles.
CELL = 2.0
#: Vectors of one side of a block.
BLOCK = 1024
SEED = 11


def collision(distance: float, cell: float = CELL) -> float:
    """Chance that two points so far apart fall in one cell of one projection."""
    r = cell / distance
    tail = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def table_sizes(vectors: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """Projections per table and tables for so many vectors that may meet.

    A table has as many projections as leave an unrelated vector (at right angles) an eighth of a partner by chance, and
    there are as many tables as find a pair at the threshold with the wanted chance.  So both grow with the table.
    """
    projections = max(1, math.ceil(math.log(8 * max(vectors, 1)) / -math.log(collision(math.sqrt(2)))))
    met = collision(math.sqrt(2 - 2 * cosine)) ** projections
    return projections, math.ceil(math.log(1 - recall) / math.log(1 - met))


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by a power of two first, so that no square overflows or vanishes."""
    scaled = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])
    return scaled / np.sqrt((scaled * scaled).sum(axis=1))[:, None]


class _Tables:
    """The hashed projections, drawn anew for each width of vectors; a task draws them from the seed."""

    def __init__(self, projections: int, tables: int):
        self.shape, self._drawn = (tables, projections), {}
        self._factors = np.random.default_rng(SEED).integers(1, 1 << 63, (tables, projections), np.uint64) | np.uint64(1)

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        """One bucket key a table for each row: the cells of its projections, mixed to 64 bits."""
        width = vectors.shape[1]
        if width not in self._drawn:
            rng = np.random.default_rng([SEED, width])
            size = self.shape[0] * self.shape[1]
            self._drawn[width] = rng.standard_normal((width, size)), rng.uniform(0, CELL, size)
        directions, shifts = self._drawn[width]
        cells = np.floor((_unit(vectors) @ directions + shifts) / CELL).astype(np.int64).view(np.uint64)
        mixed = cells.reshape(len(vectors), *self.shape) * self._factors
        mixed ^= mixed >> np.uint64(29)
        return (mixed * self._factors[::-1]).sum(axis=2, dtype=np.uint64).view(np.int64)


def _matrix(vectors) -> np.ndarray:
    return np.stack(vectors).astype(np.float64)


def _hashed(projections: int, tables: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    drawn = _Tables(projections, tables)
    for batch in batches:
        vectors, out = batch["vector"].to_numpy(), np.zeros((len(batch), tables), np.int64)
        widths = np.array([len(v) for v in vectors], np.int64)
        for width in np.unique(widths).tolist():
            rows = np.flatnonzero(widths == width)
            for i in range(0, len(rows), BLOCK):
                out[rows[i : i + BLOCK]] = drawn.keys(_matrix(vectors[rows[i : i + BLOCK]]))
        yield pd.DataFrame({"point": batch["point"], "keys": list(out)})


def _near(a: np.ndarray, b: np.ndarray, cosine: float) -> np.ndarray:
    """Which rows of ``a`` and ``b`` have at least this cosine; close calls are summed exactly."""
    found = _unit(a) @ _unit(b).T
    near = found >= cosine
    for i, j in np.argwhere(np.abs(found - cosine) < 1e-9).tolist():
        p, q = np.ldexp(a[i], -math.frexp(np.abs(a[i]).max())[1]), np.ldexp(b[j], -math.frexp(np.abs(b[j]).max())[1])
        near[i, j] = math.fsum(p * q) / math.sqrt(math.fsum(p * p) * math.fsum(q * q)) >= cosine
    return near


def _compared(drawn: _Tables, cosine: float, table: int, points, vectors, copies, side):
    """Links within one block of a bucket: points, links of each, and the least point that each is joined to.

    A pair counts in the first table where it shares a bucket and in no later one.  Pairs never leave the block.
    """
    two = side.any()
    left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if two else (np.arange(len(side)),) * 2
    if len(side) < 2 or not len(left):
        return None
    vectors = _matrix(vectors)
    near = _near(vectors[left], vectors[right], cosine)
    if not two:
        np.fill_diagonal(near, False)
    if not near.any():
        return None
    joined, keys = near.copy(), drawn.keys(vectors) if table else None
    for t in range(table):
        near &= keys[left, t][:, None] != keys[right, t][None, :]
        if not near.any():
            return None
    links = np.zeros(len(side), np.int64)
    links[left] += near @ copies[right]
    if two:
        links[right] += near.T @ copies[left]
    # The least point of each component of the block: the least one seen is passed along links until nothing changes.
    root, most = points.copy(), np.iinfo(np.int64).max
    while True:
        before = root.copy()
        root[left] = np.minimum(root[left], np.where(joined, root[right][None, :], most).min(axis=1))
        root[right] = np.minimum(root[right], np.where(joined, root[left][:, None], most).min(axis=0))
        if (root == before).all():
            break
    some = (links > 0) | (root != points)
    return points[some], links[some], root[some]


def _blocks(projections: int, tables: int, cosine: float, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come in order of their block, which may end in a later batch; a block has two sides of about BLOCK rows."""
    drawn, held = _Tables(projections, tables), None
    names = ["bucket", "low", "high", "table", "kind"]

    def searched(batch: pd.DataFrame, cuts: list[int]) -> Iterator[pd.DataFrame]:
        table, points, vectors, copies, side = (batch[c].to_numpy() for c in ("table", "point", "vector", "copies", "side"))
        found = [
            _compared(drawn, cosine, int(table[a]), points[a:b], vectors[a:b], copies[a:b], side[a:b])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True)
            # A block of two slices, one of which is empty, holds nothing to compare.
            if b - a > 1 and (side[a:b].any() or batch["low"].iat[a] == batch["high"].iat[a])
        ]
        found = [f for f in found if f is not None]
        if found:
            yield pd.DataFrame(dict(zip(("point", "links", "root"), map(np.concatenate, zip(*found, strict=True)), strict=True)))

    for batch in batches:
        batch = batch if held is None else pd.concat([held, batch], ignore_index=True)
        change = np.zeros(max(len(batch) - 1, 0), bool)
        for name in names:
            column = batch[name].to_numpy()
            change |= column[1:] != column[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist()]
        yield from searched(batch, cuts)
        held = batch.iloc[cuts[-1] :]
    if held is not None:
        yield from searched(held.reset_index(drop=True), [0, len(held)])


def _usable(vector: Column) -> Column:
    """Not null or empty, every component present and finite, and not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_vectors(
    rows: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    cosine: float = COSINE,
    recall: float = RECALL,
) -> DataFrame:
    """One row per row of ``rows``: key, ``n_links``, ``component_id``, ``kept``.

    Rows of one label (not null) and one width are linked where their cosine in double precision is at least ``cosine``.
    ``n_links`` counts the rows linked with a row, ``component_id`` is the least key that links reach (null only where all
    keys of a component are null), and ``kept`` holds where both keys are the same, null included.  A vector that is null,
    empty, zero or holds null or non-finite components links with nothing, not even its copy, and is its own component.
    Repeated rows are linked with each other.  Pairs just near enough are found with a chance of ``recall``.

    Copies are one point from the start, which counts once a copy.  A bucket that is larger than BLOCK is compared in
    blocks of two slices, and no pair of it is left out; tasks return a count and a root for each point, never pairs.
    Comparing still grows with the square of the *different* vectors that share a bucket, as each of those pairs is counted.
    """
    values = F.col(vector)
    kind = F.col(label).cast("string")
    usable = kind.isNotNull() & _usable(values.cast("array<double>"))
    named = rows.select(F.col(key).alias("_key"), F.when(usable, kind).alias("_kind"), F.when(usable, values).alias("_vector"))
    grouped = named.where("_kind IS NOT NULL").groupBy("_kind", "_vector").agg(F.count(F.lit(1)).alias("copies"), F.min("_key").alias("least"))
    # The numbers are fixed once the table is written.
    points = durable(grouped.withColumn("point", F.monotonically_increasing_id()))
    most = points.groupBy("_kind", F.size("_vector")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    projections, tables = table_sizes(most or 1, cosine, recall)

    doubled = points.select("point", F.col("_vector").cast("array<double>").alias("vector"))
    hashed = doubled.mapInPandas(lambda it: _hashed(projections, tables, it), "point long, keys array<long>")
    # Vectors of other labels or widths never meet: both are part of the bucket.
    own = points.select("point", F.xxhash64("_kind", F.size("_vector")).alias("kind"))
    hashed = durable(hashed.join(own, "point").select("point", "kind", F.posexplode("keys").alias("table", "key")))
    hashed = hashed.select("point", "table", F.xxhash64("kind", "table", "key").alias("bucket"))
    full = durable(hashed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    entry = F.struct("table", "bucket", F.ceil(F.col("n") / BLOCK).alias("slices"))
    entries = hashed.join(full, "bucket").groupBy("point").agg(F.collect_list(entry).alias("entries"))

    met = points.join(durable(entries), "point").select("point", "copies", F.col("_vector").cast("array<double>").alias("vector"), F.concat_ws(" ", F.size("_vector"), "_kind").alias("kind"), F.explode("entries").alias("e"))
    met = met.select("point", "copies", "vector", "kind", "e.table", "e.bucket", "e.slices", F.pmod(F.xxhash64("point"), F.col("e.slices")).alias("slice"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
    met = met.select(
        "bucket", F.least("slice", "other").alias("low"), F.greatest("slice", "other").alias("high"), "table", "kind",
        (F.col("slice") > F.col("other")).cast("int").alias("side"), "point", "copies", "vector",
    )
    block = ["bucket", "low", "high"]
    met = met.repartition(*block).sortWithinPartitions(*block, "table", "kind")
    found = durable(met.mapInPandas(lambda it: _blocks(projections, tables, cosine, it), "point long, links long, root long"))

    roots = durable(connected(found.select(F.col("point").alias("a"), F.col("root").alias("b")))).withColumnRenamed("node", "point")
    links = found.groupBy("point").agg(F.sum("links").alias("links"))
    rooted = points.join(links, "point", "left").join(roots, "point", "left").withColumn("root", F.coalesce("root", "point"))
    rooted = durable(rooted.select("root", "_kind", "_vector", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    least = durable(rooted.groupBy("root").agg(F.min("least").alias("component")))
    done = durable(rooted.join(least, "root").select("_kind", "_vector", "n_links", "component"))
    out = named.join(done, ["_kind", "_vector"], "left")
    component = F.when(F.col("n_links").isNull(), F.col("_key")).otherwise(F.col("component"))
    return out.select(
        F.col("_key").alias(key), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"),
        F.col("_key").eqNullSafe(component).alias("kept"),
    )
