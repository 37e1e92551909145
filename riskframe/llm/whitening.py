"""Whitening of embeddings: pivoted Cholesky of the centred scatter, one-sided Jacobi on its triangular factor.

The scatter is summed on Spark.  Only a square of one vector's width reaches the driver: that of the model.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.session import durable

COMPONENTS = 4
#: Steps of the whole numbers that entries become.
STEPS = 256
#: A pivot below this share of the first one is rounding: the rank ends there.
RANK = 1e-13
#: Rows of one product.
ROWS = 4096


class Whitening(NamedTuple):
    """Mean and components of the vectors of one width, all plain data."""

    n: int
    sums: list[int]
    values: list[float]  # the leading eigenvalues of the covariance, none where the rank ends
    vectors: list[list[float]]  # one unit vector for each
    trace: float


def pivoted_cholesky(scatter: np.ndarray) -> np.ndarray:
    """``L`` with ``L @ L.T == scatter``, one column for each rank; rows are in the order of the scatter.

    The largest diagonal that is left comes next, so the factor is triangular in the order of pivots and its columns
    fall, which is what lets the rotations after it keep small eigenvalues right.
    """
    left, factor = scatter.astype(np.float64).copy(), []
    first = max(left.diagonal().max(initial=0.0), 0.0)
    for _ in range(len(left)):
        pivot = int(np.argmax(left.diagonal()))
        if not left[pivot, pivot] > RANK * first:
            break
        column = left[:, pivot] / np.sqrt(left[pivot, pivot])
        factor.append(column)
        left -= np.outer(column, column)
        left[pivot], left[:, pivot] = 0.0, 0.0
    return np.array(factor).T if factor else np.zeros((len(left), 0))


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """The factor with its columns rotated until they are at right angles; its product with its transpose stays.

    Every round rotates disjoint pairs of columns, all at once, and rounds pair every column with every other.
    """
    rotated = factor.astype(np.float64).copy()
    count = rotated.shape[1]
    if count < 2:
        return rotated
    seats = np.arange(count + count % 2)
    for _ in range(sweeps):
        largest = 0.0
        for _ in range(len(seats) - 1):
            half = len(seats) // 2
            p, q = seats[:half], seats[half:][::-1]
            real = (p < count) & (q < count)
            p, q = p[real], q[real]
            x, y = rotated[:, p], rotated[:, q]
            a, b, c = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            scale = np.sqrt(a * b)
            turn = np.abs(c) > 1e-16 * scale
            largest = max(largest, float((np.abs(c[turn]) / scale[turn]).max(initial=0.0)))
            zeta = (b - a)[turn] / (2 * c[turn])
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            cos = 1 / np.hypot(1.0, t)
            sin = cos * t
            rotated[:, p[turn]], rotated[:, q[turn]] = cos * x[:, turn] - sin * y[:, turn], sin * x[:, turn] + cos * y[:, turn]
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
        if largest < 1e-15:
            break
    return rotated


def principal(scatter: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of ``scatter / n``, falling, and unit eigenvectors as rows, as many as the rank."""
    rotated = one_sided_jacobi(pivoted_cholesky(scatter))
    squares = (rotated * rotated).sum(0)
    order = np.argsort(-squares, kind="stable")
    return squares[order] / n, (rotated[:, order] / np.sqrt(squares[order])).T


# On Spark ---------------------------------------------------------------------------------------------------------------


def _whole(vector: Column) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * STEPS))


def _complete(vector: Column) -> Column:
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return F.coalesce(~bad, F.lit(False))


def _by_width(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and the matrix of whole numbers, for each width that occurs, in pieces of bounded size."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    widths = np.diff(offsets)
    for width in np.unique(widths):
        rows = np.flatnonzero(widths == width)
        for i in range(0, len(rows), ROWS):
            part = rows[i : i + ROWS]
            yield part, flat[offsets[part][:, None] + np.arange(width)[None, :]].astype(np.int64)


def _large(n: int, x: np.ndarray, sums: list[int]) -> np.ndarray:
    """``n * x - sums`` without overflow: longs where they hold it, Python's whole numbers else."""
    most = max(-int(x.min()), int(x.max())) if x.size else 0
    if n * most + max(map(abs, sums), default=0) < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _centred(model_n: int, sums: list[int], x: np.ndarray) -> np.ndarray:
    return _large(model_n, x, sums).astype(np.float64) / model_n


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's rows and sums of each entry, for each width; sums are exact."""
    sums, counts = {}, {}
    for batch in batches:
        for _, x in _by_width(batch.column(0)):
            width = x.shape[1]
            exact = x.sum(axis=0) if x.size == 0 or max(-int(x.min()), int(x.max())) < 1 << 50 else x.astype(object).sum(axis=0)
            counts[width] = counts.get(width, 0) + len(x)
            sums[width] = [a + int(b) for a, b in zip(sums.get(width, [0] * width), exact, strict=True)]
    rows = [(w, -1, Decimal(n)) for w, n in counts.items()] + [(w, i, Decimal(s)) for w, own in sums.items() for i, s in enumerate(own)]
    if rows:
        width, place, value = zip(*rows, strict=True)
        columns = [pa.array(width, pa.int32()), pa.array(place, pa.int32()), pa.array(value, pa.decimal128(38, 0))]
        yield pa.RecordBatch.from_arrays(columns, ["width", "place", "value"])


def _products(project, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's sums of products of projected rows, one row of the square a record."""
    squares = {}
    for batch in batches:
        for _, x in _by_width(batch.column(0)):
            rows = project(x)
            if rows.shape[1]:
                squares[x.shape[1]] = squares.get(x.shape[1], 0.0) + rows.T @ rows
    for width, square in squares.items():
        columns = [pa.array([width] * len(square), pa.int32()), pa.array(range(len(square)), pa.int32()), pa.array(list(square), pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(columns, ["width", "place", "row"])


def _added(frame):
    """The sum of one row of the square over tasks, in a fixed order."""
    rows = np.stack(frame["row"].to_numpy())
    rows = rows[np.lexsort(rows.T[::-1])]
    return frame.iloc[:1].assign(row=[rows.sum(axis=0)])


def _squares(x: DataFrame, project) -> dict[int, np.ndarray]:
    parts = durable(x.mapInArrow(lambda it: _products(project, it), "width int, place int, row array<double>"))
    rows = parts.groupBy("width", "place").applyInPandas(_added, parts.schema).collect()
    out = {r.width: np.zeros((len(r.row), len(r.row))) for r in rows}
    for r in rows:
        out[r.width][r.place] = r.row
    return out


def fit_whitening(x: DataFrame, components: int = COMPONENTS) -> tuple[dict[int, Whitening], dict[int, float]]:
    """Models by width, from distinct vectors of whole numbers in one column, and how far from one the covariance of what
    they whiten is at most.

    Two passes: counts and sums, exact; then products of centred rows.  A task sends a square of one vector's width (the
    model's own size), and the square is added up row by row, each in a task of its own.
    """
    totals = x.mapInArrow(_summed, "width int, place int, value decimal(38,0)").groupBy("width", "place").agg(F.sum("value").alias("value"))
    counts, sums = {}, {}
    for r in totals.orderBy("width", "place").collect():
        if r.place < 0:
            counts[r.width] = int(r.value)
        else:
            sums.setdefault(r.width, []).append(int(r.value))
    means = {w: (n, sums.get(w, [])) for w, n in counts.items()}
    scatter = _squares(x, lambda part: _centred(*means[part.shape[1]], part))
    models = {}
    for width, (n, own) in means.items():
        square = scatter.get(width, np.zeros((width, width)))
        values, vectors = principal((square + square.T) / 2, n)
        trace = float(square.trace() / n)
        models[width] = Whitening(n, own, values[:components].tolist(), vectors[:components].tolist(), trace)
    covariance = _squares(x, lambda part: whitened(models[part.shape[1]], part))
    error = {w: float(np.abs(c / means[w][0] - np.eye(len(c))).max()) for w, c in covariance.items()}
    return models, error


def whitened(model: Whitening, x: np.ndarray) -> np.ndarray:
    """Coordinates of rows of whole numbers on the components, each of variance one over the rows of the fit."""
    if not model.values:
        return np.zeros((len(x), 0))
    return _centred(model.n, model.sums, x) @ np.array(model.vectors).T / np.sqrt(model.values)


def _deviation(model: Whitening, x: np.ndarray) -> list[int | None]:
    """Sums of squares of ``n * x - S``, exact; null where a long cannot hold one."""
    apart = _large(model.n, x, model.sums)
    if apart.dtype != object and len(model.sums) * float(np.abs(apart).max(initial=0)) ** 2 < 2**62:
        return (apart * apart).sum(axis=1).tolist()
    exact = [sum(int(v) ** 2 for v in row) for row in apart]
    return [v if v < 1 << 63 else None for v in exact]


def _applied(models, errors, components: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
    for batch in batches:
        for rows, x in _by_width(batch.column(1)):
            width = x.shape[1]
            model, many = Whitening(*models[width]), min(components, width)
            if not many:
                continue
            coordinates, blank = whitened(model, x), [None] * len(rows)
            deviation, rank = _deviation(model, x), len(model.values)
            keys = batch.column(0).take(pa.array(rows))
            for c in range(many):
                own = coordinates[:, c] if c < rank else blank
                share = model.values[c] / model.trace if c < rank else 0.0
                columns = [
                    keys, pa.array([c + 1] * len(rows), pa.int32()), pa.array([model.n] * len(rows), pa.int64()), pa.array(deviation, pa.int64()),
                    pa.array(own, pa.float64()), pa.array([share] * len(rows), pa.float64()), pa.array([errors.get(width)] * len(rows), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["_key", *schema])


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component up to ``components``: key, ``component`` (from 1, by falling eigenvalue),
    ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    Entries become ``x = floor(256 * c)`` (longs, which end where longs end).  The fit sees each distinct ``x`` once: ``n``
    vectors with sums S.  ``deviation`` is the exact sum of ``(n x - S)^2``, null beyond a long.  ``whitened`` is ``x - S / n``
    on the component over the root of its eigenvalue, ``explained`` the eigenvalue's share of the trace, ``identity_error``
    how far the covariance of ``whitened`` over the fit is from the identity at most.

    Vectors that are null or hold null or non-finite entries are left out; vectors of each width are fitted among
    themselves, and an empty one has no component and no row.  A component beyond the rank (fewer different vectors than
    components, equal entries) has a null ``whitened`` and explains nothing; where nothing varies ``identity_error`` is null
    too.  Repeated rows and null keys are returned like any other; other columns of ``rows`` are not looked at.
    """
    values = F.col(vector)
    own = rows.where(_complete(values)).select(F.col(key).alias("_key"), _whole(values).alias("_x"))
    fit = durable(own.select("_x").distinct())
    models, errors = fit_whitening(fit, components)
    plain = {w: tuple(m) for w, m in models.items()}
    shared = rows.sparkSession.sparkContext.broadcast((plain, errors))
    kind = own.schema["_key"].dataType.simpleString()
    schema = f"_key {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return own.mapInArrow(lambda it: _applied(*shared.value, components, it), schema).withColumnRenamed("_key", key)
