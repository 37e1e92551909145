"""Exact one-dimensional Local Outlier Factor per group.

A row's factor depends on its value only, so factors are computed on distinct
values with their counts: a hot value is one line.  Distinct values are numbered
with sliced running totals and cut into blocks of ``BLOCK`` values; each block also
gets the ``3 k`` values on either side, which is all the score of its own values
can depend on.  A block is one small numpy computation, however large the group.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.frames import attach
from riskframe.operators.distributions import classify, value_counts
from riskframe.ordered import SLICE_ROWS, exact_quantiles, running_totals
from riskframe.session import durable

# Most neighbours, smallest group, contamination, variance gates.
MAX_NEIGHBOURS = 20
MIN_ROWS = 5
CONTAMINATION = 0.01
MEAN_GATE = 0.1
VARIATION_GATE = 0.5
BLOCK = 50_000


def _factors(x: np.ndarray, count: np.ndarray, k: int) -> np.ndarray:
    """LOF of sorted distinct values; correct for all but the outer ``3 k``.

    Ties in distance go to the lower value.
    """
    m = len(x)
    reachable = min(k, m - 1)
    offsets = np.array([o for o in range(-reachable, reachable + 1) if o != 0], dtype=int)
    at = np.arange(m)[:, None] + offsets[None, :]
    valid = (at >= 0) & (at < m)
    at = np.clip(at, 0, m - 1)
    distance = np.where(valid, np.abs(x[at] - x[:, None]), np.inf)
    weight = np.where(valid, count[at], 0)
    order = np.argsort(distance, axis=1, kind="stable")
    distance = np.take_along_axis(distance, order, 1)
    weight = np.take_along_axis(weight, order, 1)
    at = np.take_along_axis(at, order, 1)
    own = np.minimum(count - 1, k)
    before = own[:, None] + np.cumsum(weight, axis=1) - weight
    taken = np.clip(k - before, 0, weight)
    used = taken > 0
    k_distance = np.where(used, np.where(np.isfinite(distance), distance, 0.0), 0.0).max(axis=1, initial=0.0)
    reach = np.where(used, np.maximum(distance, k_distance[at]), 0.0)
    mean_reach = ((taken * reach).sum(axis=1) + own * k_distance) / k
    density = 1.0 / (mean_reach + 1e-10)
    neighbours = ((taken * density[at]).sum(axis=1) + own * density) / k
    return neighbours / density


def local_outlier_factors(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    slice_rows: int = SLICE_ROWS,
    block: int = BLOCK,
) -> DataFrame:
    """Columns ``keys``, ``_x``, ``_c`` (rows with that value) and ``lof``.

    Groups with fewer than five rows are left out.
    """
    keys = list(keys)
    counts = value_counts(df, keys, value)
    sizes = counts.groupBy(*keys).agg(F.sum("_c").alias("_n")).where(F.col("_n") >= MIN_ROWS)
    numbered = running_totals(
        counts.withColumn("_one", F.lit(1)), keys, "_x", {"_place": "_one"}, slice_rows=slice_rows
    )
    k = F.least(F.lit(MAX_NEIGHBOURS), F.greatest(F.lit(2), F.floor(F.col("_n") / 2)))
    place = F.col("_place") - 1
    halo = 3 * MAX_NEIGHBOURS
    blocks = F.sequence(F.floor(F.greatest(F.lit(0), place - halo) / block), F.floor((place + halo) / block))
    spread = numbered.join(sizes, keys).select(
        *keys, "_x", "_c", k.cast("int").alias("_k"), F.floor(place / block).alias("_home"), F.explode(blocks).alias("_block")
    )
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([f"`{c}` {fields[c]}" for c in keys] + ["_x double", "_c bigint", "lof double"])

    def score(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_x", ignore_index=True)
        home = (rows["_home"] == rows["_block"]).to_numpy()
        if not home.any():
            return rows.loc[home, [*keys, "_x", "_c"]].assign(lof=0.0)
        lof = _factors(rows["_x"].to_numpy(), rows["_c"].to_numpy(), int(rows["_k"].iloc[0]))
        return rows.loc[home, [*keys, "_x", "_c"]].assign(lof=lof[home])

    return spread.groupBy(*keys, "_block").applyInPandas(score, schema)


def gated_groups(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Groups whose spread warrants a score: classed Normal (all other classes are
    centred by standardising and so never pass), with a mean of at least a tenth of
    the deviation and a coefficient of variation above one half."""
    shapes = classify(df, keys, value)
    passes = (
        (F.col("distribution") == "Normal")
        & (F.abs("mean") >= MEAN_GATE * F.col("std"))
        & (F.col("std") / F.col("mean") > VARIATION_GATE)
    )
    return shapes.where(passes).select(*keys)


def with_lof(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    output: str = "lof",
    confidence: bool = True,
    gate: bool = True,
    slice_rows: int = SLICE_ROWS,
    block: int = BLOCK,
) -> DataFrame:
    """Add the scaled factor 0..1 (or a 0/1 flag for the top 1 %) to every row.

    A missing value stands at the group's mean.  Small groups, groups that fail
    the gate and groups with one value only get 0.
    """
    keys = list(keys)
    if not keys:
        out = with_lof(
            df.withColumn("_all", F.lit(0)), ["_all"], value, output, confidence, gate, slice_rows, block
        )
        return out.drop("_all")
    filled = attach(df, keys, _mean=F.avg(F.col(value).cast("double")))
    filled = filled.withColumn("_x", F.coalesce(F.col(value).cast("double"), F.col("_mean")))
    scored = filled
    if gate:
        # The gate looks at the present values only; the fill sits at their mean.
        scored = filled.join(durable(gated_groups(df, keys, value)), keys, "left_semi")
    # Read twice below (range or cut-off, then the rows): written out once.
    factors = durable(local_outlier_factors(scored.select(*keys, "_x"), keys, "_x", slice_rows, block))
    if confidence:
        ranged = attach(factors, keys, _lo=F.min("lof"), _hi=F.max("lof"))
        span = F.col("_hi") - F.col("_lo")
        result = F.when(span > 0, (F.col("lof") - F.col("_lo")) / span).otherwise(0.0)
    else:
        rows = scored.select(*keys, "_x").join(factors, [*keys, "_x"])
        cut = exact_quantiles(rows, keys, "lof", {"_cut": 1 - CONTAMINATION})
        ranged = factors.join(cut, keys)
        result = (F.col("lof") > F.col("_cut")).cast("double")
    scores = ranged.select(*keys, "_x", result.alias("_score"))
    joined = filled.join(scores, [*keys, "_x"], "left")
    return joined.select(*df.columns, F.coalesce("_score", F.lit(0.0)).alias(output))
