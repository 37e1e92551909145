"""Exact order statistics and running totals without single-task groups.

Built-in ``percentile`` gathers every distinct value of a group in one task, and
an ordered window does the same with its rows.  Both fail once one group holds a
large part of the table.  Here:

* ``exact_quantiles`` brackets each quantile with a mergeable sketch (one pass,
  map-side combined), then counts exactly and shuffles only the values inside the
  brackets, about ``6 / accuracy`` of the group per quantile.
* ``running_totals`` cuts every large group into value slices.  The cut points
  are the values whose hash is 0 modulo ``slice_rows``: about one in
  ``slice_rows``, the same on every evaluation, and found in the same pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.frames import with_scalars
from riskframe.session import durable

SKETCH_ACCURACY = 10_000
# Groups up to this size are ranked whole: no sketch bracket is needed.
WHOLE_GROUP_ROWS = 20_000
SLICE_ROWS = 4_000_000


def _numbers(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    x = F.col(value).cast("double")
    present = [F.col(k).isNotNull() for k in keys]
    out = df.select(*keys, x.alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    for p in present:
        out = out.where(p)
    return out


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    quantiles: dict[str, float],
    accuracy: int = SKETCH_ACCURACY,
    whole_group_rows: int = WHOLE_GROUP_ROWS,
) -> DataFrame:
    """Linear-interpolated quantiles per key: columns ``keys`` + one per name.

    Nulls and NaN are ignored; keys with a null are left out.
    """
    keys = list(keys)
    base = _numbers(df, keys, value)
    if not keys:
        keys = ["_all"]
        base = base.select(F.lit(0).alias("_all"), "_x")
    slack = 3.0 / accuracy
    probs = list(quantiles.values())
    ends = [max(0.0, p - slack) for p in probs] + [min(1.0, p + slack) for p in probs]
    sketch = base.groupBy(*keys).agg(
        F.count("_x").alias("_n"),
        F.min("_x").alias("_min"),
        F.max("_x").alias("_max"),
        F.percentile_approx("_x", ends, accuracy).alias("_ends"),
    )
    small = F.col("_n") <= whole_group_rows
    lows = [F.when(small, F.col("_min")).otherwise(F.col("_ends")[i]) for i in range(len(probs))]
    highs = [
        F.when(small, F.col("_max")).otherwise(F.col("_ends")[len(probs) + i]) for i in range(len(probs))
    ]
    brackets = sketch.select(*keys, "_n", F.array(*lows).alias("_lo"), F.array(*highs).alias("_hi"))
    x = F.col("_x")
    inside = F.lit(False)
    for i in range(len(probs)):
        inside = inside | x.between(F.col("_lo")[i], F.col("_hi")[i])
    # A value outside every bracket is folded onto the lower end of the next one:
    # only its count matters.
    next_low = F.lit(None).cast("double")
    for i in sorted(range(len(probs)), key=lambda j: -probs[j]):
        next_low = F.when(F.col("_lo")[i] > x, F.col("_lo")[i]).otherwise(next_low)
    # One row without keys: a scalar, not a join.  Else written first, so that a hot key's partition can be split.
    bracketed = with_scalars(base, brackets.drop("_all")) if keys == ["_all"] else base.join(durable(brackets), keys)
    counted = (
        bracketed
        .select(*keys, "_n", inside.alias("_exact"), F.when(inside, x).otherwise(next_low).alias("_v"))
        .groupBy(*keys, "_exact", "_v")
        .agg(F.count(F.lit(1)).alias("_c"), F.max("_n").alias("_n"))
    )
    return _pick_ranks(counted, keys, quantiles)


def quantiles_of_counts(
    counts: DataFrame, keys: Sequence[str], value: str, count: str, quantiles: dict[str, float]
) -> DataFrame:
    """Exact quantiles of values that were counted already.

    For values known to take few levels per key (rounded or binned ones).
    """
    keys = list(keys)
    levels = counts.select(
        *keys, F.col(value).alias("_v"), F.col(count).alias("_c"), F.lit(True).alias("_exact")
    ).where(F.col("_v").isNotNull())
    if not keys:
        keys, levels = ["_all"], levels.withColumn("_all", F.lit(0))
    sizes = levels.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    return _pick_ranks(levels.join(sizes, keys), keys, quantiles)


def _pick_ranks(counted: DataFrame, keys: list[str], quantiles: dict[str, float]) -> DataFrame:
    """Quantiles from rows (keys, _v, _c, _n, _exact) whose counts cover each whole group."""
    upto = Window.partitionBy(*keys).orderBy(F.asc_nulls_last("_v"), "_exact")
    ranked = counted.withColumn("_end", F.sum("_c").over(upto.rowsBetween(Window.unboundedPreceding, 0)))
    start = F.col("_end") - F.col("_c")
    picks: list[Column] = []
    for name, p in quantiles.items():
        low = F.floor(F.lit(p) * (F.col("_n") - 1))
        for tag, at in (("a", low), ("b", F.least(low + 1, F.col("_n") - 1))):
            hit = (start <= at) & (at < F.col("_end"))
            found = F.when(F.col("_exact"), F.col("_v")).otherwise(
                F.raise_error(F.lit("quantile fell outside its sketch bracket")).cast("double")
            )
            picks.append(F.max(F.when(hit, found)).alias(f"_{tag}_{name}"))
    found = ranked.groupBy(*keys).agg(F.max("_n").alias("_n"), *picks)
    out = []
    for name, p in quantiles.items():
        spot = F.lit(p) * (F.col("_n") - 1)
        a, b = F.col(f"_a_{name}"), F.col(f"_b_{name}")
        out.append((a + (b - a) * (spot - F.floor(spot))).alias(name))
    return found.select(*[k for k in keys if k != "_all"], *out)


def attach_quantiles(df: DataFrame, keys: Sequence[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    found = exact_quantiles(df, keys, value, quantiles)
    if not keys:
        return with_scalars(df, found)
    return df.join(durable(found), list(keys), "left").select(*df.columns, *quantiles)


def _slice_of(cuts: Column, value: Column, steps: Sequence[int]) -> Column:
    """How many sorted cut points are <= value, by binary search."""

    def step(found: Column, width: Column) -> Column:
        probe = found + width
        return F.when(
            (probe <= F.size(cuts)) & (F.get(cuts, probe - 1) <= value), probe
        ).otherwise(found)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step)


def with_slices(df: DataFrame, keys: Sequence[str], order: str, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Add ``_slice``: an order-preserving piece number inside each key.

    ``order`` must be one column with (nearly) unique values per key.  About one
    value in ``slice_rows`` becomes a cut point, so the cut table holds
    rows / slice_rows numbers in all and no slice grows with its group.
    """
    picked = df.where(F.pmod(F.xxhash64(F.col(order)), F.lit(slice_rows)) == 0)
    cuts = picked.groupBy(*keys).agg(F.sort_array(F.collect_set(order)).alias("_cuts"))
    widths = [1 << b for b in range(30, -1, -1)]
    where = F.when(
        F.col("_cuts").isNull() | F.col(order).isNull(), F.lit(0)
    ).otherwise(_slice_of(F.col("_cuts"), F.col(order), widths))
    cut = with_scalars(df, cuts.drop("_all")) if list(keys) == ["_all"] else df.join(durable(cuts), list(keys), "left")
    return cut.select(*df.columns, where.alias("_slice"))


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    totals: dict[str, str],
    descending: bool = False,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Inclusive running sums over ``order`` inside each key.

    ``totals`` maps output name to the column summed.  ``df`` must have one row
    per (keys, order): aggregate first, which also removes hot duplicate values.
    """
    keys = list(keys)
    columns = list(df.columns)
    if not keys:
        df, keys = df.withColumn("_all", F.lit(0)), ["_all"]
    sliced = with_slices(df, keys, order, slice_rows)
    by_value = F.desc(order) if descending else F.asc(order)
    by_slice = F.desc("_slice") if descending else F.asc("_slice")
    inside = Window.partitionBy(*keys, "_slice").orderBy(by_value).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(by_slice).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sliced.groupBy(*keys, "_slice").agg(
        *[F.sum(src).alias(f"_sum_{out}") for out, src in totals.items()]
    )
    offsets = offsets.select(
        *keys,
        "_slice",
        *[F.coalesce(F.sum(f"_sum_{out}").over(before), F.lit(0)).alias(f"_before_{out}") for out in totals],
    )
    inner = sliced.select(
        *columns,
        *[k for k in keys if k not in columns],
        "_slice",
        *[F.sum(src).over(inside).alias(f"_in_{out}") for out, src in totals.items()],
    )
    return inner.join(offsets, [*keys, "_slice"]).select(
        *columns,
        *[(F.col(f"_in_{out}") + F.col(f"_before_{out}")).alias(out) for out in totals],
    )
