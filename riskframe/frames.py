"""Group statistics that stay safe when one group holds most of the rows.

``Window.partitionBy(group)`` sends a whole group to one task.  Everything here
aggregates first (map-side combined, one row per group leaves each task) and
joins the small result back, so a hot group is spread over all tasks.  The group
table is written first: adaptive execution then knows its size before it chooses
a broadcast, and can split skewed partitions of a sort-merge join, which it never
does while an aggregation stands between the shuffle and the join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.session import durable


def attach(df: DataFrame, keys: Sequence[str], **aggs: Column) -> DataFrame:
    """Add one column per aggregate, computed over each key's whole group.

    Rows whose key holds a null get null statistics.  Without keys the statistics
    are those of the whole table, read through one scalar subquery.
    """
    named = [expr.alias(name) for name, expr in aggs.items()]
    if not keys:
        return with_scalars(df, df.agg(*named))
    groups = durable(df.groupBy(*keys).agg(*named))
    return df.join(groups, list(keys), "left").select(*df.columns, *aggs)


def with_scalars(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Add the columns of a one-row frame to every row, by scalar subquery."""
    row = stats.select(F.struct(*stats.columns).alias("s")).scalar()
    out = df.withColumn("_scalars", row)
    return out.select(*df.columns, *[F.col("_scalars")[n].alias(n) for n in stats.columns])


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1) -> DataFrame:
    """The first ``k`` rows of each key in the given order.

    The filter on ``row_number`` lets Catalyst cut each map task to ``k`` rows per
    key before the shuffle, so a hot key never reaches one task whole.
    """
    if not keys:
        return df.orderBy(*order).limit(k)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def truthy(col: Column | str) -> Column:
    """True for 'true' in any case, boolean true or 1; false for all else, null included."""
    text = F.lower(F.trim((F.col(col) if isinstance(col, str) else col).cast("string")))
    return F.coalesce(text.isin("true", "1", "1.0"), F.lit(False))


def unpivot(df: DataFrame, ids: Sequence[str], names: Sequence[str], label: str, value: str) -> DataFrame:
    return df.unpivot([F.col(i) for i in ids], [F.col(f"`{n}`") for n in names], label, value)
