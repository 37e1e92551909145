"""Line items to entities: keys, signed amounts, group totals, de-duplication."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import get_origin, get_type_hints

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from riskframe.frames import attach, top_per_key

# Accepted debit/credit codes.
CREDIT_CODES = ("H-Credit", "H")
DEBIT_CODES = ("S-Debit", "S")


def key_hash(*columns: str) -> Column:
    """A stable text key of several columns; null and empty text differ."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in columns]
    return F.md5(F.concat_ws("\u0001", *parts))


def net_amount(amount: str, indicator: str) -> Column:
    """Signed line amount: debit codes count as not above zero, all others raw."""
    value = F.coalesce(F.col(amount).cast("double"), F.lit(0.0))
    debit = F.coalesce(F.col(indicator).isin(*DEBIT_CODES), F.lit(False))
    return F.when(debit, -F.abs(value)).otherwise(value)


def _leveled(df: DataFrame, vendor: str, parts: Sequence[str], level: str, net: Column) -> DataFrame:
    return df.withColumns(
        {"vendor_level": F.col(vendor).cast("string"), level: key_hash(*parts), "net_amount": net}
    )


def entity_totals(
    df: DataFrame, vendor: str, parts: Sequence[str], amount: str, level: str, indicator: str | None = None
) -> DataFrame:
    """Every line with its vendor x entity total added (null vendor: null total).

    Signed levels report the absolute net total; without an indicator the plain sum.
    """
    net = net_amount(amount, indicator) if indicator else F.coalesce(F.col(amount).cast("double"), F.lit(0.0))
    lines = _leveled(df, vendor, parts, level, net)
    total = F.sum("net_amount")
    return attach(lines, ["vendor_level", level], **{f"Total_{amount}": F.abs(total) if indicator else total})


def entity_first_lines(
    df: DataFrame,
    vendor: str,
    parts: Sequence[str],
    amount: str,
    level: str,
    order: Sequence[str],
    indicator: str | None = None,
) -> DataFrame:
    """One line per vendor x entity (the first in ``order``) with the entity total.

    Total and first line come out of the same aggregation: one shuffle, one row
    per entity and map task.
    """
    net = net_amount(amount, indicator) if indicator else F.coalesce(F.col(amount).cast("double"), F.lit(0.0))
    lines = _leveled(df, vendor, parts, level, net)
    kept = [c for c in lines.columns if c not in ("vendor_level", level)]
    first = F.min(F.struct(F.struct(*order).alias("o"), F.struct(*kept).alias("v"))).alias("_first")
    total = F.sum("net_amount")
    grouped = lines.groupBy("vendor_level", level).agg(
        first, F.when(F.col("vendor_level").isNotNull(), F.abs(total) if indicator else total).alias("_total")
    )
    return grouped.select(
        "vendor_level", level, *[F.col("_first")["v"][c].alias(c) for c in kept], F.col("_total").alias(f"Total_{amount}")
    )


def invalid_indicators(df: DataFrame, indicator: str) -> DataFrame:
    """Codes outside the accepted ones with their counts, null included."""
    counts = df.groupBy(indicator).agg(F.count(F.lit(1)).alias("rows"))
    known = F.coalesce(F.col(indicator).isin(*CREDIT_CODES, *DEBIT_CODES), F.lit(False))
    return counts.where(~known)


def drop_duplicates_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Keep each key's first row in an explicit order."""
    return top_per_key(df, keys, order, 1)


# Aggregates a grouped transform knows by name.
NAMED_AGGREGATES: dict[str, Callable[[str], Column]] = {
    "sum": F.sum,
    "mean": F.avg,
    "min": F.min,
    "max": F.max,
    "count": F.count,
    "std": F.stddev_samp,
    "var": F.var_samp,
    "nunique": F.count_distinct,
}


def grouped_transform(
    df: DataFrame, groups: Sequence[str], column: str, output: str, function: str | Callable[[str], Column]
) -> DataFrame:
    """A group aggregate written back to every row of the group."""
    agg = NAMED_AGGREGATES[function] if isinstance(function, str) else function
    return attach(df, groups, **{output: agg(column)})


def grouped_apply(
    df: DataFrame, groups: Sequence[str], function: Callable, schema: str,
    partial: Callable | None = None, partial_schema: str | None = None,
) -> DataFrame:
    """A user function per group, at any size of a group.

    Three forms, by what the function needs to hold:

    * ``function(frame)`` gets the whole group at once; for groups known to be small.
    * ``function(frames)``, its first parameter annotated ``Iterator[pandas.DataFrame]``, gets the group in
      Arrow batches and yields frames: the group passes through one task, never whole.
    * With ``partial``, each task first turns the rows that it holds of a group into
      ``partial(frame)``, batch by batch; ``function`` then gets those few rows instead.
      For functions that merge: a hot group is reduced where its rows lie.

    Rows whose key holds a null form a group of their own, as in ``groupBy``.
    """
    keys = list(groups)
    if partial is not None:

        shape = to_arrow_schema(df.sparkSession.createDataFrame([], partial_schema).schema)

        def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                # Whole numbers beside nulls must not become floats: large keys would meet.
                exact = {c.type: pd.Int64Dtype() for c in batch.columns if pa.types.is_integer(c.type) and c.null_count}
                for _, rows in batch.to_pandas(types_mapper=exact.get).groupby(keys, dropna=False, sort=False):
                    yield from pa.Table.from_pandas(partial(rows), schema=shape, preserve_index=False).to_batches()

        df = df.mapInArrow(reduced, partial_schema)
    hints = list(get_type_hints(function).values())
    if hints and get_origin(hints[0]) is Iterator:

        def streamed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            return function(frames)

        return df.groupBy(*keys).applyInPandas(streamed, schema)
    return df.groupBy(*keys).applyInPandas(lambda frame: function(frame), schema)
