"""Entity-level features: counts, duplicates, date differences, score cut-offs."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.frames import attach
from riskframe.session import durable

YEARS_BACK = 25


def above(score: Column | str, cut: float) -> Column:
    """Keep a score only above a cut; every row stays, lower scores become 0."""
    s = F.col(score) if isinstance(score, str) else score
    return F.when(s > cut, s).otherwise(0.0)


def with_entity_count(df: DataFrame, keys: Sequence[str], output: str) -> DataFrame:
    """Transactions of each row's entity."""
    return attach(df, keys, **{output: F.count(F.lit(1))})


def clamp_date(date: Column | str, as_of: str) -> Column:
    """A date no earlier than 25 years before ``as_of`` and no later than the day after."""
    today = F.to_date(F.lit(as_of))
    earliest = F.add_months(today, -12 * YEARS_BACK)
    latest = F.date_add(today, 1)
    d = (F.col(date) if isinstance(date, str) else date).cast("date")
    return F.when(d.isNotNull(), F.greatest(earliest, F.least(latest, d)))


def day_difference(later: Column | str, earlier: Column | str, as_of: str) -> Column:
    return F.date_diff(clamp_date(later, as_of), clamp_date(earlier, as_of))


def pairwise_day_differences(df: DataFrame, dates: Sequence[str], as_of: str) -> DataFrame:
    """``<a>_<b>_diff`` for every pair of date columns, in one projection."""
    diffs = [day_difference(a, b, as_of).alias(f"{a}_{b}_diff") for a, b in combinations(dates, 2)]
    return df.select(*df.columns, *diffs)


def with_duplicate_counts(
    df: DataFrame, entity: str, amount: str, date: str, duplicates: str, recurring: str, recurring_amount: str
) -> DataFrame:
    """Copies of (entity, amount, date), recurrences of (entity, amount) and their sum.

    One aggregation counts both levels.  Only groups of two rows or more are written
    and looked up: a row without such a group is its own group, so the written table
    has at most half as many groups as there are rows, and hardly any where nearly
    every row is alone.  A null in a key leaves that level's results null.
    """
    pair, triple = [entity, amount], [entity, amount, date]
    level = F.grouping_id().alias("_level")
    counted = df.groupingSets([[F.col(c) for c in triple], [F.col(c) for c in pair]], *[F.col(c) for c in triple])
    groups = counted.agg(level, F.count(F.lit(1)).alias("_n"), F.sum(amount).alias("_sum")).where(F.col("_n") > 1)
    groups = durable(groups.dropna(subset=pair))
    days = groups.where((F.col("_level") == 0) & F.col(date).isNotNull()).select(*triple, F.col("_n").alias(duplicates))
    pairs = groups.where(F.col("_level") == 1).select(*pair, F.col("_n").alias(recurring), F.col("_sum").alias(recurring_amount))
    known = F.col(entity).isNotNull() & F.col(amount).isNotNull()
    alone = F.col(amount).cast(pairs.schema[recurring_amount].dataType)
    joined = df.join(days, triple, "left").join(pairs, pair, "left")
    return joined.select(
        *df.columns,
        F.when(known & F.col(date).isNotNull(), F.coalesce(duplicates, F.lit(1))).alias(duplicates),
        F.when(known, F.coalesce(recurring, F.lit(1))).alias(recurring),
        F.when(known, F.coalesce(recurring_amount, alone)).alias(recurring_amount),
    )
