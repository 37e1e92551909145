"""Benford's law: digits, conformity, anomaly scores.

Only the digit histogram is grouped (at most ``10 ** digits`` rows per group), so
neither the groups' sizes nor a hot group matter; scores join back on
(group, digits).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import lru_cache
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from riskframe.session import durable

# Normal quantiles of the two score variants, smallest sample, and
# the least count and share a digit needs.
UPPER_Z = 2.3263
BINARY_Z = 2.57
MIN_SAMPLE = 50
MIN_DIGIT_COUNT = 5
MIN_DIGIT_SHARE = 0.01


def first_digits(value: Column | str, digits: int = 2) -> Column:
    """Leading digits of the integer part; numbers too short give their integer part."""
    x = F.abs((F.col(value) if isinstance(value, str) else value).cast("double"))
    text = F.floor(x).try_cast("decimal(38,0)").cast("string")
    leading = F.substring(text, 1, digits).cast("int")
    return F.coalesce(F.when(x < 10 ** (digits - 1), F.floor(x).cast("int")).otherwise(leading), F.lit(0))


def expected_share(digit: Column) -> Column:
    return F.log10(1 + 1 / digit)


def standard_error(share: Column, n: Column) -> Column:
    return F.sqrt(share * (1 - share) / n)


def _chi_square_tail(x: float, df: int) -> float:
    """P(chi-square with df degrees > x), by the incomplete gamma series."""
    a, z = df / 2, x / 2
    if z <= 0:
        return 1.0
    term = total = 1 / a
    k = a
    while term > total * 1e-15:
        k += 1
        term *= z / k
        total += term
    return 1 - total * math.exp(-z + a * math.log(z) - math.lgamma(a))


@lru_cache
def critical_values(alpha: float, up_to: int) -> tuple[float, ...]:
    """Chi-square critical values for 1..up_to degrees of freedom."""
    out = []
    for df in range(1, up_to + 1):
        low, high = 0.0, 10.0 * df + 100
        for _ in range(80):
            mid = (low + high) / 2
            low, high = (mid, high) if _chi_square_tail(mid, df) > alpha else (low, mid)
        out.append((low + high) / 2)
    return tuple(out)


def histogram(df: DataFrame, groups: Sequence[str], value: str, digits: int = 2) -> DataFrame:
    """Counts of leading digits of positive values, with each group's total ``n``."""
    x = F.col(value).cast("double")
    positive = df.where(x > 0).select(*groups, first_digits(x, digits).alias("digits"))
    counts = positive.groupBy(*groups, "digits").agg(F.count(F.lit(1)).alias("count"))
    return counts.withColumn("n", F.sum("count").over(_whole(groups)))


def _whole(groups: Sequence[str]):
    return Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))


def _in_range(digits: int) -> Column:
    return F.col("digits").between(10 ** (digits - 1), 10**digits - 1)


def conformity(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    digits: int = 2,
    alpha: float = 0.01,
    mode: str = "proportions",
) -> DataFrame:
    """Chi-square statistic of each group's digits and whether the law is rejected.

    ``proportions`` tests shares (it hardly ever rejects), ``counts`` raw counts.
    """
    tested = _with_conformity(histogram(df, groups, value, digits), groups, digits, alpha, mode)
    return tested.where(_in_range(digits)).select(*groups, "chi_square", "degrees_of_freedom", "rejected").distinct()


def _with_conformity(hist: DataFrame, groups: Sequence[str], digits: int, alpha: float, mode: str) -> DataFrame:
    """Add the group's test to each of its digit counts, all in the histogram's own
    partitioning: the data is read once."""
    whole, inside = _whole(groups), _in_range(digits)
    marked = hist.withColumn("_law", F.when(inside, expected_share(F.col("digits"))))
    sums = marked.withColumns(
        {"_total": F.sum(F.when(inside, F.col("count"))).over(whole), "_mass": F.sum("_law").over(whole), "_levels": F.count("_law").over(whole)}
    )
    observed, expected = F.col("count") / F.col("_total"), F.col("_law") / F.col("_mass")
    scale = F.col("_total") if mode == "counts" else F.lit(1.0)
    term = F.when(inside, scale * (observed - expected) ** 2 / expected)
    critical = F.array(*[F.lit(c) for c in critical_values(alpha, 10**digits)])
    out = sums.withColumn("_term", term).withColumns(
        {"chi_square": F.sum("_term").over(whole), "degrees_of_freedom": F.col("_levels") - 1}
    )
    limit = F.get(critical, F.col("degrees_of_freedom").cast("int") - 1)
    out = out.withColumn("rejected", F.coalesce(F.col("chi_square") > limit, F.lit(False)))
    return out.drop("_law", "_total", "_mass", "_levels", "_term")


def digit_scores(
    df: DataFrame, groups: Sequence[str], value: str, digits: int = 2, mode: str = "proportions"
) -> DataFrame:
    """Anomaly score 0..1 of each digit of each group."""
    tested = _with_conformity(histogram(df, groups, value, digits), groups, digits, 0.01, mode)
    share = F.col("count") / F.col("n")
    b = F.when(_in_range(digits), expected_share(F.col("digits"))).otherwise(0.0)
    excess = F.greatest(F.lit(0.0), share - (b + UPPER_Z * standard_error(b, F.col("n"))))
    frequent = F.col("count") >= F.greatest(F.lit(float(MIN_DIGIT_COUNT)), MIN_DIGIT_SHARE * F.col("n"))
    raw = tested.withColumn("_a", F.when(frequent, excess).otherwise(0.0))
    # The group maximum is taken before out-of-range digits are zeroed.
    top = F.max("_a").over(_whole(groups))
    usable = _in_range(digits) & (F.col("n") >= MIN_SAMPLE) & ~F.col("rejected") & (top > 0)
    score = F.when(usable, F.round(F.pow(F.col("_a") / top, F.lit(2.0)), 3)).otherwise(0.0)
    return raw.select(*groups, "digits", "count", "n", score.alias("score"))


def with_benford_scores(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    output: str = "benford",
    digits: int = 2,
    mode: str = "proportions",
) -> DataFrame:
    """Add the score of each row's leading digits; non-positive and null values get 0."""
    x = F.col(value).cast("double")
    scores = digit_scores(df, groups, value, digits, mode).select(
        *groups, F.col("digits").alias("_digits"), F.col("score").alias("_score")
    )
    rows = df.withColumn("_digits", F.when(x > 0, first_digits(x, digits)))
    joined = rows.join(scores, [*groups, "_digits"], "left")
    return joined.select(*df.columns, F.coalesce("_score", F.lit(0.0)).alias(output))


def _all_digits(df: DataFrame, groups: Sequence[str], value: str, digits: int) -> DataFrame:
    """Digit counts of every row: signs dropped, null and zero counted as digit 0."""
    rows = df.select(*groups, first_digits(value, digits).alias("digits"))
    return rows.groupBy(*groups, "digits").agg(F.count(F.lit(1)).alias("count"))


def _binary_cells(counts: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Flag and lower bound per (group, digits), from counts over the whole group."""
    share = F.col("count") / F.sum("count").over(_whole(groups))
    b = F.when(F.col("digits") > 0, expected_share(F.col("digits"))).otherwise(0.0)
    error = standard_error(b, F.col("count"))
    return counts.select(
        *groups,
        "digits",
        "count",
        (share > b + BINARY_Z * error).cast("int").alias("flag"),
        (b - BINARY_Z * error).alias("lower_bound"),
    )


def _join_flags(df: DataFrame, cells: DataFrame, groups: Sequence[str], value: str, output: str, digits: int):
    verdict = cells.select(
        *groups, F.col("digits").alias("_digits"), F.col("flag").alias("_flag"), F.col("lower_bound").alias("_low")
    )
    joined = df.withColumn("_digits", first_digits(value, digits)).join(verdict, [*groups, "_digits"], "left")
    return joined.select(*df.columns, F.col("_flag").alias(output), F.col("_low").alias(f"{output}_lower_bound"))


def with_binary_benford(
    df: DataFrame, groups: Sequence[str], value: str, output: str = "benford_flag", digits: int = 2
) -> DataFrame:
    """Flag rows whose digit share lies above the 99 % band around the law.

    Every row of the group counts; the band uses the digit's own count, and its
    lower end is reported next to the flag.  Rows with a null key get null.
    """
    cells = _binary_cells(_all_digits(df, groups, value, digits), groups)
    return _join_flags(df, cells, groups, value, output, digits)


def _subsets(columns: Sequence[str]):
    return [s for size in range(1, len(columns) + 1) for s in combinations(columns, size)]


def _subset_cells(df: DataFrame, columns: Sequence[str], value: str, digits: int):
    """Binary cells of every non-empty subset, all rolled up from one finest count."""
    # Written once: every subset is rolled up from this small table, and rows are read one time.
    finest = durable(_all_digits(df, columns, value, digits))
    for subset in _subsets(columns):
        rolled = finest.groupBy(*subset, "digits").agg(F.sum("count").alias("count"))
        for key in subset:
            rolled = rolled.where(F.col(key).isNotNull())
        yield subset, "benford_" + "_".join(subset), _binary_cells(rolled, subset)


def benford_by_subsets(df: DataFrame, columns: Sequence[str], value: str, digits: int = 2) -> DataFrame:
    """Binary flag of each row under every subset of grouping columns, and their sum."""
    out, names = df, []
    for subset, name, cells in _subset_cells(df, columns, value, digits):
        out = _join_flags(out, cells, subset, value, name, digits).drop(f"{name}_lower_bound")
        names.append(name)
    total = sum((F.coalesce(F.col(n), F.lit(0)) for n in names), F.lit(0))
    return out.withColumn("benford_total", total)


def subset_counts(df: DataFrame, columns: Sequence[str], value: str, digits: int = 2) -> DataFrame:
    """How many rows each subset of grouping columns flags.

    Read off the digit counts: no row is joined back.
    """
    parts = [
        cells.agg(F.coalesce(F.sum(F.when(F.col("flag") == 1, F.col("count"))), F.lit(0)).alias("anomalies")).select(
            F.lit(name).alias("subset"), "anomalies"
        )
        for _, name, cells in _subset_cells(df, columns, value, digits)
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
