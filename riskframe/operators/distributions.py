"""Shape of a distribution per group, and shape-driven standardising.

Everything is built from mergeable aggregates; the two tests that need order
(uniformity, modes) run on value counts with sliced running totals or a bounded
grid, so no group is sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.frames import attach
from riskframe.ordered import SLICE_ROWS, running_totals
from riskframe.session import durable

# Significance level, skewness limit, kernel bandwidth, grid size,
# and the smallest sample the normality test takes.
ALPHA = 0.05
SKEW_LIMIT = 0.5
BANDWIDTH = 1.0
GRID_POINTS = 1000
MIN_NORMAL_ROWS = 20
# exp(-z*z/2) underflows beyond this many bandwidths.
KERNEL_REACH = 38.6


def present(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    x = F.col(value).cast("double")
    out = df.select(*keys, x.alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    for k in keys:
        out = out.where(F.col(k).isNotNull())
    return out


def moments(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Count, mean, population deviation, skewness and kurtosis per group."""
    return (
        present(df, keys, value)
        .groupBy(*keys)
        .agg(
            F.count("_x").alias("n"),
            F.min("_x").alias("minimum"),
            F.max("_x").alias("maximum"),
            F.avg("_x").alias("mean"),
            F.stddev_pop("_x").alias("std"),
            F.skewness("_x").alias("skewness"),
            F.kurtosis("_x").alias("kurtosis"),
        )
    )


def skewness_class(skewness: Column) -> Column:
    return (
        F.when(skewness > SKEW_LIMIT, "Right skewed").when(skewness < -SKEW_LIMIT, "Left skewed").otherwise("Symmetric")
    )


def _skew_z(n: Column, skew: Column) -> Column:
    """D'Agostino's transformed skewness."""
    y = skew * F.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    beta2 = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2.0) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + F.sqrt(2 * (beta2 - 1))
    delta = 1 / F.sqrt(0.5 * F.log(w2))
    a = F.sqrt(2.0 / (w2 - 1))
    ratio = F.when(y == 0, 1e-300).otherwise(y) / a
    return delta * F.log(ratio + F.sqrt(ratio * ratio + 1))


def _kurtosis_z(n: Column, excess: Column) -> Column:
    """Anscombe and Glynn's transformed kurtosis."""
    b2 = excess + 3
    e = 3.0 * (n - 1) / (n + 1)
    var = 24.0 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (b2 - e) / F.sqrt(var)
    root_beta = (
        6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    )
    a = 6.0 + 8.0 / root_beta * (2.0 / root_beta + F.sqrt(1 + 4.0 / (root_beta * root_beta)))
    term1 = 1 - 2 / (9.0 * a)
    denominator = 1 + x * F.sqrt(2 / (a - 4.0))
    term2 = F.signum(denominator) * F.pow((1 - 2.0 / a) / F.abs(denominator), F.lit(1 / 3))
    return (term1 - term2) / F.sqrt(2 / (9.0 * a))


def with_normality(stats: DataFrame) -> DataFrame:
    """Add ``k_squared``, ``p_normal`` and ``is_normal`` to a moments frame."""
    n = F.col("n").cast("double")
    usable = (n >= MIN_NORMAL_ROWS) & (F.col("std") > 0)
    k2 = F.when(usable, _skew_z(n, F.col("skewness")) ** 2 + _kurtosis_z(n, F.col("kurtosis")) ** 2)
    out = stats.withColumn("k_squared", k2).withColumn("p_normal", F.exp(-F.col("k_squared") / 2))
    return out.withColumn("is_normal", F.coalesce(F.col("p_normal") > ALPHA, F.lit(False)))


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return present(df, keys, value).groupBy(*keys, "_x").agg(F.count(F.lit(1)).alias("_c"))


def uniformity(df: DataFrame, keys: Sequence[str], value: str, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Kolmogorov-Smirnov distance of min-max scaled values from the uniform law."""
    counts = value_counts(df, keys, value)
    ranked = running_totals(counts, keys, "_x", {"_upto": "_c"}, slice_rows=slice_rows)
    bounds = counts.groupBy(*keys).agg(
        F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.sum("_c").alias("_n")
    )
    if keys:
        placed = ranked.join(bounds, list(keys))
    else:
        from riskframe.frames import with_scalars

        placed = with_scalars(ranked, bounds)
    u = (F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    above = F.col("_upto") / F.col("_n") - u
    below = u - (F.col("_upto") - F.col("_c")) / F.col("_n")
    distance = placed.where(F.col("_hi") > F.col("_lo")).groupBy(*keys).agg(
        F.max(F.greatest(above, below)).alias("ks_distance"), F.max("_n").alias("_n")
    )
    lam2 = F.col("_n") * F.col("ks_distance") ** 2
    series = sum(((-1) ** (k - 1) * F.exp(-2.0 * k * k * lam2) for k in range(1, 21)), F.lit(0.0))
    p = F.when(lam2 < 0.04, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * series)))
    return distance.select(*keys, "ks_distance", p.alias("p_uniform"), (p > ALPHA).alias("is_uniform"))


def mode_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Peaks of a Gaussian kernel density (bandwidth 1) on a 1000-point grid.

    Values are first folded into bins far narrower than the bandwidth and the grid
    step, each standing at its mean, so a group contributes a bounded number of
    (bin, grid point) pairs; a bin touches only grid points its kernel reaches.
    """
    stats = present(df, keys, value).groupBy(*keys).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    stats = stats.where(F.col("_hi") > F.col("_lo")).withColumn(
        "_step", (F.col("_hi") - F.col("_lo")) / (GRID_POINTS - 1)
    )
    width = F.least(F.col("_step") / 16, F.lit(BANDWIDTH / 100))
    located = present(df, keys, value).join(stats, list(keys)) if keys else _global(present(df, keys, value), stats)
    bins = (
        located.withColumn("_bin", F.floor((F.col("_x") - F.col("_lo")) / width))
        .groupBy(*keys, "_bin")
        .agg(F.avg("_x").alias("_at"), F.count(F.lit(1)).alias("_c"), F.first("_lo").alias("_lo"), F.first("_step").alias("_step"))
    )
    reach = KERNEL_REACH * BANDWIDTH
    first = F.greatest(F.lit(0), F.ceil((F.col("_at") - reach - F.col("_lo")) / F.col("_step")))
    last = F.least(F.lit(GRID_POINTS - 1), F.floor((F.col("_at") + reach - F.col("_lo")) / F.col("_step")))
    touched = bins.where(first <= last).select(
        *keys, "_at", "_c", "_lo", "_step", F.explode(F.sequence(first.cast("int"), last.cast("int"))).alias("_g")
    )
    z = (F.col("_lo") + F.col("_g") * F.col("_step") - F.col("_at")) / BANDWIDTH
    mass = touched.groupBy(*keys, "_g").agg(F.sum(F.col("_c") * F.exp(-0.5 * z * z)).alias("_d"))
    grid = stats.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(GRID_POINTS - 1))).alias("_g"))
    curve = grid.join(mass, [*keys, "_g"], "left").select(*keys, "_g", F.coalesce("_d", F.lit(0.0)).alias("_d"))
    # At most GRID_POINTS rows per group from here on.
    along = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("_g")
    turns = curve.withColumn("_prev", F.lag("_d").over(along)).where(
        F.col("_prev").isNull() | (F.abs(F.col("_d") - F.col("_prev")) > 1e-9 * F.col("_prev"))
    )
    turns = turns.withColumn("_before", F.lag("_d").over(along)).withColumn("_after", F.lead("_d").over(along))
    peak = (F.col("_d") > F.col("_before")) & (F.col("_d") > F.col("_after"))
    return turns.groupBy(*keys).agg(F.count_if(peak).alias("modes"))


def _global(rows: DataFrame, stats: DataFrame) -> DataFrame:
    from riskframe.frames import with_scalars

    return with_scalars(rows, stats)


def classify(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distribution class of each group with the statistics behind it.

    The order and density tests run on the groups that reach them only.
    """
    keys = list(keys)
    if not keys:
        return classify(df.withColumn("_all", F.lit(0)), ["_all"], value).drop("_all")
    stats = durable(with_normality(moments(df, keys, value)))
    skew = skewness_class(F.col("skewness"))
    undecided = ~F.col("is_normal") & (F.col("maximum") > F.col("minimum"))
    symmetric = df.join(stats.where(undecided & (skew == "Symmetric")).select(*keys), keys, "left_semi")
    tested = durable(
        stats.join(uniformity(symmetric, keys, value), keys, "left").withColumn(
            "is_uniform", F.coalesce("is_uniform", F.lit(False))
        )
    )
    rest = df.join(tested.where(undecided & ~F.col("is_uniform")).select(*keys), keys, "left_semi")
    out = tested.join(mode_counts(rest, keys, value), keys, "left")
    kind = (
        F.when(F.col("minimum") == F.col("maximum"), "Degenerate")
        .when(F.col("is_normal"), "Normal")
        .when((skew == "Symmetric") & F.col("is_uniform"), "Uniform")
        .when(F.col("modes") > 1, "Multimodal")
        .otherwise(skew)
    )
    named = out.withColumn("distribution", kind)
    # A group without any number is Unknown.
    groups = df.select(*keys).where(F.col(keys[0]).isNotNull()).distinct()
    return groups.join(named, keys, "left").withColumn("distribution", F.coalesce("distribution", F.lit("Unknown")))


# Candidates on either side of the best one, the first step between them, and the step that ends the search.
CANDIDATES = 20
FIRST_STEP = 0.25
LAMBDA_STEP = 0.001


def _yeo_johnson(x: Column, lam: Column) -> Column:
    near_zero, near_two = F.abs(lam) < 1e-12, F.abs(lam - 2) < 1e-12
    up = F.when(near_zero, F.log1p(x)).otherwise((F.pow(x + 1, lam) - 1) / lam)
    down = F.when(near_two, -F.log1p(-x)).otherwise(-(F.pow(1 - x, 2 - lam) - 1) / (2 - lam))
    return F.when(x >= 0, up).otherwise(down)


def _yeo_johnson_from(x: Column, middle: Column, lam: Column) -> Column:
    """The transform of x less that of ``middle``, exact to rounding where both have one sign,
    however close to its limit the transform of either is."""

    def apart(a: Column, b: Column, power: Column) -> Column:
        away = F.log1p(a) - F.log1p(b)
        grown = F.exp(power * F.log1p(b)) * F.expm1(power * away) / power
        return F.when(F.abs(power) < 1e-12, away).otherwise(grown)

    return (
        F.when((x >= 0) & (middle >= 0), apart(x, middle, lam))
        .when((x < 0) & (middle < 0), -apart(-x, -middle, 2 - lam))
        .otherwise(_yeo_johnson(x, lam) - _yeo_johnson(middle, lam))
    )


def yeo_johnson_lambdas(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Maximum-likelihood lambda per group, to 0.001, wherever it lies.

    Each pass scores 41 candidates around each group's best one, in one map-side
    combined aggregation over the value counts.  While the best candidate is the outermost,
    the group's grid moves there with twice the step; once it lies inside, the step
    shrinks to a twentieth per pass.  Finished groups take no part in later passes, and a
    group none of whose candidates has a positive variance has no lambda.
    """
    keys = list(keys)
    counts = durable(value_counts(df, keys, value))
    middle = F.sum(F.col("_x") * F.col("_c")) / F.sum("_c")
    jacobian = F.sum(F.col("_c") * F.signum("_x") * F.log1p(F.abs("_x")))
    groups = counts.groupBy(*keys).agg(middle.alias("_mid"), jacobian.alias("_j"), F.sum("_c").alias("_n"))
    state = durable(groups.withColumns({"_best": F.lit(0.0), "_step": F.lit(FIRST_STEP), "_inside": F.lit(False), "_done": F.lit(False)}))
    finished = state.limit(0)
    while not state.isEmpty():
        places = F.explode(F.sequence(F.lit(-CANDIDATES), F.lit(CANDIDATES))).alias("_i")
        lam = (F.col("_best") + F.col("_i") * F.col("_step")).alias("_lam")
        tried = counts.join(state, keys).select(*keys, "_x", "_c", "_mid", "_best", "_step", places)
        tried = tried.select(*keys, "_i", "_c", _yeo_johnson_from(F.col("_x"), F.col("_mid"), lam).alias("_y"))
        sums = tried.groupBy(*keys, "_i").agg(
            F.sum(F.col("_c") * F.col("_y")).alias("_s"), F.sum(F.col("_c") * F.col("_y") * F.col("_y")).alias("_ss")
        )
        scored = sums.join(state, keys)
        var = F.col("_ss") / F.col("_n") - (F.col("_s") / F.col("_n")) ** 2
        score = F.when(var > 0, -F.col("_n") / 2 * F.log(var) + (lam - 1) * F.col("_j"))
        scored = scored.withColumn("_score", score).where(F.col("_score").isNotNull() & (F.abs("_score") < float("inf")))
        best = scored.groupBy(*keys).agg(F.max_by("_i", F.struct("_score", -F.abs(lam))).alias("_i"))
        inside = F.col("_inside") | (F.abs("_i") < CANDIDATES)
        state = durable(
            state.join(best, keys).select(
                *keys, "_mid", "_j", "_n", lam.alias("_best"),
                F.when(inside, F.col("_step") / CANDIDATES).otherwise(F.col("_step") * 2).alias("_step"),
                inside.alias("_inside"), (inside & (F.col("_step") <= LAMBDA_STEP)).alias("_done"),
            )
        )
        finished = finished.unionByName(state.where("_done"))
        state = state.where(~F.col("_done"))
    return finished.select(*keys, F.col("_best").alias("lam"))


# Published coefficients of Acklam's rational approximation of the normal quantile.
NORMAL_QUANTILE = (
    (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.357751867269, -30.66479806614716, 2.506628277459239),
    (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572),
    (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783),
    (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416),
)


def _inverse_normal(p: Column) -> Column:
    """Standard normal quantile (Acklam's rational approximation, 1e-9)."""
    a, b, c, d = NORMAL_QUANTILE

    def poly(coefficients, x):
        out = F.lit(coefficients[0])
        for k in coefficients[1:]:
            out = out * x + k
        return out

    q = p - 0.5
    middle = poly(a, q * q) * q / poly((*b, 1.0), q * q)
    low = F.sqrt(-2 * F.log(p))
    high = F.sqrt(-2 * F.log(1 - p))
    return (
        F.when(p < 0.02425, poly(c, low) / poly((*d, 1.0), low))
        .when(p > 1 - 0.02425, -poly(c, high) / poly((*d, 1.0), high))
        .otherwise(middle)
    )


def standardize(
    df: DataFrame, keys: Sequence[str], value: str, output: str, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Standardise by each group's class.

    Normal and Degenerate stay as they are; Unknown, Symmetric and Uniform become
    z-scores; skewed groups Yeo-Johnson then z-score; Multimodal normal quantiles.
    """
    keys = list(keys)
    if not keys:
        out = standardize(df.withColumn("_all", F.lit(0)), ["_all"], value, output, slice_rows)
        return out.drop("_all")
    # Fitted values, one row per group: kept, so that the rows below are read
    # once per use and not once per statistic.
    shape = durable(
        classify(df, keys, value).select(
            *keys,
            F.col("distribution").alias("_kind"),
            F.col("mean").alias("_mean"),
            F.col("std").alias("_std"),
            F.col("n").alias("_n"),
        )
    )
    rows = df.withColumn("_x", F.col(value).cast("double")).join(shape, keys, "left")
    skewed = F.col("_kind").isin("Right skewed", "Left skewed")
    lambdas = durable(yeo_johnson_lambdas(rows.where(skewed).select(*keys, "_x"), keys, "_x"))
    rows = rows.join(lambdas, keys, "left").withColumn("_y", F.when(skewed, _yeo_johnson(F.col("_x"), F.col("lam"))))
    rows = attach(rows, keys, _ymean=F.avg("_y"), _ystd=F.stddev_pop("_y"))
    counts = value_counts(rows.where(F.col("_kind") == "Multimodal").select(*keys, "_x"), keys, "_x")
    ranks = running_totals(counts, keys, "_x", {"_upto": "_c"}, slice_rows=slice_rows)
    # Middle rank of equal values, on 0..1, clipped as the quantile mapping does.
    middle = ranks.select(*keys, "_x", (F.col("_upto") - (F.col("_c") + 1) / 2).alias("_rank"))
    rows = rows.join(middle, [*keys, "_x"], "left")
    p = F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), F.col("_rank") / (F.col("_n") - 1)))
    z = F.when(F.col("_std") > 0, (F.col("_x") - F.col("_mean")) / F.col("_std")).otherwise(0.0)
    result = (
        F.when(F.col("_x").isNull(), None)
        .when(F.col("_kind").isin("Normal", "Degenerate"), F.col("_x"))
        .when(skewed, F.when(F.col("_ystd") > 0, (F.col("_y") - F.col("_ymean")) / F.col("_ystd")).otherwise(0.0))
        .when(F.col("_kind") == "Multimodal", _inverse_normal(p))
        .otherwise(z)
    )
    return rows.select(*df.columns, F.col("_kind").alias(f"{output}_class"), result.alias(output))
