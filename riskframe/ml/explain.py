"""Why a row was flagged: contributions, readable values, failed tests."""

from __future__ import annotations

import itertools
import random
from collections.abc import Mapping, Sequence

from pyspark.ml import Model
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.frames import attach
from riskframe.ml.training import positive_probability
from riskframe.session import durable

SCORE_SUFFIX = "_Tran_Score"
BACKGROUND_CENTRES = 100
PERMUTATIONS = 20


def to_percent(contributions: DataFrame, keys: Sequence[str], probability: str) -> DataFrame:
    """Signed share of each contribution in percent of the row's probability.

    Zeros (after rounding to two decimals) are dropped.  Rows are not sorted.
    """
    total = attach(contributions, keys, _total=F.sum(F.abs("contribution")))
    percent = F.round(F.col("contribution") * F.col(probability) * 100 / F.col("_total"), 2)
    out = total.where(F.col("_total") > 0).select(*keys, "feature", percent.alias("contribution_percent"))
    return out.where(F.col("contribution_percent") != 0)


def linear_percent(df: DataFrame, keys: Sequence[str], coefficients: Mapping[str, float], means: Mapping[str, float], probability: str) -> DataFrame:
    """Exact contributions of a linear model, coefficient times (value - mean), in
    percent, smallest first within each row: the row total is a sum of columns, so nothing
    is shuffled or sorted beyond the row."""
    parts = {f: F.lit(float(w)) * (F.col(f"`{f}`").cast("double") - float(means[f])) for f, w in coefficients.items()}
    total = sum((F.abs(p) for p in parts.values()), F.lit(0.0))
    shares = [
        F.struct(F.lit(f).alias("feature"), F.round(p * F.col(probability) * 100 / F.col("_total"), 2).alias("contribution_percent"))
        for f, p in parts.items()
    ]
    ordered = F.array_sort(F.array(*shares), lambda a, b: F.when(a["contribution_percent"] < b["contribution_percent"], -1).when(a["contribution_percent"] > b["contribution_percent"], 1).otherwise(0))
    rows = df.withColumn("_total", total).where(F.col("_total") > 0).select(*keys, F.explode(ordered).alias("s"))
    return rows.select(*keys, "s.*").where(F.col("contribution_percent") != 0)


def column_means(df: DataFrame, features: Sequence[str]) -> dict[str, float]:
    row = df.agg(*[F.avg(F.col(f"`{f}`").cast("double")).alias(f) for f in features]).first()
    return {f: float(row[f] or 0.0) for f in features}


def summarised_background(rows: DataFrame, vector: str, seed: int = 42) -> list[tuple[list[float], int]]:
    """At most 100 k-means centres of all rows, each with the number of rows it stands for.

    Equal rows are one weighted point; up to 100 distinct points are their own centres.  Only centres reach the driver.
    """
    points = durable(rows.groupBy(F.col(vector).alias("_b")).agg(F.count(F.lit(1)).alias("_n")))
    few = points.limit(BACKGROUND_CENTRES + 1).collect()
    if len(few) <= BACKGROUND_CENTRES:
        return sorted((list(r["_b"]), r["_n"]) for r in few)
    # Features count alike in the distance: each is divided by its spread.
    size = len(few[0]["_b"])
    total = lambda i: F.sum(F.col("_n") * F.col("_b")[i]) / F.sum("_n")
    means = points.agg(*[total(i).alias(f"m{i}") for i in range(size)]).first()
    spread = points.agg(*[F.sqrt(F.sum(F.col("_n") * F.pow(F.col("_b")[i] - means[i], 2)) / F.sum("_n")).alias(f"s{i}") for i in range(size)]).first()
    scaled = F.array(*[(F.col("_b")[i] - means[i]) / (spread[i] or 1.0) for i in range(size)])
    data = durable(points.select("_b", "_n", F.col("_n").cast("double").alias("_w"), scaled.alias("_z")))
    data = data.select("_b", "_n", "_w", array_to_vector("_z").alias("_z"))
    model = KMeans(k=BACKGROUND_CENTRES, featuresCol="_z", weightCol="_w", predictionCol="_c", seed=seed).fit(data)
    centres = model.transform(data).groupBy("_c").agg(F.array(*[total(i) for i in range(size)]).alias("_b"), F.sum("_n").alias("_n"))
    return sorted((list(r["_b"]), r["_n"]) for r in centres.collect())


def sampled_contributions(
    model: Model, df: DataFrame, keys: Sequence[str], features: Sequence[str], background: DataFrame,
    permutations: int = PERMUTATIONS, seed: int = 42,
) -> DataFrame:
    """Sampling Shapley values for any model, all rows at once.

    Each row walks ``permutations`` feature orders from a background row to itself;
    all the mixed rows are scored in one distributed transform and the differences
    averaged.  Rows: (keys, feature, contribution, probability).
    """
    n = len(features)
    rng = random.Random(seed)
    orders = [rng.sample(range(n), n) for _ in range(permutations)]
    vector = lambda d: F.array(*[F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(0.0)) for f in d])
    # All rows, summarised; a centre is drawn as often as rows belong to it.
    centres = summarised_background(background.select(vector(features).alias("_b")), "_b", seed)
    ends = list(itertools.accumulate(n for _, n in centres))
    table = F.array(*[F.struct(F.array(*[F.lit(float(x)) for x in c]).alias("b"), F.lit(e).alias("end")) for (c, _), e in zip(centres, ends, strict=True)])
    walks = F.array(*[F.struct(F.lit(i).alias("w"), F.array(*[F.lit(j) for j in o]).alias("order")) for i, o in enumerate(orders)])
    rows = df.select(*keys, vector(features).alias("_x"), F.explode(walks).alias("_walk"))
    drawn = F.pmod(F.xxhash64(*keys, F.col("_walk")["w"]), F.lit(ends[-1]))
    pick = F.filter(table, lambda c: c["end"] > drawn)
    rows = rows.select(*keys, "_x", F.get(pick, F.lit(0))["b"].alias("_b"), F.col("_walk")["w"].alias("_w"), F.col("_walk")["order"].alias("_order"))
    # Place of each feature in the order: feature i is the row's own once its place is passed.
    place = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.array_position(F.col("_order"), i).cast("int"))
    steps = rows.withColumn("_place", place).withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(n))))
    mixed = F.transform("_x", lambda x, i: F.when(F.get("_place", i) <= F.col("_s"), x).otherwise(F.get("_b", i)))
    scored = model.transform(steps.withColumn("features", array_to_vector(mixed)))
    scored = scored.select(*keys, "_w", "_s", "_order", positive_probability(scored).alias("_p"))
    along = Window.partitionBy(*keys, "_w").orderBy("_s")  # n + 1 rows
    diffs = scored.withColumn("_d", F.col("_p") - F.lag("_p").over(along)).withColumn("_end", F.when(F.col("_s") == n, F.col("_p")))
    names = F.array(*[F.lit(f) for f in features])
    feature = F.get(names, F.get("_order", F.col("_s") - 1))
    own = diffs.groupBy(*keys).agg(F.max("_end").alias("probability"))
    values = diffs.where(F.col("_s") > 0).groupBy(*keys, feature.alias("feature")).agg(F.avg("_d").alias("contribution"))
    return values.join(own, list(keys))


def shown_value(feature: Column, value: Column, amount: Column, onehot: Sequence[str] = (), prefix: str = "Anmly_") -> Column:
    """One-hot as true/false, anomaly score as percent, ``c^n`` as the amount's power.

    Numbers are written out, as 81000000.0 rather than 8.1E7, up to 1e16: beyond, doubles do not tell whole numbers apart.
    """
    power = F.regexp_extract(feature, r"\^(\d+)$", 1).try_cast("double")
    polynomial = F.when(amount != 0, F.round(F.pow(amount, power), 2))
    return (
        F.when(F.lower(feature).isin([o.lower() for o in onehot]), F.when(value != 0, "True").otherwise("False"))
        .when(feature.startswith(prefix), F.format_string("%.2f%%", value * 100))
        .when(power.isNotNull() & polynomial.isNotNull(), _written_out(polynomial))
        .otherwise(_written_out(value))
    )


def _written_out(number: Column) -> Column:
    """A number as text; doubles of 1e7 and more without Spark's exponent."""
    x = number.cast("double")
    # A double of that size has at most 10 decimals.
    decimals = F.regexp_replace(x.try_cast("decimal(38,10)").cast("string"), r"(\.\d+?)0+$", "$1")
    return F.when((F.abs(x) >= 1e7) & (F.abs(x) < 1e16) & number.cast("string").contains("E"), decimals).otherwise(number.cast("string"))


def failed_tests(df: DataFrame, key: str, patterns: DataFrame) -> DataFrame:
    """Evidence of every transaction: patterns with a positive score, one row each.

    ``patterns``: PatternID, description, category and weight.  The first other
    column naming the pattern is shown as additional information.
    """
    scores = [c for c in df.columns if c.endswith(SCORE_SUFFIX)]
    ids = [c[: -len(SCORE_SUFFIX)] for c in scores]

    def extra(p: str) -> Column:
        more = [c for c in df.columns if p in c and SCORE_SUFFIX not in c and c != p]
        return F.col(f"`{more[0]}`").cast("string") if more else F.lit(None).cast("string")

    entries = F.array(
        *[F.struct(F.lit(p).alias("PatternID"), F.col(f"`{s}`").cast("double").alias("score"), extra(p).alias("additional_info")) for p, s in zip(ids, scores)]
    )
    hits = df.select(key, F.explode(F.filter(entries, lambda e: e["score"] > 0)).alias("h")).select(key, "h.*")
    return hits.join(patterns, "PatternID")


def positive_contributions(contributions: DataFrame) -> DataFrame:
    """Contributions above 0: the summary table's filter."""
    return contributions.where(F.col("contribution_percent") > 0)


