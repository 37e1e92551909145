"""Encoders as Spark ML stages: robust scaling, bins, powers, dates, one-hot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.feature import OneHotEncoder as SparkOneHotEncoder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions.text import category, name_part_of
from riskframe.functions.values import day_of_month, month_name, parse_date, quarter, weekday_name
from riskframe.ml.persist import SavedStage
from riskframe.ordered import exact_quantiles, running_totals
from riskframe.prep.impute import UNKNOWN
from riskframe.session import durable

# Suffixes of derived columns, and the least range.
RANGE_SUFFIX = "_Range"
POWER_SIGN = "^"
EPSILON = 1e-9
# A column of more levels is encoded as one sparse vector, not as columns.
MOST_COLUMNS = 1_000


def robust_parameters(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Median and inter-quartile range of each column (0 becomes 1e-9), exact, in shared passes."""
    stacked = df.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"`{c}`").cast("double").alias("x")) for c in columns])).alias("s")
    ).select("s.*")
    rows = exact_quantiles(stacked, ["c"], "x", {"q1": 0.25, "q2": 0.5, "q3": 0.75}).collect()
    return {r["c"]: (r["q2"], (r["q3"] - r["q1"]) or EPSILON) for r in rows}


def robust_scale(column: str, median: float, spread: float) -> Column:
    return (F.col(f"`{column}`").cast("double") - median) / spread


def robust_unscale(column: str, median: float, spread: float) -> Column:
    return F.col(f"`{column}`") * spread + median


def decade_bin(x: Column) -> Column:
    """Label "a-b" of the right-closed decade bin: 0..10 by 1, ..100 by 10, and so on.

    0 falls in "0-1"; negative and missing values have no bin.
    """
    # Powers of ten as exact literals: a value on an edge must not slip over it.  The
    # logarithm is at most one place off; of the places around it the highest below x counts.
    powers = F.lit([float(f"1e{e}") for e in range(309)])
    near = F.floor(F.log10(F.greatest(x, F.lit(1.0)))).cast("int")
    around = [F.greatest(near + k, F.lit(0)) for k in (1, 0)]
    place = F.when(F.get(powers, around[0]) < x, around[0]).when(F.get(powers, around[1]) < x, around[1])
    place = F.coalesce(place, F.greatest(near - 1, F.lit(0)))
    power = F.get(powers, place)
    # A quotient may be rounded up past an edge: x is at most ten powers, and a multiple not below x bounds it.
    high = F.least(F.ceil(x / power), F.lit(10))
    high = F.when((high - 1) * power >= x, high - 1).otherwise(high)
    zeros = F.repeat(F.lit("0"), place)
    label = F.concat(F.when(high > 1, F.concat((high - 1).cast("string"), zeros)).otherwise("0"), F.lit("-"), high.cast("string"), zeros)
    return F.when(x == 0, "0-1").when((x > 0) & (x < float("inf")), label)


def powers(column: str, value: Column, degree: int = 2) -> list[Column]:
    return [F.pow(value, F.lit(float(d))).alias(f"{column}{POWER_SIGN}{d}") for d in range(1, degree + 1)]


def polynomial_value(value: Column, degree: int) -> Column:
    """A raw value raised to a power, two decimals; 0 and missing give null."""
    return F.when(value != 0, F.round(F.pow(value, F.lit(float(degree))), 2))


class NumericEncoder(SavedStage, Estimator):
    """Fill 0, decade bins, robust scale, powers of the scaled value; raw columns dropped."""

    FACTS = ("columns", "degree")

    def __init__(self, columns: Sequence[str], degree: int = 2):
        super().__init__()
        self.columns, self.degree = list(columns), degree

    def _fit(self, dataset: DataFrame) -> NumericEncoderModel:
        filled = dataset.select(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias(c) for c in self.columns])
        return NumericEncoderModel(robust_parameters(filled, self.columns), self.degree)


class NumericEncoderModel(SavedStage, Model):
    FACTS = ("parameters", "degree")

    def __init__(self, parameters: dict[str, tuple[float, float]], degree: int):
        super().__init__()
        self.parameters, self.degree = parameters, degree

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = [F.col(f"`{c}`") for c in dataset.columns if c not in self.parameters]
        for c, (median, spread) in self.parameters.items():
            x = F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0))
            out.append(decade_bin(x).alias(f"{c}{RANGE_SUFFIX}"))
            out.extend(powers(c, (x - median) / spread, self.degree))
        return dataset.select(*out)


class DateTimeEncoder(SavedStage, Transformer):
    """Quarter, month, day of month and weekday of each date; raw columns dropped."""

    FACTS = ("columns",)

    def __init__(self, columns: Sequence[str]):
        super().__init__()
        self.columns = list(columns)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        kinds = dict(dataset.dtypes)
        out = [F.col(f"`{c}`") for c in dataset.columns if c not in self.columns]
        for c in self.columns:
            d = parse_date(F.col(f"`{c}`")) if kinds[c] == "string" else F.col(f"`{c}`")
            out += [
                quarter(d).cast("string").alias(f"{c}_Qtr"),
                month_name(d).alias(f"{c}_Month"),
                day_of_month(d).alias(f"{c}_DayOfMonth"),
                weekday_name(d).alias(f"{c}_WkDay"),
            ]
        return dataset.select(*out)


class OneHotEncoder(SavedStage, Estimator):
    """0/1 columns ``col=level`` for each level; unknown and unseen are all zero.

    Columns with fewer than two levels, or one level per row, are left as they are.  A column of more than ``most_columns``
    levels becomes one sparse vector ``col=levels`` instead, whose places are those of a table of levels.
    """

    FACTS = ("columns", "unknown", "separator", "most_columns")

    def __init__(self, columns: Sequence[str], unknown: str = UNKNOWN, separator: str = "=", most_columns: int = MOST_COLUMNS):
        super().__init__()
        self.columns, self.unknown, self.separator, self.most_columns = list(columns), unknown, separator, most_columns

    def _fit(self, dataset: DataFrame) -> OneHotModel:
        stacked = dataset.select(
            F.explode(F.array(*[F.struct(F.lit(c).alias("c"), category(F.col(f"`{c}`")).alias("v")) for c in self.columns])).alias("s")
        ).select("s.*").where(F.col("v").isNotNull())
        levels = durable(stacked.distinct())
        sizes = {r["c"]: r["count"] for r in levels.groupBy("c").count().collect()}
        rows = dataset.count()
        wide = sorted(c for c, n in sizes.items() if n > self.most_columns and n != rows)
        found: dict[str, set[str]] = {c: {self.unknown} for c in self.columns if c not in wide and sizes.get(c, 0) <= self.most_columns}
        for r in levels.where(F.col("c").isin(list(found))).collect():
            found[r["c"]].add(r["v"])
        kept = {c: sorted(v) for c, v in found.items() if 2 <= len(v) and len(v) != rows}
        index, places = None, {}
        if wide:
            named = levels.where(F.col("c").isin(wide) & (F.col("v") != self.unknown)).withColumn("one", F.lit(1))
            index = durable(running_totals(named, ["c"], "v", {"place": "one"}).select("c", "v", (F.col("place") - 1).cast("int").alias("place")))
            places = {r["c"]: r["count"] for r in index.groupBy("c").count().collect()}
        return OneHotModel(kept, self.unknown, self.separator, places, index)


class OneHotModel(SavedStage, Model):
    FACTS, TABLES = ("levels", "unknown", "separator", "places"), ("index",)

    def __init__(self, levels: dict[str, list[str]], unknown: str, separator: str, places: dict[str, int] | None = None, index: DataFrame | None = None):
        super().__init__()
        self.levels, self.unknown, self.separator = levels, unknown, separator
        self.places, self.index = places or {}, index

    @property
    def vector_names(self) -> list[str]:
        return [f"{c}{self.separator}levels" for c in self.places]

    def _names(self, keep_unknown: bool) -> dict[str, dict[str, list[str]]]:
        """Column -> feature name -> the raw levels that fold to it."""
        out: dict[str, dict[str, list[str]]] = {}
        for c, levels in self.levels.items():
            named = out.setdefault(c, {})
            for v in levels:
                if keep_unknown or v != self.unknown:
                    named.setdefault(f"{c}{self.separator}{name_part_of(v)}", []).append(v)
        return out

    @property
    def all_feature_names(self) -> list[str]:
        return [n for named in self._names(True).values() for n in named]

    @property
    def feature_names(self) -> list[str]:
        return [n for named in self._names(False).values() for n in named]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = [F.col(f"`{c}`") for c in dataset.columns if c not in self.levels and c not in self.places]
        for c, size in self.places.items():
            dataset = self._with_vector(dataset, c, size)
            out.append(F.col(f"`{c}{self.separator}levels`"))
        for c, named in self._names(False).items():
            value = category(F.col(f"`{c}`"))
            out += [F.coalesce(value.isin(v), F.lit(False)).cast("byte").alias(n) for n, v in named.items()]
        return dataset.select(*out)


    def _with_vector(self, dataset: DataFrame, column: str, size: int) -> DataFrame:
        """Levels are looked up in their table; Spark's own encoder writes the vectors, all zero where there is no place."""
        places = self.index.where(F.col("c") == column).select(F.col("v").alias("_v"), F.col("place").alias("_place"))
        placed = dataset.withColumn("_v", category(F.col(f"`{column}`"))).join(places, "_v", "left")
        placed = placed.withColumn("_place", F.coalesce("_place", F.lit(size))).drop("_v")
        encoder = SparkOneHotEncoder(inputCol="_place", outputCol=f"{column}{self.separator}levels", handleInvalid="keep")
        known = dataset.sparkSession.range(size - 1, size).select(F.col("id").cast("int").alias("_place"))
        return encoder.fit(known).transform(placed).drop("_place")


class FeatureBuilder(SavedStage, Estimator):
    """Numeric, rare-label, date and one-hot encoding in order.

    The fitted model keeps its input and output names; transforming new data gives
    exactly the fitted features, missing ones as 0.
    """

    FACTS = ("key", "target", "numeric", "dates", "categorical")

    def __init__(self, key: str, numeric: Sequence[str], dates: Sequence[str], categorical: Sequence[str], target: str):
        super().__init__()
        self.key, self.target = key, target
        self.numeric, self.dates, self.categorical = list(numeric), list(dates), list(categorical)

    def _fit(self, dataset: DataFrame) -> FeatureBuilderModel:
        from riskframe.prep.impute import impute_rare_labels, rare_labels

        numeric = NumericEncoder(self.numeric).fit(dataset)
        ranges = [f"{c}{RANGE_SUFFIX}" for c in self.numeric]
        stage = numeric.transform(dataset)
        labels = [*self.categorical, *ranges]
        rare = durable(rare_labels(stage, labels, self.target))
        dates = DateTimeEncoder(self.dates)
        stage = dates.transform(impute_rare_labels(stage, rare, labels))
        parts = [f"{c}_{p}" for c in self.dates for p in ("Qtr", "Month", "WkDay")]
        onehot = OneHotEncoder([*labels, *parts]).fit(stage)
        features = [c for c in onehot.transform(stage).columns if c not in (self.key, self.target)]
        return FeatureBuilderModel(self, numeric, rare, labels, dates, onehot, features)


class FeatureBuilderModel(SavedStage, Model):
    FACTS = ("key", "target", "input_names", "output_names", "labels")
    TABLES, PARTS = ("rare",), ("numeric", "dates", "onehot")

    def __init__(self, spec, numeric, rare, labels, dates, onehot, features):
        super().__init__()
        self.key, self.target = spec.key, spec.target
        self.input_names = [*spec.numeric, *spec.dates, *spec.categorical]
        self.numeric, self.rare, self.labels = numeric, rare, labels
        self.dates, self.onehot, self.output_names = dates, onehot, features

    def _transform(self, dataset: DataFrame) -> DataFrame:
        from riskframe.prep.impute import impute_rare_labels

        stage = impute_rare_labels(self.numeric.transform(dataset), self.rare, self.labels)
        out = self.onehot.transform(self.dates.transform(stage))
        keep = [c for c in (self.key, self.target) if c in out.columns]
        features = [F.col(f"`{c}`") if c in out.columns else F.lit(0).alias(c) for c in self.output_names]
        return out.select(*keep, *features)
