"""User-defined anomaly features: declared, checked, discovered and run."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.frames import with_scalars
from riskframe.functions.values import fill_missing

PREFIX = "Anmly_"


@dataclass(frozen=True)
class Feature:
    """A feature: its inputs, outputs and a function from frame to frame.

    ``column`` builds features that are pure expressions; ``run`` gets the key and
    the inputs and returns the key and the outputs for the same keys.
    """

    name: str
    inputs: Sequence[str]
    outputs: Sequence[str]
    run: Callable[[DataFrame], DataFrame] | None = None
    column: Callable[[], dict[str, Column]] | None = None
    description: str = ""
    risk_level: str = "Medium"
    fill: dict[str, object] = field(default_factory=dict)

    def output_name(self, output: str) -> str:
        return output if output.startswith(self.name) else f"{self.name}_{output}"


REGISTRY: dict[str, Feature] = {}


def register_feature(feature: Feature) -> Feature:
    REGISTRY[feature.name] = feature
    return feature


def key_check(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Count, least and greatest key of both frames and whether they agree: one row."""
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.agg(
            F.count(F.lit(1)).alias(f"{name}_rows"), F.count_distinct(key).alias(f"{name}_keys"),
            F.min(key).alias(f"{name}_min"), F.max(key).alias(f"{name}_max"),
        )

    both = with_scalars(side(before, "before"), side(after, "after"))
    same = F.lit(True)
    for part in ("rows", "keys", "min", "max"):
        same = same & F.col(f"before_{part}").eqNullSafe(F.col(f"after_{part}"))
    return both.withColumn("same_keys", same)


def run_feature(feature: Feature, df: DataFrame, key: str, check: bool = True) -> DataFrame:
    """Key and outputs of one feature, outputs prefixed with its name and filled."""
    missing = [c for c in feature.inputs if c not in df.columns]
    if missing:
        raise ValueError(f"{feature.name}: input columns missing: {missing}")
    given = df.select(key, *[c for c in feature.inputs if c != key])
    if feature.column is not None:
        out = given.select(key, *[c.alias(n) for n, c in feature.column().items()])
    else:
        out = feature.run(given)
    absent = [c for c in (key, *feature.outputs) if c not in out.columns]
    if absent:
        raise ValueError(f"{feature.name}: output columns missing: {absent}")
    if check and feature.column is None:
        row = key_check(given, out, key).first()
        if not row["same_keys"]:
            raise ValueError(f"{feature.name}: keys changed: {row.asDict()}")
    named = out.select(key, *[F.col(c).alias(feature.output_name(c)) for c in feature.outputs])
    return fill_missing(named, {feature.output_name(c): v for c, v in feature.fill.items()})


def runnable(df: DataFrame, features: Sequence[Feature] | None = None) -> list[Feature]:
    """Features whose inputs all exist."""
    return [f for f in (features or list(REGISTRY.values())) if all(c in df.columns for c in f.inputs)]


def with_features(df: DataFrame, key: str, features: Sequence[Feature] | None = None, prefix: str = PREFIX, check: bool = True) -> DataFrame:
    """Add every runnable feature's outputs, prefixed.

    Pure-expression features become columns of one projection; the others are joined
    back on the key.
    """
    todo = runnable(df, features)
    direct = {}
    for f in [f for f in todo if f.column is not None]:
        for n, c in f.column().items():
            name = f.output_name(n)
            direct[prefix + name] = F.coalesce(c, F.lit(f.fill[n])) if n in f.fill else c
    out = df.withColumns(direct) if direct else df
    for f in [f for f in todo if f.column is None]:
        made = run_feature(f, df, key, check)
        named = made.select(key, *[F.col(c).alias(prefix + c) for c in made.columns if c != key])
        out = out.join(named, key, "left")
    return out


def by_column(df: DataFrame, function: Callable[[Column], Column], columns: Sequence[str] | None = None) -> DataFrame:
    """Apply one column function to many columns in one projection."""
    chosen = set(columns or df.columns)
    return df.select(*[function(F.col(f"`{c}`")).alias(c) if c in chosen else F.col(f"`{c}`") for c in df.columns])
