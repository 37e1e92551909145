"""Stratified splits, minority oversampling and neighbour clean-up.

Every choice is a function of the key's hash, never of ``rand()``: any number of
partitions or retries gives the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.ml.neighbours import nearest
from riskframe.session import durable

# Split, minority share to reach, and shares that trigger each step.
TEST_PERCENT = 20
REPEATS = 5
SEED = 42
MINORITY_SHARE = 0.05
CLEAN_SHARE = 0.01
SMOTE_NEIGHBOURS = 5
CLEAN_NEIGHBOURS = 3
_BUCKETS = 65_536


def hash_unit(*parts: Column | str) -> Column:
    """A number in [0, 1) from the parts' text (52 bits of md5)."""
    text = F.concat_ws(":", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(16**13)


def pick_by_hash(df: DataFrame, stratum: str, key: str, wanted: Callable[[DataFrame], DataFrame], seed: object, output: str = "picked") -> DataFrame:
    """Mark exactly the wanted rows of each stratum: those of the lowest (hash, key).

    ``wanted`` makes (stratum, _want) from (stratum, _n), the strata and their sizes.
    Bucket counts name the one hash bucket a stratum's cut falls in; only that bucket,
    1/65536 of a stratum, is ranked, and only to find the cut.  Every row is then
    compared with the cut of its stratum: no join by key, and no shuffle of the rows
    while the strata are few.  Rows of a null stratum are never picked; rows that
    repeat the key at the cut are picked with it.
    """
    rows = df.withColumn("_h", hash_unit(key, F.lit(seed))).withColumn("_b", F.floor(F.col("_h") * _BUCKETS).cast("int"))
    counts = durable(rows.where(F.col(stratum).isNotNull()).groupBy(stratum, "_b").agg(F.count(F.lit(1)).alias("_c")))
    want = wanted(counts.groupBy(stratum).agg(F.sum("_c").alias("_n")))
    before = Window.partitionBy(stratum).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0))).join(want, stratum)
    edge = counts.where((F.col("_before") < F.col("_want")) & (F.col("_before") + F.col("_c") >= F.col("_want")))
    edge = durable(edge.select(stratum, F.col("_b").alias("_edge"), (F.col("_want") - F.col("_before")).alias("_rest")))
    at_edge = rows.select(stratum, key, "_h", "_b").join(edge, stratum).where(F.col("_b") == F.col("_edge"))
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy("_h", key))
    last = at_edge.withColumn("_r", rank).where(F.col("_r") == F.col("_rest"))
    cuts = durable(last.select(stratum, F.struct("_h", F.col(key).alias("_k")).alias("_cut")))
    placed = rows.join(cuts, stratum, "left")
    picked = F.col("_cut").isNotNull() & (F.struct("_h", F.col(key).alias("_k")) <= F.col("_cut"))
    return placed.select(*df.columns, picked.alias(output))


def test_sizes(classes: DataFrame, target: str, percent: float = TEST_PERCENT) -> DataFrame:
    """(target, _want) from (target, _n): test rows per class, shares kept, largest remainders first."""
    everything = Window.partitionBy(F.lit(0))
    total = F.sum("_n").over(everything)
    ideal = F.ceil(F.round(total * percent / 100, 9)) * F.col("_n") / total
    sized = classes.withColumn("_ideal", ideal).withColumn("_floor", F.floor(F.col("_ideal") + 1e-9))
    left = F.round(F.sum("_ideal").over(everything)) - F.sum("_floor").over(everything)
    rank = F.row_number().over(everything.orderBy(F.desc(F.col("_ideal") - F.col("_floor")), target))
    return sized.select(target, (F.col("_floor") + (rank <= left).cast("long")).alias("_want"))


def stratified_split(df: DataFrame, key: str, target: str, percent: float = TEST_PERCENT, seed: int = SEED) -> DataFrame:
    """Add ``is_test``: exact class counts, rows chosen by hash of key and seed."""
    return pick_by_hash(df, target, key, lambda classes: test_sizes(classes, target, percent), seed, "is_test")


def repeated_splits(df: DataFrame, key: str, target: str, percent: float = TEST_PERCENT, repeats: int = REPEATS, seed: int = SEED):
    for i in range(repeats):
        yield stratified_split(df, key, target, percent, seed + i)


def oversample(df: DataFrame, key: str, target: str, vector: str, share: float = MINORITY_SHARE, seed: int = SEED) -> DataFrame:
    """Interpolate minority rows until they reach ``share`` of the majority.

    Applies when the positive share is at most 5 %.  Returns (key as text, target,
    vector, synthetic); a synthetic row lies between a minority row and one of its
    nearest minority neighbours.
    """
    counts = {r[target]: r["count"] for r in df.groupBy(target).count().collect()}
    rows = df.select(F.col(key).cast("string").alias(key), target, F.col(vector).alias(vector), F.lit(False).alias("synthetic"))
    if len(counts) != 2 or counts.get(1, 0) / sum(counts.values()) > MINORITY_SHARE:
        return rows
    minority = min(counts, key=counts.get)
    have, majority = counts[minority], max(counts.values())
    needed = -(-int(round(share * majority * 1e6)) // 1_000_000) - have
    k = min(SMOTE_NEIGHBOURS, have - 1)
    if needed <= 0 or k < 1:
        return rows
    small = df.where(F.col(target) == minority).select(key, vector)
    each, extra = divmod(needed, have)
    one = small.withColumn("_one", F.lit(1))
    picked = pick_by_hash(one, "_one", key, lambda all_: all_.select("_one", F.lit(extra).alias("_want")), f"extra{seed}", "_extra") if extra else one.withColumn("_extra", F.lit(False))
    copies = F.lit(each) + F.col("_extra").cast("int")
    seeds = picked.where(copies > 0).select(key, F.col(vector).alias("_v"), F.explode(F.sequence(F.lit(1), copies)).alias("_i"))
    found = nearest(small, small, key, vector, k)
    found = found.join(small.select(F.col(key).alias("neighbour"), F.col(vector).alias("neighbour_vector")), "neighbour")
    near = found.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("distance", "neighbour", "neighbour_vector"))).alias("_near"))
    made = seeds.join(near, key)
    choice = F.floor(hash_unit(key, "_i", F.lit(f"pick{seed}")) * F.size("_near")).cast("int")
    gap = hash_unit(key, "_i", F.lit(f"gap{seed}"))
    mixed = F.zip_with("_v", F.get("_near", choice)["neighbour_vector"], lambda a, b: a + (b - a) * F.col("_gap"))
    synthetic = made.withColumn("_gap", gap).select(
        F.concat(F.lit("synthetic:"), F.col(key).cast("string"), F.lit(":"), F.col("_i").cast("string")).alias(key),
        F.lit(minority).cast(dict(df.dtypes)[target]).alias(target), mixed.alias(vector), F.lit(True).alias("synthetic"),
    )
    return rows.unionByName(synthetic)


def clean_by_neighbours(df: DataFrame, key: str, target: str, vector: str, k: int = CLEAN_NEIGHBOURS) -> DataFrame:
    """Drop rows any of whose ``k`` nearest neighbours has another class."""
    found = nearest(df, df, key, vector, k)
    classes = df.select(F.col(key).alias("neighbour"), F.col(target).alias("_c"))
    judged = found.join(classes, "neighbour").groupBy(key).agg(F.min("_c").alias("_lo"), F.max("_c").alias("_hi"))
    out = df.join(judged, key, "left")
    agrees = (F.col("_lo") == F.col(target)) & (F.col("_hi") == F.col(target))
    return out.where(F.col("_lo").isNull() | agrees).select(*df.columns)


def balanced(df: DataFrame, key: str, target: str, vector: str) -> DataFrame:
    """Oversample at a positive share up to 5 %, and clean up as well up to 1 %."""
    share = df.agg(F.avg(F.col(target).cast("double"))).first()[0] or 0.0
    out = oversample(df, key, target, vector)
    return clean_by_neighbours(out, key, target, vector) if share <= CLEAN_SHARE else out
