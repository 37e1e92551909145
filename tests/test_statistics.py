"""Benford, IQR, LOF and distribution operators against plain numpy definitions."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskframe.operators import benford, distributions, lof, outlier, scaling


def brute_lof(x, k):
    """Textbook LOF with ties in distance going to the lower position."""
    order = np.argsort(x, kind="stable")
    v = np.asarray(x)[order]
    n = len(v)
    near = [sorted((abs(v[i] - v[j]), j) for j in range(n) if j != i)[:k] for i in range(n)]
    kdist = [nb[-1][0] for nb in near]
    lrd = [1 / (np.mean([max(d, kdist[j]) for d, j in nb]) + 1e-10) for nb in near]
    out = np.empty(n)
    out[order] = [np.mean([lrd[j] for _, j in near[i]]) / lrd[i] for i in range(n)]
    return out


@pytest.mark.parametrize("block, slice_rows", [(50_000, 1_000_000), (61, 30)])
def test_lof_is_exact(spark, block, slice_rows):
    rng = np.random.default_rng(3)
    rows = pd.DataFrame(
        {"id": range(460), "k": ["a"] * 400 + ["b"] * 57 + ["c"] * 3,
         "x": np.concatenate([np.round(rng.normal(50, 20, 300)), np.full(60, 7.0), rng.uniform(0, 500, 40), rng.normal(size=57), [1, 2, 3]])}
    )
    df = spark.createDataFrame(rows).repartition(5)
    got = lof.with_lof(df, ["k"], "x", gate=False, slice_rows=slice_rows, block=block).toPandas().sort_values("id")
    for key, part in rows.groupby("k"):
        mine = got[got.k == key].lof.to_numpy()
        if len(part) < 5:
            assert (mine == 0).all()
            continue
        raw = brute_lof(part.x.to_numpy(), min(20, max(2, len(part) // 2)))
        want = (raw - raw.min()) / (raw.max() - raw.min())
        assert np.allclose(mine, want, atol=1e-7)


def test_lof_gate_and_nulls(spark):
    rng = np.random.default_rng(5)
    rows = pd.DataFrame({"k": ["n"] * 400 + ["u"] * 400, "x": np.concatenate([np.abs(rng.normal(10, 6, 400)), rng.uniform(-1, 1, 400)])})
    df = spark.createDataFrame(rows).unionByName(spark.createDataFrame([("u", None)], "k string, x double"))
    got = lof.with_lof(df, ["k"], "x").toPandas()
    assert len(got) == 801 and got.lof.between(0, 1).all()
    assert (got[got.k == "u"].lof == 0).all()


def test_benford_by_hand(spark):
    values = [11.0] * 40 + [12.5] * 5 + [13.0] * 3 + [9.5] * 20 + [0.0, -11.0]
    df = spark.createDataFrame([("g", v) for v in values] + [("small", 11.0)] * 49 + [("g", None)], "g string, x double")
    got = benford.with_benford_scores(df, ["g"], "x").toPandas()
    n = 68

    def excess(count, d):
        b = math.log10(1 + 1 / d) if d >= 10 else 0.0
        a = max(0.0, count / n - (b + 2.3263 * math.sqrt(b * (1 - b) / n)))
        return a if count >= max(5, 0.01 * n) else 0.0

    top = max(excess(40, 11), excess(5, 12), excess(20, 9))
    score = {v: round((excess(c, int(v)) / top) ** 2, 3) for v, c in ((11.0, 40), (12.5, 5))}
    assert set(got[(got.g == "g") & (got.x == 11.0)].benford) == {score[11.0]}
    assert set(got[(got.g == "g") & (got.x == 12.5)].benford) == {score[12.5]}
    assert (got[(got.x == 9.5) | (got.x <= 0) | got.x.isna() | (got.g == "small")].benford == 0).all()


def test_out_of_range_digit_can_be_the_maximum(spark):
    df = spark.createDataFrame([(9.0,)] * 60 + [(11.0,)] * 40, "x double")
    got = benford.with_benford_scores(df, [], "x").groupBy("x").agg(F.max("benford").alias("b")).toPandas().set_index("x").b
    b = math.log10(1 + 1 / 11)
    a = 0.4 - (b + 2.3263 * math.sqrt(b * (1 - b) / 100))
    assert got[9.0] == 0 and got[11.0] == round((a / 0.6) ** 2, 3)


def test_first_digits(spark):
    cases = {0.4: 0, 9.99: 9, 10.0: 10, -123.4: 12, 987654.3: 98, 1e16: 10}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "x double")
    got = {r.x: r.d for r in df.select("x", benford.first_digits("x").alias("d")).collect()}
    assert got == {**cases, None: 0}


def test_chi_square_critical_values():
    table = benford.critical_values(0.01, 90)
    assert table[0] == pytest.approx(6.6349, abs=1e-3)
    assert table[9] == pytest.approx(23.2093, abs=1e-3)
    assert table[88] == pytest.approx(122.942, abs=1e-2)


def test_iqr_by_hand(spark):
    rows = [(float(v),) for v in (1, 2, 3, 4, 5, 6, 7, 8, 9, -100)] + [(None,)]
    df = spark.createDataFrame(rows, "x double")
    got = {r.x: r.iqr for r in outlier.with_iqr_outliers(df, [], "x").collect()}
    assert got.pop(-100.0) == 1 and set(got.values()) == {0}
    scored = {r.x: r.iqr for r in outlier.with_iqr_outliers(df, [], "x", confidence=True).collect()}
    assert scored[-100.0] == pytest.approx(1 - np.mean([0.01 * v for v in range(1, 10)] + [1]))
    zero = spark.createDataFrame([(0.0,)] * 6, "x double")
    assert {r.iqr for r in outlier.with_iqr_outliers(zero, [], "x").collect()} == {0}


@pytest.mark.parametrize("slices", [50, 4_000_000])
def test_distribution_classes(spark, slices):
    rng = np.random.default_rng(42)
    n = 1500
    samples = {
        "Normal": rng.normal(size=n), "Uniform": rng.uniform(size=n), "Right skewed": rng.exponential(size=n),
        "Left skewed": -rng.exponential(size=n),
        "Multimodal": np.concatenate([rng.normal(-20, 1, n // 3), rng.normal(2, 1, n // 3), rng.normal(15, 1, n // 3)]),
        "Degenerate": np.ones(20),
    }
    rows = pd.concat([pd.DataFrame({"k": k, "x": v}) for k, v in samples.items()])
    df = spark.createDataFrame(rows).unionByName(spark.createDataFrame([("Unknown", None)], "k string, x double"))
    got = {r.k: r.distribution for r in distributions.classify(df, ["k"], "x").collect()}
    assert got == {**{k: k for k in samples}, "Unknown": "Unknown"}
    ks = distributions.uniformity(df.where("k = 'Uniform'"), ["k"], "x", slices).first()
    u = np.sort((samples["Uniform"] - samples["Uniform"].min()) / np.ptp(samples["Uniform"]))
    i = np.arange(1, n + 1)
    assert ks.ks_distance == pytest.approx(max((i / n - u).max(), (u - (i - 1) / n).max()))


def test_standardize(spark):
    rng = np.random.default_rng(1)
    rows = pd.DataFrame({"k": ["r"] * 800 + ["u"] * 800, "x": np.concatenate([rng.exponential(size=800), rng.uniform(size=800)])})
    got = distributions.standardize(spark.createDataFrame(rows), ["k"], "x", "z").toPandas()
    for _, part in got.groupby("k"):
        assert part.z.mean() == pytest.approx(0, abs=1e-6) and part.z.std(ddof=0) == pytest.approx(1, abs=1e-6)
        assert (part.sort_values("x").z.diff().dropna() >= -1e-12).all()


def test_discretize_against_numpy(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(100, 30, 700), 2)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "one": 5.0, "flag": (x > 100).astype(float)}))
    got = scaling.discretize(df, ["x", "one", "flag"]).toPandas()
    iqr = np.quantile(x, 0.75) - np.quantile(x, 0.25)
    bins = int(np.ceil((x.max() - x.min() + 1e-6) / (2 * iqr / len(x) ** (1 / 3) + 1e-6)) + 1)
    edges = np.linspace(x.min(), x.max(), bins + 1)
    want = pd.cut(got.x, edges, labels=False, include_lowest=True)
    assert (got.x_bin == want).mean() > 0.995 and (got.x_bin - want).abs().max() <= 1  # float edges
    assert (got.one_bin == 0).all() and (got.flag_bin == got.flag).all()


def test_lambda_lies_wherever_the_likelihood_says(spark):
    """Values made by the inverse transform of normal ones, for powers far outside the first grid."""
    z, made = np.random.default_rng(11).normal(0, 0.25, 20_000), {}
    for power in (-9.0, -1.5, 0.0, 2.0, 9.0):
        y = z / max(1.0, abs(power), abs(2 - power))  # within the transform's range
        up = np.expm1(np.log1p(np.maximum(y, 0) * power) / power) if power else np.expm1(np.maximum(y, 0))
        down = 2 - power
        low = -np.expm1(np.log1p(np.maximum(-y, 0) * down) / down) if down else -np.expm1(np.maximum(-y, 0))
        made[str(power)] = np.where(y >= 0, up, low)
    made["one"] = np.array([5.0, 5.0])
    df = spark.createDataFrame(pd.concat([pd.DataFrame({"g": g, "v": v}) for g, v in made.items()])).repartition(4)
    found = {r.g: r.lam for r in distributions.yeo_johnson_lambdas(df, ["g"], "v").collect()}

    def likelihood(v, lam):
        a, b = np.maximum(v, 0), np.maximum(-v, 0)
        up = np.log1p(a) if abs(lam) < 1e-12 else np.expm1(lam * np.log1p(a)) / lam
        down = np.log1p(b) if abs(lam - 2) < 1e-12 else np.expm1((2 - lam) * np.log1p(b)) / (2 - lam)
        return -len(v) / 2 * np.log(np.var(np.where(v >= 0, up, -down))) + (lam - 1) * np.sum(np.sign(v) * np.log1p(np.abs(v)))

    assert "one" not in found, "a single value has no lambda"
    for power in (-9.0, -1.5, 0.0, 2.0, 9.0):
        v, lam = made[str(power)], found[str(power)]
        assert abs(lam - power) < max(0.3, abs(power) * 0.1)
        best = likelihood(v, lam)
        assert all(likelihood(v, lam + d) <= best + 1e-6 for d in (-0.5, -0.01, -0.001, 0.001, 0.01, 0.5))


def test_lambda_of_far_values_keeps_its_digits(spark):
    """Values of one sign whose transform lies within rounding of its limit."""
    v = (1 + np.random.default_rng(2).normal(0, 0.02, 3000)) ** (-1 / 7.0) * 60 - 1
    found = distributions.yeo_johnson_lambdas(spark.createDataFrame([("g", float(x)) for x in v], "g string, v double"), ["g"], "v").first()
    assert -60 < found.lam < 60 and found.lam != 0.0
