"""Operators whose cost must not follow the largest group, the widest table or the strangest word."""

import unicodedata
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from riskframe.functions import text
from riskframe.ml import split
from riskframe.operators import entity, reduce, similarity
from riskframe.prep import select


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_duplicate_counts_against_brute_force(spark):
    rows = [(i, e, a, d) for i, (e, a, d) in enumerate(
        [("x", 1.0, "d1"), ("x", 1.0, "d1"), ("x", 1.0, "d2"), ("y", 2.5, "d1"), (None, 1.0, "d1"), (None, 1.0, "d1"),
         ("x", None, "d1"), ("x", 1.0, None), ("z", 4.0, None), ("x", 1.0, None), ("y", 7.0, "d9")])]
    df = spark.createDataFrame(rows, "id int, e string, a double, d string")
    out = entity.with_duplicate_counts(df, "e", "a", "d", "same", "again", "total").orderBy("id").collect()
    for r in out:
        pair = [q for q in rows if q[1:3] == (r.e, r.a)] if r.e is not None and r.a is not None else None
        assert r.again == (len(pair) if pair else None) and r.total == (sum(q[2] for q in pair) if pair else None)
        assert r.same == (len([q for q in pair if q[3] == r.d]) if pair and r.d is not None else None)
    assert len(out) == len(rows)
    assert entity.with_duplicate_counts(df.limit(0), "e", "a", "d", "same", "again", "total").count() == 0


def test_duplicate_counts_of_lone_rows_write_no_group(spark):
    alone = spark.range(3000).select(F.col("id").alias("e"), F.col("id").cast("decimal(12,2)").alias("a"), F.lit("d").alias("d"))
    out = entity.with_duplicate_counts(alone, "e", "a", "d", "same", "again", "total")
    assert "decimal(22,2)" in dict(out.dtypes)["total"]
    assert out.where("same = 1 and again = 1 and total = a").count() == 3000
    assert "SortMergeJoin" not in plan(out), "a table of no group is looked up by broadcast"


def test_split_compares_with_a_cut_and_moves_no_row(spark):
    df = spark.range(20_000).select("id", F.when(F.col("id") % 50 == 0, 1).when(F.col("id") % 999 != 1, 0).alias("y"))
    out = split.stratified_split(df, "id", "y")
    assert "Exchange hashpartitioning" not in plan(out) and "SortMergeJoin" not in plan(out)
    got = out.toPandas()
    known = got[got.y.notna()]
    share = known[known.is_test].groupby("y").size()
    assert share[1.0] == 80 and share.sum() == -(-len(known) // 5) and not got[got.y.isna()].is_test.any()
    hashes = df.select("id", split.hash_unit("id", F.lit(split.SEED)).alias("h")).toPandas().h.to_numpy()
    for y in (0.0, 1.0):
        mine = known[known.y == y].assign(h=hashes[known[known.y == y].id])
        assert mine[mine.is_test].h.max() < mine[~mine.is_test].h.min()


def test_group_larger_than_a_task_should_hold_is_streamed(spark):
    big = spark.range(1_200_000).select(F.when(F.col("id") % 100 > 0, "hot").otherwise("cold").alias("g"), F.col("id").alias("v"))

    def running(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = total = most = 0
        for frame in frames:
            g, rows, total, most = frame.g[0], rows + len(frame), total + int(frame.v.sum()), max(most, len(frame))
        yield pd.DataFrame({"g": [g], "rows": [rows], "total": [total], "most": [most]})

    got = {r.g: r for r in reduce.grouped_apply(big, ["g"], running, "g string, rows long, total long, most long").collect()}
    assert got["hot"].rows == 1_188_000 and got["cold"].rows == 12_000
    assert got["hot"].total + got["cold"].total == sum(range(1_200_000)) and got["hot"].most <= 10_000


def test_merged_group_reaches_its_task_reduced(spark):
    keys = [2**60 + 1, 2**60 + 3, None]
    df = spark.createDataFrame([(keys[i % 3], i) for i in range(3000)], "k long, v long").repartition(5)

    def part(frame):
        return pd.DataFrame({"k": frame.k.iloc[:1], "rows": [len(frame)], "total": [frame.v.sum()]})

    def whole(frame):
        assert len(frame) <= 5, "one row of each task"
        return pd.DataFrame({"k": frame.k.iloc[:1], "rows": [frame.rows.sum()], "total": [frame.total.sum()]})

    out = reduce.grouped_apply(df, ["k"], whole, "k long, rows long, total long", part, "k long, rows long, total long")
    assert {tuple(r) for r in out.collect()} == {(k, 1000, sum(range(i, 3000, 3))) for i, k in enumerate(keys)}


def _information(a, b):
    pairs = pd.DataFrame({"a": a, "b": b}).dropna()
    p = pairs.groupby(["a", "b"]).size() / len(pairs)
    pa_, pb = pairs.a.value_counts(normalize=True), pairs.b.value_counts(normalize=True)
    return sum(v * np.log(v / (pa_[x] * pb[y])) for (x, y), v in p.items())


def test_joint_counts_in_blocks(spark):
    rng = np.random.default_rng(3)
    made = pd.DataFrame({"a": rng.integers(0, 4, 900), "b": rng.integers(0, 900, 900), "c": rng.integers(0, 3, 900)}).astype("float64")
    made.loc[::7, "a"] = np.nan
    df = spark.createDataFrame(made).select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in made]).repartition(3)
    cells = select.joint_counts(df, list(made), block_values=150).collect()
    names = list(made)
    for i, j in combinations_with_replacement(range(3), 2):
        both = made[[names[i], names[j]]].dropna()
        expected = pd.Series(zip(both.iloc[:, 0], both.iloc[:, 1])).value_counts().to_dict()
        assert {(r.x, r.y): r.c for r in cells if (r.i, r.j) == (i, j)} == expected
    for r in select.mutual_information(df, names).collect():
        assert abs(r.mutual_information - _information(made[r.feature1], made[r.feature2])) < 1e-9
    assert select.mutual_information(df.limit(0), names).count() == 0


def test_joint_counts_of_200_columns_do_not_explode_rows(spark):
    wide = spark.range(4000).select(*[(F.xxhash64("id", F.lit(i)) % 3).alias(f"c{i}") for i in range(200)])
    cells = select.joint_counts(wide, wide.columns)
    sent = plan(cells)
    assert "Generate" not in sent and sent.count("Exchange hashpartitioning") == 1
    total = cells.groupBy("i", "j").agg(F.sum("c").alias("n")).where("n = 4000").count()
    assert total == 200 * 201 // 2


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_closest_word_of_any_kind(spark):
    rng = np.random.default_rng(5)
    entries = ["".join(rng.choice(list("abcd"), n)) for n in rng.integers(1, 12, 120)] + ["a" * 30]
    words = ["".join(rng.choice(list("abcde"), n)) for n in rng.integers(1, 14, 80)] + ["z" * 60, "ab" * 12]
    df = similarity.closest_words(
        spark.createDataFrame([(w,) for w in words], "w string"), "w", spark.createDataFrame([(e,) for e in entries], "e string"), "e")
    got = {r.w: (r.distance, r.closest) for r in df.collect()}
    assert got == {w: min((_distance(w, e), e) for e in entries) for w in words}


def test_closest_word_plan_is_the_same_at_every_distance(spark):
    words, entries = spark.createDataFrame([("abc",)], "w string"), spark.createDataFrame([("abd",)], "e string")
    sizes = [len(similarity._closest_within(words, "w", entries, "e", d)._jdf.queryExecution().optimizedPlan().toString()) for d in (2, 30)]
    assert sizes[1] < sizes[0] * 1.1


def test_script_table_holds_every_character(spark):
    codes = [c for c in range(0x110000) if c % 97 == 0 or c < 0x500]
    codes = [c for c in codes if not 0xD800 <= c < 0xE000 and c]
    df = spark.createDataFrame([(chr(c),) for c in codes], "t string")
    out = df.select("t", F.lower("t").alias("low"), text.script("t").alias("s"))
    assert "Python" not in plan(out) and "Arrow" not in plan(out)
    for r in out.collect():
        rest = "".join(c for c in r.low if c != " " and not "a" <= c <= "z")
        assert r.s == (unicodedata.name(rest[0], "LATIN").split(" ")[0] if rest else "LATIN"), r
    blank = spark.createDataFrame([(None,), ("",), ("a b",), ("a \U0001F600",)], "t string").select(text.script("t").alias("s"))
    assert [r.s for r in blank.collect()] == ["LATIN", "LATIN", "LATIN", "GRINNING"]
