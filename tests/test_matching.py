"""Similarity groups and two-way match against the sequential definitions."""

import math
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskframe.ml import neighbours
from riskframe.operators import matching, similarity


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def greedy_groups(rows, share, only_max):
    """The sequential rule: keys descending, each unclaimed key claims what it finds."""
    data = {k: re.sub("[^a-zA-Z0-9 ]", " ", t).lower().split() for k, t in rows}
    claimed, result = set(), {}
    for key in sorted(data, reverse=True):
        if key in claimed:
            continue
        need = math.ceil(round(len(data[key]) * share, 9))
        found = {
            k: jaccard(set(data[key]), set(w)) for k, w in data.items() if k not in claimed and k != key and len(w) >= need
        }
        if not found:
            continue
        limit = max(share, max(found.values())) if only_max else share
        similar = [k for k, s in found.items() if s >= limit - 1e-12]
        if similar:
            claimed.update([key, *similar])
            result.update({k: key for k in [key, *similar]})
    return {k: result.get(k) for k in data}


def names(seed, n=120):
    rng = random.Random(seed)
    words = ["acme", "global", "trade", "supply", "north", "ltd", "gmbh", "co", "steel", "tools"]
    out = []
    for i in range(n):
        base = rng.sample(words, rng.randint(2, 5))
        if rng.random() < 0.2:
            base.append(base[0])  # repeats count as words, not in the set
        out.append((f"V{i:04d}", " ".join(base)))
    return out + [(f"C{i:03d}", "acme global trade ltd") for i in range(60)]


@pytest.mark.parametrize("seed, share, posting", [(1, 0.75, 1000), (2, 0.5, 1000), (3, 0.6, 3)])
def test_similar_groups(spark, seed, share, posting):
    rows = names(seed)
    df = spark.createDataFrame(rows, "id string, name string").repartition(3)
    got = {r.id: r.similar_key for r in similarity.similar_groups(df, "id", "name", share, posting_limit=posting).collect()}
    assert got == greedy_groups(rows, share, False)


def test_similar_groups_closest_only(spark):
    rows = names(4, 60)
    df = spark.createDataFrame(rows, "id string, name string")
    got = {r.id: r.similar_key for r in similarity.similar_groups(df, "id", "name", 0.5, only_max=True).collect()}
    assert got == greedy_groups(rows, 0.5, True)


def test_settling_takes_few_rounds_in_chains(spark, monkeypatch):
    """A chain of 10 000, a tree, and random claims settle as one after another would; chains in logarithmically many rounds."""
    rng, written, real = random.Random(6), [], similarity.durable
    monkeypatch.setattr(similarity, "durable", lambda df: written.append(1) or real(df))

    def settled(n, edges):
        name = "{:06d}".format
        nodes = spark.range(n).select(F.format_string("%06d", "id").alias("sid"))
        written.clear()
        frame = spark.createDataFrame([(name(a), name(b)) for a, b in edges] + [(name(b), name(a)) for a, b in edges[:50]], "a string, b string")
        got = {r["sid"] for r in similarity._settle(frame, nodes).collect()}
        before, anchors = {}, set()
        for a, b in edges:
            before.setdefault(b, []).append(a)
        for node in range(n - 1, -1, -1):
            if not anchors.intersection(before.get(node, ())):
                anchors.add(node)
        assert got == {name(a) for a in anchors}
        return (len(written) - 3) / 5

    assert settled(10_000, [(i + 1, i) for i in range(9_999)]) <= 16
    assert settled(3_000, [(rng.randrange(i + 1, min(i + 4, 3_000)), i) for i in range(2_999)]) <= 16
    settled(300, sorted({tuple(sorted(rng.sample(range(300), 2), reverse=True)) for _ in range(500)}))
    settled(60, [(i + d, i) for i in range(60) for d in (1, 2) if i + d < 60])
    settled(20, [])


def lines(rng, n, prefix):
    return [
        (f"{prefix}{i}", rng.choice(["steel bolt", "steel nut", "red paint", "blue paint"]), float(rng.randint(50, 90)), float(rng.randint(1, 4)))
        for i in range(n)
    ]


def greedy_match(invoice, po):
    def diff(a, b):
        return round((b - a) / a * 100, 2)

    def lev(a, b):
        prev = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            cur = [i]
            for j, y in enumerate(b, 1):
                cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
            prev = cur
        return prev[-1]

    pairs = []
    for i in invoice:
        for p in po:
            text = 100 - round(100 * (1 - lev(i[1], p[1]) / max(len(i[1]), len(p[1]))))
            cents = abs(diff(i[2], p[2])) * 25 + abs(diff(i[3], p[3])) * 25 + text * 50
            pairs.append((math.floor(cents + 0.5 + 1e-9) / 100, i[0], p[0]))
    used, total, out = set(), 0, []
    for w, i, p in sorted(pairs):
        if i not in used and p not in used:
            used |= {i, p}
            out.append((i, p, w))
    return out


def test_two_way_match(spark):
    """Every pair, ties included, for ordinary orders and one far larger; equal lines recur in all of them."""
    rng = random.Random(9)
    inv, po, want = [], [], set()
    for d, (n, m) in enumerate([(12, 14), (5, 3), (90, 120), (1, 1)]):
        i, p = lines(rng, n, "i"), lines(rng, m, "p")
        inv += [(100 + d, d, *x) for x in i]
        po += [(d, *x) for x in p]
        want |= {(100 + d, *pair) for pair in greedy_match(i, p)}
    item = "item_id string, item_description string, item_amount double, item_quantity double"
    invoices = spark.createDataFrame(inv, f"invoice_id long, po_id long, {item}")
    orders = spark.createDataFrame(po, f"po_id long, {item}")
    assert matching.scored_pairs(invoices, orders).count() == 12 * 14 + 5 * 3 + 90 * 120 + 1
    got = matching.two_way_match(invoices, orders).select("invoice_id", "item_id_invoice", "item_id_po", "weighted_diff")
    assert {tuple(r) for r in got.collect()} == want


def test_two_way_match_of_equal_lines(spark, monkeypatch):
    """Thousands of equal lines take no more steps than two, and ties between different classes interleave."""
    item = "item_id string, item_description string, item_amount double, item_quantity double"
    rng, inv, po, want = random.Random(4), [], [], set()
    for d in range(12):
        # Amounts above and below by as much are equally far: classes that differ tie.
        kinds = [("same", 90.0, 1.0), ("same", 110.0, 1.0), ("same", 100.0, 1.0), ("same", 100.0, None), ("other", 100.0, 1.0)]
        i = [(f"i{n:03}", *rng.choice(kinds)) for n in rng.sample(range(999), rng.randint(1, 14))]
        p = [(f"p{n:03}", *rng.choice(kinds)) for n in rng.sample(range(999), rng.randint(1, 14))]
        inv += [(100 + d, d, *x) for x in i] + [(500 + d, d, *x) for x in i[:3]]
        po += [(d, *x) for x in p]
    invoices, orders = spark.createDataFrame(inv, f"invoice_id long, po_id long, {item}"), spark.createDataFrame(po, f"po_id long, {item}")
    pairs = matching.scored_pairs(invoices, orders).select("weighted_diff", "item_id_invoice", "item_id_po", "invoice_id").collect()
    used = set()
    for w, a, b, group in sorted(tuple(r) for r in pairs):
        if (group, 0, a) not in used and (group, 1, b) not in used:
            used |= {(group, 0, a), (group, 1, b)}
            want.add((group, a, b, w))
    got = matching.two_way_match(invoices, orders).select("invoice_id", "item_id_invoice", "item_id_po", "weighted_diff").collect()
    assert {tuple(r) for r in got} == want

    steps, matched = [], matching._matched
    monkeypatch.setattr(matching, "_matched", lambda *a: steps.append(1) or matched(*a))
    rows = spark.range(5000).select(F.lit(1).alias("po_id"), F.format_string("%05d", "id").alias("item_id"), F.lit("bolt").alias("item_description"),
                                    F.lit(9.5).alias("item_amount"), F.lit(2.0).alias("item_quantity"))
    got = matching.two_way_match(rows.where("item_id < '04000'").withColumn("invoice_id", F.lit(7)), rows).agg(
        F.count(F.lit(1)), F.count_if(F.col("item_id_invoice") == F.col("item_id_po"))
    )
    assert tuple(got.first()) == (4000, 4000) and len(steps) <= 2
    assert matching.two_way_match(rows.where("false").withColumn("invoice_id", F.lit(7)), rows).count() == 0


def test_closest_words(spark):
    entries = ["invoice", "payment", "vendor", "order", "an", "to"]
    words = ["invoce", "paymnet", "vndr", "ordder", "xyzzyx", "a"]
    df = similarity.closest_words(
        spark.createDataFrame([(w,) for w in words], "w string"), "w", spark.createDataFrame([(e,) for e in entries], "e string"), "e"
    )
    got = {r.w: (r.closest, r.distance) for r in df.collect()}
    assert got == {"invoce": ("invoice", 1), "paymnet": ("payment", 2), "vndr": ("vendor", 2), "ordder": ("order", 1), "a": ("an", 1), "xyzzyx": ("an", 6)}


def all_distances(queries, base, k):
    """The ``k`` nearest of every query by comparing it with every row, ties to the lower key."""
    out = {}
    for q, v in queries:
        near = sorted((sum((x - y) ** 2 for x, y in zip(v, w)) ** 0.5, b) for b, w in base if b != q)[:k]
        out[q] = [(b, d) for d, b in near]
    return out


def listed(frame, key="id"):
    out = {}
    for r in frame.collect():
        out.setdefault(r[key], []).append((r["neighbour"], r["distance"]))
    return {q: sorted(v, key=lambda p: (p[1], p[0])) for q, v in out.items()}


@pytest.mark.parametrize("cell, block", [(256, 4096), (10, 8)])
@pytest.mark.parametrize("width, levels", [(1, 9), (2, 4), (6, 1000)])
def test_nearest_is_exact(spark, monkeypatch, cell, block, width, levels):
    """Many cells and blocks or one of each; ties, repeated vectors, keys beyond 2^53, and a far cluster."""
    for name, value in (("CELL", cell), ("BLOCK_POINTS", block), ("BLOCK_QUERIES", block)):
        monkeypatch.setattr(neighbours, name, value)
    rng = np.random.default_rng(width)
    rows = [(2**60 + int(i), [float(x) for x in rng.integers(0, levels, width)]) for i in rng.permutation(150)]
    rows += [(int(i), [1e6 + float(x) for x in rng.integers(0, levels, width)]) for i in range(40)]
    asked = rows[::3] + [(-5, [500.0] * width), (-6, list(rows[0][1]))]
    schema = "id long, v array<double>"
    base, queries = spark.createDataFrame(rows, schema).repartition(3), spark.createDataFrame(asked, schema)
    assert listed(neighbours.nearest(queries, base, "id", "v", 4)) == all_distances(asked, rows, 4)


def test_nearest_few_rows_text_keys_and_none(spark):
    rows = [("b", [0.0]), ("a", [0.0]), ("é", [0.0]), ("c", [1.0]), ("d", None)]
    df = spark.createDataFrame(rows, "id string, v array<double>")
    got = listed(neighbours.nearest(df, df, "id", "v", 2))
    assert got == all_distances(rows[:4], rows[:4], 2) and len(listed(neighbours.nearest(df, df, "id", "v", 9))["a"]) == 3
    assert neighbours.nearest(df, df.where("false"), "id", "v", 2).collect() == []
    assert neighbours.nearest(df.where("false"), df, "id", "v", 2).collect() == []


def test_nearest_finds_all_true_neighbours_of_whole_embeddings(spark, monkeypatch):
    """2000 vectors of 64 numbers, in cells and in blocks: recall 1."""
    monkeypatch.setattr(neighbours, "BLOCK_POINTS", 200)
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    rows = df.toPandas()
    points, ids = np.stack(rows["embedding"]).astype(float), rows["vec_id"].to_numpy()
    got = listed(neighbours.nearest(df, df, "vec_id", "embedding", 3), "vec_id")
    assert len(got) == len(ids)
    for i in range(len(ids)):
        d = np.sqrt(((points - points[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        assert {n for n, _ in got[ids[i]]} == set(ids[np.argsort(d)[:3]].tolist())


def test_prefix_filter_misses_nothing(spark):
    rows = names(11, 80)
    got = similarity.similar_pairs(spark.createDataFrame(rows, "id string, name string"), "id", "name", 0.5).toPandas()
    best = {}
    for k, t in rows:
        w = t.split()
        sig = (tuple(sorted(set(w))), len(w))
        best[sig] = max(best.get(sig, k), k)
    want = {
        (max(a, b), min(a, b)) for sa, a in best.items() for sb, b in best.items() if a != b and jaccard(set(sa[0]), set(sb[0])) >= 0.5
    }
    assert set(zip(got.a, got.b)) == want
    assert isinstance(got, pd.DataFrame)


def test_ordinary_orders_are_matched_in_one_pass(spark, monkeypatch):
    """No steps for orders of few pairs; the steps on classes give the same match, and so do both side by side."""
    rng, inv, po = random.Random(7), [], []
    for d in range(30):
        inv += [(100 + d, d, *x) for x in lines(rng, rng.randint(1, 7), "i")] + [(500 + d, d, *x) for x in lines(rng, 2, "i")]
        po += [(d, *x) for x in lines(rng, rng.randint(1, 7), "p")]
    item = "item_id string, item_description string, item_amount double, item_quantity double"
    invoices, orders = spark.createDataFrame(inv, f"invoice_id long, po_id long, {item}"), spark.createDataFrame(po, f"po_id long, {item}")
    steps, matched = [], matching._matched
    monkeypatch.setattr(matching, "_matched", lambda *a: steps.append(1) or matched(*a))

    def match():
        return {tuple(r) for r in matching.two_way_match(invoices, orders).collect()}

    whole = match()
    assert whole and not steps
    for pairs in (0, 20):
        monkeypatch.setattr(matching, "WHOLE_ORDER_PAIRS", pairs)
        assert match() == whole and steps
