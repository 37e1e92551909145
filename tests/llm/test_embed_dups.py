"""Near-duplicate vectors against all pairs, recall at the threshold, and odd inputs."""

import math

import numpy as np
import pytest

from riskframe.llm import embed_dups
from riskframe.llm.queries import QUERIES


def all_pairs(rows, cosine=embed_dups.COSINE):
    """Links and least reachable key of each row, by comparing every two rows."""

    def usable(v, label):
        return label is not None and v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n = len(rows)
    links, root = [0] * n, list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            (_, v, a), (_, w, b) = rows[i], rows[j]
            if usable(v, a) and usable(w, b) and a == b and len(v) == len(w):
                v, w = [x / max(map(abs, v)) for x in v], [x / max(map(abs, w)) for x in w]
                dot = math.fsum(x * y for x, y in zip(v, w, strict=True))
                if dot / math.sqrt(math.fsum(x * x for x in v) * math.fsum(x * x for x in w)) >= cosine:
                    links[i] += 1
                    links[j] += 1
                    root[find(i)] = find(j)
    out = []
    for i in range(n):
        keys = [rows[j][0] for j in range(n) if find(j) == find(i) and rows[j][0] is not None]
        least = min(keys, default=None)
        out.append((rows[i][0], links[i], least, rows[i][0] == least))
    return sorted(out, key=str)


def found(frame):
    return sorted([(r.vec_id, r.n_links, r.component_id, r.kept) for r in frame.collect()], key=str)


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


@pytest.mark.parametrize("block", [1024, 4])
def test_links_equal_all_pairs(spark, monkeypatch, block):
    """Clusters of near copies, exact copies, scaled copies, and a bucket cut into many slices."""
    monkeypatch.setattr(embed_dups, "BLOCK", block)
    rng = np.random.default_rng(2)
    rows, key = [], 0
    for cluster in range(8):
        centre = rng.standard_normal(12)
        for _ in range(9):
            rows.append((2**60 + key, [float(np.float32(x)) for x in centre + rng.standard_normal(12) * 0.05], cluster % 2))
            key += 1
    rows += [(2**60 + key + i, rows[i][1], rows[i][2]) for i in range(20)]
    rows += [(-i - 1, [x * 2.0**i for x in rows[0][1]], 0) for i in range(3)]
    rows += [(10**6 + i, [float(np.float32(x)) for x in rng.standard_normal(12)], int(i % 2)) for i in range(40)]
    assert found(embed_dups.near_vectors(table(spark, rows).repartition(3))) == all_pairs(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    ok = [1.0, 2.0, 0.0]
    rows = [
        (1, None, 1), (1, None, 1), (2, [], 1), (3, [0.0, 0.0, 0.0], 1), (3, [-0.0, 0.0, 0.0], 1), (4, [nan, 1.0, 0.0], 1), (5, [inf, 1.0, 0.0], 1),
        (6, [None, 1.0, 0.0], 1), (7, ok, None), (8, ok, None), (9, ok, 1), (None, ok, 1), (None, ok, 1), (2**60 + 3, ok, 1), (2**60 + 3, ok, 1),
        (10, [1.0, 2.0], 1), (11, [2.0, 4.0], 1), (None, [9.0, 0.0, -1.0], 2), (None, [9.0, -0.0, -1.0], 2), (12, [3e38, 6e38 / 2, 0.0], 1),
        (13, [1e-38, 2e-38, 0.0], 1), (14, [1.0], 3), (15, [-1.0], 3), (16, [5.0], 3), (None, None, None),
    ]
    docs = table(spark, rows)
    got, want = found(embed_dups.near_vectors(docs)), all_pairs(rows)
    # Where a component has no key at all, nothing tells a row that goes from one that stays: all stay.
    want = sorted([(k, n, c, True if k is None and c is None else kept) for k, n, c, kept in want], key=str)
    assert got == want
    assert embed_dups.near_vectors(docs.where("false")).collect() == []
    clash = docs.selectExpr("*", "1 AS n_links", "2 AS point", "3 AS component_id", "4 AS bucket", "5 AS kept", "6 AS _key")
    assert found(embed_dups.near_vectors(clash)) == want


def test_recall_just_above_the_threshold(spark):
    """Pairs between 0.93 and 0.94 in 64 numbers, among 6000 unrelated vectors of the same label."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(3000):
        a, b = rng.standard_normal((2, 64))
        a /= np.linalg.norm(a)
        b -= a * (a @ b)
        b /= np.linalg.norm(b)
        c = rng.uniform(0.931, 0.94)
        rows += [(2 * i, a.tolist(), 1), (2 * i + 1, (c * a + math.sqrt(1 - c * c) * b).tolist(), 1)]
    links = embed_dups.near_vectors(table(spark, rows)).agg({"n_links": "sum"}).first()[0] / 2
    assert 0.95 * 3000 <= links <= 3000


def test_query_equals_all_pairs(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert found(QUERIES["op11_near_vectors"](spark, folder)) == all_pairs(rows)
