"""Periodic runs against a direct search, the planted tails, and odd inputs."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from riskframe.llm import periodic
from riskframe.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def direct(words):
    """Every lag, every maximal stretch, and no smaller period."""
    found = []
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            if words[i] == words[i + q]:
                j = i
                while j + q < len(words) and words[j] == words[j + q]:
                    j += 1
                part = words[i : j + q]
                smaller = any(all(part[x] == part[x + r] for x in range(len(part) - r)) for r in range(1, q))
                if len(part) >= max(6, 4 * q) and not smaller:
                    found.append((i, len(part), q))
                i = j
            i += 1
    return sorted(found)


def drops(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs_equal_direct_search():
    rng = random.Random(3)
    for _ in range(1500):
        texts = []
        for _ in range(rng.randint(1, 5)):
            words = [b"%d" % rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randint(0, 70))]
            for _ in range(rng.randint(0, 2)):
                if len(words) > 8:
                    a = rng.randrange(len(words))
                    p = 1 + (len(words) - a) // rng.randint(3, 10)
                    words = words[:a] + [words[a + (i - a) % p] for i in range(a, len(words))]
            texts.append(words)
        for words, runs in zip(texts, periodic._searched(texts), strict=True):
            assert [tuple(r) for r in runs.tolist()] == direct(words)


def test_range_successor():
    rng = np.random.default_rng(5)
    for n in (1, 2, 7, 64, 300):
        values = rng.permutation(1000)[:n]
        low = rng.integers(0, n, 200)
        high = rng.integers(low + 1, n + 1)
        after = rng.integers(-5, 1005, 200)
        got = periodic._next_in_range(values, low, high, after)
        want = [min((v for v in values[a:b] if v > x), default=-1) for a, b, x in zip(low, high, after, strict=True)]
        assert got.tolist() == want


def test_nested_and_long_runs():
    """A long text of one word, runs within runs, and a run that ends a text where the next text goes on alike."""
    inner = [b"a", b"a", b"a", b"a", b"a", b"a", b"b"]
    texts = [[b"x"] * 300_000, inner * 5, [b"p", b"q"] * 4, [b"p", b"q"] * 4, []]
    found = [[tuple(r) for r in f.tolist()] for f in periodic._searched(texts)]
    assert found[0] == [(0, 300_000, 1)]
    assert found[1] == direct(texts[1]) and (0, 35, 7) in found[1] and (7, 6, 1) in found[1]
    assert found[2] == found[3] == [(0, 8, 2)] and found[4] == []


def test_null_empty_repeated_and_clashing_names(spark):
    big = 2**60 + 1
    rows = [(big, "a a a a a a b", 1), (None, "a b a b a b a b", 2), (big + 2, None, 3), (big + 2, "", 4), (big, "a a a a a a b", 1), (7, " \t\n", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    out = [(r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.word_runs(docs).collect()]
    assert sorted(out, key=str) == sorted(
        [(big, [(0, 6, 1)], "a b"), (None, [(0, 8, 2)], "a b"), (big + 2, [], ""), (big + 2, [], ""), (big, [(0, 6, 1)], "a b"), (7, [], "")], key=str
    )
    digests = periodic.run_digests(docs).where("doc_id = 7").first()
    assert digests.n_runs == 0 and digests.start is None and digests.exponent_milli is None
    assert digests.runs_sha256 == digests.collapsed_sha256 == hashlib.sha256(b"").hexdigest()
    assert periodic.word_runs(docs.where("false")).count() == 0
    assert periodic.run_digests(periodic.repeated_tails(docs)).count() == 6
    text_keys = spark.createDataFrame([("k", "z z z z z z")], "doc_id string, text string")
    assert periodic.word_runs(text_keys).first().collapsed == "z"


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_query_equals_direct_search(spark, folder):
    got = {r.doc_id: r for r in QUERIES["op13_periodic_runs"](spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert len(got) == len(docs)
    planted = 0
    for doc in docs:
        words = WORD.findall(doc.text or "")
        h = zlib.crc32(str(doc.doc_id).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            planted += 1
        # Stretches of one lag, found by comparing the words with themselves; cheap enough for whole texts.
        codes = np.unique(np.array(words, dtype=object), return_inverse=True)[1] if words else np.zeros(0, int)
        runs = []
        for q in range(1, n // 4 + 1):
            same = np.concatenate([[False], codes[:-q] == codes[q:], [False]])
            edge = np.flatnonzero(same[1:] != same[:-1])
            runs += [(int(s), int(e - s + q), q) for s, e in zip(edge[::2], edge[1::2], strict=True) if e - s + q >= max(6, 4 * q)]
        runs = sorted(r for r in runs if not any(r[2] % x[2] == 0 and x[2] < r[2] and x[0] <= r[0] and r[0] + r[1] <= x[0] + x[1] for x in runs))
        row, lines = got[doc.doc_id], "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        assert row.n_runs == len(runs) and row.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(drops(words, runs).encode()).hexdigest()
        if runs:
            s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2]))
            assert (row.start, row.length, row.period, row.exponent_milli) == (s, n, q, 1000 * n // q)
        else:
            assert (row.start, row.length, row.period, row.exponent_milli) == (None,) * 4
    assert planted > 5
