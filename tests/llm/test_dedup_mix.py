"""Exact and near deduplication, mixing and URL rules against plain Python."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from riskframe.llm import exact, mixing, simhash, urls
from riskframe.llm.common import TO_LOWER, WORD, connected

# Extra columns with names that the operators use inside must come through untouched.
SCHEMA = "doc_id long, text string, source string, _key string, size int, keep_id string, kept int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "k", 7, "x", 3) for i, t, s in rows], SCHEMA)


def corpus():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(500)] + ["É", "Über", "\u00a0x"]
    rows = []
    for i in range(60):
        text = " ".join(rng.choices(words, k=rng.randint(1, 400)))
        rows.append((len(rows), text, rng.choice(["a", "b", None])))
        if i % 3 == 0:
            rows.append((len(rows), text.upper() if i % 2 else text, "a"))
        if i % 4 == 0:
            changed = text.split(" ")
            changed[len(changed) // 2] = "changed"
            rows.append((len(rows), " ".join(changed), "c"))
    hot = " ".join(rng.choices(words, k=50))
    rows += [(len(rows) + i, hot, "a") for i in range(150)]
    rows += [(1000, None, "z"), (1001, "", None), (1002, " \t\n", "z"), (1003, "one", "z"), (1003, "one", "z"), (1004, "one two", None)]
    rows += [(1005, "x" * 200_000, "z"), (1006, "long " * 30_000, "z"), (None, "no key", "z"), (1007, "ÀB à", "q"), (1008, "Àb à", "q"), (1009, "àb à", "q")]
    return rows


def test_exact_groups(spark):
    rows = corpus()
    got = exact.exact_groups(frame(spark, rows)).collect()
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[(t or "").translate(TO_LOWER)].append(i)
    want = []
    for i, t, _ in rows:
        text = (t or "").translate(TO_LOWER)
        keep = max((x for x in groups[text] if x is not None), default=None)
        want.append((i, keep, len(groups[text]), i == keep, hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    docs = frame(spark, rows)
    kept = exact.distinct_documents(docs)
    assert kept.columns == docs.columns
    left = [tuple(r) for r in kept.collect()]
    assert sorted((r[0] for r in left), key=repr) == sorted({w[1] for w in want}, key=repr)
    assert {r[3:] for r in left} == {("k", 7, "x", 3)}
    assert exact.exact_groups(docs.limit(0)).count() == exact.distinct_documents(docs.limit(0)).count() == 0


def fingerprint(text, shingle=3):
    words = re.findall(WORD, (text or "").translate(TO_LOWER))
    parts = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    """Smallest key reachable over fingerprints within 3 bits, by plain search."""
    keys = list(prints)
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for n, a in enumerate(keys):
        for b in keys[:n]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def test_near_duplicates(spark):
    rows = corpus()
    docs = frame(spark, rows)
    prints = {(-1 if i is None else i): fingerprint(t) for i, t, _ in rows}
    want = components({k: v for k, v in prints.items() if k >= 0})
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for row in got:
        key = -1 if row["doc_id"] is None else row["doc_id"]
        assert row["fingerprint"] == f"{prints[key]:016x}"
        assert row["component_id"] == want.get(key)
    kept = simhash.one_of_each_group(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted({*want.values(), None}, key=repr)
    assert simhash.near_duplicates(docs.limit(0)).count() == simhash.one_of_each_group(docs.limit(0)).count() == 0


def test_all_pairs_within_three_bits(spark):
    """Every distance and every block of bits; none above 3 bits is linked."""
    rng = random.Random(4)
    prints = set()
    for _ in range(40):
        centre = rng.getrandbits(64)
        prints.add(centre)
        for bits in (1, 2, 3, 4, 5):
            for _ in range(4):
                prints.add(centre ^ sum(1 << b for b in rng.sample(range(64), bits)))
    prints |= {0, 1, (1 << 64) - 1, 1 << 63, (1 << 63) | 7}
    signed = {p - (1 << 64) if p >> 63 else p: p for p in prints}
    got = {tuple(r) for r in simhash.near_links(spark.createDataFrame([(k,) for k in signed], "_print long")).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and (signed[a] ^ signed[b]).bit_count() <= 3}
    assert got == want


def test_balls_meet_only_near_each_other(spark):
    """Random fingerprints share no key, so work does not grow with their pairs."""
    random_prints = spark.range(3000).select(F.xxhash64("id").alias("_print"))
    balls = random_prints.select(F.explode(simhash._balls(F.col("_print"))).alias("ball"))
    assert balls.count() == 3000 * 131
    assert balls.distinct().count() == 3000 * 131


def test_connected(spark):
    chain = [(i, i + 1) for i in range(60)] + [(200, 100 + i) for i in range(50)] + [(5, 5), (7, 6)]
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(50)}, 200: 100}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def targets(sizes, weights=(5, 2, 1), most=3):
    """Share by weight, cap, and share the excess again."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, open_, left = {}, set(order), sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > most * sizes[s]}
        if not over:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


@pytest.mark.parametrize("slice_rows", [10_000, 20])
def test_mixing(spark, monkeypatch, slice_rows):
    monkeypatch.setattr(mixing, "SLICE_ROWS", slice_rows)
    rows = corpus()
    docs = frame(spark, rows)
    got = mixing.mixed(docs).collect()
    again = mixing.mixed(docs.repartition(7)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(re.findall(WORD, t or ""))
    want, taken, largest = targets(sizes), defaultdict(int), defaultdict(int)
    for row in got:
        assert row["source_size"] == sizes[row["source"]]
        assert row["target"] == pytest.approx(want[row["source"]])
        assert 0 <= row["copies"] <= 3 and row["taken"] == row["copies"] * row["size"]
        taken[row["source"]] += row["taken"]
        largest[row["source"]] = max(largest[row["source"]], row["size"])
    for source, target in want.items():
        assert abs(taken[source] - target) <= 3 * largest[source]
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    mix = mixing.sample_mixture(docs)
    assert mix.columns == docs.columns
    assert mix.count() == sum(r["copies"] for r in got)
    assert mixing.mixed(docs.limit(0)).count() == mixing.sample_mixture(docs.limit(0)).count() == 0


def test_targets_stop_at_three_times_their_source(spark):
    sizes = {"a": 10, "b": 1000, "c": 20, "d": 0, None: 30}
    got = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = targets(sizes)
    assert {r["source"]: pytest.approx(r["target"]) for r in got} == want


def test_urls(spark):
    pages = [
        (1, "https://example.org/es/1"), (2, "http://Sub.EXAMPLE.org/en/12?x"), (3, "http://sub.example.org/en/2"), (4, "http://notexample.org/es/"),
        (5, "http://a.com/fr/1"), (6, "http://a.com/de/#"), (7, "http://a.com"), (8, None), (9, "no scheme/org/"), (10, "x://"), (11, "http://org"),
        (12, "http://org/"), (13, "http://cheap-pills.net/x"), (14, "http://xcheap-pills.net/x"), (15, "http://a.net/CASINO#y"), (16, "http://a.com/DE/"),
        (17, "a\nb://example.org/es/\n?q"), (1, "https://example.org/es/1"), (None, "http://a.com:80/fr/"), (18, "http://b.org?/es/"), (19, "http://" + "a." * 5000 + "com/de/x"),
    ]
    table = spark.createDataFrame([(i, u, "r", "v", "h") for i, u in pages], "page_id long, url string, rule string, verdict string, host string")
    got = urls.url_verdicts(table, urls.rule_table(spark)).collect()

    def brute(url):
        found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (found.group(1).translate(TO_LOWER), found.group(2)) if found else ("", "")
        fits = [(len(h + p), h + p, v) for h, p, v in urls.HOST_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        if fits:
            return (host, path, *max(fits)[1:])
        spam = any(re.search(rf"(?i)(?:^|[^a-z0-9]){w}(?:[^a-z0-9]|$)", host + path) for w in urls.SPAM_WORDS)
        return host, path, None, "block" if spam else "allow"

    assert sorted(map(tuple, got), key=repr) == sorted([(i, *brute(u)) for i, u in pages], key=repr)
    open_rule = urls.rule_table(spark, [("any", ".*", [], 1, "block"), ("net", r"\.net/", ["net"], 1, "allow")])
    got = {r["page_id"]: r["rule"] for r in urls.url_verdicts(table.where("page_id in (13, 5)"), open_rule).collect()}
    assert got == {13: "net", 5: "any"}
    assert urls.url_verdicts(table.limit(0), urls.rule_table(spark)).count() == 0


def test_holds_for_one_hot_source(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("same text here").alias("text"), F.lit("only").alias("source"))
    assert exact.exact_groups(docs).agg(F.sum(F.col("kept").cast("int")), F.min("group_size")).first()[:] == (1, 5000)
    assert mixing.mixed(docs).agg(F.sum("taken")).first()[0] == pytest.approx(15_000, abs=3)
