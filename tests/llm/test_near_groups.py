"""The near-copy stage of the pipeline: one document of every group, whatever its keys."""

import random

import xxhash

from riskframe.llm import simhash

SCHEMA = "doc_id long, text string"


def words(seed, n=60):
    rng = random.Random(seed)
    return [f"{seed}q{rng.randrange(10**6)}" for _ in range(n)]


def test_null_and_shared_keys_keep_every_group(spark):
    texts = [" ".join(words(i)) for i in range(6)]
    # Four groups of null keys only; key 1 names two different texts, and one of them is its group's only row.
    rows = [(None, t) for t in texts[:4]] + [(None, texts[0].upper())] + [(1, texts[4]), (1, texts[5]), (0, texts[5].upper())]
    kept = simhash.one_of_each_group(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r["text"].lower() for r in kept) == sorted(texts)
    assert {r["text"].lower(): r["doc_id"] for r in kept} == dict(zip(texts, [None] * 4 + [1, 0]))


def test_a_null_key_yields_to_any_other(spark):
    text = " ".join(words(9))
    kept = simhash.one_of_each_group(spark.createDataFrame([(None, text), (7, text.upper()), (7, text.upper())], SCHEMA)).collect()
    assert [r["doc_id"] for r in kept] == [7]


def bits(text):
    """The fingerprint by its definition."""
    own = text.lower().split()
    parts = [" ".join(own[i : i + 3]) for i in range(max(1, len(own) - 2))] if own else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_stage_keeps_one_of_every_group_of_near_fingerprints(spark):
    """Long texts with one changed word are within 3 bits or not: the stage follows the bits, in chains too."""
    rng, rows = random.Random(5), []
    for g in range(40):
        own = words(g, 700)
        for i in range(6):
            copy = list(own)
            if i:
                copy[rng.randrange(700)] = "changed"
            rows.append((10 * g + i, " ".join(copy)))
    rows += [(1000 + i, rows[0][1].upper()) for i in range(50)] + [(2000, None), (2001, ""), (2002, " \t")]
    prints = {k: bits(t or "") for k, t in rows}
    root = {k: k for k in prints}
    for a in prints:
        for b in prints:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                low, high = sorted((root[a], root[b]))
                root = {k: low if r == high else r for k, r in root.items()}
    linked = sum(root[10 * g + i] != 10 * g + i for g in range(40) for i in range(6))
    assert 20 < linked < 200
    kept = {r["doc_id"] for r in simhash.one_of_each_group(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    assert kept == set(root.values())


def test_keys_beside_a_null_stay_exact(spark):
    text = " ".join(words(1))
    rows = [(None, text), (2**60 + 1, text), (2**60 + 3, " ".join(words(2))), (None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    assert {r["_key"] for r in simhash.fingerprints(docs).collect()} == {None, 2**60 + 1, 2**60 + 3}
    got = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert got == {(None, 2**60 + 1), (2**60 + 1, 2**60 + 1), (2**60 + 3, 2**60 + 3), (None, None)}
    assert {r["doc_id"] for r in simhash.one_of_each_group(docs).collect()} == {2**60 + 1, 2**60 + 3, None}
