"""Language ID, personal data, neighbour search and the pipeline against brute force."""

import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from riskframe.llm import ann, langid, pii
from riskframe.llm.common import in_fold

FOLDER = "/root/testdata/sf0.01"


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = __spark_entry__.queries()["op1_language_id"](spark, FOLDER)
    assert got.count() == docs.count()
    share = got.join(docs, "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.min("score"), F.max("score")).first()
    assert share[0] > 0.99 and 0 <= share[1] <= share[2] <= 1


def test_language_sums_are_those_of_naive_bayes(spark):
    texts = ["the cat sat", "le chat noir", "the dog", "le chien É"] * 3
    langs = ["en", "fr", "en", "fr"] * 3
    docs = spark.createDataFrame(list(zip(texts, langs, range(12))), "text string, lang string, doc_id long")
    model = langid.fit_languages(docs)
    assert model.languages == ["en", "fr"]
    for text in ["the noir", "a"]:
        grams = np.concatenate([langid._buckets(langid._codes(text), n) for n in langid.ORDERS])
        logs = []
        for lang in model.languages:
            counts = np.zeros(langid.BUCKETS)
            for t, own in zip(texts, langs):
                for n in langid.ORDERS:
                    counts += np.bincount(langid._buckets(langid._codes(t), n), minlength=langid.BUCKETS) * (own == lang)
            smooth = (counts + langid.SMOOTHING) / (counts + langid.SMOOTHING).sum()
            logs.append(np.log(smooth[grams]).sum() + np.log(7 / 14))
        row = langid._predict(model, pd.Series([text])).iloc[0]
        assert row["lang"] == model.languages[int(np.argmax(logs))]
        assert row["score"] == pytest.approx(1 / sum(np.exp(x - max(logs)) for x in logs))


def test_language_edges(spark):
    rows = [(1, "the cat", "en", "a"), (2, None, "en", "b"), (3, "", "fr", "c"), (4, "12 !?", "fr", "d"), (5, "le chat", "fr", "e"), (5, "le chat", "fr", "e"),
            (None, "é" * 300_000, None, "f"), (7, "x", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = langid.fit_languages(docs, train=~in_fold("doc_id", 4, 2))
    got = langid.with_language(docs.drop("score"), model).collect()
    assert len(got) == len(rows)
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in got if r["doc_id"] in (2, 3, 4))
    assert all(r["lang_pred"] in model.languages for r in got if r["doc_id"] in (1, 5, 7, None))
    kept = langid.known_languages(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} <= {1, 5, 7, None}
    nothing = langid.fit_languages(docs.limit(0))
    assert {r["lang_pred"] for r in langid.with_language(docs.drop("score"), nothing).collect()} == {"und"}


PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
]


def brute_spans(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for found in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", found.group())
            odd = sum(int(d) for d in digits[::-1][::2]) + sum(int(c) for d in digits[::-1][1::2] for c in str(2 * int(d)))
            if kind == 1 and any(int(p) > 255 for p in found.group().split(".")):
                continue
            if kind == 2 and not (16 <= len(digits) <= 19 and odd % 10 == 0):
                continue
            if kind == 3 and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, *found.span()))
    return out


def test_base_spans_equal_the_patterns(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choices("a.@-+0123456789 ()é\n", k=rng.randint(0, 60))) for _ in range(4000)]
    texts += ["a@b.c@d.e x..y@z-.w", "1.2.3.4.5.6.7.8.9", "256.1.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111 5", "+1 (415) 555-2671", "+1((((((", "@", "00000001.2.3.255"]
    texts += [r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    for text in texts:
        assert pii.base_spans(text) == brute_spans(text), text


def test_gradients():
    """Against differences of the likelihood."""
    rng = np.random.default_rng(3)
    tagger = pii.Tagger(rng)
    tagger.p = {k: v.astype(np.float64) for k, v in tagger.p.items()}
    x, y = rng.integers(0, pii.CLASSES, (3, 6)), rng.integers(0, pii.TAGS, (3, 6))

    def loss():
        scores = tagger.emissions(x)
        ahead, right = scores[:, 0], scores[np.arange(3), 0, y[:, 0]]
        for t in range(1, 6):
            ahead = pii._lse(ahead[:, :, None] + tagger.p["next"], 1) + scores[:, t]
            right = right + scores[np.arange(3), t, y[:, t]] + tagger.p["next"][y[:, t - 1], y[:, t]]
        return float((pii._lse(ahead, 1) - right).mean())

    grads = tagger.gradients(x, y)
    for name, own in grads.items():
        flat = tagger.p[name].reshape(-1)
        for i in rng.integers(0, flat.size, 6):
            if name.startswith("in_") and i // (4 * pii.HIDDEN) not in x:
                continue
            before = flat[i]
            flat[i] = before + 1e-3
            up = loss()
            flat[i] = before - 1e-3
            down = loss()
            flat[i] = before
            assert own.reshape(-1)[i] == pytest.approx((up - down) / 2e-3, abs=5e-3)


def test_personal_data(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    tagger = pii.fit_tagger(docs)
    assert tagger.trained
    rows = [(1, None), (2, ""), (3, "mail a.b@c.org, ip 10.0.0.1."), (3, "mail a.b@c.org, ip 10.0.0.1."), (4, "x" * 300_000 + " 10.0.0.1"), (None, "clean words only"),
            (5, "in 2024 we sold 300 of 1,200 units (25.0 %)"), (6, "9" * 50_000)]
    frame = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, spans string")
    got = pii.personal_data(frame, tagger).collect()
    assert len(got) == len(rows)
    for row in got:
        text = dict(rows)[row["doc_id"]] or ""
        named = [f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in brute_spans(text)] if len(text) < 40_000 else None
        if named is not None:
            assert [row[f"n_{k}"] for k in pii.KINDS] == [sum(n.startswith(k) for n in named) for k in pii.KINDS]
            assert set(named) <= set(filter(None, row["spans"].split(",")))
            if not named:
                assert row["spans"] == ""
        elif row["doc_id"] == 4:
            assert row["spans"] == "ip:300001:300009"
    clean = {r["doc_id"]: r["text"] for r in pii.redacted(frame, tagger).collect()}
    assert clean[3] == "mail <email>, ip <ip>." and clean[1] is None and clean[2] == ""
    assert pii.personal_data(frame.limit(0), tagger).count() == 0
    assert not pii.fit_tagger(frame.limit(0)).trained


def test_tagger_finds_held_out_spans(spark):
    """The model itself, without the base patterns, on documents that it did not learn from."""
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").orderBy("doc_id").limit(6000).collect()]
    marked = [t for t in texts if pii._MARKED.search(t)]
    parts = [m.group() for t in marked[: len(marked) // 2] for m in re.finditer(r"(?s).{0,160}[@0-9][@0-9 +().a-zA-Z-]{6}.{0,160}", t)]
    tagger, hit, total = pii.train_tagger(parts), 0, 0
    for text in marked[len(marked) // 2 :]:
        base, codes = pii.base_spans(text), pii._codes(text)
        if base:
            rows = [np.resize(np.concatenate([codes[s : s + pii.WINDOW], np.full(pii.WINDOW, pii.PADDING)]), pii.WINDOW) for s in pii._window_starts(codes)]
            found = {(k, s + a, s + b) for s, tags in zip(pii._window_starts(codes).tolist(), tagger.decode(np.stack(rows))) for k, a, b in pii._found(tags)}
            hit, total = hit + sum(b in found for b in base), total + len(base)
    assert total > 100 and hit / total > 0.8


def test_nearest_recall_and_scores(spark):
    folder = "/root/testdata/sf0.1"
    frame = spark.read.parquet(f"{folder}/embeddings.parquet")
    table = frame.toPandas()
    points, ids = np.stack(table["embedding"]).astype(float), table["vec_id"].to_numpy()
    got = __spark_entry__.queries()["op2_nearest"](spark, folder).toPandas()
    hit = total = 0
    for name, own in got.groupby("query_id"):
        own = own.sort_values("rank")
        scores = points @ points[ids == name][0]
        assert name not in own["vec_id"].values and own["rank"].tolist() == list(range(1, 21))
        assert own["score"].is_monotonic_decreasing
        assert np.allclose(own["score"], scores[[np.flatnonzero(ids == v)[0] for v in own["vec_id"]]], atol=1e-12)
        scores[ids == name] = -np.inf
        hit, total = hit + len(set(ids[np.argsort(-scores, kind="stable")[:20]]) & set(own["vec_id"])), total + 20
    assert got["query_id"].nunique() == (ids % 20 == 0).sum()
    assert hit / total >= 0.9


def test_nearest_edges(spark):
    nan, inf = float("nan"), float("inf")
    same = [(i, [1.0, 0.0]) for i in range(100, 160)]
    rows = same + [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (40, [nan, 1.0]), (60, None), (80, [0.0, 0.0]), (1, [inf, 0.0]), (2, [1.0, None]), (3, [0.0, 2.0]), (3, [0.0, 2.0]), (4, []), (5, [1.0]), (None, [1.0, 1.0])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    got = {}
    for r in ann.nearest(frame, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert sorted(got) == [0, 20, 100, 120, 140]
    assert got[0] == [(i, 1.0) for i in range(100, 120)]
    assert got[20] == [(3, 1.0), (0, 0.5)] + [(i, 0.5) for i in range(100, 118)]
    assert got[100][0] == (0, 1.0) and got[100][1] == (101, 1.0)
    assert ann.nearest(frame.limit(0), F.lit(True)).count() == 0
    assert ann.nearest(frame.where("vec_id in (40, 60)"), F.lit(True)).count() == 0


def test_nearest_of_every_width_and_full_lists(spark):
    """Each width answers its own queries, also the rarer one; lists are full where probed partitions hold too little."""
    rng = np.random.default_rng(3)
    points = {i: rng.standard_normal(8) for i in range(700)} | {i: rng.standard_normal(5) for i in range(700, 790)}
    rows = [(i, v.tolist()) for i, v in points.items()]
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=80).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 790, 20))
    for query, found in got.items():
        others = [i for i, v in points.items() if len(v) == len(points[query]) and i != query]
        assert [n for n, _, _ in sorted(found)] == list(range(1, 81))
        assert {i for _, i, _ in found} <= set(others)
        assert all(abs(s - points[query] @ points[i]) < 1e-12 for _, i, s in found)


def test_balanced_parts():
    points = np.random.default_rng(1).standard_normal((1000, 16))
    part = ann.balanced_parts(ann._neighbours(points, 10), 8, np.random.default_rng(2))
    assert np.bincount(part).tolist() == [125] * 8


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(300)
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, FOLDER)
        assert after.columns == docs.columns, name
        after = spark.createDataFrame(after.collect(), docs.schema)
        if name.startswith("mixing"):
            assert {r["doc_id"] for r in after.collect()} <= {r["doc_id"] for r in before.collect()}
        else:
            assert after.exceptAll(before).count() == 0
        before = after
    out = corpus_pipeline.STAGES[-1][1](spark, before, FOLDER)
    assert out.count() == before.count() and out.where("n_tokens <> coalesce(size(ids), 0)").count() == 0
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, FOLDER).count() == 0
