"""Katz scores against dictionaries."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from riskframe.llm import katz
from riskframe.llm.common import TO_LOWER, WORD


def tokens(text):
    return re.findall(WORD, (text or "").translate(TO_LOWER)) + [katz.END]


class Brute:
    def __init__(self, texts):
        self.words, self.pairs, self.after = Counter(), Counter(), defaultdict(Counter)
        for text in texts:
            before = None
            for word in tokens(text):
                self.words[word] += 1
                self.pairs[before, word] += 1
                self.after[before][word] += 1
                before = word
        self.total = sum(self.words.values())
        self.word_factor = katz.good_turing(Counter(self.words.values()))
        self.pair_factor = katz.good_turing(Counter(self.pairs.values()))
        mass = sum(self.discount(c, self.word_factor) for c in self.words.values())
        self.divisor = self.total if mass < self.total - 1e-9 else self.total + 1
        self.unknown = 1 - mass / self.divisor if self.total else 1.0

    @staticmethod
    def discount(count, factors):
        return count * factors[count] if count <= katz.DISCOUNTED else count

    def word(self, word):
        return self.discount(self.words[word], self.word_factor) / self.divisor if word in self.words else self.unknown

    def pair(self, before, word):
        seen = self.after.get(before)
        if not seen:
            return self.word(word)
        count = sum(seen.values())
        mass = sum(self.discount(c, self.pair_factor) for c in seen.values())
        divisor = count if mass < count - 1e-9 else count + 1
        if word in seen:
            return self.discount(seen[word], self.pair_factor) / divisor
        return (1 - mass / divisor) / (1 - sum(self.word(w) for w in seen)) * self.word(word)

    def score(self, text):
        own = tokens(text)
        return sum(math.log10(self.pair(a, b)) for a, b in zip([None] + own, own))


def corpus():
    rng = random.Random(7)
    words = [f"w{i}" for i in range(60)] + ["The", "é\x85x", "a\x00b", "a\x01b"]
    weights = [1 / (i + 1) for i in range(len(words))]
    rows = [(i, " ".join(rng.choices(words, weights, k=rng.randint(0, 40))), i % 4) for i in range(200)]
    rows += [(300, None, 1), (301, "", 1), (302, "never seen words w1 w2", 0), (303, "the " * 3000, 1), (303, "the " * 3000, 1), (None, "w1 w2", 1)]
    return rows


@pytest.mark.parametrize("block_tokens, bucket_bytes", [(1 << 20, 1 << 24), (100, 700)])
def test_scores(spark, monkeypatch, block_tokens, bucket_bytes):
    # Small blocks and buckets also spread frequent first words over several buckets.
    monkeypatch.setattr(katz, "BUCKET_BYTES", bucket_bytes)
    monkeypatch.setattr(katz, "BLOCK_TOKENS", block_tokens)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int").repartition(5)
    got = katz.katz_scores(docs, F.col("score") != 0).collect()
    model = Brute([t for _, t, part in rows if part != 0])
    assert len(got) == len(rows)
    texts = {i: t for i, t, _ in rows}
    for row in got:
        text = texts[row["doc_id"]]
        own = tokens(text)
        assert row["n_tokens"] == len(own) and row["n_known"] == sum(w in model.words for w in own)
        assert row["train_tokens"] == model.total
        base = sum(math.log10((model.words[w] + 0.5) / (model.total + 0.5 * (len(model.words) + 1))) for w in own)
        assert row["base_score"] == pytest.approx(base, abs=1e-8)
        assert row["score"] == pytest.approx(model.score(text), abs=1e-8), text


def test_probabilities_add_up():
    model = Brute([t for _, t, part in corpus() if part != 0])
    for before in [*model.after, "nowhere"]:
        total = sum(model.pair(before, w) for w in model.words) + model.pair(before, "unknown!")
        assert total == pytest.approx(1)


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    row = katz.katz_scores(docs, F.lit(False)).first()
    assert (row["n_tokens"], row["n_known"], row["score"]) == (3, 0, 0.0)
    assert katz.katz_scores(docs.limit(0), F.lit(True)).count() == 0


def test_keys_beside_a_null_stay_exact(spark):
    rows = [(2**60 + 1, "a b"), (None, "a b"), (2**60 + 3, "b"), (None, None), (-(2**63), "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = sorted(((r["doc_id"], r["n_tokens"]) for r in katz.katz_scores(docs, F.lit(True)).collect()), key=str)
    assert got == sorted([(2**60 + 1, 3), (None, 3), (2**60 + 3, 2), (None, 1), (-(2**63), 2)], key=str)
    assert katz.katz_scores(docs, F.lit(None).cast("boolean")).where("score = 0").count() == 5
