"""Katz backoff language model: Good-Turing discounts, exactly normalised backoff, tables partitioned by n-gram.

Texts are cut into blocks of about ``BLOCK_TOKENS`` tokens.  A block asks for the counts of its own distinct n-grams, so
a frequent word or word pair is one request of each block, and a shuffle carries every distinct n-gram of a block once,
packed in arrays.  Two rounds answer: one over words, one over word pairs grouped by the first word.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.session import durable

BLOCK_TOKENS = 1 << 20
#: Bytes of text for each bucket of a table.
BUCKET_BYTES = 16 << 20
#: Good-Turing discounts apply to counts up to this one.
DISCOUNTED = 5
#: A word with more than this share of a bucket's mean tokens has its pairs spread over several buckets.
HOT_SHARE = 0.25
END = "\n"  # no word holds white space
START_ID = -1

_MESSAGE = "block string, kind string, bucket long, number long, a binary, b binary, c binary, d binary"


def _pack(values: np.ndarray | bytes) -> bytes:
    """Compressed values; all first bytes come first, then all second bytes, as most high bytes are zero."""
    if isinstance(values, np.ndarray):
        values = np.ascontiguousarray(values).reshape(-1).view(np.uint8).reshape(-1, values.itemsize).T.tobytes()
    return len(values).to_bytes(8, "little") + pa.compress(values, codec="zstd", asbytes=True)


def _unpack(data: bytes, kind=np.int64) -> np.ndarray:
    planes = np.frombuffer(_unpack_bytes(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def _unpack_bytes(data: bytes) -> bytes:
    return pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def _steps(ascending: np.ndarray) -> bytes:
    return _pack(np.diff(ascending, prepend=0).astype(np.int64))


def _from_steps(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data))


def _rows(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["block", "kind", "bucket", "number", "a", "b", "c", "d"])


def _message(block="", kind="", bucket=0, number=0, a=None, b=None, c=None, d=None) -> tuple:
    return (block, kind, bucket, number, a, b, c, d)


# Blocks -------------------------------------------------------------------------------------------------------------


class _Block:
    """Documents gathered until they hold enough tokens: local word numbers, and training counts of the words."""

    def __init__(self):
        self.words: dict[bytes, int] = {}
        self.texts: list[np.ndarray] = []
        self.keys: list = []
        self.train: list[bool] = []
        self.tokens = 0

    def add(self, key, train: bool, text: str | None) -> None:
        # On bytes, lower() and split() know ASCII only: A-Z and the six white-space characters.
        words = (text or "").encode().lower().split()
        words.append(END.encode())
        number = self.words
        self.texts.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words)))
        self.keys.append(key)
        self.train.append(train)
        self.tokens += len(words)

    def messages(self, name: str, buckets: int) -> Iterator[tuple]:
        tokens = np.concatenate(self.texts)
        lengths = np.array([len(t) for t in self.texts], np.int64)
        train = np.array(self.train, bool)
        counts = np.bincount(tokens[np.repeat(train, lengths)], minlength=len(self.words))
        words = list(self.words)
        place = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
        order = np.argsort(place, kind="stable")
        cuts = np.flatnonzero(np.diff(place[order], prepend=-1)).tolist() + [len(order)]
        for low, high in zip(cuts, cuts[1:], strict=False):
            own = order[low:high]
            named = b"\x00".join(words[i].replace(b"\x01", b"\x01\x01").replace(b"\x00", b"\x01\x02") for i in own.tolist())
            yield _message(name, "words", int(place[own[0]]), len(own), _pack(named), _steps(own), _pack(counts[own].astype(np.int64)))
        keys = pa.array(self.keys, pa.int64(), from_pandas=True)
        yield _message(
            name, "texts", int(train.sum()), int(lengths[train].sum()), _pack(tokens), _pack(lengths),
            _pack(keys.fill_null(0).to_numpy()), _pack(np.stack([train, np.array(keys.is_null())]).astype(np.int8)),
        )


def _blocks(buckets: int, block_tokens: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    block, task, done = _Block(), TaskContext.get().partitionId(), 0
    for batch in batches:
        for key, null, train, text in zip(batch["_key"].tolist(), batch["_null"], batch["_train"], batch["_text"], strict=True):
            block.add(None if null else key, train, text)
            if block.tokens >= block_tokens:
                yield _rows(list(block.messages(f"{task}-{done}", buckets)))
                block, done = _Block(), done + 1
    if block.keys:
        yield _rows(list(block.messages(f"{task}-{done}", buckets)))


# Discounts ------------------------------------------------------------------------------------------------------------


def good_turing(counts: dict[int, int]) -> np.ndarray:
    """Factors for counts 0..DISCOUNTED+1 from how many n-grams occur r times; 1 where the estimate is not between 0 and 1."""
    factors = np.ones(DISCOUNTED + 2)
    n1 = counts.get(1, 0)
    rest = (DISCOUNTED + 1) * counts.get(DISCOUNTED + 1, 0) / n1 if n1 else 1.0
    for r in range(1, DISCOUNTED + 1):
        if counts.get(r, 0) and rest < 1:
            better = (r + 1) * counts.get(r + 1, 0) / counts[r] / r
            factor = (better - rest) / (1 - rest)
            if 0 < factor < 1:
                factors[r] = factor
    factors[0] = 0.0
    return factors


@dataclass
class Words:
    """The word level of a model: a few numbers, whatever the corpus."""

    total: int
    distinct: int
    factors: np.ndarray
    unknown: float = field(init=False, default=1.0)
    divisor: float = field(init=False, default=1.0)

    def settle(self, discounted: float) -> Words:
        """``discounted``: the sum of discounted counts.  Without anything left, one count is added for unknown words."""
        self.divisor = self.total if discounted < self.total else self.total + 1.0
        self.unknown = 1.0 - discounted / self.divisor if self.total else 1.0
        return self

    def probability(self, counts: np.ndarray) -> np.ndarray:
        known = counts * self.factors[np.minimum(counts, DISCOUNTED + 1)] / self.divisor
        return np.where(counts > 0, known, self.unknown)


# Rounds ---------------------------------------------------------------------------------------------------------------


def _count_words(group: pd.DataFrame) -> pd.DataFrame:
    """Add up a bucket's words over all blocks; answer each block in its own order with rank and count of its words.

    A word's number is its rank in the bucket times the number of buckets, plus the bucket.
    """
    total: dict[bytes, int] = {}
    asked = []
    for row in group.itertuples(index=False):
        words, counts = _unpack_bytes(row.a).split(b"\x00"), _unpack(row.c).tolist()
        asked.append(words)
        for word, count in zip(words, counts, strict=True):
            total[word] = total.get(word, 0) + count
    bucket = int(group["bucket"].iat[0])
    place = {word: i for i, word in enumerate(sorted(total))}
    out = []
    for row, words in zip(group.itertuples(index=False), asked, strict=True):
        ranks = np.fromiter((place[w] for w in words), np.int64, len(words))
        counts = np.fromiter((total[w] for w in words), np.int64, len(words))
        out.append(_message(row.block, "word-counts", bucket, len(words), _pack(ranks), row.b, _pack(counts)))
    counts = np.fromiter(total.values(), np.int64, len(total))
    out.append(_message("", "word-table", bucket, len(total), _pack(b"\x00".join(sorted(total))), None, _pack(np.fromiter((total[w] for w in sorted(total)), np.int64, len(total)))))
    out += _count_of_counts(bucket, counts)
    return _rows(out)


def _count_of_counts(bucket: int, counts: np.ndarray) -> list[tuple]:
    """How many n-grams of a bucket occur once, twice, ... up to the last count that discounts need, and how many more often."""
    many = np.bincount(np.minimum(counts, DISCOUNTED + 2), minlength=DISCOUNTED + 3).tolist()
    return [_message("", "repeats", r, n) for r, n in enumerate(many) if r and n]


class _Read:
    """A block with the answers of the first round: documents as sequences of local words."""

    def __init__(self, buckets: int, group: pd.DataFrame):
        text = group[group["kind"] == "texts"].iloc[0]
        self.name = text["block"]
        self.tokens, self.lengths = _unpack(text["a"], np.int32).astype(np.int64), _unpack(text["b"])
        self.keys = _unpack(text["c"])
        self.train, self.null = _unpack(text["d"], np.int8).reshape(2, -1).astype(bool)
        answers = group[group["kind"] == "word-counts"]
        self.ids, self.counts = np.zeros(int(answers["number"].sum()), np.int64), np.zeros(int(answers["number"].sum()), np.int64)
        for row in answers.itertuples(index=False):
            own = _from_steps(row.b)
            self.ids[own], self.counts[own] = _unpack(row.a) * buckets + row.bucket, _unpack(row.c)
        # Distinct pairs of the block: local first word (0: start of text) times local words, plus local second word.
        starts = np.cumsum(self.lengths) - self.lengths
        first = np.roll(self.tokens, 1) + 1
        first[starts] = 0
        self.starts, self.width = starts, len(self.ids)
        self.pairs, self.pair_of = np.unique(first * self.width + self.tokens, return_inverse=True)
        self.first, self.second = self.pairs // self.width, self.pairs % self.width
        self.first_ids = np.concatenate([[START_ID], self.ids])[self.first]

    def order(self, buckets: int, hot: int, first_counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs in the order in which they are sent, and the bucket of each: that of the first word, or one of the
        next few by the second word, as many as its count needs."""
        seconds = self.ids[self.second]
        mixed = (self.first_ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        spread = np.where(first_counts > hot, first_counts // hot + 1, 1).astype(np.uint64)
        step = (seconds.astype(np.uint64) + np.uint64(7)) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(32)
        place = (((mixed >> np.uint64(32)) + step % spread) % np.uint64(buckets)).astype(np.int64)
        return np.lexsort((self.first_ids, seconds, place)), place


def _ask_pairs(buckets: int, hot: int, documents: int, group: pd.DataFrame) -> pd.DataFrame:
    """The distinct pairs of one block: both words' numbers, training count, and counts of both words."""
    block = _Read(buckets, group)
    counts = np.bincount(block.pair_of[np.repeat(block.train, block.lengths)], minlength=len(block.pairs))
    first_counts = np.concatenate([[documents], block.counts])[block.first]
    order, place = block.order(buckets, hot, first_counts)
    cuts = np.flatnonzero(np.diff(place[order], prepend=-1)).tolist() + [len(order)]
    out = []
    for low, high in zip(cuts, cuts[1:], strict=False):
        own = order[low:high]
        firsts, index, which = np.unique(block.first_ids[own], return_index=True, return_inverse=True)
        hot_first = first_counts[own][index] > hot
        seconds, lower = block.ids[block.second[own]], block.counts[block.second[own]]
        out.append(_message(
            block.name, "pairs", int(place[own[0]]), len(own), _pack(np.stack([np.diff(firsts, prepend=0), hot_first])),
            _pack(which.astype(np.int32)), _steps(seconds), _pack(np.stack([counts[own], np.diff(lower, prepend=0)])),
        ))
    return _rows(out)


def _count_pairs(words: Words, group: pd.DataFrame) -> pd.DataFrame:
    """Add up a bucket's pairs; answer each block with the counts of its pairs and the sums of their first words.

    The sums of a first word are its count as a history, the word-level probability of all that followed it, and how
    many of its pairs occur 1, 2, ... times, from which the discounted mass follows once discounts are known.  Sums of a
    word that is spread over buckets are parts, and are also given under ``hot``.
    """
    asked, first, second, count, lower, hot_words = [], [], [], [], [], set()
    for row in group.itertuples(index=False):
        steps, hot = _unpack(row.a).reshape(2, -1)
        asked.append(np.cumsum(steps))
        hot_words.update(asked[-1][hot > 0].tolist())
        first.append(asked[-1][_unpack(row.b, np.int32)])
        second.append(_from_steps(row.c))
        known, steps = _unpack(row.d).reshape(2, -1)
        count.append(known)
        lower.append(np.cumsum(steps))
    first, second, count, lower = (np.concatenate(x) for x in (first, second, count, lower))
    order = np.lexsort((second, first))
    new_first = np.diff(first[order], prepend=first[order[0]] - 1) != 0
    new_pair = new_first | (np.diff(second[order], prepend=second[order[0]] - 1) != 0)
    at = np.flatnonzero(new_pair)
    total = np.add.reduceat(count[order], at)
    pair_of = np.empty(len(order), np.int64)
    pair_of[order] = np.cumsum(new_pair) - 1
    history = (np.cumsum(new_first) - 1)[at]
    histories = first[order][new_first]
    seen = total > 0
    sums = np.zeros((DISCOUNTED + 2, len(histories)))
    sums[0] = np.bincount(history, weights=total, minlength=len(histories))
    sums[1] = np.bincount(history, weights=words.probability(lower[order][at]) * seen, minlength=len(histories))
    for r in range(1, DISCOUNTED + 1):
        sums[1 + r] = np.bincount(history, weights=total == r, minlength=len(histories))
    bucket = int(group["bucket"].iat[0])
    out = _count_of_counts(bucket, total[seen])
    for word in sorted(hot_words):
        out.append(_message("", "hot", bucket, word, _pack(sums[:, np.searchsorted(histories, word)])))
    low = 0
    for row, firsts in zip(group.itertuples(index=False), asked, strict=True):
        own = sums[:, np.searchsorted(histories, firsts)]
        out.append(_message(row.block, "pair-counts", bucket, row.number, _pack(total[pair_of[low : low + row.number]]), _pack(own)))
        low += row.number
    return _rows(out)


def _add_parts(group: pd.DataFrame) -> pd.DataFrame:
    total = np.sum([_unpack(a, np.float64) for a in group["a"]], axis=0)
    return _rows([_message("", "hot", 0, int(group["number"].iat[0]), _pack(total))])


def _hot_wanted(buckets: int, hot: int, documents: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Which blocks hold which first words that are spread over several buckets."""
    for batch in batches:
        for row in batch.itertuples(index=False):
            ids = _unpack(row.a)[_unpack(row.c) > hot] * buckets + row.bucket
            if documents > hot:
                ids = np.append(ids, START_ID)
            yield pd.DataFrame({"block": row.block, "number": ids})


def _score(buckets: int, hot: int, documents: int, words: Words, factors: np.ndarray, group: pd.DataFrame) -> pd.DataFrame:
    """Scores of a block's documents, token by token: the pair if it was seen, else the backoff weight times the word."""
    block = _Read(buckets, group)
    first_counts = np.concatenate([[documents], block.counts])[block.first]
    order, place = block.order(buckets, hot, first_counts)
    answers = {row.bucket: row for row in group[group["kind"] == "pair-counts"].itertuples(index=False)}
    parts = {row.number: _unpack(row.a, np.float64) for row in group[group["kind"] == "hot"].itertuples(index=False)}
    total, sums = np.zeros(len(order), np.int64), np.zeros((DISCOUNTED + 2, len(order)))
    cuts = np.flatnonzero(np.diff(place[order], prepend=-1)).tolist() + [len(order)]
    for low, high in zip(cuts, cuts[1:], strict=False):
        own = order[low:high]
        answer = answers[int(place[own[0]])]
        total[own] = _unpack(answer.a)
        which = np.unique(block.first_ids[own], return_inverse=True)[1]
        sums[:, own] = _unpack(answer.b, np.float64).reshape(DISCOUNTED + 2, -1)[:, which]
    for i in np.flatnonzero(first_counts > hot).tolist():
        sums[:, i] = parts[int(block.first_ids[i])]
    history, followed, repeats = sums[0], sums[1], sums[2:]
    singles = np.arange(1, DISCOUNTED + 1)[:, None] * repeats
    mass = history - singles.sum(axis=0) + (factors[1 : DISCOUNTED + 1, None] * singles).sum(axis=0)
    divisor = np.where(mass < history, history, history + 1)
    word = words.probability(block.counts)[block.second]
    backoff = np.where(history > 0, (1 - mass / divisor) / np.maximum(1 - followed, words.unknown), 1.0)
    seen = total * factors[np.minimum(total, DISCOUNTED + 1)] / divisor
    logs = np.log10(np.where(total > 0, seen, backoff * word))[block.pair_of]
    base = np.log10((block.counts + 0.5) / (words.total + 0.5 * (words.distinct + 1)))[block.tokens]
    known = (block.counts > 0)[block.tokens]
    at = block.starts
    return pd.DataFrame({
        "_key": pd.arrays.IntegerArray(block.keys.copy(), np.array(block.null, bool)),
        "_train": block.train, "n_tokens": block.lengths, "n_known": np.add.reduceat(known.astype(np.int64), at), "train_tokens": words.total,
        "base_score": np.add.reduceat(base, at), "score": np.add.reduceat(logs, at),
    })


def _repeats(table: DataFrame) -> dict[int, int]:
    rows = table.where("kind = 'repeats'").groupBy("bucket").agg(F.sum("number").alias("n")).collect()
    return {r["bucket"]: r["n"] for r in rows}


def _discounted(repeats: dict[int, int], factors: np.ndarray, total: int) -> float:
    own = {r: r * n for r, n in repeats.items() if r <= DISCOUNTED}
    return total - sum(own.values()) + sum(factors[r] * n for r, n in own.items())


def katz_scores(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Score every whole text by a word-pair Katz model of the rows where ``train`` holds.

    Returns key, ``trained``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` for every row; keys
    are longs.  Tokens are the words with A-Z lower-cased, and one end of text; null counts as empty, and has the end
    only.  ``score`` is the log10 probability of the text: for each token the discounted count of the pair over that of
    its history if the pair was seen, else the history's backoff weight times the word's own probability; a history that
    was never seen has weight 1.  Words never seen share what the discounts of words leave.  Where discounts leave
    nothing, a history (or the word level) is counted once more, so probabilities always add up to 1.  ``base_score`` is the smoothed
    word-count score.  Repeated rows are separate documents.  Without training rows every token has probability 1.

    Counts cover all rows.  The tables lie in the shared folder, partitioned into buckets whose number follows the bytes
    of text; what reaches the driver is sums and counts of counts.
    """
    number = F.col(key).cast("long")
    # No null among the keys on their way to Python, which would make floats of the others.
    rows = docs.select(
        F.coalesce(number, F.lit(0)).alias("_key"), number.isNull().alias("_null"), F.coalesce(train, F.lit(False)).alias("_train"),
        F.col(text).cast("string").alias("_text"),
    )
    size = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    buckets = max(1, math.ceil(size / BUCKET_BYTES))
    block_tokens = BLOCK_TOKENS
    texts = durable(rows.mapInPandas(lambda it: _blocks(buckets, block_tokens, it), _MESSAGE))
    sizes = texts.where("kind = 'texts'").agg(F.sum("number").alias("n"), F.sum("bucket").alias("d")).first()
    total, documents = sizes["n"] or 0, sizes["d"] or 0
    hot = max(1, int(HOT_SHARE * total / buckets))

    word_table = durable(texts.where("kind = 'words'").groupBy("bucket").applyInPandas(lambda g: _count_words(g), _MESSAGE))
    repeats = _repeats(word_table)
    factors = good_turing(repeats)
    words = Words(total, sum(repeats.values()), factors).settle(_discounted(repeats, factors, total))

    blocks = texts.where("kind = 'texts'").union(word_table.where("kind = 'word-counts'"))
    asked = blocks.groupBy("block").applyInPandas(lambda g: _ask_pairs(buckets, hot, documents, g), _MESSAGE)
    pair_table = durable(asked.groupBy("bucket").applyInPandas(lambda g: _count_pairs(words, g), _MESSAGE))
    pair_factors = good_turing(_repeats(pair_table))

    parts = pair_table.where("kind = 'hot'").groupBy("number").applyInPandas(_add_parts, _MESSAGE)
    wanted = word_table.where("kind = 'word-counts'").select("block", "bucket", "a", "c")
    wanted = wanted.mapInPandas(lambda it: _hot_wanted(buckets, hot, documents, it), "block string, number long").distinct()
    parts = wanted.join(parts.drop("block"), "number").select(*parts.columns)
    answered = blocks.union(pair_table.where("kind = 'pair-counts'")).union(parts)
    schema = "_key long, _train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out = answered.groupBy("block").applyInPandas(lambda g: _score(buckets, hot, documents, words, pair_factors, g), schema)
    return out.withColumnsRenamed({"_key": key, "_train": "trained"})
