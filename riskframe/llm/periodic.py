"""Periodic runs of words, found by internal pattern matching.

A run is a stretch of words that repeats with a smallest period q, holds at least four periods (and six words), and that
no neighbouring word extends.  Blocks of ``b`` words (b a power of two) start at every multiple of ``b / 2``.  Each block
asks for its next occurrence, at most ``b`` words on: a range successor over the suffix array, answered by a wavelet
tree.  A block's occurrences in so short a window form a progression, whose difference is the candidate period.

No run is missed: take the block size with ``q <= b < 2 q``.  A run of 4 q words leaves ``q + 2 > b / 2`` starts for a
block that ends a period before the run does, so some block starts there.  Was it to occur again after ``r < q`` words,
its stretch would have the periods q and r and at least ``q + r`` words, so the run would have a smaller period than q.
For the same reason a stretch that is found and long enough has no smaller period.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_WORDS = 6
LEAST_PERIODS = 4
#: Texts are searched together until they hold so many words; a longer text is searched alone.
BATCH_WORDS = 1 << 18
RUN_TYPE = "array<struct<start: bigint, length: bigint, period: bigint>>"


def _classes(symbols: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order of their first words, and the queries of all block sizes.

    ``order`` lists the suffixes that share their first two words with another one, as far as blocks tell them apart.
    A query is a row ``(size, start, low, high)``: suffixes ``order[low:high]`` begin with the block.  Only suffixes that
    are not yet alone are sorted again when block sizes double.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    fresh = np.ones(n, bool)
    fresh[1:] = symbols[order[1:]] != symbols[order[:-1]]
    slots = np.arange(n)
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    asked, kept, size = [], None, 1
    while True:
        # ``slots`` are the places in ``order`` of suffixes not yet alone; ``fresh`` marks the first of each class.
        first = np.flatnonzero(fresh)
        counts = np.diff(np.append(first, len(slots)))
        low = np.repeat(slots[first], counts)
        rank[order[slots]] = low
        many = np.repeat(counts > 1, counts)
        slots, low, counts = slots[many], low[many], np.repeat(counts, counts)[many]
        if size == 2:
            kept = slots
        if size >= 2:
            starts = order[slots]
            block = starts % (size // 2) == 0
            asked.append(np.stack([np.full(block.sum(), size), starts[block], low[block], low[block] + counts[block]]))
        if not len(slots) or size * 2 > longest // 2:
            break
        here = order[slots]
        then = rank[np.minimum(here + size, n)]
        again = np.lexsort((then, low))
        order[slots], low, then = here[again], low[again], then[again]
        fresh = np.ones(len(slots), bool)
        fresh[1:] = (low[1:] != low[:-1]) | (then[1:] != then[:-1])
        size *= 2
    if kept is None or not len(kept):
        return np.zeros(0, np.int64), np.zeros((4, 0), np.int64)
    queries = np.concatenate(asked, axis=1)
    # Places are counted among the listed suffixes only; the classes of two words are whole there.
    queries[2:] = np.searchsorted(kept, queries[2:])
    return order[kept], queries


def _next_in_range(values: np.ndarray, low: np.ndarray, high: np.ndarray, after: np.ndarray) -> np.ndarray:
    """For each query the least of ``values[low:high]`` above ``after``, or -1, by a wavelet tree over distinct values."""
    ranked = np.sort(values)
    codes, bound = np.searchsorted(ranked, values), np.searchsorted(ranked, after, "right")
    bits = max(1, int(len(values)).bit_length())
    zeros, halves = [], []
    for bit in range(bits - 1, -1, -1):
        ones = (codes >> bit & 1).astype(bool)
        zeros.append(np.concatenate([[0], np.cumsum(~ones)]))
        halves.append(int(zeros[-1][-1]))
        codes = np.concatenate([codes[~ones], codes[ones]])
    # How many in the range lie below the bound ...
    below, a, b = np.zeros(len(low), np.int64), low, high
    for level, bit in enumerate(range(bits - 1, -1, -1)):
        one = (bound >> bit & 1).astype(bool)
        a0, b0 = zeros[level][a], zeros[level][b]
        below = below + np.where(one, b0 - a0, 0)
        a, b = np.where(one, halves[level] + a - a0, a0), np.where(one, halves[level] + b - b0, b0)
    # ... and the next one in order of value.
    some = below < high - low
    a, b, rest, code = low[some], high[some], below[some], np.zeros(some.sum(), np.int64)
    for level, bit in enumerate(range(bits - 1, -1, -1)):
        a0, b0 = zeros[level][a], zeros[level][b]
        one = rest >= b0 - a0
        rest, code = np.where(one, rest - (b0 - a0), rest), np.where(one, code | 1 << bit, code)
        a, b = np.where(one, halves[level] + a - a0, a0), np.where(one, halves[level] + b - b0, b0)
    out = np.full(len(low), -1, np.int64)
    out[some] = ranked[code]
    return out


def _reach(symbols: np.ndarray, at: int, period: int, step: int) -> int:
    """How many words from ``at`` on, forwards or backwards, equal the word a period later."""
    limit = len(symbols) - period - at if step > 0 else at + 1
    done, piece = 0, 16
    while done < limit:
        take = min(piece, limit - done)
        if step > 0:
            same = symbols[at + done : at + done + take] == symbols[at + done + period : at + done + period + take]
        else:
            end = at - done + 1
            same = (symbols[end - take : end] == symbols[end - take + period : end + period])[::-1]
        if not same.all():
            return done + int(np.argmin(same))
        done, piece = done + take, piece * 2
    return done


def runs_of(symbols: np.ndarray, longest: int) -> np.ndarray:
    """All runs ``(start, length, period)`` of a sequence, by start and then period; no run is longer than ``longest``."""
    none = np.zeros((0, 3), np.int64)
    if longest < LEAST_WORDS:
        return none
    order, (size, start, low, high) = _classes(symbols, longest)
    if not len(start):
        return none
    period = _next_in_range(order, low, high, start) - start
    # A block finds periods above half its size, the smallest one also period 1.
    good = (period > 0) & (period <= size) & ((period > size // 2) | (size == 2))
    size, start, period = size[good], start[good], period[good]
    by = np.lexsort((start, period))
    size, start, period = size[by], start[by], period[by]
    if not len(start):
        return none
    # Blocks of one period that touch belong to one run.
    apart = np.ones(len(start), bool)
    apart[1:] = (period[1:] != period[:-1]) | (start[1:] > start[:-1] + size[:-1])
    first = np.flatnonzero(apart)
    last = np.append(first[1:], len(start)) - 1
    found = set()
    for q, a, e in zip(period[first].tolist(), start[first].tolist(), (start + size)[last].tolist(), strict=True):
        a -= _reach(symbols, a - 1, q, -1)
        e += _reach(symbols, e, q, 1)
        if e - a + q >= max(LEAST_WORDS, LEAST_PERIODS * q):
            found.add((a, e - a + q, q))
    return np.array(sorted((a, n, q) for a, n, q in found), np.int64).reshape(-1, 3)


def _collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words outside of runs and those of each run's first period, joined by one space."""
    if len(runs):
        edges = np.zeros(len(words) + 1, np.int64)
        np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
        np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
        words = [w for w, inside in zip(words, np.cumsum(edges).tolist(), strict=False) if not inside]
    return b" ".join(words)


def _searched(texts: list[list[bytes]]) -> list[np.ndarray]:
    """Runs of several texts at once.  No symbol occurs in two texts, so no block occurs in another text than its own."""
    names, symbols, starts = {}, [], []
    longest = 0
    for words in texts:
        starts.append(len(symbols))
        symbols += [names.setdefault(w, len(names)) for w in words]
        symbols.append(-1)
        longest = max(longest, len(words))
    own = np.array(symbols, np.int64)
    bounds = np.array(starts + [len(own)], np.int64)
    ends = bounds[1:] - 1
    # Every text has its own range of symbols, and an end that equals no other.
    own += np.repeat(np.arange(len(texts)), np.diff(bounds)) * (len(names) + 1) + 1
    own[ends] = (len(names) + 1) * len(texts) + np.arange(len(texts))
    runs = runs_of(own, longest)
    cuts = np.searchsorted(runs[:, 0], bounds)
    return [runs[a:b] - np.array([s, 0, 0]) for a, b, s in zip(cuts[:-1], cuts[1:], starts, strict=True)]


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def packed(keys, texts):
        found = _searched(texts)
        offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
        flat = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
        values = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(run))
        collapsed = pa.array([_collapsed(w, r) for w, r in zip(texts, found, strict=True)], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays(
            [keys, pa.ListArray.from_arrays(pa.array(offsets), values), collapsed], ["_key", "runs", "collapsed"]
        )

    for batch in batches:
        # Keys stay Arrow values: a null among them must not turn the others into floats.
        keys, texts, words, first = batch.column(0), [], 0, 0
        for i, text in enumerate(batch.column(1)):
            texts.append(((text.as_py() or "").encode()).split())
            words += len(texts[-1])
            if words >= BATCH_WORDS or i + 1 == batch.num_rows:
                yield packed(keys.slice(first, i + 1 - first), texts)
                texts, words, first = [], 0, i + 1


def word_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: the key, ``runs`` (start and length in words, period; by start, then period) and
    ``collapsed``, the text with only the first period of every run, its words joined by one space.

    Words are what stands between ASCII white space.  A null or wordless text has no runs and collapses to an empty text.
    Rows are searched alone, so null, repeated or tied keys need nothing, other columns of ``docs`` are not looked at,
    and there is no shuffle.  Memory grows with the longest text only.
    """
    rows = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    kind = rows.schema["_key"].dataType.simpleString()
    out = rows.mapInArrow(_batches, f"_key {kind}, runs {RUN_TYPE}, collapsed string")
    return out.withColumnRenamed("_key", key)


def repeated_tails(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and text, with a periodic tail planted in one text of ten, chosen by crc32 of the key as text: words from a chosen
    place on repeat the words there with a chosen period.  Texts that are not chosen, or hold no word, stay as they are.
    """
    h = F.crc32(F.col(key).cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.regexp_extract_all(F.col(text).cast("string"), F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0)))
    out = docs.select(F.col(key), F.col(text)).withColumn("_w", words).withColumn("_n", F.size("_w")).withColumn("_g", F.floor(h / 10))
    out = out.withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")).cast("int"))
    out = out.withColumn("_p", (1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int"))
    unit = F.slice("_w", F.col("_a") + 1, F.col("_p"))
    times = F.ceil((F.col("_n") - F.col("_a")) / F.col("_p")).cast("int")
    whole = F.slice(F.concat(F.slice("_w", F.lit(1), F.col("_a")), F.flatten(F.array_repeat(unit, times))), F.lit(1), F.col("_n"))
    changed = F.when(F.col("_n") > 0, F.array_join(whole, " ")).otherwise(F.col(text))
    return out.withColumn(text, changed).drop("_w", "_n", "_g", "_a", "_p")


def run_digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The run of greatest length (then smallest start and period) of each text, and digests of all runs and of the
    collapsed text; without a run the four numbers are null and the digest is that of an empty text.
    """
    out = word_runs(docs.select(key, text), key, text)
    rank = F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period")))
    best, n_runs = F.array_min(rank), F.size("runs").cast("long")
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    out = out.select(key, "collapsed", n_runs.alias("n_runs"), best.alias("_b"), F.array_join(lines, "").alias("_lines"))
    length, period = -F.col("_b.n"), F.col("_b.period")
    return out.select(
        key, "n_runs", F.col("_b.start").alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"), F.sha2("_lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
