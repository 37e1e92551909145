"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.common import connected, source_key
from riskframe.session import durable

RADIUS = 3
SHINGLE = 3
SEED = 42
BITS = 64
# Three blocks of bits; two fingerprints within 3 bits differ in 2 bits or fewer outside at least one of them.
BLOCKS = ((0, 21), (21, 42), (42, 64))
BATCH_SHINGLES = 1 << 20


def _hashes(text: str, shingle: int, digest) -> list[int]:
    """Hashes of all shingles of one text; they are substrings of the words joined by single spaces."""
    # On bytes, lower() and split() know ASCII only: A-Z, and the six white-space characters of the word pattern.
    words = text.encode().lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    ends = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32).tolist() + [len(joined)]
    starts = [0] + [e + 1 for e in ends[:-1]]
    last = min(shingle, len(words)) - 1
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[last:], strict=False)]


def _majorities(hashes: list[int], counts: list[int]) -> np.ndarray:
    """Fingerprints from the hashes of several texts in a row: bits set in over half of a text's hashes."""
    counts = np.array(counts, np.int64)
    out = np.zeros(len(counts), np.uint64)
    some = counts > 0
    if some.any():
        bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = (np.cumsum(counts) - counts)[some]
        # Eight one-byte counters are added at once, so no run is longer than 255 rows.
        runs = np.union1d(starts, np.arange(0, len(hashes), 255))
        part = np.add.reduceat(bits.view(np.uint64), runs, axis=0).view(np.uint8)
        ones = np.add.reduceat(part, np.searchsorted(runs, starts), axis=0, dtype=np.int32)
        out[some] = np.packbits(2 * ones > counts[some, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def _long_fingerprint(hashes: list[int]) -> int:
    """The fingerprint of one text with many shingles, its bits counted in bounded pieces."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), BATCH_SHINGLES):
        part = np.array(hashes[i : i + BATCH_SHINGLES], np.uint64).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(shingle: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh64_intdigest
    for batch in batches:
        prints = np.zeros(batch.num_rows, np.uint64)
        hashes, counts, first = [], [], 0
        for i, text in enumerate(batch.column(1)):
            text = text.as_py()
            own = _hashes(text, shingle, digest) if text else []
            if len(own) > BATCH_SHINGLES:
                prints[i] = _long_fingerprint(own)
                own = []
            hashes += own
            counts.append(len(own))
            if len(hashes) > BATCH_SHINGLES or i + 1 == batch.num_rows:
                prints[first : i + 1] |= _majorities(hashes, counts)
                hashes, counts, first = [], [], i + 1
        # Keys stay Arrow values: beside a null, pandas would turn longs into floats.
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["_key", "_print"])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(_key, _print)``: the 64-bit SimHash of each whole text, as a signed long.  Null and wordless texts get zero."""
    rows = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    schema = rows.select("_key").schema.add("_print", "long")
    return rows.mapInArrow(lambda it: _fingerprints(shingle, it), schema)


def _signed(bits: int) -> Column:
    return F.lit(bits - (1 << BITS) if bits >> (BITS - 1) else bits).cast("long")


def _balls(print_: Column) -> Column:
    """All keys of a fingerprint: for each block, the bits outside it, as they are and with each one of them flipped.

    That is the ball of radius 1, half of the 2 bits in which near fingerprints may differ there.  A key holds the block
    in place of the bits that it leaves out, so keys of different blocks never meet.
    """
    keys = []
    for number, (low, high) in enumerate(BLOCKS):
        inside = ((1 << high) - 1) ^ ((1 << low) - 1)
        outside = ~inside & ((1 << BITS) - 1)
        centre = print_.bitwiseAND(_signed(outside)).bitwiseOR(_signed(number << low))
        flips = [0] + [1 << bit for bit in range(BITS) if not low <= bit < high]
        keys += [centre.bitwiseXOR(_signed(f)) for f in flips]
    return F.array(*keys)


def near_links(prints: DataFrame) -> DataFrame:
    """All pairs ``(a, b)``, a < b, of distinct fingerprints that differ in 3 bits or fewer, from one column ``_print``.

    Two such fingerprints agree up to 2 bits outside one of three blocks, so their balls of radius 1 meet there.  Keys
    that only one fingerprint reaches go first; what is left is joined on the key and every pair is verified.
    """
    reached = prints.select("_print", F.explode(_balls(F.col("_print"))).alias("_ball"))
    reached = reached.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("_ball")))
    met = durable(reached.where("_n > 1").drop("_n"))
    left, right = met.select("_ball", F.col("_print").alias("a")), met.select("_ball", F.col("_print").alias("b"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)
    return left.join(right, "_ball").where(near).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs``: key, ``fingerprint`` (16 lowercase hex digits), ``component_id``.

    Fingerprints that differ in 3 bits or fewer are linked, and ``component_id`` is the smallest key that links reach,
    null only where all keys of a component are null.  Texts without words share fingerprint zero.  Repeated rows are
    linked with each other.

    Work after the first step is on distinct fingerprints, so a large group of copies is one of them from the start.
    """
    own = durable(fingerprints(docs, key, text, shingle))
    distinct = durable(own.groupBy("_print").agg(F.min("_key").alias("_least")))
    roots = durable(connected(near_links(distinct.select("_print"))))
    # A fingerprint without links is its own root.
    rooted = distinct.join(roots.withColumnRenamed("node", "_print"), "_print", "left").withColumn("_root", F.coalesce("root", "_print"))
    rooted = durable(rooted.select("_print", "_root", "_least"))
    least = durable(rooted.groupBy("_root").agg(F.min("_least").alias("component_id")))
    named = durable(rooted.join(least, "_root").select("_print", "component_id"))
    found = own.join(named, "_print")
    return found.select(F.col("_key").alias(key), F.lower(F.lpad(F.hex("_print"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each_group(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One document of each group of linked fingerprints: the one with the smallest key, all columns unchanged.

    The survivor is chosen per group and carries a digest of its text, so every group keeps exactly one row, whatever keys
    are null or shared by different texts.  A null key stays only where a group has no other.
    """
    digest = F.unhex(F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256))
    own = docs.select(F.struct(F.col(key).alias("k"), digest.alias("d")).alias("_id"), F.col(text).alias("_text"))
    own = durable(fingerprints(own, "_id", "_text", shingle))
    roots = durable(connected(near_links(durable(own.select("_print").distinct())))).withColumnRenamed("node", "_print")
    # Copies of a text are one candidate before roots are looked up, so a large group of them is no hot key of the join.
    first = F.min(F.struct(F.col("_key.k").isNull().alias("_null"), F.col("_key.k").alias("_key"), F.col("_key.d").alias("_digest")))
    best = durable(own.groupBy("_print").agg(first.alias("_s")))
    grouped = best.join(roots, "_print", "left").groupBy(F.coalesce("root", "_print").alias("_root")).agg(F.min("_s").alias("_s"))
    stay = durable(grouped.select(source_key("_s._key").alias("_key"), F.col("_s._digest").alias("_digest")))
    # Whole rows travel as one column, so no name of theirs can clash.
    named = docs.select(source_key(key).alias("_key"), digest.alias("_digest"), F.struct("*").alias("_row"))
    kept = named.join(stay, ["_key", "_digest"], "left_semi")
    return kept.groupBy("_key", "_digest").agg(F.first("_row").alias("_row")).select("_row.*")
