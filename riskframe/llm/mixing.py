"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.common import WORD, source_key
from riskframe.session import durable

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
SLICE_ROWS = 10_000


def _hex_number(text: Column, digits: int) -> Column:
    return F.conv(F.substring(text, 1, digits), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """Target size of each source from ``(source, source_size)``, one row per source.

    Sources in code-point order, null last, take the weights in turn and share the whole size.  No target is above
    ``most`` times its source; what is cut off is shared again by weight until none is above.  Sorted by cap over weight,
    the capped sources are a prefix, so the level at which the others meet has a closed form and needs no rounds.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int"))
    caps = sizes.withColumn("_w", weight.cast("long")).withColumn("_cap", F.col("source_size") * most)
    order = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before, after, whole = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / F.sum("_w").over(after)
    met = caps.withColumn("_level", level)
    open_level = F.when(F.col("_level") <= F.col("_cap") / F.col("_w"), F.col("_level"))
    met = met.withColumn("_level", F.max(open_level).over(whole))
    target = F.least(F.coalesce(F.col("_level"), F.lit(float("inf"))) * F.col("_w"), F.col("_cap").cast("double"))
    return met.select("source", "source_size", target.alias("target"))


def mixed(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text",
          weights: Sequence[int] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """Copies of each document in the mix: key, ``source``, ``size``, ``source_size``, ``target``, ``copies``, ``taken``.

    The size is the number of words, 0 for a null text.  Documents of a source stand in order of size band, then of the
    key's md5; each is expected ``target / source_size`` times, and is taken once for every whole number that the running
    sum of expected copies passes, beginning at an offset drawn from the source's name.  Near sizes are neighbours, so
    the words taken stay near the target.  Results depend on the rows alone; repeated rows are separate documents.

    The running sum is taken in slices of about ``SLICE_ROWS`` rows by ranges of the md5 within a band, so no source,
    however large, is in one task.  A source without words has rate 0.
    """
    size = F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    base = docs.select(F.col(key).alias("_key"), F.col(source).alias("source"), size.alias("size"))
    base = base.withColumn("_src", source_key("source")).withColumn("_md5", F.md5(F.coalesce(F.col("_key").cast("string"), F.lit("")).cast("binary")))
    base = durable(base.withColumn("_band", _band(F.col("size"))))
    bands = durable(base.groupBy("_src", "source", "_band").agg(F.count(F.lit(1)).alias("_n"), F.sum("size").alias("_size")))

    totals = bands.groupBy("source").agg(F.sum("_size").alias("source_size"))
    rates = source_targets(totals, weights, most).withColumn("_src", source_key("source")).drop("source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = (_hex_number(F.md5(F.col("_src").cast("binary")), 5) + 0.5) / float(1 << 20)
    rates = rates.withColumn("_rate", rate).withColumn("_offset", offset)

    slices = durable(bands.select("_src", "_band", F.ceil(F.col("_n") / SLICE_ROWS).alias("_slices")))
    sliced = base.join(slices, ["_src", "_band"])
    sliced = sliced.withColumn("_slice", F.floor(_hex_number(F.col("_md5"), 7) * F.col("_slices") / float(1 << 28)).cast("long"))
    running = Window.partitionBy("_src").orderBy("_band", "_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sliced.groupBy("_src", "_band", "_slice").agg(F.count(F.lit(1)).alias("_rows"))
    starts = starts.withColumn("_start", F.coalesce(F.sum("_rows").over(running), F.lit(0))).drop("_rows")
    starts = durable(starts.join(rates, "_src"))

    within = Window.partitionBy("_src", "_band", "_slice").orderBy("_md5", F.col("_key").asc_nulls_last(), "size")
    placed = sliced.join(starts, ["_src", "_band", "_slice"]).withColumn("_at", F.col("_start") + F.row_number().over(within))
    passed = lambda at: F.floor(F.col("_rate") * at + F.col("_offset"))
    copies = (passed(F.col("_at")) - passed(F.col("_at") - 1)).cast("long")
    out = placed.withColumn("copies", copies)
    return out.select(
        F.col("_key").alias(key), "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken")
    )


def _band(size: Column) -> Column:
    """Size classes an eighth of an octave or less wide, in order of size."""
    bits = F.length(F.bin(size))
    return (bits * 16 + F.floor(size / F.pow(F.lit(2.0), F.greatest(bits - 4, F.lit(0))))).cast("long")


def sample_mixture(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text",
                   weights: Sequence[int] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """The mix itself: every document as often as it is taken, all its columns unchanged.

    Repeated rows of one key, source and size share their copies as evenly as whole numbers allow.
    """
    by = ["_key", "_source", "_size"]
    chosen = mixed(docs, key, source, text, weights, most)
    turns = chosen.groupBy(source_key(key).alias("_key"), source_key("source").alias("_source"), F.col("size").alias("_size"))
    turns = durable(turns.agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows")).where("_copies > 0"))
    size = F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    named = docs.select(source_key(key).alias("_key"), source_key(source).alias("_source"), size.alias("_size"), F.xxhash64(text).alias("_hash"), F.struct("*").alias("_row"))
    joined = named.join(turns, by)
    nth = F.row_number().over(Window.partitionBy(*by).orderBy("_hash")) - 1
    own = F.floor(F.col("_copies") / F.col("_rows")) + (nth < F.col("_copies") % F.col("_rows")).cast("int")
    copies = joined.withColumn("_own", own.cast("int")).where("_own > 0")
    return copies.select("_row", F.explode(F.sequence(F.lit(1), F.col("_own")))).select("_row.*")


SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w,
        source_size * 3 AS cap FROM s),
l AS (SELECT *, ((SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size,
        least(coalesce((SELECT max(level) FROM l WHERE level <= cap / w), 'infinity'::DOUBLE) * w, cap::DOUBLE) AS target FROM l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
        (('0x' || substr(md5(CASE WHEN source IS NULL THEN '-' ELSE '+' || source END), 1, 5))::BIGINT + 0.5) / 1048576.0::DOUBLE AS shift0 FROM t),
o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY
        length(bin(size)) * 16 + floor(size / pow(2.0, greatest(length(bin(size)) - 4, 0))), md5(coalesce(doc_id::VARCHAR, '')), doc_id NULLS LAST) AS pos FROM d),
c AS (SELECT o.*, r.source_size, r.target, (floor(rate * pos + shift0) - floor(rate * (pos - 1) + shift0))::BIGINT AS copies
      FROM o JOIN r ON o.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, size * copies AS taken FROM c
"""
