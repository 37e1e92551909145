"""Row predicates: the user filter language, blank handling, substring lists."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.session import durable

# Characters that part words: ASCII other than letters and digits.  The mark is one of them.
_PARTING = r"[\x00-/:-@\[-`{-\x7f]"
_MARK = "\x01"

# The fourteen filter operators.
OPERATORS = (
    "EQUALS",
    "NOT EQUALS",
    "GREATER THAN",
    "LESS THAN",
    "GREATER THAN OR EQUAL",
    "LESS THAN OR EQUAL",
    "IN",
    "NOT IN",
    "IS MISSING",
    "IS NOT MISSING",
    "CONTAINS",
    "NOT CONTAINS",
    "STARTS WITH",
    "ENDS WITH",
)


def predicate(column: str, operator: str, values: object = None) -> Column:
    """A filter condition.  Text is matched literally, wildcards included.

    EQUALS null means missing, NOT EQUALS null means present.  Several values for
    a text operator mean any of them (none of them for NOT CONTAINS).
    """
    col = F.col(column)
    many = list(values) if isinstance(values, (list, tuple, set)) else [values]
    one = many[0] if many else None
    match operator.upper():
        case "EQUALS":
            return col.isNull() if one is None else col == F.lit(one)
        case "NOT EQUALS":
            return col.isNotNull() if one is None else col != F.lit(one)
        case "GREATER THAN":
            return col > F.lit(one)
        case "LESS THAN":
            return col < F.lit(one)
        case "GREATER THAN OR EQUAL":
            return col >= F.lit(one)
        case "LESS THAN OR EQUAL":
            return col <= F.lit(one)
        case "IN":
            return col.isin(many)
        case "NOT IN":
            return ~col.isin(many)
        case "IS MISSING":
            return col.isNull()
        case "IS NOT MISSING":
            return col.isNotNull()
        case "CONTAINS":
            return any_of([col.contains(v) for v in many])
        case "NOT CONTAINS":
            return ~any_of([col.contains(v) for v in many])
        case "STARTS WITH":
            return any_of([col.startswith(v) for v in many])
        case "ENDS WITH":
            return any_of([col.endswith(v) for v in many])
    raise ValueError(f"unknown filter operator {operator!r}")


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def filter_group(conditions: Sequence[Column], logical: str = "AND") -> Column:
    """Join conditions with AND or OR."""
    return {"AND": all_of, "OR": any_of}[logical.upper()](conditions)


def filter_options(df: DataFrame, column: str, limit: int = 100) -> DataFrame:
    """The first distinct values of a column, ascending, as text."""
    values = df.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column).limit(limit)
    return values.select(F.col(column).cast("string").alias("option"))


def contains_any(column: str, terms: Sequence[str], chunk: int = 200) -> Column:
    """Whether the text holds any term, in any case; null text gives false.

    For a list known to the caller: a few quoted alternations, so no pattern
    grows without bound.
    """
    text = F.col(column)
    groups = [terms[i : i + chunk] for i in range(0, len(terms), chunk)]
    tests = [text.rlike("(?iu)" + "|".join(re.escape(t) for t in g)) for g in groups]
    return F.coalesce(any_of(tests), F.lit(False)) if tests else F.lit(False)


def with_any_term(df: DataFrame, key: str, text: str, terms: DataFrame, term: str) -> DataFrame:
    """Rows whose text holds any term of a table, in any case, however long the table is.

    A term is cut at characters that part words.  A word inside it must stand in the text as it is, its first and last piece
    at the end and the start of one.  Pieces are looked up in the vocabulary of all texts, not in the texts; each term is listed
    under the words of its rarest piece, a text's own words fetch terms, and each fetched term is then looked for whole.
    Null text and blank terms match nothing.
    """
    wanted = durable(terms.select(F.lower(term).alias("_t")).where(F.length(F.trim("_t")) > 0).distinct())
    texts = df.where(F.col(text).isNotNull()).select(F.col(key).alias("_k"), F.lower(text).alias("_x"))
    bare = F.col("_t").rlike(rf"^{_PARTING}+\z")
    spread = F.split("_x", f"{_PARTING}+")
    if not wanted.where(bare).isEmpty():
        # Terms that no word belongs to are looked for in what parts words.
        spread = F.concat(spread, F.split("_x", _PARTING.replace("[", "[^", 1) + "+"))
    # Not an inner explode: Spark would derive a filter from it that splits every text once more.
    held = texts.select("_k", F.explode_outer(F.array_distinct(spread)).alias("_w")).where("_w <> ''")
    vocabulary = durable(held.groupBy("_w").agg(F.count(F.lit(1)).alias("_n")))

    # Words stand between marks that no word holds: a piece with a mark is the start or the end of a word, with two a word.
    pieces = F.split("_t", f"{_PARTING}+")
    last = F.size(pieces) - 1
    marked = F.transform(pieces, lambda p, i: F.when(p != "", F.concat(F.when(i > 0, F.lit(_MARK)).otherwise(F.lit("")), p, F.when(i < last, F.lit(_MARK)).otherwise(F.lit("")))))
    cut = wanted.select("_t", F.explode(F.when(bare, F.array("_t")).otherwise(F.array_distinct(marked))).alias("_p")).where("_p IS NOT NULL")
    cut = durable(cut)

    def grams(whole: str, size: int) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(whole) - (size - 1)))
        return F.array_distinct(F.transform(places, lambda i: F.substring(F.col(whole), i, F.lit(size))))

    short = F.when(F.length("_p") == 1, grams("_p", 1)).when(F.length("_p") == 2, grams("_p", 2)).otherwise(grams("_p", 3))
    asked = cut.select("_p").distinct().select("_p", F.explode(F.slice(short, 1, 8)).alias("_g"))
    words = vocabulary.select("_w", F.concat(F.lit(_MARK), "_w", F.lit(_MARK)).alias("_m"))
    index = words.select("_w", "_m", F.explode(F.array_distinct(F.concat(*[grams("_m", n) for n in (1, 2, 3)]))).alias("_g"))
    index = index.join(asked.select("_g").distinct(), "_g", "left_semi")
    sizes = index.groupBy("_g").agg(F.count(F.lit(1)).alias("_c"))
    rarest = durable(asked.join(sizes, "_g").groupBy("_p").agg(F.min(F.struct("_c", "_g"))["_g"].alias("_g")))
    found = durable(index.join(rarest, "_g").where(F.contains("_m", "_p")).select("_p", "_w"))
    often = found.join(vocabulary, "_w").groupBy("_p").agg(F.sum("_n").alias("_n"))
    # A piece that no word holds is rarest of all: its term is in no text.
    chosen = cut.join(often, "_p", "left").groupBy("_t").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)), "_p"))["_p"].alias("_p"))
    listed = durable(chosen.join(found, "_p").select("_w", "_t"))
    fetched = held.join(listed, "_w").select("_k", "_t")
    return df.join(fetched, (F.col(key) == F.col("_k")) & F.contains(F.lower(text), "_t"), "left_semi")


def blank_to_null(df: DataFrame) -> DataFrame:
    """Empty or white-space text becomes null in every text column."""
    text = {f.name for f in df.schema.fields if f.dataType.simpleString() == "string"}
    return df.select(
        *[
            F.when(~F.col(c).rlike(r"^\s*$"), F.col(c)).alias(c) if c in text else F.col(c)
            for c in df.columns
        ]
    )


# Name parts of helper columns that never enter a model.
REMOVABLE_NAME_PARTS = ("spt_", "phase", "description", "IsTagged", "_Score", "loaded")


def without_helper_columns(
    df: DataFrame, keep: Sequence[str] = (), parts: Sequence[str] = REMOVABLE_NAME_PARTS
) -> DataFrame:
    """Drop columns whose name holds a helper part, in any case, unless kept by name."""
    lowered = [p.lower() for p in parts]
    names = [c for c in df.columns if c in keep or not any(p in c.lower() for p in lowered)]
    return df.select(*names)


def not_flagged(column: str) -> Column:
    """Keep rows whose flag is not true; a missing flag keeps the row."""
    from riskframe.frames import truthy

    return ~truthy(column)


def answered(question: str, answer: str, wanted: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """Rows answering any of the (question, accepted answers) pairs."""
    if not wanted:
        return F.lit(False)
    return F.coalesce(
        any_of([(F.col(question) == q) & F.col(answer).isin(list(options)) for q, options in wanted]),
        F.lit(False),
    )


def target_from_lists(df: DataFrame, key: str, concern: DataFrame, no_concern: DataFrame) -> DataFrame:
    """``target`` 1 for keys in ``concern``, 0 for those in ``no_concern``, else null.

    The key lists are frames, so they may be as long as the data.
    """
    ones = concern.select(F.col(key)).distinct().withColumn("_one", F.lit(1))
    zeros = no_concern.select(F.col(key)).distinct().withColumn("_zero", F.lit(0))
    marked = df.join(ones, key, "left").join(zeros, key, "left")
    return marked.select(*df.columns, F.coalesce("_one", "_zero").alias("target"))
