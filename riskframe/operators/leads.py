"""Leads from web pages: paragraph text, organisation-like phrases, block-list.

Named-entity recognition is replaced by capitalised phrases and an optional
dictionary of names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Two or more capitalised words in a row.
PHRASE = r"(\p{Lu}[\p{L}&'-]+(?: \p{Lu}[\p{L}&'-]+)+)"


def paragraphs(html: Column | str) -> Column:
    """Text of every paragraph, tags dropped."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<p[^>]*>(.*?)</p>"), F.lit(1))
    return F.transform(found, lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, r"<[^>]*>", " "), r"\s+", " ")))


def page_leads(
    pages: DataFrame, uid: str, html: str, block: Sequence[str] = (), names: DataFrame | None = None, name: str = "name"
) -> DataFrame:
    """Distinct (uid, company) with block-listed names removed.

    ``names`` restricts the phrases to a dictionary by equi-join.
    """
    text = F.explode(paragraphs(html)).alias("_p")
    phrases = pages.select(uid, text).select(uid, F.explode(F.regexp_extract_all("_p", F.lit(PHRASE), F.lit(1))).alias("company"))
    blocked = [b.lower() for b in block]
    if blocked:
        phrases = phrases.where(~F.lower("company").isin(*blocked))
    if names is not None:
        known = names.select(F.lower(name).alias("_n")).distinct()
        phrases = phrases.join(known, F.lower("company") == F.col("_n"), "left_semi")
    return phrases.dropDuplicates([uid, "company"])
