"""Text cleaning, term counts, keyword flags and scripts."""

from __future__ import annotations

import re
import string
import sys
import unicodedata
from collections.abc import Sequence
from functools import lru_cache

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions.predicates import any_of
from riskframe.session import durable

_SPACES = r"(?U)\s+"


def _col(text: Column | str) -> Column:
    return F.col(text) if isinstance(text, str) else text


def tokens(text: Column | str) -> Column:
    """White-space separated words."""
    return F.filter(F.split(_col(text), _SPACES), lambda w: w != "")


def remove_digits(text: Column | str) -> Column:
    return F.translate(_col(text), string.digits, "")


def remove_punctuation(text: Column | str) -> Column:
    return F.translate(_col(text), string.punctuation, "")


def remove_short_words(text: Column | str, longer_than: int = 2) -> Column:
    return F.array_join(F.filter(tokens(text), lambda w: F.length(w) > longer_than), " ")


def remove_non_ascii(text: Column | str) -> Column:
    """Every character beyond ASCII becomes a space."""
    return F.regexp_replace(_col(text), r"[^\x00-\x7F]", " ")


def default_stop_words() -> list[str]:
    """Spark's own English list (needs a running session)."""
    return StopWordsRemover.loadDefaultStopWords("english")


def remove_stop_words(text: Column | str, words: Sequence[str]) -> Column:
    """Drop exact matches, upper and lower case told apart."""
    return F.array_join(F.filter(tokens(text), lambda w: ~w.isin(list(words))), " ")


def clean(
    text: Column | str,
    stop_words: Sequence[str] | None = None,
    digits: bool = True,
    punctuation: bool = True,
    short_words: bool = True,
    non_ascii: bool = True,
    stop: bool = True,
) -> Column:
    """The cleaning steps in order; each can be switched off, null stays null."""
    out = _col(text)
    if digits:
        out = remove_digits(out)
    if punctuation:
        out = remove_punctuation(out)
    if short_words:
        out = remove_short_words(out)
    if non_ascii:
        out = remove_non_ascii(out)
    if stop:
        out = remove_stop_words(out, default_stop_words() if stop_words is None else stop_words)
    return out


def clean_lower(text: Column | str, stop_words: Sequence[str] | None = None) -> Column:
    """Variant: lower case, short words, non-ASCII, punctuation and digits, stop words."""
    out = remove_non_ascii(remove_short_words(F.lower(_col(text))))
    out = F.translate(out, string.punctuation + string.digits, "")
    return remove_stop_words(out, default_stop_words() if stop_words is None else stop_words)


def lemmatize(df: DataFrame, key: str, text: str, lemmas: DataFrame, word: str, lemma: str) -> DataFrame:
    """Replace each word by its lemma where the user's table has one.

    Words are joined to the table, so it may be as large as it likes; a text is put
    together again from its own words only.  Texts are dealt by key before they are split:
    with a table small enough to broadcast, their words are not shuffled.
    """
    spread = df.select(key, text).repartition(key).select(key, F.posexplode(tokens(text)).alias("_at", "_w"))
    table = lemmas.groupBy(F.col(word).alias("_w")).agg(F.min(lemma).alias("_l"))
    named = spread.join(durable(table), "_w", "left").select(key, F.struct("_at", F.coalesce("_l", "_w").alias("w")).alias("_s"))
    joined = named.groupBy(key).agg(F.sort_array(F.collect_list("_s")).alias("_s"))
    texts = joined.select(key, F.array_join(F.col("_s")["w"], " ").alias("_text"))
    # Of the old text, only whether there is one goes through the join.
    out = df.withColumn(text, F.col(text).isNotNull()).join(texts, key, "left")
    filled = F.when(F.col(text), F.coalesce("_text", F.lit("")))
    return out.select(*[filled.alias(text) if c == text else F.col(c) for c in df.columns])


@lru_cache
def _folding() -> tuple[str, str]:
    """Accented letters whose decomposition is one ASCII letter plus marks, and that letter."""
    source, target = [], []
    for code in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= code < 0xE000 or 0xAC00 <= code < 0xD7B0:
            continue  # surrogates, and Hangul, which holds no ASCII
        plain = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            source.append(chr(code))
            target.append(plain)
    return "".join(source), "".join(target)


def folded(value: Column | str) -> Column:
    """Accented letters as their ASCII letter."""
    return F.translate(_col(value), *_folding())


def category(value: Column | str) -> Column:
    """The compared form of a category: trimmed and in lower case."""
    return F.lower(F.trim(_col(value).cast("string")))


def name_part(value: Column | str) -> Column:
    """A category as part of a column name: accents folded, other characters to ``_``."""
    ascii_only = F.regexp_replace(folded(value), r"[^\x00-\x7F]", "")
    return F.regexp_replace(ascii_only, "[^a-zA-Z0-9]+", "_")


def name_part_of(value: str) -> str:
    """``name_part`` for a value already on the driver (a fitted category)."""
    plain = unicodedata.normalize("NFKD", value).encode("ascii", "ignore").decode()
    return "_".join(p for p in _pieces(plain))


def _pieces(text: str) -> list[str]:
    out, run = [""], False
    for ch in text:
        if ch.isascii() and ch.isalnum():
            out[-1] += ch
            run = False
        elif not run:
            out.append("")
            run = True
    return out


def angle_to_round(text: Column | str) -> Column:
    return F.translate(_col(text), "<>", "()")


def special_to_space(text: Column | str) -> Column:
    """ASCII punctuation, tab and line breaks to spaces, trimmed."""
    marks = string.punctuation + "\t\n\r"
    return F.trim(F.translate(_col(text), marks, " " * len(marks)))


def ngrams(text: Column | str, up_to: int = 3) -> Column:
    """All word n-grams of 1..up_to words, by zipping the words with themselves shifted."""
    words = tokens(text)
    grams = [words]
    for n in range(1, up_to):
        shifted = F.slice(words, F.lit(n + 1), F.greatest(F.lit(0), F.size(words) - n))
        longer = F.zip_with(grams[-1], shifted, lambda a, b: F.when(b.isNotNull(), F.concat_ws(" ", a, b)))
        grams.append(F.filter(longer, lambda g: g.isNotNull()))
    return grams[0] if up_to == 1 else F.concat(*grams)


def ngram_frequencies(df: DataFrame, text: str, up_to: int = 3) -> DataFrame:
    """How often each n-gram occurs, in no order: whoever wants the top of it need not
    sort every n-gram there is."""
    # N-grams are made place by place, without an array of all of them.  A text is split once: a filter, also the one that
    # Spark derives from an inner explode, would move below the split and split again.
    split = df.select(F.array_remove(F.split(_col(text), _SPACES), "").alias("_w"))
    places = split.select("_w", F.explode_outer(F.when(F.size("_w") > 0, F.sequence(F.lit(0), F.size("_w") - 1))).alias("_i"))

    def gram(n: int) -> Column:
        parts = [F.get(F.col("_w"), F.col("_i") + i) for i in range(n)]
        return F.when(parts[-1].isNotNull(), F.concat_ws(" ", *parts))

    grams = places.select(F.explode(F.array(*[gram(n) for n in range(1, up_to + 1)])).alias("ngram")).where("ngram IS NOT NULL")
    return grams.groupBy("ngram").agg(F.count(F.lit(1)).alias("count"))


def top_words(df: DataFrame, text: str, limit: int = 500) -> DataFrame:
    """The most frequent words (a word cloud's input)."""
    top = ngram_frequencies(df, text, 1).orderBy(F.desc("count"), "ngram").limit(limit)
    return top.select(F.col("ngram").alias("word"), "count")


def _window_match(text: Column, keyword: str, edits: int) -> Column:
    """Whether some window as long as the keyword is within ``edits`` of it.

    One of ``edits + 1`` pieces must survive unchanged, moved by at most ``edits``, so only windows that
    hold a piece at such a place are measured: a regular expression cuts out the surroundings of each piece,
    in a text with line breaks around it (``text`` itself has none).  A text shorter than the keyword is one window.
    """
    m = len(keyword)
    cut = [round(i * m / (edits + 1)) for i in range(edits + 2)]
    padded = F.concat(F.lit("\n" * (m + edits)), text, F.lit("\n" * (m + edits)))

    def near(around: Column) -> Column:
        windows = [F.substring(around, 1 + i, m) for i in range(2 * edits + 1)]
        return any_of([~w.contains("\n") & (F.levenshtein(w, F.lit(keyword), edits) >= 0) for w in windows])

    tests = [(F.length(text) < m) & (F.levenshtein(text, F.lit(keyword)) <= edits)]
    for a, b in zip(cut, cut[1:]):
        if b > a:
            piece = keyword[a:b]
            # Looking behind from each place of the piece, and from there ahead: places may overlap.
            around = rf"(?s)(?={re.escape(piece)})(?<=(?=(.{{{m + 2 * edits}}})).{{{a + edits}}})"
            tests.append(text.contains(piece) & F.exists(F.regexp_extract_all(padded, F.lit(around), F.lit(1)), near))
    return any_of(tests)


def keyword_flag(text: Column | str, keywords: Sequence[str], ratio: int = 89) -> Column:
    """Whether the lower-cased, punctuation-free text holds a keyword, exactly or
    with a partial edit-distance ratio above ``ratio``."""
    body = special_to_space(F.lower(_col(text)))
    tests = []
    for keyword in keywords:
        edits = max(e for e in range(len(keyword) + 1) if 100 * (1 - e / len(keyword)) > ratio)
        tests.append(_window_match(body, keyword, edits) if edits else body.contains(keyword))
    return F.coalesce(any_of(tests), F.lit(False))


def keyword_contains(text: Column | str, keywords: Sequence[str]) -> Column:
    body = special_to_space(F.lower(_col(text)))
    return F.coalesce(any_of([body.contains(k) for k in keywords]), F.lit(False))


@lru_cache(maxsize=None)
def script_ranges() -> tuple[list[int], list[str]]:
    """First code point and word of each run of characters whose Unicode names begin with one word.

    Unnamed characters count as LATIN.  Spark has no such function, so the runs are a table made from the rule.
    """
    starts, words = [], []
    for code in range(0x110000):
        word = unicodedata.name(chr(code), "LATIN").split(" ")[0]
        if not words or words[-1] != word:
            starts.append(code)
            words.append(word)
    return starts, words


def script(text: Column | str) -> Column:
    """Unicode script word of the first character other than a space or a-z.

    A binary search over the literal table of runs, on the JVM.
    """
    starts, words = script_ranges()
    # The first such character is looked for, the rest of the text is not read.  Lower-casing makes the Kelvin sign an ASCII
    # letter, and a dotted capital I such a letter and a mark.
    other = F.lower(F.regexp_extract(_col(text), "[^ a-zA-Z\u212a]", 0))
    rest = F.regexp_replace(other, "[ a-z]", "")
    code = F.ascii(F.coalesce(rest, F.lit("")))
    first = F.split(F.lit(",".join(map(str, starts))), ",").cast("array<int>")
    step = F.lit([1 << i for i in reversed(range(len(starts).bit_length()))])
    place = F.aggregate(step, F.lit(0), lambda at, s: F.when(F.get(first, at + s) <= code, at + s).otherwise(at))
    return F.get(F.split(F.lit(",".join(words)), ","), place)
