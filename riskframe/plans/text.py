"""Text cleaning, n-grams, keyword flags and string similarity."""

from pyspark.sql import functions as F

from riskframe.functions import text
from riskframe.operators import similarity
from riskframe.plans.catalogue import register

# The stop words of the checks.
STOP = ["the", "and", "of", "in", "le", "la", "der", "und"]
_STOP_SQL = ", ".join(f"'{w}'" for w in STOP)
_PUNCT_SQL = r"""'[!"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{|}~]'"""


def _digits_sql(x):
    return f"regexp_replace({x}, '[0-9]', '', 'g')"


def _punct_sql(x):
    return f"regexp_replace({x}, {_PUNCT_SQL}, '', 'g')"


def _words_sql(x, keep="w <> ''"):
    return rf"array_to_string(list_filter(string_split_regex({x}, '\s+'), lambda w: {keep}), ' ')"


def _short_sql(x):
    return _words_sql(x, "length(w) > 2")


def _ascii_sql(x):
    return rf"regexp_replace({x}, '[^\x00-\x7F]', ' ', 'g')"


def _stop_sql(x):
    return _words_sql(x, f"w <> '' AND w NOT IN ({_STOP_SQL})")


_CLEAN_SQL = _stop_sql(_ascii_sql(_short_sql(_punct_sql(_digits_sql("text")))))


def _simple(name, sql, fn):
    """One text function applied to every document, compared by hash and length."""
    register(name, f"SELECT doc_id, md5(v) AS hash, length(v)::BIGINT AS chars FROM (SELECT doc_id, {sql} AS v FROM documents)")(
        lambda t: t.documents.select("doc_id", fn("text").alias("v")).select(
            "doc_id", F.md5("v").alias("hash"), F.length("v").cast("long").alias("chars")
        )
    )


_simple("remove_digits", _digits_sql("text"), text.remove_digits)
_simple("remove_punctuation", _punct_sql("text"), text.remove_punctuation)
_simple("remove_short_words", _short_sql("text"), text.remove_short_words)
_simple("remove_non_ascii", _ascii_sql("text"), text.remove_non_ascii)
_simple("remove_stop_words", _stop_sql("text"), lambda c: text.remove_stop_words(c, STOP))
_simple("clean_text", _CLEAN_SQL, lambda c: text.clean(c, STOP))
_simple(
    "clean_text_lower", _stop_sql(_punct_sql(_digits_sql(_ascii_sql(_short_sql("lower(text)"))))),
    lambda c: text.clean_lower(c, STOP),
)
_simple(
    "special_characters_to_space", rf"trim(regexp_replace(text, '[!-/:-@\[-`{{-~\t\n\r]', ' ', 'g'))", text.special_to_space
)
_simple(
    "category_name", "regexp_replace(regexp_replace(strip_accents(lower(trim(text))), '[^\\x00-\\x7F]', '', 'g'), '[^a-zA-Z0-9]+', '_', 'g')",
    lambda c: text.name_part(text.category(c)),
)


@register(
    "angle_brackets_to_round",
    "SELECT page_id, md5(replace(replace(html, '<', '('), '>', ')')) AS hash FROM pages",
)
def angle_brackets_to_round(t):
    return t.pages.select("page_id", F.md5(text.angle_to_round("html")).alias("hash"))


@register(
    "lemmatize",
    r"""
    WITH l AS (SELECT lower(w) AS word, min('L_' || lower(w)) AS lemma FROM (SELECT unnest(string_split_regex(text, '\s+')) AS w FROM benchmark) WHERE w <> '' GROUP BY 1),
    d AS (SELECT doc_id, unnest(list_transform(ws, lambda w, i: {'i': i, 'w': w}), recursive := true) FROM
      (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda w: w <> '') AS ws FROM documents))
    SELECT doc_id, md5(string_agg(coalesce(lemma, w), ' ' ORDER BY i)) AS hash FROM d LEFT JOIN l ON word = w GROUP BY doc_id
    """,
)
def lemmatize(t):
    lemmas = t.benchmark.select(F.explode(text.tokens("text")).alias("w")).select(
        F.lower("w").alias("word"), F.concat(F.lit("L_"), F.lower("w")).alias("lemma")
    )
    out = text.lemmatize(t.documents.select("doc_id", "text"), "doc_id", "text", lemmas, "word", "lemma")
    return out.select("doc_id", F.md5("text").alias("hash"))


_GRAMS_SQL = r"""
    w AS (SELECT list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') AS ws FROM documents),
    g AS (SELECT unnest(ws) AS ngram FROM w
      UNION ALL SELECT unnest(list_transform(range(1, greatest(len(ws), 1)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM w
      UNION ALL SELECT unnest(list_transform(range(1, greatest(len(ws) - 1, 1)), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) FROM w)
"""


@register(
    "ngram_frequencies",
    f"WITH {_GRAMS_SQL} SELECT ngram, count(*) AS count FROM g GROUP BY ngram",
)
def ngram_frequencies(t):
    return text.ngram_frequencies(t.documents.select(F.lower("text").alias("text")), "text", 3)


@register(
    "top_words",
    r"SELECT word, count(*) AS count FROM (SELECT unnest(string_split_regex(text, '\s+')) AS word FROM documents) "
    "WHERE word <> '' GROUP BY word ORDER BY count DESC, word LIMIT 500",
)
def top_words(t):
    return text.top_words(t.documents, "text", 500)


@register(
    "word_counts",
    r"SELECT doc_id, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> ''))::BIGINT AS words, "
    r"ceil(len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) * 0.75)::BIGINT AS needed FROM documents",
)
def word_counts(t):
    n = similarity.word_count(F.col("text"))
    return t.documents.select(
        "doc_id", n.cast("long").alias("words"), similarity.count_threshold(n, 0.75).cast("long").alias("needed")
    )


def _part_pairs(t):
    """Each part next to the part with the following key."""
    nxt = t.part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.concat_ws(" ", "p_name", "p_brand").alias("b"))
    return t.part.select("p_partkey", F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("a")).join(nxt, "p_partkey")


_PART_PAIRS = (
    "(SELECT x.p_partkey, x.p_name || ' ' || x.p_type || ' ' || x.p_brand AS a, y.p_name || ' ' || y.p_brand AS b "
    "FROM part x JOIN part y ON y.p_partkey = x.p_partkey + 1)"
)


@register(
    "word_jaccard",
    "SELECT p_partkey, round(i / u, 6) AS similarity FROM (SELECT p_partkey, "
    "len(list_intersect(wa, wb)) AS i, len(list_distinct(wa || wb)) AS u FROM (SELECT p_partkey, "
    f"string_split(lower(a), ' ') AS wa, string_split(lower(b), ' ') AS wb FROM {_PART_PAIRS}))",
)
def word_jaccard(t):
    return _part_pairs(t).select("p_partkey", F.round(similarity.word_jaccard(F.col("a"), F.col("b")), 6).alias("similarity"))


@register(
    "character_score",
    "SELECT p_partkey, round(len(list_intersect(ca, cb)) / len(list_distinct(ca || cb)) * length(a), 6) AS score FROM "
    f"(SELECT p_partkey, a, string_split(a, '') AS ca, string_split(b, '') AS cb FROM {_PART_PAIRS})",
)
def character_score(t):
    return _part_pairs(t).select("p_partkey", F.round(similarity.character_score(F.col("a"), F.col("b")), 6).alias("score"))


@register(
    "fuzzy_ratio",
    f"SELECT p_partkey, round(100 * (1 - levenshtein(a, b) / greatest(length(a), length(b))))::BIGINT AS ratio FROM {_PART_PAIRS}",
)
def fuzzy_ratio(t):
    return _part_pairs(t).select("p_partkey", similarity.fuzzy_ratio(F.col("a"), F.col("b")).cast("long").alias("ratio"))


@register(
    "closest_dictionary_word",
    r"""
    WITH d AS (SELECT DISTINCT w AS entry FROM (SELECT unnest(string_split_regex(strip_accents(replace(lower(text), 'ß', 'ss')), '[^a-z]+')) AS w FROM benchmark) WHERE w <> ''),
    m AS (SELECT DISTINCT w AS word FROM (SELECT unnest(string_split_regex(strip_accents(replace(lower(text), 'ß', 'ss')), '[^a-z]+')) AS w FROM conversations) WHERE w <> '' AND w NOT IN (SELECT entry FROM d)),
    x AS (SELECT word, entry, levenshtein(word, entry) AS n FROM m JOIN d ON true),
    r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY n, entry) AS k FROM x)
    SELECT word, entry AS closest, n AS distance FROM r WHERE k = 1
    """,
)
def closest_dictionary_word(t):
    def vocabulary(df, name):
        letters = F.regexp_replace(text.folded(F.replace(F.lower("text"), F.lit("ß"), F.lit("ss"))), "[^a-z]", " ")
        return df.select(F.explode(text.tokens(letters)).alias(name)).distinct()

    entries = vocabulary(t.benchmark, "entry")
    unknown = vocabulary(t.conversations, "word").join(entries.withColumnRenamed("entry", "word"), "word", "left_anti")
    return similarity.closest_words(unknown, "word", entries, "entry")


def _script_sql():
    starts, words = text.script_ranges()
    return f"""
    WITH r AS (SELECT unnest(string_split('{",".join(map(str, starts))}', ','))::INT AS first, unnest(string_split('{",".join(words)}', ',')) AS script),
    d AS (SELECT doc_id, greatest(coalesce(unicode(substr(regexp_replace(lower(text), '[ a-z]', '', 'g'), 1, 1)), 0), 0) AS code FROM documents)
    SELECT doc_id, script FROM d ASOF JOIN r ON d.code >= r.first
    """


@register("unicode_script", _script_sql())
def unicode_script(t):
    return t.documents.select("doc_id", text.script("text").alias("script"))


_KEYWORDS = ["licence", "password", "the enther", "copyright notice"]


@register(
    "keyword_contains",
    "SELECT doc_id, (" + " OR ".join(
        rf"contains(trim(regexp_replace(lower(text), '[!-/:-@\[-`{{-~\t\n\r]', ' ', 'g')), '{k}')" for k in ["the and", "of thea", "license"]
    ) + ") AS flagged FROM documents",
)
def keyword_contains(t):
    return t.documents.select("doc_id", text.keyword_contains("text", ["the and", "of thea", "license"]).alias("flagged"))


@register("keyword_fuzzy")
def keyword_fuzzy(t):
    return t.documents.select("doc_id", text.keyword_flag("text", _KEYWORDS).alias("flagged"))


@register("page_leads")
def page_leads(t):
    """Organisation-like phrases of page paragraphs: re-aimed lead extraction."""
    from riskframe.operators.leads import page_leads as run

    return run(t.pages, "page_id", "html", block=["The", "And"])
