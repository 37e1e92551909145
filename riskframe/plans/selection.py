"""Feature selection over labelled documents and line measures."""

from pyspark.sql import functions as F

from riskframe.operators import reports
from riskframe.plans.catalogue import register
from riskframe.plans.preparation import _LABELLED, labelled
from riskframe.prep import encode, select


def flags(t):
    """0/1 columns of the labelled documents."""
    rows = labelled(t)
    langs = encode.OneHotEncoder(["lang"]).fit(rows).transform(rows)
    return langs.select(
        "doc_id", "target", *[f"`lang={v}`" for v in ("de", "en", "fr")],
        (F.col("n_chars") > 2000).cast("int").alias("long"), (F.col("n_chars") < 0).cast("int").alias("never"), F.col("quality").alias("good"),
    )


_FLAGS = ["lang=de", "lang=en", "lang=fr", "long", "never", "good"]
_FLAG_SQL = {
    "lang=de": "lang = 'de'", "lang=en": "lang = 'en'", "lang=fr": "lang = 'fr'", "long": "n_chars > 2000", "never": "false", "good": "quality = 1",
}


@register(
    "positives_per_feature",
    " UNION ALL ".join(f"SELECT '{f}' AS feature, count_if({c} AND target = 1) AS positives FROM {_LABELLED}" for f, c in _FLAG_SQL.items()),
)
def positives_per_feature(t):
    return select.positives_per_feature(flags(t), _FLAGS, "target")


@register(
    "no_impact_features",
    " UNION ALL ".join(f"SELECT '{f}' AS feature FROM {_LABELLED} HAVING count_if({c} AND target = 1) = 0" for f, c in _FLAG_SQL.items()),
)
def no_impact_features(t):
    return select.no_impact_features(flags(t), _FLAGS, "target")


_WOE = f"""
    d AS (SELECT doc_id, n_chars::DOUBLE AS x, target FROM {_LABELLED}),
    p AS (SELECT min(x) AS lo, max(x) AS hi, (ceil((max(x) - min(x) + 1e-6) / (2 * (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / pow(count(*), 1.0 / 3) + 1e-6)) + 1)::BIGINT AS b FROM d),
    n AS (SELECT doc_id, target, least(greatest(0, ceil((x - lo) / ((hi - lo) / b))::BIGINT - 1), b - 1) AS bin FROM d, p),
    g AS (SELECT bin, count(*) AS total, sum(target)::BIGINT AS concern, count(*) - sum(target)::BIGINT AS no_concern FROM n GROUP BY bin),
    w AS (SELECT *, ln((no_concern / sum(no_concern) OVER () + 1e-6) / (concern / sum(concern) OVER () + 1e-6)) AS woe FROM g)
"""


@register(
    "weight_of_evidence",
    f"WITH {_WOE} SELECT 'n_chars' AS feature, bin, total, concern, no_concern, round(woe, 6) AS woe FROM w",
)
def weight_of_evidence(t):
    return select.evidence(labelled(t), ["n_chars"], "target").withColumn("woe", F.round("woe", 6))


@register("weight_of_evidence_rows", f"WITH {_WOE} SELECT doc_id, round(woe, 6) AS \"n_chars_WoE\" FROM n JOIN w ON w.bin = n.bin")
def weight_of_evidence_rows(t):
    out = select.with_evidence(labelled(t), ["n_chars"], "target")
    return out.select("doc_id", F.round("n_chars_WoE", 6).alias("n_chars_WoE"))


_MI = ["l_linenumber", "l_discount", "l_tax"]


@register(
    "mutual_information",
    " UNION ALL ".join(
        f"SELECT '{a}' AS feature1, '{b}' AS feature2, round(sum(c / n * ln(c * n / (cx * cy))), 6) AS mutual_information FROM "
        f"(SELECT c, sum(c) OVER ()::DOUBLE AS n, sum(c) OVER (PARTITION BY x)::DOUBLE AS cx, sum(c) OVER (PARTITION BY y)::DOUBLE AS cy FROM "
        f"(SELECT {a} AS x, {b} AS y, count(*) AS c FROM lineitem GROUP BY ALL))"
        for i, a in enumerate(_MI) for b in _MI[i:]
    ),
)
def mutual_information(t):
    out = select.mutual_information(t.lineitem.select(*_MI), _MI)
    return out.withColumn("mutual_information", F.round("mutual_information", 6) + 0.0)


@register("redundant_features")
def redundant_features(t):
    rows = t.lineitem.select(*_MI, F.col("l_tax").alias("tax_copy"), (F.col("l_discount") > 0.05).cast("int").alias("target"))
    names = [*_MI, "tax_copy"]
    information = select.mutual_information(rows, [*names, "target"])
    gone = select.redundant_features(information, names, "target")
    return t.spark.createDataFrame([(g,) for g in gone], "feature STRING")


@register("correlated_features")
def correlated_features(t):
    rows = t.lineitem.select("l_quantity", "l_extendedprice", (F.col("l_quantity") * 2 + F.col("l_tax")).alias("doubled"))
    pairs = reports.correlation_pairs(rows, ["l_quantity", "l_extendedprice", "doubled"])
    return t.spark.createDataFrame([(f,) for f in select.correlated_features(pairs)], "feature STRING")


@register("feature_selection")
def feature_selection(t):
    rows = flags(t)
    return select.FeatureSelection("doc_id", "target").fit(rows).transform(rows)


