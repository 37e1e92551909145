"""Benford, IQR, LOF, distribution shape and scaling over the standard tables."""

from pyspark.sql import functions as F

from riskframe.operators import benford, distributions, entity, lof, outlier, reduce, scaling
from riskframe.plans.catalogue import register
from riskframe.session import durable

_LINES = "l_orderkey, l_linenumber::BIGINT AS l_linenumber"


def _lines(t, *columns):
    return t.lineitem.select(
        "l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), *columns
    )


_DIGITS = (
    "CASE WHEN abs({x}) < 10 THEN floor(abs({x}))::INT "
    "ELSE substr(floor(abs({x}))::BIGINT::VARCHAR, 1, 2)::INT END"
)


def benford_sql(table: str, group: str, x: str) -> str:
    """CTEs ending in ``bscore(grp, digits, score)``."""
    d = _DIGITS.format(x=x)
    return f"""
    bh AS (SELECT {group} AS grp, {d} AS digits, count(*) AS c FROM {table} WHERE {x} > 0 GROUP BY ALL),
    bn AS (SELECT *, sum(c) OVER (PARTITION BY grp) AS n,
           CASE WHEN digits BETWEEN 10 AND 99 THEN log10(1 + 1.0::DOUBLE / digits) END AS b FROM bh),
    bc AS (SELECT grp, sum(pow(c / s - b / m, 2) / (b / m)) AS chi, count(*) - 1 AS df FROM (
             SELECT *, sum(c) OVER (PARTITION BY grp) AS s, sum(b) OVER (PARTITION BY grp) AS m
             FROM bn WHERE b IS NOT NULL) GROUP BY grp),
    ba AS (SELECT bn.grp, digits, n, b, CASE WHEN c >= greatest(5, 0.01 * n)
             THEN greatest(0, c / n - (coalesce(b, 0) + 2.3263 * sqrt(coalesce(b, 0) * (1 - coalesce(b, 0)) / n))) ELSE 0 END AS a,
             chi > df * pow(1 - 2.0 / (9 * df) + 2.326348 * sqrt(2.0 / (9 * df)), 3) AS rejected
           FROM bn LEFT JOIN bc ON bc.grp = bn.grp),
    bscore AS (SELECT grp, digits, CASE WHEN b IS NULL OR n < 50 OR rejected OR top = 0 THEN 0
                 ELSE round(pow(a / top, 2), 3) END AS score
               FROM (SELECT *, max(a) OVER (PARTITION BY grp) AS top FROM ba))
    """


_INDICATOR_SQL = "CASE WHEN l_linestatus = 'F' THEN 'S' WHEN l_quantity > 45 THEN 'X' WHEN l_quantity > 5 THEN 'H' END"


def indicator():
    """Debit/credit codes from the line status, with invalid and missing ones."""
    return (
        F.when(F.col("l_linestatus") == "F", "S").when(F.col("l_quantity") > 45, "X").when(F.col("l_quantity") > 5, "H")
    )


def invoice_lines(t):
    return t.lineitem.select(
        F.col("l_suppkey").alias("VendorNumber"),
        F.col("l_returnflag").alias("CompanyCode"),
        F.year("l_shipdate").alias("FiscalYear"),
        F.col("l_orderkey").alias("SystemInvoiceNo"),
        F.col("l_linenumber").cast("long").alias("line"),
        F.col("l_partkey").alias("part"),
        F.col("l_extendedprice").alias("AmountExcl_RC"),
        indicator().alias("DebitCreditIndicator"),
    )


INVOICE_SQL = f"""
    inv AS (SELECT l_suppkey AS "VendorNumber", l_returnflag AS company, year(l_shipdate) AS yr,
      l_orderkey AS invoice, l_linenumber::BIGINT AS line, l_partkey AS part, l_extendedprice AS amount,
      {_INDICATOR_SQL} AS ind FROM lineitem),
    net AS (SELECT *, "VendorNumber"::VARCHAR AS vendor_level,
      md5(concat_ws(chr(1), company, yr::VARCHAR, invoice::VARCHAR)) AS invoice_level,
      CASE WHEN ind IN ('S', 'S-Debit') THEN -abs(amount) ELSE amount END AS net_amount FROM inv),
    tot AS (SELECT *, abs(sum(net_amount) OVER (PARTITION BY vendor_level, invoice_level)) AS total,
      row_number() OVER (PARTITION BY vendor_level, invoice_level ORDER BY line, part) AS rn FROM net)
"""
INVOICE_PARTS = ["CompanyCode", "FiscalYear", "SystemInvoiceNo"]


@register(
    "flagship_invoice_benford",
    f"""
    WITH {INVOICE_SQL},
    ded AS (SELECT * FROM tot WHERE rn = 1), {benford_sql("ded", "company", "total")}
    SELECT vendor_level, invoice_level, company AS "CompanyCode", round(total, 2) AS "Total_AmountExcl_RC",
      CASE WHEN coalesce(score, 0) > 0.1 THEN score ELSE 0 END AS anomaly
    FROM ded LEFT JOIN bscore ON grp = company AND bscore.digits = {_DIGITS.format(x="total")} AND total > 0
    ORDER BY anomaly DESC, vendor_level, invoice_level LIMIT 100
    """,
)
def flagship_invoice_benford(t):
    """Invoices from signed lines, Benford score per company, the 100 most anomalous."""
    # The invoices are read twice, for the digit counts and for their scores: written once.
    invoices = reduce.entity_first_lines(
        invoice_lines(t), "VendorNumber", INVOICE_PARTS, "AmountExcl_RC", "invoice_level", ["line", "part"],
        "DebitCreditIndicator",
    )
    # Totals of doubles may differ in the last bit between runs: digits need cents.
    invoices = durable(
        invoices.select("vendor_level", "invoice_level", "CompanyCode", F.round("Total_AmountExcl_RC", 2).alias("Total_AmountExcl_RC"))
    )
    scored = benford.with_benford_scores(invoices, ["CompanyCode"], "Total_AmountExcl_RC", "score")
    out = scored.select(
        "vendor_level", "invoice_level", "CompanyCode", "Total_AmountExcl_RC",
        entity.above("score", 0.1).alias("anomaly"),
    )
    return out.orderBy(F.desc("anomaly"), "vendor_level", "invoice_level").limit(100)


@register(
    "benford_scores",
    f"WITH {benford_sql('lineitem', 'l_returnflag', 'l_extendedprice')} SELECT {_LINES}, l_extendedprice, "
    "coalesce(score, 0) AS benford FROM lineitem LEFT JOIN bscore ON grp = l_returnflag "
    f"AND digits = {_DIGITS.format(x='l_extendedprice')} AND l_extendedprice > 0",
)
def benford_scores(t):
    return benford.with_benford_scores(
        _lines(t, "l_extendedprice", "l_returnflag"), ["l_returnflag"], "l_extendedprice"
    ).drop("l_returnflag")


@register(
    "benford_first_digits",
    f"SELECT o_orderkey, {_DIGITS.format(x='o_totalprice')}::BIGINT AS digits FROM orders",
)
def benford_first_digits(t):
    return t.orders.select("o_orderkey", benford.first_digits("o_totalprice").cast("long").alias("digits"))


@register(
    "benford_conformity",
    f"WITH {benford_sql('lineitem', 'l_returnflag', 'l_extendedprice')} "
    "SELECT grp AS l_returnflag, round(chi, 6) AS chi_square, df AS degrees_of_freedom, false AS rejected FROM bc",
)
def benford_conformity(t):
    out = benford.conformity(t.lineitem, ["l_returnflag"], "l_extendedprice")
    return out.withColumn("chi_square", F.round("chi_square", 6))


@register(
    "benford_conformity_counts",
    f"WITH {benford_sql('lineitem', 'l_returnflag', 'l_extendedprice')} "
    "SELECT grp AS l_returnflag, round(chi * s, 4) AS chi_square, df AS degrees_of_freedom, true AS rejected "
    "FROM bc JOIN (SELECT grp AS g, sum(c) AS s FROM bn WHERE b IS NOT NULL GROUP BY grp) ON g = grp",
)
def benford_conformity_counts(t):
    out = benford.conformity(t.lineitem, ["l_returnflag"], "l_extendedprice", mode="counts")
    return out.withColumn("chi_square", F.round("chi_square", 4))


def _binary_sql(groups: str) -> str:
    part = f"PARTITION BY {groups}" if groups else ""
    lead = f"{groups}, " if groups else ""
    d = _DIGITS.format(x="l_extendedprice")
    return f"""SELECT {lead}digits, c, c / sum(c) OVER ({part}) > b + 2.57 * sqrt(b * (1 - b) / c) AS flag,
        b - 2.57 * sqrt(b * (1 - b) / c) AS low FROM (
        SELECT *, CASE WHEN digits > 0 THEN log10(1 + 1.0::DOUBLE / digits) ELSE 0 END AS b FROM (
        SELECT {lead}{d} AS digits, count(*) AS c FROM lineitem GROUP BY ALL))"""


@register(
    "benford_binary",
    f"WITH f AS ({_binary_sql('l_suppkey')}) SELECT {_LINES}, f.l_suppkey, l_extendedprice, flag::BIGINT AS flag, "
    "round(low, 6) AS flag_lower_bound FROM lineitem l JOIN f ON f.l_suppkey = l.l_suppkey "
    f"AND digits = {_DIGITS.format(x='l_extendedprice')}",
)
def benford_binary(t):
    out = benford.with_binary_benford(_lines(t, "l_suppkey", "l_extendedprice"), ["l_suppkey"], "l_extendedprice", "flag")
    return out.withColumns({"flag": F.col("flag").cast("long"), "flag_lower_bound": F.round("flag_lower_bound", 6)})


_SUBSETS = [
    ("l_returnflag",), ("l_linestatus",), ("l_suppkey",), ("l_returnflag", "l_linestatus"),
    ("l_returnflag", "l_suppkey"), ("l_linestatus", "l_suppkey"), ("l_returnflag", "l_linestatus", "l_suppkey"),
]


@register(
    "benford_subset_counts",
    " UNION ALL ".join(
        f"SELECT 'benford_{'_'.join(s)}' AS subset, sum(CASE WHEN flag THEN c ELSE 0 END)::BIGINT AS anomalies "
        f"FROM ({_binary_sql(', '.join(s))})"
        for s in _SUBSETS
    ),
)
def benford_subset_counts(t):
    return benford.subset_counts(t.lineitem, ["l_returnflag", "l_linestatus", "l_suppkey"], "l_extendedprice")


@register(
    "benford_subset_totals",
    f"WITH a AS ({_binary_sql('l_returnflag')}), b AS ({_binary_sql('l_linestatus')}), "
    f"c AS ({_binary_sql('l_returnflag, l_linestatus')}), "
    f"l AS (SELECT {_LINES}, l_returnflag, l_linestatus, l_extendedprice, {_DIGITS.format(x='l_extendedprice')} AS dg FROM lineitem) "
    "SELECT l_orderkey, l_linenumber, l_extendedprice, (a.flag::INT + b.flag::INT + c.flag::INT)::BIGINT AS benford_total FROM l "
    "JOIN a ON a.l_returnflag = l.l_returnflag AND a.digits = dg "
    "JOIN b ON b.l_linestatus = l.l_linestatus AND b.digits = dg "
    "JOIN c ON c.l_returnflag = l.l_returnflag AND c.l_linestatus = l.l_linestatus AND c.digits = dg",
)
def benford_subset_totals(t):
    rows = _lines(t, "l_returnflag", "l_linestatus", "l_extendedprice")
    out = benford.benford_by_subsets(rows, ["l_returnflag", "l_linestatus"], "l_extendedprice")
    return out.select(
        "l_orderkey", "l_linenumber", "l_extendedprice", F.col("benford_total").cast("long").alias("benford_total")
    )


_IQR = """
    WITH s AS (SELECT event_id, event_type, round(abs(value) / max(abs(value)) OVER (PARTITION BY event_type), 4) AS x FROM events),
    q AS (SELECT event_type AS g, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3, avg(x) AS m FROM s GROUP BY 1)
    SELECT event_id, {expr} AS iqr FROM s JOIN q ON g = event_type
"""


@register("iqr_flags", _IQR.format(expr="CASE WHEN x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1) THEN 1 ELSE 0 END::BIGINT"))
def iqr_flags(t):
    out = outlier.with_iqr_outliers(t.events.select("event_id", "event_type", "value"), ["event_type"], "value")
    return out.select("event_id", F.col("iqr").cast("long").alias("iqr"))


@register(
    "iqr_confidence",
    _IQR.format(expr="CASE WHEN x <= q1 - 1.5 * (q3 - q1) OR x >= q3 + 1.5 * (q3 - q1) THEN round(abs(m - x), 6) ELSE 0 END"),
)
def iqr_confidence(t):
    rows = t.events.select("event_id", "event_type", "value")
    out = outlier.with_iqr_outliers(rows, ["event_type"], "value", confidence=True)
    return out.select("event_id", F.round("iqr", 6).alias("iqr"))


_LOF = """
    WITH r AS (SELECT o_orderkey AS id, o_orderpriority AS g, o_totalprice AS x,
        row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS pos FROM orders),
    cand AS (SELECT a.g, a.id, a.pos, a.pos + o AS npos FROM r a, range(-20, 21) AS t(o) WHERE o <> 0),
    dist AS (SELECT c.g, c.id, c.pos, b.id AS nid, b.pos AS npos, abs(a.x - b.x) AS d FROM cand c
        JOIN r a ON a.g = c.g AND a.pos = c.pos JOIN r b ON b.g = c.g AND b.pos = c.npos),
    nb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g, id ORDER BY d, npos) AS k FROM dist) WHERE k <= 20),
    kd AS (SELECT id, max(d) AS kdist FROM nb GROUP BY id),
    lrd AS (SELECT nb.id, 1 / (avg(greatest(d, kdist)) + 1e-10) AS lrd FROM nb JOIN kd ON kd.id = nid GROUP BY nb.id),
    lof AS (SELECT nb.g, nb.id, avg(b.lrd) / any_value(a.lrd) AS lof FROM nb JOIN lrd b ON b.id = nid JOIN lrd a ON a.id = nb.id GROUP BY ALL)
"""


@register(
    "lof_scores",
    _LOF + "SELECT id AS o_orderkey, round((lof - min(lof) OVER (PARTITION BY g)) / "
    "(max(lof) OVER (PARTITION BY g) - min(lof) OVER (PARTITION BY g)), 6) AS lof FROM lof",
)
def lof_scores(t):
    rows = t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice")
    out = lof.with_lof(rows, ["o_orderpriority"], "o_totalprice", gate=False)
    return out.select("o_orderkey", F.round("lof", 6).alias("lof"))


@register(
    "lof_flags",
    _LOF + ", q AS (SELECT g AS qg, quantile_cont(lof, 0.99) AS cut FROM lof GROUP BY g) "
    "SELECT id AS o_orderkey, (lof > cut)::INT::DOUBLE AS flag FROM lof JOIN q ON qg = g",
)
def lof_flags(t):
    rows = t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice")
    out = lof.with_lof(rows, ["o_orderpriority"], "o_totalprice", "flag", confidence=False, gate=False)
    return out.select("o_orderkey", "flag")


@register("lof_scores_gated")
def lof_scores_gated(t):
    """With the variance gate: only groups classed Normal are scored."""
    return lof.with_lof(t.customer.select("c_custkey", "c_mktsegment", "c_acctbal"), ["c_mktsegment"], "c_acctbal")


@register(
    "distribution_moments",
    """
    SELECT event_type, count(value) AS n, min(value) AS minimum, max(value) AS maximum, round(avg(value), 6) AS mean,
      round(stddev_pop(value), 6) AS std,
      round(avg(pow(value - m, 3)) / pow(avg(pow(value - m, 2)), 1.5), 6) AS skewness,
      round(avg(pow(value - m, 4)) / pow(avg(pow(value - m, 2)), 2) - 3, 6) AS kurtosis
    FROM (SELECT *, avg(value) OVER (PARTITION BY event_type) AS m FROM events) GROUP BY event_type
    """,
)
def distribution_moments(t):
    out = distributions.moments(t.events, ["event_type"], "value")
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "std", "skewness", "kurtosis")})


@register(
    "skewness_class",
    """
    SELECT o_orderpriority, CASE WHEN s > 0.5 THEN 'Right skewed' WHEN s < -0.5 THEN 'Left skewed' ELSE 'Symmetric' END AS shape
    FROM (SELECT o_orderpriority, avg(pow(x - m, 3)) / pow(avg(pow(x - m, 2)), 1.5) AS s
      FROM (SELECT o_orderpriority, o_totalprice AS x, avg(o_totalprice) OVER (PARTITION BY o_orderpriority) AS m FROM orders)
      GROUP BY 1)
    """,
)
def skewness_class(t):
    stats = distributions.moments(t.orders, ["o_orderpriority"], "o_totalprice")
    return stats.select("o_orderpriority", distributions.skewness_class(F.col("skewness")).alias("shape"))


@register(
    "normality",
    """
    WITH m AS (SELECT event_type, count(*)::DOUBLE AS n, avg(pow(value - a, 2)) AS m2, avg(pow(value - a, 3)) AS m3, avg(pow(value - a, 4)) AS m4
      FROM (SELECT event_type, value, avg(value) OVER (PARTITION BY event_type) AS a FROM events) GROUP BY 1),
    s AS (SELECT *, m3 / pow(m2, 1.5) * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y,
      3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS beta,
      (m4 / (m2 * m2) - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS x,
      6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS rb FROM m),
    w AS (SELECT *, -1 + sqrt(2 * (beta - 1)) AS w2, 6 + 8 / rb * (2 / rb + sqrt(1 + 4 / (rb * rb))) AS a FROM s),
    z AS (SELECT *, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) AS zs,
      ((1 - 2 / (9 * a)) - sign(1 + x * sqrt(2 / (a - 4))) * pow((1 - 2 / a) / abs(1 + x * sqrt(2 / (a - 4))), 1.0 / 3)) / sqrt(2 / (9 * a)) AS zk FROM w)
    SELECT event_type, round(zs * zs + zk * zk, 4) AS k_squared, exp(-(zs * zs + zk * zk) / 2) > 0.05 AS is_normal FROM z
    """,
)
def normality(t):
    out = distributions.with_normality(distributions.moments(t.events, ["event_type"], "value"))
    return out.select("event_type", F.round("k_squared", 4).alias("k_squared"), "is_normal")


@register(
    "uniformity",
    """
    WITH v AS (SELECT l_returnflag AS g, l_extendedprice AS x, count(*) AS c FROM lineitem GROUP BY ALL),
    r AS (SELECT *, sum(c) OVER (PARTITION BY g ORDER BY x) AS upto, sum(c) OVER (PARTITION BY g) AS n,
      (x - min(x) OVER (PARTITION BY g)) / (max(x) OVER (PARTITION BY g) - min(x) OVER (PARTITION BY g)) AS u FROM v)
    SELECT g AS l_returnflag, round(max(greatest(upto / n - u, u - (upto - c) / n)), 6) AS ks_distance FROM r GROUP BY g
    """,
)
def uniformity(t):
    out = distributions.uniformity(t.lineitem, ["l_returnflag"], "l_extendedprice")
    return out.select("l_returnflag", F.round("ks_distance", 6).alias("ks_distance"))


@register(
    "kernel_density_modes",
    """
    WITH v AS (SELECT event_type, value AS x, count(*) AS c FROM events GROUP BY ALL),
    b AS (SELECT event_type, min(x) AS lo, (max(x) - min(x)) / 999 AS step FROM v GROUP BY 1),
    g AS (SELECT event_type, i, lo + i * step AS pt FROM b, range(1000) AS r(i)),
    d AS (SELECT g.event_type, i, sum(CASE WHEN abs(pt - x) < 38.6 THEN c * exp(-0.5 * pow(pt - x, 2)) ELSE 0 END) AS d
          FROM g JOIN v ON v.event_type = g.event_type GROUP BY ALL),
    p AS (SELECT event_type, d, lag(d) OVER w AS a, lead(d) OVER w AS z FROM d WINDOW w AS (PARTITION BY event_type ORDER BY i))
    SELECT event_type, count(*) > 1 AS multimodal FROM p WHERE d > a AND d > z GROUP BY 1
    """,
)
def kernel_density_modes(t):
    out = distributions.mode_counts(t.events, ["event_type"], "value")
    return out.select("event_type", (F.col("modes") > 1).alias("multimodal"))


@register("distribution_class")
def distribution_class(t):
    out = distributions.classify(t.orders, ["o_orderpriority"], "o_totalprice")
    return out.select("o_orderpriority", "distribution", F.round("skewness", 6).alias("skewness"))


@register(
    "standardize_z",
    """
    SELECT c_custkey, 'Uniform' AS z_class, round((c_acctbal - avg(c_acctbal) OVER (PARTITION BY c_mktsegment))
      / stddev_pop(c_acctbal) OVER (PARTITION BY c_mktsegment), 6) AS z FROM customer
    """,
)
def standardize_z(t):
    rows = t.customer.select("c_custkey", "c_mktsegment", "c_acctbal")
    out = distributions.standardize(rows, ["c_mktsegment"], "c_acctbal", "z")
    return out.select("c_custkey", "z_class", F.round("z", 6).alias("z"))


def _transform_sql(x, lam):
    return (
        f"CASE WHEN {x} >= 0 THEN CASE WHEN abs({lam}) < 1e-12 THEN ln(1 + {x}) ELSE (pow({x} + 1, {lam}) - 1) / {lam} END "
        f"ELSE CASE WHEN abs({lam} - 2) < 1e-12 THEN -ln(1 - {x}) ELSE -(pow(1 - {x}, 2 - {lam}) - 1) / (2 - {lam}) END END"
    )


def _lambda_pass_sql(name, before, step):
    """One narrowing grid around the lambdas of the pass before; the class of every event type is read off the data."""
    return f"""
    {name} AS (SELECT g, arg_max(lam, score) AS lam FROM (
      SELECT g, lam, -count(*) / 2.0::DOUBLE * ln(var_pop({_transform_sql('x', 'lam')})) + (lam - 1) * sum(sign(x) * ln(1 + abs(x))) AS score
      FROM (SELECT v.g, v.x, b.lam + i * {step}::DOUBLE AS lam FROM v JOIN {before} AS b ON b.g = v.g, range(-20, 21) AS r(i)) GROUP BY g, lam) GROUP BY g)"""


@register(
    "power_lambdas",
    f"""
    WITH v AS (SELECT event_type AS g, value AS x FROM events WHERE value IS NOT NULL), l0 AS (SELECT DISTINCT g, 0.0::DOUBLE AS lam FROM v),
    {_lambda_pass_sql('l1', 'l0', '0.25')}, {_lambda_pass_sql('l2', 'l1', '0.0125')}, {_lambda_pass_sql('l3', 'l2', '0.000625')}
    SELECT g AS event_type, round(lam, 6) AS lam FROM l3
    """,
)
def power_lambdas(t):
    out = distributions.yeo_johnson_lambdas(t.events, ["event_type"], "value")
    return out.select("event_type", F.round("lam", 6).alias("lam"))


def _normal_quantile_sql(p):
    def poly(coefficients, x):
        out = repr(coefficients[0]) + "::DOUBLE"
        for k in coefficients[1:]:
            out = f"({out} * {x} + {k!r}::DOUBLE)"
        return out

    a, b, c, d = distributions.NORMAL_QUANTILE
    q, low, high = f"({p} - 0.5)", f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))"
    return (
        f"CASE WHEN {p} < 0.02425 THEN {poly(c, low)} / {poly((*d, 1.0), low)} "
        f"WHEN {p} > 1 - 0.02425 THEN -{poly(c, high)} / {poly((*d, 1.0), high)} "
        f"ELSE {poly(a, f'({q} * {q})')} * {q} / {poly((*b, 1.0), f'({q} * {q})')} END"
    )


@register(
    "standardize_skewed",
    f"""
    WITH c AS (SELECT event_type AS g, value AS x, count(*) AS c FROM events WHERE value IS NOT NULL GROUP BY ALL),
    r AS (SELECT g, x, (sum(c) OVER (PARTITION BY g ORDER BY x) - (c + 1) / 2.0::DOUBLE) / (sum(c) OVER (PARTITION BY g) - 1) AS p FROM c),
    q AS (SELECT g, x, greatest(1e-7::DOUBLE, least(1 - 1e-7::DOUBLE, p)) AS p FROM r)
    SELECT event_id, 'Multimodal' AS z_class, round({_normal_quantile_sql('p')}, 4) AS z FROM events LEFT JOIN q ON g = event_type AND x = value
    """,
)
def standardize_skewed(t):
    out = distributions.standardize(t.events.select("event_id", "event_type", "value"), ["event_type"], "value", "z")
    return out.select("event_id", "z_class", F.round("z", 4).alias("z"))


@register(
    "scale_zero_one",
    "SELECT c_custkey, round((c_acctbal - min(c_acctbal) OVER (PARTITION BY c_mktsegment)) / "
    "(max(c_acctbal) OVER (PARTITION BY c_mktsegment) - min(c_acctbal) OVER (PARTITION BY c_mktsegment)), 6) AS scaled FROM customer",
)
def scale_zero_one(t):
    rows = t.customer.select("c_custkey", "c_mktsegment", "c_acctbal")
    out = outlier.with_zero_one_scale(rows, ["c_mktsegment"], "c_acctbal", "scaled")
    return out.select("c_custkey", F.round("scaled", 6).alias("scaled"))


@register("scale_between", "SELECT c_custkey, round((c_acctbal + 1000) / 11000, 6) AS scaled FROM customer")
def scale_between(t):
    return t.customer.select("c_custkey", F.round(outlier.scale_between("c_acctbal", -1000.0, 10000.0), 6).alias("scaled"))


@register(
    "discretize",
    """
    WITH p AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi,
      ceil((max(l_extendedprice) - min(l_extendedprice) + 1e-6) / (2 * (quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25)) / pow(count(*), 1.0 / 3) + 1e-6)) + 1 AS b FROM lineitem)
    SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber,
      least(greatest(0, ceil((l_extendedprice - lo) / ((hi - lo) / b))::BIGINT - 1), b::BIGINT - 1) AS l_extendedprice_bin,
      (l_returnflag = 'R')::BIGINT AS returned_bin
    FROM lineitem, p
    """,
)
def discretize(t):
    rows = _lines(t, "l_extendedprice", (F.col("l_returnflag") == "R").cast("int").alias("returned"))
    out = scaling.discretize(rows, ["l_extendedprice", "returned"])
    return out.select("l_orderkey", "l_linenumber", "l_extendedprice_bin", "returned_bin")


@register(
    "anomaly_threshold",
    "SELECT event_id, CASE WHEN value > 100 THEN value ELSE 0 END AS score FROM events",
)
def anomaly_threshold(t):
    return t.events.select("event_id", entity.above("value", 100.0).alias("score"))


@register(
    "entity_counts",
    f"SELECT {_LINES}, l_partkey, count(*) OVER (PARTITION BY l_suppkey, l_partkey) AS vendor_part_count FROM lineitem",
)
def entity_counts(t):
    out = entity.with_entity_count(_lines(t, "l_partkey", "l_suppkey"), ["l_suppkey", "l_partkey"], "vendor_part_count")
    return out.drop("l_suppkey")


_CLAMP = "greatest(DATE '1975-06-01', least(DATE '2000-06-02', {c}::DATE))"


@register(
    "date_differences",
    f"SELECT {_LINES}, l_partkey, date_diff('day', {_CLAMP.format(c='l_shipdate')}, {_CLAMP.format(c='o_orderdate')}) AS o_orderdate_l_shipdate_diff, "
    f"date_diff('day', {_CLAMP.format(c='s')}, {_CLAMP.format(c='o_orderdate')}) AS o_orderdate_s_diff, "
    f"date_diff('day', {_CLAMP.format(c='s')}, {_CLAMP.format(c='l_shipdate')}) AS l_shipdate_s_diff "
    "FROM (SELECT *, l_shipdate + INTERVAL 30 DAY AS s FROM lineitem) JOIN orders ON o_orderkey = l_orderkey",
)
def date_differences(t):
    lines = _lines(t, "l_partkey", "l_shipdate").join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"))
    dates = lines.select("l_orderkey", "l_linenumber", "l_partkey", "o_orderdate", "l_shipdate", F.date_add("l_shipdate", 30).alias("s"))
    out = entity.pairwise_day_differences(dates, ["o_orderdate", "l_shipdate", "s"], "2000-06-01")
    diffs = [c for c in out.columns if c.endswith("_diff")]
    return out.select("l_orderkey", "l_linenumber", "l_partkey", *[F.col(c).cast("long").alias(c) for c in diffs])


@register(
    "duplicate_counts",
    f"""
    SELECT {_LINES}, l_partkey, count(*) OVER (PARTITION BY l_suppkey, l_quantity, l_shipdate) AS duplicate_invoice_count,
      count(*) OVER (PARTITION BY l_suppkey, l_quantity) AS recurring,
      sum(l_quantity) OVER (PARTITION BY l_suppkey, l_quantity) AS recurring_amount FROM lineitem
    """,
)
def duplicate_counts(t):
    rows = _lines(t, "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")
    out = entity.with_duplicate_counts(
        rows, "l_suppkey", "l_quantity", "l_shipdate", "duplicate_invoice_count", "recurring", "recurring_amount"
    )
    return out.drop("l_suppkey", "l_quantity", "l_shipdate")
