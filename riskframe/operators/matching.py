"""Two-way match: invoice lines against the lines of the same purchase order.

Lines carry ``item_id, item_description, item_amount, item_quantity``; purchase
orders are keyed by ``po_id``, invoices by ``invoice_id, po_id``.  Every pair of an
order is scored, in a join that adaptive execution splits where an order is large.
Orders with few pairs are matched whole: their lines meet once, dealt by order, and the
pairs of an invoice are taken in order.  Larger orders, which one task may not hold, are
matched in steps on classes of equal lines: lines of one class have the same
difference to every other line, so they are taken in order of their ids and only
classes are paired.  One step is repeated on all orders at once: two classes whose
first open lines are each other's best are matched line by line, as far as no other
class has as good a line with a lower id.  Under a strict order of pairs that is the
greedy match.  Steps do not grow with the number of equal lines.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.frames import top_per_key
from riskframe.operators.similarity import fuzzy_ratio
from riskframe.ordered import running_totals
from riskframe.session import durable

# Weights of the amount, quantity and description differences.
AMOUNT_WEIGHT = 0.25
QUANTITY_WEIGHT = 0.25
DESCRIPTION_WEIGHT = 0.50
# Orders with at most this many pairs, all their invoices together, are matched within one row.
WHOLE_ORDER_PAIRS = 10_000
_LINE = ("item_id", "item_description", "item_amount", "item_quantity")


def percent_difference(po: Column, invoice: Column) -> Column:
    """Difference in percent of the invoice's value; 100 where that is 0 or missing."""
    # Rounded twice: binary noise must not decide a tie at the second decimal.
    percent = F.round(F.round((po - invoice) / invoice * 100, 10), 2)
    return F.coalesce(F.when(invoice != 0, percent), F.lit(100.0))


def _sides(invoices: DataFrame, orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    i = invoices.select("invoice_id", "po_id", *[F.col(c).alias(f"{c}_invoice") for c in _LINE])
    o = orders.select("po_id", *[F.col(c).alias(f"{c}_po") for c in _LINE])
    return i, o


def _scored(pairs: DataFrame) -> DataFrame:
    amount = percent_difference(F.col("item_amount_po"), F.col("item_amount_invoice"))
    quantity = percent_difference(F.col("item_quantity_po"), F.col("item_quantity_invoice"))
    text = 100 - fuzzy_ratio(
        F.coalesce("item_description_invoice", F.lit("")), F.coalesce("item_description_po", F.lit(""))
    )
    parts = pairs.withColumns({"amount_diff": amount, "quantity_diff": quantity, "description_diff": text})
    # Differences have two decimals: weighing whole hundredths keeps ties exact.
    hundredths = (
        F.round(F.abs("amount_diff") * 100) * AMOUNT_WEIGHT
        + F.round(F.abs("quantity_diff") * 100) * QUANTITY_WEIGHT
        + F.abs("description_diff") * 100 * DESCRIPTION_WEIGHT
    )
    return parts.select(
        "invoice_id", "po_id", "item_id_invoice", "item_id_po", "amount_diff", "quantity_diff", "description_diff",
        (F.round(hundredths) / 100).alias("weighted_diff"),
    )


def pair_counts(invoices: DataFrame, orders: DataFrame) -> DataFrame:
    """Lines of each invoice and of its order (the line-count comparison)."""
    i = invoices.groupBy("invoice_id", "po_id").agg(F.count(F.lit(1)).alias("invoice_lines"))
    o = orders.groupBy("po_id").agg(F.count(F.lit(1)).alias("po_lines"))
    return i.join(o, "po_id", "left").select(
        "invoice_id", "po_id", "invoice_lines", F.coalesce("po_lines", F.lit(0)).alias("po_lines")
    )


def line_count_comparison(invoices: DataFrame, orders: DataFrame) -> DataFrame:
    counts = pair_counts(invoices, orders)
    return counts.withColumn("same_count", F.col("invoice_lines") == F.col("po_lines"))


def scored_pairs(invoices: DataFrame, orders: DataFrame) -> DataFrame:
    """Every pair of an invoice line and a line of its order, with its differences."""
    i, o = _sides(invoices, orders)
    return _scored(i.join(o, "po_id"))


def _ranked(lines: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Lines with their class (all but the id, as text) and rank in it, and the classes with size, content and first id."""
    content = F.to_json(F.struct(*_LINE[1:]))
    named = lines.select(*key, content.alias("class"), "item_id", F.lit(1).alias("one"))
    ranked = durable(running_totals(named, [*key, "class"], "item_id", {"rank": "one"}).drop("one"))
    first = [F.first(c).alias(c) for c in _LINE[1:]]
    classes = lines.withColumn("class", content).groupBy(*key, "class").agg(F.count(F.lit(1)).alias("size"), F.min("item_id").alias("head"), *first)
    return ranked, durable(classes)


def two_way_match(invoices: DataFrame, orders: DataFrame) -> DataFrame:
    """Greedy one-to-one match of invoice lines and order lines.

    Ascending difference; ties by invoice line, then order line.  Line ids are unique
    in an invoice and in an order.
    """
    n, m = invoices.groupBy("po_id").agg(F.count("invoice_id").alias("n")), orders.groupBy("po_id").agg(F.count(F.lit(1)).alias("m"))
    large = durable(n.join(m, "po_id").where(F.col("n") * F.col("m") > WHOLE_ORDER_PAIRS).select("po_id"))
    if large.isEmpty():
        return _match_whole(invoices, orders)
    small = _match_whole(*[lines.join(large, "po_id", "left_anti") for lines in (invoices, orders)])
    return small.unionByName(_match_classes(*[lines.join(large, "po_id", "left_semi") for lines in (invoices, orders)]))


def _match_whole(invoices: DataFrame, orders: DataFrame) -> DataFrame:
    """The match of orders whose pairs fit into one row; lines are dealt by order once, pairs are not shuffled."""
    i, o = _sides(invoices.where(F.col("invoice_id").isNotNull()), orders)
    pair = F.struct("weighted_diff", "item_id_invoice", "item_id_po")
    pairs = _scored(i.join(o.hint("merge"), "po_id")).groupBy("invoice_id", "po_id").agg(F.sort_array(F.collect_list(pair)).alias("_pairs"))

    def free(taken: Column, p: Column) -> Column:
        return ~F.exists(taken, lambda t: t["item_id_invoice"].eqNullSafe(p["item_id_invoice"]) | t["item_id_po"].eqNullSafe(p["item_id_po"]))

    taken = F.aggregate("_pairs", F.slice("_pairs", 1, 0), lambda t, p: F.when(free(t, p), F.concat(t, F.array(p))).otherwise(t))
    found = pairs.select("invoice_id", "po_id", F.explode(taken).alias("_p"))
    return found.select("invoice_id", "po_id", "_p.item_id_invoice", "_p.item_id_po", "_p.weighted_diff")


def _match_classes(invoices: DataFrame, orders: DataFrame) -> DataFrame:
    """The match of orders of any size, in steps on classes of equal lines."""
    key = ["invoice_id", "po_id"]
    lines_a, classes_a = _ranked(invoices, key)
    lines_b, classes_b = _ranked(orders, ["po_id"])
    pairs = scored_pairs(*[c.withColumn("item_id", F.col("class")) for c in (classes_a, classes_b)])
    pairs = pairs.select(*key, F.col("item_id_invoice").alias("a"), F.col("item_id_po").alias("b"), F.col("weighted_diff").alias("w"))
    state = [F.lit(0).cast("long").alias("used"), "size", "head"]
    for side, classes, by in (("a", classes_a, key), ("b", classes_b, ["po_id"])):
        own = classes.select(*by, F.col("class").alias(side), F.struct(*state).alias(f"{side}_at"))
        pairs = pairs.join(own, [*by, side])
    pairs, taken = durable(pairs), None
    while True:
        matched = durable(_matched(pairs, lines_a, lines_b))
        taken = matched if taken is None else taken.unionByName(matched)
        if matched.isEmpty():
            break
        pairs = durable(_left_open(pairs, matched, lines_a, lines_b))
    own = taken.select(*key, F.col("a").alias("class"), "b", "w", "n", F.col("a_at.used").alias("from_a"), F.col("b_at.used").alias("from_b"))
    found = own.join(lines_a, [*key, "class"]).where("rank > from_a AND rank <= from_a + n")
    found = found.select(*key, F.col("b").alias("class"), F.col("item_id").alias("item_id_invoice"), "w", (F.col("rank") - F.col("from_a") + F.col("from_b")).alias("rank"))
    found = found.join(lines_b, ["po_id", "class", "rank"])
    return found.select(*key, "item_id_invoice", F.col("item_id").alias("item_id_po"), F.col("w").alias("weighted_diff"))


def _best_two(pairs: DataFrame, side: str, other: str) -> DataFrame:
    """The best open pair of each class, and the first line of another class that is as good (null if none)."""
    key = ["invoice_id", "po_id", side]
    order = [F.col("w"), F.col(f"{other}_at.head"), F.col(other)]
    two = top_per_key(pairs, key, order, 2)
    listed = F.sort_array(F.collect_list(F.struct(F.col("w"), F.col(f"{other}_at.head").alias("head"), F.col(other).alias("class"))))
    two = two.groupBy(*key).agg(listed.alias("_two"))
    rival = F.when(F.get("_two", F.lit(1))["w"] == F.get("_two", F.lit(0))["w"], F.get("_two", F.lit(1))["head"])
    return two.select(*key, F.get("_two", F.lit(0))["class"].alias(other), rival.alias(f"{other}_rival"))


def _matched(pairs: DataFrame, lines_a: DataFrame, lines_b: DataFrame) -> DataFrame:
    """Pairs of classes that are each other's best, with the number ``n`` of lines that can be matched at once."""
    key = ["invoice_id", "po_id", "a", "b"]
    best = pairs.join(_best_two(pairs, "a", "b"), key).join(_best_two(pairs, "b", "a"), key)
    best = durable(best)
    for side, lines, by in (("a", lines_a, ["invoice_id", "po_id"]), ("b", lines_b, ["po_id"])):
        # Lines of the class before the rival's first one.
        own = lines.withColumnRenamed("class", side)
        early = best.where(F.col(f"{side}_rival").isNotNull()).join(own, [*by, side]).where(F.col("item_id") < F.col(f"{side}_rival"))
        best = best.join(early.groupBy(*key).agg(F.max("rank").alias(f"{side}_early")), key, "left")
    left = [F.col(f"{s}_at.size") - F.col(f"{s}_at.used") for s in "ab"]
    early = [F.when(F.col(f"{s}_rival").isNotNull(), F.coalesce(f"{s}_early", F.lit(0)) - F.col(f"{s}_at.used")) for s in "ab"]
    return best.select(*key, "w", "a_at", "b_at", F.least(*left, *early).alias("n"))


def _left_open(pairs: DataFrame, matched: DataFrame, lines_a: DataFrame, lines_b: DataFrame) -> DataFrame:
    """Pairs whose classes both have lines left, with the classes' new first lines."""
    for side, lines, by in (("a", lines_a, ["invoice_id", "po_id"]), ("b", lines_b, ["po_id"])):
        now = matched.select("invoice_id", "po_id", side, f"{side}_at", (F.col(f"{side}_at.used") + F.col("n")).alias("_used"))
        heads = lines.select(*by, F.col("class").alias(side), (F.col("rank") - 1).alias("_used"), F.col("item_id").alias("_head"))
        now = now.join(heads, [*by, side, "_used"], "left")
        new = F.struct(F.col("_used").alias("used"), F.col(f"{side}_at.size").alias("size"), F.col("_head").alias("head"))
        now = durable(now.select("invoice_id", "po_id", side, new.alias("_now")))
        pairs = pairs.join(now, ["invoice_id", "po_id", side], "left").withColumn(f"{side}_at", F.coalesce("_now", f"{side}_at")).drop("_now")
    return pairs.where("a_at.used < a_at.size AND b_at.used < b_at.size")
