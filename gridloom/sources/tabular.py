"""Workbooks made of business tables: one per customer, from orders.

Sheet Model has a growth chain per year (row 14 is 1995, column B January), sheet Rolling a row of monthly revenue in cents and,
below, trailing three-month sums. Deviations depend on k = (customer + year) mod 10:

    Model, July (column H)      0 literal   1 drifted anchor   2 other formula   3 blank   4 no formula tree
    Rolling                     5 data of May missing   6 the sum in column I is one column short

The grid has a fixed number of cells per customer, so it grows with the customers. Customers and their monthly sums are dealt by workbook
once; the cells come from that in order, and stay there for whatever is grouped by workbook, sheet and row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import letters
from .corpus import ANCHORING, BLANK, BOUNDARY, LITERAL
from .schema import CELL_NAMES

FIRST, LAST = 1995, 2001
#: Workbooks that one task makes and analyses.
WORKBOOKS = 1_500


def _customers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """(c and workbook of every customer, dealt by workbook; number of the parts)."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("c"), F.col("c_custkey").cast("string").alias("workbook"))
    parts = customers.count() // WORKBOOKS + 1
    return customers.repartition(parts, "workbook"), parts


def _revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """c, workbook and cents, a map from year * 12 + month, of every customer, dealt by workbook."""
    every, parts = _customers(spark, sf_dir)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").where(F.year("o_orderdate").between(FIRST, LAST))
    month = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    sums = orders.groupBy(F.col("o_custkey").cast("string").alias("workbook"), month.alias("at")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("sum"))
    # a customer's months are summed before they are dealt, so that one with many orders is no large part
    cents = sums.repartition(parts, "workbook").groupBy("workbook").agg(F.map_from_entries(F.collect_list(F.struct("at", "sum"))).alias("cents"))
    return every.join(cents, "workbook", "left")


def _text(*parts) -> Column:
    return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))


def _templates(spark: SparkSession) -> DataFrame:
    """Per ``kind`` of customer (any with the same remainders): its cells in order, with ``at``, the month that gives the number, and texts."""
    kinds = spark.createDataFrame([(n,) for n in (*range(10), *range(-3010, -3000), *range(-2000, -1995), None)], "kind long")
    months = kinds.withColumn("y", F.explode(F.sequence(F.lit(FIRST), F.lit(LAST)))).withColumn("m", F.explode(F.sequence(F.lit(1), F.lit(12)))).withColumn("k", (F.col("kind") + F.col("y")) % 10)
    none = F.lit(None).cast("string")
    k, m, y = F.col("k"), F.col("m"), F.col("y")
    col, i = m + 1, y - FIRST
    row, at = 14 + i, y * 12 + m
    before = _text(letters(col - 1), row.cast("string"))
    odd = (m == 7) & k.isin(0, 1, 2, 3, 4)
    formula = F.when(m == 1, none).when(odd & (k == 0), none).when(odd & (k == 1), _text("=", before, "*(1+B$1)")).when(odd & (k == 2), _text("=", before, "*2")).when(odd & (k == 4), _text("=", before, "*(")).otherwise(_text("=", before, "*(1+$B$1)"))

    def cells(rows: DataFrame, sheet: str, index: int, row: Column, col: Column, formula: Column, at: Column | None = None, number: float | None = None, text: Column = none) -> DataFrame:
        at = F.lit(None) if at is None else at
        cell = F.struct(F.lit(index).alias("sheet_idx"), row.cast("int").alias("row"), col.cast("int").alias("col"), F.lit(sheet).alias("sheet"), formula.alias("formula"), at.cast("int").alias("at"), F.lit(number).cast("double").alias("number"), text.alias("text"))
        return rows.select("kind", cell.alias("cell"))

    out = cells(months.where(~((m == 7) & (k == 3))), "Model", 0, row, col, formula, F.when((m == 1) | (odd & (k == 0)), at))
    data = 4 + 2 * i
    out = out.unionByName(cells(months.where(~((m == 5) & (k == 5))), "Rolling", 1, data, col, none, at))
    start = F.when((k == 6) & (m == 8), col - 1).otherwise(col - 2)
    total = _text("=SUM(", letters(start), data.cast("string"), ":", letters(col), data.cast("string"), ")")
    out = out.unionByName(cells(months.where(m >= 3), "Rolling", 1, data + 1, col, total))
    out = out.unionByName(cells(months.where(m == 1), "Model", 0, row, F.lit(1), none, text=_text("Y", y.cast("string"))))
    out = out.unionByName(cells(months.where((m == 1) & (y == FIRST)), "Model", 0, F.lit(1), F.lit(2), none, number=0.05))
    out = out.unionByName(cells(months.where(y == FIRST), "Model", 0, F.lit(13), col, none, text=_text("M", F.lpad(m.cast("string"), 2, "0"))))
    return out.groupBy("kind").agg(F.sort_array(F.collect_list("cell")).alias("cells"))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored cells (blank ones are absent). A workbook's cells are made in one task, in order, and are dealt by workbook."""
    c = F.col("c")
    # what a workbook holds besides its numbers depends on the remainders (c + year) mod 10, and their signs
    kind = F.when(c >= -FIRST, F.pmod(c, F.lit(10))).when(c <= -LAST, F.pmod(c, F.lit(10)) - 3010).otherwise(c)
    templates = F.broadcast(_templates(spark).withColumnRenamed("kind", "of"))
    each = _revenue(spark, sf_dir).withColumn("kind", kind).join(templates, F.col("kind").eqNullSafe(F.col("of")))
    each = each.select("workbook", "cents", F.inline("cells"))
    number = F.when(F.col("at").isNotNull(), F.coalesce(F.try_element_at("cents", "at"), F.lit(0)).cast("double")).otherwise(F.col("number"))
    value = F.when(number.isNotNull(), "num").when(F.col("text").isNotNull(), "str")
    more = {
        "value_type": value, "value_num": number, "is_int": F.when(number.isNotNull(), number == F.floor(number)), "value_str": F.col("text"), "value_bool": F.lit(None).cast("boolean"), "value_ts": F.lit(None).cast("timestamp"),
        "number_format": F.lit("General"), "merged": F.lit(False),
    }
    return each.select(*(more[n].alias(n) if n in more else n for n in CELL_NAMES))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the deviations mean: entry, base_shape, cell, state, rule_id, note. The broken formula (k = 4) is a bug that no rule finds."""
    customers, _ = _customers(spark, sf_dir)
    months = customers.withColumn("y", F.explode(F.sequence(F.lit(FIRST), F.lit(LAST)))).withColumn("m", F.explode(F.sequence(F.lit(1), F.lit(12))))
    months = months.withColumn("k", (F.col("c") + F.col("y")) % 10)
    k, m = F.col("k"), F.col("m")
    i = F.col("y") - FIRST
    seed = F.col("m") == 1

    def states(sheet: str, row: Column, cases: list[tuple[Column, str, str | None]]) -> DataFrame:
        state = rule = None
        for cond, s, r in cases:
            state = F.when(cond, s) if state is None else state.when(cond, s)
            rule = F.when(cond, F.lit(r).cast("string")) if rule is None else rule.when(cond, F.lit(r).cast("string"))
        cell = _text(sheet, "!", letters(m + 1), row.cast("string"))
        shape = "growth_chain" if sheet == "Model" else "trailing_sum"
        return months.select(F.col("workbook").alias("entry"), F.lit(shape).alias("base_shape"), cell.alias("cell"), state.alias("state"), rule.alias("rule_id"), F.lit(None).cast("string").alias("note")).where("state IS NOT NULL")

    model = states("Model", 14 + i, [
        (seed, "known_intentional", None), ((m == 7) & (k == 0), "injected_bug", LITERAL), ((m == 7) & (k == 1), "injected_bug", ANCHORING), ((m == 7) & (k == 2), "ambiguous", BOUNDARY),
        ((m == 8) & (k == 3), "injected_bug", BLANK), ((m == 7) & (k == 4), "injected_bug", LITERAL),
    ])
    rolling = states("Rolling", 5 + 2 * i, [((k == 5) & m.isin(5, 6, 7), "injected_bug", BLANK), ((k == 6) & (m == 8), "injected_bug", BOUNDARY)])
    return model.unionByName(rolling)
