"""Row blocks: maximal runs of one pattern, their neighbours and labels.

Everything about a run and its two neighbours comes from one order of a sheet's row: lag and lead bring the cells beside its
ends, and then the end to the beginning. So blocks cost one shuffle of the cells at most, none where they are dealt by workbook,
without a self-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from .cells import literal_text

MIN_CELLS = 3
NEAR_MISS = 85.0
ROW = ["workbook", "sheet", "row"]
BLOCK = ["workbook", "sheet", "sheet_idx", "row", "c0", "c1", "span", "pattern"]

_VALUE = ["value_type", "value_num", "value_str", "value_bool", "value_ts"]
_SEEN = ["col", "pattern", "parse_error", "empty", *_VALUE]


def runs(compiled: DataFrame) -> DataFrame:
    """``compiled`` with ``run``: the number of the cell's maximal run of equal patterns in its row (null without a pattern)."""
    w = Window.partitionBy(*ROW).orderBy("col")
    same = F.lag("pattern").over(w).eqNullSafe(F.col("pattern")) & (F.lag("col").over(w) == F.col("col") - 1)
    first = F.when(F.col("pattern").isNotNull() & ~F.coalesce(same, F.lit(False)), 1).otherwise(0)
    numbered = F.sum(first).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return compiled.withColumn("run", F.when(F.col("pattern").isNotNull(), numbered))


def blocks(compiled: DataFrame, min_cells: int = MIN_CELLS) -> DataFrame:
    """BLOCK columns, n_cells, row_label, ``left`` and ``right``: the cells beside the block, if there are any, and the references of its first and last cells.

    Only the first and last cells of runs are kept behind the window, and a second one over the same order pairs them.
    """
    w = Window.partitionBy(*ROW).orderBy("col")
    label = F.when((F.col("col") == 1) & F.col("formula").isNull(), literal_text(F.col("value_str")))
    rows = compiled.select(*ROW, "sheet_idx", "col", "pattern", "refs", F.struct(*_SEEN).alias("seen"), label.alias("label"))
    rows = rows.withColumns({"before": F.lag("seen").over(w), "after": F.lead("seen").over(w), "row_label": F.max("label").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    side = lambda name, col: F.when(F.col(f"{name}.col") == col, F.col(name))
    rows = rows.withColumns({"before": side("before", F.col("col") - 1), "after": side("after", F.col("col") + 1)})
    goes_on = lambda name: F.coalesce(F.col(f"{name}.pattern") == F.col("pattern"), F.lit(False))
    rows = rows.where("pattern IS NOT NULL").withColumns({"begins": ~goes_on("before"), "ends": ~goes_on("after")}).where("begins OR ends")
    last = F.struct("col", "after", "refs")
    rows = rows.withColumn("last", F.when(F.col("ends"), last).otherwise(F.lead(last).over(w))).where("begins")
    found = rows.select(
        *ROW, "sheet_idx", "pattern", F.col("col").alias("c0"), F.col("last.col").alias("c1"), "row_label", F.col("before").alias("left"), F.col("last.after").alias("right"),
        F.col("refs").alias("first_refs"), F.col("last.refs").alias("last_refs"), (F.col("last.col") - F.col("col") + 1).cast("long").alias("n_cells"),
    ).where(F.col("n_cells") >= min_cells)
    span = F.concat(C.address(F.col("row"), F.col("c0")), F.lit(":"), C.address(F.col("row"), F.col("c1")))
    return found.withColumn("span", span).select(*BLOCK, "n_cells", "row_label", "left", "right", "first_refs", "last_refs")


def neighbors(found: DataFrame, near_miss: float = NEAR_MISS) -> DataFrame:
    """The cells right beside a block, classified: unparseable, near_miss, different_formula, blank or literal."""
    sides = F.array(F.struct(F.lit("left").alias("side"), F.col("left").alias("n")), F.struct(F.lit("right").alias("side"), F.col("right").alias("n")))
    each = found.select(*BLOCK, F.explode(sides).alias("s")).where("s.n IS NOT NULL").select(*BLOCK, "s.side", *(F.col(f"s.n.{c}").alias(f"n_{c}") for c in _SEEN))
    # only pairs of patterns are compared, not literals or blanks
    like = F.when(F.col("n_pattern").isNotNull(), C.similarity("pattern", "n_pattern"))
    kind = (
        F.when(F.col("n_parse_error").isNotNull(), "unparseable")
        .when(F.col("similarity") >= near_miss, "near_miss")
        .when(F.col("n_pattern").isNotNull(), "different_formula")
        .when(F.col("n_empty"), "blank")
        .otherwise("literal")
    )
    cell = C.qualified(F.col("sheet"), F.col("row"), F.col("n_col"))
    out = each.withColumn("similarity", like).withColumn("kind", kind).withColumn("cell", cell)
    return out.withColumn("n_display", C.display(lambda c: F.col(f"n_{c}"))).drop(*(f"n_{c}" for c in _VALUE))


def is_near_miss(pattern: Column, other: Column, error: Column, near_miss: float = NEAR_MISS) -> Column:
    """Whether a cell beside a block holds a formula much like the block's."""
    return F.coalesce(error.isNull() & (C.similarity(F.when(other.isNotNull(), pattern), other) >= near_miss), F.lit(False))


def column_labels(found: DataFrame, cells: DataFrame) -> DataFrame:
    """Per block ``col_labels``: the text right above each member, null where there is none, in column order."""
    texts = cells.where("formula IS NULL").select("workbook", "sheet", (F.col("row") + 1).alias("row"), "col", literal_text(F.col("value_str")).alias("text"))
    each = found.select(*BLOCK, F.explode(F.sequence("c0", "c1")).alias("col")).join(texts.where("text IS NOT NULL"), [*ROW, "col"], "left")
    ordered = F.sort_array(F.collect_list(F.struct("col", "text")))
    return each.groupBy(*BLOCK).agg(F.transform(ordered, lambda x: x["text"]).alias("col_labels"))


def members(found: DataFrame) -> DataFrame:
    """A row per member cell."""
    each = found.select(*BLOCK, "n_cells", F.explode(F.sequence("c0", "c1")).alias("col"))
    return each.withColumn("cell", C.qualified(F.col("sheet"), F.col("row"), F.col("col")))
