"""Cell-level operators: density, merged membership, skip log, cross-sheet references, compilation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources.xlsx import LET_OR_LAMBDA, STRUCTURED
from .tables import discard, written

KEY = ["workbook", "sheet", "row", "col"]


def dense(stored: DataFrame, sheets: DataFrame | None = None) -> DataFrame:
    """Adds a blank row for each cell from A1 to a sheet's last row and column that isn't stored.

    The bounds are one row per sheet; the grid is made by two generators and joined on the full key, so a
    large sheet is spread over the tasks.
    """
    size = stored.groupBy("workbook", "sheet").agg(F.first("sheet_idx").alias("sheet_idx"), F.max("row").alias("rows"), F.max("col").alias("cols"))
    if sheets is not None:
        size = size.join(sheets, ["workbook", "sheet"], "left_semi")
    grid = size.select("workbook", "sheet", "sheet_idx", F.explode(F.sequence(F.lit(1), "rows")).alias("row"), "cols")
    grid = grid.select("workbook", "sheet", "sheet_idx", "row", F.explode(F.sequence(F.lit(1), "cols")).alias("col"))
    out = grid.join(stored.drop("sheet_idx"), KEY, "left")
    if "number_format" in stored.columns:
        out = out.withColumn("number_format", F.coalesce("number_format", F.lit("General")))
    if "merged" in stored.columns:
        out = out.withColumn("merged", F.coalesce("merged", F.lit(False)))
    return out


#: Rows of a merged range that are joined as one bucket of rows.
BAND = 64


def merged_membership(cells: DataFrame, ranges: DataFrame) -> DataFrame:
    """``cells`` with ``merged``: whether some merged range (r0, c0, r1, c1) of the sheet holds the cell.

    An equi-join on the band of rows, with the bounds as the rest of the condition; the ranges aren't assumed small.
    """
    bands = ranges.withColumn("band", F.explode(F.sequence(F.floor(F.col("r0") / BAND), F.floor(F.col("r1") / BAND))))
    hit = cells.select(*KEY).withColumn("band", F.floor(F.col("row") / BAND)).join(bands, ["workbook", "sheet", "band"])
    hit = hit.where(F.col("row").between(F.col("r0"), F.col("r1")) & F.col("col").between(F.col("c0"), F.col("c1"))).select(*KEY).distinct()
    return cells.drop("merged").join(hit.withColumn("merged", F.lit(True)), KEY, "left").withColumn("merged", F.coalesce("merged", F.lit(False)))


def skip_log(cells: DataFrame, array: Column | None = None) -> DataFrame:
    """A row per reason why a formula is outside the grammar; a cell may have several and is kept as a cell."""
    reasons = F.array_compact(
        F.array(
            F.when(array, F.lit("array formula")) if array is not None else F.lit(None).cast("string"),
            F.when(F.col("formula").rlike(LET_OR_LAMBDA), F.lit("LET or LAMBDA")),
            F.when(F.col("formula").rlike(STRUCTURED), F.lit("structured reference")),
        )
    )
    return cells.where("formula IS NOT NULL").select(*KEY, F.explode(reasons).alias("reason"))


def cross_sheet_refs(formula: Column, sheet: Column) -> Column:
    """Names in front of a ! other than the cell's own sheet, in order of first use. Text only: strings count, and a quoted name begins behind its last inner quote."""
    found = F.regexp_extract_all(formula, F.lit(r"(?:'[^']+'|[A-Za-z_][A-Za-z0-9_.]*)!"), F.lit(0))
    bare = F.transform(found, lambda x: F.regexp_replace(x, r"^'|'?!$", ""))
    return F.array_distinct(F.filter(bare, lambda x: x != sheet))


def _opened(out: DataFrame, cells: DataFrame) -> DataFrame:
    return out.select(
        *cells.columns,
        F.col("_c.r1c1").alias("pattern"),
        F.col("_c.refs").alias("refs"),
        F.col("_c.error_kind").alias("error_kind"),
        F.col("_c.error_msg").alias("parse_error"),
        (F.col("formula").isNull() & F.col("value_type").isNull()).alias("empty"),
    )


def compiled(cells: DataFrame) -> DataFrame:
    """``cells`` with pattern, refs, parse_error and empty. A formula is parsed once."""
    return _opened(cells.withColumn("_c", C.compile_formula("formula", "sheet", "row", "col")), cells)


#: Formulas of all workbooks, told by text and place, up to which they are compiled apart and broadcast.
FEW = 100_000


def compiled_apart(cells: DataFrame, few: int = FEW) -> DataFrame:
    """``compiled``, for workbooks made alike: their distinct formulas are compiled in a pass of their own, and looked up.

    The cells don't go through Python, and stay where and in the order they are, so that what groups them by workbook needs no shuffle.
    With more than ``few`` distinct formulas every batch compiles its own.
    """
    key = ["formula", "sheet", "row", "col"]
    once = cells.where("formula IS NOT NULL").select(*key).distinct().limit(few + 1)
    known = written(once.withColumn("_c", C.compile_formula(*key)))
    if known.count() > few:
        discard(cells.sparkSession, known)
        return compiled(cells)
    return _opened(cells.join(F.broadcast(known), key, "left"), cells)


def literal_text(value: Column) -> Column:
    """A text that isn't blank, as it is."""
    return F.when(F.regexp_replace(value, r"(?U)\s", "") != "", value)
