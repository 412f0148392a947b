"""The dependency graph: edges from precedent to dependent, nodes, neighbours, cycles and levels."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import columns as C
from ..functions.formula import FormulaError, parse, references
from .tables import discard, written

#: Cells of a range that one task makes: a larger range is cut into bands of rows, which are dealt to the tasks.
BAND_CELLS = 1 << 20
CELL = ["sheet", "row", "col"]


_TARGET = T.StructType([T.StructField(n, T.IntegerType() if n in ("r0", "c0", "r1", "c1") else T.StringType()) for n in ("kind", "sheet", "r0", "c0", "r1", "c1", "problem")])


@F.arrow_udf(_TARGET)
def _target(text: pa.Array) -> pa.Array:
    names = _TARGET.names
    out = []
    for t in text.to_pylist():
        row: dict = dict.fromkeys(names)
        try:
            tree = parse("=" + (t or "").removeprefix("="))
            if tree[0] in ("cell", "range"):
                row |= dict(zip(names, references(tree)[0][:6]))
            else:
                row["problem"] = "its target is no cell or range"
        except FormulaError as e:
            row["problem"] = f"its target can't be parsed: {e}"
        out.append(row)
    return pa.array(out, to_arrow_type(_TARGET))


def references_of(compiled: DataFrame) -> DataFrame:
    """A row per reference: workbook, cell (sheet, row, col), ord, and its kind, sheet, bounds and name."""
    return compiled.where("refs IS NOT NULL").select("workbook", *CELL, F.posexplode("refs").alias("ord", "ref")).select("workbook", *CELL, "ord", *(F.col(f"ref.{c}").alias(f"ref_{c}") for c in ("kind", "sheet", "r0", "c0", "r1", "c1", "name")))


def resolved(refs: DataFrame, named: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(references as rectangles on a sheet, names that don't resolve with the reason).

    A sheet's own name shadows the workbook's; a qualified name is looked up on that sheet alone. A target without a sheet
    is on the host sheet. Each name is parsed once and joined, not once per use.
    """
    plain = refs.where("ref_kind <> 'name'").select("workbook", *CELL, "ord", F.coalesce("ref_sheet", "sheet").alias("p_sheet"), *(F.col(f"ref_{c}").alias(c) for c in ("r0", "c0", "r1", "c1")))
    used = refs.where("ref_kind = 'name'").select("workbook", *CELL, "ord", "ref_sheet", F.col("ref_name").alias("name"))
    if named is None:
        return plain, used.select("workbook", *CELL, "name", F.lit("not defined").alias("problem"))
    known = named.groupBy("workbook", "name", "scope").agg(F.first("refers_to").alias("refers_to"))
    known = known.withColumn("t", _target("refers_to"))
    scopes = F.when(F.col("ref_sheet").isNotNull(), F.array("ref_sheet")).otherwise(F.array("sheet", F.lit("workbook")))
    tried = used.select("*", F.posexplode(scopes).alias("priority", "scope")).join(known, ["workbook", "name", "scope"], "left")
    rank = Window.partitionBy("workbook", *CELL, "ord").orderBy(F.col("t").isNull(), "priority")
    best = tried.withColumn("rn", F.row_number().over(rank)).where("rn = 1")
    good = best.where("t.kind IS NOT NULL").select("workbook", *CELL, "ord", F.coalesce("t.sheet", "sheet").alias("p_sheet"), *(F.col(f"t.{c}").alias(c) for c in ("r0", "c0", "r1", "c1")))
    bad = best.where("t.kind IS NULL").select("workbook", *CELL, "name", F.coalesce("t.problem", F.lit("not defined")).alias("problem"))
    return plain.unionByName(good), bad


def expand(rows: DataFrame, deal: bool = True) -> DataFrame:
    """A row per cell of each rectangle, row by row: p_sheet, p_row, p_col, ord, pos. Unless ``deal``, all of it is made where the rectangle is."""
    width = (F.col("c1") - F.col("c0") + 1).cast("long")
    step = F.greatest(F.lit(1), F.expr(f"{BAND_CELLS} div (c1 - c0 + 1)")).cast("int")
    small = (F.col("r1") - F.col("r0") + 1) * width <= BAND_CELLS
    bands = rows.where(~small).withColumn("b0", F.explode(F.sequence("r0", "r1", step))).withColumn("b1", F.least(F.col("b0") + step - 1, "r1"))
    every = rows.select("*", F.col("r0").alias("b0"), F.col("r1").alias("b1"))
    if deal:
        every = every.where(small).unionByName(bands.repartition(*rows.columns, "b0"))
    each = every.withColumn("p_row", F.explode(F.sequence("b0", "b1"))).withColumn("p_col", F.explode(F.sequence("c0", "c1")))
    pos = (F.col("p_row") - F.col("r0")) * width + F.col("p_col") - F.col("c0")
    return each.select("workbook", *CELL, "p_sheet", "p_row", "p_col", "ord", pos.alias("pos"))


def edges(compiled: DataFrame, named: DataFrame | None = None, deal: bool = True) -> DataFrame:
    """Distinct edges: workbook, p_sheet, p_row, p_col (precedent), sheet, row, col (dependent), ord, pos (of the first use).

    ``deal``: large ranges are dealt to the tasks. Without, edges of workbooks that are dealt by workbook stay there.
    """
    rectangles, _ = resolved(references_of(compiled), named)
    key = ["workbook", "p_sheet", "p_row", "p_col", *CELL]
    first = expand(rectangles, deal).groupBy(*key).agg(F.min(F.struct("ord", "pos")).alias("first"))
    return first.select(*key, "first.ord", "first.pos")


def nodes(compiled: DataFrame, found: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    """Cells with a formula, ends of edges, and skipped cells: workbook, sheet, row, col, empty, parse_error."""
    none = F.lit(None).cast("string")
    facts = compiled.select("workbook", *CELL, F.col("formula").isNotNull().alias("node"), F.col("empty").alias("is_empty"), F.col("parse_error"))
    named = lambda rows: rows.select("workbook", *CELL, F.lit(True).alias("node"), F.lit(None).cast("boolean").alias("is_empty"), none.alias("parse_error"))
    # the ends that are dependents have a formula, and are among the cells
    every = facts.unionByName(named(found.select("workbook", F.col("p_sheet").alias("sheet"), F.col("p_row").alias("row"), F.col("p_col").alias("col"))))
    if skipped is not None:
        every = every.unionByName(named(skipped.select("workbook", *CELL).join(compiled.select("workbook", *CELL), ["workbook", *CELL], "left_anti")))
    # one grouping instead of a join: cells dealt by workbook need no shuffle for it
    each = every.groupBy("workbook", *CELL).agg(F.max("node").alias("node"), F.max("is_empty").alias("empty"), F.max("parse_error").alias("parse_error"))
    return each.where("node").select("workbook", *CELL, F.coalesce("empty", F.lit(True)).alias("empty"), "parse_error")


def precedents(found: DataFrame, workbook: str, sheet: str, row: int, col: int) -> DataFrame:
    hit = found.where((F.col("workbook") == workbook) & (F.col("sheet") == sheet) & (F.col("row") == row) & (F.col("col") == col))
    return hit.orderBy("ord", "pos").select(C.qualified(F.col("p_sheet"), F.col("p_row"), F.col("p_col")).alias("cell"))


def dependents(found: DataFrame, workbook: str, sheet: str, row: int, col: int) -> DataFrame:
    hit = found.where((F.col("workbook") == workbook) & (F.col("p_sheet") == sheet) & (F.col("p_row") == row) & (F.col("p_col") == col))
    return hit.select(C.qualified(F.col("sheet"), F.col("row"), F.col("col")).alias("cell"))


class CyclicDependencyError(ValueError):
    def __init__(self, cycles: list[list[str]]):
        super().__init__(f"{len(cycles)} cycle(s), the first: {' -> '.join(cycles[0]) if cycles else '?'}")
        self.cycles = cycles


def _pairs(found: DataFrame) -> DataFrame:
    return found.select("workbook", C.qualified(F.col("p_sheet"), F.col("p_row"), F.col("p_col")).alias("src"), C.qualified(F.col("sheet"), F.col("row"), F.col("col")).alias("dst"))


def _levels(src: list[str], dst: list[str]) -> dict[str, int]:
    """Longest distance from a source, for the nodes that aren't on or behind a cycle."""
    after: dict[str, list[str]] = {}
    open_: dict[str, int] = {}
    for a, b in zip(src, dst):
        after.setdefault(a, []).append(b)
        open_[b] = open_.get(b, 0) + 1
        open_.setdefault(a, 0)
    level = {n: 0 for n, k in open_.items() if not k}
    ready = list(level)
    while ready:
        a = ready.pop()
        for b in after.get(a, ()):
            level[b] = max(level.get(b, 0), level[a] + 1)
            open_[b] -= 1
            if not open_[b]:
                ready.append(b)
    return {n: level[n] for n, k in open_.items() if not k}


#: Edges of a workbook that one task takes at once; the levels of a larger one are found by rounds of joins.
LARGE = 500_000


def _levels_in_rounds(pairs: DataFrame) -> DataFrame:
    """Levels of pairs(workbook, src, dst), for graphs of any size: workbook, cell, level.

    A row (workbook, cell, needs, steps) says: level at least that of ``needs`` plus steps; without ``needs``, at least steps. Each round puts the
    rows of cells that need at most one other in the place of references to them, so a chain halves and takes a logarithmic
    number of rounds. No path without a cycle has as many steps as there are cells, so what gets that far is on or behind a cycle.
    """
    spark = pairs.sparkSession
    key = ["workbook", "cell"]
    needs = pairs.select("workbook", F.col("dst").alias("cell"), F.col("src").alias("needs"), F.lit(1).cast("long").alias("steps"))
    cells = pairs.select("workbook", F.explode(F.array("src", "dst")).alias("cell")).distinct()
    cells = cells.select(*key, F.lit(None).cast("string").alias("needs"), F.lit(0).cast("long").alias("steps"))
    rows = written(cells.unionByName(needs))
    most = rows.where("needs IS NULL").count()
    while True:
        plain = rows.groupBy(*key).agg(F.count("needs").alias("open"), F.max(F.when(F.col("needs").isNotNull(), F.col("steps"))).alias("far"))
        plain = plain.where(f"open = 0 OR open = 1 AND far < {most}").select("workbook", F.col("cell").alias("needs"))
        inner = rows.select("workbook", F.col("cell").alias("needs"), F.col("needs").alias("next"), F.col("steps").alias("more")).join(plain, ["workbook", "needs"])
        moving = rows.where(f"needs IS NOT NULL AND steps < {most}").join(inner, ["workbook", "needs"], "left").withColumn("moved", F.col("more").isNotNull())
        moving = moving.select(*key, F.when(F.col("moved"), F.col("next")).otherwise(F.col("needs")).alias("needs"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), "moved")
        still = rows.where(f"needs IS NULL OR steps >= {most}").withColumn("moved", F.lit(False))
        after = written(still.unionByName(moving).groupBy(*key, "needs").agg(F.max("steps").alias("steps"), F.max("moved").alias("moved")))
        discard(spark, rows)
        rows = after
        if after.where("moved").isEmpty():
            ends = rows.groupBy(*key).agg(F.count("needs").alias("open"), F.max("steps").alias("level"))
            return ends.select(*key, F.when(F.col("open") == 0, F.col("level")).alias("level"))


def levels(found: DataFrame, large: int = LARGE) -> DataFrame:
    """Topological levels per workbook: workbook, cell, level; null on or behind a cycle.

    A workbook of up to ``large`` edges is one task's work; larger ones go by rounds of joins, with the same result.
    """

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        level = _levels(frame["src"].tolist(), frame["dst"].tolist())
        names = sorted({*frame["src"], *frame["dst"]})
        values = pd.array([level.get(n) for n in names], dtype="Int64")
        return pd.DataFrame({"workbook": frame["workbook"].iloc[0] if len(frame) else None, "cell": names, "level": values})

    pairs = _pairs(found)
    big = pairs.groupBy("workbook").count().where(F.col("count") > large).select("workbook")
    kind = "workbook string, cell string, level long"
    if big.isEmpty():
        return pairs.groupBy("workbook").applyInPandas(work, kind)
    small = pairs.join(big, "workbook", "left_anti").groupBy("workbook").applyInPandas(work, kind)
    return small.unionByName(_levels_in_rounds(pairs.join(big, "workbook", "left_semi").distinct()))


def topological_order(found: DataFrame, workbook: str) -> list[str]:
    """A valid order of a workbook's cells. CyclicDependencyError if there is none."""
    rows = levels(found.where(F.col("workbook") == workbook)).orderBy("level", "cell").collect()
    if any(r.level is None for r in rows):
        raise CyclicDependencyError([r.cells for r in cycles(found.where(F.col("workbook") == workbook)).collect()])
    return [r.cell for r in rows]


def _cycles(src: list[str], dst: list[str], limit: int | None) -> Iterator[list[str]]:
    """Elementary cycles, each from its least cell, by depth-first walks that never go below their start."""
    after: dict[str, list[str]] = {}
    for a, b in sorted(zip(src, dst)):
        after.setdefault(a, []).append(b)
    before: dict[str, list[str]] = {}
    for a, b in zip(src, dst):
        before.setdefault(b, []).append(a)
    n = 0
    for start in sorted(after):
        back, todo = {start}, [start]  # the cells from which the start can be reached
        while todo:
            for a in before.get(todo.pop(), ()):
                if a >= start and a not in back:
                    back.add(a)
                    todo.append(a)
        path, seen, walks = [start], {start}, [iter(after.get(start, ()))]
        while walks:
            for b in walks[-1]:
                if b == start:
                    yield list(path)
                    n += 1
                    if n == limit:
                        return
                elif b > start and b in back and b not in seen:
                    path.append(b)
                    seen.add(b)
                    walks.append(iter(after.get(b, ())))
                    break
            else:
                walks.pop()
                seen.discard(path.pop())


def cycles(found: DataFrame, limit: int | None = None) -> DataFrame:
    """Elementary cycles (self-references included): workbook, cells (from the least one), truncated.

    Their number is exponential in the worst case; a caller may set a ``limit`` for a workbook, behind which the rest is cut, and marked.
    """

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        out = list(_cycles(frame["src"].tolist(), frame["dst"].tolist(), limit))
        return pd.DataFrame({"workbook": [frame["workbook"].iloc[0]] * len(out), "cells": out, "truncated": [len(out) == limit] * len(out)})

    def open_ends(pairs: DataFrame, rank: DataFrame) -> DataFrame:
        """The edges between cells without a level."""
        for end in ("src", "dst"):
            pairs = pairs.join(rank.where("level IS NULL").select("workbook", F.col("cell").alias(end)), ["workbook", end], "left_semi")
        return pairs

    # what lies behind a cycle goes first, then what lies before one: a task gets the cells on cycles, and between them
    pairs = _pairs(found).distinct()
    pairs = open_ends(pairs, levels(found))
    back = found.select("workbook", *(F.col(f"p_{c}").alias(c) for c in CELL), *(F.col(c).alias(f"p_{c}") for c in CELL))
    pairs = open_ends(pairs, levels(back))
    return pairs.groupBy("workbook").applyInPandas(work, "workbook string, cells array<string>, truncated boolean")
