"""A synthetic corpus with known ground truth, and small fixture workbooks.

An entry is a few sheets of cells ({(row, col): value}, formulas as text) and the state of the cells that matter: clean,
injected_bug, known_intentional, subtotal or ambiguous. Entries become cell rows (``tables``) or files (``write``).
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formula import column_letters as L
from . import schema
from .xlsx import value_columns, write_workbook

LITERAL, BOUNDARY, BLANK, ANCHORING = "literal-in-formula-block", "range-boundary-mismatch", "reference-to-blank", "inconsistent-anchoring"

# Fixed values of the corpus.
RATE, SEED, BASE = 0.05, 100000, 1000


@dataclass
class Entry:
    name: str
    shape: str
    sheets: dict[str, dict[tuple[int, int], object]] = field(default_factory=dict)
    truth: list[tuple[str, str, str | None, str | None]] = field(default_factory=list)

    def put(self, sheet: str, row: int, col: int, value) -> None:
        self.sheets.setdefault(sheet, {})[row, col] = value

    def know(self, sheet: str, row: int, col: int, state: str, rule: str | None = None, note: str | None = None) -> None:
        self.truth.append((f"{sheet}!{L(col)}{row}", state, rule, note))


def growth(e: Entry, n: int, bug: str | None = None, at: int = -1, state: str = "injected_bug", sheet: str = "Model", row: int = 14) -> Entry:
    """A seed in column B and n cells that each grow the one before; ``bug`` (literal or anchoring) replaces cell ``at``."""
    e.put(sheet, 1, 2, RATE)
    e.put(sheet, row, 2, SEED)
    e.know(sheet, row, 2, "known_intentional", note="seed of the chain")
    value = float(SEED)
    for i in range(n):
        col, value = 3 + i, value * (1 + RATE)
        hit = bug if i == at else None
        e.put(sheet, row, col, round(value, 2) if hit == "literal" else f"={L(col - 1)}{row}*(1+{'B$1' if hit else '$B$1'})")
        e.know(sheet, row, col, state if hit else "clean", {"literal": LITERAL, "anchoring": ANCHORING}.get(hit))
    return e


def trailing(e: Entry, m: int, bug: str | None = None, at: int = -1, state: str = "injected_bug", sheet: str = "Rolling", data: int = 4) -> Entry:
    """m months of data and, below, sums of three months each; ``bug``: boundary shortens sum ``at``, blank leaves month ``at`` out."""
    for j in range(m):
        if not (bug == "blank" and j == at):
            e.put(sheet, data, 2 + j, BASE * (j + 1))
    for i in range(m - 2):
        col = 4 + i
        short = bug == "boundary" and i == at
        gap = bug == "blank" and at - 2 <= i <= at
        e.put(sheet, data + 1, col, f"=SUM({L(col - 1 if short else col - 2)}{data}:{L(col)}{data})")
        e.know(sheet, data + 1, col, state if short or gap else "clean", BOUNDARY if short else BLANK if gap else None)
    return e


def category(e: Entry, cats: int, cols: int, sheet: str = "Totals", top: int = 14) -> Entry:
    for j in range(cols):
        for r in range(cats):
            e.put(sheet, top + r, 2 + j, BASE * (r + 1) * (j + 1))
        e.put(sheet, top + cats, 2 + j, f"=SUM({L(2 + j)}{top}:{L(2 + j)}{top + cats - 1})")
        e.know(sheet, top + cats, 2 + j, "subtotal")
    return e


def variance(e: Entry, n: int, bug: str | None = None, at: int = -1, state: str = "injected_bug", sheet: str = "Variance") -> Entry:
    for j in range(n):
        col, hit = 2 + j, bug if j == at else None
        if hit != "blank":
            e.put(sheet, 4, col, 2 * BASE * (j + 1))
        e.put(sheet, 5, col, BASE * (j + 1))
        e.put(sheet, 6, col, BASE * (j + 1) if hit == "literal" else f"={L(col)}4-{L(col)}5")
        e.know(sheet, 6, col, state if hit else "clean", {"literal": LITERAL, "blank": BLANK}.get(hit))
    return e


def entries() -> Iterator[Entry]:
    """The 144 entries."""
    edges = lambda n: (("edge_left", 0), ("edge_right", n - 1))
    for bug, tag in (("literal", "literal_in_block"), ("anchoring", "inconsistent_anchoring")):
        for n in (4, 5, 6):
            for where, at in edges(n):
                yield growth(Entry(f"{tag}__{where}__n{n}", "growth_chain"), n, bug, at)
        for n in (7, 8, 10, 12):
            yield growth(Entry(f"{tag}__interior__n{n}", "growth_chain"), n, bug, 3)
    for n in (4, 6, 8, 10, 12):
        yield growth(Entry(f"clean__growth_chain__n{n}", "growth_chain"), n)
    for n in (4, 5, 6):
        for where, at in edges(n):
            yield trailing(Entry(f"range_boundary__{where}__n{n}", "trailing_sum"), n + 2, "boundary", at)
    for n in (7, 8, 10, 12):
        yield trailing(Entry(f"range_boundary__interior__n{n}", "trailing_sum"), n + 2, "boundary", 3)
    strong = {"medium": ((6, 1), (6, 2), (7, 2)), "high": ((10, 4), (12, 4), (14, 5))}
    for severity, pairs in strong.items():
        for m, at in pairs:
            yield trailing(Entry(f"reference_to_blank__{severity}__m{m}_blank{at}", "trailing_sum"), m, "blank", at)
    for m in (6, 8, 10, 12, 14):
        yield trailing(Entry(f"clean__trailing_sum__m{m}", "trailing_sum"), m)
    both = growth(Entry("cross_block_isolation__literal_in_block", "cross_block_isolation"), 8, "literal", 3, sheet="Combined")
    yield trailing(both, 10, sheet="Combined", data=29)
    for bug, tag in (("literal", "literal_in_block"), ("anchoring", "inconsistent_anchoring")):
        for where, at in edges(4):
            yield growth(Entry(f"ambiguous__{tag}__weak_{where}__n4", "growth_chain"), 4, bug, at, "ambiguous")
    for cats in range(2, 7):
        for cols in range(3, 15):
            yield category(Entry(f"subtotal__category_total__cat{cats}_col{cols}", "category_total"), cats, cols)
    for n in (4, 5, 6):
        for where, at in edges(n):
            yield variance(Entry(f"variance__literal_in_block__{where}__n{n}", "variance"), n, "literal", at)
    for n in (7, 8, 10, 12):
        yield variance(Entry(f"variance__literal_in_block__interior__n{n}", "variance"), n, "literal", 3)
    for where, at in edges(4):
        yield variance(Entry(f"ambiguous__variance__literal_in_block__weak_{where}__n4", "variance"), 4, "literal", at, "ambiguous")
    for n, at in ((5, 2), (8, 4), (10, 5)):
        yield variance(Entry(f"variance__reference_to_blank__n{n}_blank{at}", "variance"), n, "blank", at)
    for n in (4, 6, 8, 10):
        yield variance(Entry(f"clean__variance__n{n}", "variance"), n)
    # near ties: two to three fifths of the sums see the gap
    used = {p for pairs in strong.values() for p in pairs}
    for m in range(6, 21):
        for at in range(m):
            hit = sum(at - 2 <= i <= at for i in range(m - 2))
            if (m, at) not in used and 0 < hit < m - 2 and 0.4 <= hit / (m - 2) <= 0.6:
                yield trailing(Entry(f"ambiguous__reference_to_blank__near_tie__m{m}_blank{at}", "trailing_sum"), m, "blank", at, "ambiguous")


def cell_rows(name: str, sheets: dict[str, dict[tuple[int, int], object]]) -> Iterator[tuple]:
    """Cell rows of sheets, dense from A1."""
    for index, (sheet, cells) in enumerate(sheets.items()):
        for row in range(1, max((r for r, _ in cells), default=0) + 1):
            for col in range(1, max(c for _, c in cells) + 1):
                value = cells.get((row, col))
                formula = value if isinstance(value, str) and value.startswith("=") else None
                yield (name, sheet, index, row, col, formula, *value_columns(None if formula else value).values(), "General", False)


def tables(spark: SparkSession, chosen: list[Entry] | None = None) -> tuple[DataFrame, DataFrame]:
    """(cells, ground truth); the entry's name is the workbook's."""
    chosen = list(entries()) if chosen is None else chosen
    cells = spark.createDataFrame([r for e in chosen for r in cell_rows(e.name, e.sheets)], schema.CELLS)
    truth = spark.createDataFrame([(e.name, e.shape, *t) for e in chosen for t in e.truth], schema.GROUND_TRUTH)
    return cells, truth


def write(folder: str, chosen: list[Entry] | None = None) -> None:
    """Workbook and ground-truth files of the entries."""
    os.makedirs(folder, exist_ok=True)
    for e in entries() if chosen is None else chosen:
        write_workbook(os.path.join(folder, f"{e.name}.xlsx"), e.sheets)
        truth = {"workbook": f"{e.name}.xlsx", "base_shape": e.shape, "cells": [dict(zip(("cell", "state", "rule_id", "note"), t)) for t in e.truth]}
        with open(os.path.join(folder, f"{e.name}.ground_truth.json"), "w", encoding="utf-8") as out:
            json.dump(truth, out, indent=1)


def read_truth(spark: SparkSession, folder: str, names: list[str] | None = None) -> DataFrame:
    """Ground truth of ``*.ground_truth.json`` files; ``names`` selects entries (an empty list is an error)."""
    if names is not None and not names:
        raise ValueError("no entries were asked for")
    kind = "workbook string, base_shape string, cells array<struct<cell string, state string, rule_id string, note string>>"
    rows = spark.read.schema(kind).option("multiLine", True).option("pathGlobFilter", "*.ground_truth.json").json(folder)
    out = rows.select(F.regexp_replace("workbook", r"\.xls[xm]$", "").alias("entry"), "base_shape", F.explode("cells").alias("c")).select("entry", "base_shape", "c.*")
    return out if names is None else out.where(F.col("entry").isin(names))


MONTHS = ["Jan-24", "Feb-24", "Mar-24", "Apr-24", "May-24", "Jun-24", "Jul-24", "Aug-24", "Sep-24", "Oct-24", "Nov-24", "Dec-24"]


def fixtures() -> dict[str, dict]:
    """Ten small workbooks: name -> arguments of ``write_workbook``."""
    chain = lambda row, by: {(row, c): f"={L(c - 1)}{row}*{by(c)}" for c in range(3, 14)}
    out: dict[str, dict] = {}
    clean = {(1, 1): "Line Item", **{(1, 2 + i): m for i, m in enumerate(MONTHS[:4])}, (2, 1): "Revenue", (2, 2): 100000, **{(2, c): f"={L(c - 1)}2*1.05" for c in range(3, 6)}, (3, 1): "Growth Rate", **{(3, c): 0.05 for c in range(2, 6)}}
    out["clean_model"] = {"sheets": {"Model": clean}, "formats": {"Model": {(2, c): "#,##0" for c in range(2, 6)}}}
    out["merged_cells"] = {"sheets": {"Budget": {(1, 1): "FY2024 Budget", (2, 1): "Item", (2, 2): "Plan", (2, 3): "Actual", (2, 4): "Sum", (3, 2): 1000, (3, 3): 1200, (3, 4): "=B3+C3"}}, "merged": {"Budget": ["A1:D1"]}}
    out["named_range_cross_sheet"] = {"sheets": {"Assumptions": {(1, 1): "Tax", (1, 2): 0.21}, "Model": {(1, 2): 500000, (2, 2): "=B1*Assumptions!B1", (3, 2): "=B1-B2"}}, "names": [("TaxRate", "Assumptions!$B$1", None), ("LocalNet", "Model!$B$3", "Model")]}
    out["skip_cases"] = {"sheets": {"Edge Cases": {(1, 2): "=SUM(C1:C3*D1:D3)", (2, 2): "=LET(x, 5, x*2)", (3, 2): "=SUM(Table1[Column1])", (4, 1): "text", (4, 2): '=A4&"!"'}}, "arrays": {"Edge Cases": {(1, 2): "B1"}}}
    out["circular_reference"] = {"sheets": {"Circular": {(1, 1): "=B1+1", (1, 2): "=A1+1"}}}
    out["blank_reference"] = {"sheets": {"Blank Refs": {(1, 1): 10, (1, 2): "=A1+C1", (1, 4): "marker"}}}
    head = {(13, 1): "Line Item", **{(13, 2 + i): m for i, m in enumerate(MONTHS)}, (14, 1): "Revenue", (14, 2): 100000, (15, 1): "Growth Rate", **{(15, c): 0.05 for c in range(2, 14)}}
    out["revenue_row_with_hardcode"] = {"sheets": {"Model": {**head, **chain(14, lambda c: f"(1+{L(c - 1)}15)"), (14, 8): 4500000}}}
    roll = {**{(3, 2 + i): m for i, m in enumerate(MONTHS)}, **{(4, 2 + i): 1000 * (i + 1) for i in range(12)}, **{(5, c): f"=SUM({L(c - 2)}4:{L(c)}4)" for c in range(4, 14)}}
    out["range_boundary_mismatch"] = {"sheets": {"Rolling": {**roll, (5, 8): "=SUM(G4:H4)"}}}
    out["reference_to_blank_gap"] = {"sheets": {"Rolling": {k: v for k, v in roll.items() if k != (4, 6)}}}
    out["inconsistent_anchoring"] = {"sheets": {"Model": {(1, 2): 0.05, (14, 2): 100000, **chain(14, lambda c: "(1+$B$1)"), (14, 8): "=G14*(1+B$1)"}}}
    return out


def write_fixtures(folder: str) -> None:
    os.makedirs(folder, exist_ok=True)
    for name, args in fixtures().items():
        write_workbook(os.path.join(folder, f"{name}.xlsx"), **args)
