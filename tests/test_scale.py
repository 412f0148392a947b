"""What the queries over workbooks keep and shuffle, and the rules that do without."""

import re

import pytest

from gridloom.operators import cells as K
from gridloom.operators import graph as G
from gridloom.operators import rules as R
from gridloom.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["ag_counts", "rl_all_issues"])
def test_no_cell_is_kept_or_shuffled(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryTableScan" not in plan
    dealt = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)
    assert not [keys for keys in dealt if re.search(r"\b(row|col|p_row)#", keys)]


def _cells(spark, formulas, numbers):
    rows = [("w", "S", 0, r, c, f, None, None) for (r, c), f in formulas.items()] + [("w", "S", 0, r, c, None, "num", 1.0) for r, c in numbers]
    kind = "workbook string, sheet string, sheet_idx int, row int, col int, formula string, value_type string, value_num double, value_str string, value_bool boolean, value_ts timestamp"
    return spark.createDataFrame([(*r, None, None, None) for r in rows], kind)


def test_blank_precedents_of_crossing_ranges(spark):
    """Fixed ends that relative ones pass, references over several rows and on blocks of any width, against all cells one by one."""
    rows = {1: "=SUM($D1:{0}20)", 2: "=SUM({0}21:$E22)+$B$30", 3: "={0}31+{1}31*$A31", 4: "=SUM(${0}40:{1}41)"}
    formulas = {(r, c): f.format("ABCDEFGHIJ"[c - 2], "ABCDEFGHIJ"[c - 1]) for r, f in rows.items() for c in range(2, 9)}
    numbers = [(r, c) for r in (*range(5, 23), 31, 40, 41) for c in range(1, 12) if (r * 7 + c * 5) % 4]
    cells = _cells(spark, formulas, numbers)
    for a in (R.analyze(cells), R.analyze_alike(cells)):
        block = a.blocks.selectExpr("workbook", "sheet", "row", "c0 AS b0", "c1 AS b1")
        inside = a.rectangles.join(block, ["workbook", "sheet", "row"]).where("col BETWEEN b0 AND b1")
        each = G.expand(a.rectangles.join(inside.select("workbook", "sheet", "row", "col").distinct(), ["workbook", "sheet", "row", "col"]))
        want: dict = {}
        for r in each.orderBy("ord", "pos").collect():
            if (r.p_row, r.p_col) not in {*formulas, *numbers}:
                names = want.setdefault((r.row, r.col), [])
                name = f"S!{'ABCDEFGHIJKL'[r.p_col - 1]}{r.p_row}"
                if name not in names:
                    names.append(name)
        got = {(r.row, r.col): r.blanks for r in R._blank_precedents(a).collect()}
        assert got == want and len(got) > 10


def test_more_formulas_than_are_broadcast(spark):
    cells = _cells(spark, {(r, 1): f"=B{r}*2" for r in range(1, 9)}, [(1, 2)])
    columns = ["row", "col", "pattern", "refs", "parse_error", "empty"]
    want = sorted(K.compiled(cells).select(*columns).collect())
    assert sorted(K.compiled_apart(cells, few=3).select(*columns).collect()) == sorted(K.compiled_apart(cells).select(*columns).collect()) == want


@pytest.mark.parametrize("name", ["lb_labels", "ml_suppression", "ev_rollups"])
def test_nothing_is_kept(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryTableScan" not in plan


@pytest.mark.parametrize("name", ["gr_edges", "gr_precedents", "gr_nodes_empty"])
def test_no_edge_is_shuffled(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)
    assert dealt and not [keys for keys in dealt if re.search(r"\b(row|col|p_row)#", keys)]


def test_blank_precedents_of_names(spark):
    cells = _cells(spark, {(1, c): f"={'ABCDE'[c - 2]}1+rates" for c in (2, 3, 4, 5)}, [(1, 1), (9, 1)])
    named = spark.createDataFrame([("w", "rates", "S!$A$9:$B$9", "workbook")], "workbook string, name string, refers_to string, scope string")
    got = {r.col: r.blanks for r in R._blank_precedents(R.analyze(cells, named)).collect()}
    assert got == {c: ["S!B9"] for c in (2, 3, 4, 5)}
