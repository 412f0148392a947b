"""The four structural rules. Each returns issues: workbook, sheet, row, col, cell, severity, rule_id, explanation, suggested_fix."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from . import blocks as B
from . import cells as K
from . import graph as G

LITERAL, BOUNDARY, BLANK, ANCHORING = "literal-in-formula-block", "range-boundary-mismatch", "reference-to-blank", "inconsistent-anchoring"
SEVERITIES = ("high", "medium")
ISSUE = ["workbook", "sheet", "row", "col", "cell", "severity", "rule_id", "explanation", "suggested_fix"]


@dataclass
class Analysis:
    """What the rules read: compiled cells, blocks, neighbours, and references as rectangles (None where only blocks are needed)."""

    compiled: DataFrame
    blocks: DataFrame
    neighbors: DataFrame
    rectangles: DataFrame | None = None
    unresolved: DataFrame | None = None
    #: Rectangles of the names alone, where any are defined, and the cells that aren't blank, if they are known without compiling.
    names: DataFrame | None = None
    filled: DataFrame | None = None

    def unpersist(self) -> None:
        """Gives back what ``analyze`` keeps, once the results are written."""
        for kept in (self.compiled, self.blocks, self.neighbors):
            kept.unpersist()


def _filled(cells: DataFrame) -> DataFrame:
    return cells.where("formula IS NOT NULL OR value_type IS NOT NULL").select("workbook", "sheet", "row", "col")


def _analysis(cells: DataFrame, compiled: DataFrame, found: DataFrame, beside: DataFrame, named: DataFrame | None) -> Analysis:
    references = G.references_of(compiled)
    names = None if named is None else G.resolved(references.where("ref_kind = 'name'"), named)[0]
    return Analysis(compiled, found, beside, *G.resolved(references, named), names, _filled(cells))


def analyze(cells: DataFrame, named: DataFrame | None = None, min_cells: int = B.MIN_CELLS, near_miss: float = B.NEAR_MISS) -> Analysis:
    """Formulas are parsed once: the compiled cells, the blocks and the neighbours are kept (on disk where memory is short)
    for the rules that read them; what is lost with an executor is computed again. For reports, which read them many times."""
    compiled = K.compiled(cells).persist()
    found = B.blocks(compiled, min_cells).persist()
    return _analysis(cells, compiled, found, B.neighbors(found, near_miss).persist(), named)


def analyze_alike(cells: DataFrame, named: DataFrame | None = None, min_cells: int = B.MIN_CELLS, near_miss: float = B.NEAR_MISS) -> Analysis:
    """For any number of workbooks made alike, and dealt by workbook: nothing is kept, and no cell is shuffled. Rules compute what they read."""
    compiled = K.compiled_apart(cells)
    found = B.blocks(compiled, min_cells)
    return _analysis(cells, compiled, found, B.neighbors(found, near_miss), named)


def _issues(rows: DataFrame, rule: str, explanation: Column, fix: Column) -> DataFrame:
    return rows.select("workbook", "sheet", "row", "col", "cell", "severity", F.lit(rule).alias("rule_id"), explanation.alias("explanation"), fix.alias("suggested_fix"))




def _first(name: str) -> Column:
    return F.col("s")[0][name]


def _second(name: str) -> Column:
    return F.try_element_at("s", F.lit(2))[name]


def _patterns() -> Column:
    return F.array_sort(F.array_distinct(F.transform("s", lambda x: x["pattern"])))


def _joined(name: str) -> Column:
    return F.array_join(F.transform("s", lambda x: x[name]), " and ")


_SIGHTING = "struct<c0:int,span:string,pattern:string,n_display:string,axis:string,end:string,expected:int,found:int,drift:array<struct<axis:string,target:string,expected_style:string,expected:string,found_style:string,found:string>>>"


def _sighted(a: Analysis, rules: frozenset[str]) -> DataFrame:
    """A row per cell beside a block and rule that flags it: rule_id, its sightings from the blocks beside it (``s``, left block first), and the severity.

    The blocks beside a cell are brought together before any formula is compared, in the order of the row, which cells dealt by workbook need no shuffle for.
    """
    w = Window.partitionBy("workbook", "sheet", "row").orderBy("c0")
    rows = a.blocks.select("workbook", "sheet", "row", "c0", "c1", "left", "right", F.struct("c0", F.concat("sheet", F.lit("!"), "span").alias("span"), "pattern").alias("own"))
    rows = rows.withColumns({"next": F.lead("own").over(w), "end": F.lag("c1").over(w)})
    # a cell between two blocks is the one's right and the other's left: it is taken as the former
    between = F.col("end").isNotNull() & (F.col("end") == F.col("c0") - 2)
    b = F.when(F.col("next.c0") == F.col("c1") + 2, F.array("own", "next")).otherwise(F.array("own"))
    left = F.when(~between & F.col("left").isNotNull(), F.struct(F.col("left").alias("n"), F.array("own").alias("b")))
    right = F.when(F.col("right").isNotNull(), F.struct(F.col("right").alias("n"), b.alias("b")))
    rows = rows.select("workbook", "sheet", "row", F.explode(F.array(left, right)).alias("x")).where("x IS NOT NULL").select("workbook", "sheet", "row", F.col("x.n.col").alias("col"), "x.n", "x.b")
    formula = F.col("n.parse_error").isNull() & F.col("n.pattern").isNotNull()
    literal = F.col("n.parse_error").isNull() & F.col("n.pattern").isNull() & ~F.col("n.empty")
    block = lambda k: F.try_element_at("b", F.lit(k + 1))

    def sighting(k: int, **more: Column) -> Column:
        names = ("n_display", "axis", "end", "expected", "found", "drift")
        return F.struct(*(block(k)[n].alias(n) for n in ("c0", "span", "pattern")), *(more.get(n, F.lit(None)).alias(n) for n in names)).cast(_SIGHTING)

    two = lambda make: F.array_compact(F.array(*(F.when(block(k).isNotNull(), make(k)) for k in (0, 1))))
    listed = []
    if LITERAL in rules:
        rows = rows.withColumn("n_display", F.when(literal, C.display(lambda c: F.col(f"n.{c}"))))
        listed.append(F.struct(F.lit(LITERAL).alias("rule_id"), F.when(literal, two(lambda k: sighting(k, n_display=F.col("n_display")))).alias("s")))
    other = F.when(formula, F.col("n.pattern"))
    if BOUNDARY in rules:
        rows = rows.withColumns({f"shift{k}": C.boundary_shift(F.when(formula, block(k)["pattern"]), other) for k in (0, 1)})
        names = ("axis", "end", "expected", "found")
        listed.append(F.struct(F.lit(BOUNDARY).alias("rule_id"), two(lambda k: F.when(F.col(f"shift{k}").isNotNull(), sighting(k, **{n: F.col(f"shift{k}")[n] for n in names}))).alias("s")))
    if ANCHORING in rules:
        rows = rows.withColumns({f"drift{k}": C.anchoring_drift(F.when(formula, block(k)["pattern"]), other, F.col("row"), F.col("col")) for k in (0, 1)})
        listed.append(F.struct(F.lit(ANCHORING).alias("rule_id"), two(lambda k: F.when(F.col(f"drift{k}").isNotNull(), sighting(k, drift=F.col(f"drift{k}")))).alias("s")))
    out = rows.select("workbook", "sheet", "row", "col", F.explode(F.array(*listed)).alias("r")).where("size(r.s) > 0")
    out = out.select("workbook", "sheet", "row", "col", C.qualified(F.col("sheet"), F.col("row"), F.col("col")).alias("cell"), "r.rule_id", "r.s")
    out = out.withColumn("two", F.size("s") == 2).withColumn("same", F.col("two") & (F.col("s")[0]["pattern"] == F.try_element_at("s", F.lit(2))["pattern"]))
    return out.withColumn("severity", F.when(F.col("same"), "high").otherwise("medium"))


def _literal_texts() -> tuple[Column, Column]:
    what = F.concat("cell", F.lit(" holds the hardcoded value "), _first("n_display"))
    text = (
        F.when(F.col("same"), F.concat(what, F.lit(" in the middle of formulas that are otherwise alike: "), _first("span"), F.lit(" and "), _second("span"), F.lit(" both follow "), _first("pattern"), F.lit(".")))
        .when(F.col("two"), F.concat(what, F.lit(" between two blocks of different formulas: "), _first("span"), F.lit(" follows "), _first("pattern"), F.lit(", "), _second("span"), F.lit(" follows "), _second("pattern"), F.lit(".")))
        .otherwise(F.concat(what, F.lit(" right beside the formulas "), _first("span"), F.lit(", which follow "), _first("pattern"), F.lit(".")))
    )
    fix = F.when(F.size(_patterns()) == 1, F.concat(F.lit("If the cell belongs to the block, it should hold a formula of the pattern "), _patterns()[0], F.lit(", read from its own position."))).otherwise(
        F.concat(F.lit("The patterns "), F.array_join(_patterns(), " and "), F.lit(" meet here; check which of them the cell should follow, if any."))
    )
    return text, fix


def _boundary_texts() -> tuple[Column, Column]:
    unit = F.when(_first("axis") == "row", "row").otherwise("column")
    verb = F.when(_first("end") == "start", "starts").otherwise("ends")
    shift = F.concat(verb, F.lit(" one "), unit, F.when(_first("found") < _first("expected"), F.lit(" short")).otherwise(F.lit(" past")))
    text = F.concat("cell", F.lit(" has a range that covers "), _first("found").cast("string"), F.lit(" cells, while the formulas in "), _joined("span"), F.lit(" cover "), _first("expected").cast("string"), F.lit(" cells each: it "), shift, F.lit(" of where theirs do (pattern "), _first("pattern"), F.lit(")."))
    fix = F.when(F.size(_patterns()) == 1, F.concat(F.lit("With the range of its neighbours the cell would follow "), _patterns()[0], F.lit("."))).otherwise(
        F.concat(F.lit("The patterns "), F.array_join(_patterns(), " and "), F.lit(" meet here; check whose range the cell should have."))
    )
    return text, fix


def _anchoring_texts() -> tuple[Column, Column]:
    parts = F.transform(_first("drift"), lambda d: F.concat(F.lit("the "), d["axis"], F.lit(" axis of its reference to "), d["target"], F.lit(" is "), d["found_style"], F.lit(" ("), d["found"], F.lit(") instead of "), d["expected_style"], F.lit(" ("), d["expected"], F.lit(")")))
    text = F.concat("cell", F.lit(": "), F.array_join(parts, "; "), F.lit(", unlike the formulas in "), _joined("span"), F.lit(" (pattern "), _first("pattern"), F.lit(")."))
    wanted = F.array_join(F.array_sort(F.array_distinct(F.transform(_first("drift"), lambda d: d["expected"]))), ", ")
    return text, F.concat(F.lit("The block spells this reference "), wanted, F.lit("; spelled alike, the cell would copy like its neighbours."))


_TEXTS = {LITERAL: _literal_texts, BOUNDARY: _boundary_texts, ANCHORING: _anchoring_texts}


def _beside_blocks(a: Analysis, *rules: str) -> DataFrame:
    """Issues of the rules on cells beside blocks, from one reading of the blocks."""
    texts = {rule: _TEXTS[rule]() for rule in rules}
    chosen = lambda k: F.coalesce(*(F.when(F.col("rule_id") == rule, both[k]) for rule, both in texts.items()))
    found = _sighted(a, frozenset(rules))
    return found.select("workbook", "sheet", "row", "col", "cell", "severity", "rule_id", chosen(0).alias("explanation"), chosen(1).alias("suggested_fix"))


def literal_in_block(a: Analysis) -> DataFrame:
    """A hardcoded value right beside a block; high if both sides have the same pattern."""
    return _beside_blocks(a, LITERAL)


def range_boundary(a: Analysis) -> DataFrame:
    """A formula beside a block whose one range begins or ends one row or column off."""
    return _beside_blocks(a, BOUNDARY)


def inconsistent_anchoring(a: Analysis) -> DataFrame:
    """A formula beside a block that refers to the same cells, but fixes a row or column that the block doesn't, or the reverse."""
    return _beside_blocks(a, ANCHORING)


def _filled_runs(cells: DataFrame) -> DataFrame:
    """workbook, p_sheet, p_row, and the bounds (c0, c1) of each run of cells that aren't blank."""
    w = Window.partitionBy("workbook", "sheet", "row").orderBy("col")
    begins = F.coalesce(F.lag("col").over(w) < F.col("col") - 1, F.lit(True))
    ends = F.coalesce(F.lead("col").over(w) > F.col("col") + 1, F.lit(True))
    rows = cells.withColumns({"begins": begins, "ends": ends}).where("begins OR ends")
    rows = rows.withColumn("c1", F.when(F.col("ends"), F.col("col")).otherwise(F.lead("col").over(w))).where("begins")
    return rows.select("workbook", F.col("sheet").alias("p_sheet"), F.col("row").alias("p_row"), F.col("col").alias("c0"), "c1")


def _uses(a: Analysis) -> DataFrame:
    """A row per block and reference of its formulas: the rows r0 to r1, and the columns that its first (f0, f1) and last cells (l0, l1) refer to."""
    block = ["workbook", "sheet", "row", F.col("c0").alias("b0"), F.col("c1").alias("b1"), "span", "pattern"]
    each = a.blocks.select(*block, F.posexplode(F.arrays_zip(F.col("first_refs").alias("f"), F.col("last_refs").alias("l"))).alias("ord", "u")).where("u.f.kind <> 'name'")
    own = [c if isinstance(c, str) else n for c, n in zip(block, ("workbook", "sheet", "row", "b0", "b1", "span", "pattern"))]
    bounds = {"r0": "u.f.r0", "r1": "u.f.r1", "f0": "u.f.c0", "f1": "u.f.c1", "l0": "u.l.c0", "l1": "u.l.c1"}
    plain = each.select(*own, "ord", F.coalesce("u.f.sheet", "sheet").alias("p_sheet"), *(F.col(c).alias(n) for n, c in bounds.items()))
    if a.names is None:
        return plain
    at = a.names.select("workbook", "sheet", "row", F.col("col").alias("b0"), "ord", "p_sheet", "r0", "r1", "c0", "c1")
    named = a.blocks.select(*block).join(at, ["workbook", "sheet", "row", "b0"])
    return plain.unionByName(named.select(*own, "ord", "p_sheet", "r0", "r1", F.col("c0").alias("f0"), F.col("c1").alias("f1"), F.col("c0").alias("l0"), F.col("c1").alias("l1")))


def _blank_precedents(a: Analysis) -> DataFrame:
    """Per block member that has any: its distinct blank precedents in order of use, and their number.

    What a reference of a block covers in a row, over all members, is an interval. Those of a sheet's row and the runs of its filled cells meet in one window; only
    intervals that no filled cells cover are taken apart by members and cells.
    """
    uses = _uses(a)
    runs = _filled_runs(_filled(a.compiled) if a.filled is None else a.filled)
    lines = uses.select("*", F.explode(F.sequence("r0", "r1")).alias("p_row"))
    use = F.struct(*(c for c in lines.columns if c not in ("workbook", "p_sheet", "p_row")))
    target = ["workbook", "p_sheet", "p_row"]
    kind = lines.select(use.alias("use")).schema["use"].dataType
    met = lines.select(*target, use.alias("use"), F.lit(None).cast("struct<c0:int,c1:int>").alias("run"))
    met = met.unionByName(runs.select(*target, F.lit(None).cast(kind).alias("use"), F.struct("c0", "c1").alias("run")))
    met = met.withColumn("runs", F.collect_list("run").over(Window.partitionBy(*target))).where("use IS NOT NULL").select(*target, "use.*", "runs")
    lo, hi = F.least("f0", "l0"), F.greatest("f1", "l1")
    covered = F.aggregate("runs", F.lit(0), lambda n, r: n + F.greatest(F.lit(0), F.least(r["c1"], hi) - F.greatest(r["c0"], lo) + 1))
    open_ = met.where(covered < hi - lo + 1)
    # an end that is fixed stays, one that is relative moves with the member; where they pass each other, the bounds change sides
    each = open_.withColumn("col", F.explode(F.sequence("b0", "b1"))).withColumn("t", F.col("col") - F.col("b0"))
    crossed = (F.col("f0") != F.col("l0")) & (F.col("f1") != F.col("l1")) & (F.col("l0") - F.col("f0") != F.col("b1") - F.col("b0"))
    moved = lambda f, l: F.when(F.col(f) == F.col(l), F.col(f)).otherwise(F.col(f) + F.col("t"))
    each = each.withColumns({
        "c0": F.when(crossed, F.least("f1", F.col("f0") + F.col("t"))).otherwise(moved("f0", "l0")),
        "c1": F.when(crossed, F.greatest("f1", F.col("f0") + F.col("t"))).otherwise(moved("f1", "l1")),
    })
    each = each.withColumn("p_col", F.explode(F.sequence("c0", "c1"))).where(~F.exists("runs", lambda r: F.col("p_col").between(r["c0"], r["c1"])))
    pos = (F.col("p_row") - F.col("r0")) * (F.col("c1") - F.col("c0") + 1).cast("long") + F.col("p_col") - F.col("c0")
    key = ["workbook", "sheet", "row", "b0", "b1", "span", "pattern", "col"]
    named = C.qualified(F.col("p_sheet"), F.col("p_row"), F.col("p_col"))
    each = each.groupBy(*key, "p_sheet", "p_row", "p_col").agg(F.min(F.struct("ord", pos.alias("pos"))).alias("at"))
    rows = each.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("at", named.alias("name")))).alias("l"))
    return rows.select(*key, F.size("l").cast("long").alias("n_blank"), F.transform("l", lambda x: x["name"]).alias("blanks"))


def reference_to_blank(a: Analysis) -> DataFrame:
    """Members of a block that refer to blank cells while other members don't; high if those others are the majority."""
    if a.rectangles is None:
        raise ValueError(f"{BLANK} needs the dependency graph")
    rows = _blank_precedents(a).withColumn("n_cells", (F.col("b1") - F.col("b0") + 1).cast("long"))
    rows = rows.withColumn("affected", F.count(F.lit(1)).over(Window.partitionBy("workbook", "sheet", "row", "b0")))
    rows = rows.withColumn("clean", F.col("n_cells") - F.col("affected")).where("clean > 0")
    rows = rows.withColumn("cell", C.qualified(F.col("sheet"), F.col("row"), F.col("col")))
    rows = rows.withColumn("severity", F.when(F.col("clean") > F.col("affected"), "high").otherwise("medium"))
    listed = F.array_join("blanks", ", ")
    text = F.concat(
        "cell", F.when(F.col("n_blank") == 1, F.lit(" refers to a blank cell (")).otherwise(F.lit(" refers to blank cells (")), listed, F.lit("), but "), F.col("clean").cast("string"),
        F.when(F.col("clean") == 1, F.lit(" other cell in ")).otherwise(F.lit(" other cells in ")), F.col("sheet"), F.lit("!"), F.col("span"), F.lit(" (pattern "), F.col("pattern"),
        F.lit(") refer to filled ones; only "), F.col("affected").cast("string"), F.lit(" of "), F.col("n_cells").cast("string"), F.lit(" members lack data."),
    )
    return _issues(rows, BLANK, text, F.concat(F.lit("Check whether "), listed, F.lit(" should hold a value: the block's other members find one there.")))


RULES: dict[str, Callable[[Analysis], DataFrame]] = {LITERAL: literal_in_block, BOUNDARY: range_boundary, BLANK: reference_to_blank, ANCHORING: inconsistent_anchoring}


def issues(a: Analysis, rules: dict[str, Callable[[Analysis], DataFrame]] | None = None) -> DataFrame:
    """All issues of the given rules (all four by default). Those on cells beside blocks are found together."""
    chosen = RULES if rules is None else rules
    beside = [name for name in _TEXTS if chosen.get(name) is RULES[name]]
    found = [_beside_blocks(a, *beside)] if beside else []
    return reduce(DataFrame.unionByName, found + [rule(a) for name, rule in chosen.items() if name not in beside])


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "high", 0).when(severity == "medium", 1).otherwise(99)
