"""Registered queries over business tables shaped as workbooks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import blocks as B
from ..operators import cells as K
from ..operators import graph as G
from ..operators import labeling, scoring
from ..operators import rules as R
from ..operators import tiers as T
from ..operators.tables import written
from ..sources import corpus, schema, tabular, xlsx
from . import evaluate
from . import report as P

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _analysis(spark: SparkSession, sf_dir: str) -> R.Analysis:
    return R.analyze_alike(tabular.grid(spark, sf_dir))


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.issues(_analysis(spark, sf_dir))


def _short(issues: DataFrame) -> DataFrame:
    """Issues that are read more than once, written down without their texts."""
    return written(issues.select("workbook", "sheet", "row", "col", "cell", "severity", "rule_id"))


# sources -------------------------------------------------------------------------------------------------


@query
def src_dense_grid(spark, sf_dir):
    """Density rule: cells and blanks per sheet after filling the used range."""
    full = K.dense(tabular.grid(spark, sf_dir))
    blank = F.col("formula").isNull() & F.col("value_type").isNull()
    return full.groupBy("workbook", "sheet").agg(F.count(F.lit(1)).alias("n_cells"), F.count(F.when(blank, 1)).alias("n_blank"))


def _part_formulas(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey") % 6
    size = F.col("p_size").cast("string")
    formula = (
        F.when(k == 0, F.concat(F.lit("=LET(x, "), size, F.lit(", x*2)")))
        .when(k == 1, F.lit("=SUM(Table1[Column1])"))
        .when(k == 2, F.concat(F.lit("=lambda(x,x)("), size, F.lit(")")))
        .when(k == 3, F.concat(F.lit("=A1*"), size))
        .when(k == 4, F.concat(F.lit("=LET(a,T"), size, F.lit("[b],a)")))
        .otherwise(F.concat(F.lit("=Sheet"), size, F.lit("!A1+'My Tab'!B2+Data!C3+Sheet"), size, F.lit('!D4&"x!"')))
    )
    return _read(spark, sf_dir, "part").select(F.col("p_brand").alias("workbook"), F.lit("Data").alias("sheet"), F.col("p_partkey").cast("int").alias("row"), F.lit(1).alias("col"), formula.alias("formula"))


@query
def src_skip_log(spark, sf_dir):
    return K.skip_log(_part_formulas(spark, sf_dir)).select("workbook", "row", "reason")


@query
def src_cross_sheet_refs(spark, sf_dir):
    refs = K.cross_sheet_refs(F.col("formula"), F.col("sheet"))
    return _part_formulas(spark, sf_dir).select("row", F.array_join(refs, ",").alias("refs"))


@query
def src_merged_membership(spark, sf_dir):
    """Customers as cells (row: key, column: nation), nations as merged bands of rows."""
    cells = _read(spark, sf_dir, "customer").select(F.lit("w").alias("workbook"), F.lit("s").alias("sheet"), F.col("c_custkey").cast("int").alias("row"), (F.col("c_nationkey") + 1).alias("col"))
    n = F.col("n_nationkey")
    bands = _read(spark, sf_dir, "nation").select(F.lit("w").alias("workbook"), F.lit("s").alias("sheet"), (n * 40).alias("r0"), n.alias("c0"), (n * 40 + 55).alias("r1"), (n + 3).alias("c1"))
    return K.merged_membership(cells, bands).select("row", "col", "merged")


def _files(spark, sf_dir) -> DataFrame:
    """A workbook file per nation, as bytes: equal stems in the folders of the regions, endings in any case, a merged range, names."""
    k, ending = F.col("n_nationkey"), F.element_at(F.array(*map(F.lit, (".xlsx", ".XLSX", ".xlsm", ".Xlsm"))), (F.col("n_nationkey") % 4 + 1).cast("int"))
    path = F.concat(F.lit("file:/in/"), F.col("n_regionkey").cast("string"), F.lit("/book"), (k % 3).cast("string"), ending)

    def write(batches):
        import io

        import pandas as pd

        for batch in batches:
            out = []
            for name, n in zip(batch["n_name"], batch["n"].tolist()):
                file = io.BytesIO()
                cells = {(1, 1): name, (1, 3): n * 1.5, (2, 2): f'=B1*{n}.50&"x"', (3, 1): n % 2 == 0, (3, 4): "=LET(a,1,a)"}
                xlsx.write_workbook(file, {"Data": cells, "Other tab": {(2, 1): f"=Data!A{n + 1}"}}, merged={"Data": ["A1:B2"]}, names=[(f"rate_{n}", f"Data!$A${n + 1}", None), ("own", "$B$2", "Other tab")])
                out.append(file.getvalue())
            yield pd.DataFrame({"path": batch["path"], "content": out})

    rows = _read(spark, sf_dir, "nation").select(path.alias("path"), "n_name", k.cast("int").alias("n"))
    return rows.mapInPandas(write, "path string, content binary")


@query
def src_workbook_cells(spark, sf_dir):
    """Cells of workbook files, blank ones included."""
    rows = _files(spark, sf_dir).mapInPandas(xlsx.frames("cells", "/in"), schema.CELLS)
    return rows.select("workbook", "sheet", "sheet_idx", "row", "col", "formula", "value_type", "value_num", "value_str", "value_bool", "merged")


@query
def src_named_ranges(spark, sf_dir):
    return _files(spark, sf_dir).mapInPandas(xlsx.frames("named_ranges", "/in"), schema.NAMED_RANGES)


@query
def src_file_skips(spark, sf_dir):
    return _files(spark, sf_dir).mapInPandas(xlsx.frames("skipped", "/in"), schema.SKIPPED)


@query
def src_file_merges(spark, sf_dir):
    return _files(spark, sf_dir).mapInPandas(xlsx.frames("merged", "/in"), schema.MERGED)


# functions -----------------------------------------------------------------------------------------------


@query
def fn_addr_parts(spark, sf_dir):
    mark = lambda p: F.when(F.col("p_partkey") % p == 0, F.lit("$")).otherwise(F.lit(""))
    text = F.concat(mark(2), C.letters(F.col("p_size") * 300), mark(3), F.col("p_partkey").cast("string"))
    rows = _read(spark, sf_dir, "part").select("p_partkey", C.address_parts(text).alias("a"))
    return rows.select("p_partkey", "a.col_abs", F.col("a.col").alias("col_letters"), "a.row_abs", F.col("a.row").alias("row_number"))


@query
def fn_col_letters(spark, sf_dir):
    """Letters and back, over all columns that a sheet can have."""
    n = (F.col("c_custkey") % 16384 + 1).cast("int")
    rows = _read(spark, sf_dir, "customer").select("c_custkey", n.alias("n"))
    return rows.select("c_custkey", C.letters(F.col("n")).alias("letters"), C.index_of(C.letters(F.col("n"))).alias("n"))


@query
def fn_r1c1(spark, sf_dir):
    return K.compiled(tabular.grid(spark, sf_dir)).where("formula IS NOT NULL").select("workbook", "sheet", "row", "col", "formula", "pattern")


@query
def fn_parse_errors(spark, sf_dir):
    """Error kinds of formulas that have no tree."""
    size = F.col("p_size").cast("string")
    k = F.col("p_partkey") % 12
    texts = ["=LET(x,{0},x)", "=SUM(T{0}[c])", "{=A{0}}", "=A:A", "={0}:{0}", "=Sheet1:Sheet3!A{0}", "=A{0}%", "=SUM(A{0},B1", "=A{0}+", "=LOG10(A{0})", "=IF(A{0},,0)", "=A{0}*(1+$B$1)"]
    formula = None
    for i, t in enumerate(texts):
        whole = F.regexp_replace(F.lit(t), r"\{0\}", size)
        formula = F.when(k == i, whole) if formula is None else formula.when(k == i, whole)
    rows = _read(spark, sf_dir, "part").select(F.lit("w").alias("workbook"), F.lit("S").alias("sheet"), F.col("p_partkey").cast("int").alias("row"), F.lit(3).alias("col"), formula.alias("formula"), F.lit(None).cast("string").alias("value_type"))
    return K.compiled(rows).select(F.col("row").alias("p_partkey"), "formula", "error_kind", "pattern")


@query
def fn_literals(spark, sf_dir):
    """How numbers, strings and booleans are spelled in patterns."""
    size, k = F.col("p_size").cast("string"), F.col("p_partkey") % 8
    texts = ["=A1*{0}.50", "=A1*{0}E3", "=A1*0.0{0}", '=A1&"{0}""q"""', '=IF(true,"",FALSE)', "=A1*{0}e-2", "=A1*1234567890123456{0}", "=-A1^+{0}"]
    formula = None
    for i, t in enumerate(texts):
        whole = F.regexp_replace(F.lit(t), r"\{0\}", size)
        formula = F.when(k == i, whole) if formula is None else formula.when(k == i, whole)
    rows = _read(spark, sf_dir, "part").select(F.lit("w").alias("workbook"), F.lit("S").alias("sheet"), F.lit(1).alias("row"), F.lit(2).alias("col"), formula.alias("formula"), F.lit(None).cast("string").alias("value_type"))
    return K.compiled(rows.distinct()).select("formula", "pattern")


@query
def fn_similarity(spark, sf_dir):
    pairs = _read(spark, sf_dir, "part").select("p_brand", "p_type").distinct()
    return pairs.select("p_brand", "p_type", F.round(C.similarity("p_brand", "p_type"), 4).alias("ratio"))


def _shape_patterns(spark, sf_dir) -> DataFrame:
    a, b, c = (F.col("l_linenumber") - 4).cast("string"), (F.col("l_quantity").cast("int") % 5 - 2).cast("string"), (F.col("l_suppkey") % 4 - 2).cast("string")
    k = F.col("l_orderkey") % 4
    lit = F.lit
    text = (
        F.when(k == 0, F.concat(lit("(R["), a, lit("]C[0]-R["), b, lit("]C[0])")))
        .when(k == 1, F.concat(lit("SUM(R["), a, lit("]C["), b, lit("]:R["), c, lit("]C["), a, lit("])")))
        .when(k == 2, F.concat(lit("(R[0]C["), b, lit("]*(1+R"), F.col("l_linenumber").cast("string"), lit("C["), c, lit("]))")))
        .otherwise(F.concat(lit("(R["), a, lit("]C1*2)")))
    )
    return _read(spark, sf_dir, "lineitem").select(text.alias("pattern")).distinct()


@query
def fn_guess_shape(spark, sf_dir):
    return _shape_patterns(spark, sf_dir).select("pattern", C.base_shape(F.col("pattern")).alias("shape"))


@query
def fn_block_signature(spark, sf_dir):
    """SHA-256 of the text that describes a block."""
    a = _analysis(spark, sf_dir)
    seen = labeling.examples(a.blocks, a.neighbors, C.base_shape(F.col("pattern")))
    return seen.select("workbook", "sheet", "span", "base_shape", "signature")


# graph ---------------------------------------------------------------------------------------------------


@query
def gr_edges(spark, sf_dir):
    """Dependents of every cell."""
    found = G.edges(K.compiled_apart(tabular.grid(spark, sf_dir)), deal=False)
    return found.groupBy("workbook", "p_sheet", "p_row", "p_col").agg(F.count(F.lit(1)).alias("n_dependents"))


@query
def gr_precedents(spark, sf_dir):
    """Precedents of every formula, in order of use."""
    found = G.edges(K.compiled_apart(tabular.grid(spark, sf_dir)), deal=False)
    cell = C.address(F.col("p_row"), F.col("p_col"))
    listed = F.sort_array(F.collect_list(F.struct("ord", "pos", cell.alias("cell"))))
    return found.groupBy("workbook", "sheet", "row", "col").agg(F.array_join(F.transform(listed, lambda x: x["cell"]), ",").alias("precedents"))


@query
def gr_nodes_empty(spark, sf_dir):
    compiled = K.compiled_apart(tabular.grid(spark, sf_dir))
    found = G.nodes(compiled, G.edges(compiled, deal=False))
    return found.groupBy("workbook", "sheet").agg(F.count(F.lit(1)).alias("n_nodes"), F.count(F.when(F.col("empty"), 1)).alias("n_empty"), F.count("parse_error").alias("n_errors"))


@query
def gr_named_ranges(spark, sf_dir):
    """Suppliers' formulas name their nation; some nations have a sheet's own name, some none, some a bad target."""
    key = F.col("n_nationkey")
    name = F.concat(F.lit("Nation_"), key.cast("string"))
    nation = _read(spark, sf_dir, "nation").select(key, name.alias("name"), F.lit("w").alias("workbook"))
    wide = nation.where(key % 7 != 3).select("workbook", "name", F.when(key % 6 == 5, F.lit("1+1")).otherwise(F.concat(F.lit("Data!$B$"), (key + 1).cast("string"), F.lit(":$C$"), (key + 2).cast("string"))).alias("refers_to"), F.lit("workbook").alias("scope"))
    own = nation.where(key % 5 == 0).select("workbook", "name", F.concat(F.lit("$D$"), (key + 1).cast("string")).alias("refers_to"), F.lit("Model").alias("scope"))
    formula = F.concat(F.when(F.col("s_suppkey") % 3 == 0, F.lit("=Model!")).otherwise(F.lit("=")), F.lit("Nation_"), F.col("s_nationkey").cast("string"), F.lit("*2"))
    sheet = F.when(F.col("s_suppkey") % 2 == 0, "Model").otherwise("Other")
    cells = _read(spark, sf_dir, "supplier").select(F.lit("w").alias("workbook"), sheet.alias("sheet"), F.col("s_suppkey").cast("int").alias("row"), F.lit(1).alias("col"), formula.alias("formula"), F.lit(None).cast("string").alias("value_type"))
    good, bad = G.resolved(G.references_of(K.compiled(cells)), wide.unionByName(own))
    target = F.concat("p_sheet", F.lit("!"), C.address(F.col("r0"), F.col("c0")), F.lit(":"), C.address(F.col("r1"), F.col("c1")))
    return good.select("row", target.alias("target")).unionByName(bad.select("row", F.col("problem").alias("target")))


def _formula_cells(rows: DataFrame) -> DataFrame:
    return K.compiled(rows.select(F.lit("w").alias("workbook"), F.lit("T").alias("sheet"), F.col("r").cast("int").alias("row"), F.lit(1).alias("col"), F.col("f").alias("formula"), F.lit(None).cast("string").alias("value_type")))


@query
def gr_topo_levels(spark, sf_dir):
    """Suppliers as a binary tree: cell k refers to cell k div 2."""
    k = F.col("s_suppkey").cast("int")
    rows = _read(spark, sf_dir, "supplier").where(k >= 1).select(k.alias("r"), F.when(k > 1, F.concat(F.lit("=A"), F.floor(k / 2).cast("string"), F.lit("+1"))).alias("f"))
    return G.levels(G.edges(_formula_cells(rows))).select("cell", "level")


@query
def gr_cycles(spark, sf_dir):
    """Nations on a map n -> 7 n + 3 mod 25: every cycle from its least cell."""
    k = F.col("n_nationkey").cast("int")
    rows = _read(spark, sf_dir, "nation").select((k + 10).alias("r"), F.concat(F.lit("=A"), ((k * 7 + 3) % 25 + 10).cast("string")).alias("f"))
    return G.cycles(G.edges(_formula_cells(rows))).select(F.array_join("cells", ">").alias("cycle"))


@query
def gr_wide_ranges(spark, sf_dir):
    """Edges of running totals, and of one range of 1.3 million cells."""
    k = F.col("n_nationkey").cast("int")
    total = F.concat(F.lit("=SUM($D$1:D"), (k + 1).cast("string"), F.lit(")"))
    rows = _read(spark, sf_dir, "nation").select((k + 10).alias("r"), F.when(k == 0, F.lit("=SUM(Wide!A1:Z50000)")).otherwise(total).alias("f"))
    found = G.edges(_formula_cells(rows)).groupBy("row", "p_sheet")
    return found.agg(F.count(F.lit(1)).alias("n"), F.sum("p_row").alias("rows"), F.sum("p_col").alias("cols"), F.max("pos").alias("last"))


# blocks --------------------------------------------------------------------------------------------------


@query
def bk_runs(spark, sf_dir):
    """Run lengths of equal patterns, by pattern."""
    numbered = B.runs(K.compiled(tabular.grid(spark, sf_dir))).where("run IS NOT NULL")
    each = numbered.groupBy(*B.ROW, "run", "pattern").agg(F.count(F.lit(1)).alias("length"))
    return each.groupBy("pattern", "length").agg(F.count(F.lit(1)).alias("n_runs"))


@query
def bk_blocks(spark, sf_dir):
    return _analysis(spark, sf_dir).blocks.select("workbook", "sheet", "sheet_idx", "row", "span", "pattern", "n_cells", "row_label")


@query
def bk_neighbors(spark, sf_dir):
    return _analysis(spark, sf_dir).neighbors.select("workbook", "cell", "span", "side", "kind", F.round("similarity", 4).alias("similarity"))


@query
def bk_labels(spark, sf_dir):
    grid = tabular.grid(spark, sf_dir)
    found = B.blocks(K.compiled(grid))
    labelled = B.column_labels(found, grid)
    return labelled.select("workbook", "sheet", "span", F.array_join("col_labels", ",", "-").alias("col_labels"))


# rules ---------------------------------------------------------------------------------------------------

_BRIEF = ["workbook", "cell", "severity"]


@query
def rl_literal(spark, sf_dir):
    return R.literal_in_block(_analysis(spark, sf_dir)).select(*_BRIEF, "explanation")


@query
def rl_range_boundary(spark, sf_dir):
    return R.range_boundary(_analysis(spark, sf_dir)).select(*_BRIEF, "explanation")


@query
def rl_reference_to_blank(spark, sf_dir):
    return R.reference_to_blank(_analysis(spark, sf_dir)).select(*_BRIEF, "explanation")


@query
def rl_anchoring(spark, sf_dir):
    return R.inconsistent_anchoring(_analysis(spark, sf_dir)).select(*_BRIEF, "explanation")


@query
def rl_all_issues(spark, sf_dir):
    return _issues(spark, sf_dir).select(*_BRIEF, "rule_id")


@query
def rk_ranked_issues(spark, sf_dir):
    return P.ranked(_issues(spark, sf_dir), "Tier 0").select("workbook", "rank", "cell", "severity", "rule_id")


@query
def ag_heatmap(spark, sf_dir):
    found = P.heatmap(P.ranked(_issues(spark, sf_dir), "Tier 0"))
    return found.select("workbook", "cell", "severity", "issue_count", F.array_join("rule_ids", ",").alias("rule_ids"))


@query
def ag_heatmap_bbox(spark, sf_dir):
    return P.heatmap_bounds(P.ranked(_issues(spark, sf_dir), "Tier 0"))


@query
def ag_counts(spark, sf_dir):
    found = _issues(spark, sf_dir)
    return found.groupBy("workbook", "severity", "rule_id").agg(F.count(F.lit(1)).alias("n"))


# scoring -------------------------------------------------------------------------------------------------


def _scored(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    issues, truth = _issues(spark, sf_dir), tabular.truth(spark, sf_dir)
    return issues, truth, scoring.outcomes(issues, truth)


@query
def ev_outcomes(spark, sf_dir):
    return _scored(spark, sf_dir)[2].select("workbook", "cell", "rule_id", "outcome")


@query
def ev_slices(spark, sf_dir):
    return scoring.slices(_scored(spark, sf_dir)[2])


@query
def ev_false_negatives(spark, sf_dir):
    issues, truth, _ = _scored(spark, sf_dir)
    return scoring.false_negatives(issues, truth)


def _rollups(spark, sf_dir) -> DataFrame:
    issues, truth = _short(_issues(spark, sf_dir)), tabular.truth(spark, sf_dir)
    scored = scoring.outcomes(issues, truth)
    return scoring.rollups(scoring.slices(scored), scoring.false_negatives(issues, truth), scoring.precision_at_k(scored))


@query
def ev_rollups(spark, sf_dir):
    return _rollups(spark, sf_dir)


@query
def ev_precision_at_10(spark, sf_dir):
    return scoring.precision_at_k(_scored(spark, sf_dir)[2])


@query
def ev_micro_average(spark, sf_dir):
    return scoring.micro_average(_rollups(spark, sf_dir))


@query
def ev_clean_baseline(spark, sf_dir):
    _, truth, scored = _scored(spark, sf_dir)
    return scoring.clean_baseline(scored, truth)


@query
def gn_corpus(spark, sf_dir):
    """The generated corpus: truth by state."""
    _, truth = corpus.tables(spark)
    return truth.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("entry").alias("entries"))


@query
def ev_corpus(spark, sf_dir):
    """The rules over the generated corpus, scored against its truth."""
    return evaluate.evaluate(*corpus.tables(spark)).rollups.select("rule_id", "tp", "fp", "fn", "known", "ambiguous")


@query
def ev_corpus_baseline(spark, sf_dir):
    return evaluate.evaluate(*corpus.tables(spark)).baseline


# labels --------------------------------------------------------------------------------------------------


@query
def lb_corpus(spark, sf_dir):
    """Labels of the generated corpus's blocks."""
    return evaluate.labelled_blocks(*corpus.tables(spark)).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def _labelled(spark, sf_dir) -> tuple[R.Analysis, DataFrame, DataFrame]:
    a = _analysis(spark, sf_dir)
    issues = _short(R.issues(a))
    return a, labeling.labels(a.blocks, None, tabular.truth(spark, sf_dir), issues), issues


@query
def lb_labels(spark, sf_dir):
    return _labelled(spark, sf_dir)[1].select("workbook", "sheet", "span", "label", "basis")


@query
def lb_readiness(spark, sf_dir):
    """Readiness with customers dealt by key: 0-6 train, 7 val, 8-9 test."""
    found = _labelled(spark, sf_dir)[1]
    k = F.col("c_custkey") % 10
    parts = _read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("workbook"), F.when(k < 7, "train").when(k == 7, "val").otherwise("test").alias("part"))
    return labeling.readiness(found, parts)


@query
def lb_split(spark, sf_dir):
    """The seeded split of the nations' names."""
    names = [r[0] for r in _read(spark, sf_dir, "nation").select("n_name").distinct().collect()]
    return labeling.split_table(spark, labeling.split_entries(names))


@query
def ml_suppression(spark, sf_dir):
    """Issues that stay when blocks whose label is intentional_override count as predicted so."""
    _, found, issues = _labelled(spark, sf_dir)
    predicted = found.withColumn("predicted", F.coalesce("label", F.lit("unknown")))
    stays, gone = T.split_issues(issues, written(T.suppressed_issue_cells(issues, predicted)))
    mark = lambda df, v: df.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n")).withColumn("suppressed", F.lit(v))
    return mark(stays, False).unionByName(mark(gone, True))


def _judged(spark, sf_dir) -> DataFrame:
    """Labels of documents against a rule on their length, as block labels."""
    name = lambda c: F.when(c == 1, "suspected_error").otherwise("subtotal")
    rows = _read(spark, sf_dir, "labels").join(_read(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return rows.select(name(F.col("quality")).alias("label"), name((F.col("n_chars") > 500).cast("int")).alias("predicted"))


@query
def ml_confusion(spark, sf_dir):
    return T.confusion(_judged(spark, sf_dir))


@query
def ml_label_metrics(spark, sf_dir):
    return T.label_metrics(_judged(spark, sf_dir))


@query
def ml_class_weights(spark, sf_dir):
    return T.class_weights(_judged(spark, sf_dir))
