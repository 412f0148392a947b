"""The synthetic corpus and the fixture workbooks, end to end."""

import json

import pytest
from pyspark.sql import functions as F

from gridloom.operators import graph as G
from gridloom.operators import labeling
from gridloom.operators import rules as R
from gridloom.operators import tiers as T
from gridloom.plans import evaluate as E
from gridloom.plans import report as P
from gridloom.sources import corpus, xlsx


@pytest.fixture(scope="module")
def tables(spark):
    cells, truth = corpus.tables(spark)
    return cells.cache(), truth.cache()


@pytest.fixture(scope="module")
def books(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("fixtures"))
    corpus.write_fixtures(folder)
    names = xlsx.read_workbooks(spark, folder, "named_ranges").cache()
    cells = xlsx.read_workbooks(spark, folder).cache()
    return folder, cells, names, R.analyze(cells, names)


def test_size():
    assert len(list(corpus.entries())) == 144


def test_rollups(tables):
    found = E.evaluate(*tables)
    got = {r.rule_id: (r.tp, r.fp, r.fn, r.known, r.ambiguous) for r in found.rollups.collect()}
    assert got == {R.LITERAL: (21, 0, 0, 22, 4), R.BOUNDARY: (10, 0, 0, 0, 0), R.BLANK: (20, 0, 0, 0, 39), R.ANCHORING: (10, 0, 0, 0, 2)}
    assert tuple(found.baseline.first()) == (94, 52, 0)
    assert found.rollups.where(F.col("rule_id") == R.LITERAL).select("p_at_k", "k").first() == (1.0, 10)
    assert E.CAVEAT in E.text_table(found.rollups, ["rule_id"])
    with pytest.raises(ValueError):
        E.evaluate(*tables, names=[])


def test_labels_and_training(tables, tmp_path):
    rows = E.labelled_blocks(*tables).cache()
    counts = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    assert counts == {"subtotal": 60, "intentional_override": 5, "suspected_error": 67, "unknown": 20, None: 10}
    assert rows.where("label IS NOT NULL").select("pattern").distinct().count() == 8
    parts = labeling.split_entries(labeling.labelled_entries(rows))
    assert [len(parts[p]) for p in ("train", "val", "test")] == [94, 20, 21]
    ready = {r.label: r.ready for r in labeling.readiness(rows, labeling.split_table(rows.sparkSession, parts)).collect()}
    assert ready == {"subtotal": True, "suspected_error": True, "unknown": False, "intentional_override": False}
    trained = E.train_classifier(*tables, folder=str(tmp_path))
    assert trained.accuracy > 0.7
    model, split, report = T.load(str(tmp_path))
    assert split == trained.parts and {m["label"] for m in report["labels"]} == set(labeling.LABELS)
    assert "thin" in T.confidence_caveat(report)
    a = R.analyze(tables[0])
    kept, gone = T.review(R.issues(a), a, model)
    assert kept.count() + gone.count() == 128
    table = E.ablation(*tables, samples=0).collect()
    assert [(r.status, r.cost) for r in table] == [("measured", "$0"), ("not_yet_available", "$0"), ("not_yet_available", "$0")]
    assert table[0].precision == table[0].recall == table[0].precision_at_10 == 1.0
    with pytest.raises(ValueError):
        E.ablation(*tables, call=lambda t: "unknown")


def test_fixture_issues(books):
    _, _, _, a = books
    got = {(r.workbook, r.cell, r.severity, r.rule_id) for r in R.issues(a).collect()}
    assert {x for x in got if x[0] == "revenue_row_with_hardcode"} == {("revenue_row_with_hardcode", "Model!H14", "high", R.LITERAL), ("revenue_row_with_hardcode", "Model!B14", "medium", R.LITERAL)}
    assert ("range_boundary_mismatch", "Rolling!H5", "high", R.BOUNDARY) in got
    assert {x[1] for x in got if x[3] == R.BLANK} == {"Rolling!F5", "Rolling!G5", "Rolling!H5"}
    assert {(x[0], x[1], x[2]) for x in got if x[3] == R.ANCHORING} == {("inconsistent_anchoring", "Model!H14", "high")}
    text = {(r.cell, r.rule_id): r for r in R.issues(a).where("severity = 'high'").collect()}
    for part in ("4,500,000", "Model!C14:G14", "Model!I14:M14", "(R[0]C[-1]*(1+R[1]C[-1]))"):
        assert part in text["Model!H14", R.LITERAL].explanation
    for part in ("covers 2 cells", "cover 3 cells each", "D5:G5", "I5:M5", "starts one column short"):
        assert part in text["Rolling!H5", R.BOUNDARY].explanation
    for part in ("Rolling!F4", "7 other cells", "3 of 10 members"):
        assert part in text["Rolling!G5", R.BLANK].explanation
    assert "the col axis of its reference to B1 is relative (B$1) instead of absolute ($B$1)" in text["Model!H14", R.ANCHORING].explanation
    assert not any(r.suggested_fix.startswith("=") for r in text.values())
    with pytest.raises(ValueError):
        R.reference_to_blank(R.Analysis(a.compiled, a.blocks, a.neighbors))


def test_workbook_tables(spark, books):
    folder, cells, names, a = books
    merged = {r.col: r.merged for r in cells.where("workbook = 'merged_cells' AND row = 1").collect()}
    assert merged == {1: True, 2: True, 3: True, 4: True}
    skipped = {(r.row, r.reason) for r in xlsx.read_workbooks(spark, folder, "skipped").collect()}
    assert skipped == {(1, "array formula"), (2, "LET or LAMBDA"), (3, "structured reference")}
    assert {tuple(r) for r in names.select("name", "refers_to", "scope").collect()} == {("TaxRate", "Assumptions!$B$1", "workbook"), ("LocalNet", "Model!$B$3", "Model")}
    spark.dataSource.register(xlsx.WorkbookSource)
    assert spark.read.format("workbook").load(folder).count() == cells.count()
    with pytest.raises(ValueError, match=".csv"):
        xlsx.read_workbooks(spark, "book.csv")


def test_graph(books):
    _, _, _, a = books
    edges = G.expand(a.rectangles).distinct().cache()
    before = lambda book, sheet, row, col: {r.cell for r in G.precedents(edges, book, sheet, row, col).collect()}
    assert before("clean_model", "Model", 2, 3) == {"Model!B2"}
    assert before("named_range_cross_sheet", "Model", 2, 2) == {"Model!B1", "Assumptions!B1"}
    assert len(before("skip_cases", "Edge Cases", 1, 2)) == 6
    circle = edges.where("workbook = 'circular_reference'")
    assert [sorted(r.cells) for r in G.cycles(circle).collect()] == [["Circular!A1", "Circular!B1"]]
    with pytest.raises(G.CyclicDependencyError):
        G.topological_order(edges, "circular_reference")
    order = G.topological_order(edges, "clean_model")
    assert order.index("Model!B2") < order.index("Model!C2") < order.index("Model!E2")
    nodes = {(r.row, r.col): r for r in G.nodes(a.compiled, edges).where("workbook = 'blank_reference'").collect()}
    assert nodes[1, 3].empty and not nodes[1, 1].empty
    errors = G.nodes(a.compiled, edges).where("workbook = 'skip_cases' AND parse_error IS NOT NULL").count()
    assert errors == 2


def test_report(books):
    _, _, _, a = books
    found = P.build(a, "revenue_row_with_hardcode")
    assert [(i["rank"], i["cell"]) for i in found.issues] == [(1, "Model!H14"), (2, "Model!B14")]
    assert json.loads(found.to_json())["severity_counts"] == {"high": 1, "medium": 1}
    page = P.render_html(found)
    assert 'id="issue-Model-H14"' in page and "#issue-Model-H14" in page and page.count("structural checks alone") == 2 and "Suppressed" not in page
    found.issues[0]["explanation"] = "<script>alert(1)</script>"
    assert "<script>alert" not in P.render_html(found)
    assert "No issues found." in P.render_html(P.build(a, "merged_cells"))
    with pytest.raises(ValueError):
        P.build(a, "clean_model", call=lambda t: "unknown")


def test_tier_two(books):
    _, _, _, a = books
    asked = []

    def call(text):
        return "intentional_override" if "Revenue" in text or "C14:G14" in text else "unknown"

    kept, gone = T.review_by_call(R.issues(a).where("workbook = 'revenue_row_with_hardcode'"), a, call)
    assert {r.cell for r in gone.collect()} == {"Model!H14", "Model!B14"} and kept.count() == 0
    reply = {"message": {"content": '{"label": "subtotal"}'}}
    assert T.ask("text", post=lambda body: asked.append(body) or reply) == "subtotal" and asked[0]["stream"] is False
    with pytest.raises(ValueError):
        T.parse_reply('{"label": "other"}')
    T.check_available("m", get=lambda url: {"models": [{"name": "m:latest"}]})
    with pytest.raises(RuntimeError, match="doesn't have"):
        T.check_available("m:1", get=lambda url: {"models": [{"name": "m:2"}]})


def test_files_round_trip(spark, tmp_path):
    few = [e for e in corpus.entries() if e.name in ("clean__variance__n4", "literal_in_block__interior__n7")]
    corpus.write(str(tmp_path), few)
    got = E.evaluate(xlsx.read_workbooks(spark, str(tmp_path)), corpus.read_truth(spark, str(tmp_path)))
    assert {(r.rule_id, r.tp, r.known) for r in got.rollups.where("tp > 0").collect()} == {(R.LITERAL, 1, 1)}


def test_command_line(tmp_path, capsys, spark):
    from gridloom import cli

    corpus.write_fixtures(str(tmp_path))
    assert cli.main(["dump", str(tmp_path / "merged_cells.xlsx")]) == 0
    assert json.loads(capsys.readouterr().out)["workbook"] == "merged_cells"
    out = tmp_path / "r.json"
    assert cli.main(["report", str(tmp_path / "revenue_row_with_hardcode.xlsx"), "--json", str(out)]) == 0
    assert len(json.loads(out.read_text())["issues"]) == 2
    with pytest.raises(ValueError):
        cli.main(["dump", "x.csv"])


def test_stream(spark, tmp_path):
    from gridloom import streaming

    corpus.write_fixtures(str(tmp_path / "in"))
    run = streaming.stream_issues(streaming.stream_files(spark, str(tmp_path / "in")), str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"))
    run.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).where("severity = 'high'").count() == 6


def test_workbook_names():
    names = ["/in/a.xlsx", "/in/a.XLSX", "/in/a.xlsm", "/in/a.Xlsx", "/in/x/a.xlsx", "/in/a.xlsm.xlsx", "/else/a.xlsx", "file:///in/my%20book.xlsx"]
    assert [xlsx.workbook_name(n, "file:/in") for n in names] == ["a", "a.XLSX", "a.xlsm", "a.Xlsx", "x/a", "a.xlsm.xlsx", "/else/a", "my book"]
    assert xlsx.workbook_name("file:/in/a.xlsx") == xlsx.workbook_name("/in/a.xlsx", "/in/a.xlsx") == "a"


def test_files_of_one_stem(spark, tmp_path):
    for name in ("a.xlsx", "a.xlsm", "b.Xlsx"):
        xlsx.write_workbook(str(tmp_path / name), {"S": {(1, 1): name}})
    want = {("a", "a.xlsx"), ("a.xlsm", "a.xlsm"), ("b.Xlsx", "b.Xlsx")}
    assert {(r.workbook, r.value_str) for r in xlsx.read_workbooks(spark, str(tmp_path)).collect()} == want
    spark.dataSource.register(xlsx.WorkbookSource)
    assert {(r.workbook, r.value_str) for r in spark.read.format("workbook").load(str(tmp_path)).collect()} == want


def test_levels_and_cycles_by_rounds(spark):
    """A chain of 300, random graphs with cycles, and what lies behind and before them: rounds of joins and one task agree with plain code."""
    import random

    rnd = random.Random(3)
    edges = {("chain", k, k + 1) for k in range(1, 300)}
    for w in range(4):
        edges |= {(f"w{w}", a, b) for a in range(1, 30) for b in rnd.sample(range(a + 1, 34), rnd.randint(0, 3))}
        edges |= {(f"w{w}", rnd.randint(20, 30), rnd.randint(10, 24)) for _ in range(2 * w)}
    edges.add(("self", 5, 5))
    rows = [(w, "S", a, 1, "S", b, 1) for w, a, b in edges]
    found = spark.createDataFrame(rows, "workbook string, p_sheet string, p_row int, p_col int, sheet string, row int, col int")
    one, many = ({(r.workbook, r.cell): r.level for r in G.levels(found, n).collect()} for n in (G.LARGE, 0))
    assert one == many and one["chain", "S!A300"] == 299 and one["self", "S!A5"] is None
    got = {(r.workbook, frozenset(r.cells)) for r in G.cycles(found).collect()}
    after = {}
    for w, a, b in edges:
        after.setdefault((w, a), []).append(b)
    want = set()

    def walk(w, path):
        for b in after.get((w, path[-1]), ()):
            if b == path[0]:
                want.add((w, frozenset(f"S!A{k}" for k in path)))
            elif b > path[0] and b not in path:
                walk(w, [*path, b])

    for w, a, _ in edges:
        if w != "chain":
            walk(w, [a])
    assert got == want and len(want) >= 3
