"""Ranked report of workbooks: tables, JSON and HTML."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import datetime, timezone
from html import escape

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formula import column_letters
from ..operators import rules as R
from ..operators import tiers as T

CAVEAT = (
    "These findings come from structural checks alone: formulas are compared with their neighbours, and nothing judges what they mean. "
    "A legitimate subtotal or a deliberate override can look like an error. Look at every flagged cell before you trust or dismiss it."
)
CAVEAT_TIER1 = (
    "A trained classifier reviewed the findings; those that it took for subtotals or deliberate overrides are listed separately as suppressed. "
    "It saw base shapes that were guessed from the formulas; distrust it where a shape is unrecognized."
)
CAVEAT_TIER2 = "A local language model reviewed what the classifier had left, without training for this task; distrust its suppressions even more."


def ranked(issues: DataFrame, tier: str) -> DataFrame:
    """rank per workbook by (severity, rule, cell in code-point order), and the tier's name."""
    w = Window.partitionBy("workbook").orderBy(R.severity_rank(F.col("severity")), "rule_id", "cell")
    return issues.withColumn("rank", F.row_number().over(w)).withColumn("tier", F.lit(tier))


def heatmap(ranked_issues: DataFrame) -> DataFrame:
    """Per flagged cell: worst severity, issue_count, rule_ids in rank order."""
    ids = F.transform(F.sort_array(F.collect_list(F.struct("rank", "rule_id"))), lambda x: x["rule_id"])
    worst = F.min(F.struct(R.severity_rank(F.col("severity")).alias("r"), "severity"))
    return ranked_issues.groupBy("workbook", "sheet", "row", "col", "cell").agg(worst["severity"].alias("severity"), F.count(F.lit(1)).alias("issue_count"), ids.alias("rule_ids"))


def heatmap_bounds(ranked_issues: DataFrame) -> DataFrame:
    return ranked_issues.groupBy("workbook", "sheet").agg(F.min("row").alias("row0"), F.max("row").alias("row1"), F.min("col").alias("col0"), F.max("col").alias("col1"))


def counts(ranked_issues: DataFrame, by: str) -> DataFrame:
    return ranked_issues.groupBy("workbook", by).agg(F.count(F.lit(1)).alias("n"))


@dataclass
class Report:
    workbook: str
    generated_at: str
    issues: list[dict]
    suppressed_issues: list[dict]
    heatmaps: list[dict]
    severity_counts: dict[str, int]
    rule_id_counts: dict[str, int]
    caveat: str = CAVEAT
    unresolved_names: list[dict] = field(default_factory=list)

    def to_json(self) -> str:
        return json.dumps(self.__dict__, indent=1, ensure_ascii=False, default=str)


def build(analysis: R.Analysis, workbook: str, model=None, call=None, chosen=None) -> Report:
    """The report of one workbook. ``model``: tier 1; ``call``: tier 2, only on top of tier 1."""
    if call is not None and model is None:
        raise ValueError("tier 2 reviews what tier 1 leaves: it needs tier 1")
    own = lambda df: df.where(F.col("workbook") == workbook)
    a = R.Analysis(own(analysis.compiled), own(analysis.blocks), own(analysis.neighbors), own(analysis.rectangles), own(analysis.unresolved), None if analysis.names is None else own(analysis.names), None if analysis.filled is None else own(analysis.filled))
    issues, tier, caveat, cut = R.issues(a, chosen), "Tier 0", [CAVEAT], []
    if model is not None:
        try:
            issues, gone = T.review(issues, a, model)
        except Exception as e:
            raise RuntimeError(f"tier 1 failed: {e}") from e
        cut.append(ranked(gone, "Tier 0 (suppressed by Tier 1)"))
        tier, caveat = "Tier 0 (Tier 1-reviewed)", [CAVEAT_TIER1]
    if call is not None:
        issues, gone = T.review_by_call(issues, a, call)
        cut.append(ranked(gone, "Tier 0 (suppressed by Tier 2)"))
        tier = "Tier 0 (Tier 1+2-reviewed)"
        caveat.append(CAVEAT_TIER2)
    kept = ranked(issues, tier).cache()
    fields = ["rank", "sheet", "row", "col", "cell", "severity", "rule_id", "tier", "explanation", "suggested_fix"]
    listed = lambda df: [r.asDict() for r in df.select(*fields).orderBy("rank").collect()]
    cells = [r.asDict() for r in heatmap(kept).orderBy("sheet", "row", "col").collect()]
    maps = [r.asDict() | {"cells": [c for c in cells if c["sheet"] == r.sheet]} for r in heatmap_bounds(kept).orderBy("sheet").collect()]
    number = lambda by: {r[by]: r.n for r in counts(kept, by).orderBy(by).collect()}
    report = Report(
        workbook, datetime.now(timezone.utc).isoformat(timespec="seconds"), listed(kept), [x for df in cut for x in listed(df)], maps,
        number("severity"), number("rule_id"), " ".join(caveat), [r.asDict() for r in a.unresolved.collect()],
    )
    kept.unpersist()
    return report


_STYLE = "body{font:14px sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #bbb;padding:3px 7px;text-align:left}.high{background:#f4b6b6}.medium{background:#f8e3a3}.note{background:#eee;padding:.7em}"
_SCRIPT = "for(const b of document.querySelectorAll('input[data-s]'))b.onchange=()=>{for(const r of document.querySelectorAll('tr.issue.'+b.dataset.s))r.hidden=!b.checked}"


def _rows(issues: list[dict], anchors: bool) -> str:
    out = []
    for i in issues:
        name = f' id="issue-{escape(i["sheet"], True)}-{column_letters(i["col"])}{i["row"]}"' if anchors else ""
        cells = "".join(f"<td>{escape(str(i[k]))}</td>" for k in ("rank", "cell", "severity", "rule_id", "tier", "explanation", "suggested_fix"))
        out.append(f'<tr class="issue {escape(i["severity"], True)}"{name}>{cells}</tr>')
    return "<tr><th>Rank</th><th>Cell</th><th>Severity</th><th>Rule</th><th>Tier</th><th>Explanation</th><th>Suggested fix</th></tr>" + "".join(out)


def render_html(report: Report) -> str:
    """One page without outside assets; all text is escaped."""
    note = f'<p class="note">{escape(report.caveat)}</p>'
    parts = [f"<h1>{escape(report.workbook)}</h1><p>{escape(report.generated_at)}</p>{note}"]
    parts.append("<p>" + ", ".join(f"{escape(k)}: {n}" for k, n in {**report.severity_counts, **report.rule_id_counts}.items()) + "</p>")
    parts.append(" ".join(f'<label><input type="checkbox" data-s="{s}" checked>{s}</label>' for s in R.SEVERITIES))
    for m in report.heatmaps:
        flagged = {(c["row"], c["col"]): c for c in m["cells"]}
        body = []
        for row in range(m["row0"], m["row1"] + 1):
            line = [f"<th>{row}</th>"]
            for col in range(m["col0"], m["col1"] + 1):
                c, ref = flagged.get((row, col)), f"{column_letters(col)}{row}"
                line.append(f'<td class="{c["severity"]}"><a href="#issue-{escape(m["sheet"], True)}-{ref}">{ref}</a> {c["issue_count"]}</td>' if c else "<td></td>")
            body.append(f"<tr>{''.join(line)}</tr>")
        parts.append(f"<h2>{escape(m['sheet'])}</h2><table>{''.join(body)}</table>")
    parts.append(f"<h2>Issues</h2><table>{_rows(report.issues, True)}</table>" if report.issues else "<p>No issues found.</p>")
    if report.suppressed_issues:
        parts.append(f"<h2>Suppressed</h2><table>{_rows(report.suppressed_issues, False)}</table>")
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{escape(report.workbook)}</title><style>{_STYLE}</style></head><body>{''.join(parts)}{note}<script>{_SCRIPT}</script></body></html>"
