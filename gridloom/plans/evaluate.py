"""Evaluation over a corpus, training of tier 1, and the ablation table."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from statistics import median

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import labeling, scoring
from ..operators import rules as R
from ..operators import tiers as T

CAVEAT = (
    "The corpus and the rules come from the same hands: these numbers show that they agree with each other, "
    "not how often the rules are right on workbooks that people made."
)


@dataclass
class Evaluation:
    slices: DataFrame
    rollups: DataFrame
    baseline: DataFrame
    scored: DataFrame
    issues: DataFrame


def evaluate(cells: DataFrame, truth: DataFrame, rules=None, names: list[str] | None = None, review: Callable | None = None) -> Evaluation:
    """Score the issues of all entries in one job. ``review(issues, analysis)`` returns the surviving issues."""
    if names is not None:
        if not names:
            raise ValueError("no entries were asked for")
        cells, truth = cells.where(F.col("workbook").isin(names)), truth.where(F.col("entry").isin(names))
    a = R.analyze(cells)
    issues = R.issues(a, rules)
    if review is not None:
        issues = review(issues, a)
    issues = issues.cache()
    scored = scoring.outcomes(issues, truth).cache()
    sliced = scoring.slices(scored, tuple(R.RULES if rules is None else rules))
    rolled = scoring.rollups(sliced, scoring.false_negatives(issues, truth), scoring.precision_at_k(scored))
    return Evaluation(sliced, rolled, scoring.clean_baseline(scored, truth), scored, issues)


def labelled_blocks(cells: DataFrame, truth: DataFrame) -> DataFrame:
    """Examples with labels, from ground truth."""
    a = R.analyze(cells)
    shapes = truth.select(F.col("entry").alias("workbook"), F.col("base_shape").alias("true_shape")).distinct()
    seen = labeling.examples(a.blocks.join(shapes, "workbook", "left"), a.neighbors, F.col("true_shape"))
    return seen.join(labeling.labels(a.blocks, a.neighbors, truth, R.issues(a)), ["workbook", "sheet", "sheet_idx", "row", "c0", "c1", "span", "pattern"])


@dataclass
class Training:
    model: object
    parts: dict[str, list[str]]
    metrics: DataFrame
    accuracy: float | None


def train_classifier(cells: DataFrame, truth: DataFrame, config: T.TrainingConfig = T.TrainingConfig(), folder: str | None = None) -> Training:
    rows = labelled_blocks(cells, truth).where("label IS NOT NULL").cache()
    parts = labeling.split_entries(labeling.labelled_entries(rows), seed=config.seed)
    if not parts["train"] or not parts["test"]:
        raise ValueError("too few labelled entries for a split")
    part = lambda p: rows.where(F.col("workbook").isin(parts[p]))
    model = T.train(part("train"), config)
    predicted = T.predict(model, part("test")).cache()
    metrics, accuracy = T.label_metrics(predicted), T.accuracy(predicted)
    if folder:
        T.save(model, folder, parts, [r.asDict() for r in metrics.collect()], config)
    return Training(model, parts, metrics, accuracy)


COST = "$0"


def ablation(cells: DataFrame, truth: DataFrame, model=None, parts: dict[str, list[str]] | None = None, call=None, samples: int = 5) -> DataFrame:
    """Three rows: tier 0, tiers 0+1, tiers 0+1+2; unmeasured ones hold nulls. Reviewed tiers are scored on the test entries."""
    if call is not None and model is None:
        raise ValueError("tier 2 without tier 1")
    spark = cells.sparkSession

    def row(name: str, found: Evaluation | None, ms: float | None, notes: str) -> tuple:
        if found is None:
            return (name, "not_yet_available", None, None, None, COST, None, notes)
        m = scoring.micro_average(found.rollups).first()
        return (name, "measured", m.precision, m.recall, m.p_at_k, COST, ms, notes)

    names = [r.workbook for r in cells.select("workbook").distinct().orderBy("workbook").limit(samples).collect()]
    spent = []
    for n in names:
        begun = time.perf_counter()
        R.issues(R.analyze(cells.where(F.col("workbook") == n))).count()
        spent.append(1000 * (time.perf_counter() - begun))
    rows = [row("Tier 0", evaluate(cells, truth), median(spent) if spent else None, f"runtime per workbook alone, over {len(spent)} workbooks")]
    test = parts["test"] if parts else None
    one = evaluate(cells, truth, names=test, review=lambda i, a: T.review(i, a, model)[0]) if model is not None else None
    rows.append(row("Tier 0+1", one, None, "test entries only" if one else "no classifier given"))
    two = None
    if call is not None:
        two = evaluate(cells, truth, names=test, review=lambda i, a: T.review_by_call(T.review(i, a, model)[0], a, call)[0])
    rows.append(row("Tier 0+1+2", two, None, "test entries only" if two else "no adjudicator given"))
    return spark.createDataFrame(rows, "configuration string, status string, precision double, recall double, precision_at_10 double, cost string, median_runtime_ms double, notes string")


def text_table(df: DataFrame, order: list[str] | None = None, caveat: str = CAVEAT) -> str:
    """A small result as aligned text, the caveat first."""
    rows = (df.orderBy(*order) if order else df).collect()
    shown = [[("n/a" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)) for v in r] for r in rows]
    width = [max(len(x) for x in col) for col in zip(df.columns, *shown)]
    line = lambda cells: "  ".join(c.ljust(w) for c, w in zip(cells, width)).rstrip()
    return "\n".join([caveat, "", line(df.columns), *map(line, shown)])
