"""Issues against ground truth: outcomes, slices, rollups, precision at ten, clean baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rules import RULES, SEVERITIES, severity_rank

K = 10
TRUE, FALSE, KNOWN, AMBIGUOUS = "true_positive", "false_positive", "known_intentional", "ambiguous_excluded"


def outcomes(issues: DataFrame, truth: DataFrame) -> DataFrame:
    """Issues (workbook = entry) with their outcome against ground truth(entry, cell, state, rule_id)."""
    known = truth.select(F.col("entry").alias("workbook"), "cell", "state", F.col("rule_id").alias("true_rule"))
    outcome = (
        F.when((F.col("state") == "injected_bug") & (F.col("true_rule") == F.col("rule_id")), TRUE)
        .when(F.col("state") == "known_intentional", KNOWN)
        .when(F.col("state") == "ambiguous", AMBIGUOUS)
        .otherwise(FALSE)
    )
    return issues.join(known, ["workbook", "cell"], "left").withColumn("outcome", outcome).select("workbook", "cell", "severity", "rule_id", "outcome")


def false_negatives(issues: DataFrame, truth: DataFrame) -> DataFrame:
    """Injected bugs that their rule didn't flag: workbook, cell, rule_id."""
    bugs = truth.where("state = 'injected_bug'").select(F.col("entry").alias("workbook"), "cell", "rule_id")
    return bugs.join(issues.select("workbook", "cell", "rule_id"), ["workbook", "cell", "rule_id"], "left_anti")


def _count(outcome: str):
    return F.count(F.when(F.col("outcome") == outcome, 1))


def slices(scored: DataFrame, rules=tuple(RULES)) -> DataFrame:
    """Counts per rule and severity, zero-filled."""
    spark = scored.sparkSession
    grid = spark.createDataFrame([(r, s) for r in rules for s in SEVERITIES], "rule_id string, severity string")
    sums = scored.groupBy("rule_id", "severity").agg(_count(TRUE).alias("tp"), _count(FALSE).alias("fp"), _count(KNOWN).alias("known"), _count(AMBIGUOUS).alias("ambiguous"))
    out = F.broadcast(grid).join(sums, ["rule_id", "severity"], "left").fillna(0, ["tp", "fp", "known", "ambiguous"])
    return out.withColumn("precision", ratio("tp", F.col("tp") + F.col("fp")))


def ratio(part: str, whole: Column) -> Column:
    """part / whole, null for an empty whole."""
    return F.col(part) / F.when(whole != 0, whole)


def precision_at_k(scored: DataFrame, k: int = K) -> DataFrame:
    """Of each rule's decided issues over all entries, the first ``k`` by (severity, entry, cell): share of true positives."""
    w = Window.partitionBy("rule_id").orderBy(severity_rank(F.col("severity")), "workbook", "cell")
    top = scored.where(F.col("outcome").isin(TRUE, FALSE)).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)
    return top.groupBy("rule_id").agg((_count(TRUE) / F.count(F.lit(1))).alias("p_at_k"), F.count(F.lit(1)).alias("k"))


def rollups(sliced: DataFrame, missed: DataFrame, at_k: DataFrame) -> DataFrame:
    """Per rule: tp, fp, fn, known, ambiguous, precision, recall, p_at_k, k."""
    sums = sliced.groupBy("rule_id").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "known", "ambiguous")))
    out = sums.join(missed.groupBy("rule_id").agg(F.count(F.lit(1)).alias("fn")), "rule_id", "left").fillna(0, ["fn"])
    out = out.withColumns({"precision": ratio("tp", F.col("tp") + F.col("fp")), "recall": ratio("tp", F.col("tp") + F.col("fn"))})
    return out.join(at_k, "rule_id", "left")


def micro_average(rolled: DataFrame) -> DataFrame:
    """One row over all rules: precision, recall, p_at_k."""
    sums = rolled.agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn", "k")), F.sum(F.round(F.col("p_at_k") * F.col("k"))).alias("hits"))
    return sums.select(ratio("tp", F.col("tp") + F.col("fp")).alias("precision"), ratio("tp", F.col("tp") + F.col("fn")).alias("recall"), ratio("hits", F.col("k")).alias("p_at_k"))


def clean_baseline(scored: DataFrame, truth: DataFrame) -> DataFrame:
    """Over the entries without an injected bug: entries, raw_flags, unexplained."""
    clean = truth.groupBy(F.col("entry").alias("workbook")).agg(F.bool_or(F.col("state") == "injected_bug").alias("bug")).where("NOT bug").select("workbook")
    flags = clean.join(scored, "workbook", "left")
    return flags.agg(F.count_distinct("workbook").alias("entries"), F.count(F.when(F.col("outcome").isin(FALSE, KNOWN, AMBIGUOUS), 1)).alias("raw_flags"), _count(FALSE).alias("unexplained"))
