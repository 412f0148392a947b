"""Labels of blocks from cell-level ground truth, the entry-level split, and readiness for training."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from . import blocks as B

LABELS = ("subtotal", "intentional_override", "suspected_error", "unknown")
FLOOR = 50


def candidates(found: DataFrame, beside: DataFrame) -> DataFrame:
    """The cells that a block's label may come from: BLOCK columns, cell, ord (members, then non-conforming, then near misses)."""
    own = B.members(found).select(*B.BLOCK, "cell", F.col("col").cast("long").alias("ord"))
    late = F.when(F.col("kind") == "near_miss", 2).otherwise(1)
    near = beside.select(*B.BLOCK, "cell", (F.lit(1_000_000).cast("long") * late + F.col("n_col")).alias("ord"))
    return own.unionByName(near)


def _signals(truth: DataFrame, issues: DataFrame) -> DataFrame:
    """Per sheet row the cells with a signal: workbook, sheet, row, and ``signals``, an array of struct(col, rank, label, basis)."""
    rank = F.when(F.col("state") == "subtotal", 0).when(F.col("state") == "injected_bug", 1).when(F.col("state") == "ambiguous", 2).when(F.col("state") == "known_intentional", 3)
    known = truth.select(F.col("entry").alias("workbook"), "cell", "state", "rule_id", rank.alias("rank")).where("rank IS NOT NULL")
    flagged = issues.select("workbook", "cell").distinct().withColumn("flagged", F.lit(True))
    each = known.join(flagged, ["workbook", "cell"], "left").where("rank IN (0, 3) OR flagged")
    label = F.when(F.col("rank") == 0, "subtotal").when(F.col("rank") == 1, "suspected_error").when(F.col("rank") == 2, "unknown").otherwise("intentional_override")
    basis = F.concat(F.col("state"), F.when(F.col("rank").isin(1, 2), F.concat(F.lit(":"), "rule_id")).otherwise(F.lit("")), F.lit("@"), F.col("cell"))
    part = lambda k: F.regexp_extract("cell", r"(?s)^(.*)!([A-Z]{1,3})([1-9][0-9]{0,6})$", k)
    each = each.where(part(2) != "").select("workbook", part(1).alias("sheet"), part(3).cast("int").alias("row"), F.struct(C.index_of(part(2)).alias("col"), "rank", label.alias("label"), basis.alias("basis")).alias("signal"))
    return each.groupBy(*B.ROW).agg(F.collect_list("signal").alias("signals"))


def _late(near_miss: Column) -> Column:
    return F.when(near_miss, 2).otherwise(1)


def labels(found: DataFrame, beside: DataFrame | None, truth: DataFrame, issues: DataFrame) -> DataFrame:
    """Per block: label (null without a signal) and basis. The strongest signal wins, then the first candidate cell.

    Only cells with a signal meet the blocks of their row, not each member of every block. Without ``beside`` the cells beside the blocks are read from ``found``.
    """
    late = "array<struct<col:int,late:int>>"
    if beside is None:
        near = lambda side: F.when(F.col(side).isNotNull(), F.struct(F.col(f"{side}.col").alias("col"), _late(B.is_near_miss(F.col("pattern"), F.col(f"{side}.pattern"), F.col(f"{side}.parse_error"))).alias("late")))
        rows = found.select(*B.BLOCK, F.array_compact(F.array(near("left"), near("right"))).cast(late).alias("near"))
    else:
        near = beside.groupBy(*B.BLOCK).agg(F.collect_list(F.struct(F.col("n_col").alias("col"), _late(F.col("kind") == "near_miss").alias("late"))).cast(late).alias("near"))
        rows = found.select(*B.BLOCK).join(near, B.BLOCK, "left").withColumn("near", F.coalesce("near", F.array().cast(late)))
    rows = rows.join(_signals(truth, issues), B.ROW, "left")
    item = lambda s, at: F.struct(s["rank"].alias("rank"), at.alias("ord"), s["label"].alias("label"), s["basis"].alias("basis"))
    own = F.transform(F.filter("signals", lambda s: s["col"].between(F.col("c0"), F.col("c1"))), lambda s: item(s, s["col"].cast("long")))
    aside = F.flatten(F.transform("near", lambda n: F.transform(F.filter("signals", lambda s: s["col"] == n["col"]), lambda s: item(s, F.lit(1_000_000).cast("long") * n["late"] + s["col"]))))
    best = F.array_min(F.concat(own, aside))
    rows = rows.select(*B.BLOCK, F.when(F.col("signals").isNotNull(), best).alias("best"))
    return rows.select(*B.BLOCK, F.col("best.label").alias("label"), F.coalesce("best.basis", F.lit("no_ground_truth_signal")).alias("basis"))


def deviations(beside: DataFrame) -> DataFrame:
    """Per block its deviations in order: array of struct(cell, kind, side)."""
    kind = F.when(F.col("kind") == "near_miss", "near_miss").otherwise(F.concat(F.lit("non_conforming:"), "kind"))
    item = F.struct((F.col("kind") == "near_miss").alias("late"), "n_col", "cell", kind.alias("k"))
    each = beside.groupBy(*B.BLOCK).agg(F.sort_array(F.collect_list(item)).alias("d"))
    return each.select(*B.BLOCK, F.transform("d", lambda x: F.struct(x["cell"].alias("cell"), x["k"].alias("kind"), F.lit("neighbor").alias("side"))).alias("deviations"))


def examples(found: DataFrame, beside: DataFrame, shape: Column) -> DataFrame:
    """Per block: what the classifier sees. ``shape``: the base shape, from ground truth or guessed from the pattern."""
    out = found.drop("left", "right", "first_refs", "last_refs").join(deviations(beside), B.BLOCK, "left").withColumn("base_shape", shape)
    lines = F.transform(F.coalesce("deviations", F.array().cast("array<struct<cell:string,kind:string,side:string>>")), lambda d: F.concat(F.lit("  - "), d["cell"], F.lit(" ("), d["kind"], F.lit(", "), d["side"], F.lit(")")))
    rest = F.when(F.size(lines) == 0, F.array(F.lit("Deviations: none"))).otherwise(F.concat(F.array(F.lit("Deviations:")), lines))
    head = F.array(
        F.concat(F.lit("Block: "), "sheet", F.lit("!"), "span"), F.concat(F.lit("Base shape: "), "base_shape"),
        F.concat(F.lit("Formula pattern: "), "pattern"), F.concat(F.lit("Conforming cells: "), F.col("n_cells").cast("string")),
    )
    out = out.withColumn("text", F.array_join(F.concat(head, rest), "\n"))
    return out.withColumn("signature", F.sha2("text", 256))


def split_entries(names: list[str], train: float = 0.7, val: float = 0.15, test: float = 0.15, seed: int = 42) -> dict[str, list[str]]:
    """Entries, not blocks, are dealt: blocks of one entry are near copies. The same for any order of ``names``."""
    if abs(train + val + test - 1) > 1e-9:
        raise ValueError(f"the shares sum to {train + val + test}, not 1")
    order = sorted(names)
    random.Random(seed).shuffle(order)
    a = round(len(order) * train)
    b = a + round(len(order) * val)
    return {"train": order[:a], "val": order[a:b], "test": order[b:]}


def split_table(spark: SparkSession, parts: dict[str, list[str]]) -> DataFrame:
    return spark.createDataFrame([(n, p) for p, names in parts.items() for n in names], "workbook string, part string")


def labelled_entries(labelled: DataFrame) -> list[str]:
    return [r.workbook for r in labelled.where("label IS NOT NULL").select("workbook").distinct().orderBy("workbook").collect()]


def readiness(labelled: DataFrame, parts: DataFrame, floor: int = FLOOR) -> DataFrame:
    """Per label, zero-filled: n, patterns, train, val, test, ready."""
    spark = labelled.sparkSession
    rows = labelled.where("label IS NOT NULL").join(parts, "workbook", "left")
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("pattern").alias("patterns"), *(F.count(F.when(F.col("part") == p, 1)).alias(p) for p in ("train", "val", "test")))
    every = spark.createDataFrame([(x,) for x in LABELS], "label string")
    out = F.broadcast(every).join(counts, "label", "left").fillna(0)
    return out.withColumn("ready", F.col("n") >= floor)
