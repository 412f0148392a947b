"""Review of issues: a trained classifier of blocks (tier 1) and a pluggable adjudicator (tier 2)."""

from __future__ import annotations

import json
import os
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IndexToString, RegexTokenizer, StringIndexer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from . import blocks as B
from . import labeling
from .labeling import LABELS
from .rules import Analysis

QUIET = ("subtotal", "intentional_override")


@dataclass(frozen=True)
class TrainingConfig:
    features: int = 1 << 12
    rounds: int = 60
    regularization: float = 0.01
    seed: int = 42
    thin_support: int = 10


def class_weights(train: DataFrame) -> DataFrame:
    """label, weight = rows / (labels * rows of the label); a label without rows counts 1."""
    n = train.count()
    every = train.sparkSession.createDataFrame([(x,) for x in LABELS], "label string")
    counts = F.broadcast(every).join(train.groupBy("label").count(), "label", "left").fillna(1, ["count"])
    return counts.select("label", (F.lit(float(n)) / (len(LABELS) * F.col("count"))).alias("weight"))


def train(examples: DataFrame, config: TrainingConfig = TrainingConfig()) -> PipelineModel:
    """A linear classifier of block texts; ``examples`` has text and label."""
    rows = examples.where("label IS NOT NULL")
    if rows.isEmpty():
        raise ValueError("no labelled examples to train on")
    weighted = rows.join(F.broadcast(class_weights(rows)), "label")
    index = StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc", handleInvalid="keep").fit(weighted)
    words = RegexTokenizer(inputCol="text", outputCol="words", pattern=r"[A-Za-z_]+|\d+|[^\sA-Za-z0-9_]", gaps=False)
    terms = HashingTF(inputCol="words", outputCol="x", numFeatures=config.features)
    model = LogisticRegression(featuresCol="x", labelCol="y", weightCol="weight", maxIter=config.rounds, regParam=config.regularization)
    names = IndexToString(inputCol="prediction", outputCol="predicted", labels=index.labels)
    fitted = Pipeline(stages=[index, words, terms, model]).fit(weighted)
    return PipelineModel(stages=[*fitted.stages[1:], names])


def predict(model: PipelineModel, examples: DataFrame) -> DataFrame:
    return model.transform(examples).drop("words", "x", "rawPrediction", "probability", "prediction")


def confusion(predicted: DataFrame) -> DataFrame:
    """true label x predicted label, zero-filled; one column per predicted label."""
    every = predicted.sparkSession.createDataFrame([(x,) for x in LABELS], "label string")
    return F.broadcast(every).join(predicted.groupBy("label").pivot("predicted", list(LABELS)).count(), "label", "left").fillna(0)


def label_metrics(predicted: DataFrame) -> DataFrame:
    """label, support, tp, fp, fn, precision, recall, f1 (null where precision or recall is 0 or null)."""
    every = predicted.sparkSession.createDataFrame([(x,) for x in LABELS], "label string")
    pairs = predicted.groupBy(F.col("label").alias("t"), F.col("predicted").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    either = pairs.select(F.explode(F.array(F.struct(F.col("t").alias("label"), F.lit("t").alias("as")), F.struct(F.col("p").alias("label"), F.lit("p").alias("as")))).alias("e"), (F.col("t") == F.col("p")).alias("hit"), "n")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    as_true, as_pred = F.col("e.as") == "t", F.col("e.as") == "p"
    sums = either.groupBy(F.col("e.label").alias("label")).agg(total(as_true).alias("support"), total(as_true & F.col("hit")).alias("tp"), total(as_pred & ~F.col("hit")).alias("fp"), total(as_true & ~F.col("hit")).alias("fn"))
    out = F.broadcast(every).join(sums, "label", "left").fillna(0)
    over = lambda a, b: F.col(a) / F.when(F.col(a) + F.col(b) != 0, F.col(a) + F.col(b))
    out = out.withColumns({"precision": over("tp", "fp"), "recall": over("tp", "fn")})
    both = (F.col("precision") > 0) & (F.col("recall") > 0)
    return out.withColumn("f1", F.when(both, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))


def accuracy(predicted: DataFrame) -> float | None:
    return predicted.agg(F.avg((F.col("label") == F.col("predicted")).cast("double"))).first()[0]


def save(model: PipelineModel, folder: str, parts: dict[str, list[str]], metrics: list[dict], config: TrainingConfig = TrainingConfig()) -> None:
    model.write().overwrite().save(os.path.join(folder, "model"))
    for name, value in (("split", parts), ("classification_report", {"labels": metrics, "config": asdict(config)})):
        with open(os.path.join(folder, f"{name}.json"), "w", encoding="utf-8") as out:
            json.dump(value, out, indent=1)


def load(folder: str) -> tuple[PipelineModel, dict[str, list[str]], dict]:
    def read(name: str):
        with open(os.path.join(folder, f"{name}.json"), encoding="utf-8") as f:
            return json.load(f)

    return PipelineModel.load(os.path.join(folder, "model")), read("split"), read("classification_report")


def confidence_caveat(report: dict, thin: int = TrainingConfig.thin_support) -> str:
    rows = [f"{m['label']}: precision {_short(m['precision'])}, recall {_short(m['recall'])} on {m['support']} examples" + (" (thin)" if m["support"] < thin else "") for m in report["labels"]]
    return "Held-out quality of the classifier: " + "; ".join(rows) + "."


def _short(x: float | None) -> str:
    return "n/a" if x is None else f"{x:.3f}"


def suppressed_cells(found: DataFrame, beside: DataFrame, predicted: DataFrame) -> DataFrame:
    """Cells (workbook, cell) of blocks that are predicted a subtotal or an intentional override."""
    quiet = predicted.where(F.col("predicted").isin(*QUIET)).select(*B.BLOCK)
    return labeling.candidates(found, beside).join(quiet, B.BLOCK, "left_semi").select("workbook", "cell").distinct()


def suppressed_issue_cells(issues: DataFrame, predicted: DataFrame) -> DataFrame:
    """Of ``suppressed_cells`` those with an issue. A flagged cell right beside a block is one of its neighbours, so blocks and issues meet by row, not by member."""
    quiet = predicted.where(F.col("predicted").isin(*QUIET)).select(*B.ROW, "c0", "c1")
    rows = issues.select(*B.ROW, "col", "cell").distinct().join(quiet, B.ROW)
    return rows.where("col BETWEEN c0 - 1 AND c1 + 1").select("workbook", "cell").distinct()


def split_issues(issues: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(issues that stay, issues on the suppressed cells)."""
    return issues.join(cells, ["workbook", "cell"], "left_anti"), issues.join(cells, ["workbook", "cell"], "left_semi")


def apply_predictions(issues: DataFrame, a: Analysis, predicted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(surviving, suppressed). Every block needs exactly one prediction."""
    known = predicted.select(*B.BLOCK).distinct()
    if predicted.count() != known.count() or not a.blocks.select(*B.BLOCK).join(known, B.BLOCK, "left_anti").isEmpty():
        raise ValueError("blocks and predictions don't match one to one")
    return split_issues(issues, suppressed_cells(a.blocks, a.neighbors, predicted))


def review(issues: DataFrame, a: Analysis, model: PipelineModel) -> tuple[DataFrame, DataFrame]:
    """Tier 1 on workbooks without ground truth: base shapes are guessed from the patterns."""
    seen = labeling.examples(a.blocks, a.neighbors, C.base_shape(F.col("pattern")))
    return apply_predictions(issues, a, predict(model, seen))


# Tier 2 -------------------------------------------------------------------------------------------------

URL, MODEL, TIMEOUT = "http://localhost:11434", "qwen2.5:3b-instruct", 90
PROMPT = (
    "You review one block of a spreadsheet's formulas. Answer with JSON holding one key, label: subtotal for a legitimate total, "
    "intentional_override for a value put in on purpose, suspected_error for a likely mistake, unknown if you can't tell."
)
SCHEMA = {"type": "object", "properties": {"label": {"type": "string", "enum": list(LABELS)}}, "required": ["label"]}


def parse_reply(text: str) -> str:
    label = json.loads(text).get("label")
    if label not in LABELS:
        raise ValueError(f"reply has no known label: {label!r}")
    return label


def post_chat(body: dict, url: str = URL, timeout: float = TIMEOUT) -> dict:
    request = urllib.request.Request(f"{url}/api/chat", json.dumps(body).encode(), {"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=timeout) as reply:
        return json.load(reply)


def ask(text: str, model: str = MODEL, post: Callable[[dict], dict] = post_chat) -> str:
    """The label that a local chat model gives to a block's text; ``post`` is the transport."""
    messages = [{"role": "system", "content": PROMPT}, {"role": "user", "content": text}]
    reply = post({"model": model, "messages": messages, "format": SCHEMA, "stream": False, "options": {"temperature": 0}})
    return parse_reply(reply["message"]["content"])


def check_available(model: str = MODEL, url: str = URL, get: Callable[[str], dict] | None = None) -> None:
    """RuntimeError if the server doesn't answer, or doesn't have the model (a bare name matches any tag)."""

    def fetch(address: str) -> dict:
        with urllib.request.urlopen(address, timeout=5) as reply:
            return json.load(reply)

    try:
        names = [m["name"] for m in (get or fetch)(f"{url}/api/tags").get("models", [])]
    except (urllib.error.URLError, OSError) as e:
        raise RuntimeError(f"no chat server at {url}: {e}") from e
    if not any(n == model or ":" not in model and n.split(":")[0] == model for n in names):
        raise RuntimeError(f"the chat server at {url} doesn't have {model!r}; it has {', '.join(names) or 'no model'}")


def adjudicate(examples: DataFrame, call: Callable[[str], str]) -> DataFrame:
    """``examples`` with ``predicted``; equal texts are asked once."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"signature": frame["signature"], "predicted": [call(t) for t in frame["text"]]})

    once = examples.select("signature", "text").dropDuplicates(["signature"]).mapInPandas(run, "signature string, predicted string")
    return examples.join(once, "signature")


def review_by_call(issues: DataFrame, a: Analysis, call: Callable[[str], str]) -> tuple[DataFrame, DataFrame]:
    seen = labeling.examples(a.blocks, a.neighbors, C.base_shape(F.col("pattern")))
    return apply_predictions(issues, a, adjudicate(seen, call))
