"""Trained risk models: boosted trees and a neural net per disease, with Spark ML.

A model is a pair of fitted pipelines over the model's input features.  ``predict_batch`` scores a
feature table with both and feeds ``risk.score_features`` (as ``fitted``).
"""

from __future__ import annotations

import math
import random

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, MultilayerPerceptronClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import TrainValidationSplit
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinchart.operators.maintain import latest_per_key
from kinchart.sources import dimensions as dims

INPUTS = {r[0]: dims.words(r[4]) for r in dims.rows("RISK_MODELS", 5)}
AUC_GATE, F1_GATE = 0.82, 0.75
RANGES = 4096  # ranges of scores that are summed first


def feature_vector(features: DataFrame, model: str, out: str = "x") -> DataFrame:
    """The model's inputs in their order as one vector column."""
    return VectorAssembler(inputCols=INPUTS[model], outputCol=out).transform(features)


def search_space(trials: int, seed: int = 42) -> list[dict]:
    """Random settings: 40-150 rounds, depth 3-6, step 0.01-0.15 on a log scale, row share 0.6-0.9."""
    draw = random.Random(seed)
    return [
        {
            "maxIter": draw.randint(40, 150),
            "maxDepth": draw.randint(3, 6),
            "stepSize": math.exp(draw.uniform(math.log(0.01), math.log(0.15))),
            "subsamplingRate": draw.uniform(0.6, 0.9),
        }
        for _ in range(trials)
    ]


def fit_trees(
    cohort: DataFrame, model: str, label: str = "label", trials: int = 50, seed: int = 42, settings: list[dict] | None = None
) -> PipelineModel:
    """Boosted trees with the settings that give the best AUC on a held-out share."""
    assembler = VectorAssembler(inputCols=INPUTS[model], outputCol="x")
    trees = GBTClassifier(featuresCol="x", labelCol=label, seed=seed)
    options = settings or search_space(trials, seed)
    grid = [{getattr(trees, name): value for name, value in s.items()} for s in options]
    search = TrainValidationSplit(
        estimator=trees,
        estimatorParamMaps=grid,
        evaluator=BinaryClassificationEvaluator(labelCol=label, metricName="areaUnderROC"),
        trainRatio=0.889,
        seed=seed,
        parallelism=2,
    )
    best = search.fit(assembler.transform(cohort)).bestModel
    return PipelineModel([assembler, best])


def fit_net(cohort: DataFrame, model: str, label: str = "label", epochs: int = 50, seed: int = 42) -> PipelineModel:
    """A 64-32-16 net on standardised inputs."""
    names = INPUTS[model]
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=names, outputCol="x"),
            StandardScaler(inputCol="x", outputCol="z", withMean=True, withStd=True),
            MultilayerPerceptronClassifier(
                featuresCol="z", labelCol=label, layers=[len(names), 64, 32, 16, 2], maxIter=epochs, seed=seed
            ),
        ]
    ).fit(cohort)


def predict_batch(
    features: DataFrame, model: str, trees: PipelineModel | None, net: PipelineModel | None
) -> DataFrame:
    """user_id, model_key, tree_p, net_p; the input is standardised for the net only."""
    out = features
    for fitted, name in ((trees, "tree_p"), (net, "net_p")):
        if fitted is None:
            out = out.withColumn(name, F.lit(None).cast("double"))
        else:
            scored = fitted.transform(out)
            made = [c for c in scored.columns if c not in out.columns]
            out = scored.withColumn(name, vector_to_array("probability")[1]).drop(*made)
    return out.select("user_id", F.lit(model).alias("model_key"), "tree_p", "net_p")


def confusion(scored: DataFrame, label: str = "label", cut: float = 0.5) -> DataFrame:
    """Number of rows per class ``y`` and prediction ``p`` at the cut: four at most."""
    hit = (F.col("probability") >= cut).cast("int")
    return scored.groupBy(F.col(label).cast("int").alias("y"), hit.alias("p")).agg(F.count("*").alias("n"))


def auc(scored: DataFrame, label: str = "label", keys: tuple[str, ...] = (), score: str = "probability") -> DataFrame:
    """Exact area under the ROC curve per ``keys``: how often a positive row scores above a negative one, ties half.

    Rows are counted per score first.  The negatives below a score are those of lower ranges of scores (a
    running sum over at most ``RANGES`` rows a key) and those below it in its own range.  Null without both classes.
    """
    positive = (F.col(label) > 0).cast("int")
    counts = scored.groupBy(*keys, F.col(score).alias("_v")).agg(F.sum(positive).alias("_p"), F.sum(1 - positive).alias("_n"))
    counts = counts.withColumn("_range", F.floor(F.least(F.greatest("_v", F.lit(0.0)), F.lit(1.0)) * RANGES))
    below = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = counts.groupBy(*keys, "_range").agg(F.sum("_n").alias("_rn"))
    ranges = ranges.withColumn("_below", F.coalesce(F.sum("_rn").over(below), F.lit(0))).drop("_rn")
    inside = Window.partitionBy(*keys, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("_inside", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(ranges, [*keys, "_range"])
    won = F.sum((F.col("_p") * (2 * (F.col("_below") + F.col("_inside")) + F.col("_n"))).cast("decimal(38,0)"))
    pairs = 2 * F.sum("_p").cast("double") * F.sum("_n").cast("double")
    return placed.groupBy(*keys).agg(F.try_divide(won.cast("double"), pairs).alias("auc"))


def class_report(scored: DataFrame, label: str = "label", keys: tuple[str, ...] = (), cut: float = 0.5) -> DataFrame:
    """Precision, recall and F1 of the positive class per ``keys`` at the cut, and its support."""
    real, told = F.col(label) > 0, F.col("probability") >= cut
    cells = scored.groupBy(*keys).agg(
        F.count_if(real & told).alias("tp"), F.count_if(told).alias("found"), F.count_if(real).alias("support")
    )
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    rates = cells.select(*keys, share("tp", "found").alias("precision"), share("tp", "support").alias("recall"), "support")
    both = F.col("precision") + F.col("recall")
    return rates.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), both), F.lit(0.0)))


def evaluate(scored: DataFrame, label: str = "label", cut: float = 0.5) -> dict:
    """AUC, F1 at the cut, a per-class report, and whether both gates are met.

    ``scored`` has the label and the ensemble ``probability``.
    """
    area = auc(scored, label).first()["auc"] or 0.0
    cells = {(int(r["y"]), int(r["p"])): r["n"] for r in confusion(scored, label, cut).collect()}
    report = {}
    for c in (0, 1):
        tp = cells.get((c, c), 0)
        found = tp + cells.get((1 - c, c), 0)
        real = tp + cells.get((c, 1 - c), 0)
        precision, recall = tp / found if found else 0.0, tp / real if real else 0.0
        f1 = 2 * precision * recall / (precision + recall) if precision + recall else 0.0
        report[c] = {"precision": precision, "recall": recall, "f1": f1, "support": real}
    f1 = report[1]["f1"]
    return {"auc": area, "f1": f1, "report": report, "passed": area >= AUC_GATE and f1 >= F1_GATE}


def save_model(fitted: PipelineModel, folder: str, name: str, kind: str, version: int) -> str:
    path = f"{folder}/{name}/{kind}/v{version}"
    fitted.write().overwrite().save(path)
    return path


def catalog_rows(spark: SparkSession, entries: list[tuple]) -> DataFrame:
    """Catalog entries (name, type, path, saved_at, metrics)."""
    return spark.createDataFrame(
        entries, "name string, type string, path string, saved_at timestamp, metrics map<string,double>"
    )


def model_catalog(catalog: DataFrame) -> DataFrame:
    """Latest entry of each model and type."""
    return latest_per_key(catalog, ["name", "type"], [F.desc("saved_at"), F.desc("path")])


def model_readiness(catalog: DataFrame) -> DataFrame:
    """Per disease model which parts exist, and whether all do."""
    known = dims.table(catalog.sparkSession, [(m,) for m in INPUTS], "name string").select("name")
    kinds = catalog.groupBy("name").agg(F.collect_set("type").alias("_t"))
    has = lambda k: F.coalesce(F.array_contains("_t", k), F.lit(False))
    return known.join(kinds, "name", "left").select(
        "name",
        has("trees").alias("trees_exist"),
        has("net").alias("net_exists"),
        (has("trees") & has("net")).alias("fully_trained"),
    )
