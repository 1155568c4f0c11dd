"""Probes: simple heads fitted on frozen features, scored on pools. Features are standardised by the training rows."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardloom.operators import mlp
from shardloom.operators.metrics import binary_scores, class_scores, confusion, macro_scores
from shardloom.sources.tables import cut

#: Cost of the linear head; steps of its fit; training rows of a task at least.
COST, ROUNDS, A_TASK = 1.0, 100, 5_000


def standardised(train: DataFrame, *others: DataFrame, vec: str = "vec") -> list[DataFrame]:
    """The tables with ``vec`` less the training mean, over the training rows' population deviation; a constant dimension is only shifted."""
    if train.where(F.col(vec).isNotNull()).isEmpty():
        raise ValueError("no training rows")
    x = array_to_vector(F.col(vec).cast("array<double>"))
    stats = train.agg(vector_to_array(Summarizer.mean(x)).alias("m"), vector_to_array(Summarizer.variance(x)).alias("v"), F.count(vec).alias("n")).first()
    scale = [(v * (stats["n"] - 1) / stats["n"]) ** 0.5 for v in stats["v"]]  # as many numbers as a vector has
    parts = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(s or 1.0).alias("s")) for m, s in zip(stats["m"], scale, strict=True)])
    new = F.zip_with(F.col(vec), parts, lambda a, p: (a.cast("double") - p["m"]) / p["s"])
    return [t.withColumn(vec, new) for t in (train, *others)]


def _fitted(train: DataFrame) -> tuple[DataFrame, int]:
    """(features, label) of the training rows, a task for some thousands of them, and their number: every step of a fit is a job."""
    data = cut(_ready(train).select("features", "label"))
    n = data.count()
    return data.coalesce(max(1, n // A_TASK)), n


def _ready(rows: DataFrame) -> DataFrame:
    return rows.withColumn("features", array_to_vector(F.col("vec").cast("array<double>"))).withColumn("label", F.col("y").cast("double"))


def svm_predictions(train: DataFrame, other: DataFrame) -> DataFrame:
    """``other`` with ``predicted`` of a linear support vector head fitted on ``train`` (vec, y from 0 on), one class against the rest."""
    data, n = _fitted(train)
    head = LinearSVC(regParam=1 / (COST * max(1, n)), maxIter=ROUNDS, standardization=False)
    model = OneVsRest(classifier=head).fit(data)
    return model.transform(_ready(other)).withColumn("predicted", F.col("prediction").cast("int")).select(*other.columns, "predicted")


def mlp_predictions(train: DataFrame, other: DataFrame, classes: int, seed: int) -> DataFrame:
    """``other`` with ``predicted`` and ``probability`` (array) of a head with one hidden layer, a fixed number of rounds and no early stop."""
    return mlp.predictions(mlp.fit(train, classes, seed), other)


def heads(train: DataFrame, other: DataFrame, classes: int, seed: int) -> dict[str, DataFrame]:
    """Predictions of both heads on standardised features, by name."""
    a, b = standardised(train, other)
    return {"svm": svm_predictions(a, b), "mlp": mlp_predictions(a, b, classes, seed).drop("probability")}


def pid_scores(train: DataFrame, val: DataFrame, classes: list[int], headline: list[int], seed: int) -> tuple[DataFrame, DataFrame]:
    """((head, class, support, precision, recall, f1, iou), (head, macro scores over ``headline`` and the accuracy)) of both heads.

    ``train`` and ``val``: vec and ``class``, one of ``classes``, of which a head sees the place.
    """
    place = F.element_at(F.create_map(*[F.lit(x) for i, c in enumerate(classes) for x in (c, i)]), F.col("class"))
    back = F.array(*map(F.lit, classes))
    each, macro = [], []
    for name, rows in heads(train.withColumn("y", place), val.withColumn("y", place), len(classes), seed).items():
        matrix = cut(confusion(rows.withColumn("guess", F.get(back, F.col("predicted"))), "class", "guess"))
        each.append(class_scores(matrix).withColumn("head", F.lit(name)))
        macro.append(macro_scores(matrix, headline).withColumn("head", F.lit(name)))
    return reduce(DataFrame.unionByName, each), reduce(DataFrame.unionByName, macro)


def binary_probe(train: DataFrame, val: DataFrame, truth: Column, seed: int) -> DataFrame:
    """(head, prevalence, tp, fp, fn, precision, ..) of both heads on ``val``; ``truth`` is a boolean of the rows of both tables.
    Training rows of one class only are an error."""
    own = lambda rows: rows.withColumn("y", truth.cast("int"))
    if train.select(truth.alias("t")).distinct().count() < 2:
        raise ValueError("the training rows have one class only")
    out = [rows.agg(F.avg("y").alias("prevalence"), *binary_scores(F.col("y") == 1, F.col("predicted") == 1)).withColumn("head", F.lit(name)) for name, rows in heads(own(train), own(val), 2, seed).items()]
    return reduce(DataFrame.unionByName, out)


def threshold_probe(trains: list[DataFrame], val: DataFrame, value: str, thresholds: list[float], seed: int, above: bool = True) -> DataFrame:
    """``binary_probe`` for each threshold with its own training pool: is ``value`` over it (or, not ``above``, up to it)?"""
    out = []
    for train, t in zip(trains, thresholds, strict=True):
        truth = F.col(value) > t if above else F.col(value) <= t
        out.append(binary_probe(train, val, truth, seed).withColumn("threshold", F.lit(float(t))))
    return reduce(DataFrame.unionByName, out)


def named_scores(scores: DataFrame, names: dict[int, str], value: str) -> DataFrame:
    """(head, by_name): a map from class names to one of the scores."""
    name = F.element_at(F.create_map(*[F.lit(x) for k, v in names.items() for x in (k, v)]), F.col("class"))
    return scores.groupBy("head").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name.alias("k"), F.col(value).alias("v"))))).alias("by_name"))


def run_stages(stages: dict, stores: dict) -> tuple[dict, dict]:
    """({(store, stage): result}, {(store, stage): error}): every stage (a function of a store) runs for every store, whatever fails before."""
    done, failed = {}, {}
    for store, content in stores.items():
        for stage, f in stages.items():
            try:
                done[store, stage] = f(content)
            except Exception as e:  # noqa: BLE001 - the other stages still run; the caller sees what failed
                failed[store, stage] = f"{type(e).__name__}: {e}"
    return done, failed
