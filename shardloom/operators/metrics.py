"""Scores, pools of vectors, losses and checks as aggregations."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardloom.functions.expressions import bind, norm, ratio
from shardloom.operators.grouped import if_few
from shardloom.sources.tables import cut


def mean_vector(vec: str = "vec") -> Column:
    """Aggregate: the element-wise mean of vectors, without a row for every element."""
    return vector_to_array(Summarizer.mean(array_to_vector(F.col(vec).cast("array<double>"))))


def mean_pool(vectors: DataFrame, events: DataFrame, group: str = "event_idx") -> DataFrame:
    """Per event the element-wise mean of its vectors ``vec``, null for an event without any."""
    return events.select(group).join(vectors.groupBy(group).agg(mean_vector().alias("mean")), group, "left")


def offsets(counts: DataFrame, order: str, n: str = "n") -> DataFrame:
    """``counts`` with ``start`` and ``stop``: exclusive and inclusive running sums. In two steps, ranges of the order and
    rows within them, so no task needs all rows."""
    ranges = counts.withColumn("__range", F.floor(F.col(order) / 65536))
    sums = ranges.groupBy("__range").agg(F.sum(n).alias("__n"))
    sums = sums.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    own = F.sum(n).over(Window.partitionBy("__range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    rows = ranges.join(sums, "__range").withColumn("stop", F.col("__before") + own)
    return rows.withColumn("start", F.col("stop") - F.col(n)).drop("__range", "__before")


def key_digest(keys: DataFrame, key: str) -> DataFrame:
    """One row: SHA-256 over the sorted keys, each followed by a newline, and their number; null keys don't count.

    A SHA-256 of a sequence can only be taken from its beginning to its end, so one task reads the sorted keys; it sorts on
    disk if need be, holds a batch of them, and nothing of them comes to the driver.
    """

    def digest(batches):
        import hashlib

        h, n = hashlib.sha256(), 0
        for part in batches:
            h.update("".join(f"{k}\n" for k in part["k"]).encode())
            n += len(part)
        yield pd.DataFrame({"digest": [h.hexdigest()], "n": [n]})

    rows = keys.select(F.col(key).cast("string").alias("k")).where("k is not null")
    found = rows.repartition(1).sortWithinPartitions("k").mapInPandas(digest, "digest string, n long")  # no row at all without keys
    return found.agg(F.coalesce(F.max("digest"), F.sha2(F.lit(""), 256)).alias("digest"), F.coalesce(F.max("n"), F.lit(0)).alias("n"))


def confusion(pairs: DataFrame, truth: str = "truth", predicted: str = "predicted", by: list[str] | None = None) -> DataFrame:
    return pairs.groupBy(*(by or []), F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def class_scores(matrix: DataFrame) -> DataFrame:
    """Per class of a confusion matrix (truth, predicted, n): support, precision, recall, f1, iou; 0/0 is 0."""
    one = lambda c, name: matrix.groupBy(F.col(c).alias("class")).agg(F.sum("n").alias(name))
    hit = matrix.where("truth = predicted").select(F.col("truth").alias("class"), F.col("n").alias("hit"))
    rows = one("truth", "support").join(one("predicted", "guessed"), "class", "full").join(hit, "class", "left").na.fill(0)
    p, r = ratio(F.col("hit"), F.col("guessed")), ratio(F.col("hit"), F.col("support"))
    return rows.select(
        "class", "support", p.alias("precision"), r.alias("recall"),
        ratio(2 * F.col("hit"), F.col("guessed") + F.col("support")).alias("f1"),
        ratio(F.col("hit"), F.col("guessed") + F.col("support") - F.col("hit")).alias("iou"),
    )


def macro_scores(matrix: DataFrame, headline: list[int] | None = None) -> DataFrame:
    """One row: means of the class scores over ``headline`` classes (all that have support without), and the accuracy over all."""
    scores = class_scores(matrix).where(F.col("class").isin(headline) if headline else F.col("support") > 0)
    means = scores.agg(*[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1", "iou")], F.count(F.lit(1)).alias("n_classes"))
    share = matrix.agg(ratio(F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)), F.sum("n")).alias("accuracy"))
    return means.crossJoin(share)


def binary_scores(truth: Column, predicted: Column) -> list[Column]:
    """Aggregates tp, fp, fn, precision, recall, f1, accuracy and share predicted positive of two booleans; 0/0 is 0."""
    n = lambda c: F.count_if(c)
    tp, fp, fn = n(truth & predicted), n(~truth & predicted), n(truth & ~predicted)
    out = {"tp": tp, "fp": fp, "fn": fn, "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn),
           "accuracy": ratio(n(truth == predicted), F.count(F.lit(1))), "positive_rate": ratio(n(predicted), F.count(F.lit(1)))}
    return [c.alias(k) for k, c in out.items()]


def trivial_scores(rows: DataFrame, label: str, seed: int, key: str) -> DataFrame:
    """One row: the most frequent class (ties to the smallest), whether others tie, its share, and the accuracy of guessing at random among the classes."""
    from shardloom.functions.expressions import uniform

    counts = rows.groupBy(F.col(label).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    top = counts.agg(F.min(F.struct((-F.col("n")).alias("m"), "class")).alias("b"), F.sum("n").alias("total"), F.count(F.lit(1)).alias("n_classes"), F.sort_array(F.collect_list("class")).alias("classes"))
    top = top.select((-F.col("b.m")).alias("most"), F.col("b.class").alias("majority"), "total", "n_classes", "classes")
    ties = counts.join(F.broadcast(top), F.col("n") == F.col("most")).agg((F.count(F.lit(1)) > 1).alias("tied"))
    guess = F.get("classes", F.floor(uniform(seed, F.col(key)) * F.col("n_classes")).cast("int"))
    lucky = rows.crossJoin(F.broadcast(top.select("classes", "n_classes"))).agg(F.avg((guess == F.col(label)).cast("double")).alias("uniform_accuracy"))
    return top.crossJoin(ties).crossJoin(lucky).select("majority", "tied", (F.col("most") / F.col("total")).alias("majority_accuracy"), "uniform_accuracy", "n_classes")


def sweep(rows: DataFrame, value: str, predicted: Column, thresholds: list[float], strict: bool = True) -> DataFrame:
    """Binary scores of ``predicted`` against ``value`` over (or, not strict, up to) each threshold."""
    at = rows.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    truth = F.col(value) > F.col("threshold") if strict else F.col(value) <= F.col("threshold")
    return at.groupBy("threshold").agg(F.avg(truth.cast("double")).alias("prevalence"), *binary_scores(truth, predicted))


def percentiles(rows: DataFrame, value: str, shares: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """Per group ``by`` (all rows without): exact percentiles with linear interpolation, a column for each name of ``shares``;
    null values don't count.

    Distinct values with their counts are dealt out by ranges, counted by range, and only the values at the wanted ranks are
    kept: no task holds a group's values.
    """
    by = by or []
    values = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    dealt = cut(values.repartitionByRange(*by, "__v").withColumn("__part", F.spark_partition_id()))
    parts = dealt.groupBy(*by, "__part").agg(F.sum("__n").alias("__of"))
    order = Window.partitionBy(*by).orderBy("__part")
    parts = parts.select(*by, "__part", (F.sum("__of").over(order) - F.col("__of")).alias("__before"), F.sum("__of").over(Window.partitionBy(*by)).alias("__all"))
    own = F.sum("__n").over(Window.partitionBy("__part", *by).orderBy("__v"))
    ranked = dealt.join(if_few(cut(parts)).select(*[F.col(c).alias(f"__by_{c}") for c in by], F.col("__part").alias("__p"), "__before", "__all"), _null_safe(by) & (F.col("__part") == F.col("__p")))
    ranked = ranked.withColumn("__to", F.col("__before") + own)
    at = lambda q: (F.col("__all") - 1) * F.lit(q)
    holds = lambda rank: (rank >= F.col("__to") - F.col("__n")) & (rank < F.col("__to"))
    low = lambda q: F.max(F.when(holds(F.floor(at(q))), F.col("__v")))
    high = lambda q: F.max(F.when(holds(F.ceil(at(q))), F.col("__v")))
    share = lambda q: F.max(at(q) - F.floor(at(q)))
    return ranked.groupBy(*by).agg(*[(low(q) + share(q) * (high(q) - low(q))).alias(k) for k, q in shares.items()])


def _null_safe(by: list[str]) -> Column:
    out = F.lit(True)
    for c in by:
        out = out & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    return out


def order_statistics(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Per group min, p05, median, p95, max (linear interpolation) and mean."""
    found = percentiles(rows, value, {"p05": 0.05, "median": 0.5, "p95": 0.95}, by)
    plain = rows.groupBy(*by).agg(F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"))
    return plain.join(found, by)


def two_stage_mean(rows: DataFrame, value: Column, group: str) -> DataFrame:
    """Mean over the rows of a group, then over the groups that have rows."""
    return rows.groupBy(group).agg(F.avg(value).alias("m")).agg(F.avg("m").alias("mean"))


def covariance(vectors: DataFrame, id_col: str = "id", vec: str = "vec") -> DataFrame:
    """Sample covariance of the dimensions of ``vec``, rows (i, j, cov) for i <= j; null vectors don't count.

    A task sums its vectors and their products about its own mean; what is shuffled is one matrix a task, put together by
    the means' differences.
    """

    def sums(batches):
        n, mean, square = 0, None, None
        for part in batches:
            if not len(part):
                continue
            x = np.array(list(part["v"]), np.float64)
            m, own = x.mean(axis=0), len(x)
            s = (x - m).T @ (x - m)
            if mean is None:
                n, mean, square = own, m, s
                continue
            gap, both = m - mean, n + own
            square += s + np.outer(gap, gap) * (n * own / both)
            n, mean = both, mean + gap * (own / both)
        if mean is not None:
            i, j = np.triu_indices(len(mean))
            yield pd.DataFrame({"i": i, "j": j, "n": n, "x": mean[i], "y": mean[j], "s": square[i, j]})

    parts = vectors.where(F.col(vec).isNotNull()).select(F.col(vec).alias("v")).mapInPandas(sums, "i int, j int, n long, x double, y double, s double")
    n = F.sum("n")
    between = F.sum(F.col("n") * F.col("x") * F.col("y")) - F.sum(F.col("n") * F.col("x")) * F.sum(F.col("n") * F.col("y")) / n
    return parts.groupBy("i", "j").agg((F.try_divide(F.sum("s") + between, n - 1)).alias("cov"))


def eigenvalues(cov: DataFrame) -> list[float]:
    """Eigenvalues of a covariance (i, j, cov), largest first; the matrix has as many rows as a vector has dimensions."""
    rows = cov.collect()
    n = max((r["j"] for r in rows), default=-1) + 1
    m = np.zeros((n, n))
    for r in rows:
        m[r["i"], r["j"]] = m[r["j"], r["i"]] = r["cov"]
    return np.linalg.eigvalsh(m)[::-1].tolist() if n else []


def spectrum(vectors: DataFrame, id_col: str = "id", vec: str = "vec") -> DataFrame:
    """One row: participation ratio, RankMe, condition number (NaN if the smallest clipped eigenvalue is 0), dimensions that hold 90 and 99 % of the variance, and the share of squared covariance off the diagonal."""
    from shardloom.functions.expressions import participation_ratio, rank_me

    cov = cut(covariance(vectors, id_col, vec))
    values = [max(v, 0.0) for v in eigenvalues(cov)]
    squares = cov.agg(F.sum(F.when(F.col("i") == F.col("j"), F.col("cov") ** 2)).alias("on"), F.sum(F.when(F.col("i") != F.col("j"), 2 * F.col("cov") ** 2).otherwise(0.0)).alias("off"))
    own = F.array(*map(F.lit, values)) if values else F.array().cast("array<double>")
    total, sums, dims = sum(values), 0.0, {}
    for k, v in enumerate(values, 1):
        sums += v
        for q in (0.9, 0.99):
            if q not in dims and sums >= q * total:
                dims[q] = k
    condition = float("nan") if not values or values[-1] == 0 else values[0] / values[-1]
    return squares.select(
        participation_ratio(own).alias("participation_ratio"), rank_me(own).alias("rank_me"), F.lit(condition).alias("condition_number"),
        F.lit(dims.get(0.9, 0)).alias("dims_90"), F.lit(dims.get(0.99, 0)).alias("dims_99"), ratio(F.col("off"), F.col("on") + F.col("off")).alias("off_diagonal"),
    )


def pair_cosine(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row over pairs of vectors: mean, population deviation, p05, p50, p95 of the cosine, and the mean ratio of lengths; pairs with a zero vector don't count."""
    from shardloom.functions.expressions import dot

    rows = pairs.select(dot(F.col(a), F.col(b)).alias("d"), norm(F.col(a)).alias("na"), norm(F.col(b)).alias("nb")).where("na > 0 and nb > 0")
    rows = rows.select((F.col("d") / (F.col("na") * F.col("nb"))).alias("c"), (F.col("na") / F.col("nb")).alias("r"))
    rows = cut(rows)
    plain = rows.agg(F.avg("c").alias("mean"), F.stddev_pop("c").alias("std"), F.avg("r").alias("norm_ratio"), F.count(F.lit(1)).alias("n"))
    return plain.join(percentiles(rows, "c", {"p05": 0.05, "p50": 0.5, "p95": 0.95}), how="left").select("mean", "std", "p05", "p50", "p95", "norm_ratio", "n")


def class_separation(vectors: DataFrame) -> DataFrame:
    """One row over (label, vec): mean distance to the own class's centroid, mean distance between centroids, their ratio and the closest pair; classes with two rows or more."""
    counts = vectors.groupBy("label").agg(F.count(F.lit(1)).alias("n"), mean_vector().alias("centre"))
    centres = if_few(cut(counts.where("n >= 2").select("label", "centre")), 10_000)  # a row per class
    rows = vectors.join(centres, "label")
    away = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y, 2)), F.lit(0.0), lambda s, x: s + x))
    within = rows.groupBy("label").agg(F.avg(away(F.col("vec"), F.col("centre"))).alias("d")).agg(F.avg("d").alias("within"))
    pairs = centres.alias("a").join(centres.alias("b"), F.col("a.label") < F.col("b.label")).select(F.col("a.label").alias("first"), F.col("b.label").alias("second"), away(F.col("a.centre"), F.col("b.centre")).alias("d"))
    between = pairs.agg(F.avg("d").alias("between"), F.min(F.struct("d", "first", "second")).alias("c"))
    return within.crossJoin(between).select("within", "between", ratio(F.col("between"), F.col("within")).alias("separation"), F.col("c.first").alias("closest_a"), F.col("c.second").alias("closest_b"))


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def _softmax(v: Column) -> Column:
    peaked = bind(v, lambda a: bind(F.array_max(a), lambda top: F.transform(a, lambda x: F.exp(x - top))))
    return bind(peaked, lambda e: bind(_sum(e), lambda total: F.transform(e, lambda x: x / total)))


def distribution_loss(rows: DataFrame, group: str = "event_idx") -> DataFrame:
    """One row over (event, is_masked, student, teacher) of logits already divided by their temperatures: means, by row then by
    event, of the cross-entropy, the teacher's and the student's entropy, their difference, and the loss of masked and other rows."""
    p = rows.select(group, "is_masked", _softmax(F.col("student")).alias("s"), _softmax(F.col("teacher")).alias("t"))
    minus = lambda a, b: -F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x > 0, x * F.ln(y)).otherwise(0.0)), F.lit(0.0), lambda acc, x: acc + x)
    per = p.select(group, "is_masked", minus("t", "s").alias("loss"), minus("t", "t").alias("te"), minus("s", "s").alias("se"))
    means = per.groupBy(group).agg(
        F.avg("loss").alias("loss"), F.avg("te").alias("te"), F.avg("se").alias("se"), F.avg(F.when(F.col("is_masked"), F.col("loss"))).alias("lm"), F.avg(F.when(~F.col("is_masked"), F.col("loss"))).alias("lu")
    )
    return means.agg(F.avg("loss").alias("loss"), F.avg("te").alias("teacher_entropy"), F.avg("se").alias("student_entropy"), F.avg(F.col("loss") - F.col("te")).alias("kl"), F.avg("lm").alias("loss_masked"), F.avg("lu").alias("loss_unmasked"))


def sinkhorn(logits: DataFrame, temperature: float, rounds: int, row: str = "row", vec: str = "vec") -> DataFrame:
    """(row, col, p): ``rounds`` times every column, then every row, is brought to equal mass, from exp(logit / temperature); rows sum to 1.

    As a row can be brought to its mass where it is, a round only has to know the factors of the columns: one sum of vectors
    over all rows, of which as many numbers as a row has come to the driver.
    """
    peak = logits.agg(F.max(F.array_max(vec)).cast("double").alias("peak"), F.max(F.size(vec)).alias("cols")).first()
    if peak["peak"] is None:
        return logits.select(row, F.posexplode(F.col(vec).cast("array<double>")).alias("col", "p"))
    kernel = F.transform(vec, lambda x: F.exp((x.cast("double") - peak["peak"]) / temperature))
    n, factors, mass = logits.count(), [1.0] * peak["cols"], kernel
    scaled = lambda f: F.zip_with(kernel, F.array(*map(F.lit, f)), lambda k, c: k * c)
    shares = lambda f: bind(scaled(f), lambda v: bind(_sum(v), lambda total: F.transform(v, lambda x: x / total)))
    for _ in range(rounds):
        sums = logits.agg(vector_to_array(Summarizer.sum(array_to_vector(mass))).alias("s")).first()["s"]
        factors = [f / max(s, 1e-30) / len(sums) for f, s in zip(factors, sums, strict=True)]
        mass = F.transform(shares(factors), lambda x: x / n)
    return logits.select(row, F.posexplode(shares(factors)).alias("col", "p"))


def pairwise_cosine(parts: DataFrame, name: str = "term", coordinate: str = "coord", value: str = "g") -> DataFrame:
    """Per pair of terms with gradients (term, coord, g): cosine (0 without length) and share of coordinates, non-zero in both, of opposite sign."""
    a, b = (parts.select(F.col(name).alias(x), coordinate, F.col(value).alias(f"g_{x}")) for x in ("a", "b"))
    sums = a.join(b, coordinate).where("a < b").groupBy("a", "b")
    both = (F.col("g_a") != 0) & (F.col("g_b") != 0)
    sums = sums.agg(F.sum(F.col("g_a") * F.col("g_b")).alias("dot"), F.avg(F.when(both, (F.col("g_a") * F.col("g_b") < 0).cast("double"))).alias("conflict"))
    norms = parts.groupBy(name).agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("norm"))
    out = sums.join(norms.select(F.col(name).alias("a"), F.col("norm").alias("na")), "a").join(norms.select(F.col(name).alias("b"), F.col("norm").alias("nb")), "b")
    return out.select("a", "b", ratio(F.col("dot"), F.col("na") * F.col("nb")).alias("cosine"), F.coalesce("conflict", F.lit(0.0)).alias("conflict"))


def longest_prefix(names: DataFrame, groups: DataFrame, name: str = "name") -> DataFrame:
    """``names`` with the group of the longest prefix (prefix, grp) that fits, 'other' without. Beginnings of the prefixes' lengths are looked up."""
    lengths = sorted(r[0] for r in groups.select(F.length("prefix")).distinct().collect())  # as many as the longest prefix has characters at most
    begins = F.explode_outer(F.array_distinct(F.array(*[F.substring(name, 1, k) for k in lengths]))) if lengths else F.lit(None).cast("string")
    found = names.select(name, begins.alias("prefix")).join(groups, "prefix", "left").groupBy(name)
    return found.agg(F.coalesce(F.max_by("grp", F.when(F.col("grp").isNotNull(), F.length("prefix"))), F.lit("other")).alias("grp"))


def single_valued(rows: DataFrame, hard: list[str], soft: list[str]) -> DataFrame:
    """Comparability: (axis, n_values, action) for every axis with several values, empty ones apart; 'refuse' for hard axes, 'warn' for soft."""
    axes = [rows.agg(F.count_distinct(F.nullif(F.col(c).cast("string"), F.lit(""))).alias("n_values")).select(F.lit(c).alias("axis"), "n_values", F.lit("refuse" if c in hard else "warn").alias("action")) for c in [*hard, *soft]]
    return reduce(DataFrame.unionByName, axes).where("n_values > 1")


def require_comparable(rows: DataFrame, hard: list[str], soft: list[str]) -> list[str]:
    """Warnings for soft axes; ValueError for a hard one."""
    found = single_valued(rows, hard, soft).collect()
    if bad := [r["axis"] for r in found if r["action"] == "refuse"]:
        raise ValueError(f"not comparable: several values of {', '.join(bad)}")
    return [f"{r['n_values']} values of {r['axis']}" for r in found]


def masked_norm(rows: DataFrame, value: str, group: list[str] | None = None, epsilon: float = 0.0) -> DataFrame:
    """``rows`` with ``z``: the value less the mean of the values that are not null, over their population deviation; null stays null.
    Over all rows, or over each group. The sums of all rows are one row, those of groups are joined as a counted table."""
    stats = rows.groupBy(*(group or [])).agg(F.avg(value).alias("__m"), F.var_pop(value).alias("__s"))
    joined = rows.join(if_few(stats), group) if group else rows.crossJoin(F.broadcast(stats))
    return joined.withColumn("z", F.try_divide(F.col(value) - F.col("__m"), F.sqrt(F.col("__s") + epsilon))).drop("__m", "__s")


def row_norm(vec: Column, epsilon: float = 1e-5) -> Column:
    """A vector less its mean, over its population deviation: the normalisation of each row by itself; null stays null."""
    n = F.size(vec)

    def scaled(v: Column, mean: Column) -> Column:
        var = F.aggregate(v, F.lit(0.0), lambda a, x: a + F.pow(x - mean, 2)) / n
        return bind(F.sqrt(var + epsilon), lambda wide: F.transform(v, lambda x: (x - mean) / wide))

    return bind(F.transform(vec, lambda x: x.cast("double")), lambda v: bind(_sum(v) / n, lambda mean: scaled(v, mean)))
