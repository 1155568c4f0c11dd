"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame operations only.

Every source gets a target of words; it is met by whole epochs of the source and one weighted sample of it. For the
sample each document has the key u ** (1 / weight), u uniform from a hash of its id, and documents are taken from the
largest key on until one would pass the words of the sample. From there on documents that still fit are taken in the same
order, ROUNDS times in all, and at last the one that brings the sum nearest. The running sums that this needs go down three
levels of key ranges, so no task sorts a source: a level sums the words in 1024 ranges of keys, finds the range in which the
sample ends, and leaves only that range's documents to the next level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardloom.llm.common import cut, n_words

#: Weights of the sources in the order of their names.
WEIGHTS = (5, 2, 1)
#: A source is used at most so many times.
MOST_EPOCHS = 3
RANGES, LEVELS = 1024, 2
#: Runs of documents down the keys: the first, and those of documents that still fit after it.
ROUNDS = 3


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """``target`` (double) for rows ``(source, source_size)``: the words that the mix takes of each source.

    Sources by code point, null last, weigh ``weights``, repeated, and share the sum of all sizes; a target stops at
    ``most`` times the source's size and the rest is shared by weight until none is above. That is the level L at which
    the sum of least(most * size, L * weight) is the sum of all sizes. One row per source is all that one task sees.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight.cast("long")).withColumn("most", F.col("source_size") * most)
    order = Window.orderBy((F.col("most") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0))).cast("double") / F.sum("weight").over(after)
    rows = rows.withColumn("level", level)
    free = F.col("level") * F.col("weight") <= F.col("most")
    rows = rows.withColumn("level", F.min(F.when(free, F.struct((F.col("most") / F.col("weight")).alias("at"), "source", "level"))).over(whole)["level"])
    target = F.least(F.col("most").cast("double"), F.col("level") * F.col("weight"))
    return rows.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def quality_weight(text: Column, size: Column) -> Column:
    """Sampling weight of a document from 1 to 5: one more for 20 words or more, for a symbol in less than a tenth and in less
    than a fiftieth of the words, and for a mean of 3 to 12 characters a word with its blank."""
    symbols, chars = F.length(text) - F.length(F.translate(text, "#*$%&|<>", "")), F.length(text)
    rules = (size >= 20, symbols * 10 < size, symbols * 50 < size, (chars > size * 3) & (chars < size * 12))
    return sum((F.coalesce(r, F.lit(False)).cast("int") for r in rules), F.lit(1))


def sampling_key(doc_id: Column, weight: Column) -> Column:
    """u ** (1 / weight), below 1, u in (0, 1) from the md5 of the id; null ids count as an empty one."""
    digits = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 13)
    u = (F.conv(digits, 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)
    return F.when(weight == 1, u).otherwise(F.least(F.pow(u, 1 / weight), F.lit(1 - 2.0**-53)))


def _by_source(df: DataFrame) -> DataFrame:
    """A table of a row per source, broadcast if that is few; the rows of a large source then stay where they are."""
    return F.broadcast(df) if df.limit(10_001).count() <= 10_000 else df


def _narrow(docs: DataFrame, quality: Column | None) -> DataFrame:
    size = n_words(F.col("text"))
    weight = quality_weight(F.col("text"), size) if quality is None else F.greatest(F.coalesce(quality.cast("double"), F.lit(0.0)), F.lit(1e-6))
    rows = docs.withColumns({"__size": size, "__weight": weight})
    return rows.withColumn("__unit", F.struct(sampling_key(F.col("doc_id"), F.col("__weight")).alias("key"), F.col("doc_id").alias("id"), F.col("__size").alias("size")))


def _run(units: DataFrame, goals: DataFrame) -> DataFrame:
    """Of each source (sid, rest) the first unit, down the order of units, that would pass the words ``rest``: ``last``, null if
    none would; and the ``rest`` that is left before it. Sums go down the levels of key ranges."""
    sums = [F.max(F.when(F.col("sum") <= F.col("rest"), F.col("sum"))).alias("had"), F.max(F.when(F.col("sum") > F.col("rest"), F.col("at"))).alias("at")]
    key, rest = F.col("unit.key"), F.col("rest") - F.coalesce("had", F.lit(0))
    state = cut(goals.select("sid", "rest", F.lit(0.0).alias("low")))
    for level in range(LEVELS + 1):
        width = float(RANGES) ** -(level + 1)
        inside = units.join(_by_source(state.where("low is not null")), "sid").where((key >= F.col("low")) & (key < F.col("low") + RANGES * width))
        if level < LEVELS:
            part = inside.groupBy("sid", "rest", F.floor((key - F.col("low")) / width).alias("at")).agg(F.sum("words").alias("words"))
            part = part.withColumn("sum", F.sum("words").over(Window.partitionBy("sid").orderBy(F.desc("at"))))
        else:
            part = inside.select("sid", "rest", F.col("unit").alias("at"), F.sum("words").over(Window.partitionBy("sid").orderBy(F.desc("unit"))).alias("sum"))
        found = state.join(part.groupBy("sid").agg(*sums), "sid", "left")
        state = cut(found.select("sid", rest.alias("rest"), (F.col("low") + F.col("at") * width).alias("low") if level < LEVELS else F.col("at").alias("last")))
    return state


def _taken(unit: Column) -> Column:
    """Whether a run has taken a unit: in run r it fits what the runs before have left, lies after their ends and before its own."""
    out, before = F.lit(False), F.lit(True)
    for r in range(1, ROUNDS + 1):
        last = F.col(f"last{r}")
        out = out | (before & (unit["size"] <= F.col(f"rest{r - 1}")) & (last.isNull() | (unit > last)))
        before = before & (unit <= last)
    return F.coalesce(out, F.lit(False))


def _ends(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """Where each source's sample ends: ``(sid, rest0, last1, rest1, .., extra)``, see ``_taken``.

    ``rows``: sid, unit (key, id, size; size over 0). ``goals``: sid, goal (words of the sample, less than the source
    has). ``extra``: one more unit, the one of which the size is nearest to what the runs leave, if that brings the sum nearer
    to the goal. Equal units count as one.
    """
    units = cut(rows.groupBy("sid", "unit").agg(F.sum("unit.size").alias("words")))
    state = cut(goals.select("sid", F.col("goal").alias("rest0")))
    for r in range(1, ROUNDS + 1):
        fits = units.where("true") if r == 1 else units.join(_by_source(state.select("sid", F.col(f"rest{r - 1}").alias("most"), F.col(f"last{r - 1}").alias("end"))), "sid")
        fits = fits if r == 1 else fits.where((F.col("unit.size") <= F.col("most")) & (F.col("unit") <= F.col("end"))).drop("most", "end")
        # sources of which nothing more can fit have no more rows in ``fits``: their rest stays, their end is null
        run = _run(fits, state.select("sid", F.col(f"rest{r - 1}").alias("rest")))
        state = cut(state.join(run.select("sid", F.col("last").alias(f"last{r}"), F.col("rest").alias(f"rest{r}")), "sid", "left"))
    miss = F.abs(F.col("words") - F.col(f"rest{ROUNDS}"))
    spare = units.join(_by_source(state), "sid").where(~_taken(F.col("unit")) & (miss < F.col(f"rest{ROUNDS}")))
    extra = spare.groupBy("sid").agg(F.min(F.struct(miss.alias("miss"), "unit"))["unit"].alias("extra"))
    return state.join(extra, "sid", "left")


def _copies(rows: DataFrame, columns: list[str], weights: tuple[int, ...], most: int) -> DataFrame:
    """``rows`` (of ``_narrow``) with ``source_size``, ``target`` and ``copies``, how often the mix takes the row."""
    sizes = cut(rows.groupBy("source").agg(F.sum("__size").alias("source_size")))
    goals = targets(sizes, weights, most).withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    epochs = F.floor(F.try_divide("target", "source_size"))
    goals = goals.withColumn("epochs", F.coalesce(epochs, F.lit(0)).cast("int"))
    goals = goals.withColumn("goal", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    whole = (F.col("source_size") > 0) & (F.col("goal") >= F.col("source_size"))  # rounded up to one more epoch
    goals = cut(goals.withColumns({"epochs": F.col("epochs") + whole.cast("int"), "goal": F.when(whole, 0).otherwise(F.col("goal"))}))
    same = F.col("source").eqNullSafe(F.col("__source"))
    parts = rows.where("__size > 0").join(_by_source(goals.select(F.col("source").alias("__source"), "sid")), same).select("sid", F.col("__unit").alias("unit"))
    ends = cut(_ends(parts, goals.where("source_size > 0").select("sid", "goal")))
    own = _by_source(cut(goals.withColumnRenamed("source", "__source").join(ends, "sid", "left").drop("sid")))
    sampled = _taken(F.col("__unit")) | F.coalesce(F.col("__unit") == F.col("extra"), F.lit(False))
    copies = F.when(F.col("__size") > 0, F.col("epochs") + sampled.cast("int")).otherwise(0)
    return rows.join(own, same, "left").select(*columns, "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS, quality: Column | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, source): doc_id, size, source_size, target, taken.

    ``taken`` is ``size`` times the row's uses. A null text, or one without words, has size 0 and is never taken; a
    null source is a source of its own; a null id counts as an empty one for the key. Rows equal in id, size and source
    are taken together. An empty table gives no rows. Draws depend on ids and texts alone, so reruns agree. ``quality``: a
    column of ``docs`` with the weights of documents, such as the posterior of the quality rules; without it they come from
    ``quality_weight``. Other columns don't matter whatever their names, texts are counted whole however long.
    """
    rows = cut(_narrow(docs, quality).select("doc_id", "source", "__size", "__unit"))
    out = _copies(rows, ["doc_id", "__size"], weights, most)
    return out.select("doc_id", F.col("__size").alias("size"), "source_size", "target", (F.col("__size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS, quality: Column | None = None) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with the columns of ``docs``; see ``mix``."""
    names = {c: f"__in_{i}" for i, c in enumerate(docs.columns)}
    fixed = ("doc_id", "text", "source")
    given = [] if quality is None else [quality.alias("__quality")]
    inner = docs.select(*fixed, *[F.col(c).alias(n) for c, n in names.items() if c not in fixed], *given)
    kept = [n for c, n in names.items() if c not in fixed]
    out = _copies(_narrow(inner, F.col("__quality") if given else None), [*fixed, *kept], weights, most).where("copies > 0")
    out = out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select(*[F.col(names[c] if c not in fixed else c).alias(c) for c in docs.columns])
