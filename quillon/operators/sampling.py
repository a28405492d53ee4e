"""Caps, hash-ordered choices, coverage stops and leak-free splits. Nothing is random: all choices order by hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.core import hash_order


def first_per_key(rows: DataFrame, keys: list[str], k: int | Column, order: list[str | Column]) -> DataFrame:
    """The first k rows of each key in the given order."""
    r = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_r", r).where(F.col("_r") <= (F.lit(k) if isinstance(k, int) else k)).drop("_r")


def round_robin(rows: DataFrame, key: str, n: int, seed: str, ident: str) -> DataFrame:
    """n rows taken from the keys in turn, within a key by hash order."""
    r = F.row_number().over(Window.partitionBy(key).orderBy(hash_order(seed, ident), ident))
    return rows.withColumn("_r", r).where(F.col("_r") <= n).orderBy("_r", key).limit(n).drop("_r")


def equalised(rows: DataFrame, outer: list[str], inner: list[str], seed: str, ident: str) -> DataFrame:
    """Every inner group cut by hash order to the least inner group's size within its outer group."""
    sizes = rows.groupBy(*outer, *inner).agg(F.count("*").alias("_n"))
    least = sizes.groupBy(*outer).agg(F.min("_n").alias("_k"))
    return first_per_key(rows.join(least, outer), [*outer, *inner], F.col("_k"), [hash_order(seed, ident), ident]).drop("_k")


def middle_value(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """key, middle: the element at half the size of each key's sorted distinct values, for keys with three at least."""
    v = F.array_sort(F.collect_set(value))
    return rows.groupBy(*key).agg(v.alias("v")).where(F.size("v") >= 3).select(*key, F.element_at("v", (F.floor(F.size("v") / 2) + 1).cast("int")).alias("middle"))


def running_total(rows: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """rows with the sum of value over all rows up to one's own in order (equal ones together).

    Rows are cut at quantiles of order into at most 257 ranges; each is summed up by itself from the total of those before
    it, so no task orders the whole table. Any cuts give the same sums.
    """
    edges = rows.agg(F.array_distinct(F.percentile_approx(order, F.array(*[F.lit(i / 256) for i in range(1, 256)]), F.lit(2000))).alias("_e"))  # one row
    ranged = rows.join(F.broadcast(edges)).withColumn("_p", F.size(F.filter("_e", lambda e: e < F.col(order)))).drop("_e")
    totals = ranged.groupBy("_p").agg(F.sum(value).alias("_t"))
    before = totals.select("_p", (F.sum("_t").over(Window.orderBy("_p")) - F.col("_t")).alias("_before"))  # at most 257 rows
    own = F.sum(value).over(Window.partitionBy("_p").orderBy(order))
    return ranged.join(F.broadcast(before), "_p").withColumn(out, F.col("_before") + own).drop("_p", "_before")


def coverage_stop(rows: DataFrame, key: list[str], order: str, share: float) -> DataFrame:
    """order and covered of the earliest row by which the given share of keys (rounded up) has been seen.

    First sightings alone are counted, one for each key.
    """
    first = rows.groupBy(*key).agg(F.min(order).alias("at"))
    steps = first.groupBy("at").agg(F.count("*").alias("n"))
    total = steps.agg(F.sum("n").alias("total"))
    seen = running_total(steps, "at", "n", "covered").join(F.broadcast(total))
    return seen.where(F.col("covered") >= F.ceil(F.col("total") * share)).agg(F.min("at").alias("stop_at"), F.min("covered").alias("covered"), F.first("total").alias("total"))


def holdout(conditions: DataFrame, treatment: str, context: str, unseen_treatments: float, unseen_pairs: float, min_contexts: int, seed: str) -> DataFrame:
    """conditions with split: unseen_treatment, unseen_pair or train.

    A share of treatments goes whole, in hash order; of the rest a share of (treatment, context) pairs, of treatments that
    are in min_contexts contexts at least.
    """
    pairs = conditions.select(treatment, context).distinct()
    drugs = pairs.groupBy(treatment).agg(F.count("*").alias("_m"))
    w = Window.orderBy(hash_order(seed + "-t", treatment), treatment)  # one row for each treatment
    drugs = drugs.withColumn("_unseen", F.row_number().over(w) <= F.floor(F.count("*").over(Window.partitionBy()) * unseen_treatments))
    # A uniform number for each pair, so that no global ranking of pairs is needed.
    cut = int(unseen_pairs * 2**32)
    label = F.when(F.col("_unseen"), "unseen_treatment").when((F.col("_m") >= min_contexts) & (hash_order(seed + "-p", treatment, context) < cut), "unseen_pair").otherwise("train")
    return conditions.join(drugs, treatment).withColumn("split", label).drop("_m", "_unseen")


def worst_label(conditions: DataFrame, unit: str, label: str, order: list[str]) -> DataFrame:
    """conditions whose label is the worst (last in order) of any condition of the unit."""
    rank = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(label))
    worst = conditions.groupBy(unit).agg(F.max(rank).alias("_w"))
    return conditions.join(worst, unit).withColumn(label, F.element_at(F.array(*[F.lit(x) for x in order]), F.col("_w").cast("int"))).drop("_w")


def unit_holdout(units: DataFrame, treatment: str, unit: str, share: float, seed: str) -> DataFrame:
    """treatment, unit, held: units held out by hash order, never the last unit of a treatment, share of all units at most."""
    place = F.row_number().over(Window.partitionBy(treatment).orderBy(hash_order(seed, treatment, unit), unit))
    sized = units.select(treatment, unit).distinct().withColumn("_r", place).withColumn("_n", F.count("*").over(Window.partitionBy(treatment)))
    return sized.withColumn("held", (F.col("_r") < F.col("_n")) & (hash_order(seed + "-u", treatment, unit) < int(share * 2**32))).select(treatment, unit, "held")


def filled_draw(rows: DataFrame, keys: list[str], n: int, seed: str, ident: str) -> DataFrame:
    """keys, ident, draw: n draws for each key in hash order, going round again where a key has fewer rows."""
    r = F.row_number().over(Window.partitionBy(*keys).orderBy(hash_order(seed, ident), ident))
    size = F.count("*").over(Window.partitionBy(*keys))
    top = F.floor((F.lit(n) - F.col("_r")) / F.col("_n"))
    placed = rows.withColumn("_r", r).withColumn("_n", size).where(F.col("_r") <= n)
    return placed.select(*keys, ident, F.explode(F.transform(F.sequence(F.lit(0).cast("long"), top), lambda i: F.col("_r") + i * F.col("_n"))).alias("draw"))
