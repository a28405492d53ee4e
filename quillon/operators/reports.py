"""Summaries and verdicts over scored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import col, hash_order, safe_div


def interaction_swing(rows: DataFrame, treatment: str, context: str, value: str, least: int = 3) -> DataFrame:
    """treatment, swing (greatest less least mean over contexts), contexts: treatments in enough contexts."""
    by = rows.groupBy(treatment, context).agg(F.avg(value).alias("m"))
    return by.groupBy(treatment).agg((F.max("m") - F.min("m")).alias("swing"), F.count("*").alias("contexts")).where(F.col("contexts") >= least)


def geometry(value: Column | str, thresholds: list[float]) -> list[Column]:
    """Aggregates: n, mean, sd, ends, quartiles, and shares above each threshold."""
    v = col(value)
    out = [F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.min(v).alias("least"), F.max(v).alias("most")]
    out += [F.percentile(v, F.lit(q)).alias(f"q{int(100 * q)}") for q in (0.1, 0.25, 0.5, 0.75, 0.9)]
    return out + [F.avg((v > t).cast("double")).alias(f"above_{i}") for i, t in enumerate(thresholds)]


def banded(value: Column | str, edges: list[float], names: list[str]) -> Column:
    """The name of the half-open band [edge, next) that holds the value; the last band is open above."""
    v = col(value)
    out = F.when(v < edges[0], names[0])
    for e, n in zip(edges[1:], names[1:], strict=False):
        out = out.when(v < e, n)
    return out.when(v.isNotNull(), names[len(edges)])


def range_fraction(pos: Column, neg: Column, full: Column) -> Column:
    """Aggregate: (mean pos - mean neg) / (mean full - mean neg); null where the range is under 1e-6."""
    span = F.avg(full) - F.avg(neg)
    return F.when(F.abs(span) >= 1e-6, safe_div(F.avg(pos) - F.avg(neg), span))


def divergence(p: Column | str, q: Column | str) -> Column:
    """Kullback-Leibler divergence of two arrays of log probabilities."""
    return F.aggregate(F.zip_with(col(p), col(q), lambda a, b: F.exp(a) * (a - b)), F.lit(0.0), lambda s, x: s + x)


def verdict(lo: Column | str, hi: Column | str, margin: float, groups: Column | str, least: int) -> Column:
    """live, equivalent or inconclusive from an interval; untestable with too few groups."""
    return F.when(col(groups) < least, "untestable").when(col(lo) > margin, "live").when(col(hi) < margin, "equivalent").otherwise("inconclusive")


def mismatched_null(rows: DataFrame, group: list[str], ident: str, value: Column, partner: str, draws: int, seed: str) -> DataFrame:
    """group, draw, null: value of each row with a hashed partner row of the same group in place of its own.

    Partners are drawn by number among the group's rows, so the join is on group and number and doesn't expand.
    """
    from pyspark.sql.window import Window

    w = Window.partitionBy(*group).orderBy(hash_order(seed, ident), ident)
    numbered = rows.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*group)))
    wanted = numbered.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("_j", F.pmod(F.col("_i") + 1 + F.pmod(hash_order(seed, F.lit("pick"), "draw", ident), F.greatest(F.lit(1), F.col("_n") - 1)), F.col("_n")))
    other = numbered.select(*group, F.col("_i").cast("long").alias("_j"), F.col(partner).alias("_other"))
    return wanted.where("_n > 1").withColumn("_j", F.col("_j").cast("long")).join(other, [*group, "_j"]).select(*group, ident, "draw", value.alias("null"))
