"""Cluster-robust intervals, resampling by hashes, multiplicity control and small-sample estimators."""

from __future__ import annotations

import functools
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from ..functions.core import hash_order, safe_div
from .sampling import running_total


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        term = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / ((1 + term * d) or tiny)
        c = (1 + term / c) or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


@functools.lru_cache(100_000)
def t_cdf(t: float, df: float) -> float:
    tail = 0.5 * incomplete_beta(df / 2, 0.5, df / (df + t * t))
    return 1 - tail if t > 0 else tail


@functools.lru_cache(100_000)
def t_quantile(p: float, df: float) -> float:
    """Student's t quantile by bisection; the normal one for infinite df."""
    if math.isinf(df):
        from statistics import NormalDist

        return NormalDist().inv_cdf(p)
    lo, hi = -1e3, 1e3
    while t_cdf(lo, df) > p:
        lo *= 10
    while t_cdf(hi, df) < p:
        hi *= 10
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_cdf(mid, df) < p else (lo, mid)
    return (lo + hi) / 2


@F.pandas_udf(DoubleType())
def t_critical(p: pd.Series, df: pd.Series) -> pd.Series:
    """t quantile of each row; null where df is under 1."""
    return pd.Series([t_quantile(q, d) if d is not None and d >= 1 else None for q, d in zip(p, df, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p of a t statistic."""
    return pd.Series([2 * (1 - t_cdf(abs(x), d)) if pd.notna(x) and pd.notna(d) and d > 0 else None for x, d in zip(t, df, strict=True)], dtype="float64")


def two_way_variance(rows: DataFrame, group: list[str], value: str, a: str, b: str) -> DataFrame:
    """group, n, mean, variance, df of a mean under two crossed clusterings: V = Va + Vb - Vab.

    Where V isn't positive the larger one-way variance stands; with one cluster in a clustering, the other alone. Fewer
    than three rows, or one cluster in both, give null.
    """
    stats = rows.groupBy(*group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    e = rows.join(stats, group).withColumn("_e", F.col(value) - F.col("mean"))
    own = e.groupBy(*group).agg(F.sum(F.col("_e") * F.col("_e")).alias("_ss"))
    out = stats.join(own, group)
    for side, name in ((a, "a"), (b, "b")):
        sums = e.groupBy(*group, side).agg(F.sum("_e").alias("_s"))
        out = out.join(sums.groupBy(*group).agg(F.count("*").alias(f"g_{name}"), F.sum(F.col("_s") * F.col("_s")).alias(f"s_{name}")), group)
    n2 = F.col("n") * F.col("n")
    v = {k: F.when(F.col(f"g_{k}") > 1, F.col(f"g_{k}") / (F.col(f"g_{k}") - 1) * F.col(f"s_{k}") / n2) for k in "ab"}
    both = v["a"] + v["b"] - F.col("_ss") / n2
    variance = F.when(both > 0, both).otherwise(F.greatest(v["a"], v["b"]))
    df = F.when(v["a"].isNotNull() & v["b"].isNotNull(), F.least("g_a", "g_b") - 1).when(v["a"].isNotNull(), F.col("g_a") - 1).when(v["b"].isNotNull(), F.col("g_b") - 1)
    return out.select(*group, "n", "mean", F.when(F.col("n") >= 3, variance).alias("variance"), F.when(F.col("n") >= 3, df).alias("df"))


def interval(variances: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Adds lo and hi: mean -+ t * root of the variance."""
    half = t_critical(F.lit(1 - alpha / 2), F.col("df").cast("double")) * F.sqrt("variance")
    return variances.withColumn("_h", half).withColumn("lo", F.col("mean") - F.col("_h")).withColumn("hi", F.col("mean") + F.col("_h")).drop("_h")


def multiway_variance(rows: DataFrame, ident: str, value: str, nodes: str) -> DataFrame:
    """n, mean, variance, df where rows that share any node depend on each other; one node in all rows gives null.

    The sum over pairs of rows that share a node counts each pair once: it is the sum over node sets by inclusion and
    exclusion for two-node rows (dyads), so no pairs are formed. nodes: an array of one or two distinct nodes.
    """
    stats = rows.agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    e = rows.join(F.broadcast(stats)).select(F.array_sort(F.array_distinct(nodes)).alias("_k"), (F.col(value) - F.col("mean")).alias("_e"))
    node = e.select(F.explode("_k").alias("_v"), "_e").groupBy("_v").agg(F.sum("_e").alias("_s"), F.count("*").alias("_c"))
    single = node.agg(F.sum(F.col("_s") * F.col("_s")).alias("one"), F.max("_c").alias("most"), F.count("*").alias("g"))
    double = e.where(F.size("_k") > 1).groupBy("_k").agg(F.sum("_e").alias("_s")).agg(F.coalesce(F.sum(F.col("_s") * F.col("_s")), F.lit(0.0)).alias("two"))
    v = F.when(F.col("most") < F.col("n"), (F.col("one") - F.col("two")) / (F.col("n") * F.col("n")))
    return stats.join(F.broadcast(single)).join(F.broadcast(double)).select("n", "mean", v.alias("variance"), (F.col("g") - 1).alias("df"))


def cluster_bootstrap(rows: DataFrame, cluster: str, value: str, draws: int, seed: str, alpha: float = 0.05) -> DataFrame:
    """n, mean, lo, hi: percentile interval of the mean over hash draws of clusters with replacement.

    Rows shrink to a sum and a count for each cluster first; each draw's weights are sums of Poisson counts, inverted at
    a hash, so a draw needs no order among clusters. Fewer than two clusters give null ends.
    """
    sums = rows.groupBy(cluster).agg(F.sum(value).alias("_s"), F.count(value).alias("_c"))
    u = hash_order(seed, "draw", cluster) / F.lit(float(2**32))
    steps, p, cdf = [], math.exp(-1), 0.0
    for k in range(12):
        cdf += p
        steps.append(cdf)
        p /= k + 1
    weight = sum(F.when(u >= s, 1).otherwise(0) for s in steps)
    replicates = sums.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("_w", weight)
    means = replicates.groupBy("draw").agg(safe_div(F.sum(F.col("_w") * F.col("_s")), F.sum(F.col("_w") * F.col("_c"))).alias("m"))
    ends = means.agg(F.percentile("m", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("q"))
    whole = sums.agg(F.sum("_c").alias("n"), (F.sum("_s") / F.sum("_c")).alias("mean"), F.count("*").alias("_g"))
    return whole.join(F.broadcast(ends)).select("n", "mean", *[F.when(F.col("_g") > 1, F.get("q", i)).alias(name) for i, name in enumerate(("lo", "hi"))])


def sign_flip_p(rows: DataFrame, group: str, value: str, draws: int, seed: str) -> DataFrame:
    """mean, p: share of hashed sign flips of the group means whose mean is at least as far from 0, (r + 1) / (n + 1)."""
    means = rows.groupBy(group).agg(F.avg(value).alias("m"))
    sign = 1 - 2 * (hash_order(seed, "draw", group) % 2)
    flipped = means.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).groupBy("draw").agg(F.avg(sign * F.col("m")).alias("f"))
    whole = means.agg(F.avg("m").alias("mean"))
    return flipped.join(F.broadcast(whole)).groupBy("mean").agg(((F.count_if(F.abs("f") >= F.abs("mean") - 1e-12) + 1) / F.lit(draws + 1)).alias("p"))


def adjusted(rows: DataFrame, p: str, family: list[str], ident: str) -> DataFrame:
    """rows with holm and bh, the step-down and step-up adjusted p of each family."""
    w = Window.partitionBy(*family).orderBy(p, ident)
    n = F.count("*").over(Window.partitionBy(*family))
    ranked = rows.withColumn("_r", F.row_number().over(w)).withColumn("_n", n)
    down = F.max((F.col("_n") - F.col("_r") + 1) * F.col(p)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    up = F.min(F.col("_n") * F.col(p) / F.col("_r")).over(w.rowsBetween(0, Window.unboundedFollowing))
    return ranked.withColumn("holm", F.least(F.lit(1.0), down)).withColumn("bh", F.least(F.lit(1.0), up)).drop("_r", "_n")


def welch(rows: DataFrame, keys: list[str], side: Column, value: str) -> DataFrame:
    """keys, t, df: Welch's statistic of the side's rows against the others; null for fewer than two rows or no variance."""
    a, b = F.when(side, F.col(value)), F.when(~side, F.col(value))
    s = rows.groupBy(*keys).agg(F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.var_samp(a).alias("va"), F.var_samp(b).alias("vb"), F.count(a).alias("na"), F.count(b).alias("nb"))
    ea, eb = safe_div("va", "na"), safe_div("vb", "nb")
    ok = (F.col("na") > 1) & (F.col("nb") > 1) & (ea + eb > 1e-15)
    df = safe_div((ea + eb) * (ea + eb), safe_div(ea * ea, F.col("na") - 1) + safe_div(eb * eb, F.col("nb") - 1))
    return s.select(*keys, F.when(ok, (F.col("ma") - F.col("mb")) / F.sqrt(ea + eb)).alias("t"), F.when(ok, df).alias("df"))


def cohens_d(side: Column, value: Column) -> Column:
    """Aggregate: standardised mean difference with pooled variance."""
    a, b = F.when(side, value), F.when(~side, value)
    na, nb = F.count(a), F.count(b)
    pooled = safe_div((na - 1) * F.var_samp(a) + (nb - 1) * F.var_samp(b), F.nullif(na + nb - 2, F.lit(0)))
    return F.when(pooled > 1e-15, (F.avg(a) - F.avg(b)) / F.sqrt(pooled))


def signed_rank(rows: DataFrame, ident: str, diff: str) -> DataFrame:
    """n, w_plus: Wilcoxon's statistic of nonzero differences, ties averaged; ranks come from running totals of the counts of sizes."""
    nz = rows.where(F.col(diff) != 0).select(F.abs(diff).alias("_a"), (F.col(diff) > 0).alias("_p"))
    sizes = nz.groupBy("_a").agg(F.count("*").alias("_c"), F.count_if("_p").alias("_k"))
    ranked = running_total(sizes, "_a", "_c", "_upto").withColumn("_rank", F.col("_upto") - F.col("_c") + (F.col("_c") + 1) / 2.0)
    return ranked.agg(F.sum("_c").alias("n"), F.sum(F.col("_k") * F.col("_rank")).alias("w_plus"))
