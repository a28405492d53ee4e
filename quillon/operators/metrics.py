"""Metrics between predicted, true and control vectors or rankings."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from ..functions.core import col, cosine, distance, safe_div


def _inversions(y: np.ndarray) -> int:
    """Pairs i < j with y[i] > y[j], by halves that are sorted and merged."""
    if len(y) <= 64:
        return int((y[:, None] > y[None, :])[np.triu_indices(len(y), 1)].sum())
    left, right = y[: len(y) // 2], y[len(y) // 2 :]
    across = len(left) - np.searchsorted(np.sort(left), right, "right")
    return _inversions(left) + _inversions(right) + int(across.sum())


def tau_b(x: np.ndarray, y: np.ndarray) -> float | None:
    """Kendall's tau-b by one sort and a count of inversions; None where either is constant."""
    pairs = lambda counts: int((counts * (counts - 1) // 2).sum())
    order = np.lexsort((y, x))
    u, v = x[order], y[order]
    n = len(u) * (len(u) - 1) // 2
    ties_x, ties_y = pairs(np.unique(u, return_counts=True)[1]), pairs(np.unique(v, return_counts=True)[1])
    ties = pairs(np.diff(np.flatnonzero(np.concatenate(([True], (u[1:] != u[:-1]) | (v[1:] != v[:-1]), [True])))))
    root = math.sqrt((n - ties_x) * (n - ties_y))
    return (n - ties_x - ties_y + ties - 2 * _inversions(v)) / root if root else None


@F.pandas_udf(DoubleType())
def kendall_tau(x: pd.Series, y: pd.Series) -> pd.Series:
    """Kendall's tau-b of two arrays of each row; null where either is constant or missing."""
    return pd.Series([None if a is None or b is None or len(a) < 2 else tau_b(np.asarray(a, np.float64), np.asarray(b, np.float64)) for a, b in zip(x, y, strict=True)], dtype="float64")


def partial_correlation(ab: Column, ac: Column, bc: Column) -> Column:
    """Correlation of a and b with c held; null where the root is under 1e-6."""
    root = F.sqrt(F.greatest(F.lit(0.0), (1 - ac * ac) * (1 - bc * bc)))
    return F.when(root >= 1e-6, safe_div(ab - ac * bc, root))


def weighted_r2(pred: Column, true: Column, weight: Column) -> Column:
    """Aggregate: 1 - weighted error over weighted variance of the truth; null where that is flat."""
    w = F.sum(weight)
    spread = F.sum(weight * true * true) - safe_div(F.sum(weight * true) * F.sum(weight * true), w)
    return F.when(spread > 1e-12, 1 - safe_div(F.sum(weight * (true - pred) * (true - pred)), spread))


def identification_rate(own: Column | str, other: Column | str, strict: bool = False) -> Column:
    """Aggregate: share of others that are less similar than one's own; ties count half, or nothing if strict."""
    half = 0.0 if strict else 0.5
    return F.avg(F.when(col(own) > col(other), 1.0).when(col(own) == col(other), half).otherwise(0.0))


def gallery(queries: DataFrame, items: DataFrame, group: list[str], label: str, vec: str, measure: str = "cosine") -> DataFrame:
    """group, label, other, own, sim: each query against its own item and all items of other labels in its group.

    One row for each pair within a group; groups hold a bounded number of labels. measure: cosine, or -distance.
    """
    f = cosine if measure == "cosine" else (lambda a, b: -distance(a, b))
    q = queries.select(*group, F.col(label).alias("_l"), F.col(vec).alias("_q"))
    own = q.join(items.select(*group, F.col(label).alias("_l"), F.col(vec).alias("_o")), [*group, "_l"]).select(*group, "_l", "_q", f("_q", "_o").alias("own"))
    others = items.select(*group, F.col(label).alias("other"), F.col(vec).alias("_v"))
    return own.join(others, group).where("_l <> other").select(*group, F.col("_l").alias(label), "other", "own", f("_q", "_v").alias("sim"))


#: Rows on one side of a block of distances.
DISTANCE_BLOCK = 2048


def energy_distance(rows: DataFrame, group: list[str], side: str, vec: str, ident: str = "id") -> DataFrame:
    """group, energy: 2 E|XY| - E|XX| - E|YY| of sides 0 and 1; means within a side are over pairs i < j, 0 for one row.

    A group's rows are dealt into blocks, each block meets each later one, and only sums of distances leave a task: rows
    are copied once for each block, never paired.
    """
    chosen = rows.select(*group, F.col(side).cast("int").alias("_s"), F.col(ident).cast("string").alias("_i"), F.col(vec).alias("_x"))
    sizes = chosen.groupBy(*group).agg(F.ceil(F.count("*") / DISTANCE_BLOCK).cast("int").alias("_n"))
    dealt = chosen.join(sizes, group).withColumn("_b", F.pmod(F.xxhash64("_i"), F.col("_n").cast("long")).cast("int"))
    left = dealt.withColumn("_c", F.explode(F.sequence(F.col("_b"), F.col("_n") - 1)))
    right = dealt.withColumn("_c", F.col("_b")).withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_c"))))
    keys = [*group, "_b", "_c"]
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in group)
    renamed = right.toDF(*[f"{c}_r" for c in right.columns])

    def sums(a: pa.Table, b: pa.Table) -> pa.Table:
        x, y = (np.array(t.column(n).to_pylist(), np.float64).reshape(t.num_rows, -1) for t, n in ((a, "_x"), (b, "_x_r")))
        s, t = (np.array(c.to_pylist()) for c in (a.column("_s"), b.column("_s_r")))
        d = np.sqrt(np.maximum(0.0, (x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T))
        once = 0.5 if a.num_rows and a.column("_b")[0] == a.column("_c")[0] else 1.0  # a block with itself sees each pair twice
        if once < 1:
            i, j = (np.array(c.to_pylist()) for c in (a.column("_i"), b.column("_i_r")))
            same = i[:, None] == j[None, :]
        else:
            same = np.zeros(d.shape, bool)
        out = a.select(group).slice(0, 1)
        for p, q in ((0, 0), (0, 1), (1, 1)):
            m = ((s[:, None] == p) & (t == q) | (s[:, None] == q) & (t == p)) & ~same
            out = out.append_column(f"d{p}{q}", pa.array([float(once * d[m].sum())])).append_column(f"n{p}{q}", pa.array([float(once * m.sum())]))
        return out

    fields = ", ".join(f"d{p} double, n{p} double" for p in ("00", "01", "11"))
    parts = left.groupBy(*keys).cogroup(renamed.groupBy(*[f"{k}_r" for k in keys])).applyInArrow(sums, f"{kinds}, {fields}")
    mean = lambda p: safe_div(F.sum(f"d{p}"), F.nullif(F.sum(f"n{p}"), F.lit(0.0)))
    energy = 2 * mean("01") - F.coalesce(mean("00"), F.lit(0.0)) - F.coalesce(mean("11"), F.lit(0.0))
    return parts.groupBy(*group).agg(energy.alias("energy"))


def neighbours(rows: DataFrame, others: DataFrame, group: list[str], vec: str, k: int, ident: str = "id", apart: Column | None = None) -> DataFrame:
    """group, ident, other, d, r: the k nearest others of each row in its group by Euclidean distance, ties by id.

    apart: a condition on columns of both sides (others' are prefixed o_) that a neighbour must meet.
    """
    side = others.select(*group, *[F.col(c).alias("o_" + c) for c in others.columns if c not in group])
    pairs = rows.join(side, group)
    if apart is not None:
        pairs = pairs.where(apart)
    d = pairs.select(*group, ident, F.col("o_" + ident).alias("other"), distance(vec, "o_" + vec).alias("d"))
    r = F.row_number().over(Window.partitionBy(*group, ident).orderBy("d", "other"))
    return d.withColumn("r", r).where(F.col("r") <= k)
