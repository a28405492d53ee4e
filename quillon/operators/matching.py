"""Joins of rows to controls, dimensions and partners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.core import hash_order


def matched_controls(treated: DataFrame, controls: DataFrame, fine: list[str], coarse: list[str], cap: int, seed: str, ident: str) -> DataFrame:
    """treated with control (an id) and matched: one of the key's first cap controls by hash, or of the coarse key's.

    matched is false where the fine key had no control; rows without any control are dropped. The pick is an index into
    the numbered pool, so the join is on key and number and never expands.
    """

    def pool(keys: list[str], name: str) -> DataFrame:
        r = F.row_number().over(Window.partitionBy(*keys).orderBy(hash_order(seed, ident), ident))
        kept = controls.select(*keys, F.col(ident).alias(name), (r - 1).alias("_i")).where(F.col("_i") < cap)
        return kept

    out = treated
    for keys, name in ((fine, "_near"), (coarse, "_far")):
        p = pool(keys, name)
        size = p.groupBy(*keys).agg(F.count("*").alias("_k"))
        out = out.join(size, keys, "left").withColumn("_i", F.pmod(hash_order(seed + name, ident), F.col("_k"))).join(p.withColumn("_i", F.col("_i").cast("long")), [*keys, "_i"], "left").drop("_k", "_i")
    return out.withColumn("control", F.coalesce("_near", "_far")).withColumn("matched", F.col("_near").isNotNull()).where("control is not null").drop("_near", "_far")


def with_default(rows: DataFrame, dim: DataFrame, on: list[str], value: str, default: str) -> DataFrame:
    """rows with a dimension's value, or the default where it is missing or blank."""
    return rows.join(dim.select(*on, value), on, "left").withColumn(value, F.coalesce(F.nullif(F.trim(value), F.lit("")), F.lit(default)))


def found_join(keys: DataFrame, payload: DataFrame, on: str, value: str) -> DataFrame:
    """keys with value and found; a key without payload stays, with found false."""
    return keys.join(payload.select(on, value), on, "left").withColumn("found", F.col(value).isNotNull())


def pairs_within(rows: DataFrame, group: list[str], ident: str, keep: list[str], condition: Column | None = None) -> DataFrame:
    """Pairs a < b within each group, with columns keep of both sides (a_, b_). Groups are of bounded size."""
    side = lambda p: rows.select(*group, F.col(ident).alias(p), *[F.col(c).alias(f"{p}_{c}") for c in keep])
    out = side("a").join(side("b"), group).where("a < b")
    return out if condition is None else out.where(condition)


def matched_once(rows: DataFrame, pool: DataFrame, group: str, ident: str, value: str) -> DataFrame:
    """group, ident, other, gap: each row in id order takes the nearest pool row of its group that none took before, ties by id.

    Greedy matching without replacement is one pass over a group's sorted pool, so a group is a task's work; a row that
    finds the pool empty has no match. Give groups that fit one task (finer keys where they don't).
    """
    import numpy as np

    kind, key = rows.schema[ident].dataType.simpleString(), rows.schema[group].dataType.simpleString()

    def run(left, right):
        order = right.sort_values(["_value", "_id"])
        values, ids = order["_value"].to_numpy(float), order["_id"].to_numpy()
        n = len(values)
        # Free places are linked; a taken one points on to the next free one on each side (with path halving).
        up, down = np.arange(n + 1), np.arange(n + 1)  # place i of the pool is i + 1 in down, whose 0 is none

        def find(link: np.ndarray, i: int) -> int:
            while link[i] != i:
                link[i] = link[link[i]]
                i = link[i]
            return int(i)

        out = []
        for key_, v in left.sort_values(ident)[[ident, value]].itertuples(index=False):
            at = int(np.searchsorted(values, v))
            hi, lo = find(up, at), find(down, at)
            ends = [(round(abs(values[i] - v), 9), i) for i in (hi, lo - 1) if 0 <= i < n]
            if not ends:
                break
            least = min(d for d, _ in ends)
            best = None
            for _, i in [e for e in ends if e[0] == least]:  # among equal distances, the least id
                j, link = i, (up if i >= at else down)
                while 0 <= j < n and round(abs(values[j] - v), 9) == least:
                    if best is None or ids[j] < ids[best]:
                        best = j
                    j = find(link, j + 1) if link is up else find(link, j) - 1
            up[best], down[best + 1] = best + 1, best
            out.append((left[group].iloc[0], key_, ids[best], abs(values[best] - v)))
        import pandas as pd

        return pd.DataFrame(out, columns=[group, ident, "other", "gap"])

    ours, theirs = rows.select(group, ident, value), pool.select(group, ident, value).toDF("_group", "_id", "_value")
    return ours.groupBy(group).cogroup(theirs.groupBy("_group")).applyInPandas(run, f"{group} {key}, {ident} {kind}, other {kind}, gap double")


def annotated(rows: DataFrame, fine: DataFrame, coarse: DataFrame, fine_on: list[str], coarse_on: list[str], value: str) -> DataFrame:
    """rows with an array value from the fine table, else the coarse one, else empty."""
    kind = fine.schema[value].dataType.simpleString()
    out = rows.join(fine.select(*fine_on, F.col(value).alias("_f")), fine_on, "left").join(coarse.select(*coarse_on, F.col(value).alias("_c")), coarse_on, "left")
    return out.withColumn(value, F.coalesce("_f", "_c", F.array().cast(kind))).drop("_f", "_c")
