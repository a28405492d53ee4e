"""Group means, shifts from controls, leave-one-out generics and residuals of dense rows."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.core import cosine, hash_order, minus, plus, scaled


def mean_vector(vec: Column | str) -> Column:
    """Aggregate: mean of array<double> rows, one buffer for each group and task."""
    v = F.col(vec) if isinstance(vec, str) else vec
    return vector_to_array(Summarizer.mean(array_to_vector(v)))


def sum_vector(vec: Column | str) -> Column:
    v = F.col(vec) if isinstance(vec, str) else vec
    return vector_to_array(Summarizer.sum(array_to_vector(v)))


def halves(rows: DataFrame, group: list[str], ident: str, seed: str) -> DataFrame:
    """Adds half (0 or 1): two equal parts of each group by hash order; the first has the odd row."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(hash_order(seed, ident), ident))
    size = F.count("*").over(Window.partitionBy(*group))
    return rows.withColumn("half", F.when(place <= F.ceil(size / 2), 0).otherwise(1))


def shifts(rows: DataFrame, control: Column, group: list[str], treatment: str, vec: str, ident: str, min_treated: int, min_control: int, seed: str = "half") -> DataFrame:
    """group, treatment, n, n_control, shift, shift_a, shift_b: treated mean less control mean, whole and by halves.

    Groups with too few rows are dropped. A control half that is empty falls back to all controls.
    """
    keyed = rows.withColumn("_c", control)
    treated = halves(keyed.where(~F.col("_c")), [*group, treatment], ident, seed)
    controls = halves(keyed.where("_c"), group, ident, seed)
    part = lambda df, keys: df.groupBy(*keys, "half").agg(mean_vector(vec).alias("m"), F.count("*").alias("k"))

    def whole(df: DataFrame, keys: list[str], prefix: str) -> DataFrame:
        side = lambda h: F.first(F.when(F.col("half") == h, F.col("m")), ignorenulls=True)
        n = lambda h: F.coalesce(F.sum(F.when(F.col("half") == h, F.col("k"))), F.lit(0))
        out = part(df, keys).groupBy(*keys).agg(side(0).alias("a"), side(1).alias("b"), n(0).alias("na"), n(1).alias("nb"))
        total = F.col("na") + F.col("nb")
        m = F.when(F.col("nb") == 0, F.col("a")).otherwise(F.zip_with("a", "b", lambda x, y: (x * F.col("na") + y * F.col("nb")) / total))
        return out.select(*keys, total.alias(f"n_{prefix}"), m.alias(f"m_{prefix}"), F.col("a").alias(f"a_{prefix}"), F.coalesce("b", m).alias(f"b_{prefix}"))

    joined = whole(treated, [*group, treatment], "t").join(whole(controls, group, "c"), group).where((F.col("n_t") >= min_treated) & (F.col("n_c") >= min_control))
    return joined.select(*group, treatment, F.col("n_t").alias("n"), F.col("n_c").alias("n_control"), minus("m_t", "m_c").alias("shift"), minus("a_t", "a_c").alias("shift_a"), minus("b_t", "b_c").alias("shift_b"))


def generic(conditions: DataFrame, fitted: Column, fine: list[str], coarse: list[str], treatment: str, vec: str, min_others: int, shrink: float = 0.0) -> DataFrame:
    """conditions with generic: the mean over other treatments' mean vectors in the same fine group.

    Each treatment weighs the same however many conditions it has, and one's own is left out. With shrinkage the fine
    mean is blended with the coarse group's by n / (n + shrink); without it fewer than min_others other treatments give
    null. Only rows where fitted holds enter any mean.
    """
    at = conditions.where(fitted)

    def level(keys: list[str], name: str) -> tuple[DataFrame, DataFrame]:
        own = at.groupBy(*keys, treatment).agg(mean_vector(vec).alias(f"own_{name}"))
        total = own.groupBy(*keys).agg(sum_vector(f"own_{name}").alias(f"sum_{name}"), F.count("*").alias(f"k_{name}"))
        return own, total

    out = conditions
    for keys, name in ((fine, "f"), (coarse, "c")):
        own, total = level(keys, name)
        out = out.join(total, keys, "left").join(own, [*keys, treatment], "left")
        others = F.col(f"k_{name}") - F.when(F.col(f"own_{name}").isNotNull(), 1).otherwise(0)
        rest = F.when(F.col(f"own_{name}").isNotNull(), minus(f"sum_{name}", f"own_{name}")).otherwise(F.col(f"sum_{name}"))
        out = out.withColumn(f"n_{name}", others).withColumn(f"g_{name}", F.when(others > 0, scaled(rest, 1 / F.nullif(others, F.lit(0)))))
    if shrink > 0:
        w = F.col("n_f") / (F.col("n_f") + F.lit(shrink))
        blend = F.when(F.col("g_f").isNull(), F.col("g_c")).when(F.col("g_c").isNull(), F.col("g_f")).otherwise(plus(scaled("g_f", w), scaled("g_c", 1 - w)))
    else:
        blend = F.when(F.col("n_f") >= min_others, F.col("g_f"))
    drop = [f"{p}_{n}" for p in ("sum", "k", "own", "g") for n in "fc"] + ["n_c"]
    return out.withColumn("generic", blend).withColumnRenamed("n_f", "n_others").drop(*drop)


def residuals(conditions: DataFrame) -> DataFrame:
    """conditions (shift, shift_a, shift_b, generic) with residual and repro_cos, the cosine of its halves."""
    halves_cos = cosine(minus("shift_a", "generic"), minus("shift_b", "generic"))
    return conditions.where("generic is not null").withColumn("residual", minus("shift", "generic")).withColumn("repro_cos", halves_cos)


def reliable(conditions: DataFrame, threshold: float, label: Column, filter_held_out: bool = False) -> DataFrame:
    """Drops unreliable conditions; held-out ones (label not train) are exempt unless asked."""
    return conditions.where((F.col("repro_cos") > threshold) | ((label != "train") & F.lit(not filter_held_out)))


def generic_by_group(conditions: DataFrame, fitted: Column, fine: list[str], coarse: list[str], treatment: str, vec: str, shrink: float = 0.0) -> DataFrame:
    """fine, generic: what to add to a group's control when the treatment is unknown, so none is left out.

    The mean over treatments' mean vectors, blended with the coarse group's as generic() does, so that adding it undoes the
    transform that made the residuals. One row for each fine group; coarse is a part of fine.
    """
    at = conditions.where(fitted)
    level = lambda keys: at.groupBy(*keys, treatment).agg(mean_vector(vec).alias("_m")).groupBy(*keys).agg(mean_vector("_m").alias("_g"), F.count("*").alias("_n"))
    if not shrink:
        return level(fine).select(*fine, F.col("_g").alias("generic"))
    both = level(fine).join(level(coarse).select(*coarse, F.col("_g").alias("_c")), coarse)
    w = F.col("_n") / (F.col("_n") + F.lit(shrink))
    return both.select(*fine, plus(scaled("_g", w), scaled("_c", 1 - w)).alias("generic"))
