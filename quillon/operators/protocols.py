"""Steps of evaluation protocols: gates, routing, quotas, pairing, crossed resampling and calibration."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.core import col, hash_order, safe_div

# --- gates ------------------------------------------------------------------


def finite(vec: Column | str) -> Column:
    """Whether an array holds finite numbers only; null where it is null."""
    return F.forall(col(vec), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def guarded(value: Column, enough: Column) -> Column:
    """The value, or null where the prediction is too thin to be scored."""
    return F.when(enough, value)


def drop_reason(checks: Sequence[tuple[Column, str]]) -> Column:
    """The first reason whose condition holds, or 'kept'."""
    out = F.when(checks[0][0], checks[0][1])
    for when, name in checks[1:]:
        out = out.when(when, name)
    return out.otherwise("kept")


def require_share(df: DataFrame, condition: Column, least: float, what: str) -> float:
    """The share of rows that meet a condition; ValueError below the least."""
    share = df.agg(F.coalesce(F.avg(condition.cast("double")), F.lit(0.0))).first()[0]
    if share < least:
        raise ValueError(f"{what}: {share:.3f} is below {least}")
    return share


# --- routing, quotas, order statistics --------------------------------------


def routed(rows: DataFrame, routes: Sequence[tuple[str, Column, int | None]], order: Sequence[Column | str], rest: str = "train", spill: Sequence[str] = ()) -> DataFrame:
    """rows with tier: the first route whose condition holds; beyond its cap rows are dropped, or go to rest where it spills.

    The cap is by the given order within the tier. Rows of no route go to rest.
    """
    first = F.lit(rest)
    for name, when, _ in reversed(routes):
        first = F.when(when, name).otherwise(first)
    caps = {name: cap for name, _, cap in routes if cap is not None}
    placed = rows.withColumn("tier", first).withColumn("_r", F.row_number().over(Window.partitionBy("tier").orderBy(*order)))
    over = F.lit(False)
    for name, cap in caps.items():
        over = over | ((F.col("tier") == name) & (F.col("_r") > cap))
    spills = F.col("tier").isin(*spill) if spill else F.lit(False)
    return placed.withColumn("_over", over).where(~F.col("_over") | spills).withColumn("tier", F.when(F.col("_over"), rest).otherwise(F.col("tier"))).drop("_r", "_over")


def quota_sample(rows: DataFrame, key: str, quotas: DataFrame, seed: str, ident: str) -> DataFrame:
    """key, quota, taken, shortfall of each row of quotas (key, quota), and how many rows its hash-ordered sample takes."""
    taken = rows.groupBy(key).agg(F.count("*").alias("_n"))
    least = F.least(F.coalesce("_n", F.lit(0)), F.col("quota"))
    return quotas.join(taken, key, "left").select(key, "quota", least.alias("taken"), (F.col("quota") - least).alias("shortfall"))


def spaced_ranks(n: Column, k: int) -> Column:
    """array of k evenly spaced ranks from 1 to n, both ends included, halves to even."""
    steps = [F.bround(1 + (n - 1) * F.lit(i / (k - 1))) for i in range(k)]
    return F.array_distinct(F.array(*[s.cast("long") for s in steps]))


def quantile_bin(value: Column | str, edges: Column) -> Column:
    """The bin (from 0) of an array of rising edges that holds the value; the last edge belongs to the last bin."""
    v = col(value)
    inner = F.slice(edges, 2, F.size(edges) - 2)
    return F.size(F.filter(inner, lambda e: e <= v))


def random_pairs(items: DataFrame, ident: str, n: int, tries: int, seed: str, allowed: Column) -> DataFrame:
    """a_ and b_ columns of at most n distinct pairs of items, drawn by hashes, that meet the condition.

    Each draw picks two numbers below the count of items; pairs are never enumerated. items are numbered by hash order, so
    give a table of groups, not of rows.
    """
    numbered = items.withColumn("_i", F.row_number().over(Window.orderBy(hash_order(seed, ident), ident)) - 1)
    size = items.agg(F.count("*").alias("_n"))
    draws = items.sparkSession.range(n * tries).withColumnRenamed("id", "draw").join(F.broadcast(size)).where("_n > 0")
    pick = lambda side: F.pmod(hash_order(seed, F.lit(side), "draw"), F.col("_n"))
    both = draws.withColumn("_a", pick("a")).withColumn("_b", pick("b")).where("_a < _b")
    side = lambda p: numbered.select(*[F.col(c).alias(f"{p}_{c}") for c in items.columns], F.col("_i").cast("long").alias(f"_{p}"))
    found = both.join(side("a"), "_a").join(side("b"), "_b").where(allowed)
    first = found.groupBy(*[f"{p}_{c}" for p in "ab" for c in items.columns], "_a", "_b").agg(F.min("draw").alias("draw"))
    return first.orderBy("draw").limit(n).drop("_a", "_b")


# --- sentences --------------------------------------------------------------


def signed_vector(rows: DataFrame, keys: list[str], panel: DataFrame, k: int, sentence: str = "sentence", down: str = "[DOWN]", end: str = "[END]") -> DataFrame:
    """keys, idx, code of a signed sentence: 1 / log2(r + 1) for the r-th distinct panel token before the mark, less than 0 after it.

    Only the first k of each side count; a token on both sides keeps the first.
    """
    words = F.filter(F.split(sentence, " +"), lambda w: w != "")
    stop = F.array_position(words, end)
    words = F.when(stop > 0, F.slice(words, 1, stop.cast("int") - 1)).otherwise(words)
    toks = rows.select(*keys, F.posexplode(words).alias("pos", "tok"), F.array_position(words, down).alias("mark"))
    side = F.when((F.col("mark") > 0) & (F.col("pos") >= F.col("mark") - 1), -1).otherwise(1)
    first = toks.where(F.col("tok") != down).withColumn("side", side).groupBy(*keys, "tok").agg(F.min(F.struct("pos", "side")).alias("at"))
    on = first.join(F.broadcast(panel), "tok").select(*keys, "idx", "at.pos", "at.side")
    rank = F.row_number().over(Window.partitionBy(*keys, "side").orderBy("pos"))
    return on.withColumn("r", rank).where(F.col("r") <= k).select(*keys, "idx", (F.col("side") / F.log2(F.col("r") + 1)).alias("code"))


# --- nested records ---------------------------------------------------------


def leaves(df: DataFrame) -> list[tuple[str, Column]]:
    """Dotted name and column of every number inside nested structs."""

    def walk(kind: T.DataType, name: str) -> list[str]:
        if isinstance(kind, T.StructType):
            return [x for f in kind.fields for x in walk(f.dataType, f"{name}.{f.name}" if name else f.name)]
        return [name] if isinstance(kind, T.NumericType) else []

    return [(n, F.col(n)) for n in walk(df.schema, "")]


def nested_means(df: DataFrame) -> DataFrame:
    """One row: the mean of every nested number, nulls and NaN passed over, under names with _ for dots."""
    return df.agg(*[F.avg(F.when(~F.isnan(c.cast("double")), c)).alias(n.replace(".", "_")) for n, c in leaves(df)])


def json_records(text: Column, depth: int = 4) -> Column:
    """array<struct<path, effect, p>> of all objects with effect and p within a JSON text, down to a depth of objects."""
    kind = "map<string,string>"
    level = F.array(F.struct(F.lit("").alias("path"), F.from_json(text, kind).alias("node")))
    found = F.array().cast("array<struct<path:string,effect:double,p:double>>")
    for _ in range(depth):
        good = F.filter(level, lambda x: x["node"].isNotNull())
        hits = F.filter(good, lambda x: F.map_contains_key(x["node"], "effect") & F.map_contains_key(x["node"], "p"))
        found = F.concat(found, F.transform(hits, lambda x: F.struct(x["path"].alias("path"), x["node"]["effect"].try_cast("double").alias("effect"), x["node"]["p"].try_cast("double").alias("p"))))
        child = lambda x: F.transform(F.map_entries(x["node"]), lambda e: F.struct(F.concat(x["path"], F.when(x["path"] != "", F.lit(".")).otherwise(""), e["key"]).alias("path"), F.from_json(e["value"], kind).alias("node")))
        level = F.flatten(F.transform(good, child))
    return found


# --- resampling and variance ------------------------------------------------


def poisson_weight(u: Column) -> Column:
    """A Poisson count of mean 1 by inversion at a uniform number."""
    steps = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(12)]
    return sum(F.when(u >= s, 1).otherwise(0) for s in steps)


def unit_hash(seed: str, *parts: Column | str) -> Column:
    return hash_order(seed, *parts) / F.lit(float(2**32))


def crossed_bootstrap(rows: DataFrame, a: str, b: str, value: str, draws: int, seed: str, alpha: float = 0.05) -> DataFrame:
    """n, mean, lo, hi of a mean under two crossed clusterings: a row's weight in a draw is the product of its clusters' counts.

    Rows shrink to sums for each pair of clusters first.
    """
    cells = rows.groupBy(a, b).agg(F.sum(value).alias("_s"), F.count(value).alias("_c"))
    drawn = cells.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    weight = poisson_weight(unit_hash(seed, F.lit("a"), "draw", a)) * poisson_weight(unit_hash(seed, F.lit("b"), "draw", b))
    means = drawn.withColumn("_w", weight).groupBy("draw").agg(safe_div(F.sum(F.col("_w") * F.col("_s")), F.sum(F.col("_w") * F.col("_c"))).alias("m"))
    ends = means.agg(F.percentile("m", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("q"))
    whole = cells.agg(F.sum("_c").alias("n"), (F.sum("_s") / F.sum("_c")).alias("mean"))
    return whole.join(F.broadcast(ends)).select("n", "mean", F.get("q", 0).alias("lo"), F.get("q", 1).alias("hi"))


def multiway_variance(rows: DataFrame, value: str, nodes: str) -> DataFrame:
    """n, mean, variance, df where rows that share any of their nodes depend on each other; one node in all rows gives null.

    The sum over pairs of rows that share a node is taken by inclusion and exclusion over the subsets of a row's nodes,
    for any number of nodes (2^m - 1 subsets of m), so no pairs are formed.
    """
    stats = rows.agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    named = rows.select(F.array_sort(F.array_distinct(nodes)).alias("_k"), F.col(value).alias("_v"))
    e = named.join(F.broadcast(stats)).select("_k", (F.col("_v") - F.col("mean")).alias("_e"))
    masks = F.sequence(F.lit(1), F.pow(F.lit(2), F.size("_k")).cast("int") - 1)
    chosen = e.select("_e", "_k", F.explode(masks).alias("_m")).select("_e", F.filter("_k", lambda x, i: F.floor(F.col("_m") / F.pow(F.lit(2), i)) % 2 == 1).alias("_s"))
    sums = chosen.groupBy("_s").agg(F.sum("_e").alias("_t"), F.count("*").alias("_c"))
    sign = F.when(F.size("_s") % 2 == 1, 1).otherwise(-1)
    whole = sums.agg(F.sum(sign * F.col("_t") * F.col("_t")).alias("v"), F.max(F.when(F.size("_s") == 1, F.col("_c"))).alias("most"), F.count_if(F.size("_s") == 1).alias("g"))
    v = F.when(F.col("most") < F.col("n"), F.col("v") / (F.col("n") * F.col("n")))
    return stats.join(F.broadcast(whole)).select("n", "mean", v.alias("variance"), (F.col("g") - 1).alias("df"))


def range_fraction_test(rows: DataFrame, metric: str, cluster: str, draws: int, seed: str) -> DataFrame:
    """metric, fraction, lo, hi, p: (pos - neg) / (full - neg) of means, its percentile interval and one-sided p.

    rows: metric, cluster, pos, neg, full. Draws weigh clusters by Poisson counts; p is the share of draws that, moved so
    that their centre is 0, reach the fraction, (r + 1) / (n + 1).
    """
    sums = rows.groupBy(metric, cluster).agg(*[F.sum(c).alias(c) for c in ("pos", "neg", "full")])
    ratio = lambda w: safe_div(F.sum(w * (F.col("pos") - F.col("neg"))), F.nullif(F.sum(w * (F.col("full") - F.col("neg"))), F.lit(0.0)))
    drawn = sums.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("_w", poisson_weight(unit_hash(seed, "draw", cluster)))
    each = drawn.groupBy(metric, "draw").agg(ratio(F.col("_w")).alias("f"))
    whole = sums.groupBy(metric).agg(ratio(F.lit(1)).alias("fraction"))
    ends = each.join(whole, metric).groupBy(metric, "fraction").agg(F.percentile("f", F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.count_if(F.col("f") - F.col("fraction") >= F.col("fraction") - 1e-12).alias("r"))
    return ends.select(metric, "fraction", F.get("q", 0).alias("lo"), F.get("q", 1).alias("hi"), ((F.col("r") + 1) / F.lit(draws + 1)).alias("p"))


def two_sided_p(values: Column | str, draws: int) -> Column:
    """Aggregate over bootstrap means: twice the lesser share on either side of 0, at least one draw's share, at most 1."""
    v = col(values)
    return F.least(F.lit(1.0), F.greatest(F.lit(1.0 / draws), 2 * F.least(F.avg((v <= 0).cast("double")), F.avg((v >= 0).cast("double")))))
