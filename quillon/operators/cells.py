"""Sparse rows in long form (entity, feature, value): quality gates, normalisation, ranks and sentences.

Windows are over one entity or group, whose size is bounded by the number of features.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SENTINEL = "[END]"
DOWN = "[DOWN]"


def log_normalised(rows: DataFrame, entity: str = "entity", value: str = "value", scale: float = 1e4) -> DataFrame:
    """Adds lib (the entity's total) and lognorm = log10(1 + value / lib * scale); values that aren't positive are dropped first."""
    held = rows.where(F.col(value) > 0)
    lib = F.sum(value).over(Window.partitionBy(entity))
    return held.withColumn("lib", lib).withColumn("lognorm", F.log10(1 + F.col(value) / F.col("lib") * scale))


def scaled_counts(rows: DataFrame, panel: DataFrame, keys: list[str], entity: str = "entity", value: str = "value", scale: float = 1e4) -> DataFrame:
    """keys, idx, cp: counts per scale on a linear scale, negatives as 0, features that share a place summed."""
    lib = F.sum(F.greatest(F.col(value), F.lit(0.0))).over(Window.partitionBy(entity))
    held = rows.withColumn("_lib", lib).where("_lib > 0")
    return held.join(F.broadcast(panel), "feature").groupBy(*keys, "idx").agg((F.sum(F.greatest(F.col(value), F.lit(0.0)) / F.col("_lib")) * scale).alias("cp")).where("cp > 0")


def gate(rows: DataFrame, panel: DataFrame, min_features: int, min_panel: int, max_marked: float, marked: Column, entity: str = "entity", value: str = "value") -> DataFrame:
    """entity and the first reason why it fails quality control, or 'kept'."""
    on_panel = rows.join(F.broadcast(panel.select("feature", F.lit(1).alias("_on"))), "feature", "left")
    seen = on_panel.where(F.col(value) > 0).groupBy(entity).agg(F.count("*").alias("n"), F.count("_on").alias("n_panel"), F.try_divide(F.sum(F.when(marked, F.col(value)).otherwise(0.0)), F.sum(value)).alias("share"))
    reason = F.when(F.col("n") < min_features, "few features").when(F.col("n_panel") < min_panel, "few panel features").when(F.col("share") > max_marked, "marked share").otherwise("kept")
    return seen.select(entity, reason.alias("reason"))


def joined_in_order(order: list[Column], token: str = "feature", sep: str = " ") -> Column:
    """Aggregate: a group's tokens in the order given, as one string."""
    fields = [o.alias(f"o{i}") for i, o in enumerate(order)]
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*fields, F.col(token).alias("t")))), lambda s: s["t"]), sep)


def sentence(rows: DataFrame, keys: list[str], value: str = "value", limit: int | None = None, sentinel: str = SENTINEL) -> DataFrame:
    """keys, sentence, n: tokens by falling value, ties by idx, with the sentinel last. rows: keys, feature, idx, value."""
    if limit:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(value), "idx"))
        rows = rows.withColumn("_r", rank).where(F.col("_r") <= limit)
    out = rows.groupBy(*keys).agg(joined_in_order([-F.col(value), F.col("idx")]).alias("sentence"), F.count("*").alias("n"))
    return out.withColumn("sentence", F.concat_ws(" ", "sentence", F.lit(sentinel)))


def full_panel(rows: DataFrame, panel: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """keys, feature, idx, value with a 0 row for every panel feature that a group lacks."""
    groups = rows.select(*keys).distinct()
    grid = groups.join(F.broadcast(panel))  # every group meets the panel, a feature list of fixed size
    return grid.join(rows.select(*keys, "feature", value), [*keys, "feature"], "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def signed_sentence(rows: DataFrame, keys: list[str], up: int, down: int, value: str = "value") -> DataFrame:
    """keys, sentence: top positive features, [DOWN], top negative ones, and the sentinel."""
    w = Window.partitionBy(*keys)
    ranked = rows.withColumn("_u", F.row_number().over(w.orderBy(F.desc(value), "idx"))).withColumn("_d", F.row_number().over(w.orderBy(value, "idx")))
    ups = F.when((F.col(value) > 0) & (F.col("_u") <= up), F.struct(F.col("_u").alias("r"), F.col("feature").alias("t")))
    downs = F.when((F.col(value) < 0) & (F.col("_d") <= down), F.struct(F.col("_d").alias("r"), F.col("feature").alias("t")))
    words = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda s: s["t"]), " ")
    out = ranked.groupBy(*keys).agg(words(ups).alias("u"), words(downs).alias("d"))
    return out.select(*keys, F.regexp_replace(F.concat_ws(" ", "u", F.lit(DOWN), "d", F.lit(SENTINEL)), " +", " ").alias("sentence"))


def signed_ranks(rows: DataFrame, keys: list[str], k: int, value: str = "value") -> DataFrame:
    """rows with code: 1 / log2(r + 1) for the k greatest positive values, the negative of it for the k least negative ones, else 0."""
    w = Window.partitionBy(*keys)
    up, down = F.row_number().over(w.orderBy(F.desc(value), "idx")), F.row_number().over(w.orderBy(value, "idx"))
    code = F.when((F.col(value) > 0) & (F.col("_u") <= k), 1 / F.log2(F.col("_u") + 1)).when((F.col(value) < 0) & (F.col("_d") <= k), -1 / F.log2(F.col("_d") + 1)).otherwise(0.0)
    return rows.withColumn("_u", up).withColumn("_d", down).withColumn("code", code).drop("_u", "_d")


def average_rank(value: Column | str, keys: list[str], descending: bool = False) -> Column:
    """Window expression: rank with ties averaged."""
    v = F.col(value) if isinstance(value, str) else value
    w = Window.partitionBy(*keys)
    return F.rank().over(w.orderBy(v.desc() if descending else v)) + (F.count("*").over(Window.partitionBy(*keys, v)) - 1) / 2.0


def value_profile(rows: DataFrame, keys: list[str], kmax: int, value: str = "value") -> DataFrame:
    """rank, mean value of each entity's rank-th greatest value, over entities that have one."""
    r = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(value), "idx"))
    return rows.withColumn("rank", r).where(F.col("rank") <= kmax).groupBy("rank").agg(F.avg(value).alias("level"))


def decoded_order(ranks: DataFrame, profile: DataFrame, all_keys: DataFrame, panel: DataFrame, keys: list[str]) -> DataFrame:
    """keys, idx, level for every panel place: the profile's level at its rank, 0 beyond the profile and for absent places."""
    levels = ranks.join(F.broadcast(profile), "rank").select(*keys, "idx", "level")  # one row for each rank
    grid = all_keys.join(F.broadcast(panel.select("idx")))
    return grid.join(levels, [*keys, "idx"], "left").withColumn("level", F.coalesce("level", F.lit(0.0)))


def group_means(rows: DataFrame, members: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """keys, idx, mean: sums over a group's rows by the group's entity count, for absent values are 0. members: keys, entity."""
    size = members.groupBy(*keys).agg(F.countDistinct("entity").alias("_n"))
    sums = rows.groupBy(*keys, "idx").agg(F.sum(value).alias("_s"))
    return sums.join(size, keys).select(*keys, "idx", (F.col("_s") / F.col("_n")).alias("mean"))


# --- tokens -----------------------------------------------------------------


def tokens(df: DataFrame, keys: list[str], sentence: str = "sentence", stop: str | None = SENTINEL) -> DataFrame:
    """keys, tok, pos (from 1): words of a sentence up to its first sentinel."""
    words = F.split(sentence, " ")
    if stop:
        at = F.array_position(words, stop)
        words = F.when(at > 0, F.slice(words, 1, at.cast("int") - 1)).otherwise(words)
    return df.select(*keys, F.posexplode(words).alias("pos", "tok")).where("tok <> ''").withColumn("pos", (F.col("pos") + 1).cast("long"))


def first_places(toks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, tok, pos: the first place of every distinct token."""
    return toks.groupBy(*keys, "tok").agg(F.min("pos").alias("pos"))


def panel_ranks(first: DataFrame, panel: DataFrame, keys: list[str]) -> DataFrame:
    """keys, tok, idx, pos, rank: panel tokens only, numbered among themselves."""
    r = F.row_number().over(Window.partitionBy(*keys).orderBy("pos")).cast("long")
    return first.join(F.broadcast(panel), "tok").withColumn("rank", r)


def dense_ranks(ranks: DataFrame, all_keys: DataFrame, panel: DataFrame, keys: list[str], mode: str = "position", rank: str = "rank") -> DataFrame:
    """keys, idx, rank for every panel place; absent ones get P + 1 (position), P (tail), active + 1 (zero_bucket) or P // 2 (fixed)."""
    grid = all_keys.join(F.broadcast(panel.select("idx")))
    p = F.count("*").over(Window.partitionBy(*keys))
    active = F.count(rank).over(Window.partitionBy(*keys))
    fill = {"position": p + 1, "tail": p, "zero_bucket": active + 1, "fixed": F.floor(p / 2)}[mode]
    full = grid.join(ranks.select(*keys, "idx", rank), [*keys, "idx"], "left")
    return full.select(*keys, "idx", F.coalesce(F.col(rank), fill).cast("long").alias("rank"))


def consensus(toks: DataFrame, all_keys: DataFrame, group: list[str], entity: str, least_share: float, least_count: int) -> DataFrame:
    """group, sentence, n: tokens by their mean length-normalised place over all sentences of the group.

    A token's score in a sentence is 1 - (r - 1) / L; sentences without it, empty ones too, count 0. Tokens must be in
    max(least_count, round-half-even(least_share * n)) sentences; if none is, all count. As many are kept as the rounded
    median sentence length.
    """
    lengths = toks.groupBy(*group, entity).agg(F.count("*").alias("L"))
    sizes = all_keys.join(lengths, [*group, entity], "left").groupBy(*group).agg(F.count("*").alias("n"), F.percentile(F.coalesce("L", F.lit(0)), F.lit(0.5)).alias("mid"))
    first = first_places(toks, [*group, entity]).join(lengths, [*group, entity])
    scored = first.groupBy(*group, "tok").agg(F.sum(1 - (F.col("pos") - 1) / F.col("L")).alias("s"), F.count("*").alias("seen")).join(sizes, group)
    need = F.greatest(F.lit(least_count), F.bround(F.lit(least_share) * F.col("n")))
    w = Window.partitionBy(*group)
    passing = scored.withColumn("ok", F.col("seen") >= need).withColumn("any_ok", F.max("ok").over(w)).where("ok or not any_ok").withColumn("score", F.round(F.col("s") / F.col("n"), 9))
    top = passing.withColumn("r", F.row_number().over(w.orderBy(F.desc("score"), "tok"))).where(F.col("r") <= F.bround("mid"))
    return top.groupBy(*group).agg(joined_in_order([F.col("r")], "tok").alias("sentence"), F.count("*").alias("n"))
