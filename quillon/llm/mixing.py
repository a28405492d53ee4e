"""Mixing sources to target weights by Poisson replication.

Every source has a mean repetition rate, its target share over its own share of the characters. A document's count is
found by inverting the source's Poisson distribution at a uniform number that a hash of its id and the seed gives; the
document is exploded by that count, and all copies are put in the order of another hash. All of it is DataFrame code, and
the same seed gives the same mixture on any cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, only, place, places, small

#: Uniform numbers and distribution steps are whole numbers of 2^-40.
UNIT_BITS = 40


def unit(*parts: Column | str) -> Column:
    """A whole number below 2^40 from the md5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, UNIT_BITS // 4), 16, 10).cast("long")


def rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, text_col: str = "text", source_col: str = "source") -> DataFrame:
    """source, chars, weight, rate (in millionths): the mean number of copies of the source's documents.

    weights: target share of the characters for each source (others get none; they are scaled to sum 1); without them a
    source's share is in proportion to its characters to the power of temperature. The mixture is as large as the input
    in the mean. A source without characters has rate 0. A null source counts as ''.
    """
    named = only(docs, text_col, source_col).toDF("text", "source")
    chars = named.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"))
    if weights is None:
        raw = F.pow(F.col("chars").cast("double"), F.lit(temperature))
    else:
        raw = F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("source")].cast("double"), F.lit(0.0)) if weights else F.lit(0.0)
    chars = materialise(chars.withColumn("raw", raw), "sources")
    total = chars.agg(F.sum("chars").alias("all_chars"), F.sum(F.when(F.col("chars") > 0, F.col("raw"))).alias("all_raw"))
    weight = F.try_divide(F.when(F.col("chars") > 0, F.col("raw")), F.col("all_raw"))
    return chars.join(F.broadcast(total)).select(  # one row of totals
        "source", "chars", F.coalesce(weight, F.lit(0.0)).alias("weight"),
        F.coalesce(F.round(F.try_divide(weight * F.col("all_chars"), F.col("chars")) * 1e6), F.lit(0.0)).cast("long").alias("rate"),
    )


def poisson_steps(rate: Column) -> Column:
    """The distribution function at 0, 1, 2, ... in units of 2^-40, up to where the rest is below one unit.

    A document's count is how many of these are not above its uniform number.
    """
    mean = rate / F.lit(1e6)
    last = F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int")
    start = F.struct((-mean).alias("logp"), F.exp(-mean).alias("cdf"), F.array(F.round(F.exp(-mean) * F.lit(float(2**UNIT_BITS))).cast("long")).alias("steps"))

    def step(acc: Column, k: Column) -> Column:
        logp = acc["logp"] + F.ln(mean) - F.ln(k.cast("double"))
        cdf = acc["cdf"] + F.exp(logp)
        return F.struct(logp.alias("logp"), cdf.alias("cdf"), F.concat(acc["steps"], F.array(F.round(cdf * F.lit(float(2**UNIT_BITS))).cast("long"))).alias("steps"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), last), start, step)["steps"]).otherwise(F.array(F.lit(2**UNIT_BITS)))


def replicate(docs: DataFrame, seed: str = "mix-1", weights: dict[str, float] | None = None, temperature: float = 0.5, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with each row repeated by its Poisson count, in hashed order; adds _replica (from 1) and _order.

    Rows with a null id share one uniform number; repeated ids get equal counts. Null and empty texts add no characters
    but are repeated as their source is. Empty tables give none. All columns of docs are kept, whatever their names; only
    columns already named _replica or _order give way to the new ones.
    """
    found = rates(docs, weights, temperature, text_col, source_col).select(F.col("source").alias("source"), poisson_steps(F.col("rate")).alias("steps"))
    ident = F.coalesce(F.col(place(docs, id_col)).cast("string"), F.lit(""))
    keyed = places(docs).withColumn("source", F.coalesce(place(docs, source_col), F.lit("")))
    counted = keyed.join(small(materialise(found, "steps")), "source").withColumn("u", unit(F.lit(seed), ident))
    many = counted.withColumn("copies", F.size(F.filter("steps", lambda s: s <= F.col("u")))).where("copies > 0").withColumn("replica", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    order = F.md5(F.concat_ws(":", F.lit(seed), ident, F.col("replica").cast("string")).cast("binary"))
    shown = [(f"_{i}", n) for i, n in enumerate(docs.columns) if n not in ("_replica", "_order")]
    ranked = many.withColumn("order", order).drop("steps", "source", "u", "copies").orderBy("order", place(docs, id_col))
    return ranked.select(*[F.col(c).alias(n) for c, n in shown], F.col("replica").alias("_replica"), F.col("order").alias("_order"))


ORACLE = """
WITH RECURSIVE s AS (
  SELECT coalesce(source, '') AS source, sum(length(coalesce(text, ''))) AS chars FROM documents GROUP BY 1),
w AS (
  SELECT source, chars, sqrt(chars::DOUBLE) / sum(CASE WHEN chars > 0 THEN sqrt(chars::DOUBLE) END) OVER () AS weight, sum(chars) OVER () AS all_chars FROM s),
r AS (
  SELECT source, CASE WHEN chars > 0 THEN round(weight * all_chars / chars * 1e6) ELSE 0 END / 1e6 AS mean FROM w),
steps(source, mean, k, logp, cdf) AS (
  SELECT source, mean, 0, -mean, exp(-mean) FROM r WHERE mean > 0
  UNION ALL
  SELECT source, mean, k + 1, logp + ln(mean) - ln(k + 1), cdf + exp(logp + ln(mean) - ln(k + 1)) FROM steps
  WHERE k < ceil(mean + 12 * sqrt(mean) + 30)),
cuts AS (SELECT source, list(round(cdf * 1099511627776)::BIGINT) AS cuts FROM steps GROUP BY source),
c AS (
  SELECT d.doc_id, d.source, len(list_filter(cuts.cuts, lambda x: x <= ('0x' || substr(md5('mix-1:' || d.doc_id), 1, 10))::BIGINT)) AS n
  FROM documents d JOIN cuts ON cuts.source = coalesce(d.source, ''))
SELECT doc_id, source, replica, md5('mix-1:' || doc_id || ':' || replica) AS shuffle_key
FROM (SELECT doc_id, source, unnest(range(1, n + 1)) AS replica FROM c WHERE n > 0)
"""
