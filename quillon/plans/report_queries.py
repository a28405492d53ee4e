"""Queries of summaries, verdicts, lookups and compositions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.core import corr_agg, cosine, distance, hash_order, minus, norm, r6
from ..operators import reports as RP
from ..operators import residuals as R
from . import bindings as B
from .base import query
from .inference_queries import TWO, VALUE, _scores
from .vector_queries import CT, GEN, HALF, MEAN, ML, NIR, _means, _residuals, _sides


@query("agg34_interaction_swing", "SELECT treatment, round(max(m) - min(m), 6) AS swing, count(*) AS contexts FROM (SELECT treatment, context, avg(value) AS m FROM sc GROUP BY ALL) GROUP BY treatment HAVING count(*) >= 3", B.VEC, VALUE)
def _(spark, sf):
    return RP.interaction_swing(_scores(spark, sf), "treatment", "context", "value").select("treatment", r6("swing").alias("swing"), "contexts")


@query("agg36_diversity_counters", "SELECT count(*) AS n, count(DISTINCT treatment) AS treatments, count(DISTINCT (treatment, context)) AS conditions, round(count(*) / count(DISTINCT (treatment, context))::DOUBLE, 6) AS per_condition FROM vec", B.VEC)
def _(spark, sf):
    pair = F.countDistinct("treatment", "context")
    return B.vectors(spark, sf).agg(F.count("*").alias("n"), F.countDistinct("treatment").alias("treatments"), pair.alias("conditions"), r6(F.count("*") / pair).alias("per_condition"))


@query(
    "agg41_output_geometry",
    "SELECT context, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(min(value), 6) AS least, round(max(value), 6) AS most, round(quantile_cont(value, 0.1), 6) AS q10, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.75), 6) AS q75, round(quantile_cont(value, 0.9), 6) AS q90, round(avg((value > 0)::INT), 6) AS above_0, round(avg((value > 0.1)::INT), 6) AS above_1 FROM sc GROUP BY context",
    B.VEC, VALUE,
)
def _(spark, sf):
    out = _scores(spark, sf).groupBy("context").agg(*RP.geometry("value", [0.0, 0.1]))
    return out.select("context", "n", *[r6(c).alias(c) for c in out.columns[2:]])


@query("agg42_banded_table", "SELECT band, count(*) AS n, round(avg(nir), 6) AS nir FROM (SELECT nir, CASE WHEN nir < 0.4 THEN 'low' WHEN nir < 0.6 THEN 'middle' ELSE 'high' END AS band FROM (SELECT context, treatment, avg(CASE WHEN own > sim THEN 1 WHEN own = sim THEN 0.5 ELSE 0 END) AS nir FROM nr GROUP BY ALL)) GROUP BY band", B.VEC, HALF, GEN, NIR)
def _(spark, sf):
    from ..operators import metrics as M

    a, b = _sides(spark, sf)
    rate = M.gallery(a, b, ["context"], "treatment", "v").groupBy(*CT).agg(M.identification_rate("own", "sim").alias("nir"))
    return rate.groupBy(RP.banded("nir", [0.4, 0.6], ["low", "middle", "high"]).alias("band")).agg(F.count("*").alias("n"), r6(F.avg("nir")).alias("nir"))


@query("agg40_group_comparability", "SELECT treatment, round(avg(value), 6) AS mean, CASE WHEN abs(avg(value) - (SELECT avg(value) FROM sc)) < 0.02 THEN 'comparable' ELSE 'differs' END AS verdict FROM sc GROUP BY treatment", B.VEC, VALUE)
def _(spark, sf):
    s = _scores(spark, sf)
    by = s.groupBy("treatment").agg(F.avg("value").alias("mean")).join(F.broadcast(s.agg(F.avg("value").alias("g"))))  # one row
    return by.select("treatment", r6("mean").alias("mean"), F.when(F.abs(F.col("mean") - F.col("g")) < 0.02, "comparable").otherwise("differs").alias("verdict"))


@query("agg23_metric_means", "SELECT metric, round(avg(v), 6) AS mean, count(v) AS n FROM (SELECT 'value' AS metric, CASE WHEN id % 5 > 0 THEN value END AS v FROM sc UNION ALL SELECT 'other', other FROM sc) GROUP BY metric", B.VEC, VALUE)
def _(spark, sf):
    long = _scores(spark, sf).select(F.when(F.col("id") % 5 > 0, F.col("value")).alias("value"), "other").unpivot([], ["value", "other"], "metric", "v")
    return long.groupBy("metric").agg(r6(F.avg("v")).alias("mean"), F.count("v").alias("n"))


@query("met21_range_fraction", "SELECT context, round((avg(value) - avg(other)) / (avg(third) - avg(other)), 6) AS fraction FROM (SELECT context, x[1] AS value, x[2] AS other, x[3] + 1 AS third FROM vec) GROUP BY context", B.VEC)
def _(spark, sf):
    v = B.vectors(spark, sf).select("context", *[F.get("x", i).alias(n) for i, n in enumerate("abc")])
    return v.groupBy("context").agg(r6(RP.range_fraction(F.col("a"), F.col("b"), F.col("c") + 1)).alias("fraction"))


@query("met26_divergence", "SELECT id, round(list_sum(list_transform(range(1, 33), lambda i: exp(x[i]) * (x[i] - x[i + 32]))), 6) AS kl FROM vec", B.VEC)
def _(spark, sf):
    return B.vectors(spark, sf).select("id", r6(RP.divergence(F.slice("x", 1, 32), F.slice("x", 33, 32))).alias("kl"))


@query("met29_dose_monotonicity", "SELECT event_type, round(corr(rk, rv), 6) AS rho, any_value(n) AS n FROM (SELECT event_type, n, rank() OVER (PARTITION BY event_type ORDER BY k) + (count(*) OVER (PARTITION BY event_type, k) - 1) / 2.0 AS rk, rank() OVER (PARTITION BY event_type ORDER BY m) + (count(*) OVER (PARTITION BY event_type, m) - 1) / 2.0 AS rv FROM (SELECT event_type, raw_value::BIGINT AS k, round(avg(value), 9) AS m, count(*) OVER (PARTITION BY event_type) AS n FROM ev WHERE raw_value IS NOT NULL GROUP BY event_type, raw_value::BIGINT)) GROUP BY event_type HAVING any_value(n) >= 3", B.EVENT)
def _(spark, sf):
    from ..operators.cells import average_rank

    by = B.events(spark, sf).where("raw_value is not null").groupBy("event_type", F.col("raw_value").cast("long").alias("k")).agg(F.round(F.avg("value"), 9).alias("m"))
    ranked = by.select("event_type", average_rank("k", ["event_type"]).alias("rk"), average_rank("m", ["event_type"]).alias("rv"))
    return ranked.groupBy("event_type").agg(r6(corr_agg("rk", "rv")).alias("rho"), F.count("*").alias("n")).where("n >= 3")


SWEEP = f"""nk AS (SELECT *, row_number() OVER (PARTITION BY context, treatment ORDER BY {B.hash_sql("sweep", "id")}, id) AS r FROM vec WHERE treatment <> 0),
sw AS (SELECT size, context, treatment, (r > size)::INT AS half, unnest(x) AS v, unnest(range(0, len(x))) AS idx FROM nk JOIN (SELECT unnest([1, 2, 4]) AS size) ON r <= 2 * size),
sm AS (SELECT size, context, treatment, half, list(m ORDER BY idx) AS m FROM (SELECT size, context, treatment, half, idx, avg(v) AS m FROM sw GROUP BY ALL) GROUP BY ALL)"""


@query(
    "met19_rate_by_group_size",
    """SELECT size, round(avg(nir), 6) AS nir, count(*) AS conditions FROM (SELECT q.size, q.context, q.treatment, avg(CASE WHEN round(list_distance(q.m, own.m), 9) < round(list_distance(q.m, o.m), 9) THEN 1 WHEN round(list_distance(q.m, own.m), 9) = round(list_distance(q.m, o.m), 9) THEN 0.5 ELSE 0 END) AS nir
FROM sm q JOIN sm own ON own.size = q.size AND own.context = q.context AND own.treatment = q.treatment AND own.half = 1 JOIN sm o ON o.size = q.size AND o.context = q.context AND o.treatment <> q.treatment AND o.half = 1 WHERE q.half = 0 GROUP BY ALL) GROUP BY size""",
    B.VEC, SWEEP,
)
def _(spark, sf):
    """The identification rate of half means as the number of rows in a half grows."""
    from ..operators import metrics as M

    r = F.row_number().over(Window.partitionBy(*CT).orderBy(hash_order("sweep", "id"), "id"))
    rows = B.vectors(spark, sf).where("treatment <> 0").withColumn("r", r).withColumn("size", F.explode(F.array(*[F.lit(n) for n in (1, 2, 4)]))).where("r <= 2 * size")
    means = rows.groupBy("size", *CT, (F.col("r") > F.col("size")).alias("half")).agg(R.mean_vector("x").alias("v"))
    pairs = M.gallery(means.where("not half"), means.where("half"), ["size", "context"], "treatment", "v", "distance")
    rate = pairs.groupBy("size", *CT).agg(M.identification_rate(F.round("own", 9), F.round("sim", 9)).alias("nir"))
    return rate.groupBy("size").agg(r6(F.avg("nir")).alias("nir"), F.count("*").alias("conditions"))


@query(
    "stat19_reliability_null",
    """SELECT context, round(avg(seen), 6) AS seen, round(any_value(null_mean), 6) AS null_mean, round(any_value(p95), 6) AS p95, round(avg((seen > p95)::INT), 6) AS kept FROM (SELECT context, treatment, list_cosine_similarity(ra, rb) AS seen FROM rl)
JOIN (SELECT context, avg(c) AS null_mean, quantile_cont(c, 0.95) AS p95 FROM (SELECT w.context, list_cosine_similarity(w.ra, o.rb) AS c FROM mn w CROSS JOIN range(0, 20) d(draw) JOIN mn o ON o.context = w.context AND o.i = (w.i + 1 + """
    + B.hash_sql("null", "'pick'", "draw", "w.treatment")
    + """ % greatest(1, w.n - 1)) % w.n WHERE w.n > 1) GROUP BY context) USING (context) GROUP BY context""",
    B.VEC, HALF, GEN,
    f"mn AS (SELECT *, row_number() OVER (PARTITION BY context ORDER BY {B.hash_sql('null', 'treatment')}, treatment) - 1 AS i, count(*) OVER (PARTITION BY context) AS n FROM rl)",
)
def _(spark, sf):
    """Observed cosines of halves against those of a hashed other treatment's half."""
    r = _residuals(spark, sf).select("context", "treatment", minus("shift_a", "generic").alias("a"), minus("shift_b", "generic").alias("b"))
    null = RP.mismatched_null(r, ["context"], "treatment", cosine("a", "_other"), "b", 20, "null")
    seen = r.select("context", "treatment", cosine("a", "b").alias("seen"))
    cut = null.groupBy("context").agg(F.percentile("null", F.lit(0.95)).alias("p95"), F.avg("null").alias("null_mean"))
    return seen.join(cut, "context").groupBy("context").agg(r6(F.avg("seen")).alias("seen"), r6(F.first("null_mean")).alias("null_mean"), r6(F.first("p95")).alias("p95"), r6(F.avg((F.col("seen") > F.col("p95")).cast("double"))).alias("kept"))


@query("stat24_against_chance", "SELECT treatment, round((mean - 0.5) / sqrt(CASE WHEN a + b - ab > 0 THEN a + b - ab ELSE greatest(a, b) END), 6) AS t FROM tw", B.VEC, VALUE, TWO)
def _(spark, sf):
    from ..operators import inference as I

    v = I.two_way_variance(_scores(spark, sf), ["treatment"], "value", "context", "unit")
    return v.select("treatment", r6((F.col("mean") - 0.5) / F.sqrt("variance")).alias("t"))


@query("stat27_channel_verdict", None)
def _(spark, sf):
    """Same-class against other-class residual similarity, its interval over contexts and treatments, and the verdict."""
    from ..operators import inference as I

    r = _residuals(spark, sf).select("context", "treatment", "residual")
    p = r.join(r.toDF("context", "o", "v"), "context").where("treatment <> o").select("context", "treatment", (F.col("treatment") % 3 == F.col("o") % 3).alias("same"), cosine("residual", "v").alias("c"))
    gap = p.groupBy("context", "treatment").agg((F.avg(F.when(F.col("same"), F.col("c"))) - F.avg(F.when(~F.col("same"), F.col("c")))).alias("gap")).where("gap is not null")
    v = I.interval(I.two_way_variance(gap.withColumn("g", F.lit(1)), ["g"], "gap", "context", "treatment"))
    return v.select("n", "mean", "lo", "hi", RP.verdict("lo", "hi", 0.03, F.col("df") + 1, 4).alias("verdict"))


@query("stat31_output_invariance", "SELECT a.context, round(avg(list_cosine_similarity(a.m, b.m)), 6) AS across FROM ml a JOIN ml b ON a.context = b.context AND a.treatment < b.treatment GROUP BY a.context", B.VEC, MEAN, ML)
def _(spark, sf):
    m = _means(spark, sf).select(*CT, "m")
    return m.join(m.toDF("context", "o", "v"), "context").where("treatment < o").groupBy("context").agg(r6(F.avg(cosine("m", "v"))).alias("across"))


@query("stat32_frame_comparison", "SELECT context, treatment, round(list_cosine_similarity(r, s), 6) AS agreement, round(sqrt(list_inner_product(g, g)) / sqrt(list_inner_product(s, s)), 6) AS moved FROM rl", B.VEC, HALF, GEN)
def _(spark, sf):
    return _residuals(spark, sf).select(*CT, r6(cosine("residual", "shift")).alias("agreement"), r6(norm("generic") / norm("shift")).alias("moved"))


@query("ml09_other_context_lookup", "SELECT context, treatment, round(list_cosine_similarity(list(r ORDER BY idx), list(o ORDER BY idx)), 6) AS cos FROM (SELECT context, treatment, idx, r, (sum(r) OVER w - r) / nullif(count(*) OVER w - 1, 0) AS o FROM rs WINDOW w AS (PARTITION BY treatment, idx)) WHERE o IS NOT NULL GROUP BY ALL", B.VEC, HALF, GEN)
def _(spark, sf):
    r = _residuals(spark, sf).select(*CT, "residual")
    total = r.groupBy("treatment").agg(R.sum_vector("residual").alias("s"), F.count("*").alias("n")).where("n > 1")
    return r.join(total, "treatment").select(*CT, r6(cosine("residual", F.zip_with("s", "residual", lambda s, x: (s - x) / (F.col("n") - 1)))).alias("cos"))


@query("ml18_marked_token_share", "SELECT context, round(sum(n_on) / sum(n), 6) AS share FROM (SELECT context, id, count(*) AS n, count(*) FILTER (WHERE tok IN (SELECT tok FROM wp)) AS n_on FROM ft GROUP BY ALL) GROUP BY context", B.SENT)
def _(spark, sf):
    from ..operators import cells as C

    first = C.first_places(C.tokens(B.sentences(spark, sf), ["id", "context"], stop=None), ["id", "context"])
    on = first.join(F.broadcast(B.word_panel(spark, sf)), "tok", "left")
    return on.groupBy("context").agg(r6(F.count("idx") / F.count("*")).alias("share"))


@query("src21_json_path", "SELECT (k::BIGINT) % 10 AS bucket, count(*) AS n FROM (SELECT json_extract_string(props, '$.k') AS k FROM events) GROUP BY 1")
def _(spark, sf):
    k = F.variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return B.table(spark, sf, "events").groupBy((k % 10).alias("bucket")).agg(F.count("*").alias("n"))
