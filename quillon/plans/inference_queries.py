"""Queries of inference, models and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import corr_agg, disattenuate, distance, r6, spearman_brown, tost
from ..operators import inference as I
from ..operators import matching as MA
from ..operators import models as MO
from ..operators import residuals as R
from ..operators import sampling as S
from . import bindings as B
from .base import query

VALUE = "sc AS (SELECT id, treatment, context, unit, batch, x[1] AS value, x[2] AS other FROM vec)"


def _scores(spark, sf):
    return B.vectors(spark, sf).select("id", "treatment", "context", "unit", "batch", F.get("x", 0).alias("value"), F.get("x", 1).alias("other"))


TWO = """st AS (SELECT treatment, count(*) AS n, avg(value) AS mean FROM sc GROUP BY treatment),
er AS (SELECT sc.*, n, mean, value - mean AS e FROM sc JOIN st USING (treatment)),
va AS (SELECT treatment, count(*) AS ga, sum(s * s) AS sa FROM (SELECT treatment, context, sum(e) AS s FROM er GROUP BY ALL) GROUP BY treatment),
vb AS (SELECT treatment, count(*) AS gb, sum(s * s) AS sb FROM (SELECT treatment, unit, sum(e) AS s FROM er GROUP BY ALL) GROUP BY treatment),
vs AS (SELECT treatment, any_value(n) AS n, any_value(mean) AS mean, sum(e * e) AS ss FROM er GROUP BY treatment),
tw AS (SELECT treatment, n, mean, ga, gb, ga / (ga - 1.0) * sa / n / n AS a, gb / (gb - 1.0) * sb / n / n AS b, ss / n / n AS ab FROM vs JOIN va USING (treatment) JOIN vb USING (treatment))"""


@query("stat03_two_way_variance", "SELECT treatment, n, round(mean, 6) AS mean, round(1e6 * CASE WHEN a + b - ab > 0 THEN a + b - ab ELSE greatest(a, b) END, 6) AS variance_ppm, least(ga, gb) - 1 AS df FROM tw", B.VEC, VALUE, TWO)
def _(spark, sf):
    v = I.two_way_variance(_scores(spark, sf), ["treatment"], "value", "context", "unit")
    return v.select("treatment", "n", r6("mean").alias("mean"), r6(1e6 * F.col("variance")).alias("variance_ppm"), F.col("df").cast("long").alias("df"))


@query("stat03_two_way_interval")
def _(spark, sf):
    """With the t quantile, which SQL lacks; stat03_two_way_variance has the oracle for the rest."""
    v = I.interval(I.two_way_variance(_scores(spark, sf), ["treatment"], "value", "context", "unit"))
    return v.select("treatment", "n", "mean", "lo", "hi", tost("lo", "hi", 0.1).alias("verdict"))


DYAD = "dy AS (SELECT a.treatment AS p, b.treatment AS q, list_distance(a.m, b.m) AS value FROM (SELECT treatment, list(m ORDER BY idx) AS m FROM (SELECT treatment, idx, avg(v) AS m FROM vl GROUP BY ALL) GROUP BY treatment) a JOIN (SELECT treatment, list(m ORDER BY idx) AS m FROM (SELECT treatment, idx, avg(v) AS m FROM vl GROUP BY ALL) GROUP BY treatment) b ON a.treatment < b.treatment), de AS (SELECT *, value - (SELECT avg(value) FROM dy) AS e FROM dy)"


@query("stat05_dyadic_variance", "SELECT (SELECT count(*) FROM dy) AS n, round((SELECT avg(value) FROM dy), 6) AS mean, round(1e6 * (SELECT sum(a.e * b.e) FROM de a JOIN de b ON a.p IN (b.p, b.q) OR a.q IN (b.p, b.q)) / (SELECT count(*) FROM dy) ** 2, 6) AS variance_ppm", B.VEC, DYAD)
def _(spark, sf):
    m = B.vectors(spark, sf).groupBy(F.lit(1).alias("g"), "treatment").agg(R.mean_vector("x").alias("m"))
    pairs = MA.pairs_within(m, ["g"], "treatment", ["m"]).select("a", "b", distance("a_m", "b_m").alias("value"), F.array("a", "b").alias("nodes"))
    v = I.multiway_variance(pairs.withColumn("id", F.concat_ws("-", "a", "b")), "id", "value", "nodes")
    return v.select("n", r6("mean").alias("mean"), r6(1e6 * F.col("variance")).alias("variance_ppm"))


POIS = " + ".join(f"(u >= {sum(__import__('math').exp(-1) / __import__('math').factorial(i) for i in range(k + 1))!r})::INT" for k in range(12))


@query(
    "stat01_cluster_bootstrap",
    f"""SELECT (SELECT sum(c) FROM cs)::BIGINT AS n, round((SELECT sum(s) / sum(c) FROM cs), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM (SELECT draw, sum(w * s) / nullif(sum(w * c), 0) AS m FROM (SELECT draw, s, c, {POIS} AS w FROM (SELECT draw, unit, s, c, {B.hash_sql("boot", "draw", "unit")} / 4294967296.0 AS u FROM cs CROSS JOIN range(0, 200) t(draw))) GROUP BY draw)""",
    B.VEC, VALUE, "cs AS (SELECT unit, sum(value) AS s, count(value) AS c FROM sc GROUP BY unit)",
)
def _(spark, sf):
    b = I.cluster_bootstrap(_scores(spark, sf), "unit", "value", 200, "boot")
    return b.select("n", *[r6(c).alias(c) for c in ("mean", "lo", "hi")])


@query("stat11_sign_flip", f"SELECT round(any_value(mean), 6) AS mean, round((count(*) FILTER (WHERE abs(f) >= abs(mean) - 1e-12) + 1) / 201.0, 6) AS p FROM (SELECT draw, avg(m * (1 - 2 * ({B.hash_sql('flip', 'draw', 'unit')} % 2))) AS f FROM gm CROSS JOIN range(1, 201) t(draw) GROUP BY draw), (SELECT avg(m) AS mean FROM gm)", B.VEC, VALUE, "gm AS (SELECT unit, avg(value) AS m FROM sc GROUP BY unit)")
def _(spark, sf):
    return I.sign_flip_p(_scores(spark, sf), "unit", "value", 200, "flip").select(r6("mean").alias("mean"), r6("p").alias("p"))


PV = "pv AS (SELECT context, id, 0.5 + 0.5 * abs(value) / (1 + abs(value)) - 0.5 * (id % 7) / 7.0 AS p FROM sc)"


@query("win12_holm_and_bh", "SELECT context, id, round(least(1, max((n - r + 1) * p) OVER (PARTITION BY context ORDER BY p, id ROWS UNBOUNDED PRECEDING)), 6) AS holm, round(least(1, min(n * p / r) OVER (PARTITION BY context ORDER BY p, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS bh FROM (SELECT *, row_number() OVER (PARTITION BY context ORDER BY p, id) AS r, count(*) OVER (PARTITION BY context) AS n FROM pv)", B.VEC, VALUE, PV)
def _(spark, sf):
    p = 0.5 + 0.5 * F.abs("value") / (1 + F.abs("value")) - 0.5 * (F.col("id") % 7) / 7.0
    rows = _scores(spark, sf).select("context", "id", p.alias("p"))
    return I.adjusted(rows, "p", ["context"], "id").select("context", "id", r6("holm").alias("holm"), r6("bh").alias("bh"))


@query("stat12_welch", "SELECT context, round((ma - mb) / sqrt(va / na + vb / nb), 6) AS t, round((va / na + vb / nb) ** 2 / ((va / na) ** 2 / (na - 1) + (vb / nb) ** 2 / (nb - 1)), 6) AS df FROM (SELECT context, avg(value) FILTER (WHERE treatment = 0) AS ma, avg(value) FILTER (WHERE treatment <> 0) AS mb, var_samp(value) FILTER (WHERE treatment = 0) AS va, var_samp(value) FILTER (WHERE treatment <> 0) AS vb, count(*) FILTER (WHERE treatment = 0) AS na, count(*) FILTER (WHERE treatment <> 0) AS nb FROM sc GROUP BY context)", B.VEC, VALUE)
def _(spark, sf):
    return I.welch(_scores(spark, sf), ["context"], F.col("treatment") == 0, "value").select("context", r6("t").alias("t"), r6("df").alias("df"))


@query("stat12_welch_p")
def _(spark, sf):
    w = I.welch(_scores(spark, sf), ["context"], F.col("treatment") == 0, "value")
    return w.withColumn("p", I.t_two_sided("t", "df"))


@query("stat15_cohens_d", "SELECT context, round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)), 6) AS d FROM (SELECT context, avg(value) FILTER (WHERE treatment = 0) AS ma, avg(value) FILTER (WHERE treatment <> 0) AS mb, var_samp(value) FILTER (WHERE treatment = 0) AS va, var_samp(value) FILTER (WHERE treatment <> 0) AS vb, count(*) FILTER (WHERE treatment = 0) AS na, count(*) FILTER (WHERE treatment <> 0) AS nb FROM sc GROUP BY context)", B.VEC, VALUE)
def _(spark, sf):
    return _scores(spark, sf).groupBy("context").agg(r6(I.cohens_d(F.col("treatment") == 0, F.col("value"))).alias("d"))


@query("stat14_signed_rank", "SELECT sum(c)::BIGINT AS n, round(sum(k * (below + (c + 1) / 2.0)), 6) AS w_plus FROM (SELECT c, k, coalesce(sum(c) OVER (ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (SELECT abs(value - other) AS a, count(*) AS c, count(*) FILTER (WHERE value > other) AS k FROM sc WHERE value <> other GROUP BY 1))", B.VEC, VALUE)
def _(spark, sf):
    d = _scores(spark, sf).withColumn("d", F.col("value") - F.col("other"))
    return I.signed_rank(d, "id", "d").select("n", r6("w_plus").alias("w_plus"))


@query("stat23_slope_by_group", "SELECT treatment, round(regr_slope(value, other), 6) AS slope, round(corr(value, other), 6) AS r, count(*) AS n FROM sc GROUP BY treatment", B.VEC, VALUE)
def _(spark, sf):
    return _scores(spark, sf).groupBy("treatment").agg(r6(F.regr_slope("value", "other")).alias("slope"), r6(corr_agg("value", "other")).alias("r"), F.count("*").alias("n"))


@query("stat16_reliability", "SELECT treatment, round(CASE WHEN r > 0 AND r < 1 THEN 2 * r / (1 + r) END, 6) AS full_length, round(CASE WHEN r > 0 AND abs(r / sqrt(r * 0.8)) <= 1 THEN r / sqrt(r * 0.8) END, 6) AS corrected FROM (SELECT treatment, corr(value, other) AS r FROM sc GROUP BY treatment)", B.VEC, VALUE)
def _(spark, sf):
    r = _scores(spark, sf).groupBy("treatment").agg(corr_agg("value", "other").alias("r"))
    return r.select("treatment", r6(spearman_brown("r")).alias("full_length"), r6(disattenuate("r", "r", F.lit(0.8))).alias("corrected"))


@query("met28_variance_ratio", "SELECT round(sum(n * (m - g) ** 2) / sum(ss), 6) AS ratio FROM (SELECT treatment, count(*) AS n, avg(value) AS m, var_pop(value) * count(*) AS ss FROM sc GROUP BY treatment), (SELECT avg(value) AS g FROM sc)", B.VEC, VALUE)
def _(spark, sf):
    s = _scores(spark, sf)
    g = s.agg(F.avg("value").alias("g"))  # one row
    by = s.groupBy("treatment").agg(F.count("*").alias("n"), F.avg("value").alias("m"), (F.var_pop("value") * F.count("*")).alias("ss"))
    return by.join(F.broadcast(g)).agg(r6(F.sum(F.col("n") * (F.col("m") - F.col("g")) * (F.col("m") - F.col("g"))) / F.sum("ss")).alias("ratio"))


@query("met10_weighted_r2", "SELECT context, round(1 - sum(w * (value - other) ** 2) / (sum(w * value * value) - sum(w * value) ** 2 / sum(w)), 6) AS r2 FROM (SELECT *, 1 + id % 3 AS w FROM sc) GROUP BY context", B.VEC, VALUE)
def _(spark, sf):
    from ..operators.metrics import weighted_r2

    return _scores(spark, sf).groupBy("context").agg(r6(weighted_r2(F.col("other"), F.col("value"), 1 + F.col("id") % 3)).alias("r2"))


@query("met06_partial_correlation", "SELECT treatment, round((ab - ac * bc) / sqrt((1 - ac * ac) * (1 - bc * bc)), 6) AS r FROM (SELECT treatment, corr(x[1], x[2]) AS ab, corr(x[1], x[3]) AS ac, corr(x[2], x[3]) AS bc FROM vec GROUP BY treatment)", B.VEC)
def _(spark, sf):
    from ..operators.metrics import partial_correlation

    x = lambda i: F.get("x", i)
    c = B.vectors(spark, sf).groupBy("treatment").agg(corr_agg(x(0), x(1)).alias("ab"), corr_agg(x(0), x(2)).alias("ac"), corr_agg(x(1), x(2)).alias("bc"))
    return c.select("treatment", r6(partial_correlation(F.col("ab"), F.col("ac"), F.col("bc"))).alias("r"))


@query(
    "join13_nearest_covariate",
    """SELECT context, id, other, round(gap, 6) AS gap FROM step WHERE id IS NOT NULL""",
    "RECURSIVE " + B.VEC, VALUE,
    """tr AS (SELECT context, id, value, row_number() OVER (PARTITION BY context ORDER BY id) AS r FROM sc WHERE treatment > 0),
pool AS (SELECT context, list({'id': id, 'v': value} ORDER BY id) AS c FROM sc WHERE treatment = 0 GROUP BY context),
step AS (
  SELECT context, 0::BIGINT AS r, c, NULL::BIGINT AS id, NULL::BIGINT AS other, NULL::DOUBLE AS gap FROM pool
  UNION ALL
  SELECT context, r, list_filter(c, lambda p: p.id <> best.id), id, best.id, abs(best.v - value) FROM (
    SELECT s.context, t.r, s.c, t.id, t.value, list_sort(list_transform(s.c, lambda p: {'d': round(abs(p.v - t.value), 9), 'id': p.id, 'v': p.v}))[1] AS best
    FROM step s JOIN tr t ON t.context = s.context AND t.r = s.r + 1 WHERE len(s.c) > 0))""",
)
def _(spark, sf):
    s = _scores(spark, sf)
    return MA.matched_once(s.where("treatment > 0"), s.where("treatment = 0"), "context", "id", "value").select("context", "id", "other", r6("gap").alias("gap"))


# --- models -----------------------------------------------------------------


@query("ml02_gram_moments", "SELECT a.idx AS i, b.idx AS j, count(*) AS n, round(sum(a.v * b.v), 6) AS sxx FROM vl a JOIN vl b ON a.id = b.id GROUP BY ALL", B.VEC)
def _(spark, sf):
    """The Gram matrix of all features."""
    v = B.vectors(spark, sf)
    return MO.moments(v, "x", "x").select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "n", r6("sxx").alias("sxx"))


@query("ml02_ridge_prediction")
def _(spark, sf):
    v = B.vectors(spark, sf).select("id", F.slice("x", 1, 32).alias("x"), F.slice("x", 33, 32).alias("y"))
    return MO.predict_linear(v, "x", *MO.fit_ridge(v, "x", "y")).select("id", F.transform("predicted", lambda p: F.round(p, 6)).alias("predicted"))


@query("ml08_centre_assignment", "SELECT v.context, v.id, arg_min(c.treatment, (round(list_distance(v.x, c.m), 9), c.treatment)) AS centre FROM vec v JOIN (SELECT context, treatment, list(m ORDER BY idx) AS m FROM (SELECT context, treatment, idx, avg(v) AS m FROM vl GROUP BY ALL) GROUP BY ALL) c USING (context) GROUP BY v.context, v.id", B.VEC)
def _(spark, sf):
    v = B.vectors(spark, sf)
    centres = v.groupBy("context", "treatment").agg(R.mean_vector("x").alias("c")).select("context", F.col("treatment").alias("centre"), "c")
    return MO.nearest_centre(v, centres, ["context"], "x", "id").select("context", "id", "centre")


@query("ml08_kmeans")
def _(spark, sf):
    return MO.kmeans(B.vectors(spark, sf).select("id", "context", "x"), "x", 6).groupBy("cluster").agg(F.count("*").alias("n"))


@query("ml10_principal_components")
def _(spark, sf):
    return MO.principal_components(B.vectors(spark, sf).select("id", "x"), "x", 3).select("id", F.transform("coords", lambda c: F.round(c, 6)).alias("coords"))


@query("ml11_transport_cost", "SELECT a.context, b.treatment, round(avg(list_distance(a.x, b.x) ** 2), 6) AS cost FROM vec a JOIN vec b ON a.context = b.context AND a.treatment = 0 AND b.treatment <> 0 GROUP BY ALL", B.VEC)
def _(spark, sf):
    """The mean squared distance of all pairs, from means and mean squares alone."""
    v = B.vectors(spark, sf).withColumn("q", F.aggregate("x", F.lit(0.0), lambda s, x: s + x * x))
    by = v.groupBy("context", "treatment").agg(R.mean_vector("x").alias("m"), F.avg("q").alias("q"))
    control = by.where("treatment = 0").select("context", F.col("m").alias("c"), F.col("q").alias("qc"))
    dot = F.aggregate(F.zip_with("m", "c", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return by.where("treatment <> 0").join(control, "context").select("context", "treatment", r6(F.col("q") + F.col("qc") - 2 * dot).alias("cost"))


@query("ml12_logistic_probe")
def _(spark, sf):
    v = B.vectors(spark, sf).withColumn("odd", F.col("treatment") % 2)  # two classes
    return MO.logistic_probe(v, "x", "odd", F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(3)), 3)


# --- streams ----------------------------------------------------------------


def _folder(spark):
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    import tempfile

    return "file://" + tempfile.mkdtemp(prefix="quillon-stream-")


@query("stream_capped_keys", "SELECT event_type, least(count(*), 50) AS n FROM events GROUP BY event_type")
def _(spark, sf):
    from ..streaming import bounded as ST

    s = ST.capped(ST.stream_of(spark, f"{sf}/events.parquet"), "event_type", "event_id", 50)
    return ST.run_to_end(s, _folder(spark)).groupBy("event_type").agg(F.count("*").alias("n"))


@query("stream_windowed_totals", "SELECT * FROM (SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2) WHERE start < (SELECT date_trunc('day', max(ts)) FROM events)")
def _(spark, sf):
    """Days before the last: a window is final once the watermark has passed it, which the last day's never is."""
    from ..streaming import bounded as ST

    s = ST.windowed(ST.stream_of(spark, f"{sf}/events.parquet"), "ts", "event_type", "value", "1 day", "0 seconds")
    return ST.run_to_end(s, _folder(spark)).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", r6("total").alias("total"))
