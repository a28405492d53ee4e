"""Queries over dense rows: means, shifts, generics, residuals, retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.core import corr_agg, cosine, disattenuate, distance, energy_shares, hash_order, minus, norm, r6, reject, spearman_brown
from ..operators import metrics as M
from ..operators import residuals as R
from . import bindings as B
from .base import query

CT = ["context", "treatment"]
MEAN = "cm AS (SELECT context, treatment, idx, avg(v) AS m, count(*) AS n FROM vl GROUP BY ALL)"
ML = "ml AS (SELECT context, treatment, any_value(n) AS n, list(m ORDER BY idx) AS m FROM cm GROUP BY context, treatment)"


def _means(spark, sf):
    return B.vectors(spark, sf).groupBy(*CT).agg(R.mean_vector("x").alias("m"), F.count("*").alias("n"))


def _long(df, keys, vec, name="v"):
    return df.select(*keys, F.posexplode(vec).alias("idx", name)).withColumn(name, r6(name)).withColumn("idx", F.col("idx").cast("long"))


@query("agg01_mean_vector", "SELECT context, treatment, idx, round(m, 6) AS m FROM cm", B.VEC, MEAN)
def _(spark, sf):
    return _long(_means(spark, sf), CT, "m", "m")


HALF = f"""hv AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY context, treatment ORDER BY {B.hash_sql("half", "id")}, id) <= ceil(count(*) OVER (PARTITION BY context, treatment) / 2.0) THEN 0 ELSE 1 END AS half FROM vec),
hl AS (SELECT context, treatment, half, unnest(x) AS v, unnest(range(0, len(x))) AS idx FROM hv),
hm AS (SELECT context, treatment, idx, avg(v) AS f, avg(v) FILTER (WHERE half = 0) AS a, coalesce(avg(v) FILTER (WHERE half = 1), avg(v)) AS b FROM hl GROUP BY ALL),
ng AS (SELECT context, treatment, count(*) AS n FROM vec GROUP BY ALL),
sh AS (SELECT t.context, t.treatment, t.idx, t.f - c.f AS f, t.a - c.a AS a, t.b - c.b AS b FROM hm t JOIN hm c ON c.context = t.context AND c.idx = t.idx AND c.treatment = 0 JOIN ng ON ng.context = t.context AND ng.treatment = t.treatment WHERE t.treatment <> 0 AND n >= 6)"""
GEN = """gn AS (SELECT *, (sum(f) OVER (PARTITION BY context, idx) - f) / nullif(count(*) OVER (PARTITION BY context, idx) - 1, 0) AS g FROM sh),
rs AS (SELECT context, treatment, idx, f, a, b, g, f - g AS r, a - g AS ra, b - g AS rb FROM gn WHERE g IS NOT NULL),
rl AS (SELECT context, treatment, list(f ORDER BY idx) AS s, list(g ORDER BY idx) AS g, list(r ORDER BY idx) AS r, list(ra ORDER BY idx) AS ra, list(rb ORDER BY idx) AS rb FROM rs GROUP BY ALL)"""


def _shifts(spark, sf, group=("context",), least=6):
    return R.shifts(B.vectors(spark, sf), F.col("treatment") == 0, list(group), "treatment", "x", "id", least, 2)


def _residuals(spark, sf):
    return R.residuals(R.generic(_shifts(spark, sf), F.lit(True), ["context"], ["context"], "treatment", "shift", 1))


@query("agg13_shift_and_halves", "SELECT context, treatment, idx, round(f, 6) AS shift, round(a, 6) AS shift_a, round(b, 6) AS shift_b FROM sh", B.VEC, HALF)
def _(spark, sf):
    z = _shifts(spark, sf).select(*CT, F.posexplode(F.arrays_zip("shift", "shift_a", "shift_b")).alias("idx", "z"))
    return z.select(*CT, F.col("idx").cast("long").alias("idx"), *[r6(F.col("z")[c]).alias(c) for c in ("shift", "shift_a", "shift_b")])


@query("agg10_generic", "SELECT context, treatment, idx, round(g, 6) AS generic FROM gn WHERE g IS NOT NULL", B.VEC, HALF, GEN)
def _(spark, sf):
    return _long(R.generic(_shifts(spark, sf), F.lit(True), ["context"], ["context"], "treatment", "shift", 1), CT, "generic", "generic")


FINE = """nb AS (SELECT context, batch, treatment, count(*) AS n FROM vec GROUP BY ALL),
bm AS (SELECT context, batch, treatment, idx, avg(v) AS m FROM vl GROUP BY ALL),
bs AS (SELECT t.context, t.batch, t.treatment, t.idx, t.m - c.m AS s FROM bm t JOIN bm c ON c.context = t.context AND c.batch = t.batch AND c.idx = t.idx AND c.treatment = 0
  JOIN nb ON nb.context = t.context AND nb.batch = t.batch AND nb.treatment = t.treatment JOIN nb k ON k.context = t.context AND k.batch = t.batch AND k.treatment = 0 WHERE t.treatment <> 0 AND nb.n >= 4 AND k.n >= 2)"""


def _fine_shifts(spark, sf):
    return _shifts(spark, sf, ("context", "batch"), 4)


@query(
    "agg10_generic_shrunk",
    """SELECT context, batch, treatment, idx, round(CASE WHEN fine IS NULL THEN coarse WHEN coarse IS NULL THEN fine ELSE nf / (nf + 5.0) * fine + 5.0 / (nf + 5.0) * coarse END, 6) AS generic
FROM (SELECT *, sum(s) OVER w - s AS o, count(*) OVER w - 1 AS nf, (sum(s) OVER w - s) / nullif(count(*) OVER w - 1, 0) AS fine FROM bs WINDOW w AS (PARTITION BY context, batch, idx))
JOIN (SELECT context, treatment, idx, (sum(m) OVER v - m) / nullif(count(*) OVER v - 1, 0) AS coarse FROM (SELECT context, treatment, idx, avg(s) AS m FROM bs GROUP BY ALL) WINDOW v AS (PARTITION BY context, idx)) USING (context, treatment, idx)
WHERE coalesce(fine, coarse) IS NOT NULL""",
    B.VEC, FINE,
)
def _(spark, sf):
    g = R.generic(_fine_shifts(spark, sf), F.lit(True), ["context", "batch"], ["context"], "treatment", "shift", 3, 5.0)
    return _long(g, ["context", "batch", "treatment"], "generic", "generic")


@query("agg15_residual", "SELECT context, treatment, round(sqrt(list_inner_product(r, r)), 6) AS size, round(list_cosine_similarity(ra, rb), 6) AS repro_cos FROM rl", B.VEC, HALF, GEN)
def _(spark, sf):
    return _residuals(spark, sf).select(*CT, r6(norm("residual")).alias("size"), r6("repro_cos").alias("repro_cos"))


@query(
    "agg16_residual_retention",
    f"SELECT split, count(*) AS n, count(*) FILTER (WHERE cos > 0.05 OR split <> 'train') AS kept, round(avg(cos), 6) AS mean_cos FROM (SELECT list_cosine_similarity(ra, rb) AS cos, CASE WHEN {B.hash_sql('hold', 'context', 'treatment')} % 4 = 0 THEN 'held' ELSE 'train' END AS split FROM rl) GROUP BY split",
    B.VEC, HALF, GEN,
)
def _(spark, sf):
    label = F.when(hash_order("hold", "context", "treatment") % 4 == 0, "held").otherwise("train")
    found = _residuals(spark, sf).withColumn("split", label)
    kept = R.reliable(found, 0.05, F.col("split")).groupBy("split").agg(F.count("*").alias("kept"))
    return found.groupBy("split").agg(F.count("*").alias("n"), r6(F.avg("repro_cos")).alias("mean_cos")).join(kept, "split", "left").select("split", "n", F.coalesce("kept", F.lit(0)).cast("long").alias("kept"), "mean_cos")


@query("agg37_energy_shares", "SELECT context, treatment, round(list_inner_product(r, r) / list_inner_product(s, s), 6) AS residual, round(list_inner_product(g, g) / list_inner_product(s, s), 6) AS generic, round(2 * list_inner_product(r, g) / list_inner_product(s, s), 6) AS \"cross\" FROM rl", B.VEC, HALF, GEN)
def _(spark, sf):
    e = _residuals(spark, sf).withColumn("e", energy_shares("residual", "generic"))
    return e.select(*CT, *[r6(F.col("e")[n]).alias(n) for n in ("residual", "generic", "cross")])


@query(
    "prj11_signed_ranks",
    "SELECT context, treatment, idx, round(CASE WHEN r > 0 AND u <= 10 THEN 1 / log2(u + 1) WHEN r < 0 AND d <= 10 THEN -1 / log2(d + 1) ELSE 0 END, 6) AS code FROM (SELECT *, row_number() OVER (PARTITION BY context, treatment ORDER BY round(r, 9) DESC, idx) AS u, row_number() OVER (PARTITION BY context, treatment ORDER BY round(r, 9), idx) AS d FROM rs)",
    B.VEC, HALF, GEN,
)
def _(spark, sf):
    from ..operators.cells import signed_ranks

    long = _residuals(spark, sf).select(*CT, F.posexplode("residual").alias("idx", "value")).withColumn("value", F.round("value", 9))
    return signed_ranks(long, CT, 10).select(*CT, F.col("idx").cast("long").alias("idx"), r6("code").alias("code"))


@query(
    "prj10_signed_sentence",
    """SELECT context, treatment, trim(regexp_replace(coalesce(string_agg('F' || idx, ' ' ORDER BY u) FILTER (WHERE r > 0 AND u <= 10), '') || ' [DOWN] ' || coalesce(string_agg('F' || idx, ' ' ORDER BY d) FILTER (WHERE r < 0 AND d <= 10), '') || ' [END]', ' +', ' ', 'g')) AS sentence
FROM (SELECT *, row_number() OVER (PARTITION BY context, treatment ORDER BY round(r, 9) DESC, idx) AS u, row_number() OVER (PARTITION BY context, treatment ORDER BY round(r, 9), idx) AS d FROM rs) GROUP BY context, treatment""",
    B.VEC, HALF, GEN,
)
def _(spark, sf):
    from ..operators.cells import signed_sentence

    long = _residuals(spark, sf).select(*CT, F.posexplode("residual").alias("idx", "value")).withColumn("value", F.round("value", 9)).withColumn("feature", F.concat(F.lit("F"), F.col("idx")))
    return signed_sentence(long, CT, 10, 10)


@query("prj49_reject_generic", "SELECT context, treatment, idx, round(f - k * g, 6) AS v FROM rs JOIN (SELECT context, treatment, sum(f * g) / sum(g * g) AS k FROM rs GROUP BY ALL) USING (context, treatment)", B.VEC, HALF, GEN)
def _(spark, sf):
    return _long(_residuals(spark, sf).withColumn("v", reject("shift", "generic")), CT, "v")


NIR = """nr AS (SELECT q.context, q.treatment, o.treatment AS other, list_cosine_similarity(q.ra, own.rb) AS own, list_cosine_similarity(q.ra, o.rb) AS sim, list_distance(q.ra, own.rb) AS down, list_distance(q.ra, o.rb) AS dsim
FROM rl q JOIN rl own ON own.context = q.context AND own.treatment = q.treatment JOIN rl o ON o.context = q.context AND o.treatment <> q.treatment)"""


def _sides(spark, sf):
    r = _residuals(spark, sf)
    side = lambda c: r.select(*CT, minus(c, "generic").alias("v"))
    return side("shift_a"), side("shift_b")


@query("met13_identification_rate", "SELECT context, treatment, round(avg(CASE WHEN own > sim THEN 1 WHEN own = sim THEN 0.5 ELSE 0 END), 6) AS nir, round(avg(CASE WHEN own > sim THEN 1 ELSE 0 END), 6) AS nir_strict FROM nr GROUP BY ALL", B.VEC, HALF, GEN, NIR)
def _(spark, sf):
    a, b = _sides(spark, sf)
    g = M.gallery(a, b, ["context"], "treatment", "v")
    return g.groupBy(*CT).agg(r6(M.identification_rate("own", "sim")).alias("nir"), r6(M.identification_rate("own", "sim", strict=True)).alias("nir_strict"))


@query("met11_identification_by_distance", "SELECT context, treatment, round(avg(CASE WHEN down < dsim THEN 1 ELSE 0 END), 6) AS nir FROM nr GROUP BY ALL", B.VEC, HALF, GEN, NIR)
def _(spark, sf):
    a, b = _sides(spark, sf)
    return M.gallery(a, b, ["context"], "treatment", "v", "distance").groupBy(*CT).agg(r6(M.identification_rate("own", "sim", strict=True)).alias("nir"))


@query(
    "met24_contrastive_reward",
    "SELECT context, treatment, round(any_value(own) - max(sim), 6) AS against_max, round(any_value(own) - avg(sim), 6) AS against_mean, round(any_value(own) / 0.1 - ln(exp(any_value(own) / 0.1) + sum(exp(sim / 0.1))), 6) AS infonce FROM nr GROUP BY ALL",
    B.VEC, HALF, GEN, NIR,
)
def _(spark, sf):
    a, b = _sides(spark, sf)
    own = F.first("own")
    return M.gallery(a, b, ["context"], "treatment", "v").groupBy(*CT).agg(r6(own - F.max("sim")).alias("against_max"), r6(own - F.avg("sim")).alias("against_mean"), r6(own / 0.1 - F.ln(F.exp(own / 0.1) + F.sum(F.exp(F.col("sim") / 0.1)))).alias("infonce"))


@query(
    "minimum_slice",
    """SELECT context, count(*) AS n, round(avg(nir), 6) AS mean_nir, round(stddev_samp(nir), 6) AS sd_nir, round(avg(repro), 6) AS mean_repro FROM (SELECT context, treatment, avg(CASE WHEN own > sim THEN 1 WHEN own = sim THEN 0.5 ELSE 0 END) AS nir, any_value(own) AS repro FROM nr GROUP BY ALL) GROUP BY context""",
    B.VEC, HALF, GEN, NIR,
)
def _(spark, sf):
    """The flagship: shifts from controls, leave-one-out generics, residuals and their identification, by context."""
    a, b = _sides(spark, sf)
    rate = M.gallery(a, b, ["context"], "treatment", "v").groupBy(*CT).agg(M.identification_rate("own", "sim").alias("nir"), F.first("own").alias("repro"))
    return rate.groupBy("context").agg(F.count("*").alias("n"), r6(F.avg("nir")).alias("mean_nir"), r6(F.stddev_samp("nir")).alias("sd_nir"), r6(F.avg("repro")).alias("mean_repro"))


@query(
    "join14_partner_strata",
    """SELECT context, treatment, arg_max(other, (round(sim, 9), other)) AS near, arg_min(other, (round(abs(sim), 9), other)) AS orth, arg_min(other, (round(sim, 9), other)) AS opposite FROM (SELECT q.context, q.treatment, o.treatment AS other, list_cosine_similarity(q.r, o.r) AS sim FROM rl q JOIN rl o ON o.context = q.context AND o.treatment <> q.treatment) GROUP BY ALL HAVING count(*) >= 3""",
    B.VEC, HALF, GEN,
)
def _(spark, sf):
    r = _residuals(spark, sf).select(*CT, "residual")
    p = r.join(r.toDF("context", "other", "o"), "context").where("treatment <> other").withColumn("s", cosine("residual", "o"))
    key = lambda c: F.struct(F.round(c, 9), F.col("other"))
    out = p.groupBy(*CT).agg(F.count("*").alias("n"), F.max_by("other", key(F.col("s"))).alias("near"), F.min_by("other", key(F.abs("s"))).alias("orth"), F.min_by("other", key(F.col("s"))).alias("opposite"))
    return out.where("n >= 3").drop("n")


@query(
    "met25_transfer_coefficient",
    "SELECT p.treatment, p.context AS a, q.context AS b, round(CASE WHEN abs(list_cosine_similarity(p.s, q.s) / sqrt(p.sb * q.sb)) <= 1 THEN list_cosine_similarity(p.s, q.s) / sqrt(p.sb * q.sb) END, 6) AS t FROM rel p JOIN rel q ON p.treatment = q.treatment AND p.context < q.context WHERE p.sb >= 0.05 AND q.sb >= 0.05",
    B.VEC, HALF, "rel AS (SELECT *, CASE WHEN c > 0 AND c < 1 THEN 2 * c / (1 + c) END AS sb FROM (SELECT context, treatment, s, list_cosine_similarity(a, b) AS c FROM (SELECT context, treatment, list(f ORDER BY idx) AS s, list(a ORDER BY idx) AS a, list(b ORDER BY idx) AS b FROM sh GROUP BY ALL)))",
)
def _(spark, sf):
    """Cosines of a treatment's shifts in two contexts over the root of their reliabilities."""
    r = _shifts(spark, sf).select("treatment", "context", "shift", spearman_brown(cosine("shift_a", "shift_b")).alias("sb")).where("sb >= 0.05")
    p = r.toDF("treatment", "a", "ra", "sa").join(r.toDF("treatment", "b", "rb", "sb"), "treatment").where("a < b")
    return p.select("treatment", "a", "b", r6(disattenuate(cosine("ra", "rb"), "sa", "sb")).alias("t"))


@query("win10_leave_one_out", "SELECT id, idx, round((sum(v) OVER w - v) / nullif(count(*) OVER w - 1, 0), 6) AS loo FROM vl WINDOW w AS (PARTITION BY context, treatment, idx)", B.VEC)
def _(spark, sf):
    v = B.vectors(spark, sf)
    total = v.groupBy(*CT).agg(R.sum_vector("x").alias("s"), F.count("*").alias("n"))
    return _long(v.join(total, CT).withColumn("loo", F.zip_with("s", "x", lambda a, b: F.try_divide(a - b, F.col("n") - 1))), ["id"], "loo", "loo")


@query(
    "met16_energy_distance",
    """SELECT context, round(2 * avg(d) FILTER (WHERE s = 0 AND t = 1) - coalesce(avg(d) FILTER (WHERE s = 0 AND t = 0), 0) - coalesce(avg(d) FILTER (WHERE s = 1 AND t = 1), 0), 6) AS energy FROM (SELECT a.context, a.s, b.s AS t, list_distance(a.x, b.x) AS d FROM (SELECT *, (treatment > 0)::INT AS s FROM vec) a JOIN (SELECT *, (treatment > 0)::INT AS s FROM vec) b ON a.context = b.context AND (a.s < b.s OR (a.s = b.s AND a.id < b.id))) GROUP BY context""",
    B.VEC,
)
def _(spark, sf):
    two = B.vectors(spark, sf).withColumn("s", (F.col("treatment") > 0).cast("int"))
    return M.energy_distance(two, ["context"], "s", "x").select("context", r6("energy").alias("energy"))


KNN = "kn AS (SELECT t.context, t.id, t.treatment, c.id AS other, list_distance(t.x, c.x) AS d FROM vec t JOIN vec c ON c.context = t.context AND c.treatment = 0 AND t.treatment <> 0 AND c.batch <> t.batch)"


@query("join12_nearest_controls", "SELECT context, id, other, round(d, 6) AS d, r FROM (SELECT *, row_number() OVER (PARTITION BY context, id ORDER BY d, other) AS r FROM kn) WHERE r <= 3", B.VEC, KNN)
def _(spark, sf):
    v = B.vectors(spark, sf).select("context", "batch", "treatment", "id", "x")
    n = M.neighbours(v.where("treatment <> 0"), v.where("treatment = 0"), ["context"], "x", 3, apart=F.col("batch") != F.col("o_batch"))
    return n.select("context", "id", "other", r6("d").alias("d"), F.col("r").cast("long").alias("r"))


@query(
    "met18_potency",
    """SELECT context, treatment, round(list_distance(m, c), 6) AS potency, nearest, round(nd, 6) AS isolation FROM (SELECT a.context, a.treatment, a.m, k.m AS c FROM ml a JOIN ml k ON k.context = a.context AND k.treatment = 0 AND a.treatment <> 0)
JOIN (SELECT a.context, a.treatment, arg_min(b.treatment, (round(list_distance(a.m, b.m), 9), b.treatment)) AS nearest, min(list_distance(a.m, b.m)) AS nd FROM ml a JOIN ml b ON a.context = b.context AND a.treatment <> b.treatment AND b.treatment <> 0 AND a.treatment <> 0 GROUP BY ALL) USING (context, treatment)""",
    B.VEC, MEAN, ML,
)
def _(spark, sf):
    m = _means(spark, sf).select(*CT, "m")
    treated = m.where("treatment <> 0")
    potency = treated.join(m.where("treatment = 0").select("context", F.col("m").alias("c")), "context").select(*CT, r6(distance("m", "c")).alias("potency"))
    d = treated.join(treated.toDF("context", "other", "o"), "context").where("treatment <> other").select(*CT, "other", distance("m", "o").alias("d"))
    near = d.groupBy(*CT).agg(F.min_by("other", F.struct(F.round("d", 9), F.col("other"))).alias("nearest"), r6(F.min("d")).alias("isolation"))
    return potency.join(near, CT)


@query(
    "agg35_class_structure",
    "SELECT a.context, round(avg(list_distance(a.m, b.m)) FILTER (WHERE a.treatment % 3 = b.treatment % 3), 6) AS within_class, round(avg(list_distance(a.m, b.m)) FILTER (WHERE a.treatment % 3 <> b.treatment % 3), 6) AS between_class FROM ml a JOIN ml b ON a.context = b.context AND a.treatment < b.treatment GROUP BY a.context",
    B.VEC, MEAN, ML,
)
def _(spark, sf):
    m = _means(spark, sf).select(*CT, "m")
    p = m.join(m.toDF("context", "other", "o"), "context").where("treatment < other").select("context", (F.col("treatment") % 3 == F.col("other") % 3).alias("same"), distance("m", "o").alias("d"))
    return p.groupBy("context").agg(r6(F.avg(F.when(F.col("same"), F.col("d")))).alias("within_class"), r6(F.avg(F.when(~F.col("same"), F.col("d")))).alias("between_class"))


@query("ml06_trivial_predictors", "SELECT t.context, t.treatment, round(list_distance(t.m, c.m), 6) AS control_copy, round(list_distance(t.m, g.m), 6) AS global_mean FROM ml t JOIN ml c ON c.context = t.context AND c.treatment = 0 CROSS JOIN (SELECT list(m ORDER BY idx) AS m FROM (SELECT idx, avg(v) AS m FROM vl GROUP BY idx)) g WHERE t.treatment <> 0", B.VEC, MEAN, ML)
def _(spark, sf):
    m = _means(spark, sf).select(*CT, "m")
    overall = B.vectors(spark, sf).agg(R.mean_vector("x").alias("g"))  # one row
    j = m.where("treatment <> 0").join(m.where("treatment = 0").select("context", F.col("m").alias("c")), "context").join(F.broadcast(overall))
    return j.select(*CT, r6(distance("m", "c")).alias("control_copy"), r6(distance("m", "g")).alias("global_mean"))


@query(
    "agg09_displacement_levels",
    "SELECT context, treatment, idx, round(avg(v), 6) AS m, count(*) AS n FROM vl GROUP BY GROUPING SETS ((context, treatment, idx), (treatment, idx)) HAVING count(*) >= 8",
    B.VEC,
)
def _(spark, sf):
    v = B.vectors(spark, sf)
    fine = v.groupBy("context", "treatment").agg(R.mean_vector("x").alias("m"), F.count("*").alias("n"))
    pooled = v.groupBy("treatment").agg(R.mean_vector("x").alias("m"), F.count("*").alias("n")).select(F.lit(None).cast("long").alias("context"), "treatment", "m", "n")
    return _long(fine.unionByName(pooled).where("n >= 8"), ["context", "treatment", "n"], "m", "m")


@query(
    "agg12_shift_ladder",
    "SELECT CASE WHEN grouping(context) = 0 AND grouping(cls) = 0 THEN 'class x context' WHEN grouping(context) = 0 THEN 'context' WHEN grouping(cls) = 0 THEN 'class' ELSE 'all' END AS rung, context, cls, round(avg(size), 6) AS size, count(*) AS n FROM (SELECT context, treatment % 3 AS cls, sqrt(list_inner_product(s, s)) AS size FROM rl) GROUP BY GROUPING SETS ((), (context), (cls), (context, cls))",
    B.VEC, HALF, GEN,
)
def _(spark, sf):
    _residuals(spark, sf).select("context", (F.col("treatment") % 3).alias("cls"), norm("shift").alias("size")).createOrReplaceTempView("quillon_ladder")
    return spark.sql("SELECT CASE WHEN grouping(context) = 0 AND grouping(cls) = 0 THEN 'class x context' WHEN grouping(context) = 0 THEN 'context' WHEN grouping(cls) = 0 THEN 'class' ELSE 'all' END AS rung, context, cls, round(avg(size), 6) AS size, count(*) AS n FROM quillon_ladder GROUP BY GROUPING SETS ((), (context), (cls), (context, cls))")


@query(
    "agg22_kappa",
    "SELECT treatment, context, round(sqrt(sum(k * k)), 6) AS size, max(n) AS others FROM (SELECT treatment, context, r - (sum(r) OVER w - r) / nullif(count(*) OVER w - 1, 0) AS k, count(*) OVER w - 1 AS n FROM rs WINDOW w AS (PARTITION BY treatment, idx)) WHERE n >= 2 GROUP BY ALL",
    B.VEC, HALF, GEN,
)
def _(spark, sf):
    r = _residuals(spark, sf).select("treatment", "context", "residual")
    total = r.groupBy("treatment").agg(R.sum_vector("residual").alias("s"), F.count("*").alias("n"))
    k = r.join(total, "treatment").where("n >= 3").withColumn("k", F.zip_with("residual", "s", lambda x, s: x - (s - x) / (F.col("n") - 1)))
    return k.select("treatment", "context", r6(norm("k")).alias("size"), (F.col("n") - 1).alias("others"))


@query("top03_top_feature_sets", "SELECT a.context, a.treatment AS x, b.treatment AS y, 12 - count(*) AS divergence FROM tf a JOIN tf b ON a.context = b.context AND a.idx = b.idx AND a.treatment < b.treatment GROUP BY ALL", B.VEC, HALF, GEN, "tf AS (SELECT context, treatment, idx FROM rs QUALIFY row_number() OVER (PARTITION BY context, treatment ORDER BY round(abs(r), 9) DESC, idx) <= 12)")
def _(spark, sf):
    long = _residuals(spark, sf).select(*CT, F.posexplode("residual").alias("idx", "v"))
    r = F.row_number().over(Window.partitionBy(*CT).orderBy(F.desc(F.round(F.abs("v"), 9)), "idx"))
    top = long.withColumn("r", r).where("r <= 12").groupBy(*CT).agg(F.collect_set("idx").alias("s"))
    p = top.join(top.toDF("context", "y", "t"), "context").where("treatment < y").withColumn("i", F.size(F.array_intersect("s", "t"))).where("i > 0")
    return p.select("context", F.col("treatment").alias("x"), "y", (12 - F.col("i")).cast("long").alias("divergence"))


@query(
    "met23_distance_agreement",
    """SELECT p, q, round(corr(x, y), 6) AS mantel, round(stddev_samp(d) / avg(d), 6) AS cv_p, round(stddev_samp(e) / avg(e), 6) AS cv_q FROM (SELECT *, rank() OVER (PARTITION BY p, q ORDER BY d) + (count(*) OVER (PARTITION BY p, q, d) - 1) / 2.0 AS x, rank() OVER (PARTITION BY p, q ORDER BY e) + (count(*) OVER (PARTITION BY p, q, e) - 1) / 2.0 AS y
FROM (SELECT a.context AS p, b.context AS q, a.d, b.d AS e FROM td a JOIN td b ON a.treatment = b.treatment AND a.other = b.other AND a.context < b.context)) GROUP BY p, q""",
    B.VEC, MEAN, ML, "td AS (SELECT a.context, a.treatment, b.treatment AS other, round(list_distance(a.m, b.m), 9) AS d FROM ml a JOIN ml b ON a.context = b.context AND a.treatment < b.treatment)",
)
def _(spark, sf):
    """Rank correlation of the distances between treatments in every two contexts."""
    from ..operators.cells import average_rank

    m = _means(spark, sf).select(*CT, "m")
    d = m.join(m.toDF("context", "other", "o"), "context").where("treatment < other").select("treatment", "other", "context", F.round(distance("m", "o"), 9).alias("d"))
    both = d.toDF("treatment", "other", "p", "d").join(d.toDF("treatment", "other", "q", "e"), ["treatment", "other"]).where("p < q")
    ranked = both.select("p", "q", "d", "e", average_rank("d", ["p", "q"]).alias("x"), average_rank("e", ["p", "q"]).alias("y"))
    cv = lambda c: r6(F.stddev_samp(c) / F.avg(c))
    return ranked.groupBy("p", "q").agg(r6(corr_agg("x", "y")).alias("mantel"), cv("d").alias("cv_p"), cv("e").alias("cv_q"))
