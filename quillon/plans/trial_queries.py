"""Queries of pairings, scores, resampling, splits and compositions of whole evaluations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.core import corr_agg, cosine, distance, hash_order, minus, norm, plus, r6, reject, safe_div, scaled
from ..operators import cells as C
from ..operators import inference as I
from ..operators import metrics as M
from ..operators import protocols as PT
from ..operators import residuals as R
from . import bindings as B
from .base import query
from .cell_queries import BOTH, LIB, PAIR, PR, PX, _both, _pairs, _px, _ranks
from .design_queries import SPLIT, _split
from .inference_queries import POIS, VALUE, _scores
from .vector_queries import CT, FINE, GEN, HALF, MEAN, ML, _fine_shifts, _means, _residuals, _shifts

# --- pairings ---------------------------------------------------------------


@query("join06_panel_with_aliases", "SELECT n.n_nationkey AS idx, n.n_name AS wanted, coalesce(v.name, a.name) AS feature FROM nation n LEFT JOIN (SELECT n_name AS name FROM nation WHERE n_nationkey % 3 <> 0) v ON v.name = n.n_name LEFT JOIN (SELECT n_regionkey AS id, min(n_name) AS name FROM nation WHERE n_nationkey % 3 <> 0 GROUP BY 1) a ON a.id = n.n_regionkey WHERE coalesce(v.name, a.name) IS NOT NULL")
def _(spark, sf):
    """Wanted features in their order: by name where the vocabulary has it, else by the least name of the same id."""
    wanted = B.table(spark, sf, "nation").select(F.col("n_nationkey").alias("idx"), F.col("n_name").alias("wanted"), F.col("n_regionkey").alias("id"))
    vocabulary = wanted.where("idx % 3 <> 0").select(F.col("wanted").alias("name"), "id")
    direct = vocabulary.select(F.col("name").alias("wanted"), F.col("name").alias("_d"))
    alias = vocabulary.groupBy("id").agg(F.min("name").alias("_a"))
    return wanted.join(direct, "wanted", "left").join(alias, "id", "left").select("idx", "wanted", F.coalesce("_d", "_a").alias("feature")).where("feature is not null")


@query("join07_paired_records", "SELECT count(*) AS n, round(avg(m - b), 6) AS delta, round(stddev_samp(m - b), 6) AS sd FROM (SELECT id, CASE WHEN id % 5 > 0 THEN value END AS m FROM sc) x JOIN (SELECT id, CASE WHEN id % 7 > 0 THEN other END AS b FROM sc) y USING (id) WHERE m IS NOT NULL AND b IS NOT NULL", B.VEC, VALUE)
def _(spark, sf):
    s = _scores(spark, sf)
    model, base = s.select("id", F.when(F.col("id") % 5 > 0, F.col("value")).alias("m")), s.select("id", F.when(F.col("id") % 7 > 0, F.col("other")).alias("b"))
    d = model.join(base, "id").where("m is not null and b is not null").withColumn("d", F.col("m") - F.col("b"))
    return d.agg(F.count("*").alias("n"), r6(F.avg("d")).alias("delta"), r6(F.stddev_samp("d")).alias("sd"))


@query("join08_paired_by_position", "SELECT treatment, count(*) AS pairs, count(*) FILTER (WHERE x.batch = y.batch) AS aligned, round(avg(x.value - y.value) FILTER (WHERE x.batch = y.batch), 6) AS delta FROM (SELECT *, row_number() OVER (PARTITION BY treatment ORDER BY id) AS r FROM sc WHERE context = 0) x JOIN (SELECT *, row_number() OVER (PARTITION BY treatment ORDER BY id) AS r FROM sc WHERE context = 1) y USING (treatment, r) GROUP BY treatment", B.VEC, VALUE)
def _(spark, sf):
    """Records of two files paired by their place; only pairs whose other keys agree are scored."""
    place = F.row_number().over(Window.partitionBy("treatment").orderBy("id"))
    side = lambda c: _scores(spark, sf).where(F.col("context") == c).select("treatment", place.alias("r"), F.col("batch").alias(f"batch_{c}"), F.col("value").alias(f"v_{c}"))
    both = side(0).join(side(1), ["treatment", "r"]).withColumn("ok", F.col("batch_0") == F.col("batch_1"))
    return both.groupBy("treatment").agg(F.count("*").alias("pairs"), F.count_if("ok").alias("aligned"), r6(F.avg(F.when(F.col("ok"), F.col("v_0") - F.col("v_1")))).alias("delta"))


def _random_sql(seed: str, allowed: str) -> str:
    return f"""nm AS (SELECT *, row_number() OVER (ORDER BY {B.hash_sql(seed, "key")}, key) - 1 AS i FROM (SELECT DISTINCT context || '/' || treatment AS key, context, treatment FROM vec)),
dw AS (SELECT draw, {B.hash_sql(seed, "'a'", "draw")} % (SELECT count(*) FROM nm) AS a, {B.hash_sql(seed, "'b'", "draw")} % (SELECT count(*) FROM nm) AS b FROM range(0, 480) t(draw)),
pk AS (SELECT x.key AS a, y.key AS b, min(draw) AS draw FROM dw JOIN nm x ON x.i = dw.a JOIN nm y ON y.i = dw.b WHERE dw.a < dw.b AND {allowed} GROUP BY ALL ORDER BY draw LIMIT 60)"""


for _name, _seed, _allowed, _when in (
    ("join10_cross_group_pairs", "cross", "x.context <> y.context AND x.treatment <> y.treatment", "a_context <> b_context and a_treatment <> b_treatment"),
    ("smp02_constrained_pairs", "same", "x.context <> y.context AND x.treatment = y.treatment", "a_context <> b_context and a_treatment = b_treatment"),
):

    @query(_name, "SELECT a, b, draw FROM pk", B.VEC, _random_sql(_seed, _allowed))
    def _(spark, sf, seed=_seed, when=_when):
        items = B.vectors(spark, sf).select(F.concat_ws("/", "context", "treatment").alias("key"), *CT).distinct()
        return PT.random_pairs(items, "key", 60, 8, seed, F.expr(when)).select(F.col("a_key").alias("a"), F.col("b_key").alias("b"), "draw")


@query("join16_batch_mates", "SELECT context, batch, treatment, count(*) OVER (PARTITION BY context, batch, treatment % 3) - 1 AS mates FROM (SELECT DISTINCT context, batch, treatment FROM vec)", B.VEC)
def _(spark, sf):
    """How many other treatments of one's class the batch holds: a count over the group, no pairs."""
    t = B.vectors(spark, sf).select("context", "batch", "treatment").distinct()
    return t.select("context", "batch", "treatment", (F.count("*").over(Window.partitionBy("context", "batch", F.col("treatment") % 3)) - 1).alias("mates"))


@query("join17_atlas_lookup", "SELECT id, round(size, 6) AS size FROM vec LEFT JOIN (SELECT context, treatment, sqrt(sum(f * f)) AS size FROM sh GROUP BY ALL) USING (context, treatment)", B.VEC, HALF)
def _(spark, sf):
    atlas = _shifts(spark, sf).select(*CT, norm("shift").alias("size"))
    return B.vectors(spark, sf).select("id", *CT).join(atlas, CT, "left").select("id", r6("size").alias("size"))


@query("join20_train_partners", "SELECT p.treatment, p.context, count(q.context) AS partners FROM sp p LEFT JOIN (SELECT * FROM sp WHERE split = 'train') q ON q.treatment = p.treatment AND q.context <> p.context GROUP BY ALL", B.VEC, SPLIT)
def _(spark, sf):
    """Partners come from the training part only."""
    s = _split(spark, sf).select("treatment", "context", "split")
    pool = s.where("split = 'train'").groupBy("treatment").agg(F.collect_set("context").alias("pool"))
    n = F.size(F.array_except(F.coalesce("pool", F.array().cast("array<bigint>")), F.array("context")))
    return s.join(pool, "treatment", "left").select("treatment", "context", n.cast("long").alias("partners"))


@query("join22_selection_exclusion", "SELECT context, count(*) AS n FROM vec WHERE context NOT IN (SELECT context FROM vec GROUP BY context ORDER BY count(DISTINCT treatment) DESC, context LIMIT 1) GROUP BY context", B.VEC)
def _(spark, sf):
    """Contexts that chose the settings take no part in the evaluation."""
    v = B.vectors(spark, sf)
    chosen = v.groupBy("context").agg(F.countDistinct("treatment").alias("n")).orderBy(F.desc("n"), "context").limit(1).select("context")
    return v.join(F.broadcast(chosen), "context", "left_anti").groupBy("context").agg(F.count("*").alias("n"))


# --- frames and conditions --------------------------------------------------


@query(
    "agg17_condition_weighted_generic",
    """SELECT context, batch, treatment, round(sqrt(sum(r * r)), 6) AS size, round(sum(r * g), 6) AS dot, round(sqrt(greatest(0, sum(s * s) - sum(s * g) ** 2 / sum(g * g))), 6) AS apart FROM (
SELECT *, s - g AS r FROM (SELECT b.*, (sum(s) OVER (PARTITION BY context, idx) - sum(s) OVER (PARTITION BY context, treatment, idx)) / nullif(count(*) OVER (PARTITION BY context, idx) - count(*) OVER (PARTITION BY context, treatment, idx), 0) AS g FROM bs b)) WHERE g IS NOT NULL GROUP BY ALL""",
    B.VEC, FINE,
)
def _(spark, sf):
    """A generic in which every condition weighs the same, its own treatment left out; residual, and the part apart from it."""
    c = _fine_shifts(spark, sf).select("context", "batch", "treatment", "shift")
    total = c.groupBy("context").agg(R.sum_vector("shift").alias("s"), F.count("*").alias("n"))
    own = c.groupBy(*CT).agg(R.sum_vector("shift").alias("o"), F.count("*").alias("k"))
    g = c.join(total, "context").join(own, CT).where("n > k").withColumn("g", scaled(minus("s", "o"), 1 / (F.col("n") - F.col("k")))).withColumn("r", minus("shift", "g"))
    dot_ = F.aggregate(F.zip_with("r", "g", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return g.select("context", "batch", "treatment", r6(norm("r")).alias("size"), r6(dot_).alias("dot"), r6(norm(reject("shift", "g"))).alias("apart"))


@query("agg18_scope_shifts", "SELECT scope, count(*) AS n, round(avg(size), 6) AS size FROM (SELECT 'context' AS scope, sqrt(sum(f * f)) AS size FROM sh GROUP BY context, treatment UNION ALL SELECT 'batch', sqrt(sum(s * s)) FROM bs GROUP BY context, batch, treatment) GROUP BY scope", B.VEC, HALF, FINE)
def _(spark, sf):
    """The same builder at two scopes."""
    one = lambda df, name: df.select(F.lit(name).alias("scope"), norm("shift").alias("size"))
    both = one(_shifts(spark, sf), "context").unionByName(one(_fine_shifts(spark, sf), "batch"))
    return both.groupBy("scope").agg(F.count("*").alias("n"), r6(F.avg("size")).alias("size"))


@query("agg19_profile_frames", "SELECT 'full' AS frame, context, treatment, round(sqrt(sum(m * m)), 6) AS size FROM cm WHERE treatment <> 0 GROUP BY ALL UNION ALL SELECT 'shift', context, treatment, round(sqrt(sum(f * f)), 6) FROM sh GROUP BY ALL UNION ALL SELECT 'residual', context, treatment, round(sqrt(sum(r * r)), 6) FROM rs GROUP BY ALL", B.VEC, MEAN, HALF, GEN)
def _(spark, sf):
    frames = {"full": (_means(spark, sf).where("treatment <> 0"), "m"), "shift": (_shifts(spark, sf), "shift"), "residual": (_residuals(spark, sf), "residual")}
    parts = [df.select(F.lit(name).alias("frame"), *CT, r6(norm(c)).alias("size")) for name, (df, c) in frames.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("agg21_collapsed_conditions", "SELECT context, treatment, list(batch ORDER BY batch) AS batches, sum(n)::BIGINT AS cells, round(any_value(size), 6) AS size FROM (SELECT DISTINCT context, batch, treatment, n FROM bs JOIN nb USING (context, batch, treatment)) JOIN (SELECT context, treatment, sqrt(sum(m * m)) AS size FROM (SELECT context, treatment, idx, avg(s) AS m FROM bs GROUP BY ALL) GROUP BY ALL) USING (context, treatment) GROUP BY ALL", B.VEC, FINE)
def _(spark, sf):
    c = _fine_shifts(spark, sf)
    out = c.groupBy(*CT).agg(F.array_sort(F.collect_set("batch")).alias("batches"), F.sum("n").cast("long").alias("cells"), R.mean_vector("shift").alias("m"))
    return out.select(*CT, "batches", "cells", r6(norm("m")).alias("size"))


@query("agg45_reliable_share", "SELECT context, round(avg((list_cosine_similarity(ra, rb) > 0)::INT), 6) AS share, round(median(list_cosine_similarity(ra, rb)), 6) AS middle, count(*) AS n FROM rl GROUP BY context", B.VEC, HALF, GEN)
def _(spark, sf):
    return _residuals(spark, sf).groupBy("context").agg(r6(F.avg((F.col("repro_cos") > 0).cast("double"))).alias("share"), r6(F.percentile("repro_cos", F.lit(0.5))).alias("middle"), F.count("*").alias("n"))


# --- scores -----------------------------------------------------------------

TAU = """(SELECT a, b, (c - d) / nullif(sqrt((c + d + tx)::DOUBLE * (c + d + ty)), 0) AS tau FROM (SELECT p.a, p.b, count(*) FILTER (WHERE (p.x - q.x) * (p.y - q.y) > 0) AS c, count(*) FILTER (WHERE (p.x - q.x) * (p.y - q.y) < 0) AS d,
count(*) FILTER (WHERE p.x = q.x AND p.y <> q.y) AS ty, count(*) FILTER (WHERE p.y = q.y AND p.x <> q.x) AS tx FROM {0} p JOIN {0} q ON p.a = q.a AND p.b = q.b AND p.idx < q.idx GROUP BY p.a, p.b))"""


def _lists(both):
    return both.groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct("idx", "x", "y"))).alias("p"))


@query(
    "met07_scalar_bundle",
    f"""SELECT a, b, n_shared, round(r, 6) AS spearman, round(tau, 6) AS tau, round(moved, 6) AS mean_move, hits / 10.0 AS top_overlap, round(sx, 6) AS set_true, round(sy, 6) AS set_predicted, round(level, 6) AS level_r FROM
(SELECT a, b, count(*) FILTER (WHERE x < 41 AND y < 41) AS n_shared, CASE WHEN var_pop(x) > 1e-12 AND var_pop(y) > 1e-12 THEN corr(x, y) END AS r, avg(abs(x - y)) AS moved, count(*) FILTER (WHERE x <= 10 AND y <= 10) AS hits, avg(x) FILTER (WHERE idx % 4 = 0) AS sx, avg(y) FILTER (WHERE idx % 4 = 0) AS sy FROM bo GROUP BY a, b)
LEFT JOIN {TAU.format("bo")} USING (a, b) LEFT JOIN lv USING (a, b)""",
    B.SENT, PR, PAIR, BOTH, "lv AS (SELECT a, b, CASE WHEN count(*) >= 5 AND var_pop(u) > 1e-12 AND var_pop(v) > 1e-12 THEN corr(u, v) END AS level FROM (SELECT a, b, greatest(0, 3.1 - 0.8 * log10(x)) AS u, greatest(0, 3.1 - 0.8 * log10(y)) AS v FROM bo WHERE x < 41 AND y < 41) GROUP BY a, b)",
)
def _(spark, sf):
    """All scalar metrics of a predicted and a true sentence, the block of a named set of features among them."""
    return _bundle(spark, sf)


def _bundle(spark, sf):
    both = _both(spark, sf)
    shared = (F.col("x") < 41) & (F.col("y") < 41)
    level = lambda c: F.when(shared, F.greatest(F.lit(0.0), 3.1 - 0.8 * F.log10(c)))
    named = F.col("idx") % 4 == 0
    n = F.count_if(shared)
    out = both.groupBy("a", "b").agg(
        n.alias("n_shared"), r6(corr_agg("x", "y")).alias("spearman"), r6(F.avg(F.abs(F.col("x") - F.col("y")))).alias("mean_move"), (F.count_if((F.col("x") <= 10) & (F.col("y") <= 10)) / 10).alias("top_overlap"),
        r6(F.avg(F.when(named, F.col("x")))).alias("set_true"), r6(F.avg(F.when(named, F.col("y")))).alias("set_predicted"), r6(F.when(n >= 5, corr_agg(level("x"), level("y")))).alias("level_r"), F.array_sort(F.collect_list(F.struct("idx", "x", "y"))).alias("p"),
    )
    return out.withColumn("tau", r6(M.kendall_tau("p.x", "p.y"))).drop("p")


@query("met09_level_correlation", "SELECT a, b, round(CASE WHEN n >= 5 AND su > 1e-12 AND sv > 1e-12 THEN r END, 6) AS r FROM (SELECT a, b, count(*) AS n, var_pop(u) AS su, var_pop(v) AS sv, corr(u, v) AS r FROM (SELECT a, b, greatest(0, 3.1 - 0.8 * log10(x)) AS u, greatest(0, 3.1 - 0.8 * log10(y)) AS v FROM bo WHERE x < 41 AND y < 41) GROUP BY a, b)", B.SENT, PR, PAIR, BOTH)
def _(spark, sf):
    level = lambda c: F.greatest(F.lit(0.0), 3.1 - 0.8 * F.log10(c))
    both = _both(spark, sf).where("x < 41 and y < 41").withColumn("u", level("x")).withColumn("v", level("y"))
    return both.groupBy("a", "b").agg(F.count("*").alias("n"), corr_agg("u", "v").alias("r")).select("a", "b", r6(F.when(F.col("n") >= 5, F.col("r"))).alias("r"))


@query("met36_top_tau", f"SELECT a, b, round(tau, 6) AS tau FROM {TAU.format('tp')}", B.SENT, PR, PAIR, BOTH, "tp AS (SELECT * FROM bo WHERE y <= 10)")
def _(spark, sf):
    """Kendall's tau over the features that the reference ranks first."""
    lists = _lists(_both(spark, sf).where("y <= 10")).where(F.size("p") > 1)
    return lists.select("a", "b", r6(M.kendall_tau("p.x", "p.y")).alias("tau"))


@query("ml17_set_reward", f"SELECT a, b, round(t.tau, 6) AS overall, round(s.tau, 6) AS named, round(0.5 * coalesce(t.tau, 0) + 0.5 * coalesce(s.tau, 0), 6) AS reward FROM {TAU.format('bo')} t LEFT JOIN {TAU.format('ns')} s USING (a, b)", B.SENT, PR, PAIR, BOTH, "ns AS (SELECT * FROM bo WHERE idx % 4 = 0)")
def _(spark, sf):
    """Rewards by tau over all features and over a named set."""
    both = _both(spark, sf)
    tau = lambda df, name: _lists(df).select("a", "b", M.kendall_tau("p.x", "p.y").alias(name))
    out = tau(both, "overall").join(tau(both.where("idx % 4 = 0"), "named"), ["a", "b"], "left")
    return out.select("a", "b", r6("overall").alias("overall"), r6("named").alias("named"), r6(0.5 * F.coalesce("overall", F.lit(0.0)) + 0.5 * F.coalesce("named", F.lit(0.0))).alias("reward"))


@query("met38_step_agreement", "SELECT a, b, count(*) FILTER (WHERE x < 41 AND y < 41) AS common, round(count(*) FILTER (WHERE x < 41 AND y < 41) / nullif(count(*) FILTER (WHERE y < 41), 0)::DOUBLE, 6) AS overlap, round(corr(x, y) FILTER (WHERE x < 41 AND y < 41), 6) AS r FROM bo GROUP BY a, b HAVING count(*) FILTER (WHERE x < 41 AND y < 41) >= 20", B.SENT, PR, PAIR, BOTH)
def _(spark, sf):
    """How far one step's output keeps the features and the order of the step before."""
    common, wanted = (F.col("x") < 41) & (F.col("y") < 41), F.col("y") < 41
    out = _both(spark, sf).groupBy("a", "b").agg(F.count_if(common).alias("common"), F.count_if(wanted).alias("n"), corr_agg(F.when(common, F.col("x")), F.when(common, F.col("y"))).alias("r"))
    return out.where("common >= 20").select("a", "b", "common", r6(safe_div("common", "n")).alias("overlap"), r6("r").alias("r"))


@query("met39_effect_readout", f"SELECT n.treatment, n.context, count(*) AS n, round(avg(y.tau - x.tau), 6) AS toward, round(stddev_samp(y.tau - x.tau) / sqrt(count(*)), 6) AS noise FROM {TAU.format('bo')} x JOIN {TAU.format('bo')} y ON y.a = x.b JOIN sn n ON n.id = x.b WHERE x.tau IS NOT NULL AND y.tau IS NOT NULL GROUP BY ALL", B.SENT, PR, PAIR, BOTH)
def _(spark, sf):
    """How much nearer by tau an output is to one reference (the next sentence) than to another (the one before), with its noise."""
    tau = _lists(_both(spark, sf)).select("a", "b", M.kendall_tau("p.x", "p.y").alias("tau")).where("tau is not null")
    both = tau.select(F.col("b").alias("id"), F.col("tau").alias("before")).join(tau.select(F.col("a").alias("id"), F.col("tau").alias("after")), "id")
    gain = both.withColumn("gain", F.col("after") - F.col("before")).join(B.sentences(spark, sf).select("id", "treatment", "context"), "id")
    return gain.groupBy("treatment", "context").agg(F.count("*").alias("n"), r6(F.avg("gain")).alias("toward"), r6(F.stddev_samp("gain") / F.sqrt(F.count("*"))).alias("noise"))


GAL = "gl AS (SELECT q.context, q.treatment, o.treatment AS other, round(list_cosine_similarity(q.ra, own.rb), 9) AS own, round(list_cosine_similarity(q.ra, o.rb), 9) AS sim FROM rl q JOIN rl own ON own.context = q.context AND own.treatment = q.treatment JOIN rl o ON o.context = q.context)"


@query("met14_retrieval_with_self", "SELECT context, treatment, round(sum((sim < own)::INT) / (count(*) - 1)::DOUBLE, 6) AS nir FROM gl GROUP BY ALL HAVING count(*) > 1", B.VEC, HALF, GEN, GAL)
def _(spark, sf):
    """The gallery holds one's own item too; the share is of the others' number."""
    r = _residuals(spark, sf)
    q = r.select(*CT, minus("shift_a", "generic").alias("q"), minus("shift_b", "generic").alias("o")).withColumn("own", F.round(cosine("q", "o"), 9))
    pairs = q.join(q.select("context", F.col("o").alias("v")), "context").withColumn("sim", F.round(cosine("q", "v"), 9))
    return pairs.groupBy(*CT).agg(F.count("*").alias("n"), F.count_if(F.col("sim") < F.col("own")).alias("k")).where("n > 1").select(*CT, r6(F.col("k") / (F.col("n") - 1)).alias("nir"))


HB = "hb AS (SELECT context, treatment, list(a ORDER BY idx) AS a, list(b ORDER BY idx) AS b FROM sh GROUP BY ALL)"


@query("met17_distinctiveness", "SELECT q.context, q.treatment, round(avg((round(list_distance(q.a, q.b), 9) < round(list_distance(q.a, o.b), 9))::INT), 6) AS distinct_share FROM hb q JOIN hb o ON o.context = q.context AND o.treatment <> q.treatment GROUP BY ALL", B.VEC, HALF, HB)
def _(spark, sf):
    """The share of other treatments whose half is farther from one's half than one's own other half."""
    s = _shifts(spark, sf)
    side = lambda c: s.select(*CT, F.col(c).alias("v"))
    g = M.gallery(side("shift_a"), side("shift_b"), ["context"], "treatment", "v", "distance")
    return g.groupBy(*CT).agg(r6(M.identification_rate(F.round("own", 9), F.round("sim", 9), strict=True)).alias("distinct_share"))


@query("met34_shift_correlation", "SELECT context, treatment, round(corr(f, g), 6) AS r FROM (SELECT *, row_number() OVER (PARTITION BY context, treatment ORDER BY round(abs(f), 9) DESC, idx) AS k FROM rs) WHERE k <= 16 GROUP BY ALL", B.VEC, HALF, GEN)
def _(spark, sf):
    """Correlation of true and predicted shifts over the features that truly shift most; the generic is the prediction."""
    z = _residuals(spark, sf).select(*CT, F.posexplode(F.arrays_zip("shift", "generic")).alias("idx", "z")).select(*CT, "idx", "z.shift", "z.generic")
    top = z.withColumn("k", F.row_number().over(Window.partitionBy(*CT).orderBy(F.desc(F.round(F.abs("shift"), 9)), "idx"))).where("k <= 16")
    return top.groupBy(*CT).agg(r6(corr_agg("shift", "generic")).alias("r"))


@query("met35_mean_rank_scores", "SELECT a.context, a.treatment, b.treatment AS other, round(corr(a.m, b.m), 6) AS r FROM mr a JOIN mr b ON a.context = b.context AND a.idx = b.idx AND a.treatment < b.treatment GROUP BY ALL", B.SENT, PR, "mr AS (SELECT context, treatment, w.idx, (coalesce(sum(rank), 0) + 41.0 * (n - count(rank))) / n AS m FROM (SELECT context, treatment, count(*) AS n FROM sn GROUP BY ALL) g CROSS JOIN wp w LEFT JOIN pr USING (context, treatment, idx) GROUP BY context, treatment, w.idx, n)")
def _(spark, sf):
    """Pearson's correlation of the mean-rank vectors of every two treatments in a context."""
    sizes = B.sentences(spark, sf).groupBy(*CT).agg(F.count("*").alias("n"))
    sums = _ranks(spark, sf).groupBy(*CT, "idx").agg(F.sum("rank").alias("s"), F.count("*").alias("c"))
    grid = sizes.join(F.broadcast(B.word_panel(spark, sf).select("idx"))).join(sums, [*CT, "idx"], "left")
    m = grid.select(*CT, "idx", ((F.coalesce("s", F.lit(0)) + 41.0 * (F.col("n") - F.coalesce("c", F.lit(0)))) / F.col("n")).alias("m"))
    pairs = m.join(m.toDF("context", "other", "idx", "o"), ["context", "idx"]).where("treatment < other")
    return pairs.groupBy(*CT, "other").agg(r6(corr_agg("m", "o")).alias("r"))


@query(
    "met33_named_set_ranks",
    f"""SELECT (SELECT median(r) FROM ab WHERE idx % 4 = 0) AS observed, round(avg(med), 6) AS expected, round((count(*) FILTER (WHERE med <= (SELECT median(r) FROM ab WHERE idx % 4 = 0)) + 1) / 201.0, 6) AS p FROM (SELECT draw, median(r) AS med FROM (SELECT draw, r, row_number() OVER (PARTITION BY draw ORDER BY {B.hash_sql("set", "draw", "idx")}, idx) AS k FROM ab CROSS JOIN range(0, 200) t(draw)) WHERE k <= (SELECT count(*) FROM ab WHERE idx % 4 = 0) GROUP BY draw)""",
    B.EXPR, LIB, PX, "ab AS (SELECT idx, row_number() OVER (ORDER BY round(avg(cp), 9) DESC, idx) AS r FROM px GROUP BY idx)",
)
def _(spark, sf):
    """The median abundance rank of a named set against hashed sets of its size, over a panel of features."""
    by = _px(spark, sf).groupBy("idx").agg(F.round(F.avg("cp"), 9).alias("m"))
    ab = by.select("idx", F.row_number().over(Window.orderBy(F.desc("m"), "idx")).alias("r"))  # one row for each panel feature
    named = ab.where("idx % 4 = 0").agg(F.percentile("r", F.lit(0.5)).alias("observed"), F.count("*").alias("size"))
    drawn = ab.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(199)))).join(F.broadcast(named))
    k = F.row_number().over(Window.partitionBy("draw").orderBy(hash_order("set", "draw", "idx"), "idx"))
    med = drawn.withColumn("k", k).where("k <= size").groupBy("draw", "observed").agg(F.percentile("r", F.lit(0.5)).alias("med"))
    return med.groupBy("observed").agg(r6(F.avg("med")).alias("expected"), r6((F.count_if(F.col("med") <= F.col("observed")) + 1) / F.lit(201.0)).alias("p"))


@query("ml19_probe_vectors", "SELECT context, treatment, round(list_cosine_similarity(s, g), 6) AS generic, round(-list_cosine_similarity(s, r), 6) AS opposite, round(CASE WHEN list_inner_product(a, a) > 1e-18 THEN list_inner_product(s, a) / sqrt(list_inner_product(s, s) * list_inner_product(a, a)) ELSE 0 END, 6) AS apart FROM (SELECT context, treatment, list(f ORDER BY idx) AS s, list(g ORDER BY idx) AS g, list(r ORDER BY idx) AS r, list(f - k * g ORDER BY idx) AS a FROM rs JOIN (SELECT context, treatment, sum(f * g) / sum(g * g) AS k FROM rs GROUP BY ALL) USING (context, treatment) GROUP BY ALL)", B.VEC, HALF, GEN)
def _(spark, sf):
    """What a reward of cosines gives to adversarial answers: the generic, the residual turned round, the part apart from the generic."""
    r = _residuals(spark, sf).select(*CT, F.col("shift").alias("s"), F.col("generic").alias("g"), F.col("residual").alias("e"))
    return r.select(*CT, r6(cosine("s", "g")).alias("generic"), r6(-cosine("s", "e")).alias("opposite"), r6(cosine("s", reject("s", "g"))).alias("apart"))


# --- resampling and structure -----------------------------------------------


def _poisson(u: str) -> str:
    return "(" + POIS.replace("u >=", f"{u} >=") + ")"


@query(
    "stat04_crossed_bootstrap",
    f"""SELECT (SELECT sum(c) FROM cs)::BIGINT AS n, round((SELECT sum(s) / sum(c) FROM cs), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM (SELECT draw, sum(w * s) / nullif(sum(w * c), 0) AS m FROM
(SELECT draw, s, c, {_poisson("u")} * {_poisson("v")} AS w FROM (SELECT draw, s, c, {B.hash_sql("cross", "'a'", "draw", "context")} / 4294967296.0 AS u, {B.hash_sql("cross", "'b'", "draw", "unit")} / 4294967296.0 AS v FROM cs CROSS JOIN range(0, 200) t(draw))) GROUP BY draw)""",
    B.VEC, VALUE, "cs AS (SELECT context, unit, sum(value) AS s, count(value) AS c FROM sc GROUP BY ALL)",
)
def _(spark, sf):
    out = PT.crossed_bootstrap(_scores(spark, sf), "context", "unit", "value", 200, "cross")
    return out.select("n", *[r6(c).alias(c) for c in ("mean", "lo", "hi")])


@query("stat05_multiway_variance", "SELECT (SELECT count(*) FROM sc) AS n, round((SELECT avg(value) FROM sc), 6) AS mean, round(1e6 * (SELECT sum(a.e * b.e) FROM ee a JOIN ee b ON a.context = b.context OR a.unit = b.unit OR a.treatment = b.treatment) / (SELECT count(*) FROM sc) ** 2, 6) AS variance_ppm", B.VEC, VALUE, "ee AS (SELECT sc.*, value - (SELECT avg(value) FROM sc) AS e FROM sc)")
def _(spark, sf):
    """Three nodes for each row; the oracle sums over all pairs of rows that share one."""
    name = lambda c: F.concat(F.lit(c + ":"), F.col(c))
    v = PT.multiway_variance(_scores(spark, sf).withColumn("nodes", F.array(name("context"), name("unit"), name("treatment"))), "value", "nodes")
    return v.select("n", r6("mean").alias("mean"), r6(1e6 * F.col("variance")).alias("variance_ppm"))


DUPE = """du AS (SELECT q.context, q.treatment, list_cosine_similarity(list_transform(range(1, 65), lambda i: 0.5 * q.a[i] + 0.5 * g.m[i]), q.b) AS pos, list_cosine_similarity(g.m, q.b) AS neg, 1.0 AS full_, 1 - list_distance(list_transform(range(1, 65), lambda i: 0.5 * q.a[i] + 0.5 * g.m[i]), q.b) AS dpos, 1 - list_distance(g.m, q.b) AS dneg, 1.0 AS dfull
FROM hb q JOIN (SELECT context, list(m ORDER BY idx) AS m FROM (SELECT context, idx, avg(a) AS m FROM sh GROUP BY ALL) GROUP BY context) g USING (context)),
dr AS (SELECT 'cosine' AS metric, treatment, sum(pos) AS pos, sum(neg) AS neg, sum(full_) AS f FROM du GROUP BY treatment UNION ALL SELECT 'distance', treatment, sum(dpos), sum(dneg), sum(dfull) FROM du GROUP BY treatment)"""


def _duplicates(spark, sf):
    """Each treatment's half, drawn half-way to the context's mean, scored against its other half, with both ends of the scale."""
    s = _shifts(spark, sf).select(*CT, "shift_a", "shift_b")
    mean = s.groupBy("context").agg(R.mean_vector("shift_a").alias("m"))
    d = s.join(mean, "context").withColumn("dup", plus(scaled("shift_a", 0.5), scaled("m", 0.5)))
    return d.select(*CT, cosine("dup", "shift_b").alias("pos"), cosine("m", "shift_b").alias("neg"), (1 - distance("dup", "shift_b")).alias("dpos"), (1 - distance("m", "shift_b")).alias("dneg"), F.lit(1.0).alias("full"))


@query("met20_interpolated_duplicate", "SELECT context, treatment, round(pos, 6) AS pos, round(neg, 6) AS neg, round(dpos, 6) AS dpos, round(dneg, 6) AS dneg FROM du", B.VEC, HALF, HB, DUPE)
def _(spark, sf):
    return _duplicates(spark, sf).select(*CT, *[r6(c).alias(c) for c in ("pos", "neg", "dpos", "dneg")])


@query(
    "stat18_range_fraction_test",
    f"""SELECT metric, round(fraction, 6) AS fraction, round(lo, 6) AS lo, round(hi, 6) AS hi, round(p, 6) AS p, round(least(1, max((2 - k + 1) * p) OVER (ORDER BY k)), 6) AS holm FROM (SELECT *, row_number() OVER (ORDER BY p, metric) AS k FROM (
SELECT metric, fraction, quantile_cont(f, 0.025) AS lo, quantile_cont(f, 0.975) AS hi, (count(*) FILTER (WHERE f - fraction >= fraction - 1e-12) + 1) / 201.0 AS p FROM (SELECT metric, draw, sum(w * (pos - neg)) / nullif(sum(w * (f - neg)), 0) AS f FROM (SELECT *, {_poisson("u")} AS w FROM (SELECT dr.*, draw, {B.hash_sql("drf", "draw", "treatment")} / 4294967296.0 AS u FROM dr CROSS JOIN range(0, 200) t(draw))) GROUP BY ALL)
JOIN (SELECT metric, sum(pos - neg) / sum(f - neg) AS fraction FROM dr GROUP BY metric) USING (metric) GROUP BY metric, fraction))""",
    B.VEC, HALF, HB, DUPE,
)
def _(spark, sf):
    """The share of a metric's range that an interpolated duplicate reaches, with interval, one-sided p and Holm's p."""
    d = _duplicates(spark, sf)
    rows = d.select(F.lit("cosine").alias("metric"), "treatment", "pos", "neg", "full").unionByName(d.select(F.lit("distance").alias("metric"), "treatment", F.col("dpos").alias("pos"), F.col("dneg").alias("neg"), "full"))
    tested = PT.range_fraction_test(rows, "metric", "treatment", 200, "drf").withColumn("family", F.lit("all"))
    out = I.adjusted(tested, "p", ["family"], "metric")
    return out.select("metric", *[r6(c).alias(c) for c in ("fraction", "lo", "hi", "p", "holm")])


GAP = "ga AS (SELECT s.*, CASE WHEN split = 'train' THEN 'train' ELSE 'held' END AS part FROM sc s JOIN sp USING (treatment, context)), gu AS (SELECT part, 'value' AS stratum, treatment, context, value AS v FROM ga UNION ALL SELECT part, 'other', treatment, context, other FROM ga), gm AS (SELECT *, v - avg(v) OVER (PARTITION BY part, stratum) AS e, count(*) OVER (PARTITION BY part, stratum) AS n FROM gu)"


def _parts(spark, sf):
    s = _scores(spark, sf).join(_split(spark, sf).select(*CT, "split"), CT)
    return s.withColumn("part", F.when(F.col("split") == "train", "train").otherwise("held"))


def _clustered(rows, group, cluster, value):
    """group, n, mean, variance of a mean under one clustering."""
    e = rows.withColumn("_e", F.col(value) - F.avg(value).over(Window.partitionBy(*group)))
    by = e.groupBy(*group, cluster).agg(F.sum("_e").alias("_s"), F.count("*").alias("_c"), F.sum(value).alias("_v"))
    g = F.count("*")
    return by.groupBy(*group).agg(F.sum("_c").alias("n"), (F.sum("_v") / F.sum("_c")).alias("mean"), F.when(g > 1, g / (g - 1) * F.sum(F.col("_s") * F.col("_s")) / F.pow(F.sum("_c"), 2)).alias("variance"))


def _one_way(cluster: str) -> str:
    return f"(SELECT part, stratum, count(*) / nullif(count(*) - 1.0, 0) * sum(s * s) / any_value(n) ** 2 AS v FROM (SELECT part, stratum, {cluster}, sum(e) AS s, any_value(n) AS n FROM gm GROUP BY ALL) GROUP BY ALL)"


@query("stat21_gap_by_stratum", f"SELECT part, stratum, m.n, round(m.mean, 6) AS mean, round(sqrt(t.v), 6) AS se_treatment, round(sqrt(c.v), 6) AS se_context FROM (SELECT part, stratum, count(*) AS n, avg(v) AS mean FROM gu GROUP BY ALL) m JOIN {_one_way('treatment')} t USING (part, stratum) JOIN {_one_way('context')} c USING (part, stratum)", B.VEC, VALUE, SPLIT, GAP)
def _(spark, sf):
    long = _parts(spark, sf).select("part", *CT, "value", "other").unpivot(["part", *CT], ["value", "other"], "stratum", "v")
    both = _clustered(long, ["part", "stratum"], "treatment", "v").join(_clustered(long, ["part", "stratum"], "context", "v").select("part", "stratum", F.col("variance").alias("vc")), ["part", "stratum"])
    return both.select("part", "stratum", "n", r6("mean").alias("mean"), r6(F.sqrt("variance")).alias("se_treatment"), r6(F.sqrt("vc")).alias("se_context"))


@query("stat22_difference_of_arms", "SELECT round(max(mean) FILTER (WHERE part = 'train') - max(mean) FILTER (WHERE part = 'held'), 6) AS difference, round(sqrt(sum(v)), 6) AS se, sum(n)::BIGINT AS n FROM (SELECT part, count(*) AS g, sum(n) AS n, any_value(mean) AS mean, count(*) / (count(*) - 1.0) * sum(s * s) / sum(n) ** 2 AS v FROM (SELECT part, treatment, count(*) AS n, sum(e) AS s, any_value(mean) AS mean FROM (SELECT *, avg(value) OVER (PARTITION BY part) AS mean, value - avg(value) OVER (PARTITION BY part) AS e FROM ga WHERE treatment IN (SELECT treatment FROM ga GROUP BY treatment HAVING count(DISTINCT part) = 2)) GROUP BY ALL) GROUP BY part)", B.VEC, VALUE, SPLIT, GAP)
def _(spark, sf):
    """Two arms compared on the treatments that both have."""
    rows = _parts(spark, sf)
    shared = rows.groupBy("treatment").agg(F.countDistinct("part").alias("k")).where("k = 2").select("treatment")
    arms = _clustered(rows.join(shared, "treatment", "left_semi"), ["part"], "treatment", "value")
    side = lambda p: F.max(F.when(F.col("part") == p, F.col("mean")))
    return arms.agg(r6(side("train") - side("held")).alias("difference"), r6(F.sqrt(F.sum("variance"))).alias("se"), F.sum("n").alias("n"))


KAPPA = "kp AS (SELECT treatment, context, list(k ORDER BY idx) AS k FROM (SELECT treatment, context, idx, r - (sum(r) OVER w - r) / nullif(count(*) OVER w - 1, 0) AS k, count(*) OVER w AS n FROM rs WINDOW w AS (PARTITION BY treatment, idx)) WHERE n >= 3 GROUP BY ALL)"


def _kappa(spark, sf):
    r = _residuals(spark, sf).select("treatment", "context", "residual")
    total = r.groupBy("treatment").agg(R.sum_vector("residual").alias("s"), F.count("*").alias("n"))
    return r.join(total, "treatment").where("n >= 3").select("treatment", "context", F.zip_with("residual", "s", lambda x, s: x - (s - x) / (F.col("n") - 1)).alias("k"))


@query("stat25_interaction_structure", "SELECT kind, count(*) AS n, round(avg(c), 6) AS mean FROM (SELECT 'same treatment' AS kind, list_cosine_similarity(a.k, b.k) AS c FROM kp a JOIN kp b ON a.treatment = b.treatment AND a.context < b.context UNION ALL SELECT 'same context', list_cosine_similarity(a.k, b.k) FROM kp a JOIN kp b ON a.context = b.context AND a.treatment < b.treatment) GROUP BY kind", B.VEC, HALF, GEN, KAPPA)
def _(spark, sf):
    """Whether interactions point alike within a treatment, or within a context. Pairs are of conditions, not of rows."""
    k = _kappa(spark, sf)
    pair = lambda same, by, name: k.toDF("treatment", "context", "a").join(k.toDF(*["_t" if c == by and by == "treatment" else "_c" if c == by else c for c in ("treatment", "context")], "b"), same).where(F.col(by) < F.col("_t" if by == "treatment" else "_c")).select(F.lit(name).alias("kind"), cosine("a", "b").alias("c"))
    both = pair("treatment", "context", "same treatment").unionByName(pair("context", "treatment", "same context"))
    return both.groupBy("kind").agg(F.count("*").alias("n"), r6(F.avg("c")).alias("mean"))


@query(
    "stat26_interaction_channel",
    f"""SELECT round(any_value(seen), 6) AS gap, round((count(*) FILTER (WHERE gap >= seen - 1e-12) + 1) / 101.0, 6) AS p FROM (SELECT x.draw, avg(c) FILTER (WHERE x.cls = y.cls) - avg(c) FILTER (WHERE x.cls <> y.cls) AS gap FROM kc JOIN lb x ON x.treatment = kc.a JOIN lb y ON y.draw = x.draw AND y.treatment = kc.b GROUP BY x.draw), (SELECT avg(c) FILTER (WHERE a % 3 = b % 3) - avg(c) FILTER (WHERE a % 3 <> b % 3) AS seen FROM kc)""",
    B.VEC, HALF, GEN, KAPPA, "kc AS (SELECT a.treatment AS a, b.treatment AS b, round(list_cosine_similarity(a.k, b.k), 9) AS c FROM kp a JOIN kp b ON a.context = b.context AND a.treatment < b.treatment)",
    f"""kt AS (SELECT treatment, row_number() OVER (ORDER BY treatment) AS r FROM (SELECT DISTINCT treatment FROM kp)),
lb AS (SELECT draw, treatment, c.cls FROM (SELECT draw, treatment, row_number() OVER (PARTITION BY draw ORDER BY {B.hash_sql("perm", "draw", "treatment")}, treatment) AS r FROM kt CROSS JOIN range(0, 100) t(draw)) p JOIN (SELECT r, treatment % 3 AS cls FROM kt) c USING (r))""",
)
def _(spark, sf):
    """Mean cosine of interactions of one class less that of two, against labels permuted by hashes."""
    k = _kappa(spark, sf)
    pairs = k.toDF("a", "context", "x").join(k.toDF("b", "context", "y"), "context").where("a < b").select("a", "b", F.round(cosine("x", "y"), 9).alias("c"))
    t = k.select("treatment").distinct().withColumn("r", F.row_number().over(Window.orderBy("treatment")))  # one row for each treatment
    moved = t.select("treatment", F.explode(F.sequence(F.lit(0), F.lit(99))).alias("draw"))
    moved = moved.withColumn("r", F.row_number().over(Window.partitionBy("draw").orderBy(hash_order("perm", "draw", "treatment"), "treatment"))).join(t.select("r", (F.col("treatment") % 3).alias("cls")), "r").drop("r")
    gap = lambda same: F.avg(F.when(same, F.col("c"))) - F.avg(F.when(~same, F.col("c")))
    seen = pairs.agg(gap(F.col("a") % 3 == F.col("b") % 3).alias("seen"))
    null = pairs.join(moved.toDF("a", "draw", "ca"), "a").join(moved.toDF("b", "draw", "cb"), ["b", "draw"]).groupBy("draw").agg(gap(F.col("ca") == F.col("cb")).alias("gap"))
    return null.join(F.broadcast(seen)).groupBy("seen").agg(r6((F.count_if(F.col("gap") >= F.col("seen") - 1e-12) + 1) / F.lit(101.0)).alias("p")).select(r6("seen").alias("gap"), "p")


@query(
    "stat28_forced_choice",
    f"""SELECT share, count(*) AS trials, round(avg(CASE WHEN own < foil THEN 1 WHEN own = foil THEN 0.5 ELSE 0 END), 6) AS accuracy FROM (SELECT share, round(list_distance(q.a, list_transform(range(1, 65), lambda i: (1 - share) * q.b[i] + share * o.b[i])), 9) AS own, round(list_distance(q.a, o.b), 9) AS foil FROM nx q JOIN nx o ON o.context = q.context AND o.i = (q.i + 1) % q.n CROSS JOIN (SELECT unnest([0.0, 0.3, 1.0]) AS share) WHERE q.n > 1) GROUP BY share""",
    B.VEC, HALF, HB, f"nx AS (SELECT *, row_number() OVER (PARTITION BY context ORDER BY {B.hash_sql('foil', 'treatment')}, treatment) - 1 AS i, count(*) OVER (PARTITION BY context) AS n FROM hb)",
)
def _(spark, sf):
    """Which of two references is nearer to a half: one's own, mixed with a share of the foil, or the foil."""
    w = Window.partitionBy("context")
    s = _shifts(spark, sf).select(*CT, "shift_a", "shift_b").withColumn("i", F.row_number().over(w.orderBy(hash_order("foil", "treatment"), "treatment")) - 1).withColumn("n", F.count("*").over(w))
    foil = s.select("context", F.col("i").cast("long").alias("j"), F.col("shift_b").alias("f"))
    pairs = s.where("n > 1").withColumn("j", F.pmod(F.col("i") + 1, F.col("n")).cast("long")).join(foil, ["context", "j"]).withColumn("share", F.explode(F.array(*[F.lit(x) for x in (0.0, 0.3, 1.0)])))
    mixed = F.zip_with("shift_b", "f", lambda x, y: (1 - F.col("share")) * x + F.col("share") * y)
    own, other = F.round(distance("shift_a", mixed), 9), F.round(distance("shift_a", "f"), 9)
    return pairs.groupBy("share").agg(F.count("*").alias("trials"), r6(F.avg(F.when(own < other, 1.0).when(own == other, 0.5).otherwise(0.0))).alias("accuracy"))


BL = "bl AS (SELECT context, batch, treatment, list(s ORDER BY idx) AS s FROM bs GROUP BY ALL)"


@query("stat29_similarity_gap", "SELECT kind, count(*) AS n, round(avg(c), 6) AS mean FROM (SELECT CASE WHEN a.treatment = b.treatment THEN 'same treatment, other batch' WHEN a.batch = b.batch THEN 'other treatment, same batch' WHEN a.treatment % 3 = b.treatment % 3 THEN 'same class, other batch' ELSE 'other class, other batch' END AS kind, list_cosine_similarity(a.s, b.s) AS c FROM bl a JOIN bl b ON a.context = b.context AND (a.batch < b.batch OR (a.batch = b.batch AND a.treatment < b.treatment))) GROUP BY kind", B.VEC, FINE, BL)
def _(spark, sf):
    """Similarity of conditions by what they share. Pairs are of conditions of one context."""
    c = _fine_shifts(spark, sf).select("context", "batch", "treatment", "shift")
    p = c.toDF("context", "ba", "ta", "a").join(c.toDF("context", "bb", "tb", "b"), "context").where("ba < bb or (ba = bb and ta < tb)")
    kind = F.when(F.col("ta") == F.col("tb"), "same treatment, other batch").when(F.col("ba") == F.col("bb"), "other treatment, same batch").when(F.col("ta") % 3 == F.col("tb") % 3, "same class, other batch").otherwise("other class, other batch")
    return p.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), r6(F.avg(cosine("a", "b"))).alias("mean"))


@query("stat30_noise_ceiling", "SELECT context, count(*) AS n, round(avg(list_cosine_similarity(x, loo)), 6) AS ceiling FROM (SELECT id, context, treatment, list(v ORDER BY idx) AS x, list(l ORDER BY idx) AS loo FROM (SELECT id, context, treatment, idx, v, (sum(v) OVER w - v) / nullif(count(*) OVER w - 1, 0) AS l, count(*) OVER w AS n FROM vl WINDOW w AS (PARTITION BY context, treatment, idx)) WHERE n > 1 GROUP BY ALL) GROUP BY context", B.VEC)
def _(spark, sf):
    """Each row against the mean of the other rows of its condition."""
    v = B.vectors(spark, sf)
    total = v.groupBy(*CT).agg(R.sum_vector("x").alias("s"), F.count("*").alias("n"))
    loo = v.join(total, CT).where("n > 1").withColumn("l", F.zip_with("s", "x", lambda a, b: (a - b) / (F.col("n") - 1)))
    return loo.groupBy("context").agg(F.count("*").alias("n"), r6(F.avg(cosine("x", "l"))).alias("ceiling"))


@query("stat33_batch_leak_audit", "SELECT scope, count(*) AS n, round(avg(c), 6) AS ceiling FROM (SELECT 'cross batch' AS scope, list_cosine_similarity(a.s, b.s) AS c FROM bl a JOIN bl b ON a.context = b.context AND a.treatment = b.treatment AND a.batch < b.batch UNION ALL SELECT 'within', list_cosine_similarity(a, b) FROM hb) GROUP BY scope", B.VEC, HALF, HB, FINE, BL)
def _(spark, sf):
    """The ceiling between batches against that between halves of the same rows."""
    c = _fine_shifts(spark, sf).select("context", "treatment", "batch", "shift")
    cross = c.toDF(*CT, "p", "a").join(c.toDF(*CT, "q", "b"), CT).where("p < q").select(F.lit("cross batch").alias("scope"), cosine("a", "b").alias("c"))
    both = cross.unionByName(_shifts(spark, sf).select(F.lit("within").alias("scope"), cosine("shift_a", "shift_b").alias("c")))
    return both.groupBy("scope").agg(F.count("*").alias("n"), r6(F.avg("c")).alias("ceiling"))


def _normal_sql(*parts: str) -> str:
    u = lambda k: f"(({B.hash_sql('sim', f"'{k}'", *parts)} + 0.5) / 4294967296.0)"
    return f"sqrt(-2 * ln({u('u')})) * cos(2 * pi() * {u('v')})"


@query(
    "stat34_planted_interaction",
    f"""SELECT planted, round(sum(pow(y - t - c + g, 2)) / sum(pow(y - g, 2)), 6) AS recovered FROM (SELECT *, avg(y) OVER (PARTITION BY planted, treatment) AS t, avg(y) OVER (PARTITION BY planted, context) AS c, avg(y) OVER (PARTITION BY planted) AS g FROM (
SELECT planted, treatment, context, sqrt(1 - planted) * ({_normal_sql("'t'", "treatment")} + {_normal_sql("'c'", "context")}) / sqrt(2) + sqrt(planted) * {_normal_sql("'i'", "treatment", "context")} AS y FROM (SELECT DISTINCT treatment FROM vec) CROSS JOIN (SELECT DISTINCT context FROM vec) CROSS JOIN (SELECT unnest([0.0, 0.25, 0.5, 1.0]) AS planted))) GROUP BY planted""",
    B.VEC,
)
def _(spark, sf):
    """Values simulated with a known share of interaction, and the share that the decomposition finds."""
    unit = lambda k, *p: (hash_order("sim", F.lit(k), *p) + 0.5) / F.lit(float(2**32))
    normal = lambda *p: F.sqrt(-2 * F.ln(unit("u", *p))) * F.cos(2 * F.pi() * unit("v", *p))
    v = B.vectors(spark, sf)
    grid = v.select("treatment").distinct().join(F.broadcast(v.select("context").distinct()))  # short lists of names
    rows = grid.withColumn("planted", F.explode(F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 1.0)])))
    y = F.sqrt(1 - F.col("planted")) * (normal(F.lit("t"), "treatment") + normal(F.lit("c"), "context")) / F.sqrt(F.lit(2.0)) + F.sqrt("planted") * normal(F.lit("i"), "treatment", "context")
    mean = lambda *k: F.avg("y").over(Window.partitionBy("planted", *k))
    e = rows.withColumn("y", y).withColumn("t", mean("treatment")).withColumn("c", mean("context")).withColumn("g", mean())
    return e.groupBy("planted").agg(r6(F.sum(F.pow(F.col("y") - F.col("t") - F.col("c") + F.col("g"), 2)) / F.sum(F.pow(F.col("y") - F.col("g"), 2))).alias("recovered"))


@query("stat36_held_out_gate", "SELECT context, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value) / sqrt(count(*)), 6) AS se FROM ga WHERE part = 'held' GROUP BY context", B.VEC, VALUE, SPLIT, GAP)
def _(spark, sf):
    held = _parts(spark, sf).where("part = 'held'")
    return held.groupBy("context").agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean"), r6(F.stddev_samp("value") / F.sqrt(F.count("*"))).alias("se"))


@query(
    "stat38_two_sided_bootstrap",
    f"""SELECT treatment, round(least(1, greatest(1 / 200.0, 2 * least(avg((m <= 0)::INT), avg((m >= 0)::INT)))), 6) AS p FROM (SELECT treatment, draw, sum(w * s) / nullif(sum(w * c), 0) AS m FROM (SELECT *, {_poisson("u")} AS w FROM (SELECT cs.*, draw, {B.hash_sql("two", "draw", "unit")} / 4294967296.0 AS u FROM cs CROSS JOIN range(0, 200) t(draw))) GROUP BY ALL) GROUP BY treatment""",
    B.VEC, VALUE, "cs AS (SELECT treatment, unit, sum(value) AS s, count(value) AS c FROM sc GROUP BY ALL)",
)
def _(spark, sf):
    sums = _scores(spark, sf).groupBy("treatment", "unit").agg(F.sum("value").alias("s"), F.count("value").alias("c"))
    drawn = sums.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(199)))).withColumn("w", PT.poisson_weight(PT.unit_hash("two", "draw", "unit")))
    means = drawn.groupBy("treatment", "draw").agg(safe_div(F.sum(F.col("w") * F.col("s")), F.nullif(F.sum(F.col("w") * F.col("c")), F.lit(0))).alias("m"))
    return means.groupBy("treatment").agg(r6(PT.two_sided_p("m", 200)).alias("p"))


@query("stat40_pooled_family", "SELECT arm, layer, slice, round(p, 6) AS p, round(least(1, min(n * p / k) OVER (ORDER BY k DESC)), 6) AS bh FROM (SELECT *, row_number() OVER (ORDER BY p, key) AS k, count(*) OVER () AS n FROM (SELECT context AS arm, batch AS layer, slice, context || '-' || batch || '-' || slice AS key, round(1 / (1 + abs(m * slice) * 10), 9) AS p FROM (SELECT context, batch, avg(value) AS m FROM sc GROUP BY ALL) CROSS JOIN (SELECT unnest([1, 2, 4]) AS slice)))", B.VEC, VALUE)
def _(spark, sf):
    """One test for each arm, layer and amplitude, corrected as one family."""
    by = _scores(spark, sf).groupBy(F.col("context").alias("arm"), F.col("batch").alias("layer")).agg(F.avg("value").alias("m")).withColumn("slice", F.explode(F.array(F.lit(1), F.lit(2), F.lit(4))))
    tests = by.withColumn("p", F.round(1 / (1 + F.abs(F.col("m") * F.col("slice")) * 10), 9)).withColumn("key", F.concat_ws("-", "arm", "layer", "slice")).withColumn("family", F.lit("all"))
    return I.adjusted(tests, "p", ["family"], "key").select("arm", "layer", "slice", r6("p").alias("p"), r6("bh").alias("bh"))


# --- splits -----------------------------------------------------------------


@query("spl04_external_tiers", "SELECT label, count(*) AS n FROM (SELECT CASE WHEN t.treatment IS NOT NULL THEN 'unseen_treatment' WHEN c.context IS NOT NULL THEN 'unseen_pair' ELSE 'train' END AS label FROM (SELECT DISTINCT treatment, context FROM vec) v LEFT JOIN (SELECT DISTINCT label::BIGINT AS treatment FROM embeddings WHERE label % 5 = 1) t USING (treatment) LEFT JOIN (SELECT DISTINCT label::BIGINT AS treatment, 2::BIGINT AS context FROM embeddings WHERE label % 5 = 2) c USING (treatment, context)) GROUP BY label", B.VEC)
def _(spark, sf):
    """A split taken from tier files; refused where too few of the files' keys are known here."""
    pairs = B.vectors(spark, sf).select(*CT).distinct()
    tier3, tier2 = pairs.where("treatment % 5 = 1").select("treatment").distinct(), pairs.where("treatment % 5 = 2").select("treatment", F.lit(2).cast("long").alias("context")).distinct()
    known = tier3.join(pairs.select("treatment").distinct().withColumn("here", F.lit(True)), "treatment", "left")
    PT.require_share(known, F.coalesce("here", F.lit(False)), 0.5, "share of the tier's treatments that the data hold")
    out = pairs.join(tier3.withColumn("t", F.lit(1)), "treatment", "left").join(tier2.withColumn("c", F.lit(1)), ["treatment", "context"], "left")
    label = F.when(F.col("t") == 1, "unseen_treatment").when(F.col("c") == 1, "unseen_pair").otherwise("train")
    return out.groupBy(label.alias("label")).agg(F.count("*").alias("n"))


@query("spl08_train_share", "SELECT round(avg((split = 'train')::INT), 6) AS share FROM sp", B.VEC, SPLIT)
def _(spark, sf):
    """The training share, refused below a quarter."""
    share = PT.require_share(_split(spark, sf), F.col("split") == "train", 0.25, "training share")
    return spark.createDataFrame([(share,)], "share double").select(r6("share").alias("share"))


@query("spl09_regenerated_tier", f"SELECT id FROM vec WHERE treatment IN (SELECT treatment FROM sp WHERE split = 'unseen_treatment') AND treatment NOT IN (SELECT treatment FROM sp WHERE split = 'train') QUALIFY row_number() OVER (PARTITION BY treatment ORDER BY {B.hash_sql('regen', 'id')}, id) <= 8", B.VEC, SPLIT)
def _(spark, sf):
    """The held-out tier made anew: never a treatment of the training part, a few rows each."""
    s = _split(spark, sf)
    held = s.where("split = 'unseen_treatment'").select("treatment").distinct().join(s.where("split = 'train'").select("treatment").distinct(), "treatment", "left_anti")
    r = F.row_number().over(Window.partitionBy("treatment").orderBy(hash_order("regen", "id"), "id"))
    return B.vectors(spark, sf).join(held, "treatment", "left_semi").withColumn("r", r).where("r <= 8").select("id")


@query("spl10_scramble_target", f"SELECT a.treatment, coalesce(arg_min(b.treatment, ({B.hash_sql('target', 'a.treatment', 'b.treatment')}, b.treatment)) FILTER (WHERE a.treatment % 3 <> b.treatment % 3), arg_min(b.treatment, ({B.hash_sql('target', 'a.treatment', 'b.treatment')}, b.treatment))) AS target FROM (SELECT DISTINCT treatment FROM vec) a JOIN (SELECT DISTINCT treatment FROM vec) b ON a.treatment <> b.treatment GROUP BY a.treatment", B.VEC)
def _(spark, sf):
    """Another treatment for each, of another class where there is one. Pairs are of treatment names."""
    t = B.vectors(spark, sf).select("treatment").distinct()
    p = t.join(t.toDF("other"), F.col("treatment") != F.col("other"))
    key = F.struct(hash_order("target", "treatment", "other"), F.col("other"))
    apart = F.when(F.col("treatment") % 3 != F.col("other") % 3, key)
    return p.groupBy("treatment").agg(F.coalesce(F.min_by("other", apart), F.min_by("other", key)).alias("target"))


# --- whole protocols --------------------------------------------------------


@query(
    "drv01_build_examples",
    f"""SELECT split, count(*) AS examples, count(*) FILTER (WHERE c.id IS NOT NULL) AS with_control, sum(length('Context: ' || t.context || chr(10) || 'Treatment: ' || t.treatment || ', dose: unknown, mechanism: unclear' || chr(10) || coalesce('Control cell sentence: ' || c.sentence || chr(10), '') || 'Perturbed cell sentence:'))::BIGINT AS prompt_chars, sum(length(t.sentence))::BIGINT AS response_chars
FROM tx t LEFT JOIN (SELECT context, count(*) AS k FROM cx GROUP BY context) k USING (context) LEFT JOIN cx c ON c.context = t.context AND c.i = {B.hash_sql("pick", "t.id")} % k.k GROUP BY split""",
    B.SENT,
    f"""nt AS (SELECT id FROM pr GROUP BY id HAVING count(*) >= 5), ctl AS (SELECT min(treatment) AS name FROM sn),
cx AS (SELECT context, id, sentence, row_number() OVER (PARTITION BY context ORDER BY {B.hash_sql("ctl", "id")}, id) - 1 AS i FROM sn WHERE treatment = (SELECT name FROM ctl) AND id IN (SELECT id FROM nt) QUALIFY i < 6),
tx AS (SELECT *, CASE WHEN {B.hash_sql("held", "treatment", "context")} % 4 = 0 THEN 'unseen_pair' ELSE 'train' END AS split FROM sn WHERE treatment <> (SELECT name FROM ctl) AND id IN (SELECT id FROM nt) QUALIFY row_number() OVER (PARTITION BY context, treatment ORDER BY {B.hash_sql("cap", "id")}, id) <= 12)""".replace("nt AS", PR + ",\nnt AS", 1),
)
def _(spark, sf):
    """Quality gate, cap for each condition, a matched control from a capped pool, prompt and split: one example a row."""
    out = _examples(spark, sf)
    return out.groupBy("split").agg(F.count("*").alias("examples"), F.count("control").alias("with_control"), F.sum(F.length("prompt")).alias("prompt_chars"), F.sum(F.length("sentence")).alias("response_chars"))


def _examples(spark, sf):
    from ..operators import prompts as P
    from ..operators import sampling as S

    s = B.sentences(spark, sf)
    good = _ranks(spark, sf).groupBy("id").agg(F.count("*").alias("n")).where("n >= 5").select("id")
    name = s.agg(F.min("treatment").alias("name"))  # one row: which treatment is the control
    rows = s.join(good, "id", "left_semi").join(F.broadcast(name)).withColumn("is_control", F.col("treatment") == F.col("name")).drop("name")
    pool = rows.where("is_control").select("context", F.col("sentence").alias("control"), (F.row_number().over(Window.partitionBy("context").orderBy(hash_order("ctl", "id"), "id")) - 1).cast("long").alias("i")).where("i < 6")
    treated = S.first_per_key(rows.where("not is_control"), CT, 12, [hash_order("cap", "id"), "id"])
    sizes = pool.groupBy("context").agg(F.count("*").alias("k"))
    joined = treated.join(sizes, "context", "left").withColumn("i", F.pmod(hash_order("pick", "id"), F.col("k"))).join(pool, ["context", "i"], "left")
    split = F.when(hash_order("held", "treatment", "context") % 4 == 0, "unseen_pair").otherwise("train")
    prompt = P.prompt(F.col("context"), F.col("treatment"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("control"))
    return joined.withColumn("split", split).withColumn("prompt", prompt)


@query(
    "drv02_evaluate_tier",
    f"""SELECT x.treatment, count(*) AS n, count(tau) AS scored, round(avg(r), 6) AS spearman, round(avg(tau), 6) AS tau, round(avg(moved), 6) AS mean_move, round(1.96 * stddev_samp(moved) / sqrt(count(*)), 6) AS half FROM
(SELECT a, b, CASE WHEN nt.n / 40.0 >= 0.2 AND var_pop(x) > 1e-12 AND var_pop(y) > 1e-12 THEN corr(x, y) END AS r, avg(abs(x - y)) AS moved, nt.n / 40.0 >= 0.2 AS ok FROM bo JOIN nt ON nt.id = a GROUP BY a, b, nt.n) m
LEFT JOIN (SELECT a, b, tau FROM {TAU.format("bo")} t JOIN nt ON nt.id = t.a WHERE nt.n / 40.0 >= 0.2) USING (a, b) JOIN sn x ON x.id = m.a GROUP BY x.treatment""",
    B.SENT, PR, PAIR, BOTH, "nt AS (SELECT s.id, count(pr.tok) AS n FROM sn s LEFT JOIN pr ON pr.id = s.id GROUP BY s.id)",
)
def _(spark, sf):
    """Predicted and true sentences scored by the whole bundle, thin predictions nulled, averaged by treatment."""
    n = _ranks(spark, sf).groupBy("id").agg(F.count("*").alias("n")).withColumnRenamed("id", "a")
    enough = F.coalesce("n", F.lit(0)) / 40 >= 0.2
    scored = _both(spark, sf).groupBy("a", "b").agg(corr_agg("x", "y").alias("r"), F.avg(F.abs(F.col("x") - F.col("y"))).alias("moved"), F.array_sort(F.collect_list(F.struct("idx", "x", "y"))).alias("p"))
    scored = scored.withColumn("tau", M.kendall_tau("p.x", "p.y")).join(n, "a", "left").join(B.sentences(spark, sf).select(F.col("id").alias("a"), "treatment"), "a")
    scored = scored.withColumn("r", PT.guarded(F.col("r"), enough)).withColumn("tau", PT.guarded(F.col("tau"), enough))
    return scored.groupBy("treatment").agg(F.count("*").alias("n"), F.count("tau").alias("scored"), r6(F.avg("r")).alias("spearman"), r6(F.avg("tau")).alias("tau"), r6(F.avg("moved")).alias("mean_move"), r6(1.96 * F.stddev_samp("moved") / F.sqrt(F.count("*"))).alias("half"))


@query(
    "drv04_reward_pooling",
    f"""SELECT size, count(*) AS n, round(avg(c), 6) AS mean FROM (SELECT size, k.context, k.treatment, list_cosine_similarity(k.m, c.m) AS c FROM (SELECT size, context, treatment, list(m ORDER BY idx) AS m FROM (SELECT size, context, treatment, idx, avg(v) AS m FROM pv GROUP BY ALL) GROUP BY ALL) k JOIN ml c USING (context, treatment)) GROUP BY size""",
    B.VEC, MEAN, ML, f"pv AS (SELECT size, context, treatment, unnest(x) AS v, unnest(range(0, len(x))) AS idx FROM (SELECT *, row_number() OVER (PARTITION BY context, treatment ORDER BY {B.hash_sql('pool', 'id')}, id) AS r FROM vec) JOIN (SELECT unnest([1, 2, 4, 8, 16, 40]) AS size) ON r <= size)",
)
def _(spark, sf):
    """How near the mean of the first m rows comes to the whole condition's, as m grows."""
    r = F.row_number().over(Window.partitionBy(*CT).orderBy(hash_order("pool", "id"), "id"))
    rows = B.vectors(spark, sf).withColumn("r", r).withColumn("size", F.explode(F.array(*[F.lit(m) for m in (1, 2, 4, 8, 16, 40)]))).where("r <= size")
    pooled = rows.groupBy("size", *CT).agg(R.mean_vector("x").alias("p")).join(_means(spark, sf).select(*CT, "m"), CT)
    return pooled.groupBy("size").agg(F.count("*").alias("n"), r6(F.avg(cosine("p", "m"))).alias("mean"))


@query("drv05_score_by_fill", "SELECT fill, count(*) AS n, round(avg(r), 6) AS mean, round(1.96 * stddev_samp(r) / sqrt(count(r)), 6) AS half FROM (SELECT a, b, fill, CASE WHEN var_pop(x) > 1e-12 AND var_pop(y) > 1e-12 THEN corr(x, y) END AS r FROM (SELECT a, b, fill, CASE WHEN x < 41 THEN x WHEN fill = 'tail' THEN 40 ELSE 20 END AS x, CASE WHEN y < 41 THEN y WHEN fill = 'tail' THEN 40 ELSE 20 END AS y FROM bo CROSS JOIN (SELECT unnest(['tail', 'half']) AS fill)) GROUP BY ALL) GROUP BY fill", B.SENT, PR, PAIR, BOTH)
def _(spark, sf):
    """Scores under two conventions for features that a sentence lacks."""
    both = _both(spark, sf).withColumn("fill", F.explode(F.array(F.lit("tail"), F.lit("half"))))
    put = lambda c: F.when(F.col(c) < 41, F.col(c)).when(F.col("fill") == "tail", 40).otherwise(20)
    r = both.withColumn("x", put("x")).withColumn("y", put("y")).groupBy("a", "b", "fill").agg(corr_agg("x", "y").alias("r"))
    return r.groupBy("fill").agg(F.count("*").alias("n"), r6(F.avg("r")).alias("mean"), r6(1.96 * F.stddev_samp("r") / F.sqrt(F.count("r"))).alias("half"))
