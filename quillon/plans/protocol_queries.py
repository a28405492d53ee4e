"""Queries of gates, routing, quotas, pairing, calibration and whole protocols."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.core import corr_agg, cosine, distance, hash_order, minus, norm, plus, r6, safe_div, scaled
from ..operators import cells as C
from ..operators import inference as I
from ..operators import protocols as PT
from ..operators import residuals as R
from . import bindings as B
from .base import query
from .cell_queries import BOTH, LIB, PAIR, PR, PX, _both, _first, _pairs, _px, _ranks
from .design_queries import PROMPT, SPLIT, _prompts, _split
from .inference_queries import POIS, VALUE, _scores
from .vector_queries import CT, FINE, GEN, HALF, MEAN, ML, _fine_shifts, _long, _means, _residuals, _shifts

# --- sentences and profiles -------------------------------------------------

SIGNED = "sg AS (SELECT context, treatment, idx, r, row_number() OVER (PARTITION BY context, treatment ORDER BY round(r, 9) DESC, idx) AS u, row_number() OVER (PARTITION BY context, treatment ORDER BY round(r, 9), idx) AS d FROM rs)"


def _residual_rows(spark, sf):
    return _residuals(spark, sf).select(*CT, F.posexplode("residual").alias("idx", "value")).withColumn("value", F.round("value", 9))


@query("prj12_signed_vector", "SELECT context, treatment, idx, round(CASE WHEN r > 0 THEN 1 / log2(u + 1) ELSE -1 / log2(d + 1) END, 6) AS code FROM sg WHERE (r > 0 AND u <= 6) OR (r < 0 AND d <= 6)", B.VEC, HALF, GEN, SIGNED)
def _(spark, sf):
    """Sentences of ten features a side, read back into codes of the first six."""
    rows = _residual_rows(spark, sf).withColumn("feature", F.concat(F.lit("F"), F.col("idx")))
    panel = spark.range(64).select(F.concat(F.lit("F"), F.col("id")).alias("tok"), F.col("id").alias("idx"))
    return PT.signed_vector(C.signed_sentence(rows, CT, 10, 10), CT, panel, 6).select(*CT, "idx", r6("code").alias("code"))


for _mode, _fill in {"position": "(SELECT count(*) FROM wp) + 1", "tail": "(SELECT count(*) FROM wp)", "zero_bucket": "(SELECT count(*) FROM pr q WHERE q.id = s.id) + 1", "fixed": "(SELECT count(*) FROM wp) // 2"}.items():

    @query(f"prj16_raw_position_{_mode}", f"SELECT s.id, w.idx, coalesce(pr.pos, {_fill}) AS rank FROM sn s CROSS JOIN wp w LEFT JOIN pr ON pr.id = s.id AND pr.idx = w.idx", B.SENT, PR)
    def _(spark, sf, mode=_mode):
        return C.dense_ranks(_ranks(spark, sf), B.sentences(spark, sf).select("id"), B.word_panel(spark, sf), ["id"], mode, rank="pos").select("id", "idx", "rank")


@query("prj26_dual_bundle", "SELECT entity, idx, round(cp, 6) AS level, rank() OVER (PARTITION BY entity ORDER BY cp DESC) + (count(*) OVER (PARTITION BY entity, cp) - 1) / 2.0 AS rank FROM (SELECT entity, idx, round(sum(cp), 9) AS cp FROM px GROUP BY ALL)", B.EXPR, LIB, PX)
def _(spark, sf):
    rows = C.scaled_counts(B.counts(spark, sf), B.panel(spark, sf), ["entity"]).withColumn("cp", F.round("cp", 9))
    return rows.select("entity", "idx", r6("cp").alias("level"), C.average_rank("cp", ["entity"], descending=True).alias("rank"))


PROFILE = """pf AS (SELECT 1 AS side, u AS rank, avg(r) AS level FROM sg WHERE r > 0 AND u <= 10 GROUP BY u UNION ALL SELECT -1, d, avg(r) FROM sg WHERE r < 0 AND d <= 10 GROUP BY d)"""


@query("prj29_magnitude_decode", "SELECT context, treatment, idx, round(level, 6) AS level FROM (SELECT *, 1 AS side, u AS rank FROM sg WHERE r > 0 AND u <= 10 UNION ALL SELECT *, -1, d FROM sg WHERE r < 0 AND d <= 10) JOIN pf USING (side, rank)", B.VEC, HALF, GEN, SIGNED, PROFILE)
def _(spark, sf):
    """Features of each signed list with the mean magnitude of their rank and side."""
    rows = _residual_rows(spark, sf).withColumn("side", F.signum("value").cast("int")).where("side <> 0")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*CT, "side").orderBy(F.desc(F.abs("value")), "idx"))).where("rank <= 10")
    levels = ranked.groupBy("side", "rank").agg(F.avg("value").alias("level"))  # twenty rows
    return ranked.join(F.broadcast(levels), ["side", "rank"]).select(*CT, F.col("idx").cast("long").alias("idx"), r6("level").alias("level"))


@query("prj32_prompt_order", "SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN prompt ELSE split_part(prompt, chr(10), 2) || chr(10) || split_part(prompt, chr(10), 1) || substr(prompt, length(split_part(prompt, chr(10), 1)) + length(split_part(prompt, chr(10), 2)) + 2) END AS prompt FROM pm", PROMPT)
def _(spark, sf):
    """Context first for even conversations, treatment first for the others."""
    lines = F.split("prompt", "\n")
    swapped = F.array_join(F.concat(F.array(F.get(lines, 1), F.get(lines, 0)), F.slice(lines, 3, F.greatest(F.lit(0), F.size(lines) - 2))), "\n")
    return _prompts(spark, sf).select("conv_id", "turn", F.when(F.col("conv_id") % 2 == 0, F.col("prompt")).otherwise(swapped).alias("prompt"))


@query("prj36_template_scramble", "SELECT conv_id, turn, regexp_replace(prompt, 'Treatment: [^,]*,', 'Treatment: ZZ,') AS prompt FROM pm", PROMPT)
def _(spark, sf):
    return _prompts(spark, sf).select("conv_id", "turn", F.regexp_replace("prompt", r"(?s)^(.*?)Treatment: [^,]*,", "$1Treatment: ZZ,").alias("prompt"))


@query("agg07_pseudobulk_sentence", "SELECT context, treatment, string_agg(feature, ' ' ORDER BY s DESC, idx) || ' [END]' AS sentence, count(*) AS n FROM (SELECT context, treatment, feature, idx, sum(value) AS s FROM ex JOIN pn USING (feature) WHERE value > 0 GROUP BY ALL) GROUP BY context, treatment", B.EXPR)
def _(spark, sf):
    """Mean counts of a group order its features; the group's size is the same for all of them."""
    on = B.counts(spark, sf).where("value > 0").join(F.broadcast(B.panel(spark, sf)), "feature")
    sizes = B.counts(spark, sf).groupBy("context", "treatment").agg(F.countDistinct("entity").alias("cells"))
    mean = on.groupBy("context", "treatment", "feature", "idx").agg(F.sum("value").alias("s")).join(sizes, ["context", "treatment"])
    return C.sentence(mean.withColumn("value", F.round(F.col("s") / F.col("cells"), 12)), ["context", "treatment"])


CONS = """L AS (SELECT id, context, treatment, count(*) FILTER (WHERE tok <> '') AS len FROM tk GROUP BY ALL),
g AS (SELECT context, treatment, count(*) AS n, quantile_cont(len, 0.5) AS mid FROM L GROUP BY ALL),
s AS (SELECT ft.context, ft.treatment, tok, sum(1 - (pos - 1) / len) AS s, count(*) AS seen FROM ft JOIN L USING (id) GROUP BY ALL),
p AS (SELECT *, seen >= greatest(2, round_even(0.3 * n, 0)) AS ok, round(s / n, 9) AS score FROM s JOIN g USING (context, treatment)),
q AS (SELECT * FROM (SELECT *, bool_or(ok) OVER (PARTITION BY context, treatment) AS any_ok FROM p) WHERE ok OR NOT any_ok),
r AS (SELECT *, row_number() OVER (PARTITION BY context, treatment ORDER BY score DESC, tok) AS r FROM q)"""


@query("agg06_consensus_driver", "SELECT context, treatment, 'consensus' AS kind, any_value(n) AS cells, count(*) AS tokens FROM r WHERE r <= round_even(mid, 0) AND n >= 40 GROUP BY ALL UNION ALL SELECT context, treatment, 'passed', n, t FROM g JOIN (SELECT context, treatment, sum(len)::BIGINT AS t FROM L GROUP BY ALL) USING (context, treatment) WHERE n < 40", B.SENT, CONS)
def _(spark, sf):
    """Groups of enough sentences become one consensus; those of smaller groups pass as they are."""
    group = ["context", "treatment"]
    ids, toks = B.sentences(spark, sf).select(*group, "id"), C.tokens(B.sentences(spark, sf), [*group, "id"], stop=None)
    sizes = ids.groupBy(*group).agg(F.count("*").alias("cells"))
    big, small = sizes.where("cells >= 40"), sizes.where("cells < 40")
    made = C.consensus(toks.join(big.select(*group), group, "left_semi"), ids.join(big.select(*group), group, "left_semi"), group, "id", 0.3, 2).join(big, group)
    passed = toks.join(small, group).groupBy(*group, "cells").agg(F.count("*").alias("tokens"))
    return made.select(*group, F.lit("consensus").alias("kind"), "cells", F.col("n").alias("tokens")).unionByName(passed.select(*group, F.lit("passed").alias("kind"), "cells", "tokens"))


# --- gates and inventories --------------------------------------------------


@query("flt07_drop_reasons", "SELECT reason, count(*) AS conditions, sum(n)::BIGINT AS cells FROM (SELECT t.*, CASE WHEN t.treatment % 5 = 4 THEN 'combination' WHEN t.n < 4 THEN 'few treated' WHEN coalesce(k.n, 0) < 2 THEN 'few controls' ELSE 'kept' END AS reason FROM nb t LEFT JOIN nb k ON k.context = t.context AND k.batch = t.batch AND k.treatment = 0 WHERE t.treatment <> 0) GROUP BY reason", B.VEC, FINE)
def _(spark, sf):
    return _inventory(spark, sf).groupBy("reason").agg(F.count("*").alias("conditions"), F.sum("n").alias("cells"))


def _inventory(spark, sf):
    """Conditions by counts alone, with why each is dropped."""
    n = B.vectors(spark, sf).groupBy("context", "batch", "treatment").agg(F.count("*").alias("n"))
    controls = n.where("treatment = 0").select("context", "batch", F.col("n").alias("n_control"))
    both = n.where("treatment <> 0").join(controls, ["context", "batch"], "left")
    checks = [(F.col("treatment") % 5 == 4, "combination"), (F.col("n") < 4, "few treated"), (F.coalesce("n_control", F.lit(0)) < 2, "few controls")]
    return both.withColumn("reason", PT.drop_reason(checks))


@query("agg14_condition_inventory", "SELECT t.context, t.batch, t.treatment, t.n, k.n AS n_control, CASE WHEN t.treatment % 5 = 4 THEN 'combination' WHEN t.n < 4 THEN 'few treated' WHEN coalesce(k.n, 0) < 2 THEN 'few controls' ELSE 'kept' END AS reason FROM nb t LEFT JOIN nb k ON k.context = t.context AND k.batch = t.batch AND k.treatment = 0 WHERE t.treatment <> 0", B.VEC, FINE)
def _(spark, sf):
    return _inventory(spark, sf).select("context", "batch", "treatment", "n", "n_control", "reason")


THIN = "th AS (SELECT a, b, CASE WHEN var_pop(x) > 1e-12 AND var_pop(y) > 1e-12 THEN corr(x, y) END AS r FROM bo GROUP BY a, b), nt AS (SELECT s.id, count(pr.tok) AS n FROM sn s LEFT JOIN pr ON pr.id = s.id GROUP BY s.id)"


def _thin(spark, sf):
    r = _both(spark, sf).groupBy("a", "b").agg(corr_agg("x", "y").alias("r"))
    n = _ranks(spark, sf).groupBy("id").agg(F.count("*").alias("n"))
    return r.join(n.withColumnRenamed("id", "a"), "a", "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query("flt09_coverage_guard", "SELECT a, b, round(CASE WHEN n / 40.0 >= 0.2 THEN r END, 6) AS r FROM th JOIN nt ON nt.id = a", B.SENT, PR, PAIR, BOTH, THIN)
def _(spark, sf):
    """Rank metrics are null where the prediction covers under a fifth of the panel."""
    return _thin(spark, sf).select("a", "b", r6(PT.guarded(F.col("r"), F.col("n") / 40 >= 0.2)).alias("r"))


@query("flt10_least_predicted", "SELECT a, b, round(CASE WHEN n >= 20 THEN r END, 6) AS r FROM th JOIN nt ON nt.id = a", B.SENT, PR, PAIR, BOTH, THIN)
def _(spark, sf):
    return _thin(spark, sf).select("a", "b", r6(PT.guarded(F.col("r"), F.col("n") >= 20)).alias("r"))


@query("flt12_annotated_only", "SELECT lang, count(*) AS n, count(*) FILTER (WHERE toxic = 1) AS matched FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def _(spark, sf):
    """What has no annotation is left out, not counted as a mismatch."""
    return B.table(spark, sf, "documents").select("doc_id", "lang").join(B.table(spark, sf, "labels"), "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("matched"))


@query("flt14_finite_rows", "SELECT context, count(*) AS n FROM vec WHERE id % 7 <> 0 AND id % 11 <> 0 GROUP BY context", B.VEC)
def _(spark, sf):
    """Rows with a missing or infinite number are dropped (here some are made so)."""
    broken = F.when(F.col("id") % 7 == 0, F.lit(float("nan"))).when(F.col("id") % 11 == 0, F.lit(float("inf")))
    rows = B.vectors(spark, sf).withColumn("x", F.transform("x", lambda v, i: F.when(i == 3, F.coalesce(broken, v)).otherwise(v)))
    return rows.where(PT.finite("x")).groupBy("context").agg(F.count("*").alias("n"))


@query("agg30_dose_histogram", "SELECT doses, count(*) AS users FROM (SELECT user_id, count(DISTINCT raw_value) AS doses FROM ev GROUP BY user_id) GROUP BY doses", B.EVENT)
def _(spark, sf):
    return B.events(spark, sf).groupBy("user_id").agg(F.countDistinct("raw_value").alias("doses")).groupBy("doses").agg(F.count("*").alias("users"))


@query("agg32_unit_mapping_report", "SELECT count(*) AS units, count(*) FILTER (WHERE t > 1) AS several_treatments, count(*) FILTER (WHERE b > 1) AS several_batches, min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean FROM (SELECT unit, count(DISTINCT treatment) AS t, count(DISTINCT batch) AS b, count(*) AS n FROM vec GROUP BY unit)", B.VEC)
def _(spark, sf):
    by = B.vectors(spark, sf).groupBy("unit").agg(F.countDistinct("treatment").alias("t"), F.countDistinct("batch").alias("b"), F.count("*").alias("n"))
    return by.agg(F.count("*").alias("units"), F.count_if(F.col("t") > 1).alias("several_treatments"), F.count_if(F.col("b") > 1).alias("several_batches"), F.min("n").alias("least"), F.max("n").alias("most"), r6(F.avg("n")).alias("mean"))


@query("agg33_crossing_units", "SELECT unit, count(DISTINCT split) AS splits, count(*) AS n FROM vec JOIN sp USING (treatment, context) GROUP BY unit HAVING count(DISTINCT split) > 1", B.VEC, SPLIT)
def _(spark, sf):
    rows = B.vectors(spark, sf).select("unit", *CT).join(_split(spark, sf).select(*CT, "split"), CT)
    return rows.groupBy("unit").agg(F.countDistinct("split").alias("splits"), F.count("*").alias("n")).where("splits > 1")


@query("agg38_fraction_with_property", "SELECT treatment, round(avg((value > 0)::INT), 6) AS share FROM sc GROUP BY treatment", B.VEC, VALUE)
def _(spark, sf):
    return _scores(spark, sf).groupBy("treatment").agg(r6(F.avg((F.col("value") > 0).cast("double"))).alias("share"))


@query("agg24_nested_means", "SELECT round(avg(value), 6) AS top, round(avg(other) FILTER (WHERE id % 3 <> 0 AND id % 4 <> 0), 6) AS block_inner, round(avg(id), 6) AS block_deep_leaf FROM sc", B.VEC, VALUE)
def _(spark, sf):
    """Means of every leaf of nested records; nulls and NaN don't count."""
    inner = F.when(F.col("id") % 3 == 0, F.lit(float("nan"))).when(F.col("id") % 4 != 0, F.col("other"))
    rows = _scores(spark, sf).select(F.col("value").alias("top"), F.struct(inner.alias("inner"), F.struct(F.col("id").cast("double").alias("leaf")).alias("deep")).alias("block"))
    means = PT.nested_means(rows)
    return means.select(*[r6(c).alias(c) for c in means.columns])


@query("src20_json_records", "SELECT context, treatment, 'gate.' || CASE WHEN treatment % 2 = 0 THEN 'even' ELSE 'odd' END AS path, round(avg(value), 6) AS effect, count(*)::DOUBLE AS p FROM sc GROUP BY ALL UNION ALL SELECT context, treatment, 'overall', round(avg(other), 6), 0.5 FROM sc GROUP BY ALL", B.VEC, VALUE)
def _(spark, sf):
    """Records with effect and p, wherever they lie in nested results."""
    by = _scores(spark, sf).groupBy(*CT).agg(F.avg("value").alias("v"), F.avg("other").alias("o"), F.count("*").alias("n"))
    record = lambda e, p: F.struct(e.alias("effect"), p.alias("p"), F.lit("x").alias("note"))
    name = F.when(F.col("treatment") % 2 == 0, "even").otherwise("odd")
    text = F.to_json(F.struct(record(F.col("o"), F.lit(0.5)).alias("overall"), F.create_map(name, record(F.col("v"), F.col("n").cast("double"))).alias("gate"), F.lit(3).alias("version")))
    found = by.select(*CT, F.explode(PT.json_records(text)).alias("z"))
    return found.select(*CT, "z.path", r6("z.effect").alias("effect"), r6("z.p").alias("p"))


# --- routing, quotas, order statistics --------------------------------------


@query("win02_tier_cap", f"SELECT treatment, count(*) AS n FROM (SELECT treatment, row_number() OVER (PARTITION BY treatment ORDER BY {B.hash_sql('tier', 'id')}, id) AS r FROM vec WHERE treatment IN (SELECT treatment FROM sp WHERE split = 'unseen_treatment')) WHERE r <= 20 // (SELECT count(DISTINCT treatment) FROM sp WHERE split = 'unseen_treatment') GROUP BY treatment", B.VEC, SPLIT)
def _(spark, sf):
    """Each held-out treatment may fill an equal part of the tier."""
    held = _split(spark, sf).where("split = 'unseen_treatment'").select("treatment").distinct()
    cap = held.agg(F.floor(F.lit(20) / F.count("*")).alias("cap"))  # one row
    r = F.row_number().over(Window.partitionBy("treatment").orderBy(hash_order("tier", "id"), "id"))
    rows = B.vectors(spark, sf).join(held, "treatment", "left_semi").withColumn("r", r).join(F.broadcast(cap)).where("r <= cap")
    return rows.groupBy("treatment").agg(F.count("*").alias("n"))


ROUTE = f"""rt AS (SELECT vec.id, CASE WHEN split = 'unseen_treatment' THEN 'tier3' WHEN split = 'unseen_pair' THEN 'tier2' WHEN batch = 1 AND context = 2 THEN 'tier4' WHEN {B.hash_sql("t1", "vec.id")} % 10 = 0 THEN 'tier1' ELSE 'train' END AS tier FROM vec JOIN sp USING (treatment, context)),
rn AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY {B.hash_sql("route", "id")}, id) AS r FROM rt)"""


@query("win03_tier_routing", "SELECT tier, count(*) AS n FROM (SELECT CASE WHEN tier = 'tier1' AND r > 15 THEN 'train' ELSE tier END AS tier FROM rn WHERE NOT (tier IN ('tier2', 'tier3', 'tier4') AND r > 30)) GROUP BY tier", B.VEC, SPLIT, ROUTE)
def _(spark, sf):
    """Unseen treatment, unseen pair, held dose, a tenth, train: in this order, and only the tenth spills into train."""
    rows = B.vectors(spark, sf).select("id", "batch", *CT).join(_split(spark, sf).select(*CT, "split"), CT)
    routes = [("tier3", F.col("split") == "unseen_treatment", 30), ("tier2", F.col("split") == "unseen_pair", 30), ("tier4", (F.col("batch") == 1) & (F.col("context") == 2), 30), ("tier1", hash_order("t1", "id") % 10 == 0, 15)]
    return PT.routed(rows, routes, [hash_order("route", "id"), "id"], spill=["tier1"]).groupBy("tier").agg(F.count("*").alias("n"))


@query("win07_selection_split", f"SELECT context, treatment, count(*) FILTER (WHERE r <= s) AS selection, count(*) FILTER (WHERE r > s) AS evaluation FROM (SELECT *, least(greatest(2, round_even(0.4 * k, 0)), k - 2) AS s FROM (SELECT context, treatment, row_number() OVER (PARTITION BY context, treatment ORDER BY {B.hash_sql('sel', 'id')}, id) AS r, count(*) OVER (PARTITION BY context, treatment) AS k FROM vec)) WHERE k >= 4 GROUP BY ALL", B.VEC)
def _(spark, sf):
    w = Window.partitionBy(*CT)
    rows = B.vectors(spark, sf).withColumn("r", F.row_number().over(w.orderBy(hash_order("sel", "id"), "id"))).withColumn("k", F.count("*").over(w)).where("k >= 4")
    s = F.least(F.greatest(F.lit(2), F.bround(0.4 * F.col("k"))), F.col("k") - 2)
    return rows.groupBy(*CT).agg(F.count_if(F.col("r") <= s).alias("selection"), F.count_if(F.col("r") > s).alias("evaluation"))


DIST = "ds AS (SELECT a.context, a.treatment, b.treatment AS other, round(list_distance(a.m, b.m), 9) AS d FROM ml a JOIN ml b ON a.context = b.context AND a.treatment <> b.treatment)"


def _distances(spark, sf):
    m = _means(spark, sf).select(*CT, "m")
    return m.join(m.toDF("context", "other", "o"), "context").where("treatment <> other").select(*CT, "other", F.round(distance("m", "o"), 9).alias("d"))


@query("win14_distance_bins", "SELECT bin, count(*) AS n, round(avg(d), 6) AS mean FROM (SELECT d, (d >= q[2])::INT + (d >= q[3])::INT + (d >= q[4])::INT AS bin FROM ds, (SELECT quantile_cont(d, [0, 0.25, 0.5, 0.75, 1]) AS q FROM ds)) GROUP BY bin", B.VEC, MEAN, ML, DIST)
def _(spark, sf):
    d = _distances(spark, sf)
    edges = d.agg(F.percentile("d", F.array(*[F.lit(q) for q in (0.0, 0.25, 0.5, 0.75, 1.0)])).alias("q"))  # one row
    return d.join(F.broadcast(edges)).groupBy(PT.quantile_bin("d", F.col("q")).alias("bin")).agg(F.count("*").alias("n"), r6(F.avg("d")).alias("mean"))


@query("win15_spaced_partners", "SELECT context, treatment, other, r FROM (SELECT *, row_number() OVER (PARTITION BY context, treatment ORDER BY d, other) AS r, count(*) OVER (PARTITION BY context, treatment) AS n FROM ds) WHERE r IN (1, round_even(1 + (n - 1) * 0.25, 0), round_even(1 + (n - 1) * 0.5, 0), round_even(1 + (n - 1) * 0.75, 0), n)", B.VEC, MEAN, ML, DIST)
def _(spark, sf):
    w = Window.partitionBy(*CT)
    ranked = _distances(spark, sf).withColumn("r", F.row_number().over(w.orderBy("d", "other")).cast("long")).withColumn("n", F.count("*").over(w))
    return ranked.where(F.array_contains(PT.spaced_ranks(F.col("n"), 5), F.col("r"))).select(*CT, "other", "r")


@query("win16_headline_record", "SELECT a.context AS arm, l.batch AS layer, h.id, h.id IS NULL AS missing FROM (SELECT DISTINCT context FROM vec) a CROSS JOIN (SELECT DISTINCT batch FROM vec) l LEFT JOIN (SELECT context, batch, min(id) AS id FROM vec WHERE NOT (context = 1 AND batch = 0) GROUP BY ALL) h ON h.context = a.context AND h.batch = l.batch", B.VEC)
def _(spark, sf):
    """The first record of each arm and layer, and the cells of the grid that have none."""
    v = B.vectors(spark, sf).select(F.col("context").alias("arm"), F.col("batch").alias("layer"), "id")
    first = v.where("not (arm = 1 and layer = 0)").withColumn("r", F.row_number().over(Window.partitionBy("arm", "layer").orderBy("id"))).where("r = 1").drop("r")
    grid = v.select("arm").distinct().join(F.broadcast(v.select("layer").distinct()))  # arms and layers are short lists
    return grid.join(first, ["arm", "layer"], "left").select("arm", "layer", "id", F.col("id").isNull().alias("missing"))


@query("top04_signed_feature_sets", "SELECT context, treatment, list(idx ORDER BY idx) AS features FROM sg WHERE (r > 0 AND u <= 5) OR (r < 0 AND d <= 5) GROUP BY ALL", B.VEC, HALF, GEN, SIGNED)
def _(spark, sf):
    rows = _residual_rows(spark, sf).withColumn("side", F.signum("value")).where("side <> 0")
    top = rows.withColumn("r", F.row_number().over(Window.partitionBy(*CT, "side").orderBy(F.desc(F.abs("value")), "idx"))).where("r <= 5")
    return top.groupBy(*CT).agg(F.array_sort(F.collect_list(F.col("idx").cast("long"))).alias("features"))


@query("top07_largest_classes", "SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL ORDER BY n DESC, lang, source LIMIT 20")
def _(spark, sf):
    return B.table(spark, sf, "documents").groupBy("lang", "source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang", "source").limit(20)


@query("top08_quota_sample", "SELECT split, quota, least(coalesce(n, 0), quota) AS taken, quota - least(coalesce(n, 0), quota) AS shortfall FROM (VALUES ('train', 50), ('unseen_pair', 400), ('elsewhere', 10)) q(split, quota) LEFT JOIN (SELECT split, count(*) AS n FROM vec JOIN sp USING (treatment, context) GROUP BY split) USING (split)", B.VEC, SPLIT)
def _(spark, sf):
    rows = B.vectors(spark, sf).select("id", *CT).join(_split(spark, sf).select(*CT, "split"), CT)
    quotas = spark.createDataFrame([("train", 50), ("unseen_pair", 400), ("elsewhere", 10)], "split string, quota int")
    return PT.quota_sample(rows, "split", quotas, "quota", "id")


@query("set02_union_of_sides", "SELECT side, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT 'treated' AS side, value FROM sc WHERE treatment <> 0 UNION ALL SELECT 'control', value FROM sc WHERE treatment = 0) GROUP BY side", B.VEC, VALUE)
def _(spark, sf):
    s = _scores(spark, sf)
    both = s.where("treatment <> 0").select(F.lit("treated").alias("side"), "value").unionByName(s.where("treatment = 0").select(F.lit("control").alias("side"), "value"))
    return both.groupBy("side").agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean"))


@query("set09_retained_overlap", "SELECT count(*) FILTER (WHERE x AND y) AS both, count(*) FILTER (WHERE x OR y) AS either, round(count(*) FILTER (WHERE x AND y) / nullif(count(*) FILTER (WHERE x OR y), 0)::DOUBLE, 6) AS jaccard FROM (SELECT list_cosine_similarity(ra, rb) > 0 AS x, list_cosine_similarity(s, g) > 0 AS y FROM rl)", B.VEC, HALF, GEN)
def _(spark, sf):
    """Conditions that two frames keep: by reliable residuals, and by shifts that go the generic way."""
    r = _residuals(spark, sf).select((F.col("repro_cos") > 0).alias("x"), (cosine("shift", "generic") > 0).alias("y"))
    both, either = F.count_if(F.col("x") & F.col("y")), F.count_if(F.col("x") | F.col("y"))
    return r.agg(both.alias("both"), either.alias("either"), r6(safe_div(both, F.nullif(either, F.lit(0)))).alias("jaccard"))


@query("set10_shift_composition", "SELECT a, b, count(*) FILTER (WHERE x = 41 AND y < 41) AS turned_on, count(*) FILTER (WHERE x < 41 AND y = 41) AS turned_off, count(*) FILTER (WHERE x < 41 AND y < 41) AS within FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY abs(x - y) DESC, idx) AS r FROM bo) WHERE r <= 10 GROUP BY a, b", B.SENT, PR, PAIR, BOTH)
def _(spark, sf):
    """Of the most shifted features, those that appear, vanish, or move among the present ones."""
    r = F.row_number().over(Window.partitionBy("a", "b").orderBy(F.desc(F.abs(F.col("x") - F.col("y"))), "idx"))
    top = _both(spark, sf).withColumn("r", r).where("r <= 10")
    on, off = F.col("y") < 41, F.col("x") < 41
    return top.groupBy("a", "b").agg(F.count_if(on & ~off).alias("turned_on"), F.count_if(off & ~on).alias("turned_off"), F.count_if(on & off).alias("within"))
