"""Queries of loaders, nested results, group keys, outputs compared with each other and ridge on rank arrays."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.core import distance, hash_order, minus, pearson, r6
from ..operators import cells as C
from ..operators import inference as I
from ..operators import loading as L
from ..operators import matching as MA
from ..operators import metrics as M
from ..operators import models as MO
from ..operators import residuals as R
from ..operators import sampling as S
from . import bindings as B
from .base import query
from .cell_queries import K, LIB, PAIR, PR, PX, _pairs, _px, _ranks
from .design_queries import PROMPT, _prompts
from .inference_queries import TWO, VALUE, _scores
from .trial_queries import TAU
from .vector_queries import CT, FINE, MEAN, ML, _fine_shifts, _long, _means

# --- loaders ----------------------------------------------------------------

ENT = "en AS (SELECT entity, treatment, context, batch, count(*) AS n FROM ex WHERE value > 0 GROUP BY ALL)"
TWOPASS = f"""tp AS (SELECT * FROM en WHERE treatment <> '{B.CONTROL}' QUALIFY row_number() OVER (PARTITION BY context, batch, treatment ORDER BY {B.hash_sql("scan", "entity")}, entity) <= 3),
cp AS (SELECT * FROM en SEMI JOIN (SELECT DISTINCT context, batch FROM tp) USING (context, batch) WHERE treatment = '{B.CONTROL}' QUALIFY row_number() OVER (PARTITION BY context, batch ORDER BY {B.hash_sql("scan", "entity")}, entity) <= 5),
ch AS (SELECT *, false AS is_control FROM tp UNION ALL SELECT *, true FROM cp)"""


def _entities(spark, sf):
    return B.counts(spark, sf).where("value > 0").groupBy("entity", "treatment", "context", "batch").agg(F.count("*").alias("n"))


def _two_passes(spark, sf):
    order = [hash_order("scan", "entity"), "entity"]
    return L.two_passes(_entities(spark, sf), F.col("treatment") == B.CONTROL, ["context", "batch", "treatment"], ["context", "batch"], 3, 5, order)


@query("src10_two_pass_cache", "SELECT entity, is_control, idx, round(sum(cp), 6) AS cp FROM px JOIN ch USING (entity) GROUP BY ALL", B.EXPR, LIB, PX, ENT, TWOPASS)
def _(spark, sf):
    """Panel counts of capped treated rows, then of the controls that their groups need."""
    chosen = _two_passes(spark, sf).select("entity", "is_control")
    rows = B.counts(spark, sf).join(chosen.select("entity"), "entity", "left_semi")
    return C.scaled_counts(rows, B.panel(spark, sf), ["entity"]).join(chosen, "entity").select("entity", "is_control", "idx", r6("cp").alias("cp"))


@query("src13_two_pass_counts", "SELECT entity, is_control, feature, sum(value) AS value FROM ex JOIN ch USING (entity) GROUP BY ALL", B.EXPR, ENT, TWOPASS)
def _(spark, sf):
    """The same scan over the whole vocabulary, as plain counts."""
    chosen = _two_passes(spark, sf).select("entity", "is_control")
    return B.counts(spark, sf).join(chosen, "entity").groupBy("entity", "is_control", "feature").agg(F.sum("value").alias("value"))


@query("src11_true_vectors", f"SELECT context, treatment, entity, idx, round(ln(1 + cp), 6) AS level FROM px SEMI JOIN (SELECT entity FROM en WHERE n >= 8 QUALIFY row_number() OVER (PARTITION BY context, treatment ORDER BY {B.hash_sql('true', 'entity')}, entity) <= 4) USING (entity)", B.EXPR, LIB, PX, ENT)
def _(spark, sf):
    """Rows that pass the gate, capped for each context and treatment, as vectors in long form."""
    kept = S.first_per_key(_entities(spark, sf).where("n >= 8"), CT, 4, [hash_order("true", "entity"), "entity"])
    return _px(spark, sf).join(kept.select("entity"), "entity", "left_semi").select(*CT, "entity", "idx", r6(F.log1p("cp")).alias("level"))


@query(
    "src12_batch_cells",
    f"SELECT context, batch, treatment, count(*) AS cells, count(DISTINCT n) AS doses FROM (SELECT * FROM en WHERE treatment <> '{B.CONTROL}' UNION ALL SELECT * FROM en SEMI JOIN (SELECT DISTINCT context, batch FROM en WHERE treatment <> '{B.CONTROL}') USING (context, batch) WHERE treatment = '{B.CONTROL}' QUALIFY row_number() OVER (PARTITION BY context, batch ORDER BY entity) <= 6) GROUP BY ALL",
    B.EXPR, ENT,
)
def _(spark, sf):
    """All treated rows of each context and batch with capped controls, and the doses seen (here the feature counts)."""
    rows = _entities(spark, sf)
    treated = rows.where(F.col("treatment") != B.CONTROL)
    controls = rows.where(F.col("treatment") == B.CONTROL).join(treated.select("context", "batch").distinct(), ["context", "batch"], "left_semi")
    held = treated.unionByName(S.first_per_key(controls, ["context", "batch"], 6, ["entity"]))
    return held.groupBy("context", "batch", "treatment").agg(F.count("*").alias("cells"), F.countDistinct("n").alias("doses"))


LINES = """pl AS (SELECT DISTINCT ON (conv_id, turn, prompt) conv_id, turn, role AS context, 'T' || conv_id % 7 AS treatment, CASE WHEN conv_id % 5 <> 0 THEN turn % 2 END AS batch, prompt, text AS response, trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS control FROM pm)"""
LINE = ["conv_id", "turn", "prompt"]


def _lines(spark, sf):
    batch = F.when(F.col("conv_id") % 5 != 0, F.col("turn") % 2)
    rows = _prompts(spark, sf).select("conv_id", "turn", F.col("role").alias("context"), F.col("name").alias("treatment"), batch.alias("batch"), "prompt", F.col("text").alias("response"))
    return rows.withColumn("control", L.P.control_of(F.col("prompt"))).dropDuplicates(LINE)


for _name, _same, _group in (("src07_tier_by_treatment", True, "batch"), ("src08_context_cells", False, "NULL::BIGINT")):

    @query(_name, f"SELECT conv_id, turn, context, {_group} AS group_batch, treatment, control, response FROM pl WHERE control <> '' AND {'batch IS NOT NULL AND ' if _same else ''}{B.hash_sql('select', 'conv_id', 'turn')} % 4 <> 0", PROMPT, LINES)
    def _(spark, sf, same=_same):
        """Rows that can be scored, without the lines that selection used."""
        rows = _lines(spark, sf).drop("control")
        used = rows.where(hash_order("select", "conv_id", "turn") % 4 == 0).select("conv_id", "turn").distinct()
        return L.tier_rows(rows, same, used, ["conv_id", "turn"]).select("conv_id", "turn", "context", "group_batch", "treatment", "control", "response")


SELECTION = """tn AS (SELECT * FROM pl WHERE conv_id % 4 <> 0 AND batch IS NOT NULL),
wt AS (SELECT DISTINCT 'tier' || conv_id // 4 % 2 AS tier, context, treatment, batch FROM pl WHERE conv_id % 4 = 0 AND batch IS NOT NULL),
ce AS (SELECT * FROM tn JOIN wt USING (context, treatment, batch)),
co AS (SELECT * FROM (SELECT context, batch, control FROM (SELECT context, batch, control, min((conv_id, turn, prompt)) AS seen FROM tn WHERE control <> '' GROUP BY context, batch, control) QUALIFY row_number() OVER (PARTITION BY context, batch ORDER BY seen) <= 12) JOIN (SELECT DISTINCT tier, context, batch FROM ce) USING (context, batch))"""


@query("src22_train_selection", "SELECT tier, context, batch, treatment, count(*) AS n, 'cells' AS kind, min(response) AS first FROM ce GROUP BY ALL UNION ALL SELECT tier, context, batch, NULL, count(*), 'controls', min(control) FROM co GROUP BY ALL", PROMPT, LINES, SELECTION)
def _(spark, sf):
    """Train rows of the conditions that evaluation holds, with a bounded number of distinct controls."""
    rows = _lines(spark, sf).where("batch is not null")
    tier = F.concat(F.lit("tier"), (F.floor(F.col("conv_id") / 4) % 2).cast("string"))
    held, train = rows.where("conv_id % 4 = 0").withColumn("tier", tier), rows.where("conv_id % 4 <> 0")
    cells, controls = L.train_selection(train, held, ["context", "treatment", "batch"], ["context", "batch"], 12, LINE)
    a = cells.groupBy("tier", "context", "batch", "treatment").agg(F.count("*").alias("n"), F.min("response").alias("first")).withColumn("kind", F.lit("cells"))
    b = controls.groupBy("tier", "context", "batch").agg(F.count("*").alias("n"), F.min("control").alias("first")).withColumn("kind", F.lit("controls"))
    return a.unionByName(b.withColumn("treatment", F.lit(None).cast("string"))).select("tier", "context", "batch", "treatment", "n", "kind", "first")


@query("src23_harvested_controls", "SELECT 'key' AS level, conv_id, turn, context, batch, control FROM pl WHERE batch IS NOT NULL AND control <> '' QUALIFY row_number() OVER (PARTITION BY context, batch ORDER BY conv_id, turn, prompt) <= 8 UNION ALL SELECT 'context', conv_id, turn, context, batch, control FROM pl WHERE batch IS NOT NULL AND control <> '' QUALIFY row_number() OVER (PARTITION BY context ORDER BY conv_id, turn, prompt) <= 16", PROMPT, LINES)
def _(spark, sf):
    return L.harvested_controls(_lines(spark, sf), ["context", "batch"], "context", 8, 16, LINE).select("level", "conv_id", "turn", "context", "batch", "control")


@query(
    "smp04_fixed_contexts",
    f"SELECT context, treatment, header || 'Control cell sentence: ' || control || chr(10) || 'Perturbed cell sentence:' AS prompt FROM hd JOIN (SELECT context, control FROM pl WHERE control <> '' QUALIFY row_number() OVER (PARTITION BY context ORDER BY conv_id, turn, prompt) = 1) USING (context) JOIN (SELECT context FROM hd GROUP BY context HAVING count(*) >= 3 ORDER BY count(*) DESC, context LIMIT 2) USING (context) QUALIFY row_number() OVER (PARTITION BY context ORDER BY {B.hash_sql('context', 'context', 'treatment')}, treatment) <= 4",
    PROMPT, LINES, "hd AS (SELECT context, treatment, split_part(prompt, 'Control cell sentence:', 1) AS header FROM pl QUALIFY row_number() OVER (PARTITION BY context, treatment ORDER BY conv_id, turn, prompt) = 1)",
)
def _(spark, sf):
    """Two contexts of one control and up to four headers: numbers asked for are the feature."""
    return L.fixed_contexts(_lines(spark, sf).drop("control"), 2, 4, 3, "context", LINE)


# --- values, keys and nested results ----------------------------------------


@query("src15_categorical_decode", "SELECT c_custkey, coalesce(CASE WHEN code BETWEEN 0 AND 4 THEN (SELECT list(r_name ORDER BY r_regionkey) FROM region)[code + 1] END, 'NA') AS category FROM (SELECT c_custkey, c_nationkey % 8 - 1 AS code FROM customer)")
def _(spark, sf):
    names = B.table(spark, sf, "region").agg(F.transform(F.array_sort(F.collect_list(F.struct("r_regionkey", "r_name"))), lambda s: s["r_name"]).alias("names"))  # one row
    return B.table(spark, sf, "customer").join(F.broadcast(names)).select("c_custkey", L.decoded(F.col("c_nationkey") % 8 - 1, "names").alias("category"))


@query("src19_nested_results", "SELECT CASE WHEN s_suppkey % 4 = 1 THEN 'own' ELSE 'tier' || s_nationkey % 3 END AS tier, n_name AS context, s_name AS treatment, s_suppkey AS n, CASE WHEN s_suppkey % 3 > 0 THEN s_acctbal END AS model, CASE WHEN s_suppkey % 5 > 1 THEN s_acctbal / 2 END AS ceiling FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 3 > 0 OR s_suppkey % 5 > 1")
def _(spark, sf):
    """Results written as one nested document for each nation, read back as rows with a value for each predictor."""
    s = B.table(spark, sf, "supplier").join(F.broadcast(B.table(spark, sf, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))  # nations are a fixed list
    score = lambda v: F.to_json(F.struct(v.alias("rate")))
    model = F.when(F.col("s_suppkey") % 3 > 0, score(F.col("s_acctbal"))).otherwise("null")
    ceiling = F.when(F.col("s_suppkey") % 5 > 1, score(F.col("s_acctbal") / 2)).when(F.col("s_suppkey") % 5 == 0, '"none"').otherwise("{}")
    own = F.when(F.col("s_suppkey") % 4 == 1, '"tier": "own", ').otherwise("")
    row = F.format_string('{%s"context": "%s", "treatment": "%s", "n": %d, "model": %s, "ceiling": %s}', own, F.col("n_name"), F.col("s_name"), F.col("s_suppkey"), model, ceiling)
    docs = s.groupBy("s_nationkey").agg(F.concat(F.lit('{"tiers": {"tier'), (F.col("s_nationkey") % 3).cast("string"), F.lit('": {"rows": ['), F.array_join(F.collect_list(row), ", "), F.lit("]}}}")).alias("doc"))
    return L.result_rows(docs, "doc", "rate", ["model", "ceiling"], ["model", "ceiling"])


_KEYS = {"global": "NULL", "context": "n_name", "mechanism": "m", "mechanism_context": "m || '||' || n_name"}


@query("prj38_baseline_keys", " UNION ALL ".join(f"SELECT '{k}' AS mode, {v} AS key, count(*) AS n, round(avg(c_acctbal), 6) AS mean FROM cu GROUP BY ALL" for k, v in _KEYS.items()), "cu AS (SELECT n_name, c_acctbal, CASE WHEN c_custkey % 4 < 2 THEN 'unclear' ELSE c_mktsegment END AS m FROM customer JOIN nation ON c_nationkey = n_nationkey)")
def _(spark, sf):
    """The means of a baseline by each of its group keys; null and unknown mechanisms are one group."""
    said = F.when(F.col("c_custkey") % 4 > 1, F.col("c_mktsegment")).when(F.col("c_custkey") % 4 == 1, "unknown")
    rows = B.table(spark, sf, "customer").join(F.broadcast(B.table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).withColumn("m", said)
    tagged = rows.select("c_acctbal", F.explode(F.array(*[F.struct(F.lit(k).alias("mode"), L.baseline_key(k, "n_name", "m").alias("key")) for k in _KEYS])).alias("k"))
    return tagged.groupBy("k.mode", "k.key").agg(F.count("*").alias("n"), r6(F.avg("c_acctbal")).alias("mean"))


@query("prj39_group_key", "SELECT l_returnflag AS flag, round(l_discount / 7, 6) AS dose, count(*) AS n FROM lineitem GROUP BY ALL")
def _(spark, sf):
    rows = B.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), L.rounded_dose(F.col("l_discount") / 7).alias("dose"))
    return rows.groupBy("flag", "dose").agg(F.count("*").alias("n"))


@query(
    "stat35_swap_verdict",
    """SELECT treatment, CASE WHEN lo IS NULL OR hi IS NULL THEN 'too few clusters' WHEN margin IS NULL OR margin <= 0 THEN CASE WHEN lo > 0 THEN 'toward' WHEN hi < 0 THEN 'away' ELSE 'no margin' END WHEN margin < (hi - lo) / 4 THEN 'margin below resolution' WHEN lo > margin THEN 'toward' WHEN hi < -margin THEN 'away'
WHEN lo > -margin AND hi < margin THEN CASE WHEN lo <= 0 AND hi >= 0 THEN 'equivalent' ELSE 'directional, below margin' END ELSE 'inconclusive' END AS verdict FROM (SELECT treatment, mean - 2 * sqrt(v) AS lo, mean + 2 * sqrt(v) AS hi, ([NULL, 0.0, 0.005, 0.1, 1.0])[treatment % 5 + 1] AS margin FROM (SELECT treatment, mean, CASE WHEN a + b - ab > 0 THEN a + b - ab ELSE greatest(a, b) END AS v FROM tw))""",
    B.VEC, VALUE, TWO,
)
def _(spark, sf):
    """Verdicts over a ladder of margins."""
    v = I.two_way_variance(_scores(spark, sf), ["treatment"], "value", "context", "unit")
    margin = F.get(F.array(*[F.lit(m).cast("double") for m in (None, 0.0, 0.005, 0.1, 1.0)]), (F.col("treatment") % 5).cast("int"))
    return v.select("treatment", L.swap_verdict(F.col("mean") - 2 * F.sqrt("variance"), F.col("mean") + 2 * F.sqrt("variance"), margin).alias("verdict"))


# --- arrays and round trips -------------------------------------------------


@query("snk05_reconstruction", "SELECT context, batch, idx, round(n / (n + 5.0) * fine + 5.0 / (n + 5.0) * coarse, 6) AS generic FROM (SELECT context, batch, idx, avg(s) AS fine, count(*) AS n FROM bs GROUP BY ALL) JOIN (SELECT context, idx, avg(m) AS coarse FROM (SELECT context, treatment, idx, avg(s) AS m FROM bs GROUP BY ALL) GROUP BY ALL) USING (context, idx)", B.VEC, FINE)
def _(spark, sf):
    """What is added to a group's control where the treatment is unknown, as it is written for reconstruction."""
    return _long(R.generic_by_group(_fine_shifts(spark, sf), F.lit(True), ["context", "batch"], ["context"], "treatment", "shift", 5.0), ["context", "batch"], "generic", "generic")


@query(
    "prj30_round_trip",
    """SELECT e.entity, p.idx, round(coalesce(level, 0), 6) AS level, round(coalesce(x.cp, 0) - coalesce(level, 0), 6) AS loss FROM (SELECT DISTINCT entity FROM px) e CROSS JOIN pn p LEFT JOIN rk x ON x.entity = e.entity AND x.idx = p.idx
LEFT JOIN (SELECT r, avg(cp) AS level FROM rk WHERE r <= 12 GROUP BY r) USING (r)""",
    B.EXPR, LIB, PX, "rk AS (SELECT entity, idx, cp, row_number() OVER (PARTITION BY entity ORDER BY value DESC, idx) AS r FROM px)",
)
def _(spark, sf):
    """Levels to an order and back by the mean level of each rank: what the sentence loses."""
    x, panel = _px(spark, sf), B.panel(spark, sf)
    profile = C.value_profile(x, ["entity"], 12, "cp")
    toks = C.tokens(C.sentence(x, ["entity"]), ["entity"])
    ranks = C.panel_ranks(C.first_places(toks, ["entity"]), panel.withColumnRenamed("feature", "tok"), ["entity"])
    back = C.decoded_order(ranks, profile, x.select("entity").distinct(), panel, ["entity"])
    both = back.join(x.select("entity", "idx", "cp"), ["entity", "idx"], "left")
    return both.select("entity", "idx", r6("level").alias("level"), r6(F.coalesce("cp", F.lit(0.0)) - F.col("level")).alias("loss"))


@query("met40_pairwise_distances", "SELECT p.context, p.treatment AS a, q.treatment AS b, round(list_distance(p.m, q.m), 6) AS distance FROM ml p JOIN ml q ON p.context = q.context AND p.treatment < q.treatment", B.VEC, MEAN, ML)
def _(spark, sf):
    """Distances of all pairs of a context's treatments; those above the diagonal, once."""
    return MA.pairs_within(_means(spark, sf), ["context"], "treatment", ["m"]).select("context", "a", "b", r6(distance("a_m", "b_m")).alias("distance"))


# --- outputs against each other ---------------------------------------------

TRIPLE = f"""tr AS (SELECT id AS a, lead(id) OVER w AS b, lead(id, 2) OVER w AS c FROM sn WINDOW w AS (PARTITION BY treatment, context ORDER BY id) QUALIFY c IS NOT NULL),
ti AS (SELECT a, b, w.idx, coalesce(x.rank, 41) AS x, coalesce(y.rank, 41) AS y, coalesce(z.rank, 41) AS z FROM tr CROSS JOIN wp w LEFT JOIN pr x ON x.id = a AND x.idx = w.idx LEFT JOIN pr y ON y.id = b AND y.idx = w.idx LEFT JOIN pr z ON z.id = c AND z.idx = w.idx),
tt AS (SELECT * FROM ti WHERE x <= 12)"""


@query(
    "met32_pair_bundle",
    f"SELECT a, b, round(r, 6) AS shift_r, round(p.tau, 6) AS panel_tau, round(t.tau, 6) AS top_tau FROM (SELECT a, b, CASE WHEN var_pop(x - z) > 1e-12 AND var_pop(y - z) > 1e-12 THEN corr(x - z, y - z) END AS r FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY abs(x - z) DESC, idx) AS k FROM ti) WHERE k <= 10 GROUP BY a, b) LEFT JOIN {TAU.format('ti')} p USING (a, b) LEFT JOIN {TAU.format('tt')} t USING (a, b)",
    B.SENT, PR, TRIPLE,
)
def _(spark, sf):
    """One sentence as the truth, the next as its prediction, the third as the control of both."""
    w = Window.partitionBy("treatment", "context").orderBy("id")
    triples = B.sentences(spark, sf).select(F.col("id").alias("a"), F.lead("id").over(w).alias("b"), F.lead("id", 2).over(w).alias("c")).where("c is not null")
    dense = C.dense_ranks(_ranks(spark, sf), B.sentences(spark, sf).select("id"), B.word_panel(spark, sf), K, "position").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "rank"))), lambda s: s["rank"]).alias("r"))
    side = lambda n, r: dense.toDF(n, r)
    rows = triples.join(side("a", "x"), "a").join(side("b", "y"), "b").join(side("c", "z"), "c")
    moved = F.array_sort(F.transform(minus("x", "z"), lambda d, i: F.struct((-F.abs(d)).alias("size"), i.alias("at"))))
    at = F.slice(moved, 1, 10)
    lists = rows.select("a", "b", "x", "y", F.transform(at, lambda s: F.get("x", s["at"]) - F.get("z", s["at"])).alias("u"), F.transform(at, lambda s: F.get("y", s["at"]) - F.get("z", s["at"])).alias("v"))
    top = F.filter(F.arrays_zip("x", "y"), lambda s: s["x"] <= 12)
    return lists.withColumn("t", top).select("a", "b", r6(pearson("u", "v")).alias("shift_r"), r6(M.kendall_tau("x", "y")).alias("panel_tau"), r6(M.kendall_tau("t.x", "t.y")).alias("top_tau"))


OUTPUTS = """op AS (SELECT context, id FROM (SELECT context, treatment, min(id) AS id FROM sn GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY context ORDER BY id) <= 4),
og AS (SELECT p.context, p.id AS a, q.id AS b FROM op p JOIN op q ON p.context = q.context AND p.id < q.id),
oo AS (SELECT a, b, w.idx, coalesce(x.rank, 41) AS x, coalesce(y.rank, 41) AS y FROM og CROSS JOIN wp w LEFT JOIN pr x ON x.id = a AND x.idx = w.idx LEFT JOIN pr y ON y.id = b AND y.idx = w.idx)"""


@query("met37_output_agreement", f"SELECT context, count(tau) AS n_pairs, round(avg(tau), 6) AS mean_tau, round(max(tau), 6) AS max_tau FROM og LEFT JOIN {TAU.format('oo')} USING (a, b) GROUP BY context", B.SENT, PR, OUTPUTS)
def _(spark, sf):
    """Kendall's tau between the outputs for up to four treatments of one context; near 1 the treatment is not heard."""
    first = B.sentences(spark, sf).groupBy("context", "treatment").agg(F.min("id").alias("id"))
    chosen = S.first_per_key(first, ["context"], 4, ["id"])
    dense = C.dense_ranks(_ranks(spark, sf).join(chosen.select("id"), "id", "left_semi"), chosen.select("id"), B.word_panel(spark, sf), K, "position")
    lists = dense.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "rank"))), lambda s: s["rank"]).alias("r"))
    pairs = MA.pairs_within(chosen.join(lists, "id"), ["context"], "id", ["r"]).withColumn("tau", M.kendall_tau("a_r", "b_r"))
    return pairs.groupBy("context").agg(F.count("tau").alias("n_pairs"), r6(F.avg("tau")).alias("mean_tau"), r6(F.max("tau")).alias("max_tau"))


# --- ridge on rank arrays ---------------------------------------------------


def _centred(spark, sf, mode):
    """Control and shift of rank arrays, each centred by its row's mean: a sentence and the one that follows it."""
    dense = C.dense_ranks(_ranks(spark, sf), B.sentences(spark, sf).select("id"), B.word_panel(spark, sf), K, mode)
    lists = dense.groupBy("id").agg(MO.row_centred(F.transform(F.array_sort(F.collect_list(F.struct("idx", "rank"))), lambda s: s["rank"].cast("double"))).alias("r"))
    pairs = _pairs(spark, sf).join(lists.toDF("a", "x"), "a").join(lists.toDF("b", "t"), "b")
    return pairs.select("a", "b", "x", minus("t", "x").alias("y"))


for _mode, _fill in {"position": "41", "tail": "40", "zero_bucket": "(SELECT count(*) FROM pr q WHERE q.id = s.id) + 1", "fixed": "20"}.items():

    @query(
        f"ml04_rank_moments_{_mode}",
        "SELECT p.idx AS i, q.idx AS j, round(sum(p.x * q.x), 3) AS sxx, round(sum(p.x * q.y), 3) AS sxy FROM cy p JOIN cy q USING (a) GROUP BY ALL",
        B.SENT, PR, PAIR, f"dn AS (SELECT s.id, w.idx, coalesce(pr.rank, {_fill}) AS rank FROM sn s CROSS JOIN wp w LEFT JOIN pr ON pr.id = s.id AND pr.idx = w.idx), dc AS (SELECT id, idx, rank - avg(rank) OVER (PARTITION BY id) AS x FROM dn), cy AS (SELECT a, u.idx, u.x, v.x - u.x AS y FROM pa JOIN dc u ON u.id = a JOIN dc v ON v.id = b AND v.idx = u.idx)",
    )
    def _(spark, sf, mode=_mode):
        m = MO.moments(_centred(spark, sf, mode), "x", "y")
        return m.select("i", "j", (F.round("sxx", 3) + F.lit(0.0)).alias("sxx"), (F.round("sxy", 3) + F.lit(0.0)).alias("sxy"))


@query("ml04_rank_ridge")
def _(spark, sf):
    """Shifts of rank arrays predicted from the control's, without intercept."""
    rows = _centred(spark, sf, "position")
    weights = MO.fit_plain_ridge(rows, "x", "y", 10.0)
    none = [0.0] * len(weights)
    return MO.predict_linear(rows, "x", weights, none, none).select("a", "b", F.transform("predicted", lambda p: F.round(p, 6)).alias("predicted"))
