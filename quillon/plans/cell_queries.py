"""Queries over sparse rows and sentences."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.core import corr_agg, r6
from ..operators import cells as C
from . import bindings as B
from .base import query

LIB = "lb AS (SELECT *, sum(value) OVER (PARTITION BY entity) AS lib FROM ex WHERE value > 0)"
PX = "px AS (SELECT entity, treatment, context, batch, unit, feature, idx, value, lib, value / lib * 1e4 AS cp FROM lb JOIN pn USING (feature))"


def _px(spark, sf):
    rows = C.log_normalised(B.counts(spark, sf))
    return rows.join(F.broadcast(B.panel(spark, sf)), "feature").withColumn("cp", F.col("value") / F.col("lib") * 1e4)


@query("prj01_log_normalise", "SELECT entity, feature, round(log10(1 + value / lib * 1e4), 6) AS lognorm FROM lb", B.EXPR, LIB)
def _(spark, sf):
    return C.log_normalised(B.counts(spark, sf)).select("entity", "feature", r6("lognorm").alias("lognorm"))


@query("prj02_scaled_counts", "SELECT entity, idx, round(sum(cp), 6) AS cp FROM px GROUP BY ALL", B.EXPR, LIB, PX)
def _(spark, sf):
    return C.scaled_counts(B.counts(spark, sf), B.panel(spark, sf), ["entity"]).select("entity", "idx", r6("cp").alias("cp"))


@query(
    "agg02_sparse_group_mean",
    "SELECT context, treatment, idx, round(sum(ln(1 + cp)) / any_value(n), 6) AS mean FROM px JOIN (SELECT context, treatment, count(DISTINCT entity) AS n FROM ex GROUP BY ALL) USING (context, treatment) GROUP BY context, treatment, idx",
    B.EXPR, LIB, PX,
)
def _(spark, sf):
    rows = _px(spark, sf).withColumn("value", F.log1p("cp"))
    return C.group_means(rows, B.counts(spark, sf), ["context", "treatment"]).select("context", "treatment", "idx", r6("mean").alias("mean"))


@query("prj04_feature_places", "SELECT feature, idx FROM pn", B.EXPR)
def _(spark, sf):
    return B.panel(spark, sf)


@query("prj05_vocabulary_sentence", "SELECT entity, string_agg(feature, ' ' ORDER BY value DESC, feature) || ' [END]' AS sentence, count(*) AS n FROM lb GROUP BY entity", B.EXPR, LIB)
def _(spark, sf):
    rows = C.log_normalised(B.counts(spark, sf)).withColumn("idx", F.col("feature"))
    return C.sentence(rows, ["entity"])


@query(
    "prj06_panel_sentence",
    "SELECT entity, string_agg(feature, ' ' ORDER BY value DESC, idx) || ' [END]' AS sentence, count(*) AS n FROM px WHERE entity IN (SELECT entity FROM ex GROUP BY entity HAVING count(*) >= 8) GROUP BY entity HAVING count(*) >= 5",
    B.EXPR, LIB, PX,
)
def _(spark, sf):
    w = Window.partitionBy("entity")
    rows = B.counts(spark, sf).where("value > 0").withColumn("_n", F.count("*").over(w)).where("_n >= 8")
    return C.sentence(rows.join(F.broadcast(B.panel(spark, sf)), "feature"), ["entity"]).where("n >= 5")


@query(
    "prj07_full_panel_sentence",
    "SELECT e.entity, string_agg(p.feature, ' ' ORDER BY coalesce(x.value, 0) DESC, p.idx) || ' [END]' AS sentence, count(*) AS n FROM (SELECT DISTINCT entity FROM px) e CROSS JOIN pn p LEFT JOIN px x ON x.entity = e.entity AND x.idx = p.idx GROUP BY e.entity",
    B.EXPR, LIB, PX,
)
def _(spark, sf):
    return C.sentence(C.full_panel(_px(spark, sf).select("entity", "feature", "value"), B.panel(spark, sf), ["entity"]), ["entity"])


@query("prj09_top_sentence", "SELECT entity, string_agg(feature, ' ' ORDER BY r) || ' [END]' AS sentence, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY value DESC, idx) AS r FROM px) WHERE r <= 10 GROUP BY entity", B.EXPR, LIB, PX)
def _(spark, sf):
    return C.sentence(_px(spark, sf), ["entity"], limit=10)


@query(
    "flt_quality_gates",
    """SELECT reason, count(*) AS n FROM (SELECT CASE WHEN n < 15 THEN 'few features' WHEN n_panel < 12 THEN 'few panel features' WHEN share > 0.24 THEN 'marked share' ELSE 'kept' END AS reason
FROM (SELECT entity, count(*) AS n, count(idx) AS n_panel, sum(CASE WHEN feature LIKE 'Brand#5%' THEN value ELSE 0 END) / sum(value) AS share FROM ex LEFT JOIN pn USING (feature) WHERE value > 0 GROUP BY entity)) GROUP BY reason""",
    B.EXPR,
)
def _(spark, sf):
    return C.gate(B.counts(spark, sf), B.panel(spark, sf), 15, 12, 0.24, F.col("feature").startswith("Brand#5")).groupBy("reason").agg(F.count("*").alias("n"))


RANKED = "SELECT entity, idx, value, rank() OVER (PARTITION BY entity ORDER BY value) + (count(*) OVER (PARTITION BY entity, value) - 1) / 2.0 AS avg_rank, row_number() OVER (PARTITION BY entity ORDER BY value DESC, idx) AS ordinal FROM px"


@query("prj24_average_ranks", RANKED.replace("value,", "", 1), B.EXPR, LIB, PX)
def _(spark, sf):
    w = Window.partitionBy("entity").orderBy(F.desc("value"), "idx")
    return _px(spark, sf).select("entity", "idx", C.average_rank("value", ["entity"]).alias("avg_rank"), F.row_number().over(w).cast("long").alias("ordinal"))


@query(
    "prj23_ranks_zero_tied",
    "SELECT e.entity, p.idx, CASE WHEN coalesce(x.value, 0) > 0 THEN x.r ELSE (SELECT count(*) FROM pn) END AS rank FROM (SELECT DISTINCT entity FROM px) e CROSS JOIN pn p LEFT JOIN (SELECT entity, idx, value, rank() OVER (PARTITION BY entity ORDER BY value DESC) + (count(*) OVER (PARTITION BY entity, value) - 1) / 2.0 AS r FROM px) x ON x.entity = e.entity AND x.idx = p.idx",
    B.EXPR, LIB, PX,
)
def _(spark, sf):
    full = C.full_panel(_px(spark, sf).select("entity", "feature", "value"), B.panel(spark, sf), ["entity"])
    size = F.count("*").over(Window.partitionBy("entity"))
    tied = C.average_rank(F.col("value"), ["entity"], descending=True)
    return full.select("entity", "idx", F.when(F.col("value") > 0, tied).otherwise(size).cast("double").alias("rank"))


@query("prj27_value_profile", "SELECT r AS rank, round(avg(cp), 6) AS level FROM (SELECT cp, row_number() OVER (PARTITION BY entity ORDER BY cp DESC, idx) AS r FROM px) WHERE r <= 15 GROUP BY r", B.EXPR, LIB, PX)
def _(spark, sf):
    return C.value_profile(_px(spark, sf), ["entity"], 15, "cp").select(F.col("rank").cast("long").alias("rank"), r6("level").alias("level"))


@query(
    "prj28_profile_decode",
    """SELECT entity, idx, round(level, 6) AS level FROM (SELECT entity, idx, row_number() OVER (PARTITION BY entity ORDER BY value DESC, idx) AS r FROM px)
JOIN (SELECT r, avg(cp) AS level FROM (SELECT cp, row_number() OVER (PARTITION BY entity ORDER BY cp DESC, idx) AS r FROM px) WHERE r <= 15 GROUP BY r) USING (r)""",
    B.EXPR, LIB, PX,
)
def _(spark, sf):
    x = _px(spark, sf)
    profile = C.value_profile(x, ["entity"], 15, "cp")
    toks = C.tokens(C.sentence(x, ["entity"]), ["entity"])
    ranks = C.panel_ranks(C.first_places(toks, ["entity"]), B.panel(spark, sf).withColumnRenamed("feature", "tok"), ["entity"])
    return ranks.join(F.broadcast(profile), "rank").select("entity", "idx", r6("level").alias("level"))


@query(
    "ml01_rank_regression",
    "SELECT context, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(regr_r2(y, x), 6) AS r2, count(*) AS n FROM (SELECT context, log10(1 + cp) AS y, log10(row_number() OVER (PARTITION BY entity ORDER BY value DESC, idx)) AS x FROM px WHERE treatment = 'AUTOMOBILE') GROUP BY context",
    B.EXPR, LIB, PX,
)
def _(spark, sf):
    x = F.log10(F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("value"), "idx")).cast("double"))
    held = _px(spark, sf).where(F.col("treatment") == B.CONTROL).select("context", F.log10(1 + F.col("cp")).alias("y"), x.alias("x"))
    return held.groupBy("context").agg(r6(F.regr_slope("y", "x")).alias("slope"), r6(F.regr_intercept("y", "x")).alias("intercept"), r6(F.regr_r2("y", "x")).alias("r2"), F.count("*").alias("n"))


# --- sentences --------------------------------------------------------------

K = ["id"]
PR = "pr AS (SELECT id, treatment, context, tok, idx, pos, row_number() OVER (PARTITION BY id ORDER BY pos) AS rank FROM ft JOIN wp USING (tok))"


def _first(spark, sf, keys=("id", "treatment", "context")):
    return C.first_places(C.tokens(B.sentences(spark, sf), list(keys), stop=None), list(keys))


def _ranks(spark, sf):
    keys = ["id", "treatment", "context"]
    return C.panel_ranks(_first(spark, sf), B.word_panel(spark, sf), keys)


@query("prj13_tokens_to_sentinel", "SELECT id, count(*) AS n_tokens, count(DISTINCT tok) AS n_distinct FROM (SELECT id, tok, pos, min(CASE WHEN tok = 'the' THEN pos END) OVER (PARTITION BY id) AS stop FROM tk) WHERE tok <> '' AND (stop IS NULL OR pos < stop) GROUP BY id", B.SENT)
def _(spark, sf):
    return C.tokens(B.sentences(spark, sf), K, stop="the").groupBy("id").agg(F.count("*").alias("n_tokens"), F.countDistinct("tok").alias("n_distinct"))


@query("prj14_rank_map", "SELECT id, tok, pos AS rank FROM ft", B.SENT)
def _(spark, sf):
    return C.first_places(C.tokens(B.sentences(spark, sf), K, stop=None), K).withColumnRenamed("pos", "rank")


for _mode, _fill in {"position": "(SELECT count(*) FROM wp) + 1", "tail": "(SELECT count(*) FROM wp)", "zero_bucket": "(SELECT count(*) FROM pr q WHERE q.id = s.id) + 1", "fixed": "(SELECT count(*) FROM wp) // 2"}.items():

    @query(f"prj15_rank_array_{_mode}", f"SELECT s.id, w.idx, coalesce(pr.rank, {_fill}) AS rank FROM sn s CROSS JOIN wp w LEFT JOIN pr ON pr.id = s.id AND pr.idx = w.idx", B.SENT, PR)
    def _(spark, sf, mode=_mode):
        return C.dense_ranks(_ranks(spark, sf), B.sentences(spark, sf).select("id"), B.word_panel(spark, sf), K, mode)


@query("prj18_rank_to_level", "SELECT id, tok, round(greatest(0, -0.8 * log10(avg(pos)) + 3.1), 6) AS level FROM tk WHERE tok <> '' GROUP BY id, tok", B.SENT)
def _(spark, sf):
    toks = C.tokens(B.sentences(spark, sf), K, stop=None)
    return toks.groupBy("id", "tok").agg(r6(F.greatest(F.lit(0.0), -0.8 * F.log10(F.avg("pos")) + 3.1)).alias("level"))


@query("prj19_panel_level", "SELECT s.id, w.idx, round(coalesce(greatest(0, -0.8 * log10(rank) + 3.1), 0), 6) AS log_level, round(coalesce(exp(-0.05 * rank + 2), 0), 6) AS exp_level FROM sn s CROSS JOIN wp w LEFT JOIN pr ON pr.id = s.id AND pr.idx = w.idx", B.SENT, PR)
def _(spark, sf):
    grid = B.sentences(spark, sf).select("id").join(F.broadcast(B.word_panel(spark, sf).select("idx")))
    full = grid.join(_ranks(spark, sf).select("id", "idx", "rank"), ["id", "idx"], "left")
    return full.select("id", "idx", r6(F.coalesce(F.greatest(F.lit(0.0), -0.8 * F.log10("rank") + 3.1), F.lit(0.0))).alias("log_level"), r6(F.coalesce(F.exp(-0.05 * F.col("rank") + 2), F.lit(0.0))).alias("exp_level"))


@query("agg03_mean_rank", "SELECT context, treatment, w.idx, round((coalesce(sum(rank), 0) + 41.0 * (n - count(rank))) / n, 6) AS mean_rank FROM (SELECT context, treatment, count(*) AS n FROM sn GROUP BY ALL) g CROSS JOIN wp w LEFT JOIN pr USING (context, treatment, idx) GROUP BY context, treatment, w.idx, n", B.SENT, PR)
def _(spark, sf):
    keys = ["context", "treatment"]
    sizes = B.sentences(spark, sf).groupBy(*keys).agg(F.count("*").alias("n"))
    grid = sizes.join(F.broadcast(B.word_panel(spark, sf).select("idx")))
    sums = _ranks(spark, sf).groupBy(*keys, "idx").agg(F.sum("rank").alias("s"), F.count("*").alias("c"))
    return grid.join(sums, [*keys, "idx"], "left").select(*keys, "idx", r6((F.coalesce("s", F.lit(0)) + 41.0 * (F.col("n") - F.coalesce("c", F.lit(0)))) / F.col("n")).alias("mean_rank"))


@query(
    "agg04_rank_consensus",
    "SELECT context, treatment, string_agg(tok, ' ' ORDER BY m, idx) AS sentence FROM (SELECT context, treatment, w.idx, w.tok, (coalesce(sum(rank), 0) + 41 * (n - count(rank))) / n AS m FROM (SELECT context, treatment, count(*) AS n FROM sn GROUP BY ALL) g CROSS JOIN wp w LEFT JOIN pr USING (context, treatment, idx) GROUP BY context, treatment, w.idx, w.tok, n) GROUP BY context, treatment",
    B.SENT, PR,
)
def _(spark, sf):
    keys = ["context", "treatment"]
    sizes = B.sentences(spark, sf).groupBy(*keys).agg(F.count("*").alias("n"))
    grid = sizes.join(F.broadcast(B.word_panel(spark, sf)))
    sums = _ranks(spark, sf).groupBy(*keys, "idx").agg(F.sum("rank").alias("s"), F.count("*").alias("c"))
    mean = grid.join(sums, [*keys, "idx"], "left").withColumn("m", (F.coalesce("s", F.lit(0)) + 41 * (F.col("n") - F.coalesce("c", F.lit(0)))) / F.col("n"))
    return mean.groupBy(*keys).agg(C.joined_in_order([F.col("m"), F.col("idx")], "tok").alias("sentence"))


@query(
    "agg05_consensus_target",
    "SELECT context, treatment, string_agg(tok, ' ' ORDER BY r) AS sentence, count(*) AS n FROM r WHERE r <= round_even(mid, 0) GROUP BY ALL",
    B.SENT,
    """L AS (SELECT id, context, treatment, count(*) FILTER (WHERE tok <> '') AS len FROM tk GROUP BY ALL),
g AS (SELECT context, treatment, count(*) AS n, quantile_cont(len, 0.5) AS mid FROM L GROUP BY ALL),
s AS (SELECT ft.context, ft.treatment, tok, sum(1 - (pos - 1) / len) AS s, count(*) AS seen FROM ft JOIN L USING (id) GROUP BY ALL),
p AS (SELECT *, seen >= greatest(2, round_even(0.3 * n, 0)) AS ok, round(s / n, 9) AS score FROM s JOIN g USING (context, treatment)),
q AS (SELECT * FROM (SELECT *, bool_or(ok) OVER (PARTITION BY context, treatment) AS any_ok FROM p) WHERE ok OR NOT any_ok),
r AS (SELECT *, row_number() OVER (PARTITION BY context, treatment ORDER BY score DESC, tok) AS r FROM q)""",
)
def _(spark, sf):
    group = ["context", "treatment"]
    return C.consensus(C.tokens(B.sentences(spark, sf), [*group, "id"], stop=None), B.sentences(spark, sf).select(*group, "id"), group, "id", 0.3, 2)


@query("agg44_token_union", "SELECT context, treatment, count(DISTINCT tok) AS n FROM pr GROUP BY ALL", B.SENT, PR)
def _(spark, sf):
    return _ranks(spark, sf).groupBy("context", "treatment").agg(F.size(F.collect_set("tok")).cast("long").alias("n"))


@query("agg43_core_and_variable", "SELECT treatment, count(*) FILTER (WHERE c = n) AS core, count(*) FILTER (WHERE c = 1) AS variable FROM (SELECT treatment, tok, count(*) AS c FROM pr GROUP BY ALL) JOIN (SELECT treatment, count(*) AS n FROM sn GROUP BY ALL) USING (treatment) GROUP BY treatment", B.SENT, PR)
def _(spark, sf):
    n = B.sentences(spark, sf).groupBy("treatment").agg(F.count("*").alias("n"))
    seen = _ranks(spark, sf).groupBy("treatment", "tok").agg(F.count("*").alias("c"))
    return seen.join(n, "treatment").groupBy("treatment").agg(F.count_if(F.col("c") == F.col("n")).alias("core"), F.count_if(F.col("c") == 1).alias("variable"))


# Neighbouring documents of one treatment and context, as predicted and true sentences.
PAIR = "pa AS (SELECT id AS a, lead(id) OVER (PARTITION BY treatment, context ORDER BY id) AS b FROM sn QUALIFY b IS NOT NULL)"


def _pairs(spark, sf):
    w = Window.partitionBy("treatment", "context").orderBy("id")
    return B.sentences(spark, sf).select(F.col("id").alias("a"), F.lead("id").over(w).alias("b")).where("b is not null")


def _sets(spark, sf, panel_only=False):
    toks = _ranks(spark, sf) if panel_only else _first(spark, sf)
    return toks.groupBy("id").agg(F.collect_set("tok").alias("s"))


@query(
    "set03_token_set_metrics",
    """SELECT a, b, round(i / (x.n + y.n - i), 6) AS jaccard, round(i / y.n, 6) AS overlap, (x.n + y.n - 2 * i) / 2 AS divergence, x.n - i AS turned_off, y.n - i AS turned_on
FROM (SELECT a, b, count(*)::DOUBLE AS i FROM pa JOIN ft f ON f.id = a JOIN ft g ON g.id = b AND f.tok = g.tok GROUP BY a, b)
JOIN (SELECT id AS a, count(*) AS n FROM ft GROUP BY id) x USING (a) JOIN (SELECT id AS b, count(*) AS n FROM ft GROUP BY id) y USING (b)""",
    B.SENT, PAIR,
)
def _(spark, sf):
    s = _sets(spark, sf)
    p = _pairs(spark, sf).join(s.toDF("a", "x"), "a").join(s.toDF("b", "y"), "b").withColumn("i", F.size(F.array_intersect("x", "y"))).where("i > 0")
    nx, ny = F.size("x"), F.size("y")
    return p.select("a", "b", r6(F.col("i") / (nx + ny - F.col("i"))).alias("jaccard"), r6(F.col("i") / ny).alias("overlap"), ((nx + ny - 2 * F.col("i")) / 2.0).alias("divergence"), F.size(F.array_except("x", "y")).cast("double").alias("turned_off"), F.size(F.array_except("y", "x")).cast("double").alias("turned_on"))


@query(
    "set07_sentence_validity",
    """SELECT a, b, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) END, 6) AS f1, round(h, 6) AS hallucination, round(len, 6) AS length_ratio, round(dup, 6) AS duplicates, n >= 20 AND h < 0.5 AS valid
FROM (SELECT a, b, coalesce(i, 0) / nullif(x.n, 0) AS p, coalesce(i, 0) / nullif(y.n, 0) AS r, 1 - x.n / x.m AS h, x.t / nullif(y.t, 0)::DOUBLE AS len, 1 - x.m / x.t AS dup, x.m AS n
FROM pa LEFT JOIN (SELECT a, b, count(*)::DOUBLE AS i FROM pa JOIN pr f ON f.id = a JOIN pr g ON g.id = b AND f.idx = g.idx GROUP BY a, b) USING (a, b)
JOIN zz x ON x.id = a JOIN zz y ON y.id = b)""",
    B.SENT, PR, PAIR,
    "zz AS (SELECT s.id, (SELECT count(*) FROM pr WHERE pr.id = s.id) AS n, (SELECT count(*) FROM ft WHERE ft.id = s.id) AS m, (SELECT count(*) FROM tk WHERE tk.id = s.id AND tok <> '') AS t FROM sn s)",
)
def _(spark, sf):
    words = C.tokens(B.sentences(spark, sf), K, stop=None).groupBy("id").agg(F.count("*").alias("t"), F.countDistinct("tok").alias("m"))
    on = _ranks(spark, sf).groupBy("id").agg(F.collect_set("tok").alias("s"))
    z = words.join(on, "id", "left").select("id", "t", "m", F.coalesce("s", F.array().cast("array<string>")).alias("s"))
    x, y = z.toDF("a", "ta", "ma", "sa"), z.toDF("b", "tb", "mb", "sb")
    j = _pairs(spark, sf).join(x, "a").join(y, "b").withColumn("i", F.size(F.array_intersect("sa", "sb")))
    j = j.withColumn("p", F.try_divide("i", F.size("sa"))).withColumn("r", F.try_divide("i", F.size("sb"))).withColumn("h", 1 - F.size("sa") / F.col("ma"))
    f1 = F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r")))
    return j.select("a", "b", r6("p").alias("precision"), r6("r").alias("recall"), r6(f1).alias("f1"), r6("h").alias("hallucination"), r6(F.try_divide("ta", "tb")).alias("length_ratio"), r6(1 - F.col("ma") / F.col("ta")).alias("duplicates"), ((F.col("ma") >= 20) & (F.col("h") < 0.5)).alias("valid"))


BOTH = "bo AS (SELECT a, b, w.idx, coalesce(x.rank, 41) AS x, coalesce(y.rank, 41) AS y FROM pa CROSS JOIN wp w LEFT JOIN pr x ON x.id = a AND x.idx = w.idx LEFT JOIN pr y ON y.id = b AND y.idx = w.idx)"


def _both(spark, sf):
    dense = C.dense_ranks(_ranks(spark, sf), B.sentences(spark, sf).select("id"), B.word_panel(spark, sf), K, "position")
    return _pairs(spark, sf).join(dense.toDF("a", "idx", "x"), "a").join(dense.toDF("b", "idx", "y"), ["b", "idx"])


@query(
    "met04_kendall_tau",
    """SELECT a, b, round((c - d) / nullif(sqrt((c + d + tx)::DOUBLE * (c + d + ty)), 0), 6) AS tau FROM (SELECT p.a, p.b, count(*) FILTER (WHERE (p.x - q.x) * (p.y - q.y) > 0) AS c, count(*) FILTER (WHERE (p.x - q.x) * (p.y - q.y) < 0) AS d,
count(*) FILTER (WHERE p.x = q.x AND p.y <> q.y) AS ty, count(*) FILTER (WHERE p.y = q.y AND p.x <> q.x) AS tx FROM bo p JOIN bo q ON p.a = q.a AND p.b = q.b AND p.idx < q.idx GROUP BY p.a, p.b)""",
    B.SENT, PR, PAIR, BOTH,
)
def _(spark, sf):
    from ..operators.metrics import kendall_tau

    lists = _both(spark, sf).groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct("idx", "x", "y"))).alias("p"))
    return lists.select("a", "b", r6(kendall_tau("p.x", "p.y")).alias("tau"))


@query("met03_spearman_of_ranks", "SELECT a, b, round(CASE WHEN var_pop(x) > 1e-12 AND var_pop(y) > 1e-12 THEN corr(x, y) END, 6) AS r FROM bo GROUP BY a, b", B.SENT, PR, PAIR, BOTH)
def _(spark, sf):
    return _both(spark, sf).groupBy("a", "b").agg(r6(corr_agg("x", "y")).alias("r"))


@query("top01_top_shifted", "SELECT a, b, idx, x - y AS shift FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY abs(x - y) DESC, idx) AS r FROM bo) WHERE r <= 8", B.SENT, PR, PAIR, BOTH)
def _(spark, sf):
    r = F.row_number().over(Window.partitionBy("a", "b").orderBy(F.desc(F.abs(F.col("x") - F.col("y"))), "idx"))
    return _both(spark, sf).withColumn("r", r).where("r <= 8").select("a", "b", "idx", (F.col("x") - F.col("y")).alias("shift"))


@query("top02_top_expressed", "SELECT id, idx, rank FROM pr WHERE rank <= 10", B.SENT, PR)
def _(spark, sf):
    return _ranks(spark, sf).where("rank <= 10").select("id", "idx", "rank")


@query("met08_set_mean_rank", "SELECT s.id, round(avg(coalesce(rank, 41)), 6) AS mean_rank FROM sn s CROSS JOIN (SELECT * FROM wp WHERE idx % 4 = 0) w LEFT JOIN pr ON pr.id = s.id AND pr.idx = w.idx GROUP BY s.id", B.SENT, PR)
def _(spark, sf):
    group = B.word_panel(spark, sf).where("idx % 4 = 0")  # a named set of features
    grid = B.sentences(spark, sf).select("id").join(F.broadcast(group.select("idx")))
    return grid.join(_ranks(spark, sf).select("id", "idx", "rank"), ["id", "idx"], "left").groupBy("id").agg(r6(F.avg(F.coalesce("rank", F.lit(41)))).alias("mean_rank"))
