"""Queries over doses, prompts, caps, splits, joins and sources."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.core import r6, same_dose
from ..operators import design as D
from ..operators import matching as MA
from ..operators import prompts as P
from ..operators import sampling as S
from ..sources import files as SRC
from . import bindings as B
from .base import query

DOSE = """ds AS (SELECT *, CASE raw_unit WHEN 'nM' THEN 1e-9 WHEN 'uM' THEN 1e-6 WHEN 'mM' THEN 1e-3 END AS factor, CASE WHEN raw_value IS NULL THEN 'no value' WHEN raw_unit = 'mg/mL' THEN 'mass unit: molecular weight needed' END AS reason FROM ev)"""


def _doses(spark, sf):
    return B.events(spark, sf).withColumn("d", D.dose(F.col("raw_value"), F.col("raw_unit")))


@query("prj42_dose_parse", "SELECT event_id, round(CASE WHEN reason IS NULL THEN raw_value::DOUBLE * factor * 1e9 END, 6) AS nanomolar, reason FROM ds", B.EVENT, DOSE)
def _(spark, sf):
    return _doses(spark, sf).select("event_id", r6(F.col("d.molar") * 1e9).alias("nanomolar"), F.col("d.reason").alias("reason"))


@query("prj45_dose_key", "SELECT round(k * 1e9, 6) AS nanomolar, count(*) AS n FROM (SELECT CASE WHEN m = 0 THEN 0 ELSE round(m / 10 ** (floor(log10(m)) - 5)) * 10 ** (floor(log10(m)) - 5) END AS k FROM (SELECT raw_value::DOUBLE * factor AS m FROM ds WHERE reason IS NULL)) GROUP BY 1", B.EVENT, DOSE)
def _(spark, sf):
    return _doses(spark, sf).where("d.reason is null").groupBy(r6(D.dose_key("d.molar") * 1e9).alias("nanomolar")).agg(F.count("*").alias("n"))


@query("prj43_treatment_lists", "SELECT p_partkey, 1 + (p_size % 2) AS n_parts, CASE WHEN p_size % 2 = 0 THEN p_brand END AS primary_name, p_size % 2 = 1 AS combination, p_size % 10 = 0 AS is_control FROM (SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN 'dmso' ELSE p_brand END AS p_brand, p_size FROM part)")
def _(spark, sf):
    name = F.when(F.col("p_size") % 10 == 0, "dmso").otherwise(F.col("p_brand"))
    one = F.concat(F.lit("('"), name, F.lit("', 0.05, 'uM')"))
    text = F.concat(F.lit("["), one, F.when(F.col("p_size") % 2 == 1, F.concat(F.lit(", ('"), F.col("p_type"), F.lit("', 1.0, 'nM')"))).otherwise(""), F.lit("]"))
    parts = B.table(spark, sf, "part").withColumn("t", D.treatments(text))
    return parts.select("p_partkey", F.size("t").alias("n_parts"), D.primary(F.col("t")).alias("primary_name"), D.is_combination(F.col("t")).alias("combination"), D.is_control(F.col("t")).alias("is_control"))


@query("prj46_quantile_bins", "SELECT bin, count(*) AS n FROM (SELECT CASE WHEN value <= q[1] THEN 0 WHEN value <= q[2] THEN 1 WHEN value <= q[3] THEN 2 ELSE 3 END AS bin FROM ev, (SELECT quantile_cont(value, [0.25, 0.5, 0.75]) AS q FROM ev)) GROUP BY bin", B.EVENT)
def _(spark, sf):
    ev = B.events(spark, sf)
    q = ev.agg(F.percentile("value", F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75)])).alias("q"))  # one row
    v = F.col("value")
    return ev.join(F.broadcast(q)).groupBy(F.when(v <= F.get("q", 0), 0).when(v <= F.get("q", 1), 1).when(v <= F.get("q", 2), 2).otherwise(3).alias("bin")).agg(F.count("*").alias("n"))


@query("agg29_dose_coverage", "SELECT n_values, count(*) AS groups, count(*) FILTER (WHERE n >= 20) AS capped FROM (SELECT event_type, user_id, count(DISTINCT raw_value) AS n_values, count(*) AS n FROM ev GROUP BY ALL) GROUP BY n_values", B.EVENT)
def _(spark, sf):
    return D.coverage_histogram(B.events(spark, sf), ["event_type", "user_id"], "raw_value", 20)


@query("agg31_unit_audit", "SELECT s_nationkey::BIGINT AS unit, count(DISTINCT s_suppkey % 2) AS n_batch, count(DISTINCT s_suppkey % 3) AS n_drug FROM supplier GROUP BY 1 HAVING n_batch > 1 OR n_drug > 1")
def _(spark, sf):
    rows = B.table(spark, sf, "supplier").select(F.col("s_nationkey").cast("long").alias("unit"), (F.col("s_suppkey") % 2).alias("batch"), (F.col("s_suppkey") % 3).alias("drug"))
    return D.unit_audit(rows, "unit", ["batch", "drug"])


EVH = B.hash_sql("cap", "event_id")


@query("win01_cap_per_key", "SELECT event_type, user_id, event_id FROM ev QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) <= 5", B.EVENT)
def _(spark, sf):
    return S.first_per_key(B.events(spark, sf), ["event_type", "user_id"], 5, ["event_id"]).select("event_type", "user_id", "event_id")


@query("win04_middle_dose", "SELECT user_id, list_sort(list(DISTINCT value))[count(DISTINCT value) // 2 + 1] AS middle FROM (SELECT user_id, raw_value::BIGINT AS value FROM ev WHERE raw_value IS NOT NULL) GROUP BY user_id HAVING count(DISTINCT value) >= 3", B.EVENT)
def _(spark, sf):
    return S.middle_value(B.events(spark, sf).where("raw_value is not null").select("user_id", F.col("raw_value").cast("long").alias("value")), ["user_id"], "value")


@query("win05_coverage_stop", "SELECT min(p) AS stop_at, min(covered) AS covered, any_value(total) AS total FROM (SELECT p, (sum(n) OVER (ORDER BY p))::BIGINT AS covered, (sum(n) OVER ())::BIGINT AS total FROM (SELECT p, count(*) AS n FROM (SELECT min(event_id) AS p FROM ev GROUP BY event_type, user_id) GROUP BY p)) WHERE covered >= ceil(total * 0.97)", B.EVENT)
def _(spark, sf):
    return S.coverage_stop(B.events(spark, sf), ["event_type", "user_id"], "event_id", 0.97)


@query("win09_equal_sizes", f"SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY {EVH}, event_id) AS r FROM ev) JOIN (SELECT user_id, min(n) AS k FROM (SELECT user_id, event_type, count(*) AS n FROM ev GROUP BY ALL) GROUP BY user_id) USING (user_id) WHERE r <= k", B.EVENT)
def _(spark, sf):
    return S.equalised(B.events(spark, sf), ["user_id"], ["event_type"], "cap", "event_id").select("user_id", "event_type", "event_id")


@query("win11_round_robin", f"SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY {EVH}, event_id) AS r FROM ev) ORDER BY r, event_type LIMIT 37", B.EVENT)
def _(spark, sf):
    return S.round_robin(B.events(spark, sf), "event_type", 37, "cap", "event_id").select("event_id", "event_type")


@query("win08_dose_extremes", "SELECT event_type, round(arg_max(value, (k, event_id)) - arg_min(value, (k, event_id)), 6) AS swing, count(DISTINCT k) AS levels FROM (SELECT *, raw_value::BIGINT AS k FROM ev WHERE raw_value IS NOT NULL) GROUP BY event_type", B.EVENT)
def _(spark, sf):
    rows = B.events(spark, sf).where("raw_value is not null").withColumn("k", F.col("raw_value").cast("long"))
    key = F.struct("k", "event_id")
    return rows.groupBy("event_type").agg(r6(F.max_by("value", key) - F.min_by("value", key)).alias("swing"), F.countDistinct("k").alias("levels"))


@query("smp01_filled_draw", f"SELECT user_id, event_id, r + i * n AS draw FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {EVH}, event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM ev) CROSS JOIN range(0, 90) t(i) WHERE r + i * n <= 90", B.EVENT)
def _(spark, sf):
    return S.filled_draw(B.events(spark, sf), ["user_id"], 90, "cap", "event_id")


SPLIT = f"""tr AS (SELECT treatment, count(*) AS m FROM (SELECT DISTINCT treatment, context FROM vec) GROUP BY treatment),
un AS (SELECT treatment, m, row_number() OVER (ORDER BY {B.hash_sql("s-t", "treatment")}, treatment) <= floor(count(*) OVER () * 0.2) AS unseen FROM tr),
sp AS (SELECT DISTINCT vec.treatment, vec.context, CASE WHEN unseen THEN 'unseen_treatment' WHEN m >= 3 AND {B.hash_sql("s-p", "vec.treatment", "vec.context")} < {int(0.25 * 2**32)} THEN 'unseen_pair' ELSE 'train' END AS split FROM vec JOIN un USING (treatment))"""


def _split(spark, sf):
    return S.holdout(B.vectors(spark, sf).select("treatment", "context").distinct(), "treatment", "context", 0.2, 0.25, 3, "s")


@query("spl02_three_way_split", "SELECT treatment, context, split FROM sp", B.VEC, SPLIT)
def _(spark, sf):
    return _split(spark, sf).select("treatment", "context", "split")


@query("spl03_unit_holdout", f"SELECT treatment, unit, r < n AND h < {int(0.4 * 2**32)} AS held FROM (SELECT *, row_number() OVER (PARTITION BY treatment ORDER BY {B.hash_sql('u', 'treatment', 'unit')}, unit) AS r, count(*) OVER (PARTITION BY treatment) AS n, {B.hash_sql('u-u', 'treatment', 'unit')} AS h FROM (SELECT DISTINCT treatment, unit FROM vec))", B.VEC)
def _(spark, sf):
    return S.unit_holdout(B.vectors(spark, sf), "treatment", "unit", 0.4, "u")


@query("spl05_worst_label_of_unit", "SELECT treatment, context, (['train', 'unseen_pair', 'unseen_treatment'])[max(CASE split WHEN 'train' THEN 1 WHEN 'unseen_pair' THEN 2 ELSE 3 END) OVER (PARTITION BY context)] AS split FROM sp", B.VEC, SPLIT)
def _(spark, sf):
    return S.worst_label(_split(spark, sf), "context", "split", ["train", "unseen_pair", "unseen_treatment"]).select("treatment", "context", "split")


@query("join18_split_resolution", "SELECT split, count(*) AS n FROM (SELECT coalesce(sp.split, 'train') AS split FROM vec LEFT JOIN (SELECT * FROM sp WHERE split <> 'train') sp USING (treatment, context)) GROUP BY split", B.VEC, SPLIT)
def _(spark, sf):
    held = _split(spark, sf).where("split <> 'train'").select("treatment", "context", "split")
    return B.vectors(spark, sf).join(held, ["treatment", "context"], "left").groupBy(F.coalesce("split", F.lit("train")).alias("split")).agg(F.count("*").alias("n"))


@query("join21_leak_guard", "SELECT count(*) AS n FROM vec WHERE treatment NOT IN (SELECT treatment FROM sp WHERE split <> 'train')", B.VEC, SPLIT)
def _(spark, sf):
    held = _split(spark, sf).where("split <> 'train'").select("treatment").distinct()
    return B.vectors(spark, sf).join(held, "treatment", "left_anti").agg(F.count("*").alias("n"))


CTRL = f"""po AS (SELECT context, batch, id AS control, row_number() OVER (PARTITION BY context, batch ORDER BY {B.hash_sql("m", "id")}, id) - 1 AS i FROM vec WHERE treatment = 0 AND NOT (context = 3 AND batch = 1) QUALIFY i < 4),
pc AS (SELECT context, id AS control, row_number() OVER (PARTITION BY context ORDER BY {B.hash_sql("m", "id")}, id) - 1 AS i FROM vec WHERE treatment = 0 AND NOT (context = 3 AND batch = 1) QUALIFY i < 4)"""


@query(
    "join01_matched_controls",
    f"""SELECT v.id, coalesce(f.control, g.control) AS control, f.control IS NOT NULL AS matched FROM vec v LEFT JOIN (SELECT context, batch, count(*) AS k FROM po GROUP BY ALL) kf USING (context, batch) LEFT JOIN po f ON f.context = v.context AND f.batch = v.batch AND f.i = {B.hash_sql("m_near", "v.id")} % kf.k
LEFT JOIN (SELECT context, count(*) AS k FROM pc GROUP BY ALL) kc ON kc.context = v.context LEFT JOIN pc g ON g.context = v.context AND g.i = {B.hash_sql("m_far", "v.id")} % kc.k WHERE v.treatment <> 0 AND coalesce(f.control, g.control) IS NOT NULL""",
    B.VEC, CTRL,
)
def _(spark, sf):
    v = B.vectors(spark, sf).select("id", "treatment", "context", "batch")
    controls = v.where("treatment = 0 and not (context = 3 and batch = 1)")  # one key without controls, so that the fallback is seen
    return MA.matched_controls(v.where("treatment <> 0"), controls, ["context", "batch"], ["context"], 4, "m", "id").select("id", "control", "matched")


@query("join03_needed_keys", "SELECT count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def _(spark, sf):
    keys = B.table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return B.table(spark, sf, "orders").join(keys, "o_custkey", "left_semi").agg(F.count("*").alias("n"))


@query("join04_found_join", "SELECT found, count(*) AS n FROM (SELECT quality IS NOT NULL AS found FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY found")
def _(spark, sf):
    return MA.found_join(B.table(spark, sf, "documents").select("doc_id"), B.table(spark, sf, "labels"), "doc_id", "quality").groupBy("found").agg(F.count("*").alias("n"))


@query("join05_metadata_defaults", "SELECT n_name, coalesce(nullif(trim(r_name), ''), 'unclear') AS r_name FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey <> 2) ON r_regionkey = n_regionkey")
def _(spark, sf):
    dim = B.table(spark, sf, "region").where("r_regionkey <> 2").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return MA.with_default(B.table(spark, sf, "nation"), dim, ["n_regionkey"], "r_name", "unclear").select("n_name", "r_name")


@query("join09_same_context_pairs", "SELECT context, count(*) AS n FROM vec a JOIN vec b USING (context) WHERE a.id < b.id AND a.treatment <> b.treatment AND a.batch = b.batch GROUP BY context", B.VEC)
def _(spark, sf):
    v = B.vectors(spark, sf)
    return MA.pairs_within(v, ["context"], "id", ["treatment", "batch"], (F.col("a_treatment") != F.col("b_treatment")) & (F.col("a_batch") == F.col("b_batch"))).groupBy("context").agg(F.count("*").alias("n"))


@query("join15_tanimoto_partners", "SELECT a.id, b.id AS other, round(len(list_intersect(a.b, b.b)) / nullif(len(a.b) + len(b.b) - len(list_intersect(a.b, b.b)), 0)::DOUBLE, 6) AS t FROM bits a JOIN bits b ON a.context = b.context AND a.batch = b.batch AND a.id <> b.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY t DESC, b.id) <= 5", B.VEC, "bits AS (SELECT id, context, batch, list_filter(range(0, 64), lambda i: x[i + 1] > 0.1) AS b FROM vec)")
def _(spark, sf):
    bits = B.vectors(spark, sf).select("context", "batch", "id", F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.get("x", i) > 0.1).alias("b"))
    p = bits.join(bits.toDF("context", "batch", "other", "o"), ["context", "batch"]).where("id <> other")
    common = F.size(F.array_intersect("b", "o"))
    t = p.select("id", "other", r6(F.try_divide(common, F.size("b") + F.size("o") - common)).alias("t"))
    return t.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("t"), "other"))).where("r <= 5").drop("r")


PROMPT = """pm AS (SELECT conv_id, turn, role, text, 'Context: ' || role || chr(10) || 'Treatment: T' || conv_id % 7 || ', dose: ' || coalesce((turn + 1) || ' uM', 'unknown') || ', mechanism: ' || CASE WHEN conv_id % 3 = 0 THEN 'unclear' ELSE 'class' || conv_id % 3 END || chr(10) || 'Control cell sentence: ' || regexp_replace(text, '\\s+', ' ', 'g') || chr(10) || 'Perturbed cell sentence:' AS prompt FROM conversations WHERE text IS NOT NULL)"""


def _prompts(spark, sf):
    c = B.table(spark, sf, "conversations").where("text is not null")
    name = F.concat(F.lit("T"), (F.col("conv_id") % 7).cast("string"))
    moa = F.when(F.col("conv_id") % 3 == 0, F.lit("N/A")).otherwise(F.concat(F.lit("Class"), (F.col("conv_id") % 3).cast("string")))
    control = F.regexp_replace("text", r"\s+", " ")
    return c.withColumn("name", name).withColumn("prompt", P.prompt(F.col("role"), name, F.concat((F.col("turn") + 1).cast("string"), F.lit(" uM")), moa, control))


@query("prj31_prompt_assembly", "SELECT conv_id, turn, prompt, substr(sha1(prompt), 1, 16) AS example_id FROM pm", PROMPT)
def _(spark, sf):
    return _prompts(spark, sf).select("conv_id", "turn", "prompt", F.substring(F.sha1(F.col("prompt").cast("binary")), 1, 16).alias("example_id"))


@query("prj33_prompt_parts", "SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS control, split_part(prompt, 'Control cell sentence:', 1) AS header FROM pm", PROMPT)
def _(spark, sf):
    return _prompts(spark, sf).select("conv_id", "turn", P.control_of(F.col("prompt")).alias("control"), P.header_of(F.col("prompt")).alias("header"))


@query("prj35_scramble", "SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN replace(prompt, 'Treatment: T' || conv_id % 7 || ',', 'Treatment: ZZ,') END AS scrambled FROM pm", PROMPT)
def _(spark, sf):
    old = F.when(F.col("conv_id") % 2 == 0, F.col("name")).otherwise(F.lit("absent"))
    return _prompts(spark, sf).select("conv_id", "turn", P.scrambled(F.col("prompt"), old, F.lit("ZZ")).alias("scrambled"))


@query("prj35_scramble_mechanism", "SELECT conv_id, turn, regexp_replace(prompt, ', mechanism: [^\\n]*', ', mechanism: other') AS mechanism_only, CASE WHEN conv_id % 2 = 0 THEN regexp_replace(replace(prompt, 'Treatment: T' || conv_id % 7 || ',', 'Treatment: ZZ,'), ', mechanism: [^\\n]*', ', mechanism: other') END AS both FROM pm", PROMPT)
def _(spark, sf):
    old = F.when(F.col("conv_id") % 2 == 0, F.col("name")).otherwise(F.lit("absent"))
    return _prompts(spark, sf).select("conv_id", "turn", P.other_mechanism(F.col("prompt"), F.lit("other")).alias("mechanism_only"), P.scrambled(F.col("prompt"), old, F.lit("ZZ"), F.lit("other")).alias("both"))


@query("prj37_mechanism_default", "SELECT r_name, CASE WHEN lower(trim(r_name)) IN ('', 'nan', 'none', 'unknown', 'n/a', 'unclear') THEN 'unclear' ELSE lower(trim(r_name)) END AS mechanism FROM region")
def _(spark, sf):
    return B.table(spark, sf, "region").select("r_name", P.known_or_unclear(F.col("r_name")).alias("mechanism"))


@query("src03_capped_scan", "SELECT file, count(*) AS n, max(k) AS last FROM (SELECT * FROM (SELECT 'nation' AS file, n_nationkey::BIGINT AS k FROM nation ORDER BY k LIMIT 7) UNION ALL SELECT * FROM (SELECT 'supplier', s_suppkey::BIGINT AS k FROM supplier ORDER BY k LIMIT 7) UNION ALL SELECT * FROM (SELECT 'region', r_regionkey::BIGINT AS k FROM region ORDER BY k LIMIT 7)) GROUP BY file")
def _(spark, sf):
    """The first rows of each of three files, read together."""
    part = lambda t, k: B.table(spark, sf, t).select(F.lit(t).alias("file"), F.col(k).cast("long").alias("k"))
    files = part("nation", "n_nationkey").unionByName(part("supplier", "s_suppkey")).unionByName(part("region", "r_regionkey"))
    return SRC.capped_scan(files, 7, "k").groupBy("file").agg(F.count("*").alias("n"), F.max("k").alias("last"))


@query("src16_schema_report", "SELECT count(*) AS n, count(DISTINCT p_brand) AS features, (SELECT count(*) FROM pn) AS on_panel FROM part", B.EXPR)
def _(spark, sf):
    part = B.table(spark, sf, "part")
    on = part.select(F.col("p_brand").alias("feature")).distinct().join(B.panel(spark, sf), "feature", "left_semi").agg(F.count("*").alias("on_panel"))
    return part.agg(F.count("*").alias("n"), F.countDistinct("p_brand").alias("features")).join(F.broadcast(on))


@query("snk09_table_digest")
def _(spark, sf):
    return SRC.table_digest(B.table(spark, sf, "events"), ["event_id", "event_type", "user_id"])


@query("snk10_missing_artifacts", "SELECT n_name AS name FROM nation WHERE n_name NOT IN (SELECT n_name FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE s_acctbal > 9000)")
def _(spark, sf):
    nation, supplier = B.table(spark, sf, "nation"), B.table(spark, sf, "supplier")
    present = supplier.where("s_acctbal > 9000").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("name"))
    return SRC.missing_artifacts(nation.select(F.col("n_name").alias("name")), present)


@query("top05_hash_sample", f"SELECT event_id FROM ev ORDER BY {EVH}, event_id LIMIT 100", B.EVENT)
def _(spark, sf):
    return SRC.sampled_rows(B.events(spark, sf), 100, "cap", "event_id").select("event_id")


@query("agg26_breakdown", "SELECT event_type, round(avg(value), 6) AS mean, round(1.96 * stddev_samp(value) / sqrt(count(*)), 6) AS half, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS q2, round(quantile_cont(value, 0.75), 6) AS q3, count(*) AS n FROM ev GROUP BY event_type HAVING count(*) >= 10", B.EVENT)
def _(spark, sf):
    q = lambda p: r6(F.percentile("value", F.lit(p)))
    out = B.events(spark, sf).groupBy("event_type").agg(r6(F.avg("value")).alias("mean"), r6(1.96 * F.stddev_samp("value") / F.sqrt(F.count("*"))).alias("half"), q(0.25).alias("q1"), q(0.5).alias("q2"), q(0.75).alias("q3"), F.count("*").alias("n"))
    return out.where("n >= 10")


@query("set01_key_sets", "SELECT 'both' AS side, count(*) AS n FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders) UNION ALL SELECT 'left', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)")
def _(spark, sf):
    a, b = B.table(spark, sf, "customer").select(F.col("c_custkey").alias("k")), B.table(spark, sf, "orders").select(F.col("o_custkey").alias("k"))
    part = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("side"), "n")
    return part(a.intersect(b), "both").unionByName(part(a.subtract(b), "left"))


@query("flt16_label_purity", "SELECT round(avg(share), 6) AS purity FROM (SELECT lang, max(n) / sum(n) AS share FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL) GROUP BY lang)")
def _(spark, sf):
    n = B.table(spark, sf, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    return n.groupBy("lang").agg((F.max("n") / F.sum("n")).alias("share")).agg(r6(F.avg("share")).alias("purity"))


@query("same_dose_pairs", "SELECT count(*) AS n FROM (SELECT event_type, user_id, raw_value::DOUBLE * factor AS m, event_id FROM ds WHERE reason IS NULL) a JOIN (SELECT event_type, user_id, raw_value::DOUBLE * factor AS m, event_id FROM ds WHERE reason IS NULL) b USING (event_type, user_id) WHERE a.event_id < b.event_id AND abs(a.m - b.m) <= 1e-6 * greatest(abs(a.m), abs(b.m))", B.EVENT, DOSE)
def _(spark, sf):
    d = _doses(spark, sf).select("event_type", "user_id", "event_id", F.col("d.molar").alias("m"))
    return MA.pairs_within(d, ["event_type", "user_id"], "event_id", ["m"], same_dose("a_m", "b_m")).agg(F.count("*").alias("n"))

