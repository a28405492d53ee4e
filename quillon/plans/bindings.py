"""The tables in the roles that operators need, as DataFrames and as the same DuckDB views (WITH clauses)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONTROL = "AUTOMOBILE"
PANEL_SIZE = 20
SENTENCE_PANEL = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, treatment (0 is control), context, batch, unit, x: dense rows."""
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        v.alias("id"), F.col("label").cast("long").alias("treatment"), (v % 4).alias("context"), (F.floor(v / 4) % 2).alias("batch"), (F.col("label") * 10 + v % 3).alias("unit"), F.col("embedding").cast("array<double>").alias("x")
    )


VEC = """vec AS (SELECT vec_id AS id, label::BIGINT AS treatment, vec_id % 4 AS context, (vec_id // 4) % 2 AS batch, label * 10 + vec_id % 3 AS unit, embedding::DOUBLE[] AS x FROM embeddings),
vl AS (SELECT id, treatment, context, batch, unit, unnest(x) AS v, unnest(range(0, len(x))) AS idx FROM vec)"""


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, treatment, context, batch, unit, feature, value: sparse rows in long form."""
    t = lambda n: table(spark, sf_dir, n)
    part = t("part").select("p_partkey", "p_brand")
    who = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_mktsegment", "n_regionkey", "n_nationkey")
    lines = t("lineitem").select("l_orderkey", "l_partkey", "l_quantity").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    long = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("o_custkey", "p_brand").agg(F.sum("l_quantity").alias("value"))
    return long.join(who, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_custkey").alias("entity"), F.col("c_mktsegment").alias("treatment"), F.col("n_regionkey").cast("long").alias("context"), (F.col("c_custkey") % 2).alias("batch"), F.col("n_nationkey").cast("long").alias("unit"), F.col("p_brand").alias("feature"), "value"
    )


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feature, idx: the first PANEL_SIZE brands in name order."""
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("feature")).distinct()
    ordered = brands.agg(F.array_sort(F.collect_set("feature")).alias("f")).select(F.slice("f", 1, PANEL_SIZE).alias("f"))  # a feature list is small by nature
    return ordered.select(F.posexplode("f").alias("idx", "feature")).select("feature", F.col("idx").cast("long").alias("idx"))


EXPR = f"""ex AS (SELECT o_custkey AS entity, c_mktsegment AS treatment, n_regionkey::BIGINT AS context, c_custkey % 2 AS batch, n_nationkey::BIGINT AS unit, p_brand AS feature, sum(l_quantity) AS value
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
pn AS (SELECT p_brand AS feature, row_number() OVER (ORDER BY p_brand) - 1 AS idx FROM (SELECT DISTINCT p_brand FROM part) QUALIFY idx < {PANEL_SIZE})"""


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, treatment, context, sentence: texts as lower-case letter words parted by one blank."""
    words = F.trim(F.regexp_replace(F.lower(F.regexp_replace("text", "[^A-Za-z]+", " ")), " +", " "))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("treatment"), F.col("lang").alias("context"), words.alias("sentence"))


def word_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tok, idx: the words in most documents, ties by word."""
    docs = sentences(spark, sf_dir).select("id", F.explode(F.array_distinct(F.split("sentence", " "))).alias("tok")).where("tok <> ''")
    top = docs.groupBy("tok").count().orderBy(F.desc("count"), "tok").limit(SENTENCE_PANEL)
    ordered = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("n"), "tok"))).alias("w"))
    return ordered.select(F.posexplode("w").alias("idx", "w")).select(F.col("w.tok").alias("tok"), F.col("idx").cast("long").alias("idx"))


SENT = f"""sn AS (SELECT doc_id AS id, source AS treatment, lang AS context, trim(regexp_replace(lower(regexp_replace(text, '[^A-Za-z]+', ' ', 'g')), ' +', ' ', 'g')) AS sentence FROM documents),
tk AS (SELECT id, treatment, context, unnest(string_split(sentence, ' ')) AS tok, unnest(range(1, len(string_split(sentence, ' ')) + 1)) AS pos FROM sn),
ft AS (SELECT id, treatment, context, tok, min(pos) AS pos FROM tk WHERE tok <> '' GROUP BY ALL),
wp AS (SELECT tok, row_number() OVER (ORDER BY n DESC, tok) - 1 AS idx FROM (SELECT tok, count(*) AS n FROM ft GROUP BY tok) QUALIFY idx < {SENTENCE_PANEL})"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, ts, event_type, user_id, value, raw_value (from props), raw_unit."""
    units = F.element_at(F.array(*[F.lit(u) for u in ("nM", "uM", "mM", "mg/mL")]), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "user_id", "value", F.get_json_object("props", "$.k").alias("raw_value"), units.alias("raw_unit"))


EVENT = """ev AS (SELECT event_id, ts, event_type, user_id, value, json_extract_string(props, '$.k') AS raw_value, (['nM', 'uM', 'mM', 'mg/mL'])[event_id % 4 + 1] AS raw_unit FROM events)"""


def hash_sql(seed: str | int, *parts: str) -> str:
    """functions.core.hash_order in DuckDB SQL."""
    return "('0x' || substr(md5(concat_ws(':', '" + str(seed) + "', " + ", ".join(parts) + ")), 1, 8))::BIGINT"
