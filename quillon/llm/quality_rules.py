"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Each rule rejects documents whose feature exceeds a cutoff; a setting gives every rule a cutoff or leaves it out. For each
stratum (language) every setting is tested on the labelled documents: the exact binomial test must show, at a level shared
among all settings and strata (Bonferroni), that its rules together reject at most `risk` of good documents. As all
settings are tested at once, any choice among those that pass keeps the bound; taken is the one that rejects most bad
documents, a good one that it rejects counting as `weight` bad ones. A stratum with too few labels gets no rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, only, small

WORD_PARTS = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: Rules and their rising candidate cutoffs, in thousandths (symbols and marks to characters of words, lines to lines with a word, words to words).
CUTOFFS = {"symbols": [20, 80, 320], "marks": [20, 80, 320], "dup_lines": [200, 400, 600], "repeats": [100, 200, 400]}
#: Ways to set a rule: left out, then its cutoffs from the laxest to the strictest. A setting is a number with a digit for each rule.
WAYS = 4
SETTINGS = WAYS ** len(CUTOFFS)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """doc_id, stratum and whole-text counts. A null text has no words; a null stratum counts as ''."""
    named = only(docs, id_col, text_col, stratum_col).toDF("doc_id", "text", "stratum")
    d = named.select("doc_id", F.coalesce("stratum", F.lit("")).alias("stratum"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("words", F.array_remove(F.split("text", WORD_PARTS), "")).withColumn("n_words", F.size("words").cast("long"))
    lines = F.filter(F.split("text", "\n"), lambda s: F.translate(s, SPACES, "") != "")
    d = d.select(
        "doc_id", "stratum", "words", "n_words", lines.alias("lines"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length("text") - F.length(F.translate("text", "!", ""))).cast("long").alias("n_marks"),
    )
    windows = F.transform(F.sequence(F.lit(0), F.col("n_words").cast("int") - 3), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))
    d = d.withColumn("windows", F.when(F.col("n_words") >= 3, windows).otherwise(F.array().cast("array<bigint>")))
    d = d.withColumn("n_lines", F.size("lines").cast("long")).withColumn("n_dup_lines", F.col("n_lines") - F.size(F.array_distinct("lines"))).drop("words", "lines")
    # Only texts with a repeated window are sorted; equal windows then stand side by side.
    pairs = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("pairs", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), pairs)).drop("windows")
    twice = F.filter("pairs", lambda x, k: F.coalesce(x["h"] == F.get("pairs", k - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get("pairs", k + 1)["h"], F.lit(False)))
    d = d.withColumn("places", F.array_sort(F.transform(twice, lambda x: x["i"]))).drop("pairs")
    # Words covered by the repeated windows, each once.
    covered = F.aggregate(
        "places", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")), lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"), p.alias("last")), lambda acc: acc["n"]
    )
    return d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("places")


def _thousandths() -> dict[str, tuple[Column, Column]]:
    """For each rule, the count and what it is measured against; the rule fires if 1000 * count > cutoff * against."""
    return {"symbols": (F.col("n_symbols"), F.col("word_chars")), "marks": (F.col("n_marks"), F.col("word_chars")), "dup_lines": (F.col("n_dup_lines"), F.col("n_lines")), "repeats": (F.col("n_repeat_words"), F.col("n_words"))}


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of a binomial distribution, summed exactly term by term."""
    odds = F.ln(F.lit(p)) - F.ln(F.lit(1 - p))
    start = F.struct((n * F.ln(F.lit(1 - p))).alias("logp"), F.exp(n * F.ln(F.lit(1 - p))).alias("sum"))

    def step(acc: Column, i: Column) -> Column:
        logp = acc["logp"] + F.ln((n - i + 1).cast("double")) - F.ln(i.cast("double")) + odds
        return F.struct(logp.alias("logp"), (acc["sum"] + F.exp(logp)).alias("sum"))

    upto = F.filter(F.sequence(F.lit(0).cast("long"), k), lambda i: i > 0)
    return F.aggregate(upto, start, step)["sum"]


def _digit(rule: int) -> Column:
    return (F.floor(F.col("setting") / WAYS**rule) % WAYS).cast("int")


def thresholds(found: DataFrame, labels: DataFrame, risk: float, level: float, weight: int = 10, label_id: str = "doc_id", quality_col: str = "quality") -> DataFrame:
    """stratum and the chosen cutoff of each rule (null: not used). found: features(), labels: id and quality (1 is good, 0 bad)."""
    # One label for each id (the least where they differ).
    told = only(labels, label_id, quality_col).toDF("doc_id", "quality").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality in (0, 1)")
    held = found.where("n_words >= 50 and 100 * n_repeat_words <= 50 * n_words").join(told, "doc_id")
    rules = _thousandths()
    # How many of its cutoffs a document exceeds says all about a rule, so a stratum shrinks to a small histogram.
    steps = [sum((F.coalesce(1000 * rules[r][0] > c * rules[r][1], F.lit(False)).cast("int") for c in cuts), F.lit(0)).alias(f"at_{r}") for r, cuts in CUTOFFS.items()]
    names = [f"at_{r}" for r in CUTOFFS]
    counts = materialise(held.select("stratum", "quality", *steps).groupBy("stratum", *names).agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad")), "calibration")
    tried = counts.withColumn("setting", F.explode(F.sequence(F.lit(0), F.lit(SETTINGS - 1))))
    fires = F.lit(False)
    for i, name in enumerate(names):
        fires = fires | (F.col(name) + _digit(i) >= WAYS)
    sums = tried.groupBy("stratum", "setting").agg(F.sum("good").alias("n"), F.sum(F.when(fires, F.col("good")).otherwise(0)).alias("k"), F.sum("bad").alias("n_bad"), F.sum(F.when(fires, F.col("bad")).otherwise(0)).alias("k_bad"))
    per_test = F.lit(level) / F.greatest(F.lit(1), F.col("strata")) / SETTINGS
    sums = sums.join(F.broadcast(counts.agg(F.count_distinct("stratum").alias("strata"))))  # one row
    safe = sums.where(F.col("k") <= F.col("n") * risk).where(binomial_cdf(F.col("k"), F.col("n"), risk) <= per_test)
    worth = F.struct((F.col("k_bad") * F.col("n") - weight * F.col("k") * F.col("n_bad")).alias("worth"), (-F.col("setting")).alias("setting"))
    chosen = safe.groupBy("stratum").agg(F.max_by("setting", worth).alias("setting"))
    cut = lambda i, cuts: F.get(F.array(F.lit(None).cast("int"), *map(F.lit, reversed(cuts))), _digit(i))
    return chosen.select("stratum", *[cut(i, cuts).alias(f"cut_{r}") for i, (r, cuts) in enumerate(CUTOFFS.items())])


def judge(docs: DataFrame, labels: DataFrame, risk: float = 0.05, level: float = 0.05, weight: int = 10, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """One row per document: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed_rules.

    Null, empty and wordless texts have zero counts and fail the base rules. Repeated rows give a row each with equal
    results; empty documents give none, and without labels only the base rules hold. Words repeated in three-word
    windows are told by 64-bit hashes of the windows. Other columns are not looked at.
    """
    found = materialise(features(docs, id_col, text_col, stratum_col), "features")
    cuts = materialise(thresholds(found, labels, risk, level, weight), "cutoffs")
    rules = _thousandths()
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    failed = F.array_compact(F.array(*[F.when(1000 * a > F.col(f"cut_{r}") * b, F.lit(r)) for r, (a, b) in rules.items()]))
    out = found.join(small(cuts), "stratum", "left").withColumn("base_failed", base_failed).withColumn("failed_rules", F.array_join(failed, ","))
    return out.select(F.col("doc_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("failed_rules") == "")).alias("kept"), "failed_rules")


def oracle(risk: float = 0.05, level: float = 0.05, weight: int = 10) -> str:
    """DuckDB SQL for judge() over documents and labels."""
    measure = {"symbols": ("n_symbols", "word_chars"), "marks": ("n_marks", "word_chars"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words")}
    fires = " OR ".join(f"1000 * {a} > CASE setting // {WAYS**i} % {WAYS} " + " ".join(f"WHEN {WAYS - 1 - j} THEN {c}" for j, c in enumerate(CUTOFFS[r])) + f" END * {b}" for i, (r, (a, b)) in enumerate(measure.items()))
    fired = ", ".join(f"CASE WHEN 1000 * {a} > CASE setting // {WAYS**i} % {WAYS} " + " ".join(f"WHEN {WAYS - 1 - j} THEN {c}" for j, c in enumerate(CUTOFFS[r])) + f" END * {b} THEN '{r}' END" for i, (r, (a, b)) in enumerate(measure.items()))
    strip = "replace(replace(replace(replace(replace(replace({0}, ' ', ''), chr(9), ''), chr(10), ''), chr(11), ''), chr(12), ''), chr(13), '')"
    return f"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, stratum, text, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda x: {strip.format("x")} <> '') AS lines FROM t),
g AS (
  SELECT doc_id, i, words[i] || chr(10) || words[i + 1] || chr(10) || words[i + 2] AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM g) WHERE n > 1),
covered AS (
  SELECT doc_id, sum(least(3, i - last)) AS n_repeat_words
  FROM (SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), i - 3) AS last FROM twice) GROUP BY doc_id),
f AS (
  SELECT w.doc_id, stratum, len(words)::BIGINT AS n_words, length({strip.format("text")})::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, length(regexp_replace(text, '[^!]', '', 'g'))::BIGINT AS n_marks,
    len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN covered USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
told AS (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id HAVING min(quality) IN (0, 1)),
held AS (SELECT b.*, quality FROM b JOIN told USING (doc_id) WHERE NOT base_failed),
k AS (
  SELECT stratum, setting, count_if(quality = 1) AS n, count_if(quality = 1 AND coalesce({fires}, false)) AS k,
    count_if(quality = 0) AS n_bad, count_if(quality = 0 AND coalesce({fires}, false)) AS k_bad
  FROM held, range({SETTINGS}) AS s(setting) GROUP BY ALL),
p AS (
  SELECT *, (SELECT sum(exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) + i * ln({risk}) + (n - i) * ln(1 - {risk}))) FROM generate_series(0, k.k::BIGINT) AS s(i)) AS cdf
  FROM k WHERE k <= n * {risk}),
chosen AS (
  SELECT stratum, setting FROM p WHERE cdf <= {level} / (SELECT greatest(1, count(DISTINCT stratum)) FROM k) / {SETTINGS}
  QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY k_bad * n - {weight} * k * n_bad DESC, setting) = 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND rules = '' AS kept, rules AS failed_rules
FROM (SELECT b.*, concat_ws(',', {fired}) AS rules FROM b LEFT JOIN chosen USING (stratum))
"""
