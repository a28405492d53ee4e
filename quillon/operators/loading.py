"""Compositions that load tables for a run: two-pass caches, tiers, selections, harvests, contexts, nested results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import col, hash_order
from . import prompts as P
from .sampling import first_per_key

Order = Sequence[Column | str]


def two_passes(rows: DataFrame, is_control: Column, condition: list[str], group: list[str], per_condition: int, per_group: int, order: Order) -> DataFrame:
    """rows with is_control: the first per_condition treated rows of each condition, then the first per_group controls of each group that has any."""
    treated = first_per_key(rows.where(~is_control), condition, per_condition, list(order))
    needed = treated.select(*group).distinct()
    controls = first_per_key(rows.where(is_control).join(needed, group, "left_semi"), group, per_group, list(order))
    return treated.withColumn("is_control", F.lit(False)).unionByName(controls.withColumn("is_control", F.lit(True)))


def tier_rows(rows: DataFrame, same_batch: bool, excluded: DataFrame | None = None, line: Sequence[str] = ("line",)) -> DataFrame:
    """rows (context, batch, treatment, prompt, ...) that can be scored, with their control and their group (context, group_batch).

    Rows without context, treatment or control go, and so do those of excluded (its columns are line). With same_batch rows
    of different batches don't share a group and rows of unknown batch go; else group_batch is null.
    """
    kept = rows if excluded is None else rows.join(excluded, list(line), "left_anti")
    out = kept.withColumn("control", P.control_of(F.col("prompt"))).where("context is not null and treatment is not null and control <> ''")
    if same_batch:
        return out.where("batch is not null").withColumn("group_batch", F.col("batch"))
    return out.withColumn("group_batch", F.lit(None).cast(rows.schema["batch"].dataType))


def train_selection(train: DataFrame, evaluated: DataFrame, condition: list[str], group: list[str], per_group: int, order: Order) -> tuple[DataFrame, DataFrame]:
    """Train rows of each (tier, condition) that evaluated has, and the first per_group distinct controls of those tiers' groups.

    Controls are told apart by their whole text; evaluated: tier and the columns of condition.
    """
    wanted = evaluated.select("tier", *condition).distinct()
    cells = train.join(wanted, condition)
    digest = F.sha1(F.col("control").cast("binary")).alias("_digest")
    once = first_per_key(train.where("control <> ''").withColumn("_digest", digest), [*group, "_digest"], 1, list(order)).drop("_digest")
    return cells, first_per_key(once, group, per_group, list(order)).join(cells.select("tier", *group).distinct(), group)


def harvested_controls(rows: DataFrame, keys: list[str], context: str, per_key: int, per_context: int, order: Order) -> DataFrame:
    """rows with level: the first per_key rows of each key, and as a second choice the first per_context of each context."""
    known = rows.where(" and ".join(f"`{k}` is not null" for k in {*keys, context}) + " and control <> ''")
    by_key = first_per_key(known, keys, per_key, list(order)).withColumn("level", F.lit("key"))
    return by_key.unionByName(first_per_key(known, [context], per_context, list(order)).withColumn("level", F.lit("context")))


def fixed_contexts(rows: DataFrame, contexts: int, treatments: int, least: int, seed: str, order: Order) -> DataFrame:
    """context, treatment, prompt: one control for all treatments of a context, so that only the header differs.

    Contexts with the most treatments come first (ties by context), those under least stay out; a context's control is its
    first that isn't empty, a treatment's header that of its first row, and treatments are taken in hash order.
    """
    held = rows.where("context is not null and treatment is not null").withColumn("header", P.header_of(F.col("prompt"))).withColumn("control", P.control_of(F.col("prompt")))
    heads = first_per_key(held, ["context", "treatment"], 1, list(order)).select("context", "treatment", "header")
    control = first_per_key(held.where("control <> ''"), ["context"], 1, list(order)).select("context", "control")
    sizes = heads.groupBy("context").agg(F.count("*").alias("n")).where(F.col("n") >= least).join(control, "context")
    chosen = sizes.orderBy(F.desc("n"), "context").limit(contexts).drop("n")
    taken = first_per_key(heads.join(F.broadcast(chosen), "context"), ["context"], treatments, [hash_order(seed, "context", "treatment"), "treatment"])  # as many contexts as asked for
    return taken.select("context", "treatment", F.concat("header", F.lit(P.CONTROL_MARK + " "), "control", F.lit("\n" + P.END_MARK)).alias("prompt"))


# --- values and keys --------------------------------------------------------


def decoded(code: Column | str, categories: Column | str, missing: str = "NA") -> Column:
    """The category of a code (from 0); missing where the code is null or outside of the list, or the category is null."""
    c, names = col(code).cast("int"), col(categories)
    return F.coalesce(F.when((c >= 0) & (c < F.size(names)), F.get(names, c)), F.lit(missing))


def baseline_key(mode: str, context: Column | str, mechanism: Column | str) -> Column:
    """The group in which a baseline is estimated: global (null), context, mechanism or mechanism_context."""
    c, m = col(context), col(mechanism)
    said = F.when(m.isNull() | m.isin("", "unknown", "nan", "None"), P.UNCLEAR).otherwise(m)
    forms = {"global": F.lit(None).cast("string"), "context": c, "mechanism": said, "mechanism_context": F.concat_ws("||", said, F.coalesce(c, F.lit("None")))}
    if mode not in forms:
        raise ValueError(f"unknown mode {mode}")
    return forms[mode]


def rounded_dose(dose: Column | str, digits: int = 6) -> Column:
    """A dose as part of a group's key: equal to so many decimal places; null stays null, a group of its own."""
    return F.round(col(dose).cast("double"), digits) + F.lit(0.0)


def result_rows(docs: DataFrame, doc: str, key: str, predictors: Sequence[str], needed: Sequence[str]) -> DataFrame:
    """tier, context, treatment, n and one value for each predictor, from nested results {"tiers": {tier: {"rows": [...]}}}.

    A row's own tier goes before the one that it lies under. A predictor's value is null if it isn't an object with the key;
    rows without a value of any needed predictor go.
    """
    fields = ", ".join(["tier string", "context string", "treatment string", "n long", *[f"`{p}` string" for p in predictors]])
    tiers = docs.select(F.explode(F.from_json(col(doc), f"tiers map<string, struct<rows: array<struct<{fields.replace(' string', ': string').replace(' long', ': long')}>>>>")["tiers"]).alias("_tier", "_held"))
    rows = tiers.select("_tier", F.explode("_held.rows").alias("r"))
    out = rows.select(F.coalesce("r.tier", "_tier").alias("tier"), "r.context", "r.treatment", "r.n", *[F.get_json_object(F.col("r")[p], f"$.{key}").cast("double").alias(p) for p in predictors])
    return out.where(F.coalesce(*[F.col(p) for p in needed]).isNotNull())


def swap_verdict(lo: Column | str, hi: Column | str, margin: Column | str) -> Column:
    """What an interval of a displacement says. Equivalence needs the whole interval inside the margin and zero inside the interval.

    A margin finer than half of the interval's half-width resolves nothing; without a margin only the sign can be told.
    """
    a, b, m = (col(c).cast("double") for c in (lo, hi, margin))
    half = (b - a) / 2
    known = lambda c: c.isNotNull() & ~F.isnan(c)
    verdict = F.when(~known(a) | ~known(b), "too few clusters")
    bare = F.when(a > 0, "toward").when(b < 0, "away").otherwise("no margin")
    verdict = verdict.when(~known(m) | (F.abs(m) == float("inf")) | (m <= 0), bare).when((half > 0) & (m < 0.5 * half), "margin below resolution")
    verdict = verdict.when(a > m, "toward").when(b < -m, "away")
    inside = (a > -m) & (b < m)
    return verdict.when(inside & (a <= 0) & (b >= 0), "equivalent").when(inside, "directional, below margin").otherwise("inconclusive")
