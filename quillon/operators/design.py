"""Doses, treatments and units: parsing and audits of the experimental design."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import dose_key

#: Moles per litre in one of each unit, in lower case, with either micro sign or u.
MOLAR_UNITS = {"m": 1.0, "mm": 1e-3, "um": 1e-6, "μm": 1e-6, "µm": 1e-6, "nm": 1e-9, "pm": 1e-12, "fm": 1e-15}
#: Units of mass, share or strength, in lower case, which need a molecular weight or mean no amount.
OTHER_UNITS = ("mg/ml", "ug/ml", "μg/ml", "µg/ml", "ng/ml", "%", "v/v", "w/v", "x")
#: Spellings of the vehicle control, upper-cased.
CONTROL_NAMES = ("DMSO", "DMSO_TF", "VEHICLE", "UNTREATED", "")


def dose(value: Column, unit: Column) -> Column:
    """struct<molar, reason>: the dose in moles per litre, or null with the reason why there is none. 0 is a dose."""
    number = F.when(F.trim(value).rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), F.trim(value).try_cast("double"))
    named = F.regexp_replace(F.lower(F.trim(unit)), " ", "")
    factor = F.create_map(*[F.lit(x) for kv in MOLAR_UNITS.items() for x in kv])[named]
    mass = named.isin(*OTHER_UNITS)
    reason = F.when(value.isNull() | (F.trim(value) == ""), "no value").when(number.isNull(), "not a number").when(unit.isNull() | (F.trim(unit) == ""), "no unit").when(mass, "mass unit: molecular weight needed").when(factor.isNull(), "unknown unit")
    return F.struct(F.when(reason.isNull(), number * factor).alias("molar"), reason.alias("reason"))


def dose_text(text: Column) -> Column:
    """The same from one text such as '0.05 uM'."""
    parts = F.trim(text)
    return dose(F.nullif(F.regexp_extract(parts, r"^([^\s]*[0-9.])\s*(.*)$", 1), F.lit("")), F.nullif(F.trim(F.regexp_extract(parts, r"^([^\s]*[0-9.])\s*(.*)$", 2)), F.lit("")))


def treatments(text: Column) -> Column:
    """array<struct<name, value, unit>> of a literal list such as [('A', 0.05, 'uM'), ('B', 1.0, 'nM')]; all components stay."""
    pattern = r"\(\s*'([^']*)'\s*,\s*([^,\s]+)\s*,\s*'([^']*)'\s*\)"
    names, values, units = (F.regexp_extract_all(text, F.lit(pattern), F.lit(i)) for i in (1, 2, 3))
    return F.transform(F.arrays_zip(names.alias("name"), values.alias("value"), units.alias("unit")), lambda t: F.struct(t["name"].alias("name"), t["value"].alias("value"), t["unit"].alias("unit")))


def is_combination(parts: Column) -> Column:
    return F.size(parts) > 1


def is_control(parts: Column) -> Column:
    """Whether all components are spellings of the control; a list without components is one."""
    return F.forall(parts, lambda t: F.upper(F.trim(t["name"])).isin(*CONTROL_NAMES))


def primary(parts: Column) -> Column:
    """The name of the only component; null for combinations."""
    return F.when(F.size(parts) == 1, F.get(parts, 0)["name"])


def unit_audit(rows: DataFrame, unit: str, attributes: list[str]) -> DataFrame:
    """unit and the number of distinct values of each attribute, for units with more than one of any."""
    counted = rows.groupBy(unit).agg(*[F.countDistinct(a).alias(f"n_{a}") for a in attributes])
    return counted.where(" or ".join(f"n_{a} > 1" for a in attributes))


def coverage_histogram(rows: DataFrame, group: list[str], value: str, cap: int) -> DataFrame:
    """n_values, groups, capped: how many groups have so many distinct values, and how many of them reach the cap in rows."""
    per = rows.groupBy(*group).agg(F.countDistinct(value).alias("n_values"), F.count("*").alias("n"))
    return per.groupBy("n_values").agg(F.count("*").alias("groups"), F.count_if(F.col("n") >= cap).alias("capped"))


def resolve_column(df: DataFrame, candidates: list[str]) -> str:
    """The first of the candidate names that the frame has."""
    for c in candidates:
        if c in df.columns:
            return c
    raise KeyError(f"none of {candidates} in {df.columns}")


def looks_like_unit_ids(rows: DataFrame, column: str, pattern: str = "^smp_[0-9]+$", share: float = 0.5) -> bool:
    """Whether more than the share of a column's values are unit ids; callers refuse to write such a dose column."""
    return bool(rows.agg(F.coalesce(F.avg(F.col(column).rlike(pattern).cast("int")), F.lit(0.0)) > share).first()[0])


__all__ = ["CONTROL_NAMES", "MOLAR_UNITS", "coverage_histogram", "dose", "dose_key", "dose_text", "is_combination", "is_control", "looks_like_unit_ids", "primary", "resolve_column", "treatments", "unit_audit"]
