"""Prompt texts: assembly, parsing and scrambling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNCLEAR = "unclear"
CONTROL_MARK = "Control cell sentence:"
END_MARK = "Perturbed cell sentence:"


def known_or_unclear(value: Column) -> Column:
    """A label in lower case, 'unclear' where it is missing or says nothing."""
    v = F.lower(F.trim(value))
    return F.when(v.isNull() | v.isin("", "nan", "none", "unknown", "n/a", UNCLEAR), UNCLEAR).otherwise(v)


def prompt(context: Column, treatment: Column, dose: Column, mechanism: Column, control: Column) -> Column:
    """One prompt; the control block is left out where control is null."""
    head = F.concat(F.lit("Context: "), context, F.lit("\nTreatment: "), treatment, F.lit(", dose: "), F.coalesce(dose, F.lit("unknown")), F.lit(", mechanism: "), known_or_unclear(mechanism))
    return F.concat_ws("\n", head, F.concat(F.lit(CONTROL_MARK + " "), control), F.lit(END_MARK))


def control_of(text: Column) -> Column:
    """The control block of a prompt; '' where its mark is absent."""
    after = F.when(F.instr(text, CONTROL_MARK) > 0, F.substring_index(text, CONTROL_MARK, -1)).otherwise("")
    return F.trim(F.regexp_replace(F.substring_index(after, END_MARK, 1), "\n", " "))


def header_of(text: Column) -> Column:
    return F.substring_index(F.substring_index(text, CONTROL_MARK, 1), END_MARK, 1)


def scrambled(text: Column, old: Column, new: Column, mechanism: Column | None = None) -> Column:
    """The prompt with the first mention of old on its treatment line replaced; null where that line doesn't name it.

    Only the first treatment line changes. With a mechanism, what that line gives as such is replaced too.
    """
    lines = F.split(text, "\n")
    number = F.array_position(F.transform(lines, lambda s: s.startswith("Treatment: ")), True).cast("int")
    line = F.get(lines, number - 1)
    at = F.position(old, line)
    swapped = F.overlay(line, new, at, F.length(old))
    if mechanism is not None:
        swapped = F.concat(F.substring_index(swapped, ", mechanism: ", 1), F.lit(", mechanism: "), mechanism)
    return F.when(at > 0, F.array_join(F.transform(lines, lambda s, i: F.when(i == number - 1, swapped).otherwise(s)), "\n"))


def other_mechanism(text: Column, mechanism: Column) -> Column:
    """The prompt with another mechanism on its first treatment line; null without such a line or field."""
    lines = F.split(text, "\n")
    number = F.array_position(F.transform(lines, lambda s: s.startswith("Treatment: ")), True).cast("int")
    line = F.get(lines, number - 1)
    swapped = F.concat(F.substring_index(line, ", mechanism: ", 1), F.lit(", mechanism: "), mechanism)
    return F.when(F.instr(line, ", mechanism: ") > 0, F.array_join(F.transform(lines, lambda s, i: F.when(i == number - 1, swapped).otherwise(s)), "\n"))
