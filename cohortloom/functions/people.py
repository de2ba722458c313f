"""Participant-table normalization."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortloom.config import AGE_UNIT_BY_DATASET, SEX_SPELLINGS
from cohortloom.functions.missing import nan_to_null

# what a plain decimal, an exponent form or an infinity looks like; keeps '1d' and '1f' out
NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))\s*$"


def literal_map(table: Mapping[str, str]) -> Column:
    """A small fixed table as a map literal."""
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def strip_prefix(c: Column, prefix: str) -> Column:
    """Remove one leading ``prefix`` (``sub-`` or ``ses-``)."""
    return F.when(c.startswith(prefix), F.substr(c, F.lit(len(prefix) + 1))).otherwise(c)


def strip_space(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def normalize_sex(c: Column) -> Column:
    """M or F for the six known spellings, NULL for anything else."""
    return F.try_element_at(literal_map(SEX_SPELLINGS), F.lower(strip_space(c)))


def normalize_age(c: Column) -> Column:
    """Number rounded half-even to two places, NULL for text that is no number."""
    number = F.when(c.rlike(NUMBER), F.trim(c).try_cast("double"))
    finite = F.abs(number) < F.lit(float("inf"))
    return nan_to_null(F.when(finite, F.bround(number, 2)).otherwise(number))


def null_if_nonpositive(c: Column) -> Column:
    return F.when(nan_to_null(c) > 0, c)


def header_for(header: Column, names: Sequence[str]) -> Column:
    """The header a case-insensitive preference list picks; NULL when none is present.

    Among headers that differ only in case, the last one stands for the name.
    """


    def last_named(name: str) -> Column:
        return F.try_element_at(F.filter(header, lambda h: F.lower(h) == name), F.lit(-1))

    return F.coalesce(*[last_named(n) for n in names])


def header_index(header: Column, name: Column) -> Column:
    """0-based position of a header, NULL when it is absent."""
    return F.nullif(F.array_position(header, name), F.lit(0)).cast("int") - 1


def age_header(dataset: Column, header: Column, overrides: Mapping[str, str]) -> Column:
    """The age column: an exact-case override for the dataset, otherwise ``age``."""
    return F.coalesce(F.try_element_at(literal_map(overrides), dataset), header_for(header, ["age"]))


def age_unit(
    dataset: Column, description: Column, overrides: Mapping[str, str] = AGE_UNIT_BY_DATASET
) -> Column:
    """``months`` or ``years``: the override table first, then the column description."""
    return F.coalesce(
        F.try_element_at(literal_map(overrides), dataset),
        F.when(F.lower(description).contains("month"), F.lit("months")),
        F.lit("years"),
    )


def age_in_years(age: Column, unit: Column) -> Column:
    return F.when(unit == "months", age / 12.0).otherwise(age)
