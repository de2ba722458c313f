"""Registered queries: every operator on the driver's tables, with equivalent SQL."""

from cohortloom.catalog import (  # noqa: F401
    cohort,
    files,
    images,
    modelling,
    names,
    people,
    planning,
    profile,
    relational,
    scans,
    stored,
)
from cohortloom.catalog.base import REGISTRY, queries, sql_texts  # noqa: F401
