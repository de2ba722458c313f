"""Rules that are data: a table of constraints becomes one expression per row and one aggregate.

A rule is a row of a file, with the columns ``rule`` (its name), ``kind``, ``columns`` (separated by commas),
``value`` and ``where`` (an SQL condition that limits it; empty: all rows). Kinds:

========== ============================================ ===========================================
kind       holds when                                   ``value``
========== ============================================ ===========================================
not_null   every column has a value                     --
range      the columns lie within both bounds           ``low..high``, either may be empty
one_of     the columns are among the values             values separated by ``|``
pattern    the columns match the whole pattern          a regular expression
sql        the condition holds                          an SQL condition
unique     no other row has the same columns            --
column     the table has these columns                  --
========== ============================================ ===========================================

A missing value breaks ``not_null`` only; for ``unique`` missing values are equal. ``sql`` holds unless it is false.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.operators.quality import MissingColumnError, require_columns

KINDS = ("not_null", "range", "one_of", "pattern", "sql", "unique", "column")


@dataclass(frozen=True)
class Rule:
    name: str
    kind: str
    columns: tuple[str, ...] = ()
    value: str = ""
    where: str = ""

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"rule {self.name}: unknown kind {self.kind}")
        if not self.columns and self.kind != "sql":
            raise ValueError(f"rule {self.name}: no columns")


def read_rules(spark: SparkSession, path: str) -> list[Rule]:
    """Rules of a CSV file. They come to the driver: their number is that of lines somebody wrote."""
    rows = spark.read.csv(path, header=True, escape='"', multiLine=True)
    require_columns(rows, ["rule", "kind", "columns", "value", "where"])
    out = []
    for r in rows.orderBy("rule").collect():
        columns = tuple(c.strip() for c in (r["columns"] or "").split(",") if c.strip())
        out.append(Rule(r["rule"], r["kind"], columns, r["value"] or "", r["where"] or ""))
    if len({r.name for r in out}) < len(out):
        raise ValueError("two rules have one name")
    return out


def _all(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts)


def _applies(rule: Rule) -> Column:
    return F.coalesce(F.expr(rule.where), F.lit(False)) if rule.where else F.lit(True)


def _within(c: Column, bounds: str) -> Column:
    low, mark, high = bounds.partition("..")
    if not mark:
        raise ValueError(f"a range is low..high, not {bounds}")
    number = c.try_cast("double")
    held = F.lit(True)
    if low.strip():
        held = held & (number >= float(low))
    if high.strip():
        held = held & (number <= float(high))
    # text that is no number, and NaN, are outside every range
    return c.isNull() | F.coalesce(held & ~F.isnan(number), F.lit(False))


def broken(rule: Rule) -> Column:
    """Whether a row breaks a rule about single rows."""
    columns = [F.col(f"`{c}`") for c in rule.columns]
    if rule.kind == "not_null":
        holds = _all([c.isNotNull() for c in columns])
    elif rule.kind == "range":
        holds = _all([_within(c, rule.value) for c in columns])
    elif rule.kind == "one_of":
        holds = _all([c.isNull() | c.cast("string").isin(*rule.value.split("|")) for c in columns])
    elif rule.kind == "pattern":
        holds = _all([c.isNull() | c.cast("string").rlike(rf"\A(?:{rule.value})\z") for c in columns])
    elif rule.kind == "sql":
        holds = F.coalesce(F.expr(rule.value), F.lit(True))
    else:
        raise ValueError(f"{rule.kind} is no rule about single rows")
    return _applies(rule) & ~holds


def _known(df: DataFrame, rules: Sequence[Rule]) -> None:
    """Columns that a rule needs must be there, but for the rules that ask for them."""
    for rule in rules:
        missing = [c for c in rule.columns if c not in df.columns]
        if missing and rule.kind != "column":
            raise MissingColumnError(f"rule {rule.name}: missing columns {missing}")


def _repeats(df: DataFrame, rule: Rule) -> DataFrame:
    """Keys of several rows and how many rows they cover; counted in the tasks before the shuffle."""
    kept = df.filter(F.expr(rule.where)) if rule.where else df
    counts = kept.groupBy(*[F.col(f"`{c}`") for c in rule.columns]).agg(F.count(F.lit(1)).alias("_n"))
    return counts.filter("_n > 1")


def check_rules(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``rule, kind, n_rows, n_broken`` for every rule, in one plan.

    All rules about single rows are one aggregate in one scan; every ``unique`` rule adds an aggregate by its
    key. ``n_rows`` are the rows that a rule applies to. For ``unique`` all rows of a repeated key are broken; for ``column``
    one for each missing column.
    """
    _known(df, rules)
    single = [r for r in rules if r.kind not in ("unique", "column")]
    keyed = [r for r in rules if r.kind == "unique"]
    asked = [*single, *keyed]
    aggregates = [F.count_if(_applies(r)).alias(f"a{i}") for i, r in enumerate(asked)]
    aggregates += [F.count_if(broken(r)).alias(f"b{i}") for i, r in enumerate(single)]
    rows = [
        F.struct(F.lit(r.name).alias("rule"), F.lit(r.kind).alias("kind"), F.col(f"a{i}").alias("n_rows"),
                 (F.col(f"b{i}") if i < len(single) else F.lit(None).cast("long")).alias("n_broken"))
        for i, r in enumerate(asked)
    ]
    found = None
    if asked:
        found = df.agg(*aggregates).select(F.explode(F.array(*rows)).alias("r")).select("r.*")
        for r in keyed:
            covered = _repeats(df, r).agg(F.coalesce(F.sum("_n"), F.lit(0))).scalar()
            found = found.withColumn("n_broken", F.when(F.col("rule") == r.name, covered).otherwise(F.col("n_broken")))
    headers = [
        (r.name, r.kind, len(r.columns), sum(c not in df.columns for c in r.columns)) for r in rules if r.kind == "column"
    ]
    table = df.sparkSession.createDataFrame(headers, "rule string, kind string, n_rows long, n_broken long")
    return table if found is None else found.unionByName(table) if headers else found


def with_violations(df: DataFrame, rules: Sequence[Rule], name: str = "violations") -> DataFrame:
    """Append the names of all rules that a row breaks, in the order of the rules; an empty array for none.

    Repeated keys are looked up by a join; Spark broadcasts them when they are few, as they should be.
    """
    _known(df, rules)
    flags, out = [], df
    for i, rule in enumerate(r for r in rules if r.kind != "column"):
        if rule.kind == "unique":
            keys = _repeats(df, rule).select(*[F.col(f"`{c}`").alias(f"_k{i}_{j}") for j, c in enumerate(rule.columns)])
            match = _all([F.col(f"`{c}`").eqNullSafe(F.col(f"_k{i}_{j}")) for j, c in enumerate(rule.columns)])
            out = out.join(keys.withColumn(f"_u{i}", F.lit(True)), match & _applies(rule), "left")
            flags.append(F.when(F.coalesce(F.col(f"_u{i}"), F.lit(False)), F.lit(rule.name)))
        else:
            flags.append(F.when(broken(rule), F.lit(rule.name)))
    listed = F.filter(F.array(*flags), lambda x: x.isNotNull()) if flags else F.array().cast("array<string>")
    return out.select(*[F.col(f"`{c}`") for c in df.columns], listed.alias(name))
