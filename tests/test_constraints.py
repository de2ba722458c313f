"""Rules as data, rejects counted while they are written, and metrics rolled up from moments."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortloom.operators.aggregates import error_moments, merged_moments, metrics_of, regression_metrics
from cohortloom.operators.constraints import Rule, check_rules, read_rules, with_violations
from cohortloom.operators.quality import MissingColumnError, divide

ROWS = [
    ("a", 1, 5.0, "x1", "m"),
    ("a", 1, 500.0, "x1 ", None),
    ("b", None, float("nan"), None, "f"),
    (None, 2, None, "y", "q"),
    (None, 2, -1.0, "x2", "m"),
    ("c", 3, 7.0, "x3\n", "f"),
]


@pytest.fixture
def rows(spark):
    return spark.createDataFrame(ROWS, "`k` string, n int, v double, `t x` string, s string")


RULES = [
    Rule("named", "not_null", ("k", "n")),
    Rule("spread", "range", ("v",), "0..100"),
    Rule("low", "range", ("v", "n"), "..6"),
    Rule("text", "pattern", ("t x",), "[xy][0-9]?"),
    Rule("sex", "one_of", ("s",), "m|f"),
    Rule("pair", "unique", ("k", "n")),
    Rule("first", "unique", ("n",), "", "k is not null"),
    Rule("logic", "sql", (), "v <= n * 10", "k = 'a'"),
    Rule("header", "column", ("k", "missing", "gone")),
]
BROKEN = [
    ["pair", "first"],
    ["spread", "low", "text", "pair", "first", "logic"],
    ["named", "spread", "low"],
    ["named", "sex", "pair"],
    ["named", "spread", "pair"],
    ["low", "text"],
]


def test_every_kind_of_rule(rows):
    marked = with_violations(rows.withColumn("i", F.monotonically_increasing_id()), RULES)
    got = [r.violations for r in sorted(marked.collect(), key=lambda r: r.i)]
    assert got == BROKEN
    assert marked.columns == [*rows.columns, "i", "violations"]
    counted = {r.rule: (r.kind, r.n_rows, r.n_broken) for r in check_rules(rows, RULES).collect()}
    applies = {"first": 4, "logic": 2, "header": 3}
    for rule in RULES:
        n = 2 if rule.name == "header" else sum(rule.name in b for b in BROKEN)
        assert counted[rule.name] == (rule.kind, applies.get(rule.name, len(ROWS)), n)


def test_empty_table_no_rules_and_bad_rules(spark, rows):
    none = rows.limit(0)
    assert {r.rule: (r.n_rows, r.n_broken) for r in check_rules(none, RULES[:-1]).collect()} == {r.name: (0, 0) for r in RULES[:-1]}
    assert with_violations(none, RULES).count() == 0
    assert check_rules(rows, []).count() == 0 and with_violations(rows, []).first().violations == []
    assert [tuple(r) for r in check_rules(rows, RULES[-1:]).collect()] == [("header", "column", 3, 2)]
    with pytest.raises(MissingColumnError, match="rule z"):
        check_rules(rows, [Rule("z", "not_null", ("nothing",))])
    with pytest.raises(ValueError, match="unknown kind"):
        Rule("z", "other", ("k",))
    with pytest.raises(ValueError, match="low..high"):
        check_rules(rows, [Rule("z", "range", ("v",), "5")])


def test_rules_are_read_from_a_file(spark, rows, tmp_path):
    (tmp_path / "r.csv").write_text('rule,kind,columns,value,where\nspread,range,"v , n",0..100,\n"logic",sql,,"v < 3 and\n n > 1","k = \'a\'"\n')
    rules = read_rules(spark, str(tmp_path / "r.csv"))
    assert rules == [Rule("logic", "sql", (), "v < 3 and\n n > 1", "k = 'a'"), Rule("spread", "range", ("v", "n"), "0..100")]
    assert check_rules(rows, rules).count() == 2
    (tmp_path / "twice.csv").write_text("rule,kind,columns,value,where\na,not_null,k,,\na,not_null,n,,\n")
    with pytest.raises(ValueError, match="one name"):
        read_rules(spark, str(tmp_path / "twice.csv"))
    (tmp_path / "bad.csv").write_text("rule,kind\na,not_null\n")
    with pytest.raises(MissingColumnError):
        read_rules(spark, str(tmp_path / "bad.csv"))


def test_rejects_are_counted_in_the_job_that_writes_them(spark, rows, tmp_path):
    rules = [(F.col("k").isNotNull(), "no name"), (F.col("v") >= 0, "bad value"), (F.col("n") > 0, "bad value"), (F.lit(True), "never")]
    sc = spark.sparkContext
    sc.setJobGroup("divide", "rejects")
    got = divide(rows, rules, str(tmp_path / "out"), {"large": F.col("v") > 6, "odd": F.col("n") % 2 == 1})
    jobs = sc.statusTracker().getJobIdsForGroup("divide")
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) == 1
    assert (got.n_rows, got.n_good, got.failed) == (6, 3, True)
    assert got.reasons == {"no name": 2, "bad value": 1, "never": 0} and got.masks == {"large": 3, "odd": 3}
    assert {r.reason: r.n for r in got.counts().collect()} == got.reasons
    told = {r[0]: r[1] for r in got.bad.groupBy("reject_reason").count().collect()}
    assert told == {"no name": 2, "bad value": 1}
    assert got.good.columns == rows.columns and got.good.count() == 3 and got.bad.count() == 3
    none = divide(rows.limit(0), rules, str(tmp_path / "none"))
    assert (none.n_rows, none.n_good, none.failed) == (0, 0, False) and none.good.count() == 0 == none.bad.count()
    fine = divide(rows, [(F.lit(True), "never")], str(tmp_path / "fine"))
    assert fine.good.count() == 6 and fine.bad.count() == 0


@pytest.mark.parametrize("offset", [0.0, 1e8])
def test_metrics_of_merged_moments(spark, offset):
    rng = np.random.default_rng(2)
    n = 500
    y = rng.normal(50, 12, n) + offset
    pdf = pd.DataFrame({"g": rng.integers(0, 9, n), "w": [f"w{i % 3}" for i in range(n)], "y": y, "p": y + rng.normal(1, 5, n)})
    pdf.loc[::50, "p"] = np.nan
    df = spark.createDataFrame([tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in pdf.itertuples(index=False)], "g long, w string, y double, p double")
    fine = error_moments(df, "y", "p", ["g", "w"], centre=float(y.mean()))
    for by in ([], ["w"]):
        got = {tuple(r)[: len(by)]: r for r in metrics_of(merged_moments(merged_moments(fine, ["w", "g"]), by), by).collect()}
        want = {tuple(r)[: len(by)]: r for r in regression_metrics(df, "y", "p", by).collect()}
        assert set(got) == set(want)
        for key, w in want.items():
            assert got[key]["n"] == w["n"]
            assert np.allclose([got[key][c] for c in ("mae", "rmse", "r2", "pearson_r", "bias")], [w[c] for c in ("mae", "rmse", "r2", "pearson_r", "bias")], rtol=1e-7, atol=1e-9)
    whole = merged_moments(fine).first()
    assert whole.n_y == n and np.isclose(whole.c_abs, np.abs(y - y.mean()).sum()) and np.isclose(whole.c_sq, ((y - y.mean()) ** 2).sum())
    assert (whole.y_min, whole.y_max) == (y.min(), y.max())
    alone = metrics_of(merged_moments(error_moments(df.filter("p is null"), "y", "p", ["g"]))).first()
    assert tuple(alone) == (None, None, None, None, None, 0)
