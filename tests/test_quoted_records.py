"""Delimited records with quoted line breaks, cut at any place, against pandas and Python's own reader."""

import csv
import io
import random

import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cohortloom.sources.tables import line_ends, read_delimited, read_qc_long, read_qc_wide, read_records, read_regional, row_map, split_fields


def read(spark, path, sep, split=None):
    if split:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        rows = read_delimited(spark, path, sep)
        n = rows.select("block").distinct().count()
        got = [r.fields for r in rows.orderBy("file", "block", "line").collect()]
        return got, n
    finally:
        if split:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")


def field(rng):
    return "".join(rng.choice(["a", "bc", "\n", '"', ",", "\t", " ", "é", "\n\n", '""']) for _ in range(rng.randint(0, 12)))


@pytest.mark.parametrize("sep", [",", "\t"])
def test_equal_at_any_number_of_splits(spark, tmp_path, sep):
    rng = random.Random(11)
    rows = [[str(i), field(rng), field(rng)] for i in range(900)] + [["900", 'x" y', "\n" * 300 + '"' * 40 + "\n"]]
    text = io.StringIO()
    csv.writer(text, delimiter=sep, lineterminator="\n").writerows([["id", "b\nb", "c"], *rows])
    body = text.getvalue().encode()
    (tmp_path / "t.csv").write_bytes(body)
    for parts in (1, 4, 17):
        got, n = read(spark, str(tmp_path / "t.csv"), sep, -(-len(body) // parts))
        assert got == rows
        assert n >= parts * 3 // 4
    frame = pd.read_csv(tmp_path / "t.csv", sep=sep, dtype=str, keep_default_na=False)
    assert frame.values.tolist() == rows and list(frame.columns) == ["id", "b\nb", "c"]


def test_quotes_within_fields_are_text(spark, tmp_path):
    body = 'a,b\n5" disk,x"\n"in"side,"q""r"s"t\n"x\n\n",y"\n,""\n"",\n'
    (tmp_path / "t.csv").write_text(body)
    want = pd.read_csv(tmp_path / "t.csv", dtype=str, keep_default_na=False).values.tolist()
    assert want[0] == ['5" disk', 'x"'] and want[1] == ["inside", 'q"rs"t']
    assert read(spark, str(tmp_path / "t.csv"), ",", 9)[0] == want


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
def test_line_ends(spark, tmp_path, end):
    body = f'a,b{end}1,"x{end}{end}y"{end}{end}2,z{end}"3","{end}"'
    (tmp_path / "t.csv").write_bytes(body.encode())
    want = [["1", f"x{end}{end}y"], ["2", "z"], ["3", end]]
    assert read(spark, str(tmp_path / "t.csv"), ",", 9)[0] == want


def test_only_broken_files_are_joined_and_an_open_end_is_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,v\n1,"p\nq"\n')
    (tmp_path / "b.csv").write_text("k,v\n\n2,r\n")
    got = read_delimited(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], ",")
    assert sorted(r.fields for r in got.collect()) == [["1", "p\nq"], ["2", "r"]]
    (tmp_path / "c.csv").write_text('k,v\n1,"p\nq\n')
    with pytest.raises(PySparkException, match="a quoted field is not closed in .*c.csv"):
        read_delimited(spark, str(tmp_path / "*.csv"), ",").collect()
    (tmp_path / "d").mkdir()
    (tmp_path / "d/e.csv").write_text("")
    assert read_records(spark, str(tmp_path / "d/e.csv"), ",").count() == 0


def test_long_fields(spark, tmp_path):
    long = ('"x\n' * 30_000) + "y" * 200_000
    quoted = long.replace('"', '""')
    (tmp_path / "t.csv").write_text(f'k,v\n1,"{quoted}"\n2,"{"z" * 300_000}",""\n')
    got, _ = read(spark, str(tmp_path / "t.csv"), ",", 20_000)
    assert got == [["1", long], ["2", "z" * 300_000, ""]]


def test_ends_of_single_lines(spark):
    cases = {
        "a,b": (0, 1), 'a,"b': (1, 1), '"': (1, 0), '"a"': (0, 1), 'a"b': (0, 0), '""': (0, 1), '"""': (1, 0), 'x","': (0, 1), "": (0, 1),
        'x",y': (0, 0), 'x""': (0, 1), 'x"",': (0, 1), '"a"b"c,"': (1, 1),
    }
    lines = spark.createDataFrame([(k,) for k in cases], "t string")
    out, into = line_ends(F.col("t"), ",")

    def state(text, inside):
        """One character at a time."""
        begin = not inside
        i = 0
        while i < len(text):
            c = text[i]
            if inside:
                if c == '"' and text[i + 1 : i + 2] == '"':
                    i += 1
                elif c == '"':
                    inside = False
            elif c == '"' and begin:
                inside = True
            begin = not inside and c == ","
            i += 1
        return int(inside)

    rng = random.Random(5)
    more = ["".join(rng.choice('a",') for _ in range(rng.randint(0, 9))) for _ in range(400)]
    for r in lines.union(spark.createDataFrame([(m,) for m in more], "t string")).select("t", out.alias("o"), into.alias("i")).collect():
        assert (r.o, r.i) == (state(r.t, False), state(r.t, True)), r.t
    assert [r.f for r in lines.limit(1).select(split_fields(F.lit('a,"b,c"d,'), ",").alias("f")).collect()] == [["a", "b,cd", ""]]


def test_readers_of_tables_take_such_files(spark, tmp_path):
    (tmp_path / "s1_volumes.tsv").write_text('region\tvolume_mm3\n"left\n(a\tb)"\t10.5\nright\t2\n')
    rows = read_regional(spark, str(tmp_path / "*_volumes.tsv"))
    assert sorted((r.region, r.volume_mm3) for r in rows.collect()) == [("left\n(a\tb)", 10.5), ("right", 2.0)]
    (tmp_path / "a").mkdir()
    (tmp_path / "a/1_qc.csv").write_text('subject,"mean\nscore"\n"s\n1",0.5\n')
    long = [(r.subject, r.score, r.value) for r in read_qc_long(spark, [str(tmp_path / "a")]).collect()]
    assert long == [("s\n1", "mean\nscore", 0.5)]
    m = read_delimited(spark, str(tmp_path / "a/1_qc.csv"), ",").select(row_map(F.col("header"), F.col("fields")).alias("m")).first().m
    assert m == {"subject": "s\n1", "mean\nscore": "0.5"}


def test_records_are_not_dealt_by_file(spark, tmp_path):
    body = "id,t\n" + "".join(f'{i},"a\nb {i}"\n' for i in range(3_000))
    (tmp_path / "t.csv").write_text(body)
    rows = read_delimited(spark, str(tmp_path / "t.csv"), ",")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "SortAggregate" not in plan and "hashpartitioning" not in plan
    assert rows.count() == 3_000


@pytest.mark.parametrize("read_qc", [read_qc_long, read_qc_wide])
def test_headers_are_found_without_sorting_rows(spark, tmp_path, monkeypatch, read_qc):
    for d, head, row in (("a", "subject,x", "{0},1"), ("b", "y,subject,x", "{0}.5,{0},NaN")):
        (tmp_path / d).mkdir()
        for f in range(3):
            body = "\n".join([head, *[row.format(i) for i in range(f * 500, f * 500 + 500)]])
            (tmp_path / d / f"{f}_qc.csv").write_text(body)
    plans = []

    def keep(kind, name, frame):
        method = getattr(kind, name)

        def kept(self, *args, **options):
            plans.append(frame(self)._jdf.queryExecution().executedPlan().toString())
            return method(self, *args, **options)

        monkeypatch.setattr(kind, name, kept)

    df = spark.range(0)
    keep(type(df), "collect", lambda self: self)
    keep(type(df.write), "parquet", lambda self: self._df)
    got = read_qc(spark, [str(tmp_path / "a"), str(tmp_path / "b")]).collect()
    assert len(plans) > 3 and not [p for p in plans if "SortAggregate" in p or "SortMergeJoin" in p]
    if read_qc is read_qc_wide:
        want = {("a", str(i), 1.0, None) for i in range(1500)} | {("b", str(i), None, i + 0.5) for i in range(1500)}
        assert len(got) == 3000 and {(r.directory, r.subject, r.x, r.y) for r in got} == want
    else:
        want = {("a", str(i), "x", 1.0) for i in range(1500)} | {("b", str(i), "x", None) for i in range(1500)}
        want |= {("b", str(i), "y", i + 0.5) for i in range(1500)}
        assert len(got) == 4500 and {(r.directory, r.subject, r.score, r.value) for r in got} == want
