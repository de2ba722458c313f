import pytest
from pyspark.sql import functions as F

from cohortloom.functions.people import normalize_age, normalize_sex, strip_prefix
from cohortloom.plans.participants import first_session, harmonize_files

FILES = {
    "d1/participants.tsv": "participant_id\tAge\tGender\nsub-01\t30.456\tm\nsub-02\tn/a\tMale \nsub-03\t-1\tWOMAN\n\t5\tf\nsub-04\t0\t0\n",
    "d2/participants.tsv": "participant_id\tsession\tsession_id\tage\tsex\nsub-01\tses-b\tx\t20\tf\nsub-01\tses-b\tx\t25\tf\nsub-01\tses-a\tx\t21\tf\n",
    "d3/participants.tsv": "subject\tage\n1\t5\n",
    "d4/participants.tsv": "participant_id\tsex\nsub-1\tF\n",
    "ds000144/participants.tsv": "participant_id\tScanAge\tage\nsub-1\t9\t99\n",
    "ds005027/participants.tsv": "participant_id\tage\nsub-1\t9\n",
    "d5/participants.tsv": "participant_id\tage\nsub-1\t30.13\nsub-2\t1200\n",
    "d5/participants.json": '{"Age": {"Description": "age in MONTHS"}}',
    "d6/participants.tsv": "participant_id\tage\nsub-1\t40\nsub-1\t44\n",
    "ds006169/participants.tsv": "participant_id\tage\nsub-1\t24\n",
    "out/participants.tsv": "participant_id\tage\nsub-1\t40\n",
    "ds004856/participants.tsv": "participant_id\tSex\tAgeMRI_W1\tAgeMRI_W2\tAgeMRI_W3\nsub-9\tm\t50\tn/a\t58.5\nsub-8\tf\t-2\t\t\n",
}


@pytest.fixture(scope="module")
def result(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("people")
    for name, text in FILES.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_text(text)
    excluded = spark.createDataFrame([("out",)], "dataset string")
    return harmonize_files(spark, f"{root}/*/participants.tsv", f"{root}/*/participants.json", excluded)


def rows(result, dataset):
    return {(r.sub, r.ses): (r.sex, r.age) for r in result.table.filter(F.col("dataset") == dataset).collect()}


def test_headers_and_values(result):
    assert rows(result, "d1") == {
        ("01", None): ("M", 30.46),
        ("02", None): ("M", None),
        ("03", None): ("F", None),
        ("04", None): (None, None),
    }
    assert rows(result, "d4") == {("1", None): ("F", None)}


def test_first_duplicate_is_kept_and_reported(result):
    assert rows(result, "d2") == {("01", "b"): ("F", 20.0), ("01", "a"): ("F", 21.0)}
    assert rows(result, "d6") == {("1", None): (None, 40.0)}
    conflicts = {(r.dataset, r.sub, r.ses): r.range for r in result.conflicts.collect()}
    assert conflicts == {("d2", "01", "b"): 5.0, ("d6", "1", None): 4.0}


def test_overrides_units_and_rejects(result):
    assert rows(result, "ds000144") == {("1", None): (None, 9.0)}
    assert rows(result, "d5") == {("1", None): (None, 30.13 / 12), ("2", None): (None, 100.0)}
    assert rows(result, "ds006169") == {("1", None): (None, 2.0)}
    assert {(r.dataset, r.reject_reason) for r in result.rejects.collect()} == {
        ("d3", "no participant_id column"),
        ("ds005027", "no column ScanAge"),
    }
    assert rows(result, "out") == {} and rows(result, "d3") == {}
    assert {(r.dataset, r.largest) for r in result.large_ages.collect()} == {("d5", 100.0)}


def test_longitudinal_loader_keeps_waves_and_negative_ages(result):
    assert rows(result, "ds004856") == {
        ("9", "wave1"): ("M", 50.0),
        ("9", "wave3"): ("M", 58.5),
        ("8", "wave1"): ("F", -2.0),
    }


def test_first_session_labels_every_image(result):
    got = {(r.dataset, r["sub"]): r.age for r in first_session(result.table).collect()}
    assert got[("d2", "01")] == 20.0 and got[("ds004856", "9")] == 50.0


AGES = {
    "n/a": None, "89+": None, "-1": -1.0, "1_0": None, "1d": None, "1f": None, "NaN": None, " 7 ": 7.0,
    "1e1": 10.0, ".5": 0.5, "5.": 5.0, "+3": 3.0, "abc": None, "": None, "0.125": 0.12, "2.678": 2.68, "inf": float("inf"),
}


def test_age_texts(spark):
    df = spark.createDataFrame([(k,) for k in AGES], "t string")
    assert {r.t: r.a for r in df.select("t", normalize_age(F.col("t")).alias("a")).collect()} == AGES


def test_sex_texts_and_prefixes(spark):
    df = spark.createDataFrame([("m",), ("Male ",), ("\tWOMAN",), ("0",), (None,), ("sub-sub-1",)], "t string")
    assert [r.s for r in df.select(normalize_sex(F.col("t")).alias("s")).collect()] == ["M", "M", "F", None, None, None]
    assert df.select(strip_prefix(F.col("t"), "sub-").alias("p")).collect()[-1].p == "sub-1"
