import pytest
from pyspark.sql import functions as F

from cohortloom.operators.quality import DuplicateKeyError
from cohortloom.operators.reshape import assemble, long_to_wide, normalize_by_reference, union_all, wide_to_long
from cohortloom.plans.regional import feature_rows, load_scans, long_features, ridge_baseline, wave_ages
from cohortloom.sources.sinks import write_report
from cohortloom.sources.tables import read_regional

TAIL = "_space-MNI_desc-preproc_T1w_desc-synthseg"
SCANS = {
    # participant, wave: (regions, qc scores)
    ("sub-1", "wave1"): ({"total intracranial": 100, "left": 10, "right": 20}, [0.9, 0.7]),
    ("sub-1", "wave2"): ({"total intracranial": 0, "left": 11, "right": 21}, [0.65]),
    ("sub-2", "wave1"): ({"total intracranial": 50, "left": 5}, None),
    ("sub-3", "wave1"): ({"left": 5, "right": 6}, None),  # without the total
    ("sub-4", "wave1"): ({"total intracranial": 60, "left": 6}, [0.1]),  # below the gate
    ("sub-5", "wave1"): ({"total intracranial": 70, "left": 7, "right": 9}, None),  # unknown subject
    ("sub-2", "wave3"): ({"total intracranial": 70, "left": 7, "right": 9}, None),  # no age
}


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("seg")
    for (sub, wave), (regions, qc) in SCANS.items():
        stem = f"{sub}_ses-{wave}_run-1{TAIL}"
        lines = [f"{k}\t{v}" for k, v in regions.items()]
        (root / f"{stem}_volumes.tsv").write_text("region\tvolume_mm3\n" + "\n".join(lines) + "\n")
        if qc:
            (root / f"{stem}_qc.tsv").write_text("region\tqc_score\n" + "\n".join(f"r\t{q}" for q in qc) + "\n")
    (root / "other_volumes.tsv").write_text("region\tvolume_mm3\nleft\t1\n")
    people = spark.createDataFrame(
        [("sub-1", "30", "34", None), ("sub-2", "40", None, None), ("sub-3", "50", None, None), ("sub-4", "60", "n/a", None)],
        "participant_id string, AgeMRI_W1 string, AgeMRI_W2 string, AgeMRI_W3 string",
    )
    volumes = read_regional(spark, f"{root}/*_volumes.tsv")
    qc = read_regional(spark, f"{root}/*_qc.tsv", "qc_score", None)
    return volumes, wave_ages(people), qc


def test_scans_are_filtered_before_regions_are_completed(inputs):
    volumes, ages, qc = inputs
    got = load_scans(volumes, ages, qc, 0.65)
    scans = {r.pat_id: (r.age, r.qc_min) for r in got.select("pat_id", "age", "qc_min").distinct().collect()}
    assert scans == {
        "sub-1_ses-wave1_run-1_T1w": (30.0, 0.7),
        "sub-1_ses-wave2_run-1_T1w": (34.0, 0.65),
        "sub-2_ses-wave1_run-1_T1w": (40.0, None),
    }
    assert {r.region for r in got.collect()} == {"total intracranial", "left"}
    # without sub-2 the right side is complete again
    some = load_scans(volumes.filter("name not like 'sub-2%'"), ages, qc, 0.65)
    assert {r.region for r in some.collect()} == {"total intracranial", "left", "right"}
    strict = load_scans(volumes, ages, qc, 0.65, null_qc_passes=False)
    assert strict.filter("participant_id = 'sub-2'").count() == 0
    assert load_scans(volumes, ages).filter("participant_id = 'sub-4'").count() > 0


def test_two_files_with_one_identifier_are_an_error(inputs):
    volumes, ages, _ = inputs
    renamed = volumes.withColumns({"name": F.replace("name", F.lit("MNI"), F.lit("T1")), "path": F.concat("path", F.lit("2"))})
    with pytest.raises(DuplicateKeyError):
        load_scans(volumes.union(renamed.select(volumes.columns)), ages)


def test_ratio_to_the_reference(inputs):
    volumes, ages, qc = inputs
    long = long_features(load_scans(volumes, ages, qc, 0.65))
    got = {(r.pat_id[:16], r.feature): r.value for r in long.collect()}
    assert got == {
        ("sub-1_ses-wave1_", "left / TIV"): 0.1,
        ("sub-1_ses-wave2_", "left / TIV"): None,  # a total of zero
        ("sub-2_ses-wave1_", "left / TIV"): 0.1,
    }
    raw = feature_rows(load_scans(volumes, ages, qc, 0.65), "raw").orderBy("pat_id").first()
    assert raw.features == [10.0, 100.0]
    with pytest.raises(ValueError):
        long_features(load_scans(volumes, ages), "other")


def test_baseline_report(spark, tmp_path):
    n = 60
    rows = spark.range(n).select(
        F.format_string("r%03d", "id").alias("pat_id"),
        F.format_string("s%d", F.col("id") % 12).alias("participant_id"),
        F.format_string("wave%d", F.col("id") % 3 + 1).alias("wave"),
        (F.col("id") * 1.0 + F.hash("id") % 5).alias("age"),
        F.array(F.col("id").cast("double"), (F.col("id") % 7).cast("double")).alias("features"),
    )
    got = ridge_baseline(rows, ["a", "b"], alphas=(0.1, 10.0), settings={"feature_set": "raw"})
    r = got.report.first()
    assert (r.data.n_scans, r.data.n_subjects, r.data.n_features) == (n, 12, 2)
    assert r.settings.folds == 5 and r.settings.feature_set == "raw" and r.final_refit_alpha in (0.1, 10.0)
    assert [w.wave for w in r.by_wave] == ["wave1", "wave2", "wave3"] and sum(w.n for w in r.by_wave) == n
    assert [f.fold for f in r.per_fold] == [1, 2, 3, 4, 5]
    assert r.group_cv.mae < r.mean_age_baseline.mae and abs(r.mean_age_baseline.r2) < 1e-9
    write_report(got.report, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).first().mean_age_baseline.pearson_r is None


def test_reshapes(spark):
    long = spark.createDataFrame([("s", "a", 1.0), ("s", "b", 4.0), ("t", "b", 2.0)], "k string, c string, v double")
    wide = long_to_wide(long, ["k"], "c", "v", ["a", "b"]).orderBy("k").collect()
    assert [tuple(r) for r in wide] == [("s", 1.0, 4.0), ("t", None, 2.0)]
    with pytest.raises(DuplicateKeyError):
        long_to_wide(long.union(long), ["k"], "c", "v", ["a", "b"])
    later = long_to_wide(long, ["k"], "c", "v", ["a", "b"], check="later").orderBy("k")
    assert later.columns == ["k", "a", "b"] and [tuple(r) for r in later.collect()] == [("s", 1.0, 4.0), ("t", None, 2.0)]
    with pytest.raises(Exception, match="c a repeats for"):
        long_to_wide(long.union(long), ["k"], "c", "v", ["a", "b"], check="later").collect()
    with pytest.raises(ValueError):
        long_to_wide(long, ["k"], "c", "v", ["a"], check="never")
    ratios = normalize_by_reference(long, ["k"], "c", "v", "b").collect()
    assert [(r.k, r.c, r.ratio) for r in ratios] == [("s", "a", 0.25)]
    assert {r.k: r.f for r in assemble(long, ["k"], "c", "v", "f").collect()} == {"s": [1.0, 4.0], "t": [2.0]}
    back = wide_to_long(long_to_wide(long, ["k"], "c", "v", ["a", "b"]), ["k"], {"A": "a", "B": "b"}, "c", "v")
    assert {tuple(r) for r in back.collect()} == {("s", "A", 1.0), ("s", "B", 4.0), ("t", "B", 2.0)}
    both = union_all([long.select("k"), long.select("v", "k")])
    assert both.columns == ["k", "v"] and both.count() == 6
