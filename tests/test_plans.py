from pyspark.sql import functions as F

from cohortloom.functions.names import plan_paths
from cohortloom.plans.evaluation import age_labels, evaluate
from cohortloom.plans.workplan import has_failures, manifest, outcome, plan_work


def paths(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "path string")


def test_work_plan(spark):
    names = ["in/a.nii.gz", "in/b.nii.gz", "in/c.nii.gz", "in/d.nii.gz", "in/e.nii.gz"]
    p = {r.path[3]: r for r in plan_paths(paths(spark, *names), "").collect()}
    outputs = [p["b"].processed, p["b"].xfm, p["e"].processed]
    for k in "cd":
        outputs += [p[k].processed, p[k].xfm, p[k].seg, p[k].vol, p[k].qc]
    outputs += [p["d"].mask, "logs/run.nii.gz", "readme.txt"]
    listing = paths(spark, *names, *outputs)
    got = {r.path[3]: r.status for r in plan_work(listing, "").collect()}
    assert got == {"a": "register", "b": "segment", "c": "mask only", "d": "done", "e": "register"}
    assert [r.path for r in plan_work(listing, "", 1, 2).orderBy("path").collect()] == names[2:4]
    assert plan_work(listing, "", 3, 2).count() == 0


def test_outcome(spark):
    df = spark.createDataFrame([("seg", "ok"), ("seg", "failed"), ("seg", "ok")], "stage string, status string")
    assert {(r.stage, r.status): r.n for r in outcome(df).collect()} == {("seg", "ok"): 2, ("seg", "failed"): 1}
    assert has_failures(df) and not has_failures(df.filter("status = 'ok'"))


def test_manifest(spark):
    listing = paths(spark, "x/b.nii.gz", "x/a.nii.gz", "x/c.nii.gz")
    got = [tuple(r) for r in manifest(listing, 2, "sub/").orderBy("index").collect()]
    assert got == [(1, "a.nii.gz", "x/a.nii.gz", "sub/a.nii.gz"), (2, "b.nii.gz", "x/b.nii.gz", "sub/b.nii.gz")]


def test_labels_and_evaluation(spark):
    images = paths(
        spark,
        "p/sub-1_ses-wave1_x.nii.gz",
        "p/sub-1_ses-wave2_x.nii.gz",
        "p/sub-2_ses-wave1_x.nii.gz",
        "p/sub-3_ses-wave1_x.nii.gz",
        "p/other.nii.gz",
    )
    people = spark.createDataFrame(
        [("sub-1", "30.5", "N/a", None), ("sub-3", "20", "21", "22")],
        "participant_id string, AgeMRI_W1 string, AgeMRI_W2 string, AgeMRI_W3 string",
    )
    labels, skipped = age_labels(images, people)
    assert {r.pat_id: r.label for r in labels.collect()} == {"sub-1_ses-wave1_x": 366.0, "sub-3_ses-wave1_x": 240.0}
    assert {r.pat_id: r.reason for r in skipped.collect()} == {
        "sub-1_ses-wave2_x": "AgeMRI_W2 missing",
        "sub-2_ses-wave1_x": "sub-2 not in participants.tsv",
        "other": "filename did not match DLBS pattern",
    }
    years, _ = age_labels(images, people, "years")
    assert {r.label for r in years.collect()} == {30.5, 20.0}
    predicted = labels.select("pat_id", (F.col("label") + 12).alias("predicted_value"))
    rows, metrics = evaluate(labels, predicted, settings={"device": "cpu"})
    m = metrics.first()
    assert (m.n, m.mae_months, m.mae_years, m.rmse_years, m.device) == (2, 12.0, 1.0, 1.0, "cpu")
    assert {r.error for r in rows.collect()} == {12.0}
