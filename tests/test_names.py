from pyspark.sql import functions as F

from cohortloom.config import DOWNLOAD_RULES, OUTPUT_DIRECTORIES, VOLUME_NAME_PATTERN
from cohortloom.functions.names import capture, parse_entities, path_rules, plan_paths, promote
from cohortloom.operators.filters import outside_directories, visible_images
from cohortloom.operators.ordering import order_by_path
from cohortloom.operators.quality import split_valid


def paths(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "path string")


def parsed(spark, path):
    row = promote(parse_entities(paths(spark, path)), ["sub", "ses", "acq", "run"]).first()
    return row


def test_plain_name(spark):
    r = parsed(spark, "ds1/sub-01/anat/sub-01_T1w.nii.gz")
    assert (r.dataset, r.sub, r.suffix, r.reject_reason) == ("ds1", "01", "T1w", None)


def test_all_entities(spark):
    r = parsed(spark, "ds1/sub-01/ses-a/anat/sub-01_ses-a_acq-x_T2w.nii")
    assert (r.ses, r.acq, r.suffix) == ("a", "x", "T2w")


def test_name_is_cut_at_the_first_dot(spark):
    assert parsed(spark, "ds1/sub-01/anat/sub-01_acq-1.5mm_T1w.nii.gz").suffix == "acq-1"


def test_item_without_dash_is_ignored(spark):
    r = parsed(spark, "ds1/sub-01/anat/sub-01_extra_T1w.nii.gz")
    assert r.reject_reason is None and dict(r.entities) == {"sub": "01"}


def test_repeated_key_keeps_the_last(spark):
    assert parsed(spark, "ds1/sub-01/anat/sub-01_run-1_run-2_T1w.nii.gz").run == "2"


def test_rejects_keep_their_reason(spark):
    bad = {
        "ds1/sub-01/func/sub-01_T1w.nii.gz": "invalid datatype func",
        "ds1/sub-01/anat/sub-01_acq-a-b_T1w.nii.gz": "entity with more than one dash",
        "ds1/sub-01/anat/image.nii.gz": "name without a suffix",
        "ds1/sub-01/anat/sub-01_T1w": "name without an extension",
        "lonely.nii.gz": "path without a directory",
    }
    good, rejects = split_valid(parse_entities(paths(spark, *bad, "d/anat/sub-1_T1w.nii")))
    assert {r.path: r.reject_reason for r in rejects.collect()} == bad
    assert good.count() == 1


def test_paths_sort_by_component(spark):
    rows = order_by_path(paths(spark, "a-b", "a/b", "a"))
    assert [r.path for r in rows.collect()] == ["a", "a/b", "a-b"]


def test_last_path_rule_wins(spark):
    kept = paths(
        spark,
        "a/sub-1_T1w.nii.gz",
        "a/participants.tsv",
        "a/derivatives/x_T1w.nii.gz",
        "a/x_desc-preproc_T1w.nii.gz",
        "a/readme.txt",
    ).filter(path_rules(F.col("path"), DOWNLOAD_RULES))
    assert {r.path for r in kept.collect()} == {"a/sub-1_T1w.nii.gz", "a/participants.tsv"}


def test_capture_needs_a_full_match(spark):
    tail = "_space-MNI_desc-preproc_T1w_desc-synthseg_volumes.tsv"
    rows = capture(
        paths(spark, f"sub-1_ses-wave2_run-1_acq-x{tail}", f"x_sub-1_ses-wave2_r{tail}", "other.tsv"),
        "path",
        VOLUME_NAME_PATTERN,
        ["participant", "wave", "scan"],
    ).collect()
    assert tuple(rows[0])[1:] == ("sub-1", "wave2", "run-1_acq-x")
    assert [r.participant for r in rows[1:]] == [None, None]


def test_output_paths_for_a_relative_root(spark):
    r = plan_paths(paths(spark, "images/sub-1_T1w.nii.gz"), "").first()
    assert r.processed == "processed/sub-1_T1w_space-MNI152NLin2009cAsym_desc-processed.nii.gz"
    assert r.qc == "derivatives/synthseg/sub-1_T1w_qc.csv"


def test_directory_and_visibility_filters(spark):
    rows = paths(spark, "logs/a.nii.gz", "logs2/a.nii.gz", "x/.h.nii", "bidsignore/a.nii", "x/a.nii")
    path = F.col("path")
    kept = rows.filter(outside_directories(path, OUTPUT_DIRECTORIES) & visible_images(path))
    assert {r.path for r in kept.collect()} == {"logs2/a.nii.gz", "x/a.nii"}
