import math

from pyspark.sql import functions as F

from cohortloom.config import InclusionLimits
from cohortloom.functions.arrays import axis, field_of_view, parse_list
from cohortloom.functions.missing import normalize_missing
from cohortloom.operators.filters import include_mask, inclusion_terms, qc_gate
from cohortloom.plans.curation import curate, dataset_overview, with_geometry

SHAPE, PIX, MB = [200, 200, 160], [1.0, 1.0, 1.0], 10_000_000
SCHEMA = "id string, shape array<long>, pixdim array<double>, size long"

EDGES = [
    ("plain", SHAPE, PIX, MB, True),
    ("size at low bound", SHAPE, PIX, 1_000_000, True),
    ("size at high bound", SHAPE, PIX, 60_000_000, True),
    ("size below", SHAPE, PIX, 999_999, False),
    ("size above", SHAPE, PIX, 60_000_001, False),
    ("voxel at low bound", [600, 200, 160], [0.3, 1.0, 1.0], MB, True),
    ("voxel below", [600, 200, 160], [0.29, 1.0, 1.0], MB, False),
    ("x at bound", [100, 200, 160], [1.5, 1.0, 1.0], MB, True),
    ("x above", [100, 200, 160], [1.51, 1.0, 1.0], MB, False),
    ("y above", [200, 100, 160], [1.0, 1.51, 1.0], MB, False),
    ("z at bound", [200, 200, 50], [1.0, 1.0, 3.0], MB, True),
    ("z above", [200, 200, 50], [1.0, 1.0, 3.01], MB, False),
    ("fov at low bound", [120, 200, 160], PIX, MB, True),
    ("fov below", [119, 200, 160], PIX, MB, False),
    ("fov at high bound", [260, 200, 160], PIX, MB, True),
    ("fov above", [261, 200, 160], PIX, MB, False),
    ("2-D", [200, 200], [1.0, 1.0], MB, False),
    ("4-D", [200, 200, 160, 3], [1.0, 1.0, 1.0, 2.0], MB, False),
    ("NaN voxel", SHAPE, [math.nan, 1.0, 1.0], MB, False),
    ("no shape", None, PIX, MB, False),
]


def test_inclusion_mask_at_every_bound(spark):
    rows = spark.createDataFrame([e[:4] for e in EDGES], SCHEMA)
    got = {r.id: r.ok for r in rows.select("id", include_mask().alias("ok")).collect()}
    assert got == {e[0]: e[4] for e in EDGES}


def test_nine_terms():
    assert len(inclusion_terms(InclusionLimits())) == 9


def test_field_of_view_stops_at_the_shorter_array(spark):
    rows = spark.createDataFrame([("a", [10, 20, 30, 40], [1.0, 2.0], 1), ("b", [3, 4, 5, 6], [1.0] * 4, 1)], SCHEMA)
    got = rows.select(field_of_view(F.col("shape"), F.col("pixdim")).alias("f")).collect()
    assert [r.f for r in got] == [[10.0, 40.0], [3.0, 4.0, 5.0]]
    assert rows.select(axis(F.col("pixdim"), 2).alias("z")).first().z is None
    assert with_geometry(rows).first().vol == 400.0


def test_list_literals(spark):
    rows = spark.createDataFrame([("[1.0, 2.5]",), ("[1.0, nan]",), ("x",)], "t string")
    assert [r.v for r in rows.select(parse_list(F.col("t")).alias("v")).collect()] == [[1.0, 2.5], None, None]


def test_missing_values_become_null(spark):
    rows = spark.createDataFrame([("n/a", math.nan), ("ok", 1.0), ("", None)], "t string, v double")
    assert [tuple(r) for r in normalize_missing(rows).collect()] == [(None, None), ("ok", 1.0), (None, None)]


def test_null_and_nan_scores_pass_the_gate(spark):
    rows = spark.createDataFrame([(0.64,), (0.65,), (None,), (math.nan,)], "s double")
    assert [r.k for r in rows.select(qc_gate(F.col("s"), 0.65).alias("k")).collect()] == [False, True, True, True]
    assert rows.filter(qc_gate(F.col("s"), 0.65, null_passes=False)).count() == 1
    assert rows.filter(qc_gate(F.col("s"), None)).count() == 4


def image(path, dataset="d1", sub="01", suffix="T1w", size=MB, md5="m", shape=SHAPE):
    return (dataset, sub, suffix, shape, PIX, size, md5, path)


def test_curation_order(spark):
    images = spark.createDataFrame(
        [
            image("d1/a", size=100, md5="x"),  # masked copy sorts first but must not shadow the next
            image("d1/b", md5="x"),
            image("d1/c", md5="x", sub="02"),  # later copy
            image("d1/d", md5=None, sub="03"),
            image("d1/e", md5=None, sub="04"),  # missing digests count as one
            image("d2/f", "d2", md5="z"),  # excluded dataset
            image("d1/g", md5="q", suffix="bold"),  # other suffix
            image("d1/h", md5="r", sub=None, suffix="T2w"),
        ],
        "dataset string, sub string, suffix string, shape array<long>, pixdim array<double>, size long, md5 string, path string",
    )
    people = spark.createDataFrame(
        [("d1", "01", "M", 30.0), ("d1", "03", None, 40.0), ("d2", "01", "F", 9.0)],
        "dataset string, sub string, sex string, age double",
    )
    listed = spark.createDataFrame([("d2",)], "dataset string")
    cohort = curate(images, people, listed)
    assert {r.path for r in cohort.images.collect()} == {"d1/b", "d1/d", "d1/h"}
    joined = {r.path: (r.matched, r.age) for r in cohort.joined.collect()}
    assert joined == {"d1/b": (True, 30.0), "d1/d": (True, 40.0), "d1/h": (False, None)}
    c = cohort.counts.first()
    assert (c.n_datasets, c.n_subjects, c.n_images, c.n_T1w, c.n_T2w, c.n_FLAIR) == (1, 2, 3, 2, 1, 0)
    assert c.n_T1w + c.n_T2w + c.n_FLAIR == c.n_images
    o = dataset_overview(cohort.joined).first()
    assert (o.n_images, o.n_subs, o.im_per_sub) == (3, 2, 1.5) and abs(o.frac_labeled - 2 / 3) < 1e-12
