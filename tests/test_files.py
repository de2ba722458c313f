import gzip
import hashlib
import json
import struct

import pytest
from pyspark.sql import functions as F

from cohortloom.operators.ordering import order_by_path
from cohortloom.operators.quality import MissingColumnError
from cohortloom.plans.indexing import index_images, update_index
from cohortloom.sources.files import (
    file_digests,
    incremental_index,
    list_or_scan,
    read_exclusions,
    read_list,
    scan_files,
    write_list,
)
from cohortloom.sources.nifti import extract_headers
from cohortloom.sources.sinks import write_csv, write_report
from cohortloom.sources.tables import (
    parent_directory,
    read_delimited,
    read_image_index,
    read_qc_long,
    read_qc_wide,
    read_regional,
    read_sidecars,
    row_map,
    sidecar_entry,
)


def nifti(shape=(4, 5, 6), pix=(1.0, 1.25, 2.004), code=4, affine=((-1, 0, 0), (0, 1, 0), (0, 0, 1)), order="<", version=1, qform=False):
    raw = bytearray(352 if version == 1 else 544)
    dims = [len(shape), *shape] + [1] * (7 - len(shape))
    pixdim = [1.0, *pix] + [0.0] * (7 - len(pix))
    rows = [v for r in affine for v in (*r, 0)]
    if version == 1:
        struct.pack_into(order + "i", raw, 0, 348)
        struct.pack_into(order + "8h", raw, 40, *dims)
        struct.pack_into(order + "h", raw, 70, code)
        struct.pack_into(order + "8f", raw, 76, *pixdim)
        struct.pack_into(order + "2h", raw, 252, int(qform), 0 if qform else 1)
        struct.pack_into(order + "12f", raw, 280, *rows)
    else:
        struct.pack_into(order + "i", raw, 0, 540)
        struct.pack_into(order + "h", raw, 12, code)
        struct.pack_into(order + "8q", raw, 16, *dims)
        struct.pack_into(order + "8d", raw, 104, *pixdim)
        struct.pack_into(order + "2i", raw, 344, int(qform), 0 if qform else 1)
        struct.pack_into(order + "12d", raw, 400, *rows)
    return bytes(raw)


def put(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data if isinstance(data, bytes) else data.encode())


def test_inventory_digest_and_header(spark, tmp_path):
    root = tmp_path / "data"
    files = {
        "ds1/sub-01/anat/sub-01_T1w.nii.gz": gzip.compress(nifti()),
        "ds1/sub-02/anat/sub-02_T1w.nii": nifti((7, 8), (2.0, 3.0), 16),
        "ds2/sub-01/anat/sub-01_T1w.nii.gz": b"broken",
    }
    for name, data in files.items():
        put(root / name, data)
    put(root / "ds1/sub-01/anat/.hidden.nii", b"x")
    put(root / "ds1/bidsignore/x_T1w.nii", b"x")
    put(root / "ds1/participants.tsv", "a")
    listing = order_by_path(scan_files(spark, str(root)))
    assert [(r.path, r.size) for r in listing.collect()] == [(k, len(v)) for k, v in sorted(files.items())]

    wanted = listing.select("path").union(spark.createDataFrame([("gone.nii",)], "path string"))
    digests = {r.path: r.md5 for r in file_digests(spark, str(root), wanted).collect()}
    assert digests == {**{k: hashlib.md5(v).hexdigest() for k, v in files.items()}, "gone.nii": None}

    good, rejects = index_images(spark, str(root))
    assert {r.path: r.reject_reason for r in rejects.collect()} == {sorted(files)[2]: "not a NIfTI header"}
    got = {r.path: r for r in good.collect()}
    a, b = (got[k] for k in sorted(files)[:2])
    assert (a.dataset, a["sub"], a.ses, a.suffix, a["size"]) == ("ds1", "01", None, "T1w", len(files[a.path]))
    assert good.columns[-8:] == ["suffix", "shape", "pixdim", "dtype", "orient", "size", "md5", "path"]
    assert (a["shape"], a.pixdim, a.dtype, a.orient) == ([4, 5, 6], [1.0, 1.25, 2.0], "int16", "LAS")
    assert (b["shape"], b.pixdim, b.dtype) == ([7, 8], [2.0, 3.0], "float32")
    assert a.md5 == hashlib.md5(files[sorted(files)[0]]).hexdigest()


def test_scan_is_that_of_spark_in_few_tasks(spark, tmp_path):
    names = [f"ds{i % 3}/sub-{i:03d}/anat/sub-{i:03d}_T1w.nii" for i in range(600)]
    odd = ["a.nii", "_x/b.nii", "_k=1/c.nii", "ds0/.h/d.nii", "ds0/_e.nii", "ds0/f g%20é.nii.gz", "ds0/g.txt", "ds0/bidsignore/h.nii", "i.nii._COPYING_", "_metadata.nii", "_metadata_k/j.nii"]
    for name in names + odd:
        put(tmp_path / "in" / name, name)
    put(tmp_path / "in/ds0/empty.nii", "")
    (tmp_path / "in/ds1/sub-none").mkdir()
    root = str(tmp_path / "in")
    for glob in ("*.nii*", "*.{nii,txt}", "[a-f]*.nii?gz"):
        plain = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
        want = {(r.path.split("/in/", 1)[1], r.length) for r in plain.select("path", "length").collect()}
        want = {(p, n) for p, n in want if not p.rsplit("/", 1)[-1].startswith(".") and "bidsignore" not in p}
        for given in (root, f"file://{root}/"):
            assert {tuple(r) for r in scan_files(spark, given, glob).collect()} == want
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("scan", "tasks of a scan")
    scan_files(spark, root).count()
    stages = {s for j in tracker.getJobIdsForGroup("scan") for s in tracker.getJobInfo(j).stageIds}
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sum(i.numTasks for i in map(tracker.getStageInfo, stages) if i) < 300


def test_header_variants(spark):
    cases = {
        "big": (nifti(order=">"), "LAS"),
        "v2": (nifti(version=2), "LAS"),
        "qform": (nifti(qform=True), "RAS"),
        "turned": (nifti(affine=((0, 0, 2), (-1.5, 0, 0), (0, 1, 0))), "PSR"),
        "oblique": (nifti(affine=((0.8, -0.6, 0), (0.6, 0.8, 0), (0, 0, -3))), "RAI"),
    }
    rows = spark.createDataFrame([(k, bytearray(v[0])) for k, v in cases.items()], "id string, content binary")
    got = {r.id: r for r in extract_headers(rows).collect()}
    assert {k: r.orient for k, r in got.items()} == {k: v[1] for k, v in cases.items()}
    assert all(r.header_error is None and r["shape"] == [4, 5, 6] for r in got.values())
    bad = spark.createDataFrame([("a", bytearray(nifti(code=9999))), ("b", None)], "id string, content binary")
    assert all(r.header_error for r in extract_headers(bad).collect())


def test_stored_list_wins(spark, tmp_path):
    put(tmp_path / "data/a.nii", nifti())
    stored = str(tmp_path / "list")
    assert [r.path for r in list_or_scan(spark, str(tmp_path / "data"), stored).collect()] == ["a.nii"]
    put(tmp_path / "data/b.nii", nifti())
    assert list_or_scan(spark, str(tmp_path / "data"), stored).count() == 1
    write_list(spark.createDataFrame([("x/y",)], "path string"), str(tmp_path / "other"))
    assert read_list(spark, str(tmp_path / "other")).first().path == "x/y"


def test_second_incremental_run_adds_nothing(spark):
    listing = spark.createDataFrame([("a",), ("b",)], "path string")
    done = spark.createDataFrame([("a", 1)], "path string, n int")
    new = incremental_index(listing, done)
    assert [r.path for r in new.collect()] == ["b"]
    assert incremental_index(listing, done.select("path").union(new)).count() == 0


def test_exclusions_skip_comments(spark, tmp_path):
    put(tmp_path / "e.yaml", "# why\n- ds1\n- ds2  # empty\n\n# - ds3\n")
    assert {r.dataset for r in read_exclusions(spark, str(tmp_path / "e.yaml")).collect()} == {"ds1", "ds2"}


def test_headers_differ_and_fields_may_be_quoted(spark, tmp_path):
    put(tmp_path / "d1/t.tsv", 'a\tb\tc\n1\t"x\ty"\t"say ""hi"""\n\n2\t\tz\r\n')
    put(tmp_path / "d2/t.tsv", "﻿c\ta\nq\t9\nr\n")
    rows = read_delimited(spark, str(tmp_path / "*/t.tsv"))
    got = rows.orderBy("file", "block", "line").select(row_map(F.col("header"), F.col("fields")).alias("m"))
    assert [r.m for r in got.collect()] == [
        {"a": "1", "b": "x\ty", "c": 'say "hi"'},
        {"a": "2", "b": "", "c": "z"},
        {"c": "q", "a": "9"},
        {"c": "r", "a": None},
    ]


def test_large_files_are_split_and_keep_their_order(spark, tmp_path):
    lines = ["id\tv"] + [f"{i}\tid" for i in range(20000)]
    put(tmp_path / "d/t.tsv", "\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = read_delimited(spark, str(tmp_path / "d/t.tsv"))
        assert rows.select("block").distinct().count() > 3
        got = rows.orderBy("block", "line").select(F.get("fields", F.lit(0)).cast("int").alias("i"))
        assert [r.i for r in got.collect()] == list(range(20000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_sidecars(spark, tmp_path):
    put(tmp_path / "d1/participants.json", json.dumps({"AGE": {"Units": "Months"}, "age": {"Units": "weeks"}}))
    put(tmp_path / "d2/participants.json", "[1, 2]")
    put(tmp_path / "d3/participants.json", "{broken")
    rows = read_sidecars(spark, str(tmp_path / "*/participants.json"))
    got = {r.dataset: r.v for r in rows.select("dataset", sidecar_entry(F.col("descriptions"), F.lit("age")).alias("v")).collect()}
    assert got["d2"] is None and got["d3"] is None and "weeks" in got["d1"]


def test_regional_tables_by_column_name(spark, tmp_path):
    put(tmp_path / "s1_volumes.tsv", "region\tvolume_mm3\nleft\t10.5\nright\tn/a\n")
    put(tmp_path / "s2_volumes.tsv", "volume_mm3\tregion\n7\tleft\n")
    rows = read_regional(spark, str(tmp_path / "*_volumes.tsv"))
    assert sorted((r.name, r.region, r.volume_mm3) for r in rows.collect()) == [
        ("s1_volumes.tsv", "left", 10.5),
        ("s1_volumes.tsv", "right", None),
        ("s2_volumes.tsv", "left", 7.0),
    ]


def test_score_tables_align_by_name(spark, tmp_path):
    put(tmp_path / "a/1_qc.csv", "subject,x\ns1,0.5\n")
    put(tmp_path / "a/2_qc.csv", "y,subject\n0.9,s2\n")
    dirs = [str(tmp_path / "a")]
    wide = {r.subject: (r.x, r.y) for r in read_qc_wide(spark, dirs).collect()}
    assert wide == {"s1": (0.5, None), "s2": (None, 0.9)}
    long = {(r.directory, r.subject, r.score, r.value) for r in read_qc_long(spark, dirs).collect()}
    assert long == {("a", "s1", "x", 0.5), ("a", "s2", "y", 0.9)}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("01", [1, 2], float("nan"))], "sub string, shape array<long>, v double")
    write_csv(df, str(tmp_path / "csv"))
    assert tuple(spark.read.csv(str(tmp_path / "csv"), header=True, escape='"').first())[:2] == ("01", "[1,2]")
    write_report(df, str(tmp_path / "json"))
    text = spark.read.text(str(tmp_path / "json")).first().value
    assert json.loads(text) == {"sub": "01", "shape": [1, 2], "v": None}


def test_stream_indexes_each_file_once(spark, tmp_path):
    root = tmp_path / "data"

    def run():
        index = update_index(spark, str(root), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        return sorted((r.path, r.reject_reason) for r in index.collect())

    first = ("d/sub-1/anat/sub-1_T1w.nii", None)
    put(root / first[0], nifti())
    assert run() == [first]
    assert run() == [first]
    second = ("d/sub-2/anat/sub-2_T2w.nii.gz", None)
    put(root / second[0], gzip.compress(nifti()))
    put(root / "d/sub-2/func/sub-2_bold.nii.gz", gzip.compress(nifti()))
    assert run() == [first, second, ("d/sub-2/func/sub-2_bold.nii.gz", "invalid datatype func")]


def test_image_index_keeps_ids_and_reads_lists(spark, tmp_path):
    text = (
        "dataset,sub,run,suffix,shape,pixdim,dtype,orient,size,md5,path\n"
        'd1,01,,T1w,"[256, 256, 176]","[1.0, 1.0, 1.2]",int16,RAS,9500000,abc,d1/a.nii\n'
        'd1,002,1,T2w,"[256, 256]","[1.0, nan]",int16,RAS,12,,d1/b.nii\n'
    )
    put(tmp_path / "index.csv", text)
    a, b = read_image_index(spark, str(tmp_path / "index.csv")).orderBy("path").collect()
    assert (a["sub"], a.run, a["shape"], a.pixdim, a["size"]) == ("01", None, [256, 256, 176], [1.0, 1.0, 1.2], 9500000)
    assert (b["sub"], b.run, b.pixdim, b.md5) == ("002", "1", None, None)
    put(tmp_path / "other.csv", "a,b\n1,2\n")
    with pytest.raises(MissingColumnError):
        read_image_index(spark, str(tmp_path / "other.csv"))


def test_directories_with_special_characters(spark, tmp_path):
    put(tmp_path / "d 1+x%/t.tsv", "a\n1\n")
    rows = read_delimited(spark, str(tmp_path / "*/t.tsv"))
    assert rows.select(parent_directory(F.col("file")).alias("d")).first().d == "d 1+x%"


def test_nested_nan_is_null_in_reports(spark, tmp_path):
    from cohortloom.sources.sinks import write_report

    rows = spark.sql(
        "select 1 as id, struct(double('NaN') as a, array(double('NaN'), 2.0D) as b) as s, map('k', double('NaN')) as m"
    )
    write_report(rows, str(tmp_path / "report"))
    text = "".join(p.read_text() for p in (tmp_path / "report").glob("part-*"))
    assert "NaN" not in text and '"a":null' in text and '"b":[null,2.0]' in text and '"k":null' in text


def test_bad_list_literals_are_rejected(spark, tmp_path):
    from cohortloom.sources.tables import split_image_index

    lines = ["dataset,sub,suffix,shape,pixdim,size,md5,path"]
    lines += ['d,01,T1w,"[1, 2]","[1.0, 2.0]",5,x,a', "d,02,T1w,oops,[1.0],5,x,b", "d,03,T1w,[1],[1.0],many,x,c", "d,04,T1w,,,,,e"]
    (tmp_path / "index.csv").write_text("\n".join(lines))
    good, bad = split_image_index(spark, str(tmp_path / "index.csv"))
    assert {r.path: r.reject_reason for r in bad.collect()} == {"b": "shape is no list", "c": "size is no number"}
    assert {r.path: (r["sub"], r["shape"], r["size"]) for r in good.collect()} == {"a": ("01", [1, 2], 5), "e": ("04", None, None)}


def test_every_listed_image_is_indexed_or_rejected(spark, tmp_path):
    from cohortloom.plans.indexing import index_images

    root = tmp_path / "bidsignore-root"
    folder = root / "d1" / "sub-01" / "anat"
    folder.mkdir(parents=True)
    (folder / "sub-01_T1w.nii").write_bytes(b"x" * 10)
    (folder / "sub-01_T2w.nii").write_bytes(b"x" * 5000)
    (folder / "sub-01_bidsignore_T1w.nii").write_bytes(b"x")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")
    try:
        good, bad = index_images(spark, str(root))
        reasons = {r.path.rsplit("/", 1)[1]: (r.reject_reason, r["md5"] is None, r["size"]) for r in bad.collect()}
        assert good.count() == 0
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert reasons == {
        "sub-01_T1w.nii": ("not a NIfTI header", False, 10),
        "sub-01_T2w.nii": ("more than 1000 bytes", True, 5000),
    }


def test_header_behind_an_empty_member_and_an_extra_field():
    import gzip
    import zlib

    from cohortloom.sources.nifti import _payload

    body = bytes(range(256)) * 3
    assert _payload(gzip.compress(b"") + gzip.compress(body)) == body[:540]
    plain = gzip.compress(body)
    extra = plain[:3] + bytes([plain[3] | 4]) + plain[4:10] + (60_000).to_bytes(2, "little") + b"\0" * 60_000 + plain[10:]
    assert _payload(extra) == body[:540] == zlib.decompress(extra, wbits=31)[:540]
