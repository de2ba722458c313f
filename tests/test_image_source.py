"""The image source: pieces, plans, pushed prefixes, files that cannot be read, headers in batches."""

import gzip
import hashlib
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_files import nifti, put

from cohortloom.catalog.scans import _zipped
from cohortloom.plans.indexing import index_images
from cohortloom.sources.files import file_digests
from cohortloom.sources.images import ImageReader, described, describe_files, open_root, planned, read_images, write_files
from cohortloom.sources.nifti import HeaderBytes, decode_headers

BODY = nifti() + bytes(range(256)) * 40


@pytest.fixture
def folder(tmp_path):
    files = {
        "d1/sub-1/anat/sub-1_T1w.nii": BODY,
        "d1/sub-1/anat/sub-1_T2w.nii.gz": gzip.compress(BODY),
        "d1/sub-2/anat/sub-2_T1w.nii": BODY[:100],
        "d1/sub-3/anat/sub-3_T1w.nii.gz": gzip.compress(BODY)[:400] + b"#" * 5000,
        "d2/sub-1/anat/sub-1_T1w.nii": b"",
        "d2/sub 1+x%/anat/sub-1_é.nii": nifti(version=2, order=">"),
        "d10/sub-1/anat/sub-1_T1w.nii.gz": gzip.compress(b"") + gzip.compress(BODY[:300]) + gzip.compress(BODY[300:]),
    }
    for name, data in files.items():
        put(tmp_path / "root" / name, data)
    put(tmp_path / "root/d1/.hidden.nii", BODY)
    put(tmp_path / "root/d1/bidsignore/a.nii", BODY)
    put(tmp_path / "root/d1/a.txt", "a")
    (tmp_path / "root/d1/folder.nii").mkdir()
    return str(tmp_path / "root"), files


@pytest.mark.parametrize("piece", [1, 7, 4096, 4 << 20])
def test_any_piece_gives_the_same_rows(spark, folder, piece):
    root, files = folder
    rows = {r.path: r for r in read_images(spark, root, pieceBytes=piece, taskFiles=2).collect()}
    assert {p: (r["size"], r.md5) for p, r in rows.items()} == {p: (len(b), hashlib.md5(b).hexdigest()) for p, b in files.items()}
    good = {p for p, r in rows.items() if r.header_error is None}
    assert good == set(files) - {"d1/sub-2/anat/sub-2_T1w.nii", "d2/sub-1/anat/sub-1_T1w.nii"} - {p for p, r in rows.items() if r.read_error}
    assert all(rows[p]["shape"] == [4, 5, 6] and rows[p].orient == "LAS" for p in good)


def test_tasks_are_bounded(folder):
    root, files = folder
    total = [("a", 5), ("b", 5), ("c", 100), ("d", 1), ("e", 1), ("f", 1)]
    assert [[p for p, _ in some] for some in planned(iter(total), 10, 2)] == [["a", "b"], ["c"], ["d", "e"], ["f"]]
    assert list(planned(iter([]), 10, 2)) == []
    reader = ImageReader({"path": root, "taskfiles": "3"})
    assert [len(p.value) for p in reader.partitions()] == [3, 3, 1]
    assert [f[0] for p in reader.partitions() for f in p.value] == sorted(files, key=lambda p: p.split("/"))


def test_a_pushed_prefix_keeps_other_files_closed(spark, folder):
    root, files = folder
    images = read_images(spark, root)
    some = images.where(F.col("path").startswith("d1/"))
    assert {r.path for r in some.collect()} == {p for p in files if p.startswith("d1/")}
    one = images.where(F.col("path") == "d2/sub 1+x%/anat/sub-1_é.nii")
    assert [r.orient for r in one.collect()] == ["LAS"]
    both = some.where(F.col("path") == "d10/sub-1/anat/sub-1_T1w.nii.gz")
    assert both.count() == 0
    from pyspark.sql.datasource import EqualTo, StringStartsWith

    reader = ImageReader({"path": root})
    asked = [StringStartsWith(("path",), "d1/"), EqualTo(("md5",), "x"), StringStartsWith(("path",), "d1/sub-1")]
    assert list(reader.pushFilters(asked)) == asked[1:]
    assert len(reader.listed()) == 4


def test_only_the_first_bytes_without_digest(spark, tmp_path):
    large = tmp_path / "d/sub-1/anat/sub-1_T1w.nii"
    put(large, BODY)
    os.truncate(large, 3 << 30)  # more than one value can hold
    row = read_images(spark, str(tmp_path), digest="false").first()
    assert (row["size"], row.md5, row["shape"]) == (3 << 30, None, [4, 5, 6])
    assert read_images(spark, str(tmp_path), maxLength=1 << 30).count() == 0

    class Counting:
        def __init__(self, system):
            self.system, self.asked = system, []

        def open_input_stream(self, path, compression=None):
            stream, asked = self.system.open_input_stream(path, compression=compression), self.asked

            class Stream:
                __enter__ = lambda me: me
                __exit__ = lambda me, *a: stream.close()

                def read(me, n):
                    asked.append(n)
                    return stream.read(n)

            return Stream()

    system, folder = open_root(f"file://{tmp_path}")
    counting = Counting(system)
    payload, size, md5, error = described(counting, f"{folder}/d/sub-1/anat/sub-1_T1w.nii", digest=False)
    assert (payload, size, md5, error) == (BODY[:540], None, None, None) and sum(counting.asked) <= 1 << 14


def test_files_that_cannot_be_read_are_rows(spark, folder):
    root, files = folder
    os.symlink("/nowhere", f"{root}/d1/sub-1/anat/sub-1_gone.nii")  # a link to nothing is no file
    names = [*files, "d1/sub-9/anat/sub-9_T1w.nii", None]
    listing = spark.createDataFrame([(n, 5) for n in names], "path string, n long")
    got = {r.path: (r["size"], r.md5, r.read_error) for r in describe_files(listing, root, size="n").collect()}
    assert got["d1/sub-9/anat/sub-9_T1w.nii"] == (5, None, "no such file") and got[None][1:] == (None, "no such file")
    assert got["d1/sub-1/anat/sub-1_T1w.nii"] == (len(BODY), hashlib.md5(BODY).hexdigest(), None)
    good, bad = index_images(spark, root)
    reasons = {r.path: r.reject_reason for r in bad.collect()}
    assert reasons["d1/sub-2/anat/sub-2_T1w.nii"] == "not a NIfTI header"
    assert good.count() + len(reasons) == len(files)
    listed, lost = index_images(spark, root, listing=listing.where("path like 'd1/sub-1/%' or path like '%sub-9%'"))
    assert listed.count() == 2 and [r.reject_reason for r in lost.collect()] == ["no such file"]
    digests = {r.path: r.md5 for r in file_digests(spark, root, listing.select("path").union(listing.select("path"))).collect()}
    assert digests["d1/sub-9/anat/sub-9_T1w.nii"] is None and digests["d2/sub-1/anat/sub-1_T1w.nii"] == hashlib.md5(b"").hexdigest()


def test_broken_zip_keeps_its_digest(spark, tmp_path):
    raw = gzip.compress(os.urandom(5000))
    raw = raw[:30] + b"\xff" * 40 + raw[70:]
    put(tmp_path / "d/sub-1/anat/sub-1_T1w.nii.gz", raw)
    row = read_images(spark, str(tmp_path)).first()
    assert row.md5 == hashlib.md5(raw).hexdigest() and row["size"] == len(raw)
    _, bad = index_images(spark, str(tmp_path))
    assert bad.first().reject_reason


def test_empty_folder_and_missing_option(spark, tmp_path):
    assert read_images(spark, str(tmp_path)).count() == 0
    assert index_images(spark, str(tmp_path))[0].count() == 0
    with pytest.raises(ValueError):
        ImageReader({})


def test_written_files(spark, tmp_path):
    rows = [("a/b.nii", bytearray(b"1")), ("a/é c.nii", bytearray(b"")), (None, bytearray(b"x")), ("n", None)]
    files = spark.createDataFrame(rows, "path string, content binary")
    assert write_files(files, f"file://{tmp_path}/out") == 2
    assert write_files(files, f"{tmp_path}/out") == 2
    assert {str(p.relative_to(tmp_path / "out")): p.read_bytes() for p in (tmp_path / "out").rglob("*.nii")} == {"a/b.nii": b"1", "a/é c.nii": b""}


def test_headers_of_a_batch_are_those_of_each():
    heads = [
        nifti(), nifti(order=">"), nifti(version=2), nifti(version=2, order=">", qform=True), nifti(qform=True), b"", nifti()[:300],
        nifti(code=9999), nifti((1,) * 7, (1.0,) * 7), nifti(affine=((0, 0, 2), (-1.5, 0, 0), (0, 1, 0))), nifti((7, 8), (2.145, 3.005), 16),
        nifti(affine=((float("nan"), 0, 0), (0, 1, 0), (0, 0, 1))), nifti(affine=((0, 0, 0),) * 3), bytes(540), nifti(version=2)[:500],
    ]
    together = decode_headers(heads)
    singly = [decode_headers([h]) for h in heads]
    assert repr(together) == repr({name: [one[name][0] for one in singly] for name in together})
    errors = together["header_error"]
    assert [e for e in errors if e] == [
        "not a NIfTI header", "not a NIfTI header", "unknown data type code 9999", "orientation is not finite", "not a NIfTI header", "not a NIfTI header"
    ]
    assert together["orient"][9] == "PSR" and together["pixdim"][10] == [round(float(v), 2) for v in (2.1449999809265137, 3.005000114440918)]
    assert decode_headers([]) == {name: [] for name in together}


def test_header_in_single_bytes():
    for raw in (BODY, gzip.compress(BODY), gzip.compress(b"") * 3 + gzip.compress(BODY), gzip.compress(BODY[:10]) + gzip.compress(BODY[10:])):
        head = HeaderBytes()
        for i in range(len(raw)):
            head.feed(raw[i : i + 1])
        assert head.payload() == BODY[:540] and head.complete
    head = HeaderBytes()
    head.feed(b"\x1f")
    assert head.payload() == b"\x1f" and not head.complete


def test_files_are_made_in_small_batches():
    n = 1_000
    whole = pa.RecordBatch.from_pydict({"doc_id": list(range(n)), "path": [f"{i}.nii{'.gz' * (i % 2)}" for i in range(n)], "content": [b"x" * i for i in range(n)]})
    parts = list(_zipped(iter([whole])))
    assert max(p.num_rows for p in parts) <= 256 and sum(p.num_rows for p in parts) == n
    back = [gzip.decompress(c) if p.endswith(".gz") else c for part in parts for p, c in zip(part["path"].to_pylist(), part["content"].to_pylist())]
    assert back == whole["content"].to_pylist()
