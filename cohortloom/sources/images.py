"""Image files read by ranges, as a data source and for tables of paths.

``spark.read.format("image_files").load(root)`` plans the files below a folder into tasks of bounded size and
yields a row for each: path, size, MD5 digest and header. A file is streamed in pieces; the header is taken from
the first ones and the digest runs along, so no file is ever one value, whatever its size, and a task holds one
piece. Without digests nothing but the first bytes are read. A file that cannot be read is a row with a reason.

:func:`describe_files` does the same for any table of paths, a stored list or a stream.
Files are opened through Arrow's file systems, so a root may be a local folder or a URI that these know.
"""

from __future__ import annotations

import fnmatch
import hashlib
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    InputPartition,
    StringStartsWith,
)

from cohortloom.sources.nifti import HEADER_SCHEMA, HEADER_TYPES, HeaderBytes, header_columns

PIECE_BYTES = 4 << 20
HEAD_PIECE = 1 << 14
#: A task reads files until it has this many bytes or files, and at least one file.
TASK_BYTES = 256 << 20
TASK_FILES = 2_000
#: Files whose headers are decoded together.
BATCH_FILES = 256

FILE_SCHEMA = f"path string, size bigint, md5 string, read_error string, {HEADER_SCHEMA}"
FILE_TYPES = {"path": pa.string(), "size": pa.int64(), "md5": pa.string(), "read_error": pa.string(), **HEADER_TYPES}


def open_root(root: str) -> tuple[arrow_fs.FileSystem, str]:
    """File system and folder of a local path or URI."""
    scheme, colon, rest = root.partition(":")
    if not colon or "/" in scheme:
        return arrow_fs.LocalFileSystem(), root.rstrip("/") or "/"
    if scheme == "file":
        return arrow_fs.LocalFileSystem(), "/" + rest.strip("/")
    system, folder = arrow_fs.FileSystem.from_uri(root)
    return system, folder.rstrip("/")


def described(system: arrow_fs.FileSystem, path: str, digest: bool = True, piece_bytes: int = PIECE_BYTES):
    """``payload, size, md5, error`` of one file: pieces are read one after the other, none is kept.

    What fails later than the header costs the digest, not the header.
    """
    head, running, size, wanted = HeaderBytes(), hashlib.md5(), 0, HEAD_PIECE
    broken = None
    try:
        with system.open_input_stream(path, compression=None) as stream:
            while piece := stream.read(wanted):
                size += len(piece)
                if digest:
                    running.update(piece)
                if not head.complete and broken is None:
                    try:
                        head.feed(piece)
                    except zlib.error as error:
                        broken = str(error)
                if not digest and (head.complete or broken):
                    break
                wanted = piece_bytes
    except OSError as error:
        reason = "cannot be read" if not isinstance(error, FileNotFoundError) else "no such file"
        return head.payload(), None, None, None if head.complete else reason
    return (b"" if broken else head.payload()), size if digest else None, running.hexdigest() if digest else None, broken


def describe(system, folder: str, files: Sequence[tuple[str, int | None]], digest: bool, piece_bytes: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``FILE_SCHEMA`` for files given as (path below the folder, size if it is known)."""
    for i in range(0, len(files), BATCH_FILES):
        some = files[i : i + BATCH_FILES]
        got = [described(system, f"{folder}/{path}", digest, piece_bytes) for path, _ in some]
        header = header_columns([payload for payload, *_ in got])
        errors = [error for *_, error in got]
        sizes = [size if size is not None else known for (_, size, _, _), (_, known) in zip(got, some)]
        lead = [[p for p, _ in some], sizes, [md5 for _, _, md5, _ in got], errors]
        columns = [pa.array(v, kind) for v, kind in zip(lead, list(FILE_TYPES.values())[:4])]
        yield pa.RecordBatch.from_arrays(columns + header, list(FILE_TYPES))


class ImagePartition(InputPartition):
    """Neighbouring files, as (path, size)."""

    def __init__(self, files: list[tuple[str, int]]):
        super().__init__(files)


def planned(files: Iterator[tuple[str, int]], task_bytes: int, task_files: int) -> Iterator[list[tuple[str, int]]]:
    """Files in order, cut where a task would get too many bytes or files; a large file stands alone."""
    some, total = [], 0
    for path, size in files:
        if some and (total + size > task_bytes or len(some) >= task_files):
            yield some
            some, total = [], 0
        some.append((path, size))
        total += size
    if some:
        yield some


class ImageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options.get("path") or ""
        self.glob = options.get("pathglobfilter", "*.nii*")
        self.drop = options.get("drop", "bidsignore")
        self.largest = int(options.get("maxlength", 0)) or None
        self.digest = options.get("digest", "true").lower() == "true"
        self.piece_bytes = int(options.get("piecebytes", PIECE_BYTES))
        self.task_bytes = int(options.get("taskbytes", TASK_BYTES))
        self.task_files = int(options.get("taskfiles", TASK_FILES))
        self.prefix, self.only = "", None
        if not self.root:
            raise ValueError("image_files needs a folder to load")

    def pushFilters(self, filters):
        """A prefix of the path, or one path, is looked for in the listing: other files are not opened."""
        for f in filters:
            if isinstance(f, StringStartsWith) and f.attribute == ("path",) and not self.prefix:
                self.prefix = f.value
            elif isinstance(f, EqualTo) and f.attribute == ("path",) and self.only is None:
                self.only = f.value
            else:
                yield f

    def listed(self) -> list[tuple[str, int]]:
        system, folder = open_root(self.root)
        found = []
        for info in system.get_file_info(arrow_fs.FileSelector(folder, recursive=True)):
            path, name = info.path[len(folder) :].lstrip("/"), info.base_name
            if info.type == arrow_fs.FileType.Directory or not fnmatch.fnmatchcase(name, self.glob):
                continue
            if name.startswith(".") or (self.drop and self.drop in path) or not path.startswith(self.prefix):
                continue
            if self.only is None or path == self.only:
                found.append((path, info.size or 0))
        return sorted(found, key=lambda f: f[0].split("/"))

    def partitions(self) -> list[ImagePartition]:
        kept = (f for f in self.listed() if not self.largest or f[1] <= self.largest)
        return [ImagePartition(some) for some in planned(kept, self.task_bytes, self.task_files)]

    def read(self, partition: ImagePartition):
        system, folder = open_root(self.root)
        yield from describe(system, folder, partition.value if partition else [], self.digest, self.piece_bytes)


class ImageFiles(DataSource):
    """Options: ``pathGlobFilter``, ``drop`` (paths that hold it are left out), ``digest``, ``maxLength`` (larger
    files are left out), ``pieceBytes``, ``taskBytes``, ``taskFiles``. Hidden names are left out."""

    @classmethod
    def name(cls) -> str:
        return "image_files"

    def schema(self) -> str:
        return FILE_SCHEMA

    def reader(self, schema) -> ImageReader:
        return ImageReader({k.lower(): v for k, v in self.options.items()})


def read_images(spark: SparkSession, root: str, **options) -> DataFrame:
    """The files below ``root`` as rows of ``FILE_SCHEMA``; the driver lists them as it does for other sources."""
    spark.dataSource.register(ImageFiles)
    # a pushed prefix keeps other files closed
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("image_files").options(**{k: str(v) for k, v in options.items()}).load(root)


def describe_files(
    listing: DataFrame, root: str, path: str = "path", size: str | None = None, digest: bool = True, piece_bytes: int = PIECE_BYTES
) -> DataFrame:
    """Rows of ``FILE_SCHEMA`` for a table or stream of paths below ``root``; a null path is an unreadable file.

    ``size`` names a column with known sizes, which stand in where a file is not read to its end.
    """
    known = F.col(size).cast("long") if size else F.lit(None).cast("long")

    def run(batches):
        system, folder = open_root(root)
        for batch in batches:
            files = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            yield from describe(system, folder, files, digest, piece_bytes)

    return listing.select(F.col(path).alias("path"), known.alias("size")).mapInArrow(run, FILE_SCHEMA)


def write_files(files: DataFrame, root: str, path: str = "path", content: str = "content") -> int:
    """Write each row's bytes to its path below ``root`` and return how many files there are.

    A repeated attempt writes the same bytes again. Rows with a null content write nothing.
    """

    def run(batches):
        system, folder = open_root(root)
        for batch in batches:
            # contents are written out of the batch, none becomes a Python value
            for name, data in zip(batch.column(0), batch.column(1)):
                target = f"{folder}/{name.as_py()}"
                system.create_dir(target.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(target, compression=None) as out:
                    out.write(data.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    rows = files.select(F.col(path), F.col(content)).where(F.col(path).isNotNull() & F.col(content).isNotNull())
    return rows.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
