"""NIfTI headers: shape, voxel size, type, orientation.

The layout follows the public NIfTI-1 and NIfTI-2 definitions. Headers are decoded a batch at a time: the
leading bytes of all files form one array, which is viewed as header records.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes that hold the header, compressed or not, where a gzip file has no extra field and no comment;
#: of a file that has one, all bytes are handed on.
LEADING_BYTES = 1 << 14
PAYLOAD = 540

# fixed values: public data-type codes of the format
DTYPE_NAMES = {
    2: "uint8",
    4: "int16",
    8: "int32",
    16: "float32",
    32: "complex64",
    64: "float64",
    128: "void24",
    256: "int8",
    512: "uint16",
    768: "uint32",
    1024: "int64",
    1280: "uint64",
    1536: "float128",
    1792: "complex128",
    2048: "complex256",
    2304: "void32",
}

# fixed values: places of the fields in the two versions of the header
FIELDS = ["size", "dim", "code", "pix", "qform", "sform", "quat", "rows"]
SHAPES = [(), (8,), (), (8,), (), (), (3,), (3, 4)]
VERSIONS = {
    348: (["i4", "i2", "i2", "f4", "i2", "i2", "f4", "f4"], [0, 40, 70, 76, 252, 254, 256, 280]),
    540: (["i4", "i8", "i2", "f8", "i4", "i4", "f8", "f8"], [0, 16, 12, 104, 344, 348, 352, 400]),
}

HEADER_SCHEMA = "shape array<bigint>, pixdim array<double>, dtype string, orient string, header_error string"
HEADER_TYPES = {
    "shape": pa.list_(pa.int64()),
    "pixdim": pa.list_(pa.float64()),
    "dtype": pa.string(),
    "orient": pa.string(),
    "header_error": pa.string(),
}


class HeaderBytes:
    """Collects the leading bytes of a file, piece by piece, until the header is complete.

    A gzip file is unpacked on the way; it may begin with empty members.
    """

    def __init__(self):
        self.data, self.raw, self.member, self.complete = b"", b"", None, False
        self.zipped = None

    def feed(self, piece: bytes) -> None:
        if self.zipped is None:
            self.raw += piece
            if len(self.raw) < 2:
                return
            self.zipped, piece, self.raw = self.raw[:2] == b"\x1f\x8b", self.raw, b""
        if not self.zipped:
            self.data = (self.data + piece)[:PAYLOAD]
        while self.zipped and piece and len(self.data) < PAYLOAD:
            if self.member is None:
                piece = self.raw + piece
                self.raw = b"" if len(piece) > 1 else piece
                if self.raw:
                    break  # the other half of a member's mark is still to come
                if piece[:2] != b"\x1f\x8b":
                    self.complete = True  # nothing but padding follows
                    return
                self.member = zlib.decompressobj(wbits=31)
            self.data += self.member.decompress(piece, PAYLOAD - len(self.data))
            piece = self.member.unused_data if self.member.eof else b""
            if self.member.eof:
                self.member = None
        self.complete = len(self.data) >= PAYLOAD

    def payload(self) -> bytes:
        return self.data or self.raw


def _payload(raw: bytes) -> bytes:
    """The header's bytes out of a file's leading ones."""
    head = HeaderBytes()
    head.feed(raw)
    return head.payload()


def _records(data: np.ndarray, version: int, order: str) -> np.ndarray:
    """The headers seen as records of one version and byte order."""
    kinds, offsets = VERSIONS[version]
    formats = [(order + kind, shape) for kind, shape in zip(kinds, SHAPES)]
    return data.view(np.dtype({"names": FIELDS, "formats": formats, "offsets": offsets, "itemsize": PAYLOAD})).reshape(-1)


def _rotations(quat: np.ndarray) -> np.ndarray:
    b, c, d = quat.T
    a = np.sqrt(np.maximum(0.0, 1.0 - (b * b + c * c + d * d)))
    cells = [
        [a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)],
        [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)],
        [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c],
    ]
    return np.moveaxis(np.array(cells), 2, 0)


def _axis_codes(directions: np.ndarray) -> list[str]:
    """For each file, the letter of the world axis that each voxel axis runs along: R/L, A/P, S/I."""
    scale = np.linalg.norm(directions, axis=1, keepdims=True)
    u, _, vt = np.linalg.svd(directions / np.where(scale == 0, 1.0, scale))
    # nearest orthogonal frame first, so that oblique scans give three different letters
    frame = u @ vt
    size = np.abs(frame)
    each = np.arange(len(frame))
    free = np.ones((len(frame), 3), bool)
    letters = np.full((len(frame), 3), "?")
    for j in np.argsort(-size.max(axis=1), axis=1, kind="stable").T:
        i = np.where(free, size[each, :, j], -1.0).argmax(axis=1)
        free[each, i] = False
        letters[each, j] = np.array(["LR", "PA", "IS"], dtype="U2").view("U1").reshape(3, 2)[i, (frame[each, i, j] > 0).astype(int)]
    return ["".join(row) for row in letters]


def decode_headers(payloads: Sequence[bytes]) -> dict[str, list]:
    """The columns of ``HEADER_SCHEMA`` for a batch of headers; one that cannot be read has only its error."""
    n = len(payloads)
    out = {name: [None] * n for name in HEADER_TYPES}
    out["header_error"] = ["not a NIfTI header"] * n
    sizes = np.array([len(p) for p in payloads], np.int64)
    data = np.frombuffer(b"".join(p[:PAYLOAD].ljust(PAYLOAD, b"\0") for p in payloads), np.uint8).reshape(n, PAYLOAD)
    for version in VERSIONS:
        for order in "<>":
            found = _records(data, version, order) if n else np.zeros(0)
            at = np.flatnonzero((found["size"] == version) & (sizes >= version)) if n else []
            if len(at):
                _decode_records(found[at], at, out)
    return out


def _decode_records(found: np.ndarray, at: np.ndarray, out: dict[str, list]) -> None:
    pix, rows = found["pix"].astype(float), found["rows"].astype(float)
    handed = np.where(pix[:, 0] < 0, -1.0, 1.0)
    turned = _rotations(found["quat"].astype(float)) * np.stack([pix[:, 1], pix[:, 2], pix[:, 3] * handed], axis=1)[:, None, :]
    plain = np.zeros((len(at), 3, 3))
    for k, sign in enumerate((-1, 1, 1)):
        plain[:, k, k] = sign * np.abs(pix[:, k + 1])
    directions = np.where((found["qform"] > 0)[:, None, None], turned, plain)
    directions = np.where((found["sform"] > 0)[:, None, None], rows[:, :, :3], directions)
    finite = np.isfinite(directions).all(axis=(1, 2))
    codes = _axis_codes(np.where(finite[:, None, None], directions, 0.0))
    for k, i in enumerate(at):
        n, code = int(found["dim"][k, 0]), int(found["code"][k])
        if not 1 <= n <= 7:
            out["header_error"][i] = f"invalid number of dimensions {n}"
        elif code not in DTYPE_NAMES:
            out["header_error"][i] = f"unknown data type code {code}"
        elif not finite[k]:
            out["header_error"][i] = "orientation is not finite"
        else:
            out["shape"][i] = found["dim"][k, 1 : n + 1].tolist()
            out["pixdim"][i] = [round(v, 2) for v in pix[k, 1 : n + 1].tolist()]
            out["dtype"][i], out["orient"][i] = DTYPE_NAMES[code], codes[k]
            out["header_error"][i] = None


def header_columns(payloads: Sequence[bytes]) -> list[pa.Array]:
    fields = decode_headers(payloads)
    return [pa.array(fields[name], kind) for name, kind in HEADER_TYPES.items()]


def _unpacked(raw: bytes | None) -> tuple[bytes, str | None]:
    try:
        return _payload(bytes(raw or b"")), None
    except zlib.error as error:
        return b"", str(error)


def extract_headers(df: DataFrame, content: str = "content") -> DataFrame:
    """Replace a content column by header fields; ``header_error`` says why one is unreadable."""
    keep = [f for f in df.schema.fields if f.name != content]
    flags = F.conv(F.hex(F.substring(F.col(content), 4, 1)), 16, 10).cast("int")
    zipped = F.hex(F.substring(F.col(content), 1, 2)) == "1F8B"
    whole = zipped & (flags.bitwiseAND(0x14) != 0)
    lead = F.when(whole, F.col(content)).otherwise(F.substring(F.col(content), 1, LEADING_BYTES))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)
    schema = f"{kept}, {HEADER_SCHEMA}" if kept else HEADER_SCHEMA

    def run(batches):
        for batch in batches:
            heads = [_unpacked(raw) for raw in batch.column(batch.num_columns - 1).to_pylist()]
            columns = header_columns([h for h, _ in heads])
            errors = [e or known for (_, e), known in zip(heads, columns[-1].to_pylist())]
            columns = [batch.column(k) for k in range(batch.num_columns - 1)] + columns[:-1] + [pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in keep] + list(HEADER_TYPES))

    return df.select(*[F.col(f"`{f.name}`") for f in keep], lead.alias("content")).mapInArrow(run, schema)
