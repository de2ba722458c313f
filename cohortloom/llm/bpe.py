"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the last bytes decides at which word boundaries a text is cut; chunks therefore
depend on nearby content only, recur within and across documents, and each is encoded once per task. Chunk
joins are then repaired: where the encoding of two chunks together differs from the two encodings in a
row, the chunks are joined and encoded anew, and the joined chunk is tested against its own neighbours,
until all joins agree. What happens at a join depends only on the characters beside it, so a verdict is
kept for each pair of them.

Encoding is per row, so Spark only splits the scan: nothing is shuffled, a lost task is read again, and
skew does not arise. A task holds a batch of documents and a bounded table of chunks.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Of 2**HASH_BITS hash values, those up to CUT cut a boundary.
HASH_BITS = 4
CUT = 14
#: Chunks that a task remembers before it starts anew: bounds memory, not what is encoded.
MAX_CHUNKS = 600_000
#: Chunks that the tokenizer gets in one string, and the character that parts them there.
ROW, MARK = 500, "\x01"
#: Bytes of text that are cut at a time; a longer document is a batch of its own.
BATCH_BYTES = 4_000_000

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def cut_here(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which word starts are cut: the rolling hash of the four bytes before them decides."""
    value = np.zeros(len(starts), dtype=np.uint64)
    for back in range(1, 5):
        byte = data[np.maximum(starts - back, 0)].astype(np.uint64)
        value = value * np.uint64(0x9E3779B97F4A7C15) + byte + np.uint64(1)
    return (value * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - HASH_BITS) <= CUT


def last_character(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The bytes of the UTF-8 character before each place, as a number."""
    byte = data[ends - 1].astype(np.uint64)
    code, more = byte, (byte & 0xC0) == 0x80
    for back in (2, 3, 4):
        byte = data[np.maximum(ends - back, 0)].astype(np.uint64)
        code = np.where(more, code | (byte << np.uint64(8 * (back - 1))), code)
        more &= (byte & 0xC0) == 0x80
    return code


def first_character(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The bytes of the UTF-8 character at each place, as a number."""
    lead = data[starts].astype(np.uint64)
    code = lead
    for ahead, least in ((1, 0xC0), (2, 0xE0), (3, 0xF0)):
        byte = data[np.minimum(starts + ahead, len(data) - 1)].astype(np.uint64)
        code = np.where(lead >= least, code | (byte << np.uint64(8 * ahead)), code)
    return code


class ChunkEncoder:
    """Encodes texts by reused chunks; ids and decoded text of a chunk are kept as bytes."""

    def __init__(self, tokenizer, max_chunks: int = MAX_CHUNKS):
        self.tokenizer = tokenizer
        self.max_chunks = max_chunks
        if tokenizer.decoder is not None:
            raise ValueError("only tokenizers without a decoder: decoded text is then tokens with spaces between")
        self.tokens = [(tokenizer.id_to_token(i) or "") + " " for i in range(tokenizer.get_vocab_size())]
        self.mark_ids = tokenizer.encode(MARK, add_special_tokens=False).ids
        self.known: dict[bytes, tuple[bytes, bytes]] = {}
        self.joins: dict[int, bool] = {}

    def remember(self, chunk: bytes, ids: np.ndarray) -> None:
        decoded = "".join([self.tokens[i] for i in ids.tolist()])
        self.known[chunk] = (ids.tobytes(), decoded.encode())

    def fresh(self, chunks: list[bytes]) -> None:
        """Encode chunks that are not known yet, each once: many in a row, with marks between them."""
        mark = MARK.encode()
        plain = [c for c in chunks if mark not in c]
        alone = [c for c in chunks if mark in c]
        rows = [plain[i : i + ROW] for i in range(0, len(plain), ROW)] if len(self.mark_ids) == 1 else []
        alone += [] if rows or not plain else plain
        joined = [(b" " + mark + b" ").join(r).decode() for r in rows]
        for row, encoding in zip(rows, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)):
            ids = np.array(encoding.ids, dtype="<u4")
            marks = np.flatnonzero(ids == self.mark_ids[0])
            if len(marks) != len(row) - 1:
                alone += row
                continue
            for chunk, a, b in zip(row, [0, *(marks + 1).tolist()], [*marks.tolist(), len(ids)]):
                self.remember(chunk, ids[a:b])
        for chunk, encoding in zip(alone, self.tokenizer.encode_batch_fast([c.decode() for c in alone], add_special_tokens=False)):
            self.remember(chunk, np.array(encoding.ids, dtype="<u4"))

    def agrees(self, left: bytes, right: bytes) -> bool:
        """Whether two chunks encode to the same ids together as one after the other."""
        joint = self.tokenizer.encode((left + b" " + right).decode(), add_special_tokens=False).ids
        return np.array(joint, dtype="<u4").tobytes() == self.known[left][0] + self.known[right][0]

    def repaired(self, chunks: list[bytes]) -> list[bytes]:
        """``chunks`` with disagreeing neighbours joined, until every join agrees."""
        out: list[bytes] = []
        for chunk in chunks:
            while out and not self.agrees(out[-1], chunk):
                chunk = out.pop() + b" " + chunk
                if chunk not in self.known:
                    self.fresh([chunk])
            out.append(chunk)
        return out

    def encode(self, texts: list[bytes]) -> list[tuple[bytes, bytes]]:
        """Ids as little-endian 32-bit integers and decoded text of each text."""
        whole = b"\n" + b"\n".join(texts) + b"\n"
        data = np.frombuffer(whole, dtype=np.uint8)
        space = _SPACE[data]
        starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
        ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
        first = 1 + np.cumsum([0] + [len(t) + 1 for t in texts])
        text_of = np.searchsorted(first, starts, "right") - 1
        cut = cut_here(data, starts)
        cut[:1] = True
        cut[1:] |= text_of[1:] != text_of[:-1]
        at = np.flatnonzero(cut)
        starts, ends, text_of = starts[at], ends[np.append(at[1:], len(cut))[: len(at)] - 1], text_of[at]
        chunks = [whole[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        if len(self.known) > self.max_chunks:
            self.known.clear()
        self.fresh([c for c in dict.fromkeys(chunks) if c not in self.known])
        wrong = self.wrong_joins(data, starts, ends, text_of, chunks)
        bounds = np.searchsorted(text_of, np.arange(len(texts) + 1)).tolist()
        coded = [self.known[c] for c in chunks]
        out = []
        for i in range(len(texts)):
            parts = coded[bounds[i] : bounds[i + 1]]
            if i in wrong:
                parts = [self.known[c] for c in self.repaired(chunks[bounds[i] : bounds[i + 1]])]
            out.append((b"".join([p[0] for p in parts]), b"".join([p[1] for p in parts])[:-1]))
        return out

    def wrong_joins(self, data, starts, ends, text_of, chunks) -> set[int]:
        """Texts with a join that does not agree: one join is tried for each new pair of characters."""
        inside = np.flatnonzero(text_of[1:] == text_of[:-1])
        if not len(inside):
            return set()
        pairs = last_character(data, ends[inside]) << np.uint64(32) | first_character(data, starts[inside + 1])
        kinds, where, which = np.unique(pairs, return_index=True, return_inverse=True)
        good = np.ones(len(kinds), dtype=bool)
        for k, kind in enumerate(kinds.tolist()):
            if kind not in self.joins:
                i = inside[where[k]]
                self.joins[kind] = self.agrees(chunks[i], chunks[i + 1])
            good[k] = self.joins[kind]
        return set(text_of[inside[~good[which]]].tolist())


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, tokenizer_path: str, text: str = "text", doc_id: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, digests of ids and decoded text; with_ids adds ``ids`` and ``decoded``.

    The encoding is that of the whole text, the tokenizer's own truncation and padding off and no special
    tokens added. A null or empty text has no tokens; a null doc_id stays null; repeated rows and other
    columns do not matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        encoder = ChunkEncoder(tokenizer)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.binary())
            start = 0
            while start < len(texts):
                stop, size = start, 0
                while stop < len(texts) and (stop == start or size < BATCH_BYTES):
                    size += len(texts[stop].as_buffer() or b"") if texts[stop].is_valid else 0
                    stop += 1
                coded = encoder.encode([t or b"" for t in texts.slice(start, stop - start).to_pylist()])
                columns = [
                    ids.slice(start, stop - start),
                    pa.array([len(i) // 4 for i, _ in coded], pa.int64()),
                    pa.array([hashlib.sha256(i).hexdigest() for i, _ in coded]),
                    pa.array([hashlib.sha256(d).hexdigest() for _, d in coded]),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns += [pa.array([np.frombuffer(i, "<u4").astype("i4") for i, _ in coded], pa.list_(pa.int32())), pa.array([d.decode() for _, d in coded])]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names)
                start = stop

    bare = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return bare.mapInArrow(run, SCHEMA + (", ids array<int>, decoded string" if with_ids else ""))
