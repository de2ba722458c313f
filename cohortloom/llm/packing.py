"""Best-fit packing into sequences of several permitted lengths.

Pieces go, longest first, into the open bin that they leave fullest, whatever its size. A piece that fits none
opens the size of least cost per token: a bin costs its length and a fixed amount, and is expected to be
filled to ``FILL`` beyond the piece. At the end every bin shrinks to the smallest permitted length that holds
its contents. Documents longer than the largest length are cut into pieces of that length and a rest.

Pieces are dealt to shards of about ``SHARD_TOKENS`` tokens by a hash, each packed by one task, so the work
per task stays the same at any size; only the last few bins of a shard could be fuller with its neighbours'.
Only lengths move; texts are joined to their bins afterwards.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.shared import NO_ID, key_of, text_of, words_of

LENGTHS = (512, 1024, 2048, 4096)
BIN_COST = 64
FILL = 0.95
SHARD_TOKENS = 8_000_000


def opened(size: int, lengths: tuple[int, ...], bin_cost: float = BIN_COST, fill: float = FILL) -> int:
    """The length to open for a piece: least cost per token that it is expected to hold; the shorter of equals."""
    fitting = [c for c in lengths if c >= size]
    return min(fitting, key=lambda c: ((c + bin_cost) / (size + fill * (c - size)), c))


def best_fit(sizes: list[int], lengths: tuple[int, ...], bin_cost: float = BIN_COST, fill: float = FILL) -> tuple[list[int], list[int], list[int]]:
    """Bin of each piece, its offset there, and the final length of each bin. Pieces come longest first."""
    lengths = tuple(sorted(lengths))
    rooms: list[int] = []  # rooms that some open bin has, in order
    with_room: dict[int, list[int]] = {}
    length_of, used, bins, offsets = [], [], [], []
    for size in sizes:
        i = bisect_left(rooms, size)
        if i < len(rooms):
            room = rooms[i]
            number = with_room[room].pop()
            if not with_room[room]:
                del with_room[room]
                rooms.pop(i)
        else:
            room, number = opened(size, lengths, bin_cost, fill), len(used)
            length_of.append(room)
            used.append(0)
        bins.append(number)
        offsets.append(used[number])
        used[number] += size
        left = room - size
        if left:
            if left not in with_room:
                with_room[left] = []
                insort(rooms, left)
            with_room[left].append(number)
    return bins, offsets, [lengths[bisect_left(lengths, u)] for u in used]


def pieces(docs: DataFrame, longest: int, text: str, doc_id: str) -> DataFrame:
    """``id, version, piece, start, size`` of every piece; a document without words has none."""
    body = text_of(text)
    sized = docs.select(key_of(doc_id).alias("id"), F.xxhash64(body).alias("version"), F.size(words_of(body)).alias("n"))
    numbers = F.expr(f"filter(sequence(0, cast((n - 1) div {longest} as int)), p -> p * {longest} < n)")
    cut = sized.select("id", "version", "n", F.explode(numbers).alias("piece"))
    start = F.col("piece") * F.lit(longest)
    return cut.select("id", "version", "piece", start.cast("int").alias("start"), F.least(F.lit(longest), F.col("n") - start).cast("int").alias("size"))


def pack(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, text: str = "text", doc_id: str = "doc_id", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """A row for each piece: ``doc_id, piece, start, size, bin_id, offset, capacity``; sizes in words.

    Rows without words give none. Repeated rows are packed each. Which of equal pieces goes where is settled
    by (size, id, version, piece), so results do not depend on the partitioning. ``version`` is a hash of the text.
    """
    longest = max(lengths)
    cut = pieces(docs, longest, text, doc_id)
    total = cut.agg(F.sum("size")).first()[0] or 0
    shards = int(total // shard_tokens) + 1
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("id", "version", "piece"), F.lit(shards)))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        size = table["size"].to_numpy()
        by = np.lexsort((table["piece"].to_numpy(), table["version"].to_numpy(), table["id"].to_numpy(), -size))
        bins, offsets, final = best_fit(size[by].tolist(), lengths)
        out = table.select(["id", "version", "piece", "start", "size"]).take(pa.array(by))
        number = key[0].as_py() * 2**32 + np.array(bins, np.int64)
        capacity = np.array(final, np.int32)[np.array(bins, np.int64)]
        for name, column in (("bin_id", number), ("offset", np.array(offsets, np.int32)), ("capacity", capacity)):
            out = out.append_column(name, pa.array(column))
        return out

    schema = "id long, version long, piece int, start int, size int, bin_id long, offset int, capacity int"
    packed = dealt.groupBy("shard").applyInArrow(run, schema)
    return packed.withColumn("doc_id", F.nullif("id", F.lit(NO_ID))).drop("id")


def sequences(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A row for each bin: ``bin_id, capacity, n_tokens, doc_ids, starts, sizes, text``; pieces by offset, a line each."""
    packed = pack(docs, lengths, text, doc_id)
    texts = docs.select(key_of(doc_id).alias("id"), F.xxhash64(text_of(text)).alias("version"), text_of(text).alias("body"))
    placed = packed.withColumn("id", F.coalesce("doc_id", F.lit(NO_ID)))
    joined = placed.join(texts.dropDuplicates(["id", "version"]), ["id", "version"])
    words = F.slice(words_of(F.col("body")), F.col("start") + 1, F.col("size"))
    piece = F.struct("offset", "doc_id", "start", "size", F.array_join(words, " ").alias("body")).alias("piece")
    held = joined.select("bin_id", "capacity", piece).groupBy("bin_id", "capacity")
    held = held.agg(F.array_sort(F.collect_list("piece")).alias("p"))
    return held.select(
        "bin_id",
        "capacity",
        F.aggregate("p.size", F.lit(0), lambda a, x: a + x).cast("long").alias("n_tokens"),
        F.col("p.doc_id").alias("doc_ids"),
        F.col("p.start").alias("starts"),
        F.col("p.size").alias("sizes"),
        F.array_join("p.body", "\n").alias("text"),
    )
