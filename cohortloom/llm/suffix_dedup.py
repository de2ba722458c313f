"""Suffix-array dedup: removes bytes of strings of ``LENGTH`` bytes that also start earlier.

Per shard, Larsson-Sadakane refinement in numpy builds a suffix array, Kasai's order of work the common
prefixes, and runs of prefixes of at least ``LENGTH`` bytes are equal strings. What shards have in common is
merged by binary search in sorted runs.

Shards hold what can repeat, and nothing else. A rolling hash of every ``GRAM`` bytes is taken and each string's
least one is its anchor, so equal strings have equal anchors; only stretches whose anchor occurs twice, in other
stretches or as a gram within the stretch, go to a shard, chosen by the anchor, equal stretches once with their earliest place. Documents that repeat an earlier one wholly are set apart first. An anchor
with very many stretches, such as the edge of a passage that countless documents share, is spread over
shards of its own; each finds its first strings, and their digests meet, sorted, in ranges. Every step is
linear in the text, and no task holds more than a shard or a range of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.llm.shared import key_of, store, text_of

LENGTH = 100
GRAM = 64
#: Starts in one stretch, at most.
STRETCH = 64
SHARD_BYTES = 8_000_000
#: Stretches of an anchor in one shard, before it is spread.
SPREAD = 20_000
RANGE_ROWS = 500_000
BATCH_BYTES = 4_000_000


def spanned(h: np.ndarray, wide: int, pick: np.ufunc) -> np.ndarray:
    """The least or greatest of each ``wide`` neighbours."""
    size = 1
    while size * 2 <= wide:
        h = pick(h[:-size], h[size:])
        size *= 2
    rest = wide - size
    return pick(h[: len(h) - rest], h[rest:])


def least_anchors(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each start of ``length`` bytes the least hash of the grams in it, and the hash of each gram."""
    with np.errstate(over="ignore"):
        h = data.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
        factor, size = np.uint64(0x9E3779B97F4A7C15), 1
        while size < gram:
            h = h[:-size] * factor + h[size:]
            h ^= h >> np.uint64(29)
            factor, size = factor * factor, size * 2
        h *= np.uint64(0x94D049BB133111EB)
    return spanned(h, length - gram + 1, np.minimum), h


def near_repeats(h: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second places of grams that are anchors and stand again less than ``STRETCH`` bytes further on.

    Given back by first place, with the least second place from there on.
    """
    wide = len(h) - len(anchor) + 1
    edge = np.zeros(wide - 1, np.uint64)
    places = np.flatnonzero(spanned(np.concatenate([edge, anchor, edge]), wide, np.maximum) == h)
    by = places[np.lexsort((places, h[places]))]
    close = np.flatnonzero((h[by[1:]] == h[by[:-1]]) & (by[1:] - by[:-1] < STRETCH))
    first, second = by[close], by[close + 1]
    order = np.argsort(first)
    return first[order], np.minimum.accumulate(second[order][::-1])[::-1]


def stretches(texts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of starts with one anchor: text number, anchor, first start, number of starts, and whether a gram that
    is an anchor stands twice in the run's bytes, without which no two of its strings are equal."""
    sizes = np.array([len(t) for t in texts], np.int64)
    if sizes.sum() < length:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty, empty
    anchor, h = least_anchors(np.frombuffer(b"".join(texts), np.uint8), length, gram)
    first, second = near_repeats(h, anchor)
    begin = np.cumsum(sizes) - sizes
    number = np.repeat(np.arange(len(texts)), np.maximum(sizes - length + 1, 0))
    within = np.arange(len(number)) - np.repeat(np.cumsum(np.maximum(sizes - length + 1, 0)) - np.maximum(sizes - length + 1, 0), np.maximum(sizes - length + 1, 0))
    anchor = anchor[begin[number] + within]
    new = np.ones(len(number), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (number[1:] != number[:-1])
    head = np.flatnonzero(new)
    far = np.arange(len(number)) - np.repeat(head, np.diff(np.append(head, len(number))))
    head = np.flatnonzero(new | (far % STRETCH == 0))
    count = np.diff(np.append(head, len(number)))
    start = begin[number[head]] + within[head]
    following = np.append(second, len(h))[np.searchsorted(first, start)]
    twice = following < start + count + length - gram
    return number[head], anchor[head].view(np.int64), within[head], count, twice.astype(np.int64)


def suffix_array(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``data`` in the order of their first ``depth`` bytes, or more, and their 8-byte openings.

    Larsson-Sadakane: after each round suffixes are in order to depth ``h``, and only groups that are still
    tied are sorted again, by the ranks ``h`` further on.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(2 * depth + 8, np.uint8)])
    opening = np.zeros(n, np.uint64)
    for i in range(8):
        opening = opening << np.uint64(8) | padded[i : i + n].astype(np.uint64)
    order = np.argsort(opening)
    new = np.ones(n, bool)
    new[1:] = opening[order[1:]] != opening[order[:-1]]
    heads = np.flatnonzero(new)
    rank = np.zeros(n + 2 * depth, np.uint64)  # past the end: before everything
    rank[order] = np.repeat(heads, np.diff(np.append(heads, n))).astype(np.uint64) + np.uint64(1)
    tied = ~(new & np.append(new[1:], True))
    active, h = order[tied], 8
    while h < depth and len(active):
        key = rank[active] << np.uint64(32) | rank[active + h]
        by = np.argsort(key)
        active, key = active[by], key[by]
        old = key >> np.uint64(32)
        group = np.flatnonzero(np.append(True, old[1:] != old[:-1]))
        start = np.repeat(group, np.diff(np.append(group, len(key))))
        place = old.astype(np.int64) - 1 + np.arange(len(key)) - start
        order[place] = active
        new = np.append(True, key[1:] != key[:-1])
        heads = np.flatnonzero(new)
        head = np.repeat(heads, np.diff(np.append(heads, len(key))))
        fresh = old + (head - start).astype(np.uint64)
        rank[active] = fresh
        tied = ~(new & np.append(new[1:], True))
        active, h = active[tied], 2 * h
    return order, opening


def common_prefixes(data: np.ndarray, order: np.ndarray, opening: np.ndarray, begin: np.ndarray, size: np.ndarray, cap: int) -> np.ndarray:
    """For each suffix in order, the prefix it shares with the one before, up to ``cap``.

    Kasai: a suffix shares at most one byte less than the suffix one place earlier in the text did. Pieces of
    the text are walked in step, from ``begin`` over ``size`` places each.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    tail = np.append(data, np.arange(cap + 9) % 2).astype(np.uint8)
    wide = np.append(opening, np.zeros(cap + 9, np.uint64))
    shared = np.zeros(n, np.int64)
    by_size = np.argsort(-size, kind="stable")
    begin, size = begin[by_size], size[by_size]
    length = np.zeros(len(begin), np.int64)
    for step in range(int(size[0]) if len(size) else 0):
        live = int(np.searchsorted(-size, -step, "left"))
        at = begin[:live] + step
        prev = before[at]
        # at the cap, suffixes are tied and the neighbour may be another one: begin anew
        length = np.where(length[:live] >= cap, 0, np.maximum(length[:live] - 1, 0))
        length[prev < 0] = 0
        go = np.flatnonzero(prev >= 0)
        while len(go):
            a, b = at[go] + length[go], prev[go] + length[go]
            same = (wide[a] == wide[b]) & (np.maximum(a, b) + 8 <= n)
            length[go[same]] += 8
            go = go[same]
            go = go[length[go] < cap]
        go = np.flatnonzero((prev >= 0) & (length < cap))
        while len(go):
            a, b = at[go] + length[go], prev[go] + length[go]
            go = go[(tail[a] == tail[b]) & (np.maximum(a, b) < n)]
            length[go] += 1
            go = go[length[go] < cap]
        shared[at] = np.minimum(length, cap)
    return shared[order]


def repeated_starts(parts: list[bytes], ids: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """A flag for each start in ``parts`` (all that leave ``length`` bytes): whether the string starts earlier.

    ``ids`` and ``places`` are the document and place of each part. Flags are in the order of the parts.
    """
    size = np.array([len(p) for p in parts], np.int64)
    data = np.frombuffer(b"".join(parts), np.uint8)
    begin = np.cumsum(size) - size
    order, opening = suffix_array(data, length)
    prefix = common_prefixes(data, order, opening, begin, size, length)
    group = np.empty(len(data), np.int64)
    group[order] = np.cumsum(prefix < length)
    starts = size - length + 1
    number = np.repeat(np.arange(len(parts)), starts)
    offset = np.arange(len(number)) - np.repeat(np.cumsum(starts) - starts, starts)
    group = group[begin[number] + offset]
    doc, at = ids[number], places[number] + offset
    by = np.lexsort((at, doc, group))
    g = group[by]
    head = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
    first = np.repeat(by[head], np.diff(np.append(head, len(g))))
    flags = np.zeros(len(number), bool)
    flags[by] = (doc[by] != doc[first]) | (at[by] != at[first])
    return flags


def runs_of(flags: np.ndarray) -> list[int]:
    """Ends of the runs of set flags: from, upto, from, upto, and so on."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return edge.tolist()


def keyed(docs: DataFrame, text: str, doc_id: str, *more) -> DataFrame:
    """Documents with a ``row`` for id and text: rows that repeat an id with another text are told apart."""
    body = text_of(text).cast("binary")
    return docs.select(key_of(doc_id).alias("id"), F.xxhash64(key_of(doc_id), body).alias("row"), body.alias("text"), *more)


def whole_copies(docs: DataFrame, length: int) -> DataFrame:
    """``row, size`` of documents that repeat an earlier one wholly: all their strings start earlier; stored."""
    sized = docs.select("id", "row", F.octet_length("text").alias("size"), F.md5("text").alias("digest"))
    sized = sized.where(F.col("size") >= length)
    first = sized.groupBy("digest", "size").agg(F.min("id").alias("first"))
    return store(sized.join(first, ["digest", "size"]).where("id > first").select("row", "size").distinct(), "copies")


def of_shared_anchors(found: DataFrame) -> DataFrame:
    """``anchor, n, row, place``: rows of ``found`` whose anchor occurs more than once, or twice within, with its count."""
    # a window: the rows move once, and Spark spills a large group
    counted = found.withColumn("n", F.count("*").over(Window.partitionBy("anchor")))
    return counted.where("n > 1 or (place & 128) > 0").select("anchor", "n", "row", "place")


def shared_stretches(docs: DataFrame, copies: DataFrame, length: int, gram: int) -> DataFrame:
    """``anchor, n, row, place``: stretches whose anchor occurs more than once, whole copies left out.

    ``place`` holds the number of starts in 7 bits, then the flag of ``stretches``, then the first start.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            start = 0
            while start < len(texts):
                stop, total = start + 1, len(texts[start])
                while stop < len(texts) and total < BATCH_BYTES:
                    total += len(texts[stop])
                    stop += 1
                number, anchor, at, count, twice = stretches(texts[start:stop], length, gram)
                number = number + start
                columns = [pa.array(anchor), pa.array(rows[number]), pa.array(at * 256 + twice * 128 + count)]
                yield pa.RecordBatch.from_arrays(columns, ["anchor", "row", "place"])
                start = stop

    found = of_shared_anchors(docs.select("row", "text").mapInArrow(run, "anchor long, row long, place long"))
    # an outer join: an anti join would move below the exchange of all stretches
    flagged = found.drop("n").join(copies.select("row", F.lit(True).alias("copy")), "row", "left")
    return of_shared_anchors(flagged.where("copy is null").select("anchor", "row", "place"))


def cut_out(docs: DataFrame, found: DataFrame, length: int, spread: int) -> DataFrame:
    """``part, key, spread, id, row, at, starts`` of every shared stretch with its bytes; stored."""
    lists = found.groupBy("row").agg(F.collect_list(F.struct("anchor", "n", "place")).alias("places"))
    rows = docs.select("id", "row", "text").join(lists, "row")
    rows = rows.select("id", "row", "text", F.inline("places"))
    rows = rows.withColumn("at", F.expr("cast(place div 256 as int)")).withColumn("starts", F.expr("cast(place % 128 as int)"))
    rows = rows.withColumn("part", F.expr(f"substr(text, at + 1, starts + {length - 1})"))
    ways = F.expr(f"(n + {spread - 1}) div {spread}")
    rows = rows.withColumn("key", F.xxhash64("anchor", F.when(ways > 1, F.pmod(F.xxhash64("part"), ways))))
    return store(rows.select("part", "key", (ways > 1).alias("spread"), "id", "row", "at", "starts"), "stretches")


def shard_results(parts: DataFrame, length: int, shard_bytes: int) -> DataFrame:
    """Per distinct stretch: ``digest, id, at`` of its earliest place, ``runs`` of starts that start earlier
    elsewhere in the shard, and for spread anchors ``strings`` and ``offsets`` of the rest; stored."""
    total = parts.agg(F.sum(F.octet_length("part"))).first()[0] or 0
    shards = int(total // shard_bytes) + 1
    once = parts.groupBy("part", F.pmod("key", F.lit(shards)).alias("shard"), "spread").agg(F.min(F.struct("id", "at")).alias("first"))
    once = once.select("shard", "part", "spread", "first.id", "first.at")

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        texts = table["part"].to_pylist()
        flags = repeated_starts(texts, table["id"].to_numpy(), table["at"].to_numpy().astype(np.int64), length)
        runs, strings, offsets, begin = [], [], [], 0
        for text, spread in zip(texts, table["spread"].to_pylist()):
            own = flags[begin : begin + len(text) - length + 1]
            begin += len(own)
            runs.append(runs_of(own))
            left = np.flatnonzero(~own).tolist() if spread else []
            strings.append([hashlib.md5(text[o : o + length]).digest() for o in left])
            offsets.append(left)
        return pa.table(
            {
                "digest": pa.array([hashlib.md5(t).digest() for t in texts], pa.binary()),
                "id": table["id"],
                "at": table["at"],
                "runs": pa.array(runs, pa.list_(pa.int32())),
                "strings": pa.array(strings, pa.list_(pa.binary())),
                "offsets": pa.array(offsets, pa.list_(pa.int32())),
            }
        )

    schema = "digest binary, id long, at int, runs array<int>, strings array<binary>, offsets array<int>"
    return store(once.groupBy("shard").applyInArrow(run, schema), "shards")


def merged_across(results: DataFrame) -> DataFrame:
    """``digest, runs``: starts of spread stretches whose string starts earlier in another shard.

    First strings of all shards are dealt by ranges of their digest; in a range they are sorted and each looks
    up its equals by binary search.
    """
    rows = results.where("size(offsets) > 0").select("digest", "id", "at", F.explode(F.arrays_zip("strings", "offsets")).alias("s"))
    rows = rows.select("digest", "id", (F.col("at") + F.col("s.offsets")).alias("start"), F.col("s.offsets").alias("offset"), F.col("s.strings").alias("string"))
    ranges = int(rows.count() // RANGE_ROWS) + 1
    opening = F.conv(F.substring(F.hex("string"), 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("range", (opening * ranges / F.lit(2**32)).cast("int"))

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        strings = np.array(table["string"].to_pylist(), dtype="S16")
        ids, starts = table["id"].to_numpy(), table["start"].to_numpy()
        by = np.lexsort((starts, ids, strings))
        first = by[np.searchsorted(strings[by], strings)]
        late = pa.array((ids != ids[first]) | (starts != starts[first]))
        return table.select(["digest", "offset"]).filter(late)

    found = rows.groupBy("range").applyInArrow(run, "digest binary, offset int")
    return found.groupBy("digest").agg(F.flatten(F.collect_list(F.array("offset", F.col("offset") + 1))).alias("more"))


def repeated_places(docs: DataFrame, length: int, gram: int, spread: int, shard_bytes: int) -> DataFrame:
    """``row, runs``: per document the starts, as from-upto runs, of strings that start earlier."""
    copies = whole_copies(docs, length)
    parts = cut_out(docs, shared_stretches(docs, copies, length, gram), length, spread)
    results = shard_results(parts, length, shard_bytes)
    results = results.join(merged_across(results), "digest", "left")
    flagged = F.concat("runs", F.coalesce("more", F.array().cast("array<int>")))
    first = results.select("digest", F.struct("id", "at").alias("first"), flagged.alias("runs"))
    here = parts.select(F.unhex(F.md5("part")).alias("digest"), "id", "row", "at", "starts").join(first, "digest")
    runs = F.when(F.struct("id", "at") != F.col("first"), F.array(F.col("at"), F.col("at") + F.col("starts")))
    runs = runs.otherwise(F.transform("runs", lambda x: x + F.col("at")))
    here = here.select("row", runs.alias("runs")).where("size(runs) > 0")
    here = here.union(copies.select("row", F.array(F.lit(0), F.col("size") - (length - 1))))
    return here.groupBy("row").agg(F.flatten(F.collect_list("runs")).alias("runs"))


def covered(size: int, runs: list[int] | None, length: int) -> np.ndarray:
    """Flags of the bytes that strings starting in ``runs`` cover."""
    edge = np.zeros(size + 1, np.int32)
    if runs is not None and len(runs):
        ends = np.asarray(runs).reshape(-1, 2)
        np.add.at(edge, ends[:, 0], 1)
        np.add.at(edge, np.minimum(ends[:, 1] - 1 + length, size), -1)
    return np.cumsum(edge[:-1]) > 0


def whole_characters(data: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """``gone`` without the bytes of characters that are only partly gone."""
    if not gone.any():
        return gone
    char = np.cumsum((data & 0xC0) != 0x80)
    stays = np.bincount(char, ~gone) > 0
    return gone & ~stays[char]


def remove_repeats(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, gram: int = GRAM, spread: int = SPREAD, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """Rows of ``docs`` with ``n_bytes, n_removed, n_spans, kept_sha256`` and ``left_over``, added or replaced.

    "Earlier" is a smaller doc_id, or an earlier place in the same one; matches never cross documents and are
    judged on the input. ``left_over`` is the remaining text; characters that are cut stay whole in it, the
    digest is of the remaining bytes alone. A null or empty text has nothing to remove. Rows that repeat a
    doc_id are one place: a string does not repeat what stands at the same place of another such row. A row
    without doc_id comes before all others.
    """
    added = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "left_over"]
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in (*added, text)]).alias("own")
    places = repeated_places(keyed(docs, text, doc_id), length, gram, spread, shard_bytes)
    joined = keyed(docs, text, doc_id, own, F.col(text).isNull().alias("absent")).join(places, "row", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for body, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                gone = covered(len(body), runs, length)
                data = np.frombuffer(body, np.uint8)
                kept = data[~gone].tobytes() if runs else body
                left = data[~whole_characters(data, gone)].tobytes() if runs else body
                spans = int(np.count_nonzero(np.diff(np.append(False, gone).astype(np.int8)) == 1))
                out.append((len(body), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), left.decode()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = [pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, batch.column(3)], ["own", *added, "absent"])

    kind = docs.select(own).schema["own"].dataType.simpleString()
    done = joined.select("own", "text", "runs", "absent").mapInArrow(
        run, f"own {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, left_over string, absent boolean"
    )
    names = [c for c in docs.columns if c not in added]
    left = F.when(~F.col("absent"), F.col("left_over"))
    return done.select(*[left.alias(c) if c == text else F.col("own").getField(c).alias(c) for c in names], *added)


def report(docs: DataFrame) -> DataFrame:
    out = remove_repeats(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def clean(docs: DataFrame) -> DataFrame:
    """Pipeline form: the columns of ``docs``, ``n_chars`` that of the new text; rows left blank go."""
    out = remove_repeats(docs)
    blank = (F.col("n_removed") > 0) & ~F.coalesce(F.col("left_over"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return out.where(~blank).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)
