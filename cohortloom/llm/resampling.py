"""Importance resampling towards a target distribution.

Features are hashed runs of one to three words. A table counts them per bucket for the corpus and for the
target; the logarithm of the smoothed ratio is the gain of a bucket, and the sum of gains over a document is
its weight. Gumbel noise, a function of the document's id, turns the highest scores into a draw without
replacement whose odds follow the weights.

Gains are an array of fixed length, and so are a task's counts: a batch of texts is cut into words, hashed and
scored by whole arrays. The CRC of a run follows from the CRCs of its words, for appending bytes is linear: no
run is ever built as a string.

Ranks come from a distributed LSD radix sort. The composite key (score descending, id, number of features) is
sorted digit by digit, the least one first. A pass counts each digit per block of positions, turns the counts
into global offsets, and moves every row to its offset plus its place within block and digit; passes are stable,
so after the last one a row's position is its rank. No task holds more than a block, however many rows are equal.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.llm.shared import store, text_of

BUCKETS = 10_000
MAX_RUN = 3
MIN_WORDS = 20
PERCENT = 5
SEED = 42
#: Bits of a digit, and rows of a block of positions.
DIGIT_BITS = 16
BLOCK_ROWS = 200_000
#: Bytes and words that are handled at once.
CHUNK = 1 << 20

_BYTE = np.arange(256)
_LOWER = np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, _BYTE).astype(np.uint8)
#: Letters, digits and every byte of a character beyond ASCII.
_IN_WORD = ((_BYTE >= 48) & (_BYTE <= 57)) | ((_LOWER >= 97) & (_LOWER <= 122)) | (_BYTE >= 128)
_ALL = np.uint32(0xFFFFFFFF)


def _byte_table() -> np.ndarray:
    """Raw CRC of each byte, from the library's own."""
    start = zlib.crc32(b"\0")
    return np.array([zlib.crc32(bytes([b])) ^ start for b in range(256)], np.uint32)


_STEP = _byte_table()


def _raw_step(register: np.ndarray, byte) -> np.ndarray:
    return _STEP[(register ^ byte) & np.uint32(255)] ^ (register >> np.uint32(8))


@lru_cache(maxsize=4096)
def _shift(length: int) -> np.ndarray:
    """What ``length`` appended bytes do to a CRC, as four tables of 256, one for each of its bytes."""
    if length < 2:
        grid = (np.arange(256, dtype=np.uint32)[None, :] << np.array([[0], [8], [16], [24]], np.uint32)).astype(np.uint32)
        return grid if length == 0 else _raw_step(grid, np.uint32(0))
    return _apply(_shift(length // 2), _shift(length - length // 2))


def _apply(tables: np.ndarray, crc: np.ndarray, which: np.ndarray | int = 0) -> np.ndarray:
    """``crc`` shifted by the tables, or by the ``which``-th of several."""
    flat = tables.reshape(-1)
    base = np.asarray(which) * 1024
    out = flat[base + (crc & np.uint32(255))]
    for k in (1, 2, 3):
        out = out ^ flat[base + 256 * k + ((crc >> np.uint32(8 * k)) & np.uint32(255))]
    return out


def word_codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts that lie end to end: CRC of the lower-cased bytes, length, and place of the text."""
    first, last = int(offsets[0]), int(offsets[-1])
    cut = np.unique(offsets)
    starts, ends = [], []
    for a in range(first, last, CHUNK):
        b = min(a + CHUNK, last)
        inside = np.zeros(b - a + 2, bool)
        lo, hi = max(a - 1, first), min(b + 1, last)
        inside[lo - a + 1 : hi - a + 1] = _IN_WORD[data[lo:hi]]
        begins = inside[1:-1] & ~inside[:-2]
        closes = inside[1:-1] & ~inside[2:]
        at = cut[(cut >= a) & (cut < b)] - a
        begins[at] = inside[1:-1][at]
        at = cut[(cut > a) & (cut <= b)] - a - 1
        closes[at] = inside[1:-1][at]
        starts.append(np.flatnonzero(begins) + a)
        ends.append(np.flatnonzero(closes) + a + 1)
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    length = (np.concatenate(ends) if ends else start) - start
    codes = np.concatenate([_codes(data, start[i : i + CHUNK], length[i : i + CHUNK]) for i in range(0, len(start), CHUNK)] or [np.zeros(0, np.uint32)])
    return codes, length, np.searchsorted(offsets, start, "right") - 1


def _codes(data: np.ndarray, start: np.ndarray, length: np.ndarray, most: int = 48) -> np.ndarray:
    """CRCs of words, all words a byte further at a time; words beyond ``most`` bytes singly."""
    order = np.argsort(-length, kind="stable")
    begin, size = start[order], length[order]
    register = np.full(len(order), _ALL, np.uint32)
    long = int(np.searchsorted(-size, -most, "left"))
    for k in range(most if long < len(size) else 0):
        active = int(np.searchsorted(-size, -k, "left"))
        if active <= long:
            break
        register[long:active] = _raw_step(register[long:active], _LOWER[data[begin[long:active] + k]].astype(np.uint32))
    register ^= _ALL
    for i in range(long):
        register[i] = zlib.crc32(_LOWER[data[begin[i] : begin[i] + size[i]]].tobytes())
    out = np.empty_like(register)
    out[order] = register
    return out


def run_codes(codes: np.ndarray, length: np.ndarray, owner: np.ndarray):
    """CRC and owner of every run of 1 to ``MAX_RUN`` words joined by a space, in pieces of bounded size."""
    for a in range(0, len(codes), CHUNK):
        b = min(a + CHUNK, len(codes))
        run = codes[a:b]
        yield run, owner[a:b]
        for k in range(1, MAX_RUN):
            run = run[: max(min(b, len(codes) - k) - a, 0)]
            nxt = slice(a + k, a + k + len(run))
            sizes, which = np.unique(length[nxt], return_inverse=True)
            if not len(sizes):
                break
            spaced = _raw_step(run ^ _ALL, np.uint32(32)) ^ _ALL
            run = _apply(np.stack([_shift(int(s)) for s in sizes]), spaced, which) ^ codes[nxt]
            same = owner[nxt] == owner[a : a + len(run)]
            yield run[same], owner[a : a + len(run)][same]


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a column of texts; a null is an empty text."""
    column = pa.compute.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def _groups(offsets: np.ndarray):
    """Neighbouring texts of together about ``CHUNK`` bytes; a longer text stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1, i + 1)
        yield i, min(j, n)
        i = min(j, n)


def bucket_counts(texts: DataFrame, column: str, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n``: how often the features of all texts fall into each bucket. A task sends one row per bucket."""

    def run(batches):
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            data, offsets = _texts(batch.column(0))
            for i, j in _groups(offsets):
                for codes, _ in run_codes(*word_codes(data, offsets[i : j + 1])):
                    counts += np.bincount(codes % np.uint32(buckets), minlength=buckets)
        hit = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int64)), pa.array(counts[hit])], ["bucket", "n"])

    local = texts.select(text_of(column).alias("body")).mapInArrow(run, "bucket long, n long")
    return local.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Gain of every bucket, from two tables of counts: an array of ``buckets`` numbers on the driver."""
    spark = corpus.sparkSession
    both = (
        spark.range(buckets).select(F.col("id").alias("bucket"))
        .join(corpus.select("bucket", F.col("n").alias("s")), "bucket", "left")
        .join(target.select("bucket", F.col("n").alias("t")), "bucket", "left")
        .fillna(0)
    )
    rows = sorted(tuple(r) for r in both.select("bucket", "s", "t").collect())
    n_s, n_t = float(sum(r[1] for r in rows)), float(sum(r[2] for r in rows))
    ratio = [((t + 1.0) * (n_s + buckets)) / ((s + 1.0) * (n_t + buckets)) for _, s, t in rows]
    whole = spark.createDataFrame([(i, x) for i, x in enumerate(ratio)], "i long, x double")
    logs = whole.select("i", F.floor(1000 * F.log("x")).cast("long").alias("g")).collect()
    out = np.zeros(buckets, np.int64)
    for i, g in logs:
        out[i] = g
    return out


def weigh(docs: DataFrame, gain: np.ndarray, text: str = "text") -> DataFrame:
    """The columns of ``docs`` but ``text``, then ``w_words, w_features, w_weight`` of the whole text."""
    kept = [f for f in docs.schema.fields if f.name != text]
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    schema = ", ".join(filter(None, [types, "w_words long, w_features long, w_weight long"]))
    buckets = np.uint32(len(gain))

    def run(batches):
        for batch in batches:
            data, offsets = _texts(batch.column(batch.num_columns - 1))
            n = len(offsets) - 1
            words, features, weight = (np.zeros(n, np.int64) for _ in range(3))
            for i, j in _groups(offsets):
                codes, length, owner = word_codes(data, offsets[i : j + 1])
                words[i:j] = np.bincount(owner, minlength=j - i)
                for run_crc, of in run_codes(codes, length, owner):
                    features[i:j] += np.bincount(of, minlength=j - i)
                    # sums of whole numbers far below 2^53: exact in doubles
                    weight[i:j] += np.bincount(of, gain[run_crc % buckets], minlength=j - i).astype(np.int64)
            columns = [batch.column(k) for k in range(batch.num_columns - 1)] + [pa.array(x) for x in (words, features, weight)]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in kept] + ["w_words", "w_features", "w_weight"])

    plain = docs.select(*[F.col(f"`{f.name}`") for f in kept], text_of(text).alias("w_body"))
    return plain.mapInArrow(run, schema)


def noise(doc_id: str = "doc_id", seed: int = SEED) -> Column:
    """Gumbel noise of an id in whole thousandths; a missing id is the empty text."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ascending(value: Column) -> Column:
    """A long whose unsigned order is the signed order of ``value``."""
    return F.coalesce(value.cast("long"), F.lit(0)).bitwiseXOR(F.lit(-(2**63)))


def descending(value: Column) -> Column:
    return F.bitwise_not(ascending(value))


def radix_positions(
    rows: DataFrame, keys: list[Column], name: str = "position", digit_bits: int = DIGIT_BITS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """``rows`` with their 0-based position in the unsigned order of ``keys``, the first key foremost.

    Rows that agree in every key follow each other in no particular order. Digits that all rows share
    are passed over; the state is written after every pass, so a lost executor costs one re-read.
    """
    per_key = -(-64 // digit_bits)
    mask = F.lit((1 << digit_bits) - 1).cast("long")
    names = rows.columns
    state = rows.withColumns({f"_k{i}": k for i, k in enumerate(keys)})
    state = store(
        state.withColumn("_block", F.spark_partition_id().cast("long")).withColumn(name, F.monotonically_increasing_id()), "radix"
    )
    digits = {
        f"_{i}_{d}": F.shiftrightunsigned(f"_k{i}", d * digit_bits).bitwiseAND(mask)
        for i in reversed(range(len(keys)))
        for d in range(per_key)
    }
    spans = state.agg(*[F.min(c).alias(f"lo{n}") for n, c in digits.items()], *[F.max(c).alias(f"hi{n}") for n, c in digits.items()])
    spans = spans.first()
    within = Window.partitionBy("_block", "_digit").orderBy(name)
    earlier = Window.partitionBy("_digit").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each value of a digit: at most 2 ** digit_bits
    smaller = Window.partitionBy(F.lit(0)).orderBy("_digit").rowsBetween(Window.unboundedPreceding, -1)
    moved = False
    for n, digit in digits.items():
        if spans[f"lo{n}"] == spans[f"hi{n}"]:
            continue
        placed = state.withColumn("_digit", digit)
        counts = placed.groupBy("_block", "_digit").agg(F.count("*").alias("_n"))
        totals = counts.groupBy("_digit").agg(F.sum("_n").alias("_all"))
        totals = totals.select("_digit", F.coalesce(F.sum("_all").over(smaller), F.lit(0)).alias("_below"))
        offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).join(totals, "_digit")
        offsets = offsets.select("_block", "_digit", (F.col("_below") + F.col("_before")).alias("_offset"))
        place = F.row_number().over(within).cast("long") - 1
        out = placed.withColumn("_place", place).join(offsets, ["_block", "_digit"])
        out = out.withColumn(name, F.col("_offset") + F.col("_place"))
        out = out.withColumn("_block", F.expr(f"`{name}` div {int(block_rows)}"))
        state = store(out.select(*state.columns), "radix")
        moved = True
    if not moved:  # every row has the same key: any order will do, but positions must have no gaps
        sizes = state.groupBy("_block").agg(F.count("*").alias("_n"))
        before = Window.partitionBy(F.lit(0)).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        sizes = sizes.select("_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
        inner = F.row_number().over(Window.partitionBy("_block").orderBy(name)).cast("long") - 1
        state = state.withColumn("_place", inner).join(sizes, "_block").withColumn(name, F.col("_offset") + F.col("_place"))
    return state.select(*names, name)


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    seed: int = SEED,
    digit_bits: int = DIGIT_BITS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every row of ``docs``.

    Of the N rows with ``min_words`` words or more the ``percent * N div 100`` with the highest scores are
    drawn, ties to the smaller id, a missing id before all others; ``rank`` is null for the rest. Rows that
    agree in id and score are ranked by fewer features; repeated rows each take a rank. A null or wordless
    text has no features and weight 0. Without target every gain follows from the corpus alone; an empty
    corpus gives no rows. Other columns of either table are not looked at.
    """
    gain = gains(bucket_counts(docs, "text"), bucket_counts(target, "text"))
    weighed = weigh(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), gain)
    scored = weighed.select(
        "doc_id", F.col("w_words").alias("n_words"), F.col("w_features").alias("n_features"), F.col("w_weight").alias("weight"),
        (F.col("w_weight") + noise("doc_id", seed)).alias("score"),
    )
    scored = store(scored, "scored")
    enough = F.col("n_words") >= min_words
    keys = [
        descending(F.col("score")),
        F.when(F.col("doc_id").isNull(), 0).otherwise(1).cast("long"),
        ascending(F.col("doc_id")),
        ascending(F.col("n_features")),
    ]
    able = scored.where(enough)
    drawn = able.count() * percent // 100
    ranked = radix_positions(able, keys, "rank", digit_bits, block_rows)
    ranked = ranked.withColumn("rank", F.when(F.col("rank") < drawn, F.col("rank") + 1))
    return ranked.unionByName(scored.where(~enough).withColumn("rank", F.lit(None).cast("long")))


def sample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns, whole texts included.

    The last drawn row sets the threshold, and documents are weighed again next to their texts, which so
    never move. Repeats of the last drawn row go with it. Nulls and empty tables as in :func:`resample`.
    """
    last = resample(docs, target, percent, min_words, seed).where("rank is not null").orderBy(F.desc("rank")).first()
    if last is None:
        return docs.limit(0)
    gain = gains(bucket_counts(docs, "text"), bucket_counts(target, "text"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("w_row"), F.col("doc_id").cast("long").alias("w_id"), "text")
    out = weigh(rows, gain).withColumn("w_score", F.col("w_weight") + noise("w_id", seed))
    ids = F.struct(F.col("w_id").isNotNull(), F.coalesce("w_id", F.lit(0)), "w_features")
    bound = F.struct(F.lit(last.doc_id is not None), F.lit(last.doc_id or 0).cast("long"), F.lit(last.n_features).cast("long"))
    score = F.lit(last.score).cast("long")
    kept = (F.col("w_words") >= min_words) & ((F.col("w_score") > score) | ((F.col("w_score") == score) & (ids <= bound)))
    return out.where(kept).select("w_row.*")


def oracle_sql() -> str:
    """The same from DuckDB; the CRC byte by byte, its table from the polynomial."""
    return r"""
  with tab as (select list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
      lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as tab),
  d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
  b as (select regexp_extract_all(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
  fd as (select r, array_to_string(ws[i:i + k - 1], ' ') as f from d, unnest([1, 2, 3]) u(k), unnest(range(1, len(ws) - k + 2)) v(i)),
  fb as (select array_to_string(ws[i:i + k - 1], ' ') as f from b, unnest([1, 2, 3]) u(k), unnest(range(1, len(ws) - k + 2)) v(i)),
  fs as (select f, list_transform(range(octet_length(encode(f))), lambda i: ('0x' || substr(hex(f), (2 * i + 1)::int, 2))::bigint) as bytes
      from (select f from fd union select f from fb)),
  fc as materialized (select f, xor(list_reduce(list_concat([4294967295], bytes),
      lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) % 10000 as bucket from fs, tab),
  s as (select bucket, count(*) as s from fd join fc using (f) group by bucket),
  t as (select bucket, count(*) as t from fb join fc using (f) group by bucket),
  tot as (select (select count(*) from fd)::double as ns, (select count(*) from fb)::double as nt),
  g as (select bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::double * (ns + 10000)) / ((coalesce(s, 0) + 1)::double * (nt + 10000))))::bigint as gain
      from (select unnest(range(10000)) as bucket) left join s using (bucket) left join t using (bucket), tot),
  w as (select r, count(*) as n_features, sum(gain)::bigint as weight from fd join fc using (f) join g using (bucket) group by r),
  a as (select doc_id, len(ws) as n_words, coalesce(n_features, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
      ('0x' || substr(sha256('42:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint as h from d left join w using (r)),
  sc as (select *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296.0::double)))::bigint as score from a),
  rk as (select *, row_number() over (partition by n_words >= 20 order by score desc, doc_id nulls first, n_features) as p,
      count(*) over (partition by n_words >= 20) as n from sc)
  select doc_id, n_words::bigint as n_words, n_features, weight, score,
      case when n_words >= 20 and p <= 5 * n // 100 then p end as rank from rk"""
