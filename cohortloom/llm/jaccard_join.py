"""N-gram Jaccard join by PartEnum signatures.

A document is the set of its distinct 4-word shingles. Two sets of sizes a and b with Jaccard similarity of at
least G differ in at most (1-G)/(1+G) * (a+b) shingles. Sizes fall into bands; sets that can meet in a
band share its bound k. The shingle domain is dealt into k+1 partitions and more; two such sets agree wholly in
all partitions but k, and the content of a partition, hashed with band and number, is a signature. Partitions
with less than two shingles say little and meet often, so they give no signature: the extra partitions make
sure that others agree. A set with too many of them is dealt anew by another hash, and so is each set it
could only be missed by.

No pairs are made within a signature: every member is compared with the smallest one; links become components;
where more than one is left of those that met the same document, blocks of them are compared within tasks
(``across_components``). So groups of copies are joined at the cost of their members, no link is lost, and no pair
that is none becomes a row. A signature holds a document once while a document has many, so no signature outgrows a task's share.

Whole sets are the largest thing to be moved, so a profile goes first: how many shingles a set has in each of about
half as many buckets as it has shingles, a byte each. The common part of two sets is at most the sum of the
smaller counts. Pairs that cannot reach the similarity even so are no links, and only the sets of the others are
moved and compared shingle by shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.components import components
from cohortloom.llm.shared import NO_ID, key_of, store, text_of
from cohortloom.llm.url_filter import MAX_BLOCKS, PER_BLOCK, bloom_filter, possible

WIDTH = 4
#: Similarity in hundredths.
LEAST = 85
#: Ratio of a band's largest to its smallest size, and partitions beyond k + 1.
BAND_RATIO, EXTRA = 1.25, 0.3
#: Hashes that deal the shingles; at the last one every partition gives a signature.
DEALS = 8
MAX_WORDS = 500_000
#: Documents in a block that is compared within a task.
BLOCK = 300

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of ``x``."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MAX_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: bytes, hashes: WordHashes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct shingle hashes of a text; a text with fewer words is one shingle."""
    words = text.lower().split()  # of bytes: A-Z only, and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(width, len(w))
    value = np.full(len(w) - size + 1, size, np.uint64)
    for i in range(size):
        value = value * np.uint64(0x9E3779B97F4A7C15) + w[i : len(w) - size + 1 + i]
    return np.unique(mixed(value))


class Bands:
    """Size bands ``[low, high]`` in order, with the number of differing shingles that a linked pair may have."""

    def __init__(self, least: int = LEAST, ratio: float = BAND_RATIO):
        self.least, self.ratio = least, ratio
        self.low, self.high, self.k = [1], [1], [0]

    def of(self, n: int) -> list[int]:
        """Numbers of the bands in which a set of ``n`` shingles is compared."""
        while self.high[-1] < n * 2:
            low = self.high[-1] + 1
            high = max(low, int(low * self.ratio))
            self.low.append(low)
            self.high.append(high)
            self.k.append((100 - self.least) * 2 * high // (100 + self.least))
        i = int(np.searchsorted(self.high, n))
        out = [i]
        while 100 * n >= self.least * self.low[i + 1]:
            i += 1
            out.append(i)
        return out


def signatures(s: np.ndarray, bands: Bands) -> np.ndarray:
    """Signatures of a set."""
    out = []
    content = mixed(s + np.uint64(0x51ED270B9B1D))
    for band in bands.of(len(s)) if len(s) else []:
        k = bands.k[band]
        parts = 1 if k == 0 else int(np.ceil((k + 1) * (1 + EXTRA)))
        for deal in range(DEALS):
            part = (mixed(s ^ np.uint64((band * DEALS + deal + 1) * 0x2545F4914F6CDD1D % 2**64)) % np.uint64(parts)).astype(np.int64)
            counts = np.bincount(part, minlength=parts)
            order = np.argsort(part, kind="stable")
            full = np.flatnonzero(counts)
            sums = np.zeros(parts, np.uint64)
            sums[full] = np.add.reduceat(content[order], (np.cumsum(counts) - counts)[full])
            telling = counts >= (2 if k else 1)
            enough = parts - int(telling.sum()) < parts - k
            chosen = np.flatnonzero(telling if enough or deal < DEALS - 1 else counts >= 0)
            tag = mixed(np.uint64((band * DEALS + deal) << 32) + chosen.astype(np.uint64))
            out.append(mixed(sums[chosen] ^ tag))
            if enough:
                break
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def bodies(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    return docs.select(key_of(doc_id).alias("id"), text_of(text).cast("binary").alias("text"))


def set_sizes(docs: DataFrame) -> DataFrame:
    """``id, n, d1, d2, profile``: size, 128-bit digest and profile of each row's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sums, known = [], []
            for t in batch.column(1).to_pylist():
                s = shingles(t, hashes)
                sums.append((len(s), int(s.sum()), int(mixed(s + np.uint64(1)).sum())))
                known.append(profile(s).tobytes())
            values = np.array(sums, np.uint64).reshape(-1, 3).view(np.int64)
            columns = [batch.column(0), *[pa.array(values[:, i]) for i in range(3)], pa.array(known, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "d1", "d2", "profile"])

    return docs.mapInArrow(run, "id long, n long, d1 long, d2 long, profile binary")


def profile(s: np.ndarray) -> np.ndarray:
    """Shingles of a set by bucket, a power of two of them; empty if a byte does not hold a count."""
    buckets = max(8, 1 << max(len(s) // 2, 1).bit_length() - 1)
    counts = np.bincount((s & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets)
    return counts.astype(np.uint8) if counts.max(initial=0) < 256 else np.zeros(0, np.uint8)


def all_signatures(docs: DataFrame) -> DataFrame:
    """``sig, id``, a row for each signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, bands = WordHashes(), Bands()
        for batch in batches:
            ids = batch.column(0).to_numpy()
            found = [signatures(shingles(t, hashes), bands) for t in batch.column(1).to_pylist()]
            counts = [len(f) for f in found]
            if sum(counts):
                columns = [pa.array(np.concatenate(found).view(np.int64)), pa.array(np.repeat(ids, counts))]
                yield pa.RecordBatch.from_arrays(columns, ["sig", "id"])

    return docs.mapInArrow(run, "sig long, id long")


def rows_of(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows ``id, text`` whose id is among ``ids``. A Bloom filter of bounded size passes over the others where they
    are read, so that no more texts are moved than are asked for, and a few by chance."""
    ids = store(ids.distinct(), "ids")
    n_blocks = max(1, min(MAX_BLOCKS, -(-ids.count() // PER_BLOCK)))
    bloom = bloom_filter(ids.select(F.col("id").cast("string").alias("listed_url")), n_blocks)
    asked = possible(rows.withColumn("key", F.col("id").cast("string")), "key", bloom, n_blocks)
    return asked.where("maybe").select("id", "text").join(ids, "id", "left_semi").select("id", "text")


def full_sets(docs: DataFrame) -> DataFrame:
    """``id, members``: each row's shingle hashes, sorted, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingles(t, hashes).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["id", "members"])

    return docs.mapInArrow(run, "id long, members binary")


def folded(p: np.ndarray, buckets: int) -> np.ndarray:
    """A profile with fewer buckets."""
    return p.reshape(-1, buckets).sum(axis=0, dtype=np.int64)


def most_common(m: int, p: np.ndarray, n: int, q: np.ndarray) -> int:
    """The most that sets of sizes ``m`` and ``n`` with profiles ``p`` and ``q`` can have in common."""
    if not len(p) or not len(q):
        return min(m, n)
    buckets = min(len(p), len(q))
    return int(np.minimum(folded(p, buckets), folded(q, buckets)).sum())


def plausible(pairs: DataFrame, known: DataFrame, least: int = LEAST) -> DataFrame:
    """The pairs ``a, b`` that may be links by their profiles: all links, and few others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for m, x, n, y in zip(*(c.to_pylist() for c in batch.columns[2:])):
                good = 100 * min(m, n) >= least * max(m, n)
                if good:
                    common = most_common(m, np.frombuffer(x, np.uint8), n, np.frombuffer(y, np.uint8))
                    good = 100 * common >= least * (m + n - common)
                keep.append(good)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    one = known.select(F.col("id").alias("a"), F.col("n").alias("m"), F.col("profile").alias("x"))
    other = known.select(F.col("id").alias("b"), "n", F.col("profile").alias("y"))
    met = pairs.select("a", "b").join(one, "a").join(other, "b").select("a", "b", "m", "x", "n", "y")
    return met.mapInArrow(run, "a long, b long").distinct()


def linked(pairs: DataFrame, sets: DataFrame, least: int = LEAST) -> DataFrame:
    """The pairs ``a, b`` whose sets are similar enough, counted exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                small, large = sorted((len(x), len(y)))
                good = 100 * small >= least * large
                if good:
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    good = 100 * common >= least * (len(x) + len(y) - common)
                keep.append(good)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    one = sets.select(F.col("id").alias("a"), F.col("members").alias("x"))
    other = sets.select(F.col("id").alias("b"), F.col("members").alias("y"))
    return pairs.select("a", "b").join(one, "a").join(other, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def in_blocks(compared: DataFrame, labels: DataFrame, block: int = BLOCK) -> DataFrame:
    """``a, b, component, i, j``: the members of the groups that are more than one component, for each pair of blocks.

    Members are those that were compared with the same document ``a``; they are dealt into blocks of about ``block``.
    Groups that are one component by now are left out.
    """
    named = compared.join(labels.select(F.col("id").alias("b"), "component"), "b", "left")
    named = named.select("a", "b", F.coalesce("component", "b").alias("component"))
    open_ = named.groupBy("a").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("n"))
    open_ = open_.where("x <> y").select("a", F.expr(f"(n + {block - 1}) div {block}").alias("blocks"))
    dealt = named.join(open_, "a").withColumn("own", F.pmod(F.xxhash64("b"), F.col("blocks")))
    # with every block once: the smaller of the two names the row of the table of block pairs
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    dealt = dealt.select("a", "b", "component", "own", other)
    return dealt.select("a", "b", "component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


def still_open(compared: DataFrame, labels: DataFrame, known: DataFrame, least: int = LEAST, block: int = BLOCK) -> DataFrame:
    """The rows ``a, b`` of ``compared`` that may be linked, by their profiles, to another component of their group."""

    def run(table: pa.Table) -> pa.Table:
        sizes = table["n"].to_numpy()
        found = table["component"].to_numpy()
        raw = [np.frombuffer(p, np.uint8) for p in table["profile"].to_pylist()]
        buckets = min([len(p) for p in raw if len(p)], default=1)
        small = np.array([folded(p, buckets) if len(p) else np.full(buckets, 1 << 30) for p in raw])
        hit = np.zeros(len(raw), bool)
        for k in range(len(raw)):
            common = np.minimum(np.minimum(small[k], small[k + 1 :]).sum(axis=1), np.minimum(sizes[k], sizes[k + 1 :]))
            near = (100 * common >= least * (sizes[k] + sizes[k + 1 :] - common)) & (found[k] != found[k + 1 :])
            hit[k] |= near.any()
            hit[k + 1 :] |= near
        return table.select(["a", "b"]).filter(pa.array(hit))

    rows = in_blocks(compared, labels, block).join(known.select(F.col("id").alias("b"), "n", "profile"), "b")
    return rows.groupBy("a", "i", "j").applyInArrow(run, "a long, b long").distinct()


def across_components(compared: DataFrame, labels: DataFrame, sets: DataFrame, least: int = LEAST, block: int = BLOCK) -> DataFrame:
    """Links ``a, b`` between components, among documents that were compared with the same one.

    A task takes two blocks of such a group and counts what each two sets share by matrix products, in memory of
    bounded size. No pair becomes a row: a task returns only as many links as join its components.
    """
    rows = in_blocks(compared, labels, block).join(sets.select(F.col("id").alias("b"), "members"), "b")

    def run(table: pa.Table) -> pa.Table:
        ids, found = table["b"].to_pylist(), table["component"].to_pylist()
        members = [np.frombuffer(m, np.uint64) for m in table["members"].to_pylist()]
        sizes = np.array([len(m) for m in members])
        common = shared_counts(members)
        alike = 100 * common >= least * (sizes[:, None] + sizes[None, :] - common)
        root = {c: c for c in found}

        def top(c):
            while root[c] != c:
                c = root[c]
            return c

        links = []
        for x, y in zip(*(v.tolist() for v in np.nonzero(np.triu(alike, 1)))):
            u, v = top(found[x]), top(found[y])
            if u != v:
                root[max(u, v)] = min(u, v)
                links.append((ids[x], ids[y]))
        return pa.table({"a": pa.array([u for u, _ in links], pa.int64()), "b": pa.array([v for _, v in links], pa.int64())})

    return rows.groupBy("a", "i", "j").applyInArrow(run, "a long, b long")


def shared_counts(members: list[np.ndarray], wide: int = 8192) -> np.ndarray:
    """How many elements each two sets share, by matrix products over ``wide`` elements at a time."""
    flat = np.concatenate(members)
    owner = np.repeat(np.arange(len(members)), [len(m) for m in members])
    _, index, times = np.unique(flat, return_inverse=True, return_counts=True)
    several = np.cumsum(times > 1) - 1
    keep = times[index] > 1
    column, owner = several[index[keep]], owner[keep]
    out = np.diag([float(len(m)) for m in members]).astype(np.float32)
    by = np.argsort(column, kind="stable")
    column, owner = column[by], owner[by]
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, wide):
        a, b = np.searchsorted(column, [first, first + wide])
        part = np.zeros((len(members), wide), np.float32)
        part[owner[a:b], column[a:b] - first] = 1
        out += part @ part.T
    np.fill_diagonal(out, [len(m) for m in members])
    return out.astype(np.int64)


def similar_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``.

    A null or blank text has no shingles and is its own component. Rows that repeat a doc_id are one
    document with links from each of its texts. A row without doc_id comes before all others; its own
    and its component's id come back null. Other columns are ignored.
    """
    rows = bodies(docs, text, doc_id)
    sizes = store(set_sizes(rows), "set-sizes")
    worded = sizes.where("n > 0")
    # equal sets: one of them stands for all
    copies = worded.groupBy("n", "d1", "d2").agg(F.min("id").alias("first"))
    stands = worded.join(copies, ["n", "d1", "d2"]).where("id <> first").select("id", "first").distinct()
    stands = store(stands, "equal-sets")

    # the filter is the join's own: with it here, both uses are one exchange
    dealt = all_signatures(rows).where("sig is not null").repartition("sig")
    shared = dealt.groupBy("sig").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least <> most")
    members = dealt.join(shared.select("sig"), "sig")  # inner: a semi join would move below the exchange
    # a repeated id may stand under several ids with equal sets; its own texts keep their signatures
    members = members.join(stands.groupBy("id").agg(F.min("first").alias("first")), "id", "left")
    members = store(members.select("sig", F.coalesce("first", "id").alias("id")).distinct(), "members")

    def leaders(of: DataFrame) -> DataFrame:
        found = of.groupBy("sig").agg(F.min("id").alias("a"), F.max("id").alias("most")).where("a <> most")
        return of.join(found.select("sig", "a"), "sig").where("id <> a").select("a", F.col("id").alias("b")).distinct()

    first_pairs = store(leaders(members), "pairs")
    involved = first_pairs.select("a").union(first_pairs.select("b")).distinct().select(F.col("a").alias("id"))

    known = sizes.join(involved, "id", "left_semi").select("id", "n", "profile")
    known = store(known.dropDuplicates(), "profiles")
    likely = store(plausible(first_pairs, known), "likely")
    meant = likely.select("a").union(likely.select("b")).distinct().select(F.col("a").alias("id"))
    sets = store(full_sets(rows_of(rows, meant)).dropDuplicates(), "sets")
    links = store(linked(likely, sets), "links")
    labels = components(links)

    open_ = store(still_open(first_pairs, labels, known), "open")
    if not open_.isEmpty():
        sets = store(full_sets(rows_of(rows, open_.select(F.col("b").alias("id")))).dropDuplicates(), "sets")
        more = store(across_components(open_, labels, sets), "links")
        labels = components(links.union(more))

    joined = stands.select(F.col("id").alias("a"), F.col("first").alias("b"))
    through = joined.join(labels.select(F.col("id").alias("b"), "component"), "b", "left")
    through = through.select(F.col("a").alias("id"), F.coalesce("component", "b").alias("component"))
    final = labels.union(through).groupBy("id").agg(F.min("component").alias("component"))
    out = sizes.join(final, "id", "left")
    none = F.lit(NO_ID)
    return out.select(
        F.nullif("id", none).alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.nullif(F.coalesce("component", "id"), none).alias("component_id"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` that stand for their component: those with its smallest doc_id.

    A missing id comes before all others, so a row without one stays, and its copies go. Rows that repeat a
    doc_id stay or go together. Texts without words stay; an empty table stays empty.
    """
    groups = similar_groups(docs).where(~F.col("component_id").eqNullSafe(F.col("doc_id"))).select("doc_id").distinct()
    return docs.join(groups, "doc_id", "left_anti").select(*docs.columns)


def oracle_sql(relation: str = "documents") -> str:
    """The same rows from DuckDB: shingle sets by text, all pairs with a common shingle, labels by iteration."""
    return rf"""
  with recursive t as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x20\x09-\x0D]+') as w from {relation}),
  s as (select distinct doc_id, case when len(w) < {WIDTH} then array_to_string(w, ' ')
        else array_to_string(w[i : i + {WIDTH - 1}], ' ') end as g, least(len(w), {WIDTH}) as k
        from t, unnest(range(1, greatest(len(w) - {WIDTH - 1}, case when len(w) > 0 then 1 else 0 end) + 1)) u(i)),
  n as materialized (select doc_id, count(*) as n from s group by doc_id),
  c as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.k = b.k and a.doc_id < b.doc_id group by 1, 2),
  e as materialized (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= {LEAST} * (x.n + y.n - c)),
  e2 as materialized (select a, b from e union select b, a from e),
  r as (select doc_id as id, doc_id as c from t union select e2.b, r.c from r join e2 on e2.a = r.id where r.c < e2.b)
  select t.doc_id, coalesce(n.n, 0)::bigint as n_shingles, l.c as component_id
  from (select doc_id from t) t left join n using (doc_id) join (select id, min(c) as c from r group by id) l on l.id = t.doc_id"""
