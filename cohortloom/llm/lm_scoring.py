"""LM scoring: a weighted backoff automaton over n-grams, walked once from left to right.

States are the n-grams shorter than ``order`` that occur in training texts, and the empty one. A state has an arc for each token seen after it, weighted with the log probability there, and a failure arc
to its longest proper suffix that is a state, weighted with the mass left for unseen tokens; the empty state
knows every token. Counts are smoothed towards the shorter context: P(w | h) = (c(hw) + MU * P(w | h')) / (c(h) + MU),
down to the add-0.1 unigram base, so probabilities over all known tokens and one unknown sum to one in every state.

The automaton of a corpus fits no worker. Documents are dealt into blocks; a block counts its own n-grams, the counts
meet in ranges of n-grams, and each block gets back what the others add to its own, which is all it needs of the
automaton to walk its documents exactly. A frequent n-gram moves once for each block, however often it occurs,
and what moves grows with the text. N-grams are 64-bit hashes of their words; a block sends them sorted, as
packed differences, and the answers come in the same order without them.
"""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.jaccard_join import WordHashes, mixed
from cohortloom.llm.shared import text_of

ORDER = 2
#: Weight of the shorter context, in observations.
MU = 5.0
#: Training occurrences from which a context is a state: every one that was seen.
MIN_CONTEXT = 1
#: Fixed: the base's added count, and folds of which number 0 is held out.
ADDED, FOLDS = 0.1, 10
BLOCK_BYTES = 12_000_000
#: Text whose n-grams meet in one range.
RANGE_BYTES = 24_000_000
_END = np.uint64(0x5DEECE66D1234567)


def packed(values: np.ndarray) -> bytes:
    """Whole numbers as compressed byte planes, as many as the largest needs."""
    values = np.ascontiguousarray(values).astype("<u8")
    width = (int(values.max()).bit_length() + 7) // 8 if len(values) else 0
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return struct.pack("<qB", len(values), width) + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(blob: bytes) -> np.ndarray:
    n, width = struct.unpack_from("<qB", blob)
    planes = pa.decompress(blob[9:], decompressed_size=n * width, codec="zstd", asbytes=True) if n * width else b""
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(planes, np.uint8).reshape(width, n).T
    return out.view("<u8").reshape(n)


class Block:
    """The token sequence of a block's documents and, for each length up to ``order``, its n-grams."""

    def __init__(self, texts: list[bytes], training: np.ndarray, order: int):
        hashes = WordHashes()
        words = [t.lower().split() for t in texts]  # of bytes: A-Z only, and ASCII white space only
        self.sizes = np.array([len(w) + 1 for w in words], np.int64)
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.tokens = np.empty(int(self.sizes.sum()), np.uint64)
        last = self.begin + self.sizes - 1
        inner = np.ones(len(self.tokens), bool)
        inner[last] = False
        self.tokens[inner] = np.fromiter((hashes[w] for ws in words for w in ws), np.uint64)
        self.tokens[last] = _END
        self.ends = ~inner
        train = np.repeat(training, self.sizes)
        place = np.arange(len(self.tokens)) - np.repeat(self.begin, self.sizes)
        #: Per length: n-gram number at each place (-1: none), n-gram keys in order, own counts, and once settled the corpus's.
        self.at, self.keys, self.own, self.counts = [], [], [], []
        key = mixed(self.tokens)
        for k in range(order):
            if k:
                key[1:] = mixed(key[:-1] * np.uint64(0x9E3779B97F4A7C15) + self.tokens[1:] + np.uint64(k))
            there = place >= k
            found, index = np.unique(key[there], return_inverse=True)
            at = np.full(len(self.tokens), -1, np.int64)
            at[there] = index
            self.at.append(at)
            self.keys.append(found)
            self.own.append(np.bincount(index, train[there], len(found)).astype(np.int64))
        #: Length of the longest n-gram that ends at each place and is a state, once settled.
        self.state = np.zeros(len(self.tokens), np.int64)

    def in_order(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """N-grams of all lengths by key: where each stands among the lengths put together, its key and own count."""
        keys = np.concatenate(self.keys)
        by = np.argsort(keys, kind="stable")
        return by, keys[by], np.concatenate(self.own)[by]

    def settle(self, more: np.ndarray, min_context: int) -> None:
        """Corpus-wide counts, from what other blocks add to the own ones ``in_order``; then the states."""
        by, _, own = self.in_order()
        totals = np.empty(len(by), np.int64)
        totals[by] = own + more
        self.counts = np.split(totals, np.cumsum([len(k) for k in self.keys])[:-1])
        opened = None
        for k, (at, counts) in enumerate(zip(self.at, self.counts)):
            if opened is not None:  # only n-grams behind a state are arcs
                at[1:][~opened[:-1]] = -1
            opened = (at >= 0) & ~self.ends
            opened[opened] = counts[at[opened]] >= min_context
            self.state[opened] = k + 1


def unigram_base(counts: np.ndarray, n: int, v: int) -> np.ndarray:
    return (counts + ADDED) / (n + ADDED * (v + 1))


class Automaton:
    """Arcs and failure arcs that a settled block can take, by n-gram number and length."""

    def __init__(self, block: Block, n: int, v: int, mu: float = MU):
        self.block = block
        p = unigram_base(block.counts[0], n, v)
        self.arc, self.fail = [np.log10(p)], [None]
        here = p[block.at[0]]
        for k in range(1, len(block.counts)):
            place = np.flatnonzero(block.at[k] >= 0)
            gram = block.at[k][place]
            context = block.counts[k - 1][block.at[k - 1][place - 1]]
            here[place] = (block.counts[k][gram] + mu * here[place]) / (context + mu)
            arc = np.zeros(len(block.counts[k]))
            arc[gram] = np.log10(here[place])
            self.arc.append(arc)
            self.fail.append(np.log10(mu / (block.counts[k - 1] + mu)))

    def walk(self) -> np.ndarray:
        """Log10 probability of each document. All documents advance by one token at a time, each in its state.

        A state is the length of its n-gram, which ends at the token before.
        """
        block, longest = self.block, len(self.arc) - 1
        by_size = np.argsort(-block.sizes, kind="stable")
        begin, sizes = block.begin[by_size], block.sizes[by_size]
        state = np.zeros(len(begin), np.int64)
        total = np.zeros(len(begin))
        for step in range(int(sizes[0]) if len(sizes) else 0):
            live = int(np.searchsorted(-sizes, -step, "left"))
            at = begin[:live] + step
            s, weight = state[:live].copy(), np.zeros(live)
            for k in range(longest, -1, -1):  # fail down from the longest states
                inside = np.flatnonzero(s == k)
                if not len(inside):
                    continue
                gram = block.at[k][at[inside]]
                if not k:
                    weight[inside] += self.arc[0][gram]
                    continue
                seen = block.counts[k][gram] > 0
                weight[inside[seen]] += self.arc[k][gram[seen]]
                s[inside[seen]] = -1
                drop = inside[~seen]
                weight[drop] += self.fail[k][block.at[k - 1][at[drop] - 1]]
                # the longest proper suffix that is a state: n-grams of that length stand behind one
                s[drop] = 0
                for j in range(1, k):
                    s[drop[block.at[j][at[drop]] >= 0]] = j
            total[:live] += weight
            state[:live] = np.minimum(block.state[at], longest)
        out = np.empty(len(total))
        out[by_size] = total
        return out


def fold_of(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def training_totals(docs: DataFrame) -> tuple[int, int]:
    """Tokens and distinct tokens of the training texts, each text's end counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for text in batch.column(0).to_pylist():
                found.update(text.lower().split())
            words = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    training = docs.where(~F.col("held_out"))
    words = training.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    row = words.agg(F.count("*").alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    ends = training.count()
    return row.n + ends, row.v + (ends > 0)


def score(
    docs: DataFrame, order: int = ORDER, mu: float = MU, min_context: int = MIN_CONTEXT, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Per row: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Learns from rows outside fold 0. A null or empty text is its end alone. A null doc_id takes the fold of an
    empty string. Repeated rows count and score as often as they occur; other columns are ignored.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (fold_of(F.col("doc_id")) == 0).alias("held_out"),
        text_of().cast("binary").alias("text"),
    )
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(size // block_bytes) + 1
    n, v = training_totals(rows)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))

    ranges = int(size // RANGE_BYTES) + 1

    def read(table: pa.Table) -> Block:
        return Block(table["text"].to_pylist(), ~np.array(table["held_out"].to_pylist(), bool), order)

    def count(key: tuple, table: pa.Table) -> pa.Table:
        _, keys, own = read(table).in_order()
        place = ((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
        edge = np.searchsorted(place, np.arange(ranges + 1))
        grams = [packed(np.diff(keys[a:b], prepend=np.uint64(0))) for a, b in zip(edge[:-1], edge[1:])]
        counts = [packed(own[a:b]) for a, b in zip(edge[:-1], edge[1:])]
        numbers = pa.array(np.full(ranges, key[0].as_py(), np.int32))
        return pa.table(
            {"range": pa.array(np.arange(ranges, dtype=np.int32)), "block": numbers, "grams": pa.array(grams, pa.binary()), "counts": pa.array(counts, pa.binary())}
        )

    def meet(table: pa.Table) -> pa.Table:
        own = [unpacked(c).astype(np.int64) for c in table["counts"].to_pylist()]
        keys = np.concatenate([np.cumsum(unpacked(g), dtype=np.uint64) for g in table["grams"].to_pylist()])
        _, index = np.unique(keys, return_inverse=True)
        del keys
        each = np.concatenate(own)
        more = np.bincount(index, each).astype(np.int64)[index] - each
        more = np.split(more, np.cumsum([len(o) for o in own])[:-1])
        return pa.table({"range": table["range"], "block": table["block"], "more": pa.array([packed(m) for m in more], pa.binary())})

    own = dealt.groupBy("block").applyInArrow(count, "range int, block int, grams binary, counts binary")
    answers = own.groupBy("range").applyInArrow(meet, "range int, block int, more binary")

    def walk(left: pa.Table, right: pa.Table) -> pa.Table:
        block = read(left)
        found = right.sort_by("range")["more"].to_pylist()
        block.settle(np.concatenate([unpacked(m) for m in found]).astype(np.int64), min_context)
        unigrams = block.counts[0][block.at[0]]
        base = np.add.reduceat(np.log10(unigram_base(unigrams, n, v)), block.begin)
        return pa.table(
            {
                "doc_id": left["doc_id"],
                "held_out": left["held_out"],
                "n_tokens": block.sizes,
                "n_known": np.add.reduceat((unigrams > 0).astype(np.int64), block.begin),
                "train_tokens": np.full(len(base), n, np.int64),
                "base_score": base,
                "score": Automaton(block, n, v, mu).walk(),
            }
        )

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(walk, schema)
