"""Toxicity: noisy-channel deobfuscation, then a linear score of the restored text.

Writers hide words by leetspeak, spacing and repetition. Each token that could be so written opens a
lattice of readings per character; Viterbi decoding under a character trigram model picks the likeliest
word. Tokens that offer one reading only are taken as they stand. Restored words, and their runs of five
characters for what inflection and compounding do to them, are the features of a logistic regression.

Every labelled training row is learned from. Word statistics are counted in the tasks; the trigrams, features and
weights kept of them are bounded in number and travel with the tasks. Each text is turned into its features once,
for training and scoring; the weights come from Newton steps on sums over the distinct sets of features.
"""

from __future__ import annotations

import math
import re
import string
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.shared import store, text_of
from cohortloom.llm.url_filter import MAX_BLOCKS, PER_BLOCK, bloom_filter, possible

FOLDS = 5
MAX_FEATURES = 400
#: Training rows a word must appear in, and how sure its excess among toxic ones must be (standard errors).
MIN_ROWS, MIN_Z = 4, 2.8
#: Newton steps, shortened ones included; ten or so are usual.
STEPS = 60
MAX_TRIGRAMS = 100_000
#: Words that a task counts before it hands them on.
MAX_COUNTED = 400_000
#: Pairs of features whose products are held at once.
MAX_PAIRS = 1_000_000
#: Tokens, and stretches of tokens, that a task remembers before it starts anew.
MAX_MEMO = 400_000
#: Longer tokens may be many words: they are also read piece by piece, and not remembered.
MAX_TOKEN = 60

#: Fixed: usual leetspeak readings of a character.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e"}
SEPARATORS = ".-_*~'"
#: Natural-log costs of the channel: a leet reading, a dropped separator or mark, a shortened run.
LEET_COST, DROP_COST, RUN_COST, KEEP_COST = 1.0, 0.7, 0.4, 3.0

DOUBLE = re.compile(r"(.)\1", re.S)
#: Runs that have several readings, with at most one character between them that has one.
STRETCH = re.compile(r"(?:(.)\1+|[\W\d_])(?:[^\W\d_]?(?:(.)\2+|[\W\d_]))*", re.S)
#: What stands between the pieces of a long token: neither letters, digits nor leetspeak.
BETWEEN = re.compile(r"(?:_|[^\w@$!|+(€])+")
EDGES = string.punctuation + "…“”„«»‘’–—"
#: A token opening or ending with these may hide a letter there.
OPENERS, ENDINGS = frozenset("@$("), frozenset("@$0123456789")
#: So many one-character tokens in a row are a word written with spaces.
SPACED = 4


class CharModel:
    """Trigram model of words with interpolation by context counts."""

    def __init__(self, trigrams: dict[str, int]):
        self.three = trigrams
        self.two: Counter = Counter()
        self.one: Counter = Counter()
        for gram, n in trigrams.items():
            self.two[gram[:2]] += n
            self.one[gram[2]] += n
        self.total = sum(trigrams.values()) + 1
        self.after: Counter = Counter()
        self.pairs: Counter = Counter()
        for gram, n in trigrams.items():
            self.after[gram[1]] += n
            self.pairs[gram[1:]] += n
        self.memo: dict[str, float] = {}
        self.stretches: dict[tuple, str] = {}

    def cost(self, gram: str) -> float:
        """Negative log probability of the third character after the first two."""
        found = self.memo.get(gram)
        if found is None:
            p1 = (self.one[gram[2]] + 0.01) / self.total
            p2 = (self.pairs[gram[1:]] + 5 * p1) / (self.after[gram[1]] + 5)
            p3 = (self.three.get(gram, 0) + 5 * p2) / (self.two[gram[:2]] + 5)
            found = self.memo[gram] = -math.log(p3)
        return found

    def word_cost(self, word: str) -> float:
        padded = f"^^{word}$"
        return sum(self.cost(padded[i : i + 3]) for i in range(len(padded) - 2))


@lru_cache(maxsize=10_000)
def run_readings(c: str, n: int) -> list[tuple[str, float]]:
    """Readings of ``n`` equal characters with their costs; three stand for more."""
    options = []
    if c.isalpha():
        options.append((c * n, 0.0))
        if n >= 2:
            options.append((c, RUN_COST if n > 2 else 2 * KEEP_COST))
        if n > 2:
            options.append((c * 2, RUN_COST))
    else:
        options.append((c, KEEP_COST))
        for reading in LEET.get(c, ""):
            options.append((reading * min(n, 2), LEET_COST))
            if n > 1:
                options.append((reading, LEET_COST + RUN_COST))
        if c in SEPARATORS or not (c in LEET or c.isalnum()):
            options.append(("", DROP_COST))
    return options


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """Readings of each run of equal characters with their costs."""
    return [run_readings(run[1], min(len(run[0]), 3)) for run in re.finditer(r"(.)\1*", token, re.S)]


def best_reading(before: str, stretch: str, after: str, model: CharModel) -> str:
    """The likeliest reading of ``stretch`` between the two characters before it and the two after it."""
    known = model.memo
    best: dict[str, tuple[float, tuple]] = {before: (0.0, ())}
    for options in [*lattice(stretch), *([(c, 0.0)] for c in after)]:
        following: dict[str, tuple[float, tuple]] = {}
        for state, (cost, path) in best.items():
            for reading, price in options:
                c, s = cost + price, state
                for ch in reading:
                    gram = s + ch
                    c += known[gram] if gram in known else model.cost(gram)
                    s = gram[1:]
                if s not in following or c < following[s][0]:
                    following[s] = (c, (path, reading))
        best = following
    _, path = min(best.values(), key=lambda end: end[0])
    text = []
    while path:
        path, reading = path
        text.append(reading)
    return "".join(reversed(text))[: -len(after)]


def viterbi(token: str, model: CharModel) -> str:
    """The likeliest word behind ``token``.

    A state is the last two characters. Two characters of one reading each leave one state only, so the stretches
    between such are decoded apart, and once for the same characters around them.
    """
    known, padded = model.stretches, f"^^{token}$"
    out, at = [], 0
    for found in STRETCH.finditer(token):
        a, b = found.span()
        key = padded[a : a + 2], found[0], padded[b + 2 : b + 4]
        word = known.get(key)
        if word is None:
            word = best_reading(*key, model)
            if b - a <= MAX_TOKEN:
                if len(known) >= MAX_MEMO:
                    known.clear()
                known[key] = word
        out += token[at:a], word
        at = b
    return "".join(out) + token[at:]


def readings(token: str, model: CharModel) -> tuple[str, ...]:
    """The word of a token, and what it may hide."""
    plain = token.strip(EDGES)
    doubtful = not plain.isalpha() or token[0] in OPENERS or token[-1] in ENDINGS or DOUBLE.search(plain)
    pieces = {*BETWEEN.split(token)} - {"", token} if len(token) > MAX_TOKEN else ()
    among = {w for piece in pieces for w in readings(piece, model)}
    if not doubtful or not any(c.isalpha() for c in token):
        return tuple(sorted(among | ({plain} if plain else set())))
    whole = token.rstrip(".,;:?!\"'*%&#")
    tried = {whole, plain} | ({BETWEEN.sub("", token)} if pieces else set())
    found = {plain, *among, *(viterbi(t, model).strip(EDGES) for t in tried)}
    return tuple(sorted(w for w in found if w))


def spaced_words(tokens: list[str]) -> list[str]:
    """Words written as single characters with white space between; a last one may carry punctuation."""
    lengths = bytes(map(min, map(len, tokens), repeat(255)))
    if b"\x01" * (SPACED - 1) not in lengths:
        return []
    out = []
    for run in re.finditer(b"\x01{%d,}" % (SPACED - 1), lengths):
        a, b = run.span()
        if b < len(tokens) and len(tokens[b].strip(EDGES)) == 1:
            b += 1
        if b - a >= SPACED:
            out.append("".join(tokens[a:b]))
    return out


def features_of(word: str) -> list[str]:
    """A word and its character runs; ``^`` and ``$`` mark its ends."""
    marked = f"^{word}$"
    return [marked, *[marked[i : i + 5] for i in range(len(marked) - 4)]]


class Reader:
    """Distinct features of the restored words of texts, each token decoded once."""

    def __init__(self, model: CharModel, index: dict[str, int] | None = None):
        self.model, self.index = model, index
        self.names = frozenset(index or ())
        self.forget()

    def forget(self) -> None:
        """Start anew with the tokens; ``without`` are those that hold no feature."""
        self.memo: dict[str, tuple] = {}
        self.without: set[str] = set()

    def token(self, token: str) -> tuple:
        plain = token.strip(EDGES)
        if len(token) <= MAX_TOKEN and plain.isalpha() and token[0] not in OPENERS and token[-1] not in ENDINGS and not DOUBLE.search(plain):
            found = features_of(plain)  # its one reading
        else:
            found = [f for w in readings(token, self.model) for f in features_of(w)]
        if self.index is None:
            return tuple(set(found))
        known = self.names.intersection(found)
        return tuple(map(self.index.__getitem__, known)) if known else ()

    def read(self, text: str) -> set:
        tokens = text.lower().split()
        distinct = {*tokens, *spaced_words(tokens)} - self.without
        new = distinct.difference(self.memo)
        out = set(chain.from_iterable(map(self.memo.__getitem__, distinct - new)))
        for token in new:
            found = self.token(token)
            out.update(found)
            if len(token) <= MAX_TOKEN:
                if len(self.memo) + len(self.without) >= MAX_MEMO:
                    self.forget()
                if found:
                    self.memo[token] = found
                else:
                    self.without.add(token)
        return out


def fold_of(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def known_labels(labels: DataFrame) -> DataFrame:
    """``doc_id, toxic`` of every label outside fold 0, once per doc_id."""
    known = labels.where("doc_id is not null and toxic is not null").where(fold_of(F.col("doc_id")) != 0)
    return known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every labelled row outside fold 0: ``toxic, text``, stored.

    A Bloom filter of bounded size passes over most rows without a label; texts of the others move to their labels.
    """
    known = store(known_labels(labels), "toxicity-labels")
    n_blocks = max(1, min(MAX_BLOCKS, -(-known.count() // PER_BLOCK)))
    bloom = bloom_filter(known.select(F.col("doc_id").cast("string").alias("listed_url")), n_blocks)
    rows = docs.select("doc_id", text_of().alias("text")).where(fold_of(F.col("doc_id")) != 0)
    asked = possible(rows.withColumn("key", F.col("doc_id").cast("string")), "key", bloom, n_blocks).where("maybe")
    # the same plan at any size
    return store(asked.join(known.hint("merge"), "doc_id").select("toxic", "text"), "toxicity-rows")


def word_counts(rows: DataFrame, model: CharModel | None) -> DataFrame:
    """``word, toxic, n``: rows that hold a word of letters, or with a model a feature. Counted in each task, then summed."""

    def letters(text: str) -> set:
        words = {t.strip(EDGES) for t in set(text.lower().split())}
        return {w for w in words if len(w) <= 40 and w.isalpha()}

    def handed_on(counts: dict[int, Counter]) -> Iterator[pa.RecordBatch]:
        for toxic, counter in counts.items():
            columns = [pa.array(list(counter), pa.string()), pa.array([toxic] * len(counter), pa.int32()), pa.array(list(counter.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["word", "toxic", "n"])
        counts.clear()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Reader(model).read if model else letters
        counts: dict[int, Counter] = {}
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts.setdefault(label, Counter()).update(read(text.as_py()))
                if sum(map(len, counts.values())) >= MAX_COUNTED:
                    yield from handed_on(counts)
        yield from handed_on(counts)

    counted = rows.select("toxic", "text").mapInArrow(count, "word string, toxic int, n long")
    return counted.groupBy("word", "toxic").agg(F.sum("n").alias("n"))


def fit_characters(rows: DataFrame, max_trigrams: int = MAX_TRIGRAMS) -> CharModel:
    """Trigrams of the letters-only words of the training rows, the commonest ``max_trigrams``."""
    words = word_counts(rows, None).where(F.col("word").rlike(r"^\p{L}{1,40}$"))
    padded = words.select(F.concat(F.lit("^^"), "word", F.lit("$")).alias("w"), "n")
    at = F.explode(F.sequence(F.lit(1), F.char_length("w") - 2)).alias("i")
    grams = padded.select("w", "n", at).select(F.expr("substr(w, i, 3)").alias("gram"), "n")
    counted = grams.groupBy("gram").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "gram").limit(max_trigrams)
    return CharModel({r.gram: r.n for r in counted.toLocalIterator()})


def choose_features(rows: DataFrame, model: CharModel, max_features: int = MAX_FEATURES) -> dict[str, int]:
    """Features with the surest excess among toxic rows, numbered."""
    total = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = total.get(1, 0), total.get(0, 0)
    counts = word_counts(rows, model).groupBy("word").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"),
        F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("b"),
    )
    z = F.expr(
        f"(ln((a + 0.5) / ({bad} - a + 0.5)) - ln((b + 0.5) / ({good} - b + 0.5))) / sqrt(1 / (a + 0.5) + 1 / (b + 0.5))"
    )
    best = counts.where(F.col("a") >= MIN_ROWS).withColumn("z", z).where(F.col("z") >= MIN_Z)
    best = best.orderBy(F.desc("z"), "word").limit(max_features)
    return {r.word: i for i, r in enumerate(best.collect())}


def found_features(docs: DataFrame, model: CharModel, index: dict[str, int]) -> DataFrame:
    """``doc_id, features`` of every row, stored: the numbers of the features that its text holds."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model, index)
        for batch in batches:
            found = [sorted(reader.read(text)) if text else [] for text in (t.as_py() for t in batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "features"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return store(texts.mapInArrow(extract, "doc_id long, features array<int>"), "toxicity-features")


def training_sets(found: DataFrame, labels: DataFrame) -> DataFrame:
    """``toxic, features, n``: every distinct set of features of the training rows, counted and stored."""
    rows = found.where(fold_of(F.col("doc_id")) != 0).join(known_labels(labels), "doc_id")
    return store(rows.groupBy("toxic", "features").agg(F.count("*").alias("n")), "toxicity-sets")


def flat(features: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each list begins, how long it is, and the numbers of all lists."""
    ends = features.offsets.to_numpy()
    return ends[:-1] - ends[0], np.diff(ends), features.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def logistic_sums(sets: DataFrame, beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss at ``beta`` (the bias last), its slope and its curvature, summed in the tasks and then over them."""
    k = len(beta)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, slope, curve = 0.0, np.zeros(k), np.zeros(k * k)
        for batch in batches:
            toxic, n = (batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (0, 2))
            begin, length, numbers = flat(batch.column(1))
            for size in np.unique(length):
                rows, wide = np.flatnonzero(length == size), int(size) + 1
                for some in np.array_split(rows, len(rows) * wide**2 // MAX_PAIRS + 1):
                    if not len(some):
                        continue
                    at = np.full((len(some), wide), k - 1)
                    at[:, :-1] = numbers[begin[some][:, None] + np.arange(size)]
                    y, weight, z = toxic[some], n[some], beta[at].sum(1)
                    p = (1 + np.tanh(z / 2)) / 2
                    loss += weight @ (np.logaddexp(0, z) - y * z)
                    slope += np.bincount(at.ravel(), np.repeat(weight * (p - y), wide), k)
                    pairs = at[:, :, None] * k + at[:, None, :]
                    curve += np.bincount(pairs.ravel(), np.repeat(weight * p * (1 - p), wide**2), k * k)
        sums = np.concatenate([curve, slope, [loss]])
        cells = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(sums[cells])], ["cell", "value"])

    sums = np.zeros(k * k + k + 1)
    total = sets.select("toxic", "features", "n").mapInArrow(run, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    table = total.toArrow()
    sums[table.column("cell").to_numpy()] = table.column("value").to_numpy()
    return float(sums[-1]), sums[k * k : -1], sums[: k * k].reshape(k, k)


def fit_weights(sets: DataFrame, n_features: int, ridge: float = 0.3) -> tuple[np.ndarray, float]:
    """Logistic regression on all training rows by Newton steps, halved where the loss would grow.

    Only the sums of a step come to the driver: at most (n_features + 1) squared numbers, whatever the rows.
    """
    best, step, lowest = np.zeros(n_features + 1), np.zeros(n_features + 1), math.inf
    if sets.isEmpty():
        return best[:-1], -4.0
    # the bias is free; a trace keeps it finite where all labels are the same
    penalty = np.append(np.full(n_features, ridge), 1e-6)
    for _ in range(STEPS):
        beta = best - step
        loss, slope, curve = logistic_sums(sets, beta)
        loss += penalty @ beta**2 / 2
        if loss > lowest * (1 + 1e-12):
            step = step / 2
            continue
        best, lowest, slope = beta, loss, slope + penalty * beta
        step = np.linalg.solve(curve + np.diag(penalty), slope)
        if slope @ step < 1e-8:
            break
    # the last step is too small to be weighed, and brings runs that added in another order together
    best = np.round(best - step, 9)
    return best[:-1], float(best[-1])


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id, held_out, score, predicted``.

    A null or empty text has no words and gets the score of the bias, as do all texts where no labelled
    training row exists. A null doc_id counts as held out. Repeated rows score alike; a doc_id that is
    labelled twice counts as toxic if either label says so. Other columns are never looked at.
    """
    rows = training_rows(docs, labels)
    model = fit_characters(rows)
    index = choose_features(rows, model)
    found = found_features(docs, model, index)
    weights, bias = fit_weights(training_sets(found, labels), len(index))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, length, numbers = flat(batch.column(1))
            z = np.bincount(np.repeat(np.arange(len(length)), length), weights[numbers], len(length)) + bias
            values = pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), values], ["doc_id", "score"])

    return found.mapInArrow(run, "doc_id long, score double").select(
        "doc_id",
        (fold_of(F.col("doc_id")) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
