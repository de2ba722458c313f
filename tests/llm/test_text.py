"""Quality rules, licence scan, toxicity, LM scoring, BPE and packing."""

import hashlib
import itertools
import math
import os
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortloom.llm import bpe, license_scan, lm_scoring, packing, quality_rules, toxicity

SF = "/root/testdata/sf0.01"


def docs_of(spark, rows):
    """Documents with other columns whose names clash with those that the operators use inside."""
    full = [(d, t, "en", "s", "x", None) for d, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, words string, n long")


ODD = [(None, "a b"), (900, None), (901, ""), (902, " \n\t "), (903, "é" * 5000), (904, "a b"), (904, "a b")]


# --- LM scoring ------------------------------------------------------------------------------------


def expected_scores(rows, order, mu, least):
    low = [(d, zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0, (t or "").lower().split() + [None]) for d, t in rows]
    counts = Counter(tuple(w[i : i + k]) for _, held, w in low if not held for k in range(1, order + 1) for i in range(len(w) - k + 1))
    n = sum(c for g, c in counts.items() if len(g) == 1)
    v = sum(1 for g in counts if len(g) == 1)

    def p(h, x):
        if not h:
            return (counts[(x,)] + 0.1) / (n + 0.1 * (v + 1))
        if counts[h] < least:
            return p(h[1:], x)
        return (counts[h + (x,)] + mu * p(h[1:], x)) / (counts[h] + mu)

    return [
        (d, held, len(w), sum(counts[(x,)] > 0 for x in w), n, sum(math.log10(p((), x)) for x in w),
         sum(math.log10(p(tuple(w[max(0, i - order + 1) : i]), x)) for i, x in enumerate(w)))
        for d, held, w in low
    ]


@pytest.mark.parametrize("order, block_bytes, least", [(2, 8_000_000, 1), (2, 60, 40), (3, 60, 9), (1, 50, 1)])
def test_lm_scores(spark, order, block_bytes, least):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(["a", "b", "C", "d.", "é", "xy"], k=rng.randint(0, 12)))) for i in range(50)]
    rows += ODD

    def key(r):
        return str(r[0]), r[2], r[5]

    got = sorted((tuple(r) for r in lm_scoring.score(docs_of(spark, rows), order=order, block_bytes=block_bytes, min_context=least).collect()), key=key)
    want = sorted(expected_scores(rows, order, lm_scoring.MU, least), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=0, atol=1e-6)


def test_every_seen_context_is_a_state(spark):
    rng = random.Random(12)
    rows = [(i, " ".join(rng.choices([f"w{j}" for j in range(40)], k=rng.randint(0, 30)))) for i in range(60)] + ODD
    got = sorted((tuple(r) for r in lm_scoring.score(docs_of(spark, rows), block_bytes=400).collect()), key=str)
    want = sorted(expected_scores(rows, lm_scoring.ORDER, lm_scoring.MU, 1), key=str)
    assert np.allclose(sorted(g[6] for g in got), sorted(w[6] for w in want), rtol=0, atol=1e-6)
    assert sum(abs(g[6] - g[5]) > 1e-3 for g in got) > 40


def test_packed_numbers():
    for values in ([], [0], [0, 0], [1, 255, 256], [2**64 - 1, 0, 7]):
        assert lm_scoring.unpacked(lm_scoring.packed(np.array(values, np.uint64))).tolist() == values


# --- BPE -------------------------------------------------------------------------------------------


def test_bpe_equals_the_tokenizer(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = [
        "", "  ", "a", " ́a b́", "İ Σς ΑΣ Σ. x", "<|startoftext|> a<|endoftext|>b <|startoftext |>", "don't 's 't can 't I'll\t\n\x0b x y  z",
        "日本語 テスト 12345 1 2", "a\x01b \x01 c", "ǅ ŉ ß ẞ ...!!! ??", "x" * 3000, "가 각 가 ᆨ", None, "the cat the cat the dog " * 50,
    ]
    rows = list(enumerate(texts)) + ODD
    got = sorted((tuple(r) for r in bpe.encode_documents(docs_of(spark, rows), path).collect()), key=str)
    want = []
    for d, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_wrong_joins_are_repaired():
    class Joined:
        """Encodes letters one by one, but ``a b`` across white space as one id."""

        decoder = None

        def id_to_token(self, i):
            return chr(i)

        def get_vocab_size(self):
            return 300

        def encode(self, text, add_special_tokens):
            ids, i = [], 0
            while i < len(text):
                step = 3 if text[i : i + 3] == "a b" else 1
                if text[i] != " ":
                    ids.append(299 if step == 3 else ord(text[i]))
                i += step
            return type("Encoding", (), {"ids": ids})()

        def encode_batch_fast(self, texts, add_special_tokens):
            return [self.encode(t, add_special_tokens) for t in texts]

    encoder = bpe.ChunkEncoder(Joined())
    for text in ("xa bx", "a b a b", "b a bb aa b", "c d"):
        want = Joined().encode(text, False).ids
        assert encoder.encode([text.encode()])[0][0] == np.array(want, "<u4").tobytes()


# --- packing ---------------------------------------------------------------------------------------


def plain_best_fit(sizes, lengths):
    bins = []
    for size in sizes:
        open_ = [b for b in bins if b[0] - b[1] >= size]
        if open_:
            tight = min(b[0] - b[1] for b in open_)
            best = [b for b in open_ if b[0] - b[1] == tight]
        else:
            best = [[packing.opened(size, lengths), 0]]
            bins += best
        best[-1][1] += size
    return sorted(min(c for c in lengths if c >= b[1]) for b in bins)


def test_best_fit_is_that_of_a_plain_search():
    rng = random.Random(4)
    lengths = (8, 16, 32)
    for _ in range(50):
        sizes = sorted((rng.randint(1, 32) for _ in range(rng.randint(0, 40))), reverse=True)
        bins, offsets, final = packing.best_fit(sizes, lengths)
        used = Counter()
        for b, o, s in zip(bins, offsets, sizes):
            assert o == used[b]
            used[b] += s
        assert all(used[b] <= final[b] and not any(used[b] <= c < final[b] for c in lengths) for b in used)
        assert len(final) == len(plain_best_fit(sizes, lengths))


def test_packing_keeps_every_word(spark):
    rows = [(i, " ".join(["w"] * (i * 7 % 90))) for i in range(80)] + ODD
    df = docs_of(spark, rows)
    pieces = packing.pack(df, (8, 16, 32), shard_tokens=500)
    assert pieces.agg({"size": "sum"}).first()[0] == sum(len((t or "").split()) for _, t in rows)
    assert pieces.groupBy("bin_id").agg({"size": "sum", "capacity": "max"}).where("`sum(size)` > `max(capacity)`").count() == 0
    assert pieces.where("offset + size > capacity or start % 32 <> 0").count() == 0
    bins = packing.sequences(df, (8, 16, 32)).collect()
    assert sum(len(b.text.split()) for b in bins) == sum(len((t or "").split()) for _, t in rows)
    assert all(b.n_tokens == sum(b.sizes) <= b.capacity for b in bins)
    assert packing.pack(df.limit(0)).count() == 0


# --- quality ---------------------------------------------------------------------------------------


def test_quality_on_odd_rows(spark):
    good = " ".join(f"word{i}" for i in range(60))
    rows = ODD + [(1, good), (2, good + "\n" + good), (3, "a b c " * 30), (4, good), (4, good)]
    got = {}
    for r in quality_rules.score(docs_of(spark, rows).withColumnRenamed("words", "q_words")).collect():
        got.setdefault(r.doc_id, []).append(tuple(r)[1:])
    assert got[1] == [(60, 350, 0, 0, 0, False, True)] and len(got[4]) == 2
    assert got[2][0][0] == 120 and got[2][0][3] == 1 and got[2][0][5]  # every window but those at the seam occurs twice
    assert got[3][0][4] == 90 and not got[3][0][6]
    assert got[900] == got[901] == got[902] == [(0, 0, 0, 0, 0, True, False)]
    assert quality_rules.score(docs_of(spark, rows).limit(0)).count() == 0
    kept = quality_rules.keep_good(docs_of(spark, rows))
    assert kept.columns == docs_of(spark, []).columns and sorted(r.doc_id for r in kept.collect()) == [1, 4, 4]


def test_outlier_goes_and_its_group_stays(spark):
    rng = random.Random(6)
    rows = [(i, " ".join("x" * rng.randint(1, 6) + str(rng.randint(10, 99)) for _ in range(rng.randint(80, 400)))) for i in range(80)]
    rows += [(100, " ".join(f"#%${i}*#" for i in range(100)))]
    kept = {r.doc_id for r in quality_rules.score(docs_of(spark, rows)).where("kept").collect()}
    assert kept == set(range(80))


def plain_mcd(x, tries, rng):
    """Least determinant that concentration steps from random starts reach, with the same smallest deviations."""
    floors = np.diag([f[2] ** 2 for f in quality_rules.FEATURES])
    h = int(quality_rules.SUPPORT * len(x))
    best = (np.inf, None)
    for _ in range(tries):
        near = rng.choice(len(x), 12, replace=False)
        for _ in range(40):
            mean = x[near].mean(axis=0)
            scatter = quality_rules.CONSISTENCY * np.cov(x[near].T, bias=True) + floors
            far = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(scatter), x - mean)
            near = np.argsort(far, kind="stable")[:h]
        best = min(best, (np.sqrt(np.linalg.det(scatter)), tuple(mean)))
    return best


def features_of(spark, groups):
    """A table of features as ``fit`` takes it, one group for each array."""
    rows = [("en", f"s{k}", False, *map(int, row)) for k, x in enumerate(groups) for row in x]
    return spark.createDataFrame(rows, "g_lang string, g_source string, base_failed boolean, f1 long, f2 long, f3 long, f4 long, f5 long")


def test_masked_outliers_are_found_by_the_least_determinant(spark):
    rng = np.random.default_rng(4)
    scale = np.array([900, 60, 100, 200, 40])
    clean = rng.normal([5500, 1800, 200, 300, 50], scale, (400, 5))
    # a fifth of the rows far off in two statistics draws the plain mean and scatter over to itself
    planted = rng.normal([5500, 1800, 6000, 4500, 50], scale / 4, (100, 5))
    groups = [np.rint(np.vstack([clean, planted])), np.rint(clean[:60]), np.rint(clean[:1])]
    rows = features_of(spark, groups)
    estimates = {r.g_source: r for r in quality_rules.fit(rows).collect()}
    for k in (0, 1):
        det, mean = plain_mcd(groups[k], 100, rng)
        assert estimates[f"s{k}"].det <= 1.02 * det
    np.testing.assert_allclose([estimates["s0"][f"m{i}"] for i in range(5)], plain_mcd(groups[0], 100, rng)[1], atol=60)
    kept = quality_rules.judge(rows, quality_rules.fit(rows)).where("kept").groupBy("g_source").agg(F.max("f3").alias("f3"), F.count("*").alias("n"))
    assert {(r.g_source, r.n) for r in kept.collect() if r.f3 < 3000} == {("s0", 400), ("s1", 60), ("s2", 1)}
    sums = rows.groupBy(*quality_rules.GROUP).agg(F.count("*").alias("n"), *quality_rules.aggregates(quality_rules.moment_sql()))
    plain = quality_rules.estimate(sums.withColumn("start", F.lit(0)))
    assert quality_rules.judge(rows, plain).where("kept and f3 > 3000").count() == 100  # the classical estimate misses all


def test_steps_written_out_in_sql_are_enough(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    enough, more = (con.execute(quality_rules.oracle_sql(k)).fetchall() for k in (quality_rules.ORACLE_STEPS, quality_rules.ORACLE_STEPS + 3))
    got = sorted(tuple(r) for r in quality_rules.score(docs).collect())
    assert sorted(enough) == sorted(more) == got


def test_rows_with_many_symbols_go_and_good_ones_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    got = quality_rules.score(docs).where("not base_failed").join(labels, "doc_id", "left")
    got = got.join(docs.select("doc_id", "lang", "source"), "doc_id").withColumn("odd", F.expr("n_symbols > 0.2 * n_words"))
    got = got.withColumn("share", F.avg(F.col("odd").cast("int")).over(Window.partitionBy("lang", "source"))).cache()
    # the estimate rests on three quarters of a group, so it holds where fewer than a quarter are odd
    assert got.where("odd and share < 0.25").count() > 20
    assert got.where("kept and odd and share < 0.25").count() == 0
    assert got.where("not kept and quality = 1").count() == 0


def test_quality_of_missing_groups_and_repeated_rows(spark):
    good = " ".join(f"word{i}" for i in range(60))
    rows = [(1, good, None, None), (1, good, None, None), (None, good, "", ""), (2, None, None, "s"), (3, good, "en", None)]
    docs = spark.createDataFrame([r + (0.5, 7) for r in rows], "doc_id long, text string, lang string, source string, row double, kept int")
    out = quality_rules.keep_good(docs)
    assert out.columns == docs.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, docs.where("text is not null").collect()))
    assert quality_rules.keep_good(docs.limit(0)).count() == 0


# --- licences --------------------------------------------------------------------------------------


def test_licence_families(spark):
    text = "Some words here.\nReleased under the MIT License.\n\nLicensed under CC BY-NC 4.0.\nthe terms of the contract"
    rows = [(1, text), (2, "You need a driving license to rent a car."), (3, "All rights reserved.")] + ODD
    got = license_scan.scan(docs_of(spark, rows)).where("confirmed").collect()
    assert sorted((r.doc_id, r.paragraph, r.family) for r in got) == [(1, 1, "mit"), (1, 3, "cc-by-nc"), (3, 0, "proprietary")]
    assert license_scan.scan(docs_of(spark, rows).limit(0)).count() == 0


def test_licence_scan_agrees_with_plain_python(spark):
    families, weights, bias = license_scan.trained()
    sets = license_scan.template_trigrams()
    rng = random.Random(8)
    sentences = [t for ts in license_scan.TEMPLATES.values() for t in ts] + license_scan.OTHERS
    rows = [(i, " ".join(w for w in rng.choice(sentences).split() if rng.random() > 0.2)) for i in range(60)]
    want = {}
    for d, t in rows:
        words = license_scan.tokens(t)
        own = set(zip(words, words[1:], words[2:]))
        if not any(own & s for ss in sets.values() for s in ss):
            continue
        z = bias + sum((weights[g] for g in license_scan.grams(words) if g in weights), np.zeros(len(families)))
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        best = families[int(p.argmax())]
        sure = best != "unknown" and p.max() >= license_scan.LEAST_PROBABILITY
        similar = max((len(own & s) / min(len(own), len(s)) for s in sets.get(best, [])), default=0.0)
        want[d] = (best if sure else "unknown", bool(sure and round(similar, 6) >= license_scan.LEAST_SIMILARITY))
    got = {r.doc_id: (r.family, r.confirmed) for r in license_scan.scan(docs_of(spark, rows)).collect()}
    assert len(want) > 20 and got == want


def test_licences_are_found_without_template_trigrams(spark):
    families, weights, bias = license_scan.trained()
    known = {g for ss in license_scan.template_trigrams().values() for s in ss for g in s}
    texts = ["MIT License", "Apache License", "GPL-3.0", "License: Apache-2.0", "mit", "..."] + license_scan.OTHERS
    for ts in license_scan.TEMPLATES.values():
        for t in ts:
            w = license_scan.tokens(t)
            texts += [" ".join(x for i, x in enumerate(w) if i % 3 != k) for k in range(3)]
            texts += [" ".join(y for a in range(k, len(w), 2) for y in (*w[a : a + 2], "zz")) for k in range(2)]
    want, silent = {}, 0
    for d, t in enumerate(texts):
        words = license_scan.tokens(t)
        z = bias + sum((weights[g] for g in license_scan.grams(words) if g in weights), np.zeros(len(families)))
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        sure = families[int(p.argmax())] != "unknown" and p.max() >= license_scan.LEAST_PROBABILITY
        shares = any(g in known for g in zip(words, words[1:], words[2:]))
        silent += sure and not shares
        if sure or shares:
            want[d] = families[int(p.argmax())] if sure else "unknown"
    got = {r.doc_id: r.family for r in license_scan.scan(docs_of(spark, list(enumerate(texts)))).collect()}
    assert silent > 10 and got == want


# --- toxicity --------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def letters():
    words = "idiot moron stupid loser clown worthless pathetic disgusting trash scum the thing with and of for".split()
    grams = Counter(f"^^{w}$"[i : i + 3] for w in words for i in range(len(w) + 1))
    return toxicity.CharModel({g: 50 * n for g, n in grams.items()})


@pytest.mark.parametrize(
    "written, word",
    [("id10t", "idiot"), ("m0r0n,", "moron"), ("$cum", "scum"), ("l.o.s.e.r", "loser"), ("mooooron", "moron"), ("p4th3tic", "pathetic"), ("tr@sh", "trash"), ("w0rthless", "worthless")],
)
def test_hidden_words_are_read(letters, written, word):
    assert word in toxicity.readings(written, letters)


@pytest.mark.parametrize("written, word", [
    ("the.thing.with_and_of_" * 5 + "m0r0n", "moron"), ("m" + "o" * 90 + "ron", "moron"), ("l." + "o." * 70 + "s.e.r", "loser"), ("stuupid", "stupid"), ("mooron", "moron"), ("tr@sh," * 20, "trash"),
])
def test_hidden_words_are_read_at_any_length(letters, written, word):
    found = toxicity.readings(written, letters)
    assert word in found or any(word in w for w in found if len(written) > 60)
    assert any(f in word for w in found for f in toxicity.features_of(w) if len(f) == 5)


def test_runs_of_a_long_word(letters):
    word = "abcdefghij" * 8 + "idiot" + "klmnopqrst" * 2000
    assert "idiot" in {f for w in toxicity.readings(word, letters) for f in toxicity.features_of(w)}
    assert len(toxicity.viterbi("ab" * 50_000, letters)) == 100_000


def test_spaced_words_and_plain_words(letters):
    assert toxicity.spaced_words("you i d i o t and m o r o n. a b".split()) == ["idiot", "moron."]
    assert toxicity.readings("the%%%", letters) == ("the",) and toxicity.readings("...", letters) == ()


def whole_token(token, model):
    """Costs of every reading of ``token``, all characters at once."""
    costs = {}
    for path in itertools.product(*toxicity.lattice(token)):
        word = "".join(r for r, _ in path)
        costs[word] = min(costs.get(word, math.inf), sum(p for _, p in path) + model.word_cost(word))
    return costs


def test_stretches_are_read_as_in_the_whole_token(letters):
    rng = random.Random(12)
    for _ in range(1500):
        token = "".join(rng.choices("idotmrnlescw0113$@!.-^²2é\u0301", k=rng.randrange(1, 9)))
        costs = whole_token(token, letters)
        assert costs[toxicity.viterbi(token, letters)] <= min(costs.values()) + 1e-9, token


def test_a_stretch_is_decoded_once(letters, monkeypatch):
    """Words around the same doubtful characters: their lattice was opened for each of them before."""
    opened, lattice = [], toxicity.lattice
    monkeypatch.setattr(toxicity, "lattice", lambda token: opened.append(token) or lattice(token))
    fresh = toxicity.CharModel(letters.three)
    tails = [f"{a}{b}{c}" for a, b, c in itertools.permutations("abcdefgh", 3)]
    read = {w for t in tails for w in toxicity.readings("m0ron" + t, fresh)}
    assert len(read) > 400 and sum("moron" in w for w in read) > 200 and len(opened) < 10


def test_tokens_forgotten_are_read_again(letters, monkeypatch):
    texts = [" ".join(f"{w}{i % 7} {w}xq" for i, w in enumerate(["idiot", "m0ron", "loser", "trash", "the", "with"], k)) for k in range(30)]
    index = {"idiot": 0, "moron": 1, "^thex": 2}
    whole = toxicity.Reader(letters, index)
    want = [whole.read(t) for t in texts]
    monkeypatch.setattr(toxicity, "MAX_MEMO", 3)
    short = toxicity.Reader(letters, index)
    assert [short.read(t) for t in texts] == want and all({0, 1, 2} <= w for w in want)
    assert whole.without and whole.memo and len(short.memo) + len(short.without) <= 3


def test_toxicity_learns_from_labels(spark):
    rng = random.Random(9)
    words = [f"{a}{b}" for a in ("ba", "lo", "mi", "ru") for b in ("ten", "sor", "vik", "pal")]
    rows, labels = [], []
    for i in range(300):
        w, bad = rng.choices(words, k=30), i % 4 == 0
        if bad:
            w[rng.randrange(30)] = rng.choice(["vileword", "v1leword", "v i l e w o r d"])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    labels += [(None, 1, 1), (5000, 1, None), (0, 1, 0)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.score(docs_of(spark, rows + ODD), table).collect()
    assert len(got) == len(rows) + len(ODD) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 300]
    assert held and all(r.predicted == (r.doc_id % 4 == 0) for r in held)
    assert toxicity.score(docs_of(spark, rows), table.limit(0)).where("predicted = 1").count() == 0
    assert toxicity.score(docs_of(spark, rows).limit(0), table).count() == 0


def test_toxicity_learns_from_every_label(spark):
    """The toxic rows come last by the hash that a sample of 20,000 was drawn by."""
    ids = spark.range(27_000).withColumnRenamed("id", "doc_id")
    trained = ids.where(toxicity.fold_of(F.col("doc_id")) != 0)
    last = {r.doc_id for r in trained.orderBy(F.xxhash64("doc_id").desc()).limit(12).collect()}
    bad = F.col("doc_id").isin(*last)
    docs = ids.select("doc_id", F.concat(F.lit("some plain text "), F.when(bad, "vileword").otherwise("row")).alias("text"))
    labels = ids.select("doc_id", bad.cast("int").alias("toxic"))
    asked = docs_of(spark, [(30_000 + i, "text with vileword" if i % 2 else "text with row") for i in range(6)])
    got = toxicity.score(docs.unionByName(asked.select("doc_id", "text")), labels).where("doc_id >= 30000").collect()
    assert len(got) == 6 and all(r.predicted == r.doc_id % 2 for r in got)


def test_logistic_weights_are_the_optimum(spark):
    rng = random.Random(3)
    rows = [(int(i % 3 == 0 or rng.random() < 0.2), sorted(rng.sample(range(6), rng.randrange(5))), rng.randrange(1, 9)) for i in range(200)]
    sets = spark.createDataFrame(rows, "toxic int, features array<int>, n long").repartition(3)
    weights, bias = toxicity.fit_weights(sets, 6)
    miss = np.array([n * (1 / (1 + np.exp(-bias - weights[f].sum())) - y) for y, f, n in rows])
    slope = [sum(m for m, (_, f, _) in zip(miss, rows) if j in f) + 0.3 * weights[j] for j in range(6)]
    assert abs(miss.sum()) < 1e-4 and np.abs(slope).max() < 1e-4
    assert toxicity.fit_weights(sets.limit(0), 6)[1] == -4.0
    weights, bias = toxicity.fit_weights(sets.where("toxic = 0"), 6)
    assert np.isfinite(weights).all() and bias < -4


# --- pipeline --------------------------------------------------------------------------------------


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline_stages(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "jaccard_join", "suffix_dedup", "best_fit_packing"]
    rng = random.Random(10)
    text = [" ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(120)) for _ in range(6)]
    rows = [(i, t) for i, t in enumerate(text)] + [(10, text[0]), (11, text[1] + " more"), (12, "too short"), (13, text[2].replace(" ", "  ", 1) + "\nnew line of words")]
    docs = docs_of(spark, rows).selectExpr("doc_id", "text", "lang", "source", "length(text) as n_chars")
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append(sorted(r.doc_id for r in docs.collect()))
    assert kept[0] == [0, 1, 2, 3, 4, 5, 10, 11, 13]
    assert kept[1] == [0, 1, 2, 3, 4, 5, 11, 13]
    assert kept[2] == [0, 1, 2, 3, 4, 5, 13]
    assert kept[3] == [0, 1, 2, 3, 4, 5, 13]
    bins = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert sum(b.n_tokens for b in bins) == 6 * 120 + 4
