"""Importance resampling, URL filters and spelling variants against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.llm import resampling, spelling, url_filter

ODD = [(None, "a b"), (900, None), (901, ""), (902, " \n\t "), (903, "é" * 3000), (904, "a b"), (904, "a b")]


def docs_of(spark, rows):
    """Documents with columns whose names clash with those that the operators use inside."""
    full = [(d, t, "en", 7, "x", 1) for d, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, word string, n long, score string, bucket long")


def id_order(d):
    return (d is not None, d or 0)


# --- importance resampling -------------------------------------------------------------------------


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
    return words, [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10000


def expected_draw(rows, target, percent=5, min_words=20):
    s = Counter(bucket(f) for _, t in rows for f in features(t)[1])
    t = Counter(bucket(f) for x in target for f in features(x)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    out = []
    for d, text in rows:
        words, fs = features(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (n_s + 10000.0) / ((s[b] + 1) * (n_t + 10000.0)))) for b in map(bucket, fs))
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(words), len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296.0)))])
    able = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], id_order(r[0]), r[2]))
    for i, r in enumerate(able):
        r.append(i + 1 if i < percent * len(able) // 100 else None)
    return sorted((tuple(r) if len(r) == 6 else (*r, None) for r in out), key=str)


def texts(rng, n):
    vocabulary = ["".join(rng.choice("abCDé1ß") for _ in range(rng.randint(1, 9))) for _ in range(40)] + ["x" * 130, "日本語"]
    return [rng.choice([" ", ", ", "\n", "!"]).join(rng.choices(vocabulary, k=rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("digit_bits, block_rows", [(16, 200_000), (5, 7)])
def test_draw(spark, digit_bits, block_rows):
    rng = random.Random(3)
    rows = list(enumerate(texts(rng, 60))) + ODD
    rows += [(5, rows[5][1]), (5, rows[6][1]), (None, rows[7][1]), (-(2**63), rows[8][1]), (2**63 - 1, rows[9][1])]
    target = texts(rng, 5) + [rows[3][1], None]
    aim = spark.createDataFrame([(i, x) for i, x in enumerate(target)], "item_id long, text string")
    docs = docs_of(spark, rows).repartition(3)
    got = resampling.resample(docs, aim, percent=40, digit_bits=digit_bits, block_rows=block_rows)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    want = expected_draw(rows, target, 40)
    assert sorted(map(tuple, got.collect()), key=str) == want
    drawn = resampling.sample(docs, aim, percent=40)
    assert drawn.columns == docs.columns
    numbers = [w[5] for w in want if w[5]]
    assert drawn.count() == len(numbers) == max(numbers) >= 15


@pytest.mark.parametrize("chunk", [1 << 20, 3, 17])
def test_codes_of_runs(monkeypatch, chunk):
    monkeypatch.setattr(resampling, "CHUNK", chunk)
    rng = random.Random(4)
    bodies = texts(rng, 12) + ["", "A", "z" * 5000 + " b", "", "É"]
    raw = [b.encode() for b in bodies]
    data = np.frombuffer(b"?" + b"".join(raw), np.uint8)
    offsets = np.cumsum([1] + [len(r) for r in raw])
    got = Counter()
    for i, j in resampling._groups(offsets):
        for codes, owner in resampling.run_codes(*resampling.word_codes(data, offsets[i : j + 1])):
            got.update((i + o, c) for o, c in zip(owner.tolist(), codes.tolist()))
    assert got == Counter((i, zlib.crc32(f.encode())) for i, b in enumerate(bodies) for f in features(b)[1])


def test_radix_positions(spark):
    rng = random.Random(6)
    values = [(rng.choice([None, -5, 3, 2**40, -(2**62)]), rng.randint(-3, 3), i) for i in range(200)]
    df = spark.createDataFrame(values, "a long, b long, i long").repartition(5)
    keys = [resampling.descending(F.col("b")), F.col("a").isNotNull().cast("long"), resampling.ascending(F.col("a"))]
    got = resampling.radix_positions(df, keys, digit_bits=7, block_rows=16).orderBy("position").collect()
    assert [r.position for r in got] == list(range(200))
    order = [(-r.b, id_order(r.a)) for r in got]
    assert order == sorted(order) and sorted(r.i for r in got) == list(range(200))
    same = resampling.radix_positions(df.withColumn("a", F.lit(1)), [F.col("a").cast("long")], digit_bits=7)
    assert sorted(r.position for r in same.collect()) == list(range(200))


def test_draw_of_nothing(spark):
    none, aim = docs_of(spark, []), spark.createDataFrame([], "item_id long, text string")
    assert resampling.resample(none, aim).count() == 0 and resampling.sample(none, aim).count() == 0
    few = resampling.resample(docs_of(spark, ODD), aim).collect()
    assert len(few) == len(ODD) and all(r.rank is None for r in few)


# --- URL filters -----------------------------------------------------------------------------------

URLS = [
    "http://a.example.org/es/1", "https://EXAMPLE.org/es/", "http://example.org/en/12?x", "http://example.org/en/2#top",
    "http://notexample.org/es/1", "http://org", "http://org/", "http://www.x.com/fr/1?a=1", "http://x.com/de/", "http://x.com/en/",
    "http://com/fr/", "http://spam-farm.net/p", "https://www.spam-farm.net/p/?utm_source=feed", "//x.com/a", "no url", "", None,
    "http://x.net/q?b=2&a=1&a=1&ref=x#f", "ftp://u@X.NET:80/q?a=1&b=2", "http://x.net/index.html", "http://x.net", "http://m.x.net/?",
    "http://example.org/Es/1", "a://b://c/d", "http://x.net/q?a=1", "http:///de/", "http://ü.net/é\nx",
]


def plain_parts(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", rest).groups()
    return lower(host), path


def plain_rule(host, path):
    fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


@pytest.mark.parametrize("max_blocks", [1 << 20, 1])
def test_urls(spark, max_blocks):
    rng = random.Random(8)
    many = [f"http://h{rng.randint(0, 30)}.net/{rng.randint(0, 40)}" for _ in range(600)]
    urls = URLS + many + URLS[:3]
    pages = spark.createDataFrame([(i, u, "k", True, 1) for i, u in enumerate(urls)], "page_id long, url string, canonical string, maybe boolean, f0 int")
    listed = ["https://www.h3.net/4/?utm_source=a", "http://x.net/q?a=1&b=2", "http://x.net", None, "", "http://spam-farm.net/p"] + many[::9] * 2
    block = spark.createDataFrame([(u, 1) for u in listed], "url string, page_id int")
    canonical = dict(spark.createDataFrame([(u,) for u in set(urls + listed)], "url string").select("url", url_filter.canonical(F.col("url"))).collect())
    names = {canonical[u] for u in listed} - {""}
    want = []
    for i, u in enumerate(urls):
        host, path = plain_parts(u)
        rule, verdict = plain_rule(host, path)
        hit = canonical[u] in names
        want.append((i, host, path, rule, verdict or ("block" if hit else "allow"), hit))
    got = url_filter.judge(pages, block, max_blocks=max_blocks)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict", "canonical", "is_listed"]
    assert sorted(tuple(r) for r in got.drop("canonical").collect()) == want
    assert sum(w[5] for w in want) > 50


def test_canonical_urls(spark):
    same = [
        ["http://x.net/q?a=1&b=2", "https://www.x.net/q/?b=2&a=1&utm_medium=m", "ftp://u@X.NET:80/q?a=1&b=2&a=1#f"],
        ["http://x.net", "http://x.net/", "https://m.x.net/index.html", "http://x.net:443/?ref=a"],
        ["", None, "x.net/q", "http://"],
    ]
    for group in same:
        rows = spark.createDataFrame([(u,) for u in group], "url string").select(url_filter.canonical(F.col("url")).alias("c")).distinct()
        assert rows.count() == 1
    others = ["http://x.net/Q", "http://x.net/q", "http://y.x.net/q", "http://x.net/q?reference=1", "http://www.net/q"]
    rows = spark.createDataFrame([(u,) for u in others], "url string").select(url_filter.canonical(F.col("url")).alias("c")).distinct()
    assert rows.count() == len(others)


def test_filter_passes_all_listed_and_few_others(spark):
    urls = spark.range(20_000).select(F.concat(F.lit("h/"), "id").alias("canonical"))
    listed = urls.limit(2_000).select(F.col("canonical").alias("listed_url"))
    bloom = url_filter.bloom_filter(listed, 200)
    passed = url_filter.possible(urls, "canonical", bloom, 200).where("maybe")
    assert bloom.count() <= 200
    assert passed.join(listed.withColumnRenamed("listed_url", "canonical"), "canonical").count() == 2_000
    assert passed.count() < 2_400


def test_urls_of_nothing(spark):
    pages = spark.createDataFrame([(1, "http://x.net/a"), (None, None)], "page_id long, url string")
    none = pages.limit(0)
    assert sorted(r.verdict for r in url_filter.judge(pages, none).collect()) == ["allow", "allow"]
    assert url_filter.judge(none, pages).count() == 0


# --- spelling variants -----------------------------------------------------------------------------


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def expected_groups(rows):
    counts = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 2 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n, len(near[w]), form[w], words[form[w]] if form[w] else None, root))
    return sorted(out)


@pytest.mark.parametrize("parts", [4, 3, 6])
def test_variants(spark, parts):
    rng = random.Random(9)
    base = ["".join(rng.choice("abcdeéÿß") for _ in range(rng.randint(4, 9))) for _ in range(12)] + ["aaaaa", "aaaaaa", "é" * 400]

    def edited(w):
        for _ in range(rng.choice([0, 0, 0, 0, 0, 1, 1, 2])):
            p = rng.randrange(len(w) + 1)
            w = w[:p] + rng.choice(["", "a", "é", "b"]) + w[p + rng.randint(0, 1) :]
        return w

    rows = [(i, " ".join(edited(rng.choice(base)) for _ in range(60)).title()) for i in range(40)] + ODD
    rows.append((501, "anchor " * 20 + "anchora " * 7 + "anchorab " * 3))  # a chain of forms
    got = spelling.group_variants(docs_of(spark, rows).repartition(3), parts=parts)
    assert got.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    want = expected_groups(rows)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert sum(w[3] is not None for w in want) > 30 and any(w[5] != w[3] for w in want if w[3])
    if parts == 4:
        sizes = Counter(w[5] for w in want)
        assert {r.root: r.n_words for r in spelling.members(got).collect()} == sizes


def test_variants_of_nothing(spark):
    assert spelling.group_variants(docs_of(spark, [])).count() == 0
    assert spelling.group_variants(docs_of(spark, ODD)).count() == 0
    alone = spelling.group_variants(docs_of(spark, [(1, "anchor anchor anchor other")])).collect()
    assert [tuple(r) for r in alone] == [("anchor", 3, 0, None, None, "anchor")]
