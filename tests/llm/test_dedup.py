"""Exact, line, suffix-array and near-copy dedup against brute force, with nulls, ties and clashing names."""

import hashlib
import random
import re

import numpy as np
import pytest

from cohortloom.llm import components, exact_dedup, jaccard_join, line_dedup, suffix_dedup

LAST = -(2**63)
ODD = [(None, "a b"), (200, None), (201, ""), (202, " \t "), (203, "x" * 99), (204, "x" * 301)]


def frame(spark, rows):
    """Documents with columns whose names clash with those that the operators use inside."""
    rows = [(d, t, i, "n", None, "r") for i, (d, t) in enumerate(rows)]
    return spark.createDataFrame(rows, "doc_id long, text string, id long, line string, n_removed long, row string")


def values(df, *names):
    return sorted(map(str, [tuple(r) for r in df.select(*names).collect()]))


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    passages = [" ".join(rng.choice(words) for _ in range(rng.randint(20, 60))) for _ in range(6)]
    out = []
    for i in range(60):
        parts = [rng.choice(passages) if rng.random() < 0.6 else " ".join(rng.choices(words, k=rng.randint(1, 40))) for _ in range(rng.randint(1, 4))]
        if i % 9 == 0:
            parts = ["ab" * 150, parts[0], parts[0]]
        out.append((i, rng.choice(["\n", " "]).join(parts)))
    return out + ODD + [(70, out[3][1]), (71, out[3][1].upper()), out[4]]


def test_exact(spark, docs):
    groups = {}
    key = {}
    for d, t in docs:
        digest = hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()
        key[(d, t)] = digest
        groups.setdefault(digest, []).append(LAST if d is None else d)
    want = []
    for d, t in docs:
        g = groups[key[(d, t)]]
        keep = min(g)
        want.append((d, None if keep == LAST else keep, len(g), (LAST if d is None else d) == keep, key[(d, t)]))
    df = frame(spark, docs)
    for fan_in, parts in ((2, 7), (16, 3), (3, 1)):
        got = exact_dedup.find_copies(df.repartition(parts), fan_in=fan_in)
        assert values(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(map(str, want))


def near(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def test_lines(spark):
    rng = random.Random(7)
    base = ["".join(rng.choice("abcdeé ") for _ in range(rng.randint(18, 60))) for _ in range(20)]

    def edited(x):
        x = list(x)
        for _ in range(rng.choice([0, 1, 1, 2])):
            p = rng.randrange(len(x))
            x[p : p + rng.randint(0, 1)] = rng.choice(["", "a", "é"])
        return "".join(x)

    rows = [(i, "\n".join(edited(rng.choice(base)) if rng.random() < 0.8 else rng.choice(["", " ", "ab"]) for _ in range(rng.randint(0, 7)))) for i in range(60)]
    rows += ODD + [rows[3]]

    def normal(x):
        return re.sub(r"[\x20\x09-\x0D]+", " ", x.strip(" \t\n\x0b\x0c\r"))

    places = [(LAST if d is None else d, j, normal(x)) for d, t in rows for j, x in enumerate((t or "").split("\n")) if normal(x)]
    gone = {
        (d, j)
        for d, j, x in places
        if any((e, k) < (d, j) and (x == y or (min(len(x), len(y)) >= line_dedup.MIN_SIMILAR and near(x, y))) for e, k, y in places)
    }
    want = []
    for d, t in rows:
        lines = [] if t is None else t.split("\n")
        kept = [x for j, x in enumerate(lines) if (LAST if d is None else d, j) not in gone]
        want.append((d, None if t is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    got = line_dedup.drop_lines(frame(spark, rows))
    assert len(gone) > 50
    assert got.columns == ["doc_id", "text", "id", "line", "row", "n_lines", "n_removed"]
    assert values(got, "doc_id", "text", "n_lines", "n_removed") == sorted(map(str, want))


def removed(docs, length):
    seen, out = {}, []
    for d, t in sorted(docs, key=lambda x: LAST if x[0] is None else x[0]):
        body = (t or "").encode()
        gone = np.zeros(len(body), bool)
        for p in range(len(body) - length + 1):
            place = seen.setdefault(body[p : p + length], (d, p))
            if place != (d, p):
                gone[p : p + length] = True
        kept = bytes(np.frombuffer(body, np.uint8)[~gone])
        spans = int(np.count_nonzero(np.diff(np.append(False, gone).astype(int)) == 1))
        out.append((d, len(body), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(map(str, out))


@pytest.mark.parametrize("spread, shard_bytes", [(20_000, 8_000_000), (3, 2_000)])
def test_suffixes(spark, docs, spread, shard_bytes):
    got = suffix_dedup.remove_repeats(frame(spark, docs), spread=spread, shard_bytes=shard_bytes)
    assert values(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == removed(docs, 100)
    assert "left_over" in got.columns and got.where("text is null").count() == 1


def test_repeats_that_overlap_themselves(spark):
    rng = random.Random(13)

    def text(n):
        return "".join(rng.choices("abcdefghijklmnop ", k=n))

    rows = []
    for size in (101, 110, 120, 137, 150, 163):
        for period in (1, 2, 3, 7, 20, 36, 37, 38, 50, 62):
            body = (text(period) * size)[:size]
            rows += [(len(rows), body), (len(rows) + 1, text(40) + (text(period) * size)[:size] + text(150))]
    rows += [(500, "=" * 120), (501, text(200) + "ha " * 45 + text(99)), (502, "-+" * 60)]
    got = suffix_dedup.remove_repeats(frame(spark, rows))
    assert values(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == removed(rows, 100)


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(1)
    for size in (1, 5, 300):
        data = rng.integers(97, 100, size).astype(np.uint8)
        text = data.tobytes()
        order, opening = suffix_dedup.suffix_array(data, 100)
        cut = [text[i : i + 100] for i in order]
        assert cut == sorted(cut)
        shared = suffix_dedup.common_prefixes(data, order, opening, np.array([0]), np.array([size]), 100)

        def common(a, b):
            return next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))

        assert shared[1:].tolist() == [min(100, common(text[a:], text[b:])) for a, b in zip(order, order[1:])]


def test_similar_groups(spark, docs):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    base = [rng.choices(words, k=rng.choice([3, 9, 12, 40, 120])) for _ in range(12)]
    rows = []
    for i in range(90):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i, rng.choice([" ", "\n"]).join(w).swapcase() if i % 5 else " ".join(w)))
    rows += ODD

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        return {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()

    sets = [(LAST if d is None else d, shingles(t)) for d, t in rows]
    label = {d: d for d, _ in sets}
    changed = True
    while changed:
        changed = False
        for d, a in sets:
            for e, b in sets:
                if a and b and 100 * len(a & b) >= 85 * len(a | b) and label[e] < label[d]:
                    label[d], changed = label[e], True
    want = [(d, len(s), None if label[LAST if d is None else d] == LAST else label[LAST if d is None else d]) for (d, _), (_, s) in zip(rows, sets)]
    got = jaccard_join.similar_groups(frame(spark, rows))
    assert len(set(label.values())) < len(label) - 10
    assert values(got, "doc_id", "n_shingles", "component_id") == sorted(map(str, want))


def test_signatures_meet_whenever_sets_are_similar():
    rng, bands = random.Random(1), jaccard_join.Bands()
    tried = 0
    for _ in range(2000):
        a = {rng.getrandbits(64) for _ in range(rng.choice([1, 5, 6, 7, 8, 9, 12, 13, 20, 40, 150, 400]))}
        b = set(a)
        for _ in range(rng.randint(0, max(1, len(a) // 5))):
            if rng.random() < 0.5 and len(b) > 1:
                b.pop()
            if rng.random() < 0.7:
                b.add(rng.getrandbits(64))
        if 100 * len(a & b) >= 85 * len(a | b):
            tried += 1
            x, y = (jaccard_join.signatures(np.array(sorted(s), np.uint64), bands) for s in (a, b))
            assert set(x.tolist()) & set(y.tolist())
    assert tried > 1000


def test_profiles_bound_what_sets_share():
    rng = random.Random(4)
    for _ in range(500):
        pool = [rng.getrandbits(64) for _ in range(rng.choice([3, 20, 300, 3000]))]
        a, b = (np.array(sorted(set(rng.sample(pool, rng.randint(1, len(pool))))), np.uint64) for _ in range(2))
        most = jaccard_join.most_common(len(a), jaccard_join.profile(a), len(b), jaccard_join.profile(b))
        assert len(np.intersect1d(a, b)) <= most <= min(len(a), len(b))
    crowd = np.arange(300, dtype=np.uint64) * np.uint64(1 << 40)  # all in one bucket
    assert len(jaccard_join.profile(crowd)) == 0 and jaccard_join.most_common(300, jaccard_join.profile(crowd), 200, jaccard_join.profile(crowd[:200])) == 200
    assert jaccard_join.profile(np.zeros(0, np.uint64)).sum() == 0


def test_links_between_members_that_met_another(spark):
    """Documents that each share passages with one, and are near copies among themselves, in blocks of two."""
    rng = random.Random(21)
    shared = [f"s{i}" for i in range(120)]
    rows = [(0, " ".join(shared))]
    for g in range(6):
        own = shared[g : g + 100] + [f"g{g}x{i}" for i in range(25)]
        for k in range(5):
            w = list(own)
            w[rng.randrange(len(w))] = f"v{g}{k}"
            rows.append((len(rows), " ".join(w)))
    df = frame(spark, rows)
    want = values(jaccard_join.similar_groups(df), "doc_id", "component_id")
    old = jaccard_join.BLOCK
    sets = [set(zip(*[t.split()[i:] for i in range(4)])) for _, t in rows]
    label = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if 100 * len(a & b) >= 85 * len(a | b):
                    label[i] = min(label[i], label[j])
    assert want == sorted(map(str, [(i, c) for i, c in enumerate(label)]))
    compared = spark.createDataFrame([(0, i) for i in range(1, len(rows))], "a long, b long")
    none = spark.createDataFrame([], "id long, component long")
    body = jaccard_join.bodies(df, "text", "doc_id")
    open_ = jaccard_join.still_open(compared, none, jaccard_join.set_sizes(body), block=4)
    links = jaccard_join.across_components(open_, none, jaccard_join.full_sets(body), block=4)
    got = {r.id: r.component for r in components.components(links).collect()}
    assert got == {i: c for i, c in enumerate(label) if i and label.count(c) > 1 and c > 0} and jaccard_join.BLOCK == old


def test_one_of_each_group_stays(spark):
    body = " ".join(f"w{i}" for i in range(40))
    rows = [(None, body), (5, body), (7, body + " x"), (9, "other words here"), (9, "more of them"), (11, None), (12, ""), (None, "alone it stands here")]
    kept = jaccard_join.keep_one(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert values(kept, "doc_id", "text") == sorted(map(str, [rows[0], rows[3], rows[4], rows[5], rows[6], rows[7]]))
    assert jaccard_join.keep_one(frame(spark, []).limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.range(1, 60).selectExpr("id as a", "id + 1 as b").union(spark.createDataFrame([(90, 80), (81, 90)], "a long, b long"))
    got = {r.id: r.component for r in components.components(links).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 80: 80, 81: 80, 90: 80}


@pytest.mark.parametrize("operator", [exact_dedup.find_copies, line_dedup.drop_lines, suffix_dedup.remove_repeats, jaccard_join.similar_groups])
def test_empty_table(spark, operator):
    assert operator(frame(spark, []).limit(0)).count() == 0
