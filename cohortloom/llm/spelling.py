"""Spelling variants: words one edit apart, grouped under the most frequent form.

Words that differ by one code point have letter multisets that differ little: as binary vectors, with one
coordinate for each letter and occurrence (the second ``e`` of a word is a coordinate of its own), a replaced
letter is a Hamming distance of two at equal length, an inserted or deleted one a distance of one between
neighbouring lengths. Each of the two size bands has exact PartEnum signatures. The coordinates are dealt into
``PARTS`` partitions; two vectors at distance k differ in at most k of them, so they agree on what is left after
dropping the right k. A signature is the vector without k partitions, for every choice of the k: all close pairs
share one.

One edit also leaves the first or the second half of a word in its place. Each signature is therefore emitted
once with either half, which keeps the words of a common multiset apart and loses nothing. Signatures are joined
by equality, the edit distance of candidates is verified, and only true links go on.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.shared import lower_ascii, store, text_of

RUN = r"[A-Za-zÀ-ÿ]+"
#: One run in this many loses a letter, by the contract's rule.
DELETED = 97
MIN_LETTERS = 5
MIN_COUNT = 3
#: How much more frequent a form is than its variant.
RATIO = 2
#: Partitions of the coordinates.
PARTS = 4


def runs_of(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(text), F.lit(RUN), F.lit(0))


def word_counts(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT
) -> DataFrame:
    """``word, n`` of the words that are long and frequent enough, over all texts. Counts are combined per task."""
    name = F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"))
    runs = docs.select(name.alias("name"), F.explode(runs_of(text_of(text))).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat("name", "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), at), F.substr(F.col("run"), at + 2))
    words = hashed.select(F.when(F.col("h") % DELETED == 0, cut).otherwise(F.col("run")).alias("word"))
    counts = words.where(F.char_length("word") >= min_letters).groupBy("word").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= min_count)


def partition_vectors(word: str = "word", parts: int = PARTS) -> Column:
    """An array with one number for each partition: the set of its coordinates that the word has.

    A coordinate is a letter with its occurrence. Those of a word are all different, so the exclusive or of
    their hashes stands for the set.
    """
    return F.expr(f"""
      aggregate(
        transform(array_sort(regexp_extract_all({word}, '(?s).', 0)), (c, i) -> struct(c, i)),
        named_struct('last', '', 'k', 0L, 'v', array_repeat(0L, {parts})),
        (a, e) -> named_struct(
          'last', e.c,
          'k', if(e.c = a.last, a.k + 1L, 0L),
          'v', transform(a.v, (x, j) -> if(pmod(xxhash64(e.c, if(e.c = a.last, a.k + 1L, 0L)), {parts}) = j,
              x ^ xxhash64(if(e.c = a.last, a.k + 1L, 0L), e.c), x))),
        a -> a.v)""")


def signatures(words: DataFrame, parts: int = PARTS) -> DataFrame:
    """``key, role, word``: role 0 meets itself; 1 meets 2, the shorter and the longer word of a pair.

    Keys hold the band, the length (of the shorter word), what was dropped, what is left, and a half.
    """
    rows = words.select("word", F.char_length("word").alias("l"), partition_vectors("word", parts).alias("v"))
    found = []
    for role, dropped in ((0, 2), (1, 1), (2, 1)):
        size = F.col("l") - (1 if role == 2 else 0)
        front = F.call_function("div", size, F.lit(2)).cast("int")
        back = (size - front).cast("int")
        halves = [F.left("word", front), F.right("word", back)]
        for drop in combinations(range(parts), dropped):
            left = [F.get("v", F.lit(i)) for i in range(parts) if i not in drop]
            for side, half in enumerate(halves):
                what = F.lit(f"{min(role, 1)}:{drop}:{side}")
                found.append(F.struct(F.xxhash64(what, size, *left, half).alias("key"), F.lit(role).alias("role")))
    return rows.select("word", F.explode(F.array(*found)).alias("s")).select("s.key", "s.role", "word")


def near_pairs(words: DataFrame, parts: int = PARTS) -> DataFrame:
    """``a, b``: every pair of words one edit apart, once."""
    keyed = store(signatures(words, parts), "signatures")
    # a key held by one word joins nothing; the others go on
    left = keyed.select("key", "role", F.col("word").alias("a")).where("role < 2")
    right = keyed.select("key", F.col("role").alias("other"), F.col("word").alias("b")).where("other <> 1")
    same = (F.col("role") == 0) & (F.col("other") == 0) & (F.col("a") < F.col("b"))
    met = left.join(right, "key").where(same | ((F.col("role") == 1) & (F.col("other") == 2)))
    return met.where(F.levenshtein("a", "b", 1) == 1).select("a", "b").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for every word that has a form (columns ``word, form``): the end of its chain.

    A form is more frequent than its word, so chains end. Each round doubles the step.
    """
    state = store(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        state = store(state.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if state.where("moved").isEmpty():
            return state.select("word", "root")
        state = state.select("word", "root")


def group_variants(
    docs: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, ratio: int = RATIO, parts: int = PARTS
) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of every frequent word of the whole texts of ``docs``.

    A word's form is its most frequent near word (ties: smallest in code-point order) if that occurs at least
    ``ratio`` times as often. Null and empty texts have no words; a missing id is the empty text in the rule that
    deletes letters; repeated rows count again; no frequent words, or an empty table, give no rows. Other columns
    are not looked at.
    """
    words = store(word_counts(docs, min_letters=min_letters, min_count=min_count), "words")
    pairs = store(near_pairs(words, parts), "near")
    both = pairs.union(pairs.select("b", "a"))
    counted = both.join(words.select(F.col("word").alias("b"), F.col("n").alias("m")), "b")
    # the least of a struct: largest count first, then the smallest word
    best = counted.groupBy(F.col("a").alias("word")).agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("b").alias("b"))).alias("best")
    )
    out = words.join(best, "word", "left")
    known = -F.col("best.m") >= ratio * F.col("n")
    out = store(
        out.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(known, F.col("best.b")).alias("form"), F.when(known, -F.col("best.m")).alias("form_n"),
        ),
        "forms",
    )
    ends = roots(out.where("form is not null"))
    return out.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))


def members(variants: DataFrame) -> DataFrame:
    """``root, n_words, n``: the groups of :func:`group_variants`, their size and how often they occur."""
    return variants.groupBy("root").agg(F.count("*").alias("n_words"), F.sum("n").alias("n"))


def oracle_sql() -> str:
    """The same from DuckDB; near words by their common deletions, at one place for replaced letters."""
    return r"""
  with recursive tab as (select list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
      lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as tab),
  r as materialized (select name, run, count(*) as c from (select coalesce(doc_id::varchar, '') as name, unnest(regexp_extract_all(translate(
      coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) as run from documents) group by all),
  x as (select name, run, c, list_transform(range(octet_length(encode(name || ':' || run))),
      lambda i: ('0x' || substr(hex(name || ':' || run), (2 * i + 1)::int, 2))::bigint) as bytes from r),
  h as (select run, c, xor(list_reduce(list_concat([4294967295], bytes),
      lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) as h from x, tab),
  e as (select case when h % 97 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, c from h),
  w as materialized (select word, sum(c)::bigint as n from e where length(word) >= 5 group by word having sum(c) >= 3),
  del as (select distinct word, i, substr(word, 1, i) || substr(word, i + 2) as d from w, unnest(range(length(word))) u(i)),
  near as materialized (select distinct a, b from (
      select p.word as a, q.word as b from del p join del q on p.d = q.d and p.i = q.i and p.word <> q.word
      union all select p.word, w.word from del p join w on p.d = w.word
      union all select w.word, p.word from del p join w on p.d = w.word)),
  best as (select a as word, count(*) as n_near, min(struct_pack(m := -n, b := b)) as best from near join w on w.word = b group by a),
  f as materialized (select word, n, coalesce(n_near, 0)::bigint as n_near, case when -best.m >= 2 * n then best.b end as form,
      case when -best.m >= 2 * n then -best.m end as form_n from w left join best using (word)),
  chain as (select word, word as at from f union all select c.word, f.form from chain c join f on f.word = c.at where f.form is not null),
  last as (select c.word, c.at as root from chain c join f on f.word = c.at where f.form is null)
  select f.word, n, n_near, form, form_n, root from f join last using (word)"""
