"""Line dedup: deletion-neighbourhood join within one edit.

Every variant of a line within the bound (the line itself, and the line without one character) becomes
a hashed key; lines whose keys meet are compared, the edit distance of each match is verified, and of
similar lines the earliest stays. "Earliest" is by (doc_id, line number), judged on the input: a line
goes when an equal line, or one within the bound, comes before it anywhere in the corpus.

The work is linear in the text. Equal lines are collapsed by digest first. Two lines within one edit share a
half, and of ``PIECES`` pieces all but one; keys of halves, then of all pieces but one, find the lines that
can have a neighbour and the piece where it can differ, and only there are variants made. Lines that meet in
a variant by deletion at one place differ in one character, so a key holds at most one line for each
character, and the minimum over a key replaces pairs: keys do not grow hot, whatever the number of copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.llm.shared import SPACE, SPACE_CHARS, key_of, store, text_of

#: Shorter lines only go when an equal line comes before: one edit makes another word of them.
MIN_SIMILAR = 20
#: Pieces of a line that is tested for the place where it may differ.
PIECES = 16
PLACE = ["id", "line_no"]


def normal_line(line):
    """Outer white space off, inner runs one space."""
    return F.regexp_replace(F.trim(line, F.lit(SPACE_CHARS)), SPACE, " ")


def occurrences(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """Every line with a word: place, digest and, if long enough, the four half keys; stored."""
    lines = docs.select(key_of(doc_id).alias("id"), F.posexplode(F.split(text_of(text), "\n")).alias("line_no", "raw"))
    lines = lines.select(*PLACE, normal_line(F.col("raw")).alias("line")).where("line <> ''")
    lines = lines.withColumn("n", F.char_length("line"))

    def half(base: str, side: str) -> str:
        cut = f"({base}) div 2"
        part = f"left(line, {cut})" if side == "first" else f"right(line, ({base}) - {cut})"
        return f"xxhash64({base}, '{side}', {part})"

    keys = ", ".join(half(base, side) for base in ("n", "n - 1") for side in ("first", "second"))
    long_enough = F.col("n") >= MIN_SIMILAR
    return store(lines.select(*PLACE, digest().alias("digest"), F.when(long_enough, F.expr(f"array({keys})")).alias("halves")), "lines")


def digest(column: str = "line"):
    return F.unhex(F.md5(F.col(column).cast("binary")))


def shared_keys(keyed: DataFrame, key: list[str], line: str) -> DataFrame:
    """Rows of ``keyed`` whose key two different lines have. Dealt by key once, for the count and the rows."""
    dealt = keyed.dropna(subset=key).repartition(*[F.col(k) for k in key])  # the join's filter: one exchange for both uses
    shared = dealt.groupBy(*key).agg(F.min(line).alias("least"), F.max(line).alias("most")).where("least <> most")
    return dealt.join(shared.select(*key), key)  # inner: a semi join would move below the exchange


def with_partners(places: DataFrame) -> DataFrame:
    """``digest, first`` of distinct lines that share a half with another one."""
    long_lines = places.where("halves is not null")
    keyed = long_lines.select(F.xxhash64("digest").alias("line"), F.explode("halves").alias("half"))
    found = shared_keys(keyed, ["half"], "line").select("line").distinct()
    lines = long_lines.groupBy("digest").agg(F.min(F.struct(*PLACE)).alias("first"))
    return lines.withColumn("line", F.xxhash64("digest")).join(found, "line", "left_semi").drop("line")


def with_texts(docs: DataFrame, chosen: DataFrame, text: str, doc_id: str) -> DataFrame:
    """``digest, first, line`` of chosen lines, cut out of the document of their first place; stored."""
    wanted = chosen.groupBy(F.col("first.id").alias("id")).agg(F.collect_list(F.struct("first.line_no", "digest", "first")).alias("wanted"))
    bodies = docs.select(key_of(doc_id).alias("id"), text_of(text).alias("body"))
    lines = bodies.join(wanted, "id").select(F.split("body", "\n").alias("body"), "wanted")
    lines = lines.select("body", F.inline("wanted"))
    lines = lines.select("digest", "first", normal_line(F.get("body", F.col("line_no"))).alias("line"))
    # rows that repeat a doc_id: the digest tells which of them holds the line
    return store(lines.where(F.col("digest") == digest()).dropDuplicates(["digest"]), "similar")


def differing_pieces(lines: DataFrame) -> DataFrame:
    """``digest, first, line, from, upto``: places where a line may differ from another one, from piecewise keys.

    A line is cut at the same places as a neighbour of its length, and as one a character shorter: then the
    pieces behind the one with the extra character start one place later.
    """

    def piece(shift: int) -> str:
        at, end = f"i * base div {PIECES}", f"(i + 1) * base div {PIECES}"
        return f"transform(sequence(0, {PIECES - 1}), i -> xxhash64(i, substr(line, {at} + {1 + shift}, {end} - {at})))"

    based = lines.withColumn("n", F.char_length("line"))
    based = based.withColumn("base", F.explode(F.array("n", F.col("n") - 1)))
    based = based.withColumn("still", F.expr(piece(0))).withColumn("moved", F.expr(piece(1)))
    based = based.withColumn("behind", F.when(F.col("base") == F.col("n"), F.col("still")).otherwise(F.col("moved")))
    based = based.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(PIECES - 1))))
    rest = F.expr("concat(slice(still, 1, piece), slice(behind, piece + 2, size(behind)))")
    keyed = based.select("digest", "n", "base", "piece", F.xxhash64(rest).alias("rest"))
    met = shared_keys(keyed, ["base", "piece", "rest"], "digest")
    spans = met.select(
        "digest",
        F.expr(f"piece * base div {PIECES}").alias("from"),
        F.expr(f"(piece + 1) * base div {PIECES} - 1 + n - base").alias("upto"),
    )
    return lines.join(spans.distinct(), "digest")


def variants(lines: DataFrame) -> DataFrame:
    """``key, place, digest, first``: the line itself (no place), and without the character at ``place``."""
    spans = differing_pieces(lines)
    itself = spans.select("digest", "first", "line").distinct()
    itself = itself.select(digest().alias("key"), F.lit(None).cast("int").alias("place"), "digest", "first")
    places = spans.select("digest", "first", "line", F.explode(F.sequence("from", "upto")).alias("place"))
    without = F.expr("concat(left(line, place), substr(line, place + 2))").alias("without")
    deleted = places.select("place", "digest", "first", without)
    return itself.unionByName(deleted.select(digest("without").alias("key"), "place", "digest", "first").distinct())


def earlier_neighbours(lines: DataFrame) -> DataFrame:
    """Digests of lines with an earlier line within one edit."""
    keyed = variants(lines).withColumn("entry", F.struct("first", "digest"))
    same_place = Window.partitionBy("key", "place")
    same_key = Window.partitionBy("key")
    is_line = F.col("place").isNull()
    met = keyed.withColumn("changed", F.min(F.when(~is_line, F.col("entry"))).over(same_place))
    met = met.withColumn("shorter", F.min(F.when(is_line, F.col("entry"))).over(same_key))
    met = met.withColumn("longer", F.min(F.when(~is_line, F.col("entry"))).over(same_key))
    # a line meets the lines that become it; a line without one character meets its like and that line
    met = met.withColumn("near", F.when(is_line, F.col("longer")).otherwise(F.least("changed", "shorter")))
    pairs = met.where("near.first < first").select("digest", F.col("near.digest").alias("other")).distinct()
    mine = lines.select("digest", "line")
    theirs = lines.select(F.col("digest").alias("other"), F.col("line").alias("other_line"))
    close = pairs.join(mine, "digest").join(theirs, "other").where("levenshtein(line, other_line, 1) between 0 and 1")
    return close.select("digest").distinct()


def removed_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``id, removed``: per document with removed lines, their numbers."""
    places = occurrences(docs, text, doc_id)
    lines = places.groupBy("digest").agg(F.min(F.struct(*PLACE)).alias("first"), F.count("*").alias("copies"))
    near = earlier_neighbours(with_texts(docs, with_partners(places), text, doc_id)).withColumn("near", F.lit(True))
    touched = lines.join(near, "digest", "left").where("copies > 1 or near").select("digest", "first", "near")
    gone = places.select(*PLACE, "digest").join(touched, "digest").where("near or struct(id, line_no) <> first")
    return gone.groupBy("id").agg(F.collect_set("line_no").alias("removed"))


def drop_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with repeated lines taken out of the text, and ``n_lines, n_removed``.

    Blank lines stay; a document may end up empty but keeps its row. A null text stays null, with no
    lines. Rows that repeat a doc_id are one place: their lines do not remove each other, unless they
    stand at different line numbers. A row without doc_id comes before all others. Input columns named
    as the added ones are replaced.
    """
    removed = removed_lines(docs, text, doc_id)
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key_of(doc_id).alias("id"))
    body = F.split(F.col("row").getField(text), "\n")
    joined = row.join(removed, "id", "left").withColumn("body", body)
    kept = F.expr("filter(body, (line, i) -> not array_contains(removed, i))")
    joined = joined.withColumn("left_over", F.when(F.col("removed").isNull(), F.col("body")).otherwise(kept))
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return joined.select(
        *[(F.array_join("left_over", "\n") if c == text else F.col("row").getField(c)).alias(c) for c in names],
        F.coalesce(F.size("body"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("body") - F.size("left_over"), F.lit(0)).cast("long").alias("n_removed"),
    )


def report(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_lines, n_removed and the SHA-256 of what is left."""
    out = drop_lines(docs.select("doc_id", text_of().alias("text")))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def clean(docs: DataFrame) -> DataFrame:
    """Pipeline form: the columns of ``docs``, with ``n_chars`` that of the new text; emptied rows go."""
    out = drop_lines(docs)
    emptied = (F.col("n_removed") > 0) & (F.trim("text", F.lit(SPACE_CHARS)) == "")
    out = out.where(~emptied).withColumn("n_chars", F.char_length("text").cast("long"))
    return out.select(*docs.columns)


def oracle_sql(relation: str = "documents") -> str:
    """Brute force over distinct lines of like length that share a half, checked by position."""
    return rf"""
  with recursive t as (select doc_id, coalesce(text, '') as text from {relation}),
  ls as (select doc_id, u.i - 1 as line_no, trim(regexp_replace(parts[u.i], '[\x20\x09-\x0D]+', ' ', 'g')) as line
         from (select doc_id, string_split(text, chr(10)) as parts from t), unnest(range(1, len(parts) + 1)) u(i)),
  ws as (select * from ls where line <> ''),
  d as (select line, length(line) as n, min((doc_id, line_no)) as first from ws group by line),
  c as (select a.line, a.n, b.line as other, b.n as m from d a join d b
        on a.n = b.n and left(a.line, a.n // 2) = left(b.line, a.n // 2) where a.n >= {MIN_SIMILAR} and a.line <> b.line and b.first < a.first
        union select a.line, a.n, b.line, b.n from d a join d b
        on a.n = b.n and right(a.line, a.n - a.n // 2) = right(b.line, a.n - a.n // 2) where a.n >= {MIN_SIMILAR} and a.line <> b.line and b.first < a.first
        union select a.line, a.n, b.line, b.n from d a join d b
        on a.n = b.n + 1 and left(a.line, b.n // 2) = left(b.line, b.n // 2) where b.n >= {MIN_SIMILAR} and b.first < a.first
        union select a.line, a.n, b.line, b.n from d a join d b
        on a.n = b.n + 1 and right(a.line, b.n - b.n // 2) = right(b.line, b.n - b.n // 2) where b.n >= {MIN_SIMILAR} and b.first < a.first
        union select a.line, a.n, b.line, b.n from d a join d b
        on a.n + 1 = b.n and left(a.line, a.n // 2) = left(b.line, a.n // 2) where a.n >= {MIN_SIMILAR} and b.first < a.first
        union select a.line, a.n, b.line, b.n from d a join d b
        on a.n + 1 = b.n and right(a.line, a.n - a.n // 2) = right(b.line, a.n - a.n // 2) where a.n >= {MIN_SIMILAR} and b.first < a.first),
  near as (select distinct line from c where len(list_filter(range(0, least(n, m) + 1), lambda i:
           left(line, i) = left(other, i) and
           case when n = m then i < n and right(line, n - i - 1) = right(other, n - i - 1)
                when n < m then right(line, n - i) = right(other, n - i)
                else right(line, m - i) = right(other, m - i) end)) > 0),
  gone as (select distinct doc_id, line_no from ws join d using (line) left join near using (line)
           where near.line is not null or (doc_id, line_no) <> first),
  kept as (select ls.doc_id, count(*) as n_lines, count(gone.doc_id) as n_removed
           from ls left join gone using (doc_id, line_no) group by ls.doc_id),
  parts as (select t.doc_id, u.i - 1 as line_no, p[u.i] as raw from (select doc_id, string_split(text, chr(10)) as p from t) t,
            unnest(range(1, len(p) + 1)) u(i)),
  texts as (select parts.doc_id, string_agg(raw, chr(10) order by line_no) as left_over from parts
            left join gone using (doc_id, line_no) where gone.doc_id is null group by parts.doc_id)
  select doc_id, n_lines, n_removed, sha256(coalesce(left_over, '')) as kept_sha256 from kept left join texts using (doc_id)"""
