"""URL filters: host and path rules, then a list of blocked URLs behind a blocked Bloom filter.

A URL that no rule judges is blocked when its canonical form is on the list. The list becomes a blocked Bloom
filter: every listed URL sets eight bits within one block of 256, chosen by its hash. The filter is a table of
at most ``MAX_BLOCKS`` blocks of four longs, 64 MB with Spark's overhead whatever the list's length, and is
broadcast; so the test of a URL costs one look-up where the URL was read, and only possible hits travel on.
The rest is exact: distinct possible hits meet the list in a hash join that removes what the filter let through
by chance, and the confirmed ones are attached to their rows. A list too long for the filter lets more through and
loses nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.shared import lower_ascii, store
from cohortloom.operators.joins import keyed_join

#: Fixed: the rules of the result contract, as host, start of the path, verdict.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
MAX_BLOCKS = 1 << 20
#: Listed URLs for each block; 25 bits a URL.
PER_BLOCK = 10
#: Ways that the rows of one URL are dealt, so that no URL fills a task.
SPREAD = 16
WORDS = ("f0", "f1", "f2", "f3")
#: Parameters that name where a visitor came from, not what is shown.
TRACKING = r"^(utm_.*|ref|fbclid|gclid)(=.*)?$"
#: Labels of hosts whose pages make up the list of the registered query.
LISTED_HOSTS = r"(^|[.-])(spam|farm|pills|casino|cheap|bet|porn)([.-]|$)"


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``, null for none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """One form for all spellings of an address; empty where there is no host.

    No scheme, user, default port, fragment or tracking parameter; lower-case host without a leading ``www`` or
    ``m``; no ``index.html`` or slash at the end of the path; parameters in order, each once.
    """
    host = F.regexp_replace(host_of(url), r"^.*@|:(80|443)?$", "")
    host = F.regexp_replace(F.regexp_replace(host, r"\.$", ""), r"^(www|m)\.(?=.*\.)", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"/index\.html?$", "/"), r"/+$", "")
    query = F.regexp_extract(after_scheme(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    kept = F.array_sort(F.array_distinct(kept))
    asked = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(host == "", "").otherwise(F.coalesce(F.concat(host, path, asked), F.lit("")))


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null for none. Of equally long ones the longer host wins.

    The rules are part of the expression, so they are meant to be few; long lists belong in the list of URLs.
    """
    best, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, judged in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        best = F.when(fits, h + p).otherwise(best)
        verdict = F.when(fits, judged).otherwise(verdict)
    return best, verdict


def probe(url: Column, n_blocks: int) -> tuple[Column, list[Column]]:
    """Block of a URL and the bits it sets in each of the block's four words, two of 64 each."""
    block = F.pmod(F.xxhash64(url), F.lit(n_blocks))
    bits = F.xxhash64(F.lit("bits"), url)

    def bit(k: int) -> Column:
        at = F.shiftrightunsigned(bits, 6 * k).bitwiseAND(F.lit(63)).cast("int")
        return F.call_function("shiftleft", F.lit(1).cast("long"), at)

    return block, [bit(2 * j).bitwiseOR(bit(2 * j + 1)) for j in range(len(WORDS))]


def bloom_filter(listed: DataFrame, n_blocks: int) -> DataFrame:
    """``f_block`` and its four words, stored: no more than ``n_blocks`` rows, combined before the shuffle."""
    block, masks = probe(F.col("listed_url"), n_blocks)
    rows = listed.select(block.alias("f_block"), *[m.alias(w) for m, w in zip(masks, WORDS)])
    return store(rows.groupBy("f_block").agg(*[F.bit_or(w).alias(w) for w in WORDS]), "bloom")


def possible(rows: DataFrame, url: str, bloom: DataFrame, n_blocks: int) -> DataFrame:
    """``rows`` with ``maybe``: whether the filter passes their URL. The empty URL never passes."""
    block, masks = probe(F.col(url), n_blocks)
    found = rows.withColumn("f_block", block).join(F.broadcast(bloom), "f_block", "left")
    hit = F.col(url) != ""
    for word, mask in zip(WORDS, masks):
        hit = hit & (F.col(word).bitwiseAND(mask) == mask)
    return found.withColumn("maybe", F.coalesce(hit, F.lit(False))).drop("f_block", *WORDS)


def listed_rows(rows: DataFrame, listed: DataFrame, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """``rows`` (with ``canonical``) and ``is_listed``; ``listed`` has URLs in canonical form as ``listed_url``."""
    names = store(listed.where("listed_url <> ''").select("listed_url").distinct(), "listed")
    n_blocks = max(1, min(max_blocks, -(-names.count() // PER_BLOCK)))
    # written once: the rows' expressions would otherwise be evaluated for each use
    seen = store(possible(rows, "canonical", bloom_filter(names, n_blocks), n_blocks), "possible")
    hits = seen.where("maybe")
    asked = hits.select(F.col("canonical").alias("listed_url")).distinct()
    confirmed = asked.join(names, "listed_url", "left_semi").withColumn("is_listed", F.lit(True))
    confirmed = store(confirmed.withColumnRenamed("listed_url", "canonical"), "confirmed")
    exact = keyed_join(hits, confirmed, ["canonical"], "left", spread=SPREAD)
    exact = exact.withColumn("is_listed", F.coalesce("is_listed", F.lit(False)))
    return exact.unionByName(seen.where("not maybe").withColumn("is_listed", F.lit(False))).drop("maybe")


def judge(pages: DataFrame, listed: DataFrame, rules=RULES, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """``page_id, host, path, rule, verdict, canonical, is_listed`` of every row of ``pages``.

    ``listed`` is a table with a column ``url``, of any size and with any repeats. The verdict is that of the
    longest rule; without a rule, ``block`` for a listed URL and ``allow`` for others. A null URL, or one without
    ``://``, has an empty host and path, no rule, and is allowed. Repeated rows are judged alike; an empty list
    blocks nothing; empty tables give an empty result. Other columns are not looked at.
    """
    url = F.col("url")
    rule, judged = rule_columns(F.col("host"), F.col("path"), rules)
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("canonical"))
    rows = rows.withColumns({"rule": rule, "judged": judged})
    out = listed_rows(rows, listed.select(canonical(F.col("url")).alias("listed_url")), max_blocks)
    verdict = F.coalesce("judged", F.when(F.col("is_listed"), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "canonical", "is_listed")


def listed_pages(pages: DataFrame) -> DataFrame:
    """The list of the registered query: URLs of pages on hosts with a listed label."""
    return pages.where(host_of(F.col("url")).rlike(LISTED_HOSTS)).select("url")


def oracle_sql() -> str:
    rules = sorted(RULES, key=lambda r: (len(r[0]) + len(r[1]), len(r[0])), reverse=True)
    fits = [f"when (host = '{h}' or host like '%.{h}') and starts_with(path, '{p}')" for h, p, _ in rules]
    rule = " ".join(f"{c} then '{h}{p}'" for c, (h, p, _) in zip(fits, rules))
    judged = " ".join(f"{c} then '{v}'" for c, (_, _, v) in zip(fits, rules))
    return rf"""
  with a as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) end as rest from pages),
  b as (select page_id, rest, translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
      coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path,
      list_sort(list_distinct(list_filter(string_split(coalesce(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), ''), '&'),
          lambda p: p <> '' and not regexp_full_match(p, '(utm_.*|ref|fbclid|gclid)(=.*)?')))) as ps from a),
  c as (select *, regexp_replace(regexp_replace(host, '^.*@|:(80|443)?$', '', 'g'), '\.$', '') as bare from b),
  d as (select *, case when regexp_matches(bare, '^(www|m)\..*\.') then regexp_replace(bare, '^(www|m)\.', '') else bare end as plain from c),
  e as (select *, case when plain = '' then '' else plain || regexp_replace(regexp_replace(path, '/index\.html?$', '/'), '/+$', '')
      || case when len(ps) > 0 then '?' || array_to_string(ps, '&') else '' end end as canonical from d),
  l as (select distinct canonical from e where regexp_matches(host, '{LISTED_HOSTS}') and canonical <> ''),
  j as (select *, case {rule} end as rule, case {judged} end as judged, canonical in (from l) as is_listed from e)
  select page_id, host, path, rule, coalesce(judged, case when is_listed then 'block' else 'allow' end) as verdict, canonical, is_listed from j"""
