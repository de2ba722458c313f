"""Exact dedup: tree merge of sorted digest runs.

The digests of a partition form a run. In each round ``fan_in`` neighbouring runs are exchanged to one
place and merged in digest order, where the smallest identifier of equal entries survives; the rounds
form a tree whose root holds every digest once. Rows then find their keeper on the way down the same
tree: a root entry goes to the runs that hold the digest, never to single rows, so a group of copies
that holds a third of all rows moves one entry per run and is answered within each run.

An entry is the SHA-256 of the normalised text together with its length and a second, unrelated hash.
Entries merge only when all three agree, at every level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.shared import NO_ID, SPACE, key_of, store, text_of

#: Runs that meet in one merge.
FAN_IN = 16
ENTRY = ["digest", "n_bytes", "check"]


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, " ")


def local_runs(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """Identifier, entry and run of every row; stored, for the run is the partition that read it."""
    body = docs.select(key_of(doc_id).alias("id"), normalised(text_of(text)).alias("body"))
    rows = body.select(
        "id",
        F.spark_partition_id().cast("long").alias("run"),
        F.unhex(F.sha2("body", 256)).alias("digest"),
        F.octet_length("body").cast("long").alias("n_bytes"),
        F.xxhash64("body").alias("check"),
    )
    return store(rows, "runs")


def merged(runs: DataFrame, fan_in: int) -> DataFrame:
    """One round: ``fan_in`` runs become one. Sorted by entry, smallest identifier and row count kept.

    The minimum of a struct keeps Spark on sort-based aggregation: every task sorts its part of a run,
    and the exchange merges sorted parts.
    """
    wider = runs.withColumn("run", F.expr(f"run div {int(fan_in)}"))
    out = wider.groupBy("run", *ENTRY).agg(
        F.min(F.struct("keep", "n_bytes")).alias("least"), F.sum("size").alias("size")
    )
    return out.select("run", *ENTRY, F.col("least.keep").alias("keep"), "size")


def find_copies(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", fan_in: int = FAN_IN
) -> DataFrame:
    """For every row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    A missing text counts as empty. Rows with equal ids and texts are both kept, as neither is smaller;
    a row without id comes before all others and its ids come back null. Other columns are ignored.
    """
    rows = local_runs(docs, text, doc_id)
    n_runs = (rows.agg(F.max("run")).first()[0] or 0) + 1
    level = rows.groupBy("run", *ENTRY).agg(F.min("id").alias("keep"), F.count("*").alias("size"))
    leaves = level
    while True:
        level = merged(level, fan_in)
        n_runs = -(-n_runs // fan_in)
        if n_runs <= 1:
            break
    root = level.select(*ENTRY, "keep", "size")
    answered = leaves.select("run", *ENTRY).join(root, ENTRY)
    out = rows.join(answered, ["run", *ENTRY])
    none = F.lit(NO_ID)
    return out.select(
        F.nullif("id", none).alias("doc_id"),
        F.nullif("keep", none).alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("id") == F.col("keep")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def oracle_sql() -> str:
    return r"""
  with t as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents)
  select doc_id, min(doc_id) over g as keep_id, count(*) over g as group_size,
         doc_id = min(doc_id) over g as kept, text_sha256
  from t window g as (partition by text_sha256)"""
