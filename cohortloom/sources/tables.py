"""Delimited tables whose headers differ from file to file, sidecars, regional and QC tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortloom.functions.missing import nan_to_null, token_to_null
from cohortloom.operators.joins import attach_group
from cohortloom.operators.quality import require_columns, split_valid
from cohortloom.session import materialize
from cohortloom.sources.files import decoded

INDEX_LISTS = {"shape": "bigint", "pixdim": "double"}


def read_image_index(spark: SparkSession, path: str) -> DataFrame:
    """Image index from CSV, columns taken from its header.

    Every id stays text (leading zeros), list literals become arrays, ``size`` a long; entity
    columns may differ from index to index. What cannot be read is NULL; :func:`split_image_index` reports it.
    """
    raw = spark.read.csv(path, header=True, escape='"')
    require_columns(raw, ["dataset", "sub", "suffix", "shape", "pixdim", "size", "md5", "path"])
    return _typed_index(raw)


def _typed_index(raw: DataFrame) -> DataFrame:
    texts = {c: token_to_null(F.col(c)) for c in raw.columns if c not in (*INDEX_LISTS, "size")}
    lists = {c: F.from_json(F.col(c), f"array<{t}>") for c, t in INDEX_LISTS.items()}
    return raw.withColumns({**texts, **lists, "size": F.col("size").try_cast("long")})


def split_image_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The image index, and the lines of it whose ``shape``, ``pixdim`` or ``size`` cannot be read.

    Rejected lines keep their text and have a ``reject_reason``; a missing value is no reject.
    """
    raw = spark.read.csv(path, header=True, escape='"')
    require_columns(raw, ["dataset", "sub", "suffix", "shape", "pixdim", "size", "md5", "path"])
    rules = [
        (token_to_null(F.col(c)).isNull() | F.from_json(F.col(c), f"array<{t}>").isNotNull(), f"{c} is no list")
        for c, t in INDEX_LISTS.items()
    ]
    rules.append((token_to_null(F.col("size")).isNull() | F.col("size").try_cast("long").isNotNull(), "size is no number"))
    good, bad = split_valid(raw, rules)
    return _typed_index(good), bad


def _quoted(sep: str) -> str:
    """A field that begins with a quote, up to the next separator: doubled quotes stay, text may follow it."""
    return f'"(?:[^"]++|"")*+"[^{sep}]*+'


def _separator(sep: str) -> str:
    return "\\t" if sep == "\t" else "\\" + sep


def split_fields(record: Column, sep: str) -> Column:
    """Fields of one record; a quoted field may hold separators, line breaks and doubled quotes.

    A quote counts only at the start of a field; what follows the closing one belongs to the field.
    """
    s = _separator(sep)
    raw = F.regexp_extract_all(F.concat(F.lit(sep), record), F.lit(f"{s}({_quoted(s)}|[^{s}]*+)"), F.lit(1))
    quoted = r'^"((?s:[^"]|"")*+)"((?s:.*))\z'
    return F.transform(
        raw,
        lambda x: F.when(
            x.startswith('"') & x.rlike(quoted),
            F.concat(
                F.replace(F.regexp_extract(x, quoted, 1), F.lit('""'), F.lit('"')), F.regexp_extract(x, quoted, 2)
            ),
        ).otherwise(x),
    )


def line_ends(text: Column, sep: str) -> tuple[Column, Column]:
    """Where a line ends, inside a quoted field (1) or outside (0), if it begins outside, and if inside."""
    s = _separator(sep)
    rest = f"(?:{s}(?:{_quoted(s)}|(?!\")[^{s}]*+))*+\\z"
    has = text.contains('"')
    outside = F.concat(F.lit(sep), text).rlike("^" + rest)
    inside = text.rlike(f'^(?:[^"]++|"")*+"[^{s}]*+{rest}')
    # without a quote nothing changes
    return F.when(has & ~outside, 1).otherwise(0), F.when(has & inside, 0).otherwise(1)


def _composed(rows: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Running composition of state changes along ``order``: the last fixed state and the turns since.

    A change is ``_fixed`` (the state it leads to, whatever came before) or, where that is null, ``_turn``
    (1: the other state, 0: the same). The composition of any number of them is again one of these.
    """
    upto = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_turns", F.sum("_turn").over(upto))
    mark = F.when(F.col("_fixed").isNotNull(), F.struct("_fixed", "_turns"))
    rows = rows.withColumn("_mark", F.last(mark, ignorenulls=True).over(upto))
    turned = (F.col("_turns") - F.coalesce("_mark._turns", F.lit(0))) % 2
    fixed = F.col("_mark._fixed").bitwiseXOR(turned.cast("int"))
    return rows.withColumns({"_fixed": fixed, "_turn": F.when(fixed.isNull(), turned).otherwise(0).cast("int")}).drop("_turns", "_mark")


def _after(state: Column) -> Column:
    """The state that a composed change leads to."""
    return F.coalesce(F.col("_fixed"), state.bitwiseXOR(F.col("_turn")))


def join_lines(lines: DataFrame) -> DataFrame:
    """Records of files with quoted line breaks, from lines with ``file, block, line, text, eol, out, into``.

    Whether a line begins inside a quoted field depends on all lines before it. Each line is a change between
    the two states; changes are composed within a block and over the blocks of a file, so a block is scanned
    on its own, whatever the size of the file. Only the lines of records with several of them are then gathered,
    record by record. A file that ends inside quotes is an error.
    """
    fixed = F.when(F.col("out") == F.col("into"), F.col("out"))
    turn = F.when((F.col("out") == 1) & (F.col("into") == 0), 1).otherwise(0)
    scanned = _composed(lines.withColumns({"_fixed": fixed, "_turn": turn}), ["file", "block"], ["line"])

    blocks = scanned.groupBy("file", "block").agg(F.max_by(F.struct("_fixed", "_turn"), "line").alias("m"))
    blocks = _composed(blocks.select("file", "block", "m.*"), ["file"], ["block"])
    in_file = Window.partitionBy("file").orderBy("block")
    blocks = blocks.withColumn("_end", _after(F.lit(0)))
    blocks = blocks.select("file", "block", F.lag("_end", 1, 0).over(in_file).alias("_start"))

    in_block = Window.partitionBy("file", "block").orderBy("line")
    ends = scanned.join(blocks, ["file", "block"]).withColumn("_end", _after(F.col("_start")))
    begins = F.coalesce(F.lag("_end").over(in_block), F.col("_start")) == 0
    placed = ends.withColumns({"_own": F.when(begins, F.struct("block", "line")), "_alone": begins & (F.col("_end") == 0)})
    placed = placed.withColumn("_own", F.last("_own", ignorenulls=True).over(in_block.rowsBetween(Window.unboundedPreceding, 0)))
    # written once: the records that run on into the next block are looked up in it
    placed = materialize(placed.select("file", "block", "line", "text", "eol", "_end", "_own", "_alone"), "placed")

    before = in_file.rowsBetween(Window.unboundedPreceding, -1)
    last = placed.groupBy("file", "block").agg(F.max("_own").alias("_own"), F.max_by("_end", "line").alias("_end"))
    carried = last.select(
        "file",
        "block",
        F.last("_own", ignorenulls=True).over(before).alias("_carried"),
        F.max(F.struct("block", "_end")).over(Window.partitionBy("file")).alias("_tail"),
        F.max("_own").over(Window.partitionBy("file")).alias("_final"),
    )
    owned = placed.filter("not _alone").join(carried, ["file", "block"]).withColumn("_own", F.coalesce("_own", "_carried"))
    unclosed = (F.col("_tail._end") == 1) & (F.col("_own") == F.col("_final"))
    message = F.concat(F.lit("a quoted field is not closed in "), "file")
    owned = owned.withColumn("text", F.when(unclosed, F.raise_error(message)).otherwise(F.col("text")))
    parts = F.array_sort(F.collect_list(F.struct("block", "line", "text", "eol")))
    records = owned.groupBy("file", "_own").agg(parts.alias("p"))
    inner = F.transform(F.slice("p", F.lit(1), F.size("p") - 1), lambda x: F.concat(x["text"], x["eol"]))
    whole = F.concat(F.array_join(inner, ""), F.element_at("p", -1)["text"])
    joined = records.select("file", F.col("_own.block").alias("block"), F.col("_own.line").alias("line"), whole.alias("text"))
    return joined.unionByName(placed.filter("_alone").select("file", "block", "line", "text"))


def read_records(spark: SparkSession, paths: str | Sequence[str], sep: str = "\t") -> DataFrame:
    """Records of many delimited files as ``file, block, line, text``, in one scan; large files are split.

    Lines end with a line feed, a carriage return or both. A quoted field may hold line breaks, which stay as
    they are. Empty lines between records are left out. ``block`` and ``line`` order the records of a file.
    """
    raw = spark.read.text(paths, lineSep="\n").select(
        decoded(F.col("_metadata.file_path")).alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.regexp_replace("value", r"^\uFEFF", "").alias("value"),
    )
    # a carriage return within the line ends a line of its own
    pieces = F.split(F.regexp_replace("value", r"\r\z", ""), "\r")
    ended = F.when(F.col("value").endswith("\r"), "\r\n").otherwise("\n")
    raw = raw.select("file", "block", ended.alias("ended"), F.size(pieces).alias("n"), F.posexplode(pieces).alias("i", "text"))
    out, into = line_ends(F.col("text"), sep)
    lines = raw.select(
        "file",
        "block",
        F.monotonically_increasing_id().alias("line"),
        "text",
        F.when(F.col("i") < F.col("n") - 1, "\r").otherwise(F.col("ended")).alias("eol"),
        out.alias("out"),
        into.alias("into"),
    )
    # written once: headers and rows are told apart by line numbers, which two scans need not agree on
    lines = materialize(lines, "delimited")
    # only where some line leaves a quote open can a record have more than one line
    broken = materialize(lines.filter("out = 1").select("file").distinct(), "broken")
    if broken.isEmpty():
        return lines.filter(F.col("text") != "").select("file", "block", "line", "text")
    # of known size: rows are not dealt by file, of which a few may hold all of them
    plain = lines.join(broken, "file", "left_anti").select("file", "block", "line", "text")
    joined = join_lines(lines.join(broken, "file", "left_semi"))
    return materialize(plain.unionByName(joined).filter(F.col("text") != ""), "records")


def read_delimited(spark: SparkSession, paths: str | Sequence[str], sep: str = "\t") -> DataFrame:
    """Rows of many delimited files, each with a header of its own, in one scan.

    Columns: ``file``, ``block`` and ``line`` (the position within the file), ``header`` and
    ``fields`` as arrays of text.  Large files are split between tasks, also within quoted fields; the header is
    the first record of a file and reaches the others through a small per-file table.
    """
    records = read_records(spark, paths, sep)
    # places first, in two steps of numbers only: texts would be sorted by file, to the last record
    first = records.groupBy("file", "block").agg(F.min("line").alias("line"))
    first = first.groupBy("file").agg(F.min("block").alias("block"), F.min_by("line", "block").alias("line"))
    heads = attach_group(records, first, ["file", "block", "line"], "left_semi")
    heads = heads.select("file", F.struct("block", "line").alias("head"), split_fields(F.col("text"), sep).alias("header"))
    rows = attach_group(records, heads, ["file"], "inner")
    return rows.filter(F.struct("block", "line") > F.col("head")).select(
        "file", "block", "line", "header", split_fields(F.col("text"), sep).alias("fields")
    )


def row_map(header: Column, fields: Column) -> Column:
    """A row as a map from header to text; missing trailing fields are NULL."""
    pairs = F.arrays_zip(header.alias("k"), fields.alias("v"))
    pairs = F.slice(pairs, F.lit(1), F.size(header))
    return F.map_from_entries(pairs)


def parent_directory(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -2)


def read_participants_raw(spark: SparkSession, glob: str | Sequence[str]) -> DataFrame:
    """Participant tables, one per dataset; the dataset is the parent directory."""
    return read_delimited(spark, glob, "\t").withColumn("dataset", parent_directory(F.col("file")))


def sidecar_descriptions(text: Column) -> Column:
    """Entries of a JSON object with lower-cased keys; values keep their JSON text.

    Anything that is not an object gives NULL.
    """
    entries = F.map_entries(F.from_json(text, "map<string,string>"))
    return F.transform(
        entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))
    )


def sidecar_entry(entries: Column, key: Column) -> Column:
    """The value for a key; of keys differing only in case the last one counts."""
    return F.try_element_at(F.filter(entries, lambda e: e["key"] == key), F.lit(-1))["value"]


def read_sidecars(spark: SparkSession, glob: str | Sequence[str]) -> DataFrame:
    """Column descriptions, one JSON file per dataset."""
    texts = spark.read.text(glob, wholetext=True)
    return texts.select(
        parent_directory(decoded(F.col("_metadata.file_path"))).alias("dataset"),
        sidecar_descriptions(F.col("value")).alias("descriptions"),
    )


def read_regional(
    spark: SparkSession,
    glob: str | Sequence[str],
    value: str = "volume_mm3",
    label: str | None = "region",
) -> DataFrame:
    """Long regional tables, one file per scan: ``path``, ``name``, the label and the value.

    Columns are found by name in each file's own header.
    """
    rows = read_delimited(spark, glob, "\t")

    def field(name: str) -> Column:
        spot = F.nullif(F.array_position("header", name), F.lit(0)).cast("int") - 1
        return token_to_null(F.get("fields", spot))

    cols = [F.col("file").alias("path"), F.substring_index("file", "/", -1).alias("name")]
    if label:
        cols.append(field(label).alias(label))
    return rows.select(*cols, nan_to_null(field(value).try_cast("double")).alias(value))


def read_qc_long(
    spark: SparkSession, dirs: Sequence[str], key: str = "subject", pattern: str = "*_qc.csv"
) -> DataFrame:
    """Wide QC tables as long rows (directory, subject, score, value), columns aligned by name."""
    globs = [f"{d.rstrip('/')}/{pattern}" for d in dirs]
    rows = read_delimited(spark, globs, ",")
    cells = rows.select(
        parent_directory(F.col("file")).alias("directory"),
        row_map(F.col("header"), F.col("fields"))[key].alias(key),
        F.explode(F.arrays_zip(F.col("header").alias("k"), F.col("fields").alias("v"))).alias("cell"),
    )
    value = nan_to_null(token_to_null(F.col("cell.v")).try_cast("double"))
    return cells.filter(F.col("cell.k") != key).select(
        "directory", key, F.col("cell.k").alias("score"), value.alias("value")
    )


def read_qc_wide(
    spark: SparkSession, dirs: Sequence[str], key: str = "subject", pattern: str = "*_qc.csv"
) -> DataFrame:
    """Wide QC tables of several directories; columns are matched by name, absent ones are NULL.

    Only the distinct column names come to the driver.
    """
    rows = read_delimited(spark, [f"{d.rstrip('/')}/{pattern}" for d in dirs], ",")
    heads = rows.select("header").distinct()  # by hash: as a value of a group, a list makes Spark sort all rows
    names = heads.select(F.explode("header").alias("name")).distinct().orderBy("name").collect()
    scores = [r["name"] for r in names if r["name"] != key]
    cells = rows.select(
        parent_directory(F.col("file")).alias("directory"),
        row_map(F.col("header"), F.col("fields")).alias("m"),
    )
    values = {c: nan_to_null(token_to_null(F.col("m")[c]).try_cast("double")) for c in scores}
    return cells.select("directory", F.col("m")[key].alias(key), *[v.alias(c) for c, v in values.items()])
