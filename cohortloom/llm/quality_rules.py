"""Quality rules: text statistics, hard limits, and robust multivariate outliers.

Per language and source, minimum-covariance-determinant estimates of location and scatter are found by
concentration steps from three starts, each run until its determinant stops falling; the start that ends
with the least determinant counts, and a document goes when its Mahalanobis distance is too large.
Statistics are kept as whole thousandths, so sums over rows are exact and the result does not depend on
the partitioning. The same expressions run as Spark columns and, in the oracle, as DuckDB SQL.

A concentration step is one pass for all starts: distances are binned, the moments are summed per group,
start and bin, and the nearest bins that together hold ``SUPPORT`` of the group, the last one in part,
give the next estimate. Nothing but a row for each group, start and bin is shuffled, so a group with a
third of all rows costs no more than others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.llm.shared import SPACE, store, text_of, words_of

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Share of a group's rows that an estimate rests on.
SUPPORT = 0.75
#: Makes the scatter of the nearest 75 % consistent for a normal distribution in five dimensions.
CONSISTENCY = 1.41
BINS_PER_E = 50
#: A step counts only if it lowers the determinant of the scatter's root by this share, so steps end.
FALL = 1e-6
#: Where the winsorised start clips, in robust standard deviations.
CLIP = 2.0
#: Squared distance beyond which a document goes: the 0.9999 quantile of chi-square, 5 degrees.
CUTOFF = 25.745
#: Rows of estimates or quartiles, of at most 23 numbers and a group's names each, that are sent to all tasks.
MAX_SENT = 50_000
#: Steps that the SQL writes out.
ORACLE_STEPS = 16

#: Transformed statistics in thousandths, and the smallest standard deviation granted to each: a
#: statistic that is constant in a group must not turn ordinary documents into outliers. For symbols that is one
#: symbol in a hundred words, for lines somewhat over one repeated line.
FEATURES = (
    ("f1", "ln(1.0 + n_words)", 500.0),
    ("f2", "ln(1.0 + cast(word_chars as double) / greatest(n_words, 1))", 150.0),
    ("f3", "ln(1.0 + 100.0 * n_symbols / greatest(n_words, 1))", 700.0),
    ("f4", "ln(1.0 + n_dup_lines)", 1000.0),
    ("f5", "cast(n_repeat_words as double) / greatest(n_words, 1)", 100.0),
)
P = len(FEATURES)
NAMES = [f[0] for f in FEATURES]
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
BASE_FAILED = f"(n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)"
GROUP = ["g_lang", "g_source"]


def feature_sql(expression: str) -> str:
    return f"cast(round(1000.0 * ({expression})) as bigint)"


def moment_sql() -> list[tuple[str, str]]:
    """Sums of the features and of their products."""
    sums = [(f"s{i}", f"sum({NAMES[i]})") for i in range(P)]
    return sums + [(f"q{i}{j}", f"sum({NAMES[i]} * {NAMES[j]})") for i, j in PAIRS]


MOMENTS = [name for name, _ in moment_sql()]


def factor_sql() -> list[tuple[str, str]]:
    """From moments ``n, s*, q*``: mean ``m*``, then the Cholesky factor ``l*`` of the scatter, in order."""
    steps = [(f"m{i}", f"cast(s{i} as double) / n") for i in range(P)]
    for j in range(P):
        for i in range(j, P):
            value = f"{CONSISTENCY} * (cast(q{i}{j} as double) / n - m{i} * m{j})"
            if i == j:
                floor = FEATURES[i][2]
                value = f"greatest({value}, 0.0) + {floor * floor}"
            for k in range(j):
                value += f" - l{i}{k} * l{j}{k}"
            steps.append((f"l{i}{j}", f"sqrt({value})" if i == j else f"({value}) / l{j}{j}"))
    return steps


def whitened_sql() -> list[tuple[str, str]]:
    """Forward substitution: ``y*`` have unit scatter."""
    steps = []
    for i in range(P):
        value = f"{NAMES[i]} - m{i}" + "".join(f" - l{i}{k} * y{k}" for k in range(i))
        steps.append((f"y{i}", f"({value}) / l{i}{i}"))
    return steps


DISTANCE = " + ".join(f"y{i} * y{i}" for i in range(P))
BIN = f"cast(floor({BINS_PER_E} * ln(1.0 + d2)) as bigint)"
PARAMETERS = [name for name, _ in factor_sql()]


def add(df: DataFrame, steps: list[tuple[str, str]]) -> DataFrame:
    """``df`` and the columns of ``steps``, which may name earlier ones, in one projection."""
    return df.select("*", *[F.expr(expression).alias(name) for name, expression in steps])


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``docs`` and the five counts, as ``q_*``; a missing text counts as empty."""
    body = text_of(text)
    out = docs.withColumn("q_words", words_of(body))
    # a 3-word window by its hash; the last two positions start none
    windows = F.expr("slice(transform(q_words, (w, i) -> xxhash64(w, get(q_words, i + 1), get(q_words, i + 2))), 1, greatest(size(q_words) - 2, 0))")
    out = out.withColumn("q_windows", windows)
    twice = F.expr(
        "size(q_windows) > 0 and size(array_distinct(q_windows)) < size(q_windows)"
    )
    out = out.withColumn(
        "q_sorted",
        F.when(twice, F.expr("array_sort(transform(q_windows, (h, i) -> struct(h as h, i as i)))")),
    )
    covered = F.expr(
        "coalesce(size(array_distinct(flatten(transform("
        " filter(q_sorted, (e, i) -> e.h = get(q_sorted, i - 1).h or e.h = get(q_sorted, i + 1).h),"
        " e -> array(e.i, e.i + 1, e.i + 2))))), 0)"
    )
    with_words = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumn("q_lines", with_words)
    return out.select(
        *docs.columns,
        F.size("q_words").cast("long").alias("q_n_words"),
        F.char_length(F.regexp_replace(body, SPACE, "")).cast("long").alias("q_word_chars"),
        F.char_length(F.regexp_replace(body, r"[^#*$%&|<>]+", "")).cast("long").alias("q_n_symbols"),
        F.expr("size(q_lines) - size(array_distinct(q_lines))").cast("long").alias("q_n_dup_lines"),
        F.when(twice, covered).otherwise(0).cast("long").alias("q_n_repeat_words"),
    )


def described(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Statistics, features and group of every row; a missing language or source is one with ''."""
    keep = docs.select(
        *[F.col(c) for c in docs.columns],
        F.coalesce(F.col(lang), F.lit("")).alias("g_lang"),
        F.coalesce(F.col(source), F.lit("")).alias("g_source"),
    )
    out = statistics(keep, text)
    for name in STATISTICS:
        out = out.withColumnRenamed(f"q_{name}", name)
    out = out.withColumn("base_failed", F.expr(BASE_FAILED))
    return add(out, [(n, feature_sql(e)) for n, e, _ in FEATURES])


def quartile_sql(quantile: str) -> list[tuple[str, str]]:
    """Lower quartile, median and upper quartile of each feature; ``quantile`` takes place and feature."""
    return [(f"{c}{i}", f"cast({quantile.format(q, NAMES[i])} as bigint)") for i in range(P) for c, q in (("lo", 0.25), ("me", 0.5), ("hi", 0.75))]


def diagonal_sql() -> list[tuple[str, str]]:
    """Moments of a start without correlations: medians, and the quartile range as standard deviation."""
    sums = [(f"s{i}", f"me{i}") for i in range(P)]
    spread = "cast(floor(pow((hi{0} - lo{0}) / cast(1.349 as double), 2)) as bigint)"
    return sums + [(f"q{i}{j}", f"me{i} * me{j}" + (" + " + spread.format(i) if i == j else "")) for i, j in PAIRS]


def clipped_sql() -> list[tuple[str, str]]:
    """Features moved to within ``CLIP`` robust standard deviations, the smallest deviation at least, of the median."""
    steps = []
    for i, (name, _, floor) in enumerate(FEATURES):
        reach = f"cast(floor({CLIP} * greatest((hi{i} - lo{i}) / cast(1.349 as double), {floor})) as bigint)"
        steps.append((name, f"least(greatest({name}, me{i} - {reach}), me{i} + {reach})"))
    return steps


def support_sql() -> list[tuple[str, str]]:
    """Moments of the nearest ``SUPPORT`` of a group from its bins: of the last bin in part, as all its rows are alike."""
    wanted = f"cast({SUPPORT} as double) * total"
    whole, part = f"sum(case when upto <= {wanted} then {{0}} else 0 end)", f"sum(case when upto > {wanted} then {{0}} * ({wanted} - (upto - n)) / n else 0 end)"
    return [(c, f"{whole.format(c)} + {part.format(c)}") for c in ["n", *MOMENTS]]


#: Product of the factor's diagonal, the root of the scatter's determinant.
DET = " * ".join(f"l{i}{i}" for i in range(P))
KEY = [*GROUP, "start"]


def aggregates(steps: list[tuple[str, str]]) -> list:
    return [F.expr(e).alias(n) for n, e in steps]


def sent(table: DataFrame) -> DataFrame:
    """A stored table, broadcast if its counted rows are few; its many small files would hide that from Spark.

    Beyond that the join is Spark's choice, which splits hot groups.
    """
    return F.broadcast(table) if table.count() <= MAX_SENT else table


def starts(rows: DataFrame) -> DataFrame:
    """Moments of three starts for each group: the plain ones, medians without correlations, winsorised values.

    Quartiles are exact; whole thousandths of logarithms leave each group few distinct values to count.
    """
    quartiles = rows.groupBy(*GROUP).agg(*aggregates(quartile_sql("percentile_disc({}) within group (order by {})")))
    quartiles = store(quartiles, "quartiles")
    sums = [F.count("*").alias("n"), *aggregates(moment_sql())]
    plain = rows.groupBy(*GROUP).agg(*sums).withColumn("start", F.lit(0))
    diagonal = add(quartiles.withColumn("n", F.lit(1).cast("long")), diagonal_sql()).withColumn("start", F.lit(1))
    clipped = rows.join(sent(quartiles), GROUP).select(*GROUP, *[F.expr(e).alias(n) for n, e in clipped_sql()])
    clipped = clipped.groupBy(*GROUP).agg(*sums).withColumn("start", F.lit(2))
    columns = [*KEY, "n", *MOMENTS]
    return plain.select(columns).unionByName(diagonal.select(columns)).unionByName(clipped.select(columns))


def estimate(moments: DataFrame) -> DataFrame:
    """Location, scatter and determinant from moments: a row for each group and start."""
    return add(moments, [*factor_sql(), ("det", DET)]).select(*KEY, *PARAMETERS, "det")


def distances(rows: DataFrame, parameters: DataFrame) -> DataFrame:
    """``d2`` per row, from a stored table of parameters."""
    return add(rows.join(sent(parameters), GROUP, "left"), whitened_sql() + [("d2", DISTANCE)])


def concentrated(rows: DataFrame, parameters: DataFrame) -> DataFrame:
    """One step for every group and start; ``fell`` says whether its determinant did, else the old estimate stays."""
    near = distances(rows, parameters).withColumn("bin", F.expr(BIN))
    binned = near.groupBy(*KEY, "bin").agg(F.count("*").alias("n"), *aggregates(moment_sql()))
    binned = binned.withColumn("upto", F.sum("n").over(Window.partitionBy(*KEY).orderBy("bin")))
    binned = binned.withColumn("total", F.sum("n").over(Window.partitionBy(*KEY)))
    nearest = binned.where(F.expr(f"upto - n < {SUPPORT} * total"))
    nearest = nearest.groupBy(*KEY).agg(*aggregates(support_sql()))
    new = estimate(nearest).select(*KEY, *[F.col(c).alias(f"new_{c}") for c in [*PARAMETERS, "det"]])
    both = parameters.drop("fell").join(new, KEY).withColumn("fell", F.expr(f"new_det < det * {1 - FALL}"))
    return both.select(*KEY, *[F.expr(f"if(fell, new_{c}, {c})").alias(c) for c in [*PARAMETERS, "det"]], "fell")


def fit(rows: DataFrame) -> DataFrame:
    """Minimum-covariance-determinant estimate of every group over its rows that pass the hard limits.

    Each start takes concentration steps until its determinant falls no more; the first start with the
    least determinant is the estimate. A determinant that always falls by a share and never below the
    smallest deviations' comes to rest, so the loop ends. A group of any size, one row included, gets an
    estimate: the smallest deviations keep the scatter regular. Outliers that are over a quarter of their
    group, as can be in groups of a dozen rows, draw the estimate to themselves. The driver sees one flag a step.
    """
    rows = rows.where(~F.col("base_failed"))
    parameters = store(estimate(starts(rows)).withColumn("fell", F.lit(True)), "mcd")
    while not parameters.where("fell").isEmpty():
        parameters = store(concentrated(rows, parameters), "mcd")
    best = F.min(F.struct("det", "start", *PARAMETERS)).alias("best")
    return store(parameters.groupBy(*GROUP).agg(best).select(*GROUP, "best.*"), "mcd")


def judge(rows: DataFrame, parameters: DataFrame) -> DataFrame:
    """``d2`` and ``kept``: within the hard limits and not an outlier of its group."""
    out = distances(rows, parameters)
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("d2"), F.lit(0.0)) <= CUTOFF))


def score(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, ``base_failed`` and ``kept`` of every row of ``docs``.

    Null or blank text: no words, fails. Repeated rows are judged alike, each on its own. An empty table
    gives an empty result. Other columns of ``docs`` are not looked at.
    """
    rows = store(described(docs.select("doc_id", "text", "lang", "source")).drop("text"), "statistics")
    return judge(rows, fit(rows)).select("doc_id", *STATISTICS, "base_failed", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` that are kept, with their own columns. Every text is described once.

    Null or blank text goes; rows with null ids, repeated rows and languages or sources that are null are
    judged like others. An empty table stays empty. Columns beside text, lang and source may have any name.
    """
    bare = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text", "lang", "source")
    rows = store(described(bare).drop("text", "lang", "source"), "described")
    return judge(rows, fit(rows.drop("row"))).where("kept").select("row.*")


def oracle_sql(steps: int = ORACLE_STEPS) -> str:
    """The same rows from DuckDB, the counts by other means. More steps than needed change nothing."""

    def nested(source: str, steps: list[tuple[str, str]]) -> str:
        for name, expression in steps:
            source = f"(select *, {expression} as {name} from {source})"
        return source

    def listed(steps: list[tuple[str, str]]) -> str:
        return ", ".join(f"{e} as {n}" for n, e in steps)

    moments = listed(moment_sql())
    group, key = ", ".join(GROUP), ", ".join(KEY)
    columns = ", ".join([key, "n", *MOMENTS])
    estimated = [*factor_sql(), ("det", DET)]
    values = [*PARAMETERS, "det"]
    clipped = f"(select {group}, {listed(clipped_sql())} from ok join qu using ({group}))"
    parts = [
        r"""t as (select row_number() over () as r, doc_id, coalesce(lang, '') as g_lang, coalesce(source, '') as g_source,
            coalesce(text, '') as text from documents)""",
        r"""w as (select r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws from t)""",
        r"""tri as (select r, i, concat(ws[i], ' ', ws[i + 1], ' ', ws[i + 2]) as g from w, unnest(range(1, len(ws) - 1)) u(i))""",
        r"""rep as (select r, i from tri qualify count(*) over (partition by r, g) > 1)""",
        r"""cov as (select r, count(distinct p) as c from (select r, unnest([i, i + 1, i + 2]) as p from rep) group by r)""",
        r"""ln as (select r, count(*) - count(distinct x) as c from (select r, unnest(string_split(text, chr(10))) as x from t)
            where regexp_matches(x, '[^\x20\x09-\x0D]') group by r)""",
        r"""st as (select t.r, doc_id, g_lang, g_source, len(ws)::bigint as n_words,
            coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars,
            length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
            coalesce(ln.c, 0)::bigint as n_dup_lines, coalesce(cov.c, 0)::bigint as n_repeat_words
            from t join w using (r) left join ln using (r) left join cov using (r))""",
        "fe as (select *, "
        + ", ".join(f"{feature_sql(e)} as {n}" for n, e, _ in FEATURES)
        + f", {BASE_FAILED} as base_failed from st)",
        "ok as (select * from fe where not base_failed)",
        f"qu as materialized (select {group}, {listed(quartile_sql('quantile_disc({1}, {0})'))} from ok group by {group})",
        f"""s0 as (select {group}, 0 as start, count(*) as n, {moments} from ok group by {group}
            union all by name select {columns} from {nested("(select *, 1 as start, 1 as n from qu)", diagonal_sql())}
            union all by name select {group}, 2 as start, count(*) as n, {moments} from {clipped} group by {group})""",
        f"p0 as materialized (select {key}, {', '.join(values)} from {nested('s0', estimated)})",
    ]
    for k in range(steps):
        near = nested(f"(select * from ok join p{k} using ({group}))", whitened_sql() + [("d2", DISTANCE), ("bin", BIN)])
        parts += [
            f"b{k} as materialized (select {key}, bin, count(*) as n, {moments} from {near} group by {key}, bin)",
            f"c{k} as (select *, sum(n) over (partition by {key} order by bin) as upto, sum(n) over (partition by {key}) as total from b{k})",
            f"h{k} as (select {key}, {listed(support_sql())} from c{k} where upto - n < {SUPPORT} * total group by {key})",
            f"e{k} as (select {key}, {', '.join(f'{c} as new_{c}' for c in values)} from {nested(f'h{k}', estimated)})",
            f"p{k + 1} as materialized (select {key}, "
            + ", ".join(f"case when new_det < det * {1 - FALL} then new_{c} else {c} end as {c}" for c in values)
            + f" from p{k} join e{k} using ({key}))",
        ]
    best = f"(select * from p{steps} qualify row_number() over (partition by {group} order by det, start) = 1)"
    last = nested(f"(select * from fe left join {best} using ({group}))", whitened_sql() + [("d2", DISTANCE)])
    return (
        "with "
        + ",\n".join(parts)
        + f"\nselect doc_id, {', '.join(STATISTICS)}, base_failed, not base_failed and coalesce(d2, 0.0) <= {CUTOFF} as kept from {last}"
    )
