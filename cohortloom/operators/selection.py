"""Exact quantiles by radix selection: values are counted where they lie, and never moved or rewritten.

The first digit of a value is its sign and the leading bits of its logarithm; further digits are those of its place
within an interval, ``DIGIT_BITS`` at a time. Both are monotone in the value, which is all that is needed. A round
counts the values of every group by the next digit, a bounded number of counts for a group or an interval; the counts
tell in which interval each wanted rank lies, and the next round looks at the rows of these intervals only. An
interval whose least and greatest value agree is done. The first digit leaves fewer than 2 ** 48 doubles to an
interval, so three more of 16 bits are enough. Counting is combined in the tasks before any shuffle, so a
group with a third of all rows sends no more than any other.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.operators.positions import quantiles
from cohortloom.session import materialize

DIGIT_BITS = 16
#: Steps of the first digit for each doubling of a value.
PER_OCTAVE = 32
#: More rounds than any values need: intervals shrink by a factor of 2 ** DIGIT_BITS.
MOST_ROUNDS = 64


def first_digit(value: Column) -> Column:
    """Sign and logarithm: a long that grows with the value; at most 2 * 2,100 * ``PER_OCTAVE`` different ones."""
    size = F.abs(value.cast("double"))
    place = F.floor((F.log2(size) + 1076) * PER_OCTAVE) + 1
    bits = F.when(size == 0, F.lit(0)).when(size == float("inf"), F.lit(2**30)).otherwise(place)
    return F.when(value < 0, -bits).otherwise(bits)


def next_digit(value: Column, low: Column, high: Column, digit_bits: int) -> Column:
    """Place of a value between two others of the same first digit."""
    share = (value - low).cast("double") / (high - low).cast("double")
    return F.floor(share * float(2**digit_bits))


def _counts(rows: DataFrame, keys: list[str], digit: Column) -> DataFrame:
    """Intervals of the next digit: size, least and greatest value."""
    return rows.groupBy(*keys, digit.alias("_d")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
    )


def _equal(keys: Sequence[str], prefix: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(prefix + c)) for c in keys], F.lit(True))


def _narrowed(counts: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """For every wanted rank the interval it lies in, and its rank there."""
    upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_d").rowsBetween(Window.unboundedPreceding, 0))
    bins = counts.withColumn("_upto", upto)
    want = wanted.select(*[F.col(c).alias(f"_w_{c}") for c in keys], "_q", "_rank")
    inside = (F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_n"))
    met = bins.join(want, _equal(keys, "_w_") & inside)
    return met.select(*keys, "_q", (F.col("_rank") - (F.col("_upto") - F.col("_n"))).alias("_rank"), "_lo", "_hi")


def _wanted(ranks: list[Column]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(q).alias("_q"), r.cast("long").alias("_rank")) for q, r in enumerate(ranks)]))


def select_quantiles(
    df: DataFrame,
    value: str,
    ps: dict[str, float],
    by: Sequence[str] = (),
    sizes: str | None = None,
    digit_bits: int = DIGIT_BITS,
) -> DataFrame:
    """Exact linearly interpolated quantiles per group, one column per entry of ``ps``.

    Null and NaN values are left out, and a group without others has no row; null keys are a group of their own.
    ``sizes`` names a column for the number of values. Decimals go through
    :func:`cohortloom.operators.positions.quantiles`, for they have no bits of this kind.
    """
    kind = dict(df.dtypes)[value]
    if kind.startswith("decimal") or not ps:
        return quantiles(df, value, ps, by, sizes)
    whole = kind in ("bigint", "int", "smallint", "tinyint")
    by = list(by)
    v = F.col(f"`{value}`").cast("long" if whole else "double")
    # minus zero and zero are one value, and so one interval
    rows = df.select(*by, (v if whole else v + F.lit(0.0)).alias("_v")).filter(F.col("_v").isNotNull())
    if not whole:
        rows = rows.filter(~F.isnan("_v"))

    spots = {n: (F.col("_size") - 1) * F.lit(float(p)) for n, p in ps.items()}
    ranks = [f(s) for s in spots.values() for f in (F.floor, F.ceil)]
    got = _by_driver(rows, ranks, digit_bits) if not by else _by_table(rows, by, ranks, digit_bits)

    out = []
    for i, (name, spot) in enumerate(spots.items()):
        lo, hi = F.get("_at", F.lit(2 * i)), F.get("_at", F.lit(2 * i + 1))
        out.append((lo + (hi - lo) * (spot - F.floor(spot))).cast("double").alias(name))
    if sizes:
        out.append(F.col("_size").alias(sizes))
    return got.select(*by, *out)


def _by_driver(rows: DataFrame, ranks: list[Column], digit_bits: int) -> DataFrame:
    """Quantiles of the whole table: the intervals, one per wanted rank, are part of the next round's filter."""
    spark = rows.sparkSession
    one = rows.withColumn("_i", F.lit(0))
    first = _counts(one, ["_i"], first_digit(F.col("_v")))
    upto = Window.partitionBy("_i")
    first = first.withColumn("_size", F.sum("_n").over(upto))
    sized = first.withColumn("_w", F.array(*[r.cast("long") for r in ranks]))
    running = F.sum("_n").over(upto.orderBy("_d").rowsBetween(Window.unboundedPreceding, 0))
    sized = sized.withColumn("_upto", running).select("_size", "_upto", "_n", "_lo", "_hi", F.posexplode("_w").alias("_q", "_rank"))
    inside = (F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_n"))
    found = sized.filter(inside).select("_size", "_q", (F.col("_rank") - F.col("_upto") + F.col("_n")).alias("_rank"), "_lo", "_hi").collect()
    if not found:
        return spark.createDataFrame([(None, None)], f"_size long, _at array<{dict(rows.dtypes)['_v']}>")
    size = found[0]["_size"]
    state = {r["_q"]: (r["_rank"], r["_lo"], r["_hi"]) for r in found}
    for _ in range(MOST_ROUNDS):
        open_ = sorted({(lo, hi) for _, lo, hi in state.values() if lo != hi})
        if not open_:
            break
        number = {span: i for i, span in enumerate(open_)}
        spans = [F.col("_v").between(lo, hi) for lo, hi in open_]
        near = rows.filter(reduce(lambda a, b: a | b, spans))

        def of(values) -> Column:
            """The value that belongs to the interval of the row."""
            return reduce(lambda c, x: c.when(x[0], x[1]), list(zip(spans, values))[1:], F.when(spans[0], values[0]))

        which = of([F.lit(i) for i in range(len(open_))])
        place = of([next_digit(F.col("_v"), F.lit(lo), F.lit(hi), digit_bits) for lo, hi in open_])
        want = [(number[lo, hi], q, r) for q, (r, lo, hi) in state.items() if lo != hi]
        asked = F.broadcast(spark.createDataFrame(want, "_i int, _q int, _rank long"))  # one row per wanted rank
        for r in _narrowed(_counts(near.withColumn("_i", which), ["_i"], place), asked, ["_i"]).collect():
            state[r["_q"]] = (r["_rank"], r["_lo"], r["_hi"])
    at = [state[q][1] for q in range(len(ranks))]
    return spark.createDataFrame([(size, at)], f"_size long, _at array<{dict(rows.dtypes)['_v']}>")


def _by_table(rows: DataFrame, by: list[str], ranks: list[Column], digit_bits: int) -> DataFrame:
    """Quantiles per group: intervals are a stored table, joined by group and value."""
    first = materialize(_counts(rows, by, first_digit(F.col("_v"))), "counts")
    sizes = first.groupBy(*by).agg(F.sum("_n").alias("_size"))
    wanted = sizes.select(*by, _wanted(ranks).alias("_w")).select(*by, "_w.*")
    state = materialize(_narrowed(first, wanted, by), "intervals")
    done = []
    for _ in range(MOST_ROUNDS):
        done.append(state.filter("_lo = _hi").select(*by, "_q", "_lo"))
        open_ = state.filter("_lo <> _hi")
        if open_.isEmpty():
            break
        spans = open_.select(*[F.col(c).alias(f"_s_{c}") for c in by], "_lo", "_hi").distinct()
        # an interval is told from others of its group by its least value
        near = rows.join(spans, _equal(by, "_s_") & F.col("_v").between(F.col("_lo"), F.col("_hi")))
        near = near.select(*by, F.col("_lo").alias("_from"), "_v", "_hi")
        counts = _counts(near, [*by, "_from"], next_digit(F.col("_v"), F.col("_from"), F.col("_hi"), digit_bits))
        asked = open_.select(*by, F.col("_lo").alias("_from"), "_q", "_rank")
        state = materialize(_narrowed(counts, asked, [*by, "_from"]).drop("_from"), "intervals")
    every = reduce(DataFrame.unionByName, done)
    at = F.transform(F.array_sort(F.collect_list(F.struct("_q", "_lo"))), lambda x: x["_lo"])
    ready = every.groupBy(*by).agg(at.alias("_at"))  # two values for each quantile
    match = _equal(by, "_r_")
    return sizes.join(ready.select(*[F.col(c).alias(f"_r_{c}") for c in by], "_at"), match).select(*by, "_size", "_at")
