"""Participant normalization on values derived from documents and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.catalog.base import register, table
from cohortloom.functions.people import (
    age_header,
    age_in_years,
    age_unit,
    header_for,
    header_index,
    normalize_age,
    normalize_sex,
    null_if_nonpositive,
    strip_prefix,
)
from cohortloom.functions.scalars import pick_by
from cohortloom.operators.positions import with_position
from cohortloom.operators.quality import split_valid
from cohortloom.operators.reshape import wide_to_long
from cohortloom.plans.participants import harmonize, load_longitudinal
from cohortloom.session import working_path
from cohortloom.sources.tables import (
    read_participants_raw,
    row_map,
    sidecar_descriptions,
    sidecar_entry,
)


def _choice(key, values):
    """The value at ``key`` (0-based) of a list of texts."""
    return F.get(F.array(*[F.lit(v) for v in values]), key.cast("int"))


def _sql_choice(key, values):
    quoted = ", ".join("null" if v is None else "'" + v + "'" for v in values)
    return f"list_value({quoted})[{key} + 1]"


SEXES = [" Male ", "f", "WOMAN", "0", None, "m", "woMan", "n/a"]
AGES = ["12.5", "89+", "-1", "0", "1d", "NaN", " 7 ", "1e1", ".5", "abc", None, "33.25"]


@register(
    "B2",
    sql="""select event_id, user_id, regexp_replace(case when event_id % 3 = 0 then concat('sub-', user_id)
             when event_id % 3 = 1 then concat('sub-sub-', user_id) else concat('x-sub-', user_id) end, '^sub-', '') as sub,
             regexp_replace(concat('ses-', event_type), '^ses-', '') as ses from events""",
)
def prefix_strip(spark, sf):
    user = F.col("user_id").cast("string")
    k = F.col("event_id") % 3
    raw = F.when(k == 0, F.concat(F.lit("sub-"), user)).when(k == 1, F.concat(F.lit("sub-sub-"), user))
    raw = raw.otherwise(F.concat(F.lit("x-sub-"), user))
    return table(spark, sf, "events").select(
        "event_id",
        "user_id",
        strip_prefix(raw, "sub-").alias("sub"),
        strip_prefix(F.concat(F.lit("ses-"), "event_type"), "ses-").alias("ses"),
    )


@register(
    "B3",
    "K1",
    sql=f"""select doc_id, case lower(trim({_sql_choice("(doc_id % 8)", SEXES)})) when 'male' then 'M' when 'm' then 'M'
            when 'man' then 'M' when 'f' then 'F' when 'female' then 'F' when 'woman' then 'F' end as sex from documents""",
)
def sex_codes(spark, sf):
    raw = _choice(F.col("doc_id") % 8, SEXES)
    return table(spark, sf, "documents").select("doc_id", normalize_sex(raw).alias("sex"))


@register(
    "B4",
    "B8",
    sql="""
      with a as (select event_id, value, event_id % 12 as k from events)
      select event_id, case k when 0 then 12.5 when 2 then -1.0 when 3 then 0.0 when 6 then 7.0 when 7 then 10.0
               when 8 then 0.5 when 10 then value when 11 then 33.25 end as age,
             case k when 0 then 12.5 when 6 then 7.0 when 7 then 10.0 when 8 then 0.5
               when 10 then case when value > 0 then value end when 11 then 33.25 end as positive_age from a""",
)
def age_values(spark, sf):
    raw = F.when(F.col("event_id") % 12 == 10, F.col("value").cast("string")).otherwise(
        _choice(F.col("event_id") % 12, AGES)
    )
    rows = table(spark, sf, "events").select("event_id", normalize_age(raw).alias("age"))
    return rows.withColumn("positive_age", null_if_nonpositive(F.col("age")))


_HEADERS = [
    ["participant_id", "session_id", "Gender", "Age"],
    ["participant_id", "session", "session_id", "sex", "gender", "age"],
    ["subject", "Sex"],
    ["participant_id", "ScanAge", "age", "SESSION"],
]


def _header_column():
    out = None
    for i, names in enumerate(_HEADERS):
        value = F.array(*[F.lit(n) for n in names])
        test = F.col("doc_id") % 4 == i
        out = F.when(test, value) if out is None else out.when(test, value)
    return out


def _headed(spark, sf):
    values = [
        F.concat(F.lit(f"v{i}-"), F.col("doc_id").cast("string")) for i in range(max(map(len, _HEADERS)))
    ]
    docs = table(spark, sf, "documents").select(
        "doc_id", F.col("source").alias("dataset"), _header_column().alias("header"), F.array(*values).alias("fields")
    )
    return docs


@register(
    "B5",
    "B6",
    sql="""
      select doc_id, list_value('session_id', 'session', null, 'SESSION')[doc_id % 4 + 1] as ses_column,
             list_value('Gender', 'sex', 'Sex', null)[doc_id % 4 + 1] as sex_column,
             case when source = 'src1' then 'ScanAge' else list_value('Age', 'age', null, 'age')[doc_id % 4 + 1] end as age_column,
             case doc_id % 4 when 0 then concat('v2-', doc_id) when 1 then concat('v3-', doc_id)
                             when 2 then concat('v1-', doc_id) end as sex_text,
             case when source = 'src1' then case doc_id % 4 when 3 then concat('v1-', doc_id) end
                  else case doc_id % 4 when 0 then concat('v3-', doc_id) when 1 then concat('v5-', doc_id)
                                       when 3 then concat('v2-', doc_id) end end as age_text
      from documents""",
)
def header_choice(spark, sf):
    header = F.col("header")
    rows = _headed(spark, sf).withColumns(
        {
            "ses_column": header_for(header, ["session", "session_id"]),
            "sex_column": header_for(header, ["sex", "gender"]),
            "age_column": age_header(F.col("dataset"), header, {"src1": "ScanAge"}),
        }
    )
    return rows.select(
        "doc_id",
        "ses_column",
        "sex_column",
        "age_column",
        F.try_element_at(row_map(header, F.col("fields")), "sex_column").alias("sex_text"),
        F.get("fields", header_index(header, F.col("age_column"))).alias("age_text"),
    )


@register("C14", sql="select doc_id from documents where doc_id % 4 <> 2")
def required_header(spark, sf):
    raw = _headed(spark, sf).withColumn("row", row_map(F.col("header"), F.col("fields")))
    good, _ = split_valid(raw, [(F.map_contains_key("row", "participant_id"), "no participant_id column")])
    return good.select("doc_id")


@register(
    "A6",
    sql="""select event_id, json_extract_string(props, '$.k') as k from events""",
)
def sidecar_key(spark, sf):
    entries = sidecar_descriptions(F.replace("props", F.lit('"k"'), F.lit('"K"')))
    return table(spark, sf, "events").select("event_id", sidecar_entry(entries, F.lit("k")).alias("k"))


@register(
    "B7",
    sql="""select event_id, case when user_id = 6 then 'months' when event_id % 3 = 0 then 'months' else 'years' end as unit,
             round(case when user_id = 6 or event_id % 3 = 0 then value / 12 else value end, 6) as age from events""",
)
def age_units(spark, sf):
    text = F.when(F.col("event_id") % 3 == 0, F.lit('{"AGE": {"Units": "Months", "k": [1, 2]}}'))
    text = text.when(F.col("event_id") % 3 == 1, F.lit('{"Age": "in years"}')).otherwise(F.col("props"))
    description = sidecar_entry(sidecar_descriptions(text), F.lit("age"))
    unit = age_unit(F.col("user_id").cast("string"), description, {"6": "months"})
    rows = table(spark, sf, "events").select("event_id", "value", unit.alias("unit"))
    return rows.select("event_id", "unit", F.round(age_in_years(F.col("value"), F.col("unit")), 6).alias("age"))


@register(
    "B24",
    "H2",
    sql="""select l_orderkey, l_partkey, l_linenumber, case l_linenumber % 4 when 1 then l_quantity
             when 2 then l_discount when 3 then l_tax end as age from lineitem""",
)
def wave_age_choice(spark, sf):
    wave = F.concat(F.lit("wave"), (F.col("l_linenumber") % 4).cast("string"))
    ages = {"wave1": F.col("l_quantity"), "wave2": F.col("l_discount"), "wave3": F.col("l_tax")}
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", pick_by(wave, ages).alias("age")
    )


def _participant_files(spark, sf):
    """One table per source below a fresh folder; the sources differ in their headers."""
    root = working_path(spark, "participants")
    i = F.col("doc_id")
    docs = table(spark, sf, "documents")
    rows = docs.select(
        F.col("source").alias("dataset"),
        F.concat(F.lit("sub-"), (i % 200).cast("string")).alias("participant_id"),
        F.when(i % 3 == 0, F.lit("n/a")).otherwise(F.concat(F.lit("ses-"), (i % 2).cast("string"))).alias("session"),
        _choice(i % 8, SEXES).alias("sex"),
        F.when(i % 9 == 0, "n/a").otherwise((i % 100 / F.lit(4.0)).cast("string")).alias("age"),
    )
    upper = F.substring("dataset", 4, 2).cast("int") % 2 == 1
    first = rows.filter(~upper)
    second = rows.filter(upper).select(
        "dataset", F.col("age").alias("Age"), F.col("sex").alias("Gender"), "participant_id"
    )
    for frame, name in ((first, "lower"), (second, "upper")):
        writer = frame.write.partitionBy("dataset").option("header", True).option("sep", "\t")
        writer.option("nullValue", "n/a").csv(f"{root}/{name}")
    return f"{root}/*/dataset=*/*.csv"


def _raw_participants(spark, sf):
    raw = read_participants_raw(spark, _participant_files(spark, sf))
    return raw.withColumn("dataset", F.replace("dataset", F.lit("dataset="), F.lit("")))


_PARTICIPANT_SQL = f"""
  select source as dataset, cast(doc_id % 200 as varchar) as sub,
         case when cast(substr(source, 4) as int) % 2 = 0 and doc_id % 3 <> 0 then cast(doc_id % 2 as varchar) end as ses,
         case lower(trim({_sql_choice("(doc_id % 8)", SEXES)})) when 'male' then 'M' when 'm' then 'M'
            when 'man' then 'M' when 'f' then 'F' when 'female' then 'F' when 'woman' then 'F' end as sex,
         case when doc_id % 9 <> 0 and doc_id % 100 > 0
              then doc_id % 100 / 4.0 end as age
  from documents"""


@register(
    "A4",
    sql="""select source as dataset, concat('sub-', doc_id % 200) as participant_id, count(*) as n,
             cast(sum(case when cast(substr(source, 4) as int) % 2 = 0 then 4 else 3 end) as bigint) as n_fields
           from documents group by 1, 2""",
)
def participants_raw(spark, sf):
    raw = _raw_participants(spark, sf)
    row = row_map(F.col("header"), F.col("fields"))
    return raw.groupBy("dataset", row["participant_id"].alias("participant_id")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.size("header")).alias("n_fields")
    )


@register(
    "K3",
    "K2",
    sql=f"""select dataset, sub, ses, count(*) as n from (select distinct dataset, sub, ses from ({_PARTICIPANT_SQL}))
            group by 1, 2, 3""",
)
def participants_harmonized(spark, sf):
    """Keys of the harmonized table; which duplicate comes first depends on the written files."""
    table_ = harmonize(_raw_participants(spark, sf)).table
    return table_.groupBy("dataset", "sub", "ses").agg(F.count(F.lit(1)).alias("n"))


@register(
    "E3",
    sql=f"""select dataset, sub, ses, round(max(age) - min(age), 6) as range
            from ({_PARTICIPANT_SQL})
            group by 1, 2, 3 having max(age) - min(age) > 0""",
)
def age_conflicts(spark, sf):
    found = harmonize(_raw_participants(spark, sf)).conflicts
    return found.select("dataset", "sub", "ses", F.round("range", 6).alias("range"))


@register(
    "K4",
    sql="""
      with w as (select o_orderkey, o_custkey, o_orderpriority, o_totalprice from orders)
      select concat('c', cast(o_custkey % 10 as varchar)) as dataset, cast(o_orderkey as varchar) as sub, ses,
             case o_orderkey % 3 when 0 then 'M' when 1 then 'F' end as sex, age
      from (select *, 'wave1' as ses, case when o_orderkey % 2 = 0 then cast(o_orderkey % 90 as double) end as age from w
            union all select *, 'wave2', case when o_orderkey % 5 > 0 then cast(o_orderkey % 90 + 4 as double) end from w
            union all select *, 'wave3', case when o_orderkey % 7 = 0 then cast(o_orderkey % 90 as double) + 8.5 end from w)
      where age is not null""",
)
def longitudinal_waves(spark, sf):
    key = F.col("o_orderkey")
    base = key % 90

    def text(value, test):
        return F.when(test, value.cast("double").cast("string")).otherwise("n/a")

    raw = table(spark, sf, "orders").select(
        F.concat(F.lit("c"), (F.col("o_custkey") % 10).cast("string")).alias("dataset"),
        F.array(*[F.lit(c) for c in ("participant_id", "Sex", "AgeMRI_W1", "AgeMRI_W2", "AgeMRI_W3")]).alias("header"),
        F.array(
            F.concat(F.lit("sub-"), key.cast("string")),
            _choice(key % 3, ["male", "Woman", "?"]),
            text(base, key % 2 == 0),
            text(base + 4, key % 5 > 0),
            text(base + 8.5, key % 7 == 0),
        ).alias("fields"),
        F.lit("orders").alias("file"),
        F.lit(0).cast("long").alias("block"),
        key.alias("line"),
    )
    return load_longitudinal(raw).rows.select("dataset", "sub", "ses", "sex", "age")


@register(
    "G6",
    sql="""
      with w as (select o_orderkey, o_custkey from orders),
      e as (select o_orderkey, o_custkey, 'wave1' as ses, cast(o_orderkey % 90 as double) as age from w
            union all select o_orderkey, o_custkey, 'wave2', cast(o_orderkey % 90 + 4 as double) from w)
      select o_custkey % 10 as dataset, o_orderkey as sub, ses, age,
             row_number() over (order by o_custkey % 10, o_orderkey, ses) as place from e""",
)
def sorted_sessions(spark, sf):
    key = F.col("o_orderkey")
    wide = table(spark, sf, "orders").select(
        key.alias("sub"),
        (F.col("o_custkey") % 10).alias("dataset"),
        (key % 90).cast("double").alias("age1"),
        (key % 90 + 4).cast("double").alias("age2"),
    )
    long = wide_to_long(wide, ["sub", "dataset"], {"wave1": "age1", "wave2": "age2"}, "ses", "age")
    return with_position(long, ["dataset", "sub", "ses"], name="place")
