"""Queries p2 and p4 to p7 over the fact store, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.dates import day, iso_instant, recorded_end
from tallyloom.functions.text import clean_field
from tallyloom.functions.instants import read_instants
from tallyloom.operators import as_known, history, instants, orphans, units
from tallyloom.session import cut
from tallyloom.sources.tables import table

# ---- p4: references to records that do not exist


def p4_references(spark: SparkSession, d: str) -> DataFrame:
    return (
        orphans.references(table(spark, d, "fact", "fact_id", "source_id"), "fact", "fact_id", "source_id", "source_file")
        .unionAll(orphans.references(table(spark, d, "entity_name", "name_id", "entity_id", "created_at"), "entity_name", "name_id", "entity_id", "entity", iso_instant(F.col("created_at"))))
        .unionAll(orphans.references(table(spark, d, "credit_case", "case_id", "entity_id", "created_at"), "credit_case", "case_id", "entity_id", "entity", iso_instant(F.col("created_at"))))
    )


def p4_lifetimes(spark: SparkSession, d: str) -> DataFrame:
    parents = table(spark, d, "entity", "entity_id", "created_at").select(F.lit("entity").alias("target"), F.col("entity_id").alias("key"), iso_instant(F.col("created_at")).alias("born"))
    parents = parents.unionAll(table(spark, d, "source_file", "source_id").select(F.lit("source_file"), "source_id", F.lit(None).cast("timestamp")))
    purges = table(spark, d, "purge_log", "table_name", "row_id", "purged_at").select(F.col("table_name").alias("target"), F.col("row_id").alias("key"), iso_instant(F.col("purged_at")).alias("purged_at"))
    return orphans.lifetimes(parents, purges)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphans(p4_references(spark, d), p4_lifetimes(spark, d)).select(F.col("ref_table").alias("table_name"), "row_id")


def p4_times(spark: SparkSession, d: str) -> DataFrame:
    """(ref_table, row_id, at): when each row of the four tables was made, of facts and source files as p2 reads it."""
    read = p2_instants(spark, d).filter("table_name in ('fact', 'source_file') and utc_us is not null").select(F.col("table_name").alias("ref_table"), F.col("row_key").try_cast("bigint").alias("row_id"), F.timestamp_micros("utc_us").alias("at"))
    for name, key, text in (("fact", "fact_id", "created_at"), ("source_file", "source_id", "ingested_at"), ("entity_name", "name_id", "created_at"), ("credit_case", "case_id", "created_at")):
        done = F.when(F.col(text).rlike("^[0-9]{4}-[0-9-]*T[0-9:.]*Z$"), F.col(text))
        read = read.unionAll(table(spark, d, name, key, text).filter(done.isNotNull()).select(F.lit(name), F.col(key), iso_instant(done)))
    return read.groupBy("ref_table", "row_id").agg(F.max("at").alias("at"))


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """References whose target is missing, deleted or late, per table, target, month of the referring row and status."""
    times = cut(p4_times(spark, d))
    refs = p4_references(spark, d).drop("at").join(times, ["ref_table", "row_id"], "left").select("ref_table", "row_id", "target", "key", "at")
    files = times.filter("ref_table = 'source_file'").select(F.lit("source_file").alias("target"), F.col("row_id").alias("key"), F.col("at").alias("came"))
    lives = p4_lifetimes(spark, d).join(files, ["target", "key"], "left").withColumn("born", F.coalesce("born", "came")).drop("came")
    return orphans.per_period(orphans.broken(orphans.classified(refs, lives)))


def p4_entities(spark: SparkSession, d: str) -> DataFrame:
    """As p4_report, of the references to entities, whose times stand in one notation."""
    refs = p4_references(spark, d).filter("target = 'entity'")
    return orphans.per_period(orphans.broken(orphans.classified(refs, p4_lifetimes(spark, d))))


P4_ENTITIES = """
with lives as (select entity_id as k, min(cast(created_at as timestamptz)) as born from entity where entity_id is not null group by 1),
purged as (select row_id as k, max(cast(purged_at as timestamptz)) as p from purge_log where table_name = 'entity' group by 1),
refs as (select distinct 'entity_name' as ref_table, name_id as id, entity_id as k, cast(created_at as timestamptz) as made from entity_name where entity_id is not null
  union all select distinct 'credit_case', case_id, entity_id, cast(created_at as timestamptz) as made from credit_case where entity_id is not null),
said as (select ref_table, made, case when l.k is not null and born > made then 'late' when l.k is not null then 'present' when u.k is null then 'missing' when made >= p then 'deleted_before' else 'deleted' end as status
  from refs left join lives l using (k) left join purged u using (k))
select ref_table, 'entity' as target, strftime(made at time zone 'UTC', '%Y-%m') as period, status, count(*) as rows from said where status != 'present' group by 1, 2, 3, 4
"""

P4_FOUND = """
select distinct 'fact' as table_name, fact_id as row_id from fact where source_id is not null and not exists (select 1 from source_file s where s.source_id = fact.source_id)
union all
select distinct 'entity_name', name_id from entity_name n where entity_id is not null and not exists (select 1 from entity e where e.entity_id = n.entity_id)
union all
select distinct 'credit_case', case_id from credit_case c where entity_id is not null and not exists (select 1 from entity e where e.entity_id = c.entity_id)
"""

# ---- p6: attributes as known at event time


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    cases = table(spark, d, "credit_case", "case_id", "entity_id", "base_date").select(F.col("case_id").alias("event_id"), "entity_id", day(F.col("base_date")).alias("at"))
    profile = table(spark, d, "entity_profile", "profile_id", "entity_id", "field", "valid_from", "valid_to", "created_at")
    start = day(F.col("valid_from"))
    versions = profile.select(
        F.col("profile_id").alias("row_id"), "entity_id", clean_field(F.col("field")).alias("attr"), start.alias("start"),
        recorded_end(start, day(F.col("valid_to"))).alias("until"), iso_instant(F.col("created_at")).alias("known"),
    )
    return as_known.as_known(cases, versions).select(F.col("event_id").alias("case_id"), F.col("row_id").alias("profile_id"))


#: A date that stands in any of the notations, in DuckDB's SQL.
_SQL_DAY = r"""try_cast(case when regexp_full_match({x}, '\d{{4}}-\d{{1,2}}-\d{{1,2}}') then {x} end as date)"""
_SQL_DAY_TEXT = r"""regexp_replace(regexp_replace(regexp_replace(translate({c}, '０１２３４５６７８９－／．', '0123456789-/.'), '[\s\x{{3000}}\x{{200b}}\x{{a0}}]', '', 'g'), '^(\d{{4}})[-/.年](\d{{1,2}})[-/.月](\d{{1,2}})日?$', '\1-\2-\3'), '^(\d{{4}})(\d\d)(\d\d)$', '\1-\2-\3')"""
_SQL_FIELD = r"""regexp_replace(regexp_replace({c}, '[\s\x{{3000}}\x{{200b}}\x{{a0}}]', '', 'g'), '[:：]+$', '')"""


def sql_day(c: str) -> str:
    return _SQL_DAY.format(x=_SQL_DAY_TEXT.format(c=c))


P6_FOUND = f"""
with p as (select distinct profile_id, entity_id, {_SQL_FIELD.format(c="field")} as attr, {sql_day("valid_from")} as f, {sql_day("valid_to")} as t, cast(created_at as timestamptz) at time zone 'UTC' as k from entity_profile where entity_id is not null and field is not null),
c as (select distinct case_id, entity_id, {sql_day("base_date")} as b from credit_case),
j as (select case_id, profile_id, row_number() over (partition by case_id, attr order by coalesce(f, date '0001-01-01') desc, k desc, profile_id desc) as r
  from c join p using (entity_id) where b is not null and (f is null or f <= b) and (t is null or t > b or t <= f) and cast(k as date) <= b)
select case_id, profile_id from j where r = 1
"""

# ---- p7: history of changing attributes

#: The fields of entity_profile that hold quantities.
QUANTITY_FIELDS = ("注册资本", "资产总额", "年营业收入", "年收入", "用地面积", "年产能", "年用电量", "经营期限")


def p7_events(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "entity_name", "name_id", "entity_id", "name", "name_kind", "valid_from", "valid_to", "created_at").filter(~F.col("name_kind").eqNullSafe("别名"))
    profile = table(spark, d, "entity_profile", "profile_id", "entity_id", "field", "value", "valid_from", "valid_to", "created_at").withColumn("attr", clean_field(F.col("field"))).filter(~F.col("attr").isin(*QUANTITY_FIELDS))
    return history.change_log(names, "entity_id", F.lit("名称"), "name", "valid_from", "valid_to", "created_at", "name_id").unionByName(
        history.change_log(profile, "entity_id", F.col("attr"), "value", "valid_from", "valid_to", "created_at", "profile_id")
    )


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    found = history.versions(p7_events(spark, d)).filter("versions >= 2")
    text = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit("")).alias(c)
    return found.select("entity_id", "attr", text("valid_from"), text("valid_to"))


def p7_timeline(spark: SparkSession, d: str) -> DataFrame:
    """All attributes of each entity side by side, split at every change."""
    return history.combined(history.versions(p7_events(spark, d)))


_SQL_FORM = r"""regexp_replace(translate({c}, '""" + "".join(map(chr, range(0xFF01, 0xFF5F))).replace("'", "''") + "￥￡" + "', '" + "".join(map(chr, range(0x21, 0x7F))).replace("'", "''").replace("{", "{{").replace("}", "}}") + "¥£" + r"""'), '[\s\x{{3000}}\x{{200b}}\x{{a0}}]', '', 'g')"""

P7_FOUND = f"""
with a as (
  select entity_id, '名称' as attr, {_SQL_FORM.format(c="name")} as v, {sql_day("valid_from")} as f, {sql_day("valid_to")} as t, created_at as k, name_id as id from entity_name where name_kind is distinct from '别名'
  union all
  select entity_id, {_SQL_FIELD.format(c="field")}, {_SQL_FORM.format(c="value")}, {sql_day("valid_from")}, {sql_day("valid_to")}, created_at, profile_id from entity_profile),
b as (select *, row_number() over (partition by entity_id, attr, f order by k desc, id desc) as r from a where f is not null and v != '' and entity_id is not null and attr not in {QUANTITY_FIELDS}),
c as (select entity_id, attr, v, f, case when t > f then t end as t, lag(v) over (partition by entity_id, attr order by f) is distinct from v as n from b where r = 1),
g as (select *, sum(cast(n as int)) over (partition by entity_id, attr order by f) as g from c),
s as (select entity_id, attr, g, min(f) as f, arg_max(coalesce(t, date '9999-12-31'), f) as t from g group by 1, 2, 3),
w as (select *, lead(f) over (partition by entity_id, attr order by g) as x, count(*) over (partition by entity_id, attr) as n from s)
select entity_id, attr, strftime(f, '%Y-%m-%d') as valid_from, coalesce(strftime(nullif(least(coalesce(x, date '9999-12-31'), t), date '9999-12-31'), '%Y-%m-%d'), '') as valid_to from w where n >= 2
"""

_P7_VERSIONS = P7_FOUND[: P7_FOUND.index("select entity_id, attr, strftime")].replace("select entity_id, attr, g, min(f) as f,", "select entity_id, attr, g, any_value(v) as v, min(f) as f,")
P7_TIMELINE = _P7_VERSIONS + """,
y as (select entity_id, attr, v, f, nullif(least(coalesce(x, date '9999-12-31'), t), date '9999-12-31') as t from w),
edges as (select entity_id, f as e from y union select entity_id, t from y where t is not null),
spans as (select entity_id, e as lo, lead(e) over (partition by entity_id order by e) as hi from edges),
held as (select entity_id, lo, hi, count(*) as attrs, string_agg(attr || '=' || v, chr(10) order by attr) as state from spans join y using (entity_id) where f <= lo and coalesce(t, date '9999-12-31') > lo group by 1, 2, 3),
marked as (select *, case when lag(state) over q = state and lag(hi) over q = lo then 0 else 1 end as n from held window q as (partition by entity_id order by lo)),
runs as (select *, sum(n) over (partition by entity_id order by lo) as run from marked)
select entity_id, min(lo) as valid_from, max_by(hi, lo) as valid_to, any_value(attrs) as attrs, any_value(state) as state from runs group by entity_id, run
"""

QUERIES = {"p4_found": p4_found, "p4_report": p4_report, "p4_entities": p4_entities, "p6_found": p6_found, "p7_found": p7_found, "p7_timeline": p7_timeline}
SQL = {"p4_found": P4_FOUND, "p4_entities": P4_ENTITIES, "p7_timeline": P7_TIMELINE, "p6_found": P6_FOUND, "p7_found": P7_FOUND}

# ---- p5: quantities in different units

#: The kind of quantity that each of the fields holds.
FIELD_KINDS = {"注册资本": "money", "资产总额": "money", "年营业收入": "money", "年收入": "money", "用地面积": "area", "年产能": "mass", "年用电量": "energy", "经营期限": "months"}


def p5_units(spark: SparkSession, d: str) -> DataFrame:
    """Every row of a quantity field with its quantity in common units, how it was found and its segment of the history."""
    kinds = F.create_map(*[F.lit(x) for pair in FIELD_KINDS.items() for x in pair])
    rows = table(spark, d, "entity_profile", "profile_id", "source_id", "entity_id", "field", "value", "unit", "valid_from", "created_at").withColumn("field", clean_field(F.col("field"))).filter(F.col("field").isin(*FIELD_KINDS))
    rows = rows.select(F.col("profile_id").alias("row_id"), "source_id", "entity_id", "field", kinds[F.col("field")].alias("kind"), "value", "unit", F.coalesce(day(F.col("valid_from")), iso_instant(F.col("created_at")).cast("date")).alias("at"))
    return units.to_common_units(rows).withColumnRenamed("row_id", "profile_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_units(spark, d).filter("origin = 'stated' and common is not null").select("profile_id", F.col("common").alias("common_value"))


QUERIES |= {"p5_found": p5_found, "p5_units": p5_units}

# ---- p2: timestamps in mixed formats and zones


def p2_records(spark: SparkSession, d: str) -> DataFrame:
    """All time stamps; a source file and the facts drawn from it are a group, the file's arrival being first."""
    out, none = None, F.lit(None).cast("bigint")
    for name, key, text, rank, group in (("fact", "fact_id", "created_at", 1, "source_id"), ("source_file", "source_id", "ingested_at", 0, "source_id"), ("fill_decision", "fingerprint", "decided_at", 1, None)):
        df = table(spark, d, name, *dict.fromkeys(c for c in (key, "batch_no", text, group) if c))
        df = df.select(F.lit(name).alias("table_name"), F.col(key).cast("string").alias("row_key"), (F.col(group) if group else none).alias("group"), F.regexp_extract("batch_no", r"-(\d{2})$", 1).alias("site"), F.lit(rank).alias("rank"), F.col(text).alias("text"))
        out = df if out is None else out.unionAll(df)
    return out


def p2_sites(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "office_desk", "desk_no", "zone_name", "day_order").select(F.col("desk_no").alias("site"), F.col("zone_name").alias("zone"), "day_order")


def p2_instants(spark: SparkSession, d: str) -> DataFrame:
    """Every record with its instant and what told its zone; also those of desks that are not listed, with the estimated zone."""
    return instants.normalised(p2_records(spark, d), p2_sites(spark, d), cut)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_instants(spark, d).filter("not done and utc_us is not null and basis in ('text', 'registered', 'corrected')").select("table_name", "row_key", "utc_us")


def p2_zones(spark: SparkSession, d: str) -> DataFrame:
    """Each desk's zone, registered or estimated, how many records it puts out of order, and whether the estimate alone agrees."""
    sites = p2_sites(spark, d).groupBy("site").agg(F.min("zone").alias("zone"), F.min("day_order").alias("day_order"))
    read = cut(read_instants(p2_records(spark, d).join(sites.select("site", "day_order"), "site", "left"), "text", "day_order"))
    chosen = instants.choose_zones(instants.zone_histories(read, instants.listed_zones(sites)), sites)
    return chosen.withColumn("agrees", F.col("zone") == F.col("estimate"))


QUERIES |= {"p2_found": p2_found, "p2_zones": p2_zones}
