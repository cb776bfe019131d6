"""Queries of the table, fact-store, audit, matching, extraction and file operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.dates import iso_instant
from tallyloom.operators import audit, combine, decide, extract, facts, files, pivot, profile, quality, store, tables
from tallyloom.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, places: int = 4) -> DataFrame:
    return df.select(*[F.round(F.col(f"`{c}`"), places).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


# ---- pivots, reports, charts


@query("""select l_returnflag, l_linestatus, round(sum(l_quantity), 4) as l_quantity_sum, round(avg(l_quantity), 4) as l_quantity_mean, count(l_quantity) as l_quantity_count from lineitem group by 1, 2""")
def pivot_status(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pivot.pivot(table(spark, d, "lineitem", "l_returnflag", "l_linestatus", "l_quantity"), ["l_returnflag", "l_linestatus"], ["l_quantity"], "l_quantity:sum,l_quantity:mean,l_quantity:count"))


@query("""select o_orderpriority, round(coalesce(sum(o_totalprice) filter (o_orderstatus = 'F'), 0), 2) as o_totalprice_F, round(coalesce(sum(o_totalprice) filter (o_orderstatus = 'O'), 0), 2) as o_totalprice_O,
 round(coalesce(sum(o_totalprice) filter (o_orderstatus = 'P'), 0), 2) as o_totalprice_P from orders group by 1""")
def pivot_wide(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pivot.pivot(table(spark, d, "orders", "o_orderpriority", "o_orderstatus", "o_totalprice"), ["o_orderpriority"], ["o_totalprice"], "sum", "o_orderstatus", ["F", "O", "P"]), 2)


@query("""select c_mktsegment, round(sum(c_acctbal), 2) as c_acctbal from customer group by 1""")
def pivot_sorted_simple(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pivot.pivot(table(spark, d, "customer", "c_mktsegment", "c_acctbal"), ["c_mktsegment"], ["c_acctbal"]), 2).orderBy(F.desc("c_acctbal"))


@query("""select l_shipdate::date as day, round(sum(l_extendedprice), 2) as total, round(avg(l_extendedprice), 4) as mean, count(l_extendedprice) as "rows" from lineitem group by 1 order by sum(l_extendedprice) desc, 1 limit 20""")
def report_group(spark: SparkSession, d: str) -> DataFrame:
    df = pivot.group_report(table(spark, d, "lineitem", "l_shipdate", "l_extendedprice").withColumn("day", F.col("l_shipdate").cast("date")), "day", "l_extendedprice")
    return df.select("day", F.round("total", 2).alias("total"), F.round("mean", 4).alias("mean"), "rows")


@query("""with t as (select p_type as label, sum(p_retailprice) as total, row_number() over (order by sum(p_retailprice) desc, p_type) as r from part group by 1)
select label, round(total, 2) as total from t where r <= 12 union all select 'other (' || count(*) || ')', round(sum(total), 2) from t where r > 12 having count(*) > 0""")
def chart_pie_other(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pivot.top_with_other(table(spark, d, "part", "p_type", "p_retailprice"), "p_type", "p_retailprice"), 2)


@query("""with e as (select min(o_totalprice) as lo, max(o_totalprice) as hi from orders) select cast(least(floor((o_totalprice - lo) / ((hi - lo) / 20)) + 1, 20) as int) as bin, count(*) as "rows" from orders, e where o_totalprice is not null group by 1""")
def chart_hist(spark: SparkSession, d: str) -> DataFrame:
    return pivot.histogram(table(spark, d, "orders", "o_totalprice"), "o_totalprice")


@query("""select l_returnflag, round(min(l_extendedprice), 4) as low, round(quantile_cont(l_extendedprice, 0.25), 4) as q1, round(quantile_cont(l_extendedprice, 0.5), 4) as median, round(quantile_cont(l_extendedprice, 0.75), 4) as q3, round(max(l_extendedprice), 4) as high from lineitem group by 1""")
def chart_box(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pivot.box(table(spark, d, "lineitem", "l_returnflag", "l_extendedprice"), "l_returnflag", "l_extendedprice"))


@query("""with e as (select p_brand, p_size, sum(p_retailprice) as total from part group by 1, 2), t as (select p_brand from e group by 1 order by sum(total) desc, 1 limit 30)
select p_brand, p_size, round(total, 2) as total from e where p_brand in (select p_brand from t)""")
def chart_topk(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pivot.series(table(spark, d, "part", "p_brand", "p_size", "p_retailprice"), "p_brand", "p_retailprice", "p_size"), 2)


# ---- profiles


_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount")


@query(" union all ".join(
    f"""select '{c}' as "column", count(*) - count({c}) as missing, count(distinct {c}) as distinct_values, min({c}) as min, max({c}) as max, round(avg({c}), 4) as mean, round(quantile_cont({c}, 0.5), 4) as median, round(stddev_samp({c}), 4) as std, round(sum({c}), 2) as sum,
 round(quantile_cont({c}, 0.25), 4) as q1, round(quantile_cont({c}, 0.75), 4) as q3, round(skewness({c}), 3) as skew, (select count(*) from lineitem, (select quantile_cont({c}, 0.25) as a, quantile_cont({c}, 0.75) as b from lineitem) where {c} < a - 1.5 * (b - a) or {c} > b + 1.5 * (b - a)) as outliers from lineitem"""
    for c in _NUMBERS))
def profile_numeric(spark: SparkSession, d: str) -> DataFrame:
    df = profile.numbers(table(spark, d, "lineitem", *_NUMBERS), list(_NUMBERS))
    return rounded(df.withColumn("skew", F.round("skew", 3)).withColumn("sum", F.round("sum", 2)))


_TEXTS = ("p_name", "p_brand", "p_type")


@query(" union all ".join(f"""select '{c}' as "column", count(*) - count({c}) as missing, count(distinct {c}) as distinct_values, cast(min(length({c})) as int) as shortest, cast(max(length({c})) as int) as longest, round(avg(length({c})), 1) as mean_length, count(distinct {c}) = count(*) and count(*) > 1 as likely_id from part""" for c in _TEXTS))
def profile_text(spark: SparkSession, d: str) -> DataFrame:
    return profile.texts(table(spark, d, "part", *_TEXTS), list(_TEXTS))


@query("""select p_type as value, count(*) as "rows" from part where p_type is not null group by 1 order by 2 desc, 1 limit 10""")
def profile_top_values(spark: SparkSession, d: str) -> DataFrame:
    return profile.top_values(table(spark, d, "part", "p_type"), "p_type")


@query("""select 'o_orderdate' as "column", min(o_orderdate)::date as first, max(o_orderdate)::date as last, cast(date_diff('day', min(o_orderdate)::date, max(o_orderdate)::date) as int) as span_days from orders""")
def profile_datetime(spark: SparkSession, d: str) -> DataFrame:
    return profile.dates(table(spark, d, "orders", "o_orderdate"), ["o_orderdate"])


@query("""select count(*) - (select count(*) from (select distinct * from fact)) as repeated_rows from fact""")
def profile_repeated_rows(spark: SparkSession, d: str) -> DataFrame:
    return profile.repeated_rows(table(spark, d, "fact"))


_NARROW = "translate({c}, '０１２３４５６７８９．－＋，％　（）：', '0123456789.-+,% ():')"
_BARE = "regexp_replace(regexp_replace(regexp_replace(trim(" + _NARROW + "), '^\\((.*)\\)$', '\\1'), '%$', ''), '(?i)[¥$€£￥\\s\\x{{3000}}]|RMB|CNY|USD|EUR|GBP', '', 'g')"
_PARSED = "regexp_full_match(regexp_replace(regexp_replace(" + _BARE + ", '(\\d),(\\d{{3}})\\b', '\\1\\2', 'g'), '(\\d),(\\d{{3}})\\b', '\\1\\2', 'g'), '[+-]?(\\d+(\\.\\d*)?|\\.\\d+)([eE][+-]?\\d+)?')"
_TOKENS = ", ".join("'" + t + "'" for t in tables.NULL_TOKENS)


def _issues(c: str) -> str:
    n, m, u = f"count({c})", f"count(*) - count({c})", f"count(distinct {c})"
    read, plain = f"count(*) filter ({_PARSED.format(c=c)})", f"count(*) filter (regexp_full_match({c}, '-?\\d+(\\.\\d+)?'))"
    each = {
        "high_missing": f"case when {m} > 0.5 * count(*) then {m} end", "notable_missing": f"case when {m} > 0.3 * count(*) and {m} <= 0.5 * count(*) then {m} end", "constant": f"case when {u} = 1 and count(*) > 1 then {n} end",
        "all_unique": f"case when {u} = count(*) and count(*) > 1 then {n} end", "untrimmed": f"count(*) filter (regexp_matches({c}, '^[\\s\\x{{3000}}\\x{{a0}}\\x{{85}}]|[\\s\\x{{3000}}\\x{{a0}}\\x{{85}}]$'))", "full_width": f"count(*) filter (regexp_matches({c}, '[{tables.WIDE}]'))",
        "null_token": f"count(*) filter (lower(trim({c}, ' ')) in ({_TOKENS}))", "number_as_text": f"case when {n} > 0 and {read} >= 0.8 * {n} and {plain} < {n} then {read} end",
    }
    return " union all ".join(f"select '{c}' as \"column\", '{k}' as issue, cast({x} as bigint) as \"rows\" from entity_profile" for k, x in each.items())


@query("select * from (" + " union all ".join(_issues(c) for c in ("field", "value", "unit", "valid_from")) + ") where \"rows\" > 0")
def profile_issues(spark: SparkSession, d: str) -> DataFrame:
    return profile.issues(table(spark, d, "entity_profile", "field", "value", "unit", "valid_from"), ["field", "value", "unit", "valid_from"])


# ---- cleaning



@query(f"""with t as (select distinct profile_id, value, regexp_replace(regexp_replace({_BARE.format(c="value")}, '(\\d),(\\d{{3}})\\b', '\\1\\2', 'g'), '(\\d),(\\d{{3}})\\b', '\\1\\2', 'g') as s, regexp_full_match(trim({_NARROW.format(c="value")}), '\\(.*\\)') as neg from entity_profile where value is not null)
select profile_id, round(case when neg then -abs(n) else n end, 4) as number from (select *, case when regexp_full_match(s, '[+-]?(\\d+(\\.\\d*)?|\\.\\d+)([eE][+-]?\\d+)?') then try_cast(s as double) end as n from t) where n is not null""")
def clean_numbers(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "entity_profile", "profile_id", "value").filter("value is not null").dropDuplicates(["profile_id"])
    return rounded(df.select("profile_id", tables.to_number(F.col("value")).alias("number")).filter("number is not null"))


@query(f"""select distinct profile_id, try_cast(s as date) as day from (select profile_id, regexp_replace(regexp_replace(trim({_NARROW.format(c="valid_from")}), '^(\\d{{4}})[年./-](\\d{{1,2}})[月./-](\\d{{1,2}})日?$', '\\1-\\2-\\3'), '^(\\d{{4}})[年/](\\d{{1,2}})月?$', '\\1-\\2-01') as s from entity_profile)
where regexp_full_match(s, '\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}') and try_cast(s as date) is not null""")
def clean_dates(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "entity_profile", "profile_id", "valid_from").dropDuplicates(["profile_id"])
    return df.select("profile_id", tables.to_date(F.col("valid_from")).alias("day")).filter("day is not null")


@query("""with k as (select profile_id, unit, lower(regexp_replace(unit, '[\\s\\x{3000}_\\-()（）\\[\\]]+', '', 'g')) as f from entity_profile), m as (select f, arg_min(unit, profile_id) as u from k where unit is not null group by 1)
select u as unit, count(*) as "rows" from k join m using (f) group by 1""")
def clean_categories(spark: SparkSession, d: str) -> DataFrame:
    df = tables.unify_categories(table(spark, d, "entity_profile", "profile_id", "unit"), "unit", "profile_id")
    return df.filter("unit is not null").groupBy("unit").agg(F.count(F.lit(1)).alias("rows"))


_FENCE = "(select quantile_cont(l_extendedprice, 0.25) as q1, quantile_cont(l_extendedprice, 0.75) as q3 from lineitem)"


@query("""select l_orderkey, l_linenumber, l_partkey, l_suppkey from (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_shipdate) as r from lineitem) where r = 1""")
def dedupe_keep_first(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    return tables.keep_first(df, ["l_orderkey", "l_linenumber"], F.col("l_partkey"), F.col("l_suppkey"), F.col("l_shipdate")).drop("l_shipdate")


@query()
def clean_profile(spark: SparkSession, d: str) -> DataFrame:
    """The whole chain of cleaning over the profile entries."""
    return tables.clean(table(spark, d, "entity_profile"), order="profile_id")


# ---- merging and comparing


@query("""select c_custkey as id, c_name as name, c_acctbal as balance, c_mktsegment as segment from customer union all select s_suppkey, s_name, s_acctbal, null from supplier""")
def merge_align(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return combine.stacked([c, table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))])


@query("""select c.case_id, c.entity_id, c.created_at, e.created_at as created_at_2 from (select distinct case_id, entity_id, created_at from credit_case) c left join (select distinct entity_id, created_at from entity) e on c.entity_id is not distinct from e.entity_id""")
def merge_join_nullsafe(spark: SparkSession, d: str) -> DataFrame:
    cases, entities = (table(spark, d, n, *cols).distinct() for n, cols in (("credit_case", ("case_id", "entity_id", "created_at")), ("entity", ("entity_id", "created_at"))))
    return combine.joined([cases, entities], ["entity_id"], "left").select("case_id", "entity_id", "created_at", "created_at_2")


def _perturbed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    a = table(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_totalprice")
    changed = F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus"))
    b = a.filter(F.col("o_orderkey") % 11 != 0).withColumn("o_orderstatus", changed)
    return a, b.unionAll(a.filter(F.col("o_orderkey") % 13 == 0).select((F.col("o_orderkey") + 10_000_000).alias("o_orderkey"), "o_orderstatus", "o_totalprice"))


_B = "(select o_orderkey, case when o_orderkey % 7 = 0 then 'X' else o_orderstatus end as o_orderstatus, o_totalprice from orders where o_orderkey % 11 != 0 union all select o_orderkey + 10000000, o_orderstatus, o_totalprice from orders where o_orderkey % 13 = 0)"


@query(f"""select distinct cast(o_orderkey as varchar) as o_orderkey, 'a' as side from orders where o_orderkey not in (select o_orderkey from {_B}) union all select distinct cast(o_orderkey as varchar), 'b' from {_B} where o_orderkey not in (select o_orderkey from orders)""")
def compare_only_in(spark: SparkSession, d: str) -> DataFrame:
    a, b = _perturbed(spark, d)
    return combine.only_in(a, b, ["o_orderkey"]).withColumn("side", F.lit("a")).unionAll(combine.only_in(b, a, ["o_orderkey"]).withColumn("side", F.lit("b")))


@query(f"""select 'o_orderstatus' as "column", count(*) as changed from orders a join {_B} b using (o_orderkey) where coalesce(a.o_orderstatus, '') != coalesce(b.o_orderstatus, '')""")
def compare_changed(spark: SparkSession, d: str) -> DataFrame:
    return combine.change_counts(*_perturbed(spark, d), ["o_orderkey"])


# ---- fact store


@query("""select key, entity_id, fact_id, value from (select *, row_number() over (partition by key, entity_id order by fact_id desc) as r from (select distinct * from fact) where superseded_by is null) where r = 1""")
def facts_current(spark: SparkSession, d: str) -> DataFrame:
    return facts.current(table(spark, d, "fact", "fact_id", "key", "entity_id", "value", "superseded_by")).select("key", "entity_id", "fact_id", "value")


@query("""with l as (select distinct fact_id, key, entity_id, value from fact where superseded_by is null), g as (select key, count(distinct coalesce(cast(entity_id as varchar), '')) as entities, max(fact_id) as m from l group by 1)
select g.key, case when entities = 1 then fact_id end as fact_id, case when entities = 1 then entity_id end as entity_id, case when entities = 1 then value end as value, entities > 1 as ambiguous, entities from g join l on l.fact_id = g.m""")
def facts_by_key(spark: SparkSession, d: str) -> DataFrame:
    return facts.by_key(table(spark, d, "fact", "fact_id", "key", "entity_id", "value", "superseded_by"))


@query("""select 'facts' as what, count(distinct fact_id) as n from fact union all select 'live_facts', count(distinct fact_id) from fact where superseded_by is null union all select 'unassigned_facts', count(distinct fact_id) from fact where entity_id is null
 union all select 'missing_facts', count(distinct fact_id) from fact where status = 'missing' union all select 'suspect_facts', count(distinct fact_id) from fact where status = 'suspect' union all select 'keys', count(distinct key) from fact
 union all select 'batches', count(distinct batch_no) from fact union all select 'entities', count(distinct entity_id) from entity union all select 'sources', count(distinct source_id) from source_file""")
def facts_summary(spark: SparkSession, d: str) -> DataFrame:
    return facts.summary(table(spark, d, "fact", "fact_id", "key", "entity_id", "status", "superseded_by", "batch_no"), table(spark, d, "entity", "entity_id"), table(spark, d, "source_file", "source_id"))


@query("""select distinct f.fact_id, e.entity_type, s.name as source_name, s.path as source_path from fact f left join entity e using (entity_id) left join source_file s on s.source_id = f.source_id where superseded_by is null""")
def facts_lineage(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "fact", "fact_id", "entity_id", "source_id", "superseded_by")
    return facts.lineage(f, table(spark, d, "entity", "entity_id", "entity_type"), table(spark, d, "source_file", "source_id", "name", "path")).select("fact_id", "entity_type", "source_name", "source_path")


@query("""select distinct fact_id, key, value, coalesce(confidence, 1.0) as confidence from fact where superseded_by is null and coalesce(confidence, 1.0) >= 0.9 and contains(key, '金额')""")
def facts_show(spark: SparkSession, d: str) -> DataFrame:
    return facts.show(table(spark, d, "fact", "fact_id", "key", "value", "confidence", "superseded_by"), key_part="金额", least_confidence=0.9).select("fact_id", "key", "value", F.coalesce("confidence", F.lit(1.0)).alias("confidence"))


@query("""select key, entity_id, count(distinct coalesce(value, '')) as distinct_values from fact where superseded_by is null and entity_id is not null group by 1, 2 having count(distinct coalesce(value, '')) > 1""")
def conflict_groups(spark: SparkSession, d: str) -> DataFrame:
    return facts.conflicts(table(spark, d, "fact", "fact_id", "key", "entity_id", "value", "superseded_by"))


@query("""select entity_id, name from (select *, row_number() over (partition by entity_id order by case when name_kind = '现用名' then 0 else 1 end, name_id) as r from entity_name where entity_id is not null) where r = 1""")
def names_preferred(spark: SparkSession, d: str) -> DataFrame:
    return facts.preferred_names(table(spark, d, "entity_name", "entity_id", "name_id", "name", "name_kind"))


@query("""select entity_id, max(case_id) as case_id from credit_case where entity_id is not null group by 1""")
def case_latest(spark: SparkSession, d: str) -> DataFrame:
    return facts.latest_case(table(spark, d, "credit_case", "entity_id", "case_id"))


@query("""with f as (select distinct fact_id, batch_no, key, entity_id, value from fact where superseded_by is null), x as (select *, row_number() over (partition by batch_no, key, entity_id order by fact_id desc) as r from f where fact_id % 2 = 0), o as (select * from x where r = 1),
i as (select * from f where fact_id % 2 = 1), j as (select i.*, o.fact_id is not null as had, o.value as stored from i left join o on i.batch_no is not distinct from o.batch_no and i.key = o.key and i.entity_id is not distinct from o.entity_id),
w as (select *, count(*) over b > 0 as earlier, first_value(case when trim(value) != '' then value end ignore nulls) over b as seen from j window b as (partition by batch_no, key, entity_id order by fact_id rows between unbounded preceding and 1 preceding)),
s as (select *, case when trim(stored) != '' then stored else coalesce(seen, stored) end as old_value from w)
select fact_id as incoming_ord, case when not (had or earlier) then 'inserted' when coalesce(old_value, '') = coalesce(value, '') then 'unchanged' when coalesce(trim(old_value), '') = '' and coalesce(trim(value), '') != '' then 'superseded' else 'conflict' end as action from s""")
def put_fact_actions(spark: SparkSession, d: str) -> DataFrame:
    """The facts with odd ids put into a store of those with even ones, each held against what stands."""
    f = table(spark, d, "fact", "fact_id", "batch_no", "key", "entity_id", "value", "superseded_by")
    incoming = facts.live(f.filter("fact_id % 2 = 1")).withColumnRenamed("fact_id", "ord").drop("superseded_by")
    return facts.put(f.filter("fact_id % 2 = 0"), incoming).select("incoming_ord", "action")


@query("""with f as (select distinct fact_id, key, entity_id, value from fact where superseded_by is null), l as (select *, row_number() over (partition by fact_id % 2, key, entity_id order by fact_id desc) as r from f), e as (select * from l where r = 1 and fact_id % 2 = 0), i as (select * from l where r = 1 and fact_id % 2 = 1),
j as (select i.key, i.entity_id, e.value as existing, i.value as incoming, case when coalesce(trim(i.value), '') = '' then case when e.key is not null then 'incoming_blank' end when e.key is null then 'new' when coalesce(e.value, '') = coalesce(i.value, '') then null when coalesce(trim(e.value), '') = '' then 'fill_blank' else 'conflict' end as kind
 from i left join e on i.key = e.key and i.entity_id is not distinct from e.entity_id)
select kind, count(*) as n, count(*) filter (regexp_matches(key, '账号|账户|卡号|金额|敞口|额度|保证金|余额|本金|利率|费率|息|日期|到期日|生效日|提款日|起始日|期限|身份证|证件号') and kind != 'fill_blank') as must_tick from j where kind is not null group by 1""")
def merge_plan(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "fact", "fact_id", "key", "entity_id", "value", "superseded_by")
    plan = facts.merge_plan(facts.current(f.filter("fact_id % 2 = 0")), facts.current(f.filter("fact_id % 2 = 1")))
    return plan.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if("must_tick").alias("must_tick"))


@query("""select distinct entity_id, uscc, upper(trim(uscc)) as code from entity where regexp_full_match(upper(trim(uscc)), '[0-9ABCDEFGHJKLMNPQRTUWXY]{18}') and substr('0123456789ABCDEFGHJKLMNPQRTUWXY', 1 + (31 - ("""
       + " + ".join(f"(instr('0123456789ABCDEFGHJKLMNPQRTUWXY', substr(upper(trim(uscc)), {i}, 1)) - 1) * {w}" for i, w in enumerate(facts.USCC_WEIGHTS, 1)) + """) % 31) % 31, 1) = substr(upper(trim(uscc)), 18, 1)""")
def uscc_check(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "entity", "entity_id", "uscc").distinct()
    return e.filter(facts.uscc_ok(F.col("uscc"))).select("entity_id", "uscc", F.upper(F.trim("uscc")).alias("code"))


@query("""with n as (select distinct entity_id, identity_pending_reason from entity where (coalesce(trim(uscc), '') = '' or lower(trim(uscc)) in ('n/a', '无', '待补')) and (coalesce(trim(id_card), '') = '' or lower(trim(id_card)) in ('n/a', '无', '待补')) and (coalesce(trim(bank_no), '') = '' or lower(trim(bank_no)) in ('n/a', '无', '待补')))
select entity_id, exists (select 1 from fact f where f.entity_id = n.entity_id and superseded_by is null and key in ('借款人名称', '保证人名称') and coalesce(trim(value), '') != '') as has_evidence, coalesce(identity_pending_reason, '') as pending from n""")
def identity_gaps(spark: SparkSession, d: str) -> DataFrame:
    return facts.identity_gaps(table(spark, d, "entity"), table(spark, d, "fact", "fact_id", "key", "entity_id", "value", "superseded_by"), ["借款人名称", "保证人名称"])


@query("""select what, id, "at", text from (select distinct 'fact' as what, cast(fact_id as varchar) as id, created_at as "at", value as text from fact where key = '借款用途' union all select distinct 'decision', fingerprint, decided_at, value from fill_decision where field = '借款用途')""")
def facts_trace(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "fact", "fact_id", "key", "created_at", "value").distinct().select(F.col("fact_id").alias("id"), "key", F.col("created_at").alias("at"), F.col("value").alias("text"))
    g = table(spark, d, "fill_decision", "fingerprint", "field", "decided_at", "value").distinct().select(F.col("fingerprint").alias("id"), F.col("field").alias("key"), F.col("decided_at").alias("at"), F.col("value").alias("text"))
    return facts.trace("借款用途", fact=f, decision=g)


_CLAIM = "case when contains(key, '保证人') then '保证人' when contains(key, '借款人') then '借款人' when contains(key, '法定代表人') then '法定代表人' end"
_ROLES = "select distinct entity_id, case when contains(key, '保证人') then '保证人' else '借款人' end as role from fact where entity_id is not null and (contains(key, '保证人') or contains(key, '借款人'))"
_HELD = f"""with r as ({_ROLES}), f as (select distinct fact_id, key, entity_id, value, {_CLAIM} as claimed from fact where superseded_by is null),
h as (select f.*, r.entity_id is not null as holds from f left join r on r.entity_id = f.entity_id and r.role = f.claimed)"""


def _scoped(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Facts of all entities with a case; an entity holds the company roles that its facts' keys name, nobody is a legal representative."""
    f = table(spark, d, "fact", "fact_id", "key", "entity_id", "value", "superseded_by")
    role = F.when(F.col("key").contains("保证人"), "保证人").when(F.col("key").contains("借款人"), "借款人")
    roles = f.filter("entity_id is not null").select("entity_id", role.alias("role")).filter("role is not null").distinct()
    scopes = table(spark, d, "credit_case", "entity_id").filter("entity_id is not null").distinct().select(F.col("entity_id").alias("subject"), "entity_id")
    return facts.for_subjects(f, roles, scopes)


@query(_HELD + """, s as (select distinct entity_id as subject from credit_case where entity_id is not null)
select subject, key, case when count(*) = 1 then max(fact_id) end as fact_id, case when count(*) = 1 then max(value) end as value, count(*) > 1 as ambiguous, count(*) as candidates from h join s on s.subject = h.entity_id where claimed is null or holds group by 1, 2""")
def role_scoped_facts(spark: SparkSession, d: str) -> DataFrame:
    return _scoped(spark, d)[0]


@query(_HELD + """, c as (select key, count(*) filter (holds) as role, count(*) filter (entity_id is null) as none, max(fact_id) filter (holds) as a, max(fact_id) filter (entity_id is null) as b from h group by 1), n as (select key, case when role > 0 then role else none end as n, case when role > 0 then a else b end as m from c)
select key, case when n = 1 then m end as fact_id, case when n = 1 then (select any_value(value) from f where fact_id = m) end as value, n > 1 as ambiguous, n as candidates from n where n > 0""")
def role_fallback_facts(spark: SparkSession, d: str) -> DataFrame:
    return _scoped(spark, d)[1]


# ---- audit


def _log(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    e = table(spark, d, "events", "event_id", "ts", "user_id", "event_type", "props")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(F.col("user_id").cast("string").alias("batch_no"), seq.cast("bigint").alias("seq"), "event_type", F.col("props").alias("payload_json"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("occurred_at"), F.lit(None).cast("string").alias("actor_id"), F.lit(None).cast("string").alias("run_id"), F.col("user_id").alias("entity_id"))


@query("""select count(*) as "rows", count(*) as hash_ok, count(*) as link_ok, count(*) as payload_ok from events""")
def audit_chain_verify(spark: SparkSession, d: str) -> DataFrame:
    return audit.verified(audit.appended(_log(spark, d))).agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(c) for c in ("hash_ok", "link_ok", "payload_ok")])


@query("""select count(*) as "rows", count(*) filter (seq != 3) as payload_ok from (select row_number() over (partition by user_id order by ts, event_id) as seq from events)""")
def audit_chain_tampered(spark: SparkSession, d: str) -> DataFrame:
    log = audit.appended(_log(spark, d)).withColumn("payload_json", F.when(F.col("seq") == 3, F.lit("{}tampered")).otherwise(F.col("payload_json")))
    return audit.verified(log).agg(F.count(F.lit(1)).alias("rows"), F.count_if("payload_ok").alias("payload_ok"))


# ---- matching and the decision plan

# Synonyms of some fields of the test tables.
SYNONYMS = {"联系电话": ("电话", "联系方式", "手机"), "开户行": ("开户银行", "开户行名称"), "账号": ("帐号", "银行账号", "账户", "收款账号"), "授信额度": ("额度", "授信金额"), "证件号码": ("证件号", "有效证件号码"), "合同金额": ("金额", "借款金额"), "注册地址": ("住所", "地址", "办公地址"), "法定代表人": ("法人", "法人代表")}


_SYN = "(select unnest([" + ", ".join(f"'{k}'" for k, ws in SYNONYMS.items() for _ in ws) + "]) as a, unnest([" + ", ".join(f"'{w}'" for ws in SYNONYMS.values() for w in ws) + "]) as b)"


@query(f"""with l as (select distinct field as label from fill_decision where field is not null), k as (select distinct key from fact where key is not null), s as {_SYN}, p as (select a, b from s union select b, a from s union select x.b, y.b from s x join s y using (a)),
c as (select label, key, case when label = key then 1.0 when exists (select 1 from p where p.a = label and p.b = key) then 0.9 when contains(label, key) or contains(key, label) then 0.82 end as score from l, k),
r as (select *, row_number() over (partition by label order by score desc, key) as rank, max(score) over (partition by label) as best from c where score is not null)
select label, key, cast(score as double) as score, cast(rank as int) as rank, score = best and count(*) filter (score = best) over (partition by label) > 1 as tied from r qualify rank <= 4""")
def label_candidates_by_rule(spark: SparkSession, d: str) -> DataFrame:
    """As label_candidates, without likeness: equal, synonyms, one within the other. The fields are their own forms."""
    syn = spark.createDataFrame([(k, w) for k, ws in SYNONYMS.items() for w in ws], "name string, word string")
    scores = decide.scored(table(spark, d, "fill_decision", "field").select(F.col("field").alias("label")).distinct(), table(spark, d, "fact", "key").distinct(), syn, fuzzy=False)
    return decide.best_candidates(scores).select("label", "key", "score", "rank", "tied")


@query()
def label_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Fields of fill decisions against keys of facts: the four best keys of each field."""
    syn = spark.createDataFrame([(k, w) for k, ws in SYNONYMS.items() for w in ws], "name string, word string")
    scores = decide.scored(table(spark, d, "fill_decision", "field").select(F.col("field").alias("label")).distinct(), table(spark, d, "fact", "key").distinct(), syn)
    return decide.best_candidates(scores).select("label", "key", "score", "rank", "tied")


@query("""with c as (select key, count(distinct coalesce(cast(entity_id as varchar), '')) > 1 as ambiguous, max(fact_id) as m from fact where superseded_by is null group by 1), p as (select distinct c.key, ambiguous, f.value, coalesce(f.confidence, 1.0) as confidence from c join fact f on f.fact_id = c.m)
select key, case when ambiguous then 'ask' when coalesce(trim(value), '') = '' then 'empty' when confidence < 0.85 then 'ask' when regexp_matches(key, '账号|账户|卡号|金额|敞口|额度|保证金|余额|本金|利率|费率|息|日期|到期日|生效日|提款日|起始日|期限|身份证|证件号') then 'ask' else 'auto' end as decision from p""")
def fill_decisions(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "fact", "fact_id", "key", "entity_id", "value", "confidence", "superseded_by")
    k = facts.by_key(f).select("key", "ambiguous")
    newest = facts.latest(facts.live(f).select("key", "fact_id", "value", "confidence"), ["key"], "fact_id")
    no = F.lit(False)
    return k.join(newest, "key").select("key", decide.decision(F.col("ambiguous"), F.col("value"), no, no, F.coalesce("confidence", F.lit(1.0)), F.col("key")).alias("decision"))


@query("""select field, coalesce(value, '') as value, count(distinct template_sha256) as places, count(*) as asked from (select distinct * from fill_decision) group by 1, 2""")
def question_groups(spark: SparkSession, d: str) -> DataFrame:
    plan = table(spark, d, "fill_decision").distinct().select("field", F.coalesce("value", F.lit("")).alias("value"), "template_sha256")
    return decide.questions(plan, ["field", "value"], "template_sha256").drop("question")


@query("""select kind, action, count(distinct fingerprint) as n from (select *, case when regexp_matches(field, '账号|账户|卡号') then '收款账号' when regexp_matches(field, '金额|敞口|额度|保证金|余额|本金') then '金额' when regexp_matches(field, '利率|费率|息') then '利率' when regexp_matches(field, '日期|到期日|生效日|提款日|起始日|期限') then '日期' when regexp_matches(field, '身份证|证件号') then '证件号码' end as kind from fill_decision) group by 1, 2""")
def high_risk_actions(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "fill_decision", "fingerprint", "field", "action")
    return g.groupBy(facts.high_risk(F.col("field")).alias("kind"), "action").agg(F.countDistinct("fingerprint").alias("n"))


# ---- extraction


@query("""with l as (select doc_id, unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) as t from documents where text is not null), m as (select doc_id, regexp_extract(t, '^\\s*([^:：。；;，,\\n]{1,20}?)\\s*[:：]\\s*(.*?)\\s*$', 1) as a, regexp_extract(t, '^\\s*([^:：。；;，,\\n]{1,20}?)\\s*[:：]\\s*(.*?)\\s*$', 2) as v from l)
select regexp_replace(a, '[\\s\\x{3000}\\x{85}\\x{a0}]+', '', 'g') as label, count(*) as "rows", count(*) filter (length(v) > 80) as too_long from m where v != '' and a != '' group by 1""")
def label_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = extract.labelled(extract.lines(table(spark, d, "documents", "doc_id", "text"))).filter("label is not null and label != ''")
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("issue") == "too long").alias("too_long"))


@query("""select doc_id, cast(length(regexp_replace(text, '[^\\x{4e00}-\\x{9fff}]', '', 'g')) as int) as cjk, cast(len(regexp_extract_all(text, '[A-Za-z]+')) as int) as words, cast(length(text) as int) as chars from documents where text is not null""")
def text_stats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").filter("text is not null").select("doc_id", extract.text_counts(F.col("text")).alias("c")).select("doc_id", "c.*")


# ---- files


def _files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_file", "source_id", "path", "name", "sha256", "bytes", "batch_no").dropDuplicates(["source_id"])


_CATEGORY = "case " + " ".join(f"when lower(regexp_extract(name, '(\\.[^./\\\\]+)$', 1)) in ({', '.join(repr(e) for e in ends)}) then '{c}'" for c, ends in files.CATEGORIES.items()) + f" else '{files.OTHER}' end"


@query(f"""select {_CATEGORY} as category, count(*) as files, cast(sum(bytes) as bigint) as bytes from (select distinct source_id, name, bytes from source_file) group by 1""")
def inventory_by_category(spark: SparkSession, d: str) -> DataFrame:
    return files.by_category(_files(spark, d))


@query("""select lower(regexp_extract(name, '(\\.[^./\\\\]+)$', 1)) as suffix, count(*) as files, cast(sum(bytes) as bigint) as bytes from (select distinct source_id, name, bytes from source_file) group by 1 order by 2 desc, 1 limit 30""")
def inventory_by_suffix(spark: SparkSession, d: str) -> DataFrame:
    return files.by_suffix(_files(spark, d))


@query("""select sha256(text) as digest, count(*) as files, max(octet_length(encode(text))) as bytes, max(octet_length(encode(text))) * (count(*) - 1) as wasted from documents where text != '' group by 1 having count(*) > 1""")
def doc_duplicates(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents", "doc_id", "text").filter("text != ''")
    quick = F.xxhash64(F.length("text"), F.substring("text", 1, 64), F.substring("text", -64, 64))
    rows = t.select("doc_id", F.octet_length("text").cast("bigint").alias("bytes"), quick.alias("quick"), F.sha2("text", 256).alias("digest"))
    return files.duplicates(rows, "quick", "digest")


@query("""select source_id, bytes from (select distinct source_id, bytes from source_file) order by bytes desc, source_id limit 20""")
def files_largest(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).select("source_id", "bytes").orderBy(F.desc("bytes"), "source_id").limit(20)


@query("""select upper(substr(name, 1, 1)) as bucket, count(*) as files from (select distinct source_id, name from source_file) group by 1""")
def files_organised(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).groupBy(files.bucket("first-letter").alias("bucket")).agg(F.count(F.lit(1)).alias("files"))


# ---- quality and migration


@query("""select l_partkey as template, l_suppkey as field, rule_id from (select *, row_number() over (partition by l_partkey, l_suppkey order by l_discount desc, rule_id) as r from (select *, l_orderkey * 10 + l_linenumber as rule_id from (select distinct l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount from lineitem))) where r = 1""")
def rule_keep_best(spark: SparkSession, d: str) -> DataFrame:
    rules = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount").distinct()
    rules = rules.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("rule_id"), F.col("l_partkey").alias("template"), F.col("l_suppkey").alias("field"), F.col("l_discount").alias("confidence"))
    return quality.best_rules(rules)[0].select("template", "field", "rule_id")


@query("""select distinct p_partkey as template, s_suppkey as rule_id from part join (select s_suppkey, s_suppkey % 200 + 1 as t from supplier) on p_partkey = t where s_suppkey % 5 != 0""")
def rules_active(spark: SparkSession, d: str) -> DataFrame:
    rules = table(spark, d, "supplier", "s_suppkey").select(F.col("s_suppkey").alias("rule_id"), (F.col("s_suppkey") % 200 + 1).alias("template"))
    templates = table(spark, d, "part", "p_partkey").select(F.col("p_partkey").alias("template"))
    return quality.active_rules(rules, templates, rules.filter("rule_id % 5 = 0")).select("template", "rule_id")


@query("""with u as (select distinct left(batch_no, 8) as day, cast(substr(batch_no, 10, 2) as int) as n from (select batch_no from fact union all select batch_no from source_file union all select batch_no from credit_case) where regexp_full_match(batch_no, '\\d{8}-\\d{2}'))
select day, (select case when min(g) is not null then day || '-' || lpad(cast(min(g) as varchar), 2, '0') end from (select unnest(generate_series(1, 99)) as g) where not exists (select 1 from u v where v.day = x.day and v.n = g)) as batch_no from (select distinct day from u) x""")
def batch_allocate(spark: SparkSession, d: str) -> DataFrame:
    used = table(spark, d, "fact", "batch_no").unionAll(table(spark, d, "source_file", "batch_no")).unionAll(table(spark, d, "credit_case", "batch_no")).distinct()
    return quality.next_batch(used, used.filter(F.col("batch_no").rlike(quality.BATCH)).select(F.substring("batch_no", 1, 8).alias("day")))


@query("""select 'batch_no of fact' as name, count(*) filter (not regexp_full_match(batch_no, '\\d{8}-\\d{2}')) = 0 as ok, count(*) filter (not regexp_full_match(batch_no, '\\d{8}-\\d{2}')) as detail from fact union all select 'batch_no of source_file', count(*) filter (not regexp_full_match(batch_no, '\\d{8}-\\d{2}')) = 0, count(*) filter (not regexp_full_match(batch_no, '\\d{8}-\\d{2}')) from source_file
 union all select 'batch_no of credit_case', count(*) filter (not regexp_full_match(batch_no, '\\d{8}-\\d{2}')) = 0, count(*) filter (not regexp_full_match(batch_no, '\\d{8}-\\d{2}')) from credit_case union all select 'batch_no of fill_decision', count(*) filter (not regexp_full_match(batch_no, '\\d{8}-\\d{2}')) = 0, count(*) filter (not regexp_full_match(batch_no, '\\d{8}-\\d{2}')) from fill_decision
 union all select name, bad = 0, bad from (with f as (select distinct * from fact) select 'status' as name, count(*) filter (coalesce(status, '') not in ('ok', 'missing', 'suspect')) as bad from f union all select 'source_kind', count(*) filter (coalesce(source_kind, '') not in ('source', 'computed', 'user')) from f
 union all select 'computed without formula', count(*) filter (source_kind = 'computed' and (formula is null or inputs is null)) from f union all select 'fact_id single', count(*) from (select fact_id from f group by 1 having count(*) > 1) union all select 'superseded_by leads to a fact', count(*) from f where superseded_by is not null and superseded_by not in (select fact_id from f))""")
def dq_checks(spark: SparkSession, d: str) -> DataFrame:
    return quality.checks(table(spark, d, "fact"), {n: table(spark, d, n, "batch_no") for n in ("fact", "source_file", "credit_case", "fill_decision")})


@query("""select strftime(created_at::timestamptz at time zone 'UTC', '%Y-%m') as month, count(distinct entity_id) as entities from entity group by 1""")
def entities_per_month(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entity", "entity_id", "created_at").groupBy(F.date_format(iso_instant(F.col("created_at")), "yyyy-MM").alias("month")).agg(F.countDistinct("entity_id").alias("entities"))


# ---- writes of the store, as frames


@query("""select distinct source_id from source_file a where source_id % 2 = 1 and source_id = (select min(source_id) from source_file m where m.source_id % 2 = 1 and m.path is not distinct from a.path and m.sha256 is not distinct from a.sha256) and not exists (select 1 from source_file b where b.source_id % 2 = 0 and b.path = a.path and b.sha256 = a.sha256)""")
def sources_registered(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "source_file", "source_id", "path", "sha256").distinct()
    return store.new_sources(s.filter("source_id % 2 = 1"), s.filter("source_id % 2 = 0")).select("source_id")


@query("""select subject_name as name, min(n.entity_id) as entity_id, min(n.entity_id) is null as is_new from (select distinct subject_name from ledger_subject where subject_name is not null) l left join entity_name n on n.name = l.subject_name group by 1""")
def entities_resolved(spark: SparkSession, d: str) -> DataFrame:
    return store.resolved_entities(table(spark, d, "ledger_subject", "subject_name").withColumnRenamed("subject_name", "name"), table(spark, d, "entity_name", "name", "entity_id"))


@query("""select template, field, rule_id from (select *, row_number() over (partition by template, field order by rule_id % 2 desc, rule_id desc) as r from (select distinct l_partkey as template, l_suppkey as field, l_orderkey * 10 + l_linenumber as rule_id from lineitem)) where r = 1 and rule_id % 2 = 1
 union all select template, field, max(rule_id) from (select distinct l_partkey as template, l_suppkey as field, l_orderkey * 10 + l_linenumber as rule_id from lineitem) group by 1, 2 having max(rule_id % 2) = 0""")
def rules_upserted(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "lineitem", "l_partkey", "l_suppkey", "l_orderkey", "l_linenumber").select(F.col("l_partkey").alias("template"), F.col("l_suppkey").alias("field"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("rule_id")).distinct()
    stored = facts.latest(r.filter("rule_id % 2 = 0"), ["template", "field"], "rule_id")
    return store.upserted(stored, r.filter("rule_id % 2 = 1"), ["template", "field"], "rule_id")


@query("""with f as (select distinct fact_id, key, entity_id, value from fact where superseded_by is null), h as (select distinct entity_id, case when contains(key, '保证人') then '保证人' else '借款人' end as role from fact where entity_id is not null and key in ('借款人名称', '保证人名称')),
r as (select role || key as alias, fact_id, entity_id, value from f join h using (entity_id) where not contains(key, '法定代表人') and not contains(key, '保证人') and not contains(key, '借款人') and coalesce(trim(value), '') != ''), g as (select alias, max(fact_id) as m, count(distinct (entity_id, value)) as n from r group by 1)
select alias, case when n = 1 then m end as fact_id, case when n = 1 then (select min(value) from r where r.fact_id = m and r.alias = g.alias) end as value, n > 1 as ambiguous from g""")
def role_aliases(spark: SparkSession, d: str) -> DataFrame:
    """Facts named by the role that their entity's other facts give it."""
    f = table(spark, d, "fact", "fact_id", "key", "entity_id", "value", "superseded_by")
    roles = f.filter("entity_id is not null and key in ('借款人名称', '保证人名称')").select("entity_id", facts.claimed_role(F.col("key")).alias("role"), F.lit("").alias("evidence")).distinct()
    return store.role_aliases(f, roles)


@query("""select run_id, field from (select distinct run_id, field from fill_decision where action = 'accept') where run_id in (select run_id from fill_decision where action = 'blank')""")
def fields_delivered(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "fill_decision", "run_id", "field", "action")
    ops = g.filter("action = 'accept'").select("run_id", F.lit("field").alias("kind"), F.col("field").alias("target")).unionAll(g.filter("action = 'blank'").select("run_id", F.lit("artifact"), "field"))
    return store.delivered_fields(ops)


@query()
def values_digested(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "fact", "fact_id", "value").dropDuplicates(["fact_id"]).select("fact_id", store.sm3("value").alias("digest"))
