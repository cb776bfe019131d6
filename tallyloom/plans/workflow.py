"""Queries of the operators for questions, answers, ingest, labels, runs, listings and table structure, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.numbering import numbered
from tallyloom.operators import combine, decide, dialogue, extract, facts, files, pivot, profile, quality, store, tables
from tallyloom.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def live(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return facts.live(table(spark, d, "fact", *dict.fromkeys(("fact_id", "superseded_by", *columns)))).drop("superseded_by")


_LIVE = "(select distinct fact_id, batch_no, source_id, entity_id, case_id, key, value, confidence, source_kind, status, provenance from fact where superseded_by is null)"
_BLANK = "coalesce(regexp_replace({c}, '[\\s\\x{{3000}}\\x{{a0}}\\x{{200b}}]', '', 'g'), '') = ''"

# ---- questions and answers


@query("""select distinct fingerprint as item_id, field as kind from fill_decision where action = 'blank' and field = '借款用途'""")
def reviews_open(spark: SparkSession, d: str) -> DataFrame:
    """Decisions left blank as open reviews of one kind."""
    items = table(spark, d, "fill_decision", "fingerprint", "field", "action", "decided_at").select(F.col("fingerprint").alias("item_id"), F.col("field").alias("kind"), F.when(F.col("action") != "blank", F.col("decided_at")).alias("resolved_at"))
    return dialogue.open_items(items, "借款用途").select("item_id", "kind").distinct()


def _conflict_items(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Suspect facts as conflicts; each is answered twice, the answers of computed facts with a word that isn't allowed."""
    none = F.lit(None).cast("string")
    items = live(spark, d, "status", "source_kind").filter("status = 'suspect'")
    word = lambda first: F.when(F.col("source_kind") == "computed", "whatever").otherwise(first)
    answers = items.select(F.col("fact_id").alias("item_id"), F.inline(F.array(*[F.struct(word(a).alias("resolution"), F.lit("user").alias("resolved_by"), F.lit(t).alias("resolved_at")) for a, t in (("left_blank", "2024-01-01"), ("took_incoming", "2024-01-02"))])))
    return items.select(F.col("fact_id").alias("item_id"), none.alias("resolution"), none.alias("resolved_by"), none.alias("resolved_at")), answers


@query(f"""select fact_id as item_id, case when source_kind != 'computed' then 'took_incoming' end as resolution, case when source_kind != 'computed' then '2024-01-02' end as resolved_at from {_LIVE} where status = 'suspect'""")
def conflicts_settled(spark: SparkSession, d: str) -> DataFrame:
    return dialogue.settled(*_conflict_items(spark, d))[0].select("item_id", "resolution", "resolved_at")


@query(f"""select fact_id as item_id, t as resolved_at from {_LIVE}, (select unnest(['2024-01-01', '2024-01-02']) as t) where status = 'suspect' and source_kind = 'computed'""")
def conflicts_refused(spark: SparkSession, d: str) -> DataFrame:
    return dialogue.settled(*_conflict_items(spark, d))[1].select("item_id", "resolved_at")


@query("""select distinct fingerprint, run_id, case when action = 'new' then case when length(run_id) % 2 = 0 then 'approve' else 'reject' end end as signoff_decision from fill_decision""")
def runs_signed_off(spark: SparkSession, d: str) -> DataFrame:
    """New fields stand for artifacts; every run is signed off, by the length of its name."""
    ops = table(spark, d, "fill_decision", "fingerprint", "run_id", "action").distinct().withColumn("kind", F.when(F.col("action") == "new", "artifact").otherwise("field"))
    asked = ops.select("run_id").distinct().select("run_id", F.when(F.length("run_id") % 2 == 0, "approve").otherwise("reject").alias("decision"), F.lit("batch").alias("scope"), F.lit("user").alias("actor"), F.lit("2024").alias("at"))
    return dialogue.signed_off(ops, asked).select("fingerprint", "run_id", "signoff_decision")


def _page(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    all_ = table(spark, d, "fill_decision", "fingerprint", "field", "action", "value").distinct()
    new = all_.filter("action in ('new', 'use')")
    plan = new.select(F.col("fingerprint").alias("n"), F.lit("ask").alias("decision"), (F.col("action") == "use").alias("ambiguous"), F.array("fingerprint").alias("candidates"))
    chosen = new.select(F.col("fingerprint").alias("n"), F.when(F.col("action") == "use", "use").otherwise("accept").alias("action"), F.concat(F.lit("#"), "fingerprint").alias("pick"))
    return all_.filter("action not in ('new', 'use')"), plan, chosen, new.withColumn("value", F.lit("saved"))


@query("""select distinct fingerprint, action, case when action in ('new', 'use') then 'saved' else value end as value from fill_decision""")
def decisions_saved(spark: SparkSession, d: str) -> DataFrame:
    """A page of new and chosen decisions, all answered, goes into those stored."""
    return dialogue.saved_page(*_page(spark, d), "value")[0].select("fingerprint", "action", "value")


@query("""select distinct fingerprint, action, value from fill_decision where action not in ('new', 'use')""")
def decisions_not_saved(spark: SparkSession, d: str) -> DataFrame:
    """The same page with the answers to ambiguous rows turned into plain acceptance: none of it goes in."""
    stored, plan, chosen, rows = _page(spark, d)
    return dialogue.saved_page(stored, plan, chosen.withColumn("action", F.lit("accept")), rows, "value")[0].select("fingerprint", "action", "value")


def _stated(spark: SparkSession, d: str) -> DataFrame:
    return live(spark, d, "key", "entity_id", "value").select(F.col("fact_id").alias("row_id"), "key", F.col("entity_id").cast("string").alias("entity_name"), "value")


_CONFLICTS = f"""v as (select key, cast(entity_id as varchar) as entity_name, value, count(*) as "rows" from {_LIVE} where value is not null group by 1, 2, 3),
o as (select *, row_number() over (partition by key, entity_name order by value) as option, count(*) over (partition by key, entity_name) as n from v)"""


@query(f"""with {_CONFLICTS} select key, entity_name, cast(option as int) as option, value, "rows" from o where n > 1""")
def value_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return dialogue.value_conflicts(_stated(spark, d))


@query(f"""with {_CONFLICTS}, p as (select key, entity_name, value as picked from o where n > 1 and option = 2),
r as (select f.fact_id as row_id, f.key, cast(entity_id as varchar) as entity_name, f.value, p.picked, p.key is not null as answered from {_LIVE} f left join p on p.key = f.key and p.entity_name is not distinct from cast(entity_id as varchar)),
k as (select *, answered and row_number() over (partition by key, entity_name order by coalesce(value = picked, false) desc, row_id) = 1 as kept from r)
select row_id, case when kept then picked else value end as value, answered and not kept as dropped, kept as by_user from k""")
def conflicts_answered(spark: SparkSession, d: str) -> DataFrame:
    """Every conflict answered with its second option."""
    rows = _stated(spark, d)
    answers = dialogue.value_conflicts(rows).filter("option = 2").select("key", "entity_name", F.col("option").alias("pick"), F.lit(None).cast("string").alias("custom"))
    return dialogue.answered_conflicts(rows, answers).select("row_id", "value", "dropped", "by_user")


@query(f"""with {_CONFLICTS} select distinct key, entity_name from o where n > 1""")
def ingest_stops(spark: SparkSession, d: str) -> DataFrame:
    return dialogue.ingestable(_stated(spark, d).withColumn("dropped", F.lit(False)))[1]


@query(f"""select key, cast(entity_id as varchar) as entity_name, max(fact_id) as row_id from {_LIVE} group by 1, 2""")
def ingest_rows(spark: SparkSession, d: str) -> DataFrame:
    """All but the newest row of each key and subject dropped, nothing stops the ingest."""
    rows = _stated(spark, d)
    last = rows.groupBy("key", "entity_name").agg(F.max("row_id").alias("row_id")).select("row_id", F.lit(False).alias("dropped"))
    return dialogue.ingestable(rows.join(last, "row_id", "left").fillna({"dropped": True}))[0].select("key", "entity_name", "row_id")


@query(f"""with q as (select source_id, key, value, provenance, count(distinct (fact_id)) as occurrences from {_LIVE} where entity_id is null group by 1, 2, 3, 4) select key, count(*) as questions, cast(sum(occurrences) as bigint) as occurrences from q group by 1""")
def ownership_questions(spark: SparkSession, d: str) -> DataFrame:
    """Facts without an entity, asked once for each that says the same from the same source."""
    none = F.lit(None).cast("string")
    rows = live(spark, d, "source_id", "key", "value", "provenance", "entity_id").filter("entity_id is null").select(F.coalesce(F.col("source_id").cast("string"), F.lit("none")).alias("source"), F.col("fact_id").alias("line"), F.coalesce("key", F.lit("")).alias("key"), F.coalesce("value", F.lit("\u0000")).alias("value"), none.alias("entity_name"), F.coalesce("provenance", F.lit("\u0000")).alias("quote"), none.alias("context"), F.lit(False).alias("certificate"))
    return dialogue.ownership_questions(rows, F.lit("b")).groupBy("key").agg(F.count(F.lit(1)).alias("questions"), F.sum("occurrences").alias("occurrences"))


@query("""select distinct name_id, case when name_kind = '别名' then name when name_kind = '曾用名' then '甲公司' else name end as entity_name, coalesce(name_kind = '别名', false) as dropped from entity_name""")
def ownership_answered(spark: SparkSession, d: str) -> DataFrame:
    """Other names left out, former ones given to an offered owner."""
    rows = table(spark, d, "entity_name", "name_id", "name", "name_kind").distinct().withColumn("question", F.col("name_id").cast("string")).withColumnRenamed("name", "entity_name")
    answers = rows.filter("name_kind in ('别名', '曾用名')").select("question", F.when(F.col("name_kind") == "别名", "暂不收录").otherwise("归属：甲公司（推荐）").alias("selected"), F.lit("  ").alias("custom"))
    return dialogue.answered_ownership(rows, answers).select("name_id", "entity_name", "dropped")


def _owner_parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = live(spark, d, "key", "value", "entity_id", "source_kind").select(F.col("fact_id").alias("row_id"), "key", "value", F.when(F.col("source_kind") == "user", F.col("entity_id")).alias("declared"))
    names = table(spark, d, "entity_name", "name", "entity_id").filter("name is not null and entity_id is not null").distinct()
    holders = table(spark, d, "credit_case", "entity_id", "product_code").filter("entity_id is not null").agg(F.min("entity_id").alias("entity_id")).select(F.lit("保证人").alias("role"), "entity_id")
    return rows, names, holders


_NAMES = "(select name, min(entity_id) as e from entity_name where entity_id is not null and name is not null group by 1 having min(entity_id) = max(entity_id))"
_CLAIM = "case when contains(key, '法定代表人') then '法定代表人' when contains(key, '保证人') then '保证人' when contains(key, '借款人') then '借款人' end"


@query(f"""with h as (select min(entity_id) as e from credit_case), r as (select fact_id, key, value, case when source_kind = 'user' then entity_id end as declared, {_CLAIM} as role from {_LIVE})
select fact_id as row_id, coalesce(n.e, declared, case when role = '保证人' then (select e from h) end, 7) as entity_id, case when n.e is not null then 'name' when declared is not null then 'declared' when role = '保证人' then 'role' else 'default' end as basis
 from r left join {_NAMES} n on n.name = r.value and r.key like '%名称'""")
def fact_owners(spark: SparkSession, d: str) -> DataFrame:
    rows, names, holders = _owner_parts(spark, d)
    return dialogue.fact_owners(rows, names, holders.limit(0), holders, 7).select("row_id", "entity_id", "basis")


@query(f"""with s as (select distinct value as name from {_LIVE} where key like '%名称' and value != ''), x as (select name from s where name not in (select name from entity_name where name is not null and entity_id is not null))
select name, (select max(entity_id) from entity_name) + row_number() over (order by name) as entity_id from x""")
def ingest_names(spark: SparkSession, d: str) -> DataFrame:
    return dialogue.ingested(*_owner_parts(spark, d))[0]


@query(f"""with s as (select distinct value as name from {_LIVE} where key like '%名称' and value != ''), x as (select name, (select max(entity_id) from entity_name) + row_number() over (order by name) as e from s where name not in (select name from entity_name where name is not null and entity_id is not null)),
n as (select name, min(e) as e, max(e) as z from (select name, entity_id as e from entity_name where entity_id is not null and name is not null union select * from x) group by 1),
c as (select distinct {_CLAIM} as role, n.e, n.z, f.value as name from {_LIVE} f join n on n.name = f.value where key like '%名称'), p as (select role, min(e) as e from c where role is not null group by 1 having min(e) = max(z)),
r as (select fact_id, key, value, case when source_kind = 'user' then entity_id end as declared, {_CLAIM} as role from {_LIVE}), h as (select min(entity_id) as e from credit_case)
select fact_id as row_id, coalesce(case when n.e = n.z then n.e end, declared, p.e, case when r.role = '保证人' then (select e from h) end) as entity_id from r left join n on n.name = r.value and r.key like '%名称' left join p on p.role = r.role""")
def ingest_facts(spark: SparkSession, d: str) -> DataFrame:
    return dialogue.ingested(*_owner_parts(spark, d))[1].select("row_id", "entity_id")


@query(f"""select distinct batch_no, 'fact_discarded' as event_type, key as target, fact_id from {_LIVE} where status = 'suspect'""")
def facts_discarded(spark: SparkSession, d: str) -> DataFrame:
    rows = live(spark, d, "batch_no", "key", "value", "status").filter("status = 'suspect'").withColumn("reason", F.col("fact_id").cast("string"))
    return facts.discarded(rows, F.lit("2024-01-01")).select("batch_no", "event_type", "target", F.get_json_object("payload", "$.reason").cast("bigint").alias("fact_id"))


# ---- labels, lines and slots

_TEXT = "coalesce('借款人：' || subject_name, '') || coalesce(' 联系电话：' || phone_text, '') || coalesce(chr(9) || '地址: ' || address_text, '')"
_BEHIND = "\\s+(" + "|".join(sorted(extract.INLINE, key=lambda w: (-len(w), w))) + ")\\s*[:：]"
_LABEL = "'^\\s*([^:：。；;，,\\n]{1,20}?)\\s*[:：]\\s*(.*?)\\s*$'"


@query(f"""with t as (select distinct record_id as doc_id, {_TEXT} as x from ledger_subject), p as (select doc_id, string_split(case when regexp_matches(x, {_LABEL}) then regexp_replace(x, '{_BEHIND}', chr(1) || '\\1：', 'g') else x end, chr(1)) as a from t)
select doc_id, cast(i - 1 as int) as part, a[i] as line_text from (select doc_id, a, unnest(range(1, len(a) + 1)) as i from p)""")
def label_splits(spark: SparkSession, d: str) -> DataFrame:
    """Ledger entries as lines of several labelled values."""
    r = table(spark, d, "ledger_subject", "record_id", "subject_name", "phone_text", "address_text").distinct()
    part = lambda word, c: F.coalesce(F.concat(F.lit(word), c), F.lit(""))
    lines = r.select(F.col("record_id").alias("doc_id"), F.lit(0).alias("line"), F.concat(part("借款人：", "subject_name"), part(" 联系电话：", "phone_text"), part("\t地址: ", "address_text")).alias("line_text"))
    return extract.split_labels(lines).select("doc_id", "part", "line_text")


_LINES = f"""l as (select doc_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) as a from documents where text is not null), e as (select doc_id, unnest(range(0, len(a))) as line, unnest(a) as t from l),
m as (select *, regexp_extract(t, {_LABEL}, 1) as a, regexp_extract(t, {_LABEL}, 2) as v from e), b as (select doc_id, line, t, case when a != '' and v != '' then regexp_replace(a, '[\\s\\x{{3000}}\\x{{85}}\\x{{a0}}]+', '', 'g') end as label, case when a != '' and v != '' and length(v) <= 80 then v end as value from m)"""
_IN = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"


@query(f"""with {_LINES}, c as (select *, case when regexp_matches(coalesce(label, t), '保证合同') then 'guarantee' when regexp_matches(coalesce(label, t), '借款合同|贷款合同|授信合同|授信协议') then 'other' end as title,
  case when value is null then null when regexp_full_match(label, '保证人[（(]?[0-9一二三四五六七八九十]+[）)]?(名称)?') then '保证人' when label in {_IN(extract.SUBJECTS["借款人"])} then '借款人' when label in {_IN(extract.SUBJECTS["保证人"])} then '保证人' end as names from b),
g as (select *, last_value(case when names = '借款人' then value end ignore nulls) over w as borrower, last_value(case when names = '保证人' then value end ignore nulls) over w as guarantor, sum(cast(title is not null as int)) over w as section from c window w as (partition by doc_id order by line rows between unbounded preceding and current row)),
h as (select *, nullif(last_value(case when names is not null then names when title = 'guarantee' then '' when title is not null then case when borrower is not null then '借款人' else '' end end ignore nulls) over w, '') as present,
  nullif(last_value(case when names is not null or title is not null then '' when value is not null and (label in ('法定代表人', '法人代表', '法人') or regexp_matches(label, '^(借款人|保证人).*(法定代表人|法人代表|法人)$')) then value end ignore nulls) over w, '') as person,
  case when starts_with(label, '借款人') then '借款人' when starts_with(label, '保证人') then '保证人' end as starts, coalesce(label in {_IN(extract.CERTIFICATES)}, false) as cert from g window w as (partition by doc_id order by line rows between unbounded preceding and current row)),
k as (select *, case when cert then present else coalesce(starts, present) end as who from h)
select doc_id, cast(line as int) as line, label, value, case when names is not null then value when cert and person is not null then person when who = '借款人' then borrower when who = '保证人' then guarantor end as owner, cast(section as bigint) as section from k where label is not null""")
def ownership_carry_forward(spark: SparkSession, d: str) -> DataFrame:
    rows = extract.owned(extract.labelled(extract.lines(table(spark, d, "documents", "doc_id", "text"))))
    return rows.filter("label is not null").select("doc_id", "line", "label", "value", "owner", "section")


@query(f"""with {_LINES} select doc_id, cast(line as int) as line from b where label is null and not regexp_full_match(t, '本次借款金额为人民币(\\d+(\\.\\d+)?)元[。.]?') and regexp_matches(t, '{extract.NARRATIVE}')""")
def narrative_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = extract.narratives(extract.labelled(extract.lines(table(spark, d, "documents", "doc_id", "text"))))
    return rows.filter("narrative is not null").select("doc_id", "line")


@query("""select distinct fact_id as doc, case when {b} then cast(1 as int) end as col, key as label, coalesce(confidence < 0.8, false) as required from fact where {b} and key is not null""".replace("{b}", _BLANK.format(c="value")))
def cell_labels(spark: SparkSession, d: str) -> DataFrame:
    """Facts as rows of two cells, the key with a star where the confidence is low."""
    f = table(spark, d, "fact", "fact_id", "key", "value", "confidence").distinct()
    star = F.concat("key", F.when(F.col("confidence") < 0.8, "*").otherwise(""))
    cells = f.select(F.col("fact_id").alias("doc"), F.lit(0).alias("row"), F.inline(F.array(F.struct(F.lit(0).alias("col"), star.alias("text")), F.struct(F.lit(1).alias("col"), F.col("value").alias("text")))))
    return extract.cell_labels(cells).select("doc", "col", "label", "required")


@query("""with k as (select distinct key from fact where key is not null) select key, cast(length(key) + 1 as int) as start, cast(length(key) + 7 as int) as "end", key as label, false as protected from k union all select key, cast(length(key) + 10 as int), cast(length(key) + 11 as int), '签字', true from k""")
def line_slots(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "fact", "key").filter("key is not null").distinct()
    rows = k.select("key", F.lit(0).alias("line"), F.concat("key", F.lit("：______，签字□")).alias("line_text"))
    return extract.line_slots(rows, "key").select("key", "start", "end", "label", "protected")


@query("""select doc_id, cast(length(text) + length(regexp_replace(text, '[\\x{0}-\\x{2e80}]', '', 'g')) as int) as width from documents where text is not null""")
def text_widths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").filter("text is not null").select("doc_id", extract.text_width(F.col("text")).alias("width"))


@query("""select l_suppkey as page, count(l_tax) as boxes, round(round(avg(l_tax * 16), 4), 3) as mean, count(*) filter (l_tax * 16 < 0.6) as low from lineitem group by 1""")
def ocr_quality(spark: SparkSession, d: str) -> DataFrame:
    got = extract.ocr_quality(table(spark, d, "lineitem", "l_suppkey", "l_tax").select(F.col("l_suppkey").alias("page"), (F.col("l_tax") * 16).alias("confidence")))
    return got.withColumn("mean", F.round("mean", 3))


# ---- runs, templates, listings


def _ops(spark: SparkSession, d: str) -> DataFrame:
    """Live facts as the log of a run: a batch is a run, a computed fact an artifact of the template that its source is."""
    return live(spark, d, "batch_no", "entity_id", "source_id", "source_kind").select(F.col("fact_id").alias("op_id"), F.col("batch_no").alias("run_id"), "entity_id", F.col("source_id").alias("template_id"), F.when(F.col("source_kind") == "computed", "artifact").otherwise("field").alias("kind"))


@query(f"""select fact_id as op_id, e.entity_type, t.name as template_name from {_LIVE} f left join (select entity_id, min(entity_type) as entity_type from entity group by 1) e using (entity_id) left join (select source_id, min(name) as name from source_file group by 1) t on t.source_id = f.source_id where source_kind = 'computed'""")
def artifacts_joined(spark: SparkSession, d: str) -> DataFrame:
    templates = table(spark, d, "source_file", "source_id", "name").withColumnRenamed("source_id", "template_id")
    return store.artifacts(_ops(spark, d), table(spark, d, "entity", "entity_id", "entity_type"), templates).select("op_id", "entity_type", "template_name")


@query(f"""select source_id as template_id, max(fact_id) as op_id, max_by(batch_no, fact_id) as run_id from {_LIVE} where source_kind = 'computed' and source_id is not null group by 1""")
def artifacts_latest(spark: SparkSession, d: str) -> DataFrame:
    return store.latest_artifacts(_ops(spark, d))


@query(f"""with c as (select key, entity_id, value from (select *, row_number() over (partition by key, entity_id order by fact_id desc) as r from {_LIVE}) where r = 1)
select c.entity_id, n.e as person_id, p.key, p.value from c join {_NAMES} n on n.name = c.value join c p on p.entity_id = n.e where c.key = '借款人名称' and p.key in ('联系电话', '收款账号') and c.entity_id is not null""")
def representatives(spark: SparkSession, d: str) -> DataFrame:
    """From a fact that names a subject to the named subject's own facts."""
    return store.representatives(table(spark, d, "fact", "fact_id", "key", "entity_id", "value", "superseded_by"), table(spark, d, "entity_name", "name", "entity_id").distinct(), "借款人名称", ["联系电话", "收款账号"])


@query("""with o as (select distinct batch_no, cast(regexp_extract(run_id, '-(\\d+)$', 1) as bigint) as n from fill_decision), c as (select batch_no, count(*) as runs from o group by 1),
t as (select batch_no, unnest(range(runs + 1, 2 * runs + 2)) as n from c) select batch_no, batch_no || '-R' || min(n) as run_id from t where not exists (select 1 from o where o.batch_no = t.batch_no and o.n = t.n) group by 1""")
def runs_next(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "fill_decision", "batch_no", "run_id").distinct().select("batch_no", F.regexp_replace("run_id", r"-(\d+)$", "-R$1").alias("run_id"), F.lit("run").alias("kind"))
    return store.next_runs(r, r)


@query("""select batch_no, template_id, cast(dense_rank() over (partition by batch_no order by template_id) as int) as run from (select distinct batch_no, template_sha256 as template_id from fill_decision)""")
def run_numbers(spark: SparkSession, d: str) -> DataFrame:
    return store.run_numbers(table(spark, d, "fill_decision", "batch_no", "template_sha256").withColumnRenamed("template_sha256", "template_id"))


@query("""select fingerprint, row_number() over (order by batch_no, field, fingerprint) as n from (select distinct fingerprint, batch_no, field from fill_decision)""")
def plan_numbered(spark: SparkSession, d: str) -> DataFrame:
    return numbered(table(spark, d, "fill_decision", "fingerprint", "batch_no", "field").distinct(), "batch_no", "field", "fingerprint").select("fingerprint", "n")


@query(f"""select fact_id, key from {_LIVE} order by coalesce(confidence, 1.0) desc, fact_id limit 25""")
def facts_surest(spark: SparkSession, d: str) -> DataFrame:
    return facts.ordered(table(spark, d, "fact", "fact_id", "key", "confidence", "superseded_by"), "confidence").select("fact_id", "key").limit(25)


def _files(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files: the id is the path, the text's length the size."""
    return table(spark, d, "documents", "doc_id", "n_chars", "received_at", "source").select(F.concat(F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit(".txt")).alias("path"), F.concat("source", F.lit(".txt")).alias("name"), F.col("n_chars").alias("bytes"), F.col("received_at").alias("modified"))


_PATH = "'/' || lpad(cast(doc_id as varchar), 12, '0') || '.txt'"


@query(f"""select 'oldest' as which, {_PATH} as path from (select * from documents where received_at is not null order by received_at, doc_id limit 10) union all select 'newest', {_PATH} from (select * from documents where received_at is not null order by received_at desc, doc_id limit 10)
 union all select 'largest', {_PATH} from (select * from documents where n_chars is not null order by n_chars desc, doc_id limit 20)""")
def files_extremes(spark: SparkSession, d: str) -> DataFrame:
    f, out = _files(spark, d), None
    for which, n in (("oldest", 10), ("newest", 10), ("largest", 20)):
        part = files.extremes(f, which, n).select(F.lit(which).alias("which"), "path")
        out = part if out is None else out.unionAll(part)
    return out


@query(f"""select {_PATH} as path, (select count(*) from documents) > 200 as truncated from documents order by received_at desc nulls last, doc_id limit 200""")
def files_listed(spark: SparkSession, d: str) -> DataFrame:
    return files.listing(_files(spark, d)).select("path", "truncated")


@query("""select cast(received_at as date) < date '2023-06-01' - 100 as old, count(*) as "rows" from documents where cast(received_at as date) < date '2023-06-01' - 100 group by 1""")
def files_stale(spark: SparkSession, d: str) -> DataFrame:
    return files.stale(_files(spark, d), "2023-06-01", 100).groupBy(F.lit(True).alias("old")).agg(F.count(F.lit(1)).alias("rows"))


_BUCKETS = {"date": "strftime(received_at at time zone 'UTC', '%Y-%m-%d')", "year-month": "strftime(received_at at time zone 'UTC', '%Y-%m')", "extension": "'txt'", "first-letter": "upper(substr(source || '.txt', 1, 1))"}


@query(" union all ".join(f"""select '{by}' as by, {sql} as bucket, count(*) as files from documents where source is not null and received_at is not null group by 2""" for by, sql in _BUCKETS.items()))
def files_by_bucket(spark: SparkSession, d: str) -> DataFrame:
    """Every way of putting files into folders but the type, which files_organised has."""
    f, out = _files(spark, d).filter("name is not null and modified is not null"), None
    for by in _BUCKETS:
        part = f.groupBy(F.lit(by).alias("by"), files.bucket(by).alias("bucket")).agg(F.count(F.lit(1)).alias("files"))
        out = part if out is None else out.unionAll(part)
    return out


_KEEP = {"oldest": "received_at, path", "newest": "received_at desc, path", "shortest-path": "length(path), path", "longest-path": "length(path) desc, path"}


@query(" union all ".join(f"""select '{p}' as policy, path from (select *, row_number() over (partition by md5 order by {o}) as r from (select {_PATH} as path, received_at, md5(text) as md5 from documents where text is not null and received_at is not null)) where r = 1""" for p, o in _KEEP.items()))
def files_kept(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "documents", "doc_id", "text", "received_at").filter("text is not null and received_at is not null").select(F.concat(F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit(".txt")).alias("path"), F.md5(F.encode("text", "UTF-8")).alias("digest"), F.col("received_at").alias("modified"))
    out = None
    for policy in _KEEP:
        part = files.kept(f, "digest", policy).filter("keep").select(F.lit(policy).alias("policy"), "path")
        out = part if out is None else out.unionAll(part)
    return out


@query("""select distinct purged_at, row_id from purge_log order by purged_at desc, row_id limit 10""")
def section_newest(spark: SparkSession, d: str) -> DataFrame:
    return store.newest(table(spark, d, "purge_log", "purged_at", "row_id").distinct().withColumn("by", F.struct("purged_at", -F.col("row_id"))), "by", 10).drop("by")


# ---- structure of tables


@query("""select unnest(['o_custkey', 'o_orderdate', 'o_orderpriority', 'extra']) as "column", unnest(['a', 'a', 'a', 'b']) as side""")
def columns_differ(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    return combine.column_difference(a, a.select("o_orderkey", "o_orderstatus", "o_totalprice", F.lit(1).alias("extra")))


@query("""with c as (select o_orderkey, 'o_orderstatus' as "column", o_orderstatus as before, 'X' as after from orders where o_orderpriority like '1%' and coalesce(o_orderstatus, '') != 'X')
select "column", o_orderkey, before, after, (select count(*) from c) as changed from c order by o_orderkey limit 10""")
def change_samples(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority")
    b = a.withColumn("o_orderstatus", F.when(F.col("o_orderpriority").like("1%"), "X").otherwise(F.col("o_orderstatus")))
    return combine.change_samples(a, b, ["o_orderkey"]).select("column", "o_orderkey", "before", "after", "changed")


_Q = ("value", "unit", "agreement_no", "status")


@query(" union all ".join(f"""select '{c}' as "column", p as problem, cast(n as bigint) as "rows" from (select unnest(['missing', 'mostly_duplicate', 'untrimmed', 'full_width', 'all_unique']) as p, unnest([count(*) - count({c}), case when count(distinct {c}) > 1 and 1 - count(distinct {c}) / count({c}) > 0.9 then count({c}) - count(distinct {c}) end,
 count(*) filter (regexp_matches({c}, '^[\\s\\x{{3000}}\\x{{a0}}\\x{{85}}]|[\\s\\x{{3000}}\\x{{a0}}\\x{{85}}]$')), count(*) filter (regexp_matches({c}, '[{tables.WIDE}]')), case when count(distinct {c}) = count(*) and count(*) > 1 then count(*) end]) as n from fact) where n > 0""" for c in _Q))
def quick_problems(spark: SparkSession, d: str) -> DataFrame:
    return profile.quick_problems(table(spark, d, "fact", *_Q), list(_Q))


@query("""select 'o_orderkey' as "column", 'numeric' as role, count(distinct o_orderkey) as distinct_values from orders union all select 'o_orderstatus', 'categorical', count(distinct o_orderstatus) from orders union all select 'o_orderdate', 'datetime', count(distinct o_orderdate) from orders
 union all select 'o_totalprice', 'numeric', count(distinct o_totalprice) from orders union all select 'name', 'text', count(*) from (select distinct o_orderkey from orders)""")
def column_roles(spark: SparkSession, d: str) -> DataFrame:
    return profile.roles(table(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_orderdate", "o_totalprice").withColumn("name", F.concat(F.lit("n"), F.col("o_orderkey").cast("string"))))


@query("""select 'o_orderdate' as x, 'o_orderkey' as y, 'line' as chart, count(distinct o_orderdate) < count(*) as aggregate from orders""")
def chart_choice(spark: SparkSession, d: str) -> DataFrame:
    return profile.chart_choice(table(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_orderdate", "o_totalprice"))


@query("""select 'credit_amount' as a, 'credit_exposure_amount' as b, round(corr(credit_amount, credit_exposure_amount), 3) as r from credit_case""")
def correlations(spark: SparkSession, d: str) -> DataFrame:
    """Columns of which one pair does go together."""
    columns = ["credit_amount", "credit_exposure_amount", "case_id"]
    return profile.correlations(table(spark, d, "credit_case", *columns), columns)


_C = ("credit_amount", "credit_exposure_amount", "case_id")


@query(" union all ".join(f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 3) as r from credit_case" for a in _C for b in _C))
def correlation_matrix(spark: SparkSession, d: str) -> DataFrame:
    return profile.correlation_matrix(table(spark, d, "credit_case", *_C), list(_C))


@query("""with e as (select least(min(credit_amount), min(credit_exposure_amount)) as lo, greatest(max(credit_amount), max(credit_exposure_amount)) as hi from credit_case), v as (select 'credit_amount' as "column", credit_amount as x from credit_case union all select 'credit_exposure_amount', credit_exposure_amount from credit_case)
select "column", cast(least(floor((x - lo) / ((hi - lo) / 20)) + 1, 20) as int) as bin, count(*) as "rows" from v, e where x is not null group by 1, 2""")
def chart_hists(spark: SparkSession, d: str) -> DataFrame:
    return pivot.histograms(table(spark, d, "credit_case", "credit_amount", "credit_exposure_amount"), ["credit_amount", "credit_exposure_amount"])


@query("""with q as (select quantile_cont(value, 0.25) as a, quantile_cont(value, 0.75) as b from events) select 'value' as "column", 'outliers' as issue, count(*) as "rows" from events, q where value < a - 1.5 * (b - a) or value > b + 1.5 * (b - a)""")
def outlier_issues(spark: SparkSession, d: str) -> DataFrame:
    return profile.outlier_issues(table(spark, d, "events", "value"), ["value"])


@query("""select distinct o_orderkey, sha256('{"o_custkey":"' || o_custkey || '","o_orderkey":"' || o_orderkey || '","o_orderstatus":"' || coalesce(o_orderstatus, '') || '"}') as fingerprint from orders""")
def rows_fingerprinted(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_custkey").select("o_orderkey", store.fingerprint("o_orderkey", "o_orderstatus", "o_custkey").alias("fingerprint")).distinct()


_F = "(select quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3 from events)"


@query(f"""select value < q1 - 1.5 * (q3 - q1) or value > q3 + 1.5 * (q3 - q1) as value_is_outlier, count(*) as "rows" from events, {_F} group by 1""")
def outlier_flag(spark: SparkSession, d: str) -> DataFrame:
    return tables.mark_outliers(table(spark, d, "events", "value"), "value").groupBy("value_is_outlier").agg(F.count(F.lit(1)).alias("rows"))


@query(f"""select round(min(x), 4) as low, round(max(x), 4) as high, round(sum(x), 2) as total from (select least(greatest(value, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)) as x from events, {_F})""")
def outlier_clip(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("value")
    return tables.mark_outliers(table(spark, d, "events", "value"), "value", clip=True).agg(F.round(F.min(x), 4).alias("low"), F.round(F.max(x), 4).alias("high"), F.round(F.sum(x), 2).alias("total"))


@query("""select l_linestatus, round_even(sum(l_quantity) / 8, 0) as eighth from lineitem group by 1""")
def rounded_half_even(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem", "l_linestatus", "l_quantity").groupBy("l_linestatus").agg(F.bround(F.sum("l_quantity") / 8, 0).alias("eighth"))


# ---- store operators whose every way is queried


@query(f"""select fact_id, key, value from {_LIVE} where entity_id is null""")
def facts_unassigned(spark: SparkSession, d: str) -> DataFrame:
    return facts.unassigned(table(spark, d, "fact", "fact_id", "key", "value", "entity_id", "superseded_by")).select("fact_id", "key", "value")


@query("""select distinct e.entity_id, e.entity_type from entity e join credit_case c using (entity_id) where e.entity_id is not null""")
def entities_for_role(spark: SparkSession, d: str) -> DataFrame:
    roles = table(spark, d, "credit_case", "entity_id").select("entity_id", F.lit("借款人").alias("role"))
    return facts.with_role(roles, table(spark, d, "entity", "entity_id", "entity_type"), "借款人").select("entity_id", "entity_type")


@query(f"""select fact_id from {_LIVE} f where source_kind = 'source' and source_id is not null and not (status = 'ok')""")
def facts_withdrawn(spark: SparkSession, d: str) -> DataFrame:
    """Facts whose source no longer says so: what was seen again are the keys of each source's sound facts, by fact."""
    f = table(spark, d, "fact", "fact_id", "source_id", "source_kind", "status", "superseded_by").withColumn("key", F.col("fact_id").cast("string"))
    return facts.withdrawn(f, f.filter("status = 'ok' and source_id is not null")).select("fact_id")


def _put(mode: str) -> str:
    base = """with f as (select distinct fact_id, batch_no, key, entity_id, value from fact where superseded_by is null), o as (select * from (select *, row_number() over (partition by batch_no, key, entity_id order by fact_id desc) as r from f where fact_id % 2 = 0) where r = 1), i as (select * from f where fact_id % 2 = 1),
j as (select i.*, o.fact_id is not null as had, o.value as stored from i left join o on i.batch_no is not distinct from o.batch_no and i.key = o.key and i.entity_id is not distinct from o.entity_id),"""
    if mode == "ignore":
        return base + """ w as (select *, count(*) over b > 0 as earlier, first_value(case when trim(value) != '' then value end ignore nulls) over b as seen from j window b as (partition by batch_no, key, entity_id order by fact_id rows between unbounded preceding and 1 preceding)),
s as (select *, case when trim(stored) != '' then stored else coalesce(seen, stored) end as old_value from w)
select fact_id as incoming_ord, case when not (had or earlier) then 'inserted' when coalesce(old_value, '') = coalesce(value, '') then 'unchanged' when coalesce(trim(old_value), '') = '' and coalesce(trim(value), '') != '' then 'superseded' else 'kept_existing' end as action from s"""
    return base + """ w as (select *, count(*) over b > 0 as earlier, lag(value) over (partition by batch_no, key, entity_id order by fact_id) as seen from j window b as (partition by batch_no, key, entity_id order by fact_id rows between unbounded preceding and 1 preceding)), s as (select *, case when earlier then seen else stored end as old_value from w)
select fact_id as incoming_ord, case when not (had or earlier) then 'inserted' when coalesce(old_value, '') = coalesce(value, '') then 'unchanged' else 'superseded' end as action from s"""


def _put_in(spark: SparkSession, d: str, mode: str) -> DataFrame:
    f = table(spark, d, "fact", "fact_id", "batch_no", "key", "entity_id", "value", "superseded_by")
    return facts.put(f.filter("fact_id % 2 = 0"), facts.live(f.filter("fact_id % 2 = 1")).withColumnRenamed("fact_id", "ord").drop("superseded_by"), mode).select("incoming_ord", "action")


@query(_put("ignore"))
def put_facts_ignoring(spark: SparkSession, d: str) -> DataFrame:
    return _put_in(spark, d, "ignore")


@query(_put("supersede"))
def put_facts_superseding(spark: SparkSession, d: str) -> DataFrame:
    return _put_in(spark, d, "supersede")


_RULES = "(select distinct fingerprint as rule_id, template_sha256 as template, field, length(coalesce(value, '')) as confidence from fill_decision)"


def _rules(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "fill_decision", "fingerprint", "template_sha256", "field", "value").distinct().select(F.col("fingerprint").alias("rule_id"), F.col("template_sha256").alias("template"), "field", F.length(F.coalesce("value", F.lit(""))).alias("confidence"))


@query(f"""select rule_id from (select *, row_number() over (partition by template, field order by confidence desc, rule_id) as r from {_RULES}) where r > 1""")
def rules_to_review(spark: SparkSession, d: str) -> DataFrame:
    return quality.best_rules(_rules(spark, d))[1].select("rule_id")


@query(f"""with r as {_RULES} select distinct template, field from r d where not exists (select 1 from r where confidence > 6 and r.template = d.template and r.field = d.field)""")
def rules_still_disabled(spark: SparkSession, d: str) -> DataFrame:
    """All fields disabled; those of which a rule with a long value comes in are enabled again."""
    r = _rules(spark, d)
    return store.upserted_rules(r, r.filter("confidence > 6"), r.select("template", "field").distinct(), "rule_id")[1]


@query(f"""select rule_id from {_RULES} where field like '%名称'""")
def rules_disabled(spark: SparkSession, d: str) -> DataFrame:
    """Asked for all rules, with the file's digest as it was seen only for those of names."""
    r = _rules(spark, d).withColumnRenamed("field", "target").withColumnRenamed("template", "template_sha256")
    asked = r.withColumn("template_sha256", F.when(F.col("target").like("%名称"), F.col("template_sha256")).otherwise("old"))
    return store.disabled_rules(r, asked)[0].select("rule_id")


@query("""select distinct c.case_id, e.entity_type from credit_case c join entity e using (entity_id) where c.entity_id is not null""")
def merge_join_inner(spark: SparkSession, d: str) -> DataFrame:
    return combine.joined([table(spark, d, "credit_case", "entity_id", "case_id").filter("entity_id is not null").distinct(), table(spark, d, "entity", "entity_id", "entity_type").distinct()], ["entity_id"], "inner").select("case_id", "entity_type").distinct()


@query("""select coalesce(c.entity_id, e.entity_id) as entity_id, c.cases, e.rows_ from (select entity_id, count(distinct case_id) as cases from credit_case where entity_id is not null group by 1) c full join (select entity_id, count(*) as rows_ from entity where entity_id is not null group by 1) e using (entity_id)""")
def merge_join_outer(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "credit_case", "entity_id", "case_id").filter("entity_id is not null").groupBy("entity_id").agg(F.countDistinct("case_id").alias("cases"))
    e = table(spark, d, "entity", "entity_id", "entity_type").filter("entity_id is not null").groupBy("entity_id").agg(F.count(F.lit(1)).alias("rows_"))
    return combine.joined([c, e], ["entity_id"], "outer").select("entity_id", "cases", "rows_")


@query("""with l as (select distinct fact_id, key, entity_id, value, superseded_by from fact where superseded_by is null), x as (select key, count(distinct coalesce(cast(entity_id as varchar), '')) > 1 as ambiguous, max(fact_id) as m, count(distinct value) as values from l group by 1)
select key, case when ambiguous then 'ask' when coalesce(trim(value), '') = '' then 'empty' when contains(key, '法定代表人') or contains(key, '保证人') or contains(key, '借款人') then 'ask' when values > 1 then 'ask' when coalesce(confidence, 1.0) < 0.85 then 'ask' when regexp_matches(key, '"""
       + "|".join(w for ws in facts.HIGH_RISK.values() for w in ws) + """') then 'ask' else 'auto' end as decision from x join (select distinct fact_id, value, confidence from fact) f on f.fact_id = m""")
def fill_decisions_all(spark: SparkSession, d: str) -> DataFrame:
    """Every rung from the data: a role in the key that nobody holds is open, several values of one key are a tie."""
    f = table(spark, d, "fact", "fact_id", "key", "entity_id", "value", "confidence", "superseded_by")
    k = facts.by_key(f).select("key", "ambiguous")
    values = facts.live(f).groupBy("key").agg(F.countDistinct("value").alias("values"))
    newest = facts.latest(facts.live(f).select("key", "fact_id", "value", "confidence"), ["key"], "fact_id")
    rows = k.join(newest, "key").join(values, "key")
    return rows.select("key", decide.decision(F.col("ambiguous"), F.col("value"), facts.claimed_role(F.col("key")).isNotNull(), F.col("values") > 1, F.coalesce("confidence", F.lit(1.0)), F.col("key")).alias("decision"))


@query(f"""select fact_id as n, case when status = 'suspect' then 'unknown number' when key like '%名称' then 'ambiguous' when {_BLANK.format(c="value")} then 'nothing to accept' end as problem from {_LIVE}""")
def choices_guarded(spark: SparkSession, d: str) -> DataFrame:
    """Every fact accepted, of a plan without the suspect ones in which blanks are empty and names ambiguous."""
    f = live(spark, d, "key", "value", "status")
    plan = f.filter("status != 'suspect'").select(F.col("fact_id").alias("n"), F.when(facts.blank(F.col("value")) & ~F.col("key").like("%名称"), "empty").otherwise("auto").alias("decision"), F.col("key").like("%名称").alias("ambiguous"), F.array(F.col("fact_id").cast("string")).alias("candidates"))
    return decide.guarded(plan, f.select(F.col("fact_id").alias("n"), F.lit("accept").alias("action"), F.lit(None).cast("string").alias("pick"))).select("n", "problem")


@query("""select batch_no as template, count(*) as detected, count(*) filter (entity_id is not null) as mapped, count(*) filter (entity_id is null and status != 'suspect') as unmapped, count(*) filter (status = 'suspect') as protected, count(*) filter (status = 'missing') as left_blank from """ + _LIVE + " group by 1")
def slots_covered(spark: SparkSession, d: str) -> DataFrame:
    f = live(spark, d, "batch_no", "entity_id", "status")
    return decide.coverage(f.select(F.col("batch_no").alias("template"), F.col("entity_id").isNotNull().alias("mapped"), (F.col("status") == "suspect").alias("protected"), (F.col("status") == "missing").alias("left_blank")))


@query("""with k as (select distinct field as key from fill_decision union select distinct key from fact) select key, case when contains(key, '法定代表人') then '法定代表人' when contains(key, '保证人') then '保证人' when contains(key, '借款人') then '借款人' end as role from k where key is not null""")
def roles_claimed(spark: SparkSession, d: str) -> DataFrame:
    """Every key as a template of its own, named by nothing."""
    k = table(spark, d, "fill_decision", "field").toDF("key").unionAll(table(spark, d, "fact", "key")).filter("key is not null").distinct()
    return decide.template_scope(k.select(F.col("key").alias("template"), F.lit("x.docx").alias("template_name"), "key")).withColumnRenamed("template", "key")


@query(f"""select distinct key from {_LIVE} where key is not null and key != '' and key not in (select distinct field from fill_decision where field is not null)""")
def contract_fields(spark: SparkSession, d: str) -> DataFrame:
    return store.new_contract_fields(live(spark, d, "key"), table(spark, d, "fill_decision", "field").filter("field is not null").distinct().withColumnRenamed("field", "key"))


def _old(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    f = live(spark, d, "batch_no", "key", "value", "status", "source_kind", "source_id", "formula", "inputs")
    return f, f.filter("batch_no is not null and batch_no not like '%-09'").select(F.col("batch_no").alias("session"), "batch_no").distinct()


_OLD = f"""(select distinct fact_id, case when batch_no not like '%-09' then batch_no end as b, key, value, status, case when source_kind in ('source', 'computed', 'user') then source_kind when source_id is not null then 'source' end as k, formula, inputs from fact where superseded_by is null)"""


@query(f"""select fact_id, b as batch_no, case when {_BLANK.format(c="value")} then 'missing' when status in ('ok', 'missing', 'suspect') then status else 'suspect' end as status, k as source_kind from {_OLD} where not {_BLANK.format(c="key")} and b is not null and k is not null and not (k = 'computed' and (formula is null or inputs is null))""")
def facts_migrated(spark: SparkSession, d: str) -> DataFrame:
    """Batches of one desk are unknown to the new store."""
    return store.migrated(*_old(spark, d))[0].select("fact_id", "batch_no", "status", "source_kind")


@query(f"""select * from (select fact_id, case when {_BLANK.format(c="key")} then 'no key' when b is null then 'unknown batch' when k is null then 'unknown origin' when k = 'computed' and (formula is null or inputs is null) then 'computed without formula' end as reason from {_OLD}) where reason is not null""")
def facts_diverted(spark: SparkSession, d: str) -> DataFrame:
    return store.migrated(*_old(spark, d))[1]


@query("""select * from (values ('cases', (select count(distinct case_id) from credit_case)), ('entities_without_key', (select count(distinct entity_id) from entity where identity_incomplete = 1)), ('facts_with_value', (select count(distinct fact_id) from fact where superseded_by is null and value != '')),
 ('facts_superseded', (select count(distinct fact_id) from fact where superseded_by is not null)), ('decisions', (select count(distinct fingerprint) from fill_decision)), ('decisions_blank', (select count(distinct fingerprint) from fill_decision where action = 'blank')), ('runs', (select count(distinct run_id) from fill_decision))) t(what, n)""")
def store_counts(spark: SparkSession, d: str) -> DataFrame:
    return facts.more_counts(table(spark, d, "fact", "fact_id", "value", "superseded_by"), table(spark, d, "entity", "entity_id", "identity_incomplete"), table(spark, d, "credit_case", "case_id"), table(spark, d, "fill_decision", "fingerprint", "action", "run_id"))


@query("""select x.name, case when lo = hi then lo end as entity_id, lo is not null as known from (select distinct subject_name as name from ledger_subject where subject_name is not null) x left join (select name, min(entity_id) as lo, max(entity_id) as hi from entity_name where entity_id is not null group by 1) e using (name)""")
def entities_unique(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "ledger_subject", "subject_name").withColumnRenamed("subject_name", "name")
    return store.unique_entities(wanted, table(spark, d, "entity_name", "name", "entity_id"))


@query("""select subject_name as name, entity_id, entity_id is null as is_new from (select subject_name, n.entity_id, row_number() over (partition by subject_name order by n.entity_id is null, case when name_kind = '现用名' then 0 else 1 end, name_id) as r from (select distinct subject_name from ledger_subject where subject_name is not null) l left join entity_name n on n.name = l.subject_name) where r = 1""")
def entities_by_present_name(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "ledger_subject", "subject_name").withColumnRenamed("subject_name", "name")
    return store.resolved_entities(wanted, table(spark, d, "entity_name", "name", "entity_id", "name_kind", "name_id"))


@query("""select l_linestatus, l_returnflag, round(median(l_extendedprice), 4) as l_extendedprice_median from lineitem group by 1, 2""")
def pivot_median(spark: SparkSession, d: str) -> DataFrame:
    got = pivot.pivot(table(spark, d, "lineitem", "l_linestatus", "l_returnflag", "l_extendedprice"), ["l_linestatus", "l_returnflag"], ["l_extendedprice"], "l_extendedprice:median")
    return got.select("l_linestatus", "l_returnflag", F.round(F.col(got.columns[-1]), 4).alias("l_extendedprice_median"))
