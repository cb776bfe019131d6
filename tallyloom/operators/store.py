"""Writes of the fact store as frames: what is new, what changes, what is refused. Nothing is updated in place; a writer appends or merges by key."""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tallyloom.operators.facts import ROLES, blank, claimed_role, live, same


def new_sources(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """Sources not registered yet: a source is its (path, sha256)."""
    return incoming.dropDuplicates(["path", "sha256"]).join(known.select("path", "sha256").distinct(), ["path", "sha256"], "left_anti")


def resolved_entities(wanted: DataFrame, names: DataFrame) -> DataFrame:
    """(name, entity_id, is_new) of wanted names: the entity that has exactly that name, never a similar one; null where one must be made.

    Of several entities the one whose present name it is counts, then the one named first (by name_id); without these columns
    the least.
    """
    rank = F.struct(F.when(F.col("name_kind") == "现用名", 0).otherwise(1), "name_id", "entity_id") if {"name_kind", "name_id"} <= set(names.columns) else F.col("entity_id")
    exact = names.filter("entity_id is not null").groupBy("name").agg(F.min_by("entity_id", rank).alias("entity_id"))
    return wanted.select("name").filter("name is not null").distinct().join(exact, "name", "left").withColumn("is_new", F.col("entity_id").isNull())


def unique_entities(wanted: DataFrame, names: DataFrame) -> DataFrame:
    """(name, entity_id, known) of wanted names: the one entity that has exactly that name; null where several have it, of which none is taken."""
    exact = names.filter("entity_id is not null").groupBy("name").agg(F.min("entity_id").alias("lo"), F.max("entity_id").alias("hi"))
    found = wanted.select("name").filter("name is not null").distinct().join(exact, "name", "left")
    return found.select("name", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("entity_id"), F.col("lo").isNotNull().alias("known"))


def upserted(stored: DataFrame, incoming: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The stored rows with the incoming ones put in by key, the latest of them winning; columns as stored."""
    last = incoming.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in stored.columns if c not in keys]), order).alias("r"))
    last = last.select(*[c if c in keys else F.col(f"r.{c}").alias(c) for c in stored.columns])
    return stored.join(last.select(*keys), keys, "left_anti").unionByName(last)


def set_roles(roles: DataFrame, incoming: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """(roles after, rows refused): roles of (entity_id, case_id, role), of the closed set only."""
    good = F.col("role").isin(*ROLES) & F.col("entity_id").isNotNull()
    return upserted(roles, incoming.filter(good), ["entity_id", "case_id", "role"], order), incoming.filter(~F.coalesce(good, F.lit(False)))


def upserted_rules(rules: DataFrame, incoming: DataFrame, disabled: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """(rules after, disabled after): a rule set anew for its (template, field) is enabled again."""
    after = upserted(rules, incoming, ["template", "field"], order)
    return after, disabled.join(incoming.select("template", "field").distinct(), ["template", "field"], "left_anti")


def disabled_rules(rules: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to append to the disabled ones, refused): only where target and file are still those that were seen; rules are never removed."""
    both = asked.alias("a").join(rules.alias("r"), "rule_id", "left")
    fits = F.coalesce((F.col("a.target") == F.col("r.target")) & (F.col("a.template_sha256") == F.col("r.template_sha256")), F.lit(False))
    rows = both.select("rule_id", "a.target", "a.template_sha256", fits.alias("fits"))
    return rows.filter("fits").drop("fits"), rows.filter("not fits").drop("fits")


def selected(plan: DataFrame, picks: DataFrame | None = None) -> DataFrame:
    """Plan rows that are applied: those picked, or all but new and must-tick ones if nothing is picked. plan as facts.merge_plan with n."""
    if picks is None:
        return plan.filter("kind in ('conflict', 'fill_blank') and not must_tick")
    return plan.join(picks.groupBy("n").agg(F.max("action").alias("action"), F.count(F.lit(1)).alias("times")).filter("times = 1 and action = 'accept'").select("n"), "n", "left_semi").filter("kind != 'incoming_blank'")


def applied(plan: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to write, stale rows): a row is refused if the current value is no longer the one it was planned against."""
    a, c = plan.alias("a"), current.select("key", "entity_id", "value").alias("c")
    both = a.join(c, (F.col("a.key") == F.col("c.key")) & F.col("a.entity_id").eqNullSafe(F.col("c.entity_id")), "left")
    fresh = same(F.col("a.existing"), F.col("c.value"))
    rows = both.select("a.*", fresh.alias("fresh"))
    return rows.filter("fresh").drop("fresh"), rows.filter("not fresh").drop("fresh")


def identity_changes(entities: DataFrame, asked: DataFrame) -> DataFrame:
    """(entity_id, kind, value, problem) of identity keys to be set: of the wrong type, in use elsewhere, asked twice, or for no entity; null if it may be set.

    asked: (entity_id, kind, value), kind uscc, bank_no or id_card. A person has an id_card, a company the other two.
    """
    held = entities.select("entity_id", F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.upper(F.trim(k)).alias("value")) for k in ("uscc", "bank_no", "id_card")]))).filter("value is not null and value != ''").groupBy("kind", "value").agg(F.min("entity_id").alias("lo"), F.max("entity_id").alias("hi"))
    kinds = entities.groupBy("entity_id").agg(F.min("entity_type").alias("entity_type"))
    rows = asked.withColumn("value", F.upper(F.trim("value"))).withColumn("times", F.count(F.lit(1)).over(Window.partitionBy("kind", "value")))
    rows = rows.join(kinds, "entity_id", "left").join(held, ["kind", "value"], "left")
    problem = (
        F.when(F.col("entity_type").isNull(), "no such entity").when(blank(F.col("value")), "no value").when((F.col("kind") == "id_card") != (F.col("entity_type") == "natural_person"), "wrong type")
        .when((F.col("lo") != F.col("entity_id")) | (F.col("hi") != F.col("entity_id")), "in use").when(F.col("times") > 1, "asked twice")
    )
    return rows.select("entity_id", "kind", "value", problem.alias("problem"))


def delivered_fields(ops: DataFrame) -> DataFrame:
    """(run_id, field) of fields filled in runs that brought out a document: a self-join of (run_id, kind, target)."""
    fields, out = ops.filter("kind = 'field'"), ops.filter("kind = 'artifact'").select("run_id").distinct()
    return fields.join(out, "run_id", "left_semi").select("run_id", F.col("target").alias("field")).distinct()


def artifacts(ops: DataFrame, entities: DataFrame, templates: DataFrame) -> DataFrame:
    """What runs brought out (ops of kind artifact: op_id, run_id, entity_id, template_id) with the entity's type and the template's name, where known."""
    e = entities.groupBy("entity_id").agg(F.min("entity_type").alias("entity_type"))
    t = templates.groupBy("template_id").agg(F.min("name").alias("template_name"))
    return ops.filter("kind = 'artifact'").join(e, "entity_id", "left").join(t, "template_id", "left")


def latest_artifacts(ops: DataFrame) -> DataFrame:
    """(template_id, op_id, run_id): the newest artifact of each template."""
    return ops.filter("kind = 'artifact' and template_id is not null").groupBy("template_id").agg(F.max_by(F.struct("op_id", "run_id"), "op_id").alias("a")).select("template_id", "a.op_id", "a.run_id")


def representatives(facts: DataFrame, names: DataFrame, relation: str, identity: list[str]) -> DataFrame:
    """(entity_id, person_id, key, value): a company's newest fact `relation` names a person; the person's newest identity facts are theirs.

    Two equi-joins over current facts; a name that several entities have tells nobody.
    """
    from tallyloom.operators.facts import current

    now = current(facts)
    who = names.filter("entity_id is not null").groupBy("name").agg(F.min("entity_id").alias("person_id"), F.max("entity_id").alias("hi")).filter("person_id = hi").drop("hi")
    named = now.filter((F.col("key") == relation) & F.col("entity_id").isNotNull()).select("entity_id", F.col("value").alias("name")).join(who, "name").select("entity_id", "person_id")
    papers = now.filter(F.col("key").isin(*identity) & F.col("entity_id").isNotNull()).select(F.col("entity_id").alias("person_id"), "key", "value")
    return named.join(papers, "person_id").select("entity_id", "person_id", "key", "value")


def next_runs(ops: DataFrame, batches: DataFrame) -> DataFrame:
    """(batch_no, run_id): the next run's name of each batch, `<batch>-R<n>`, n the first after the number of runs that no op has yet."""
    names = ops.filter("run_id is not null").select("batch_no", F.regexp_extract("run_id", r"-R(\d+)$", 1).try_cast("bigint").alias("n"), F.col("kind") == "run").toDF("batch_no", "n", "is_run")
    counts = names.groupBy("batch_no").agg(F.count_if("is_run").alias("runs"), F.countDistinct("n").alias("used"))
    tries = batches.select("batch_no").distinct().join(counts, "batch_no", "left").fillna(0)
    tries = tries.withColumn("n", F.explode(F.sequence(F.col("runs") + 1, F.col("runs") + F.col("used") + 1)))
    free = tries.join(names.select("batch_no", "n").distinct(), ["batch_no", "n"], "left_anti").groupBy("batch_no").agg(F.min("n").alias("n"))
    return free.select("batch_no", F.concat("batch_no", F.lit("-R"), F.col("n").cast("string")).alias("run_id"))


def run_numbers(runs: DataFrame) -> DataFrame:
    """(batch_no, template_id, run): runs of a batch numbered by the order of their templates."""
    return runs.select("batch_no", "template_id").distinct().withColumn("run", F.dense_rank().over(Window.partitionBy("batch_no").orderBy("template_id")))


def newest(df: DataFrame, order: str, limit: int = 10) -> DataFrame:
    """The newest rows of a section, between 1 and 100 of them."""
    return df.orderBy(F.desc(order)).limit(max(1, min(limit, 100)))


def new_contract_fields(fields: DataFrame, known: DataFrame) -> DataFrame:
    """(key): keys of facts that no contract lists yet."""
    return fields.select("key").filter("key is not null and key != ''").distinct().join(known.select("key"), "key", "left_anti")


def migrated(facts: DataFrame, batches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows as the new store has them, diverted rows with the reason): facts of an older store, in fixed steps.

    batches: (session, batch_no) as quality.batch_map has it. A row without a key or of an unknown batch is diverted, as are
    computed ones without formula or inputs; unknown statuses become `suspect`, a blank value `missing`; a source kind that
    is unknown is `source` if there is a source, else diverted.
    """
    rows = facts.join(batches.select(F.col("session").alias("batch_was"), F.col("batch_no").alias("new_batch")), F.col("batch_no") == F.col("batch_was"), "left").drop("batch_was")
    kind = F.when(F.col("source_kind").isin("source", "computed", "user"), F.col("source_kind")).when(F.col("source_id").isNotNull(), "source")
    status = F.when(blank(F.col("value")), "missing").when(F.col("status").isin("ok", "missing", "suspect"), F.col("status")).otherwise("suspect")
    rows = rows.withColumns({"new_kind": kind, "new_status": status})
    reason = (
        F.when(blank(F.col("key")), "no key").when(F.col("new_batch").isNull(), "unknown batch").when(F.col("new_kind").isNull(), "unknown origin")
        .when((F.col("new_kind") == "computed") & (F.col("formula").isNull() | F.col("inputs").isNull()), "computed without formula")
    )
    rows = rows.withColumn("reason", reason)
    good = rows.filter("reason is null").select("fact_id", F.col("new_batch").alias("batch_no"), "key", "value", F.col("new_status").alias("status"), F.col("new_kind").alias("source_kind"))
    return good, rows.filter("reason is not null").select("fact_id", "reason")


def role_aliases(facts: DataFrame, roles: DataFrame) -> DataFrame:
    """(alias, fact_id, value, ambiguous) of facts named by their holder's role: 借款人X, and 保证人N X where evidence tells the number.

    roles: (entity_id, role, evidence). Keys that name a role already stay as they are; an alias that several values claim is ambiguous.
    """
    number = F.regexp_extract("evidence", r"(\d+)$", 1)
    held = roles.filter(F.col("role") != ROLES[0]).select("entity_id", "role", F.when(F.col("role") == "保证人", number).otherwise("").alias("number")).distinct()
    rows = live(facts).filter(claimed_role(F.col("key")).isNull() & ~blank(F.col("value"))).join(held, "entity_id")
    plain = rows.select(F.concat("role", "key").alias("alias"), "fact_id", "entity_id", "value")
    counted = rows.filter("number != ''").select(F.concat("role", "number", "key").alias("alias"), "fact_id", "entity_id", "value")
    got = plain.unionAll(counted).groupBy("alias").agg(F.max_by(F.struct("fact_id", "value"), "fact_id").alias("b"), F.countDistinct("entity_id", "value").alias("n"))
    one = F.col("n") == 1
    return got.select("alias", F.when(one, F.col("b.fact_id")).alias("fact_id"), F.when(one, F.col("b.value")).alias("value"), (~one).alias("ambiguous"))


def inferred_roles(lines: DataFrame, names: DataFrame) -> DataFrame:
    """(name, role): the role word nearest to the left of a name in lines (line_id, text); lines and names meet by the name's first two characters."""
    n = names.filter(F.length("name") >= 2).select("name", F.substring("name", 1, 2).alias("head")).distinct()
    heads = lines.select("line_id", "text", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("text") - 1, F.lit(1))), lambda i: F.substring("text", i, F.lit(2))))).alias("head"))
    met = heads.join(n, "head").filter(F.col("text").contains(F.col("name")))
    left = F.expr("substring_index(text, name, 1)")
    at = lambda r: F.length(left) - F.instr(F.reverse(left), r[::-1])
    best = F.array_max(F.array(*[F.when(left.contains(r), F.struct(at(r).alias("at"), F.lit(r).alias("role"))) for r in ROLES]))
    return met.select("name", best["role"].alias("role")).filter("role is not null").distinct()


def same_plan(a: DataFrame, b: DataFrame) -> bool:
    """Whether two plans hold the same rows in any order: by counts and two sums of row hashes."""
    mark = lambda df: df.select(F.xxhash64(*sorted(df.columns)).alias("h"), F.hash(*sorted(df.columns)).alias("g")).agg(F.count(F.lit(1)), F.sum(F.col("h").cast("decimal(38,0)")), F.sum("g")).first()
    return tuple(mark(a)) == tuple(mark(b))


def imported_rules(pack: DataFrame, templates: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rules to add, rows that hold the pack up): a pack fits only if each of its (name, sha256) is a template here; rules in use are left alone."""
    unknown = pack.join(templates.select("name", "sha256").distinct(), ["name", "sha256"], "left_anti")
    fits = pack.join(unknown.agg(F.count(F.lit(1)).alias("bad")).filter("bad = 0").drop("bad").withColumn("k", F.lit(1)), F.lit(1) == F.col("k"), "left_semi")
    return fits.join(rules.select("name", "field").distinct(), ["name", "field"], "left_anti"), unknown


def fingerprint(*columns: str) -> Column:
    """The SHA-256 of a row as a JSON object with its keys in order and without blanks; a null is the empty text, so that it has a place."""
    return F.sha2(F.to_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in sorted(columns)])), 256)


def fitted_value(value: Column, printed: Column) -> Column:
    """A value without what is printed around its blank already: a unit that the form has behind it. A foreign currency before 元 gives null."""
    foreign = value.rlike("(?i)USD|EUR|HKD|JPY|GBP|美元|欧元|港币|日元|英镑")
    return F.when(printed.contains("元") & foreign, None).when(value.endswith(printed) & (F.length(printed) > 0), F.call_function("substring", value, F.lit(1), F.length(value) - F.length(printed))).otherwise(value)


@F.pandas_udf(StringType())
def sm3(text: pd.Series) -> pd.Series:
    """The SM3 digest, SHA-256 where the platform has no SM3."""
    name = "sm3" if "sm3" in hashlib.algorithms_available else "sha256"
    return text.map(lambda t: None if t is None else hashlib.new(name, t.encode()).hexdigest())


@F.pandas_udf(StringType())
def rendered(template: pd.Series, values: pd.Series) -> pd.Series:
    """A template's {{keys}} with the values of a JSON object, by path `a.b[0]`; unknown keys stay."""
    import json

    def one(t, v):
        if t is None:
            return None
        data = json.loads(v) if v else {}

        def get(m):
            at = data
            for part in re.findall(r"[^.\[\]]+", m.group(1).strip()):
                try:
                    at = at[int(part)] if isinstance(at, list) else at[part]
                except (KeyError, IndexError, ValueError, TypeError):
                    return m.group(0)
            return str(at)

        return re.sub(r"\{\{(.+?)\}\}", get, t)

    return pd.Series([one(t, v) for t, v in zip(template, values, strict=True)])
