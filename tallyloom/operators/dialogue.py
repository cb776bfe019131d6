"""Open questions of a store and their answers: conflicts, reviews, ownership and saved decisions, as frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.decide import guarded
from tallyloom.operators.store import upserted

# How a conflict may be settled; how a run may be signed off, and for what.
RESOLUTIONS, DECISIONS, SCOPES = ("took_existing", "took_incoming", "left_blank"), ("approve", "reject"), ("batch", "document")
# The answer that leaves a row out, what stands before and after an offered owner.
LEFT_OUT, OFFERED, RECOMMENDED = "暂不收录", "归属：", "（推荐）"


def open_items(items: DataFrame, kind: str | None = None) -> DataFrame:
    """Conflicts or reviews (…, kind, resolved_at) that nobody has settled; the condition reaches the scan."""
    rows = items.filter("resolved_at is null")
    return rows if kind is None else rows.filter(F.col("kind") == kind)


def settled(items: DataFrame, answers: DataFrame, allowed: tuple[str, ...] = RESOLUTIONS) -> tuple[DataFrame, DataFrame]:
    """(items after, answers refused): items (item_id, resolution, resolved_by, resolved_at), answers the same columns.

    Of several answers to one item the latest counts. An answer that is not allowed or that belongs to no item is refused.
    """
    asked = answers.withColumn("fits", F.coalesce(F.col("resolution").isin(*allowed), F.lit(False)))
    good = asked.filter("fits").groupBy("item_id").agg(F.max_by(F.struct("resolution", "resolved_by", "resolved_at"), "resolved_at").alias("a"))
    rest = [c for c in items.columns if c not in ("resolution", "resolved_by", "resolved_at")]
    after = items.join(good, "item_id", "left").select(*rest, *[F.coalesce(f"a.{c}", F.col(c)).alias(c) for c in ("resolution", "resolved_by", "resolved_at")])
    lost = asked.join(items.select("item_id").distinct().withColumn("known", F.lit(True)), "item_id", "left").filter("not fits or known is null")
    return after, lost.select("item_id", "resolution", "resolved_by", "resolved_at")


def signed_off(ops: DataFrame, asked: DataFrame) -> DataFrame:
    """Runs' artifacts (run_id, kind, …) with scope, decision and actor of the sign-off of their run; others and wrong words leave them null."""
    good = asked.filter(F.col("decision").isin(*DECISIONS) & F.col("scope").isin(*SCOPES)).groupBy("run_id").agg(F.max_by(F.struct("scope", "decision", "actor"), "at").alias("s"))
    on = (F.col("run_id") == F.col("signed_run")) & (F.col("kind") == "artifact")
    return ops.join(good.withColumnRenamed("run_id", "signed_run"), on, "left").select(*ops.columns, *[F.col(f"s.{c}").alias(f"signoff_{c}") for c in ("scope", "decision", "actor")])


def saved_page(stored: DataFrame, plan: DataFrame, chosen: DataFrame, rows: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """(decisions after, problems): a whole page of choices goes in by fingerprint, or, if any has a problem or a row has no answer, none.

    plan and chosen as for decide.guarded; rows: the decisions to store, with the columns of `stored`.
    """
    checked = guarded(plan, chosen)
    problems = checked.withColumn("problem", F.coalesce("problem", F.when(F.col("action").isNull(), "not answered"))).filter("problem is not null")
    gate = problems.agg(F.count(F.lit(1)).alias("bad")).filter("bad = 0").select(F.lit(1).alias("__gate"))
    let = rows.withColumn("__gate", F.lit(1)).join(gate, "__gate", "left_semi").drop("__gate")
    return upserted(stored, let, ["fingerprint"], order), problems


def value_conflicts(rows: DataFrame) -> DataFrame:
    """(key, entity_name, option, value, rows) of facts of one subject and key that differ: a row for each value, numbered from 1 in their order.

    rows: (row_id, key, entity_name, value). Values are counted before they meet, so a group's size is that of its values.
    """
    each = rows.filter("value is not null").groupBy("key", "entity_name", "value").agg(F.count(F.lit(1)).alias("rows"))
    group = Window.partitionBy("key", "entity_name")
    return each.withColumns({"option": F.row_number().over(group.orderBy("value")), "values": F.count(F.lit(1)).over(group)}).filter("values > 1").select("key", "entity_name", "option", "value", "rows")


def answered_conflicts(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """rows with what the answers make of them: (row_id, key, entity_name, value, dropped, by_user).

    answers: (key, entity_name, pick, custom), pick an option's number, null for none. Of the rows with the chosen value the first
    is kept; a value of the user's own goes into the first row that has it, else the first; without either all are dropped.
    """
    options = value_conflicts(rows)
    a, o = answers.alias("a"), options.select("key", "entity_name", "option", F.col("value").alias("picked")).alias("o")
    chosen = a.join(o, (F.col("a.key") == F.col("o.key")) & F.col("a.entity_name").eqNullSafe(F.col("o.entity_name")) & (F.col("a.pick") == F.col("o.option")), "left")
    chosen = chosen.select("a.key", "a.entity_name", F.coalesce(F.nullif(F.trim("custom"), F.lit("")), "picked").alias("chosen"), F.lit(True).alias("answered"))
    on = (F.col("r.key") == F.col("c.key")) & F.col("r.entity_name").eqNullSafe(F.col("c.entity_name"))
    both = rows.alias("r").join(chosen.alias("c"), on, "left").select("r.*", "c.chosen", F.coalesce("c.answered", F.lit(False)).alias("answered"))
    first = F.row_number().over(Window.partitionBy("key", "entity_name").orderBy(~F.coalesce(F.col("value") == F.col("chosen"), F.lit(False)), "row_id"))
    kept = F.col("answered") & (first == 1) & F.col("chosen").isNotNull()
    return both.withColumn("kept", kept).select(
        "row_id", "key", "entity_name", F.when(F.col("kept"), F.col("chosen")).otherwise(F.col("value")).alias("value"), (F.col("answered") & ~F.col("kept")).alias("dropped"), F.col("kept").alias("by_user"),
    )


def ownership_questions(rows: DataFrame, batch: Column) -> DataFrame:
    """(question, key, value, entity_name, quote, context, occurrences, texts): facts whose owner a person must tell, the same ones asked once.

    rows: (source, line, key, value, entity_name, quote, context, certificate). Rows of one certificate are one question, of all
    others each (source, key, value, entity, quote, context); `question` is the hash of what is asked. `texts` counts
    different wordings under one hash; more than one is a collision and must not be answered as one.
    """
    asked = F.when(F.coalesce("certificate", F.lit(False)), F.lit("")).otherwise(F.concat_ws("\u001f", "key", "value"))
    parts = [batch, F.col("source"), asked, *[F.coalesce(c, F.lit("")) for c in ("entity_name", "quote", "context")]]
    mark = F.concat(F.lit("source-"), F.sha2(F.concat_ws("\u001e", *parts), 256))
    wording = F.sha2(F.concat_ws("\u001e", F.coalesce("quote", F.lit("")), F.coalesce("context", F.lit("")), F.coalesce("entity_name", F.lit(""))), 256)
    return rows.withColumns({"question": mark, "wording": wording}).groupBy("question").agg(
        *[F.min(c).alias(c) for c in ("key", "value", "entity_name", "quote", "context")], F.countDistinct("source", "line", "quote").alias("occurrences"), F.countDistinct("wording").alias("texts")
    )


def answered_ownership(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """rows (question, entity_name, …) with the answers (question, selected, custom) applied: what was picked or typed owns them; those left out are dropped."""
    typed = F.nullif(F.trim(F.coalesce("custom", F.lit(""))), F.lit(""))
    got = answers.select("question", typed.alias("typed"), "selected").groupBy("question").agg(F.max(F.struct("typed", "selected")).alias("a"))
    out = F.col("a.typed").isNull() & (F.col("a.selected") == LEFT_OUT)
    name = F.coalesce("a.typed", F.trim(F.regexp_replace(F.regexp_replace("a.selected", f"^{OFFERED}", ""), f"{RECOMMENDED}$", "")))
    both = rows.join(got, "question", "left").withColumn("dropped", F.coalesce(out, F.lit(False)))
    assigned = F.col("a").isNotNull() & ~F.col("dropped")
    return both.withColumn("assigned_by_user", assigned).withColumn("entity_name", F.when(F.col("assigned_by_user"), name).otherwise(F.col("entity_name"))).drop("a")


def ingestable(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to write, groups that stop the ingest): of rows (row_id, key, entity_name, value, dropped) that are not dropped the first of each key
    and subject; a subject's key with different values stops all until somebody has said which counts."""
    live = rows.filter("not dropped")
    stops = value_conflicts(live).select("key", "entity_name").distinct()
    gate = stops.agg(F.count(F.lit(1)).alias("bad")).filter("bad = 0").select(F.lit(1).alias("__gate"))
    first = live.groupBy("key", "entity_name").agg(F.min_by(F.struct("row_id", "value"), "row_id").alias("f")).select("f.row_id", "key", "entity_name", "f.value")
    return first.withColumn("__gate", F.lit(1)).join(gate, "__gate", "left_semi").drop("__gate"), stops


def fact_owners(rows: DataFrame, names: DataFrame, slots: DataFrame, holders: DataFrame, default: int | None = None) -> DataFrame:
    """rows (row_id, key, value, declared) with entity_id and basis: whose fact it is, the first that tells of

    the subject that a name's key names (`name`), what the user declared (`declared`), who the material names for the role that
    the key claims (`slot`), the one holder of that role in the store (`role`), the default (`default`); null if none does.
    names: (name, entity_id); slots and holders: (role, entity_id). A name or role of several entities tells nothing.
    """
    from tallyloom.operators.facts import claimed_role

    def single(df: DataFrame, key: str, name: str) -> DataFrame:
        got = df.filter(F.col(key).isNotNull() & F.col("entity_id").isNotNull()).groupBy(key).agg(F.min("entity_id").alias(name), F.max("entity_id").alias("hi"))
        return got.filter(F.col(name) == F.col("hi")).drop("hi")

    rows = rows.withColumns({"name": F.when(F.col("key").rlike("名称$"), F.col("value")), "role": claimed_role(F.col("key"))})
    rows = rows.join(single(names, "name", "by_name"), "name", "left").join(single(slots, "role", "by_slot"), "role", "left").join(single(holders, "role", "by_role"), "role", "left")
    ways = (("name", F.col("by_name")), ("declared", F.col("declared")), ("slot", F.col("by_slot")), ("role", F.col("by_role")), ("default", F.lit(default).cast("bigint")))
    basis = F.coalesce(*[F.when(c.isNotNull(), n) for n, c in ways])
    return rows.select("row_id", "key", "value", F.coalesce(*[c for _, c in ways]).alias("entity_id"), basis.alias("basis"))


def ingested(rows: DataFrame, names: DataFrame, holders: DataFrame, default: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(names to add, facts): an ingest of read rows (row_id, key, value, declared) in two passes.

    First every subject that the material names is resolved by its exact name, or gets a new entity with the next free ids in the
    order of names; those that a role's key names fill the material's role slots. Then each fact finds its owner.
    """
    from tallyloom.functions.numbering import numbered
    from tallyloom.operators.facts import claimed_role

    said = rows.filter(F.col("key").rlike("名称$") & F.col("value").isNotNull() & (F.col("value") != "")).select(F.col("value").alias("name"), claimed_role(F.col("key")).alias("role"))
    new = numbered(said.select("name").distinct().join(names.select("name").distinct(), "name", "left_anti"), "name")
    top = names.agg(F.coalesce(F.max("entity_id"), F.lit(0)).alias("top")).withColumn("one", F.lit(1))
    new = new.withColumn("one", F.lit(1)).join(top, "one").select("name", (F.col("top") + F.col("n")).alias("entity_id"))
    known = names.select("name", "entity_id").unionByName(new)
    slots = said.filter("role is not null").join(known, "name").select("role", "entity_id").distinct()
    return new, fact_owners(rows, known, slots, holders, default)
