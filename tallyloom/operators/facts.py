"""The fact store: provenance-carrying facts in append-only versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.text import is_blank

# Keyword classes of fields, the first hit wins.
HIGH_RISK = {"收款账号": ("账号", "账户", "卡号"), "金额": ("金额", "敞口", "额度", "保证金", "余额", "本金"), "利率": ("利率", "费率", "息"), "日期": ("日期", "到期日", "生效日", "提款日", "起始日", "期限"), "证件号码": ("身份证", "证件号")}
ROLES = ("法定代表人", "保证人", "借款人")
NORM_RULES = {"amount": ("金额", "额度", "余额", "价款", "利率", "比例"), "date": ("日期", "日", "时间", "期限")}
USCC_ALPHABET = "0123456789ABCDEFGHJKLMNPQRTUWXY"
USCC_WEIGHTS = (1, 3, 9, 27, 19, 26, 16, 17, 20, 29, 25, 13, 8, 24, 10, 30, 28)


def blank(c: Column) -> Column:
    """Null, or nothing but blanks of any kind."""
    return is_blank(c)


def same(a: Column, b: Column) -> Column:
    """Equal values; null equals the empty text."""
    return F.coalesce(a, F.lit("")) == F.coalesce(b, F.lit(""))


def live(facts: DataFrame) -> DataFrame:
    """Facts that no other supersedes, each delivered row once."""
    return facts.filter("superseded_by is null").dropDuplicates(["fact_id"])


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the greatest `order` of each key; null keys are keys. An aggregate, so hot keys combine before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("b"))
    return best.select(*keys, *[F.col(f"b.{c}").alias(c) for c in rest])


def current(facts: DataFrame) -> DataFrame:
    """The newest live fact of each (key, entity)."""
    return latest(live(facts), ["key", "entity_id"], "fact_id")


def by_key(facts: DataFrame) -> DataFrame:
    """(key, fact_id, entity_id, value, ambiguous, entities): one fact a key, or none if several entities have one.

    Several facts of one entity (no entity counts as one) give the newest. Only counts and the newest row are gathered.
    """
    rows = live(facts)
    entity = F.coalesce(F.col("entity_id").cast("string"), F.lit(""))
    got = rows.groupBy("key").agg(F.min(entity).alias("lo"), F.max(entity).alias("hi"), F.countDistinct(entity).alias("entities"), F.max_by(F.struct("fact_id", "entity_id", "value"), "fact_id").alias("b"))
    one = F.col("lo") == F.col("hi")
    return got.select("key", *[F.when(one, F.col(f"b.{c}")).alias(c) for c in ("fact_id", "entity_id", "value")], (~one).alias("ambiguous"), "entities")


def candidates(facts: DataFrame) -> DataFrame:
    """The facts behind each ambiguous key, one row each."""
    rows = live(facts)
    return rows.join(by_key(facts).filter("ambiguous").select("key"), "key", "left_semi").select("key", "fact_id", "entity_id", "value", "provenance")


def lineage(facts: DataFrame, entities: DataFrame, sources: DataFrame) -> DataFrame:
    """Live facts with what they come from: the entity's type and the source's name and path. Both are one row a key."""
    e = entities.groupBy("entity_id").agg(F.min("entity_type").alias("entity_type"))
    s = sources.groupBy("source_id").agg(F.min("name").alias("source_name"), F.min("path").alias("source_path"))
    return live(facts).join(e, "entity_id", "left").join(s, "source_id", "left")


def show(facts: DataFrame, batch: str | None = None, entity: int | None = None, key_part: str | None = None, least_confidence: float | None = None) -> DataFrame:
    """Live facts that meet all given conditions; a missing confidence counts as 1. Conditions reach the scan."""
    rows = facts
    if batch is not None:
        rows = rows.filter(F.col("batch_no") == batch)
    if entity is not None:
        rows = rows.filter(F.col("entity_id") == entity)
    if key_part:
        rows = rows.filter(F.col("key").contains(key_part))
    if least_confidence is not None:
        rows = rows.filter(F.coalesce("confidence", F.lit(1.0)) >= least_confidence)
    return live(rows)


def conflicts(facts: DataFrame) -> DataFrame:
    """(key, entity_id, distinct_values) of live facts that differ for one entity and key."""
    rows = live(facts).filter("entity_id is not null")
    return rows.groupBy("key", "entity_id").agg(F.countDistinct(F.coalesce("value", F.lit(""))).alias("distinct_values")).filter("distinct_values > 1")


def preferred_names(names: DataFrame, on=None) -> DataFrame:
    """(entity_id, name): the current name before others, then the lowest id."""
    rank = F.struct(F.when(F.col("name_kind") == "现用名", 0).otherwise(1), F.col("name_id"))
    return names.filter("entity_id is not null").groupBy("entity_id").agg(F.min_by("name", rank).alias("name"))


def latest_case(cases: DataFrame) -> DataFrame:
    return cases.filter("entity_id is not null").groupBy("entity_id").agg(F.max("case_id").alias("case_id"))


def put(existing: DataFrame, incoming: DataFrame, mode: str = "record") -> DataFrame:
    """What putting a batch of facts does: (batch_no, key, entity_id, incoming_ord, old_value, value, action).

    incoming: (ord, batch_no, key, entity_id, value). Each is held against the newest live fact of its batch, key and entity
    (null being an entity), as the rows of the same batch before it have left it. Actions: inserted, unchanged,
    superseded (a blank value gets one, or mode `supersede`), kept_existing (mode `ignore`), conflict (mode `record`).

    Rows of one key are folded in order by a window: what stands before row i is the last row that replaced the value. With
    `supersede` that is the row before; else the first value that is not blank stands for good.
    """
    keys = ["batch_no", "key", "entity_id"]
    old = latest(live(existing).select(*keys, "fact_id", F.col("value").alias("stored")), keys, "fact_id")
    a, b = incoming.alias("a"), old.alias("b")
    on = F.col("a.batch_no").eqNullSafe(F.col("b.batch_no")) & (F.col("a.key") == F.col("b.key")) & F.col("a.entity_id").eqNullSafe(F.col("b.entity_id"))
    rows = a.join(b, on, "left").select("a.*", "b.stored", F.col("b.fact_id").isNotNull().alias("had"))
    before = Window.partitionBy(*keys).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.count(F.lit(1)).over(before) > 0
    if mode == "supersede":
        standing = F.when(earlier, F.last("value").over(before)).otherwise(F.col("stored"))
    else:
        # the stored value unless blank, then the first earlier one that is not blank
        first = F.first(F.when(~blank(F.col("value")), F.col("value")), ignorenulls=True).over(before)
        standing = F.when(~blank(F.col("stored")), F.col("stored")).otherwise(F.coalesce(first, F.col("stored")))
    rows = rows.withColumn("old_value", standing).withColumn("exists", F.col("had") | earlier)
    action = (
        F.when(~F.col("exists"), "inserted").when(same(F.col("old_value"), F.col("value")), "unchanged").when(blank(F.col("old_value")) & ~blank(F.col("value")), "superseded")
        .otherwise({"ignore": "kept_existing", "supersede": "superseded"}.get(mode, "conflict"))
    )
    return rows.select(*keys, F.col("ord").alias("incoming_ord"), "old_value", "value", action.alias("action"))


def high_risk(field: Column) -> Column:
    """The class of fields that are never filled without asking; null for others."""
    out = None
    for name, words in HIGH_RISK.items():
        hit = field.rlike("|".join(words))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def claimed_role(key: Column) -> Column:
    out = None
    for role in ROLES:
        out = F.when(key.contains(role), role) if out is None else out.when(key.contains(role), role)
    return out


def norm_rule(key: Column) -> Column:
    out = None
    for name, words in NORM_RULES.items():
        hit = key.rlike("|".join(words))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("text")


def merge_plan(stored: DataFrame, incoming: DataFrame, delivered: DataFrame | None = None, include_new: bool = True) -> DataFrame:
    """(key, entity_id, existing, incoming, kind, high_risk, must_tick) of what incoming facts would change.

    stored, incoming: one (key, entity_id, value) a key and entity. Equal values are left out; a blank incoming value is listed as
    `incoming_blank` and never applied. Delivered keys (key) and high-risk ones must be ticked one by one unless they only fill a blank.
    """
    a, b = incoming.alias("a"), stored.alias("b")
    both = a.join(b, (F.col("a.key") == F.col("b.key")) & F.col("a.entity_id").eqNullSafe(F.col("b.entity_id")), "left")
    had = F.col("b.key").isNotNull()
    kind = (
        F.when(blank(F.col("a.value")), F.when(had, "incoming_blank")).when(~had, "new" if include_new else None)
        .when(same(F.col("a.value"), F.col("b.value")), None).when(blank(F.col("b.value")), "fill_blank").otherwise("conflict")
    )
    rows = both.select("a.key", "a.entity_id", F.col("b.value").alias("existing"), F.col("a.value").alias("incoming"), kind.alias("kind"), high_risk(F.col("a.key")).alias("high_risk")).filter("kind is not null")
    if delivered is not None:
        rows = rows.join(delivered.select("key").distinct().withColumn("was_delivered", F.lit(True)), "key", "left")
    else:
        rows = rows.withColumn("was_delivered", F.lit(False))
    tick = (F.col("high_risk").isNotNull() | F.coalesce("was_delivered", F.lit(False))) & (F.col("kind") != "fill_blank")
    return rows.select("key", "entity_id", "existing", "incoming", "kind", "high_risk", tick.alias("must_tick"))


def for_subjects(facts: DataFrame, roles: DataFrame, scopes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(own, fallback): facts of each subject's scope, and what stands where a scope has none.

    roles: (entity_id, role), scopes: (subject, entity_id). A key that claims a role takes facts of the entities that hold it, any
    other key those of the scope; a key that claims the legal representative while nobody holds that role takes the
    holders of the company's role it names. own: (subject, key, fact_id, value, ambiguous, candidates), one fact being the
    answer, several ambiguous. fallback: (key, fact_id, value, ambiguous, candidates), a row a key: the one fact of the
    role's holders anywhere, else the one fact without an entity.

    One join with scopes for all subjects; groups are combined before the shuffle.
    """
    # of a closed set of three
    present = {r[0] for r in roles.filter(F.col("role").isin(*ROLES)).select("role").distinct().collect()}
    claimed = claimed_role(F.col("key"))
    if ROLES[0] not in present:
        company = F.when(F.col("key").contains(ROLES[1]), ROLES[1]).when(F.col("key").contains(ROLES[2]), ROLES[2]).otherwise(ROLES[0])
        claimed = F.when(claimed == ROLES[0], company).otherwise(claimed)
    rows = live(facts).select("fact_id", "key", "entity_id", "value", claimed.alias("claimed"))
    held = roles.select(F.col("entity_id").alias("holder"), "role").distinct()
    rows = rows.join(held, (F.col("entity_id") == F.col("holder")) & (F.col("claimed") == F.col("role")), "left").withColumn("holds", F.col("holder").isNotNull())
    answer = lambda n, best: (F.when(n == 1, best["fact_id"]).alias("fact_id"), F.when(n == 1, best["value"]).alias("value"), (n > 1).alias("ambiguous"), n.alias("candidates"))
    fact = F.struct("fact_id", "value")
    inside = rows.filter("claimed is null or holds").join(scopes.select("subject", "entity_id").distinct(), "entity_id")
    own = inside.groupBy("subject", "key").agg(F.count(F.lit(1)).alias("n"), F.max_by(fact, "fact_id").alias("b")).select("subject", "key", *answer(F.col("n"), F.col("b")))
    nobody = F.col("entity_id").isNull()
    per = rows.groupBy("key").agg(F.count_if("holds").alias("role"), F.max_by(fact, F.when(F.col("holds"), F.col("fact_id"))).alias("b_role"), F.count_if(nobody).alias("none"), F.max_by(fact, F.when(nobody, F.col("fact_id"))).alias("b_none"))
    some = per.select("key", F.when(F.col("role") > 0, F.col("role")).otherwise(F.col("none")).alias("n"), F.when(F.col("role") > 0, F.col("b_role")).otherwise(F.col("b_none")).alias("b")).filter("n > 0")
    return own, some.select("key", *answer(F.col("n"), F.col("b")))


def for_subject(facts: DataFrame, roles: DataFrame, subject: int, scope: list[int]) -> DataFrame:
    """(key, fact_id, value, ambiguous, candidates): facts of one subject and its scope, with the fallback for keys that they lack; as for_subjects."""
    inside = [(subject, e) for e in dict.fromkeys([*scope, subject])]
    own, rest = for_subjects(facts, roles, facts.sparkSession.createDataFrame(inside, "subject bigint, entity_id bigint"))
    own = own.drop("subject")
    return own.unionByName(rest.join(own.select("key"), "key", "left_anti"))


def uscc_ok(c: Column) -> Column:
    """Whether the check character of an 18-character code is right; null for anything else. Native expressions only."""
    v = F.upper(F.trim(c))
    total = F.lit(0)
    for i, w in enumerate(USCC_WEIGHTS, 1):
        total = total + (F.call_function("instr", F.lit(USCC_ALPHABET), F.substring(v, i, 1)) - 1) * w
    check = F.call_function("substring", F.lit(USCC_ALPHABET), (31 - total % 31) % 31 + 1, F.lit(1))
    return F.when(v.rlike(f"^[{USCC_ALPHABET}]{{18}}$"), check == F.substring(v, 18, 1))


def identity_gaps(entities: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """(entity_id, has_evidence, pending): entities without an identity key, with whether facts hold one and the entity's pending reason."""
    def none(c: str) -> Column:
        return blank(F.col(c)) | F.lower(F.trim(c)).isin("n/a", "无", "待补")

    gaps = entities.dropDuplicates(["entity_id"]).filter(none("uscc") & none("id_card") & none("bank_no"))
    proof = live(facts).filter(F.col("key").isin(*keys) & ~blank(F.col("value")) & F.col("entity_id").isNotNull()).select("entity_id").distinct().withColumn("proof", F.lit(True))
    return gaps.join(proof, "entity_id", "left").select("entity_id", F.coalesce("proof", F.lit(False)).alias("has_evidence"), F.coalesce("identity_pending_reason", F.lit("")).alias("pending"))


def summary(facts: DataFrame, entities: DataFrame, sources: DataFrame) -> DataFrame:
    """(what, n): the store's counts, one aggregation a table."""
    f = facts.dropDuplicates(["fact_id"]).agg(
        F.count(F.lit(1)).alias("facts"), F.count_if(F.col("superseded_by").isNull()).alias("live_facts"), F.count_if(F.col("entity_id").isNull()).alias("unassigned_facts"),
        F.count_if(F.col("status") == "missing").alias("missing_facts"), F.count_if(F.col("status") == "suspect").alias("suspect_facts"), F.countDistinct("key").alias("keys"), F.countDistinct("batch_no").alias("batches"),
    )
    e = entities.agg(F.countDistinct("entity_id").alias("entities"))
    s = sources.agg(F.countDistinct("source_id").alias("sources"))
    rows = lambda df: df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).cast("bigint").alias("n")) for c in df.columns])))
    return rows(f).unionAll(rows(e)).unionAll(rows(s))


def withdrawn(facts: DataFrame, seen: DataFrame) -> DataFrame:
    """Live facts drawn from sources whose (source_id, key) were not seen again, to be superseded by a missing value."""
    return live(facts).filter("source_kind = 'source' and source_id is not null").join(seen.select("source_id", "key").distinct(), ["source_id", "key"], "left_anti")


def trace(key: str, **tables: DataFrame) -> DataFrame:
    """(what, id, at, text): everything of one key in tables of (id, key, at, text), newest last."""
    out = None
    for what, df in tables.items():
        part = df.filter(F.col("key") == key).select(F.lit(what).alias("what"), F.col("id").cast("string").alias("id"), F.col("at").alias("at"), F.col("text").alias("text"))
        out = part if out is None else out.unionAll(part)
    return out


def format_hint(kind: str, value: Column) -> Column:
    """What looks unusual about an identity key, null if nothing does. A hint never refuses a value."""
    v = F.trim(value)
    hint = {
        "uscc": F.when(F.upper(v).rlike("^[0-9A-Z]{18}$"), F.when(~F.coalesce(uscc_ok(v), F.lit(False)), "check digit")).otherwise("not 18 letters and digits"),
        "bank_no": F.when(~v.rlike(r"^\d{19}$"), "not 19 digits"), "id_card": F.when(~v.rlike(r"^\d{17}[\dXx]$"), "not 17 digits and a check digit"),
    }[kind]
    return F.when(blank(value), "empty").otherwise(hint)


def with_role(roles: DataFrame, entities: DataFrame, role: str) -> DataFrame:
    """Entities that hold a role, each once."""
    return roles.filter(F.col("role") == role).select("entity_id").distinct().join(entities.dropDuplicates(["entity_id"]), "entity_id")


def unassigned(facts: DataFrame) -> DataFrame:
    return live(facts).filter("entity_id is null")


def ordered(facts: DataFrame, by: str = "key") -> DataFrame:
    """Live facts in order of key, entity, case, batch or confidence, the surest first; a missing confidence counts as 1."""
    first = {"entity": F.col("entity_id"), "case": F.col("case_id"), "batch": F.col("batch_no"), "confidence": F.desc(F.coalesce("confidence", F.lit(1.0)))}.get(by, F.col("key"))
    return live(facts).orderBy(first, "fact_id")


def discarded(rows: DataFrame, at: Column, actor: str = "user") -> DataFrame:
    """(batch_no, event_type, target, payload, actor, at): what is put aside leaves an event and no fact. rows: (batch_no, key, value, reason)."""
    payload = F.to_json(F.struct("key", "value", "reason"))
    return rows.select("batch_no", F.lit("fact_discarded").alias("event_type"), F.col("key").alias("target"), payload.alias("payload"), F.lit(actor).alias("actor"), at.alias("at"))


def more_counts(facts: DataFrame, entities: DataFrame, cases: DataFrame, decisions: DataFrame) -> DataFrame:
    """(what, n): further counts of a store, one aggregation a table; each delivered row counts once."""
    n = lambda key, when=None: F.countDistinct(F.col(key) if when is None else F.when(when, F.col(key)))
    parts = [
        cases.agg(n("case_id").alias("cases")), entities.agg(n("entity_id", F.col("identity_incomplete") == 1).alias("entities_without_key")),
        facts.agg(n("fact_id", F.col("superseded_by").isNull() & (F.col("value") != "")).alias("facts_with_value"), n("fact_id", F.col("superseded_by").isNotNull()).alias("facts_superseded")),
        decisions.agg(n("fingerprint").alias("decisions"), n("fingerprint", F.col("action") == "blank").alias("decisions_blank"), n("run_id").alias("runs")),
    ]
    out = None
    for df in parts:
        rows = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).cast("bigint").alias("n")) for c in df.columns])))
        out = rows if out is None else out.unionAll(rows)
    return out
