"""Writes of the fact store as frames."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from tallyloom.operators import facts, store


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_sources_and_entities(spark):
    new = spark.createDataFrame([(1, "p", "a"), (2, "p", "a"), (3, "p", "b"), (4, "q", "a")], "id int, path string, sha256 string")
    assert {r.path + r.sha256 for r in store.new_sources(new, spark.createDataFrame([("p", "b")], "path string, sha256 string")).collect()} == {"pa", "qa"}
    names = spark.createDataFrame([("甲", 5), ("甲", 3), ("乙", None)], "name string, entity_id bigint")
    assert rows(store.resolved_entities(spark.createDataFrame([("甲",), ("乙",), (None,), ("甲",)], "name string"), names)) == sorted([("甲", 3, False), ("乙", None, True)], key=repr)


def test_upserts(spark):
    old = spark.createDataFrame([("t", "f", 1), ("t", "g", 2)], "template string, field string, rule_id int")
    new = spark.createDataFrame([("t", "f", 5), ("t", "f", 7), ("u", "f", 6)], "template string, field string, rule_id int")
    after, off = store.upserted_rules(old, new, old.drop("rule_id"), "rule_id")
    assert rows(after) == [("t", "f", 7), ("t", "g", 2), ("u", "f", 6)] and rows(off) == [("t", "g")]
    roles = spark.createDataFrame([(1, None, "借款人", 1)], "entity_id bigint, case_id bigint, role string, ord int")
    asked = spark.createDataFrame([(2, 9, "保证人", 2), (3, 9, "别的", 3), (None, 9, "保证人", 4)], "entity_id bigint, case_id bigint, role string, ord int")
    after, refused = store.set_roles(roles, asked, "ord")
    assert after.count() == 2 and refused.count() == 2
    rules = spark.createDataFrame([(1, "x", "h"), (2, "y", "h")], "rule_id int, target string, template_sha256 string")
    ok, bad = store.disabled_rules(rules, spark.createDataFrame([(1, "x", "h"), (2, "z", "h"), (9, "x", "h")], "rule_id int, target string, template_sha256 string"))
    assert rows(ok.select("rule_id")) == [(1,)] and rows(bad.select("rule_id")) == [(2,), (9,)]


def test_plan_selection_and_staleness(spark):
    s = spark.createDataFrame([("账号", 1, "a"), ("电话", 1, "")], "key string, entity_id bigint, value string")
    plan = facts.merge_plan(s, spark.createDataFrame([("账号", 1, "b"), ("电话", 1, "5"), ("新", 1, "v")], "key string, entity_id bigint, value string")).withColumn("n", F.when(F.col("key") == "账号", 1).when(F.col("key") == "电话", 2).otherwise(3))
    assert rows(store.selected(plan).select("n")) == [(2,)]
    picks = spark.createDataFrame([(1, "accept"), (3, "accept"), (3, "skip")], "n int, action string")
    assert rows(store.selected(plan, picks).select("n")) == [(1,)]
    fresh, stale = store.applied(plan, s.withColumn("value", F.when(F.col("key") == "账号", "changed").otherwise(F.col("value"))))
    assert rows(fresh.select("n")) == [(2,), (3,)] and rows(stale.select("n")) == [(1,)]
    assert store.same_plan(plan, plan.orderBy(F.desc("n"))) and not store.same_plan(plan, plan.filter("n > 1"))


def test_identity(spark):
    e = spark.createDataFrame([(1, "legal_person", "A", None, None), (2, "natural_person", None, None, "P"), (3, "legal_person", None, None, None)], "entity_id bigint, entity_type string, uscc string, bank_no string, id_card string")
    asked = spark.createDataFrame([(3, "uscc", "a "), (3, "bank_no", "9"), (1, "id_card", "Q"), (2, "id_card", "p"), (8, "uscc", "Z"), (3, "uscc", " "), (2, "bank_no", "9")], "entity_id bigint, kind string, value string")
    got = {(r.entity_id, r.kind, r.value): r.problem for r in store.identity_changes(e, asked).collect()}
    assert got == {(3, "uscc", "A"): "in use", (3, "bank_no", "9"): "asked twice", (1, "id_card", "Q"): "wrong type", (2, "id_card", "P"): None, (8, "uscc", "Z"): "no such entity", (3, "uscc", ""): "no value", (2, "bank_no", "9"): "wrong type"}


def test_roles(spark):
    f = spark.createDataFrame([(1, "地址", 1, "a", None), (2, "地址", 2, "b", None), (3, "地址", 3, "c", None), (4, "电话", 2, "d", None)], "fact_id bigint, key string, entity_id bigint, value string, superseded_by bigint")
    roles = spark.createDataFrame([(1, "借款人", ""), (2, "保证人", "材料明确保证人1"), (3, "保证人", "材料明确保证人2")], "entity_id bigint, role string, evidence string")
    assert {r.alias: (r.value, r.ambiguous) for r in store.role_aliases(f, roles).collect()} == {"借款人地址": ("a", False), "保证人地址": (None, True), "保证人1地址": ("b", False), "保证人2地址": ("c", False), "保证人电话": ("d", False), "保证人1电话": ("d", False)}
    lines = spark.createDataFrame([(1, "借款人甲公司与保证人乙公司"), (2, "丙公司")], "line_id int, text string")
    assert rows(store.inferred_roles(lines, spark.createDataFrame([("甲公司",), ("乙公司",), ("丙公司",)], "name string"))) == sorted([("甲公司", "借款人"), ("乙公司", "保证人")], key=repr)


def test_packs_and_values(spark):
    pack = spark.createDataFrame([("n", "h", "f"), ("n", "h", "g")], "name string, sha256 string, field string")
    t, used = spark.createDataFrame([("n", "h")], "name string, sha256 string"), spark.createDataFrame([("n", "f")], "name string, field string")
    add, held = store.imported_rules(pack, t, used)
    assert rows(add.select("field")) == [("g",)] and held.count() == 0
    add, held = store.imported_rules(pack.unionAll(spark.createDataFrame([("m", "x", "f")], pack.schema)), t, used)
    assert add.count() == 0 and held.count() == 1
    df = spark.createDataFrame([("5万元", "元"), ("USD 5", "万元"), ("5", "元"), ("5", "")], "value string, printed string")
    assert [r[0] for r in df.select(store.fitted_value(F.col("value"), F.col("printed"))).collect()] == ["5万", None, "5", "5"]
    got = spark.createDataFrame([("{{a.b[0]}}-{{x}}", '{"a": {"b": [7]}}'), (None, None)], "t string, v string").select(store.rendered("t", "v"), store.sm3("t")).collect()
    assert got[0][0] == "7-{{x}}" and got[1][0] is None and (len(got[0][1]) == 64 or got[0][1] == hashlib.sha256(b"").hexdigest())
    ops = spark.createDataFrame([("r", "field", "f"), ("r", "artifact", "d"), ("s", "field", "g")], "run_id string, kind string, target string")
    assert rows(store.delivered_fields(ops)) == [("r", "f")]
