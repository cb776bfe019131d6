"""Questions and answers, ingest, labels, slots, numbering and counted quantiles on small tables, and their edge cases."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tallyloom.functions.numbering import numbered
from tallyloom.operators import dialogue, extract, files, profile, store, tables


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_settled_and_refused(spark):
    kind = "item_id bigint, resolution string, resolved_by string, resolved_at string"
    items = spark.createDataFrame([(1, None, None, None), (2, None, None, None), (3, "left_blank", "u", "1")], kind)
    answers = spark.createDataFrame([(1, "took_existing", "u", "1"), (1, "took_incoming", "u", "2"), (2, "other", "u", "1"), (9, "left_blank", "u", "1"), (2, None, None, None)], kind)
    after, refused = dialogue.settled(items, answers)
    assert rows(after) == [(1, "took_incoming", "u", "2"), (2, None, None, None), (3, "left_blank", "u", "1")]
    assert sorted(r.item_id for r in refused.collect()) == [2, 2, 9]
    assert rows(dialogue.settled(items.limit(0), answers.limit(0))[0]) == []


def test_conflicts_and_ingest(spark):
    kind = "row_id bigint, key string, entity_name string, value string"
    data = [(1, "k", "a", "x"), (2, "k", "a", "y"), (3, "k", "a", "y"), (4, "k", None, "p"), (5, "k", None, "q"), (6, "m", "a", "z"), (7, "m", "a", "z"), (8, "n", "a", None)]
    r = spark.createDataFrame(data, kind)
    assert [(x[0], x[1], x[2], x[3], x[4]) for x in rows(dialogue.value_conflicts(r))] == [("k", "a", 1, "x", 1), ("k", "a", 2, "y", 2), ("k", None, 1, "p", 1), ("k", None, 2, "q", 1)]
    answers = spark.createDataFrame([("k", "a", 2, None), ("k", None, None, " own ")], "key string, entity_name string, pick int, custom string")
    after = {x.row_id: (x.value, x.dropped, x.by_user) for x in dialogue.answered_conflicts(r, answers).collect()}
    assert after[2] == ("y", False, True) and after[1][1] and after[3][1] and after[4] == ("own", False, True) and after[5][1] and after[6] == ("z", False, False)
    stopped, stops = dialogue.ingestable(r.withColumn("dropped", F.lit(False)))
    assert rows(stopped) == [] and rows(stops) == [("k", "a"), ("k", None)]
    written, stops = dialogue.ingestable(dialogue.answered_conflicts(r, answers))
    assert rows(stops) == [] and sorted(x.row_id for x in written.collect()) == [2, 4, 6, 8]


def test_ownership_questions_and_answers(spark):
    kind = "source string, line int, key string, value string, entity_name string, quote string, context string, certificate boolean"
    data = [("s", 1, "k", "v", None, "q", "c", False), ("s", 9, "k", "v", None, "q", "c", False), ("s", 1, "k", "w", None, "q", "c", False), ("s", 3, "证件号码", "1", "p", "z", "c", True), ("s", 3, "证件类型", "身份证", "p", "z", "c", True)]
    asked = dialogue.ownership_questions(spark.createDataFrame(data, kind), F.lit("b"))
    assert sorted((r.key, r.occurrences, r.texts) for r in asked.collect()) == [("k", 1, 1), ("k", 2, 1), ("证件号码", 1, 1)]
    r = spark.createDataFrame([("1", None), ("2", "x"), ("3", "y"), ("4", "z")], "question string, entity_name string")
    answers = spark.createDataFrame([("1", "归属：甲（推荐）", ""), ("2", "暂不收录", None), ("3", "暂不收录", "乙")], "question string, selected string, custom string")
    assert rows(dialogue.answered_ownership(r, answers).select("question", "entity_name", "dropped")) == [("1", "甲", False), ("2", "x", True), ("3", "乙", False), ("4", "z", False)]


def test_ingested_names_and_owners(spark):
    r = spark.createDataFrame([(1, "借款人名称", "甲", None), (2, "保证人名称", "乙", None), (3, "保证人联系电话", "1", None), (4, "地址", "某路", None), (5, "地址", "他路", 77), (6, "借款人名称", None, None)], "row_id bigint, key string, value string, declared bigint")
    names = spark.createDataFrame([("甲", 10), ("丙", 12)], "name string, entity_id bigint")
    none = spark.createDataFrame([], "role string, entity_id bigint")
    new, owned = dialogue.ingested(r, names, none, 5)
    assert rows(new) == [("乙", 13)]
    assert [(x.row_id, x.entity_id, x.basis) for x in owned.orderBy("row_id").collect()] == [(1, 10, "name"), (2, 13, "name"), (3, 13, "slot"), (4, 5, "default"), (5, 77, "declared"), (6, 10, "slot")]


def test_titles_split_labels_and_narratives(spark):
    text = "借款人：甲公司 联系电话：1380\n保证合同\n联系电话：1390\n保证人（二）：乙公司\n法定代表人：丙\n身份证号：12345\n借款人地址：某路\n借款合同\n利率：3%\n本次借款金额为人民币500元。\n授信金额共计 30 万元\n普通说明"
    lines = extract.split_labels(extract.lines(spark.createDataFrame([(1, text), (2, None)], "doc_id bigint, text string")))
    got = {(r.line, r.part): r for r in extract.narratives(extract.owned(extract.labelled(lines))).collect()}
    assert got[0, 1].label == "联系电话" and got[0, 1].owner == "甲公司" and got[0, 1].quote.startswith("借款人")
    assert got[2, 0].owner is None and got[2, 0].owner_kind == "unknown"
    assert got[4, 0].owner == "乙公司" and (got[5, 0].owner, got[5, 0].owner_kind) == ("丙", "person") and got[6, 0].owner == "甲公司" and got[8, 0].owner == "甲公司"
    assert got[9, 0].amount == "500" and got[10, 0].narrative == "unparsed" and got[11, 0].narrative is None


def test_slots(spark):
    r = spark.createDataFrame([(1, 0, "甲方（盖章）____，日期：____ 金额：……元"), (1, 1, "法定代表人："), (1, 2, "无"), (1, 3, None), (1, 4, "□是 □否")], "doc_id bigint, line int, line_text string")
    got = rows(extract.line_slots(r).select("line", "start", "end", "label", "protected"))
    assert (1, 6, 6, "法定代表人", False) in got and (4, 0, 1, None, False) in got and (4, 3, 4, "是", False) in got
    assert [(g[3], g[4]) for g in sorted(g for g in got if g[0] == 0)] == [("甲方（盖章）", True), ("日期", False), ("金额", False)]
    assert spark.createDataFrame([("甲\n乙：",), ("说明。长",), ("",), (None,), ("字" * 30,)], "t string").select(extract.short_label(F.col("t"))).collect() == [("甲乙",), (None,), (None,), (None,), (None,)]


def test_numbers_are_consecutive(spark):
    df = spark.range(5000).select(F.xxhash64("id").alias("k")).repartition(7)
    got = [r.n for r in numbered(df, "k").orderBy("k").collect()]
    assert got == list(range(1, 5001)) and numbered(df.limit(0), "k").count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 5, 2000])
def test_counted_quantiles(spark, n):
    rnd = random.Random(n)
    xs = [rnd.choice([None, float(rnd.randint(0, 40)), rnd.random()]) for _ in range(n)]
    df = spark.createDataFrame([(x, 1.0) for x in xs], "x double, y double")
    got = {r.column: r for r in profile.quantiles(profile.counted(df, ["x", "y"]), (0.25, 0.5, 1.0)).collect()}
    have = sorted(x for x in xs if x is not None)
    if not have:
        assert "x" not in got
        return
    at = lambda p: (lambda r: have[int(r)] + (have[min(int(r) + 1, len(have) - 1)] - have[int(r)]) * (r - int(r)))((len(have) - 1) * p)
    assert got["x"].distinct_values == len(set(have)) and all(abs(a - at(p)) < 1e-9 for a, p in zip(got["x"].q, (0.25, 0.5, 1.0), strict=True))


def test_outliers_of_several_columns(spark):
    df = spark.createDataFrame([(float(i), 1.0) for i in range(10)] + [(1000.0, 5.0), (None, None)], "a double, b double")
    got = tables.mark_outliers(df, "a", "b", clip=True)
    assert got.filter("a_is_outlier").count() == 1 and got.agg(F.max("a")).first()[0] < 1000 and got.filter("b_is_outlier").count() == 0


def test_runs_and_listings(spark):
    ops = spark.createDataFrame([("b", "b-R1", "run"), ("b", "b-R3", "field"), ("c", None, "run")], "batch_no string, run_id string, kind string")
    assert rows(store.next_runs(ops, spark.createDataFrame([("b",), ("c",), ("d",)], "batch_no string"))) == [("b", "b-R2"), ("c", "c-R1"), ("d", "d-R1")]
    f = spark.createDataFrame([(f"/{i}", i) for i in range(5)], "path string, modified int")
    assert files.listing(f, 3).filter("truncated").count() == 3 and files.listing(f, 9).filter("not truncated").count() == 5
