"""Table, fact-store, audit, matching, extraction, file and quality operators, and the readers."""

from __future__ import annotations

import os
import random
import zipfile
from datetime import date, datetime
from difflib import SequenceMatcher

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import audit, combine, decide, extract, facts, files, pivot, profile, quality, tables
from tallyloom.sources import readers


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ---- tables


def test_names_and_columns(spark):
    assert tables.tidy_names([" 金额（元） ", "a  b", "a_b", "a b", "", "x\n y"]) == ["金额(元)", "a_b", "a_b_1", "a_b_2", "column", "x_y"]
    df = spark.createDataFrame([(1, None, "x", None), (None, None, None, None)], "index int, `unnamed: 3` string, v string, e string")
    assert tables.drop_noise_columns(tables.drop_empty(df)).columns == ["v"]
    assert tables.drop_empty(df.limit(0)).columns == []


@pytest.mark.parametrize(("text", "number"), [("１，２３４．５", 1234.5), ("(1,234)", -1234.0), ("12%", 12.0), ("¥ 1,234,567", 1234567.0), ("1,23", None), ("1d", None), ("nan", None), ("RMB 5", 5.0), ("1e3", 1000.0), ("", None), (None, None), ("3-5", None), ("（7）", -7.0), ("9" * 100_000 + "x", None)])
def test_numbers(spark, text, number):
    assert spark.createDataFrame([(text,)], "t string").select(tables.to_number(F.col("t"))).first()[0] == number


def test_inference_and_clean(spark):
    df = spark.createDataFrame([(1, " 2024年1月2日 ", "1,000", "A-b"), (2, "2024/2/3", "无", "ab"), (3, "N/A", "2.5", "a_B"), (3, "N/A", "2.5", "a_B")], "id bigint, d string, n string, c string")
    out = tables.clean(df, order="id")
    assert rows(out) == sorted([(1, date(2024, 1, 2), 1000.0, "A-b", False), (2, date(2024, 2, 3), None, "A-b", False), (3, None, 2.5, "A-b", False)], key=repr) or out.count() == 3
    assert dict(out.dtypes)["d"] == "date" and dict(out.dtypes)["n"] == "double"
    assert {r.c for r in out.collect()} == {"A-b"}
    assert tables.infer_kinds(spark.createDataFrame([("3.14",), ("2.71",)], "x string")) == {"x": "number"}


def test_outliers(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 2, 3, 4, 5, 6, 7, 1000]], "x double")
    assert tables.mark_outliers(df, "x", clip=True).agg(F.max("x"), F.count_if("x_is_outlier")).first()[:] == (11.5, 1)
    assert tables.mark_outliers(df.limit(3), "x").filter("x_is_outlier").count() == 0 and tables.mark_outliers(df.limit(0), "x").count() == 0


# ---- profile and pivot


def test_profile_equals_pandas(spark):
    rnd = random.Random(1)
    xs = [rnd.gauss(0, 3) if rnd.random() > 0.1 else None for _ in range(200)] + [99.0]
    r = profile.numbers(spark.createDataFrame([(x,) for x in xs], "x double"), ["x"]).first()
    s = pd.Series(xs, dtype=float)
    q1, q3 = s.quantile(0.25), s.quantile(0.75)
    assert r.missing == s.isna().sum() and abs(r.skew - s.skew()) < 1e-9 and abs(r["std"] - s.std()) < 1e-9 and abs(r.q1 - q1) < 1e-12
    assert r.outliers == ((s < q1 - 1.5 * (q3 - q1)) | (s > q3 + 1.5 * (q3 - q1))).sum()
    assert profile.numbers(spark.createDataFrame([], "x double"), ["x"]).first().missing is None


def test_issues_and_header(spark):
    df = spark.createDataFrame([(" a", "1,000"), ("ｂ１", "2,000"), ("N/A", "3,000"), (None, "4")], "t string, n string")
    assert {(r["column"], r.issue): r.rows for r in profile.issues(df, ["t", "n"]).collect()} == {("t", "untrimmed"): 1, ("t", "full_width"): 1, ("t", "null_token"): 1, ("n", "number_as_text"): 4, ("n", "all_unique"): 4}
    cells = spark.createDataFrame([("s", 0, "title"), ("s", 1, "name"), ("s", 1, "amount"), ("s", 2, "x"), ("s", 2, "1,000")], "sheet string, row int, text string")
    assert rows(profile.header_row(cells)) == [("s", 1)]


def test_pivot(spark):
    df = spark.createDataFrame([("a", "x", 1.0, "p"), ("a", "y", 2.0, "q"), ("b", "x", 4.0, None)], "k string, c string, v double, t string")
    assert rows(pivot.pivot(df, ["k"], ["v"], "sum", "c")) == [("a", 1.0, 2.0), ("b", 4.0, 0.0)]
    wide = pivot.pivot(df, ["k"], ["v"], "v:sum,v:count", "c", ["x", "y"])
    assert wide.columns == ["k", "v_sum_x", "v_count_x", "v_sum_y", "v_count_y"]
    assert rows(pivot.pivot(df, ["k"], ["t"], "mean")) == [("a", 2), ("b", 0)]
    with pytest.raises(ValueError):
        pivot.pivot(df, ["nope"])
    with pytest.raises(ValueError):
        pivot.parse_aggregations("v:nope")
    assert rows(pivot.top_with_other(df, "c", "v", 1)) == [("other (1)", 2.0), ("x", 5.0)]
    assert rows(pivot.histogram(df, "v", 3)) == [(1, 1), (2, 1), (3, 1)] and pivot.histogram(df.limit(0), "v").count() == 0


# ---- combine


def test_join_and_compare(spark):
    a = spark.createDataFrame([(1, "x"), (None, "n")], "k int, v string")
    b = spark.createDataFrame([(1, "y"), (None, "m"), (3, "z")], "k int, v string")
    assert rows(combine.joined([a, b, b], ["k"])) == [(1, "x", "y", "y"), (None, "n", "m", "m")]
    assert combine.joined([a, b], ["k"], "outer").count() == 3
    assert rows(combine.changed(a.filter("k = 1"), b, ["k"])) == [(1, "v", "x", "y")]
    assert rows(combine.only_in(b, a, ["k"])) == [("3",)]
    assert combine.stacked([a, b.withColumn("w", F.lit(1))], "src").columns == ["k", "v", "src", "w"]


# ---- facts

FACT = "fact_id bigint, batch_no string, key string, entity_id bigint, value string, superseded_by bigint"


@pytest.mark.parametrize(("mode", "expected"), [("record", ["unchanged", "conflict", "superseded", "conflict", "inserted", "unchanged"]), ("supersede", ["unchanged", "superseded", "superseded", "superseded", "inserted", "unchanged"]), ("ignore", ["unchanged", "kept_existing", "superseded", "kept_existing", "inserted", "unchanged"])])
def test_put(spark, mode, expected):
    old = spark.createDataFrame([(1, "b", "k", 1, "v", None), (2, "b", "e", None, "　", None), (3, "b", "k", 1, "old", 1)], FACT)
    new = spark.createDataFrame([(1, "b", "k", 1, "v"), (2, "b", "k", 1, "w"), (3, "b", "e", None, "x"), (4, "b", "e", None, "y"), (5, "b", "n", 1, None), (6, "b", "n", 1, "")], "ord bigint, batch_no string, key string, entity_id bigint, value string")
    assert [r.action for r in facts.put(old, new, mode).orderBy("incoming_ord").collect()] == expected


def test_by_key_and_subject(spark):
    f = spark.createDataFrame([(1, "b", "a", 1, "x", None), (2, "b", "a", 1, "y", None), (2, "b", "a", 1, "y", None), (3, "b", "c", 1, "x", None), (4, "b", "c", None, "z", None), (5, "b", "保证人电话", 2, "p", None), (6, "b", "保证人电话", 3, "q", None)], FACT)
    assert rows(facts.by_key(f)) == sorted([("a", 2, 1, "y", False, 1), ("c", None, None, None, True, 2), ("保证人电话", None, None, None, True, 2)], key=repr)
    roles = spark.createDataFrame([(2, "保证人")], "entity_id bigint, role string")
    got = {r.key: (r.value, r.ambiguous) for r in facts.for_subject(f, roles, 1, [1]).collect()}
    assert got == {"a": (None, True), "c": ("x", False), "保证人电话": ("p", False)}
    # nobody is a legal representative: the key's company role counts
    g = f.unionByName(spark.createDataFrame([(7, "b", "保证人法定代表人", 2, "r", None), (8, "b", "保证人法定代表人", 1, "s", None)], FACT))
    assert {r.key: r.value for r in facts.for_subject(g, roles, 1, []).collect()}["保证人法定代表人"] == "r"
    legal = roles.unionByName(spark.createDataFrame([(1, "法定代表人")], "entity_id bigint, role string"))
    own, rest = facts.for_subjects(g, legal, spark.createDataFrame([(1, 1), (2, 2), (3, None)], "subject bigint, entity_id bigint"))
    assert {(r.subject, r.key): r.value for r in own.collect() if r.key == "保证人法定代表人"} == {(1, "保证人法定代表人"): "s"} and {r.key: r.value for r in rest.collect()}["c"] == "z"


def test_joint_histograms_and_matrix(spark):
    from tallyloom.operators import pivot

    df = spark.createDataFrame([(0.0, 10.0), (10.0, None), (5.0, 20.0)], "a double, b double")
    assert rows(pivot.histograms(df, ["a", "b"], 2)) == [("a", 1, 2), ("a", 2, 1), ("b", 2, 2)]
    assert rows(pivot.histograms(df.limit(0), ["a", "b"])) == [] and profile.correlation_matrix(df, ["a", "b"]).filter("a = b and r = 1").count() == 2


def test_codes(spark):
    good = next(("9135010" + "0M000100Y4" + c for c in facts.USCC_ALPHABET if spark.createDataFrame([("9135010" + "0M000100Y4" + c,)], "u string").select(facts.uscc_ok(F.col("u"))).first()[0]), None)
    assert good is not None
    assert [r[0] for r in spark.createDataFrame([(good[:-1] + ("0" if good[-1] != "0" else "1"),), ("x",), (None,)], "u string").select(facts.uscc_ok(F.col("u"))).collect()] == [False, None, None]


def test_merge_plan(spark):
    s = spark.createDataFrame([("账号", 1, "a"), ("电话", 1, ""), ("名", None, "n")], "key string, entity_id bigint, value string")
    i = spark.createDataFrame([("账号", 1, "b"), ("电话", 1, "5"), ("名", None, " "), ("新", 1, "v"), ("名", 2, None)], "key string, entity_id bigint, value string")
    got = {(r.key, r.entity_id): (r.kind, r.must_tick) for r in facts.merge_plan(s, i).collect()}
    assert got == {("账号", 1): ("conflict", True), ("电话", 1): ("fill_blank", False), ("名", None): ("incoming_blank", False), ("新", 1): ("new", False)}


# ---- audit


def test_audit_chain(spark):
    e = spark.createDataFrame([("b", i, "t", f"{{{i}}}", "2024", None, None, 7) for i in range(1, 5)] + [("c", 1, "t", None, "2024", "me", "r", None)], "batch_no string, seq bigint, event_type string, payload_json string, occurred_at string, actor_id string, run_id string, entity_id bigint")
    log = audit.appended(e)
    assert audit.verified(log).filter("not (link_ok and hash_ok and payload_ok)").count() == 0 and audit.appended(e.limit(0)).count() == 0
    bad = log.withColumn("event_type", F.when((F.col("seq") == 3) & (F.col("batch_no") == "b"), "x").otherwise(F.col("event_type")))
    assert rows(audit.verified(bad).filter("not hash_ok").select("batch_no", "seq")) == [("b", 3)]


def test_streamed_chain(spark, tmp_path):
    from tallyloom.streaming import live

    e = spark.createDataFrame([("b", i, "t", f"{{{i}}}", "2024", None, None, 7) for i in range(1, 6)], "batch_no string, seq bigint, event_type string, payload_json string, occurred_at string, actor_id string, run_id string, entity_id bigint")
    log = audit.appended(e).filter("seq != 4")
    log.coalesce(1).write.json(str(tmp_path / "log"))
    breaks = live.chain_breaks(spark.readStream.schema(log.schema).json(str(tmp_path / "log")))
    q = breaks.writeStream.format("memory").queryName("breaks").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.table("breaks")) == [("b", 5, "link")]
    ev = spark.createDataFrame([(datetime(2024, 1, 1, 0, 5), "a", 1.0), (datetime(2024, 1, 1, 0, 50), "a", 2.0)], "ts timestamp, event_type string, value double")
    assert [(r.events, r.total) for r in live.windowed(ev).collect()] == [(2, 3.0)]


# ---- decisions


def test_scores_equal_difflib(spark):
    labels, keys = ["联系电话：", "客户名称", "开户行", "", "完全无关"], ["联系电话", "电话", "借款人名称", "开户银行", "账号"]
    syn = spark.createDataFrame([("联系电话", "电话"), ("借款人名称", "客户名称"), ("借款人名称", "企业名称")], "name string, word string")
    got = {(r.label, r.key): r.score for r in decide.scored(spark.createDataFrame([(x,) for x in labels], "label string"), spark.createDataFrame([(x,) for x in keys], "key string"), syn).collect()}
    for x in labels:
        for k in keys:
            a, b = x.replace("：", ""), k
            s = 0.0 if not a else 1.0 if a == b else 0.9 if {a, b} in ({"联系电话", "电话"}, {"借款人名称", "客户名称"}) else 0.82 if a in b or b in a else round(SequenceMatcher(None, a, b).ratio() * 0.8, 3)
            assert got.get((x, k), 0.0) == (s if s >= decide.PROPOSE else 0.0), (x, k)
    assert decide.best_candidates(spark.createDataFrame([("l", "a", 0.9), ("l", "b", 0.9), ("l", "c", 0.5)], "label string, key string, score double")).filter("tied").count() == 2


def test_decisions_and_guards(spark):
    df = spark.createDataFrame([(1, True, "v", False, False, 1.0, "名"), (2, False, " ", False, False, 1.0, "名"), (3, False, "v", True, False, 1.0, "名"), (4, False, "v", False, True, 1.0, "名"), (5, False, "v", False, False, 0.8, "名"), (6, False, "v", False, False, 1.0, "账号"), (7, False, "v", False, False, 1.0, "名")], "n int, a boolean, v string, r boolean, t boolean, c double, f string")
    args = [F.col(c) for c in "avrtcf"]
    assert [r[0] for r in df.orderBy("n").select(decide.decision(*args)).collect()] == ["ask", "empty", "ask", "ask", "ask", "ask", "auto"]
    assert [r[0] for r in df.orderBy("n").select(decide.reason(*args)).collect()] == ["ambiguous", "blank", "role", "tied", "confidence", "收款账号", ""]
    plan = spark.createDataFrame([(1, "ask", True, ["5", "6"]), (2, "empty", False, []), (3, "auto", False, []), (4, "ask", False, [])], "n int, decision string, ambiguous boolean, candidates array<string>")
    chosen = spark.createDataFrame([(1, "use", "#5"), (2, "accept", None), (3, "use", "1"), (9, "accept", None)], "n int, action string, pick string")
    assert dict(decide.guarded(plan, chosen).select("n", "problem").collect()) == {1: None, 2: "nothing to accept", 3: "not ambiguous", 4: "not decided", 9: "unknown number"}
    roles = spark.createDataFrame([(2, "保证人")], "entity_id bigint, role string")
    p = spark.createDataFrame([(1, "k", 1, None), (2, "k", 9, None), (3, "保证人名", 2, "保证人"), (4, "保证人名", 9, "保证人"), (5, "k", None, None)], "n int, key string, entity_id bigint, claimed string")
    assert dict(decide.cross_subject(p, roles, 1, spark.createDataFrame([("k", 2)], "key string, live_rows bigint")).select("n", "verdict").collect()) == {1: "checked", 2: "violation", 3: "checked", 4: "unchecked", 5: "unchecked"}


# ---- extraction


def test_lines_and_ownership(spark):
    text = "借款合同\n借款人：甲公司\n联系电话：1380\n保证人（二）：乙公司\n地 址: 某路1号\n保证合同\n联系电话：1390\n无标签行\n备注：" + "长" * 90
    got = {r.line: (r.label, r.value, r.role, r.owner, r.issue) for r in extract.owned(extract.labelled(extract.lines(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id bigint, text string")))).filter("doc_id = 1").collect()}
    assert got[2][:4] == ("联系电话", "1380", "借款人", "甲公司") and got[4][:4] == ("地址", "某路1号", "保证人", "乙公司") and got[6][2:4] == (None, None) and got[7][0] is None and got[8][4] == "too long"
    assert spark.range(1).select(extract.text_counts(F.lit("中a b文c1"))).first()[0][:] == (2, 3, 7)


def test_overlaps_against_brute_force(spark):
    rnd = random.Random(6)
    mk = lambda n: [(i, rnd.choice("ab"), s, s + rnd.randint(1, 900)) for i, s in ((i, rnd.randint(0, 3000)) for i in range(n))]
    a, b = mk(30), mk(30)
    schema = "id bigint, part string, start bigint, end bigint"
    got = rows(extract.overlaps(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)))
    assert got == sorted([(p, i, j, s <= u and e >= v) for i, p, s, e in a for j, q, u, v in b if p == q and s < v and u < e], key=repr)


def test_ocr_columns(spark):
    df = spark.createDataFrame([(1, 0, 10), (1, 2, 11), (1, 40, 50), (1, 41, 52)], "page int, left int, right int")
    assert [r.column for r in extract.ocr_columns(df).orderBy("left").collect()] == [0, 0, 1, 1]


# ---- files, quality, readers


def test_files(spark):
    df = spark.createDataFrame([("a/x.PDF", "x.PDF", 10, "k", "d", datetime(2024, 1, 2)), ("a/b/y.pdf", "y.pdf", 10, "k", "d", datetime(2024, 1, 1)), ("z", "z", 0, "k", "e", datetime(2024, 1, 3))], "path string, name string, bytes bigint, quick string, digest string, modified timestamp")
    assert rows(files.by_category(df)) == sorted([("文档_Documents", 2, 20), ("其他_Other", 1, 0)], key=repr)
    assert rows(files.duplicates(df, "quick", "digest")) == [("d", 2, 10, 10)]
    assert rows(files.kept(df, "digest", "oldest").filter("keep").select("path")) == [("a/b/y.pdf",), ("z",)]
    assert [r[0] for r in df.orderBy("modified").select(files.bucket("extension")).collect()] == ["pdf", "pdf", "none"]
    assert [r[0] for r in spark.createDataFrame([(512,), (2048,), (3 * 1024**3,)], "b bigint").select(files.human_bytes(F.col("b"))).collect()] == ["512.0 B", "2.0 KB", "3.0 GB"]


def test_quality(spark):
    used = spark.createDataFrame([("20240101-01",), ("20240101-03",), ("x",)] + [(f"20240102-{i:02d}",) for i in range(1, 100)], "batch_no string")
    days = spark.createDataFrame([("20240101",), ("20240102",), ("20240103",)], "day string")
    assert rows(quality.next_batch(used, days)) == [("20240101", "20240101-02"), ("20240102", None), ("20240103", "20240103-01")]
    s = spark.createDataFrame([("20240101-02", "20240101", 1), ("first", "20240101", 2), ("second", "20240101", 3)], "session string, day string, ord int")
    assert dict(quality.batch_map(s).collect()) == {"20240101-02": "20240101-02", "first": "20240101-01", "second": "20240101-03"}
    best, rest = quality.best_rules(spark.createDataFrame([(1, "t", "f", 0.5), (2, "t", "f", 0.9), (3, "t", "f", None)], "rule_id int, template string, field string, confidence double"))
    assert rows(best.select("rule_id")) == [(2,)] and rest.count() == 2


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("名称;金额\n甲;1\n乙;2\n".encode("gb18030"))
    (tmp_path / "b.jsonl").write_text('{"名称": "丙", "金额": 3}\n', encoding="utf-8")
    (tmp_path / "skip.tmp").write_text("x")
    (tmp_path / "big5").mkdir()
    (tmp_path / "big5" / "c.csv").write_bytes('名稱,"a,b",n\n甲,1.5,\n\n"乙\n丙",2,7\n'.encode("big5"))
    import pyarrow as pa
    import pyarrow.feather

    pyarrow.feather.write_feather(pa.table({"k": [1, 2], "t": ["x", None]}), str(tmp_path / "big5" / "d.feather"))
    wide = readers.read_table(spark, str(tmp_path / "big5" / "c.csv"), encoding="big5")
    assert wide.dtypes == [("名稱", "string"), ("a,b", "double"), ("n", "bigint")] and rows(wide) == [("乙\n丙", 2.0, 7), ("甲", 1.5, None)]
    assert rows(readers.read_table(spark, str(tmp_path / "big5" / "d.feather"))) == [(1, "x"), (2, None)]
    assert spark.conf.get("spark.sql.legacy.javaCharsets", "false") == "false"
    assert rows(readers.read_table(spark, str(tmp_path / "a.csv"))) == sorted([("甲", 1), ("乙", 2)], key=repr)
    assert readers.read_all(spark, f"{tmp_path};{tmp_path}/*.csv").count() == 3
    assert readers.sniff_encoding("ä".encode()) == "utf-8" and readers.sniff_encoding(b"\xef\xbb\xbfa") == "utf-8-sig" and readers.sniff_delimiter("a|b|c") == "|"
    df = spark.createDataFrame([(1, "x|y")], "a int, b string")
    readers.write_table(df, str(tmp_path / "o.tsv"))
    readers.write_table(df, str(tmp_path / "o.md"))
    assert (tmp_path / "o.md").read_text(encoding="utf-8") == "| a | b |\n| --- | --- |\n| 1 | x\\|y |\n"
    done = readers.convert(spark, f"{tmp_path / 'a.csv'};{tmp_path / 'b.jsonl'}", str(tmp_path / "out"), "parquet")
    assert [os.path.basename(p) for p in done] == ["a.parquet", "b.parquet"] and rows(spark.read.parquet(done[0])) == rows(readers.read_table(spark, str(tmp_path / "a.csv")))
    with pytest.raises(ValueError):
        readers.read_table(spark, "x.pdf")


def test_office_sources(spark, tmp_path):
    s, r = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{s}" xmlns:r="{r}"><sheets><sheet name="一" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{s}"><si><t>名</t></si><si><r><t>甲</t></r><r><t>公司</t></r></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{s}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>额</t></is></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2"><v>5</v></c></row></sheetData></worksheet>')
    df = readers.read_table(spark, str(tmp_path / "b.xlsx"))
    assert df.columns == ["名", "额"] and rows(df) == [("甲公司", "5")]
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = lambda t, st="": f'<w:p>{st}<w:r><w:t>{t}</w:t></w:r></w:p>'
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{p("题", "<w:pPr><w:pStyle w:val=" + chr(34) + "Heading1" + chr(34) + "/></w:pPr>")}{p("文")}<w:tbl><w:tr><w:tc>{p("电话")}</w:tc><w:tc>{p("138")}</w:tc></w:tr></w:tbl></w:body></w:document>')
    from tallyloom.sources.office import Document

    spark.dataSource.register(Document)
    assert [(r.pos, r.kind, r.level, r.text) for r in spark.read.format("tallyloom_document").load(str(tmp_path / "d.docx")).orderBy("pos").collect()] == [(0, "heading", 1, "题"), (1, "paragraph", 0, "文"), (2, "row", 0, "电话：138")]


def test_small_ones(spark):
    scores = spark.createDataFrame([("l", "a", 0.9), ("m", "a", 0.9), ("m", "b", 0.9), ("n", "a", 0.82)], "label string, key string, score double")
    places = spark.createDataFrame([("l", "x"), ("l", "y"), ("m", "z")], "label string, target string")
    assert [(r.label, r.key, r.targets) for r in decide.proposed(scores, places).collect()] == [("l", "a", ["x", "y"])]
    plan = spark.createDataFrame([("t", "保证人表", "借款人名称"), ("u", "表", "借款人名称"), ("u", "表", "电话"), ("v", "表", "借款人名称"), ("v", "表", "保证人名称")], "template string, template_name string, key string")
    assert dict(decide.template_scope(plan).collect()) == {"t": "保证人", "u": "借款人", "v": None}
    lab = spark.createDataFrame([("t", "f", "x"), ("t", "g", "y")], "template string, field string, target string")
    assert rows(decide.uncovered(lab, lab.filter("field = 'f'")).select("field")) == [("g",)]
    assert rows(decide.coverage(spark.createDataFrame([("t", True, False, False), ("t", False, True, False), ("t", False, False, True)], "template string, mapped boolean, protected boolean, left_blank boolean"))) == [("t", 3, 1, 1, 1, 1)]
    v = spark.createDataFrame([("",), ("1234567890123456789",), ("x",), (None,)], "v string")
    assert [r[0] for r in v.select(facts.format_hint("bank_no", F.col("v"))).collect()] == ["empty", None, "not 19 digits", "empty"]
    assert [r[0] for r in spark.createDataFrame([("__ ",), (None,), ("a_",), ("　□",)], "t string").select(extract.blank_slot(F.col("t"))).collect()] == [True, True, False, True]
    assert [r[0] for r in spark.createDataFrame([("身份证号",), ("护照号",), ("电话",)], "t string").select(extract.certificate_type(F.col("t"))).collect()] == ["身份证", "护照", None]
    assert extract.page_numbers("1,3-4, 9-,2，3", 10) == [1, 3, 4, 9, 10, 2]
    roles = spark.createDataFrame([(1, "保证人"), (1, "保证人"), (2, "借款人")], "entity_id bigint, role string")
    assert rows(facts.with_role(roles, spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "entity_id bigint, note string"), "保证人")) == [(1, "x")]
