"""p2 and p4 to p7 on small tables with known results, and their edge cases."""

from __future__ import annotations

import random
import time
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyloom.functions.dates import day
from tallyloom.functions.instants import read_instants
from tallyloom.functions.quantities import read_quantities
from tallyloom.operators import as_known, history, instants, orphans, units


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# ---- p4


def parents(spark, keys):
    return spark.createDataFrame([("entity", k, datetime(2020, 1, 1)) for k in keys], orphans.PARENT)


def test_orphans_missing_deleted_late(spark):
    refs = orphans.references(spark.createDataFrame([(1, 10, datetime(2021, 1, 1), "x"), (2, 11, datetime(2019, 1, 1), "x"), (3, 12, None, "x"), (4, 13, None, "x"), (5, None, None, "x"), (3, 12, None, "x")], "id bigint, e bigint, at timestamp, target string"), "t", "id", "e", "entity", F.col("at"))
    purges = spark.createDataFrame([("entity", 12, datetime(2022, 1, 1)), ("entity", 10, datetime(2019, 1, 1))], "target string, key bigint, purged_at timestamp")
    lives = orphans.lifetimes(parents(spark, [10, 11]), purges)
    assert dict(orphans.classified(refs, lives).select("row_id", "status").collect()) == {1: "present", 2: "late", 3: "deleted", 4: "missing"}
    assert rows(orphans.orphans(refs, lives).select("row_id", "status")) == [(3, "deleted"), (4, "missing")]


def test_references_by_time(spark):
    at = lambda y: datetime(y, 1, 1)
    refs = orphans.references(spark.createDataFrame([(1, 12, at(2021)), (2, 12, at(2023)), (3, 10, at(2017)), (4, 10, at(2021)), (5, 10, None)], "id bigint, e bigint, at timestamp"), "t", "id", "e", "entity", F.col("at"))
    purges = spark.createDataFrame([("entity", 12, at(2022)), ("entity", 12, at(2020)), ("entity", 10, at(2018))], "target string, key bigint, purged_at timestamp")
    found = orphans.broken(orphans.classified(refs, orphans.lifetimes(parents(spark, [10]), purges)))
    assert rows(found.select("row_id", "status")) == [(1, "deleted"), (2, "deleted_before"), (3, "late")]


def test_orphans_empty_sides(spark):
    none = parents(spark, [])
    refs = orphans.references(spark.createDataFrame([(1, 10)], "id bigint, e bigint"), "t", "id", "e", "entity")
    assert rows(orphans.orphans(refs, orphans.lifetimes(none)).select("row_id")) == [(1,)]
    assert rows(orphans.orphans(refs.limit(0), orphans.lifetimes(parents(spark, [1])))) == []
    assert rows(orphans.per_period(orphans.orphans(refs, orphans.lifetimes(none)))) == [("t", "entity", None, "missing", 1)]


# ---- p6


def brute_as_known(cases, versions):
    out = set()
    for case, entity, at in cases:
        best = {}
        for rid, e, attr, start, until, known in versions:
            if e == entity and at is not None and (start is None or start <= at) and (until is None or until > at) and known.date() <= at:
                k = (start or date.min, known, rid)
                if attr not in best or k > best[attr]:
                    best[attr] = k
        out |= {(case, a, k[2]) for a, k in best.items()}
    return sorted(out)


@pytest.mark.parametrize("group_rows", [200_000, 7])
def test_as_known_against_brute_force(spark, group_rows):
    rnd, base = random.Random(4), date(2020, 1, 1)
    versions = [(i, rnd.choice([1, 1, 1, 2, 3]), rnd.choice("ab"), rnd.choice([None, base + timedelta(rnd.randint(0, 60))]), rnd.choice([None, base + timedelta(rnd.randint(10, 80))]), datetime(2020, 1, 1) + timedelta(days=rnd.randint(0, 60), hours=rnd.randint(0, 23))) for i in range(120)]
    cases = [(100 + i, rnd.choice([1, 1, 2, 9]), rnd.choice([None, base + timedelta(rnd.randint(0, 90))])) for i in range(60)]
    v = spark.createDataFrame(versions + versions[:9], "row_id bigint, entity_id bigint, attr string, start date, until date, known timestamp").withColumn("part", F.lit("clash"))
    c = spark.createDataFrame(cases + cases[:5], "event_id bigint, entity_id bigint, at date").withColumn("kind", F.lit(5))
    got = as_known.as_known(c, v, group_rows)
    assert rows(got) == brute_as_known(cases, versions)


def test_as_known_empty_and_null(spark):
    v = spark.createDataFrame([(1, None, "a", None, None, datetime(2020, 1, 1)), (2, 1, None, None, None, datetime(2020, 1, 1)), (3, 1, "a", None, None, None)], "row_id bigint, entity_id bigint, attr string, start date, until date, known timestamp")
    c = spark.createDataFrame([(1, 1, date(2021, 1, 1)), (2, None, date(2021, 1, 1)), (None, 1, date(2021, 1, 1))], "event_id bigint, entity_id bigint, at date")
    assert rows(as_known.as_known(c, v)) == [] and rows(as_known.as_known(c.limit(0), v.limit(0))) == []


# ---- p7


def log(spark, data):
    df = spark.createDataFrame(data, "entity_id bigint, attr string, value string, f string, t string, known string, id bigint, start string")
    return history.change_log(df, "entity_id", F.col("attr"), "value", "f", "t", "known", "id")


def test_versions_coalesce_and_end(spark):
    data = [
        (1, "a", "甲Ａ", "2020-01-01", None, "k1", 1, ""), (1, "a", " 甲A ", "2020年2月1日", "2020-03-01", "k1", 2, ""), (1, "a", "乙", "20200401", "2019-01-01", "k1", 3, ""), (1, "a", "甲A", "2020/5/1", "2021.6.1", "k1", 4, ""),
        (1, "a", "丙", "2020-04-01", None, "k0", 9, ""), (1, "a", None, "2020-04-02", None, "k1", 5, ""), (1, "a", "　", "2020-04-03", None, "k1", 6, ""), (1, "a", "丁", None, None, "k1", 7, ""), (1, "a", "丁", "2020-02-31", None, "k1", 8, ""), (None, "a", "x", "2020-01-01", None, "k", 10, ""),
    ]
    got = rows(history.versions(log(spark, data + data[:2])).select("form", "valid_from", "valid_to", "versions"))
    assert got == sorted([("甲A", date(2020, 1, 1), date(2020, 3, 1), 3), ("乙", date(2020, 4, 1), date(2020, 5, 1), 3), ("甲A", date(2020, 5, 1), date(2021, 6, 1), 3)])
    assert rows(history.versions(log(spark, []).limit(0))) == []


def test_combined_splits_and_joins(spark):
    data = [(1, "a", "x", "2020-01-01", None, "k", 1, ""), (1, "b", "y", "2020-02-01", "2020-03-01", "k", 2, ""), (1, "b", "y", "2020-03-01", "2020-04-01", "k", 3, "")]
    got = [(r.valid_from, r.valid_to, dict(x.split("=") for x in r.state.split("\n"))) for r in history.combined(history.versions(log(spark, data))).orderBy("valid_from").collect()]
    assert got == [(date(2020, 1, 1), date(2020, 2, 1), {"a": "x"}), (date(2020, 2, 1), date(2020, 4, 1), {"a": "x", "b": "y"}), (date(2020, 4, 1), None, {"a": "x"})]


def test_day_notations(spark):
    texts = ["2024-3-1", "2024/03/01", "2024.3.1", "2024年3月1日", "20240301", "２０２４－０３－０１", " 2024 年3月1日", "2024-02-30", "2024", "", None, "3/1/2024", "x" * 100_000]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(day(F.col("t"))).collect()]
    assert got == [date(2024, 3, 1)] * 7 + [None] * 6


# ---- p5

CASES = [
    ("money", "1,219.5万元", None, 1219500000), ("money", "0.137亿", None, 1370000000), ("money", "人民币8527.92万元", None, 8527920000), ("money", "10340000", "CNY", 1034000000), ("money", "¥ 1 951 580.5", None, 195158050), ("money", "RMB 844000", None, 84400000),
    ("money", "约333万元人民币", "亿元", 333000000), ("money", "３０００千元", "亿元", 300000000), ("money", "九十一 万元整", None, 91000000), ("money", "贰佰零捌万元整", None, 208000000), ("money", "2.9亿元", None, 29000000000), ("money", "1亿2000万元", None, 12000000000), ("money", "8.9949e3 千元", None, 899490000),
    ("money", "3.5", "百万元", 350000000), ("money", "0.005元", None, 1), ("money", "0.004元", None, 0), ("money", "15-31万元", None, None), ("money", "待核实", "元", None), ("money", "413", None, None), ("money", "", "元", None), ("money", None, "元", None), ("money", "3年", None, None), ("money", "USD 100", None, None),
    ("area", "77 亩", None, 5133333), ("area", "48 万平方米", None, 48000000), ("area", "2", "公顷", 2000000), ("area", "0.05km²", None, 5000000), ("area", "21586.2㎡", "亩", 2158620), ("area", "16 612", "m2", 1661200), ("area", "1.5hm²", None, 1500000), ("area", "约三百九十八亩", None, 26533333),
    ("mass", "985.91t", None, 985910), ("mass", "8.741", "万吨", 87410000), ("mass", "673098千克", None, 673098), ("mass", "7.1千吨", "万吨", 7100000), ("mass", "291000市斤", None, 145500), ("mass", "3", "斤", 2), ("mass", "2.5kt", None, 2500000), ("mass", "三万吨", None, 30000000), ("mass", "五千克", None, 5),
    ("energy", "46MWh", None, 46000), ("energy", "2.5 万千瓦时", None, 25000), ("energy", "82", "万千瓦时", 820000), ("energy", "1,993,000KWH", None, 1993000), ("energy", "6.82e5 度", None, 682000),
    ("months", "４４", "年", 528), ("months", "49周年", None, 588), ("months", "38个季度", None, 114), ("months", "27months", "年", 27), ("months", "四十二年", None, 504), ("months", "一十年", None, 120), ("months", "118", "个月", 118),
]


def test_quantities(spark):
    df = spark.createDataFrame([(i, k, v, u) for i, (k, v, u, _) in enumerate(CASES)], "i int, kind string, value string, unit string")
    got = {r.i: r.common for r in read_quantities(df).collect()}
    assert [(CASES[i][:3], got[i]) for i in got if got[i] != CASES[i][3]] == []
    assert read_quantities(spark.createDataFrame([(1, "money", "9" * 200_000 + "元", None)], "i int, kind string, value string, unit string")).first().common is None


def brute_segments(xs, sigma, penalty):
    n = len(xs)
    cost = lambda a, b: sum((x - sum(xs[a:b]) / (b - a)) ** 2 for x in xs[a:b]) / (2 * sigma * sigma)
    best = [0.0] + [None] * n
    for t in range(1, n + 1):
        best[t] = min(best[a] + cost(a, t) + penalty for a in range(t))
    return best[n] if n else 0.0


def test_segments_are_exact():
    rnd = random.Random(1)
    for _ in range(60):
        xs = [rnd.gauss(rnd.choice([0, 3, 4]), 0.1) for _ in range(rnd.randint(1, 14))]
        cuts = units.segments(xs) + [len(xs)]
        cost = sum(sum((x - sum(xs[a:b]) / (b - a)) ** 2 for x in xs[a:b]) / (2 * units.SIGMA**2) + units.PENALTY for a, b in zip(cuts, cuts[1:], strict=False))
        assert cuts[0] == 0 and abs(cost - brute_segments(xs, units.SIGMA, units.PENALTY)) < 1e-6


@pytest.mark.parametrize("limit", [100_000, 3])
def test_units_are_inferred_from_level_shifts(spark, limit):
    data = [(1, 7, "f", "money", "500万元", None, date(2020, 1, 1)), (2, 7, "f", "money", "505", None, date(2020, 2, 1)), (3, 7, "f", "money", "5100000", None, date(2020, 3, 1)), (4, 7, "f", "money", "5.2e6", "元", date(2020, 4, 1)), (5, None, "f", "money", "5", None, None), (6, 7, "f", "money", "0", "元", None), (6, 7, "f", "money", "0", "元", None)]
    df = spark.createDataFrame(data, "row_id bigint, entity_id bigint, field string, kind string, value string, unit string, at date").withColumn("order", F.lit(1)).withColumn("source_id", F.lit(None).cast("bigint"))
    got = {r.row_id: (r.common, r.origin) for r in units.to_common_units(df, limit).collect()}
    assert got[1] == (500000000, "stated") and got[4] == (520000000, "stated") and got[5] == (None, "none") and got[6] == (0, "stated") and len(got) == 6
    if limit > 3:
        assert got[2] == (505000000, "inferred") and got[3] == (510000000, "inferred")
    assert units.to_common_units(df.limit(0)).count() == 0


def test_a_source_that_changes_its_unit(spark):
    # 40 entities state their capital elsewhere; source 9 writes bare numbers, first in 元, then in 万元
    stated = [(i, None, i, "f", "money", f"{100 + i}万元", None, date(2020, 1, 1)) for i in range(40)]
    bare = [(100 + i, 9, i, "f", "money", str((100 + i) * (10_000 if i < 20 else 1)), None, date(2020, 2, 1 + i % 20 if i < 20 else 1)) if i < 20 else (100 + i, 9, i, "f", "money", str(100 + i), None, date(2020, 3, i - 19)) for i in range(40)]
    df = spark.createDataFrame(stated + bare, "row_id bigint, source_id bigint, entity_id bigint, field string, kind string, value string, unit string, at date")
    got = {r.row_id: (r.common, r.origin, r.segment) for r in units.to_common_units(df).collect()}
    assert all(got[100 + i] == ((100 + i) * 1_000_000, "inferred", int(i >= 20)) for i in range(40))


@pytest.mark.parametrize("limit", [1, 3, 30])
def test_units_do_not_depend_on_the_size_of_a_history(spark, limit):
    # source 9 tells its unit in one row and then writes bare numbers for days; the entities state nothing
    told = [(i, None, i, "f", "money", f"{100 + i}万元", None, date(2020, 1, 1)) for i in range(8)]
    bare = [(100 + i, 9, i % 8, "f", "money", str((100 + i % 8) * (10_000 if 16 <= i < 40 else 1)), "万元" if i == 0 else None, date(2020, 2, 1) + timedelta(i)) for i in range(64)]
    df = spark.createDataFrame(told + bare, "row_id bigint, source_id bigint, entity_id bigint, field string, kind string, value string, unit string, at date")
    whole = rows(units.to_common_units(df))
    assert rows(units.to_common_units(df, limit)) == whole
    assert {r[3] for r in whole if r[0] >= 100} == {0, 1, 2} and all(r[1] == (100 + (r[0] - 100) % 8) * 1_000_000 for r in whole if r[0] >= 100)


def test_segments_of_long_histories_take_little_time():
    began = time.time()
    assert units.segments([7.0] * 100_000) == [0]
    rnd = random.Random(3)
    steps = [rnd.gauss(4 * (i // 25_000 % 2), 0.1) for i in range(100_000)]
    assert len(units.segments(steps)) >= 4 and time.time() - began < 20


# ---- p2

TIMES = [
    ("2021-04-21T00:53:30+02:00", "u", "2021-04-20T22:53:30"), ("2021-08-22 03:23:44 +0000", "u", "2021-08-22T03:23:44"), ("2023-10-26 05:17:38 -0800", "u", "2023-10-26T13:17:38"), ("1642237749029", "u", "2022-01-15T09:09:09.029"), ("1610176604", "u", "2021-01-09T07:16:44"), ("1619255602910047", "u", "2021-04-24T09:13:22.910047"),
    ("北京时间2021-07-09 01:15", "u", "2021-07-08T17:15:00"), ("Wed, 01 Feb 2023 03:00:06 +0800", "u", "2023-01-31T19:00:06"), ("2025-10-26 02:42:32 CEST", "u", "2025-10-26T00:42:32"), ("2025-10-26 02:42:32 CET", "u", "2025-10-26T01:42:32"), ("2021-03-10 07:01:41 GMT", "u", "2021-03-10T07:01:41"), ("2022-01-22 04:55:17 SGT", "u", "2022-01-21T20:55:17"),
    ("2022-05-29 24:00:00", "l", "2022-05-30T00:00:00"), ("2023-12-14 02:27:30.142643", "l", "2023-12-14T02:27:30.142643"), ("20231026020802", "l", "2023-10-26T02:08:02"), ("2023-08-02T16:02", "l", "2023-08-02T16:02:00"), ("2022年7月23日 0时37分29秒", "l", "2022-07-23T00:37:29"), ("2021/8/22 5:02", "l", "2021-08-22T05:02:00"),
    ("2021.08.22 09:03:19", "l", "2021-08-22T09:03:19"), ("２０２３－０２－０１　００：２２：２２", "l", "2023-02-01T00:22:22"), ("2022年03月24日下午3:06", "l", "2022-03-24T15:06:00"), ("2021年06月28日上午12:16", "l", "2021-06-28T00:16:00"), ("2021年06月28日下午12:16", "l", "2021-06-28T12:16:00"), ("44385.763646", "l", "2021-07-08T18:19:39"),
    ("26/10/2023 19:19:32", "l", "2023-10-26T19:19:32"), ("04.12.2022 02:16:54", "l", "2022-12-04T02:16:54"), ("11-Jul-2021 22:22:00", "l", "2021-07-11T22:22:00"), ("Sun 7 Mar 2021, 3.01am", "l", "2021-03-07T03:01:00"), ("Sun 7 Mar 2021, 12.01pm", "l", "2021-03-07T12:01:00"), ("2021-08-22 05:41:09 CST", "l", "2021-08-22T05:41:09"), ("\t2021/1/17 18:22　", "l", "2021-01-17T18:22:00"),
    ("2021年06月28日中午11:30", "l", "2021-06-28T11:30:00"), ("2021年06月28日中午12:30", "l", "2021-06-28T12:30:00"), ("2021年06月28日中午1:30", "l", "2021-06-28T13:30:00"), ("2021年06月28日晚上8:30", "l", "2021-06-28T20:30:00"), ("2021年06月28日晚上12:30", "l", "2021-06-29T00:30:00"),
    ("2021年06月28日凌晨12:30", "l", "2021-06-28T00:30:00"), ("2021年06月28日晚上21:05", "l", "2021-06-28T21:05:00"), ("2021年06月28日下午25:05", "", None),
    ("2021-04-21T13:50:45.149Z", "d", None), (" 2023-12-14T07:11:14Z", "d", None), ("0000-00-00 00:00:00", "", None), ("N/A", "", None), ("昨日下午", "", None), ("", "", None), (None, "", None), ("2021-02-30 10:00:00", "", None), ("2021-01-01 25:00:00", "", None), ("2021-01-01 10:00:00 XYZ", "", None), ("x" * 200_000, "", None), ("20211301000000", "", None),
]


def test_instants_are_read(spark):
    df = spark.createDataFrame([(i, t, "DMY") for i, (t, _, _) in enumerate(TIMES)], "i int, t string, o string")
    for r in read_instants(df, "t", "o").collect():
        text, kind, expected = TIMES[r.i]
        us = None if expected is None else round((datetime.fromisoformat(expected) - datetime(1970, 1, 1)).total_seconds() * 1_000_000)
        assert (r.done, r.utc_us, r.local_us) == (kind == "d", us if kind == "u" else None, us if kind == "l" else None), text
    mdy = read_instants(spark.createDataFrame([("11/04/2021 5:11 PM", "MDY"), ("11/04/2021 5:11 PM", "YMD"), ("11/04/2021 5:11 PM", None)], "t string, o string"), "t", "o").collect()
    assert [r.local_us for r in mdy] == [1636045860000000, None, None]


def test_zones_first_occurrence_and_estimate(spark):
    sites = spark.createDataFrame([("05", "Europe/Berlin", "DMY"), ("05", "Europe/Berlin", "DMY"), ("06", "America/New_York", "MDY")], "site string, zone string, day_order string")
    recs = [("fact", "1", 1, "05", 1, "2025-10-26 02:30:00"), ("fact", "1", 1, "05", 1, "2025-10-26 02:30:00"), ("fact", "2", None, None, 1, "2025-10-26 02:30:00"), ("fact", "3", 2, "06", 1, "2021-11-07 01:30:00 CST"), ("fact", "4", 2, "06", 1, None)]
    # a site that isn't listed works on New York's clock
    for i in range(30):
        recs += [("src", f"s{i}", 100 + i, "77", 0, f"2021-06-{1 + i % 28:02d}T12:00:00Z".replace("Z", "+00:00")), ("fact", f"f{i}", 100 + i, "77", 1, f"2021-06-{1 + i % 28:02d} 08:20:00"), ("src", f"t{i}", 200 + i, "77", 0, f"2021-06-{1 + i % 28:02d} 08:20:00"), ("fact", f"g{i}", 200 + i, "77", 1, f"2021-06-{1 + i % 28:02d}T12:40:00+00:00")]
    df = spark.createDataFrame(recs, "table_name string, row_key string, group bigint, site string, rank int, text string").withColumn("zone", F.lit("clash"))
    got = {(r.table_name, r.row_key): (r.utc_us, r.basis) for r in instants.normalised(df, sites).collect()}
    assert got["fact", "1"] == (1761438600000000, "registered") and got["fact", "2"] == (None, None) and got["fact", "3"] == (1636263000000000, "registered") and got["fact", "4"] == (None, None)
    assert got["fact", "f0"] == (1622550000000000, "estimated")
    assert instants.normalised(df.limit(0), sites).count() == 0 and instants.normalised(df, sites.limit(0)).filter("basis = 'text'").count() == 60
