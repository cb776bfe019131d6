from __future__ import annotations

import random

from tallyloom.operators import layout


def test_ocr_rows(spark):
    df = spark.createDataFrame([(1, 1, 0, 10, 0), (1, 2, 2, 12, 50), (1, 3, 30, 40, 0), (1, 4, 31, 41, 9), (2, 5, 0, 10, 0)], "page int, box_id int, top int, bottom int, left int")
    assert {r.box_id: r.row for r in layout.ocr_rows(df).collect()} == {1: 0, 2: 0, 3: 1, 4: 1, 5: 0}
    assert layout.ocr_rows(df.limit(0)).count() == 0


def test_slots_against_brute_force(spark):
    rnd = random.Random(2)
    slots = [("ab"[i % 2], i, s, s + rnd.randint(1, 20)) for i, s in ((i, rnd.randint(0, 200)) for i in range(60))]
    want = []
    for p in "ab":
        last = -1
        for s in sorted((s for s in slots if s[0] == p), key=lambda s: (s[2], -s[3], s[1])):
            if s[2] >= last:
                want.append(s[1])
                last = s[3]
    got = layout.without_overlaps(spark.createDataFrame(slots, "part string, id int, start int, end int"))
    assert sorted(r.id for r in got.collect()) == sorted(want)


def test_markdown(spark):
    text = "# T #\ntext\nmore\n\n- a\n2. b\n> q\n| x |\n|---|\n---\n```\n# c\n```"
    want = [("heading", 1, "T"), ("paragraph", 0, "text\nmore"), ("list", 0, "a\nb"), ("quote", 0, "q"), ("table", 0, "| x |\n|---|"), ("rule", 0, ""), ("code", 0, "# c")]
    got = layout.markdown(spark.createDataFrame([(1, text), (2, None), (3, "")], "k int, t string"), "k", "t").orderBy("pos").collect()
    assert [(r.kind, r.level, r.text) for r in got] == want


def test_similar_names(spark):
    a, b = spark.createDataFrame([("借款合同模板.docx",)], "name string"), spark.createDataFrame([("借款合同模板2.docx",), ("发票.pdf",)], "name string")
    assert [(r.known, r.rank) for r in layout.similar_names(a, b).collect()] == [("借款合同模板2.docx", 1)]
    # no pair of characters in common
    c, d = spark.createDataFrame([("abc",), ("x",), ("",)], "name string"), spark.createDataFrame([("axbxc",), ("x",), (None,)], "name string")
    assert sorted((r.wanted, r.known) for r in layout.similar_names(c, d).collect()) == [("abc", "axbxc"), ("x", "x")]
