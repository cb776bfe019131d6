"""p1, p3 and p8 to p10: against brute force, other libraries and exact round trips, and their edge cases."""

from __future__ import annotations

import heapq
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import entities, leakage, mojibake, names, tokens, variants


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# ---- p8

ODD = ["", None, " ", "a", "it's don't we'll", "中文，标点。", "<|endoftext|> x", "\x1c\x1f\x85　  \n\n  x", "é́", "a" * 700, "中" * 500, " " * 300, "x\n", "1234 5678", "😀😀"]


def single_byte(b):
    return tokens.vocabulary("byte_bpe_50k")[0][b]


def test_tokens_equal_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(tokens.TOKENIZERS, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    rnd = random.Random(2)
    texts = ODD + ODD[:3] + ["".join(chr(rnd.choice([*range(32, 126), 0x4E2D, 0x3001, 0x301, 0x1F600, 0x600, 0xA0, 10])) for _ in range(rnd.randint(1, 60))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    got = {r.doc_id: r.ids for r in tokens.encoded(df, "doc_id", "text").collect()}
    assert len(got) == len(texts)
    for i, x in enumerate(texts):
        assert got[i] == (t.encode(x, add_special_tokens=False).ids if x else []), repr(x)
    assert tokens.encoded(df.limit(0), "doc_id", "text").count() == 0
    back = {r.doc_id: r.text for r in tokens.decoded(tokens.encoded(df, "doc_id", "text"), "doc_id", "ids").collect()}
    assert back == {i: x or "" for i, x in enumerate(texts)}
    odd = spark.createDataFrame([(1, None), (2, []), (3, [10**6]), (4, [single_byte(255)])], "k bigint, ids array<int>")
    assert rows(tokens.decoded(odd, "k", "ids")) == [(1, ""), (2, ""), (3, ""), (4, "\ufffd")]


def merge_by_heap(ids: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """The merges by another way: the leftmost pair of the lowest rank first, with a heap."""
    n = len(ids)
    nxt, prv, gone = [*range(1, n), -1], [*range(-1, n - 1)], [False] * n
    heap = [(ranks[p][0], i, *p) for i in range(n - 1) if (p := (ids[i], ids[i + 1])) in ranks]
    heapq.heapify(heap)
    ids = list(ids)
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = nxt[i] if not gone[i] else -1
        if j < 0 or ids[i] != left or ids[j] != right:
            continue
        ids[i], gone[j], nxt[i] = ranks[left, right][1], True, nxt[j]
        if nxt[j] >= 0:
            prv[nxt[j]] = i
        for a in (prv[i], i):
            if a >= 0 and nxt[a] >= 0 and (p := (ids[a], ids[nxt[a]])) in ranks:
                heapq.heappush(heap, (ranks[p][0], a, *p))
    return [x for x, g in zip(ids, gone, strict=True) if not g]


def test_recursion_equals_a_heap(monkeypatch):
    single, merges = tokens.vocabulary("byte_bpe_50k")
    ranks = {(a, b): (r, m) for a, b, r, m in merges}
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdetionsr中文") for _ in range(rnd.randint(1, 40))) for _ in range(200)] + ["aaaaaaa", "ababab", "a" * 100_001, "中文a" * 3_000]
    for long in (0, tokens.LONG_WORD):
        monkeypatch.setattr(tokens, "LONG_WORD", long)
        e = tokens.Encoder(single, merges)
        e._learn(words)
        for w in words:
            assert e.ids_of(w) == merge_by_heap([single[b] for b in w.encode()], ranks)


# ---- p9


def brute_leaks(docs, items):
    """Every passage of every length from half an item on, with at most one in ten changed."""
    table = leakage.letter_table()
    flat = lambda t: leakage.letters([t], table)[0].tolist()
    out = set()
    for d, text in docs:
        for i, item in items:
            x, t = flat(item or ""), flat(text or "")
            if any(edits(x[a : a + w], t) <= w // 10 for w in range(max(1, -(-len(x) // 2)), len(x) + 1) for a in range(len(x) - w + 1)):
                out.add((d, i))
    return sorted(out)


def edits(p, t):
    """Least edit distance of p to any stretch of t."""
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, d in enumerate(t, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_leaks_against_brute_force(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefghij甲乙丙丁戊己") for _ in range(rnd.randint(3, 8)))
    items = [(i, " ".join(word() for _ in range(rnd.randint(6, 14)))) for i in range(6)] + [(90, "Abc"), (91, ""), (92, None)]
    docs = []
    for d in range(30):
        text = " ".join(word() for _ in range(rnd.randint(0, 12)))
        if d % 2:
            src = rnd.choice(items[:6])[1]
            a = rnd.randint(0, len(src) // 3)
            piece = list(src[a : a + int(len(src) * rnd.uniform(0.3, 0.8))])
            for _ in range(rnd.randint(0, 5)):
                k = rnd.randrange(len(piece))
                piece[k] = rnd.choice(["z", "", "zz", piece[k].upper() + "、"])
            text += "".join(piece) + word()
        docs.append((d, text))
    docs += [(80, None), (81, ""), (82, "ＡＢ c!" + "。" * 3), (83, docs[1][1]), (84, "x" * 200_000)]
    dd = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit("clash"))
    ii = spark.createDataFrame(items + items[:2], "item_id bigint, text string")
    expected = brute_leaks(docs[:-1], items)
    assert rows(leakage.leaks(dd, ii)) == expected and len(expected) > 5
    assert rows(leakage.leaks(dd, ii, block_letters=60)) == expected
    assert rows(leakage.leaks(dd.limit(0), ii)) == [] and rows(leakage.leaks(dd, ii.limit(0))) == []


def test_short_items_against_brute_force():
    rnd = random.Random(12)
    items = [(i, "".join(rnd.choice("abcd甲乙丙") for _ in range(n))) for i, n in enumerate([*range(1, 13), *range(12, 41, 2)])]
    docs = []
    for d in range(120):
        x = rnd.choice(items)[1]
        n = rnd.randint(-(-len(x) // 2), len(x))
        a = rnd.randint(0, len(x) - n)
        piece = list(x[a : a + n])
        for _ in range(rnd.randint(0, 1 + n // 10)):
            k = rnd.randrange(len(piece))
            piece[k] = rnd.choice(["z", "", "z" + piece[k]])
        docs.append((d, "".join(rnd.choice("wxy") for _ in range(rnd.randint(0, 9))) + "".join(piece) + "，vw"))
    block = leakage.Items([i for i, _ in items], [x for _, x in items], leakage.letter_table())
    block.narrow(block.frequency([t for _, t in docs]))
    got = sorted({(docs[t][0], items[i][0]) for t, i in block.found([t for _, t in docs])})
    assert got == brute_leaks(docs, items) and len(got) > 200


def test_longer_passages_may_have_more_changes():
    item = "".join(random.Random(6).choices("abcdefghijklmnopqrstuvwxyz", k=153))
    at = [14, 24, 34, 44, 54, 60, 66, 72, 76]
    text = "".join("Z9"[i % 2] if i in at else c for i, c in enumerate(item[:90]))
    table = leakage.letter_table()
    letters = lambda t: leakage.letters([t], table)[0].tolist()
    assert all(edits(letters(item[a : a + 77]), letters(text)) > 7 for a in range(77))
    more = text[:40] + "ZZ" + text[40:]
    items = leakage.Items([1, 2], [item, "abcdefghijklmnopqrst"], table)
    items.narrow(items.frequency([text, more]))
    assert items.found([text, more, "abcdZfghij", "abcdZfgZij"]) == [(0, 0), (2, 1)]


# ---- p10

CLEAN = {
    "zh": "经查，股东会决议与营业执照所载地址不一致，降额处理。该户余额{}万元，未见逾期，账期8833天，可予通过。", "de": "Größere Änderungen am Formular {} sind unzulässig. Zusätzliche Gebühren in Höhe von EUR {} sind fällig.",
    "ru": "Решение отложено до получения отчёта {}. Поручитель подтвердил адрес в городе.", "fr": "Le gérant, Monsieur {}, a signé après vérification. Ça n'a pas été approuvé.", "en": "The guarantee letter {} and the cash-flow sheet give different addresses. Café — “checked”.",
}


def sloppy(text, codec):
    return "".join(bytes([b]).decode(codec, "ignore") or chr(b) for b in text.encode("utf-8"))


def test_garbled_round_trips(spark):
    clean = [(i, t.replace("{}", str(1000 + 7 * i)), lang) for i, (lang, t) in enumerate(x for _ in range(40) for x in CLEAN.items())]
    wrong = {}
    for k, (lang, t) in enumerate(CLEAN.items()):
        t = t.replace("{}", "4711")
        wrong[1000 + 10 * k] = (t, sloppy(t, "cp1252"))
        wrong[1001 + 10 * k] = (t, sloppy(sloppy(t, "cp1252"), "cp1252"))
        wrong[1002 + 10 * k] = (t, t.encode().decode("latin-1"))
        if lang != "ru":
            wrong[1003 + 10 * k] = (t, t.encode().decode("cp437"))
    zh = CLEAN["zh"].replace("{}", "4711")
    wrong[1100] = (zh, zh.encode("gb18030").decode("latin-1"))
    wrong[1101] = (zh, zh.replace("账期", "账期".encode().decode("gbk")))
    wrong[1102] = (zh, zh.encode().decode("koi8-r"))
    lost = {1200: zh.encode("gb18030").decode("utf-8", "replace"), 1201: "锟斤拷锟斤拷4711"}
    docs = clean + [(i, g, "zh") for i, (_, g) in wrong.items()] + [(i, g, "zh") for i, g in lost.items()] + [(1300, None, None), (1301, "", "zh"), (1302, "✅ ①②③ ├─ SÃO BENTO Nº", "pt")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string").withColumn("chain", F.lit("clash"))
    got = {r.doc_id: r for r in mojibake.garbled(df).collect()}
    assert {i for i in got if i < 1000 or i >= 1300} == set()
    assert {i for i, (t, g) in wrong.items() if g != t and (i not in got or got[i].restored != t or got[i].lost)} == set()
    assert all(got[i].lost for i in lost)
    assert mojibake.garbled(df.limit(0)).count() == 0


@pytest.mark.parametrize("text", [CLEAN["de"], CLEAN["ru"], CLEAN["fr"], "ひらがなとカタカナのテキスト、そして数字４７１１。"])
def test_letters_read_as_gbk_are_tried(text):
    wrong = text.encode().decode("gb18030", "replace")
    if mojibake.LOST not in wrong:
        assert ("utf-8 as gb18030", text) in mojibake.steps(wrong)
    assert "utf-8 as gb18030" not in dict(mojibake.steps(CLEAN["zh"] + "A座B"))


def test_longer_restoration_is_tried():
    # read as Han characters the bytes of this sentence make a shorter text than the right one
    right = "Решение отложено до получения отчёта. Поручитель подтвердил адрес в городе и срок действия договора поручения."
    wrong = right.encode("cp1251").decode("cp1252")
    tried = []

    def cost(t):
        tried.append(t)
        return 10 if t == right else 100

    best, chain = mojibake.restore(wrong, cost)
    assert best == right and chain == ["cp1251 as cp1252"]
    assert any(len(t.encode()) * 1.15 < len(right.encode()) for t in tried)



def language_cost():
    rnd = random.Random(10)
    return mojibake.Cost({lang: [CLEAN[lang].replace("{}", str(rnd.randint(1000, 9999))).encode() for _ in range(60)] for lang in CLEAN})


def test_no_description_is_below_its_bound():
    cost, rnd = language_cost(), random.Random(11)
    zh = CLEAN["zh"] * 3
    texts = [zh, sloppy(zh, "cp1252"), sloppy(sloppy(zh, "cp1252"), "cp1252"), zh.encode("gb18030").decode("latin-1"), "a", "abc", "aaaa" * 500, "é" * 40, *CLEAN.values()]
    texts += ["".join(rnd.choices([chr(rnd.randrange(0x80, n)) for _ in range(k)], k=rnd.randrange(1, 900))) for n in (0x100, 0x800, 0xD800) for k in (3, 30, 300) for _ in range(4)]
    texts += [t[: rnd.randrange(len(t)) + 1] + rnd.choice(texts) for t in texts[:20]]
    bounds = cost.at_least(texts)
    assert [t for t, x in zip(texts, bounds, strict=True) if x > cost(t)] == []
    assert bounds[1] > cost(zh) and cost.all(texts) == [cost(t) for t in texts]
    assert cost.at_least([texts[1] * 400]) == [0.0]


def test_not_every_text_need_be_compressed():
    class Counted(mojibake.Cost):
        def __call__(self, text):
            seen.add(text)
            return super().__call__(text)

        def all(self, texts):
            seen.update(texts)
            return super().all(texts)

    made = language_cost()
    cost = Counted({})
    cost.raw = made.raw
    zh = (CLEAN["zh"] + "担保物厂房位于霁阳市石榴弄604号，权属清晰。").replace("{}", "4711")
    for wrong in (zh.encode().decode("cp437"), zh.encode("gb18030").decode("latin-1"), sloppy(sloppy(zh, "cp1252"), "cp1252")):
        seen = set()
        best = mojibake.restore(wrong, cost)
        few, seen = len(seen), set()
        assert best == mojibake.restore(wrong, lambda t: seen.add(t) or made(t)) and best[0] == zh
        assert few <= len(seen) / (1 if wrong[0] == "Ã" else 2)


@pytest.mark.parametrize("codec", mojibake.SINGLE)
def test_sequences_are_those_of_their_pattern(codec):
    of, rnd = {b: c for c, b in mojibake.HALF[codec].items()}, random.Random(12)
    pattern = re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xef][\x80-\xbf]{2}|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf4][\x80-\xbf]{3})+")
    edges = [0x41, 0x80, 0x8F, 0x90, 0x9F, 0xA0, 0xBF, 0xC1, 0xC2, 0xDF, 0xE0, 0xE1, 0xED, 0xEF, 0xF0, 0xF1, 0xF4, 0xF5]
    for _ in range(60):
        raws = [bytes(b for b in rnd.choices(edges, k=rnd.randrange(1, 30)) if b in of or b < 0x80) for _ in range(8)]
        texts = ["".join(of.get(b, chr(b)) for b in raw) + rnd.choice(["", "中", "😀"]) for raw in raws]
        for raw, text, undone in zip(raws, texts, mojibake.all_steps(texts), strict=True):
            want, done = "", 0
            for m in pattern.finditer(raw):
                want += "".join(of.get(b, chr(b)) for b in raw[done : m.start()]) + m.group().decode("utf-8", "replace")
                done = m.end()
            want += "".join(of.get(b, chr(b)) for b in raw[done:]) + text[len(raw) :]
            assert dict(undone).get(f"utf-8 as {codec}", text) == want or codec in mojibake.CYRILLIC and mojibake.fine_cyrillic(text)


def test_equal_texts_are_rows_of_their_own(spark):
    wrong = sloppy(CLEAN["de"], "cp1252")
    docs = [(i, CLEAN["de"].replace("{}", str(i)), "de") for i in range(60)] + [(i, wrong, "de") for i in (100, 101, 102)]
    got = mojibake.garbled(spark.createDataFrame(docs, "doc_id bigint, text string, lang string")).collect()
    assert sorted((r.doc_id, r.restored) for r in got) == [(i, CLEAN["de"]) for i in (100, 101, 102)]


# ---- p1 and p3


@pytest.fixture(scope="module")
def namer(spark):
    return names.Namer(*names.char_tables(spark), ["澜城", "溪原", "砚山口"])


def test_names_meet_in_their_canonical_form(namer):
    same = [
        ("澜城芳妍牧仓储物流有限公司", ["芳妍牧仓储物流（澜城）有限公司", "澜城市芳妍牧倉儲物流", "“澜城 芳妍牧仓储物流集团有限公司”", "借款人：澜城芳言牧仓储物流有限责任公司", "澜城芳妍牧仓储物流（有限公司）"]),
    ]
    for name, others in same:
        p = namer.parse(name, False)
        for o in others:
            q = namer.parse(o, False)
            assert (q[1], q[2], q[4]) == (p[1], p[2], p[4]), o
    own = lambda n: namer.named(n, False)[4]
    namer.words = {"logistics", "steel", "trading", "foods"}
    assert own("LANCHENG FANGYANMU LOGISTICS CO.,LTD") == own("澜城芳妍牧仓储物流有限公司")
    assert own("Huaxin Trading Co., Ltd.") == own("Huaxin Steel Co., Ltd.") == "huaxin"
    trade = lambda n: namer.named(n, False)[5]
    assert not names.same_trade(trade("Huaxin Trading Co., Ltd."), trade("Huaxin Steel Co., Ltd.")) and names.same_trade(trade("Huaxin Trading Ltd"), trade("Huaxin Co."))
    assert own("Golden Sun Foods") == "goldensun" and own("Golden Dragon Chemical Ltd") == "goldendragonchemical"
    namer.trades = {"化工": 90, "油化工": 1, "石材": 80, "贸易": 90}
    assert [namer.named(n, False)[4:6] for n in ("中国石油化工有限公司", "中国石材有限公司", "华信贸易有限公司")] == [("zhongguoshiyou", "化工"), ("zhongguo", "石材"), ("huaxin", "贸易")]
    namer.trades, namer.words = {}, set()
    for o in ("Heng-yan Wu", "wu hengyan", "Wu, Heng-yan"):
        assert names.grams(True, namer.parse(o, True)[4]) == names.grams(True, namer.parse("吴恒岩", True)[4])
    assert namer.parse("澜城芳妍牧仓储物流有限公司溪原分公司", False)[2] == namer.parse("澜城芳妍牧仓储物流溪原分公司", False)[2] != ""
    assert namer.parse("", None)[4] == "" and namer.parse("陶美桦先生", True)[3] == "陶美桦" and len(namer.parse("甲" * 50_000, None)[4]) > 50_000


def brute_average(similar, least):
    clusters = [[i] for i in range(len(similar))]
    s = lambda a, b: sum(similar[min(i, j)][max(i, j)] for i in a for j in b) / (len(a) * len(b))
    while len(clusters) > 1:
        a, b = max(((a, b) for x, a in enumerate(clusters) for b in clusters[x + 1 :]), key=lambda p: s(*p))
        if s(a, b) < least:
            break
        clusters.remove(b)
        a += b
    return sorted(map(sorted, clusters))


def test_average_linkage():
    rnd = random.Random(8)
    for _ in range(40):
        n = rnd.randint(1, 8)
        m = [[rnd.random() if i < j else 0.0 for j in range(n)] for i in range(n)]
        got: dict = {}
        for i, c in enumerate(variants.average_linkage([r[:] for r in m], 0.5)):
            got.setdefault(c, []).append(i)
        assert sorted(got.values()) == brute_average(m, 0.5)


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (10, 11), (12, 11), (20, 20)], "a bigint, b bigint")
    assert rows(variants.components(edges)) == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (10, 10), (11, 10), (12, 10)]
    assert rows(variants.components(edges.limit(0))) == []


def store(spark):
    E = [(1, "N29901234567890123", False), (2, None, False), (3, "N29909999999999999", False), (4, None, False), (5, "992727196011276860", True), (6, None, True), (7, "992727196011276999", True), (1, "N29901234567890123", False)]
    N = [
        (10, 1, "澜城芳妍牧仓储物流有限公司"), (11, 1, "澜城旧名号贸易有限公司"), (20, 2, "芳言牧仓储流物（澜城）有限公司"), (30, 3, "溪原芳妍牧仓储物流有限公司"), (40, 4, "澜城芳妍牧仓储物流有限公司溪原分公司"), (50, 5, "吴恒岩"), (60, 6, "Heng-yan Wu"), (70, 7, "吴恒岩"),
        (10, 1, "澜城芳妍牧仓储物流有限公司"), (90, None, "x"), (91, 9, None), (92, 9, "　"),
    ]
    P = [(1, "联系电话", "12000000001"), (2, " 联系电话：", "120 0000 0001"), (3, "联系电话", "12000000001"), (4, "联系电话", "12000000001"), (5, "联系电话", "12000000005"), (6, "联系电话", "１２００００００００５"), (1, "注册地址", "澜城市青芦大道1号"), (3, "注册地址", "溪原市青芦大道1号"), (7, "住所", "澜城市青芦大道9号"), (5, "住所", "溪原市青芦大道9号"), (2, "注册地址", "澜城市银杏西路3号"), (4, "注册地址", "溪原市银杏西路3号"), (9, None, None)]
    return spark.createDataFrame(N, "name_id bigint, entity_id bigint, name string"), spark.createDataFrame(E, "entity_id bigint, key string, person boolean"), spark.createDataFrame(P, "entity_id bigint, field string, value string").withColumn("key", F.lit("clash"))


def test_variant_spellings(spark):
    n, e, p = store(spark)
    assert rows(variants.variant_spellings(n, e, p)) == [(10, 20), (50, 60)]
    assert rows(variants.variant_spellings(n.limit(0), e.limit(0), p.limit(0))) == []
    classes = variants.class_sizes(variants.name_classes(n, e, p))
    assert sorted((r.name_id, r.links) for r in classes.collect() if r.links) == [(10, 1), (20, 1), (50, 1), (60, 1)]


def test_copies_are_linked_without_all_pairs(spark, namer):
    n = spark.createDataFrame([(i, i, "澜城芳妍牧仓储物流有限公司" if i % 2 else "澜城芳言牧仓储物流") for i in range(1, 61)], "name_id bigint, entity_id bigint, name string")
    e = spark.createDataFrame([(i, "N29901234567890123" if i % 3 else None, False) for i in range(1, 61)], "entity_id bigint, key string, person boolean")
    p = spark.createDataFrame([(i, "联系电话", "12000000001") for i in range(1, 61)], "entity_id bigint, field string, value string")
    nodes, vectors, groups = variants.grouped(n, e, p, namer, variants.evidence(p))
    assert {r.component for r in groups.collect()} == {1} and groups.count() == 60
    assert variants.links(nodes, variants.evidence(p), vectors).count() < 120
    assert variants.variant_spellings(n, e, p).count() == 60 * 59 // 2


def test_trades_are_learned(spark):
    texts = [f"{b}{t}有限公司" for b in ("甲乙丙", "丁戊己", "庚辛壬", "天地玄", "宇宙洪", "日月盈") for t in ("电子元件", "贸易")] + [f"{w} Steel Co., Ltd" for w in "Alpha Beta Gamma Delta Zeta".split()] + [None, "", "　"]
    places = spark.createDataFrame([("澜城市青芦大道1号",)] * 3 + [("溪原市银杏西路3号",)] * 2 + [(None,)], "address string")
    cities, trades, words = names.learned(spark.createDataFrame([(t,) for t in texts], "name string"), places)
    assert cities == ["澜城"]
    assert max(trades, key=lambda t: (trades[t], len(t))) == "电子元件" and "贸易" in trades and "子元件" not in trades and words == {"steel"}
    assert names.learned(spark.createDataFrame([], "name string"), places.limit(0)) == ([], {}, set())


@pytest.mark.parametrize("matrix", [0, variants.MATRIX_BYTES])
def test_large_components_are_clustered(spark, namer, monkeypatch, matrix):
    monkeypatch.setattr(variants, "MATRIX_BYTES", matrix)
    weights = {}
    form = lambda name: (False, *(p := namer.named(name, False))[1:3], p[5], p[6])
    rnd = random.Random(4)
    bodies = ["".join(chr(rnd.randrange(0x4E00, 0x9000)) for _ in range(3)) for _ in range(150)]
    bodies += [b[:2] + "厦" for b in bodies]
    texts = [c + b + t + "有限公司" for b in bodies for c, t in (("澜城", "仓储物流"), ("溪原", rnd.choice(["仓储", "贸易"])))] + ["澜城芳妍牧仓储物流有限公司溪原分公司"]
    forms = sorted({form(t) for t in texts})
    assert len(forms) > 500
    for f in forms:
        for g in names.grams(False, f[4]):
            weights[g] = weights.get(g, 0) + 1
    vectors = []
    for f in forms:
        v = {g: 1 / weights[g] ** 0.3 for g in names.grams(False, f[4])}
        norm = sum(x * x for x in v.values()) ** 0.5
        vectors.append({g: x / norm for g, x in v.items()})

    def like(i, j):
        p, q = forms[i], forms[j]
        if (p[1] and q[1] and p[1] != q[1]) or (p[2] != q[2] and "branch" not in (p[2], q[2])) or not names.same_trade(p[3], q[3]):
            return 0.0
        return sum(x * vectors[j].get(g, 0.0) for g, x in vectors[i].items())

    n = len(forms)
    expected: dict = {}
    for i, c in enumerate(variants.average_linkage([[like(i, j) if i < j else 0.0 for j in range(n)] for i in range(n)], 0.45)):
        expected.setdefault(c, []).append(i)
    got: dict = {}
    for i, c in enumerate(variants.Forms([f[:4] for f in forms], [list(v.items()) for v in vectors]).clusters(0.45).tolist()):
        got.setdefault(c, []).append(i)
    assert sorted(got.values()) == sorted(expected.values()) and sum(len(v) > 1 for v in expected.values()) > 50


def test_certificates():
    key = "N29901234567890123"
    assert all(entities.cert_fit(c, key) >= 4 for c in ("N299**********0123", "N2990123456789012X" [:-1] + "3", "尾号890123", "…34567890…", "n2990123 4567890123", "N29901234"))
    assert all(entities.cert_fit(c, key) < 0 for c in ("N299**********9999", "尾号999999")) and entities.cert_fit(None, key) == entities.cert_fit("无", key) == entities.cert_fit("x", None) == 0


def test_marginals_prefer_one_to_one(spark):
    pairs = [(1, 10, "a", 5.0), (1, 11, "a", 4.0), (2, 10, "a", 4.5), (3, 12, "a", 0.0), (4, 13, "a", -3.0), (5, 14, "a", 800.0)]
    got = {(r.record_id, r.subject): r.confidence for r in entities.marginals(spark.createDataFrame(pairs, "record_id bigint, subject bigint, side string, score double")).collect()}
    assert got[1, 11] > 0.5 > got[1, 10] and got[2, 10] > 0.9 and abs(got[3, 12] - 0.5) < 1e-6 and got[4, 13] < 0.06 and got[5, 14] > 0.99


@pytest.mark.parametrize("hot", [1_000, 0])
def test_candidates_of_hot_tokens(spark, hot):
    left = spark.createDataFrame([(1, "b", "x"), (1, "p", "1"), (2, "b", "x"), (3, "c", "7"), (3, "p", "8")], "record_id bigint, kind string, token string")
    right = spark.createDataFrame([(10, "b", "x"), (10, "p", "1"), (11, "b", "x"), (12, "c", "7"), (12, "p", "8"), (13, "c", "7")], "subject bigint, kind string, token string")
    name = lambda i, city, trade: (i, False, city, "", trade)
    kind = "person boolean, city string, branch string, trade string"
    records = spark.createDataFrame([name(1, "A", "甲乙"), name(2, "B", "甲乙"), name(3, "A", "丙丁")], f"record_id bigint, {kind}")
    subjects = spark.createDataFrame([name(10, "C", "甲乙"), name(11, "", "甲"), name(12, "D", "戊"), name(13, "E", "丙丁")], f"subject bigint, {kind}")
    got = [(r.record_id, r.subject, r.kinds) for r in entities.candidates(left, right, records, subjects, hot).orderBy("record_id", "subject").collect()]
    every = [(1, 10, ["b", "p"]), (1, 11, ["b"]), (2, 10, ["b"]), (2, 11, ["b"]), (3, 12, ["c", "p"]), (3, 13, ["c"])]
    # a hot token needs a second one of another kind or a compatible name
    assert got == (every if hot else [(1, 10, ["b", "p"]), (1, 11, ["b"]), (2, 11, ["b"]), (3, 12, ["c", "p"])])


def test_the_rest_of_a_number_goes_before_its_beginning(spark):
    many = range(10, 15)
    left = spark.createDataFrame([(1, "c", "N29900"), (1, "c", "77X88Y"), (2, "c", "N29900"), (2, "c", "nobody")], "record_id bigint, kind string, token string")
    right = spark.createDataFrame([(i, "c", "N29900") for i in many] + [(12, "c", "77X88Y")], "subject bigint, kind string, token string")
    kind = "person boolean, city string, branch string, trade string"
    records = spark.createDataFrame([(i, False, "A", "", "甲乙") for i in (1, 2)], f"record_id bigint, {kind}")
    subjects = spark.createDataFrame([(i, False, "A" if i < 13 else "B", "", "甲乙") for i in many], f"subject bigint, {kind}")
    got = sorted((r.record_id, r.subject) for r in entities.candidates(left, right, records, subjects, 3).collect())
    assert got == [(1, 12), (2, 10), (2, 11), (2, 12)]
    runs = spark.createDataFrame([("ＮX12 345678*9",), (None,)], "t string").select(entities.runs_of(F.col("t"), 9).alias("r")).collect()
    assert [r.r for r in runs] == [["NX1234567", "X12345678"], None]


def test_matched_across_sources(spark):
    n, e, p = store(spark)
    L = [
        (100, "甲", "澜城芳妍牧仓储物流", "尾号890123", "120-0000-0001", "澜城市青芦大道1号…", None), (101, "甲", "Wu Heng-yan", None, "+86 12000000005", None, None), (102, "乙", "砚山口别家贸易有限公司", None, None, None, None), (103, "乙", None, None, None, None, None), (104, "乙", "", "", "", "", ""),
        (100, "甲", "澜城芳妍牧仓储物流", "尾号890123", "120-0000-0001", "澜城市青芦大道1号…", None), (105, None, "芳妍牧仓储物流" * 2000, None, None, None, None),
    ]
    ledger = spark.createDataFrame(L, "record_id bigint, ledger_name string, subject_name string, cert_text string, phone_text string, address_text string, rep_name string").withColumn("entity_id", F.lit("clash"))
    got = entities.matched(ledger, n, e, p)
    assert rows(got.select("entity_id", "record_id").distinct()) == [(1, 100), (2, 100), (5, 101), (6, 101)]
    assert got.filter("confidence > 1 or confidence < 0.5").count() == 0
    assert entities.matched(ledger.limit(0), n, e, p).count() == 0


def test_a_hot_name_reaches_its_compatible_subject(spark):
    key = lambda i: f"N{i * 7919 % 100_000:05d}012345{i:06d}"
    trade = lambda i: chr(0x5000 + 2 * i) + chr(0x5001 + 2 * i)
    many = range(1, entities.HOT_TOKEN + 20)
    n = spark.createDataFrame([(i, i, f"澜城芳妍牧{trade(i)}有限公司") for i in many], "name_id bigint, entity_id bigint, name string")
    e = spark.createDataFrame([(i, key(i), False) for i in many], "entity_id bigint, key string, person boolean")
    p = spark.createDataFrame([(i, "注册地址", "澜城市青芦大道") for i in many], "entity_id bigint, field string, value string")
    ledger = spark.createDataFrame([(100, "甲", f"澜城芳妍牧{trade(7)}有限公司", "尾号" + key(7)[-5:])], "record_id bigint, ledger_name string, subject_name string, cert_text string")
    ledger = ledger.selectExpr("*", "cast(null as string) phone_text", "cast(null as string) address_text", "cast(null as string) rep_name")
    assert rows(entities.matched(ledger, n, e, p).select("entity_id", "record_id")) == [(7, 100)]


@pytest.mark.parametrize("hot", [0, 2, 6])
def test_matches_do_not_depend_on_what_is_hot(spark, hot):
    rnd = random.Random(11)
    key = lambda i: f"N2990{i % 3}{i * 7919 % 100_000:05d}{i:06d}"
    own = lambda i: "".join(chr(0x5200 + 37 * (i * k % 40)) for k in (1, 3, 7))
    city, trade = ("澜城", "砚山", ""), ("仓储物流", "贸易", "粮油贸易")
    many = range(1, 41)
    n = spark.createDataFrame([(i, i, f"{city[i % 3]}{own(i // 2)}{trade[i % 2]}有限公司") for i in many], "name_id bigint, entity_id bigint, name string")
    e = spark.createDataFrame([(i, key(i), False) for i in many], "entity_id bigint, key string, person boolean")
    told = lambda i: [(i, "联系电话", f"1200000000{i % 5}"), (i, "注册地址", f"澜城市青芦大道{i % 4}号"), (i, "法定代表人", "吴恒" + "一二三四五六七"[i % 7])]
    p = spark.createDataFrame([r for i in many for r in told(i)], "entity_id bigint, field string, value string")
    records = []
    for i in many:
        j, k = rnd.choice(many), rnd.choice(many)
        cert = rnd.choice([None, key(i), "尾号" + key(i)[-6:], key(i)[:6] + "******" + key(i)[-4:], key(i)[:9] + "XY" + key(i)[11:]])
        records.append((100 + i, "甲乙"[i % 2], f"{city[j % 3]}{own(i // 2)}{trade[k % 3]}有限公司", cert, rnd.choice([None, f"1200000000{i % 5}", f"120****000{i % 5}"]), rnd.choice([None, f"澜城市青芦大道{j % 4}号"]), rnd.choice([None, "吴恒" + "一二三四五六七"[k % 7]])))
    ledger = spark.createDataFrame(records, "record_id bigint, ledger_name string, subject_name string, cert_text string, phone_text string, address_text string, rep_name string")
    of = lambda hot: {(r.entity_id, r.record_id): r.confidence for r in entities.matched(ledger, n, e, p, 0.0, hot).collect()}
    whole, got = of(10**9), of(hot)
    assert len(whole) > 100 and got.keys() == whole.keys() and all(abs(got[k] - whole[k]) < 1e-6 for k in whole)
