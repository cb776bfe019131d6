"""Names as people type them: a canonical, romanised form that spellings of one name have in common."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.text import half_width, no_blanks
from tallyloom.session import cut

#: Cities are learned from addresses. No country has so many names of cities; more of them are an error, none is dropped.
MOST_CITIES = 50_000
#: A word for a trade ends (Latin: follows in) this share of all names at least, TRADE_NAMES of them at least, after TRADE_BEFORE different
#: characters (Latin: words) and TRADE_VARIETY of the most that any has; the share bounds the number of trades by 10 / TRADE_SHARE.
TRADE_SHARE, TRADE_NAMES, TRADE_BEFORE, TRADE_VARIETY, LONGEST_TRADE = 0.001, 5, 5, 0.1, 6
#: Characters of a Chinese name's own part where no known trade follows.
OWN = 3
GRAM = 3
#: Words of Latin trades are compared as characters of this private range, by a hash.
PRIVATE = 0xE000, 6_400

# Forms of organisation at the end of names, titles after or within persons' names, words of Latin company names.
FORM = re.compile("(?:集团)?(?:股份)?(?:有限)?(?:责任)?(?:公司|有限公|集团)?$")
BRANCH = re.compile("(?:公司|集团)(.{1,8}?(?:分公司|分行|支行|分部|办事处|分店|分厂))$")
TITLES = ("先生", "女士", "小姐", "老师", "经理", "总经理", "董事长", "主任", "总")
LATIN_FORM = re.compile(r"\b(?:co|ltd|limited|company|corp|corporation|inc|group|branch)\b")
LATIN_BRANCH = re.compile(r"\bbranch\b")
NOISE = re.compile(r"[\s​-‏⁠﻿·・•\"“”‘’'*。，,、;；_—\-]")


def char_tables(spark: SparkSession) -> tuple[dict[str, str], dict[str, str]]:
    """(reading, simplified form) of every Han character of the basic block, from the transliteration rules that Spark's JVM carries."""
    chars = [chr(c) for c in range(0x4E00, 0xA000)]
    rules = spark.sparkContext._jvm.com.ibm.icu.text.Transliterator
    readings = rules.getInstance("Han-Latin; Latin-ASCII; Lower").transliterate(" ".join(chars)).split(" ")
    simple = rules.getInstance("Traditional-Simplified").transliterate(" ".join(chars)).split(" ")
    return dict(zip(chars, readings, strict=True)), {c: s for c, s in zip(chars, simple, strict=True) if c != s}


class Namer:
    """Canonical forms of names; made on the driver, used on the executors. Its tables' sizes are bounded."""

    def __init__(self, readings: dict[str, str], simple: dict[str, str], cities: list[str], trades: dict[str, int] | None = None, words: set[str] | None = None) -> None:
        """trades: Chinese words for trades, with how many characters stand before them; words: Latin ones."""
        self.readings, self.simple = readings, simple
        self.trades, self.words = trades or {}, words or set()
        self.cities = sorted(set(cities), key=lambda c: (-len(c), c))
        self.city_set = set(cities)
        self.romanised = {self.roman(c): c for c in self.cities}

    def clean(self, text: str) -> str:
        text = unicodedata.normalize("NFKC", text)
        return "".join(self.simple.get(c, c) for c in text)

    def roman(self, text: str) -> str:
        return "".join(self.readings.get(c, c) for c in text).lower()

    def parse(self, name: str, person: bool | None) -> tuple[bool, str, str, str, str]:
        """(person, city, branch, body, romanised body) of a name; the body is what is left without city, branch, form and titles."""
        text = self.clean(name)
        text = re.sub(r"^[^:]{1,5}:", "", text)
        if re.search("[A-Za-z]{2}", text) and not re.search("[一-鿿]", text):
            return self._latin(text, person)
        text = NOISE.sub("", text)
        if person is None:
            person = len(text) <= 4 and not re.search("公司|集团|厂|店|行", text) and not any(text.startswith(c) for c in self.cities)
        if person:
            for t in sorted(TITLES, key=len, reverse=True):
                if len(text) > 2 and t in text[1:]:
                    text = text[0] + text[1:].replace(t, "", 1)
                    break
            text = re.sub(r"\(.*?\)", "", text)
            return True, "", "", text, self.roman(text)
        city = ""

        def inside(m: re.Match) -> str:
            nonlocal city
            word = m.group(1)
            if word.removesuffix("市") in self.city_set:
                city = word.removesuffix("市")
                return ""
            if FORM.fullmatch(word) or word in ("企业", "公章", "盖章", "本部", "总部"):
                return ""
            return word

        text = re.sub(r"\(([^()]*)\)?", inside, text).replace(")", "")
        branch = ""
        if m := BRANCH.search(text):
            branch, text = m.group(1), text[: m.start(1)]
        elif text.endswith("分公司") and len(text) > 7:
            head = text[:-3]
            part = next((c for c in self.cities if head.endswith(c)), None) or (m.group() if (m := re.search("第.{1,2}$", head)) else head[-2:])
            branch, text = part + "分公司", head[: -len(part)]
        for c in self.cities:
            if text.startswith(c):
                city = city or c
                text = text[len(c) :].removeprefix("市")
                break
        body = FORM.sub("", text) or text
        return False, city, self.roman(branch), body, self.roman(body)

    def own_length(self, body: str) -> int:
        """How many characters of a Chinese body are the company's own: what stands before the word for its trade, of several the
        one with the most different characters before it."""
        best = max(((self.trades.get(body[-n:], 0), n) for n in range(2, min(LONGEST_TRADE, len(body) - 2) + 1)), default=(0, 0))
        if not best[0]:
            return min(OWN, len(body))
        own = len(body) - best[1]
        # a character typed twice where the trade begins
        return own - 1 if own > OWN and body[own - 1] == body[own] else own

    def parts(self, p: tuple[bool, str, str, str, str], latin_trade: str) -> tuple[str, str]:
        """(own, trade): how a parsed name's own part sounds and the rest of it. A person's whole name is turned so that its least
        turn stands first; a name in Latin letters has its trade's words as private characters."""
        if p[0]:
            return min(p[4][i:] + p[4][:i] for i in range(len(p[4]))), ""
        if not p[3]:
            return p[4], latin_trade
        n = self.own_length(p[3])
        return self.roman(p[3][:n]), p[3][n:]

    def named(self, name: str, person: bool | None) -> tuple[bool, str, str, str, str, str, str]:
        """(person, city, branch, body, own part, trade, romanised body)."""
        p = self.parse(name, person)
        return (*p[:4], *self.parts(p[:5], p[5] if len(p) > 5 else ""), p[4]) if p[4] else (*p[:4], "", "", "")

    def _latin(self, text: str, person: bool | None) -> tuple:
        """As parse, with the trade as a sixth part."""
        low = re.sub(r"[^a-z()& -]", " ", text.lower().replace(".", " "))
        company = bool(LATIN_FORM.search(low)) or "&" in low
        if person is None:
            person = not company and len(low.split()) <= 4
        if person:
            body = re.sub("[^a-z]", "", low)
            return True, "", "", body, body
        branch = "branch" if LATIN_BRANCH.search(low) else ""
        words = [w for w in re.sub("[^a-z]", " ", LATIN_FORM.sub(" ", low)).split()]
        city = ""
        for w in words:
            if w in self.romanised:
                city = self.romanised[w]
                words.remove(w)
                break
        # a name's own part ends where a word for a trade begins
        own = next((i for i, w in enumerate(words) if i and w in self.words), len(words))
        first, many = PRIVATE
        return False, city, branch, "", "".join(words[:own]), "".join(chr(first + zlib.crc32(w.encode()) % many) for w in words[own:])


def grams(person: bool, roman: str) -> list[str]:
    """Character n-grams of a romanised body. A person's are taken around the end, so that the order of the name's parts doesn't matter."""
    if not roman:
        return []
    text = roman + roman[: GRAM - 1] if person else f"^{roman}$"
    return sorted({text[i : i + GRAM] for i in range(max(1, len(text) - GRAM + 1))})


def private(c: str) -> bool:
    return PRIVATE[0] <= ord(c[0]) < sum(PRIVATE)


def same_trade(x: str, y: str) -> bool:
    """Whether two trades can be one company's: they are of the same characters, one perhaps shortened or missing, or of another script."""
    if not x or not y or private(x) != private(y):
        return True
    short, long = sorted((x, y), key=len)
    rest, hit = list(long), 0
    for c in short:
        if c in rest:
            rest.remove(c)
            hit += 1
    return hit >= 0.6 * len(short)


def learned(names: DataFrame, addresses: DataFrame) -> tuple[list[str], dict[str, int], set[str]]:
    """(cities, Chinese words for trades with the number of characters that stand before them, Latin words for trades).

    names: (name); addresses: (address). Cities are what stands before 市 at the start of at least three addresses. Every
    ending of two to LONGEST_TRADE characters, and every word but the first of Latin companies' names, is counted over all
    names, combined before the shuffle; those of a share of the names come to the driver, whose number the share bounds. More
    than MOST_CITIES cities are an error.
    """
    text = F.regexp_replace(no_blanks(half_width(F.col("name"))), r"\(.*?\)|[(]?有限公司[)]?$", "")
    body = F.regexp_replace(text, FORM.pattern, "")
    latin = F.filter(F.split(F.regexp_replace(F.lower(half_width(F.col("name"))), LATIN_FORM.pattern + "|[^a-z]+", " "), " +"), lambda w: F.length(w) > 2)
    token = lambda kind, word, before: F.struct(F.lit(kind).alias("kind"), word.alias("word"), before.alias("before"))
    none = F.lit("")
    ends = F.transform(F.sequence(F.lit(2), F.least(F.lit(LONGEST_TRADE), F.length("body") - 2)), lambda n: token("han", F.right("body", n), F.substring(F.col("body"), -n - 1, F.lit(1))))
    words = F.transform(F.sequence(F.lit(1), F.size("latin") - 1), lambda i: token("latin", F.get("latin", i), F.get("latin", i - 1)))
    one = lambda kind: F.array(token(kind, none, none))
    each = names.filter("name is not null").select(body.alias("body"), latin.alias("latin"), F.lower(half_width(F.col("name"))).rlike(LATIN_FORM.pattern).alias("company")).select(
        F.when(F.col("body").rlike(r"\p{IsHan}"), F.when(F.length("body") >= 4, F.concat(one("han"), ends)).otherwise(one("han")))
        .when(F.col("company") & (F.size("latin") > 1), F.concat(one("latin"), words)).otherwise(one("none")).alias("e")
    )
    towns = addresses.select(F.array(token("city", F.regexp_extract("address", r"^\s*(\p{IsHan}{2,4}?)市", 1), none)).alias("e"))
    found = each.unionAll(towns).select(F.explode("e").alias("e")).groupBy("e").count().groupBy("e.kind", "e.word").agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("before"))
    of = lambda kind, what: F.max(F.when((F.col("kind") == kind) & (F.col("word") == "" if what == "n" else F.lit(True)), F.col(what)))
    found, seen = cut(found, han=of("han", "n"), latin=of("latin", "n"), han_before=of("han", "before"), latin_before=of("latin", "before"))
    enough = lambda kind: (F.col("n") >= max(TRADE_NAMES, TRADE_SHARE * (seen[kind] or 0))) & (F.col("before") >= max(TRADE_BEFORE, TRADE_VARIETY * (seen[kind + "_before"] or 0)))
    trade = F.when(F.col("kind") == "han", enough("han")).when(F.col("kind") == "latin", enough("latin"))
    most = MOST_CITIES + round(10 / TRADE_SHARE) * 2
    rows = found.filter((F.col("word") != "") & (trade | ((F.col("kind") == "city") & (F.col("n") >= 3)))).limit(most + 1).collect()
    cities = sorted(r.word for r in rows if r.kind == "city")
    if len(cities) > MOST_CITIES or len(rows) > most:
        raise ValueError(f"addresses name more than {MOST_CITIES} cities")
    return cities, {r.word: r.before for r in rows if r.kind == "han"}, {r.word for r in rows if r.kind == "latin"}


def made(names: DataFrame, addresses: DataFrame) -> Namer:
    """The Namer of a corpus: the tables of characters, and the cities and trades that its addresses and names tell."""
    readings, simple = char_tables(names.sparkSession)
    cities, trades, words = learned(names, addresses)
    # a syllable of a reading is part of a name
    return Namer(readings, simple, cities, trades, words - set(readings.values()))


def parsed(df: DataFrame, namer: Namer, columns: list[str]) -> DataFrame:
    """Adds person, city, branch, body, brand (the own part), trade, roman and grams to (columns..., name, person_hint). Names without any letter are left out."""
    shipped = df.sparkSession.sparkContext.broadcast(namer)
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, out = [], []
            for i, (name, hint) in enumerate(zip(batch.column(len(columns)).to_pylist(), batch.column(len(columns) + 1).to_pylist(), strict=True)):
                p = shipped.value.named(name, hint)
                if p[6]:
                    keep.append(i)
                    out.append((*p, grams(p[0], p[6])))
            if keep:
                types = [pa.bool_(), *[pa.string()] * 6, pa.list_(pa.string())]
                taken = [batch.column(c).take(pa.array(keep)) for c in range(len(columns))]
                yield pa.RecordBatch.from_arrays(taken + [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], [*columns, "person", "city", "branch", "body", "brand", "trade", "roman", "grams"])

    schema = ", ".join([f"{c} {kinds[c]}" for c in columns] + ["person boolean, city string, branch string, body string, brand string, trade string, roman string, grams array<string>"])
    return df.filter("name is not null").select(*columns, "name", "person_hint").mapInArrow(run, schema)


def gram_weights(nodes: DataFrame, total: int) -> DataFrame:
    """(gram, df, idf) over all nodes, `total` of them."""
    df = nodes.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    return df.select("gram", "df", F.log1p(F.lit(max(total, 1)) / F.col("df")).alias("idf"))


def vectors(nodes: DataFrame, weights: DataFrame, threshold: float) -> DataFrame:
    """(person, roman, vector, prefix) of each romanised form: the weights of its grams at length 1 and the grams of its prefix, the rarest first.

    Two forms whose cosine reaches the threshold share a gram of both prefixes: the grams left out are too light together.
    """
    forms = nodes.select("person", "roman", "grams").dropDuplicates(["person", "roman"])
    each = forms.select("person", "roman", F.explode("grams").alias("gram")).join(weights.hint("merge"), "gram")
    gathered = each.groupBy("person", "roman").agg(F.sort_array(F.collect_list(F.struct("df", "gram", "idf"))).alias("g"), F.sum(F.col("idf") * F.col("idf")).alias("all"))
    vector = F.map_from_arrays(F.col("g.gram"), F.transform("g", lambda x: x["idf"] / F.sqrt("all")))
    # a gram belongs to the prefix as long as what is left from it on is heavy enough
    start = F.struct(F.col("all").alias("left"), F.array().cast("array<string>").alias("prefix"))
    heavy = lambda a: a["left"] >= threshold * threshold * F.col("all") - 1e-9
    step = lambda a, x: F.struct((a["left"] - x["idf"] * x["idf"]).alias("left"), F.when(heavy(a), F.concat(a["prefix"], F.array(x["gram"]))).otherwise(a["prefix"]).alias("prefix"))
    return gathered.select("person", "roman", vector.alias("vector"), F.aggregate("g", start, step)["prefix"].alias("prefix"))


def cosine(a, b):
    """The cosine of two weight maps of length 1."""
    return F.aggregate(F.map_keys(a), F.lit(0.0), lambda acc, g: acc + F.coalesce(F.try_element_at(a, g) * F.try_element_at(b, g), F.lit(0.0)))
