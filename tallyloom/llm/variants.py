"""Variant spellings of one name of one subject."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import clean_field, half_width, no_blanks
from tallyloom.llm import names as N
from tallyloom.session import cut

#: Cosine of two spellings at least; average cosine of two clusters at least.
THRESHOLD, LINKAGE = 0.5, 0.45
#: A matrix of similarities larger than this is kept in a file instead of memory.
MATRIX_BYTES = 128_000_000


def identity_key(uscc: Column, id_card: Column) -> Column:
    """A subject's key in one form; null for missing and placeholder keys."""
    clean = lambda c: F.upper(no_blanks(half_width(c)))
    good = lambda c: F.when(clean(c).rlike("^[0-9A-Z]{15,18}$"), clean(c))
    return F.coalesce(good(uscc), good(id_card))


def phone_digits(c: Column) -> Column:
    """The last eleven digits of a telephone number; null if there are fewer."""
    digits = F.regexp_replace(half_width(c), r"\D", "")
    return F.when(F.length(digits) >= 11, F.substring(digits, -11, 11))


def place(c: Column) -> Column:
    """An address without blanks and marks."""
    return F.regexp_replace(no_blanks(half_width(c)), r"[^\p{L}\p{N}-]", "")


def evidence(profile: DataFrame) -> DataFrame:
    """(entity_id, what, value): what entries of a profile tell of a subject beside its name: telephone, representative, address."""
    # a character that each of the fields has, so that few fields need cleaning
    near = F.lit(False)
    for c in "电代址所":
        near = near | F.col("field").contains(c)
    kept = profile.filter("entity_id is not null and value is not null").filter(near).select("entity_id", clean_field(F.col("field")).alias("field"), "value")
    what = F.when(F.col("field") == "联系电话", "phone").when(F.col("field") == "法定代表人", "rep").when(F.col("field").isin("注册地址", "住所"), "address")
    value = F.when(what == "phone", phone_digits(F.col("value"))).otherwise(place(F.col("value")))
    return kept.select("entity_id", what.alias("what"), value.alias("value")).filter("what is not null and value is not null and length(value) > 1").distinct()


def addresses(profile: DataFrame) -> DataFrame:
    """(address): entries of a profile that may be one."""
    return profile.filter(F.col("value").contains("市")).select(F.col("value").alias("address"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of edges (a, b): the least node of each connected component, by contraction.

    In each round every node points to the least of its neighbours and itself and from there one step further; edges between
    nodes that now point to the same one are gone, the others join the nodes pointed to, until no edge is left. Each
    round's pointers and edges are written to the checkpoint folder; only the number of edges comes to the driver.
    """
    ends = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")
    left = cut(edges.filter("a != b").select(ends).select("e.a", "e.b").distinct())
    out = None
    while True:
        near = left.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("to"))
        further = near.select(F.col("node").alias("to"), F.col("to").alias("far"))
        points = cut(near.join(further.hint("merge"), "to").select("node", F.col("far").alias("to")))
        at = lambda end: points.select(F.col("node").alias(end), F.col("to").alias("to_" + end)).hint("merge")
        moved = left.join(at("a"), "a").join(at("b"), "b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b")).filter("a != b").distinct()
        left, seen = cut(moved, n=F.count(F.lit(1)))
        step = points.withColumnRenamed("to", "component")
        if out is None:
            out = step
        else:
            later = points.withColumnRenamed("node", "component")
            out = out.join(later.hint("merge"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        if not seen["n"]:
            return out


def compatible(a: str, b: str) -> Column:
    """Whether two names can be one subject's by kind, keys, city and branch."""
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    return (
        (x("person") == y("person"))
        & (x("key").isNull() | y("key").isNull() | (x("key") == y("key")))
        & ((x("city") == "") | (y("city") == "") | (x("city") == y("city")))
        & ((x("branch") == y("branch")) | ((x("branch") != "") & (y("branch") == "branch")) | ((y("branch") != "") & (x("branch") == "branch")))
    )


def _latin(trade: Column) -> Column:
    return (trade >= chr(N.PRIVATE[0])) & (trade < chr(sum(N.PRIVATE)))


def same_trade(a: str, b: str) -> Column:
    """As names.same_trade, of two columns."""
    x, y = F.col(a), F.col(b)
    short, long = F.when(F.length(x) <= F.length(y), x).otherwise(y), F.when(F.length(x) <= F.length(y), y).otherwise(x)
    missing = F.length(F.call_function("translate", short, long, F.lit("")))
    return (short == "") | (_latin(x) != _latin(y)) | (F.length(short) - missing >= 0.6 * F.length(short))


def nodes_of(names: DataFrame, entities: DataFrame, namer: N.Namer) -> DataFrame:
    """Names with their parsed parts and their entity's key: (name_id, entity_id, key, person, city, branch, body, brand, trade, roman, grams)."""
    who = entities.filter("entity_id is not null").groupBy("entity_id").agg(F.max("key").alias("key"), F.max("person").alias("person_hint"))
    rows = names.filter("name_id is not null and entity_id is not null and name is not null").select("name_id", "entity_id", "name").dropDuplicates(["name_id"]).join(who.hint("merge"), "entity_id", "left")
    return N.parsed(rows, namer, ["name_id", "entity_id", "key"])


def links(nodes: DataFrame, facts: DataFrame, vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b) entities of one subject: some of their names are spellings alike and they share a telephone, representative or address.

    A sparse cosine join: what is joined are (shared fact, gram of the prefix) pairs, so neither a common name nor a common
    telephone by itself brings entities together. Facts that one entity only has are left out before, by an aggregate that
    is combined before the shuffle, and so are the entities without any other; `vectors` are of all names (names.vectors).
    Of entities with one fact and one spelling (copies of a subject, perhaps a third of all rows) each is linked to the
    least of those with the same or no key, and only the least meets others, so that copies are not expanded into pairs.
    """
    common = facts.groupBy("what", "value").agg(F.min("entity_id").alias("lo"), F.max("entity_id").alias("hi")).filter("lo < hi").select("what", "value")
    shared = facts.join(common.hint("merge"), ["what", "value"])
    met = nodes.select("entity_id", "key", "person", "city", "branch", "trade", "roman").join(shared.hint("merge"), "entity_id")
    same = met.groupBy("what", "value", "person", "city", "branch", "trade", "roman", "key").agg(F.min("entity_id").alias("first"), F.max("entity_id").alias("last"))
    forms = cut(same.join(vectors.hint("merge"), ["person", "roman"]).select("first", "last", "key", "person", "city", "branch", "trade", "vector", "prefix", F.xxhash64("what", "value", "person").alias("fact"), "what", "value", "roman"))
    copies = forms.filter("first < last").select("what", "value", "person", "city", "branch", "trade", "roman", "key", "first")
    inside = met.join(copies.hint("merge"), [met[c].eqNullSafe(copies[c]) for c in ("what", "value", "person", "city", "branch", "trade", "roman", "key")]).filter("entity_id != first").select(F.col("first").alias("a"), F.col("entity_id").alias("b"))
    keyed = forms.drop("what", "value", "roman").select("*", F.explode("prefix").alias("gram")).withColumn("meet", F.xxhash64("fact", "gram"))
    a, b = keyed.alias("a"), keyed.alias("b")
    first = F.get(F.array_intersect("a.prefix", "b.prefix"), F.lit(0)) == F.col("a.gram")
    across = a.join(b.hint("merge"), (F.col("a.meet") == F.col("b.meet")) & (F.col("a.first") < F.col("b.first"))).filter(first & compatible("a", "b") & same_trade("a.trade", "b.trade"))
    across = across.filter(N.cosine(F.col("a.vector"), F.col("b.vector")) >= threshold).select(F.col("a.first").alias("a"), F.col("b.first").alias("b"))
    return across.unionAll(inside)


def lone_links(nodes: DataFrame) -> DataFrame:
    """(a, b): entities without a key, each with the one subject whose name sounds the same, where no two keys have that name.

    For subjects that share no recorded fact with their other entry. Names are grouped by sound, city, branch and the start
    of the trade; names that lack city or trade are compared without it. In a group with at most one key every entity
    without a key is linked to the group's first entity (that with the key before others), so that no pairs within a
    group arise; what is linked still has to pass the average linkage.
    """
    # a trade in another script can't be compared
    trade = F.when(_latin(F.col("trade")), "").otherwise(F.substring("trade", 1, 1))
    forms = nodes.select("entity_id", "key", "person", "city", "branch", "brand", trade.alias("trade"))
    ways = F.explode(F.array(*[F.struct(F.lit(c).alias("no_city"), F.lit(t).alias("no_trade")) for c in (False, True) for t in (False, True)])).alias("w")
    each = forms.select("*", ways).select(
        "entity_id", "key", "person", "brand", "branch", "w.no_city", "w.no_trade", F.when(F.col("w.no_city"), "").otherwise(F.col("city")).alias("city"), F.when(F.col("w.no_trade"), "").otherwise(F.col("trade")).alias("trade"),
        (F.col("key").isNull() & (~F.col("w.no_city") | (F.col("city") == "")) & (~F.col("w.no_trade") | (F.col("trade") == ""))).alias("asks"),
    )
    on = ["person", "brand", "branch", "no_city", "no_trade", "city", "trade"]
    groups = each.groupBy(*on).agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.min(F.struct(F.col("key").isNull().alias("unkeyed"), "entity_id")).alias("first"), F.max("asks").alias("asked"))
    one = groups.filter("asked and (lo is null or lo = hi)").select(*on, F.col("first.entity_id").alias("first"))
    return each.filter("asks").join(one.hint("merge"), on).select(F.col("first").alias("a"), F.col("entity_id").alias("b"))


def grouped(names: DataFrame, entities: DataFrame, profile: DataFrame, namer: N.Namer, facts: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, vectors, groups): the parsed names, their forms' vectors and the component of each linked entity."""
    nodes, seen = cut(nodes_of(names, entities, namer), n=F.count(F.lit(1)))
    vectors = cut(N.vectors(nodes, N.gram_weights(nodes, seen["n"]), threshold))
    return nodes, vectors, components(links(nodes, facts, vectors, threshold).unionAll(lone_links(nodes)))


def average_linkage(similar: list[list[float]], least: float) -> list[int]:
    """Cluster of each item: the two clusters with the greatest average similarity are joined as long as it is at least `least`."""
    upper = np.triu(np.array(similar, float).reshape(len(similar), -1), 1)
    return _joined(upper + upper.T, least).tolist()


def _joined(total: np.ndarray, least: float) -> np.ndarray:
    """As average_linkage, of a full matrix, which is used up. Each cluster keeps its nearest; as joining never brings clusters
    nearer, one whose nearest was joined keeps its old average as a bound and is looked up again only when that is the greatest."""
    n = len(total)
    size, cluster = np.ones(n), np.arange(n)
    best, near, stale = np.full(n, -np.inf), np.zeros(n, np.int64), np.zeros(n, bool)

    def look(i: int) -> np.ndarray:
        mean = total[i] / (size[i] * size)
        near[i], stale[i] = mean.argmax(), False
        best[i] = mean[near[i]]
        return mean

    np.fill_diagonal(total, -np.inf)
    for i in range(n):
        look(i)
    while n:
        i = int(best.argmax())
        if best[i] < least:
            break
        if stale[i]:
            look(i)
            continue
        i, j = sorted((i, int(near[i])))
        total[i] += total[j]
        total[:, i] = total[i]
        total[:, j] = best[j] = -np.inf
        size[i] += size[j]
        cluster[cluster == j] = i
        stale |= (near == i) | (near == j)
        mean = look(i)
        nearer = (mean > best) | ((mean == best) & (i < near))
        best[nearer], near[nearer], stale[nearer] = mean[nearer], i, False
    return cluster


class Forms:
    """The distinct forms (person, city, branch, trade) of the names of one component, with their vectors, as arrays by gram."""

    def __init__(self, keys: list[tuple], vectors: list[list[tuple[str, float]]]) -> None:
        self.n = len(keys)
        code = lambda values: np.unique(np.array(values), return_inverse=True)[1]
        self.person = np.array([bool(k[0]) for k in keys])
        self.city, self.any_city = code([k[1] for k in keys]), np.array([k[1] == "" for k in keys])
        self.branch, self.any_branch = code([k[2] for k in keys]), np.array([k[2] == "branch" for k in keys])
        self.grams, self.by_gram = self._postings(vectors)
        # what same_trade compares: the characters of a trade, the second one of a kind being another
        trades = sorted({k[3] for k in keys})
        at = {t: i for i, t in enumerate(trades)}
        self.trade, self.length = np.array([at[k[3]] for k in keys]), np.array([len(t) for t in trades])
        self.latin = np.array([bool(t) and N.private(t) for t in trades])
        self.chars, self.by_char = self._postings([[((c, t[:i].count(c)), 1.0) for i, c in enumerate(t)] for t in trades])

    @staticmethod
    def _postings(rows: list[list[tuple]]) -> tuple[list[list[tuple]], dict]:
        found: dict = {}
        for i, row in enumerate(rows):
            for key, x in row:
                own = found.setdefault(key, ([], []))
                own[0].append(i)
                own[1].append(x)
        return rows, {key: (np.array(a), np.array(x)) for key, (a, x) in found.items()}

    def like(self, i: int) -> np.ndarray:
        """The cosine of form i with every form; 0 where person, city, branch or trade differ."""
        out = np.zeros(self.n)
        for g, x in self.grams[i]:
            at, y = self.by_gram[g]
            out[at] += x * y
        hit = np.zeros(len(self.length))
        for c, _ in self.chars[self.trade[i]]:
            hit[self.by_char[c][0]] += 1
        # an empty rest has no characters to miss
        trade = (hit >= 0.6 * np.minimum(self.length, self.length[self.trade[i]])) | (self.latin != self.latin[self.trade[i]])
        city = self.any_city | self.any_city[i] | (self.city == self.city[i])
        branch = self.any_branch | self.any_branch[i] | (self.branch == self.branch[i])
        return np.where((self.person == self.person[i]) & city & branch & trade[self.trade], out, 0.0)

    def clusters(self, least: float) -> np.ndarray:
        """The average-linkage cluster of each form. Clusters are joined only if some pair of theirs reaches `least`, so the parts that such
        pairs hold together are clustered one by one; a part's matrix beyond MATRIX_BYTES is kept in a file."""
        cluster, seen = np.arange(self.n), np.zeros(self.n, bool)
        for first in range(self.n):
            if seen[first]:
                continue
            seen[first], part = True, [first]
            for i in part:
                more = np.flatnonzero((self.like(i) >= least - 1e-9) & ~seen)
                seen[more] = True
                part.extend(more.tolist())
            if len(part) > 1:
                part = np.sort(part)
                shape = (len(part), len(part))
                with tempfile.TemporaryFile() as file:
                    total = np.zeros(shape) if 8 * len(part) ** 2 <= MATRIX_BYTES else np.memmap(file, np.float64, "w+", shape=shape)
                    for row, i in enumerate(part):
                        total[row, row + 1 :] = total[row + 1 :, row] = self.like(i)[part[row + 1 :]]
                    cluster[part] = part[_joined(total, least)]
                    del total
        return cluster


def _classes(batches: Iterator[pa.RecordBatch], linkage: float) -> Iterator[pa.RecordBatch]:
    """(component, form, class) of rows (component, form, person, city, branch, trade, vector) sorted by component and form."""
    stream = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    out: list[tuple] = []

    def emit() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["component", "form", "class"])

    for component, rows in groupby(stream, lambda r: r[0]):
        forms, keys, vectors = [], [], []
        for r in rows:
            forms.append(r[1])
            keys.append(r[2:6])
            vectors.append([(x["key"], x["value"]) for x in r[6]])
        cluster = Forms(keys, vectors).clusters(linkage) if len(forms) > 1 else [0]
        out.extend((component, form, forms[int(c)]) for form, c in zip(forms, cluster, strict=True))
        if len(out) >= 20_000:
            yield emit()
            out = []
    if out:
        yield emit()


def spelled_alike(nodes: DataFrame, groups: DataFrame, vectors: DataFrame, linkage: float = LINKAGE) -> DataFrame:
    """(name_id, entity_id, component, class): the class of spellings of each name of a linked entity, within its component.

    What is gathered for the clustering are a component's distinct forms, one row each however many names have it; the
    names find their form's class by a join.
    """
    form = F.xxhash64("person", "city", "branch", "trade", "roman").alias("form")
    inside = cut(nodes.join(groups.hint("merge"), nodes["entity_id"] == groups["node"]).select("component", "name_id", "entity_id", "person", "city", "branch", "trade", "roman", form))
    forms = inside.groupBy("component", "form").agg(*[F.first(c).alias(c) for c in ("person", "city", "branch", "trade", "roman")]).join(vectors.hint("merge"), ["person", "roman"])
    ordered = forms.select("component", "form", "person", "city", "branch", "trade", F.map_entries("vector").alias("vector")).repartition("component").sortWithinPartitions("component", "form")
    classes = ordered.mapInArrow(lambda batches: _classes(batches, linkage), "component bigint, form bigint, class bigint")
    return inside.select("component", "form", "name_id", "entity_id").join(classes.hint("merge"), ["component", "form"]).select("name_id", "entity_id", "component", "class")


def name_classes(names: DataFrame, entities: DataFrame, profile: DataFrame, threshold: float = THRESHOLD, linkage: float = LINKAGE) -> DataFrame:
    """(name_id, entity_id, component, class): the names that are spellings of one name of one subject have component and class in common.

    names (name_id, entity_id, name), entities (entity_id, key, person), profile (entity_id, field, value). Names are brought
    to a romanised form (width, simplified forms, readings, order of parts, forms of organisation), weighted by character
    n-grams and met by a sparse cosine join; entities whose names meet must share a fact beside the name and not differ in
    key, city, branch or trade, so that namesakes, sister companies and branches stay apart. Within a component of linked
    entities average-linkage clustering tells a subject's several names apart.

    Edge cases: null and blank names and names without letters are left out, as are names of entities that no other is
    linked with; names of entities that are lost count, by their own facts; copies count once; an entity without a key and
    without a shared fact is linked only where its name sounds like one subject's; empty tables give no rows.
    """
    namer = N.made(names, addresses(profile))
    nodes, vectors, groups = grouped(names, entities, profile, namer, cut(evidence(profile)), threshold)
    return spelled_alike(nodes, groups, vectors, linkage)


def class_sizes(classes: DataFrame) -> DataFrame:
    """(name_id, entity_id, class, links): each name with its class and how many names of other entities it is linked with; copies are not expanded."""
    on = ["component", "class"]
    own = classes.groupBy(*on, "entity_id").agg(F.count(F.lit(1)).alias("own"))
    whole = own.groupBy(*on).agg(F.sum("own").alias("names"))
    return classes.join(own, [*on, "entity_id"]).join(whole, on).select("name_id", "entity_id", F.concat_ws("/", *on).alias("class"), (F.col("names") - F.col("own")).alias("links"))


def variant_spellings(names: DataFrame, entities: DataFrame, profile: DataFrame, threshold: float = THRESHOLD, linkage: float = LINKAGE) -> DataFrame:
    """(name_id_a, name_id_b): pairs of name rows of different entities whose names are spellings of one name of one subject; as name_classes."""
    a = cut(name_classes(names, entities, profile, threshold, linkage))
    b = a.select(F.col("name_id").alias("name_id_b"), F.col("entity_id").alias("other"), "component", "class")
    return a.join(b.hint("merge"), ["component", "class"]).filter("name_id < name_id_b and entity_id != other").select(F.col("name_id").alias("name_id_a"), "name_id_b")
