"""Matching of labels with fact keys and the plan of what to fill."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tallyloom.operators.facts import blank, high_risk

PROPOSE, AUTOMATIC = 0.45, 0.85


def label_form(c: Column) -> Column:
    """A label without blanks, colons, hyphens, brackets and slashes, in lower case."""
    return F.lower(F.regexp_replace(c, r"(?U)[\s:：_\-（）()【】\[\]/]+", ""))


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """0.8 times the share of matching blocks, to three places; for pairs that no simpler rule has scored."""
    return pd.Series([None if x is None or y is None else round(SequenceMatcher(None, x, y).ratio() * 0.8, 3) for x, y in zip(a, b, strict=True)])


def _characters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(form, token, length): each character of a form with how many of its kind stand before it."""
    for batch in batches:
        forms, tokens, lengths = [], [], []
        for form in batch.column(0).to_pylist():
            seen: dict[str, int] = {}
            for c in form:
                seen[c] = seen.get(c, 0) + 1
                forms.append(form)
                tokens.append(f"{c}{seen[c]}")
                lengths.append(len(form))
        yield pa.RecordBatch.from_arrays([pa.array(forms, pa.string()), pa.array(tokens, pa.string()), pa.array(lengths, pa.int32())], ["form", "token", "length"])


def alike(l: DataFrame, k: DataFrame, ratio: float) -> DataFrame:
    """(lf, kf) of forms whose ratio of matching blocks may reach `ratio`: a prefix-filtered join on characters, the rarest first.

    The ratio takes matching blocks of r = ratio / 2 of both lengths together, so the lengths differ at most by the factor
    (1 - r) / r and a form keeps at least r / (1 - r) of its characters. l: (lf), k: (kf).
    """
    r = ratio / 2
    each = lambda df: df.mapInArrow(_characters, "form string, token string, length int")
    a, b = each(l.select("lf").distinct()), each(k.select("kf").distinct())
    rare = a.select("token").unionAll(b.select("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))

    def prefix(df: DataFrame, name: str) -> DataFrame:
        order = Window.partitionBy("form").orderBy("df", "token")
        keep = F.col("length") - F.ceil(F.col("length") * r / (1 - r) - 1e-9) + 1
        return df.join(rare, "token").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= keep).select(F.col("form").alias(name), "token", F.col("length").alias(name + "_length"))

    met = prefix(a, "lf").join(prefix(b, "kf"), "token").filter(F.least("lf_length", "kf_length") >= r * (F.col("lf_length") + F.col("kf_length")) - 1e-9)
    return met.select("lf", "kf").distinct()


def _within(inner: DataFrame, outer: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b) of forms where the inner one stands in the outer one: the outer's pieces of every length that an inner one has meet it as equals."""
    i, o = inner.select(a).distinct(), outer.select(b).distinct()
    sizes = i.select(F.length(a).alias("size")).distinct()
    pieces = o.join(sizes, F.col("size") <= F.length(b)).select(b, F.explode(F.transform(F.sequence(F.lit(1), F.length(b) - F.col("size") + 1), lambda at: F.call_function("substring", F.col(b), at, F.col("size")))).alias(a))
    return pieces.join(i, a).select(a, b).distinct()


def scored(labels: DataFrame, keys: DataFrame, synonyms: DataFrame, fuzzy: bool = True) -> DataFrame:
    """(label, key, score) of labels and keys from PROPOSE on: 1 equal, 0.9 synonyms, 0.82 one within the other, else by similarity.

    labels: (label), keys: (key), synonyms: (name, word). They meet as synonyms, as pieces of each other, and by the characters
    that a score of PROPOSE needs in common, the rarest first; no label meets every key.
    """
    l = labels.select("label", label_form(F.col("label")).alias("lf")).filter("lf != ''").distinct()
    k = keys.select("key", label_form(F.col("key")).alias("kf")).filter("kf != ''").distinct()
    syn = synonyms.select(label_form(F.col("name")).alias("nf"), label_form(F.col("word")).alias("wf")).distinct()
    both_ways = syn.unionAll(syn.select("wf", "nf")).unionAll(syn.alias("x").join(syn.alias("y"), "nf").select(F.col("x.wf").alias("nf"), F.col("y.wf").alias("wf")))
    pairs = both_ways.distinct().select(F.col("nf").alias("lf"), F.col("wf").alias("kf"), F.lit(True).alias("syn"))
    met = _within(l, k, "lf", "kf").unionByName(_within(k, l, "kf", "lf"))
    if fuzzy:
        met = met.unionByName(alike(l, k, PROPOSE / 0.8))
    both = met.unionByName(l.select("lf").join(pairs, "lf").join(k.select("kf"), "kf").select("lf", "kf")).distinct().join(pairs, ["lf", "kf"], "left")
    rule = F.when(F.col("lf") == F.col("kf"), 1.0).when(F.col("syn"), 0.9).when(F.col("lf").contains(F.col("kf")) | F.col("kf").contains(F.col("lf")), 0.82)
    both = both.select("lf", "kf", rule.alias("rule"))
    score = F.coalesce("rule", similarity(F.when(F.col("rule").isNull(), F.col("lf")), F.col("kf"))) if fuzzy else F.coalesce("rule", F.lit(0.0))
    found = both.select("lf", "kf", score.alias("score")).filter(F.col("score") >= PROPOSE)
    return found.join(l, "lf").join(k, "kf").select("label", "key", "score")


def best_candidates(scores: DataFrame, n: int = 4) -> DataFrame:
    """The n best keys of each label with their rank, and whether another ties with the best."""
    order = Window.partitionBy("label").orderBy(F.desc("score"), "key")
    top = F.max("score").over(Window.partitionBy("label"))
    ranked = scores.withColumns({"rank": F.row_number().over(order), "best": top})
    return ranked.withColumn("tied", (F.abs(F.col("score") - F.col("best")) < 1e-9) & (F.count_if(F.abs(F.col("score") - F.col("best")) < 1e-9).over(Window.partitionBy("label")) > 1)).filter(F.col("rank") <= n).drop("best")


def decision(ambiguous: Column, value: Column, role_open: Column, tied: Column, confidence: Column, field: Column) -> Column:
    """What to do with a field: the first that holds of ambiguous, empty, open role, tie, low confidence and high risk; else it is filled."""
    return (
        F.when(ambiguous, "ask").when(blank(value), "empty").when(role_open, "ask").when(tied, "ask").when(confidence < AUTOMATIC, "ask").when(high_risk(field).isNotNull(), "ask").otherwise("auto")
    )


def reason(ambiguous: Column, value: Column, role_open: Column, tied: Column, confidence: Column, field: Column) -> Column:
    return (
        F.when(ambiguous, "ambiguous").when(blank(value), "blank").when(role_open, "role").when(tied, "tied").when(confidence < AUTOMATIC, "confidence").when(high_risk(field).isNotNull(), high_risk(field)).otherwise("")
    )


def guarded(plan: DataFrame, chosen: DataFrame) -> DataFrame:
    """(n, action, problem) of a user's choices over a plan: (n, decision, ambiguous, candidates array of ids) and (n, action, pick).

    An unknown number, an accepted empty or ambiguous row, a `use` of what is not ambiguous or not among the candidates, and an
    `ask` row that is left open are problems.
    """
    both = chosen.alias("c").join(plan.alias("p"), "n", "full")
    a, d = F.col("c.action"), F.col("p.decision")
    pick = F.regexp_replace("c.pick", "^#", "")
    problem = (
        F.when(d.isNull(), "unknown number").when(a.isNull() & (d == "ask"), "not decided").when(a.isNull(), None)
        .when((a == "accept") & (d == "empty"), "nothing to accept").when((a == "accept") & F.col("p.ambiguous"), "ambiguous").when((a == "use") & ~F.col("p.ambiguous"), "not ambiguous")
        .when((a == "use") & ~F.array_contains("p.candidates", pick), "no such candidate")
    )
    return both.select("n", a.alias("action"), problem.alias("problem"))


def cross_subject(plan: DataFrame, roles: DataFrame, subject: int, live_counts: DataFrame) -> DataFrame:
    """Each planned value as checked, unchecked or violation: whether it belongs to the template's subject or to a holder of the role it claims.

    plan: (n, key, entity_id, claimed), roles: (entity_id, role), live_counts: (key, live_rows).
    """
    allowed = roles.join(plan.select(F.col("claimed").alias("role")).filter("role is not null").distinct(), "role").groupBy("role").agg(F.min("entity_id").alias("allowed")).select("allowed").distinct().withColumn("ok", F.lit(True))
    held = roles.select(F.col("entity_id").alias("h"), F.col("role").alias("r")).distinct().withColumn("holds", F.lit(True))
    known = roles.select(F.col("entity_id").alias("e")).distinct().withColumn("has_role", F.lit(True))
    rows = plan.join(live_counts, "key", "left").join(allowed, F.col("entity_id") == F.col("allowed"), "left")
    rows = rows.join(held, (F.col("entity_id") == F.col("h")) & (F.col("claimed") == F.col("r")), "left").join(known, F.col("entity_id") == F.col("e"), "left")
    fine = F.coalesce("ok", F.lit(False)) | (F.col("entity_id") == subject)
    verdict = (
        F.when(F.col("entity_id").isNull(), "unchecked").when(F.col("claimed").isNull(), F.when((F.coalesce("live_rows", F.lit(0)) > 1) & ~fine, "violation").otherwise("checked"))
        .when(F.col("holds"), "checked").when(F.col("has_role").isNull(), "unchecked").otherwise("violation")
    )
    return rows.select("n", "key", "entity_id", verdict.alias("verdict"))


def questions(plan: DataFrame, same: list[str], place: str) -> DataFrame:
    """Plan rows that ask the same, as one question with its places: (question, same..., places, asked)."""
    mark = F.sha2(F.concat_ws("‖", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in same]), 256)
    return plan.groupBy(mark.alias("question"), *same).agg(F.countDistinct(place).alias("places"), F.count(F.lit(1)).alias("asked"))


def proposed(scores: DataFrame, targets: DataFrame) -> DataFrame:
    """(label, key, score, targets) of labels whose best key is sure (AUTOMATIC) and has no tie, with all places of the label. targets: (label, target)."""
    best = best_candidates(scores, 1).filter((F.col("score") >= AUTOMATIC) & ~F.col("tied")).select("label", "key", "score")
    return best.join(targets.groupBy("label").agg(F.sort_array(F.collect_set("target")).alias("targets")), "label")


def template_scope(plan: DataFrame) -> DataFrame:
    """(template, role): the role a template is about, from its file's name, else the only one that its keys claim; null if they claim several. plan: (template, template_name, key)."""
    from tallyloom.operators.facts import claimed_role

    named, claimed = claimed_role(F.col("template_name")), claimed_role(F.col("key"))
    got = plan.groupBy("template").agg(F.max(named).alias("named"), F.min(claimed).alias("lo"), F.max(claimed).alias("hi"))
    return got.select("template", F.coalesce("named", F.when(F.col("lo") == F.col("hi"), F.col("lo"))).alias("role"))


def uncovered(labels: DataFrame, rules: DataFrame) -> DataFrame:
    """Labels of templates that no rule covers: (template, field, target) without a rule for them."""
    return labels.join(rules.select("template", "field", "target").distinct(), ["template", "field", "target"], "left_anti")


def coverage(slots: DataFrame) -> DataFrame:
    """(template, detected, mapped, unmapped, protected, left_blank) of slots (template, mapped, protected, left_blank as booleans)."""
    return slots.groupBy("template").agg(F.count(F.lit(1)).alias("detected"), F.count_if("mapped").alias("mapped"), F.count_if(~F.col("mapped") & ~F.col("protected")).alias("unmapped"), F.count_if("protected").alias("protected"), F.count_if("left_blank").alias("left_blank"))
