"""Operators whose result depends on the order within a page or document: one shuffle by that, a sorted stream, bounded state."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.decide import alike, label_form, similarity


def ocr_rows(boxes: DataFrame, near: float = 0.6) -> DataFrame:
    """Adds `row` to boxes (page, box_id, top, bottom, left): from top to bottom a box joins the row before if its middle is within `near` median heights of that row's mean middle.

    The mean moves with each box, so the order decides; boxes are streamed by page and middle, with one row's state.
    """
    heights = boxes.groupBy("page").agg(F.percentile(F.col("bottom") - F.col("top"), 0.5).alias("height"))
    cols = boxes.columns
    ready = boxes.join(heights, "page").withColumn("middle", (F.col("top") + F.col("bottom")) / 2.0).select(*cols, "middle", "height")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, row, mean, n = None, 0, 0.0, 0
        for batch in batches:
            out = []
            pages, middles, spans = (batch.column(c).to_pylist() for c in ("page", "middle", "height"))
            for p, m, h in zip(pages, middles, spans, strict=True):
                if p != page:
                    page, row, mean, n = p, 0, m, 0
                elif abs(m - mean) > near * h:
                    row, mean, n = row + 1, m, 0
                mean = (mean * n + m) / (n + 1)
                n += 1
                out.append(row)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in cols), pa.array(out, pa.int32())], [*cols, "row"])

    kinds = dict(boxes.dtypes)
    return ready.repartition("page").sortWithinPartitions("page", "middle", "left").mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in cols) + ", row int")


def without_overlaps(slots: DataFrame) -> DataFrame:
    """Slots (part, id, start, end) that a greedy pass keeps: from left to right, the longer first, each that begins where the last kept one has ended."""
    cols = ["part", "id", "start", "end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last = None, 0
        for batch in batches:
            keep = []
            for i, (p, s, e) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("part", "start", "end")), strict=True)):
                if p != part:
                    part, last = p, None
                if last is None or s >= last:
                    keep.append(i)
                    last = e
            yield batch.take(pa.array(keep, pa.int64()))

    kinds = dict(slots.dtypes)
    return slots.select(*cols).repartition("part").sortWithinPartitions("part", "start", F.desc("end"), "id").mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in cols))


_RULE, _HEAD, _ITEM, _TABLE = re.compile(r"^\s*([-*_])(\s*\1){2,}\s*$"), re.compile(r"^(#{1,6})\s+(.*?)\s*#*$"), re.compile(r"^\s*(?:[-*+]|\d+[.)])\s+(.*)$"), re.compile(r"^\s*\|.*\|\s*$")


def markdown_blocks(text: str) -> list[tuple[str, int, str]]:
    """(kind, level, text) of a Markdown text: heading, rule, code, quote, table, list or paragraph; neighbouring lines of a kind are one block."""
    out: list[tuple[str, int, str]] = []
    held: tuple[str, list[str]] | None = None
    fence = None

    def close() -> None:
        nonlocal held
        if held:
            out.append((held[0], 0, "\n".join(held[1])))
        held = None

    for line in text.split("\n"):
        mark = re.match(r"^\s*(```|~~~)", line)
        if fence:
            if mark and mark.group(1) == fence:
                fence = None
                close()
            else:
                held[1].append(line)
            continue
        if mark:
            close()
            fence, held = mark.group(1), ("code", [])
            continue
        if not line.strip():
            close()
        elif m := _HEAD.match(line):
            close()
            out.append(("heading", len(m.group(1)), m.group(2)))
        elif _RULE.match(line):
            close()
            out.append(("rule", 0, ""))
        else:
            kind, piece = ("quote", line.lstrip()[1:].strip()) if line.lstrip().startswith(">") else ("table", line.strip()) if _TABLE.match(line) else ("list", m.group(1)) if (m := _ITEM.match(line)) else ("paragraph", line.strip())
            if held and held[0] == kind:
                held[1].append(piece)
            else:
                close()
                held = (kind, [piece])
    close()
    return out


def markdown(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, kind, level, text) of every block of Markdown texts; null and empty texts have none."""
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, pos, *b) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t for pos, b in enumerate(markdown_blocks(t))]
            if rows:
                ks, ps, kinds, levels, texts = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(ks, batch.column(0).type), pa.array(ps, pa.int32()), pa.array(kinds), pa.array(levels, pa.int32()), pa.array(texts)], [key, "pos", "kind", "level", "text"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, pos int, kind string, level int, text string")


def similar_names(wanted: DataFrame, known: DataFrame, least: float = 0.65, n: int = 3) -> DataFrame:
    """(wanted, known, ratio, rank) of file names alike: they meet by the characters that the ratio needs in common, the rarest first."""
    form = lambda df, side: df.select(F.col("name").alias(side), label_form(F.col("name")).alias(side[0] + "f")).distinct().filter(f"{side[0]}f != ''")
    a, b = form(wanted, "wanted"), form(known, "known")
    met = alike(a.select(F.col("wf").alias("lf")), b.select("kf"), least)
    ratio = met.select(F.col("lf").alias("wf"), "kf", (similarity("lf", "kf") / 0.8).alias("ratio")).filter(F.col("ratio") >= least - 1e-9)
    both = ratio.join(a, "wf").join(b, "kf").select("wanted", "known", "ratio")
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("wanted").orderBy(F.desc("ratio"), "known"))).filter(F.col("rank") <= n)
