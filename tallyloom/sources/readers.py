"""Files read and written by their suffix."""

from __future__ import annotations

import csv
import fnmatch
import glob
import io
import itertools
import os
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Encodings and delimiters that are tried, in order.
ENCODINGS = ("utf-8-sig", "utf-8", "gb18030", "gbk", "big5", "latin-1")
DELIMITERS = (",", "\t", ";", "|")
HEAD_BYTES = 8192
TEXT, SHEETS = (".csv", ".tsv", ".txt"), (".xlsx", ".xlsm")
#: A Markdown table shows at most so many rows; that is what it is for.
MARKDOWN_ROWS = 200


def resolve(pattern: str, recursive: bool = False, exclude: tuple[str, ...] = ("~$*", "*.tmp", "*.temp", ".ds_store", "thumbs.db", "desktop.ini")) -> list[str]:
    """Files of a path, folder (its direct children, or all below), glob or several joined by `;`, each once whatever its case, without junk."""
    out: dict[str, str] = {}
    for part in filter(None, (p.strip() for p in pattern.split(";"))):
        if os.path.isdir(part):
            found = [os.path.join(r, f) for r, _, fs in os.walk(part) for f in fs] if recursive else [e.path for e in os.scandir(part) if e.is_file()]
        else:
            found = [part] if os.path.isfile(part) else [f for f in glob.glob(part, recursive=True) if os.path.isfile(f)]
        for f in sorted(found):
            if not any(fnmatch.fnmatch(os.path.basename(f).lower(), x) for x in exclude):
                out.setdefault(os.path.abspath(f).lower(), f)
    return list(out.values())


def _head(spark: SparkSession, path: str) -> bytes:
    """The first bytes of a file, wherever Spark reads it from."""
    row = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, HEAD_BYTES).alias("head")).first()
    return bytes(row["head"]) if row else b""


def sniff_encoding(head: bytes) -> str:
    """The first encoding that reads the head; a character cut off at its end is no fault."""
    for name in ENCODINGS:
        if name == "utf-8-sig" and not head.startswith(b"\xef\xbb\xbf"):
            continue
        for cut in range(4):
            try:
                head[: len(head) - cut].decode(name)
                return name
            except UnicodeDecodeError:
                continue
    return "latin-1"


def sniff_delimiter(head: str) -> str:
    """The delimiter that occurs most often; the comma among equals."""
    return max(DELIMITERS, key=lambda d: (head.count(d), -DELIMITERS.index(d)))


def read_table(spark: SparkSession, path: str, sheet: str | int = 0, header: int = 0, encoding: str | None = None, delimiter: str | None = None) -> DataFrame:
    """A table from csv, tsv, txt, json, jsonl, ndjson, parquet, feather, xlsx or xlsm. Other suffixes raise."""
    end = os.path.splitext(path)[1].lower()
    if end in TEXT:
        head = b"" if encoding and delimiter else _head(spark, path)
        encoding = encoding or sniff_encoding(head)
        name = "UTF-8" if encoding.startswith("utf-8") else "GB18030" if encoding in ("gbk", "gb18030") else {"latin-1": "ISO-8859-1", "big5": "Big5"}.get(encoding, encoding)
        delimiter = delimiter or sniff_delimiter(head.decode(encoding, "replace"))
        if name not in ("UTF-8", "ISO-8859-1"):
            # encodings that Spark's own reader refuses by default
            return _decoded(spark, path, encoding, delimiter)
        return spark.read.option("header", True).option("inferSchema", True).option("multiLine", True).option("escape", '"').option("encoding", name).csv(path, sep=delimiter)
    if end in (".json", ".jsonl", ".ndjson"):
        return spark.read.option("multiLine", end == ".json").json(path)
    if end == ".parquet":
        return spark.read.parquet(path)
    if end == ".feather":
        return _feather(spark, path)
    if end in SHEETS:
        from tallyloom.sources.office import Workbook

        spark.dataSource.register(Workbook)
        cells = spark.read.format("tallyloom_workbook").option("sheet", str(sheet)).load(path)
        return from_cells(cells, header)
    raise ValueError(f"no reader for {end}")


def _decoded(spark: SparkSession, path: str, encoding: str, delimiter: str) -> DataFrame:
    """A delimited file in an encoding that Spark's reader doesn't have, decoded and taken apart in the task that reads it; columns of
    which every value is a whole or a decimal number are numbers. The first row names the columns."""

    def run(batches):
        for batch in batches:
            for content in batch.column(0).to_pylist():
                rows = csv.reader(io.StringIO(content.decode(encoding, "replace"), newline=""), delimiter=delimiter)
                while part := list(itertools.islice(rows, 10_000)):
                    yield pa.RecordBatch.from_arrays([pa.array([[x or None for x in r] for r in part], pa.list_(pa.string())), pa.array([len(r) for r in part], pa.int32())], ["cells", "width"])

    lines = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "cells array<string>, width int").withColumn("line", F.monotonically_increasing_id()).filter("width > 0")
    first = lines.orderBy("line").first()
    names = [x or f"_c{i}" for i, x in enumerate(first["cells"])] if first else []
    rows = lines.filter(F.col("line") > first["line"]).select(*[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)]) if first else lines.select()
    if not names:
        return rows
    counts = rows.agg(*[x for i, n in enumerate(names) for x in (F.count(f"`{n}`").alias(f"n{i}"), F.count(F.col(f"`{n}`").try_cast("bigint")).alias(f"i{i}"), F.count(F.when(F.col(f"`{n}`").rlike(r"^\s*[+-]?[\d.]+([eE][+-]?\d+)?\s*$"), F.col(f"`{n}`").try_cast("double"))).alias(f"d{i}"))]).first()
    kind = lambda i: "bigint" if counts[f"n{i}"] and counts[f"i{i}"] == counts[f"n{i}"] else "double" if counts[f"n{i}"] and counts[f"d{i}"] == counts[f"n{i}"] else "string"
    return rows.select(*[F.col(f"`{n}`").cast(kind(i)).alias(n) for i, n in enumerate(names)])


def _feather(spark: SparkSession, path: str) -> DataFrame:
    """A feather file: its columns' types are read from its end, its rows in the task that reads the file."""
    from pyspark.sql.pandas.types import from_arrow_schema

    with pa.memory_map(path) as f:
        schema = pa.ipc.open_file(f).schema

    def run(batches):
        for batch in batches:
            for content in batch.column(0).to_pylist():
                file = pa.ipc.open_file(pa.BufferReader(content))
                for i in range(file.num_record_batches):
                    yield file.get_batch(i)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, from_arrow_schema(schema))


def from_cells(cells: DataFrame, header: int = 0) -> DataFrame:
    """A table of cells (sheet, row, column, text) whose row `header` names the columns; columns without a name are numbered."""
    names = {r["column"]: r["text"] for r in cells.filter(F.col("row") == header).select("column", "text").collect()}
    width = cells.agg(F.max("column")).first()[0]
    columns = [names.get(i) or f"unnamed_{i}" for i in range((width if width is not None else -1) + 1)]
    wide = cells.filter(F.col("row") > header).groupBy("row").agg(*[F.max(F.when(F.col("column") == i, F.col("text"))).alias(f"c{i}") for i in range(len(columns))])
    from tallyloom.operators.tables import tidy_names

    return wide.orderBy("row").drop("row").toDF(*tidy_names(columns))


def read_all(spark: SparkSession, pattern: str, mark: str = "_source_file", **options) -> DataFrame:
    """All files of a pattern, one after the other, columns by name, with the file each row is from."""
    frames = [read_table(spark, f, **options).withColumn(mark, F.lit(os.path.basename(f))) for f in resolve(pattern)]
    if not frames:
        raise FileNotFoundError(pattern)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A table as csv, tsv, json, parquet or Markdown, by the path's suffix. Markdown is for reading: MARKDOWN_ROWS rows."""
    end = os.path.splitext(path)[1].lower()
    if end in (".csv", ".tsv"):
        df.write.mode(mode).option("header", True).csv(path, sep="\t" if end == ".tsv" else ",")
    elif end in (".json", ".jsonl"):
        df.write.mode(mode).json(path)
    elif end == ".parquet":
        df.write.mode(mode).parquet(path)
    elif end == ".md":
        with open(path, "w", encoding="utf-8") as f:
            f.write(markdown(df))
    else:
        raise ValueError(f"no writer for {end}")


def convert(spark: SparkSession, pattern: str, folder: str, end: str, mode: str = "errorifexists", **options) -> list[str]:
    """Every file of a pattern written into a folder with another suffix; the paths written. Names that two files share are numbered."""
    out, taken = [], {}
    for f in resolve(pattern):
        stem = os.path.splitext(os.path.basename(f))[0]
        taken[stem] = taken.get(stem, 0) + 1
        path = os.path.join(folder, f"{stem}{'' if taken[stem] == 1 else f'_{taken[stem] - 1}'}.{end.lstrip('.')}")
        write_table(read_table(spark, f, **options), path, mode)
        out.append(path)
    return out


def markdown(df: DataFrame, rows: int = MARKDOWN_ROWS) -> str:
    line = lambda xs: "| " + " | ".join("" if x is None else str(x).replace("|", "\\|").replace("\n", " ") for x in xs) + " |"
    return "\n".join([line(df.columns), line("---" for _ in df.columns), *map(line, df.limit(rows).collect())]) + "\n"
