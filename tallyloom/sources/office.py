"""Workbooks and text documents of the Open XML formats as Python data sources, with the standard library only."""

from __future__ import annotations

import glob
import os
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# The namespaces of the formats.
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


class File(InputPartition):
    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.path = path


def _files(options: dict) -> list[str]:
    path = options["path"].removeprefix("file:")
    return sorted(glob.glob(os.path.join(path, "*"))) if os.path.isdir(path) else sorted(glob.glob(path))


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref).group():
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_names(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part) of a workbook's sheets in order."""
    rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{S}sheet"):
        target = rels[s.get(f"{R}id")].lstrip("/")
        out.append((s.get("name"), target if target.startswith("xl/") else f"xl/{target}"))
    return out


def cells(path: str, sheet: str = "") -> Iterator[tuple[str, str, int, int, str]]:
    """(path, sheet, row, column, text) of all cells that hold something; rows and columns from 0."""
    with zipfile.ZipFile(path) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{S}t")) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{S}si")]
        for i, (name, part) in enumerate(sheet_names(book)):
            if sheet and sheet != name and sheet != str(i):
                continue
            with book.open(part) as f:
                for _, row in ElementTree.iterparse(f):
                    if row.tag != f"{S}row":
                        continue
                    for c in row.iter(f"{S}c"):
                        kind, value = c.get("t"), c.findtext(f"{S}v")
                        text = "".join(t.text or "" for t in c.iter(f"{S}t")) if kind == "inlineStr" else shared[int(value)] if kind == "s" and value else value
                        if text is not None:
                            yield path, name, int(row.get("r")) - 1, _column(c.get("r")), text
                    row.clear()


def blocks(path: str) -> Iterator[tuple[str, int, str, int, str]]:
    """(path, pos, kind, level, text) of a document's paragraphs and table rows in their order; level is that of headings."""
    with zipfile.ZipFile(path) as doc:
        body = ElementTree.fromstring(doc.read("word/document.xml")).find(f"{W}body")
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{W}t"))
    pos = 0
    for e in body:
        if e.tag == f"{W}p":
            style = e.find(f"{W}pPr/{W}pStyle")
            level = int(m.group(1)) if style is not None and (m := re.search(r"(?:heading|标题)\s*(\d)", style.get(f"{W}val", ""), re.I)) else 0
            yield path, pos, "heading" if level else "list" if e.find(f"{W}pPr/{W}numPr") is not None else "paragraph", level, text(e)
            pos += 1
        elif e.tag == f"{W}tbl":
            for row in e.iter(f"{W}tr"):
                parts = [text(c).strip() for c in row.iter(f"{W}tc")]
                # a label and the value beside it read as one line
                yield path, pos, "row", 0, f"{parts[0].rstrip(':：')}：{parts[1]}" if len(parts) == 2 and parts[0] and parts[1] else "\t".join(parts)
                pos += 1


class _Reader(DataSourceReader):
    def __init__(self, options: dict, rows) -> None:
        self.options, self.rows = options, rows

    def partitions(self) -> list[File]:
        return [File(p) for p in _files(self.options)]

    def read(self, partition: File):
        return self.rows(partition.path)


class Workbook(DataSource):
    """spark.read.format("tallyloom_workbook").load(path): the cells of workbooks, a task a file; option `sheet` is a name or number."""

    @classmethod
    def name(cls) -> str:
        return "tallyloom_workbook"

    def schema(self) -> str:
        return "path string, sheet string, row int, column int, text string"

    def reader(self, schema) -> DataSourceReader:
        sheet = self.options.get("sheet", "")
        return _Reader(dict(self.options), lambda p: cells(p, sheet))


class Document(DataSource):
    """spark.read.format("tallyloom_document").load(path): paragraphs and table rows of documents, a task a file."""

    @classmethod
    def name(cls) -> str:
        return "tallyloom_document"

    def schema(self) -> str:
        return "path string, pos int, kind string, level int, text string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options), blocks)
