"""XLSX sheets as a Spark data source, with nothing but the standard library.

    spark.dataSource.register(WorkbookSource)
    spark.read.format("workbook").option("sheet", "2-1").load(path)

gives (row_idx, col_idx, value) of all cells that hold something. A workbook is
one zip file, so one task reads it.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Sheets that hold the registered population, in order of preference.
PREFERRED = ("인구상세", "2-1")


def column_number(reference: str) -> int:
    """0 for A, 26 for AA."""
    total = 0
    for letter in re.match("[A-Z]*", reference)[0]:
        total = total * 26 + ord(letter) - 64
    return total - 1


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))


def sheets(book: zipfile.ZipFile) -> dict[str, str]:
    """Sheet names and their parts, in order."""
    links = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    part = lambda target: target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join("xl", target))
    return {s.get("name"): part(links[s.get(_LINK)]) for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")}


def choose_sheet(names: list[str], wanted: str | None) -> str:
    """The named sheet, else the preferred, else the first; ValueError where there is none."""
    if wanted and wanted in names:
        return wanted
    for hint in PREFERRED:
        for name in names:
            if hint in name:
                return name
    if not names:
        raise ValueError("the workbook has no sheet")
    return names[0]


def cells(data: bytes, sheet: str | None = None) -> Iterator[tuple[int, int, str]]:
    """Row from 1, column from 0, and text of every cell that holds something."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        found = sheets(book)
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = [_text(x) for x in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        for at, row in enumerate(ElementTree.fromstring(book.read(found[choose_sheet(list(found), sheet)])).iter(f"{_MAIN}row"), 1):
            for place, cell in enumerate(row.iter(f"{_MAIN}c")):
                kind, value = cell.get("t"), cell.find(f"{_MAIN}v")
                if kind == "inlineStr":
                    text = _text(cell)
                elif value is None or value.text is None:
                    continue
                elif kind == "s":
                    text = shared[int(value.text)]
                elif kind == "b":
                    text = "true" if value.text == "1" else "false"
                else:
                    text = value.text
                reference = cell.get("r")
                yield int(row.get("r") or at), column_number(reference) if reference else place, text


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.sheet = options["path"], options.get("sheet")

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        with open(self.path, "rb") as file:
            yield from cells(file.read(), self.sheet)


class WorkbookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return "row_idx int, col_idx int, value string"

    def reader(self, schema):
        return _Reader(self.options)


def read_workbook(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """Cells of a workbook in any file system that Spark reads (the file's bytes are a row of the binary source)."""

    def parse(batches):
        import pandas as pd

        for batch in batches:
            for data in batch["content"]:
                yield pd.DataFrame(cells(data, sheet), columns=["row_idx", "col_idx", "value"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, "row_idx int, col_idx int, value string")


def write_workbook(path: str, contents: dict[str, list[list[str | None]]]) -> None:
    """Sheets of texts as a workbook, for reports: cells are inline strings, those that repeat shared ones; None leaves a cell out."""
    from xml.sax.saxutils import escape, quoteattr

    main, office = _MAIN[1:-1], _LINK[1:].split("}")[0]
    texts = [x for rows in contents.values() for row in rows for x in row if x is not None]
    shared = sorted({x for x in texts if texts.count(x) > 1}) if len(texts) < 10_000 else []
    place = {x: k for k, x in enumerate(shared)}

    def letters(k: int) -> str:
        return (letters(k // 26 - 1) if k >= 26 else "") + chr(65 + k % 26)

    def cell(reference: str, text: str) -> str:
        if text in place:
            return f'<c r="{reference}" t="s"><v>{place[text]}</v></c>'
        return f'<c r="{reference}" t="inlineStr"><is><t>{escape(text)}</t></is></c>'

    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        listed = "".join(f'<sheet name={quoteattr(n)} sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(contents, 1))
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets>{listed}</sheets></workbook>')
        links = "".join(f'<Relationship Id="r{k}" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(contents) + 1))
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">' + "".join(f"<si><t>{escape(x)}</t></si>" for x in shared) + "</sst>")
        for k, rows in enumerate(contents.values(), 1):
            body = "".join(f'<row r="{n}">' + "".join(cell(f"{letters(c)}{n}", x) for c, x in enumerate(row) if x is not None) + "</row>" for n, row in enumerate(rows, 1))
            book.writestr(f"xl/worksheets/sheet{k}.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')


#: Headings of the columns, without blanks.
NAME_HEADS, POPULATION_HEADS, SUB_HEADS = ("구분", "지역", "행정동"), ("총인구", "총계", "전체"), ("계", "소계", "총계")


def population_sheet(found: DataFrame) -> DataFrame:
    """Cells to (row_idx, name, population, senior): columns are found by their headings in one of the first 40 rows; ValueError where there is none."""
    head = F.regexp_replace("value", r"\s+", "")
    role = F.when(head.isin(*NAME_HEADS), "name").when(head.isin(*POPULATION_HEADS), "population").when(head.startswith("65세이상") & head.contains("총인구"), "senior")
    named = found.where("row_idx <= 40").select("row_idx", "col_idx", head.alias("head"), role.alias("role"))
    places = named.where("role is not null").groupBy("row_idx", "role").agg(F.min("col_idx").alias("c"))
    top = places.groupBy("row_idx").agg(F.count("*").alias("n")).where("n = 3").agg(F.min("row_idx")).first()[0]
    if top is None:
        raise ValueError("no row has headings for name, population and senior population")
    at = {r["role"]: r["c"] for r in places.where(F.col("row_idx") == top).collect()}  # three rows
    sub = named.where((F.col("row_idx") == top + 1) & F.col("col_idx").isin(at["population"], at["senior"]) & F.col("head").isin(*SUB_HEADS))
    last = top if sub.isEmpty() else top + 1
    value = lambda r: F.max(F.when(F.col("col_idx") == at[r], F.col("value"))).alias(r)
    return found.where(F.col("row_idx") > last).groupBy("row_idx").agg(*(value(r) for r in ("name", "population", "senior")))
