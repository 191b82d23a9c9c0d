"""Sheets of xlsx workbooks, a file to a task. A workbook is a zip archive of XML: no library is needed."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# XML namespaces of the format.
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def rows_of(content: bytes, sheet: str | None = None) -> Iterator[list[str | None]]:
    """The rows of a sheet (the first, if none is named) as texts; empty cells are None."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{_MAIN}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        sheets = [*ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")]
        chosen = next((s for s in sheets if sheet in (None, s.get("name"))), None)
        if chosen is None:
            raise ValueError(f"no sheet {sheet!r}")
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        target = links[chosen.get(_LINK)]
        with z.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{_MAIN}row":
                    continue
                out: list[str | None] = []
                for cell in row.iter(f"{_MAIN}c"):
                    letters = "".join(c for c in cell.get("r", "") if c.isalpha())
                    column = 0
                    for c in letters:
                        column = 26 * column + ord(c.upper()) - 64
                    out += [None] * (column - 1 - len(out))
                    kind, value = cell.get("t"), cell.find(f"{_MAIN}v")
                    if kind == "inlineStr":
                        out.append("".join(t.text or "" for t in cell.iter(f"{_MAIN}t")))
                    elif value is None or value.text is None:
                        out.append(None)
                    else:
                        out.append(shared[int(value.text)] if kind == "s" else value.text)
                yield out
                row.clear()


def read_sheet(spark: SparkSession, path: str, schema: str, sheet: str | None = None) -> DataFrame:
    """Rows of a sheet below its header, from one or many workbooks, as the schema's columns by name.
    What cannot be read as a column's type is null; times are the format's day numbers or texts."""
    fields = spark.createDataFrame([], schema).schema.fields
    names = [f.name for f in fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows = rows_of(content, sheet)
                head = {name: i for i, name in enumerate(next(rows, [])) if name is not None}
                while chunk := [r for _, r in zip(range(5000), rows)]:
                    yield pd.DataFrame({n: [r[head[n]] if n in head and head[n] < len(r) else None for r in chunk] for n in names}, dtype=object)

    texts = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, ", ".join(f"`{n}` string" for n in names))

    def typed(f):
        text, kind = F.col(f"`{f.name}`"), f.dataType.simpleString()
        if kind == "timestamp":
            day = F.expr(f"try_cast(`{f.name}` as double)")
            return F.coalesce(F.timestamp_seconds(F.round((day - 25569) * 86400)), F.expr(f"try_cast(`{f.name}` as timestamp)"))
        if kind in ("int", "bigint"):
            return F.expr(f"cast(try_cast(`{f.name}` as double) as {kind})")
        return text if kind == "string" else F.expr(f"try_cast(`{f.name}` as {kind})")

    return texts.select(*[typed(f).alias(f.name) for f in fields])


def day_number(when: datetime) -> float:
    """A time as the format's number of days."""
    return (when - datetime(1899, 12, 30)) / timedelta(days=1)
