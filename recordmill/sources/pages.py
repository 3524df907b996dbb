"""Stored web pages and their parts as nested columns."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from recordmill.functions.html import TABLE_FIELDS, page_parts

PAGES_AT_ONCE = 256  # parsed pages held in Python before they go back to Spark

PARTS = {
    "links": "array<struct<pos:int,href:string,text:string,cell_day:string,row_day:string,near_day:string>>",
    "days": "array<string>",
    "times": "array<struct<rank:int,text:string>>",
}
TABLE = dict(zip(TABLE_FIELDS, (
    "int", "boolean", "string", "string", "array<array<string>>", "array<struct<row_no:int,cell_no:int,rowspan:int,colspan:int>>",
    "array<array<string>>"), strict=True))


def scan_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page markup keyed by address."""
    return spark.read.parquet(path).select("url", "html")


def read_parts(pages: DataFrame, *parts: str, candidates_only: bool = False, fields: tuple[str, ...] = TABLE_FIELDS) -> DataFrame:
    """``pages`` with the markup replaced by the asked parts of each page.

    One Arrow pass without a shuffle; only asked parts are built and carried. With
    ``candidates_only`` tables of a marked class hide the page's other tables. Of a table only ``fields`` are built.
    """
    kinds = {**PARTS, "tables": f"array<struct<{','.join(f'{f}:{TABLE[f]}' for f in fields)}>>"}
    keep = [f for f in pages.schema.fields if f.name != "html"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + [f"{p} {kinds[p]}" for p in parts])
    names = [f.name for f in keep]
    types = {p: _arrow(kinds[p]) for p in parts}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, PAGES_AT_ONCE):
                batch = whole.slice(start, PAGES_AT_ONCE)
                built: dict[str, list] = {p: [] for p in parts}
                for markup in batch.column("html").to_pylist():
                    for part, value in page_parts(markup or "", parts, candidates_only, fields).items():
                        built[part].append(value)
                columns = [batch.column(n) for n in names] + [pa.array(built[p], types[p]) for p in parts]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, *parts])

    return pages.select(*names, "html").mapInArrow(run, schema)


def _arrow(ddl: str) -> pa.DataType:
    return to_arrow_type(T.DataType.fromDDL(ddl))
