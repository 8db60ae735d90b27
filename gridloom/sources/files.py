"""Files of any kind that is known, as (source, r, cells)."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.sources import csvgrid, xlsx

TEXT, BOOKS = (".csv", ".tsv"), (".xlsx",)


def ending(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return "." + name.rsplit(".", 1)[1].lower() if "." in name else ""


def contents(spark: SparkSession, path: str) -> DataFrame:
    """(source, content) of a file, or of all files of known kinds in a folder."""
    kinds = TEXT + BOOKS
    if ending(path) and ending(path) not in kinds:
        raise ValueError(f"Unsupported file type: {path}")
    files = spark.read.format("binaryFile")
    if not ending(path):
        files = files.option("pathGlobFilter", "*.{" + ",".join(k[1:] for k in kinds) + "}")
    return files.load(path).selectExpr("path as source", "content")


def read(spark: SparkSession, path: str, sheet: str | int | None = None, delimiter: str | None = None) -> DataFrame:
    """(source, r, cells); of each workbook the sheet asked for, else the one that is chosen."""
    text, books = _by_kind(spark, path)
    parts = [f.mapInArrow(run, csvgrid.GRID) for f, run in ((text, csvgrid.grids(delimiter)), (books, xlsx.grids(sheet))) if f is not None]
    return parts[0].union(parts[1]) if len(parts) > 1 else parts[0]


def _by_kind(spark: SparkSession, path: str) -> tuple[DataFrame | None, DataFrame | None]:
    """Text files and workbooks, None where the path can't hold any."""
    found, kind = contents(spark, path), ending(path)
    if kind:
        return (found, None) if kind in TEXT else (None, found)
    book = F.lower("source").rlike(r"\.xlsx$")
    return found.filter(~book), found.filter(book)


def coded(spark: SparkSession, path: str, sheet: str | int | None = None) -> DataFrame:
    """(source, r, width, cells, codes) of all files, decoded and coded in one pass, blank rows left out (see
    detect.coded_rows)."""
    from gridloom.operators.detect import CODED, code_batches

    text, books = _by_kind(spark, path)
    runs = ((text, csvgrid.grids(blanks=False)), (books, xlsx.grids(sheet)))
    parts = [f.mapInArrow(lambda batches, run=run: code_batches(run(batches)), CODED) for f, run in runs if f is not None]
    return parts[0].union(parts[1]) if len(parts) > 1 else parts[0]


def fingerprints(files: DataFrame) -> DataFrame:
    """files (source, content) -> (source, bytes, sha256, rows, cols, encoding, delimiter, read_error)."""
    kinds = {"source": pa.string(), "bytes": pa.int64(), "sha256": pa.string(), "rows": pa.int64(), "cols": pa.int64(), "encoding": pa.string(), "delimiter": pa.string(), "read_error": pa.string()}

    def about(source: str, content: bytes) -> tuple:
        start = (source, len(content), hashlib.sha256(content).hexdigest())
        try:
            if ending(source) in BOOKS:
                book = xlsx.Workbook(content)
                rows = list(book.grid(book.chosen())) if book.names else []
                return (*start, max((r for r, _ in rows), default=-1) + 1, max((len(c) for _, c in rows), default=0), None, None, None)
            encoding, text = csvgrid.decoded(content)
            delimiter = csvgrid.guess_delimiter(text)
            widths = [len(r) for r in csvgrid.rows(text, delimiter)]
            return (*start, len(widths), max(widths, default=0), encoding, delimiter, None)
        except Exception as e:  # a file that can't be read is reported, not raised
            return (*start, None, None, None, None, f"{type(e).__name__}: {e}")

    def run(batches):
        for x in batches:
            rows = [about(s, c.as_py() or b"") for s, c in zip(x.column(0).to_pylist(), x.column(1), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)] if rows else [pa.array([], k) for k in kinds.values()], names=list(kinds))

    sql = ", ".join(f"{n} {'long' if k == pa.int64() else 'string'}" for n, k in kinds.items())
    return files.select("source", "content").mapInArrow(run, sql)
