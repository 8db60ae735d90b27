"""Ragged text grids: files as (source, r, cells), decoded and split in Python workers, one file per row of the scan."""

from __future__ import annotations

import csv
import io
import re
import sys
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gridloom.functions.constants import GRID_DELIMITERS

ENCODINGS = ("utf-8-sig", "utf-8", "cp949", "latin-1")
GRID, ROWS = "source string, r long, cells array<string>", 10_000
_KIND = pa.schema([("source", pa.string()), ("r", pa.int64()), ("cells", pa.list_(pa.string()))])


def decoded(content: bytes) -> tuple[str, str]:
    """The first encoding that fits, and the text."""
    for name in ENCODINGS[:-1]:
        try:
            return name, content.decode(name)
        except UnicodeDecodeError:
            continue
    return ENCODINGS[-1], content.decode(ENCODINGS[-1])


def decode(content: bytes) -> str:
    return decoded(content)[1]


def _splits_alike(lines: list[str], pattern: str) -> bool:
    """Three lines or more, most of which (80 %) split into the same number of fields, two at least."""
    if len(lines) < 3:
        return False
    n, times = Counter(len(re.split(pattern, x.strip())) for x in lines).most_common(1)[0]
    return n >= 2 and times >= 0.8 * len(lines)


def guess_delimiter(text: str) -> str:
    """The commonest of , ; tab | in the first five lines; without any, `::` or runs of blanks; else a comma."""
    head = "\n".join(text.strip().split("\n")[:5])
    counts = [head.count(d) for d in GRID_DELIMITERS]
    if max(counts):
        return GRID_DELIMITERS[counts.index(max(counts))]
    lines = [x for x in text.split("\n") if x.strip()][:20]
    return next((p for p in ("::", r"\s{2,}") if _splits_alike(lines, p)), ",")


def rows(text: str, delimiter: str | None = None) -> Iterator[list[str]]:
    delimiter = delimiter or guess_delimiter(text)
    if delimiter in GRID_DELIMITERS:
        csv.field_size_limit(sys.maxsize)  # cells of any length
        return csv.reader(io.StringIO(text, newline=""), delimiter=delimiter)
    return (re.split(delimiter, x.strip()) if x.strip() else [] for x in text.split("\n"))


def batches_of(source: str, found: Iterator[tuple[int, list[str]]], blanks: bool = True) -> Iterator[pa.RecordBatch]:
    """Record batches of (row, cells); without blanks, rows of empty cells go but for the last one and any that is wider
    than all before."""
    last, wide, part, held = -1, 0, [], None

    def out():
        ends = pa.array(list(accumulate((len(x) for _, x in part), initial=0)), pa.int32())
        cells = pa.ListArray.from_arrays(ends, pa.array(list(chain.from_iterable(x for _, x in part)), pa.string()))
        return pa.RecordBatch.from_arrays([pa.array([source] * len(part), pa.string()), pa.array([r for r, _ in part], pa.int64()), cells], schema=_KIND)

    for r, cells in found:
        last = r
        if not blanks and not any(cells) and len(cells) <= wide:
            held = cells
            continue
        held, wide = None, max(wide, len(cells))
        part.append((r, cells))
        if len(part) >= ROWS:
            yield out()
            part = []
    if held is not None:
        part.append((last, held))
    if part:
        yield out()


def grids(delimiter: str | None = None, encoding: str | None = None, blanks: bool = True):
    """A mapInArrow function over (source, content): (source, r, cells). A file is decoded in one task; its rows leave it in
    batches."""

    def run(batches):
        for x in batches:
            for source, content in zip(x.column(0).to_pylist(), x.column(1), strict=True):
                raw = content.as_py() or b""
                yield from batches_of(source, enumerate(rows(raw.decode(encoding) if encoding else decode(raw), delimiter)), blanks)

    return run


def parsed(files: DataFrame, delimiter: str | None = None, encoding: str | None = None) -> DataFrame:
    """files (source, content binary) -> (source, r, cells), r from 0."""
    return files.select("source", "content").mapInArrow(grids(delimiter, encoding), GRID)


def read(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    if not path.lower().rstrip("/").endswith((".csv", ".tsv")) and "." in path.rsplit("/", 1)[-1]:
        raise ValueError(f"Unsupported file type: {path}")
    return parsed(spark.read.format("binaryFile").load(path).selectExpr("path as source", "content"), delimiter)
