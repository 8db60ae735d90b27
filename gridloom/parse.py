"""The parse path: one file to one trimmed table with its header, by the detected region or by given bounds."""

from __future__ import annotations

import logging
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import cells
from gridloom.operators import areas, grid
from gridloom.operators import detect as D
from gridloom.operators.model import distinct_names
from gridloom.sources import csvgrid, files, store, xlsx

log = logging.getLogger("gridloom")


def cleaned(rows: DataFrame, custom: list[str] | None = None) -> DataFrame:
    """Blank cells and those that read as null become null."""
    return rows.withColumn("cells", F.transform("cells", lambda c: cells.nan_like_to_null(c, custom)))


def _rectangular(rows: DataFrame) -> DataFrame:
    """Lines with more fields than the first are dropped and blank lines are skipped, as a strict reader does; rows are
    numbered anew."""
    lines = rows.filter(F.size("cells") > 0)
    first = lines.orderBy("r").limit(1).select(F.size("cells").alias("_w"))
    kept = lines.join(F.broadcast(first), F.size("cells") <= F.col("_w")).drop("_w")  # one row
    kept, _ = store.kept(kept.select("r", "cells"))
    # a line's new number: how many kept lines stand before its block, and before it within the block
    block = F.expr("r div 65536")
    counts = dict(kept.groupBy(block.alias("b")).count().collect())  # a row per block of lines
    before, starts = 0, []
    for b in sorted(counts):
        starts += [F.lit(b), F.lit(before)]
        before += counts[b]
    place = F.row_number().over(grid.W.partitionBy(block).orderBy("r")) - 1
    return kept.select((F.try_element_at(F.create_map(*starts), block) + place).cast("long").alias("r"), "cells") if starts else kept


def trim_grid(rows: DataFrame, trim: bool | str | dict = "auto", set_header: bool = True, header_row: int | None = None) -> tuple[DataFrame, dict[str, Any]]:
    """rows (r, cells) trimmed and named, and what was done.

    trim: "auto" takes the first detected table, else the robust area; a dict bounds top, bottom, left and right, ends
    exclusive; False trims nothing. header_row is a row of the whole grid; without one the detected header is taken, or
    the row after the last comment row. Names that lack are Col_i, repeated ones are told apart.
    """
    high, wide = rows.agg(F.coalesce(F.max("r") + 1, F.lit(0)), F.coalesce(F.max(F.size("cells")), F.lit(0))).first()
    sheet = rows.withColumn("source", F.lit("grid"))
    top, left, bottom, right = 0, 0, high, wide
    header, method = None, "legacy"
    if trim == "auto":
        found = D.detect(sheet).orderBy("table_no").first()
        if found:
            header, method = found.header, "ensemble"
            top, left, bottom, right = found.top, found.left_col, min(found.bottom + 1, high), min(found.right_col, wide)
        else:
            a = areas.find(sheet).first()
            top, left, bottom, right = (a.top, a.left_col, a.bottom, a.right_col) if a else areas.NONE
    elif isinstance(trim, dict):
        top, bottom, left, right = trim.get("top", 0), trim.get("bottom", high), trim.get("left", 0), trim.get("right", wide)
    elif trim is not False:
        raise ValueError("trim is 'auto', False or a dict of bounds")
    body = top
    if set_header and bottom > top:
        if header_row is not None:
            header = header_row if top <= header_row < bottom else None
        elif method != "ensemble":
            head = rows.filter(F.col("r").between(top, min(bottom, top + areas.HEAD + 1) - 1)).orderBy("r").collect()  # a bounded head
            frame = areas.Frame([[*x.cells, *[None] * (wide - len(x.cells))][left:right] for x in head])
            end = areas.header_end(frame.kind)
            header = top + end + 1 if end >= 0 and top + end + 1 < bottom else None
        elif header < 0:
            header = None
        body = header + 1 if header is not None and header >= top else top
    names = [f"Col_{i}" for i in range(right - left)]
    if set_header and header is not None:
        row = rows.filter(F.col("r") == header).first()
        got = [*(row.cells if row else []), *[None] * wide][left:right]
        names = [n if n else f"Col_{i}" for i, n in enumerate(got)]
    columns = [F.get("cells", F.lit(c)).alias(f"c{i}") for i, c in enumerate(range(left, right))]
    table = rows.filter(F.col("r").between(body, bottom - 1)).select("r", *columns)
    out = table.orderBy("r").select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(distinct_names(names))])
    about = {"original_shape": (high, wide), "trimmed_shape": (max(0, bottom - body), right - left), "top": top, "bottom": bottom, "left": left, "right": right, "header_row_abs": header, "detection_method": method}
    return out, about


def parse_with_info(spark: SparkSession, path: str, trim: bool | str | dict = "auto", is_header: bool | int = True, delimiter: str | None = None, sheet_name: str | int | None = None, encoding: str = "auto") -> tuple[DataFrame, dict[str, Any]]:
    kind = files.ending(path)
    if kind not in files.TEXT + files.BOOKS:
        raise ValueError(f"Unsupported file type: {path}")
    about: dict[str, Any] = {}
    content = files.contents(spark, path)
    if kind in files.BOOKS:
        book = xlsx.Workbook(bytes(content.first().content))
        about["detected_sheet"] = book.strictly(sheet_name) if sheet_name is not None else book.chosen()
        rows = xlsx.parsed(content, about["detected_sheet"], fill_merged=True).select("r", "cells")
        rows, _ = store.kept(cleaned(rows))
    else:
        rows = cleaned(_rectangular(csvgrid.parsed(content, delimiter, None if encoding == "auto" else encoding)))
    header = None if isinstance(is_header, bool) else int(is_header)
    df, info = trim_grid(rows, trim, is_header is not False, header)
    return df, about | info


def parse(spark: SparkSession, path: str, trim: bool | str | dict = "auto", is_header: bool | int = True, delimiter: str | None = None, sheet_name: str | int | None = None, encoding: str = "auto", verbose: bool = False) -> DataFrame:
    """The table of a .csv, .tsv or .xlsx file. is_header: True finds the header row, a number is its row, False gives names
    Col_i. Without a sheet the one that is chosen is read, merged cells filled."""
    df, info = parse_with_info(spark, path, trim, is_header, delimiter, sheet_name, encoding)
    if verbose:
        for k, v in info.items():
            log.info("%s: %s", k, v)
    return df
