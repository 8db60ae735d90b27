"""Operators on grids: DataFrames (r BIGINT, cells ARRAY<STRING>), a row per sheet row, ragged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions import cells
from gridloom.operators.tabular import q
from gridloom.sources import store


def cell(c: int) -> Column:
    """Cell c of the row; empty beyond its end."""
    return F.coalesce(F.get("cells", F.lit(c)), F.lit(""))


def grid_of(df: DataFrame, order: list[str] | None = None, header: bool = True) -> DataFrame:
    """A DataFrame as a grid: rows by `order`, else as they lie; the header is row 0. Rows are numbered without gathering
    them: each partition counts its own, and of the counts, one per partition, the sums before it are added."""
    values = F.array(*[F.coalesce(q(c).cast("string"), F.lit("")) for c in df.columns])
    rows = df.orderBy(*[q(o) for o in order]) if order else df
    rows, _ = store.kept(rows.select(values.alias("cells"), F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_id")))
    counts = dict(rows.groupBy("_part").count().collect())  # a row per partition
    before, starts = 1 if header else 0, []
    for part in sorted(counts):
        starts += [F.lit(part), F.lit(before)]
        before += counts[part]
    start = F.try_element_at(F.create_map(*starts), F.col("_part")) if starts else F.lit(0)
    grid = rows.select((F.col("_id").bitwiseAND((1 << 33) - 1) + start).cast("long").alias("r"), "cells")
    return df.sparkSession.createDataFrame([(0, list(df.columns))], "r long, cells array<string>").union(grid) if header else grid


def _by(grid: DataFrame) -> list[str]:
    """Windows go by sheet where there are several."""
    return ["source"] if "source" in grid.columns else []


def filled_down(rows: DataFrame, columns: list[str], by: list[str], block: int = 1 << 16) -> DataFrame:
    """Blanks of the columns take the last value above them, by r. Rows go in blocks of r, and what stands last in each
    block, one small row, is carried to the next ones, so no sheet is gathered in one task."""
    rows = rows.withColumn("_block", F.expr(f"r div {block}"))
    last = lambda c: F.last(F.nullif(F.col(c), F.lit("")), ignorenulls=True)
    inside = W.partitionBy(*by, "_block").orderBy("r").rowsBetween(W.unboundedPreceding, 0)
    ends = rows.groupBy(*by, "_block").agg(*[F.max_by(F.nullif(F.col(c), F.lit("")), F.when(F.col(c) != "", F.col("r"))).alias(f"_end_{i}") for i, c in enumerate(columns)])
    above = (W.partitionBy(*by) if by else W.partitionBy(F.lit(0))).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select(*by, "_block", *[F.last(f"_end_{i}", ignorenulls=True).over(above).alias(f"_above_{i}") for i in range(len(columns))])
    out = rows.withColumns({f"_in_{i}": last(c).over(inside) for i, c in enumerate(columns)}).join(carried, [*by, "_block"], "left")
    return out.withColumns({c: F.coalesce(f"_in_{i}", f"_above_{i}", F.lit("")) for i, c in enumerate(columns)}).drop("_block", *[f"_{k}_{i}" for k in ("in", "above") for i in range(len(columns))])


def row_features(grid: DataFrame) -> DataFrame:
    """(source if there is one, r, width, filled, fill_rate, numeric, dates, texts, datalike, entropy of the classes of filled
    cells, summary, title) of every row."""
    kinds = F.transform("cells", cells.cell_type)
    n = lambda k: F.size(F.filter("_k", lambda x: x == k))
    g = grid.withColumn("_k", kinds)
    width, numeric, dates, texts = F.size("cells"), n("numeric"), n("date"), n("text")
    filled = numeric + dates + texts
    late = F.size(F.filter(F.slice("_k", 3, 1 << 20), lambda x: x != "empty"))
    return g.select(
        *_by(grid), "r", width.alias("width"), filled.alias("filled"), F.coalesce(F.try_divide(filled, width), F.lit(0.0)).alias("fill_rate"), numeric.alias("numeric"), dates.alias("dates"), texts.alias("texts"),
        F.coalesce(F.try_divide(numeric + dates, filled), F.lit(0.0)).alias("datalike"), F.round(cells.entropy(F.array(numeric, dates, texts)), 9).alias("entropy"), cells.summary_row(F.col("cells")).alias("summary"), (filled.between(1, 2) & (late == 0) & (numeric == 0)).alias("title"),
    )


def column_profile(grid: DataFrame, top: int, bottom: int, sample: int = 1000) -> DataFrame:
    """Per column over its first `sample` non-empty cells in the window: n, numeric, dates, distinct, least and greatest integer."""
    by = _by(grid)
    body = grid.filter(F.col("r").between(top, bottom)).select(*by, "r", F.posexplode("cells").alias("c", "v")).filter(~cells.is_empty(F.col("v")))
    body = body.withColumn("_n", F.row_number().over(W.partitionBy(*by, "c").orderBy("r"))).filter(F.col("_n") <= sample)
    whole = F.when(cells.strip(F.col("v")).rlike(r"^-?\d{1,18}$"), cells.strip(F.col("v")).cast("long"))
    kind = cells.cell_type(F.col("v"))
    return body.groupBy(*by, "c").agg(
        F.count("*").alias("n"), F.count_if(kind == "numeric").alias("numeric"), F.count_if(kind == "date").alias("dates"), F.count_distinct("v").alias("distinct_values"), F.min(whole).alias("least"), F.max(whole).alias("greatest")
    )


def column_classes(grid: DataFrame, top: int, bottom: int) -> DataFrame:
    """Per column of the window: n rows, fill, share of numbers and dates among filled cells, and the entropy of the parse
    path's classes (empty, numeric, string)."""
    by = _by(grid)
    body = grid.filter(F.col("r").between(top, bottom))
    width = F.max(F.size("cells"))
    wide = body.groupBy(*by).agg(width.alias("_w"), F.count("*").alias("_n")) if by else body.agg(width.alias("_w"), F.count("*").alias("_n"))
    v = F.col("v")
    kind, plain = cells.cell_type(v), cells.classify(v)
    got = body.select(*by, "r", F.posexplode("cells").alias("c", "v")).groupBy(*by, "c").agg(
        F.count_if(kind.isin("numeric", "date")).alias("_data"), F.count_if(kind != "empty").alias("_some"), F.count_if(plain == "numeric").alias("_num"), F.count_if(plain == "string").alias("_str"))
    got = got.join(wide, by) if by else got.crossJoin(F.broadcast(wide))  # one row
    shares = F.array(F.col("_n") - F.col("_num") - F.col("_str"), F.col("_num"), F.col("_str"))
    return got.select(
        *by, "c", F.col("_n").alias("n"), F.round((F.col("_num") + F.col("_str")) / F.col("_n"), 9).alias("fill"),
        F.round(F.coalesce(F.try_divide("_data", "_some"), F.lit(0.0)), 9).alias("datalike"), F.round(cells.entropy(shares), 9).alias("entropy"),
    )


def strategy_rules(grid: DataFrame, head: int = 20) -> DataFrame:
    """Rule strategy -> a row per sheet (header, top, left_col, bottom, right_col): header is the first of the first rows
    filled over half, else 0; bottom the last row filled to 0.3 without a summary keyword."""
    by = _by(grid)
    f = row_features(grid)
    header = F.coalesce(F.min(F.when((F.col("r") < head) & (F.col("fill_rate") > 0.5), F.col("r"))), F.lit(0).cast("long"))
    bottom = F.max(F.when((F.col("fill_rate") >= 0.3) & ~F.col("summary"), F.col("r")))
    one = f.groupBy(*by).agg(header.alias("header"), bottom.alias("bottom"), F.max("width").alias("right_col"))
    return one.select(*by, "header", (F.col("header") + 1).alias("top"), F.lit(0).alias("left_col"), F.greatest(F.coalesce("bottom", F.lit(0)), F.col("header") + 1).alias("bottom"), "right_col")


def best_band(grid: DataFrame) -> DataFrame:
    """Window strategy's rows (top, bottom), per sheet: the run of rows whose centred moving average of fill is 0.4 or more
    with the greatest sum; the first on ties. The window is n // 4 rows, 1 to 5: all widths are averaged, n picks one."""
    by = _by(grid)
    f = row_features(grid).select(*by, "r", "fill_rate")
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    order = group.orderBy("r")
    half = F.expr("least(5, greatest(1, _n div 4)) div 2")
    smooth = f.withColumn("_n", F.count("*").over(group)).withColumns({f"_a{h}": F.avg("fill_rate").over(order.rowsBetween(-h, h)) for h in range(3)})
    smooth = smooth.withColumn("avg", F.when(half == 0, F.col("_a0")).when(half == 1, F.col("_a1")).otherwise(F.col("_a2")))
    runs = smooth.withColumn("on", F.col("avg") >= 0.4).withColumn("island", F.sum(F.when(F.col("on"), 0).otherwise(1)).over(order))
    found = runs.filter("on").groupBy(*by, "island").agg(F.min("r").alias("top"), F.max("r").alias("bottom"), F.sum("avg").alias("score"))
    best = found.groupBy(*by).agg(F.max(F.struct("score", (-F.col("top")).alias("first"), "bottom")).alias("b"))
    return best.select(*by, (-F.col("b.first")).alias("top"), F.col("b.bottom").alias("bottom"), F.round("b.score", 6).alias("score"))


def window(grid: DataFrame, top: int, bottom: int, left: int, right: int) -> DataFrame:
    """(r, cells) of a window: bottom inclusive, right exclusive; every row has right - left cells."""
    return grid.filter(F.col("r").between(top, bottom)).select(*_by(grid), "r", F.array(*[cell(c) for c in range(left, right)]).alias("cells"))


def clean_region(grid: DataFrame, top: int, bottom: int, left: int, right: int, names: list[str], drop_summary: bool = True) -> DataFrame:
    """The window's rows as columns: cells cleaned, blank, summary and repeated rows dropped (the first stays), with r."""
    rows = window(grid, top, bottom, left, right)
    if drop_summary:
        rows = rows.filter(~cells.summary_row(F.col("cells")))
    by = _by(grid)
    rows = rows.select(*by, "r", F.transform("cells", cells.clean_cell).alias("cells")).filter(F.exists("cells", lambda x: x != ""))
    rows = rows.groupBy(*by, "cells").agg(F.min("r").alias("r"))
    return rows.select(*by, "r", *[F.col("cells")[i].alias(n) for i, n in enumerate(names)])


def to_long(grid: DataFrame, top: int, bottom: int, left: int, right: int, stub_end: int, labels: list[str], value_name: str = "value", ffill_stub: bool = True, dropna: bool = False) -> DataFrame:
    """Rows to (r, stub_1..n, variable, value): blank and summary rows go, stubs are filled down over kept rows."""
    by = _by(grid)
    rows = window(grid, top, bottom, left, right).filter(~cells.summary_row(F.col("cells")))
    rows = rows.select(*by, "r", F.transform("cells", cells.clean_cell).alias("cells")).filter(F.exists("cells", lambda x: x != ""))
    stubs = [f"stub_{i + 1}" for i in range(stub_end - left)]
    rows = rows.withColumns({n: F.col("cells")[i] for i, n in enumerate(stubs)})
    if ffill_stub and stubs:
        rows = filled_down(rows, stubs, by)
    pairs = F.array(*[F.struct(F.lit(name).alias("variable"), F.col("cells")[stub_end - left + i].alias(value_name)) for i, name in enumerate(labels)])
    out = rows.select(*by, "r", *stubs, F.explode(pairs).alias("e")).select(*by, "r", *stubs, "e.*")
    return out.filter(F.col(value_name) != "") if dropna else out
