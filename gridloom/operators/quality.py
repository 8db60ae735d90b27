"""Data-quality profile and scores of one table against another."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions import cells
from gridloom.operators import detect as D
from gridloom.operators.detect import Region, Sheet
from gridloom.operators.tabular import q


def profile(df: DataFrame) -> DataFrame:
    """Per column: rows, missing cells, distinct values, numeric cells, cells that a spreadsheet would run as a formula."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), q(c).cast("string").alias("v")) for c in df.columns])).alias("e")).select("e.*")
    v = F.col("v")
    return long.groupBy("column").agg(
        F.count("*").alias("n"), F.count_if(cells.is_empty(v)).alias("missing"), F.count_distinct("v").alias("distinct_values"), F.count_if(cells.is_numeric(v)).alias("numeric"),
        F.count_if(v.rlike(r"^[=+@\-\t\r\n]") & ~cells.is_numeric(v)).alias("injections"),
    )


def bag_scores(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Precision, recall and F1 of rows as bags; columns are paired by name, nulls equal nulls."""
    keys = predicted.columns
    a, b = predicted.groupBy(*[q(k) for k in keys]).agg(F.count("*").alias("_n")), truth.groupBy(*[q(k) for k in keys]).agg(F.count("*").alias("_m"))
    both = a.select(*keys, "_n", F.lit(0).cast("long").alias("_m")).union(b.select(*keys, F.lit(0).cast("long"), "_m")).groupBy(*[q(k) for k in keys]).agg(F.sum("_n").alias("_n"), F.sum("_m").alias("_m"))
    one = both.agg(F.coalesce(F.sum(F.least("_n", "_m")), F.lit(0)).alias("hits"), F.sum("_n").alias("p"), F.sum("_m").alias("t"))
    rate = lambda x, y: F.round(F.coalesce(F.try_divide(x, y), F.lit(0.0)), 6)
    return one.select("hits", rate(F.col("hits"), F.col("p")).alias("precision"), rate(F.col("hits"), F.col("t")).alias("recall"), rate(2 * F.col("hits"), F.col("p") + F.col("t")).alias("f1"))


def region_iou(a: tuple[int, int, int, int], b: tuple[int, int, int, int]) -> float:
    """Intersection over union of (top, left, bottom inclusive, right exclusive)."""
    height, width = min(a[2], b[2]) - max(a[0], b[0]) + 1, min(a[3], b[3]) - max(a[1], b[1])
    both = max(0, height) * max(0, width)
    area = lambda x: (x[2] - x[0] + 1) * (x[3] - x[1])
    union = area(a) + area(b) - both
    return both / union if union else 0.0


def header_accuracy(found: int, true: int) -> float:
    return 1 / (1 + abs(found - true))


def matched(found: list[Region], truth: list[Region]) -> tuple[float, float]:
    """Mean overlap and header accuracy of the truth's tables, each with the table found that overlaps it most and isn't
    taken yet; a table without one counts 0."""
    if not found or not truth:
        return (float(not found and not truth),) * 2
    left, ious, heads = list(found), [], []
    for t in truth:
        near = max(left, key=lambda f: region_iou(_box(f), _box(t)), default=None)
        iou = region_iou(_box(near), _box(t)) if near else 0.0
        ious.append(iou)
        heads.append(header_accuracy(near.header, t.header) if iou else 0.0)
        if iou:
            left.remove(near)
    return sum(ious) / len(ious), sum(heads) / len(heads)


def _box(r: Region) -> tuple[int, int, int, int]:
    return r.top, r.left, r.bottom, r.right


def _spans(regions: list[Region]) -> list[tuple[int, int]]:
    """Disjoint spans (first, end) of the regions' rows, header rows included."""
    out: list[tuple[int, int]] = []
    for a, b in sorted([(r.top, r.bottom + 1) for r in regions] + [(r.header, r.header + 1) for r in regions if r.header >= 0]):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _size(spans: list[tuple[int, int]], upto: int | None = None) -> int:
    return sum(max(0, (b if upto is None else min(b, upto)) - a) for a, b in spans)


def _both(x: list[tuple[int, int]], y: list[tuple[int, int]]) -> list[tuple[int, int]]:
    return [(max(a, c), min(b, d)) for a, b in x for c, d in y if max(a, c) < min(b, d)]


SCORES = ("header_accuracy", "boundary_iou", "noise_removal", "data_preservation", "cleaning_quality")
#: Off the overlap for each table too many or too few.
COUNT_PENALTY = 0.05


def compute_scores(found: list[Region], truth: list[Region], rows: int, agreement: list[list[float]] | None = None) -> dict[str, float]:
    """The five scores of tables found in a sheet of so many rows, and their mean. Tables are paired by their rows, each found
    one with the free true one that it overlaps most. agreement: of each found table, how far each column's cells agree
    in class once cleaned."""
    if not truth:
        same = float(not found)
        out = dict(zip(SCORES, (same, same, 1.0, 1.0, 0.5), strict=True))
        return out | {"avg": sum(out.values()) / len(SCORES)}
    free, pairs = list(range(len(truth))), []
    lines = lambda r: (r.top, 0, r.bottom, 1)
    for k, f in enumerate(found):
        if free:
            best = max(free, key=lambda i: region_iou(lines(f), lines(truth[i])))
            free.remove(best)
            pairs.append((k, f, truth[best]))
    if not pairs:
        return dict.fromkeys((*SCORES, "avg"), 0.0)
    data, said = _spans(truth), _spans(found)
    noise = rows - _size(data, rows)
    wrong = _size(said, rows) - _size(_both(data, said), rows)
    agree = [a for k, *_ in pairs for a in (agreement[k] if agreement else [])]
    mean = lambda x: sum(x) / len(x)
    out = {
        "header_accuracy": mean([header_accuracy(f.header, t.header) for _, f, t in pairs]),
        "boundary_iou": max(0.0, mean([region_iou(_box(f), _box(t)) for _, f, t in pairs]) - COUNT_PENALTY * abs(len(found) - len(truth))),
        "noise_removal": (noise - wrong) / noise if noise > 0 else 1.0,
        "data_preservation": _size(_both(data, said)) / _size(data),
        "cleaning_quality": mean(agree) if agree else 0.5,
    }
    return out | {"avg": mean(list(out.values()))}


def score_sheets(sheets: DataFrame, truth: dict[str, list[Region]], strategy: str | None = None) -> DataFrame:
    """(source, tables, true_tables, iou, header, the five scores, avg) of every sheet against hand-made truth, each in its
    own task. Sheets without truth are scored as holding no table."""
    known = sum(map(len, truth.values()))
    if known > 1_000_000:
        raise ValueError("hand-made truth goes to all workers; this is too much of it")

    def judge(s: Sheet) -> list[tuple]:
        found, true = D.regions(s, strategy), truth.get(s.source, [])
        got = compute_scores(found, true, s.rows, [D.agreement(s, r) for r in found])
        return [(len(found), len(true), *matched(found, true), *(got[k] for k in (*SCORES, "avg")))]

    names = ("iou", "header", *SCORES, "avg")
    return D.per_sheet(sheets, judge, [("tables", pa.int32()), ("true_tables", pa.int32()), *((n, pa.float64()) for n in names)], "tables int, true_tables int, " + ", ".join(f"{n} double" for n in names)).drop("table_no")


#: A sheet passes with as many tables as there are, overlaps of so much and as many columns as expected.
PASS_IOU = 0.6


def scorecard(results: DataFrame) -> DataFrame:
    """results (group, passed, iou, header) -> a row per group: files, passed, rate, mean overlap and header accuracy."""
    return results.groupBy("group").agg(
        F.count("*").alias("files"), F.count_if("passed").alias("passed"), F.round(F.avg(F.col("passed").cast("double")), 6).alias("rate"), F.round(F.avg("iou"), 6).alias("iou"), F.round(F.avg("header"), 6).alias("header")
    )


def leaderboard(candidates: DataFrame) -> DataFrame:
    """candidates (source, strategy, quality) -> per strategy its mean quality, how often it was the best of a sheet (the
    first on ties) and how far it stays behind the best on average; best first."""
    best = W.partitionBy("source")
    ranked = candidates.withColumn("_best", F.max("quality").over(best)).withColumn("_n", F.row_number().over(best.orderBy(F.desc("quality"), "strategy")))
    out = ranked.groupBy("strategy").agg(F.round(F.avg("quality"), 6).alias("quality"), F.count_if(F.col("_n") == 1).alias("wins"), F.round(F.avg(F.col("_best") - F.col("quality")), 6).alias("gap"))
    return out.orderBy(F.desc("quality"), "strategy")
