"""The parse path's areas: where the main table of a sheet lies, by density, by changes of cell classes and by noise.

A frame is a rectangle of cells, None or a string each. Areas are (top, left, bottom, right), bottom and right exclusive;
all zero for a blank frame. `find` judges many sheets at once, one task per sheet.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridloom.functions import codes as C
from gridloom.operators.detect import Region, Sheet

EMPTY, NUMERIC, STRING = range(3)
_KIND = {"empty": EMPTY, "numeric": NUMERIC, "string": STRING}
#: Shares of the fullest row or column, of numbers and of strings, and changes of class, that decide.
DENSE, MOSTLY_NUMBERS, MOSTLY_STRINGS, CHANGES, HEAD = 0.3, 0.8, 0.6, 2, 20
#: A border row or column is noise from this entropy on, or below this fill; so many go per side; the area that must stay.
NOISE, FILL, SHRINK, STAYS, SMALL = 1.0, 0.3, 3, 0.2, 3
BORDERED, WHOLE_WIDTH = 0.1, 0.8

Area = tuple[int, int, int, int]
NONE: Area = (0, 0, 0, 0)


class Frame:
    """Cells of equal rows, their classes, and which hold more than blanks."""

    def __init__(self, rows: list[list[str | None]]):
        width = max(map(len, rows), default=0)
        self.cells = np.array([[*r, *[None] * (width - len(r))] for r in rows], object).reshape(len(rows), width)
        known = {v: _KIND[C.classify(v)] for v in set(self.cells.ravel().tolist())}
        self.kind = np.array([known[v] for v in self.cells.ravel().tolist()], np.int8).reshape(self.cells.shape)
        self.filled = self.kind != EMPTY


def header_end(kind: np.ndarray, head: int = HEAD) -> int:
    """The last row above the data, by the greatest change of classes from a row to the next; 0 for a row of strings over
    rows like it; -1 for none."""
    n, wide = kind.shape
    if n < 2 or not wide:
        return -1
    last = min(n - 1, head)
    changes = (kind[1:last] != kind[2 : last + 1]).sum(1)
    fits = (kind[1:last] == NUMERIC).mean(1) <= MOSTLY_NUMBERS
    if fits.any() and changes[fits].max() >= CHANGES:
        return 1 + int(np.argmax(np.where(fits, changes, -1)))
    return 0 if (kind[0] == STRING).mean() > MOSTLY_STRINGS else -1


def dense_span(projection: np.ndarray, least: float = DENSE) -> tuple[int, int]:
    """From the first to behind the last entry of `least` of the greatest."""
    most = projection.max(initial=0)
    at = np.flatnonzero(projection / most >= least) if most else []
    return (int(at[0]), int(at[-1]) + 1) if len(at) else (0, 0)


def dense_box(filled: np.ndarray) -> Area:
    """The dense span of the rows, and of the columns within these rows."""
    top, bottom = dense_span(filled.sum(1))
    left, right = dense_span(filled[top:bottom].sum(0))
    return (top, left, bottom, right) if top < bottom and left < right else NONE


def noisy(line: np.ndarray, entropy: float = NOISE, fill: float = FILL) -> bool:
    share = np.bincount(line, minlength=3) / max(1, len(line))
    some = share[share > 0]
    return 1 - share[EMPTY] < fill or -(some * np.log2(some)).sum() > entropy


def refined(kind: np.ndarray, area: Area, entropy: float = NOISE, fill: float = FILL, shrink: int = SHRINK) -> Area:
    """The area less noisy rows and columns at its edges: bottom, top, right and left in this order, `shrink` of each at
    most; as it was where it is small or too little would stay."""
    top, left, bottom, right = area
    high, wide = bottom - top, right - left
    if min(high, wide) <= SMALL:
        return area

    def cut(lines: list[np.ndarray], room: int) -> int:
        """How many of the leading lines are noise."""
        return next((i for i, line in enumerate(lines[: max(0, min(shrink, room))]) if not noisy(line, entropy, fill)), max(0, min(shrink, room, len(lines))))

    rows, columns = kind[:, left:right], kind.T
    bottom -= cut([rows[r] for r in range(bottom - 1, top - 1, -1)], high - SMALL)
    top += cut([rows[r] for r in range(top, bottom)], bottom - top - SMALL)
    right -= cut([columns[c, top:bottom] for c in range(right - 1, left - 1, -1)], wide - SMALL)
    left += cut([columns[c, top:bottom] for c in range(left, right)], right - left - SMALL)
    return area if (bottom - top) * (right - left) < STAYS * high * wide else (top, left, bottom, right)


def robust(frame: Frame, **limits) -> Area:
    """The dense box, begun at the row where its header ends and as wide as that row, less noise at its edges."""
    top, left, bottom, right = dense_box(frame.filled)
    if not bottom:
        return NONE
    end = header_end(frame.kind[top:bottom, left:right])
    if end >= 0:
        top += end
        named = np.flatnonzero(frame.filled[top])
        if len(named):
            left, right = int(named[0]), int(named[-1]) + 1
    return refined(frame.kind, (top, left, bottom, right), **limits)


def robust_or_bordered(frame: Frame, border: Area | None, **limits) -> Area:
    """The border box where it is a tenth of the sheet or more, else the robust area."""
    if border and frame.kind.size and (border[2] - border[0]) * (border[3] - border[1]) >= BORDERED * frame.kind.size:
        return border
    return robust(frame, **limits)


def soft_rectangle(mask: np.ndarray, row_offset: int = 0, col_offset: int = 0, tolerance: float = 0.1, min_score: float = 0.8) -> tuple[int, int, int, int]:
    """(top, bottom, left, right), ends exclusive, of the greatest rectangle of ones; on ties that which ends first
    below, then at the right, then the tallest. No zero can be inside, so tolerance and min_score only turn nonsense away."""
    if tolerance < 0 or min_score > 1:
        return NONE
    body = np.asarray(mask, bool)[row_offset:, col_offset:]
    high = np.zeros(body.shape[1], np.int64)
    best, found = 0, NONE
    for r, row in enumerate(body):
        high = np.where(row, high + 1, 0)
        here = (best, 0, 0, 0)
        for level in np.unique(high[high * len(high) > best]).tolist():
            edges = np.diff(np.concatenate([[0], (high >= level).astype(np.int8), [0]]))
            begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
            i = int(np.argmax(end - begin))
            here = max(here, (level * int(end[i] - begin[i]), -int(end[i]), level, -int(begin[i])))
        if here[0] > best:
            best, right, level, left = here
            found = (r - level + 1 + row_offset, r + 1 + row_offset, col_offset - left, col_offset - right)
    return found


def numbers(frame: Frame) -> np.ndarray:
    """Which cells are numbers or read as null."""
    known = {v: C.numeric_or_nan_like(v) for v in set(frame.cells.ravel().tolist())}
    return np.array([known[v] for v in frame.cells.ravel().tolist()], bool).reshape(frame.cells.shape)


def stub_columns(frame: Frame, header_rows: int) -> int:
    """How many columns stand left of the greatest block of numbers, which must have four fifths of the width."""
    _, _, left, right = soft_rectangle(numbers(frame)[header_rows:], tolerance=0.3, min_score=0.7)
    if frame.cells.shape[1] == 0 or (right - left) / frame.cells.shape[1] < WHOLE_WIDTH:
        raise ValueError("no block of numbers over most of the width: the table can't be flattened")
    return left


def gap_split(s: Sheet, min_gap: int = 2, min_rows: int = 2) -> list[Region]:
    """A region for each run of rows between `min_gap` blank rows or more; none where there is one run only."""
    live = np.flatnonzero(s.count > 0)
    cut = np.flatnonzero(np.diff(live) > min_gap) + 1
    runs = [(int(x[0]), int(x[-1])) for x in np.split(live, cut) if len(x)]
    out = []
    for first, last in runs if len(runs) > 1 else []:
        if last - first + 1 >= min_rows:
            header = s.first_textual(first, min(first + 10, last + 1), first)
            top = min(header + 1, last)
            left, right = s.span(top, last)
            out.append(Region(header, top, left, last, right))
    return out


def find(sheets: DataFrame, judge: Callable[[Frame], Area] = robust) -> DataFrame:
    """(source, top, left_col, bottom, right_col) of every sheet (source, r, cells) by `judge`."""

    def run(key, t):
        t = t.sort_by("r")
        at, cells = t["r"].to_pylist(), t["cells"].to_pylist()
        rows: list = [[] for _ in range(at[-1] + 1)]
        for r, x in zip(at, cells, strict=True):
            rows[r] = x or []
        return pa.table([pa.array([v], k) for v, k in zip((key[0].as_py(), *judge(Frame(rows))), (pa.string(), *[pa.int32()] * 4), strict=True)], names=["source", "top", "left_col", "bottom", "right_col"])

    return sheets.select("source", "r", "cells").groupBy("source").applyInArrow(run, "source string, top int, left_col int, bottom int, right_col int")


def gaps(sheets: DataFrame, min_gap: int = 2, min_rows: int = 2) -> DataFrame:
    """(source, table_no, header, top, left_col, bottom, right_col) of every sheet by its blank rows."""
    from gridloom.operators.detect import per_sheet

    names = ("header", "top", "left_col", "bottom", "right_col")
    return per_sheet(sheets, lambda s: gap_split(s, min_gap, min_rows), [(n, pa.int32()) for n in names], ", ".join(f"{n} int" for n in names))
