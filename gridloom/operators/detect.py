"""Table detection: sheets (source, r, cells) to regions, one task per sheet, all sheets at once.

Cells are classified where their rows are (`coded_rows`), each distinct value of a batch once; rows without content go
before the shuffle. A sheet then is a matrix of codes on which six strategies, the quality score and the XY-cut work as
array operations. Texts are looked at only for repeated headers and keywords.

A region is (header, top, left, bottom, right): header -1 for none, bottom inclusive, right exclusive. An empty sheet has
no regions; null cells are empty ones; rows of one sheet may differ in length.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from gridloom.functions import codes as C
from gridloom.functions import constants as K
from gridloom.functions.codes import DATE, EMPTY, NUMERIC, TEXT
from gridloom.functions.codes import clean as cleaned

LEAST_QUALITY, LEAST_ROWS = 0.45, 2


class Region(NamedTuple):
    header: int
    top: int
    left: int
    bottom: int
    right: int


class Texts:
    """The cells of the rows that hold any, read one at a time, as few are looked at."""

    def __init__(self, rows: list[int], cells: pa.Array):
        self.place = {r: i for i, r in enumerate(rows)}
        self.values = cells.flatten()
        self.ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(cells), 0).to_numpy(zero_copy_only=False))])

    def width(self, r: int) -> int:
        i = self.place.get(r)
        return 0 if i is None else int(self.ends[i + 1] - self.ends[i])

    def get(self, r: int, c: int) -> str:
        i = self.place.get(r)
        if i is None or not 0 <= c < self.ends[i + 1] - self.ends[i]:
            return ""
        return self.values[int(self.ends[i]) + c].as_py() or ""


class Sheet:
    """A window of texts, and their codes as a matrix; cells beyond a row's end are empty and don't count in its length."""

    def __init__(self, texts: Texts, code: np.ndarray, length: np.ndarray, r0: int = 0, c0: int = 0):
        self.texts, self.code, self.length, self.r0, self.c0 = texts, code, length, r0, c0
        self.source: str | None = None
        self.kind = code & 3
        self.filled = self.kind != EMPTY
        self.rows, self.columns = code.shape
        self.count = self.filled.sum(1)
        self.rate = self.count / np.maximum(length, 1)

    @classmethod
    def of(cls, grid: list[list[str | None]]) -> Sheet:
        """A sheet of plain rows."""
        cells = pa.array([x or [] for x in grid], pa.list_(pa.string()))
        n = len(grid)
        return cls.placed(pa.array(range(n), pa.int64()), pa.array([len(x or []) for x in grid], pa.int32()), cells, _packed(cells, C.coded(cells.flatten())))

    @classmethod
    def placed(cls, at: pa.Array, width: pa.Array, cells: pa.Array, codes: pa.Array) -> Sheet:
        """Rows by their place in the sheet; rows without content may lack, but for the last and the widest."""
        at, width = at.to_numpy(), width.to_numpy()
        rows, columns = (int(at.max()) + 1, int(width.max())) if len(at) else (0, 0)
        length, code = np.zeros(rows, np.int64), np.zeros((rows, columns), np.uint8)
        length[at] = width
        n = pc.binary_length(codes).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = np.frombuffer(b"".join(codes.to_pylist()), np.uint8)
        code[np.repeat(at, n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
        return cls(Texts(at.tolist(), cells), code, length)

    def text(self, r: int, c: int) -> str:
        return self.texts.get(r + self.r0, c + self.c0) if 0 <= r < self.rows and 0 <= c < self.columns else ""

    def part(self, r0: int, r1: int, c0: int, c1: int) -> Sheet:
        """The cells of both ranges, ends included; all rows get the same length."""
        code = self.code[r0 : r1 + 1, c0 : c1 + 1]
        return Sheet(self.texts, code, np.full(len(code), c1 + 1 - c0), self.r0 + r0, self.c0 + c0)

    def summary(self, r: int, left: int = 0, right: int | None = None) -> bool:
        end = min(self.columns, self.texts.width(r + self.r0) - self.c0) if right is None else right
        return C.summary_lines([" ".join(self.text(r, c).strip() for c in range(left, end))])[0]

    def first_textual(self, lo: int, hi: int, default: int, count: np.ndarray | None = None, numeric: np.ndarray | None = None) -> int:
        """The first row of lo..hi-1 with two filled cells or more, over half of them no numbers."""
        count = self.count if count is None else count
        numeric = (self.kind == NUMERIC).sum(1) if numeric is None else numeric
        window = slice(lo, max(lo, hi))
        found = np.flatnonzero((count[window] >= 2) & (2 * (count[window] - numeric[window]) > count[window]))
        return lo + int(found[0]) if len(found) else default

    def span(self, top: int, bottom: int, filled: np.ndarray | None = None, live: np.ndarray | None = None) -> tuple[int, int]:
        """Left and right by the columns filled in a tenth of the rows that hold anything."""
        filled = self.filled if filled is None else filled
        live = self.rate > 0 if live is None else live
        body = filled[top : bottom + 1][live[top : bottom + 1]]
        dense = np.flatnonzero(body.sum(0) / len(body) >= 0.1) if len(body) else []
        return (int(dense[0]), int(dense[-1]) + 1) if len(dense) else (0, self.columns)


def _last(mask: np.ndarray, lo: int, default: int) -> int:
    at = np.flatnonzero(mask[lo:])
    return lo + int(at[-1]) if len(at) else default


def by_rules(s: Sheet) -> Region:
    """Header: the first of twenty rows filled over half. Bottom: the last row filled to 0.3 without a summary keyword."""
    full = np.flatnonzero(s.rate[:20] > 0.5)
    header = int(full[0]) if len(full) else 0
    bottom = next((r for r in range(s.rows - 1, header, -1) if s.rate[r] >= 0.3 and not s.summary(r)), header)
    return Region(header, header + 1, 0, max(bottom, header + 1), s.columns)


def by_entropy(s: Sheet) -> Region:
    """Header: where the entropy of cell classes and the classes themselves change most towards the next row."""
    share = np.stack([(s.kind[:21] == k).sum(1) for k in (NUMERIC, DATE, TEXT)], 1) / np.maximum(s.count[:21], 1)[:, None]
    entropy = -np.where(share > 0, share * np.log2(np.where(share > 0, share, 1)), 0).sum(1)
    header, most = 0, -1.0
    for r in range(min(s.rows - 1, 20)):
        if s.rate[r] >= 0.3:
            here, below = s.kind[r][s.filled[r]], s.kind[r + 1][s.filled[r + 1]]
            n = min(len(here), len(below))
            change = abs(entropy[r] - entropy[r + 1]) + 0.1 * int((here[:n] != below[:n]).sum())
            if change > most:
                header, most = r, change
    top = header + 1
    bottom = max(top, _last(s.rate >= 0.3, top, top))
    return Region(header, top, *_sides(s, top, bottom))


def _sides(s: Sheet, top: int, bottom: int, **kw) -> tuple[int, int, int]:
    left, right = s.span(top, bottom, **kw)
    return left, bottom, right


def by_gradient(s: Sheet) -> Region | None:
    """Rows filled to 0.3 of the fullest bound the table."""
    if not s.count.max(initial=0):
        return None
    dense = s.count / s.count.max() >= 0.3
    first = int(np.argmax(dense))
    last = _last(dense, first + 1, s.rows - 1)
    header = s.first_textual(first, min(first + 10, last), first)
    return Region(header, header + 1, *_sides(s, header + 1, last))


def by_pattern(s: Sheet) -> Region:
    """As the text-dominant header and the last row filled to 0.3 say once cells are in their normal form."""
    filled = s.code & 8 != 0
    count = filled.sum(1)
    header = s.first_textual(0, 20, 0, count, (filled & (s.code & 4 != 0)).sum(1))
    rate = count / max(1, s.columns)
    bottom = _last(rate >= 0.3, header + 1, s.rows - 1)
    return Region(header, header + 1, *_sides(s, header + 1, bottom, filled=filled, live=rate > 0))


def by_window(s: Sheet) -> Region:
    """The run of rows whose centred moving average of fill is 0.4 or more with the greatest sum."""
    half = min(5, max(1, s.rows // 4)) // 2
    padded, inside = np.pad(s.rate, half), np.pad(np.ones(s.rows), half)
    total, size = sum(padded[i : i + s.rows] for i in range(2 * half + 1)), sum(inside[i : i + s.rows] for i in range(2 * half + 1))
    mean = total / size
    edges = np.diff(np.concatenate([[0], (mean >= 0.4).astype(np.int8), [0]]))
    runs = list(zip(np.flatnonzero(edges == 1).tolist(), (np.flatnonzero(edges == -1) - 1).tolist(), strict=True))
    first, last = max(runs, key=lambda x: (sum(mean[x[0] : x[1] + 1].tolist()), -x[0]), default=(0, 0))
    if last <= first:
        first, last = 0, s.rows - 1
    header = s.first_textual(first, min(first + 10, last), first)
    top = header + 1
    return Region(header, top, *_sides(s, top, max(last, top)))


def by_voting(s: Sheet) -> Region:
    """Rows vote by how well their cells agree with the commonest class of each column."""
    header = s.first_textual(0, 20, 0)
    live = np.flatnonzero(s.count[header + 1 :]) + header + 1
    body = s.kind[live]
    tally = np.stack([(body == k).sum(0) for k in (NUMERIC, DATE, TEXT)])
    met = np.stack([np.where((body == k).any(0), (body == k).argmax(0), len(body)) for k in (NUMERIC, DATE, TEXT)]) if len(body) else tally
    # most often, then first met
    rank = tally.astype(np.int64) * (len(body) + 1) + len(body) - met
    chief = np.where(tally.sum(0) > 0, rank.argmax(0) + 1, EMPTY)
    asked = (chief != EMPTY)[None] & (np.arange(s.columns)[None] < s.length[live, None])
    near = (np.isin(body, (NUMERIC, DATE)) & np.isin(chief, (NUMERIC, DATE))[None]) * 0.8
    votes = np.where(body == EMPTY, 0.5, np.where(body == chief[None], 1.0, near)) * asked
    good = live[votes.sum(1) / np.maximum(asked.sum(1), 1) >= 0.5 - 1e-12]
    if not len(good):
        return Region(header, header + 1, 0, s.rows - 1, s.columns)
    typed = np.flatnonzero(chief != EMPTY)
    left, right = (int(typed[0]), int(typed[-1]) + 1) if len(typed) else (0, s.columns)
    return Region(header, int(good[0]), left, int(good[-1]), right)


#: In the order in which ties are settled; more may be added.
STRATEGIES: dict[str, Callable[[Sheet], Region | None]] = {"A": by_rules, "B": by_entropy, "C": by_gradient, "D": by_pattern, "E": by_window, "F": by_voting}


def quality(s: Sheet, region: Region) -> float:
    """0 to 1: agreement of classes in columns, even fill, a textual header, sharp edges, coverage and size."""
    header, top, left, bottom, right = region
    high, wide = bottom - top + 1, right - left
    if high <= 0 or wide <= 0:
        return 0.0
    within = lambda r: s.filled[r, left:right].sum()
    live = np.flatnonzero(s.count[top : bottom + 1])
    body = s.kind[top + live, left:right]
    tally = np.stack([(body == k).sum(0) for k in (NUMERIC, DATE, TEXT)])
    total = tally.sum(0)
    agree = np.where(total > 0, tally.max(0) / np.maximum(total, 1), 0.5)
    agree = np.concatenate([agree, np.full(wide - len(agree), 0.5)])
    fills = np.zeros(min(high, max(0, s.rows - top)), np.int64)
    fills[live] = (body != EMPTY).sum(1)
    even = 1 - min(fills.var() / max(wide * wide / 4, 1), 1) if len(fills) > 1 else 1.0
    titled = 0.5
    if 0 <= header < s.rows:
        n = within(header)
        titled = (n - (s.kind[header, left:right] == NUMERIC).sum()) / n if n else 0.0
    around = [within(r) / wide for r in (top - 1, bottom + 1) if 0 <= r < s.rows]
    dense = fills.sum() / (high * wide)
    sharp = max(0.0, dense - sum(around) / len(around)) if around else dense
    cover, size = min(high * wide / max(s.rows * s.columns, 1), 1), min(5 * high / max(s.rows, 1), 1)
    return round(float(0.25 * agree.mean() + 0.15 * even + 0.2 * titled + 0.15 * min(2 * sharp, 1) + 0.15 * cover + 0.1 * size), 4)


def single(s: Sheet, strategy: str | None = None) -> Region | None:
    """By the strategy named, else the best of all by quality; the earlier strategy wins ties."""
    chosen = STRATEGIES.get((strategy or "").upper())
    if chosen:
        return chosen(s) if s.rows else None
    found = [r for r in (f(s) for f in STRATEGIES.values()) if r is not None] if s.rows else []
    return max(found, key=lambda r: quality(s, r), default=None)


def agreement(s: Sheet, region: Region) -> list[float]:
    """Of each column of the region's cleaned rows, the share of the commonest class among filled cells; 1 where none is."""
    seen, rows = set(), []
    for r in range(region.top, min(region.bottom, s.rows - 1) + 1):
        if s.filled[r, region.left : region.right].any() and not s.summary(r, region.left, region.right):
            line = tuple(cleaned(s.text(r, c)) for c in range(region.left, region.right))
            if any(line) and line not in seen:
                seen.add(line)
                rows.append(r)
    kind = s.kind[rows, region.left : region.right] if rows else np.zeros((0, 0), np.uint8)
    tally = np.stack([(kind == k).sum(0) for k in (NUMERIC, DATE, TEXT)])
    return np.where(tally.sum(0) > 0, tally.max(0) / np.maximum(tally.sum(0), 1), 1.0).tolist()


class _Cut:
    """The cuts of one sheet into blocks."""

    def __init__(self, s: Sheet):
        self.s = s

    def titles(self, r0: int, r1: int, c0: int, c1: int) -> np.ndarray:
        """Rows with one or two filled cells, all in the first two columns and no numbers."""
        kind = self.s.kind[r0 : r1 + 1, c0 : c1 + 1]
        n = (kind != EMPTY).sum(1)
        return (n >= 1) & (n == (np.isin(kind[:, :2], (DATE, TEXT))).sum(1))

    def headers(self, r0: int, r1: int, c0: int, c1: int) -> np.ndarray:
        """Rows with two filled cells or more, under half of them (the last column aside) numbers or dates."""
        kind = self.s.kind[r0 : r1 + 1, c0 : c1 + 1]
        inner = kind[:, :-1]
        data, n = np.isin(inner, (NUMERIC, DATE)).sum(1), (inner != EMPTY).sum(1)
        return (2 * data < np.maximum(n, 1)) & ((kind != EMPTY).sum(1) >= 2)

    def column(self, r0: int, r1: int, c0: int, c1: int) -> tuple[int, int] | None:
        """(last column of the left table, first of the right) at the first blank band between unlike tables."""
        part = self.s.filled[r0 : r1 + 1, c0 : c1 + 1]
        used = np.flatnonzero(part.any(0))
        for a, b in zip(used[:-1].tolist(), used[1:].tolist(), strict=True):
            if b - a < 2:
                continue
            left, right = part[:, : a + 1].any(1), part[:, b:].any(1)
            alike = (left & right).sum() / (left | right).sum()
            low = min(r0 + 2, r1)
            if alike < 0.7 or (self.titles(r0, low, c0, c0 + a).any() and self.titles(r0, low, c0 + b, c1).any()):
                return c0 + a, c0 + b
        return None

    def row(self, r0: int, r1: int, c0: int, c1: int) -> int | None:
        """The first row of a second table: after two blank rows, a repeated header, or a title above a header."""
        live = np.flatnonzero(self.s.filled[r0 : r1 + 1, c0 : c1 + 1].any(1))
        headers, titles = self.headers(r0, r1, c0, c1), self.titles(r0, r1, c0, c1)
        first = int(live[0])
        like = np.flatnonzero(headers[first : first + 6])
        again = self.repeats(r0 + first + int(like[0]), r0, r1, c0, c1) if len(like) else set()
        for i, r in enumerate(live.tolist()):
            if i and ((i > 1 and r - live[i - 1] > 2) or r in again or (titles[r] and headers[r + 1 : r + 4].any())):
                return r0 + r
        return None

    def repeats(self, header: int, r0: int, r1: int, c0: int, c1: int) -> set[int]:
        s = self.s
        sign = lambda r, c: cleaned(s.text(r, c)).lower()
        same = (s.kind[r0 : r1 + 1, c0 : c1 + 1] == s.kind[header, c0 : c1 + 1]).all(1)
        wanted = [(c, sign(header, c)) for c in range(c0, c1 + 1)]
        return {r for r in np.flatnonzero(same).tolist() if all(sign(r0 + r, c) == v for c, v in wanted)}


def blocks(s: Sheet) -> list[tuple[int, int, int, int]]:
    """(r0, r1, c0, c1), ends included, of the sheet's blocks, left before right and upper before lower."""
    cut, out, work = _Cut(s), [], [(0, s.rows - 1, 0, s.columns - 1)]
    while work:
        r0, r1, c0, c1 = work.pop()
        part = s.filled[r0 : r1 + 1, c0 : c1 + 1]
        rows, cols = np.flatnonzero(part.any(1)), np.flatnonzero(part.any(0))
        if not len(rows):
            continue
        r0, r1, c0, c1 = r0 + int(rows[0]), r0 + int(rows[-1]), c0 + int(cols[0]), c0 + int(cols[-1])
        if gap := cut.column(r0, r1, c0, c1):
            work += [(r0, r1, gap[1], c1), (r0, r1, c0, gap[0])]
        elif (at := cut.row(r0, r1, c0, c1)) is not None:
            work += [(at, r1, c0, c1), (r0, at - 1, c0, c1)]
        else:
            out.append((r0, r1, c0, c1))
    return out


def regions(s: Sheet, strategy: str | None = None) -> list[Region]:
    """The tables of a sheet: one per block where two blocks or more hold a table, else one for the sheet."""
    parts = blocks(s)
    if len(parts) > 1:
        found = []
        for r0, r1, c0, c1 in parts:
            x = single(s.part(r0, r1, c0, c1), strategy)
            if x is not None:
                x = Region(x.header + r0 if x.header >= 0 else -1, x.top + r0, x.left + c0, x.bottom + r0, x.right + c0)
                if x.bottom - x.top + 1 >= LEAST_ROWS and x.right > x.left and quality(s, x) >= LEAST_QUALITY:
                    found.append(x)
        if len(found) > 1:
            return found
    one = single(s, strategy)
    return [one] if one is not None else []


def _packed(cells: pa.Array, codes: np.ndarray) -> pa.Array:
    """The codes of a list array's values as a row of bytes for each list."""
    n = pc.fill_null(pc.list_value_length(cells), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cells), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(codes))])


CODED = "source string, r long, width int, cells array<string>, codes binary"


def code_batches(batches):
    """A mapInArrow function over (source, r, cells): those rows that hold anything, and each batch's last and widest, with
    their width and the codes of their cells."""
    for x in batches:
        cells, at = x.column(2), x.column(1).to_numpy()
        codes = _packed(cells, C.coded(cells.flatten()))
        width = pc.fill_null(pc.list_value_length(cells), 0)
        n = pc.binary_length(codes).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(n)])
        filled = np.concatenate([[0], np.cumsum(np.frombuffer(codes.buffers()[2] or b"", np.uint8)[: ends[-1]] & 3 != EMPTY)])
        keep = filled[ends[1:]] > filled[ends[:-1]]
        source = pc.dictionary_encode(x.column(0), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        for of in (at, width.to_numpy(zero_copy_only=False)):
            most = np.full(int(source.max(initial=0)) + 1, -1, np.int64)
            np.maximum.at(most, source, of)
            keep |= of == most[source]
        yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), width.cast(pa.int32()), cells, codes], names=["source", "r", "width", "cells", "codes"]).filter(pa.array(keep))


def coded_rows(sheets: DataFrame) -> DataFrame:
    """(source, r, width, cells, codes) of the rows that hold anything, and of each batch's last and widest row; what is
    coded already is taken as it is."""
    if "codes" in sheets.columns:
        return sheets.select("source", "r", "width", "cells", "codes")
    return sheets.selectExpr("source", "cast(r as long) as r", "cells").mapInArrow(code_batches, CODED)


def per_sheet(sheets: DataFrame, judge: Callable[[Sheet], list[tuple]], fields: list[tuple[str, pa.DataType]], sql: str) -> DataFrame:
    """(source, table_no, fields) from `judge` of every sheet; sheets are (source, r, cells), r a row's index from 0."""
    schema = pa.schema([("source", pa.string()), ("table_no", pa.int32()), *fields])

    def run(key, t):
        t = t.sort_by("r").combine_chunks()
        sheet = Sheet.placed(*(t[c].chunk(0) for c in ("r", "width", "cells", "codes")))
        sheet.source = key[0].as_py()
        found = judge(sheet)
        rows = [dict(zip(schema.names, (key[0].as_py(), i, *f), strict=True)) for i, f in enumerate(found)]
        return pa.Table.from_pylist(rows, schema=schema)

    return coded_rows(sheets).groupBy("source").applyInArrow(run, f"source string, table_no int, {sql}")


def detect(sheets: DataFrame, strategy: str | None = None) -> DataFrame:
    """(source, table_no, header, top, left_col, bottom, right_col, quality) of every table of every sheet."""
    names = ("header", "top", "left_col", "bottom", "right_col")
    return per_sheet(sheets, lambda s: [(*x, quality(s, x)) for x in regions(s, strategy)], [*((n, pa.int32()) for n in names), ("quality", pa.float64())], ", ".join(f"{n} int" for n in names) + ", quality double")


def candidates(sheets: DataFrame) -> DataFrame:
    """(source, table_no, strategy, region, quality): what each strategy makes of a whole sheet."""

    def judge(s: Sheet) -> list[tuple]:
        found = [(k, f(s)) for k, f in STRATEGIES.items()] if s.rows else []
        return [(k, *x, quality(s, x)) for k, x in found if x is not None]

    names = ("header", "top", "left_col", "bottom", "right_col")
    return per_sheet(sheets, judge, [("strategy", pa.string()), *((n, pa.int32()) for n in names), ("quality", pa.float64())], "strategy string, " + ", ".join(f"{n} int" for n in names) + ", quality double")
