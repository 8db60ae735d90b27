"""XLSX workbooks over zip and XML: sheets as (source, r, cells), merged ranges, borders, sheet choice; and a writer.

Values are the cached ones, as a spreadsheet last computed them. Numbers read as Python writes them, whole ones without a
point; dates by their cell format as ISO text; booleans as True and False. Rows without a cell give no row but for the
sheet's last, so a sheet of a million blank rows costs what it holds.
"""

from __future__ import annotations

import datetime
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gridloom.sources import csvgrid

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
# Number formats that are dates without saying so in a format code.
_DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])
_SIDES = ("left", "right", "top", "bottom")
SIGNATURE = b"PK\x03\x04"
#: A first sheet with so many rows of two cells or more is taken; others are compared up to ROWS_COMPARED such rows.
TABULAR, ROWS_COMPARED = 2, 8


def column_index(ref: str) -> int:
    """0 for A, 26 for AA; digits are ignored."""
    n = 0
    for c in ref:
        if c.isalpha():
            n = n * 26 + ord(c.upper()) - 64
    return n - 1


def column_name(i: int) -> str:
    out = ""
    while i >= 0:
        i, k = divmod(i, 26)
        out, i = chr(65 + k) + out, i - 1
    return out


def _range(ref: str) -> tuple[int, int, int, int]:
    """(first row, first column, last row, last column) of A1:B2."""
    ends = ref.split(":")
    at = [(int(re.sub(r"\D", "", x)) - 1, column_index(x)) for x in (ends[0], ends[-1])]
    return (*at[0], *at[1])


class Workbook:
    """A workbook's bytes; sheets are read on demand."""

    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        book = ElementTree.fromstring(self.zip.read("xl/workbook.xml"))
        links = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))}
        place = lambda t: t.lstrip("/") if t.startswith("/") else f"xl/{t}"
        self.paths = {x.get("name"): place(links[x.get(_REL + "id")]) for x in book.iter(_MAIN + "sheet")}
        self.epoch = datetime.datetime(1904, 1, 1) if any(x.get("date1904") in ("1", "true") for x in book.iter(_MAIN + "workbookPr")) else datetime.datetime(1899, 12, 30)
        views = [x for x in book.iter(_MAIN + "workbookView")]
        self.active = int(views[0].get("activeTab") or 0) if views else 0
        self.strings = self._shared()
        self.dates, self.bordered = self._styles()

    @property
    def names(self) -> list[str]:
        return list(self.paths)

    def _shared(self) -> list[str]:
        if "xl/sharedStrings.xml" not in self.zip.namelist():
            return []
        root = ElementTree.fromstring(self.zip.read("xl/sharedStrings.xml"))
        return [_text(item) for item in root.iter(_MAIN + "si")]

    def _styles(self) -> tuple[list[bool], list[bool]]:
        """Of each cell style, whether it shows dates and whether any side has a border."""
        if "xl/styles.xml" not in self.zip.namelist():
            return [], []
        root = ElementTree.fromstring(self.zip.read("xl/styles.xml"))
        own = {int(x.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", x.get("formatCode") or "") for x in root.iter(_MAIN + "numFmt")}
        group = root.find(_MAIN + "borders")
        borders = [any((side := b.find(_MAIN + s)) is not None and side.get("style") not in (None, "none") for s in _SIDES) for b in (group if group is not None else [])]
        styles = root.find(_MAIN + "cellXfs")
        dates, bordered = [], []
        for x in styles if styles is not None else []:
            form, border = int(x.get("numFmtId") or 0), int(x.get("borderId") or 0)
            dates.append(form in _DATE_FORMATS or bool(re.search(r"[dmyhs]", own.get(form, ""), re.I)))
            bordered.append(border < len(borders) and borders[border])
        return dates, bordered

    def _value(self, cell: ElementTree.Element) -> str:
        kind = cell.get("t") or "n"
        if kind == "inlineStr":
            return _text(cell)
        v = cell.find(_MAIN + "v")
        raw = (v.text or "") if v is not None else ""
        if kind == "s":
            return self.strings[int(raw)] if raw else ""
        if kind == "b":
            return {"1": "True", "0": "False"}.get(raw, raw)
        if kind != "n" or not raw:
            return raw
        number, style = float(raw), int(cell.get("s") or 0)
        if style < len(self.dates) and self.dates[style]:
            return str(self.epoch + datetime.timedelta(seconds=round(number * 86400)))
        return str(int(raw)) if re.fullmatch(r"[+-]?\d+", raw) else str(int(number)) if number.is_integer() and abs(number) < 1e15 else repr(number)

    def rows(self, name: str) -> Iterator[tuple[int, dict[int, str], list[int]]]:
        """(row, cells by column, bordered columns) of each row of the sheet that is written down."""
        at = -1
        with self.zip.open(self.paths[name]) as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != _MAIN + "row":
                    continue
                at = int(row.get("r")) - 1 if row.get("r") else at + 1
                cells, framed, c = {}, [], -1
                for cell in row:
                    if cell.tag != _MAIN + "c":
                        continue
                    c = column_index(cell.get("r")) if cell.get("r") else c + 1
                    if v := self._value(cell):
                        cells[c] = v
                    style = int(cell.get("s") or 0)
                    if style < len(self.bordered) and self.bordered[style]:
                        framed.append(c)
                yield at, cells, framed
                row.clear()

    def width(self, name: str) -> int:
        """The sheet's number of columns as the workbook states it; 0 where it doesn't."""
        with self.zip.open(self.paths[name]) as f:
            said = re.search(rb'<(?:\w+:)?dimension[^>]*\bref="([A-Z0-9:]+)"', f.read(4096))
        return _range(said[1].decode())[3] + 1 if said else 0

    def merges(self, name: str) -> list[tuple[int, int, int, int]]:
        with self.zip.open(self.paths[name]) as f:
            return [_range(x.get("ref")) for _, x in ElementTree.iterparse(f) if x.tag == _MAIN + "mergeCell"]

    def border_box(self, name: str) -> tuple[int, int, int, int] | None:
        """(top, left, bottom, right), ends exclusive, of all cells with a border on any side."""
        found = [(r, c) for r, _, framed in self.rows(name) for c in framed]
        if not found:
            return None
        rows, columns = zip(*found, strict=True)
        return min(rows), min(columns), max(rows) + 1, max(columns) + 1

    def chosen(self, sheet: str | int | None = None) -> str | None:
        """The sheet asked for by name or place, if there is one; else the first, unless it is a cover: then the one with
        the most rows of two cells or more."""
        if not self.names:
            return None
        if isinstance(sheet, int) and not isinstance(sheet, bool) and 0 <= sheet < len(self.names):
            return self.names[sheet]
        if isinstance(sheet, str) and sheet in self.paths:
            return sheet
        if len(self.names) == 1 or self._tabular(self.names[0], TABULAR) >= TABULAR:
            return self.names[0]
        return max(self.names, key=lambda n: self._tabular(n, ROWS_COMPARED))

    def strictly(self, sheet: str | int | None = None) -> str:
        """The sheet by name (KeyError), place (IndexError), or the active one; anything else is a TypeError."""
        if sheet is None:
            return self.names[min(self.active, len(self.names) - 1)]
        if isinstance(sheet, str):
            if sheet not in self.paths:
                raise KeyError(f"no sheet {sheet}")
            return sheet
        if isinstance(sheet, int) and not isinstance(sheet, bool):
            return self.names[sheet]
        raise TypeError("a sheet is a name, a number or None")

    def _tabular(self, name: str, enough: int) -> int:
        n = 0
        for _, cells, _ in self.rows(name):
            n += sum(1 for v in cells.values() if v.strip()) >= 2
            if n >= enough:
                break
        return n

    def grid(self, name: str, fill_merged: bool = False) -> Iterator[tuple[int, list[str]]]:
        """(row, cells) of the sheet, rows that hold anything as wide as the sheet says it is; with fill_merged every cell of
        a merged range has its first cell's value."""
        width = self.width(name)
        spans = self.merges(name) if fill_merged else []
        lead: dict[int, str] = {}
        open_: list[int] = []
        begins: dict[int, list[int]] = {}
        for i, (r0, *_) in enumerate(spans):
            begins.setdefault(r0, []).append(i)
        at = -1
        for r, cells, _ in self.rows(name):
            for missing in range(at + 1, r):  # rows that only a merged range reaches into
                open_ = [i for i in open_ if spans[i][2] >= missing] + begins.pop(missing, [])
                if reached := self._merged({}, missing, spans, open_, lead):
                    yield missing, _dense(reached, width)
            at = r
            open_ = [i for i in open_ if spans[i][2] >= r] + begins.pop(r, [])
            yield r, _dense(self._merged(cells, r, spans, open_, lead), width)
        for r in range(at + 1, max((spans[i][2] for i in open_), default=at) + 1):
            open_ = [i for i in open_ if spans[i][2] >= r]
            yield r, _dense(self._merged({}, r, spans, open_, lead), width)

    @staticmethod
    def _merged(cells: dict[int, str], r: int, spans: list, open_: list[int], lead: dict[int, str]) -> dict[int, str]:
        for i in open_:
            r0, c0, _, c1 = spans[i]
            if r == r0:
                lead[i] = cells.get(c0, "")
            if lead[i]:
                cells |= dict.fromkeys(range(c0, c1 + 1), lead[i])
        return cells


def _text(node: ElementTree.Element) -> str:
    """The text of a string item, less phonetic hints."""
    return "".join(t.text or "" for t in _texts(node))


def _texts(node: ElementTree.Element) -> Iterator[ElementTree.Element]:
    for x in node:
        if x.tag == _MAIN + "t":
            yield x
        elif x.tag in (_MAIN + "r", _MAIN + "is"):
            yield from _texts(x)


def _dense(cells: dict[int, str], width: int) -> list[str]:
    return [cells.get(c, "") for c in range(max(width, max(cells) + 1))] if cells else []


def grids(sheet: str | int | None = None, fill_merged: bool = False, strict: bool = False):
    """A mapInArrow function over (source, content): (source, r, cells) of one sheet of each workbook."""

    def run(batches):
        for x in batches:
            for source, content in zip(x.column(0).to_pylist(), x.column(1), strict=True):
                book = Workbook(content.as_py())
                name = book.strictly(sheet) if strict else book.chosen(sheet)
                if name is not None:
                    yield from csvgrid.batches_of(source, book.grid(name, fill_merged), blanks=False)

    return run


def parsed(files: DataFrame, sheet: str | int | None = None, fill_merged: bool = False, strict: bool = False) -> DataFrame:
    """files (source, content binary) -> (source, r, cells); rows without content go but for the last."""
    return files.select("source", "content").mapInArrow(grids(sheet, fill_merged, strict), csvgrid.GRID)


def sheets(files: DataFrame) -> DataFrame:
    """files (source, content) -> (source, sheet, position, chosen, merges, border struct) of every sheet."""
    box = pa.struct([(n, pa.int32()) for n in ("top", "left_col", "bottom", "right_col")])

    def run(batches):
        for x in batches:
            for source, content in zip(x.column(0).to_pylist(), x.column(1), strict=True):
                book = Workbook(content.as_py())
                rows = [(source, n, i, n == book.chosen(), len(book.merges(n)), dict(zip(box.names, b, strict=True)) if (b := book.border_box(n)) else None) for i, n in enumerate(book.names)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.int32(), box), strict=True)], names=["source", "sheet", "position", "chosen", "merges", "border"])

    return files.select("source", "content").mapInArrow(run, "source string, sheet string, position int, chosen boolean, merges int, border struct<top:int,left_col:int,bottom:int,right_col:int>")


def read(spark: SparkSession, path: str, sheet: str | int | None = None, fill_merged: bool = False) -> DataFrame:
    return parsed(spark.read.format("binaryFile").load(path).selectExpr("path as source", "content"), sheet, fill_merged)


# writing

# The parts of a workbook of one sheet.
_TYPES = '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>{sheets}</Types>'
_SHEET_TYPE = '<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'
_ROOT = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>'
_STYLES = '<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="2"><border/><border><left style="thin"/><right style="thin"/><top style="thin"/><bottom style="thin"/></border></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf borderId="1"/></cellXfs></styleSheet>'
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def _cell(r: int, c: int, v, bordered: bool) -> str:
    style = ' s="1"' if bordered else ""
    ref = f'r="{column_name(c)}{r + 1}"{style}'
    if v is None or v == "":
        return f"<c {ref}/>" if bordered else ""
    if isinstance(v, bool):
        return f'<c {ref} t="b"><v>{int(v)}</v></c>'
    if isinstance(v, (int, float)) and v == v and v not in (float("inf"), float("-inf")):
        return f"<c {ref}><v>{v!r}</v></c>"
    return f'<c {ref} t="inlineStr"><is><t xml:space="preserve">{escape(_CONTROL.sub("", str(v)))}</t></is></c>'


def write(target, sheets: dict[str, Iterator], merges: dict[str, list[str]] | None = None, borders: dict[str, tuple[int, int, int, int]] | None = None) -> None:
    """A workbook of rows by sheet name into a path or file; merges as A1:B2, borders as areas. Rows may
    be a list, whose size is then stated, or come one by one."""
    merges, borders = merges or {}, borders or {}
    links = "".join(f'<Relationship Id="rId{i}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
    styles = '<Relationship Id="rIdS" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/styles" Target="styles.xml"/>'
    names = "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", _HEAD + _TYPES.format(sheets="".join(_SHEET_TYPE.format(i=i) for i in range(1, len(sheets) + 1))))
        z.writestr("_rels/.rels", _HEAD + _ROOT)
        z.writestr("xl/styles.xml", _HEAD + _STYLES)
        z.writestr("xl/workbook.xml", f'{_HEAD}<workbook xmlns="{_MAIN[1:-1]}" xmlns:r="{_REL[1:-1]}"><sheets>{names}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'{_HEAD}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}{styles}</Relationships>')
        for i, (name, rows) in enumerate(sheets.items(), 1):
            top, left, bottom, right = borders.get(name, (0, 0, 0, 0))
            with z.open(f"xl/worksheets/sheet{i}.xml", "w", force_zip64=True) as f:
                size = f'<dimension ref="A1:{column_name(max(map(len, rows), default=1) - 1)}{max(1, len(rows))}"/>' if isinstance(rows, list) else ""
                f.write(f'{_HEAD}<worksheet xmlns="{_MAIN[1:-1]}">{size}<sheetData>'.encode())
                for r, row in enumerate(rows):
                    framed = [top <= r < bottom and left <= c < right for c in range(max(len(row), right if top <= r < bottom else 0))]
                    cells = "".join(_cell(r, c, row[c] if c < len(row) else None, b) for c, b in enumerate(framed))
                    if cells:
                        f.write(f'<row r="{r + 1}">{cells}</row>'.encode())
                joined = "".join(f'<mergeCell ref="{m}"/>' for m in merges.get(name, []))
                f.write(f"</sheetData>{f'<mergeCells>{joined}</mergeCells>' if joined else ''}</worksheet>".encode())
