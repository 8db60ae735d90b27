"""Security audit of files: what they are, what they would run, and what they hide. One row per file."""

from __future__ import annotations

import io
import re
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import codes
from gridloom.sources import csvgrid
from gridloom.sources.files import ending

CLEAN, WARNING, DANGER = "CLEAN", "WARNING", "DANGER"

# First bytes of files that can carry programs, and of workbooks.
SIGNATURES = {"windows program": b"MZ", "elf program": b"\x7fELF", "ole2 document": b"\xd0\xcf\x11\xe0", "pdf": b"%PDF", "java class": b"\xca\xfe\xba\xbe"}
DANGEROUS = ("windows program", "elf program", "ole2 document")
WORKBOOK = b"PK\x03\x04"

# Patterns of scripts and commands in text, matched without regard to case.
SCRIPTS = {
    "script tag": r"<script[\s>]",
    "javascript uri": r"javascript:",
    "vbscript uri": r"vbscript:",
    "event handler": r"on(click|load|error|mouseover)\s*=",
    "shell": r"cmd\.exe|powershell|/bin/(ba)?sh",
    "script host": r"WScript\.Shell|Shell\.Application",
    "object creation": r"CreateObject\s*\(",
    "remote data function": r"IMPORTXML|IMPORTDATA|IMPORTRANGE",
    "command formula": r"=CMD\(|=EXEC\(|=SYSTEM\(",
    "hyperlink formula": r"HYPERLINK\s*\(.*https?://",
}


def starts_with(content: Column, signature: bytes) -> Column:
    return F.coalesce(F.substring(content, 1, len(signature)) == F.lit(signature), F.lit(False))


def is_workbook(content: Column) -> Column:
    return starts_with(content, WORKBOOK)


def is_dangerous(content: Column) -> Column:
    """Whether the content begins as a program or an old office document does."""
    found = F.lit(False)
    for name in DANGEROUS:
        found = found | starts_with(content, SIGNATURES[name])
    return found


def runs_as_formula(cell: str) -> bool:
    """Twin of cells.runs_as_formula."""
    v = cell.strip()
    signed = len(v) > 1 and v[0] in "+-" and codes.is_float(v[1:].replace(",", ""))
    return bool(v) and v[0] in "=+-@" and not signed


def _book(content: bytes) -> list[tuple[str, str]]:
    out = []
    try:
        book = zipfile.ZipFile(io.BytesIO(content))
        names = book.namelist()
        for mark, level, said in (("vbaproject", DANGER, "macros"), (".bin", DANGER, "macros"), ("activex", DANGER, "activex"), ("externallink", WARNING, "external links"), ("printersettings", WARNING, "printer settings")):
            if any(n.lower().endswith(mark) if mark == ".bin" else mark in n.lower() for n in names):
                out.append((level, said))
        for n in names:
            if n.endswith((".xml", ".rels")):
                text = book.read(n).decode("utf-8", "replace")
                if re.search("cmd\\.exe|powershell", text, re.I):
                    out.append((DANGER, f"shell in {n}"))
                if "DDE" in text or "ddelink" in text.lower():
                    out.append((DANGER, f"dde in {n}"))
    except zipfile.BadZipFile:
        out.append((DANGER, "broken workbook"))
    return out


def findings(source: str, content: bytes) -> list[tuple[str, str]]:
    """(level, what) of a file."""
    kind = ending(source)
    out = [(DANGER, name) for name, mark in SIGNATURES.items() if content.startswith(mark)]
    if kind == ".xlsx":
        out += ([] if content.startswith(WORKBOOK) else [(DANGER, "no workbook inside")]) + _book(content)
    if kind in (".csv", ".tsv"):
        if content.startswith(WORKBOOK):
            out.append((DANGER, "a workbook inside"))
        if n := content.count(b"\0"):
            out.append((WARNING, f"{n} nul bytes"))
        text = content.decode("utf-8", "replace")
        try:
            if n := sum(runs_as_formula(c) for r in csvgrid.rows(text, "\t" if kind == ".tsv" else None) for c in r):
                out.append((WARNING, f"{n} cells run as formulas"))
        except Exception as e:  # text that is no table is a finding
            out.append((WARNING, f"not readable as a table: {type(e).__name__}"))
        out += [(WARNING, f"{said}: {n}") for said, p in SCRIPTS.items() if (n := len(re.findall(p, text, re.I)))]
    return sorted(set(out))


def audit(files: DataFrame) -> DataFrame:
    """files (source, content) -> (source, bytes, severity, findings)."""

    def run(batches):
        for x in batches:
            for source, content in zip(x.column(0).to_pylist(), x.column(1), strict=True):
                raw = content.as_py() or b""
                found = findings(source, raw)
                level = DANGER if any(f[0] == DANGER for f in found) else WARNING if found else CLEAN
                yield pa.RecordBatch.from_arrays([pa.array([source]), pa.array([len(raw)], pa.int64()), pa.array([level]), pa.array([[f[1] for f in found]], pa.list_(pa.string()))], names=["source", "bytes", "severity", "findings"])

    return files.select("source", "content").mapInArrow(run, "source string, bytes long, severity string, findings array<string>")
