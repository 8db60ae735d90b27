"""Cell classes in Python workers: each distinct value of a batch is judged once, the rest is array work.

The twin of cells.py for sheets, whose cells are nested in rows: expressions over nested values aren't compiled, so a
dictionary of a batch's values is many times faster there.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from gridloom.functions import constants as K

EMPTY, NUMERIC, DATE, TEXT = range(4)
#: Added to the class: the normal form is a number, it isn't blank, the cell reads as a label, it is a whole number.
NORMAL_NUMBER, NORMAL_FILLED, LABEL, WHOLE = 4, 8, 16, 32

_MARKERS = frozenset(K.MISSING_MARKERS)
_DATE = re.compile(K.DATE_ANYWHERE)
_MONTH, _PERIOD = re.compile(K.MONTH_OR_QUARTER, re.I), re.compile(K.PERIOD_TOKEN, re.I)
_UNITS = re.compile(K.NUMBER_DRESS)
_WHOLE, _PLAIN = re.compile(r"[+-]?\d+"), re.compile(r"[+-]?[0-9]+(?:\.[0-9]*)?")
#: No label is longer, however many blanks stand within it.
LONGEST_LABEL = 40
_DAY, _MONEY, _EURO = (re.compile(p) for p in (K.DAY, K.MONEY, K.EURO))


def is_float(v: str) -> bool:
    try:
        float(v)
    except ValueError:
        return False
    return True


def bare_number(v: str) -> str:
    """A stripped cell less one leading quote or currency sign, trailing units, brackets and commas."""
    return _UNITS.sub("", v).strip("() ").replace(",", "")


def whole_part(v: str) -> str:
    """A stripped cell less its dress and commas; brackets stay."""
    return _UNITS.sub("", v).replace(",", "")


def is_numeric(v: str) -> bool:
    core = bare_number(v.strip())
    return core != "" and is_float(core)


def clean(v: str | None) -> str:
    v = (v or "").strip().replace("\0", "").replace("﻿", "")
    v = v[1:] if len(v) > 1 and v[0] == "'" and v[1] in "=+@-" else v
    return "" if v in _MARKERS else v


def year_of(v: str) -> int | None:
    v = v.strip().replace(",", "")
    return int(v) if len(v) == 4 and v.isdigit() and 1900 <= int(v) <= 2100 else None


def is_label(v: str) -> bool:
    v = v.strip()
    return v != "" and (year_of(v) is not None or bool(_MONTH.search(v)) or bool(_PERIOD.search(v)))


def normal(v: str) -> str:
    """M/D/YYYY to ISO, currency to digits, European decimals to a point; anything else is cleaned only."""
    v = clean(v)
    if m := _DAY.search(v):
        return f"{m[3]}-{m[1].zfill(2)}-{m[2].zfill(2)}"
    if m := _MONEY.search(v):
        return m[1].replace(",", "")
    if m := _EURO.search(v):
        return f"{m[1].replace('.', '')}.{m[2]}"
    return v


def code(v: str | None) -> int:
    """The class of a cell and what else is asked of it. Plain numbers, and words by their first character, are told
    without the patterns."""
    v = v or ""
    core = v.strip()
    if core in _MARKERS:
        # a marker's normal form is blank
        return EMPTY
    if _PLAIN.fullmatch(core):
        return NUMERIC | NORMAL_FILLED | NORMAL_NUMBER | (0 if "." in core else WHOLE) | (LABEL if len(core) == 4 and year_of(core) else 0)
    lead = core[0]
    word = "a" <= lead <= "z" or "A" <= lead <= "Z"
    found = TEXT
    if (not word or lead in "iInN") and is_numeric(core):
        found = NUMERIC | (WHOLE if _WHOLE.fullmatch(whole_part(core)) else 0)
    elif _DATE.search(core):
        found = DATE
    form = clean(v) if word else normal(v)
    found |= NORMAL_FILLED if form else 0
    found |= NORMAL_NUMBER if form and (not word or lead in "iInN") and is_numeric(form) else 0
    return found | (LABEL if len(core) <= LONGEST_LABEL and is_label(core) else 0)


def coded(values: pa.Array) -> np.ndarray:
    """The code of every value of a string array, as uint8; nulls are empty."""
    if not len(values):
        return np.zeros(0, np.uint8)
    known = pc.dictionary_encode(values, null_encoding="encode")
    table = np.array([code(v) for v in known.dictionary.to_pylist()], np.uint8)
    return table[known.indices.to_numpy(zero_copy_only=False)]


def summary_lines(lines: list[str]) -> list[bool]:
    """Whether each line, lower-cased, holds a summary keyword."""
    return [any(k in x for k in K.SUMMARY_KEYWORDS) for x in map(str.lower, lines)]


def classify(v: str | None) -> str:
    """empty, numeric or string: the parse path's classes."""
    if v is None or not v.strip():
        return "empty"
    return "numeric" if v.strip().isdigit() or is_float(v) else "string"


def numeric_or_nan_like(v: str | None) -> bool:
    """Null, a string that reads as null, or a number."""
    return v is None or v.strip() in _NAN_LIKE or is_float(v)


_NAN_LIKE = frozenset(K.NAN_LIKE)
