"""Cell predicates and cleaners as column expressions; nothing here leaves the JVM.

A null cell counts as the empty string.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions import constants as K

def strip(c: Column) -> Column:
    """Unicode-aware strip; null gives the empty string."""
    return F.btrim(F.coalesce(c, F.lit("")), F.lit(K.SPACES))


def is_empty(c: Column) -> Column:
    return strip(c).isin(K.MISSING_MARKERS)


def parses_as_float(c: Column) -> Column:
    return c.rlike(K.FLOAT) | c.rlike("(?i)" + K.NOT_FINITE)


def is_numeric(c: Column) -> Column:
    """A number once one leading quote or currency sign, trailing units, brackets and commas are off."""
    v = F.regexp_replace(strip(c), K.NUMBER_DRESS, "")
    v = F.regexp_replace(v, r"^[() ]+|[() ]+$", "")
    return (v != "") & parses_as_float(F.replace(v, F.lit(","), F.lit("")))


def is_date_like(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(K.DATE_ANYWHERE)


def cell_type(c: Column) -> Column:
    """empty, numeric, date or text, in this order."""
    return F.when(is_empty(c), "empty").when(is_numeric(c), "numeric").when(is_date_like(strip(c)), "date").otherwise("text")


def clean_cell(c: Column) -> Column:
    v = F.translate(strip(c), "\0\ufeff", "")
    v = F.when(v.startswith("'") & F.substring(v, 2, 1).isin("=", "+", "@", "-"), F.substring(v, 2, 1 << 30)).otherwise(v)
    return F.when(v.isin(K.MISSING_MARKERS), "").otherwise(v)


def summary_row(cells: Column) -> Column:
    """Whether the row's lower-cased cells, joined by blanks, contain a summary keyword."""
    line = F.lower(F.array_join(F.transform(cells, strip), " "))
    hit = F.lit(False)
    for k in K.SUMMARY_KEYWORDS:
        hit = hit | line.contains(k)
    return hit


def year_of(c: Column) -> Column:
    """The year a bare label names, 1900 to 2100; else null."""
    v = F.replace(strip(c), F.lit(","), F.lit(""))
    y = F.when(v.rlike(r"^\d{4}$"), F.expr("1") * v.try_cast("int"))
    return F.when(y.between(1900, 2100), y)


def is_label(c: Column) -> Column:
    v = strip(c)
    return (v != "") & (year_of(c).isNotNull() | v.rlike("(?i)" + K.MONTH_OR_QUARTER) | v.rlike("(?i)" + K.PERIOD_TOKEN))


def hints_id(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike("(?i)" + K.ID_HINT)


def normalise(c: Column) -> Column:
    """M/D/YYYY to ISO, currency to digits, European decimals to a point; anything else is cleaned only."""
    v = clean_cell(c)
    day, money, euro = K.DAY, K.MONEY, K.EURO
    part = lambda p, i: F.regexp_extract(v, p, i)
    return (
        F.when(v.rlike(day), F.concat_ws("-", part(day, 3), F.lpad(part(day, 1), 2, "0"), F.lpad(part(day, 2), 2, "0")))
        .when(v.rlike(money), F.replace(part(money, 1), F.lit(","), F.lit("")))
        .when(v.rlike(euro), F.concat(F.replace(part(euro, 1), F.lit("."), F.lit("")), F.lit("."), part(euro, 2)))
        .otherwise(v)
    )


def classify(c: Column) -> Column:
    """empty, numeric or string: the parse path's classes."""
    return F.when(c.isNull() | (strip(c) == ""), "empty").when(strip(c).rlike(r"^\d+$") | parses_as_float(c), "numeric").otherwise("string")


def nan_like_to_null(c: Column, custom: list[str] | None = None) -> Column:
    return F.when((strip(c) == "") | c.isin(K.NAN_LIKE + list(custom or [])), None).otherwise(c)


def numeric_or_nan_like(c: Column) -> Column:
    """Null, a string that reads as null, or a number."""
    return c.isNull() | strip(c).isin(K.NAN_LIKE) | F.coalesce(parses_as_float(c), F.lit(False))


def sanitised(c: Column) -> Column:
    """The cell less NULs and byte order marks, quoted where a spreadsheet would run it as a formula."""
    v = F.regexp_replace(c, "[\\x00\\uFEFF]", "")
    return F.when(v.rlike(r"^[=+\-@\t\r\n]"), F.concat(F.lit("'"), v)).otherwise(v)


def runs_as_formula(c: Column) -> Column:
    """Whether a spreadsheet would run the cell: it begins with = + - @, and isn't a signed number."""
    v = strip(c)
    signed = v.rlike(r"^[+-]") & F.coalesce(parses_as_float(F.replace(F.substring(v, 2, 1 << 30), F.lit(","), F.lit(""))), F.lit(False)) & (F.length(v) > 1)
    return v.rlike(r"^[=+\-@]") & ~signed


def entropy(counts: Column) -> Column:
    """Shannon entropy in bits of an array of counts."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, n: a + n)
    share = lambda n: n / total
    return F.aggregate(F.filter(counts, lambda n: n > 0), F.lit(0.0), lambda a, n: a - share(n) * F.log2(share(n)))
