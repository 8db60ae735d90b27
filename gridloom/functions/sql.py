"""The cell functions for SQL: temporary functions of the session, whose bodies are SQL that Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

from gridloom.functions import constants as K


def _text(v: str) -> str:
    """A SQL literal of any text."""
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _any(values: list[str]) -> str:
    return "(" + ", ".join(_text(v) for v in values) + ")"


def _bodies() -> dict[str, tuple[str, str, str]]:
    """name -> (parameter, result type, body)."""
    strip = f"btrim(coalesce(v, ''), {_text(K.SPACES)})"
    core = f"replace(regexp_replace(regexp_replace({strip}, {_text(K.NUMBER_DRESS)}, ''), '^[() ]+|[() ]+$', ''), ',', '')"
    number = lambda x: f"({x} rlike {_text(K.FLOAT)} or {x} rlike {_text('(?i)' + K.NOT_FINITE)})"
    bare = f"translate({strip}, '\\0\\ufeff', '')"
    unquoted = f"if(startswith({bare}, '\\'') and substr({bare}, 2, 1) in ('=', '+', '@', '-'), substr({bare}, 2), {bare})"
    year = f"replace({strip}, ',', '')"
    # a temporary function can't be called within a lambda
    line = f"lower(array_join(transform(v, x -> btrim(coalesce(x, ''), {_text(K.SPACES)})), ' '))"
    keywords = " or ".join(f"contains({line}, {_text(k)})" for k in K.SUMMARY_KEYWORDS)
    return {
        "gl_strip": ("v string", "string", strip),
        "gl_is_empty": ("v string", "boolean", f"gl_strip(v) in {_any(K.MISSING_MARKERS)}"),
        "gl_is_numeric": ("v string", "boolean", f"{core} <> '' and {number(core)}"),
        "gl_is_date_like": ("v string", "boolean", f"coalesce(v, '') rlike {_text(K.DATE_ANYWHERE)}"),
        "gl_cell_type": ("v string", "string", "case when gl_is_empty(v) then 'empty' when gl_is_numeric(v) then 'numeric' when gl_is_date_like(gl_strip(v)) then 'date' else 'text' end"),
        "gl_clean": ("v string", "string", f"if({unquoted} in {_any(K.MISSING_MARKERS)}, '', {unquoted})"),
        "gl_year": ("v string", "int", f"if({year} rlike '^\\\\d{{4}}$' and try_cast({year} as int) between 1900 and 2100, try_cast({year} as int), null)"),
        "gl_is_label": ("v string", "boolean", f"gl_strip(v) <> '' and (gl_year(v) is not null or gl_strip(v) rlike {_text('(?i)' + K.MONTH_OR_QUARTER)} or gl_strip(v) rlike {_text('(?i)' + K.PERIOD_TOKEN)})"),
        "gl_hints_id": ("v string", "boolean", f"coalesce(v, '') rlike {_text('(?i)' + K.ID_HINT)}"),
        "gl_is_summary_row": ("v array<string>", "boolean", keywords),
    }


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session's SQL; their names."""
    bodies = _bodies()
    for name, (parameter, kind, body) in bodies.items():
        spark.sql(f"create or replace temporary function {name}({parameter}) returns {kind} return {body}")
    return list(bodies)
