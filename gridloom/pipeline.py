"""The fluent pipeline: detect, clean, atomize, clarify, merge, to_long, flatten, append, save."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import grid as G
from gridloom.operators import model as M
from gridloom.operators import tabular as T
from gridloom.operators.detect import coded_rows
from gridloom.sources import files, sinks, store


class Pipeline:
    """A file, a folder of files or a DataFrame to tidy tables.

    The grid is decoded once and kept as a table below spark.checkpoint.dir until close(). Models are found eagerly (a few
    numbers per table are collected); all tables are lazy plans. A DataFrame's rows go by the columns of `order`, else as
    they lie. sheet_name picks a workbook's sheet by name or place.
    """

    def __init__(self, source: str | DataFrame, *, spark: SparkSession | None = None, strategy: str | None = None, sheet_name: str | int | None = None, order: list[str] | None = None):
        self.source, self.strategy, self.sheet_name, self.order = source, strategy, sheet_name, order
        self.spark = spark or (source.sparkSession if isinstance(source, DataFrame) else SparkSession.active())
        self._grid: DataFrame | None = None
        self._place: str | None = None
        self._found: list[tuple[object, DataFrame]] = []
        self.models: list = []
        self._df: DataFrame | None = None
        self._log: list[str] = []

    def __enter__(self) -> Pipeline:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        """Deletes the kept grid; tables that weren't read or saved by then can't be any more."""
        if self._place:
            store.delete(self.spark, self._place)
            self._place = None

    def _say(self, line: str) -> Pipeline:
        self._log.append(line)
        return self

    def detect(self) -> Pipeline:
        self.close()
        if isinstance(self.source, DataFrame):
            rows = coded_rows(G.grid_of(self.source, self.order).select(F.lit("dataframe").alias("source"), "r", "cells"))
        else:
            rows = files.coded(self.spark, self.source, self.sheet_name)
        self._grid, self._place = store.kept(rows)
        self.models = M.models(self._grid, self.strategy).orderBy("source", "table_no").collect()  # one row per table
        return self._say(f"Detection: {len(self.models)} table(s) found (strategy={self.strategy or 'auto'})")

    def _sheet(self, m) -> DataFrame:
        return self._grid.filter(F.col("source") == m.source).select("r", "cells")

    def clean(self) -> Pipeline:
        self._found = [(m, M.wide(self._sheet(m), m)) for m in self.models if m.has_rows]
        for i, (m, df) in enumerate(self._found):
            self._say(f"Clean: table {i}, {len(df.columns)} columns (rows=[{m.top}..{m.bottom}], cols=[{m.left_col}..{m.right_col}))")
        self._df = self._found[0][1] if self._found else self._df
        return self

    def to_long(self, table_index: int = 0, *, value_name: str = "value", dropna: bool = True, ffill_stub: bool = True) -> Pipeline:
        kept = [m for m, _ in self._found] or self.models
        if not kept and self._df is not None:
            return self.flatten()
        if table_index >= len(kept):
            raise ValueError("no such table; call detect() first")
        m = kept[table_index]
        self._df = M.long(self._sheet(m), m, value_name, dropna, ffill_stub)
        return self._say(f"ToLong: table {table_index}")

    def flatten(self, header_rows: int | None = None, header_cols: int | None = None, **names) -> Pipeline:
        """Long form by the first table's model; without one, by the rows and columns of heads of the table at hand."""
        if self.models and self._grid is not None:
            return self.to_long()
        return self._apply("Flatten", lambda df: T.flatten(G.grid_of(df, self.order, header=False), header_rows, header_cols, **names))

    def tidy(self) -> DataFrame:
        """All tables of all sheets in one long form (see model.tidy)."""
        return M.tidy(self._grid, M.models(self._grid, self.strategy))

    def use(self, df: DataFrame) -> Pipeline:
        """Goes on with a table of one's own."""
        self._df = df
        return self

    def _apply(self, name: str, f) -> Pipeline:
        if self._df is None:
            return self
        self._df = f(self._df)
        return self._say(f"{name}: {len(self._df.columns)} columns")

    def atomize(self, cols: str | list[str] | None = None, delimiter: str | None = None, mode: str = "column") -> Pipeline:
        if mode == "column":
            return self._apply("Atomize (column)", lambda df: T.atomize_by_column(df, cols, delimiter))

        def by_row(df: DataFrame) -> DataFrame:
            names = [cols] if isinstance(cols, str) else cols or df.columns
            found = delimiter or next((d for c, d in T.feature_delimiters(df, names).items() if c == names[0]), None)
            return T.atomize_by_row(df, names, found)

        return self._apply("Atomize (row)", by_row)

    def clarify(self, column: str, mapping: DataFrame | str, sum_columns: list[str] | None = None) -> Pipeline:
        table = T.dictionary(self.spark.read.csv(mapping, header=True)) if isinstance(mapping, str) else mapping
        return self._apply(f"Clarify {column}", lambda df: T.clarify(df, column, table, sum_columns))

    def cast_numeric(self, columns: list[str]) -> Pipeline:
        """Text columns to doubles, bad values to null: cleaned tables hold texts and merge asks for numbers."""
        return self._apply("Cast", lambda df: df.withColumns({c: T.q(c).try_cast("double") for c in columns}))

    def merge(self, sum_columns: str | list[str]) -> Pipeline:
        return self._apply("Merge", lambda df: T.merge(df, sum_columns))

    def append_table(self, other: DataFrame | int = 1) -> Pipeline:
        table = self._found[other][1] if isinstance(other, int) else other
        return self._apply("Append", lambda df: T.append(df, table))

    def result(self, table_index: int = 0) -> DataFrame:
        if table_index and table_index < len(self._found):
            return self._found[table_index][1]
        if self._df is None:
            raise ValueError("No table; call detect() and clean() first")
        return self._df

    def all_tables(self) -> list[DataFrame]:
        return [df for _, df in self._found]

    @property
    def log(self) -> list[str]:
        return list(self._log)

    def run(self, shape: str = "wide") -> DataFrame:
        self.detect().clean()
        return (self.to_long() if shape == "long" else self).result()

    def save(self, path: str, table_index: int = 0, **kw) -> None:
        """One file, written by the driver; sinks.write_folder(result(), folder) has the executors write."""
        sinks.save_dataframe(self.result(table_index), path, **kw)

    def __repr__(self) -> str:
        return f"Pipeline(tables={len(self._found)}, columns={self._df.columns if self._df is not None else None})"
