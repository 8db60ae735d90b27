"""Operators on DataFrames: merge, clarify, append, atomize, multi-value detection, flatten."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions import cells
from gridloom.functions import constants as K


#: Text of a mapping that goes to all workers.
MAPPING_BYTES = 64 << 20
#: Of a column's sampled cells, the share that must have the most frequent number of delimiters.
AGREE = 0.9


def q(name: str):
    """A column by its exact name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them where df has such columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def merge(df: DataFrame, sum_column: str | list[str]) -> DataFrame:
    """Sum by all other columns. Rows with a null key are dropped, null sums are 0, output is in key order."""
    sums = [sum_column] if isinstance(sum_column, str) else list(sum_column)
    types = {f.name: f.dataType for f in df.schema.fields}
    for c in sums:
        if c not in types:
            raise KeyError(c)
        if not isinstance(types[c], T.NumericType):
            raise ValueError(f"{c} is not numeric; cast it first")
    keys = [c for c in df.columns if c not in sums]
    totals = [F.coalesce(F.sum(q(c)), F.lit(0)).alias(c) for c in sums]
    if not keys:
        return df.agg(*totals)
    return df.dropna(subset=["`" + k.replace("`", "``") + "`" for k in keys]).groupBy(*[q(k) for k in keys]).agg(*totals).orderBy(*[q(k) for k in keys])


def dictionary(table: DataFrame) -> DataFrame:
    """A mapping sheet (target, addno, synonyms...) as (source, target, addno, ord); later entries have a higher ord."""
    target, addno, *names = table.columns
    entries = F.array(*[F.struct(F.lit(i).alias("i"), q(n).cast("string").alias("source")) for i, n in enumerate(names)])
    rows = table.withColumn("_r", F.monotonically_increasing_id()).select(q(target).alias("target"), q(addno).alias("addno"), "_r", F.explode(entries).alias("e"))
    return rows.filter("e.source is not null").select(cells.strip(F.col("e.source")).alias("source"), cells.strip(F.col("target")).alias("target"), F.col("addno").try_cast("double").alias("addno"), F.struct("e.i", "_r").alias("ord"))


def clarify(df: DataFrame, column: str, mapping: DataFrame, sum_columns: list[str] | None = None, addno_col: str = "clarify_addno", most: int = 1_000_000) -> DataFrame:
    """Map values by dictionary (unmapped ones stay), weight and sum by the remaining columns if sum_columns are given.

    mapping has source, target, addno and ord. Of entries with one source that of highest ord counts. It is broadcast
    while it has `most` rows and MAPPING_BYTES of text at most and joined by shuffle beyond. df may have columns of any
    name, the mapping's included.
    """
    if column not in df.columns:
        raise KeyError(column)
    key, to = fresh(df, "_source", "_to")
    single = mapping.groupBy(F.col("source").alias(key)).agg(F.max_by(F.struct("target", "addno"), "ord").alias(to))
    rows, size = single.limit(most + 1).agg(F.count("*"), F.coalesce(F.sum(F.octet_length(key) + F.octet_length(f"{to}.target")), F.lit(0))).first()
    small = rows <= most and size <= MAPPING_BYTES
    out = df.join(F.broadcast(single) if small else single, cells.strip(q(column)) == F.col(key), "left")
    out = out.withColumn(column, F.coalesce(f"{to}.target", q(column))).withColumn(addno_col, F.coalesce(f"{to}.addno", F.lit(1.0))).drop(to, key)
    if not sum_columns:
        return out.drop(addno_col)
    for c in sum_columns:
        out = out.withColumn(c, F.coalesce(q(c).try_cast("double"), F.lit(0.0)) * F.col(addno_col))
    return merge(out.drop(addno_col), list(sum_columns))


def has_header(df: DataFrame) -> bool:
    """Whether the columns have names of their own: not 0..n-1, _c0.._cn-1 or Unnamed."""
    names = df.columns
    plain = names == [str(i) for i in range(len(names))] or names == [f"_c{i}" for i in range(len(names))] or all(n.startswith("Unnamed:") for n in names)
    return bool(names) and not plain and not df.isEmpty()


def append(df1: DataFrame, df2: DataFrame, strict: bool = False, recover_types: bool = False, df2_header: bool | str = "auto") -> DataFrame:
    """df1's rows, then df2's in df1's columns: by name where df2 has a header, else by position."""
    named = has_header(df2) if df2_header == "auto" else bool(df2_header)
    kinds = dict(df1.dtypes)
    if named:
        extra, missing = [c for c in df2.columns if c not in df1.columns], [c for c in df1.columns if c not in df2.columns]
        if strict and (extra or missing):
            raise ValueError(f"columns differ: missing {missing}, extra {extra}")
        chosen = [q(c) if c in df2.columns else F.lit(None) for c in df1.columns]
    else:
        if strict and len(df1.columns) != len(df2.columns):
            raise ValueError(f"{len(df2.columns)} columns for {len(df1.columns)}")
        chosen = [q(df2.columns[i]) if i < len(df2.columns) else F.lit(None) for i in range(len(df1.columns))]
    if recover_types:
        return df1.unionAll(df2.select(*[c.try_cast(kinds[n]).alias(n) for c, n in zip(chosen, df1.columns, strict=True)]))
    return df1.unionAll(df2.select(*[c.alias(n) for c, n in zip(chosen, df1.columns, strict=True)]))


def compare_structure(df1: DataFrame, df2: DataFrame) -> dict:
    a, b = dict(df1.dtypes), dict(df2.dtypes)
    return {"missing": [c for c in a if c not in b], "extra": [c for c in b if c not in a], "dtype_mismatches": {c: (a[c], b[c]) for c in a if c in b and a[c] != b[c]}}


def parts(c, delimiter: str):
    """The non-empty stripped parts of a cell; null for null."""
    return F.filter(F.transform(F.split(c.cast("string"), r"\Q" + delimiter + r"\E"), cells.strip), lambda x: x != "")


def feature_delimiters(df: DataFrame, columns: list[str] | None = None, candidates: list[str] | None = None, min_score: float = 0.1) -> dict[str, str]:
    """Per column the delimiter that the greatest share of all rows holds, if over min_score; one job for all columns."""
    columns, candidates = columns or df.columns, candidates or K.FEATURE_DELIMITERS
    asked = [F.coalesce(F.avg(F.coalesce(q(c).cast("string").contains(d), F.lit(False)).cast("double")), F.lit(0.0)) for c in columns for d in candidates]
    got = list(df.agg(*[a.alias(f"s{i}") for i, a in enumerate(asked)]).first())
    out = {}
    for i, c in enumerate(columns):
        share = got[i * len(candidates) : (i + 1) * len(candidates)]
        if max(share) > min_score:
            out[c] = candidates[share.index(max(share))]
    return out


def atomize_by_column(df: DataFrame, columns: str | list[str] | None = None, delimiter: str | None = None) -> DataFrame:
    """A row per part; several columns give all combinations; a cell without parts gives a null row."""
    columns = [columns] if isinstance(columns, str) else columns
    found = {c: delimiter for c in columns} if columns and delimiter else feature_delimiters(df, columns)
    for c, d in found.items():
        df = df.withColumn(c, F.explode_outer(parts(q(c), d)))
    return df


def atomize_by_row(df: DataFrame, columns: str | list[str] | None = None, delimiter: str | None = None, value_col: str | None = None, sample: int = 30, order: list[str] | None = None) -> DataFrame:
    """The parts of a cell as columns <column>_1..n behind the others, in place of the column.

    The column is the first of `columns` whose first `sample` values (by `order`, else as they lie) have most often the
    same number of delimiters, one or more and in nine tenths of them at least (the smallest number on ties); rows with
    another number of parts are dropped. Without such a column it is a ValueError. value_col names the column and keeps all
    rows: n is then the greatest number of parts, and what a row lacks is null. A null cell has no parts.
    """
    if not delimiter:
        raise ValueError("a delimiter is needed")
    count = lambda c: F.regexp_count(q(c).cast("string"), F.lit(r"\Q" + delimiter + r"\E"))
    if value_col:
        chosen, n = value_col, None
    else:
        chosen = n = None
        for c in [columns] if isinstance(columns, str) else columns or []:
            rows = df.filter(q(c).isNotNull())
            rows = rows.orderBy(*[q(o) for o in order]) if order else rows
            sizes = [r[0] for r in rows.select(count(c)).limit(sample).collect()]  # the bounded head of the table
            most = min(set(sizes), key=lambda k: (-sizes.count(k), k), default=0)
            if most > 0 and sizes.count(most) >= AGREE * len(sizes):
                chosen, n = c, most + 1
                break
        if chosen is None:
            raise ValueError("no column splits into equally many parts")
    (parts_,) = fresh(df, "_parts")
    split = F.transform(F.split(q(chosen).cast("string"), r"\Q" + delimiter + r"\E"), cells.strip)
    out = df.withColumn(parts_, split)
    if n is None:
        n = out.agg(F.coalesce(F.max(F.size(parts_)), F.lit(0))).first()[0]
    else:
        out = out.filter(F.size(parts_) == n)
    return out.select(*[q(c) for c in df.columns if c != chosen], *[F.get(parts_, F.lit(i)).alias(f"{chosen}_{i + 1}") for i in range(max(n, 0))])


def multivalue_columns(df: DataFrame, candidates: list[str] | None = None, min_overlap: float = 0.3, min_multi_ratio: float = 0.1) -> DataFrame:
    """(column, delimiter, confidence) of columns whose cells hold lists, most confident first.

    One aggregation judges all columns and delimiters by how many cells split and into how much; of the columns and
    delimiters that pass, a row each, the cells are then exploded and their parts counted.
    """
    candidates = candidates or K.MULTIVALUE_DELIMITERS
    entries = [F.struct(F.lit(i).alias("pos"), q(c).cast("string").alias("v")) for i, c in enumerate(df.columns)]
    long = df.select(F.explode(F.array(*entries)).alias("e")).select("e.*").filter("v is not null")
    split = [parts(F.col("v"), d) for d in candidates]
    words = lambda atoms: F.aggregate(atoms, F.lit(0), lambda a, x: a + F.size(F.filter(F.split(x, r"(?U)\s+"), lambda w: w != "")))
    asked = [F.count("*").alias("n"), F.avg(cells.strip(F.col("v")).rlike("(?i)" + K.SINGLE_DATE).cast("double")).alias("dates")]
    for i, (d, atoms) in enumerate(zip(candidates, split, strict=True)):
        multi = F.col("v").contains(d) & (F.size(atoms) > 1)
        n = F.when(multi, F.size(atoms))
        asked += [F.count_if(multi).alias(f"m{i}"), F.sum(n).alias(f"a{i}"), F.sum(F.when(multi, words(atoms))).alias(f"w{i}")]
    passed: dict[tuple[int, int], float] = {}
    for r in long.groupBy("pos").agg(*asked).collect():  # a row per column
        if r.n >= 3 and r.dates < 0.8:
            for i in range(len(candidates)):
                ratio = r[f"m{i}"] / r.n
                if ratio >= min_multi_ratio and ratio > 0:
                    listed = ratio >= 0.5 and r[f"a{i}"] >= 3 * r[f"m{i}"] and r[f"w{i}"] <= 4 * r[f"a{i}"]
                    passed[r.pos, i] = ratio if listed else 0.0
    schema = "column string, delimiter string, confidence double"
    if not passed:
        return df.sparkSession.createDataFrame([], schema)
    tried = [F.when(F.col("pos").isin([p for p, k in passed if k == i]), F.struct(F.lit(i).alias("ord"), atoms.alias("atoms"))) for i, atoms in enumerate(split) if any(k == i for _, k in passed)]
    each = long.filter(F.col("pos").isin(sorted({p for p, _ in passed}))).select("pos", F.explode(F.filter(F.array(*tried), lambda x: x.isNotNull())).alias("t"))
    each = each.select("pos", "t.ord", (F.size("t.atoms") > 1).alias("multi"), F.explode("t.atoms").alias("atom"))
    each = each.groupBy("pos", "ord", "atom").agg(F.count("*").alias("n"), F.max("multi").alias("in_multi"), F.max(~F.col("multi")).alias("in_single"))
    overlap = each.filter("in_multi").groupBy("pos", "ord").agg(F.avg((F.col("in_single") | (F.col("n") > 1)).cast("double"))).collect()  # a row per column and delimiter
    best: dict[int, tuple[float, int]] = {}
    for pos, i, share in sorted(overlap):
        score = max(share, passed[pos, i])
        if score >= min_overlap and score > best.get(pos, (0.0, 0))[0]:
            best[pos] = (score, i)
    rows = [(df.columns[p], candidates[i], round(score, 3)) for p, (score, i) in sorted(best.items(), key=lambda x: (-x[1][0], x[0]))]
    return df.sparkSession.createDataFrame(rows, schema)


def melt(df: DataFrame, stubs: list[str], levels: list[list[str | None]], vertical_names: list[str] | None = None, horizontal_names: list[str] | None = None, value_name: str = "value") -> DataFrame:
    """Unpivot all columns but the stubs; levels holds the header parts of each, null parts as [NaN]. Nulls are kept."""
    values = [c for c in df.columns if c not in stubs]
    depth = max((len(x) for x in levels), default=1)
    across = _named(horizontal_names, "horizontal", depth)
    down = _named(vertical_names, "vertical", len(stubs))
    one = lambda c, x: F.struct(*[F.lit(NAN if p is None else p).alias(n) for p, n in zip([*x, *[None] * (depth - len(x))], across, strict=True)], q(c).cast("string").alias(value_name))
    (cell,) = fresh(df, "_cell")
    cells_ = F.explode(F.array(*[one(c, x) for c, x in zip(values, levels, strict=True)])).alias(cell)
    return df.select(*[q(s).alias(d) for s, d in zip(stubs, down, strict=True)], cells_).select(*[q(d) for d in down], f"{cell}.*")


NAN = "[NaN]"


def _named(names: list[str] | None, kind: str, n: int) -> list[str]:
    return list(names) if names and len(names) == n else [f"{kind}_{i + 1}" for i in range(n)]


def flatten(grid: DataFrame, header_rows: int | None = None, header_cols: int | None = None, horizontal_names: list[str] | None = None, vertical_names: list[str] | None = None, value_name: str = "value") -> DataFrame:
    """A grid (r, cells) with header_rows rows of column heads and header_cols columns of row heads to long form: the row
    heads, the column heads, the value; column after column. Null heads read [NaN], null values stay.

    Rows of heads are found, where not given, as the parse path finds them (one more than the last of them), columns of
    heads by the greatest block of numbers, over BLOCK_ROWS rows of the body; a ValueError where that isn't most of the width.
    """
    from gridloom.operators import areas

    if header_rows is None:
        head = grid.filter(F.col("r") <= areas.HEAD + 1).orderBy("r").collect()  # a bounded head
        header_rows = areas.header_end(areas.Frame([list(x.cells) for x in head]).kind) + 1
    if header_cols is None:
        rows = grid.filter(F.col("r") < header_rows + BLOCK_ROWS).orderBy("r").collect()  # a bounded head
        header_cols = areas.stub_columns(areas.Frame([list(x.cells) for x in rows]), header_rows)
    top = grid.filter(F.col("r") < header_rows).orderBy("r").collect()  # the rows of heads
    width = grid.agg(F.coalesce(F.max(F.size("cells")), F.lit(0))).first()[0]
    heads = [[x.cells[c] if c < len(x.cells) else None for x in top] for c in range(header_cols, width)]
    across, down = _named(horizontal_names, "horizontal", header_rows), _named(vertical_names, "vertical", header_cols)
    cell = lambda c: F.get("cells", F.lit(c))
    one = lambda c, x: F.struct(F.lit(c).alias("_c"), *[F.lit(NAN if v is None else v).alias(f"h{i}") for i, v in enumerate(x)], cell(c).alias("v"))
    values = F.explode(F.array(*[one(c, x) for c, x in enumerate(heads, header_cols)])).alias("e")
    body = grid.filter(F.col("r") >= header_rows).select("r", *[F.coalesce(cell(i), F.lit(NAN)).alias(f"s{i}") for i in range(header_cols)], values)
    named = [*[F.col(f"s{i}").alias(n) for i, n in enumerate(down)], *[F.col(f"e.h{i}").alias(n) for i, n in enumerate(across)], F.col("e.v").alias(value_name)]
    return body.orderBy("e._c", "r").select(*named)


#: Rows of the body in which flatten looks for the block of numbers.
BLOCK_ROWS = 10_000


def union_parts(parts_: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts_)
