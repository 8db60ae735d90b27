"""Registered queries over whole sheets that are made from the tables: a noisy grid for each nation, and their SQL.

The SQL works the same things out anew, by relational features of rows and columns or by the counts from which a sheet is
built; none of it holds expected rows.
"""

from __future__ import annotations

import io

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions import cells, codes
from gridloom.functions import constants as K
from gridloom.operators import areas as A
from gridloom.operators import detect as D
from gridloom.operators import grid as G
from gridloom.operators import model as M
from gridloom.operators import quality as Q
from gridloom.operators import tabular as T
from gridloom.plans.catalogue import _LISTED, _VALUES, _listed, _sql_clean, _sql_label, _sql_summary, _sql_type, _sql_year, _t, _values
from gridloom.sources import audit, csvgrid, files, store, xlsx

HEAD = ["key", "name", "segment", "balance"]


def _numbered(spark: SparkSession, sf: str, table: str, p: str) -> DataFrame:
    """(nation, i, row) of customers or suppliers, numbered within their nation from 0."""
    df = _t(spark, sf, table)
    last = F.col("c_mktsegment") if p == "c" else F.lit("SUPPLY")
    key = F.col(f"{p}_custkey" if p == "c" else f"{p}_suppkey")
    row = F.array(key.cast("string"), F.concat(F.lit("customer " if p == "c" else "supplier "), key.cast("string")), last, F.format_string("%.2f", f"{p}_acctbal"))
    place = F.row_number().over(W.partitionBy(f"{p}_nationkey").orderBy(key)) - 1
    return df.select(F.col(f"{p}_nationkey").alias("nation"), place.cast("long").alias("i"), row.alias("row"))


def nation_sheets(spark: SparkSession, sf: str) -> DataFrame:
    """(source, r, cells): a sheet per nation: a title, a blank row, heads, its customers, their total."""
    rows = _numbered(spark, sf, "customer", "c")
    source = F.concat(F.lit("n"), F.col("nation").cast("string")).alias("source")
    some = rows.groupBy("nation").agg(F.count("*").alias("n"))
    line = lambda r, *cells: F.struct(r.cast("long").alias("r"), F.array(*cells).alias("cells"))
    none = F.lit("")
    fixed = F.array(line(F.lit(0), F.lit("Customers by nation"), none, none, none), line(F.lit(1), none, none, none, none), line(F.lit(2), *map(F.lit, HEAD)), line(F.col("n") + 3, F.lit("Total"), none, none, F.col("n").cast("string")))
    return rows.select(source, (F.col("i") + 3).alias("r"), F.col("row").alias("cells")).union(some.select(source, F.explode(fixed).alias("e")).select("source", "e.r", "e.cells"))


_GRID = """rows_ as (select c_nationkey as nation, row_number() over (partition by c_nationkey order by c_custkey) - 1 as i,
  [cast(c_custkey as varchar), 'customer ' || c_custkey, c_mktsegment, printf('%.2f', c_acctbal)] as cells from customer),
sizes_ as (select nation, 'n' || nation as source, count(*) as n from rows_ group by nation),
grid as (select 'n' || nation as source, cast(i + 3 as bigint) as r, cells from rows_
 union all select source, 0, ['Customers by nation', '', '', ''] from sizes_ union all select source, 1, ['', '', '', ''] from sizes_
 union all select source, 2, ['key', 'name', 'segment', 'balance'] from sizes_ union all select source, n + 3, ['Total', '', '', cast(n as varchar)] from sizes_)"""


def paired_sheets(spark: SparkSession, sf: str) -> DataFrame:
    """A sheet per nation that has suppliers: customers over suppliers, three blank rows between, or beside each other with a
    blank column between, as the nation's number is even or odd."""
    c, s = _numbered(spark, sf, "customer", "c"), _numbered(spark, sf, "supplier", "s")
    sizes = c.groupBy("nation").agg(F.count("*").alias("n")).join(s.groupBy("nation").agg(F.count("*").alias("m")), "nation").filter("m >= 2 and n >= 2")
    head = F.array(*[F.lit(h) for h in HEAD])
    with_head = lambda t, size: t.join(sizes, "nation").select("nation", "n", (F.col("i") + 1).alias("i"), "row").union(sizes.select("nation", "n", F.lit(0).cast("long"), head))
    a, b = with_head(c, "n"), with_head(s, "m")
    source = F.concat(F.lit("p"), F.col("nation").cast("string")).alias("source")
    over = a.filter("nation % 2 = 0").select(source, F.col("i").alias("r"), F.col("row").alias("cells")).union(b.filter("nation % 2 = 0").select(source, F.col("i") + F.col("n") + 4, "row"))
    left, right = a.filter("nation % 2 = 1").select("nation", "i", F.col("row").alias("x")), b.filter("nation % 2 = 1").select("nation", "i", F.col("row").alias("y"))
    none = F.array(*[F.lit("")] * 4)
    beside = left.join(right, ["nation", "i"], "full").select(source, F.col("i").alias("r"), F.concat(F.coalesce("x", none), F.array(F.lit("")), F.coalesce("y", F.array().cast("array<string>"))).alias("cells"))
    return over.union(beside)


_SIZES = """sizes as (select c.nation, 'p' || c.nation as source, n, m from (select c_nationkey as nation, count(*) as n from customer group by 1) c
 join (select s_nationkey as nation, count(*) as m from supplier group by 1) s using (nation) where m >= 2 and n >= 2)"""


def row_entropy(spark, sf):
    f = G.row_features(nation_sheets(spark, sf))
    return f.select("source", "r", "filled", F.round("fill_rate", 6).alias("fill_rate"), F.round("datalike", 6).alias("datalike"), F.round("entropy", 6).alias("entropy"), "title", "summary")


def column_shares(spark, sf):
    return G.column_classes(nation_sheets(spark, sf), 2, 1 << 30).withColumns({c: F.round(c, 6) for c in ("fill", "datalike", "entropy")})


def rules_by_sheet(spark, sf):
    return G.strategy_rules(nation_sheets(spark, sf))


def bands_by_sheet(spark, sf):
    return G.best_band(nation_sheets(spark, sf))


def sheet_candidates(spark, sf):
    """What each of the six strategies makes of every nation's sheet, and its quality."""
    return D.candidates(nation_sheets(spark, sf)).drop("table_no")


def sheet_tables(spark, sf):
    """The table found in every nation's sheet by the strategies' competition."""
    return D.detect(nation_sheets(spark, sf))


def strategy_board(spark, sf):
    return Q.leaderboard(D.candidates(nation_sheets(spark, sf)))


def paired_tables(spark, sf):
    """Two tables in a sheet, over or beside each other."""
    return D.detect(paired_sheets(spark, sf)).drop("quality")


def gap_tables(spark, sf):
    return A.gaps(paired_sheets(spark, sf))


def sheet_models(spark, sf):
    m = M.models(nation_sheets(spark, sf))
    return m.withColumn("names", F.concat_ws(";", "stubs", F.flatten("levels"))).drop("stubs", "levels", "quality")


def sheet_tidy(spark, sf):
    """All nations' tables in long form at once."""
    sheets = nation_sheets(spark, sf)
    t = M.tidy(sheets, M.models(sheets))
    return t.select("source", "table_no", "r", "c", F.concat_ws(";", "stubs").alias("stubs"), F.concat_ws(";", "labels").alias("labels"), "value")


def streamed_tidy(spark, sf):
    """The same by a stream over CSV files, one for each nation."""
    from gridloom import streaming

    place = store.folder(spark)
    line = F.array_join("cells", ",").alias("line")
    lines = nation_sheets(spark, sf).select("source", "r", line).groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "line"))), lambda x: x["line"]), "\n").alias("value"))
    lines.repartition(4, "source").write.option("lineSep", "\n\n\n\n").partitionBy("source").text(f"{place}/text")
    names = [r[0] for r in lines.select("source").orderBy("source").collect()]  # a file for each nation
    fs, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    for n in names:  # text files get the name that the stream looks for
        for f in fs.Path(f"{place}/text").getFileSystem(conf).globStatus(fs.Path(f"{place}/text/source={n}/part-*")):
            f.getPath().getFileSystem(conf).rename(f.getPath(), fs.Path(f"{place}/text/{n}.csv"))
    streaming.tidy_files(spark, f"{place}/text", f"{place}/out", f"{place}/state").awaitTermination()
    t = spark.read.parquet(f"{place}/out")
    return t.select(F.regexp_extract("source", r"([^/]+)\.csv$", 1).alias("source"), "table_no", "r", "c", F.concat_ws(";", "stubs").alias("stubs"), F.concat_ws(";", "labels").alias("labels"), "value")


def robust_areas(spark, sf):
    return A.find(nation_sheets(spark, sf))


def dense_areas(spark, sf):
    return A.find(nation_sheets(spark, sf), lambda frame: A.dense_box(frame.filled))


def header_ends(spark, sf):
    """The last row above the data, as `top`."""
    return A.find(nation_sheets(spark, sf), lambda frame: (A.header_end(frame.kind), 0, 0, 0)).select("source", "top")


def number_blocks(spark, sf):
    """The greatest block of numbers: (top, bottom, left, right)."""
    def judge(frame):
        top, bottom, left, right = A.soft_rectangle(A.numbers(frame))
        return top, left, bottom, right

    return A.find(nation_sheets(spark, sf), judge)


def parse_classes(spark, sf):
    v = F.col("v")
    return _values(spark, sf).select(
        "v", cells.classify(v).alias("kind"), cells.nan_like_to_null(v).alias("kept"), cells.numeric_or_nan_like(v).alias("numeric_or_nan"), cells.sanitised(v).alias("sanitised"), cells.runs_as_formula(v).alias("formula")
    )


def cell_codes(spark, sf):
    """Cell classes as the workers give them; the same SQL as in the JVM."""
    def run(batches):
        names = np_names
        for x in batches:
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array([names[c & 3] for c in codes.coded(x.column(0)).tolist()])], names=["v", "kind"])

    np_names = ["empty", "numeric", "date", "text"]
    return _values(spark, sf).select("v").mapInArrow(run, "v string, kind string")


def sql_functions(spark, sf):
    """The cell functions called from SQL."""
    from gridloom.functions import sql

    sql.register(spark)
    _values(spark, sf).createOrReplaceTempView("gl_values")
    return spark.sql("select v, gl_cell_type(v) as kind, gl_clean(v) as cleaned, gl_year(v) as year, gl_is_label(v) as is_label, gl_hints_id(v) as hints_id, gl_is_summary_row(array(v, 'x')) as summary from gl_values")


def flatten_grid(spark, sf):
    """A crosstab of orders by status and priority, its heads found, to long form."""
    by = _t(spark, sf, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count("o_orderkey")).na.fill(0)
    place = F.row_number().over(W.orderBy("o_orderpriority")).cast("long")  # five rows
    rows = by.select(place.alias("r"), F.array("o_orderpriority", *[F.col(c).cast("string") for c in "FOP"]).alias("cells"))
    head = spark.createDataFrame([(0, [None, "F", "O", "P"])], "r long, cells array<string>")
    grid = head.union(rows)
    return T.flatten(grid, 1, 1, horizontal_names=["status"], value_name="orders")


def atomize_ragged(spark, sf):
    """Part names, of any number of words, to columns."""
    return T.atomize_by_row(_t(spark, sf, "part").select("p_partkey", F.concat_ws("-", F.slice(F.split("p_name", " "), 1, 1 + F.col("p_partkey").cast("int") % 2)).alias("w")), value_col="w", delimiter="-")


def multivalue_limits(spark, sf):
    """Dates, sentences and keys beside real lists: only the lists count."""
    o = _t(spark, sf, "orders")
    return T.multivalue_columns(o.select(
        F.date_format("o_orderdate", "M/d/yyyy").alias("day"), F.concat_ws(",", F.lit("the order that was placed then"), F.col("o_orderkey").cast("string"), F.lit("came by ship as it always did"), F.lit("and it was late again as well")).alias("note"),
        F.concat_ws(";", "o_orderstatus", F.substring("o_orderpriority", 1, 1)).alias("codes")))


def structure(spark, sf):
    """How supplier's columns differ from customer's, renamed to the same prefix."""
    strip = lambda t, p: _t(spark, sf, t).select(*[F.col(c).alias(c[2:]) for c in _t(spark, sf, t).columns])
    found = T.compare_structure(strip("customer", "c").withColumn("acctbal", F.col("acctbal").cast("string")), strip("supplier", "s"))
    rows = [("missing", c) for c in found["missing"]] + [("extra", c) for c in found["extra"]] + [("dtype", c) for c in found["dtype_mismatches"]]
    return spark.createDataFrame(rows, "kind string, name string")


def file_audit(spark, sf):
    """A small CSV file for each customer, some with formulas, scripts or foreign content."""
    k = F.col("c_custkey")
    note = F.when(k % 3 == 0, "=1+1").when(k % 5 == 0, "<script >").when(k % 7 == 0, "-12.5").otherwise("ok")
    text = F.concat(F.when(k % 11 == 0, "MZ").otherwise(""), F.lit("name,note\n"), F.col("c_name"), F.lit(","), note)
    return audit.audit(_t(spark, sf, "customer").select(F.format_string("c%d.csv", k).alias("source"), text.cast("binary").alias("content"))).select("source", "bytes", "severity", F.size("findings").alias("findings"))


def file_prints(spark, sf):
    k = F.col("c_custkey")
    text = F.concat(F.lit("key;name\n"), k.cast("string"), F.lit(";"), F.col("c_name"))
    return files.fingerprints(_t(spark, sf, "customer").select(F.format_string("c%d.csv", k).alias("source"), text.cast("binary").alias("content")))


def _workbooks(spark: SparkSession, sf: str) -> DataFrame:
    """(source, content): a workbook per nation: a cover of one cell, and the nation's sheet with a merged title and borders
    around the table."""
    def run(key, t):
        t = t.sort_by("r")
        rows, out = t["cells"].to_pylist(), io.BytesIO()
        xlsx.write(out, {"cover": [["about"]], "data": rows}, {"data": ["A1:D1"]}, {"data": (2, 0, len(rows) - 1, 4)})
        return pa.table({"source": [key[0].as_py() + ".xlsx"], "content": pa.array([out.getvalue()], pa.binary())})

    return nation_sheets(spark, sf).groupBy("source").applyInArrow(run, "source string, content binary")


def workbook_rows(spark, sf):
    """The chosen sheet of every workbook, merged cells filled."""
    return xlsx.parsed(_workbooks(spark, sf), fill_merged=True).select("source", "r", F.array_join("cells", ";").alias("cells"))


def workbook_sheets(spark, sf):
    return xlsx.sheets(_workbooks(spark, sf)).select("source", "sheet", "position", "chosen", "merges", "border.*")


def workbook_tables(spark, sf):
    """Tables found in the workbooks."""
    return D.detect(xlsx.parsed(_workbooks(spark, sf))).drop("quality")


def table_scores(spark, sf):
    """Scores against a truth that is a row too long."""
    sheets = nation_sheets(spark, sf)
    n = sheets.groupBy("source").agg(F.max("r").alias("last")).collect()  # a row for each nation
    got = Q.score_sheets(sheets, {r.source: [D.Region(2, 3, 0, r.last, 4)] for r in n})
    return got.select("source", "tables", "true_tables", *[F.round(c, 6).alias(c) for c in ("iou", "header", *Q.SCORES)])


def scores_by_size(spark, sf):
    """The scorecard: sheets by size, passed where the overlap is great enough."""
    s = table_scores(spark, sf)
    sizes = nation_sheets(spark, sf).groupBy("source").agg(F.max("r").alias("last"))
    rows = s.join(sizes, "source").select(F.when(F.col("last") % 2 == 0, "even").otherwise("odd").alias("group"), ((F.col("tables") == F.col("true_tables")) & (F.col("iou") >= Q.PASS_IOU)).alias("passed"), "iou", "header")
    return Q.scorecard(rows)


def pipeline_frame(spark, sf):
    """The fluent pipeline on a DataFrame: detect, clean, atomize, clarify with sums."""
    from gridloom.pipeline import Pipeline

    df = _listed(spark, sf).select(F.format_string("%06d", "p_partkey").alias("part"), "tags", F.lit("1").alias("count"))
    mapping = T.dictionary(spark.createDataFrame([("STEEL", "2", "STANDARD STEEL", "steel")], "target string, addno string, s1 string, s2 string"))
    p = Pipeline(df, spark=spark, order=["part"]).detect().clean().atomize("tags", ",")
    return p.use(p.result().drop("part")).clarify("tags", mapping, ["count"]).result()


def pipeline_long(spark, sf):
    from gridloom.pipeline import Pipeline

    n = _t(spark, sf, "nation").select(F.col("n_name").alias("nation name"), F.col("n_regionkey").cast("string").alias("first"), (F.col("n_regionkey") * 7).cast("string").alias("second"))
    return Pipeline(n, spark=spark, order=["nation name"]).run("long")


_NAMES = [row_entropy, column_shares, rules_by_sheet, bands_by_sheet, sheet_candidates, sheet_tables, strategy_board, paired_tables, gap_tables, sheet_models, sheet_tidy, streamed_tidy, robust_areas, dense_areas, header_ends, number_blocks, parse_classes, cell_codes, sql_functions, flatten_grid, atomize_ragged, multivalue_limits, structure, file_audit, file_prints, workbook_rows, workbook_sheets, workbook_tables, table_scores, scores_by_size, pipeline_frame, pipeline_long]


def queries() -> dict:
    return {f.__name__: f for f in _NAMES}


def _candidates_sql() -> str:
    """CTEs up to cand(source, strategy, header, top, l, b, x) and scored(..., quality): the six strategies and the quality
    from features of rows and columns. All rows of these sheets are four cells wide, and no cell changes in normal form."""
    share = lambda k: f"case when {k} > 0 then -({k} / n) * log2({k} / n) else 0 end"
    first = lambda lo, hi, otherwise: f"coalesce((select min(r) from f f2 where f2.source = s.source and r >= {lo} and r < {hi} and n >= 2 and 2 * (n - num) > n), {otherwise})"
    last = lambda lo, otherwise: f"coalesce((select max(r) from f f2 where f2.source = s.source and r >= {lo} and rate >= 0.3), {otherwise})"
    return f"""{_GRID},
x as (select source, r, c, v, {_sql_type('v')} as k from (select source, r, unnest(range(4)) as c, unnest(cells) as v from grid)),
f0 as (select source, r, count(*) filter (where k <> 'empty') as n, count(*) filter (where k = 'numeric') as num, count(*) filter (where k = 'date') as dat, count(*) filter (where k = 'text') as txt,
        list(k order by c) filter (where k <> 'empty') as ks from x group by source, r),
f as (select f0.*, n / 4 as rate, case when n > 0 then {share('num')} + {share('dat')} + {share('txt')} else 0 end as h, {_sql_summary('cells')} as summary from f0 join grid using (source, r)),
s as (select source, cast(count(*) as bigint) as rows_, max(n) as most from f group by source),
a as (select source, header, header + 1 as top, greatest(coalesce((select max(r) from f where f.source = o.source and r > header and rate >= 0.3 and not summary), header), header + 1) as b
      from (select source, coalesce((select min(r) from f where f.source = s.source and r < 20 and rate > 0.5), 0) as header from s) o),
b0 as (select p.source, p.r, abs(p.h - q.h) + 0.1 * len(list_filter(range(least(p.n, q.n)), lambda i: p.ks[i + 1] <> q.ks[i + 1])) as score
      from f p join f q on p.source = q.source and q.r = p.r + 1 join s on s.source = p.source where p.r < least(rows_ - 1, 20) and p.rate >= 0.3),
b as (select source, header + 1 as top, header, greatest(header + 1, {last('header + 1', 'header + 1')}) as b from (select s.source, coalesce(arg_max(r, score order by r), 0) as header from s left join b0 using (source) group by s.source) s),
c0 as (select s.source, rows_, min(r) as fst from f join s using (source) where n / most >= 0.3 group by s.source, rows_),
c1 as (select s.*, coalesce((select max(r) from f join s s2 using (source) where f.source = s.source and r > fst and n / most >= 0.3), rows_ - 1) as lst from c0 s),
c as (select source, header, header + 1 as top, lst as b from (select *, {first('fst', 'least(fst + 10, lst)', 'fst')} as header from c1 s)),
d as (select source, header, header + 1 as top, {last('header + 1', 'rows_ - 1')} as b from (select *, {first('0', '20', '0')} as header from s) s),
e0 as (select p.source, p.r, avg(q.rate) as m from f p join s using (source) join f q on q.source = p.source and q.r between p.r - least(5, greatest(1, rows_ // 4)) // 2 and p.r + least(5, greatest(1, rows_ // 4)) // 2 group by p.source, p.r),
e1 as (select *, sum(case when m >= 0.4 then 0 else 1 end) over (partition by source order by r) as island from e0),
e2 as (select source, min(r) as fst, max(r) as lst, sum(m) as score from e1 where m >= 0.4 group by source, island),
e3 as (select source, fst, lst from e2 qualify row_number() over (partition by source order by score desc, fst) = 1),
e4 as (select s.source, rows_, case when lst > fst then fst else 0 end as fst, case when lst > fst then lst else rows_ - 1 end as lst from s left join e3 using (source)),
e as (select source, header, header + 1 as top, greatest(lst, header + 1) as b from (select *, {first('fst', 'least(fst + 10, lst)', 'fst')} as header from e4 s)),
g0 as (select *, {first('0', '20', '0')} as header from s),
g1 as (select x.source, c, k, count(*) as times, min(r) as met from x join g0 using (source) where r > header and k <> 'empty' group by x.source, c, k),
g2 as (select source, c, k as chief from g1 qualify row_number() over (partition by source, c order by times desc, met) = 1),
g3 as (select x.source, r, avg(case when k = 'empty' then 0.5 when k = chief then 1 when k in ('numeric', 'date') and chief in ('numeric', 'date') then 0.8 else 0 end) as vote, count(*) filter (where k <> 'empty') as n
       from x join g0 using (source) join g2 using (source, c) where r > header group by x.source, r),
g as (select g0.source, header, coalesce(min(r), header + 1) as top, coalesce(max(r), rows_ - 1) as b from g0 left join (select * from g3 where n > 0 and vote >= 0.5 - 1e-12) g3 using (source) group by g0.source, header, rows_),
every as (select 'A' as strategy, source, header, top, b from a union all select 'B', source, header, top, b from b union all select 'C', source, header, top, b from c
  union all select 'D', source, header, top, b from d union all select 'E', source, header, top, b from e union all select 'F', source, header, top, b from g),
sides as (select y.source, strategy, c, count(*) filter (where k <> 'empty') / count(*) as fill from every y join f using (source) join x using (source, r) where r between top and b and f.n > 0 group by y.source, strategy, c),
cand as (select y.source, y.strategy, header, top, case when y.strategy in ('A', 'F') then 0 else coalesce(min(c) filter (where fill >= 0.1), 0) end as l, b, case when y.strategy in ('A', 'F') then 4 else coalesce(max(c) filter (where fill >= 0.1) + 1, 4) end as x
  from every y left join sides using (source, strategy) group by y.source, y.strategy, header, top, b),
kind as (select y.source, strategy, c, coalesce(greatest(count(*) filter (where k = 'numeric'), count(*) filter (where k = 'date'), count(*) filter (where k = 'text')) / nullif(count(*) filter (where k <> 'empty'), 0), 0.5) as agree
  from cand y join x using (source) where r between top and b and c between l and y.x - 1 group by y.source, strategy, c),
fills as (select y.source, strategy, r, count(*) filter (where k <> 'empty') as n, count(*) filter (where k = 'numeric') as num from cand y join x using (source) where c between l and y.x - 1 group by y.source, strategy, r),
q1 as (select y.source, y.strategy, b - top + 1 as high, y.x - l as wide, avg(n) filter (where r between top and b) as mean_, var_pop(n) filter (where r between top and b) as var_, avg(n) filter (where r in (top - 1, b + 1)) as around,
        max(case when r = header then case when n > 0 then (n - num) / n else 0 end end) as titled from cand y join fills using (source, strategy) group by y.source, y.strategy, high, wide),
q2 as (select q1.*, (select avg(agree) from kind where kind.source = q1.source and kind.strategy = q1.strategy) as agree, rows_, case when around is null then mean_ / wide else greatest(0, (mean_ - around) / wide) end as sharp from q1 join s using (source)),
scored as (select cand.*, round(0.25 * agree + 0.15 * case when high > 1 then 1 - least(var_ / greatest(wide * wide / 4, 1), 1) else 1 end + 0.2 * coalesce(titled, 0.5) + 0.15 * least(2 * sharp, 1)
        + 0.15 * least(high * wide / (rows_ * 4), 1) + 0.1 * least(5 * high / rows_, 1), 4) as quality from cand join q2 using (source, strategy))"""


def oracle_sql() -> dict[str, str]:
    box = "cast(header as int) as header, cast(top as int) as top, cast(l as int) as left_col, cast(b as int) as bottom, cast(x as int) as right_col"
    share = lambda k, n: f"case when {k} > 0 then -({k} / {n}) * log2({k} / {n}) else 0 end"
    numeric = f"(regexp_matches(v, '{K.FLOAT}') or regexp_matches(v, '(?i){K.NOT_FINITE}'))"
    classes = f"case when trim(v) = '' then 'empty' when regexp_matches(trim(v), '^[0-9]+$') or {numeric} then 'numeric' else 'string' end"
    nan = "(" + ", ".join(f"'{m}'" for m in K.NAN_LIKE) + ")"
    signed = f"(length(trim(v)) > 1 and regexp_matches(trim(v), '^[+-]') and (regexp_matches(replace(substr(trim(v), 2), ',', ''), '{K.FLOAT}') or regexp_matches(replace(substr(trim(v), 2), ',', ''), '(?i){K.NOT_FINITE}')))"
    tidy = f"with {_GRID} select source, 0::int as table_no, r, 0::int as c, cells[1] || ';' || cells[2] || ';' || cells[3] as stubs, 'balance' as labels, cells[4] as value from grid join sizes_ using (source) where r between 3 and n + 2"
    kinds = f"{_GRID}, x as (select source, r, unnest(range(4)) as c, unnest(cells) as v from grid), t as (select *, {classes} as k from x)"
    cand = _candidates_sql()
    parts = "o.o_orderstatus"
    return {
        "row_entropy": f"""with {_GRID}, x as (select source, r, cells, c, {_sql_type('v')} as k from (select source, r, cells, unnest(range(4)) as c, unnest(cells) as v from grid)),
            t as (select source, r, cells, count(*) filter (where k <> 'empty') as n, count(*) filter (where k = 'numeric') as a, count(*) filter (where k = 'date') as b, count(*) filter (where k = 'text') as d, count(*) filter (where c > 1 and k <> 'empty') as late from x group by all)
            select source, r, cast(n as int) as filled, round(n / 4, 6) as fill_rate, round(case when n > 0 then (a + b) / n else 0 end, 6) as datalike, round(case when n > 0 then {share('a', 'n')} + {share('b', 'n')} + {share('d', 'n')} else 0 end, 6) as entropy,
            n between 1 and 2 and late = 0 and a = 0 as title, {_sql_summary('cells')} as summary from t""",
        "column_shares": f"""with {kinds}, y as (select *, {_sql_type('v')} as t from t where r >= 2),
            z as (select source, c, count(*) as n, count(*) filter (where k = 'numeric') as a, count(*) filter (where k = 'string') as b, count(*) filter (where t in ('numeric', 'date')) as d, count(*) filter (where t <> 'empty') as s from y group by source, c)
            select source, cast(c as int) as c, n, round((a + b) / n, 6) as fill, round(coalesce(d / nullif(s, 0), 0), 6) as datalike, round({share('a', 'n')} + {share('b', 'n')} + {share('(n - a - b)', 'n')}, 6) as entropy from z""",
        "rules_by_sheet": f"with {cand} select source, header, top, 0 as left_col, cast(b as bigint) as bottom, 4::int as right_col from a",
        "bands_by_sheet": f"with {cand} select source, fst as top, lst as bottom, round(score, 6) as score from e2 qualify row_number() over (partition by source order by score desc, fst) = 1",
        "sheet_candidates": f"with {cand} select source, strategy, {box}, quality from scored",
        "sheet_tables": f"with {cand} select source, 0::int as table_no, {box}, quality from scored qualify row_number() over (partition by source order by quality desc, strategy) = 1",
        "strategy_board": f"with {cand}, w as (select *, max(quality) over (partition by source) as best, row_number() over (partition by source order by quality desc, strategy) as place from scored) select strategy, round(avg(quality), 6) as quality, count(*) filter (where place = 1) as wins, round(avg(best - quality), 6) as gap from w group by strategy",
        "paired_tables": f"""with {_SIZES} select source, 0::int as table_no, 0::int as header, 1::int as top, 0::int as left_col, cast(n as int) as bottom, 4::int as right_col from sizes
            union all select source, 1, case when nation % 2 = 0 then n + 4 else 0 end::int, case when nation % 2 = 0 then n + 5 else 1 end::int, case when nation % 2 = 0 then 0 else 5 end::int, case when nation % 2 = 0 then n + 4 + m else m end::int, case when nation % 2 = 0 then 4 else 9 end::int from sizes""",
        "gap_tables": f"""with {_SIZES} select source, 0::int as table_no, 0::int as header, 1::int as top, 0::int as left_col, cast(n as int) as bottom, 4::int as right_col from sizes where nation % 2 = 0
            union all select source, 1, (n + 4)::int, (n + 5)::int, 0, (n + 4 + m)::int, 4 from sizes where nation % 2 = 0""",
        "sheet_models": f"with {_GRID} select source, 0::int as table_no, 2::int as hdr_first, 2::int as hdr_last, 3::int as stub_end, 3::int as top, 0::int as left_col, cast(n + 2 as int) as bottom, 4::int as right_col, 2::int as leaf, true as has_rows, 'key;name;segment;balance' as names from sizes_",
        "sheet_tidy": tidy,
        "streamed_tidy": tidy,
        "robust_areas": f"with {_GRID} select source, 2::int as top, 0::int as left_col, cast(n + 3 as int) as bottom, 4::int as right_col from sizes_ where n >= 20 union all select source, (n + 2)::int, 0, (n + 4)::int, 4 from sizes_ where n < 20",
        "dense_areas": f"""with {kinds}, p as (select source, r, count(*) filter (where k <> 'empty') as n from t group by source, r), m as (select source, max(n) as most from p group by source),
            y as (select source, min(r) as top, max(r) + 1 as bottom from p join m using (source) where n / most >= 0.3 group by source),
            q as (select t.source, c, count(*) filter (where k <> 'empty') as n from t join y using (source) where r >= top and r < bottom group by t.source, c), w as (select source, max(n) as most from q group by source),
            z as (select source, min(c) as l, max(c) + 1 as x from q join w using (source) where n / most >= 0.3 group by source)
            select source, cast(top as int) as top, cast(l as int) as left_col, cast(bottom as int) as bottom, cast(x as int) as right_col from y join z using (source)""",
        "header_ends": f"""with {kinds}, w as (select source, r, list(k order by c) as ks from t group by source, r), s as (select source, count(*) as n from w group by source),
            p as (select a.source, a.r, len(list_filter(range(4), lambda i: a.ks[i + 1] <> b.ks[i + 1])) as changes from w a join w b on a.source = b.source and b.r = a.r + 1 join s on s.source = a.source
                  where a.r >= 1 and a.r < least(n - 1, 20) and len(list_filter(a.ks, lambda k: k = 'numeric')) / 4 <= 0.8),
            o as (select source, max(changes) as most, arg_max(r, changes order by r) as r from p group by source)
            select s.source, cast(case when most >= 2 then o.r when (select len(list_filter(ks, lambda k: k = 'string')) / 4 from w where w.source = s.source and w.r = 0) > 0.6 then 0 else -1 end as int) as top from s left join o using (source)""",
        "number_blocks": f"with {_GRID} select source, 3::int as top, 3::int as left_col, cast(n + 4 as int) as bottom, 4::int as right_col from sizes_",
        "parse_classes": f"""with {_VALUES} select v, {classes} as kind, case when trim(v) = '' or v in {nan} then null else v end as kept, trim(v) in {nan} or {numeric} as numeric_or_nan,
            case when regexp_matches(v, '^[=+@\\-\\t\\r\\n]') then '''' || v else v end as sanitised, regexp_matches(trim(v), '^[=+@\\-]') and not {signed} as formula from values_""",
        "cell_codes": f"with {_VALUES} select v, {_sql_type('v')} as kind from values_",
        "sql_functions": f"""with {_VALUES} select v, {_sql_type('v')} as kind, {_sql_clean('v')} as cleaned, {_sql_year('v')} as year, {_sql_label('v')} as is_label, regexp_matches(v, '(?i){K.ID_HINT}') as hints_id, {_sql_summary("[v, 'x']")} as summary from values_""",
        "flatten_grid": f"select o_orderpriority as vertical_1, s.status, cast(count(*) filter (where {parts} = s.status) as varchar) as orders from orders o, (select unnest(['F', 'O', 'P']) as status) s group by 1, 2",
        "atomize_ragged": "select p_partkey, split_part(p_name, ' ', 1) as w_1, case when p_partkey % 2 = 1 then split_part(p_name, ' ', 2) end as w_2 from part",
        "multivalue_limits": "select 'codes' as \"column\", ';' as delimiter, 1.0::double as confidence",
        "structure": "select unnest(['missing', 'missing', 'extra', 'dtype']) as kind, unnest(['custkey', 'mktsegment', 'suppkey', 'acctbal']) as name",
        "file_audit": """with t as (select c_custkey as k, (case when c_custkey % 11 = 0 then 'MZ' else '' end) || 'name,note' || chr(10) || c_name || ',' || (case when c_custkey % 3 = 0 then '=1+1' when c_custkey % 5 = 0 then '<script >' when c_custkey % 7 = 0 then '-12.5' else 'ok' end) as content from customer)
            select 'c' || k || '.csv' as source, cast(strlen(content) as bigint) as bytes, case when k % 11 = 0 then 'DANGER' when k % 3 = 0 or k % 5 = 0 then 'WARNING' else 'CLEAN' end as severity, ((k % 11 = 0)::int + (k % 3 = 0 or k % 5 = 0)::int)::int as findings from t""",
        "file_prints": "with t as (select c_custkey as k, 'key;name' || chr(10) || c_custkey || ';' || c_name as content from customer) select 'c' || k || '.csv' as source, cast(strlen(content) as bigint) as bytes, sha256(content) as sha256, 2::bigint as \"rows\", 2::bigint as cols, 'utf-8-sig' as encoding, ';' as delimiter, null::varchar as read_error from t",
        "workbook_rows": f"with {_GRID} select source || '.xlsx' as source, r, case when r = 0 then 'Customers by nation;Customers by nation;Customers by nation;Customers by nation' else array_to_string(cells, ';') end as cells from grid where r <> 1",
        "workbook_sheets": f"with {_GRID} select source || '.xlsx' as source, unnest(['cover', 'data']) as sheet, unnest([0, 1])::int as position, unnest([false, true]) as chosen, unnest([0, 1])::int as merges, unnest([null, 2])::int as top, unnest([null, 0])::int as left_col, unnest([null, n + 3])::int as bottom, unnest([null, 4])::int as right_col from sizes_",
        "workbook_tables": f"with {cand} select source || '.xlsx' as source, 0::int as table_no, {box} from scored qualify row_number() over (partition by source order by quality desc, strategy) = 1",
        "table_scores": f"""with {cand}, p as (select * from scored qualify row_number() over (partition by source order by quality desc, strategy) = 1), t as (select p.source, p.b, n, b - 2 as len, n + 1 as true_len from p join sizes_ using (source))
            select source, 1::int as tables, 1::int as true_tables, round(least(len, true_len) / greatest(len, true_len), 6) as iou, 1.0::double as header, 1.0::double as header_accuracy, round(least(len, true_len) / greatest(len, true_len), 6) as boundary_iou, 1.0::double as noise_removal,
                   round((least(len, true_len) + 1) / (true_len + 1), 6) as data_preservation, 1.0::double as cleaning_quality from t""",
        "scores_by_size": f"""with {cand}, p as (select * from scored qualify row_number() over (partition by source order by quality desc, strategy) = 1), t as (select case when (n + 3) % 2 = 0 then 'even' else 'odd' end as "group", round(least(b - 2, n + 1) / greatest(b - 2, n + 1), 6) as iou from p join sizes_ using (source))
            select "group", count(*) as files, count(*) filter (where iou >= 0.6) as passed, round(avg((iou >= 0.6)::int), 6) as rate, round(avg(iou), 6) as iou, 1.0::double as header from t group by 1""",
        "pipeline_frame": f"with {_LISTED}, a as (select trim(unnest(string_split(tags, ','))) as t from listed) select case when t in ('STANDARD STEEL', 'steel') then 'STEEL' else t end as tags, sum(case when t in ('STANDARD STEEL', 'steel') then 2.0 else 1.0 end) as count from a group by 1",
        "pipeline_long": "select n_name as \"nation name\", unnest(['first', 'second']) as variable, unnest([cast(n_regionkey as varchar), cast(n_regionkey * 7 as varchar)]) as value from nation",
    }
