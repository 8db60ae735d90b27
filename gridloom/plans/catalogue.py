"""The registered queries over the library's own operators, and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import cells
from gridloom.functions import constants as K
from gridloom.operators import grid as G
from gridloom.operators import model as M
from gridloom.operators import tabular as T

TRICKY = ["$1,234", "(12)", "1e5", "1d", "1_000", "50%", " N/A ", "--", "2024-01-15", "20240115", "1.234,56", "'=1+1", "3/4/2021", "12원", "- 5", "x", "", "nan", "1.2.3", "12/31/1999", "€ 9.50", "2021", "1,999", "Q3", "wk 12", "March", "2200", "id", "order id", "zip code", "note"]


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _values(spark: SparkSession, sf: str) -> DataFrame:
    """Strings of many kinds: literal ones, and names, dates, prices and numbers of the tables."""
    o = _t(spark, sf, "orders")
    return (
        spark.createDataFrame([(v,) for v in TRICKY], "v string")
        .union(_t(spark, sf, "part").select("p_name"))
        .union(_t(spark, sf, "customer").select("c_name"))
        .union(o.select(F.date_format("o_orderdate", "yyyy-MM-dd")))
        .union(o.select(F.date_format("o_orderdate", "MM/dd/yyyy")))
        .union(o.select(F.concat(F.lit("$"), F.floor("o_totalprice").cast("string"))))
        .union(_t(spark, sf, "events").select(F.col("event_id").cast("string")))
    )


_LITERALS = ", ".join("('" + v.replace("'", "''") + "')" for v in TRICKY)
_VALUES = f"""values_ as (select v from (values {_LITERALS}) t(v)
 union all select p_name from part union all select c_name from customer
 union all select strftime(o_orderdate, '%Y-%m-%d') from orders union all select strftime(o_orderdate, '%m/%d/%Y') from orders
 union all select '$' || cast(cast(floor(o_totalprice) as bigint) as varchar) from orders union all select cast(event_id as varchar) from events)"""
_MARKERS = "(" + ", ".join(f"'{m}'" for m in K.MISSING_MARKERS) + ")"


def _sql_numeric(v: str) -> str:
    core = f"replace(trim(regexp_replace(trim({v}), '^[''\"$₩]|[원만USD%\\s]+$', '', 'g'), '() '), ',', '')"
    return f"({core} <> '' and (regexp_matches({core}, '{K.FLOAT}') or regexp_matches({core}, '(?i){K.NOT_FINITE}')))"


def _sql_type(v: str) -> str:
    return f"case when trim({v}) in {_MARKERS} then 'empty' when {_sql_numeric(v)} then 'numeric' when regexp_matches({v}, '{K.DATE_ANYWHERE}') then 'date' else 'text' end"


def _sql_clean(v: str) -> str:
    t = f"(case when regexp_matches(trim({v}), '^''[=+@-]') then substr(trim({v}), 2) else trim({v}) end)"
    return f"(case when {t} in {_MARKERS} then '' else {t} end)"


def _sql_year(v: str) -> str:
    core = f"replace(trim({v}), ',', '')"
    return f"case when regexp_matches({core}, '^[0-9]{{4}}$') and cast({core} as int) between 1900 and 2100 then cast({core} as int) end"


def _sql_label(v: str) -> str:
    return f"trim({v}) <> '' and (({_sql_year(v)}) is not null or regexp_matches(trim({v}), '(?i){K.MONTH_OR_QUARTER}') or regexp_matches(trim({v}), '(?i){K.PERIOD_TOKEN}'))"


def _sql_summary(cells_: str) -> str:
    line = f"lower(array_to_string({cells_}, ' '))"
    return "(" + " or ".join(f"contains({line}, '{k}')" for k in K.SUMMARY_KEYWORDS) + ")"


# a grid with a title, a blank row, repeated rows and a total around nation


def _nation_grid(spark: SparkSession, sf: str) -> DataFrame:
    n = _t(spark, sf, "nation")
    row = F.array(F.col("n_nationkey").cast("string"), "n_name", F.col("n_regionkey").cast("string"))
    noise = [(0, ["Nation report", "", ""]), (1, ["", "", ""]), (2, ["n_nationkey", "n_name", "n_regionkey"]), (31, ["Total", "25", ""])]
    key = F.col("n_nationkey").cast("long")
    return spark.createDataFrame(noise, "r long, cells array<string>").union(n.select(key + 3, row)).union(n.filter("n_nationkey < 3").select(key + 28, row))


_GRID = """grid as (select * from (values (0, ['Nation report', '', '']), (1, ['', '', '']), (2, ['n_nationkey', 'n_name', 'n_regionkey']), (31, ['Total', '25', ''])) t(r, cells)
 union all select 3 + n_nationkey, [cast(n_nationkey as varchar), n_name, cast(n_regionkey as varchar)] from nation
 union all select 28 + n_nationkey, [cast(n_nationkey as varchar), n_name, cast(n_regionkey as varchar)] from nation where n_nationkey < 3)"""

# orders by status and priority, first label only on a status' first row, for stub filling


def _crosstab(spark: SparkSession, sf: str) -> DataFrame:
    by = _t(spark, sf, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("m"))
    from pyspark.sql import Window as W

    place = F.row_number().over(W.orderBy("o_orderstatus", "o_orderpriority"))
    first = F.row_number().over(W.partitionBy("o_orderstatus").orderBy("o_orderpriority"))
    row = F.array(F.when(F.col("i") == 1, F.col("o_orderstatus")).otherwise(""), "o_orderpriority", F.col("n").cast("string"), F.col("m").cast("string"))
    return by.withColumn("r", place.cast("long")).withColumn("i", first).select("r", row.alias("cells"))


_CROSS = """by_ as (select o_orderstatus as s, o_orderpriority as p, count(*) as n, count(distinct o_custkey) as m from orders group by all),
cross_ as (select row_number() over (order by s, p) as r, s, p, n, m from by_)"""


def _listed(spark: SparkSession, sf: str) -> DataFrame:
    """part with lists: the words of the name, the type and the first letter of the brand's number."""
    return _t(spark, sf, "part").select("p_partkey", F.concat_ws(", ", F.replace("p_name", F.lit(" "), F.lit(", ")), "p_type").alias("tags"), F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("code"))


_LISTED = "listed as (select p_partkey, replace(p_name, ' ', ', ') || ', ' || p_type as tags, p_brand || '/' || p_size as code from part)"


def _dictionary(spark: SparkSession) -> DataFrame:
    rows = [("high", "2", "1-URGENT", "2-HIGH"), ("low", "1", "5-LOW", None)]
    return T.dictionary(spark.createDataFrame(rows, "target string, addno string, s1 string, s2 string"))


def cell_types(spark, sf):
    v = F.col("v")
    return _values(spark, sf).select("v", cells.cell_type(v).alias("kind"))


def clean_cells(spark, sf):
    return _values(spark, sf).select("v", cells.clean_cell(F.col("v")).alias("cleaned"))


def label_tokens(spark, sf):
    v = F.col("v")
    return _values(spark, sf).select("v", cells.is_label(v).alias("is_label"), cells.hints_id(v).alias("hints_id"), cells.year_of(v).alias("year"))


def normalise_values(spark, sf):
    return _values(spark, sf).select("v", cells.normalise(F.col("v")).alias("normal"))


def summary_rows(spark, sf):
    return _t(spark, sf, "conversations").select("conv_id", "turn", cells.summary_row(F.array("role", "text")).alias("summary"))


def row_features(spark, sf):
    return G.row_features(_nation_grid(spark, sf)).select("r", "width", "filled", F.round("fill_rate", 6).alias("fill_rate"), "numeric", "dates", "texts", "summary")


def column_profile(spark, sf):
    return G.column_profile(_nation_grid(spark, sf), 3, 30)


def strategy_rules(spark, sf):
    return G.strategy_rules(_nation_grid(spark, sf))


def density_band(spark, sf):
    return G.best_band(_nation_grid(spark, sf))


def clean_region(spark, sf):
    return G.clean_region(_nation_grid(spark, sf), 3, 31, 0, 3, ["n_nationkey", "n_name", "n_regionkey"])


def to_long(spark, sf):
    return G.to_long(_crosstab(spark, sf), 1, 1000, 0, 4, 2, ["orders", "customers"])


def flatten(spark, sf):
    by = _t(spark, sf, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("a"), F.col("n_regionkey").alias("b"))
    return T.melt(by, ["name"], [["key", "nation"], ["key", None]])


def delimiter_detect(spark, sf):
    found = T.feature_delimiters(_listed(spark, sf), ["tags", "code"])
    return spark.createDataFrame(sorted(found.items()), "column string, delimiter string")


def atomize_column(spark, sf):
    return T.atomize_by_column(_listed(spark, sf).select("p_partkey", "tags"), "tags", ",")


def atomize_row(spark, sf):
    return T.atomize_by_row(_listed(spark, sf).select("p_partkey", "code"), "code", "/")


def multivalue_columns(spark, sf):
    return T.multivalue_columns(_listed(spark, sf).select("tags", "code"))


def clarify_map(spark, sf):
    return T.clarify(_t(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", _dictionary(spark))


def clarify_sum(spark, sf):
    df = _t(spark, sf, "orders").select("o_orderpriority", F.floor("o_totalprice").cast("string").alias("price"))
    return T.clarify(df, "o_orderpriority", _dictionary(spark), ["price"])


def merge_sum(spark, sf):
    return T.merge(_t(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity"), "l_quantity")


def merge_no_keys(spark, sf):
    return T.merge(_t(spark, sf, "lineitem").select("l_quantity"), "l_quantity")


def append_named(spark, sf):
    c = _t(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    s = _t(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("extra"))
    return T.append(c, s)


def append_positional(spark, sf):
    c = _t(spark, sf, "customer").select("c_name", "c_nationkey", "c_mktsegment")
    return T.append(c, _t(spark, sf, "supplier").select("s_name", "s_nationkey"), df2_header=False)


def profile(spark, sf):
    from gridloom.operators import quality

    return quality.profile(_t(spark, sf, "part").select("p_name", "p_type", "p_brand"))


def bag_f1(spark, sf):
    from gridloom.operators import quality

    o = _t(spark, sf, "orders")
    return quality.bag_scores(o.select("o_custkey", "o_orderstatus"), o.filter("o_orderstatus <> 'F'").select("o_custkey", "o_orderstatus"))


def scan_grid_csv(spark, sf):
    from gridloom.sources import csvgrid

    return csvgrid.parsed(_t(spark, sf, "nation").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(";", F.lpad(F.col("n_nationkey").cast("string"), 3, "0"), F.concat(F.lit('"'), "n_name", F.lit(';x"'))))), "\n").alias("t")).select(F.lit("nation.csv").alias("source"), F.col("t").cast("binary").alias("content"))).select("r", F.get("cells", F.lit(0)).alias("key"), F.get("cells", F.lit(1)).alias("name"))


def wide_by_model(spark, sf):
    """Finds the nation table in its noisy grid, works out its model and cleans it."""
    grid = _nation_grid(spark, sf)
    (m,) = M.models(grid.withColumn("source", F.lit("nation"))).collect()  # one table's model
    return M.wide(grid, m)


def long_by_model(spark, sf):
    """A crosstab of orders with its header row, to long form by its model."""
    head = spark.createDataFrame([(0, ["status", "priority", "orders", "customers"])], "r long, cells array<string>")
    grid = head.union(_crosstab(spark, sf).filter("r > 0").select(F.col("r").cast("long"), "cells"))
    (m,) = M.models(grid.withColumn("source", F.lit("crosstab"))).collect()  # one table's model
    return M.long(grid, m)


_NAMES = [cell_types, clean_cells, label_tokens, normalise_values, summary_rows, row_features, column_profile, strategy_rules, density_band, clean_region, to_long, flatten, delimiter_detect, atomize_column, atomize_row, multivalue_columns, clarify_map, clarify_sum, merge_sum, merge_no_keys, append_named, append_positional, profile, bag_f1, scan_grid_csv, wide_by_model, long_by_model]


def queries() -> dict:
    from gridloom.plans import sheets

    return {f.__name__: f for f in _NAMES} | sheets.queries()


def oracle_sql() -> dict[str, str]:
    from gridloom.plans import sheets

    return _own_sql() | sheets.oracle_sql()


def _own_sql() -> dict[str, str]:
    clean = _sql_clean("v")
    filled = "len(list_filter(k, lambda x: x <> 'empty'))"
    many = lambda k: f"cast(len(list_filter(k, lambda x: x = '{k}')) as int)"
    feat = f"feat as (select r, cells, list_transform(cells, lambda x: {_sql_type('x')}) as k from grid)"
    return {
        "cell_types": f"with {_VALUES} select v, {_sql_type('v')} as kind from values_",
        "clean_cells": f"with {_VALUES} select v, {clean} as cleaned from values_",
        "label_tokens": f"with {_VALUES} select v, {_sql_label('v')} as is_label, regexp_matches(v, '(?i){K.ID_HINT}') as hints_id, {_sql_year('v')} as year from values_",
        "normalise_values": rf"""with {_VALUES}, c as (select v, {clean} as x from values_)
            select v, case when regexp_matches(x, '^\d{{1,2}}[/\-.]\d{{1,2}}[/\-.]\d{{4}}$') then regexp_extract(x, '^(\d{{1,2}})[/\-.](\d{{1,2}})[/\-.](\d{{4}})$', 3) || '-' || lpad(regexp_extract(x, '^(\d{{1,2}})', 1), 2, '0') || '-' || lpad(regexp_extract(x, '^\d{{1,2}}[/\-.](\d{{1,2}})', 1), 2, '0')
                 when regexp_matches(x, '^[\$₩€£]\s*[\d,]+\.?\d*$') then replace(regexp_extract(x, '^[\$₩€£]\s*([\d,]+\.?\d*)$', 1), ',', '')
                 when regexp_matches(x, '^\d{{1,3}}(\.\d{{3}})*,\d+$') then replace(split_part(x, ',', 1), '.', '') || '.' || split_part(x, ',', 2)
                 else x end as normal from c""",
        "summary_rows": f"select conv_id, turn, {_sql_summary('[role, text]')} as summary from conversations",
        "row_features": f"with {_GRID}, {feat} select r, cast(len(cells) as int) as width, cast({filled} as int) as filled, round({filled} / len(cells), 6) as fill_rate, {many('numeric')} as numeric, {many('date')} as dates, {many('text')} as texts, {_sql_summary('cells')} as summary from feat",
        "column_profile": f"""with {_GRID}, b as (select r, unnest(range(3)) as c, unnest(cells) as v from grid where r between 3 and 30),
            t as (select cast(c as int) as c, v, {_sql_type('v')} as kind, case when regexp_matches(trim(v), '^-?\\d{{1,18}}$') then cast(trim(v) as bigint) end as whole from b)
            select c, count(*) as n, count(*) filter (where kind = 'numeric') as numeric, count(*) filter (where kind = 'date') as dates, count(distinct v) as distinct_values, min(whole) as least, max(whole) as greatest from t where kind <> 'empty' group by c""",
        "strategy_rules": f"""with {_GRID}, {feat}, f as (select r, len(cells) as width, {filled} / len(cells) as fill_rate, {_sql_summary('cells')} as summary from feat),
            o as (select coalesce(min(r) filter (where r < 20 and fill_rate > 0.5), 0) as header, max(r) filter (where fill_rate >= 0.3 and not summary) as bottom, max(width) as right_col from f)
            select cast(header as bigint) as header, cast(header + 1 as bigint) as top, 0 as left_col, cast(greatest(coalesce(bottom, 0), header + 1) as bigint) as bottom, cast(right_col as int) as right_col from o""",
        "density_band": f"""with {_GRID}, {feat}, f as (select r, {filled} / len(cells) as fill_rate, least(5, greatest(1, count(*) over () // 4)) // 2 as half from feat),
            s as (select a.r, avg(b.fill_rate) as avg_ from f a join f b on b.r between a.r - a.half and a.r + a.half group by a.r),
            i as (select r, avg_, sum(case when avg_ >= 0.4 then 0 else 1 end) over (order by r) as island from s)
            select cast(min(r) as bigint) as top, cast(max(r) as bigint) as bottom, round(sum(avg_), 6) as score from i where avg_ >= 0.4 group by island order by sum(avg_) desc, min(r) limit 1""",
        "clean_region": "select cast(n_nationkey + 3 as bigint) as r, cast(n_nationkey as varchar) as n_nationkey, n_name, cast(n_regionkey as varchar) as n_regionkey from nation",
        "to_long": f"with {_CROSS} select r, s as stub_1, p as stub_2, variable, value from (select r, s, p, unnest(['orders', 'customers']) as variable, unnest([cast(n as varchar), cast(m as varchar)]) as value from cross_)",
        "flatten": "select n_name as vertical_1, unnest(['key', 'key']) as horizontal_1, unnest(['nation', '[NaN]']) as horizontal_2, unnest([cast(n_nationkey as varchar), cast(n_regionkey as varchar)]) as value from nation",
        "delimiter_detect": f"""with {_LISTED}, s as (select unnest(['code', 'tags']) as "column", unnest([code, tags]) as v from listed), d as (select unnest([',', ';', '/', '|', 'ㆍ', '&', ':']) as delimiter, unnest(range(7)) as o),
            c as (select "column", delimiter, o, avg(case when contains(v, delimiter) then 1.0 else 0 end) as score from s, d group by all)
            select "column", delimiter from c where score > 0.1 qualify row_number() over (partition by "column" order by score desc, o) = 1""",
        "atomize_column": f"with {_LISTED} select p_partkey, trim(unnest(string_split(tags, ','))) as tags from listed",
        "atomize_row": f"with {_LISTED} select p_partkey, split_part(code, '/', 1) as code_1, split_part(code, '/', 2) as code_2 from listed",
        "multivalue_columns": f"""with {_LISTED}, s as (select unnest(['tags', 'code']) as "column", unnest([0, 1]) as pos, unnest([tags, code]) as v from listed), d as (select unnest([',', ';', '/', '|']) as delimiter, unnest(range(4)) as o),
            t as (select "column", pos, delimiter, o, list_filter(list_transform(string_split(v, delimiter), lambda x: trim(x)), lambda x: x <> '') as atoms from s, d),
            p as (select "column", pos, delimiter, o, avg(case when len(atoms) > 1 then 1.0 else 0 end) as multi, avg(case when len(atoms) > 1 then len(atoms) end) as length from t group by all),
            a as (select "column", pos, delimiter, len(atoms) > 1 as m, unnest(atoms) as atom from t),
            e as (select "column", pos, delimiter, atom, count(*) as n, bool_or(m) as in_multi, bool_or(not m) as in_single from a group by all),
            v as (select "column", pos, delimiter, avg(case when in_single or n > 1 then 1.0 else 0 end) as overlap from e where in_multi group by all),
            r as (select p.*, greatest(overlap, case when multi >= 0.5 and length >= 3 then multi else 0 end) as score from p join v using ("column", pos, delimiter) where multi >= 0.1)
            select "column", delimiter, round(score, 3) as confidence from r where score >= 0.3 qualify row_number() over (partition by "column" order by score desc, o) = 1""",
        "clarify_map": "select o_orderkey, case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'high' when o_orderpriority = '5-LOW' then 'low' else o_orderpriority end as o_orderpriority from orders",
        "clarify_sum": "select case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'high' when o_orderpriority = '5-LOW' then 'low' else o_orderpriority end as o_orderpriority, sum(floor(o_totalprice) * case when o_orderpriority in ('1-URGENT', '2-HIGH') then 2.0 else 1.0 end) as price from orders group by 1",
        "merge_sum": "select l_returnflag, l_linestatus, sum(l_quantity) as l_quantity from lineitem where l_returnflag is not null and l_linestatus is not null group by all",
        "merge_no_keys": "select coalesce(sum(l_quantity), 0) as l_quantity from lineitem",
        "append_named": "select c_name as name, c_nationkey as nation, c_mktsegment as segment from customer union all select s_name, s_nationkey, null from supplier",
        "append_positional": "select c_name, c_nationkey, c_mktsegment from customer union all select s_name, s_nationkey, null from supplier",
        "profile": "with s as (select unnest(['p_name', 'p_type', 'p_brand']) as \"column\", unnest([p_name, p_type, p_brand]) as v from part) select \"column\", count(*) as n, count(*) filter (where trim(coalesce(v, '')) in " + _MARKERS + ") as missing, count(distinct v) as distinct_values, count(*) filter (where " + _sql_numeric("v") + ") as numeric, count(*) filter (where regexp_matches(v, '^[=+@\\-\\t\\r\\n]') and not " + _sql_numeric("v") + ") as injections from s group by 1",
        "bag_f1": "with a as (select o_custkey, o_orderstatus, count(*) as n from orders group by all), b as (select o_custkey, o_orderstatus, count(*) as m from orders where o_orderstatus <> 'F' group by all), h as (select sum(least(coalesce(n, 0), coalesce(m, 0))) as hit, sum(coalesce(n, 0)) as p, sum(coalesce(m, 0)) as t from a full join b using (o_custkey, o_orderstatus)) select cast(hit as bigint) as hits, round(hit / p, 6) as precision, round(hit / t, 6) as recall, round(2 * hit / (p + t), 6) as f1 from h",
        "scan_grid_csv": "select cast(n_nationkey as bigint) as r, lpad(cast(n_nationkey as varchar), 3, '0') as key, n_name || ';x' as name from nation",
        "wide_by_model": "select cast(n_nationkey as varchar) as n_nationkey, n_name, cast(n_regionkey as varchar) as n_regionkey from nation",
        "long_by_model": f"with {_CROSS} select s as status, p as priority, variable, value from (select s, p, unnest(['orders', 'customers']) as variable, unnest([cast(n as varchar), cast(m as varchar)]) as value from cross_)",
    }
