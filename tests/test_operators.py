import pytest
from pyspark.sql import functions as F

from gridloom.functions import cells
from gridloom.operators import grid, quality, tabular
from gridloom.sources import csvgrid


@pytest.mark.parametrize(("value", "kind"), [("$1,234", "numeric"), ("1e5", "numeric"), ("1d", "text"), ("1_000", "numeric"), ("($5)", "text"), ("- 5", "text"), ("20240115", "numeric"), ("2024-01-15", "date"), (" N/A ", "empty"), (None, "empty"), ("50%", "numeric"), ("\u3000x\u3000", "text")])
def test_cell_type(spark, value, kind):
    assert spark.createDataFrame([(value,)], "v string").select(cells.cell_type(F.col("v"))).first()[0] == kind


def test_merge_drops_null_keys_and_orders(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3), (None, 9), ("c", None)], "k string, v int")
    assert [tuple(r) for r in tabular.merge(df, "v").collect()] == [("a", 2), ("b", 4), ("c", 0)]
    with pytest.raises(ValueError):
        tabular.merge(df, "k")


def test_atomize(spark):
    df = spark.createDataFrame([(1, "x, y"), (2, None), (3, " , "), (4, "z")], "i int, t string")
    assert sorted((r.i, r.t or "") for r in tabular.atomize_by_column(df, "t", ",").collect()) == [(1, "x"), (1, "y"), (2, ""), (3, ""), (4, "z")]
    rows = tabular.atomize_by_row(spark.createDataFrame([("a/b",)] * 9 + [("e",)], "t string"), "t", "/").distinct().collect()
    assert [tuple(r) for r in rows] == [("a", "b")]


def test_multivalue_columns(spark):
    df = spark.createDataFrame([("Alice", "apple"), ("Bob", "apple, banana"), ("Charlie", "apple, banana, carrot")], "name string, fruits string")
    assert [tuple(r) for r in tabular.multivalue_columns(df).collect()] == [("fruits", ",", 0.667)]


def test_append_and_names_with_dots(spark):
    a, b = spark.createDataFrame([(1, 2)], ["x.y", "z"]), spark.createDataFrame([(5,)], ["z"])
    assert [tuple(r) for r in tabular.append(a, b).collect()] == [(1, 2), (None, 5)]


def test_clean_region_keeps_first(spark):
    g = spark.createDataFrame([(0, ["h", "k"]), (1, ["a", "1"]), (2, []), (3, ["a", "1"]), (4, ["Total", "2"]), (5, ["b"])], "r long, cells array<string>")
    assert sorted(tuple(r) for r in grid.clean_region(g, 1, 5, 0, 2, ["h", "k"]).collect()) == [(1, "a", "1"), (5, "b", "")]


def test_csv_grid():
    assert csvgrid.guess_delimiter("a;b\n1;2") == ";"
    assert list(csvgrid.rows("a,\"b\nc\"\n1")) == [["a", "b\nc"], ["1"]]
    assert csvgrid.guess_delimiter("1::a::x\n2::b::y\n3::c::z") == "::"
    assert csvgrid.decode("한글".encode("cp949")) == "한글"


def test_iou():
    assert quality.region_iou((0, 0, 9, 4), (0, 0, 9, 4)) == 1.0
    assert quality.region_iou((0, 0, 1, 1), (5, 5, 6, 6)) == 0.0
