import pytest

from gridloom.operators import detect as D
from gridloom.operators import model as M
from gridloom.pipeline import Pipeline

CROSS = [["", "", "2020", "2021"], ["대분류", "중분류", "매출(억)", "매출(억)"], ["전자", "TV", "10", "20"], ["", "냉장고", "30", "40"], ["생활", "식품", "50", "60"]]
BESIDE = [["Name", "Qty", "", "City", "Pop"], ["a", "1", "", "Rome", "10"], ["b", "2", "", "Oslo", "20"], ["c", "3"], ["d", "4"], ["e", "5"]]
BELOW = [["k", "v"], ["a", "1"], ["b", "2"], [], [], ["x", "y"], ["c", "3"], ["d", "4"]]
BARE = [["a", "1"], ["b", "2"], ["c", "3"]]
BOX = {"cross": CROSS, "beside": BESIDE, "below": BELOW, "bare": BARE, "blank": [[], ["", None]]}


@pytest.fixture(scope="module")
def sheets(spark):
    return spark.createDataFrame([(n, i, x) for n, t in BOX.items() for i, x in enumerate(t)], "source string, r long, cells array<string>")


def test_all_strategies_agree_on_a_crosstab(sheets):
    rows = D.candidates(sheets.filter("source = 'cross'")).collect()
    assert [r.strategy for r in rows] == list("ABCDEF")
    assert {(r.header, r.top, r.left_col, r.bottom, r.right_col) for r in rows} == {(1, 2, 0, 4, 4)}


def test_tables_beside_and_below_each_other(sheets):
    found = sorted(tuple(r)[:7] for r in D.detect(sheets).collect() if r.source in ("beside", "below"))
    assert found == [("below", 0, 0, 1, 0, 2, 2), ("below", 1, 5, 6, 0, 7, 2), ("beside", 0, 0, 1, 0, 5, 2), ("beside", 1, 0, 1, 3, 2, 5)]


def test_model_wide_and_long(sheets):
    (m,) = M.models(sheets.filter("source = 'cross'")).collect()
    assert (m.hdr_first, m.hdr_last, m.stub_end, m.top, m.left_col, m.bottom, m.right_col, m.leaf) == (0, 1, 2, 2, 0, 4, 4, 0)
    grid = sheets.filter("source = 'cross'").select("r", "cells")
    wide = M.wide(grid, m)
    assert wide.columns == ["대분류", "중분류", "2020 / 매출(억)", "2021 / 매출(억)"]
    assert [tuple(r) for r in wide.collect()] == [("전자", "TV", "10", "20"), ("", "냉장고", "30", "40"), ("생활", "식품", "50", "60")]
    long = M.long(grid, m)
    assert long.columns == ["대분류", "중분류", "level_1", "level_2", "value"]
    assert [tuple(r) for r in long.collect()][2:4] == [("전자", "냉장고", "2020", "매출(억)", "30"), ("전자", "냉장고", "2021", "매출(억)", "40")]


def test_headerless(sheets):
    (m,) = M.models(sheets.filter("source = 'bare'")).collect()
    assert m.hdr_first is None and m.top == 0 and m.stubs == ["Col_0"]


def test_pipeline_over_a_file(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("Report,,\n,,\nkey,tags,n\na,x;y,1\nb,z,2\nb,z,2\nTotal,,3\n", "utf-8")
    p = Pipeline(str(path), spark=spark).detect().clean()
    assert [tuple(r) for r in p.result().collect()] == [("a", "x;y", "1"), ("b", "z", "2")]
    out = p.atomize("tags", ";").cast_numeric(["n"]).merge("n").result()
    assert [tuple(r) for r in out.collect()] == [("a", "x", 1.0), ("a", "y", 1.0), ("b", "z", 2.0)]
    p.save(str(tmp_path / "o" / "out.csv"))
    assert (tmp_path / "o" / "out.csv").read_text("utf-8-sig").splitlines()[:2] == ["key,tags,n", "a,x,1.0"]
    with pytest.raises(ValueError):
        p.save(str(tmp_path / "out.doc"))
