import io

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom import cli, parse, streaming
from gridloom.functions import cells, codes
from gridloom.operators import areas as A
from gridloom.operators import detect as D
from gridloom.operators import grid as G
from gridloom.operators import model as M
from gridloom.operators import quality as Q
from gridloom.operators import tabular as T
from gridloom.pipeline import Pipeline
from gridloom.plans.catalogue import TRICKY
from gridloom.sources import audit, csvgrid, files, sinks, xlsx

MESSY = [[None] * 5, ["Report", "Title", None, None, None], ["Date:", "2024-01-01", None, None, None], [None] * 5, ["Name", "Age", "City", "Score", "Grade"],
         ["Al", "25", "Xi", "9.5", "A"], ["Bo", "30", "Yo", "8.5", "B"], ["Cy", "35", "Zu", "7.5", "C"], ["Di", "40", "Wa", "6.5", "D"], [None] * 5]


def test_codes_agree_with_the_columns(spark):
    values = [*TRICKY, None, "　x", "1 000", "(5)", "inf", "-", "﻿", "12.5.2024", "1٣"]
    got = spark.createDataFrame([(v,) for v in values], "v string").select(cells.cell_type(F.col("v")), cells.normalise(F.col("v")), cells.is_label(F.col("v")), cells.classify(F.col("v")), cells.numeric_or_nan_like(F.col("v")), cells.runs_as_formula(F.col("v"))).collect()
    names = ["empty", "numeric", "date", "text"]
    for v, r in zip(values[:-1], got[:-1], strict=True):
        assert names[codes.code(v) & 3] == r[0], v
        assert codes.normal(v or "") == r[1] and codes.is_label(v or "") == r[2] and codes.classify(v) == r[3], v
        assert v is None or (codes.numeric_or_nan_like(v) == r[4] and audit.runs_as_formula(v) == r[5]), v


def test_areas_of_a_messy_frame():
    f = A.Frame(MESSY)
    assert A.dense_box(f.filled) == (1, 0, 9, 5) and A.robust(f) == (4, 0, 9, 5)
    assert A.robust(A.Frame([[None, "", " "]] * 3)) == A.NONE and A.robust(A.Frame([])) == A.NONE
    assert A.header_end(A.Frame([["a", "b", "c"]]).kind) == -1
    assert A.header_end(A.Frame([["1", "2"]] * 5).kind) == -1 and A.header_end(A.Frame([["a", "b"], ["c", "d"]]).kind) == 0
    assert A.robust_or_bordered(f, (1, 0, 5, 5)) == (1, 0, 5, 5) and A.robust_or_bordered(f, (0, 0, 1, 2)) == (4, 0, 9, 5)
    notes = A.Frame([["n", "a", "b", None], *[[str(i), "x", "7", None] for i in range(6)], ["note", None, None, None]])
    assert A.refined(notes.kind, (0, 0, 8, 4)) == (0, 0, 5, 3)  # rows of three classes are noise, three of them at most


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 6), st.integers(1, 6), st.integers(0, 2**36 - 1))
def test_soft_rectangle_is_the_greatest(high, wide, bits):
    mask = np.array([(bits >> i) & 1 for i in range(high * wide)], bool).reshape(high, wide)
    top, bottom, left, right = A.soft_rectangle(mask)
    best = max(((b - t) * (r - x) for t in range(high) for b in range(t + 1, high + 1) for x in range(wide) for r in range(x + 1, wide + 1) if mask[t:b, x:r].all()), default=0)
    assert (bottom - top) * (right - left) == best and mask[top:bottom, left:right].all()


def test_gaps_and_repeated_headers():
    s = D.Sheet.of([["k", "v"], ["a", "1"], ["b", "2"], [], [], ["x", "y"], ["c", "3"], ["d", "4"], ["", ""]])
    assert A.gap_split(s) == [D.Region(0, 1, 0, 2, 2), D.Region(5, 6, 0, 7, 2)] and A.gap_split(D.Sheet.of([["a"], ["b"]])) == []
    again = D.Sheet.of([["k", "v"], ["a", "1"], ["b", "2"], ["k", "v"], ["c", "3"], ["d", "4"]])
    assert [r.header for r in D.regions(again)] == [0, 3]
    titled = D.Sheet.of([["k", "v", "w"], ["a", "1", "2"], ["b", "2", "3"], ["Second", "", ""], ["x", "y", "z"], ["c", "3", "4"], ["d", "4", "5"]])
    assert [r.header for r in D.regions(titled)] == [0, 4]


HAZARDS = {
    "units": ([["Report", "", ""], ["", "", ""], ["region", "q1", "q2"], ["", "(won)", "(won)"], *[[n, str(i * 7), str(i * 9)] for i, n in enumerate(["ab", "cd", "ef", "gh"], 11)], ["합계", "100", "90"]], (2, 3, 1, 4, 0, 7, 3)),
    "deep": ([["", "2020", "", "2021", ""], ["m", "in", "out", "in", "out"], *[[n, "1.5", "2.5", "3.5", "4.5"] for n in ("jan", "feb", "mar")]], (0, 1, 1, 2, 0, 4, 5)),
    "bare": ([[f"{i}.{j}" for j in range(4)] for i in range(20)], (None, None, 0, 0, 0, 19, 4)),
    "keys": ([["id", "x", "y"], *[[str(i), f"{i * 37 % 101}.5", f"{i * 53 % 97}.25"] for i in range(1, 40)]], (0, 0, 1, 1, 0, 39, 3)),
    "years": ([["year", "value"], *[[str(1990 + i), str(i * i * 31 % 1000)] for i in range(12)]], (0, 0, 1, 1, 0, 12, 2)),
    "hollow": ([["k", "a", "b", "", "", "c", "d", "e"], *[[f"r{i}", f"{i}.5", f"{i}.2", "", "", f"{i * 3}.1", "1.5", "2.5"] for i in range(30)]], (0, 0, 1, 1, 0, 30, 8)),
    "foot": ([["n", "a", "b"], *[[f"r{i}", f"{i}.5", f"{i * 3}.5"] for i in range(9)], ["※ a note", "", ""], ["자료: office", "", ""]], (0, 0, 1, 1, 0, 9, 3)),
}


@pytest.mark.parametrize("name", HAZARDS)
def test_models_of_hazards(name):
    grid, want = HAZARDS[name]
    (region,) = D.regions(D.Sheet.of(grid))
    assert tuple(M._Table(D.Sheet.of(grid), region).model()[:7]) == want


def test_ragged_and_single_column():
    ragged = D.Sheet.of([["A", "B", "C"], *[[str(i)] * (2 + i % 4) for i in range(30)]])
    assert D.regions(ragged)[0][:2] == (0, 1)
    one = D.Sheet.of([["value"], *[[f"{i}.5"] for i in range(20)]])
    assert tuple(D.regions(one)[0]) == (0, 1, 0, 20, 1)
    assert D.regions(D.Sheet.of([])) == [] and D.quality(one, D.Region(0, 5, 0, 4, 1)) == 0


def test_quality_orders_good_before_bad():
    s = D.Sheet.of([["Name", "Age"], *[[f"n{c}", str(i)] for i, c in enumerate("abcdef", 20)], ["", ""], ["", ""]])
    assert D.quality(s, D.Region(0, 1, 0, 6, 2)) > D.quality(s, D.Region(3, 4, 0, 8, 2)) > 0


def test_workbooks(spark, tmp_path):
    out = io.BytesIO()
    rows = [["Title", None, None], ["Name", "Qty", "On"], ["a & <b>", 2.5, True], ["c", 10, None]]
    xlsx.write(out, {"cover": [["read me"]], "data": rows}, {"data": ["A1:C1", "A3:A4"]}, {"data": (1, 0, 4, 3)})
    book = xlsx.Workbook(out.getvalue())
    assert book.names == ["cover", "data"] and book.chosen() == "data" and book.chosen(0) == "cover" and book.chosen("none") == "data" and book.chosen(True) == "data"
    assert book.strictly(None) == "cover" and book.border_box("data") == (1, 0, 4, 3) and book.border_box("cover") is None
    for bad, kind in (("none", KeyError), (7, IndexError), (1.5, TypeError)):
        with pytest.raises(kind):
            book.strictly(bad)
    assert list(book.grid("data")) == [(0, ["Title", "", ""]), (1, ["Name", "Qty", "On"]), (2, ["a & <b>", "2.5", "True"]), (3, ["c", "10", ""])]
    assert list(book.grid("data", True))[0][1] == ["Title"] * 3 and list(book.grid("data", True))[3][1] == ["a & <b>", "10", ""]
    assert [xlsx.column_name(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"] and xlsx.column_index("AAA12") == 702
    path = tmp_path / "b.xlsx"
    path.write_bytes(out.getvalue())
    p = Pipeline(str(path), spark=spark).detect().clean()
    assert [tuple(r) for r in p.result().collect()] == [("a & <b>", "2.5", "True"), ("c", "10", "")]
    p.save(str(tmp_path / "again.xlsx"))
    assert [c for _, c in xlsx.Workbook((tmp_path / "again.xlsx").read_bytes()).grid("Sheet1")][0] == ["Name", "Qty", "On"]
    p.close()


def test_parse(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text("\n".join(",".join(c or "" for c in r) for r in MESSY[1:]) + "\nx,y,z,w,v,too,long\n", "utf-8")
    df, info = parse.parse_with_info(spark, str(path))
    assert df.columns == ["Name", "Age", "City", "Score", "Grade"] and [r.Age for r in df.collect()] == ["25", "30", "35", "40"]
    assert info["header_row_abs"] == 3 and info["detection_method"] == "ensemble"
    cut = parse.parse(spark, str(path), trim={"top": 4, "bottom": 6, "left": 1, "right": 3}, is_header=False)
    assert cut.columns == ["Col_0", "Col_1"] and [tuple(r) for r in cut.collect()] == [("25", "Xi"), ("30", "Yo")]
    whole = parse.parse(spark, str(path), trim=False, is_header=3)
    assert whole.columns[0] == "Name" and whole.count() == 5
    for bad in ("a.doc", "a.xls"):
        with pytest.raises(ValueError):
            parse.parse(spark, str(tmp_path / bad))
    with pytest.raises(ValueError):
        parse.parse(spark, str(path), trim="some")


def test_flatten_and_atomize(spark):
    rows = [[None, None, "Q1", "Q1", "Q2", "Q2"], [None, None, "S", "T", "S", "T"], ["N", "a", "1", "2", "3", "4"], ["N", "b", "5", "6", None, "8"]]
    grid = spark.createDataFrame(list(enumerate(rows)), "r long, cells array<string>")
    got = [tuple(r) for r in T.flatten(grid, 2, 2).collect()]
    assert got[:3] == [("N", "a", "Q1", "S", "1"), ("N", "b", "Q1", "S", "5"), ("N", "a", "Q1", "T", "2")] and len(got) == 8 and got[5][4] is None
    wide = spark.createDataFrame([(0, ["n", *[f"c{i}" for i in range(5)]])] + [(i, [f"r{i}", *[str(i * j) for j in range(5)]]) for i in range(1, 6)], "r long, cells array<string>")
    assert T.flatten(wide, 1).columns == ["vertical_1", "horizontal_1", "value"] and T.flatten(wide, 1).count() == 25
    with pytest.raises(ValueError):
        T.flatten(spark.createDataFrame([(i, ["a", "b", "1"]) for i in range(5)], "r long, cells array<string>"), 1)
    few = spark.createDataFrame([("a/b", i) for i in range(6)] + [("c", i) for i in range(4)], "t string, _parts int")
    for df in (few, few.filter("t = 'c'")):
        with pytest.raises(ValueError):
            T.atomize_by_row(df, "t", "/")
    got = T.atomize_by_row(few, value_col="t", delimiter="/")
    assert got.columns == ["_parts", "t_1", "t_2"] and got.count() == 10
    mapping = T.dictionary(spark.createDataFrame([("fruit", "2", "apple")], "target string, addno string, s string"))
    sold = spark.createDataFrame([("apple", "x", "3")], "source string, target string, n string")
    assert [tuple(r) for r in T.clarify(sold, "source", mapping, ["n"]).collect()] == [("fruit", "x", 6.0)]


def test_frames_keep_their_order_and_sheets_stay_apart(spark):
    df = spark.createDataFrame([(f"z{50 - i}", str(i)) for i in range(40)], "k string, v string").repartition(1)
    got = [r.cells for r in G.grid_of(df).orderBy("r").collect()]
    assert got == [["k", "v"]] + [[f"z{50 - i}", str(i)] for i in range(40)]
    assert [r.cells[1] for r in G.grid_of(df, ["k"], header=False).orderBy("r").collect()][:2] == ["39", "38"]
    rows = [(s, i, [s if i == 0 else "", str(i)]) for s in ("p", "q") for i in range(5)]
    long = G.to_long(spark.createDataFrame(rows, "source string, r long, cells array<string>"), 0, 9, 0, 2, 1, ["v"])
    assert sorted({(r.source, r.stub_1) for r in long.collect()}) == [("p", "p"), ("q", "q")]
    blocks = G.filled_down(spark.createDataFrame([(i, "a" if i == 1 else "b" if i == 7 else "") for i in range(12)], "r long, s string"), ["s"], [], block=3)
    assert [r.s for r in blocks.orderBy("r").collect()] == [""] + ["a"] * 6 + ["b"] * 5


def test_folder_cli_and_stream(spark, tmp_path, capsys):
    place = tmp_path / "in"
    place.mkdir()
    (place / "a.csv").write_text("k,v\na,1\nb,2\n", "utf-8")
    (place / "b.tsv").write_text("k\tv\nc\t3\nd\t4\n", "utf-8")
    xlsx.write(str(place / "c.xlsx"), {"s": [["k", "v"], ["e", 5], ["f", 6]]})
    with Pipeline(str(place), spark=spark) as p:
        assert len(p.detect().clean().all_tables()) == 3
        assert p.tidy().count() == 6
    assert cli.main(["detect", str(place / "a.csv")]) == 0 and "[0] 2 rows x 2 cols: k, v" in capsys.readouterr().out
    assert cli.main(["clean", str(place / "c.xlsx"), "--sheet", "0", "--shape", "long", "-o", str(tmp_path / "o.csv")]) == 0
    assert (tmp_path / "o.csv").read_text("utf-8-sig").splitlines() == ["k,variable,value", "e,v,5", "f,v,6"]
    with pytest.raises(SystemExit):
        cli.main(["--version"])
    streaming.tidy_files(spark, str(place), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6
    with pytest.raises(ValueError):
        files.contents(spark, str(place / "x.doc"))
    with pytest.raises(ValueError):
        sinks.save_dataframe(spark.range(1), str(tmp_path / "x.xls"))


def test_long_cells_prints_and_audit(spark):
    big = "x" * 200_000
    assert [len(r[0]) for r in csvgrid.rows(f"{big},1\n2,3")] == [200_000, 1]
    made = io.BytesIO()
    xlsx.write(made, {"s": [["a", "b"], ["c", "d"]]})
    content = [("a.csv", b"a;b\n1;2\n"), ("b.csv", b"PK\x03\x04..."), ("c.xlsx", b"nothing"), ("d.csv", b"x,=1\n-5,+3\n"), ("e.xlsx", made.getvalue()), ("f.csv", None)]
    df = spark.createDataFrame(content, "source string, content binary")
    assert {r.source: r.severity for r in audit.audit(df).collect()} == {"a.csv": "CLEAN", "b.csv": "DANGER", "c.xlsx": "DANGER", "d.csv": "WARNING", "e.xlsx": "CLEAN", "f.csv": "CLEAN"}
    got = {r.source: r for r in files.fingerprints(df).collect()}
    assert (got["a.csv"].rows, got["a.csv"].cols, got["a.csv"].delimiter) == (2, 2, ";") and got["c.xlsx"].read_error and (got["e.xlsx"].rows, got["e.xlsx"].cols) == (2, 2)
    kinds = {r[0]: tuple(r)[1:] for r in df.select("source", audit.is_workbook(F.col("content")), audit.is_dangerous(F.col("content"))).collect()}
    assert kinds["b.csv"] == (True, False) and kinds["f.csv"] == (False, False)


def test_scores():
    r = D.Region
    same = Q.compute_scores([r(0, 1, 0, 9, 3)], [r(0, 1, 0, 9, 3)], 12, [[1.0, 0.5]])
    assert same == {"header_accuracy": 1, "boundary_iou": 1, "noise_removal": 1, "data_preservation": 1, "cleaning_quality": 0.75, "avg": 0.95}
    off = Q.compute_scores([r(2, 3, 0, 11, 3), r(20, 21, 0, 22, 3)], [r(0, 1, 0, 9, 3)], 30)
    assert off["header_accuracy"] == 1 / 3 and abs(off["boundary_iou"] - (7 / 11 - 0.05)) < 1e-12
    assert abs(off["noise_removal"] - 15 / 20) < 1e-12 and off["data_preservation"] == 0.8
    assert Q.compute_scores([], [], 5)["boundary_iou"] == 1 and Q.compute_scores([], [r(0, 1, 0, 9, 3)], 12)["avg"] == 0
    assert Q.matched([r(0, 1, 0, 4, 2)], [r(0, 1, 0, 4, 2), r(9, 10, 0, 12, 2)]) == (0.5, 0.5)
