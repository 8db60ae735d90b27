"""Every registered operator over tables that hold nothing, and over nulls, repeats, long texts and clashing columns."""

import pytest

from gridloom.llm import queries

KINDS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "pages": "page_id long, url string, html string",
    "benchmark": "item_id long, text string",
    "labels": "doc_id long, quality int, toxic int",
    "conversations": "conv_id long, turn long, role string, text string",
}
LONG = "word " * 30_000 + "end"
ROWS = {
    "documents": [(1, "Some plain words of a text", "en", "src0", 1), (1, "Some plain words of a text", "en", "src0", 1), (2, None, None, None, None), (3, "", "en", "", 0), (4, LONG, "de", "src1", 1), (None, "no id here", "en", "src1", 1), (6, " \t\n", "de", None, 1), (7, "ÀÉ \x0b x", None, "src0", 1)],
    "embeddings": [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, None, None), (3, [0.0, 0.0], 1), (4, [None, 1.0], 1), (5, [float("nan"), 1.0], 1), (None, [1.0, 0.1], 1), (6, [], 0), (7, [2.0, 0.1], 0)],
    "pages": [(1, "http://a.net/x", LONG), (1, "http://a.net/x", LONG), (2, None, None), (3, "nothing", ""), (None, "https://b.org/fr/", LONG), (4, "x://" + "y" * 50_000, "short")],
    "benchmark": [(1, "plain words of a text"), (1, "plain words of a text"), (None, "no id here"), (3, None), (4, ""), (5, LONG)],
    "labels": [(1, 1, 1), (1, 0, 0), (None, 1, 1), (3, None, None), (4, 1, 0)],
    "conversations": [(1, 0, "system", "be brief"), (1, 1, "user", "q"), (1, 1, "user", "q"), (1, 2, "assistant", "a"), (None, 1, "user", "lost"), (2, None, "user", None), (3, 1, None, "x"), (4, 1, "user", LONG)],
}
#: Columns by names that the operators use inside.
EXTRA = "row, hits, tail, score, fp, rep, key, unit, mark, digest, payload, host, path, level, position, toxic_, has, n_tokens, domain, allotment, copies, held_out, block, cell"


@pytest.fixture(scope="module")
def places(spark, tmp_path_factory):
    empty, odd = str(tmp_path_factory.mktemp("empty")), str(tmp_path_factory.mktemp("odd"))
    for name, kind in KINDS.items():
        spark.createDataFrame([], kind).write.parquet(f"{empty}/{name}.parquet")
        df = spark.createDataFrame(ROWS[name], kind)
        more = [f"'x' as `{c.strip()}`" for c in EXTRA.split(",") if c.strip() not in df.columns]
        df.selectExpr("*", *more).write.parquet(f"{odd}/{name}.parquet")
    return empty, odd


#: Rows of the odd tables that each query gives: all, but for the mix, and the calls among the turns.
COUNTS = {"op1_warc": 6, "op4_embedding_dedup": 9, "op7_url_filter": 6, "op9_tool_calls": 5, "op6_mix_sources": None}


@pytest.mark.parametrize("name", queries.queries())
def test_edges(spark, places, name):
    empty, odd = places
    run = queries.queries()[name]
    assert run(spark, empty).collect() == []
    rows = [tuple(r) for r in run(spark, odd).collect()]
    want = COUNTS.get(name, len(ROWS["documents"]))
    assert want is None or len(rows) == want
    if name not in ("op1_warc", "op9_tool_calls", "op6_mix_sources"):
        assert sum(r == next(x for x in rows if x[0] == 1) for r in rows) == 2  # repeated rows get equal results
