import re

import numpy as np

import corpus_pipeline
from gridloom.llm import common, mixing, simhash


def tables(spark, place):
    rng = np.random.default_rng(21)
    vocabulary = {"en": "the house and every dog that runs over some hill with cold water while people were walking near their old garden wall".split(), "de": "das haus und jeder hund der über einen berg läuft mit kaltem wasser während viele leute neben ihrem alten garten gehen".split()}
    text = lambda g, n=60: " ".join(f"{w}{rng.integers(0, 60)}" if rng.random() < 0.3 else w for w in rng.choice(vocabulary[g], n))
    docs = [(i, text("en" if i % 2 else "de"), "en" if i % 2 else "de", f"src{i % 3}") for i in range(240)]
    bad = [(300 + i, text("en") + " idiot scum moron vermin", "en", "src1") for i in range(60)]
    passage = text("en", 25)
    near = docs[10][1].split()
    near[0] = "changed"
    more = [(400, docs[4][1].replace(" ", "  "), "de", "src0"), (401, " ".join(near), "de", "src2"), (402, text("en", 20) + " " + passage + " " + text("en", 20), "en", "src1"), (403, None, "en", "src1"), (404, "12 345 !", None, None), (405, "Η γρήγορη αλεπού πηδά πάνω από το σκυλί " * 6, None, "src0"), (None, text("de"), "de", "src2")]
    rows = [(*r, 0) for r in [*docs, *bad, *more]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 300)) for i in [*range(240), *range(300, 350)]], "doc_id long, quality int, toxic int").write.parquet(f"{place}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(f"{place}/benchmark.parquet")
    return rows


def test_stages_and_run(spark, tmp_path):
    rows = tables(spark, tmp_path)
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert name == "mix" or out.dtypes == docs.dtypes
        docs = common.written(out, f"test-{name}")
        kept[name] = [r.doc_id for r in docs.select("doc_id").collect()]
    first, toxic, near, bench, mix = (set(kept[n]) for n, _ in corpus_pipeline.STAGES)
    everything = {r[0] for r in rows}
    assert everything - first >= {403, 404, 405} and len(everything - first) <= 4
    assert first - toxic >= set(range(300, 360)) and len(first - toxic) <= 62
    # the near-copy stage against all pairs
    text = {r[0]: r[1] for r in rows}
    sets = {i: set(simhash.shingle_set(text[i].encode()).tolist()) for i in toxic if i is not None}
    copies = {b for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert toxic - near == copies and {400, 401} <= copies
    assert near - bench == {402}
    # the mix against its budget by hand
    tokens = {i: len(re.findall(r"[^\x20\x09-\x0D]+", text[i])) for i in bench}
    assert mix <= bench and 0.5 < sum(tokens[i] for i in mix) / sum(tokens.values()) <= mixing.Mix().budget_percent / 100
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r.doc_id or -1) for r in again.collect()) == sorted((i or -1) for i in kept["mix"])


def test_run_on_empty_tables(spark, tmp_path):
    for name, kind in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
