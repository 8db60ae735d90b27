import base64
import gzip
import hashlib
import re
import time
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

import corpus_pipeline
from gridloom.llm import common, cosine, langid, mixing, mixlm, simhash, toolcalls, toxicity, urlfilter, warc, winnow


def brute_components(near, ids):
    label = list(ids)
    while True:
        new = [min(label[j] for j in range(len(ids)) if near[i][j] or i == j) for i in range(len(ids))]
        if new == label:
            return label
        label = new


def test_components_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in common.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_forest():
    a, b = common.forest(np.array([5, 3, 9]), np.array([3, 1, 8]))
    assert dict(zip(a.tolist(), b.tolist(), strict=True)) == {5: 1, 3: 1, 9: 8}


def test_warc_round_trip(spark, tmp_path):
    big = "é<p>\r\n\r\nWARC/1.1\r\n" * 2000
    rows = [(1, "http://a", big, 0), (2, "http://b", big, 0), (3, None, None, 0), (4, "x\r\ny", "short", 0), (None, "u", big, 0), (5, "e", "", 0), (5, "e", "", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload int")
    path = f"file://{tmp_path}/w"
    warc.write(pages, path)
    got = warc.read(spark, path).collect()
    assert len(got) == 7 and all(r.complete for r in got)
    assert sorted(r.record_type for r in got).count("revisit") == 1
    revisit = next(r for r in got if r.record_type == "revisit")
    assert revisit.refers_to in {r.record_id for r in got} and ":2:" in revisit.refers_to and len({r.record_id for r in got}) == 7
    assert sorted(len(r.payload or b"") for r in got) == sorted([0, 0, 0, 5, len(big.encode()), len(big.encode()), 0])


def test_warc_broken_segments(spark, tmp_path):
    record = warc.page_records(1, 0, "u", b"z" * 30_000, hashlib.sha1(b"z" * 30_000).hexdigest(), None) + b"\r\n"
    parts = record.split(b"WARC/1.1\r\n")
    (tmp_path / "a.gz").write_bytes(b"WARC/1.1\r\n".join(parts[:2] + parts[3:]))
    assert [(r.complete, r.payload) for r in warc.read(spark, f"file://{tmp_path}").collect()] == [(False, None)]
    (tmp_path / "a.gz").write_bytes(record)
    assert [(r.complete, r.payload) for r in warc.read(spark, f"file://{tmp_path}").collect()] == [(True, b"z" * 30_000)]
    (tmp_path / "a.gz").write_bytes(warc.page_records(1, 0, "u", b"text", hashlib.sha1(b"other").hexdigest(), None))
    assert [(r.complete, r.payload) for r in warc.read(spark, f"file://{tmp_path}").collect()] == [(False, None)]
    assert warc.said_so(b"text", "sha1:" + base64.b32encode(hashlib.sha1(b"text").digest()).decode())
    assert warc.dechunked(b"3;x=1\r\nabc\r\n0\r\nT: 1\r\n\r\n") == b"abc" and warc.dechunked(b"5\r\nab") is None


def test_warc_plain_and_damaged(spark, tmp_path):
    one, two = (warc.page_records(i, 0, "u", b"text", hashlib.sha1(b"text").hexdigest(), None) + b"\r\n" for i in (1, 2))
    (tmp_path / "a.warc").write_bytes(one + b"damaged\r\n" + two)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(one) + b"tail")
    whole = len(list(warc.parse(one)))
    got = [r.complete for r in warc.read(spark, f"file://{tmp_path}").collect()]
    assert got.count(True) == 3 * whole and got.count(False) == 2


def brute_fingerprint(text):
    """As the contract words it."""
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(x.encode(), 42).intdigest() for x in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def test_fingerprints_against_brute_force(spark):
    rng = np.random.default_rng(12)
    texts = [None, "", " \t\n", "One", "two Words", "É\x0bàB\x1c x", "a b c a b c a b c", *(" ".join(rng.choice(list("abcXYZé"), int(rng.integers(3, 200)))) for _ in range(20))]
    rows = simhash.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.fp & 0xFFFFFFFFFFFFFFFF for r in rows} == {i: brute_fingerprint(t) for i, t in enumerate(texts)}


def test_groups_come_whole():
    rng = np.random.default_rng(1)
    key = np.sort(rng.integers(0, 40, 1000))
    batches = [common.pa.RecordBatch.from_arrays([common.pa.array(key[i : i + 17]), common.pa.array(np.arange(i, min(1000, i + 17)))], names=["k", "v"]) for i in range(0, 1000, 17)]
    got = list(simhash.groups_of(batches, 50))
    assert np.concatenate([x[1] for x in got]).tolist() == list(range(1000)) and len(got) > 5
    ends = [set(x[0].tolist()) for x in got]
    assert all(not a & b for a, b in zip(ends, ends[1:], strict=False))


def test_simhash_links_all_pairs(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 20, dtype=np.uint64)
    codes = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 20, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 20, dtype=np.uint64)) for _ in range(30)]))
    reps = spark.createDataFrame([(int(c.astype(np.int64)), i) for i, c in enumerate(codes)], "fp long, rep long")
    got = {r.node: r.component for r in common.components(simhash.links(reps)).collect()}
    near = np.bitwise_count(codes[:, None] ^ codes[None]) <= 3
    assert [got.get(i, i) for i in range(len(codes))] == brute_components(near, range(len(codes)))


def test_near_copies_and_edge_cases(spark):
    words = [f"w{i}" for i in range(200)]
    text = " ".join(words)
    near = " ".join(["other", *words[1:]])
    far = " ".join(f"v{i}" for i in range(200))
    docs = spark.createDataFrame([(1, text, "e"), (2, near, "e"), (3, text.upper(), "e"), (4, far, "e"), (5, None, "e"), (6, "", "e"), (None, text, "e"), (7, " ".join(f"q{i}" for i in range(30_000)), "e")], "doc_id long, text string, fp string")
    kept = simhash.distinct_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 5, 7]
    rows = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert rows[5].fp == 0 and rows[6].component_id == 5 and rows[None].component_id is None
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def kept_by_brute_force(texts):
    sets = [set(simhash.shingle_set(t.encode()).tolist()) for t in texts]
    near = [[len(p & q) >= 0.8 * len(p | q) for q in sets] for p in sets]
    return sorted(set(brute_components(near, range(len(texts)))))


def test_near_copies_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL", 4, raising=False)
    rng = np.random.default_rng(8)
    texts = []
    for g in range(40):
        base = [f"g{g}x{i}" for i in rng.integers(0, 60, 40)] + [f"common{i}" for i in range(20)]
        for _ in range(5):  # words replaced at one place, so that similarities lie on both sides of 0.8
            at, n = int(rng.integers(0, 30)), int(rng.integers(1, 9))
            texts.append(" ".join([*base[:at], *(f"n{rng.integers(0, 10**9)}" for _ in range(n)), *base[at + n :]]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = sorted(r.doc_id for r in simhash.distinct_documents(docs).collect())
    assert kept == kept_by_brute_force(texts) and 40 < len(kept) < 200
    # the pairs themselves, without candidates from SimHash
    none = spark.createDataFrame([], "node long, component long")
    got = {(r.a, r.b) for r in simhash.across(simhash.shared_prefixes(docs), none).collect()}
    sets = [set(simhash.shingle_set(t.encode()).tolist()) for t in texts]
    assert got >= {(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}


def test_near_copies_beyond_the_nearest_fingerprint(spark):
    lines = [[f"l{i}w{k}" for k in range(8)] for i in range(25)]
    order = np.random.default_rng(2).permutation(200)
    words = [w for x in lines for w in x]
    # 1 has the words of 2 and 3 in another order: equal fingerprints, but a copy of neither; 3 repeats some of 2's words
    texts = [(1, " ".join(words[i] for i in order)), (2, " ".join(words)), (3, " ".join(words + words[:8]))]
    assert len({tuple(simhash.families(t.encode())) for _, t in texts}) == 1
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.distinct_documents(docs).collect()) == [1, 2]


def test_winnowing_against_brute_force(spark):
    rng = np.random.default_rng(1)
    voc = [f"t{i}" for i in range(30)]
    make = lambda n: " ".join(voc[i] for i in rng.integers(0, 30, n))
    items = [(0, make(40)), (1, make(9)), (2, make(3)), (3, None), (4, "!!"), (5, make(10))]
    docs = [(i, make(60)) for i in range(30)] + [(30, items[0][1][20:] + " " + items[1][1]), (31, items[5][1].upper() + "!"), (32, None), (33, "")]
    schema = "item_id long, text string"
    for block in (winnow.BLOCK_BYTES, 60):
        found = winnow.judged(winnow.scan(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, schema), ["doc_id"], block_bytes=block))
        got = {r.doc_id: (r.n_words, r.n_hit, list(r.items)) for r in found.collect()}
        for i, text in docs:
            w = winnow.words(text.encode() if text else None)
            hit, names = set(), set()
            for j, t in items:
                x = winnow.words(t.encode() if t else None)
                m = min(10, len(x))
                wins = {tuple(x[q : q + m]) for q in range(len(x) - m + 1)} if m else set()
                for p in range(len(w) - m + 1 if m else 0):
                    if tuple(w[p : p + m]) in wins:
                        hit |= set(range(p, p + m))
                        names.add(str(j))
            assert got[i] == (len(w), len(hit), sorted(names)), i


def test_winnowing_of_repeats_is_linear():
    word, n = b"again ", 20_000
    items = winnow.Items([("a", word * n), ("b", b"x y " * n), ("c", word * 4)])
    began = time.process_time()
    (got,) = items.hits([b"new " + word * n + b"end"])
    assert got == (n + 2, [(0, 1, n + 1), (2, 1, n + 1)]) and time.process_time() - began < 5


@pytest.mark.parametrize("block", [2048, 16])
def test_cosine_against_brute_force(spark, block):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 16))
    x = np.concatenate([base, base[:20] + 0.15 * rng.normal(size=(20, 16)), base[:1] + 0.1 * rng.normal(size=(60, 16)), base[:5]])
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, [None] * 16, 0), (904, [], 0)]
    got = {r.vec_id: r for r in cosine.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int"), block=block).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    assert [got[i].n_links for i in range(len(x))] == near.sum(1).tolist() and near.any()
    assert [got[i].component_id for i in range(len(x))] == brute_components(near, range(len(x)))
    assert all(got[i].n_links == 0 and got[i].kept for i in range(900, 905))


def test_gru_gradient():
    rng = np.random.default_rng(0)
    g = langid.Gru.new(4, rng)
    g.byte, g.u = g.byte.astype(np.float64), g.u.astype(np.float64)
    x, grad = rng.integers(0, 257, (6, 3)), rng.normal(size=(6, 3, 4))
    kept = []
    g.states(x, kept)
    back = g.back(x, kept, grad)
    for i, j in ((0, 0), (2, 5), (3, 11)):
        was, side = g.u[i, j], []
        for e in (1e-3, -1e-3):
            g.u[i, j] = was + e
            side.append((g.states(x) * grad).sum())
        g.u[i, j] = was
        assert abs((side[0] - side[1]) / 2e-3 - back.u[i, j]) < 2e-2 * max(1, abs(back.u[i, j]))


def test_gru_gradients_of_all_parameters_and_pooling():
    """A step of training against central differences of a loss computed byte by byte."""
    rng = np.random.default_rng(3)
    langs, hidden = ["a", "b", "c"], 3
    model = langid.Model(langs, langid.Gru.new(hidden, rng), langid.Gru.new(hidden, rng), rng.normal(0, 0.5, (2 * hidden, 3)), rng.normal(0, 0.5, 3))
    for g in (model.ahead, model.behind):
        g.byte, g.u = g.byte.astype(np.float64), g.u.astype(np.float64)

    def run(g, data):
        h, out = np.zeros(hidden), []
        for b in data:
            gates = g.byte[b, : 2 * hidden] + h @ g.u[:, : 2 * hidden]
            z, r = (1 / (1 + np.exp(-gates[k * hidden : (k + 1) * hidden])) for k in (0, 1))
            c = np.tanh(g.byte[b, 2 * hidden :] + (r * h) @ g.u[:, 2 * hidden :])
            h = (1 - z) * c + z * h
            out.append(h)
        return out

    def probabilities(data):
        both = zip(run(model.ahead, data), run(model.behind, data[::-1])[::-1], strict=True)
        logits = [np.concatenate(x) @ model.w + model.b for x in both]
        return np.array([np.exp(x) / np.exp(x).sum() for x in logits])

    x, y = rng.integers(0, 256, (7, 2)), np.array([0, 2])
    loss = lambda: -sum(np.log(probabilities(x[:, i].tolist())[:, y[i]]).sum() for i in range(2)) / 14
    grads = langid.gradients(model, x, y)
    for p, g in zip((model.ahead.byte, model.ahead.u, model.behind.byte, model.behind.u, model.w, model.b), grads, strict=True):
        flat, got = p.reshape(-1), g.reshape(-1)
        for i in rng.choice(np.flatnonzero(got), 6) if np.any(got) else []:
            was, side = flat[i], []
            for e in (1e-4, -1e-4):
                flat[i] = was + e
                side.append(loss())
            flat[i] = was
            assert abs((side[0] - side[1]) / 2e-4 - got[i]) < 1e-4 + 1e-2 * abs(got[i])
    text = bytes(rng.integers(97, 123, 150).tolist())
    cut = [probabilities(list(text[i : i + langid.WINDOW])) for i in range(0, 150, langid.WINDOW)]
    # padding behind the last window's end is read by the backward direction first
    pad = langid.WINDOW - 150 % langid.WINDOW
    cut[-1] = probabilities(list(text[-(150 % langid.WINDOW) :]) + [256] * pad)[:-pad]
    assert np.allclose(model.pooled([text])[0], np.concatenate(cut).mean(0), atol=1e-5)


def test_training_steps_use_memory_again_and_give_the_same():
    rng = np.random.default_rng(5)
    model = langid.Model(["a", "b"], langid.Gru.new(8, rng), langid.Gru.new(8, rng), rng.normal(0, 0.5, (16, 3)).astype(np.float32), np.zeros(3, np.float32))
    space, peaks = langid.Space(), []
    for size in (200, 7, 200, 90):  # a step must not see what a larger one left
        x, y, weight = rng.integers(97, 123, (langid.WINDOW, size)), rng.integers(0, 3, size), rng.random(size)
        x[50:, : size // 3] = 256
        want = langid.gradients(model, x, y, weight)
        tracemalloc.start()
        got = langid.gradients(model, x, y, weight, space)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert all(np.array_equal(a, b) for a, b in zip(got, want, strict=True))
    assert peaks[2] < peaks[0] / 3


def test_language_sample_is_the_least_hashes(spark):
    rows = [(i, f"text {i}", g) for i in range(900) for g in ("x", "y") if g == "x" or i < 30] + [(0, "text 0", "x"), (None, None, "x"), (1, "t", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.sample(docs, 50)
    assert sorted(g for _, g in got) == ["x"] * 50 + ["y"] * 30 and len(set(got)) == 80
    assert sorted(got) == sorted(langid.sample(docs.repartition(7), 50))


def test_language(spark):
    rng = np.random.default_rng(4)
    make = lambda a: " ".join("".join(rng.choice(list(a), 4)) for _ in range(30))
    rows = [(make("abcde").encode(), "x") for _ in range(60)] + [(make("vwxyzé").encode(), "y") for _ in range(60)]
    model = langid.train(rows, steps=40)
    lang, score = model.judge([make("abcde").encode(), make("vwxyz").encode() * 40, None, b"123 !", b""])
    assert lang == ["x", "y", "und", "und", "und"] and score[2:] == [0, 0, 0] and min(score[:2]) > 0.5
    assert langid.train([]).judge([b"abc"]) == (["und"], [0.0])


def test_language_rejects_what_was_not_learned(spark):
    rng = np.random.default_rng(4)
    vocabulary = {"en": "the house and every dog that runs over some hill with water", "de": "das haus und jeder hund der über einen berg läuft mit wasser"}
    rows = [(i, " ".join(rng.choice(vocabulary[g].split(), 30)), g) for i in range(60) for g in vocabulary]
    odd = ["Η γρήγορη αλεπού πηδά πάνω από το σκυλί και τρέχει στο δάσος " * 3, "तेज भूरी लोमड़ी आलसी कुत्ते के ऊपर कूदती है " * 4, " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(60))]
    docs = spark.createDataFrame(rows + [(1000 + i, t, None) for i, t in enumerate([*odd, None, "123"])], "doc_id long, text string, lang string")
    kept = [r.doc_id for r in corpus_pipeline.language(spark, docs, "").collect()]
    assert max(kept) < 1000 and len(kept) >= len(rows) - 1


def test_toxicity():
    rng = np.random.default_rng(5)
    clean = [(" ".join(f"w{i}" for i in rng.integers(0, 80, 40)), 0) for _ in range(300)]
    bad = [(t + " " + " ".join(rng.choice(["idiot", "scum", "moron"], 2)), 1) for t, _ in clean[:60]]
    model = toxicity.train([(t.encode(), y) for t, y in clean + bad])
    p = model.above([b"w1 w2 scum idiot", b"w1 w2 " * 5000, None, b""])
    assert p[0, 0] > 0.5 > p[1:, 0].max() and (np.diff(p, axis=1) <= 0).all()
    assert toxicity.train([]).above([b"x"]).sum() < 1e-9
    # batches without any fitted feature
    assert toxicity.train([(b"a b", 0)] * 90 + [(b"a b", 1)] * 9).above([b"a"])[0, 0] < 0.5


def test_ordinal_gradient_against_the_likelihood():
    rng = np.random.default_rng(2)
    w, gap, y = rng.normal(size=6), np.array([0.3, -0.5, 0.2]), np.array([0, 1, 2, 3, 1])
    sparse = [np.sort(rng.choice(6, 3, replace=False)) for _ in y]

    def loss():
        theta = [gap[0], gap[0] + np.exp(gap[1]), gap[0] + np.exp(gap[1]) + np.exp(gap[2])]
        total = 0.0
        for x, grade in zip(sparse, y, strict=True):
            above = [1.0, *(1 / (1 + np.exp(-(w[x].sum() - t))) for t in theta), 0.0]
            total -= np.log(above[grade] - above[grade + 1])
        return total

    for at, got in zip((w, gap), toxicity.steps(w, gap, sparse, y), strict=True):
        for i in range(len(at)):
            was, side = at[i], []
            for e in (1e-5, -1e-5):
                at[i] = was + e
                side.append(loss())
            at[i] = was
            assert abs((side[0] - side[1]) / 2e-5 - got[i]) < 1e-5
    assert (np.diff(toxicity.thresholds(gap)) > 0).all()


def test_toxicity_through_spark(spark):
    rng = np.random.default_rng(5)
    clean = [" ".join(f"w{i}" for i in rng.integers(0, 80, 40)) for _ in range(300)]
    texts = clean + [t + " " + " ".join(rng.choice(["idiot", "scum", "moron"], 2)) for t in clean[:60]] + [None, ""]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(texts)], "doc_id long, text string, severity double")
    labels = spark.createDataFrame([(i, int(i >= 300)) for i in range(360)] + [(3, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fitted(docs, labels)
    near = toxicity.train([(t.encode(), int(i >= 300)) for i, t in enumerate(texts[:360])])
    assert set(model.w) == set(near.w) and model.w
    kept = {r.doc_id for r in toxicity.accepted(docs, model).collect()}
    assert {300 + i for i in range(60)} & kept == set() and {*range(300), 360, 361} <= kept
    # the slow way: a score from the texts' features
    p = model.above([t.encode() if t else None for t in texts[295:305]])
    for t, row in zip(texts[295:305], p, strict=True):
        feats = {f for w in set(toxicity.words(t.encode())) for f in toxicity.features(w)}
        assert np.allclose(row, [1 / (1 + np.exp(-(sum(model.w.get(f, 0) for f in feats) - th))) for th in model.thresholds])
    only = toxicity.fitted(docs, labels.filter("toxic = 1"))
    assert toxicity.accepted(docs, only).count() == len(texts)


def brute_budget(leaves, mix):
    """Budgets by the tree, one share at a time: children that can't use their share are filled, and the rest is shared anew."""
    def weight(level, name):
        return getattr(mix, level).get(name, mix.other)

    def pour(budget, children):
        open_, out = dict(children), {}
        while True:
            total = sum(w for _, w in open_.values())
            short = {k for k, (cap, w) in open_.items() if cap * total <= budget * w}
            if not short:
                return out | {k: budget * w // total for k, (cap, w) in open_.items()}
            for k in short:
                out[k] = open_.pop(k)[0]
                budget -= out[k]
            if not open_:
                return out

    def down(budget, rows, levels):
        if not levels:
            return {rows[0][0]: budget}
        names = sorted({x[0][3 - len(levels)] for x in rows})
        part = {n: [x for x in rows if x[0][3 - len(levels)] == n] for n in names}
        shares = pour(budget, {n: (sum(c for _, c in part[n]), weight(levels[0], n)) for n in names})
        return {k: v for n in names for k, v in down(shares[n], part[n], levels[1:]).items()}

    caps = [(k, t * mix.max_epochs) for k, t in leaves.items()]
    return down(sum(leaves.values()) * mix.budget_percent // 100, caps, list(mixing.LEVELS))


def test_budgets_against_brute_force(spark):
    rng = np.random.default_rng(4)
    for percent in (10, 60, 150, 200):
        mix = mixing.Mix(budget_percent=percent)
        leaves = {(d, g, s): int(rng.integers(0, 10 ** int(rng.integers(1, 6)))) for d in "012" for g in ("en", "de", "xx") for s in ("src0", "src1") if rng.random() < 0.8}
        df = spark.createDataFrame([(*k, v) for k, v in leaves.items()], "domain string, lang string, source string, tokens long")
        got = {(r.domain, r.lang, r.source): r.allotment for r in mixing.allotments(df, mix).collect()}
        assert got == brute_budget(leaves, mix)


def test_url_trees_with_both_classes(spark):
    rows = [(i, f"http://h{i % 7}.net/a/{'x' * (i % 5)}" if i % 2 else f"https://safe{i}.org/fr/page?id={i}&n={i * 7}#top") for i in range(600)]
    rows += [(1000 + i, f"http://h{i}.info/a/xx") for i in range(20)] + [(2000 + i, f"https://safe{i}.info/fr/page?id={i}&n=1#top") for i in range(20)] + [(3000, None)]
    rows += [(5000 + i, "http://hot.net/a") for i in range(400)]
    docs = spark.createDataFrame(rows, "page_id long, url string")
    got = {r.page_id: r for r in urlfilter.filtered(docs, train_rows=300).collect()}
    assert len(got) == len(rows)
    for i, url in rows:
        host, path = (url.split("://")[1].split("/")[0], "/" + re.split("[?#]", url.split("://")[1].split("/", 1)[1])[0]) if url else ("", "")
        fits = [(len(h + p), h + p, v) for h, p, v in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, max(fits)[1] if fits else None)
        assert not fits or got[i].verdict == max(fits)[2]
    assert {got[1000 + i].verdict for i in range(20)} == {"block"} and {got[2000 + i].verdict for i in range(20)} == {"allow"}


def test_scratch_is_released(spark):
    kept, gone = common.written(spark.range(3).toDF("a"), "kept"), common.written(spark.range(3).toDF("a"), "gone")
    path = kept.inputFiles()[0].rsplit("/", 1)[0]
    common.release(spark, *[p for p in common._MADE if p.rsplit("/", 1)[1] in path])
    assert kept.count() == 3
    with pytest.raises(Exception, match="(?i)exist|not found"):
        gone.count()


def test_mixing_empty_and_nulls(spark):
    kind = "doc_id long, text string, lang string, source string, n_tokens int"
    assert mixing.mixed(spark.createDataFrame([], kind)).count() == 0
    rows = mixing.mixed(spark.createDataFrame([(1, "a b", None, None, 0), (None, None, "en", "src1", 0), (2, "c d e", "en", "src1", 0)], kind)).collect()
    assert all(r.copies > 0 for r in rows)


def test_url_parts_and_single_class(spark):
    rows = [(1, "HTTP://A.Example.NET/en/x?y#z", 0), (2, None, 0), (3, "no scheme", 0), (4, "http://net.", 0), (5, "x://b.org/fr/", 0)]
    got = {r.page_id: r for r in urlfilter.filtered(spark.createDataFrame(rows, "page_id long, url string, length int")).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert (got[2].host, got[3].path, got[2].rule, got[4].rule) == ("", "", None, None) and got[5].rule == "org/fr/"


def test_tool_calls(spark):
    calls = [("c", "b", 1, "answer", '{"turn": 1, "prompt": "é\\n"}', ["a", "zz"]), ("c", "a", 2, "answer", "{broken", None), ("c", "x", 3, "answer", '{"turn":-1,"prompt":"p"}', ["y"]), ("c", "y", 4, "none", "{}", ["x"]), (None, "a", 1, "answer", None, None)]
    results = [("c", "a", 5, "old"), ("c", "a", 6, "new"), ("d", "a", 1, "orphan")]
    calls = spark.createDataFrame(calls, "conv_id string, call_id string, position long, name string, arguments string, depends_on array<string>")
    results = spark.createDataFrame(results, "conv_id string, call_id string, position long, content string")
    got = {(r.conv_id, r.call_id): r for r in toolcalls.linked(calls, results, toolcalls.TOOLS).collect()}
    assert (got["c", "a"].call_order, got["c", "b"].call_order, got["c", "x"].call_order) == (1, 2, None)
    assert got["c", "b"].valid and not got["c", "a"].valid and got["c", "a"].linked and not got["c", "b"].linked
    assert '"arguments":{"prompt":"é\\n","turn":1}' in got["c", "b"].message and '"result":"new"' in got["c", "a"].message
    assert toolcalls.orphans(calls, results).count() == 1


@pytest.mark.parametrize("group", [128, 2])
def test_tool_call_order_against_brute_force(spark, group):
    rng = np.random.default_rng(9)
    rows, want = [], {}
    for conv in range(25):
        n = int(rng.integers(1, 14))
        needs = {i: [int(j) for j in rng.integers(-1, n, int(rng.integers(0, 3))) if j >= 0 and (j < i or rng.random() < 0.4)] for i in range(n)}
        rows += [(f"c{conv}", f"k{i:02}", i, [f"k{j:02}" for j in x] + ["gone"]) for i, x in needs.items()]
        level, changed = {}, True
        if all(j < i for i, x in needs.items() for j in x):
            level = dict.fromkeys(needs, 0)
        while changed and len(level) < n:
            ready = [i for i, x in needs.items() if i not in level and all(j in level for j in x)]
            level |= {i: max((level[j] for j in needs[i]), default=-1) + 1 for i in ready}
            changed = bool(ready)
        for k, i in enumerate(sorted(level, key=lambda i: (level[i], i)), 1):
            want[f"c{conv}", f"k{i:02}"] = k
    calls = spark.createDataFrame(rows, "conv_id string, call_id string, position long, depends_on array<string>")
    found = toolcalls.levels(calls, group)
    got = toolcalls.numbered(calls.join(found, ["conv_id", "call_id"], "left")).collect()
    assert {(r.conv_id, r.call_id): r.call_order for r in got if r.call_order} == want and len(got) == len(rows) and 0 < len(want) < len(rows)


def test_tool_calls_in_a_long_chain_and_without_keys(spark):
    n = 300
    calls = spark.createDataFrame([("c", f"k{i}", i, "answer", "{}", [f"k{i + 1}"]) for i in range(n)] + [(None, "k", 1, "answer", "{}", None)] * 2, "conv_id string, call_id string, position long, name string, arguments string, depends_on array<string>")
    results = spark.createDataFrame([(None, "k", 1, "x")], "conv_id string, call_id string, position long, content string")
    toolcalls_group = toolcalls.GROUP
    rows = toolcalls.levels(calls.filter("conv_id is not null"), n).collect()
    assert {r.call_id: r.level for r in rows} == {f"k{i}": n - 1 - i for i in range(n)} and toolcalls_group < n
    few = toolcalls.linked(calls.filter("position < 5"), results, toolcalls.TOOLS).collect()
    assert sum(r.conv_id is None for r in few) == 2 and not any(r.linked or r.valid for r in few if r.conv_id is None)


def test_mixing_lm_is_a_distribution():
    texts = [mixlm.words(t) for t in (b"ab abc ab", b"abc ab", b"ba ab abc")]
    at, n = np.unique(mixlm.places(*mixlm.stream(texts)), return_counts=True)
    mixer = mixlm.Mixer.new(mixlm.bit_tree(at, n))
    flat, doc = mixlm.stream(texts)
    real = doc >= 0
    mixer.learn(mixlm.contexts(flat)[0][:, real], flat[real])
    slots = np.repeat(mixlm.contexts(flat)[0][:, [12]], 256, axis=1)
    assert abs((10 ** mixer.log10(slots, np.arange(256, dtype=np.uint8))).sum() - 1) < 1e-3
    # slots and keys depend on the last six bytes and the word so far, wherever these are
    slots, key, _ = mixlm.contexts(flat)
    seen = {}
    for i in np.flatnonzero(real):
        word = flat[:i].tobytes().translate(bytes.maketrans(b"\0\n", b"  ")).rsplit(b" ", 1)[-1]
        what = (flat[i - 6 : i].tobytes(), word, int(flat[i]))
        assert seen.setdefault(what, (slots[:, i].tolist(), key[i])) == (slots[:, i].tolist(), key[i])
    assert len({k for _, k in seen.values()}) == len(seen)
    scorer = mixlm.Scorer(mixer)
    first = scorer.log10(texts)
    whole = np.bincount(doc[real], mixer.log10(slots[:, real], flat[real]))
    assert np.allclose(first, whole, atol=1e-4)
    assert np.allclose(first, scorer.log10(texts)) and np.allclose(first[1:], mixlm.Scorer(mixer).log10(texts[1:]))


def test_mixing_lm_tunes_on_the_whole_fold(spark, monkeypatch):
    monkeypatch.setattr(mixlm, "PART", 1 << 12, raising=False)
    texts = [f"word{i} and some more words of text {i % 7}" for i in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    none = spark.createDataFrame([], mixlm.COUNTED)
    mixer = mixlm.fitted(docs, none)
    assert mixer.seen.sum() == mixlm.EPOCHS * 8 * sum(len(t) + 1 for t in texts)
    assert mixer.tree.any() and np.isfinite(mixer.weights).all()


def test_crc_bucket(spark):
    ids = spark.range(50).withColumnRenamed("id", "doc_id")
    got = {r[0] for r in ids.filter(common.in_bucket("doc_id", 7, 2)).collect()}
    assert got == {i for i in range(50) if zlib.crc32(str(i).encode()) % 7 == 2}


def brute_expected(texts, fold, anchor):
    """By plain dictionaries: of every context of two words its most frequent next word and count, and the gates' rates."""
    with_fold, without, held = {}, {}, {}
    for i, t in enumerate(texts):
        flat, doc = mixlm.stream([mixlm.words(t.encode())])
        _, c, w, _, _ = mixlm.anchors(flat, doc, mixlm.contexts(flat)[2])
        for key in zip(c.tolist(), w.tolist(), strict=True):
            for d in [with_fold] + ([held] if fold[i] else [without]):
                d.setdefault(key[0], {})
                d[key[0]][key[1]] = d[key[0]].get(key[1], 0) + 1
    top = lambda x: max((n, np.uint64(w).tobytes()) for w, n in x.items())
    gate = lambda n, total: min(7, int(np.log2(n))) * 5 + int(4 * n / total)
    right, asked = np.full(mixlm.GATES, 2 * mixlm.GUESS), np.full(mixlm.GATES, 2.0)
    for c, met in held.items():
        if c in without:
            n, w = top(without[c])
            g = gate(n, sum(without[c].values()))
            right[g] += met.get(int(np.frombuffer(w, "<u8")[0]), 0)
            asked[g] += sum(met.values())
    sure = np.clip(right / asked, 1e-4, 0.999)
    return {c: (int(np.frombuffer(top(x)[1], "<u8")[0]), sure[gate(top(x)[0], sum(x.values()))]) for c, x in with_fold.items()}


@pytest.mark.parametrize("head", [1 << 16, 3])
def test_mixing_lm_through_spark_against_brute_force(spark, monkeypatch, head):
    monkeypatch.setattr(mixlm, "HEAD", head, raising=False)
    monkeypatch.setattr(mixlm, "FLUSH", 50, raising=False)
    rng = np.random.default_rng(6)
    voc = [f"w{i}" for i in range(12)]
    texts = [" ".join(rng.choice(voc, int(rng.integers(0, 60)))) for _ in range(120)] + ["É ÀB Cd\tx y", "", "solo"]
    texts += texts[:20]
    rows = [(i, t) for i, t in enumerate(texts)] + [(len(texts), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in mixlm.scores(docs, mixlm.F.col("doc_id") % 5 != 2, mixlm.F.col("doc_id") % 4 == 1).collect()}
    words = {i: mixlm.words(t.encode() if t else None) for i, t in rows}
    learn = [i for i, _ in rows if i % 5 != 2]
    count = {}
    for i in learn:
        for w in [*words[i], b""]:
            count[w] = count.get(w, 0) + 1
    total, below = sum(count.values()), sum(count.values()) + len(count) + 1
    for i, _ in rows:
        tokens = [*words[i], b""]
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(tokens), sum(w in count for w in tokens), total)
        assert abs(got[i].base_score - sum(np.log10((count.get(w, 0) + 1) / below) for w in tokens)) < 1e-9
    # the score: bits by the fitted mixer, and what the expected words add
    counts = mixlm.counted(docs.filter("doc_id % 5 <> 2").withColumn("counted", mixlm.F.expr("doc_id % 4 <> 1")))
    mixer = mixlm.fitted(docs.filter("doc_id % 5 <> 2 and doc_id % 4 = 1"), counts)
    known = brute_expected([texts[i] if i < len(texts) else "" for i in learn], [i % 4 == 1 for i in learn], mixlm.ANCHOR)
    met = 0
    for i, _ in rows:
        flat, doc = mixlm.stream([words[i]])
        real = np.flatnonzero(doc >= 0)
        slots, _, word = mixlm.contexts(flat)
        each = np.zeros(len(flat))
        each[real] = mixer.log10(slots[:, real], flat[real])
        want = each.sum()
        for _, c, w, a, b in zip(*(x.tolist() for x in mixlm.anchors(flat, doc, word)), strict=True):
            if c in known:
                met += 1
                p, g = 10 ** each[a:b].sum(), known[c][1]
                want += np.log10(g * (known[c][0] == w) + (1 - g) * p) - np.log10(p)
        assert abs(got[i].score - want) < 1e-3 * max(1, abs(want)), i
    assert met > 50 and got[5].score <= 0


def test_mixing_lm_looks_at_every_place(spark, monkeypatch):
    rng = np.random.default_rng(8)
    voc = [f"a{'b' * int(rng.integers(0, 30))}{i}same-end" for i in range(40)]
    texts = [mixlm.words(" ".join(rng.choice(voc, n)).encode()) for n in (0, 1, 2, 3, 50, 400)]
    flat, doc = mixlm.stream(texts)
    of, context, after, _, _ = mixlm.anchors(flat, doc, mixlm.contexts(flat)[2])
    assert np.bincount(of, minlength=len(texts)).tolist() == [max(0, len(w) - 2) for w in texts]
    before = [(w[i], w[i + 1]) for w in texts for i in range(len(w) - 2)]
    then = [(w[i + 2], i + 3 == len(w)) for w in texts for i in range(len(w) - 2)]
    # as many hashes as there are different contexts and words, each of one of them
    for plain, hashed in ((before, context), (then, after)):
        assert len(set(plain)) == len(set(hashed.tolist())) == len(set(zip(plain, hashed.tolist(), strict=True)))
    # a score does not depend on the blocks and buckets that its places go through
    rows = [(i, " ".join(rng.choice(voc[:9], int(rng.integers(0, 40))))) for i in range(150)] + [(150, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "doc_id")
    run = lambda: {r.doc_id: r.score for r in mixlm.scores(docs, mixlm.F.col("doc_id") % 5 != 2, mixlm.F.col("doc_id") % 4 == 1).collect()}
    whole = run()
    monkeypatch.setattr(mixlm, "BLOCK", 2)
    monkeypatch.setattr(mixlm, "BUCKET", 1 << 12)
    parts = run()
    assert len(parts) == len(rows) and all(abs(parts[i] - whole[i]) < 1e-6 * max(1, abs(whole[i])) for i in whole)


def test_pairs_of_any_count_come_back_and_nothing_read_no_more_is_left(spark):
    rng = np.random.default_rng(3)
    n, held = (rng.choice([0, 1, 2, 14, 15, 16, 255, 70_000], 500).astype(np.uint32) for _ in range(2))
    code, more, upto = mixlm.packed(n, held)
    for a, b in ((0, 500), (17, 17), (17, 180), (499, 500)):
        got = mixlm.unpacked(code[a:b], more[upto[a] : upto[b]].ravel())
        assert code.itemsize == 1 and np.array_equal(got[0], n[a:b]) and np.array_equal(got[1], held[a:b])
    # a pair that comes 40 times in counted texts and 30 times in the fold
    rows = [(k, r, "one two three") for k, r in enumerate([1] * 40 + [2] * 30)]
    found = mixlm.answered(spark.createDataFrame(rows, "row long, role int, text string").coalesce(1), 1)
    assert [tuple(x) for x in found.filter("gate is not null").select("gate", "correct", "asked").collect()] == [(int(mixlm.gate(np.array([40]), np.array([40]))[0]), 30, 30)]
    docs = spark.createDataFrame([(i, "one two three four " * (i % 5)) for i in range(40)], "doc_id long, text string")
    before = set(common.made())
    out = mixlm.scores(docs, mixlm.F.col("doc_id") % 5 != 2, mixlm.F.col("doc_id") % 4 == 1)
    left = set(common.made()) - before
    assert out.count() == 40 and not any("-rows-" in x for x in left) and any("-scored-" in x for x in left)


def test_pairs_and_places_take_little_disk(spark):
    rng = np.random.default_rng(4)
    for size in ([1], [3, 1, 700, 2], [5000] * 3):
        key = np.concatenate([np.sort(rng.integers(0, 1 << 64, n, np.uint64) >> np.uint64(shift)) for n, shift in zip(size, [0, 20, 3, 40], strict=False)])
        spread = mixlm.apart(key, np.array(size))
        assert spread.nbytes == key.nbytes and np.array_equal(mixlm.together(spread, np.array(size)), key)
    n = np.array([0, 254, 255, 256, 7, 1 << 31])
    code, more = mixlm.small(n)
    back, rest = mixlm.whole(code.tobytes(), np.append(more, np.uint32(5)))
    assert code.itemsize == 1 and np.array_equal(back, n) and rest.tolist() == [5]
    # what goes to the shuffle, compressed as there: a pair took more than 8 bytes, a place 12 before
    rows = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 400)) for _ in range(300)]
    batch = pa.RecordBatch.from_pydict({"row": pa.array(range(300), pa.int64()), "role": pa.array([1, 1, 2] * 100, pa.int32()), "text": rows})
    out = pa.Table.from_batches(list(mixlm._gather(3)([batch]))).to_pylist()
    taken = lambda some: sum(len(pa.compress(b"".join(r[c] for c in ("key", "n", "held")), codec="lz4_raw", asbytes=True)) for r in some)
    asked, places = [r for r in out if r["bucket"] >= 0], [r for r in out if r["bucket"] < 0]
    assert taken(asked) < 7.5 * sum(len(r["n"]) for r in asked) and sum(len(r["n"]) for r in asked) > 100_000
    assert sum(len(r[c]) for r in places for c in ("key", "n", "held")) < 6 * len(np.unique(np.concatenate([mixlm.places(*mixlm.stream([mixlm.words(t.encode())])) for t in rows])))
    # shuffles that led to a table go with its writing, though the frame lives on
    blocks = lambda: set(re.findall(r"shuffle_\d+", spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllBlocks().mkString(" ")))
    setting, before = spark.conf.get(common._CLEANUP), blocks()
    frame = spark.range(1000).repartition(3, "id")
    table = common.written(frame, "lean", lean=True)
    for _ in range(100):
        if not blocks() - before:
            break
        time.sleep(0.1)
    assert not blocks() - before and table.count() == frame.count() == 1000 and spark.conf.get(common._CLEANUP) == setting
    assert all(".zstd." in f for f in table.inputFiles())


def test_language_model_and_threshold_from_all_labelled_texts(spark):
    rng = np.random.default_rng(12)
    voc = {"aa": "alpha beta gamma delta river stone".split(), "bb": "zorro quux wyrd jinx flux vexed".split()}
    rows = [(i, " ".join(rng.choice(voc[g], int(rng.integers(1, 60)))), g) for i, g in enumerate(rng.choice(["aa", "bb"], 900, p=[0.9, 0.1]).tolist())] + [(900, None, "aa"), (901, "12 34", "bb"), (902, "zorro beta", None), (None, "flux flux", "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    may = [(t, g) for i, t, g in rows if not (i is not None and zlib.crc32(str(i).encode()) % 4 == 2) and t and g and langid.has_letter(t.encode())]
    model, seen = langid.whole(langid.learnable(docs), 20)
    # every window of every labelled text, and not those of the sample alone
    assert seen == sum(-(-len(t.encode()) // langid.WINDOW) for t, _ in may)
    assert len(langid.sample(langid.learnable(docs), 20)) <= 40 < len(may)
    lang, _ = model.judge([t.encode() for t, _ in may])
    assert np.mean([a == b for a, (_, b) in zip(lang, may, strict=True)]) > 0.98
    again, _ = langid.whole(langid.learnable(docs).repartition(5), 20)
    assert np.allclose(again.w, model.w, atol=1e-5) and np.allclose(again.ahead.byte, model.ahead.byte, atol=1e-5)
    # the threshold is the exact order statistic of all of them
    score = model.learned([t.encode() for t, _ in may])
    least = 0.9 * np.quantile(score, 1 - langid.STAY, method="lower")
    every = model.learned([t.encode() if t else None for _, t, _ in rows])
    want = sorted((i if i is not None else -1) for (i, _, _), x in zip(rows, every, strict=True) if x > 0 and x >= least)
    assert sorted((r.doc_id if r.doc_id is not None else -1) for r in langid.guarded(docs, 20).collect()) == want
    frame = spark.createDataFrame([(float(x),) for x in [*rng.random(3000) ** 9, *[0.25] * 2000]], "s double")
    ordered = sorted(r[0] for r in frame.collect())
    assert [langid.ranked(frame, "s", k) for k in (0, 3, 2500, 4999)] == [ordered[k] for k in (0, 3, 2500, 4999)]
