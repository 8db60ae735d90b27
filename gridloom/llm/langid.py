"""Language identification: a bidirectional gated recurrent network over bytes, in numpy.

Each direction is a GRU whose gates take a learned row per byte; a softmax over both states labels every byte of a
text, and the mean of the labels' probabilities over all its bytes is the document's.
Texts are cut into windows of WINDOW bytes, each read in both directions from a zero state, so work is linear in the
text and bounded per step; all windows of a whole text count. Training is by backpropagation through time with Adam on
windows drawn from a bounded sample: QUOTA documents per language at most, those of least hash, WINDOWS windows in all.
Languages are few: one row of each goes to all workers, which pick by a threshold of the hash, so no language is sorted.

The pipeline's model only starts from that sample: whole() then learns from every window of every labelled text, in parts
that begin with the same model and are averaged by their windows, and guarded() takes its threshold from the scores of
all labelled texts, not of a sample.

A null text, or one without a letter, is `und` with score 0. Ties go to the language that sorts first. Without a
labelled document every text is `und`. Very long texts are cut over several steps; nothing is truncated. Repeated rows
get equal predictions; null ids are predicted like others and count as not held out. Extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import in_bucket, join_bytes, prepare, text_column, written

WINDOW, HIDDEN, BATCH, STEPS, RATE, SEED = 64, 8, 256, 220, 0.02, 11
QUOTA, WINDOWS = 400, 24_000
#: Texts made up in no language, and the share of labelled texts that the threshold of guarded() lets through at least.
STRANGERS, STAY = 400, 0.999
#: Of whole(): bytes of a part, windows of a step, texts that are mixed at a time, and the rate.
PART, MIXED, TOGETHER, FINE = 1 << 23, 512, 100, 0.002
#: Rows among which a score is sought by sorting; buckets of the search before that.
FEW, SPLIT = 1000, 1024
#: Windows labelled at a time; what a step of these reads stays in a core's cache.
ROWS = 1024
UND = "und"
_LETTER = regex.compile(r"\p{L}")


def sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    with np.errstate(over="ignore"):  # 1 / (1 + infinity) is 0, as it should be
        np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


@dataclass
class Gru:
    """One direction. byte: (257, 3H) rows added to the gates update, reset, candidate (row 256: padding); u: (H, 3H)."""

    byte: np.ndarray
    u: np.ndarray

    @classmethod
    def new(cls, hidden: int, rng) -> Gru:
        return cls((rng.normal(0, 0.3, (257, 3 * hidden))).astype(np.float32), (rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden))).astype(np.float32))

    def states(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """x: (T, B) bytes -> (T, B, H)."""
        kept = forward([self], x[:, None], Space(), keep is not None)
        if keep is not None:
            keep.extend(kept)
        return kept[0][1:, 0]

    def back(self, x: np.ndarray, kept: list, grad: np.ndarray) -> Gru:
        """Gradients by backpropagation through time; grad: of the states."""
        return backward([self], x[:, None], kept, grad[:, None], Space())[0]


class Space:
    """Arrays by name that are used again step after step: fresh memory costs more than what is computed in it."""

    def __init__(self):
        self.kept: dict[str, np.ndarray] = {}

    def __call__(self, name: str, shape: tuple[int, ...], kind) -> np.ndarray:
        size, found = math.prod(shape), self.kept.get(name)
        if found is None or found.size < size or found.dtype != kind:
            found = self.kept[name] = np.empty(size, kind)
        return found[:size].reshape(shape)


def gates(grus: list[Gru]) -> list[np.ndarray]:
    """The networks' rows per byte (3, G, 257, H) and matrices (3, G, H, H), each gate's by itself: what a step works on is
    then contiguous, and all networks take a step in the same calls."""
    n = grus[0].u.shape[0]
    stacked = (np.stack([g.byte for g in grus]), np.stack([g.u for g in grus]))
    return [np.ascontiguousarray(p.reshape(len(grus), -1, 3, n).transpose(2, 0, 1, 3)) for p in stacked]


def forward(grus: list[Gru], x: np.ndarray, space: Space, keep: bool) -> tuple[np.ndarray, ...]:
    """x: (T, G, B), bytes for each network -> states (T + 1, G, B, H), the first zero; and, of all steps if these are to be
    kept, the gates update and reset (T, 2, G, B, H), the reset states and the candidates."""
    byte, u = gates(grus)
    _, many, size, n = byte.shape
    two, last, base = byte[:2].reshape(-1, n), byte[2].reshape(-1, n), size * np.arange(2 * many).reshape(2, many, 1)
    one, kind, steps = (many, x.shape[2], n), byte.dtype, len(x) if keep else 1
    states, zrs = space("states", (len(x) + 1, *one), kind), space("zr", (steps, 2, *one), kind)
    rhs, cs = space("rh", (steps, *one), kind), space("c", (steps, *one), kind)
    at, more = space("at", (2, many, x.shape[2]), np.intp), space("more", (2, *one), kind)
    states[0] = 0
    for t in range(len(x)):
        k = t if keep else 0
        h, zr, rh, c, new = states[t], zrs[k], rhs[k], cs[k], states[t + 1]
        np.add(x[t], base, out=at)
        two.take(at, axis=0, out=zr, mode="clip")
        zr += np.matmul(h, u[:2], out=more)
        sigmoid(zr)
        np.multiply(zr[1], h, out=rh)
        last.take(at[0], axis=0, out=c, mode="clip")
        c += np.matmul(rh, u[2], out=more[0])
        np.tanh(c, out=c)
        np.subtract(h, c, out=new)
        new *= zr[0]
        new += c
    return states, zrs, rhs, cs


def backward(grus: list[Gru], x: np.ndarray, kept: tuple[np.ndarray, ...], grad: np.ndarray, space: Space) -> list[Gru]:
    """Gradients by backpropagation through time; kept: of forward(); grad: (T, G, B, H), of the states."""
    _, u = gates(grus)
    states, zrs, rhs, cs = kept
    n, kind = u.shape[-1], grad.dtype
    back = np.ascontiguousarray(u.transpose(0, 1, 3, 2))
    # of every step, the gradients of the three gates
    d = space("d", (3, *grad.shape), kind)
    dh, stay, more = (space(x, grad.shape[1:], kind) for x in ("dh", "stay", "back"))
    dh[:] = 0
    for t in range(len(x) - 1, -1, -1):
        h, (z, r), c, (dz, dr, dc) = states[t], zrs[t], cs[t], d[:, t]
        dh += grad[t]
        np.multiply(dh, z, out=stay)
        np.multiply(c, c, out=dc)
        np.subtract(1, dc, out=dc)
        dc *= np.subtract(dh, stay, out=dh)
        np.subtract(h, c, out=dz)
        dz *= stay
        dz *= np.subtract(1, z, out=dh)
        drh = np.matmul(dc, back[2], out=more)
        drh *= r
        np.multiply(drh, h, out=dr)
        dr *= np.subtract(1, r, out=dh)
        np.add(stay, drh, out=dh)
        dh += np.matmul(dz, back[0], out=more)
        dh += np.matmul(dr, back[1], out=more)
    out = []
    for k, g in enumerate(grus):
        # sums over equal bytes by sorting them
        of = x[:, k].ravel()
        order = np.argsort(of, kind="stable")
        of = of[order]
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(of)), bool), of[1:] != of[:-1]]))
        gru, flat, turned = Gru(np.zeros_like(g.byte), np.zeros_like(g.u)), space("flat", (len(of), n), kind), space("turned", (n, len(of)), kind)
        for j in range(3):
            mine = slice(j * n, (j + 1) * n)
            gru.u[:, mine] = np.matmul((rhs if j == 2 else states[:-1])[:, k].transpose(0, 2, 1), d[j, :, k]).sum(0)
            if len(first):
                np.copyto(flat.reshape(*x[:, k].shape, n), d[j, :, k])
                turned[:] = flat.take(order, axis=0, out=space("sorted", flat.shape, kind), mode="clip").T
                gru.byte[of[first], mine] = np.add.reduceat(turned, first, axis=1).T
        out.append(gru)
    return out


@dataclass
class Model:
    langs: list[str]
    ahead: Gru
    behind: Gru
    w: np.ndarray
    b: np.ndarray

    def positions(self, x: np.ndarray, space: Space | None = None) -> np.ndarray:
        """x: (T, B) bytes, 256 where padded -> (T, B, L) probabilities of every byte's label."""
        space = space or Space()
        return self.labels(forward([self.ahead, self.behind], ways(x), space, False)[0], space)

    def labels(self, states: np.ndarray, space: Space) -> np.ndarray:
        """The probabilities of the labels by the states of both ways."""
        n, shape = states.shape[-1], (len(states) - 1, states.shape[2], len(self.b))
        out = np.matmul(states[1:, 0], self.w[:n], out=space("labels", shape, self.w.dtype))
        out += np.matmul(states[:0:-1, 1], self.w[n:], out=space("behind", shape, self.w.dtype))
        out += self.b
        return softmax(out)

    def pooled(self, told: list[bytes]) -> np.ndarray:
        """(texts, classes): the mean over its bytes of each text's probabilities."""
        sums = np.zeros((len(told), len(self.b)))
        flat, starts = join_bytes(told)
        count = -(-np.diff(starts) // WINDOW)  # windows of each text
        doc = np.repeat(np.arange(len(told)), count)
        begin = starts[doc] + WINDOW * (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count))
        space = Space()
        for i in range(0, len(doc), ROWS):
            d, at = doc[i : i + ROWS], begin[i : i + ROWS, None] + np.arange(WINDOW)
            there = at < starts[d + 1][:, None]
            x = np.where(there, flat[np.minimum(at, len(flat) - 1)], np.int16(256)).T
            p = self.positions(np.ascontiguousarray(x), space)
            p *= there.T[:, :, None]
            np.add.at(sums, d, p.sum(0))
        return np.clip(sums / np.maximum(np.diff(starts), 1)[:, None], 0, 1)

    def judge(self, texts: list[bytes | None]) -> tuple[list[str], list[float]]:
        """Language and its pooled probability of each text."""
        told = [t if t and has_letter(t) else b"" for t in texts]
        if not self.langs:
            return [UND] * len(texts), [0.0] * len(texts)
        shares = self.pooled(told)
        best = shares[:, : len(self.langs)].argmax(1)
        score = shares[np.arange(len(texts)), best]
        return [self.langs[b] if t else UND for b, t in zip(best, told, strict=True)], [float(s) if t else 0.0 for s, t in zip(score, told, strict=True)]


    def learned(self, texts: list[bytes | None]) -> np.ndarray:
        """The pooled probability of all learned languages together; 0 for what judge() leaves undetermined."""
        told = [t if t and has_letter(t) else b"" for t in texts]
        return self.pooled(told)[:, : len(self.langs)].sum(1) if self.langs else np.zeros(len(texts))


def ways(x: np.ndarray) -> np.ndarray:
    """x: (T, B) -> (T, 2, B), ahead and behind."""
    return np.stack([x, x[::-1]], axis=1)


def has_letter(text: bytes) -> bool:
    return bool(_LETTER.search(text.decode("utf-8", "replace")))


def softmax(x: np.ndarray) -> np.ndarray:
    # of few columns; numpy's reductions over a short last axis are slow
    most = x[..., 0].copy()
    for k in range(1, x.shape[-1]):
        np.maximum(most, x[..., k], out=most)
    x -= most[..., None]
    np.exp(x, out=x)
    x /= x @ np.ones((x.shape[-1], 1), x.dtype)
    return x


def strangers(n: int, seed: int = SEED) -> list[bytes]:
    """n texts in no language: words of letters drawn evenly from a few neighbours in any script, or from a to z."""
    rng, out = np.random.default_rng(seed), []
    while len(out) < n:
        if len(out) % 4:
            start, count = int(rng.integers(0x370, 0xD700)), int(rng.integers(20, 400))
            letters = [chr(c) for c in range(start, start + count) if c < 0xD800 and has_letter(chr(c).encode())]
        else:
            letters = list("abcdefghijklmnopqrstuvwxyz")
        if letters:
            out.append(" ".join("".join(rng.choice(letters, k)) for k in rng.integers(1, 11, 40)).encode())
    return out


def gradients(model: Model, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, space: Space | None = None) -> list[np.ndarray]:
    """Of the mean loss over x (T, B) bytes of texts with classes y, each with its weight: by all parameters, through time."""
    space, two, n = space or Space(), ways(x), model.ahead.u.shape[0]
    kept = forward([model.ahead, model.behind], two, space, True)
    states = kept[0]
    d = model.labels(states, space)
    d[:, np.arange(x.shape[1]), y] -= 1
    share = (x < 256) / x.size
    d *= (share if weight is None else share * weight)[:, :, None]
    grad = space("grad", (len(x), *states.shape[1:]), states.dtype)
    np.matmul(d, model.w[:n].T, out=grad[:, 0])
    np.matmul(d[::-1], model.w[n:].T, out=grad[:, 1])
    a, b = backward([model.ahead, model.behind], two, kept, grad, space)
    w = np.concatenate([np.matmul(h.transpose(0, 2, 1), d).sum(0) for h in (states[1:, 0], states[:0:-1, 1])])
    return [a.byte, a.u, b.byte, b.u, w, d.sum((0, 1))]


def train(rows: list[tuple[bytes, str]], hidden: int = HIDDEN, steps: int = STEPS, seed: int = SEED, others: list[bytes] | None = None) -> Model:
    """rows: (text, language). The order of rows doesn't matter. others: texts of a class more, which takes probability
    from the languages and is never told."""
    rng = np.random.default_rng(seed)
    rows = sorted((t, g) for t, g in rows if t and has_letter(t))
    langs = sorted({g for _, g in rows})
    size, by = 2 * hidden, [[t for t, x in rows if x == g] for g in langs] + ([others] if others and langs else [])
    model = Model(langs, Gru.new(hidden, rng), Gru.new(hidden, rng), np.zeros((size, len(by)), np.float32), np.zeros(len(by), np.float32))
    if len(by) < 2:
        return model
    xs, ys = [], []
    for k, texts in enumerate(by):  # equally many windows of each language, at places drawn at random
        for i in rng.integers(0, len(texts), WINDOWS // len(by)):
            t = texts[i]
            at = int(rng.integers(0, max(1, len(t) - WINDOW // 2)))
            part = np.frombuffer(t[at : at + WINDOW], np.uint8)
            xs.append(np.concatenate([part, np.full(WINDOW - len(part), 256)]))
            ys.append(k)
    xs, ys = np.array(xs), np.array(ys)
    params = [model.ahead.byte, model.ahead.u, model.behind.byte, model.behind.u, model.w, model.b]
    mean, square, space = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], Space()
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(xs), BATCH)
        x, y = np.ascontiguousarray(xs[pick].T), ys[pick]
        adam(params, gradients(model, x, y, space=space), mean, square, step, RATE * (1 - step / (steps + 1)) + 1e-3)
    return model


def adam(params: list, grads: list, mean: list, square: list, step: int, rate: float) -> None:
    for p, g, m, v in zip(params, grads, mean, square, strict=True):
        g = np.clip(g, -1, 1)
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All windows of texts, one a row, 256 where padded; and the text of each."""
    flat, starts = join_bytes(texts)
    count = -(-np.diff(starts) // WINDOW)
    doc = np.repeat(np.arange(len(texts)), count)
    at = (starts[doc] + WINDOW * (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)))[:, None] + np.arange(WINDOW)
    return np.where(at < starts[doc + 1][:, None], flat[np.minimum(at, max(len(flat) - 1, 0))], np.int16(256)) if len(doc) else np.zeros((0, WINDOW), np.int16), doc


def sample(docs: DataFrame, quota: int = QUOTA) -> list[tuple[bytes, str]]:
    """(text, lang) of at most quota documents per language, those of least hash. docs: doc_id, text, lang."""
    rows = docs.filter("text is not null and lang is not null and length(text) > 0").withColumn("_h", F.xxhash64(F.col("doc_id"), F.length("text"), F.crc32(F.col("text").cast("binary"))))
    # hashes under a threshold that lets through a few more of each language than asked for, then the least of these
    rank = F.pmod("_h", F.lit(1 << 40))
    share = F.least(F.lit(1.0), F.lit(1.2 * quota + 100) / F.col("count"))
    bound = rows.groupBy("lang").count().select("lang", (share * float(1 << 40)).cast("long").alias("_upto"))
    keys = written(rows.select("lang", "_h").join(F.broadcast(bound), "lang").filter(rank <= F.col("_upto")).select("lang", "_h").distinct(), "near")
    keys = keys.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy(rank, "_h"))).filter(F.col("_r") <= quota)
    least = written(keys.select("lang", "_h"), "least")
    return [(bytes(r[0]), r[1]) for r in rows.join(F.broadcast(least), ["lang", "_h"], "left_semi").select(F.col("text").cast("binary"), "lang").dropDuplicates(["text", "lang"]).collect()]  # quota rows a language


def fitted(docs: DataFrame, quota: int = QUOTA) -> Model:
    return train(sample(docs, quota))


def predictor(model: Model):
    """A mapInArrow function over (row..., text): appends lang_pred and score in place of the text, the last column."""

    def run(batches):
        for x in batches:
            lang, score = model.judge(text_column(x, x.schema.names[-1]))
            yield pa.RecordBatch.from_arrays([*x.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*x.schema.names[:-1], "lang_pred", "score"])

    return run


def learnable(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", "lang").filter(~in_bucket("doc_id", 4, 2))


def op5_language(spark, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fitted(learnable(docs))
    rows = docs.select("doc_id", in_bucket("doc_id", 4, 2).alias("held_out"), "text")
    return rows.mapInArrow(predictor(model), f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double")


def labelled(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("text").rlike(r"\p{L}") & F.col("lang").isNotNull())


def whole(docs: DataFrame, quota: int = QUOTA) -> tuple[Model, int]:
    """A model that also knows texts in no language, learned from every window of every text of docs (doc_id, text, lang)
    that has a letter and a label; and the number of these windows. Each language weighs the same."""
    prepare(docs.sparkSession)
    docs = labelled(docs)
    start, others = train(sample(docs, quota), others=strangers(STRANGERS)), strangers(STRANGERS)
    size, docs = F.octet_length("text"), docs.filter(F.col("lang").isin(start.langs))
    by = {r[0]: (r[1], r[2]) for r in docs.groupBy("lang").agg(F.sum(F.ceil(size / WINDOW)), F.sum(size)).collect()}  # a row per language
    if not by:
        return start, 0
    place = {g: k for k, g in enumerate(start.langs)}
    weight = np.array([sum(n for n, _ in by.values()) / (len(by) * by[g][0]) for g in start.langs], np.float32)
    sent = docs.sparkSession.sparkContext.broadcast(start)

    def run(batches):
        first = sent.value
        params = [p.copy() for p in (first.ahead.byte, first.ahead.u, first.behind.byte, first.behind.u, first.w, first.b)]
        mine = Model(first.langs, Gru(params[0], params[1]), Gru(params[2], params[3]), params[4], params[5])
        mean, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        rng, strange, step, seen, space = np.random.default_rng(SEED), windows(others)[0], 0, 0, Space()
        for x in batches:
            texts, langs = text_column(x), x.column(x.schema.get_field_index("lang")).to_pylist()
            for i in range(0, len(texts), TOGETHER):
                rows, doc = windows(texts[i : i + TOGETHER])
                y = np.array([place[g] for g in langs[i : i + TOGETHER]])[doc]
                order = rng.permutation(len(rows))
                seen += len(rows)
                for j in range(0, len(order), MIXED):
                    pick = order[j : j + MIXED]
                    more = rng.integers(0, len(strange), len(pick) // 8 + 1)
                    both = np.concatenate([rows[pick], strange[more]])
                    even = np.concatenate([weight[y[pick]], np.full(len(more), len(pick) / (len(place) * len(more)), np.float32)])
                    step += 1
                    adam(params, gradients(mine, np.ascontiguousarray(both.T), np.concatenate([y[pick], np.full(len(more), len(place))]), even, space), mean, square, step, FINE)
        value = np.concatenate([p.ravel() for p in params]).astype(float) * seen
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(value)), pa.int32()), pa.array(value, pa.float64()), pa.array(np.full(len(value), seen), pa.int64())], names=["at", "value", "seen"])

    # dealt and ordered by the rows alone, so that the model doesn't depend on how they lie
    parts, key = -(-sum(n for _, n in by.values()) // PART), F.xxhash64("text", "doc_id")
    rows = docs.select("doc_id", "text", "lang").repartition(int(parts), key).sortWithinPartitions(key, "text", "lang").mapInArrow(run, "at int, value double, seen long")
    got = np.array(rows.groupBy("at").agg(F.sum("value"), F.sum("seen")).orderBy("at").collect())  # a row per parameter
    new, i, out = got[:, 1] / got[:, 2], 0, []
    for p in (start.ahead.byte, start.ahead.u, start.behind.byte, start.behind.u, start.w, start.b):
        out.append(new[i : i + p.size].reshape(p.shape).astype(p.dtype))
        i += p.size
    return Model(start.langs, Gru(out[0], out[1]), Gru(out[2], out[3]), out[4], out[5]), int(got[0, 2])


def ranked(rows: DataFrame, score: str, k: int) -> float:
    """The k-th least score, from 0, exactly: by counts of ever smaller ranges."""
    rows = rows.select(F.col(score).alias("s"))
    low, high = rows.agg(F.min("s"), F.max("s")).first()
    while low < high:
        part = rows.filter(F.col("s").between(low, high))
        bucket = F.least(F.lit(SPLIT - 1), F.floor((F.col("s") - F.lit(low)) / F.lit(high - low) * SPLIT))
        found = sorted(tuple(r) for r in part.groupBy(bucket.alias("b")).agg(F.count("*"), F.min("s"), F.max("s")).collect())  # SPLIT rows
        for _, n, a, b in found:
            if k < n:
                break
            k -= n
        if n <= FEW or (a, b) == (low, high):
            return sorted(r[0] for r in rows.filter(F.col("s").between(a, b)).collect())[k]
        low, high = a, b
    return low


def guarded(docs: DataFrame, quota: int = QUOTA) -> DataFrame:
    """The rows of docs, all columns, whose score for the learned languages together is above 0 and not under a threshold:
    a tenth below the score that STAY of all learnable labelled texts reach."""
    model, _ = whole(learnable(docs), quota)
    rows = scored(docs, model)
    told = labelled(rows).filter(~in_bucket("doc_id", 4, 2))
    n = told.count()
    least = 0.9 * ranked(told, SCORE, int((n - 1) * (1 - STAY))) if n else 0.0
    return rows.filter((F.col(SCORE) > 0) & (F.col(SCORE) >= least)).drop(SCORE)


SCORE = "_learned"


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs and SCORE, the score of each text for the learned languages together."""

    def run(batches):
        for x in batches:
            yield pa.RecordBatch.from_arrays([*x.columns, pa.array(model.learned(text_column(x)), pa.float64())], names=[*x.schema.names, SCORE])

    prepare(docs.sparkSession)
    kind = T.StructType([*docs.schema.fields, T.StructField(SCORE, T.DoubleType())])
    return written(docs.mapInArrow(run, kind), "language")
