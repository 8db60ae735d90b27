"""Toxicity: cumulative-link ordinal regression on sparse text features.

P(grade >= k) = sigmoid(w.x - theta_k), one w for all ordered thresholds. x says which features a text has: its words
(digits, letters and non-ASCII characters, A-Z lower-cased) and their first four and five bytes, hashed to FEATURES
places. Of those, the ones seen in LEAST_DOCS training documents or more whose share differs between toxic and clean
ones by SIGMAS standard errors are fitted, by AdaGrad with an L2 penalty; so long clean texts gain no score. The
expected severity is the sum of P(grade >= k) over k.

The labels say toxic or not. Toxic training documents are graded 1 to 3 by terciles of how many markers they have
(fitted features seen in at least eight times the share of toxic documents that of clean ones); clean ones are 0. TRAIN_ROWS labelled documents at most are fitted, those of least hash; their features are found and counted where the
texts are, and the driver holds the places of the fitted ones only.

A null or empty text has no features and the intercept's severity; without labelled documents of
both classes nothing is learned and all severities are 0.
Null labels are no labels; several labels of one id count as its greatest. Whole texts are scored. Repeated rows get
equal results. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import prepare, text_column, written
from gridloom.llm.winnow import words

FEATURES, TRAIN_ROWS, LEAST_DOCS, SIGMAS, EPOCHS, BATCH, RATE, L2, SEED = 1 << 20, 10_000, 4, 5.0, 30, 64, 1.0, 1e-3, 5
CACHE = 1 << 17
#: Reject from this probability of grade 1 or more.
LEAST = 0.5


def features(word: bytes) -> list[int]:
    """The places of a word's features."""
    keys = [b"w" + word, b"4" + word[:4]] + ([b"5" + word[:5]] if len(word) > 4 else [])
    return [zlib.crc32(k) % FEATURES for k in keys]


class Found(dict):
    """Of a word, those of its features that weigh anything; forgets all when it has grown to CACHE words."""

    def __init__(self, kept: set[int]):
        super().__init__()
        self.kept = kept

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= CACHE:
            self.clear()
        self[word] = x = tuple(f for f in features(word) if f in self.kept)
        return x


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


@dataclass
class Model:
    w: dict[int, float]
    thresholds: np.ndarray

    def above(self, texts: list[bytes | None]) -> np.ndarray:
        """(texts, grades - 1): P(grade >= k) for k from 1."""
        found = Found(set(self.w))
        x = np.array([sum(self.w[f] for f in sorted({f for w in set(words(t)) for f in found[w]})) for t in texts], np.float64)
        return sigmoid(x[:, None] - self.thresholds[None])


def grades(toxic: np.ndarray, markers: np.ndarray) -> np.ndarray:
    """0 for clean rows, 1 to 3 for toxic ones by terciles of their number of markers."""
    out = toxic.astype(np.int64)
    for q in np.quantile(markers[toxic], [1 / 3, 2 / 3]):
        out += toxic & (markers > q)
    return np.unique(out, return_inverse=True)[1]


def places(text: bytes | None) -> np.ndarray:
    """The places of a text's features, each once."""
    return np.unique(np.array([f for x in set(words(text)) for f in features(x)], np.int32))


def telling(one, both, n1: int, n: int):
    """Whether features that `one` toxic and `both` training documents have are fitted, and whether they are markers; n1 of n
    documents are toxic."""
    share = both / n
    z = (one / n1 - (both - one) / (n - n1)) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n1 + 1 / (n - n1)))
    return (both >= LEAST_DOCS) & (np.abs(z) >= SIGMAS), one / n1 >= 8 * (both - one) / (n - n1)


def train(rows: list[tuple[bytes, int]], epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """rows: (text, toxic). The order of rows doesn't matter."""
    rows = sorted(rows)
    toxic = np.array([bool(y) for _, y in rows], bool)
    if toxic.all() or not toxic.any():
        return nothing()
    has = [places(t) for t, _ in rows]
    one, both = np.zeros(FEATURES, np.int64), np.zeros(FEATURES, np.int64)
    for h, t in zip(has, toxic.tolist(), strict=True):
        both[h] += 1
        one[h] += t
    fits, marks = telling(one, both, int(toxic.sum()), len(rows))
    kept = np.flatnonzero(fits)
    return fit([h[fits[h]] for h in has], toxic, kept, marks[kept], epochs, seed)


def nothing() -> Model:
    return Model({}, np.full(3, 60.0))


def fit(has: list[np.ndarray], toxic: np.ndarray, kept: np.ndarray, marks: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """has: of each document the places among `kept`, in order; marks: which of these are markers."""
    rng, n = np.random.default_rng(seed), len(has)
    sparse, marker = [np.searchsorted(kept, h) for h in has], marks.astype(np.int64)
    y = grades(toxic, np.array([int(marker[x].sum()) for x in sparse]))
    k = int(y.max())
    base = np.array([max(1, int((y >= j).sum())) / (len(y) + 1) for j in range(1, k + 1)])
    theta = np.maximum.accumulate(-np.log(base / (1 - base)) + 1e-3 * np.arange(k))
    gap, gap_steep = np.concatenate([theta[:1], np.log(np.maximum(1e-3, np.diff(theta)))]), np.ones(k)
    w, steep = np.zeros(len(kept)), np.ones(len(kept))
    for _ in range(epochs):
        order = rng.permutation(n)
        for i in range(0, n, BATCH):
            pick = order[i : i + BATCH]
            dw, dgap = steps(w, gap, [sparse[j] for j in pick], y[pick])
            dw = dw + L2 * w
            gap_steep += dgap * dgap
            gap -= 0.3 * dgap / np.sqrt(gap_steep)
            steep += dw * dw
            w -= RATE * dw / np.sqrt(steep)
    return Model(dict(zip(kept.tolist(), w.tolist(), strict=True)), thresholds(gap))


def thresholds(gap: np.ndarray) -> np.ndarray:
    """The ordered thresholds: the first one, and the logarithms of the gaps to the next."""
    return np.cumsum(np.concatenate([gap[:1], np.exp(gap[1:])]))


def steps(w: np.ndarray, gap: np.ndarray, sparse: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients, by the weights and the gaps, of the negative log likelihood of documents with grades y."""
    k = len(gap)
    flat, row = np.concatenate(sparse), np.repeat(np.arange(len(sparse)), [len(x) for x in sparse])
    eta, theta = np.bincount(row, w[flat], len(sparse)), thresholds(gap)
    edge = np.concatenate([[-60.0], theta, [60.0 + theta[-1]]])
    a, b = sigmoid(eta - edge[y]), sigmoid(eta - edge[y + 1])
    a, b = np.where(y == 0, 1.0, a), np.where(y == k, 0.0, b)
    p = np.maximum(a - b, 1e-9)
    dt = np.zeros(k + 2)
    np.add.at(dt, y, a * (1 - a) / p)
    np.add.at(dt, y + 1, -b * (1 - b) / p)
    dgap = np.cumsum(dt[1:-1][::-1])[::-1].copy()
    dgap[1:] *= np.exp(gap[1:])
    return np.bincount(flat, (a + b - 1)[row], len(w)), dgap


def fitted(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    # the rows of least hash: those under a threshold that lets through a few more than asked for, then the least of these
    n = known.count()
    share = min(1.0, 1.2 * train_rows / n + 200 / n) if n else 1.0
    rank = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    least = written(known.filter(rank <= int(share * (1 << 30))).orderBy(rank, "doc_id").limit(train_rows), "labelled")
    def found(batches):
        for x in batches:
            has = [places(t) for t in text_column(x)]
            yield pa.RecordBatch.from_arrays([pa.array(has, pa.list_(pa.int32())), x.column(1)], names=["has", "toxic"])

    prepare(docs.sparkSession)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter("text is not null").join(F.broadcast(least), "doc_id").select("text", "toxic")
    # equal texts with equal labels count once
    rows = written(texts.mapInArrow(found, "has array<int>, toxic int").withColumn("h", F.xxhash64("has", "toxic")).dropDuplicates(["h", "has", "toxic"]), "labelled-features")
    n, n1 = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < n1 < n:
        return nothing()
    counts = rows.select(F.explode("has").alias("f"), "toxic").groupBy("f").agg(F.sum("toxic").alias("one"), F.count("*").alias("both")).filter(F.col("both") >= LEAST_DOCS)
    f, one, both = (c.to_numpy() for c in counts.orderBy("f").toArrow().columns)  # FEATURES rows of numbers at most
    fits, marks = telling(one, both, n1, n)
    f, marks = f[fits], marks[fits]
    sent = docs.sparkSession.sparkContext.broadcast(f)

    def kept(batches):
        for x in batches:
            has = [np.array(h, np.int32)[np.isin(h, sent.value)] for h in x.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([h.tobytes() for h in has], pa.binary()), x.column(1), x.column(2)], names=["has", "toxic", "h"])

    few = rows.mapInArrow(kept, "has binary, toxic int, h long").orderBy("h", "has").toArrow()  # train_rows rows of fitted places
    return fit([np.frombuffer(h, np.int32) for h in few.column("has").to_pylist()], few.column("toxic").to_numpy() > 0, f, marks)


def scorer(model: Model):
    """A mapInArrow function over (doc_id, text): doc_id, severity, grade, p_toxic."""

    def run(batches):
        for x in batches:
            p = model.above(text_column(x))
            grade = (p >= 0.5).sum(1)
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(p.sum(1)), pa.array(grade, pa.int64()), pa.array(p[:, 0])], names=["doc_id", "severity", "grade", "p_toxic"])

    return run


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fitted(docs, labels)
    out = docs.select("doc_id", "text").mapInArrow(scorer(model), f"doc_id {dict(docs.dtypes)['doc_id']}, severity double, grade long, p_toxic double")
    return out.withColumn("toxic", F.col("p_toxic") >= LEAST)


def accepted(docs: DataFrame, model: Model, least: float = LEAST) -> DataFrame:
    """The rows of docs, all columns, whose probability of grade 1 or more is under `least`."""

    def run(batches):
        for x in batches:
            yield x.filter(pa.array(model.above(text_column(x))[:, 0] < least))

    prepare(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
