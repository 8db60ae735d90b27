"""Plumbing that the operators of this subpackage share."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch handed to a Python worker; bounds a worker's memory when texts are long.
ARROW_ROWS = 1000


def prepare(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share. A session on one machine that names none gets a temporary one; on
    a cluster that is an error."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/gridloom-{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


_MADE: list[str] = []


def made() -> list[str]:
    """The scratch tables made so far, the last one last."""
    return list(_MADE)


def release(spark: SparkSession, *keep: str) -> None:
    """Deletes the scratch tables made so far, but for those to keep. What still reads from them fails afterwards, so this is
    for whoever has written or collected the results."""
    for path in [p for p in _MADE if p not in keep]:
        delete(spark, path)


def written(df: DataFrame, name: str, partitions: int | None = None, lean: bool = False) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage, survives lost executors. Lean: for little disk, packed
    more closely, and the shuffles behind it are deleted once it is written."""
    spark = df.sparkSession
    path = scratch(spark, name)
    out = (df.coalesce(partitions) if partitions else df).write
    if lean:
        before = spark.conf.get(_CLEANUP)
        spark.conf.set(_CLEANUP, "true")
        try:
            out.option("compression", "zstd").parquet(path)
        finally:
            spark.conf.set(_CLEANUP, before)
    else:
        out.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    if path in _MADE:
        _MADE.remove(path)


def spare(spark: SparkSession) -> None:
    """Lets the driver find the shuffles that nothing refers to any more, so that executors delete their files now and not
    at some later collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_column(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding them."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def in_bucket(doc_id: str, mod: int, rest: int):
    """Whether crc32(id as text) mod `mod` is `rest`; the id's null counts as not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % mod == rest, F.lit(False))


def join_bytes(texts: list[bytes], end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes in one array, and where each begins (one more entry: the length)."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + len(end) for t in texts], out=starts[1:])
    return np.frombuffer(b"".join(t + end for t in texts) if end else b"".join(texts), np.uint8), starts


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, least node of its component) for every node but the least; vectorised min-label contraction."""
    if not len(a):
        return a, b
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = inverse[: len(a)], inverse[len(a) :]
    parent = np.arange(len(nodes))
    while True:
        pu, pv = parent[u], parent[v]
        differ = pu != pv
        if not differ.any():
            break
        u, v, pu, pv = u[differ], v[differ], pu[differ], pv[differ]
        np.minimum.at(parent, np.maximum(pu, pv), np.minimum(pu, pv))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    keep = parent != np.arange(len(nodes))
    return nodes[keep], nodes[parent[keep]]


EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])
EDGE_SQL = "a long, b long"


class Forest:
    """Gathers edges and keeps a spanning forest of at most as many edges as nodes."""

    def __init__(self, limit: int = 1 << 18):
        self.a: list[np.ndarray] = []
        self.b: list[np.ndarray] = []
        self.size, self.limit = 0, limit

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.a.append(a)
            self.b.append(b)
            self.size += len(a)
            if self.size > self.limit:
                self.shrink()
                self.limit = max(self.limit, 4 * self.size)

    def shrink(self) -> tuple[np.ndarray, np.ndarray]:
        none = np.zeros(0, np.int64)
        a, b = forest(np.concatenate([*self.a, none]), np.concatenate([*self.b, none]))
        self.a, self.b, self.size = [a], [b], len(a)
        return a, b


def _contract(batches):
    found = Forest()
    for x in batches:
        found.add(x.column(0).to_numpy(), x.column(1).to_numpy())
    a, b = found.shrink()
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=EDGE)


def components(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """edges (a, b) -> (node, component), component the least node reachable; nodes without edges are absent.

    Each round finds every node's least neighbour with a partially aggregated minimum, points the node and all its
    neighbours at it, and contracts each partition's edges to a spanning forest. Rounds grow with the logarithm of
    the longest path. All state is in written tables; nothing is collected.
    """
    now = written(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).mapInArrow(_contract, EDGE_SQL), name)
    for _ in range(rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), name)
        aimed = both.join(least, "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e")).select(F.col("e.a").alias("a"), F.col("e.m").alias("b"))
        now = written(aimed.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().mapInArrow(_contract, EDGE_SQL), name)
        # settled when no node has two targets and no target has a target of its own
        if now.groupBy("a").count().filter("count > 1").isEmpty() and now.join(now.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b"), F.col("b")).distinct())
