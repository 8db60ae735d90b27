"""Embedding near-duplicates: spherical k-means cells and blocked cosine products.

Unit vectors u, v with cosine >= t are at most d = sqrt(2 - 2t) apart. Where their nearest centroids a and c differ,
u and v stand on either side of the hyperplane midway between a and c, and the two distances to it add up to d at
most; so one of them is within d / 2 of it. Every vector is at home in the cell of its nearest centroid and visits all
cells whose hyperplane is within d / 2, so with `margin` at its default no link is lost.

Vectors without clusters can't be told apart by cells: of 51,282 random ones in 64 dimensions each visits 62 % of 29
cells, and still 26 % of 960, so finer cells compare fewer pairs but send every vector to more places. Cells and blocks
are coarse, as what is sent weighs more than products.

Equal vectors are one weighted vector from the start. A cell's home rows are dealt into blocks of about `block` rows;
home rows and visitors of the cell pass each block in batches, so a task holds one block and one batch however large
the cell. Tasks give link counts and a spanning forest, never pairs.

A vector that is null, zero, or holds a null or non-finite component links with nothing; so does one with a null id,
which stays a row with a null component. Shorter vectors count as padded with zeros. Rows with equal ids are vectors
of their own that share a component. k-means is fitted on TRAIN_ROWS distinct vectors at most, those of least hash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import Forest, components, prepare, written

THRESHOLD, TRAIN_ROWS, BLOCK, SEED = 0.9, 20_000, 8192, 7
#: Cells are the square root of the number of vectors by this.
COARSE = 16
_HIT = pa.schema([("rep", pa.int64()), ("other", pa.int64()), ("n", pa.int64())])


def unit(vector: list | None) -> bytes | None:
    """The vector at length one as double bytes; None where it links with nothing."""
    if not vector or any(x is None for x in vector):
        return None
    v = np.asarray(vector, np.float64)
    top = np.abs(v).max()
    if not np.isfinite(top) or top == 0:
        return None
    v = v / top
    return (v / math.sqrt(float(v @ v)) + 0.0).tobytes()


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    parts = [np.frombuffer(x, np.float64) for x in column.to_pylist()]
    out = np.zeros((len(parts), dim))
    for i, p in enumerate(parts):
        out[i, : len(p)] = p
    return out


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = SEED) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))]
    for _ in range(rounds):
        home = np.concatenate([(x[i : i + 4096] @ centres.T).argmax(1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        norm = np.linalg.norm(sums, axis=1)
        centres = np.where(norm[:, None] > 1e-12, sums / np.maximum(norm, 1e-12)[:, None], centres)
    return np.unique(centres, axis=0)


class Cells:
    def __init__(self, centres: np.ndarray, margin: float):
        self.centres, self.margin = centres, margin
        gap = np.linalg.norm(centres[:, None] - centres[None], axis=2) if len(centres) <= 512 else np.sqrt(np.maximum(0, 2 - 2 * centres @ centres.T))
        np.fill_diagonal(gap, np.inf)
        self.gap = np.maximum(gap, 1e-9)

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Home cells, and of every row and cell whether it visits; home is no visit."""
        near = x @ self.centres.T
        home = near.argmax(1)
        rows = np.arange(len(x))
        go = near[rows, home][:, None] - near <= self.margin * self.gap[home] + 1e-12
        go[rows, home] = False
        return home, go


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, margin: float | None = None, block: int = BLOCK, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of vectors."""
    spark = vectors.sparkSession
    prepare(spark)

    def units(batches):
        for x in batches:
            u = [None if i is None else unit(v) for i, v in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(u, pa.binary())], names=["vec_id", "unit"])

    rows = written(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).mapInArrow(units, "vec_id long, unit binary"), "units")
    reps = written(rows.filter("unit is not null").groupBy("unit").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "distinct")
    # several distinct vectors may share an id; mark tells them apart
    reps = written(reps.withColumn("mark", F.monotonically_increasing_id()), "marked")
    count, longest = reps.agg(F.count("*"), F.max(F.length("unit"))).first()
    dim = int(longest or 8) // 8
    sample = [bytes(r[0]) for r in reps.select("unit").orderBy(F.xxhash64("unit"), "unit").limit(train_rows).collect()]
    k = max(1, math.ceil(math.sqrt(count) / COARSE))
    centres = spherical_kmeans(matrix(pa.array(sample, pa.binary()), dim), k) if sample else np.ones((1, dim))
    margin = math.sqrt(max(0.0, 2 - 2 * threshold)) / 2 if margin is None else margin
    sent = spark.sparkContext.broadcast(Cells(centres, margin))

    def deal(batches):
        for x in batches:
            home, go = sent.value.visits(matrix(x.column(0), dim))
            who, cell = np.nonzero(go)
            at = np.concatenate([np.arange(len(home)), who])
            part = x.take(pa.array(at))
            cells = np.concatenate([home, cell])
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cells, pa.int32()), pa.array(np.concatenate([home, home[who]]), pa.int32())], names=[*x.schema.names, "cell", "home"])

    dealt = written(reps.select("unit", "rep", "n", "mark").mapInArrow(deal, "unit binary, rep long, n long, mark long, cell int, home int"), "cells")
    sizes = {r["cell"]: r["count"] for r in dealt.filter("cell = home").groupBy("cell").count().collect()}  # a row per centroid
    parts = F.element_at(F.create_map(*[F.lit(y) for c, m in sorted(sizes.items()) for y in (c, -(-m // block))] or [F.lit(0), F.lit(1)]), F.col("cell"))
    dealt = dealt.withColumn("parts", F.coalesce(parts, F.lit(0)))
    stored = dealt.filter("cell = home").withColumn("block", F.pmod(F.xxhash64("mark"), F.col("parts")).cast("int")).withColumn("role", F.lit(0))
    asking = dealt.filter("parts > 0").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("role", F.lit(1))
    meet = stored.unionByName(asking).drop("parts").repartition("cell", "block").sortWithinPartitions("cell", "block", "role")

    def compare(batches):
        cells, key, base, found = sent.value, None, None, Forest()

        def close():
            if base is not None and base["got"].any():
                hit = base["got"] > 0
                return pa.RecordBatch.from_arrays([pa.array(base["mark"][hit]), pa.nulls(int(hit.sum()), pa.int64()), pa.array(base["got"][hit])], schema=_HIT)
            return None

        for x in batches:
            c = {f: x.column(i) for i, f in enumerate(x.schema.names)}
            cell, blk, role = (c[f].to_numpy() for f in ("cell", "block", "role"))
            cut = np.flatnonzero((np.diff(cell) != 0) | (np.diff(blk) != 0) | (np.diff(role) != 0)) + 1
            for i, j in zip([0, *cut.tolist()], [*cut.tolist(), len(cell)], strict=True):
                if i == j:
                    continue
                v = matrix(c["unit"].slice(i, j - i), dim)
                mark, rep, n, home = (c[f].slice(i, j - i).to_numpy() for f in ("mark", "rep", "n", "home"))
                if role[i] == 0:
                    if key != (cell[i], blk[i]):
                        if (y := close()) is not None:
                            yield y
                        key, base = (cell[i], blk[i]), {"v": v, "mark": mark, "rep": rep, "n": n}
                    else:
                        base = {f: np.concatenate([base[f], y]) for f, y in (("v", v), ("mark", mark), ("rep", rep), ("n", n))}
                    base["got"], base["go"] = np.zeros(len(base["n"]), np.int64), None
                    continue
                if key != (cell[i], blk[i]):
                    continue  # a block without home rows
                if base["go"] is None:
                    base["go"] = cells.visits(base["v"])[1]
                near = v @ base["v"].T >= threshold
                near &= mark[:, None] != base["mark"][None]
                away = home != cell[i]
                # a link that both cells see counts in the one of lower number
                if away.any():
                    near[away] &= ~(base["go"][:, home[away]].T & (home[away] < cell[i])[:, None])
                got = near @ base["n"]
                base["got"] += n[away] @ near[away].astype(np.int64) if away.any() else 0
                a, b = np.nonzero(near)
                found.add(rep[a], base["rep"][b])
                hit = got > 0
                if hit.any():
                    yield pa.RecordBatch.from_arrays([pa.array(mark[hit]), pa.nulls(int(hit.sum()), pa.int64()), pa.array(got[hit])], schema=_HIT)
        if (y := close()) is not None:
            yield y
        a, b = found.shrink()
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.zeros(len(a), np.int64))], schema=_HIT)

    hits = written(meet.mapInArrow(compare, "rep long, other long, n long"), "links")
    linked = hits.filter("other is null").groupBy(F.col("rep").alias("mark")).agg(F.sum("n").alias("linked"))
    found = components(hits.filter("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    known = written(
        reps.join(linked, "mark", "left").join(found, F.col("rep") == F.col("node"), "left").select("unit", F.coalesce("component", "rep").alias("component"), (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("links")),
        "known",
    )
    component = F.coalesce("component", "vec_id")
    return rows.join(known, "unit", "left").select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op4_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: DuckDB: every pair, in double precision.
OP4_SQL = """
with recursive
e as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings),
u as (select vec_id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) as v from e),
p as (select a.vec_id as a, b.vec_id as b from u a, u b where a.vec_id <> b.vec_id and list_inner_product(a.v, b.v) >= 0.9),
reach as (select vec_id as a, vec_id as b from e union select r.a, p.b from reach r join p on r.b = p.a),
c as (select a, min(b) as component_id from reach group by a),
n as (select a, count(*) as n from p group by a)
select e.vec_id, coalesce(n.n, 0) as n_links, c.component_id, e.vec_id = c.component_id as kept
from e join c on e.vec_id = c.a left join n on e.vec_id = n.a
"""
