"""SimHash near-duplicate detection with a Gray-order hierarchical index.

A fingerprint has 64 bits, each the majority over the XXH64 hashes (seed 42) of a text's word shingles. Fingerprints
within `radius` differing bits are linked. A pair within 3 bits agrees on one of four 16-bit blocks, and within the
other 48 bits on one of four 12-bit blocks, so each distinct fingerprint is dealt under 16 keys of 28 bits and no link
is lost. Within a key's rows a tree is built: codes are sorted by Gray rank, so neighbours share long bit patterns;
each node holds the bits that all codes below it share and that no node above holds; a query descends from the root,
adding up differing bits, and whole subtrees go once the sum passes the radius. A task gives a spanning forest of its
links, never all pairs. Rows come sorted by key and are indexed in pieces of about ROWS rows, so a task holds its
largest group at most, not its whole partition.

Nulls and texts without words get fingerprint zero and are linked like any other; a null id stays a row of its own
with a null component. Repeated ids are one document for linking. Columns other than id and text are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import EDGE, EDGE_SQL, Forest, components, prepare, text_column, written

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SEED = 42
FAN = 8
#: Node visits worked on at a time; bounds a task's memory whatever the group.
FRONTIER = 1 << 18


def shingle_hashes(text: bytes | None, size: int) -> np.ndarray:
    """XXH64 of each run of `size` words, repeats included; of the whole where there are fewer."""
    words = text.translate(LOWER).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < size:
        return np.array([h(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return np.array([h(joined[i:j], SEED) for i, j in zip(starts.tolist(), ends[size - 1 :].tolist(), strict=False)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(doc_id, fp): every document's 64-bit fingerprint as a long."""

    def run(batches):
        for x in batches:
            out = [majority(shingle_hashes(t, size)) for t in text_column(x)]
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(out, pa.int64())], names=["doc_id", "fp"])

    prepare(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """The trees over the groups of equal key, level by level; level 0 holds the codes."""

    def __init__(self, keys: np.ndarray, codes: np.ndarray):
        self.order = np.lexsort((gray_rank(codes), keys))
        group = keys[self.order]
        code = codes[self.order]
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        self.pattern, self.mask = [code], [np.full(len(code), full)]
        self.first: list[np.ndarray] = []  # of each node above level 0, its first child; one more entry ends the last
        self.last_code = [np.arange(len(code))]
        while len(group) and (group[1:] == group[:-1]).any():
            new = np.concatenate([[True], group[1:] != group[:-1]])
            start = np.maximum.accumulate(np.where(new, np.arange(len(group)), 0))
            first = np.flatnonzero((np.arange(len(group)) - start) % FAN == 0)
            pattern, mask = self.pattern[-1], self.mask[-1]
            lead = np.repeat(pattern[first], np.diff(np.append(first, len(group))))
            shared = np.bitwise_and.reduceat(mask & ~(pattern ^ lead), first)
            self.first.append(np.append(first, len(group)))
            self.last_code.append(self.last_code[-1][self.first[-1][1:] - 1])
            self.pattern.append(pattern[first])
            self.mask.append(shared)
            group = group[first]
        for k in range(len(self.first)):  # what a node above holds goes from the nodes below it
            self.mask[k] = self.mask[k] & ~np.repeat(self.mask[k + 1], np.diff(self.first[k]))
        root = np.arange(len(group))
        for first in reversed(self.first):
            root = np.repeat(root, np.diff(first))
        self.root = root

    def pairs(self, radius: int):
        """Yields (i, j), positions in the order given, of codes of one key within the radius, i before j in Gray order."""
        top, code, n = len(self.first), self.pattern[0], len(self.root)
        work = [(top, np.arange(i, min(n, i + FRONTIER)), self.root[i : i + FRONTIER], np.zeros(min(n, i + FRONTIER) - i, np.int64)) for i in range(0, n, FRONTIER)]
        while work:
            level, query, node, far = work.pop()
            far = far + np.bitwise_count((code[query] ^ self.pattern[level][node]) & self.mask[level][node])
            keep = (far <= radius) & (self.last_code[level][node] > query)
            query, node, far = query[keep], node[keep], far[keep]
            if not level:
                yield self.order[query], self.order[node]
                continue
            first = self.first[level - 1]
            count = first[node + 1] - first[node]
            to = np.cumsum(count)
            step = max(1, FRONTIER // FAN)
            for i in range(0, len(query), step):
                part = slice(i, i + step)
                c = count[part]
                begin = np.repeat(first[node[part]] - (to[part] - c), c) + np.arange(to[part][0] - c[0], to[part][-1]) if len(c) else None
                work.append((level - 1, np.repeat(query[part], c), begin, np.repeat(far[part], c)))


def _keys():
    """Of fp, the 16 keys: table, 16-bit block and 12-bit block of the rest."""
    fp, out = F.col("fp"), []
    for i in range(4):
        block = F.shiftrightunsigned(fp, 16 * i).bitwiseAND(0xFFFF)
        low = fp.bitwiseAND((1 << 16 * i) - 1) if i else F.lit(0).cast("long")
        rest = F.shiftleft(F.shiftrightunsigned(fp, 16 * (i + 1)), 16 * i).bitwiseOR(low) if i < 3 else low
        for j in range(4):
            out.append(F.shiftleft(F.lit(4 * i + j).cast("long"), 28).bitwiseOR(F.shiftleft(block, 12)).bitwiseOR(F.shiftrightunsigned(rest, 12 * j).bitwiseAND(0xFFF)))
    return F.array(*out)


#: Rows of whole groups that a task indexes at a time.
ROWS = 1 << 19


def groups_of(batches, rows: int = ROWS):
    """Arrays of the columns of batches sorted by the first, in pieces of about `rows` rows that hold whole groups of it."""
    held, n = [], 0
    for x in batches:
        parts = tuple(c.to_numpy() for c in x.columns)
        cut = np.flatnonzero(parts[0][1:] != parts[0][:-1]) + 1
        if n > rows:
            # what is held ends where the next group begins: at this batch's start, or at its first change
            at = 0 if parts[0][0] != held[-1][0][-1] else int(cut[0]) if len(cut) else None
            if at is not None:
                held.append(tuple(c[:at] for c in parts))
                yield [np.concatenate(c) for c in zip(*held, strict=True)]
                held, n, parts = [], 0, tuple(c[at:] for c in parts)
        held.append(parts)
        n += len(parts[0])
    if n:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def links(reps: DataFrame, radius: int = 3) -> DataFrame:
    """reps (fp, rep), fp distinct -> edges (a, b) of reps that span what is linked within the radius, 3 at most."""
    if not 0 <= radius <= 3:
        raise ValueError("the 16 keys hold for a radius of 0 to 3")

    def run(batches):
        found = Forest()
        for key, fp, rep in groups_of(batches):
            _, where, times = np.unique(key, return_inverse=True, return_counts=True)
            keep = times[where] > 1
            key, fp, rep = key[keep], fp[keep].view(np.uint64), rep[keep]
            if len(key):
                for i, j in GrayIndex(key, fp).pairs(radius):
                    found.add(rep[i], rep[j])
        a, b = found.shrink()
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=EDGE)

    return reps.select(F.explode(_keys()).alias("key"), "fp", "rep").repartition("key").sortWithinPartitions("key").mapInArrow(run, EDGE_SQL)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the least id reachable over links, the document's own included."""
    prints = written(fingerprints(docs, id_col, text_col, size), "fingerprints")
    reps = written(prints.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "reps")
    found = components(links(reps, radius))
    classes = written(reps.join(found, reps.rep == found.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id")), "classes")
    joined = prints.join(classes, "fp", "left")
    return joined.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# Near copies by shingle similarity: SimHash and then the rarest shingles find candidates, the Jaccard similarity of the
# shingle sets decides.

FAMILIES, SHINGLE, SIMILARITY = 4, 5, 0.8
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def families(text: bytes | None, n: int = FAMILIES) -> list[int]:
    """n fingerprints over the text's distinct words, each by another mix of their hashes. A near copy by five-word
    shingles changes few of its words, so these differ less than one over shingles would."""
    h = np.unique(shingle_hashes(text, 1))
    out = []
    for i in range(n):
        x = h * (_M1 + np.uint64(2 * i))
        x ^= x >> np.uint64(29)
        x *= _M2
        out.append(majority(x ^ (x >> np.uint64(32))))
    return out


def shingle_set(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Distinct shingles as sorted 32-bit hashes."""
    return np.unique(shingle_hashes(text, size).astype(np.uint32))


def _sketch(batches):
    for x in batches:
        texts = [b" ".join(t.translate(LOWER).split()) if t else b"" for t in text_column(x)]
        yield pa.RecordBatch.from_arrays(
            [x.column(0), pa.array([xxhash.xxh3_128_digest(t) for t in texts], pa.binary()), pa.array([families(t) for t in texts], pa.list_(pa.int64()))], names=["doc_id", "digest", "fps"]
        )


def nearest(reps: DataFrame, radius: int = 3) -> DataFrame:
    """reps (family, fp, rep), fp distinct in a family -> (family, a, d, b): for every a of a key's rows, the nearest b of
    lower id within the radius, least id on ties. Several keys may give rows for one a."""

    def run(batches):
        parts = [tuple(c.to_numpy() for c in x.columns) for x in batches]
        if not parts:
            return
        key, family, fp, rep = (np.concatenate(c) for c in zip(*parts, strict=True))
        _, where, times = np.unique(key, return_inverse=True, return_counts=True)
        keep = times[where] > 1
        key, family, fp, rep = key[keep], family[keep], fp[keep].view(np.uint64), rep[keep]
        if not len(key):
            return
        rank = np.argsort(np.argsort(rep, kind="stable"), kind="stable").astype(np.int64)
        by_rank = np.empty(len(rep), np.int64)
        by_rank[rank] = np.arange(len(rep))
        best = np.full(len(rep), np.iinfo(np.int64).max)  # distance, then the partner's rank
        for i, j in GrayIndex(key, fp).pairs(radius):
            i, j = np.where(rep[i] > rep[j], i, j), np.where(rep[i] > rep[j], j, i)
            np.minimum.at(best, i, np.bitwise_count(fp[i] ^ fp[j]).astype(np.int64) << 40 | rank[j])
        a = np.flatnonzero(best != np.iinfo(np.int64).max)
        b = by_rank[best[a] & ((1 << 40) - 1)]
        yield pa.RecordBatch.from_arrays([pa.array(family[a]), pa.array(rep[a]), pa.array(best[a] >> 40), pa.array(rep[b])], names=["family", "a", "d", "b"])

    keys = F.transform(_keys(), lambda k: k + F.shiftleft(F.col("family").cast("long"), 40))
    return reps.select(F.explode(keys).alias("key"), "family", "fp", "rep").repartition("key").mapInArrow(run, "family int, a long, d long, b long")


#: Shingles held by a task before it gives out those that it met often; at most so many frequent ones go to all workers.
FLUSH, FREQUENT, OFTEN = 1 << 22, 1 << 18, 3
#: Rows of one shingle that are compared in one cell; pairs worked on at a time; ids that may go to all workers.
CELL, PAIRS, SMALL = 1 << 11, 1 << 20, 1 << 16


def word_runs(text: bytes | None, size: int) -> np.ndarray:
    """Distinct runs of `size` words (the whole where there are fewer), as sorted 64-bit hashes mixed from the words'."""
    words = text.translate(LOWER).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))
    size = min(size, len(words))
    out = np.zeros(len(words) - size + 1, np.uint64)
    for i in range(size):
        out ^= h[i : i + len(out)]
        out *= _M1
        out ^= out >> np.uint64(29)
        out *= _M2
        out ^= out >> np.uint64(32)
    return np.unique(out)


def prefix_size(n: int, similarity: float) -> int:
    """Of sets of n, how many members in a common order must be looked at to meet every set of the similarity."""
    return n - max(1, math.ceil(similarity * n - 1e-9)) + 1


def _distinct_texts(batches):
    """(doc_id, text) of a task's rows, texts equal but for case and blanks once."""
    seen = set()
    for x in batches:
        for d, t in zip(x.column(0).to_pylist(), text_column(x), strict=True):
            digest = xxhash.xxh3_128_digest(b" ".join(t.translate(LOWER).split()) if t else b"")
            if digest not in seen:
                seen.add(digest)
                yield d, t


def frequent(docs: DataFrame, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that tasks met in many texts, sorted, and how many. They only order the shingles, rare ones first: any
    order finds all pairs, so missing ones cost time, not links."""

    def run(batches):
        held, n = [], 0

        def out():
            key, times = np.unique(np.concatenate(held), return_counts=True)
            many = times >= OFTEN
            return pa.RecordBatch.from_arrays([pa.array(key[many].view(np.int64)), pa.array(times[many].astype(np.int64))], names=["key", "n"])

        for _, t in _distinct_texts(batches):
            held.append(word_runs(t, size))
            n += len(held[-1])
            if n > FLUSH:
                yield out()
                held, n = [], 0
        if held:
            yield out()

    met = written(docs.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "frequent")
    least, total = 1 << 62, 0
    for level, m in sorted(((r[0], r[1]) for r in met.groupBy(F.floor(F.log2("n")).alias("level")).count().collect()), reverse=True):
        if (total := total + m) > FREQUENT:
            break
        least = 1 << level
    rows = met.filter(F.col("n") >= least).toArrow()  # FREQUENT rows at most
    key, n = rows.column("key").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    order = np.argsort(key)
    return key[order], n[order]


def shared_prefixes(docs: DataFrame, similarity: float = SIMILARITY, size: int = SHINGLE) -> DataFrame:
    """(key, id, n, at): of every text the rarest shingles, as many as must be met by any text of the similarity, with the
    number of its shingles and the place in its order; only shingles that several rows have."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent(docs, size))

    def prefix(batches):
        keys, times = sent.value
        held, rows = [], 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names=["key", "id", "place"])

        for d, t in _distinct_texts(batches):
            h = word_runs(t, size)
            if not len(h):
                continue
            if len(keys):
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                h = h[np.lexsort((h, np.where(keys[at] == h, times[at], 0)))]
            k = prefix_size(len(h), similarity)
            held.append((h[:k].view(np.int64), np.full(k, d, np.int64), np.int64(len(h)) << 32 | np.arange(k)))
            rows += k
            if rows > 1 << 16:
                yield out()
                held, rows = [], 0
        if held:
            yield out()

    def several(batches):
        parts = [tuple(c.to_numpy() for c in x.columns) for x in batches]
        if not parts:
            return
        key, node, place = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        keep = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
        for i in range(0, len(keep), 1 << 16):
            k = keep[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(key[k]), pa.array(node[k]), pa.array(place[k] >> 32), pa.array(place[k] & 0xFFFFFFFF)], names=["key", "id", "n", "at"])

    rows = docs.mapInArrow(prefix, "key long, id long, place long").repartition("key")
    return written(rows.mapInArrow(several, "key long, id long, n long, at long"), "prefixes")


def may_reach(n, m, at, to, least, similarity: float):
    """Whether sets of n and m, whose first common member has these places, may have the similarity; least: minimum."""
    return least(n - at, m - to) >= similarity / (1 + similarity) * (n + m) - 1e-6


def across(shared: DataFrame, found: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """shared (key, id, n, at), found (node, component) -> (a, b): every pair that shares a shingle, may have the similarity
    and isn't in one component. Shingles of many rows are dealt in cells of pairs of groups."""
    rows = shared.join(found, shared.id == found.node, "left").select("key", "id", "n", "at", F.coalesce("component", "id").alias("comp"))
    rows = written(rows, "placed")
    open_keys = rows.groupBy("key").agg(F.min("comp").alias("p"), F.max("comp").alias("q"), F.count("*").alias("rows")).filter("p <> q").select("key", F.ceil(F.col("rows") / CELL).cast("int").alias("parts"))
    dealt = rows.join(open_keys, "key").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least("part", o).alias("x"), F.greatest("part", o).alias("y")))
    dealt = dealt.withColumn("cell", F.explode(cells)).select("key", F.col("cell.x").alias("x"), F.col("cell.y").alias("y"), "part", "id", "n", "at", "comp")

    def run(batches):
        parts = [tuple(c.to_numpy() for c in b.columns) for b in batches]
        if not parts:
            return
        key, x, y, part, node, n, at, comp = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((n, y, x, key))
        key, x, y, part, node, n, at, comp = (c[order] for c in (key, x, y, part, node, n, at, comp))
        ends = np.append(np.flatnonzero((key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1, len(key))
        end = np.repeat(ends, np.diff(np.concatenate([[0], ends])))
        # rows of a cell go by size, so a row's partners are those after it up to the size that the similarity allows
        span = end - np.arange(len(key)) - 1
        to = np.cumsum(span)
        i = 0
        while i < len(key):
            j = max(i + 1, int(np.searchsorted(to, (to[i - 1] if i else 0) + PAIRS, "right")))
            c = span[i:j]
            p = np.repeat(np.arange(i, j), c)
            q = p + 1 + np.arange(len(p)) - np.repeat(np.cumsum(c) - c, c)
            ok = (comp[p] != comp[q]) & (n[p] >= similarity * n[q] - 1e-6) & ((x[p] == y[p]) | (part[p] != part[q]))
            p, q = p[ok], q[ok]
            ok = may_reach(n[p], n[q], at[p], at[q], np.minimum, similarity)
            p, q = p[ok], q[ok]
            ab = np.unique(np.stack([np.maximum(node[p], node[q]), np.minimum(node[p], node[q])], 1), axis=0)
            if len(ab):
                yield pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], schema=EDGE)
            i = j

    return dealt.repartition("key", "x", "y").mapInArrow(run, EDGE_SQL).filter("a <> b").distinct()


def verified(docs: DataFrame, edges: DataFrame, similarity: float = SIMILARITY, size: int = SHINGLE) -> DataFrame:
    """The edges (a, b) whose shingle sets have the Jaccard similarity."""
    nodes = edges.select("a").union(edges.select("b")).distinct().withColumnRenamed("a", "doc_id")
    nodes = written(nodes, "nodes")

    def sets(batches):
        for x in batches:
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array([shingle_set(t, size).tobytes() for t in text_column(x)], pa.binary())], names=["id", "shingles"])

    few = nodes.count() <= SMALL
    has = written(docs.join(F.broadcast(nodes) if few else nodes, "doc_id", "left_semi").mapInArrow(sets, "id long, shingles binary").dropDuplicates(["id"]), "sets")

    def verify(batches):
        for x in batches:
            good = []
            for p, q in zip(x.column(2).to_pylist(), x.column(3).to_pylist(), strict=True):
                p, q = np.frombuffer(p, np.uint32), np.frombuffer(q, np.uint32)
                both = len(np.intersect1d(p, q, assume_unique=True))
                good.append(both >= similarity * (len(p) + len(q) - both))
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([x.column(0).filter(mask), x.column(1).filter(mask)], schema=EDGE)

    pairs = edges.join(has.select(F.col("id").alias("a"), F.col("shingles").alias("p")), "a").join(has.select(F.col("id").alias("b"), F.col("shingles").alias("q")), "b")
    return written(pairs.select("a", "b", "p", "q").mapInArrow(verify, EDGE_SQL), "verified")


def copies(docs: DataFrame, radius: int = 3, similarity: float = SIMILARITY, size: int = SHINGLE) -> DataFrame:
    """(doc_id, component_id) of all documents that aren't the least id of their group. docs: doc_id (not null), text.

    Equal texts (case and blanks aside) are one. Of the others, each takes per family the nearest fingerprint of lower id
    as a candidate, and of each of its rarest shingles the least id; links whose shingle sets have a Jaccard similarity
    under `similarity` go. Then all pairs that share a rare shingle and aren't in one group yet are compared, so no link
    between groups is lost.
    """
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketch = written(docs.mapInArrow(_sketch, "doc_id long, digest binary, fps array<long>"), "sketches")
    first = written(sketch.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("fps").alias("fps")), "texts")
    same = sketch.join(first.select("digest", "rep"), "digest").filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    same = written(same, "same")
    prints = written(first.select("rep", F.posexplode("fps").alias("family", "fp")), "prints")
    heads = written(prints.groupBy("family", "fp").agg(F.min("rep").alias("rep")), "heads")
    equal = prints.join(heads.withColumnRenamed("rep", "head"), ["family", "fp"]).filter("rep <> head").select(F.col("rep").alias("a"), F.col("head").alias("b"))
    near = nearest(heads, radius).groupBy("family", "a").agg(F.min(F.struct("d", "b")).alias("x")).select("a", F.col("x.b").alias("b"))
    shared = shared_prefixes(docs, similarity, size)
    least = shared.groupBy("key").agg(F.min(F.struct("id", "n", "at")).alias("h"))
    star = shared.join(least, "key").filter("id <> h.id").filter(may_reach(F.col("n"), F.col("h.n"), F.col("at"), F.col("h.at"), F.least, similarity))
    edges = written(equal.union(near).union(star.select("id", "h.id")).distinct(), "candidates")
    held = verified(docs, edges, similarity, size)
    found = written(components(held.union(same)), "found")
    more = written(across(shared, found, similarity), "across").join(edges, ["a", "b"], "left_anti")
    found = components(held.union(same).union(verified(docs, written(more, "open"), similarity, size)))
    return written(found.filter("node <> component").select(F.col("node").alias("doc_id"), F.col("component").alias("component_id")), "copies")


def distinct_documents(docs: DataFrame, **kw) -> DataFrame:
    """The rows of docs, all columns, less near copies: of each group the one of least doc_id stays, in one row. Rows with a
    null id stay as they are."""
    ids = docs.filter("doc_id is not null")
    gone = copies(ids, **kw).select("doc_id").distinct()
    if not ids.groupBy("doc_id").count().filter("count > 1").isEmpty():
        ids = ids.dropDuplicates(["doc_id"])
    return ids.join(gone, "doc_id", "left_anti").select(*docs.columns).union(docs.filter("doc_id is null"))
