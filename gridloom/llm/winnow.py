"""Benchmark decontamination by winnowing.

Both sides keep, of every window of span - k + 1 consecutive k-gram hashes, the least one (rightmost on ties), so any
`span` consecutive words that a document shares with an item share a kept hash at the same place. Kept hashes are
joined; each match is extended to the windows of `span` words around it that the item has anywhere, compared word by
word, and the runs of words in them are hits. So work goes with the matches, not with how often a passage is repeated
in an item. An item of fewer words than `span` is one window of its own length and is found by the hash of that many
words.

The benchmark side of the join is sent to the workers in blocks of at most BLOCK_BYTES of text, and the documents pass
them one after another within one stage, so neither side is shuffled and a benchmark of any size is done in whole.

Null and empty texts have no words. An item with a null id marks words as hit but isn't named. Repeated rows are each
judged; items with equal ids count once. Columns other than id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import prepare, text_column

SPAN, K = 10, 6
BLOCK_BYTES = 8 << 20
CACHE = 1 << 18
HITS = "array<struct<item_id:string,start:long,end:long>>"

_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    """Runs of digits, letters and non-ASCII characters, A-Z lower-cased."""
    return text.translate(_WORD).split() if text else []


class WordHash(dict):
    """XXH64 by word; forgets all when it has grown to CACHE words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A mixed hash of every k consecutive word hashes."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + n]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def winnowed(grams: np.ndarray, width: int) -> np.ndarray:
    """Positions kept: of each `width` consecutive hashes the least, the rightmost on ties."""
    n = len(grams) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least, where = grams[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, width):
        here = grams[j : j + n]
        lower = here <= least
        least[lower] = here[lower]
        where[lower] = j
    return np.unique(where + np.arange(n))


class Items:
    """A block of the benchmark: of every item its windows, and which items hold a kept hash."""

    def __init__(self, rows: list[tuple[str | None, bytes | None]], span: int = SPAN, k: int = K):
        self.span, self.k = span, min(k, span)
        self.ids = [r[0] for r in rows]
        hashes, held = WordHash(), {}
        self.windows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # of an item: hashes of its windows, in order, where each begins, its words' hashes
        for i, (_, text) in enumerate(rows):
            w = words(text)
            h = np.fromiter(map(hashes.__getitem__, w), np.uint64, len(w))
            m = min(len(w), span)
            grams, first = np.unique(gram_hashes(h, m) if m else np.zeros(0, np.uint64), return_index=True)
            self.windows.append((grams, first, h))
            if m == span:
                g = gram_hashes(h, self.k)
                for x in np.unique(g[winnowed(g, span - self.k + 1)]).tolist():
                    held.setdefault(self.k, {}).setdefault(x, []).append(i)
            elif m:
                held.setdefault(-m, {}).setdefault(int(grams[0]), []).append(i)
        #: By gram length (negative: of short items, where all places count), the hashes in order and their items.
        self.tables = {n: (np.array(sorted(x), np.uint64), x) for n, x in held.items()}

    def hits(self, texts: list[bytes | None]) -> list[tuple[int, list[tuple[int, int, int]]]]:
        """Of each text, its number of words and its hits (item, first word, end)."""
        split = [words(t) for t in texts]
        starts = np.cumsum([0, *map(len, split)])
        flat = [w for s in split for w in s]
        h = np.fromiter(map(_CACHE.__getitem__, flat), np.uint64, len(flat))
        out: list[list[tuple[int, int, int]]] = [[] for _ in split]
        for n, (known, held) in self.tables.items():
            grams = gram_hashes(h, abs(n))
            # grams over the end of a text may be kept in place of others, but only in windows that pass the end too
            kept = winnowed(_cut(grams, starts, abs(n)), self.span - n + 1) if n > 0 else np.arange(len(grams))
            if not len(kept):
                continue
            place = np.minimum(np.searchsorted(known, grams[kept]), len(known) - 1)
            kept = kept[known[place] == grams[kept]]
            by: dict[int, list[int]] = {}
            for p in kept.tolist():
                for item in held[int(grams[p])]:
                    by.setdefault(item, []).append(p)
            size = self.span if n > 0 else -n
            if by:
                whole = gram_hashes(h, size)
            for item, near in by.items():
                # windows that hold a matched gram, within one text
                at = np.unique((np.array(near)[:, None] - np.arange(size - abs(n) + 1)).ravel())
                at = at[(at >= 0) & (at < len(whole))]
                doc = np.searchsorted(starts, at, side="right") - 1
                inside = at + size <= starts[doc + 1]
                at, doc = at[inside], doc[inside]
                theirs, first, said = self.windows[item]
                where = np.minimum(np.searchsorted(theirs, whole[at]), len(theirs) - 1)
                same = (said[first[where][:, None] + np.arange(size)] == h[at[:, None] + np.arange(size)]).all(1)
                at, doc = at[same], doc[same]
                if len(at):  # windows that touch are one hit
                    cut = np.flatnonzero((at[1:] > at[:-1] + size) | (doc[1:] != doc[:-1])) + 1
                    for a, b in zip(np.concatenate([[0], cut]).tolist(), np.concatenate([cut, [len(at)]]).tolist(), strict=True):
                        d = int(doc[a])
                        out[d].append((item, int(at[a] - starts[d]), int(at[b - 1] + size - starts[d])))
        return [(len(s), o) for s, o in zip(split, out, strict=True)]


_CACHE = WordHash()


def _cut(grams: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """grams, with those that pass the end of a text at the highest value, so that they are kept last."""
    over = (starts[1:-1, None] - np.arange(1, k)).ravel()
    grams = grams.copy()
    grams[over[(over >= 0) & (over < len(grams))]] = np.uint64(0xFFFFFFFFFFFFFFFF)
    return grams


def blocks(benchmark: DataFrame, id_col: str, text_col: str, span: int, k: int, block_bytes: int) -> list[Items]:
    """The benchmark in blocks of about block_bytes; only one block's rows are collected at a time."""
    items = benchmark.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    n = int((items.agg(F.sum(F.length("text"))).first()[0] or 0) // block_bytes) + 1
    for i in range(n):
        part = items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == i) if n > 1 else items
        yield Items([(r[0], None if r[1] is None else bytes(r[1])) for r in part.collect()], span, k)


def scan(docs: DataFrame, benchmark: DataFrame, keep: list[str], text_col: str = "text", item_id: str = "item_id", item_text: str = "text", span: int = SPAN, k: int = K, block_bytes: int = BLOCK_BYTES, with_text: bool = False) -> DataFrame:
    """(row: the columns `keep`, n_words, hits): per document its hits, start inclusive and end exclusive in words."""
    spark = docs.sparkSession
    prepare(spark)
    row = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")
    now = docs.select(row, F.col(f"`{text_col}`").cast("string").alias("text"), F.lit(0).cast("long").alias("n_words"), F.expr(f"cast(array() as {HITS})").alias("hits"))
    for block in blocks(benchmark, item_id, item_text, span, k, block_bytes):
        sent = spark.sparkContext.broadcast(block)

        def run(batches, sent=sent):
            kind = pa.list_(pa.struct([("item_id", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            for x in batches:
                items = sent.value
                found = items.hits(text_column(x))
                before = x.column(3).to_pylist()
                hits = pa.array([b + [{"item_id": items.ids[i], "start": s, "end": e} for i, s, e in h] for b, (_, h) in zip(before, found, strict=True)], kind)
                yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array([n for n, _ in found], pa.int64()), hits], names=["row", "text", "n_words", "hits"])

        now = now.mapInArrow(run, now.schema)
    return now if with_text else now.drop("text")


def judged(found: DataFrame) -> DataFrame:
    """row.*, n_words, n_hit, items, hits of what scan gives: words hit are counted once however many runs hold them."""
    merged = F.expr(
        "aggregate(array_sort(transform(hits, h -> struct(h.start as s, h.end as e))), struct(0L as n, 0L as upto),"
        " (a, x) -> struct(a.n + greatest(0L, x.e - greatest(x.s, a.upto)) as n, greatest(a.upto, x.e) as upto)).n"
    )
    items = F.array_sort(F.array_distinct(F.filter(F.transform("hits", lambda h: h.item_id), lambda i: i.isNotNull())))
    return found.select("row.*", "n_words", merged.alias("n_hit"), items.alias("items"), "hits")


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = judged(scan(docs, items, ["doc_id"]))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **kw) -> DataFrame:
    """The rows of docs, all columns, that hold no window of an item."""
    return scan(docs, benchmark, docs.columns, text_col, **kw).filter(F.size("hits") == 0).select("row.*")
