"""Approximate nearest neighbours by a forest of hash prefixes.

Every tree hashes a vector to a string of ``BITS`` bits, the sides of random
hyperplanes through the mean of a bounded sample, and keeps its strings sorted.
A query descends each tree to its longest matching prefix by binary search, then
all trees ascend together, a bit at a time, until the prefixes they stand at hold
enough of the shard's rows, counted with repeats over trees, and k rows beside the
query's own, counted once.  Rows that share a query's whole string in a tree, its
own among them, do not count there to what is enough.  All rows under those
prefixes are compared exactly, in double precision; no bucket is cut.  What is
enough falls with a shard's size, ``ENOUGH`` times (WHOLE / rows) ** ``FALL``: among
more rows a neighbour is nearer.  A shard of ``WHOLE`` rows or fewer is compared
whole: there every row that all trees hold would be much of what is enough.

Rows are indexed in even shards of about ``SHARD`` rows at most, written as a table.
Queries are written in blocks of ``QUERIES``, each with its hash strings, and one
plan brings every block to every shard, where it streams past the shard's index;
each shard returns its k best.  Equal vectors of a shard are indexed once with
their smallest ids, as many as a result can hold.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.functions import col

from watchfold.llm.threads import one_thread
from watchfold.shared import Scratch

TREES = 64
BITS = 48
ENOUGH, FALL = 1.1, 0.17
SHARD = 65_536
WHOLE = 16 * TREES
QUERIES = 256
#: Rows that the centre of the hyperplanes is fit on, at most.
FIT = 10_000
SEED = 5


class Forest:
    """The index of one shard: sorted hash strings of every tree, and the rows in their order."""

    def __init__(self, vectors: np.ndarray, hashes: np.ndarray, order: np.ndarray):
        self.vectors, self.hashes, self.order = vectors, hashes, order

    @classmethod
    def build(cls, vectors: np.ndarray, planes: np.ndarray, centre: np.ndarray) -> "Forest":
        strings = hash_strings(vectors, planes, centre)
        order = np.argsort(strings, axis=1, kind="stable").astype(np.int32)
        return cls(vectors, np.take_along_axis(strings, order, axis=1), order)

    def candidates(self, strings: np.ndarray, enough: float, k: int):
        """Of each query (a column of strings): the rows under its prefixes once they are enough, k + 1 at least if there are."""
        trees, n = self.hashes.shape
        queries = strings.shape[1]
        if n <= max(WHOLE, k + 1):
            yield from (np.arange(n) for _ in range(queries))
            return
        low = np.empty((trees, queries, BITS + 1), np.int32)
        high = np.empty_like(low)
        keep = np.array([((1 << x) - 1) << (BITS - x) for x in range(BITS + 1)], np.uint64)
        rest = np.array([(1 << (BITS - x)) - 1 for x in range(BITS + 1)], np.uint64)
        for t in range(trees):
            prefix = strings[t][:, None] & keep
            low[t] = np.searchsorted(self.hashes[t], prefix.ravel()).reshape(prefix.shape)
            high[t] = np.searchsorted(self.hashes[t], (prefix | rest).ravel(), "right").reshape(prefix.shape)
        enough *= (WHOLE / n) ** FALL if n > WHOLE else 1
        # A tree whose longest match is shorter than x has an empty range at x and waits.
        size = (high - low).astype(np.int64)
        total = size.sum(axis=0)
        for q in range(queries):
            want = min(enough * n + total[q, BITS], total[q, 0])
            x = int(np.flatnonzero(total[q] >= want)[-1])
            # All trees have ascended to x + 1; at x they add what they have, one after another, until it is enough.
            last = int(np.argmax(total[q, x + 1] + np.cumsum(size[:, q, x] - size[:, q, x + 1]) >= want)) if x < BITS else trees
            mask = np.zeros(n, bool)
            for t in range(trees):
                at = x if t <= last else x + 1
                mask[self.order[t, low[t, q, at]:high[t, q, at]]] = True
            while x and np.count_nonzero(mask) <= k:
                x -= 1
                for t in range(trees):
                    mask[self.order[t, low[t, q, x]:high[t, q, x]]] = True
            yield np.flatnonzero(mask)


def hash_strings(vectors: np.ndarray, planes: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """(trees, rows): the first bit of a string is its highest."""
    side = ((vectors - centre) @ planes.T > 0).reshape(len(vectors), TREES, BITS)
    weight = (np.uint64(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64))
    return np.ascontiguousarray((side * weight).sum(axis=2, dtype=np.uint64).T)


def _planes(dim: int) -> np.ndarray:
    return np.random.default_rng(SEED).normal(size=(TREES * BITS, dim)).astype(np.float32)


def _valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    rows = vectors.select(col(id_col).cast("long").alias("id"), col(vector_col).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return rows.where(col("id").isNotNull() & col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))


def _dtype(vectors: DataFrame, vector_col: str) -> str:
    """How vectors are held: floats as such, all else in double precision."""
    return "<f4" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "<f8"


def _matrix(column: pa.Array, dim: int, dtype: str) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(-1, dim)


_ROW = "shard int, lane int, kind int, ids binary, owner binary, vectors binary, hashes binary, places binary"
_NAMES = [part.split()[0] for part in _ROW.split(", ")]


def build(vectors: DataFrame, scratch: Scratch, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, DataFrame, np.ndarray]:
    """The shards' index as a table; the rows that take part; the centre.

    Null, zero and non-finite vectors, null ids and vectors of another length than
    the most common one take no part.
    """
    rows = _valid(vectors, id_col, vector_col)
    dim = rows.agg(F.mode(F.size("v"), deterministic=True)).first()[0] or 1
    rows, dtype = rows.where(F.size("v") == dim), _dtype(vectors, vector_col)
    fit = np.array([r.v for r in rows.orderBy(F.xxhash64("id"), "id").limit(FIT).collect()], float).reshape(-1, dim)
    centre = fit.mean(axis=0) if len(fit) else np.zeros(dim)

    def shards(batches):
        one_thread()
        ids, held = [], []
        for b in batches:
            ids.append(b.column(0).to_numpy())
            held.append(_matrix(b.column(1), dim, dtype))
        if not sum(map(len, ids)):
            return
        own, v = np.concatenate(ids), np.concatenate(held)
        order = np.argsort(own, kind="stable")
        own, v = own[order], v[order]
        first, same = np.unique(v, axis=0, return_index=True, return_inverse=True)[1:]
        same = same.ravel()
        by = np.argsort(same, kind="stable")
        rank = np.arange(len(by)) - np.searchsorted(same[by], same[by])
        keep = by[rank <= k]  # the smallest ids of equal vectors: k, and one that may be the query's own
        forest = Forest.build(v[first], _planes(dim), centre)
        yield _row(TaskContext.get().partitionId(), 0, own[keep], same[keep].astype(np.int32), forest.vectors, forest.hashes, forest.order)

    # Dealt in turn, so that shards are even whatever partitions the rows come in.
    even = rows.repartition(max(1, -(-rows.count() // SHARD)))
    return scratch.write("index", even.mapInArrow(shards, _ROW)), rows, centre


def _row(shard: int, kind: int, *parts: np.ndarray) -> pa.RecordBatch:
    own = [p.tobytes() for p in parts] + [b""] * (5 - len(parts))
    return pa.RecordBatch.from_arrays([pa.array([x], pa.int32()) for x in (shard, 0, kind)] + [pa.array([x], pa.binary()) for x in own], _NAMES)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
            enough: float = ENOUGH) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for every query, by Euclidean distance, then id.

    ``queries`` has the columns of ``vectors``; a query's own id is no candidate.
    Rows that take no part: see ``build``.  Of rows that repeat a query's id one is
    searched for; repeated candidates count each.  Empty tables: empty result.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    index, rows, centre = build(vectors, scratch, k, id_col, vector_col)
    dim, dtype = len(centre), _dtype(vectors, vector_col)
    asked = _valid(queries, id_col, vector_col).where(F.size("v") == dim).groupBy("id").agg(F.min("v").alias("v"))

    def block(batches):
        one_thread()
        ids, held = np.zeros(0, np.int64), np.zeros((0, dim), dtype)
        for b in chain(batches, [None]):
            if b is not None:
                ids, held = np.concatenate([ids, b.column(0).to_numpy()]), np.concatenate([held, _matrix(b.column(1), dim, dtype)])
            while len(ids) >= QUERIES or b is None and len(ids):
                now, v = ids[:QUERIES], held[:QUERIES]
                ids, held = ids[QUERIES:], held[QUERIES:]
                yield _row(0, 1, now, np.zeros(0, np.int32), v, hash_strings(v, _planes(dim), centre))

    blocks = scratch.write("queries", asked.mapInArrow(block, _ROW))
    shards = (index.agg(F.max("shard")).first()[0] or 0) + 1
    # Where there are fewer shards than cores, copies of a shard share its blocks.
    lanes = max(1, spark.sparkContext.defaultParallelism // shards)
    copies = index.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    dealt = blocks.withColumn("lane", F.pmod(F.xxhash64("ids"), F.lit(lanes)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    pairs = copies.unionByName(dealt.select(*_NAMES)).select(*_NAMES).repartitionById(shards * lanes, col("shard") * lanes + col("lane"))
    found = pairs.sortWithinPartitions("kind").mapInArrow(_searcher(dim, dtype, k, enough), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _searcher(dim: int, dtype: str, k: int, enough: float):
    def search(batches):
        forest = None
        for b in batches:
            for _, _, kind, ids, owner, vectors, hashes, places in zip(*(c.to_pylist() for c in b.columns)):
                if not kind:
                    own_ids, owner, vectors = np.frombuffer(ids, np.int64), np.frombuffer(owner, np.int32), np.frombuffer(vectors, dtype).reshape(-1, dim)
                    forest = Forest(vectors, np.frombuffer(hashes, np.uint64).reshape(TREES, -1), np.frombuffer(places, np.int32).reshape(TREES, -1))
                    start, wide = np.searchsorted(owner, np.arange(len(vectors) + 1)), vectors.astype(np.float64)
                elif forest is not None:
                    query_ids, query = np.frombuffer(ids, np.int64), np.frombuffer(vectors, dtype).reshape(-1, dim).astype(np.float64)
                    strings, out = np.frombuffer(hashes, np.uint64).reshape(TREES, -1), []
                    for q, rows in enumerate(forest.candidates(strings, enough, k)):
                        d = np.sqrt(((wide[rows] - query[q]) ** 2).sum(axis=1))
                        near = rows[d <= np.partition(d, min(k, len(d) - 1))[min(k, len(d) - 1)]]
                        d = np.sqrt(((wide[near] - query[q]) ** 2).sum(axis=1)).tolist()
                        own = [(x, i) for r, x in zip(near.tolist(), d) for i in own_ids[start[r]:start[r + 1]].tolist() if i != query_ids[q]]
                        out += [(int(query_ids[q]), i, score) for score, i in sorted(own)[:k]]
                    query_id, vec_id, score = zip(*out) if out else ((), (), ())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(query_id, pa.int64()), pa.array(vec_id, pa.int64()), pa.array(score, pa.float64())], ["query_id", "vec_id", "score"])

    return search
