"""Connected components of an edge table: tasks merge blocks of edges, then what the blocks have in common.

Alternating large-star and small-star steps end a graph that blocks don't make small.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, functions as F
from pyspark.sql.functions import col

from watchfold.shared import Scratch

#: Rows and their bytes that a task merges at a time.
BLOCK, BLOCK_BYTES = 1_000_000, 128 << 20
#: Of more edges than these, each block takes those of its share of starts; all of one start are in one task.
DEALT = 4_000_000
#: Rows of labels that are broadcast, at most.
FEW = 300_000
#: Types that Arrow orders as Spark does.
MERGED = ("string", "binary", "bigint", "int", "smallint", "tinyint", "date")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node with an edge to another; component is its smallest node.

    A task merges its edges block by block, and numbers what is connected within a
    block as a group.  A second task has all groups of a node, one a block at most,
    so a hub is no hot key; groups with a node in common are linked.  The links are
    the next, smaller graph, whose nodes are numbers, until one block holds it.
    Every graph is written to the shared folder, so the lineage stays one round
    long.  Where a graph doesn't halve, star steps do the rest.  Edges with a null
    end or equal ends take no part; repeated edges change nothing.
    """
    scratch = Scratch(edges.sparkSession, "components")
    current = edges.select(col(src).alias("u"), col(dst).alias("v")).where("u <> v")
    kinds = {f.dataType.simpleString() for f in current.schema}
    if len(kinds) > 1 or not kinds <= {*MERGED}:
        return _stars(scratch, current)
    n = edges.count()  # of stored tables this reads no column
    if n > DEALT:
        # All edges of a start fall into one block, whatever order they lie in, so blocks leave few groups.
        current = current.repartition(1 + n // BLOCK, "u")
    return _label(scratch, 0, current, None)


def _label(scratch: Scratch, k: int, edges: DataFrame, n: int | None) -> DataFrame:
    """(node, component) of edges (u, v); n: how many, where that is known."""
    kind = edges.schema["u"].dataType.simpleString()
    facts = Observation()
    size = F.sum(F.length(col("node").cast("string").cast("binary")) + 12)
    # Written, as a task that runs again may get its rows in another order and thus other blocks.
    stars = edges.mapInArrow(_blocks, f"node {kind}, root long").observe(facts, F.count(F.lit(1)).alias("n"), size.alias("size"))
    stars = scratch.write(f"stars{k}", stars)
    parts = 1 + max(2 * facts.get["n"] // BLOCK, 2 * (facts.get["size"] or 0) // BLOCK_BYTES)
    facts, linked = Observation(), F.col("other").isNotNull()
    found = stars.repartition(parts, "node").mapInArrow(_meet, f"node {kind}, root long, other long")
    found = scratch.write(f"found{k}", found.observe(facts, F.count_if(linked).alias("n"), F.sum(F.when(linked, F.length(col("node").cast("string").cast("binary")))).alias("size")))
    scratch.drop(f"stars{k}")
    own, met, links = found.where(~linked).select("node", "root"), found.where(linked), facts.get["n"]
    if links <= BLOCK and (facts.get["size"] or 0) <= BLOCK_BYTES:
        names = met.coalesce(1).mapInArrow(_finish, f"root long, component {kind}")
    else:
        pairs = met.where("root <> other").select(col("root").alias("u"), col("other").alias("v"))
        groups = _label(scratch, k + 1, pairs, links) if n is None or 2 * links <= n else _stars(scratch, pairs)
        groups = met.where("root = other").select("node", "root").join(groups.select(col("node").alias("root"), col("component").alias("group")).hint("merge"), "root", "left")
        groups = scratch.write(f"groups{k}", groups.select("node", "root", F.coalesce("group", "root").alias("group")))
        least = scratch.write(f"least{k}", groups.groupBy("group").agg(F.min("node").alias("component")))
        names = groups.select("root", "group").distinct().join(least.hint("merge"), "group").select("root", "component")
    names = scratch.write(f"names{k}", names)
    names = F.broadcast(names) if links <= FEW else names.hint("merge")
    return own.join(names, "root").select("node", "component")


def _codes(columns: list[pa.Array]) -> tuple[pa.Array, np.ndarray]:
    """The distinct values of all columns, and for each row the place of its value."""
    coded = pa.concat_arrays(columns).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy()


def _out(columns: list[pa.Array], names: list[str]):
    for at in range(0, len(columns[0]), 1 << 16):
        yield pa.RecordBatch.from_arrays([c.slice(at, 1 << 16) for c in columns], names)


def _smallest(of: np.ndarray, nodes: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The groups ``of`` the nodes, and the smallest node of each."""
    least = pa.table({"of": of, "node": nodes}).group_by("of", use_threads=False).aggregate([("node", "min")])
    return least["of"].to_numpy(), least["node_min"].combine_chunks()


def _blocks(batches):
    """(node, root): the number of what each node of a block is connected with in it."""
    base = TaskContext.get().partitionId() << 40

    def block(held):
        nonlocal base
        nodes, at = _codes([b.column(i) for i in (0, 1) for b in held])
        root = _least(*np.split(at, 2), len(nodes))
        number = np.cumsum(root == np.arange(len(root))) - 1
        yield from _out([nodes, pa.array(base + number[root])], ["node", "root"])
        base += int(number[-1]) + 1

    held, n, used = [], 0, 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n, used = n + b.num_rows, used + b.nbytes
        if n >= BLOCK or used >= BLOCK_BYTES:
            yield from block(held)
            held, n, used = [], 0, 0
    if held:
        yield from block(held)


def _meet(batches):
    """(node, root, null) of every node, and for each of the roots here (smallest node of the root that it is merged into or null, that root, it)."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    nodes, at = _codes([b.column(0) for b in held])
    roots, root = _codes([b.column(1) for b in held])
    first = np.empty(len(nodes), root.dtype)
    first[at] = root
    least = _least(first[at], root, len(roots))
    own = least[first]
    yield from _out([nodes, roots.take(pa.array(own)), pa.nulls(len(nodes), pa.int64())], ["node", "root", "other"])
    of, node = _smallest(own, nodes)
    place = np.full(len(roots), -1)
    place[of] = np.arange(len(of))
    node = node.take(pa.array(place, mask=place < 0))
    yield from _out([node, roots.take(pa.array(least)), roots], ["node", "root", "other"])


def _finish(batches):
    """(root, component): the smallest node of all that each root is linked with."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    roots, at = _codes([b.column(i) for i in (1, 2) for b in held])
    root, other = np.split(at, 2)
    least = _least(root, other, len(roots))
    of, node = _smallest(least[root], pa.concat_arrays([b.column(0) for b in held]))
    place = np.empty(len(roots), np.int64)
    place[of] = np.arange(len(of))
    yield from _out([roots, node.take(pa.array(place[least]))], ["root", "component"])


def _least(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The smallest node that each of the nodes 0..n-1 reaches."""
    root = np.arange(n)
    while len(u):
        # Each root with a smaller neighbour goes below one such, so at least half of those with neighbours go.
        root[np.maximum(u, v)] = np.minimum(u, v)
        while not np.array_equal(up := root[root], root):
            root = up
        u, v = root[u], root[v]
        apart = u != v
        u, v = u[apart], v[apart]
    return root


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _stars(scratch: Scratch, current: DataFrame) -> DataFrame:
    """(node, component) of edges (u, v); rounds grow with the logarithm of a component's diameter.

    A hub is only a hot join key: its minimum is a partial aggregate and the join's
    hot partitions can be split.
    """
    current = scratch.write("round0", current.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen, n = _fingerprint(current), 0
    while seen[0]:
        both = current.union(current.select("v", "u"))
        # Minima are written, so that the joins' exchanges stand alone and a hub's partition can be split.
        least = scratch.write(f"large{n}", both.groupBy("u").agg(F.least(col("u"), F.min("v")).alias("m")))
        large = both.join(least.hint("merge"), "u").where("v > u").select(col("v").alias("u"), col("m").alias("v"))
        large = scratch.write(f"edges{n}", large)
        least = scratch.write(f"small{n}", large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least.hint("merge"), "u")
        small = small.select("u", col("m").alias("v")).union(small.where("v <> m").select(col("v").alias("u"), col("m").alias("v")))
        n += 1
        current = scratch.write(f"round{n}", small.distinct())
        now = _fingerprint(current)
        if now == seen:
            break
        scratch.drop(f"round{n - 1}")
        seen = now
    return current.select(col("u").alias("node"), col("v").alias("component")).union(
        current.select(col("v").alias("node"), col("v").alias("component")).distinct())
