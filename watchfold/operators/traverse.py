"""Breadth-first traversals of the graph as joins of a frontier with the edges, one round a hop.

Every round writes its frontier to the shared folder, so that lineage stays one
round long and lost executors cost one round at most.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import col, lit

from watchfold import schema
from watchfold.functions import scalars
from watchfold.shared import Scratch


@dataclass(frozen=True)
class Options:
    """Which edges count: those seen within [low, high], of these types, in this direction."""

    low: int | None = None
    high: int | None = None
    etypes: tuple[str, ...] = ()
    direction: str = "both"

    def edges(self, edges: DataFrame) -> DataFrame:
        """Unknown type names are ignored; without a known one all types count."""
        kept = edges.where(scalars.live_in(self.low, self.high))
        known = [t for t in self.etypes if t in schema.EDGE_TYPES]
        return kept.where(col("etype").isin(known)) if known else kept

    def onward(self, edges: DataFrame, frontier: DataFrame) -> DataFrame:
        """(at, to, edge_id): the steps from a frontier's nodes (node_id) along edges that count.

        The frontier filters each end by a semi-join, which moves below whatever
        makes the edges (a fold by their ends, too): a small frontier costs a scan,
        without a shuffle or a copy of the edges.
        """
        own = self.edges(edges)

        def way(at, to):
            near = own.join(frontier.select(col("node_id").alias(at)), at, "left_semi")
            return near.select(col(at).alias("at"), col(to).alias("to"), "edge_id")

        out, back = way("src_id", "dst_id"), way("dst_id", "src_id")
        return {"out": out, "in": back, "both": out.unionByName(back)}[self.direction]


def k_hop(nodes: DataFrame, edges: DataFrame, seed, hops: int | None, options: Options = Options()) -> tuple[DataFrame, DataFrame]:
    """(node_id, hop) of the nodes within ``hops`` of a seed, and the edges that were followed.

    An unknown seed gives empty tables; without ``hops`` all that can be reached.
    Edges among the nodes of the last ring aren't followed, so they aren't there.
    """
    spark = nodes.sparkSession
    scratch = Scratch(spark, "hops")
    start = nodes.where(col("node_id") == lit(seed)).select("node_id", lit(0).alias("hop"))
    frontier = scratch.write("ring0", start)
    visited, followed, hop = frontier, None, 0
    while (hops is None or hop < hops) and not frontier.isEmpty():
        hop += 1
        taken = scratch.write(f"steps{hop}", options.onward(edges, frontier).select("to", "edge_id"))
        fresh = taken.select(col("to").alias("node_id")).distinct().join(visited.select("node_id"), "node_id", "left_anti")
        frontier = scratch.write(f"ring{hop}", fresh.select("node_id", lit(hop).alias("hop")))
        visited = visited.unionByName(frontier)
        followed = taken if followed is None else followed.unionByName(taken)
    ids = edges.select("edge_id").limit(0) if followed is None else followed.select("edge_id").distinct()
    return visited, options.edges(edges).join(ids, "edge_id", "left_semi").select(*edges.columns)


def neighbors(nodes: DataFrame, edges: DataFrame, seed, options: Options = Options()) -> tuple[DataFrame, DataFrame]:
    return k_hop(nodes, edges, seed, 1, options)


def reachable(nodes: DataFrame, edges: DataFrame, seed, options: Options = Options()) -> DataFrame:
    """node_id of all that can be reached from a seed, itself included."""
    return distances(nodes, edges, nodes.where(col("node_id") == lit(seed)), None, options).select("node_id")


def distances(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, most: int | None, options: Options = Options()) -> DataFrame:
    """(node_id, hop): hops from the nearest of many seeds, as far as ``most``."""
    scratch = Scratch(nodes.sparkSession, "rings")
    frontier = scratch.write("ring0", seeds.select("node_id").distinct().select("node_id", lit(0).alias("hop")))
    visited, hop = frontier, 0
    while (most is None or hop < most) and not frontier.isEmpty():
        hop += 1
        found = options.onward(edges, frontier).select(col("to").alias("node_id")).distinct()
        frontier = scratch.write(f"ring{hop}", found.join(visited.select("node_id"), "node_id", "left_anti").select("node_id", lit(hop).alias("hop")))
        visited = visited.unionByName(frontier)
    return visited


def shortest_path(nodes: DataFrame, edges: DataFrame, src, dst, options: Options = Options()) -> list[tuple] | None:
    """[(node, edge that led there)] from src to dst by fewest hops, None where there is no path.

    Rings grow from both ends, the smaller one first, until they meet; of the rings
    before dst only nodes on shortest paths stay.  Then the path is walked back from dst:
    ties go to the smallest edge id at each step.  Only the path itself, a row for
    each hop, reaches the driver.
    """
    spark = nodes.sparkSession
    if nodes.where(col("node_id").isin(src, dst)).select("node_id").distinct().count() < len({src, dst}):
        return None
    if src == dst:
        return [(src, None)]
    scratch = Scratch(spark, "path")
    against = replace(options, direction={"out": "in", "in": "out", "both": "both"}[options.direction])
    sides = [(options, "ahead", []), (against, "behind", [])]
    for (_, name, rings), end in zip(sides, (src, dst)):
        rings.append((scratch.write(f"{name}0", nodes.where(col("node_id") == lit(end)).select("node_id").distinct()), 1))
    while True:
        own, name, rings = min(sides, key=lambda side: side[2][-1][1])
        found = own.onward(edges, rings[-1][0]).select(col("to").alias("node_id")).distinct()
        for ring, _ in rings:
            found = found.join(ring, "node_id", "left_anti")
        ring = scratch.write(f"{name}{len(rings)}", found)
        rings.append((ring, ring.count()))
        if not rings[-1][1]:
            return None
        met = ring.join(next(r for o, n, r in sides if n != name)[-1][0], "node_id", "left_semi")
        if not met.isEmpty():
            break
    ahead, behind = ([ring for ring, _ in rings] for _, _, rings in sides)
    # Nodes at each hop from src that shortest paths go through, from where the rings met to dst.
    through = [ahead[-1].join(behind[-1], "node_id", "left_semi")]
    for i, ring in enumerate(reversed(behind[:-1])):
        after = options.onward(edges, through[-1]).select(col("to").alias("node_id")).distinct().join(ring, "node_id", "left_semi")
        through.append(scratch.write(f"through{i}", after))
    path, at = [], dst
    for ring in reversed([*ahead[:-1], *through][:-1]):
        last = nodes.where(col("node_id") == lit(at)).select("node_id").distinct()
        ways = against.onward(edges, last).select("edge_id", col("to").alias("node_id")).join(ring, "node_id", "left_semi")
        way = ways.agg(F.min(F.struct("edge_id", "node_id")).alias("way")).first().way
        path.append((at, way.edge_id))
        at = way.node_id
    return [(src, None), *reversed(path)]
