"""Cheapest paths that respect time: no step is earlier than the arrival before it."""

from __future__ import annotations

import heapq
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import col, lit

from watchfold.operators.traverse import Options, reachable

# What a step costs, what its target's risk takes off, the least cost, what a used edge costs more.
BASE, DISCOUNT, LEAST, REUSED = 1.0, 0.6, 0.05, 2.0


@dataclass(frozen=True)
class Path:
    nodes: list
    edges: list
    cost: float


def search(edges: list[tuple], risk: dict, src, dst, k: int) -> list[Path]:
    """Up to k paths over edges (edge_id, src, dst, first_seen); a used edge costs REUSED more in later rounds.

    A node has one label: its cheapest arrival counts, also where a dearer but
    earlier one would have allowed a later step.  Ties go to the smaller node.
    """
    by_src: dict = {}
    for edge_id, a, b, first in sorted(edges):
        by_src.setdefault(a, []).append((edge_id, b, first))
    penalty: dict = {}
    out: list[Path] = []
    for _ in range(max(k, 1)):
        best, arrival, way, heap = {src: 0.0}, {src: None}, {}, [(0.0, src)]
        while heap:
            cost, u = heapq.heappop(heap)
            if cost > best[u]:
                continue
            if u == dst:
                break
            for edge_id, v, first in by_src.get(u, ()):
                if arrival[u] is not None and first < arrival[u]:
                    continue
                c = best[u] + max(LEAST, BASE - DISCOUNT * risk.get(v, 0.0) / 100 + penalty.get(edge_id, 0.0))
                if c + 1e-9 < best.get(v, float("inf")):
                    best[v], arrival[v], way[v] = c, first if arrival[u] is None else max(first, arrival[u]), (u, edge_id)
                    heapq.heappush(heap, (c, v))
        if dst not in best:
            break
        nodes, used, at = [dst], [], dst
        while at != src:
            at, edge_id = way[at]
            nodes.append(at)
            used.append(edge_id)
        used = used[::-1]
        if any(p.edges == used for p in out):
            break
        for e in used:
            penalty[e] = penalty.get(e, 0.0) + REUSED
        out.append(Path(nodes[::-1], used, best[dst]))
    return out


def attack_paths(nodes: DataFrame, edges: DataFrame, src, dst, k: int = 3, options: Options = Options(direction="out")) -> DataFrame:
    """(rank, cost, base_cost, nodes, edges) of up to k (1 to 10) paths along edges' direction, cheapest first.

    The search is one loop over labels that depend on each other, so it runs in one
    task; what it reads is first cut down, in parallel, to the edges between nodes
    that src reaches and that reach dst, which loses no path.
    """
    own = replace(options, direction="out")
    ahead = reachable(nodes, edges, src, own)
    behind = reachable(nodes, edges, dst, replace(own, direction="in"))
    within = ahead.join(behind, "node_id", "left_semi")
    used = own.edges(edges).select("edge_id", "src_id", "dst_id", "first_seen")
    used = used.join(within.withColumnRenamed("node_id", "src_id"), "src_id", "left_semi").join(within.withColumnRenamed("node_id", "dst_id"), "dst_id", "left_semi")
    rows = used.join(nodes.select(col("node_id").alias("dst_id"), "risk_score"), "dst_id").select(
        "edge_id", "src_id", "dst_id", "first_seen", col("risk_score").cast("double").alias("risk"))
    # An empty row keeps the task alive where no edge is left, for the path from a node to itself.
    here = nodes.where(col("node_id") == lit(src)).select(lit(None).cast("bigint").alias("edge_id"), "node_id", "node_id", lit(0).cast("bigint"), lit(0.0))
    key, edge_key = dict(nodes.dtypes)["node_id"], dict(edges.dtypes)["edge_id"]

    def run(batches):
        found, risks, known = [], {}, False
        for b in batches:
            for edge_id, a, c, first, r in zip(*(x.to_pylist() for x in b.columns)):
                if edge_id is None:
                    known = True
                else:
                    found.append((edge_id, a, c, first))
                    risks[c] = r or 0.0
        paths = search(found, risks, src, dst, min(max(k, 1), 10)) if known else []
        risk_of = lambda p: sum(max(LEAST, BASE - DISCOUNT * risks.get(v, 0.0) / 100) for v in p.nodes[1:])
        ids = pa.string() if key == "string" else pa.int64()
        edge_ids = pa.string() if edge_key == "string" else pa.int64()
        yield pa.RecordBatch.from_pylist(
            [{"rank": i + 1, "cost": p.cost, "base_cost": float(risk_of(p)), "nodes": p.nodes, "edges": p.edges} for i, p in enumerate(paths)],
            schema=pa.schema([("rank", pa.int32()), ("cost", pa.float64()), ("base_cost", pa.float64()), ("nodes", pa.list_(ids)), ("edges", pa.list_(edge_ids))]))

    here = here.toDF("edge_id", "src_id", "dst_id", "first_seen", "risk").withColumn("edge_id", col("edge_id").cast(edge_key))
    return rows.unionByName(here).coalesce(1).mapInArrow(
        run, f"rank int, cost double, base_cost double, nodes array<{key}>, edges array<{edge_key}>")


def union_paths(paths: DataFrame) -> DataFrame:
    """(part, id, rank): every node and edge of ranked paths once, with the least rank that it is on."""
    parts = paths.select("rank", F.explode(F.array(
        F.struct(lit("node").alias("part"), F.transform("nodes", lambda x: x.cast("string")).alias("ids")),
        F.struct(lit("edge").alias("part"), F.transform("edges", lambda x: x.cast("string")).alias("ids")))).alias("p"))
    return parts.select("rank", "p.part", F.explode("p.ids").alias("id")).groupBy("part", "id").agg(F.min("rank").alias("rank"))
