"""Degree, PageRank, components and composite risk of a graph's nodes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation, functions as F
from pyspark.sql.functions import col, lit

from watchfold.operators.components import connected_components
from watchfold.operators.traverse import Options, distances
from watchfold.shared import Scratch

DAMPING, ITERATIONS = 0.85, 40
ALERT_HOPS = 3
#: Rows of a table that is broadcast, at most.
FEW = 300_000
# What a node's kind adds to its risk.
KIND_WEIGHT = {"alert": 1.0, "ioc": 0.9, "privilege": 0.5, "certificate": 0.5, "process": 0.25, "user": 0.25, "host": 0.25}


def degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, out_degree, in_degree); edges of different types count each."""
    ends = edges.select(F.explode(F.array(
        F.struct(col("src_id").alias("node_id"), lit(1).alias("o"), lit(0).alias("i")),
        F.struct(col("dst_id").alias("node_id"), lit(0).alias("o"), lit(1).alias("i")))).alias("e")).select("e.*")
    counted = ends.groupBy("node_id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    return nodes.select("node_id").join(counted, "node_id", "left").select(
        "node_id", F.coalesce("out_degree", lit(0)).alias("out_degree"), F.coalesce("in_degree", lit(0)).alias("in_degree"))


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = DAMPING, iterations: int = ITERATIONS) -> DataFrame:
    """(node_id, score): a fixed number of rounds; nodes without out-edges spread their score evenly.

    Parallel edges each take a share; edges to unknown nodes take it away.  A
    round gives each node the same base and what arrives along edges.  So scores
    after t rounds are the sum over j of the base of round t - j times the weight of the ways of
    j edges that end in a node, and only those weights are tables: they don't depend
    on the bases, and they end with the longest way, so that a graph without
    cycles takes as many rounds as its longest way has edges.  Each weight table is
    written with the mass of nodes without out-edges, from which the bases follow.
    The edges are not bucketed by source: a source with a large part of them would be
    one task, whereas a skewed join is split.
    """
    scratch = Scratch(nodes.sparkSession, "pagerank")
    return _pagerank(scratch, nodes, scratch.write("edges", edges.select("src_id", "dst_id")), damping, iterations)


def _pagerank(scratch: Scratch, nodes: DataFrame, edges: DataFrame, damping: float, iterations: int) -> DataFrame:
    out = edges.groupBy(col("src_id").alias("node_id")).agg(F.count(lit(1)).alias("n_out"))

    def written(name, df):
        """The table, its rows, those with out-edges, and the weight of the others."""
        facts = Observation()
        ends = col("n_out").isNull()
        df = df.select("node_id", "n_out", "weight").observe(facts, F.count(lit(1)).alias("n"), F.count_if(~ends).alias("going"), F.sum(F.when(ends, col("weight"))).alias("mass"))
        df = scratch.write(name, df)
        return df, facts.get["n"], facts.get["going"], facts.get["mass"] or 0.0

    own, n, going, mass = written("ways0", nodes.select("node_id").join(out, "node_id", "left").withColumn("weight", lit(1.0)))
    if not n:
        return own.select("node_id", lit(0.0).alias("score"))
    ways, masses = [own], [mass]
    while going and len(ways) <= iterations:
        shares = ways[-1].where("n_out IS NOT NULL").select(col("node_id").alias("src_id"), (damping * col("weight") / col("n_out")).alias("share"))
        shares = F.broadcast(shares) if going <= FEW else shares
        got = edges.join(shares, "src_id").groupBy(col("dst_id").alias("node_id")).agg(F.sum("share").alias("weight"))
        now, _, going, mass = written(f"ways{len(ways)}", own.select("node_id", "n_out").join(got, "node_id"))
        ways.append(now)
        masses.append(mass)
    bases = [1.0 / n]
    for t in range(iterations):
        bases.append((1 - damping) / n + damping / n * sum(base * m for base, m in zip(reversed(bases), masses)))
    parts = [w.select("node_id", (lit(base) * col("weight")).alias("score")) for base, w in zip(reversed(bases), ways)]
    return reduce(DataFrame.unionAll, parts).groupBy("node_id").agg(F.sum("score").alias("score"))


def components(nodes: DataFrame, edges: DataFrame, options: Options = Options()) -> DataFrame:
    """(node_id, component): weak components, named by their smallest node; a lone node is its own."""
    own = connected_components(options.edges(edges), "src_id", "dst_id").withColumnRenamed("node", "node_id")
    return nodes.select("node_id").join(own, "node_id", "left").select("node_id", F.coalesce("component", "node_id").alias("component"))


def component_sizes(labelled: DataFrame) -> DataFrame:
    """(component, size), the largest first."""
    return labelled.groupBy("component").agg(F.count(lit(1)).alias("size")).orderBy(F.desc("size"), "component")


def component_members(labelled: DataFrame, nodes: DataFrame, least: int = 2) -> DataFrame:
    """(component, size, node_id, kind, label) of components of ``least`` nodes or more: a row a member, so no list grows with a component."""
    sizes = labelled.groupBy("component").agg(F.count(lit(1)).alias("size")).where(col("size") >= least)
    return labelled.join(sizes.hint("merge"), "component").join(nodes.select("node_id", "kind", "label"), "node_id").select(
        "component", "size", "node_id", "kind", "label")


def kind_weight() -> "F.Column":
    pairs = [lit(x) for kv in KIND_WEIGHT.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), col("kind")), lit(0.1))


def risk(nodes: DataFrame, edges: DataFrame, iterations: int = ITERATIONS) -> DataFrame:
    """(node_id, score), 0 to 100: centrality, nearness to alerts within ALERT_HOPS, and the kind's weight."""
    scratch = Scratch(nodes.sparkSession, "risk")
    nodes = scratch.write("nodes", nodes.select("node_id", "kind"))
    edges = scratch.write("edges", edges.select("src_id", "dst_id"))  # read by the rounds and the rings
    ranks = scratch.write("ranks", _pagerank(scratch, nodes, edges, DAMPING, iterations))
    top = max(ranks.agg(F.max("score")).first()[0] or 0.0, 1e-9)
    near = distances(nodes, edges.withColumn("edge_id", lit(None)), nodes.where("kind = 'alert'"), ALERT_HOPS)
    proximity = F.coalesce(F.pow(lit(0.5), col("hop")), lit(0.0))
    total = 0.45 * col("score") / top + 0.40 * proximity + 0.15 * kind_weight()
    joined = nodes.select("node_id", "kind").join(ranks, "node_id").join(near, "node_id", "left")
    return joined.select("node_id", (F.least(F.greatest(total, lit(0.0)), lit(1.0)) * 100).alias("score"))


def with_risk(nodes: DataFrame, scores: DataFrame) -> DataFrame:
    """Nodes with their risk replaced where there is a score; scores of unknown ids are ignored."""
    return nodes.join(scores.select("node_id", "score"), "node_id", "left").select(
        *(F.coalesce(col("score").cast("float"), "risk_score").alias("risk_score") if c == "risk_score" else c for c in nodes.columns))
