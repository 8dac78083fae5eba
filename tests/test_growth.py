"""What the graph's loops write and shuffle: no more rounds than the graph needs, no copies of all edges."""

import pytest
from pyspark.sql import functions as F

from watchfold import catalog, shared
from watchfold.operators import centrality, components, traverse
from watchfold.operators.traverse import Options

EDGE = "src_id string, dst_id string, etype string, ts_ms long"


@pytest.fixture
def written(monkeypatch):
    """(name, columns, rows) of each table as it is written."""
    tables, write = [], shared.Scratch.write

    def noted(self, name, df):
        out = write(self, name, df)
        tables.append((name, set(df.columns), out.count()))
        return out

    monkeypatch.setattr(shared.Scratch, "write", noted)
    return tables


def _graph(spark, pairs):
    seen = spark.createDataFrame([(a, b, "USED", 5) for a, b in pairs], EDGE)
    folded = seen.groupBy("src_id", "dst_id", "etype").agg(F.min("ts_ms").alias("first_seen"), F.max("ts_ms").alias("last_seen"))
    nodes = spark.createDataFrame([(n, "user") for n in sorted({n for p in pairs for n in p} - {"unknown"})], "node_id string, kind string")
    return nodes, folded.withColumn("edge_id", F.concat_ws(":", "src_id", "dst_id", "etype"))


def _ranks(nodes, pairs, rounds=40, d=0.85):
    n, out = len(nodes), {a: sum(x == a for x, _ in pairs) for a, _ in pairs}
    rank = dict.fromkeys(nodes, 1 / n)
    for _ in range(rounds):
        base = (1 - d) / n + d * sum(r for i, r in rank.items() if i not in out) / n
        new = dict.fromkeys(nodes, base)
        for a, b in pairs:
            if b in new:
                new[b] += d * rank[a] / out[a]
        rank = new
    return rank


def test_pagerank_ends_with_the_longest_way(spark, written):
    pairs = [("a", "b"), ("a", "c"), ("b", "c"), ("c", "d"), ("c", "unknown"), ("e", "d")]
    nodes, edges = _graph(spark, pairs)
    got = {r.node_id: r.score for r in centrality.pagerank(nodes, edges).collect()}
    assert got == pytest.approx(_ranks("abcde", pairs), abs=1e-12)
    assert len(written) <= 6


def test_pagerank_of_a_cycle_takes_all_rounds(spark, monkeypatch):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("a", "d")]
    nodes, edges = _graph(spark, pairs)
    for few in (0, centrality.FEW):
        monkeypatch.setattr(centrality, "FEW", few)
        got = {r.node_id: r.score for r in centrality.pagerank(nodes, edges, iterations=7).collect()}
        assert got == pytest.approx(_ranks("abcd", pairs, 7), abs=1e-12)


def test_a_frontier_filters_edges_below_their_fold(spark, written):
    pairs = [("a", "b"), ("b", "c"), ("c", "d"), ("a", "e"), ("e", "f"), ("f", "d"), ("d", "a")]
    nodes, edges = _graph(spark, pairs)
    frontier = spark.createDataFrame([("a",)], "node_id string")
    plan = Options(direction="out").onward(edges, F.broadcast(frontier))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("LeftSemi")
    assert {r.node_id: r.hop for r in traverse.distances(nodes, edges, nodes.where("node_id = 'a'"), None, Options(direction="out")).collect()} == {
        "a": 0, "b": 1, "e": 1, "c": 2, "f": 2, "d": 2 + 1}
    assert [n for n, _ in traverse.shortest_path(nodes, edges, "a", "d", Options(direction="out"))] == ["a", "b", "c", "d"]
    assert [n for n, _ in traverse.shortest_path(nodes, edges, "f", "b", Options(direction="both"))] in (["f", "d", "c", "b"], ["f", "e", "a", "b"], ["f", "d", "a", "b"])
    assert traverse.shortest_path(nodes, edges, "d", "f", Options(direction="in")) == [("d", None), ("f", "f:d:USED")]
    assert not any(columns >= {"src_id", "dst_id"} for _, columns, _ in written)


def test_graphs_folded_by_one_key_are_united_without_a_shuffle(spark):
    df = catalog.QUERIES["validity_merge"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and "Exchange" not in plan[:plan.index("Union")]


def _smallest(pairs):
    label = {n: n for p in pairs for n in p}
    for _ in label:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return label


@pytest.mark.parametrize("block, dealt", [(components.BLOCK, components.DEALT), (60, 100)])
def test_components_merge_blocks_in_few_tables(spark, written, monkeypatch, block, dealt):
    monkeypatch.setattr(components, "BLOCK", block)
    monkeypatch.setattr(components, "DEALT", dealt)
    pairs = [(f"ö{i % 7}", f"n{i}") for i in range(60)] + [(f"m{i}", f"m{i + 1}") for i in range(20)] + [(f"x{i}", f"n{i}") for i in range(0, 60, 3)]
    df = spark.createDataFrame([*pairs, *pairs, ("n1", None), (None, "n1"), ("alone", "alone")], "src string, dst string").repartition(4)
    got = {r.node: r.component for r in components.connected_components(df).collect()}
    assert got == _smallest(pairs)
    if block > len(pairs):
        assert len(written) <= 3 and not any(n.startswith("round") for n, _, _ in written)
    numbers = [(a * 7 % 50 - 25, a * 3 % 50 - 25) for a in range(40) if a % 5]
    got = components.connected_components(spark.createDataFrame(numbers, "src long, dst long"))
    assert {r.node: r.component for r in got.collect()} == _smallest([p for p in numbers if p[0] != p[1]])
    assert components.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_components_of_the_graph_do_not_fold_its_edges(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(centrality, "connected_components", lambda edges, *ends: plans.append(edges) or components.connected_components(edges, *ends))
    assert {r["size"]: r.n for r in catalog.QUERIES["component_sizes"](spark, "/root/testdata/sf0.001").collect()} == {centrality.components(*catalog.testdata.graph(spark, "/root/testdata/sf0.001")).count(): 1}
    assert "Aggregate" not in plans[0]._jdf.queryExecution().optimizedPlan().toString()
