"""The queries over the whole graph, with the operators' own rounds, against brute force."""

from collections import Counter, defaultdict

import pytest

from watchfold import catalog
from watchfold.operators import centrality
from watchfold.sources import testdata

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def graph(spark):
    nodes, edges = testdata.graph(spark, SF)
    return {r.node_id: r.kind for r in nodes.collect()}, [(r.src_id, r.dst_id) for r in edges.collect()]


def _labels(nodes, edges):
    near = defaultdict(list)
    for a, b in edges:
        near[a].append(b)
        near[b].append(a)
    label = {}
    for n in sorted(nodes):
        stack = [] if n in label else [n]
        while stack:
            at = stack.pop()
            if at not in label:
                label[at] = n
                stack += near[at]
    return label


def _ranks(nodes, edges, rounds=40, d=0.85):
    out, n = Counter(a for a, _ in edges), len(nodes)
    rank = dict.fromkeys(nodes, 1 / n)
    for _ in range(rounds):
        base = (1 - d) / n + d * sum(r for i, r in rank.items() if not out[i]) / n
        new = dict.fromkeys(nodes, base)
        for a, b in edges:
            new[b] += d * rank[a] / out[a]
        rank = new
    return rank


def test_components_of_the_whole_graph(spark, graph):
    want = _labels(*graph)
    assert {r.node_id: r.component for r in catalog.QUERIES["component_labels"](spark, SF).collect()} == want
    sizes = Counter(Counter(want.values()).values())
    assert {r["size"]: r.n for r in catalog.QUERIES["component_sizes"](spark, SF).collect()} == sizes


def test_components_of_long_chains(spark):
    chains = [[f"a{i:03}" for i in range(130)], [f"b{i:03}" for i in range(57)], ["c0"]]
    edges = [(x, y) for c in chains for x, y in zip(c[1::2], c[::2])] + [(x, y) for c in chains for x, y in zip(c[1::2], c[2::2])]
    nodes = [n for c in chains for n in c]
    df = spark.createDataFrame([(a, b, "OWNS", 0, 0) for a, b in edges], "src_id string, dst_id string, etype string, first_seen long, last_seen long")
    got = centrality.components(spark.createDataFrame([(n,) for n in nodes], "node_id string"), df)
    assert {r.node_id: r.component for r in got.collect()} == _labels(nodes, edges)


def test_pagerank_and_risk_of_forty_rounds(spark, graph):
    nodes, edges = graph
    rank = _ranks(nodes, edges)
    got = {r.node_id: r.score for r in catalog.QUERIES["pagerank"](spark, SF).collect()}
    assert got == pytest.approx(rank, abs=2e-9)
    near, ring = {n: 0 for n, kind in nodes.items() if kind == "alert"}, None
    for hop in (1, 2, 3):
        ring = {y for a, b in edges for x, y in ((a, b), (b, a)) if near.get(x) == hop - 1} - set(near)
        near |= dict.fromkeys(ring, hop)
    top = max(rank.values())
    want = {n: 100 * min(1, 0.45 * rank[n] / top + 0.4 * (0.5 ** near[n] if n in near else 0) + 0.15 * centrality.KIND_WEIGHT.get(kind, 0.1)) for n, kind in nodes.items()}
    assert {r.node_id: r.score for r in catalog.QUERIES["risk"](spark, SF).collect()} == pytest.approx(want, abs=2e-6)
