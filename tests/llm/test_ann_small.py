import numpy as np
import pytest

from watchfold.llm import ann


def _recall(spark, x, partitions, asked=range(5)):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(partitions)
    got = ann.nearest(df, df.where(df.vec_id.isin(list(asked)))).collect()
    hits, k = 0, min(10, len(x) - 1)
    for q in asked:
        own = [r.vec_id for r in got if r.query_id == q]
        assert len(own) == k
        d = ((x.astype(np.float64) - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hits += np.isin(own, np.argsort(d)[:k]).sum()
    return hits / (len(asked) * k)


@pytest.mark.parametrize("n", [5, 11, 30, 58, 100])
def test_small_tables_give_all_neighbours(spark, n):
    x = np.random.default_rng(n).normal(size=(n, 16)).astype(np.float32)
    assert _recall(spark, x, 1) == 1


def test_small_partitions_give_all_neighbours(spark):
    x = np.random.default_rng(1).normal(size=(300, 16)).astype(np.float32)
    x[1:5] = x[0] + 1e-4 * x[1:5]
    assert _recall(spark, x, 40) == 1


@pytest.mark.parametrize("enough", [0.001, 1.1])
def test_a_large_shard_holds_k_others(enough):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 16)).astype(np.float32)
    x[1:5] = x[0] + 1e-4 * x[1:5]
    planes, centre = ann._planes(16), x.mean(axis=0)
    forest = ann.Forest.build(x, planes, centre)
    rows = next(forest.candidates(ann.hash_strings(x[:1], planes, centre), enough, 10))
    assert len(np.setdiff1d(rows, [0])) >= 10


@pytest.mark.parametrize("shard, queries", [(700, 256), (2500, 3), (65_536, 256)])
def test_recall_over_shards_and_blocks(spark, monkeypatch, shard, queries):
    monkeypatch.setattr(ann, "SHARD", shard)
    monkeypatch.setattr(ann, "QUERIES", queries)
    x = np.random.default_rng(4).normal(size=(5000, 16)).astype(np.float32)
    assert _recall(spark, x, 4, range(0, 5000, 250)) >= 0.9


def test_doubles_stay_doubles(spark):
    x = np.random.default_rng(6).normal(size=(30, 4))
    x[1], x[2] = x[0] + 3e-12, x[0] + 1e-12  # nearer than floats can tell
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = sorted(ann.nearest(df, df.where("vec_id = 0")).collect(), key=lambda r: r["rank"])
    assert [r.vec_id for r in got[:2]] == [2, 1]
    assert [r.score for r in got] == sorted(np.sqrt(((x[1:] - x[0]) ** 2).sum(axis=1)).tolist())[:10]
