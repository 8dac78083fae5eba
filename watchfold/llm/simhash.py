"""SimHash near-deduplication with BK-trees.

Fingerprints are 64-bit SimHashes of word shingles.  Two link at ``RADIUS`` or
fewer differing bits.  Of 64 bits in four bands, two such fingerprints agree in
one band at least, so all fingerprints that share a band's value form one shard,
and each shard gets a BK-tree: a node's children are keyed by their integer
Hamming distance to it, and a search at distance d follows only the edges
d - RADIUS to d + RADIUS.

Shard trees are dealt to the tasks that search them by the shuffle on (band,
value) instead of being broadcast whole: the trees together grow with the corpus
and have no size bound.  A crowded shard is told by a count per band value, a
table of at most 4 * 65,536 rows (the bound that lets it be broadcast); it is
divided once more by four bands of its other 48 bits, which again lose no link.
Exact copies share a fingerprint and enter a tree once; a shard returns only a
spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import col

from watchfold.operators.components import connected_components
from watchfold.shared import Scratch

SEED = 42
WORDS = 3
RADIUS = 3
BAND_BITS = 16
SUB_BITS = 12
CROWDED = 2048
#: Rows of a shard block that are searched at a time; whole shards only.
BLOCK = 200_000
#: Probes whose search frontier is held at a time.
PROBES = 20_000


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """The SimHash of one text's word shingles, repeats included; 0 without words."""
    tokens = text.lower().split()
    n = len(tokens)
    if n == 0:
        return 0
    joined = b" ".join(tokens)
    if n <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    starts = [0, *accumulate(len(t) + 1 for t in tokens)]
    hashed = xxhash.xxh64_intdigest
    ones, shingles = np.zeros(64, np.int64), n - words + 1
    for at in range(0, shingles, 65_536):
        to = min(shingles, at + 65_536)
        h = np.array([hashed(joined[a:b - 1], SEED) for a, b in zip(starts[at:to], starts[at + words:to + words])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > shingles, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a long."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t or b"", words) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(col(id_col).alias("doc_id"), col(text_col).cast("binary").alias("text")).mapInArrow(
        run, f"doc_id {kind}, fp long")


def build_forest(shard: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """BK-trees of all shards at once, a level each round.

    Returns every node's key parent * 65 + distance; a root's is negative.
    shard: numbers from 0 for each row; the fingerprints of a shard differ.
    """
    key = -1 - shard.astype(np.int64)
    group, rest = key.copy(), np.arange(len(fp))
    while len(rest):
        rest = rest[np.argsort(group[rest], kind="stable")]
        g = group[rest]
        first = np.r_[True, g[1:] != g[:-1]]
        heads = rest[first]
        key[heads] = g[first]
        head = heads[np.cumsum(first) - 1][~first]
        rest = rest[~first]
        group[rest] = head * 65 + np.bitwise_count(fp[rest] ^ fp[head])
    return key


def search_forest(shard: np.ndarray, fp: np.ndarray, key: np.ndarray, radius: int = RADIUS, parts: list[np.ndarray] | None = None):
    """Pairs of rows (probe, node) at most ``radius`` bits apart in one shard: each once, or all of the probes in ``parts``, a part at a time."""
    order = np.argsort(key)
    edges = key[order]
    roots = np.zeros(int(shard.max()) + 1, np.int64)
    is_root = key < 0
    roots[shard[is_root]] = np.flatnonzero(is_root)
    every = parts is None
    for probe in (np.arange(at, min(len(fp), at + PROBES)) for at in range(0, len(fp), PROBES)) if every else parts:
        node = roots[shard[probe]]
        while len(probe):
            d = np.bitwise_count(fp[probe] ^ fp[node]).astype(np.int64)
            hit = (d <= radius) & (probe < node if every else probe != node)
            if hit.any():
                yield probe[hit], node[hit]
            low = np.searchsorted(edges, node * 65 + np.maximum(d - radius, 1))
            n = np.searchsorted(edges, node * 65 + np.minimum(d + radius, 64), "right") - low
            at_child = np.repeat(low - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            probe, node = np.repeat(probe, n), order[at_child]


def spanning_forest(n: int, pairs) -> tuple[np.ndarray, np.ndarray]:
    """Of each component of rows 0..n-1: its members but the smallest, and the smallest for each."""
    label = np.arange(n)
    for a, b in pairs:
        while True:
            low = np.minimum(label[a], label[b])
            if (label[a] == low).all() and (label[b] == low).all():
                break
            np.minimum.at(label, label[a], low)
            np.minimum.at(label, label[b], low)
            while (jumped := label[label] != label).any():
                label[jumped] = label[label[jumped]]
    member = np.flatnonzero(label != np.arange(n))
    return member, label[member]


def _link_block(shard_cols: np.ndarray, fp: np.ndarray, radius: int):
    """Links of a block of whole shards; shard_cols: rows of (band, value, sub, subvalue), sorted."""
    new = np.r_[True, (shard_cols[1:] != shard_cols[:-1]).any(axis=1)]
    shard = np.cumsum(new) - 1
    crowd = np.bincount(shard)[shard] > 1  # a lone fingerprint has no link here
    if not crowd.any():
        return fp[:0], fp[:0]
    fp, shard = fp[crowd], np.unique(shard[crowd], return_inverse=True)[1]
    member, root = spanning_forest(len(fp), search_forest(shard, fp, build_forest(shard, fp), radius))
    return fp[member], fp[root]


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): edges that join just what the links between these distinct fingerprints join."""
    band = lambda bits, at, of: F.shiftrightunsigned(of, bits * at).bitwiseAND((1 << bits) - 1)
    banded = distinct.select("fp", F.explode(F.array(*(
        F.struct(F.lit(k).alias("band"), band(BAND_BITS, k, col("fp")).alias("value")) for k in range(4)))).alias("s"))
    banded = banded.select("fp", "s.band", "s.value")
    crowded = banded.groupBy("band", "value").count().where(col("count") > CROWDED).select("band", "value", F.lit(True).alias("crowded"))
    # The 48 bits beside the band, as one number, in four parts.
    low = F.expr("fp & (shiftleft(1L, 16 * band) - 1)")
    high = F.expr("CASE WHEN band = 3 THEN 0L ELSE shiftleft(shiftrightunsigned(fp, 16 * band + 16), 16 * band) END")
    other = low.bitwiseOR(high)
    parts = F.when(col("crowded"), F.array(*(
        F.struct(F.lit(j).alias("sub"), band(SUB_BITS, j, other).alias("subvalue")) for j in range(4)))).otherwise(
        F.array(F.struct(F.lit(-1).alias("sub"), F.lit(0).cast("long").alias("subvalue"))))
    keyed = banded.join(F.broadcast(crowded), ["band", "value"], "left").select("band", "value", F.explode(parts).alias("p"), "fp")
    keys = ["band", "value", "sub", "subvalue"]
    dealt = keyed.select("band", "value", "p.sub", "p.subvalue", "fp").repartition(*keys).sortWithinPartitions(*keys)

    def run(batches):
        held_keys, held_fp, rows = [], [], 0

        def flush(last):
            k, f = np.concatenate(held_keys), np.concatenate(held_fp)
            cut = len(f)
            if not last:  # the last shard may go on
                cut = int(np.flatnonzero(np.r_[True, (k[1:] != k[:-1]).any(axis=1)])[-1])
            a, b = _link_block(k[:cut], f[:cut], radius)
            held_keys[:], held_fp[:] = [k[cut:]], [f[cut:]]
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for b in batches:
            held_keys.append(np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)], axis=1))
            held_fp.append(b.column(4).to_numpy(zero_copy_only=False).view(np.uint64))
            rows += b.num_rows
            if rows >= BLOCK:
                yield flush(False)
                rows = len(held_fp[0])
        if held_fp:
            yield flush(True)

    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id that links reach, its own included.
    Nulls: a null text is empty (fingerprint zero, linked like any other); a null
    id gets a row, and component_id is null only where no member has an id.
    Repeated rows get a row each.  Empty table: empty result.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.write("prints", fingerprints(docs, id_col, text_col, words))
    distinct = scratch.write("distinct", prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    forest = scratch.write("links", links(distinct, radius))
    component = connected_components(forest, "a", "b").select(col("node").alias("fp"), col("component"))
    labelled = distinct.join(component, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    labelled = scratch.write("labelled", labelled)
    # Written, so that the join's exchanges stand alone and a large component's partition can be split.
    smallest = scratch.write("smallest", labelled.groupBy("component").agg(F.min("least").alias("component_id")))
    labelled = labelled.join(smallest.hint("merge"), "component").select("fp", "component_id")
    return prints.join(labelled.hint("merge"), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each component, with all its columns: that of the smallest id, which is null only where no member has one.

    Nulls: a null text is empty, linked like any other.  Of rows that repeat the
    smallest id the first written stays.  Empty table: empty result.
    """
    scratch = Scratch(docs.sparkSession, "kept")
    rows = scratch.write("rows", docs.select(F.struct(col(id_col).isNull().alias("none"), col(id_col).alias("id"), F.monotonically_increasing_id().alias("row")).alias("key"),
                                             col(text_col).alias("text"), F.struct("*").alias("doc")))
    kept = near_duplicates(rows, "key", "text").where(col("doc_id").eqNullSafe(col("component_id"))).select(col("doc_id.row").alias("kept"))
    return rows.join(kept, col("key.row") == col("kept"), "left_semi").select("doc.*")
