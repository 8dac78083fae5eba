"""Exact deduplication by distributed MSD radix partitioning.

Documents are split by successive bytes of their UTF-8 text: a first digit of
``FIRST`` bytes, then digits ``GROWTH`` times as wide each round.  A group stops
being split when it holds one document or when its text has ended; all members
of an ended group are equal byte for byte, so no digest decides anything.

Each round is two plain shuffles.  The group sizes are a partial aggregate, so a
group with a third of the corpus costs one row per task; the rows are then
joined with the sizes of the groups of two or more, a sort-merge join whose hot
partitions adaptive execution splits.  Only members of groups that are still open carry the rest of
their text to the next round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import col

from watchfold.shared import Scratch

FIRST = 48
GROWTH = 8


def _verdicts(docs: DataFrame, id_col: str, text_col: str, whole: bool) -> tuple[DataFrame, DataFrame]:
    """The rows as first written, and a verdict for each of their row numbers.

    With ``whole``, the written rows hold all columns of ``docs`` as struct "doc".
    """
    scratch = Scratch(docs.sparkSession, "exact")
    text = F.encode(F.coalesce(col(text_col), F.lit("")), "UTF-8")
    doc = [F.struct("*").alias("doc")] if whole else []
    rows = docs.select(col(id_col).alias("id"), text.alias("rest"), *doc)
    rows = rows.select("id", F.monotonically_increasing_id().alias("row"), F.unhex(F.sha2("rest", 256)).alias("sha"),
                       F.lit(0).cast("long").alias("group"), "rest", *[d for d in rows.columns if d == "doc"])
    first = scratch.write("level0", rows)
    open_rows, digit, done, level = first.drop("doc"), FIRST, [], 0
    while True:
        keyed = open_rows.select("*", F.substring("rest", 1, digit).alias("digit"))
        groups = keyed.groupBy("group", "digit").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("id", "row")).alias("top"))
        # Written, so that the join's exchanges stand alone and its hot partitions can be split.
        groups = scratch.write(f"groups{level}", groups.where("n > 1"))
        ended = F.length("rest") < digit
        alone = col("n").isNull()
        split = keyed.join(groups.hint("merge"), ["group", "digit"], "left").select(
            "id", "row", "sha", F.when(alone, col("row")).otherwise(col("top.row")).alias("group"),
            F.when(alone, col("id")).otherwise(col("top.id")).alias("keep_id"), F.coalesce("n", F.lit(1).cast("long")).alias("n"),
            (ended | alone).alias("done"), F.when(~ended & ~alone, F.expr(f"substring(rest, {digit + 1})")).alias("rest"))
        level += 1
        split = scratch.write(f"level{level}", split)
        if level == 1 and not whole:
            scratch.drop("level0")
        done.append(split.where("done"))
        open_rows = split.where("not done").select("id", "row", "sha", "group", "rest")
        if open_rows.isEmpty():
            break
        digit *= GROWTH
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return first, out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Nulls: a null text equals the empty text; a null id sorts below every other
    id, and keep_id is null only where all ids of a group are null.  Repeated
    rows: of rows that share both text and largest id exactly one is kept.
    Empty table: empty result.  Other columns are ignored, whatever their names.
    """
    _, verdicts = _verdicts(docs, id_col, text_col, whole=False)
    return verdicts.select(
        col("id").alias("doc_id"), "keep_id", col("n").alias("group_size"),
        (col("row") == col("group")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with all their columns."""
    first, verdicts = _verdicts(docs, id_col, text_col, whole=True)
    kept = verdicts.where(col("row") == col("group")).select("row")
    return first.select("row", "doc").join(kept, "row", "left_semi").select("doc.*")
