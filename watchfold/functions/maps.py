"""Maps from lists of (k, v) entries whose keys may repeat."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def first_wins(entries: Column) -> Column:
    """A map of the entries with a value; of equal keys the first stays.

    The entries are read three times, and where a key repeats anew for each of them, so
    they should be a column, not a long expression.
    """
    kept = F.filter(entries, lambda e: e.isNotNull() & e["k"].isNotNull() & e["v"].isNotNull())
    keys = F.transform(kept, lambda e: e["k"])
    firsts = F.map_from_entries(F.filter(kept, lambda e, i: F.array_position(keys, e["k"]) == i + 1))
    return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.map_from_entries(kept)).otherwise(firsts)


def last_wins(entries: Column) -> Column:
    return first_wins(F.reverse(entries))


def entry(key, value: Column) -> Column:
    return F.struct((F.lit(key) if isinstance(key, str) else key).alias("k"), value.alias("v"))
