"""q-gram sets as array Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pads of the two encoders: control character 1 for attribute encodings, '$' for concatenated records.
ATTRIBUTE_PAD, RECORD_PAD = "\x01", "$"


def qgram_list(value: Column, q: int = 2, pad: str | None = None) -> Column:
    """All q-grams in order, repeats kept; null and too short values give an empty array."""
    if pad is not None:
        edge = F.lit(pad * (q - 1))
        value = F.concat(edge, value, edge)
    n = F.length(value)
    return F.when(n >= q, F.transform(F.sequence(F.lit(1), n - (q - 1)), lambda i: F.substring(value, i, F.lit(q)))).otherwise(F.array().cast("array<string>"))


def qgram_set(value: Column, q: int = 2, pad: str | None = None) -> Column:
    return F.array_distinct(qgram_list(value, q, pad))


def attribute_qgrams(values: list[Column], q: int = 2, pad: str | None = None) -> Column:
    """Union of the stripped attributes' q-gram sets; nulls count as empty."""
    return F.array_distinct(F.flatten(F.array(*[qgram_list(F.trim(F.coalesce(v, F.lit(""))), q, pad) for v in values])))


def node_key(qgrams: Column) -> Column:
    """Key of a q-gram set: the sorted set, joined."""
    return F.array_join(F.array_sort(qgrams), "|")


def padded_count(n: Column, q: int = 2) -> Column:
    """Number of q-grams of a padded string of length n."""
    return n + (q - 1)
