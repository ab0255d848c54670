"""From two record tables to a comparison matrix: one lazy plan with one exchange on the block key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions.qgrams import qgram_set
from ..operators.blocking import candidate_pairs, prefix_blocks
from ..operators.compare import compare_all, compare_pairs, with_gold
from ..operators.encode import encrypt
from ..operators.grouped import group_pairs


def similarity_matrix(a: DataFrame, b: DataFrame, gold: DataFrame, id_col: str, columns: list[str], block_columns: list[str] | None, prefix: int, m: int, q: int = 2, only_gold: bool = False) -> DataFrame:
    """Encode both tables before they meet, pair them by block key, compare, and label by gold. No block columns: all pairs."""
    ea, eb = (encrypt(t, id_col, columns, m, q) for t in (a, b))
    if not block_columns:
        return compare_all(ea, eb, gold, m)
    pairs = candidate_pairs(prefix_blocks(a, block_columns, prefix), prefix_blocks(b, block_columns, prefix), id_col, id_col)
    return compare_pairs(pairs, ea, eb, gold, m, only_gold)


def matrices(a: DataFrame, b: DataFrame, gold: DataFrame, id_col: str, attribute_sets: dict[str, list[str]], block_columns: list[str], prefixes: list[int], m: int) -> dict[tuple[str, int | None], DataFrame]:
    """A matrix for each attribute set and block key length."""
    return {(name, n): similarity_matrix(a, b, gold, id_col, columns, block_columns, n, m) for name, columns in attribute_sets.items() for n in prefixes}


def qgram_matrix(a: DataFrame, b: DataFrame, id_col: str, value: str, key: str, q: int = 2) -> DataFrame:
    """``id1, id2, dice, jaccard, overlap, is_match`` of q-gram sets within equal keys; matches have equal values."""
    side = lambda t, s: t.select(F.col(id_col).alias(f"id{s}"), key, F.col(value).alias(f"v{s}"), qgram_set(F.col(value), q).alias(f"q{s}"))
    x = side(a, 1).join(side(b, 2), key)
    h, na, nb = F.size(F.array_intersect("q1", "q2")), F.size("q1"), F.size("q2")
    return x.select("id1", "id2", S.dice(h, na, nb).alias("dice"), S.jaccard(h, na, nb).alias("jaccard"), S.overlap(h, na, nb).alias("overlap"), (F.col("v1") == F.col("v2")).cast("int").alias("is_match"))


def qgram_groups(rows: DataFrame, id_col: str, value: str, key: str, q: int = 2) -> DataFrame:
    """``qgram_matrix`` of a table with itself, for groups of rows with equal key and value: ``ids1, ids2`` instead of ``id1, id2``."""

    def scores(a: str, b: str) -> dict:
        h, na, nb = F.size(F.array_intersect(f"q{a}", f"q{b}")), F.size(f"q{a}"), F.size(f"q{b}")
        return {"dice": S.dice(h, na, nb), "jaccard": S.jaccard(h, na, nb), "overlap": S.overlap(h, na, nb), "is_match": (F.col(f"v{a}") == F.col(f"v{b}")).cast("int")}

    return group_pairs(rows, id_col, key, value, lambda v: {"q": qgram_set(v, q)}, scores)


__all__ = ["matrices", "qgram_groups", "qgram_matrix", "similarity_matrix", "with_gold"]
