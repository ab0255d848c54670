"""Comparing encoded records: cross and candidate comparisons with a gold standard, and record text similarities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as S


def five_similarities(m: int, pa: str = "pos_a", pb: str = "pos_b") -> dict[str, Column]:
    """Dice, Jaccard, overlap, the Hamming coefficient and the entropy coefficient of two position lists."""
    h, a, b = F.size(F.array_intersect(pa, pb)), F.size(pa), F.size(pb)
    return {"dice": S.dice(h, a, b), "jaccard": S.jaccard(h, a, b), "overlap": S.overlap(h, a, b), "hamming": S.hamming_coefficient(h, a, b, m), "entropy": S.entropy_coefficient(a, b)}


def with_gold(pairs: DataFrame, gold: DataFrame, only_gold: bool = False) -> DataFrame:
    """``is_match``, 0 for pairs that gold doesn't list; repeated gold rows count once."""
    known = gold.select(F.col("id1"), F.col("id2"), F.lit(1).alias("__g")).distinct()
    return pairs.join(known, ["id1", "id2"], "inner" if only_gold else "left").withColumn("is_match", F.coalesce("__g", F.lit(0))).drop("__g")


def compare_pairs(pairs: DataFrame, a: DataFrame, b: DataFrame, gold: DataFrame, m: int, only_gold: bool = False) -> DataFrame:
    """The comparison matrix of candidate pairs (``id1, id2``); a and b are encoded (``id, positions``). Unknown ids drop out."""
    joined = pairs.join(a.select(F.col("id").alias("id1"), F.col("positions").alias("pos_a")), "id1").join(b.select(F.col("id").alias("id2"), F.col("positions").alias("pos_b")), "id2")
    scored = joined.select("id1", "id2", *[c.alias(n) for n, c in five_similarities(m).items()])
    return with_gold(scored, gold, only_gold)


def compare_all(a: DataFrame, b: DataFrame, gold: DataFrame, m: int) -> DataFrame:
    """The comparison matrix of all pairs, for small tables: quadratic by definition. Blocks are the way at scale."""
    pairs = a.select(F.col("id").alias("id1"), F.col("positions").alias("pos_a")).crossJoin(b.select(F.col("id").alias("id2"), F.col("positions").alias("pos_b")))
    return with_gold(pairs.select("id1", "id2", *[c.alias(n) for n, c in five_similarities(m).items()]), gold)


def comparison_stats(k: int, m: int, attributes: list[str], spark) -> DataFrame:
    return spark.createDataFrame([(k, m, 0, ",".join(attributes))], "n_hash int, bits int, cap int, atts string")


def text_similarity(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Adds to each pair ``text_similarities`` of two texts."""
    return pairs.withColumns(text_similarities(left, right))


def text_similarities(left: str, right: str) -> dict[str, Column]:
    """``hamming, jaccard, levenshtein, overlap, sorensen`` of two texts; characters count as multisets.

    Hamming counts differing places, and the longer text's rest, over the longer length.
    """
    x, y = F.coalesce(F.col(left), F.lit("")), F.coalesce(F.col(right), F.lit(""))
    nx, ny = F.length(x), F.length(y)
    longest = F.greatest(nx, ny)
    letters = F.filter(F.split(F.concat(x, y), ""), lambda c: c != "")
    times = lambda t, c: F.length(t) - F.length(F.replace(t, c, F.lit("")))
    both = F.aggregate(F.transform(F.array_distinct(letters), lambda c: F.least(times(x, c), times(y, c))), F.lit(0), lambda s, v: s + v)
    same = F.aggregate(F.zip_with(F.split(x, ""), F.split(y, ""), lambda a, b: F.coalesce((a == b) & (a != ""), F.lit(False)).cast("int")), F.lit(0), lambda s, v: s + v)
    share = lambda n, d: F.when(d > 0, n.cast("double") / d.cast("double")).otherwise(1.0)
    return {
        "hamming": share(same, longest), "jaccard": share(both, nx + ny - both), "levenshtein": share(longest - F.levenshtein(x, y), longest),
        "overlap": share(both, F.least(nx, ny)), "sorensen": share(2 * both, nx + ny),
    }


def entropy_ncd(pairs: DataFrame, left: str, right: str, name: str = "entropy_ncd") -> DataFrame:
    """Adds the ``entropy_distance`` of two texts."""
    return pairs.withColumn(name, entropy_distance(left, right))


def entropy_distance(left: str, right: str) -> Column:
    """1 - normalised compression distance, with 1 + character entropy as the compressed size (1 for an empty text)."""
    x, y = (F.coalesce(F.col(c), F.lit("")) for c in (left, right))

    def size(text: Column) -> Column:
        letters, n = F.filter(F.split(text, ""), lambda c: c != ""), F.length(text).cast("double")
        times = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
        return 1.0 + F.aggregate(F.transform(F.array_distinct(letters), lambda c: -times(c) * F.log2(times(c))), F.lit(0.0), lambda a, v: a + v)

    # the entropy of a concatenation does not depend on its order
    a, b = size(x), size(y)
    return 1.0 - (size(F.concat(x, y)) - F.least(a, b)) / F.greatest(a, b)
