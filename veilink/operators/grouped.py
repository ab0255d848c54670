"""Pairs within blocks through groups of equal values: what depends on the values alone is computed once for each pair of values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of so many distinct values at most are compared all with all and broadcast; others are compared group by group.
FEW_VALUES = 256
#: Ids of a group in a row.
CHUNK = 4096


def tasks(spark: SparkSession) -> int:
    """Tasks for rows that few bytes expand to: adaptive execution would put them into one."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def chunked(ids: str, name: str, most: int = CHUNK) -> Column:
    """The list ``ids`` as rows of at most ``most`` of its entries."""
    return F.explode(F.expr(f"transform(sequence(0, greatest(0, (size({ids}) - 1) div {most})), i -> slice({ids}, i * {most} + 1, {most}))")).alias(name)


def group_pairs(rows: DataFrame, id_col: str, key: str, value: str, code: Callable[[Column], dict[str, Column]], scores: Callable[[str, str], dict[str, Column]]) -> DataFrame:
    """``ids1, ids2`` and the scores of every two groups of rows with equal key and value, in both orders and each with itself.

    ``code(value)`` names columns made of a value; ``scores(s, t)`` makes columns of two values' columns, which end in s and t (the
    value itself is ``v``). Null ids and keys pair with nothing; equal ids stay apart.
    """
    spark = rows.sparkSession
    groups = rows.filter(F.col(id_col).isNotNull()).groupBy(F.col(key).alias("key"), F.col(value).alias("v")).agg(F.collect_list(id_col).alias("ids"))
    groups = groups.select("key", "v", chunked("ids", "ids"))
    values = rows.select(F.col(value).alias("v")).distinct()

    def side(df: DataFrame, s: str, coded: bool) -> DataFrame:
        made = df.select("*", *(c.alias(n) for n, c in code(F.col("v")).items())) if coded else df
        return made.withColumnsRenamed({c: f"{c}{s}" for c in made.columns if c != "key"})

    named = [c.alias(n) for n, c in scores("1", "2").items()]
    few = values.limit(FEW_VALUES + 1).count() <= FEW_VALUES
    n = tasks(spark)
    pairs = side(groups.repartition(n, "key"), "1", not few).join(side(groups, "2", not few), "key")
    if not few:
        return pairs.select("ids1", "ids2", *named)
    table = side(values, "1", True).crossJoin(side(values, "2", True)).repartition(n)
    table = table.select(F.col("v1").alias("__v1"), F.col("v2").alias("__v2"), *named)
    both = pairs.join(F.broadcast(table), F.col("v1").eqNullSafe(F.col("__v1")) & F.col("v2").eqNullSafe(F.col("__v2")))
    return both.select("ids1", "ids2", *scores("1", "2"))


def expanded(pairs: DataFrame, ordered: bool = True) -> DataFrame:
    """``id1, id2`` and the other columns of all rows of the groups; ``ordered``: where id1 < id2."""
    rest = [c for c in pairs.columns if c not in ("ids1", "ids2")]
    each = pairs.select(F.explode("ids1").alias("id1"), "ids2", *rest).select("id1", F.explode("ids2").alias("id2"), *rest)
    return each.filter("id1 < id2") if ordered else each


def counted(pairs: DataFrame) -> DataFrame:
    """The other columns of ``expanded(pairs)``, with the number ``n`` of its rows that have them.

    Of two groups, one order or the other has a pair of ids, unless the ids are equal; so groups are counted, not their pairs, where
    no id is in both. Needs scores that do not depend on the order of two groups.
    """
    rest = [c for c in pairs.columns if c not in ("ids1", "ids2")]
    sizes = F.size("ids1").cast("long") * F.size("ids2") - F.size(F.array_intersect("ids1", "ids2"))
    plain = (F.size(F.array_distinct("ids1")) == F.size("ids1")) & (F.size(F.array_distinct("ids2")) == F.size("ids2"))
    equal = F.expr("aggregate(ids1, 0L, (s, x) -> s + size(filter(ids2, y -> y = x)))")
    both = F.when(plain, sizes).otherwise(F.size("ids1").cast("long") * F.size("ids2") - equal)
    # each pair of ids is met in both orders
    return pairs.select(*rest, both.alias("n")).groupBy(*rest).agg((F.sum("n") / 2).cast("long").alias("n")).filter("n > 0")
