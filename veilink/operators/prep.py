"""Preparing linkage data: cleaning, splitting, profiling, sampling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import missing_to_null
from .graph import cut


def fill_nulls(df: DataFrame, value: str = "") -> DataFrame:
    """All columns as strings, nulls replaced."""
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit(value)).alias(c) for c in df.columns])


def at_positions(df: DataFrame, positions: list[int]) -> DataFrame:
    return df.select(*[df.columns[i] for i in positions])


def last_to_front(df: DataFrame, name: str = "id") -> DataFrame:
    *rest, last = df.columns
    return df.select(F.col(last).alias(name), *rest)


def split_labelled_pairs(df: DataFrame, id1: str, id2: str, attrs1: dict[str, str], attrs2: dict[str, str], label: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(left records, right records, gold) of a table of wide labelled pairs; attrs map columns to record columns."""
    left = df.select(F.col(id1).alias("id"), *[F.col(c).alias(n) for c, n in attrs1.items()])
    right = df.select(F.col(id2).alias("id"), *[F.col(c).alias(n) for c, n in attrs2.items()])
    gold = df.filter(F.col(label).cast("int") == 1).select(F.col(id1).alias("id1"), F.col(id2).alias("id2"))
    return left, right, gold


def recode_gold(df: DataFrame, tag: str = "tag") -> DataFrame:
    """Tag 3 goes; 1 and 2 become 1, larger ones 0."""
    return df.filter(F.col(tag) != 3).withColumn("is_match", F.when(F.col(tag).isin(1, 2), 1).otherwise(0))


def without_ids(df: DataFrame, ids: DataFrame, column: str, id_col: str = "id") -> DataFrame:
    return df.join(ids.select(F.col(id_col).alias(column)).distinct(), column, "left_anti")


def with_ids(df: DataFrame, ids: DataFrame, column: str, id_col: str = "id") -> DataFrame:
    return df.join(ids.select(F.col(id_col).alias(column)).distinct(), column, "left_semi")


def first_per_key(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def last_duplicates(gold: DataFrame, key: str, other: str, order: str) -> DataFrame:
    """``key, other``: of each key with several rows, the last one's other id: the ones to remove."""
    return gold.groupBy(key).agg(F.max_by(other, order).alias(other), F.count(F.lit(1)).alias("__n")).filter("__n > 1").drop("__n")


def duplicate_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key column: ``key, duplicates``, the number of rows whose value occurs more than once."""
    out = None
    for k in keys:
        own = df.groupBy(F.col(k).cast("string").alias("v")).count().agg(F.coalesce(F.sum(F.when(F.col("count") > 1, F.col("count"))), F.lit(0)).cast("long").alias("duplicates")).select(F.lit(k).alias("key"), "duplicates")
        out = own if out is None else out.unionByName(own)
    return out


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: ``variable, count, unique, top, freq, missing``; ties of the top value go to the smallest one."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "variable", "value")
    counts = long.groupBy("variable", "value").agg(F.count(F.lit(1)).alias("n"))
    named = F.when(F.col("value").isNotNull(), F.struct((-F.col("n")).alias("m"), "value"))
    return counts.groupBy("variable").agg(
        F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("count"), F.count("value").alias("unique"),
        F.min(named).alias("best"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("missing"),
    ).select("variable", "count", "unique", F.col("best.value").alias("top"), (-F.col("best.m")).alias("freq"), "missing")


def missing_and_unique(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: ``variable, missing, unique``, 'nan' and '' counting as missing."""
    long = df.select(*[missing_to_null(F.col(c).cast("string")).alias(c) for c in columns]).unpivot([], columns, "variable", "value")
    return long.groupBy("variable").agg(F.count_if(F.col("value").isNull()).alias("missing"), F.count_distinct("value").alias("unique"))


def unique_ratio(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per feature: distinct values over all values."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "variable", "value")
    return long.groupBy("variable").agg((F.count_distinct("value") / F.count("value")).alias("ratio"))


def divergences(a: DataFrame, b: DataFrame, key: str, columns: list[str], order: str) -> DataFrame:
    """Per column, in how many shared keys the two tables' first rows differ."""
    x, y = (first_per_key(t, [key], [order]).select(key, *[F.col(c).alias(f"{s}_{c}") for c in columns]) for t, s in ((a, "a"), (b, "b")))
    differs = [(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))).cast("long").alias(c) for c in columns]
    return x.join(y, key).select(*differs).agg(*[F.sum(c).alias(c) for c in columns]).unpivot([], columns, "variable", "different")


def multiplicity(df: DataFrame, columns: list[str]) -> DataFrame:
    """``times, records``: how many attribute lists occur so many times."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("times")).groupBy("times").agg(F.count(F.lit(1)).alias("records"))


def max_record_length(df: DataFrame, columns: list[str]) -> DataFrame:
    """Sum over columns of the longest value's length."""
    return df.agg(sum((F.coalesce(F.max(F.length(c)), F.lit(0)) for c in columns[1:]), F.coalesce(F.max(F.length(columns[0])), F.lit(0))).cast("long").alias("max_length"))


def in_hash_order(id_col: str, seed: str) -> list[Column]:
    """A reproducible random order that SQL can repeat: by the MD5 of id and seed, then the id."""
    return [F.md5(F.concat(F.col(id_col).cast("string"), F.lit("|" + seed)).cast("binary")), F.col(id_col)]


def sample_ids(df: DataFrame, id_col: str, n: int, seed: str) -> DataFrame:
    return df.select(id_col).distinct().orderBy(*in_hash_order(id_col, seed)).limit(n)


def linkage_sample(a: DataFrame, b: DataFrame, id_col: str, n: int, share: float, seed: str = "s", only_from_both: bool = False) -> DataFrame:
    """``side, id``: n * share common ids on both sides, and n * (1 - share) ids of each side that are not common.

    only_from_both: non-matches of both sides are drawn from the ids of either table alone.
    """
    ia, ib = a.select(id_col).distinct(), b.select(id_col).distinct()
    common = sample_ids(ia.intersect(ib), id_col, round(n * share), seed)
    rest, only_a, only_b = n - round(n * share), ia.subtract(ib), ib.subtract(ia)
    pool_a, pool_b = (only_a.unionByName(only_b),) * 2 if only_from_both else (only_a, only_b)
    left, right = common.unionByName(sample_ids(pool_a, id_col, rest, seed + "a")), common.unionByName(sample_ids(pool_b, id_col, rest, seed + "b"))
    return left.select(F.lit("a").alias("side"), id_col).unionByName(right.select(F.lit("b").alias("side"), id_col))


def gold_of(common: DataFrame, id_col: str) -> DataFrame:
    return common.select(F.col(id_col).alias("id1"), F.col(id_col).alias("id2"))


def hash_split(df: DataFrame, id_col: str, share: float, seed: str = "t") -> tuple[DataFrame, DataFrame]:
    """(train, test) by a hash of the id: the same on every run."""
    part = F.conv(F.substring(F.md5(F.concat(F.col(id_col).cast("string"), F.lit("|" + seed)).cast("binary")), 1, 7), 16, 10).cast("long") < int(share * 16**7)
    return df.filter(part), df.filter(~part)


def populate(a: DataFrame, b: DataFrame, sample: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(left records, right records, gold) of a sample as ``linkage_sample`` draws it; gold has the ids that both sides hold."""
    side = lambda name: sample.filter(F.col("side") == name).select(id_col)
    left, right = side("a"), side("b")
    return a.join(left, id_col, "left_semi"), b.join(right, id_col, "left_semi"), gold_of(left.intersect(right), id_col)


def quality_report(a: DataFrame, b: DataFrame, gold: DataFrame, columns: list[str]) -> DataFrame:
    """``side, variable, count, unique, top, freq, missing``: profiles of both tables and of the gold standard's ids."""
    parts = [profile(t, c).select(F.lit(name).alias("side"), "*") for name, t, c in (("a", a, columns), ("b", b, columns), ("gold", gold, ["id1", "id2"]))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def save_all(a: DataFrame, b: DataFrame, gold: DataFrame, columns: list[str], path: str) -> None:
    """A linkage set without nulls, with a profile of each side."""
    from ..sources.sinks import save_linkage_set

    save_linkage_set(fill_nulls(a), fill_nulls(b), gold, {"stats_a": profile(a, columns), "stats_b": profile(b, columns)}, path)


def first_rows(df: DataFrame, order: list[Column], ties: list[str], n: int) -> DataFrame:
    """The first n rows by ``order`` (one column), then ``ties``, where n may be a share of all rows: no task sorts them all.

    Rows are range-partitioned in this order, so whole ranges before the n-th row stay, and only the range that holds it is ranked.
    """
    by = [*order, *ties]
    ranged = cut(df.repartitionByRange(*by).withColumn("__range", F.spark_partition_id()))  # ranges are drawn by sampling, so once
    counts = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    upto = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range: as many as partitions
    before = counts.select("__range", F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__before"))
    at = Window.partitionBy("__range").orderBy(*by)
    ranked = ranged.withColumn("__at", F.row_number().over(at)).join(F.broadcast(before), "__range")
    return ranked.filter(F.col("__before") + F.col("__at") <= n).drop("__range", "__at", "__before")


def first_by_values(df: DataFrame, order: list[tuple[str, bool]], n: int, counts: DataFrame | None = None) -> DataFrame:
    """The first n rows by columns (name, whether falling), nulls where Spark's order has them: no row is sorted or written.

    The values of the first column are counted; rows before the value that holds the n-th row stay, and among those that have it the next
    column decides. Fits first columns of few values next to the rows, such as scores of small sets or the first digits of a hash.
    ``counts`` (the first column, ``n``) saves the first count.
    """
    stay, same, left = F.lit(False), F.lit(True), n
    for i, (name, falling) in enumerate(order):
        c = F.col(name)
        found = counts if i == 0 and counts is not None else df.filter(same).groupBy(name).agg(F.count(F.lit(1)).alias("n"))
        border = _border(found, c.desc() if falling else c.asc(), left)
        if border is None:  # there are no more than n rows
            return df.filter(stay | same)
        value, before, own = border
        if falling:
            ahead = c.isNotNull() if value is None else c > F.lit(value)
        else:
            ahead = F.lit(False) if value is None else c.isNull() | (c < F.lit(value))
        stay, same, left = stay | (same & F.coalesce(ahead, F.lit(False))), same & c.eqNullSafe(F.lit(value)), left - before
        if left in (0, own):
            return df.filter(stay | same if left else stay)
    return df.filter(stay).unionByName(df.filter(same).limit(left))  # equal in all columns


def _border(counts: DataFrame, order: Column, n: int):
    """(value, rows before it, its rows) where the n-th row of these counted values lies; None where there are fewer."""
    name = counts.columns[0]
    ranged = cut(counts.repartitionByRange(order).withColumn("__range", F.spark_partition_id()))
    before = 0
    for r in ranged.groupBy("__range").agg(F.sum("n").alias("n")).orderBy("__range").collect():  # as many as partitions
        if before + r["n"] > n:
            upto = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
            at = ranged.filter(F.col("__range") == r["__range"]).withColumn("__upto", F.sum("n").over(upto))
            x = at.filter(F.col("__upto") > n - before).orderBy(order).first()
            return x[name], before + x["__upto"] - x["n"], x["n"]
        before += r["n"]
    return None


def first_by_hash(df: DataFrame, id_col: str, n: int, seed: str) -> DataFrame:
    """The first n rows in the order of ``in_hash_order``."""
    keyed = df.withColumn("__h", in_hash_order(id_col, seed)[0]).withColumn("__first", F.substring("__h", 1, 4))
    return first_by_values(keyed, [("__first", False), ("__h", False), (id_col, False)], n).drop("__h", "__first")


def first_counted_by_hash(df: DataFrame, id_col: str, n: int, total: int, columns: list[str], seed: str) -> DataFrame:
    """``columns, n``: the rows of ``first_by_hash``, counted; ``df`` has ``total`` rows. No row but a few is kept, and each is hashed once.

    Hashes are even, so the n-th lies near the share n / total of their range: what comes before a window around it is only counted, and
    the window's rows are ranked. If the n-th lies elsewhere all the same, rows are found as ``first_by_hash`` finds them.
    """
    h, share = F.col("__h"), n / max(total, 1)
    spread = 12 * math.sqrt(max(share * (1 - share), 0.0) / max(total, 1)) + 64 / max(total, 1)
    border = lambda x: f"{int(x * 2**32):08x}" if x < 1 else "g"  # noqa: E731  no digit is as large as g
    low, high = border(max(0.0, share - spread)), border(min(1.0, share + spread))
    near = h >= low
    keyed = df.select(*columns, id_col, in_hash_order(id_col, seed)[0].alias("__h")).filter(h < high)
    found = cut(keyed.groupBy(*columns, F.when(near, h).alias("__h"), F.when(near, F.col(id_col)).alias(id_col)).agg(F.count(F.lit(1)).alias("n")))
    before, inside = (x or 0 for x in found.agg(F.sum(F.when(h.isNull(), F.col("n"))), F.sum(F.when(h.isNotNull(), F.col("n")))).first())
    if n < before or n > before + inside:
        return first_by_hash(df, id_col, n, seed).groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    rows = found.filter(h.isNotNull()).withColumn("n", F.explode(F.expr("array_repeat(1L, cast(n AS int))")))
    rest = first_by_values(rows, [("__h", False), (id_col, False)], n - before)
    return found.filter(h.isNull()).select(*columns, "n").unionByName(rest.select(*columns, "n")).groupBy(*columns).agg(F.sum("n").alias("n"))
