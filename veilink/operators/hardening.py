"""Markov-chain hardening: q-grams that a language model adds to a set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.qgrams import qgram_list


def transitions(df: DataFrame, value: str, q: int = 2, pad: str | None = None) -> DataFrame:
    """``q1, q2, cnt, prob, rnk``: how often one q-gram follows another, its share, and its rank (ties by q2)."""
    grams = df.select(qgram_list(F.col(value), q, pad).alias("g")).filter(F.size("g") > 1)
    steps = grams.select(F.explode(F.expr("transform(sequence(1, size(g) - 1), i -> struct(g[i - 1] AS q1, g[i] AS q2))")).alias("s")).select("s.*")
    counts = steps.groupBy("q1", "q2").agg(F.count(F.lit(1)).alias("cnt"))
    return counts.withColumn("prob", F.col("cnt") / F.sum("cnt").over(Window.partitionBy("q1"))).withColumn(
        "rnk", F.row_number().over(Window.partitionBy("q1").orderBy(F.desc("cnt"), "q2"))
    )


def expand(sets: DataFrame, id_col: str, qgrams: str, model: DataFrame, chain: int = 2, mode: str = "freq", seed: int = 0) -> DataFrame:
    """``id, extra``: q-grams that the model adds. 'freq' takes the ``chain`` likeliest successors of each, 'prob' draws that many
    times from its successors, by a hash of q-gram, draw and seed."""
    each = sets.select(F.col(id_col).alias("id"), F.explode(qgrams).alias("q1"))
    if mode == "freq":
        found = each.join(model.filter(F.col("rnk") <= chain), "q1").select("id", "q2")
    else:
        upto = Window.partitionBy("q1").orderBy("rnk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ranges = model.withColumn("hi", F.sum("prob").over(upto)).withColumn("lo", F.col("hi") - F.col("prob"))
        draws = each.select("q1").distinct().select("q1", F.explode(F.sequence(F.lit(1), F.lit(chain))).alias("draw"))
        draws = draws.withColumn("u", F.pmod(F.xxhash64("q1", "draw", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30))
        chosen = draws.join(ranges, "q1").filter("u >= lo AND u < hi").select("q1", "q2").distinct()
        found = each.join(chosen, "q1").select("id", "q2")
    gathered = found.groupBy("id").agg(F.array_sort(F.collect_set("q2")).alias("extra"))
    return sets.select(F.col(id_col).alias("id")).join(gathered, "id", "left").select("id", F.coalesce("extra", F.array().cast("array<string>")).alias("extra"))
