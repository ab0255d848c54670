"""Bulk-synchronous best-fit packing of token sequences.

1. One scan tokenises the texts and stages a narrow row for each piece.
2. Pieces of equal length and open sequences with an equal gap are interchangeable, so the tables of the rounds hold runs:
   (length, number) and (gap, first sequence, number). Their rows follow the number of different lengths (at most ``capacity``)
   and of rounds, not of pieces.
3. A round sorts runs of both kinds into ``RANGES`` ranges of sizes. In each range a sweep goes from large to small, and every
   piece meets its successor, the smallest gap that is no shorter; where more pieces than gaps want the same gaps, the rank
   within the run decides. Gaps and pieces that find nothing in their range are carried to a last sweep over what all ranges left.
   Every gap takes one piece at most in a round. Gaps are then updated, and rounds repeat until nothing fits; the
   largest of the pieces left open as many sequences as their tokens need at least, and rounds go on.
4. The outcome is a table of rank intervals. Each piece finds its place by a distributed rank (very frequent lengths are
   counted in salted parts) and a join on length and bucket of ranks, so that a piece meets the few intervals of its bucket.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace, table, text_or_empty
from .tokens import byte_bpe

#: Up to so many rank intervals are broadcast (48 bytes each); beyond, they are joined by a shuffle.
BROADCAST_INTERVALS = 200_000
#: Ranges of sizes that are swept apart, and pieces of one length that are ranked in one part.
RANGES, PART_ROWS = 16, 1_000_000
#: Kinds of the rounds' rows.
GAP, PIECE, PLACED = 0, 1, 2
_RUN = "kind int, size long, n long, at long, low long, offset long, round int"


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece: all are full but the first."""
    first = length % capacity or min(length, capacity)
    starts = [0, *range(first, length, capacity)]
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], length])]


def _pieces(path: str, end_id: int, capacity: int, with_ids: bool):
    def run(batches):
        bpe = byte_bpe(path)
        for batch in batches:
            rows, out = [], [[] for _ in range(5)]
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = np.append(bpe.encode(text), np.uint32(end_id)).astype("<u4")
                for k, (a, n) in enumerate(cut(len(ids), capacity)):
                    blob = ids[a : a + n].tobytes()
                    rows.append(i)
                    for column, value in zip(out, (k, a, n, zlib.crc32(blob), blob)):
                        column.append(value)
            names = ["id", "piece", "start", "length", "ids_crc32", "ids"]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, t) for c, t in zip(out, kinds))]
            keep = 6 if with_ids else 5
            yield pa.RecordBatch.from_arrays(columns[:keep], names[:keep])

    return run


def _sweep(capacity: int, round_: int):
    """One sweep over runs sorted by range, falling size, gaps first: matched runs, gaps that took a piece, and what is left.

    ``at`` is a gap's first sequence, and the number of a length's pieces that are placed; ``low`` the first rank placed. A gap
    that took a piece in this round has its number in ``round`` and is not swept again in it.
    """

    def run(batches):
        out, stack, now = [], [], None
        for batch in batches:
            for part, kind, size, n, at, low, offset, seen in zip(*(batch.column(c).to_pylist() for c in ("part", "kind", "size", "n", "at", "low", "offset", "round"))):
                if part != now:
                    out += stack
                    stack, now = [], part
                if kind == GAP:
                    stack.append((GAP, size, n, at, low, offset, seen))
                    continue
                while n and stack:
                    _, gap, many, first, *rest = stack.pop()
                    m = min(n, many)
                    out += [(PLACED, size, m, first, at, capacity - gap, round_), (GAP, gap - size, m, first, 0, 0, round_)]
                    n, at = n - m, at + m
                    if m < many:
                        stack.append((GAP, gap, many - m, first + m, *rest))
                if n:
                    out.append((PIECE, size, n, at, low, offset, seen))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in out + stack], pa.int32() if i in (0, 6) else pa.int64()) for i in range(7)], ["kind", "size", "n", "at", "low", "offset", "round"]
        )

    return run


def _swept(runs: DataFrame, capacity: int, round_: int) -> DataFrame:
    """The runs after a round."""
    order = ["part", F.desc("size"), "kind"]
    part = F.floor(F.col("size") * RANGES / (capacity + 1)).cast("int").alias("part")
    open_ = (F.col("kind") == PIECE) | ((F.col("kind") == GAP) & (F.col("size") > 0))
    # no more tasks than ranges, however many partitions a shuffle has
    own = runs.filter(open_).withColumn("part", part).repartition("part").coalesce(RANGES).sortWithinPartitions(*order).mapInArrow(_sweep(capacity, round_), _RUN)
    free = (F.col("kind") == PIECE) | ((F.col("kind") == GAP) & (F.col("round") < round_))
    rest = own.filter(free).withColumn("part", F.lit(0)).repartition(1).sortWithinPartitions(*order).mapInArrow(_sweep(capacity, round_), _RUN)
    return runs.filter(F.col("kind") == PLACED).unionByName(own.filter(~free)).unionByName(rest)


def _opened(runs: DataFrame, capacity: int, need: int, sequences: int, round_: int) -> DataFrame:
    """The runs after the largest pieces opened ``need`` sequences, or, where it is 0, all that are longer than half of one."""
    pieces, falling = runs.filter(F.col("kind") == PIECE), Window.orderBy(F.desc("size"))  # a row for each length
    wanted = F.greatest(F.lit(0), F.least("n", F.lit(need) - F.col("before"))) if need else F.when(F.col("size") * 2 > capacity, F.col("n")).otherwise(0)
    before = F.coalesce(F.sum("n").over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = pieces.withColumn("before", before).withColumn("m", wanted.cast("long"))
    first = F.col("before") + sequences
    row = lambda kind, size, n, at, low: [F.lit(kind).alias("kind"), size.alias("size"), n.alias("n"), at.cast("long").alias("at"), low.cast("long").alias("low"), F.lit(0).cast("long").alias("offset"), F.lit(round_).alias("round")]
    new = own.filter("m > 0")
    size, m, none = F.col("size"), F.col("m"), F.lit(0)
    return (
        runs.filter(F.col("kind") != PIECE)
        .unionByName(new.select(*row(PLACED, size, m, first, F.col("at"))))
        .unionByName(new.select(*row(GAP, capacity - size, m, first, none)))
        .unionByName(own.filter("n > m").select(*row(PIECE, size, F.col("n") - m, F.col("at") + m, none)))
    )


def plan(counts: DataFrame, capacity: int, work: Workspace) -> DataFrame:
    """Intervals ``length, low, many, sequence, offset`` for ``counts`` (``length, n``): pieces ranked low to low + many - 1 of a
    length go to the sequences from ``sequence`` on, at ``offset``.

    The driver sees a few sums of each round.
    """
    zero = lambda name: F.lit(0).cast("long").alias(name)
    runs = work.stage(counts.select(F.lit(PIECE).alias("kind"), F.col("length").alias("size"), "n", zero("at"), zero("low"), zero("offset"), F.lit(0).alias("round")), "runs")
    is_piece, sequences, round_, moved = F.col("kind") == PIECE, 0, 0, False
    while True:
        left = runs.agg(
            F.sum(F.when(is_piece, F.col("size") * F.col("n"))).alias("tokens"), F.sum(F.when(is_piece & (F.col("size") * 2 > capacity), F.col("n"))).alias("large"),
            F.count_if((F.col("kind") == PLACED) & (F.col("round") == round_)).alias("moved"),
        ).first()
        if not left["tokens"]:
            return runs.filter(F.col("kind") == PLACED).select(F.col("size").alias("length"), "low", F.col("n").alias("many"), F.col("at").alias("sequence"), "offset")
        swept = runs
        if not round_ or not left["moved"]:
            need = 0 if left["large"] else -(-left["tokens"] // capacity)
            # opened in the round before, so that they take part in this one
            swept = _opened(runs, capacity, need, sequences, round_)
            sequences += left["large"] or need
        round_ += 1
        after = work.stage(_swept(swept, capacity, round_), "runs")
        work.drop(runs)
        runs = after


def best_fit_pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: ``<id_col>, piece, start, length, ids_crc32, sequence_id, offset`` and, on request, ``ids``.

    path: a tokenizers JSON file. A document's ids are followed by ``end_id``; only documents longer than
    ``capacity`` are cut. A null text counts as empty and gives the one id ``end_id``. Rows with null or repeated ids
    are documents of their own. Other columns are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "packing")
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    pieces = work.stage(texts.mapInArrow(_pieces(path, end_id, capacity, with_ids), schema).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    counts = work.stage(pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")), "counts")  # at most capacity rows
    slots = plan(counts, capacity, work)
    # buckets of ranks, about as many for each length as it has intervals
    widths = slots.groupBy("length").agg(F.count(F.lit(1)).alias("intervals")).join(counts, "length").select(
        "length", F.expr(f"int(n div {PART_ROWS}) + 1").alias("parts"), F.expr("n div intervals + 1").alias("width")
    )
    widths = work.stage(widths, "widths")
    salt = F.expr("pmod(xxhash64(uid), parts)").alias("salt")
    salted = pieces.join(F.broadcast(widths), "length").withColumn("salt", salt)
    sizes = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = work.stage(sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).select("length", "salt", "before"), "sizes")
    slots = work.stage(
        slots.join(widths, "length").withColumn("bucket", F.explode(F.expr("sequence(low div width, (low + many - 1) div width)"))).select("length", "bucket", "low", "many", "sequence", "offset"), "slots"
    )
    small = slots.count() <= BROADCAST_INTERVALS
    inside = Window.partitionBy("length", "salt").orderBy("uid")
    ranked = (salted.drop("ids") if with_ids else salted).withColumn("rank", F.row_number().over(inside)).join(F.broadcast(sizes) if sizes.count() <= BROADCAST_INTERVALS else sizes, ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("rank") - 1 + F.col("before")).withColumn("bucket", F.expr("rank div width"))
    placed = ranked.join(F.broadcast(slots) if small else slots, ["length", "bucket"]).filter("rank >= low AND rank < low + many")
    if with_ids:
        placed = placed.join(pieces.select("uid", "ids"), "uid")
    return placed.select(
        F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset", *["ids"] * with_ids
    )


def sequences(packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``sequence_id, n_tokens, doc_ids, ids`` (unsigned 32-bit, little-endian) from rows of ``best_fit_pack(with_ids=True)``."""
    part = F.struct("offset", F.col(id_col).alias("id"), "length", "ids")
    return packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("parts")).select(
        "sequence_id",
        F.expr("aggregate(parts, 0L, (a, x) -> a + x.length)").alias("n_tokens"),
        F.expr("transform(parts, x -> x.id)").alias(f"{id_col}s"),
        F.expr("aggregate(parts, cast('' AS binary), (a, x) -> concat(a, x.ids))").alias("ids"),
    )


def op1_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return best_fit_pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
