"""What the corpus operators share: table reads, staged intermediate tables, white space."""

from __future__ import annotations

import atexit
import ctypes
import math
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: the space and U+0009 to U+000D.
WS = r"[\x20\x09-\x0D]+"

_own_dir: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")).cast("string")


def unused(rows: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``rows`` doesn't have; Spark's names differ by more than case."""
    taken, out = {c.lower() for c in rows.columns}, f"__{name}"
    while out in taken:
        out += "_"
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset (tests in local mode) a temporary folder of this process is made and set.
    """
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="corpus-")
        atexit.register(__import__("shutil").rmtree, _own_dir, True)
    return f"file://{_own_dir}"


#: Spark's own switch for deleting a query's shuffle files as soon as the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Workspace:
    """Tables written to the shared folder to cut lineage: a lost executor costs a re-read, not a re-run.

    ``drop`` removes a table that no later step reads, ``keep_only`` all but those that a result still reads; what is
    left goes with ``close`` or when the driver ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        self.live: list[str] = []
        self.count = 0
        OPEN.append(self)
        atexit.register(self._quiet_drop, self.path)

    def stage(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write ``df`` as Parquet and read it again, with the written schema; shuffle files of the write go at once."""
        at = f"{self.path}/{self.count}-{name}"
        self.count += 1
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(at)
        finally:
            self.spark.conf.set(CLEANUP, before)
        self.live.append(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._staged_at = at
        return out

    def drop(self, *staged: DataFrame) -> None:
        for df in staged:
            self._quiet_drop(df._staged_at)
            self.live.remove(df._staged_at)

    def keep_only(self, *staged: DataFrame) -> None:
        kept = {df._staged_at for df in staged}
        for at in self.live:
            if at not in kept:
                self._quiet_drop(at)
        self.live = [at for at in self.live if at in kept]

    def close(self) -> None:
        self._quiet_drop(self.path)
        self.live = []
        OPEN[:] = [work for work in OPEN if work is not self]

    def _quiet_drop(self, at: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session may be gone at exit; leftovers are then the cluster's to sweep
            pass


#: Workspaces whose tables may still be read.
OPEN: list[Workspace] = []


#: Bytes of rows that are broadcast at most: the driver holds them as results, as a hash table and in blocks, several times over.
BROADCAST_BYTES = 16 << 20


def is_few(n: int, width: int = 48) -> bool:
    """Whether ``n`` rows of about ``width`` bytes, a row's own 16 or more included, may be broadcast."""
    return n * width <= BROADCAST_BYTES


def with_label(rows: DataFrame, small: DataFrame, on: str, n: int, width: int = 48) -> DataFrame:
    """``rows`` joined with ``small``, of ``n`` rows of about ``width`` bytes: broadcast where that is a few MB, else by a shuffle of both."""
    return rows.join(F.broadcast(small) if is_few(n, width) else small, on)


def bitmap_of(hashes: DataFrame, n: int, each: int = 16, least: int = 16, most: int = 28) -> Column:
    """A Column over ``h``, true for each of the about ``n`` values of ``hashes`` (``h``, as ``xxhash64`` gives it) and for few others.

    A scalar bitmap of ``each`` bits for each value, and of 2**most (32 MB) at most: filled up, it lets more through.
    """
    size = min(max(math.ceil(math.log2(each * max(n, 1))), least), most)
    place = f"shiftrightunsigned(h, {64 - size})"
    bit = f"shiftleft(1L, cast({place} % 64 AS int))"
    words = hashes.groupBy(F.expr(f"shiftright({place}, 6)").alias("w")).agg(F.expr(f"bit_or({bit})").alias("bits"))
    every = hashes.sparkSession.range(1 << (size - 6)).join(words, F.col("id") == F.col("w"), "left")
    bitmap = every.agg(F.expr("transform(array_sort(collect_list(struct(id, coalesce(bits, 0L) AS bits))), x -> x.bits)"))
    return F.element_at(bitmap.scalar(), F.expr(f"cast(shiftright({place}, 6) + 1 AS int)")).bitwiseAND(F.expr(bit)) != 0


def lean(run):
    """``run`` of a ``mapInArrow``, which gives freed memory back to the system as it begins and ends: workers are used again by
    the tasks of later stages, which then start with the peak of the earlier ones."""

    def task(batches):
        free_memory()
        try:
            yield from run(batches)
        finally:
            free_memory()

    return task


def free_memory() -> None:
    """What the allocators kept of freed memory goes back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def input_bytes(rows: DataFrame) -> int:
    """The optimizer's estimate of the table's size, which for files is their size; 0 where it has none."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 50 else 0
