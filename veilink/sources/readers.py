"""Readers for record files, linkage archives and comparison matrices."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..operators.graph import cut

COMPARISON = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id1", "id2")]
    + [T.StructField(n, T.DoubleType()) for n in ("dice", "jaccard", "overlap", "hamming", "entropy")]
    + [T.StructField("is_match", T.IntegerType())]
)
# Widths of the voter file's fields, and the names of those that stay (None: filler).
VOTER_WIDTHS = (35, 20, 20, 3, 4, 1, 8, 14, 30, 8, 13, 35, 2, 5, 250, 13)
VOTER_NAMES = ("lastname", "firstname", "middlename", "namesufix", "birthyear", "gender", "date_registration", None, "street_name", None, "extension", "city", "state", "zip", None, "id")
# Positions in the state's voter file of the columns in use, the voter number first.
STATE_VOTER_POSITIONS = (68, 2, 10, 11, 9, 28, 29, 13, 14, 1, 15, 16)
# Prefixes of the token records, and their columns.
TOKENS = {
    "G_": "gender", "S_": "src", "L_": "lastname", "F_": "firstname", "B1_": "bd", "B2_": "bm", "B3_": "by",
    "PP1_": "city", "PP2_": "county", "PP3_": "region", "PP4_": "country", "PR_": "prof",
}


def csv(spark: SparkSession, path: str | list[str], sep: str = ",", header: bool = True, encoding: str = "UTF-8", quote: str = '"', comment: str | None = None, columns: list[str] | None = None, schema: T.StructType | None = None) -> DataFrame:
    """Delimited text (``.gz`` too), all columns as strings unless a schema is given; malformed lines are left out."""
    reader = spark.read.option("sep", sep).option("header", header).option("encoding", encoding).option("quote", quote).option("mode", "DROPMALFORMED")
    if comment:
        reader = reader.option("comment", comment)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.csv(path)
    return df.select(*columns) if columns else df


def load_records(df: DataFrame, id_col: str, attributes: list[str], limit: int | None = None, unique: bool = False, order_col: str | None = None) -> DataFrame:
    """``ent_id, attrs``: cleaned attributes in the table's column order, without records whose attributes are all empty.

    unique: of equal attribute lists the first record stays. Of repeated ids the last one wins. ``order_col`` gives the file
    order; without it the input's own order counts.
    """
    names = [c for c in df.columns if c in set(attributes)]
    clean = [F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))) for c in names]
    at = F.col(order_col) if order_col else F.monotonically_increasing_id()
    rows = df.withColumn("__at", at)
    if limit is not None:
        rows = rows.orderBy("__at").limit(limit)
    rows = rows.select("__at", F.trim(F.col(id_col).cast("string")).alias("ent_id"), F.array(*clean).alias("attrs")).filter(F.concat_ws("", "attrs") != "")
    if unique:
        rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy("attrs").orderBy("__at"))).filter("__n = 1").drop("__n")
    return rows.groupBy("ent_id").agg(F.max_by("attrs", "__at").alias("attrs"))


def _members(columns: list[str], choose, sep: str, encoding: str, quote: str, comment: str | None, last: bool):
    """Rows of the archive members whose names ``choose`` accepts (only of the last of them, with ``last``), as string columns."""
    import pandas as pd

    def run(batches):
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    names = [n for n in z.namelist() if choose(n)]
                    if not names:
                        raise ValueError(f"{path}: no member fits")
                    for name in names[-1:] if last else names:
                        with z.open(name) as member:
                            for part in pd.read_csv(member, sep=sep, dtype=str, keep_default_na=False, chunksize=50_000, encoding=encoding, quotechar=quote, comment=comment, on_bad_lines="skip"):
                                yield part.reindex(columns=columns).astype(object).where(lambda x: x.notna(), None)

    return run


def zipped_csv(spark: SparkSession, path: str, columns: list[str], member: str, sep: str = ";", encoding: str = "UTF-8", quote: str = '"', comment: str | None = None, exact: bool = False) -> DataFrame:
    """The CSV member of each archive whose name contains ``member``, or is it (``exact``), as strings; lines with too many
    fields are left out. Archives are not splittable: one task each."""
    choose = (lambda n: n == member) if exact else (lambda n: member in n)
    return _zipped(spark, path, columns, _members(columns, choose, sep, encoding, quote, comment, True))


def zipped_members(spark: SparkSession, path: str, columns: list[str], without: str, sep: str = ";", encoding: str = "ISO-8859-1") -> DataFrame:
    """The rows of all txt and csv members whose names don't hold ``without``."""
    return _zipped(spark, path, columns, _members(columns, lambda n: bool(members_without([n], without)), sep, encoding, '"', None, False))


def _zipped(spark: SparkSession, path: str, columns: list[str], run) -> DataFrame:
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def extract_member(spark: SparkSession, path: str, member: str) -> DataFrame:
    """``path, member, content`` of one archive member, by its exact name; archives without it give no row."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for at, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    if member in z.namelist():
                        rows.append((at, member, z.read(member)))
            yield pd.DataFrame(rows, columns=["path", "member", "content"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, member string, content binary")


def at_file_positions(df: DataFrame, positions: list[int], key: str) -> DataFrame:
    """Columns by their positions in the file; the first one is renamed to ``key``."""
    first, *rest = (df.columns[i] for i in positions)
    return df.select(F.col(first).alias(key), *rest)


def state_voters(spark: SparkSession, path: str) -> DataFrame:
    """The tab-separated voter file in Latin-1, cut to the twelve columns in use, with the voter number first."""
    return at_file_positions(csv(spark, path, "\t", encoding="ISO-8859-1"), list(STATE_VOTER_POSITIONS), "ncid")


def records_and_duplicates(spark: SparkSession, records: str, duplicates: str, sep: str = "\t") -> tuple[DataFrame, DataFrame]:
    """The two tables of a deduplication set: records, and pairs of duplicates."""
    return tuple(csv(spark, p, sep, encoding="ISO-8859-1") for p in (records, duplicates))


def matrices_of(spark: SparkSession, source: str, target: str, attributes: tuple[str, str] = ("atts-1", "atts-1"), blocks: tuple[int | None, int | None] = (None, None)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(source matrix, target matrix, one row of their names and sizes) of two zipped matrices whose file names hold their sizes."""
    frames = [comparison_matrix(spark, p, a, b) for p, a, b in zip((source, target), attributes, blocks)]
    names = [p.rsplit("/", 1)[-1].split("_")[1] if p.rsplit("/", 1)[-1].count("_") > 1 else p for p in (source, target)]
    log = spark.createDataFrame([(names[0], size_from_name(source), names[1], size_from_name(target), *attributes)], "source string, src_len int, target string, tgt_len int, atts_source string, atts_target string")
    return (*frames, log)


def comparison_matrix(spark: SparkSession, path: str, attributes: str = "atts-1", block: int | None = None, zipped: bool = True) -> DataFrame:
    """A comparison matrix: the last member named ``attributes`` or ``attributes-blk-N.csv``, or a folder written by ``save_matrices``."""
    if not zipped:
        df = spark.read.parquet(path).filter(F.col("atts") == attributes)
        return (df.filter(F.col("blk") == block) if block is not None else df).select(*COMPARISON.fieldNames())
    name = f"{attributes}-blk-{block}.csv" if block is not None else attributes
    raw = zipped_csv(spark, path, COMPARISON.fieldNames(), name)
    return raw.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in COMPARISON])


def size_from_name(path: str) -> int:
    """The third part, by '_', of a matrix file's name: its size."""
    return int(path.rsplit("/", 1)[-1].split("_")[2].split(".")[0])


def linkage_set(spark: SparkSession, path: str, columns_a: list[str], columns_b: list[str], sep: str = ";") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(a, b, gold) of a zipped linkage archive or of a folder with a, b and gold; nulls become '' in a and b alone."""
    if path.endswith(".zip"):
        a, b, gold = zipped_csv(spark, path, columns_a, "a.csv", sep), zipped_csv(spark, path, columns_b, "b.csv", sep), zipped_csv(spark, path, ["id1", "id2"], "gold.csv", sep)
    else:
        a, b, gold = (spark.read.parquet(f"{path}/{n}") for n in ("a", "b", "gold"))
    fill = lambda df: df.select(*[F.col(c).cast("string").alias(c) for c in df.columns]).na.fill("")
    return fill(a), fill(b), gold


def fixed_width(lines: DataFrame, widths: tuple[int, ...] = VOTER_WIDTHS, names: tuple[str | None, ...] = VOTER_NAMES, line_col: str = "value") -> DataFrame:
    """Fields of fixed width, stripped; fields without a name are dropped."""
    out, at = [], 1
    for width, name in zip(widths, names, strict=True):
        if name is not None:
            out.append(F.trim(F.substring(line_col, at, width)).alias(name))
        at += width
    return lines.select(*out)


def members_without(paths: list[str], word: str) -> list[str]:
    """The txt and csv paths whose names don't hold ``word``."""
    return [p for p in paths if p.lower().endswith((".txt", ".csv")) and word not in p.rsplit("/", 1)[-1]]


def _starting(parts, prefix: str):
    return F.filter(parts, lambda t: t.startswith(prefix))


def token_records(lines: DataFrame, line_col: str = "value", carry_from: str | None = None) -> DataFrame:
    """``id`` and twelve columns of ';'-separated token lines. Gender 1 is Female, others Male.

    A missing token is null; with ``carry_from``, the column that gives the line order, the columns other than bd, bm, by
    and prof keep the previous line's value.
    """
    parts = F.split(line_col, ";")
    columns = {}
    for prefix, name in TOKENS.items():
        hit = _starting(parts, prefix)
        value = F.when(F.size(hit) > 0, F.substring(F.try_element_at(hit, F.lit(-1)), len(prefix) + 1, 1_000_000))
        columns[name] = F.when(value == "1", "Female").when(value.isNotNull(), "Male") if name == "gender" else value
    out = lines.select(F.trim(parts[0]).alias("id"), *[c.alias(n) for n, c in columns.items()], *([carry_from] if carry_from else []))
    if carry_from:
        carried = [n for n in columns if n not in ("bd", "bm", "by", "prof")]
        out = _carried(out, carry_from, carried).drop(carry_from)
    return out


def _carried(rows: DataFrame, order: str, names: list[str]) -> DataFrame:
    """Last values so far, in ``order``: within ranges first; then each range takes over what the ranges before it ended with."""
    ranged = cut(rows.repartitionByRange(order).withColumn("__range", F.spark_partition_id()))  # ranges are drawn by sampling, so once
    so_far = Window.partitionBy("__range").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = ranged.withColumns({n: F.last(n, ignorenulls=True).over(so_far) for n in names})
    ends = ranged.groupBy("__range").agg(*[F.max_by(n, F.when(F.col(n).isNotNull(), F.col(order))).alias(f"__{n}") for n in names])
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range: as many as partitions
    ends = ends.select("__range", *[F.last(f"__{n}", ignorenulls=True).over(before).alias(f"__{n}") for n in names])
    return filled.join(F.broadcast(ends), "__range").withColumns({n: F.coalesce(n, f"__{n}") for n in names}).select(*rows.columns)


def feature_matrix(df: DataFrame, key: str = "node_key") -> tuple[DataFrame, DataFrame]:
    """(matrix with double features, one row of ``<name>_min, <name>_max``): minima are capped at 1, maxima floored at 0."""
    names = [c for c in df.columns if c != key]
    made = df.select(key, *[F.col(c).try_cast("double").alias(c) for c in names])
    ends = [f(n).alias(f"{n}_{s}") for n in names for f, s in ((lambda n: F.least(F.lit(1.0), F.min(n)), "min"), (lambda n: F.greatest(F.lit(0.0), F.max(n)), "max"))]
    return made, made.agg(*ends)
