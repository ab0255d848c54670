"""Writers: linkage sets, comparison matrices, feature matrices, graphs, result logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def save_linkage_set(a: DataFrame, b: DataFrame, gold: DataFrame, stats: dict[str, DataFrame], path: str) -> None:
    """Parquet folders a, b, gold and one for each statistics table."""
    for name, df in {"a": a, "b": b, "gold": gold, **stats}.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def save_matrices(matrices: dict[tuple[str, int | None], DataFrame], path: str, stats: DataFrame | None = None) -> None:
    """Comparison matrices by (attribute set, block length), partitioned by both; their statistics go to ``<path>-stats``."""
    if stats is not None:
        stats.write.mode("append").parquet(f"{path}-stats")
    for (atts, blk), df in matrices.items():
        df.withColumns({"atts": F.lit(atts), "blk": F.lit(-1 if blk is None else blk)}).write.mode("append").partitionBy("atts", "blk").parquet(path)


def save_features(features: DataFrame, path: str, append: bool = False) -> None:
    features.write.mode("append" if append else "overwrite").parquet(path)


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def competitor_input(matrix: DataFrame, features: list[str], label: str = "is_match") -> DataFrame:
    """``features, labels``: the adapter format of pair classifiers."""
    return matrix.select(F.array(*[F.col(c).cast("double") for c in features]).alias("features"), F.col(label).alias("labels"))


def save_linkage_csv(a: DataFrame, b: DataFrame, gold: DataFrame, stats: dict[str, DataFrame], path: str) -> None:
    """The same as ';'-separated text with headers, a folder each."""
    for name, df in {"a": a, "b": b, "gold": gold, **stats}.items():
        df.write.mode("overwrite").option("sep", ";").option("header", True).csv(f"{path}/{name}")


def markdown(rows: DataFrame, most: int = 1000) -> str:
    """A small result as a Markdown table; ``most`` rows at most, since a report is read by people."""
    cells = [rows.columns, ["---"] * len(rows.columns), *[["" if v is None else str(v) for v in r] for r in rows.limit(most).collect()]]
    return "\n".join(f"| {' | '.join(x.replace('|', chr(92) + '|') for x in row)} |" for row in cells)


def latex(rows: DataFrame, most: int = 1000) -> str:
    """A small result as a LaTeX tabular; ``most`` rows at most."""
    escaped = lambda v: "".join(f"\\{c}" if c in "&%$#_{}" else c for c in ("" if v is None else str(v)))
    body = [" & ".join(map(escaped, r)) + r" \\" for r in [rows.columns, *rows.limit(most).collect()]]
    return "\n".join([f"\\begin{{tabular}}{{{'l' * len(rows.columns)}}}", *body, r"\end{tabular}"])


def remove(spark, path: str) -> bool:
    """Delete a folder, wherever it is; whether there was one."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
