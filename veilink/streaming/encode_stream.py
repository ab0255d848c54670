"""Encoding and blocking records as they arrive: stateless row functions over a stream, against a static block index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.blocking import prefix_blocks
from ..operators.encode import EncodeSpec, encode


def encoded_stream(records: DataFrame, id_col: str, spec: EncodeSpec) -> DataFrame:
    """The code of each arriving record; kinds that need a pass over all records ('rbf-d') are refused."""
    if spec.kind == "rbf-d":
        raise ValueError("dynamic lengths need all records")
    return encode(records, id_col, spec)


def link_stream(records: DataFrame, index: DataFrame, id_col: str, columns: list[str], prefix: int, path: str, checkpoint: str) -> StreamingQuery:
    """Append the candidate pairs of each batch with the index (``id, blk_key``) to a Parquet table."""

    def batch(df: DataFrame, _: int) -> None:
        keyed = prefix_blocks(df, columns, prefix).select(df[id_col].alias("id1"), "blk_key")
        keyed.join(index.withColumnRenamed("id", "id2"), "blk_key").select("id1", "id2").write.mode("append").parquet(path)

    return records.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
