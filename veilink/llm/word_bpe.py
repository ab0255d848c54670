"""BPE encoding and decoding through a table of distinct words.

For vocabularies whose pre-tokeniser never lets a token span white space, a text's ids are its words' ids in order.

1. One scan splits the texts into words. Each block (consecutive rows of an input partition, up to ``BLOCK_ROWS`` rows and about
   ``BLOCK_BYTES`` of text) sends its distinct words, sorted, to their owners (by CRC-32 of the word), as one compressed message to each.
2. An owner merges its messages into its part of the distinct-word table, encodes each word once, and answers
   each block with the ids, in the message's order.
3. Blocks meet their answers, join ids back by position, and decode through the id-to-piece table, once per
   distinct word. That table has the vocabulary's size, not the corpus's.

A word that occurs in every row is one entry of each block's message, so frequent words make no hot task.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from itertools import accumulate, pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, input_bytes, shuffle_partitions, table, text_or_empty

#: Rows of a block at most, and bytes of text after which the next one begins; a longer text is a block with what comes before it.
BLOCK_ROWS, BLOCK_BYTES = 4096, 16_000_000
#: Bytes of input for each owner of words, about.
OWNER_BYTES = 256_000_000
#: Bytes of text that are compressed together for the exchange that brings blocks and answers together.
BUNDLE = 2_000_000

_SPACE = re.compile(r"[^\x20\x09-\x0D]+")
#: Characters that ``str.split`` treats as white space and the word pattern above does not.
_ODD = re.compile("[\x1c-\x1f\x85\xa0  -     　]")


def words_of(text: str) -> list[str]:
    return _SPACE.findall(text) if _ODD.search(text) else text.split()


def tokenizer(path: str):
    import tokenizers

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    out = tokenizers.Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


def _pack(words: list[str]) -> bytes:
    return zlib.compress("\n".join(words).encode("utf-8", "surrogatepass"), 1)


def _unpack(blob: bytes) -> list[str]:
    return zlib.decompress(blob).decode("utf-8", "surrogatepass").split("\n")


def by_owner(words, owners: int) -> list[list[str]]:
    """The distinct words, sorted, of each owner. Sorted, so that the order does not depend on that of the rows."""
    out: list[list[str]] = [[] for _ in range(owners)]
    for w in sorted(words):
        out[zlib.crc32(w.encode("utf-8", "surrogatepass")) % owners].append(w)
    return out


def _blocks():
    """Numbers the blocks of a partition: a function from (row number, bytes) of consecutive rows to the block."""
    state = {"rows": 0, "bytes": 0, "block": None}

    def of(uid: int, size: int) -> int:
        if state["block"] is None or state["rows"] >= BLOCK_ROWS or state["bytes"] >= BLOCK_BYTES:
            state.update(rows=0, bytes=0, block=uid)  # the first row's number, so blocks of all partitions differ
        state["rows"] += 1
        state["bytes"] += size
        return state["block"]

    return of


def _send(owners: int):
    def run(batches):
        import pyarrow as pa

        of = _blocks()

        def messages(block, words):
            parts = [(o, _pack(ws)) for o, ws in enumerate(by_owner(words, owners)) if ws]
            return pa.RecordBatch.from_arrays(
                [pa.array([o for o, _ in parts], pa.int32()), pa.array([block] * len(parts), pa.int64()), pa.array([b for _, b in parts], pa.binary())],
                ["owner", "block", "words"],
            )

        now, words = None, set()
        for batch in batches:  # blocks come in ascending order within a partition
            for uid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                block = of(uid, len(text))
                if block != now:
                    if words:
                        yield messages(now, words)
                    now, words = block, set()
                words.update(words_of(text))
        if words:
            yield messages(now, words)

    return run


def _bundles(batches):
    """Rows of one block, packed: ids, bytes of each text, and the texts compressed together, about ``BUNDLE`` bytes at a time."""
    import pyarrow as pa
    import zstandard

    packer, of = zstandard.ZstdCompressor(level=3), _blocks()
    for batch in batches:
        texts = batch.column(2).to_pylist()
        blocks = [of(uid, len(t)) for uid, t in zip(batch.column(0).to_pylist(), texts)]
        cuts, sizes, blobs, size, first = [], [], [], 0, 0
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        null = batch.column(1).is_null().to_pylist()  # null ids go apart: pandas would turn their list into floats
        for i, r in enumerate(raw):
            size += len(r)
            if i + 1 == len(raw) or blocks[i + 1] != blocks[i] or null[i + 1] != null[i] or size >= BUNDLE:
                cuts.append(first)
                sizes.append([len(x) for x in raw[first : i + 1]])
                blobs.append(packer.compress(b"".join(raw[first : i + 1])))
                size, first = 0, i + 1
        ids = pa.ListArray.from_arrays(pa.array([*cuts, len(raw)], pa.int32()), batch.column(1))
        yield pa.RecordBatch.from_arrays(
            [pa.array([blocks[c] for c in cuts], pa.int64()), ids, pa.array(sizes, pa.list_(pa.int32())), pa.array(blobs, pa.binary())], ["block", "ids", "sizes", "texts"]
        )


def _unbundle(rows: pd.DataFrame) -> tuple[list, list[str]]:
    import zstandard

    ids, texts, unpacker = [], [], zstandard.ZstdDecompressor()
    for own, sizes, blob in zip(rows["ids"], rows["sizes"], rows["texts"]):
        raw = unpacker.decompress(blob) if sum(sizes) else b""
        ids += [None if x is None or x != x else x for x in own]
        texts += [raw[a:b].decode("utf-8", "surrogatepass") for a, b in pairwise(accumulate(sizes, initial=0))]
    return ids, texts


def _answer(path: str):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        asked = [_unpack(x) for x in rows["words"]]
        distinct = list(set().union(*asked))
        bpe, ids = tokenizer(path), {}
        for a in range(0, len(distinct), 20_000):
            part = distinct[a : a + 20_000]
            ids.update(zip(part, (np.array(e.ids, "<u4").tobytes() for e in bpe.encode_batch_fast(part, add_special_tokens=False))))
        out = []
        for block, ws in zip(rows["block"], asked):
            got = [ids[w] for w in ws]
            out.append((block, key[0], zlib.compress(np.array([len(x) // 4 for x in got], "<u4").tobytes(), 1), zlib.compress(b"".join(got), 1)))
        return pd.DataFrame(out, columns=["block", "owner", "sizes", "ids"])

    return run


def pieces_of(path: str) -> list[str | None]:
    """The id-to-piece table, as a list."""
    bpe = tokenizer(path)
    return [bpe.id_to_token(i) for i in range(max(bpe.get_vocab(with_added_tokens=True).values(), default=-1) + 1)]


def _assemble(path: str, owners: int, digests: bool):
    state: dict = {}

    def run(key: tuple, rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({"id": [], "n_tokens": [], "a": [], "b": []})
        pieces = state.get("pieces") or state.setdefault("pieces", pieces_of(path))
        own, texts = _unbundle(rows)
        split = [words_of(t) for t in texts]
        asked = by_owner(set().union(*split), owners)
        ids: dict[str, bytes] = {}
        decoded: dict[str, str] = {}
        for owner, sizes, blob in zip(answers["owner"], answers["sizes"], answers["ids"]):
            ends = list(accumulate(np.frombuffer(zlib.decompress(sizes), "<u4").tolist(), initial=0))
            flat = zlib.decompress(blob)
            names = [pieces[i] for i in np.frombuffer(flat, "<u4").tolist()]
            if len(ends) != len(asked[owner]) + 1:
                raise ValueError("the answer is not to this block's message")
            for w, a, b in zip(asked[owner], ends, ends[1:]):
                ids[w] = flat[4 * a : 4 * b]
                decoded[w] = " ".join(names[a:b])
        n, first, second = [], [], []
        for ws in split:
            blob = b"".join([ids[w] for w in ws])
            text = " ".join([decoded[w] for w in ws])
            n.append(len(blob) // 4)
            first.append(hashlib.sha256(blob).hexdigest() if digests else blob)
            second.append(hashlib.sha256(text.encode("utf-8")).hexdigest() if digests else text)
        return pd.DataFrame({"id": pd.Series(own, dtype=object), "n_tokens": n, "a": first, "b": second})

    return run


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False, owners: int | None = None) -> DataFrame:
    """One row per input row: ``<id_col>, n_tokens, ids, decoded``, or with ``digests`` their SHA-256 digests.

    path: a tokenizers JSON file without decoder, whose tokens never span white space. ids: unsigned 32-bit,
    little-endian; decoded: the pieces joined by spaces, as the library decodes such files. A null text counts as
    empty and has no ids. Null and repeated ids pass through; other columns are not read. An empty table gives an
    empty result. ``docs`` is scanned twice and must give the same rows each time, as files and staged tables do.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "word-bpe")
    partitions = shuffle_partitions(spark)
    owners = owners or min(max(partitions, input_bytes(docs) // OWNER_BYTES), 64 * partitions)
    rows = docs.select(F.monotonically_increasing_id().alias("block"), F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    messages = rows.select("block", "text").mapInArrow(_send(owners), "owner int, block long, words binary")
    answers = work.stage(messages.groupBy("owner").applyInPandas(_answer(path), "block long, owner int, sizes binary, ids binary"), "answers")
    a, b = ("string", "string") if digests else ("binary", "string")
    bundles = rows.mapInArrow(_bundles, f"block long, ids array<{kind}>, sizes array<int>, texts binary")
    joined = bundles.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(_assemble(path, owners, digests), f"id {kind}, n_tokens long, a {a}, b {b}")
    names = ("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded")
    return joined.select(F.col("id").alias(id_col), "n_tokens", F.col("a").alias(names[0]), F.col("b").alias(names[1]))


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``<id_col>, decoded`` for rows of id arrays, by a join with the id-to-piece table, broadcast: it has the vocabulary's size.

    A null array decodes to null, an empty one to the empty string; ids outside the vocabulary are left out, as the
    library does. Rows are told apart by a number, so repeated ids keep rows of their own.
    """
    spark = encoded.sparkSession
    pieces = spark.createDataFrame([(i, p) for i, p in enumerate(pieces_of(path)) if p is not None], "token long, piece string")
    rows = encoded.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    at = rows.select("row", F.posexplode("ids").alias("at", "token")).withColumn("token", F.col("token").cast("long"))
    texts = at.join(F.broadcast(pieces), "token").groupBy("row").agg(
        F.expr("concat_ws(' ', transform(array_sort(collect_list(struct(at, piece))), x -> x.piece))").alias("decoded")
    )
    return rows.join(texts, "row", "left").select(F.col("id").alias(id_col), F.when(F.col("ids").isNotNull(), F.coalesce("decoded", F.lit(""))).alias("decoded"))


def op4_word_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), digests=True)
