"""WARC archives with Zstandard dictionaries, written and read in parallel.

Layout of a ``.warc.zst`` file: one skippable frame (magic 0x184D2A5D) that holds the dictionary, then one
Zstandard frame for each record. Any run of records can be read with the leading frame and a byte range.

Archives go to a folder that all executors share, through ``pyarrow.fs``. A task writes under a name of its own and
renames when the archive is complete; only archives listed in the staged manifest count, so attempts that were lost
or repeated leave no trace in the result.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, lean, table, text_or_empty

SKIPPABLE = 0x184D2A5D
#: Equal payloads of fewer bytes are written in full.
LEAST_REVISIT = 100
#: Payload bytes of an archive: what a task holds in memory while it builds the archive's dictionary.
ARCHIVE_BYTES = 24_000_000
#: The dictionary and the sample it is trained on: records spread evenly over the whole archive, up to so many bytes.
DICTIONARY_BYTES, SAMPLE_BYTES = 65_536, 2_000_000
#: Compressed bytes that one reading task takes at a time.
READ_BYTES = 4_000_000
#: Rows that are Python objects at once in a writing task; rows and payload bytes that a reading task sends at once.
ROWS_AT_ONCE, SENT_BYTES = 256, 2_000_000

_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_CONTROL = re.compile("[\x00-\x1f\x7f-\x9f\u2028\u2029\ud800-\udfff]")
_MANIFEST = "archive string, first long, length long, records long"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL namespace of RFC 4122


def record_id(run: str, row: int) -> str:
    """The URN of a row's record; ``run`` is drawn for each write, so other crawls give other names, and a repeated task the same."""
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{run}:{row}')}>"


def header_value(text: str) -> str:
    """``text`` with control characters and lone surrogates percent-encoded, so that it stays within its header line."""
    return _CONTROL.sub(lambda m: "".join(f"%{x:02X}" for x in m[0].encode("utf-8", "surrogatepass")), text)


def record(row: dict, payload: bytes | None, run: str) -> bytes:
    """The WARC/1.1 record of a row; without a payload, a revisit (profile identical-payload-digest)."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if payload is None else 'response'}",
        f"WARC-Record-ID: {record_id(run, row['row'])}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {header_value(row['url'])}",
        f"WARC-Payload-Digest: sha256:{row['digest']}",
        f"WARC-Row: {row['row']}",
    ]
    if payload is None:
        head += [f"WARC-Refers-To: {record_id(run, row['refers'])}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        kind, block = "application/http; msgtype=response", _HTTP % row["bytes"]
    else:
        kind, block = "application/http; msgtype=response", _HTTP % row["bytes"] + payload
    head += [f"Content-Type: {kind}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    size = int(headers["content-length"])
    if lines[0] != "WARC/1.1" or rest[size:] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    return headers, rest[:size]


def qualified(spark, folder: str) -> str:
    """The folder with the scheme and authority that Spark itself resolves it to: without a scheme, that of the default file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


def filesystem(uri: str):
    """(pyarrow file system, path) of a qualified folder; Hadoop's names of S3 are pyarrow's ``s3``."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", re.sub(r"^s3[an]:", "s3:", uri)))


def train(records: list[bytes]):
    """A dictionary from records of the archive, or None where there is too little to train on."""
    import zstandard

    total = sum(map(len, records))
    step = max(1, -(-total // SAMPLE_BYTES))
    samples = records[::step]
    if len(samples) < 8 or sum(map(len, samples)) < 8 * 1024:
        return None
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, samples)) // 4), samples, k=256, d=8)
    except zstandard.ZstdError:  # samples too alike or too few
        return None


def archive(records: list[bytes]) -> tuple[list[bytes], int]:
    """The archive's frames, and the length of the leading one."""
    import zstandard

    trained = train(records)
    blob = trained.as_bytes() if trained else b""
    packer = zstandard.ZstdCompressor(level=3, dict_data=trained) if trained else zstandard.ZstdCompressor(level=3)
    lead = struct.pack("<II", SKIPPABLE, len(blob)) + blob
    return [lead, *(packer.compress(x) for x in records)], len(lead)


def _write(folder: str, crawl: str):
    def run(batches):
        store, base = filesystem(folder)
        pending: list[bytes] = []
        size = 0

        def flush():
            frames, _ = archive(pending)
            name = hashlib.sha256(b"".join(frames[:1]) + b"".join(frames[1:2]) + str(len(frames)).encode() + uuid.uuid4().bytes).hexdigest()[:24]
            with store.open_output_stream(f"{base}/.{name}.tmp") as out:
                at, first, count, ranges = len(frames[0]), len(frames[0]), 0, []
                out.write(frames[0])
                for frame in frames[1:]:
                    out.write(frame)
                    at, count = at + len(frame), count + 1
                    if at - first >= READ_BYTES:
                        ranges.append((first, at - first, count))
                        first, count = at, 0
                if count:
                    ranges.append((first, at - first, count))
            store.move(f"{base}/.{name}.tmp", f"{base}/{name}.warc.zst")
            return pa.RecordBatch.from_arrays(
                [pa.array([f"{name}.warc.zst"] * len(ranges), pa.string()), *(pa.array([r[i] for r in ranges], pa.int64()) for i in range(3))],
                ["archive", "first", "length", "records"],
            )

        for row in (row for batch in batches for k in range(0, batch.num_rows, ROWS_AT_ONCE) for row in batch.slice(k, ROWS_AT_ONCE).to_pylist()):
            payload = row["html"].encode() if row["html"] is not None else b""
            raw = record(row, None if row["refers"] is not None else payload, crawl)
            pending.append(raw)
            size += len(raw)
            if size >= ARCHIVE_BYTES:
                yield flush()
                pending.clear()
                size = 0
        if pending:
            yield flush()

    return run


def _read(folder: str, payloads: bool):
    def run(batches):
        import zstandard

        store, base = filesystem(folder)
        for batch in batches:
            for part in batch.to_pylist():
                with store.open_input_file(f"{base}/{part['archive']}") as file:
                    magic, size = struct.unpack("<II", file.read(8))
                    if magic != SKIPPABLE:
                        raise ValueError(f"{part['archive']}: no leading dictionary frame")
                    blob = file.read(size)
                    file.seek(part["first"])
                    data = file.read(part["length"])
                unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(blob)) if blob else zstandard.ZstdDecompressor()
                rows, at, held, seen = [], 0, 0, 0
                while at < len(data):
                    one = unpacker.decompressobj()
                    raw = one.decompress(data[at : at + (1 << 16)])
                    end = at + (1 << 16)
                    while not one.eof:
                        raw += one.decompress(data[end : end + (1 << 20)])
                        end += 1 << 20
                    at = min(end, len(data)) - len(one.unused_data)
                    headers, block = parse(raw)
                    payload = block.partition(b"\r\n\r\n")[2]
                    whole = headers["warc-type"] == "response"
                    rows.append({
                        "row": int(headers["warc-row"]), "record": headers["warc-record-id"], "kind": headers["warc-type"], "refers": headers.get("warc-refers-to"),
                        "url": headers["warc-target-uri"], "digest": hashlib.sha256(payload).hexdigest() if whole else None,
                        "said": headers["warc-payload-digest"].removeprefix("sha256:"), "bytes": len(payload) if whole else None, "payload": payload if whole and payloads else None,
                    })
                    seen, held = seen + 1, held + len(payload) * payloads
                    if held >= SENT_BYTES or len(rows) >= ROWS_AT_ONCE:
                        yield pa.RecordBatch.from_pylist(rows, schema=_READ_ARROW)
                        rows, held = [], 0
                if seen != part["records"]:
                    raise ValueError(f"{part['archive']}: {seen} records where {part['records']} were written")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_READ_ARROW)

    return run


_READ_SCHEMA = "row long, record string, kind string, refers string, url string, digest string, said string, bytes long, payload binary"
_READ_ARROW = pa.schema([("row", pa.int64()), ("record", pa.string()), ("kind", pa.string()), ("refers", pa.string()), ("url", pa.string()), ("digest", pa.string()), ("said", pa.string()), ("bytes", pa.int64()), ("payload", pa.binary())])


def write_warc(pages: DataFrame, folder: str, work: Workspace, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> tuple[DataFrame, DataFrame]:
    """Write an archive record per row into ``folder``; returns the staged manifest and the staged keys (row, id).

    Of equal payloads of at least ``LEAST_REVISIT`` bytes the row with the smallest id is the response and the
    others revisit it. Null html is an empty payload; control characters of a url are percent-encoded. Rows are numbered, so null and repeated ids keep
    records of their own; among rows of one id the lowest number counts as smallest, null ids come last.
    """
    html = text_or_empty(html_col)
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("about:blank")).alias("url"), html.alias("html"))
    keys = work.stage(rows.select("row", "id", F.octet_length("html").cast("long").alias("bytes"), F.sha2("html", 256).alias("digest")), "keys")
    order = F.struct(F.col("id").isNull().alias("last"), "id", "row")
    firsts = keys.filter(F.col("bytes") >= LEAST_REVISIT).groupBy("digest", "bytes").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    revisits = work.stage(
        keys.join(firsts, ["digest", "bytes"]).filter("row != first.row").select("row", F.col("first.row").alias("refers")), "revisits"
    )
    whole = rows.select("row", "url", "html", F.octet_length("html").cast("long").alias("bytes"), F.sha2("html", 256).alias("digest"))
    records = whole.join(revisits, "row", "left").select("row", "url", F.when(F.col("refers").isNull(), F.col("html")).alias("html"), "bytes", "digest", "refers")
    folder = qualified(pages.sparkSession, folder)
    store, base = filesystem(folder)
    store.create_dir(base, recursive=True)
    return work.stage(records.mapInArrow(lean(_write(folder, uuid.uuid4().hex)), _MANIFEST), "manifest"), keys


def read_warc(spark, folder: str, manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of the listed archives: ``row, record, kind, refers, url, digest, said, bytes, payload``.

    ``digest`` and ``bytes`` are computed from the payload as read (null for revisits), ``said`` is the header's digest.
    Without ``payloads`` that column is null: payloads are read and digested, but don't leave the reading task.
    """
    return manifest.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))).mapInArrow(lean(_read(qualified(spark, folder), payloads)), _READ_SCHEMA)


def warc_roundtrip(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write, read back, resolve revisits: ``<id_col>, payload_bytes, payload_digest, record_type, refers_to``.

    A revisit's size and digest are those of the response it names, as read back; ``raise_error`` ends the query where
    a header's digest differs from the payload's. An empty table writes nothing and gives an empty result.
    """
    spark = pages.sparkSession
    work = Workspace(spark, "warc")
    folder = folder or f"{work.path}/archives"
    manifest, keys = write_warc(pages, folder, work, id_col, url_col, html_col)
    records = work.stage(read_warc(spark, folder, manifest, False).drop("payload"), "records")
    checked = F.when(F.col("digest") == F.col("said"), F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("payload digest differs in "), F.col("record"))))
    whole = records.filter("kind = 'response'").select("row", "record", "kind", "url", "bytes", checked.alias("digest"), F.lit(None).cast("long").alias("of"))
    target = records.filter("kind = 'response'").select(F.col("record").alias("refers"), F.col("row").alias("of"), F.col("bytes").alias("b"), F.col("digest").alias("d"))
    again = records.filter("kind = 'revisit'").join(target, "refers").select(
        "row", "record", "kind", "url", F.col("b").alias("bytes"),
        F.when(F.col("d") == F.col("said"), F.col("d")).otherwise(F.raise_error(F.concat(F.lit("revisit of another payload: "), F.col("record")))).alias("digest"), "of",
    )
    both = whole.unionByName(again)
    return (
        both.join(keys.select("row", "id"), "row").join(keys.select(F.col("row").alias("of"), F.col("id").alias("refers_to")), "of", "left")
        .select(F.col("id").alias(id_col), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to")
    )


def op2_warc(spark, sf_dir: str) -> DataFrame:
    return warc_roundtrip(table(spark, sf_dir, "pages"))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT page_id, html, octet_length(encode(html)) AS n, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, sha256(html) AS payload_digest,
       CASE WHEN n >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND first <> page_id THEN first END AS refers_to
FROM f
"""
