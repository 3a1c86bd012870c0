"""WARC (operator 6): archives with a Zstandard dictionary, written and read back.

Each scan task fills archives of bounded size. An archive's dictionary is built
from its own records, stored in a leading skippable frame, and every record is a
frame of its own, compressed with that dictionary.
"""

from __future__ import annotations

import datetime
import hashlib
import json
import re
import struct
import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import maybe_broadcast, read
from loomgraph.session import new_path, written

#: Fixed values of the format: the skippable frame's magic number and WARC header names.
SKIPPABLE_MAGIC = 0x184D2A5D
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: An archive is closed when its records reach this size; a larger record has an archive of its own.
ARCHIVE_BYTES = 8 << 20
DICTIONARY_BYTES = 32 << 10
LEAST_DICTIONARY = 256
#: The dictionary is built from at most this much of an archive's records, in slices spread evenly over their bytes.
TRAINING_BYTES = 1 << 20
SLICE_BYTES = 2048
REVISIT_LEAST = 100


def _record(kind: str, fields: list[str], block: bytes) -> bytes:
    head = [VERSION, f"WARC-Type: {kind}", *fields, f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def warcinfo(date: str) -> bytes:
    """The record that every archive begins with."""
    return _record("warcinfo", [f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {date}", "Content-Type: application/warc-fields"], b"format: WARC File Format 1.1\r\n")


def warc_record(kind: str, page_id: object, url: str | None, digest: str, size: int, payload: bytes, date: str, refers_to: object = None) -> bytes:
    """One record: header lines, a blank line, the block, two line ends.

    The block is an HTTP answer, a head and the payload; a revisit has the head alone.
    Digest and X-Payload-Length are those of the full payload, without the head.
    """
    name = lambda x: f"<urn:page:{'null' if x is None else x}>"
    fields = [f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}", "Content-Type: application/http;msgtype=response"]
    if url is not None:
        target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
        fields.append(f"WARC-Target-URI: {target}")
        if target != url:  # as it was, with what a header line cannot have
            fields.append(f"X-Target-URI: {json.dumps(url)}")
    fields += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}"]
    if kind == "revisit":
        fields += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    return _record(kind, fields, f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + payload)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of a record; that of warcinfo is its block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != VERSION:
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record is cut short")
    block = rest[:size]
    return fields, block if fields["WARC-Type"] == "warcinfo" else block.partition(b"\r\n\r\n")[2]


def train_dictionary(records: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from slices spread evenly over the bytes of all records; smaller if those are few, empty without any."""
    import zstandard

    data = b"".join(records)
    length = max(8, min(SLICE_BYTES, len(data) // 16))
    n = min(-(-len(data) // length), TRAINING_BYTES // length)
    samples = [data[at : at + length] for at in (i * len(data) // n for i in range(n))]
    size = min(size, max(LEAST_DICTIONARY, sum(map(len, samples)) // 16))
    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:  # of some tens of bytes
        return b""


def pack(records: list[bytes], level: int = 3) -> bytes:
    """An archive: the dictionary in a skippable frame, then a frame for each record."""
    import zstandard

    raw = train_dictionary(records)
    made = zstandard.ZstdCompressionDict(raw) if raw else None
    press = zstandard.ZstdCompressor(level=level, dict_data=made, write_content_size=True)
    return b"".join([struct.pack("<II", SKIPPABLE_MAGIC, len(raw)), raw, *map(press.compress, records)])


def unpack(archive: bytes) -> Iterator[bytes]:
    """The records of an archive, one frame at a time."""
    import zstandard

    magic, size = struct.unpack_from("<II", archive)
    if magic != SKIPPABLE_MAGIC:
        raise ValueError("no dictionary frame")
    raw = archive[8 : 8 + size]
    rest = memoryview(archive)[8 + size :]
    made = zstandard.ZstdCompressionDict(raw) if raw else None
    press = zstandard.ZstdDecompressor(dict_data=made)
    while len(rest):
        one = press.decompressobj()
        yield one.decompress(rest)
        rest = rest[len(rest) - len(one.unused_data) :]


MANIFEST = "path string, records long, bytes long"


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write a record for each page below ``folder``; returns the manifest (path, records, bytes).

    ``folder`` is a URI that all executors reach. A payload is the html in UTF-8,
    empty for null. Of pages with equal payloads of at least 100 bytes the one with
    the smallest identifier is the response (so are rows that repeat it), and the
    others are revisits without a payload; a null identifier is a revisit wherever
    another page has one. Small partitions are packed together, so that a task has
    an archive's bytes on average. An archive counts only if the manifest lists it, so those
    of failed task attempts are ignored. Other columns are not read.
    """
    text = F.coalesce(F.col(payload_col), F.lit(""))
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), text.alias("payload"), F.sha2(text, 256).alias("digest"), F.octet_length(text).alias("size"))
    first = base.where(F.col("size") >= REVISIT_LEAST).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n"), F.max("id").alias("last")).where("n > 1").select("digest", "first")
    first = maybe_broadcast(written(first, "firsts"))
    tasks = max(1, (base.agg(F.sum("size")).first()[0] or 0) // ARCHIVE_BYTES)
    judged = base.join(first, "digest", "left").withColumn("refers_to", F.when(F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")), F.col("first")))

    date = datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, where = fs.FileSystem.from_uri(folder)
        store.create_dir(where, recursive=True)
        held: list[bytes] = []
        size = 0
        info = warcinfo(date)

        def close() -> pd.DataFrame:
            name = f"{where}/{uuid.uuid4().hex}.warc.zst"
            data = pack([info, *held])
            with store.open_output_stream(name, compression=None) as out:
                out.write(data)
            return pd.DataFrame({"path": [name], "records": [len(held)], "bytes": [len(data)]})

        for batch in batches:
            for i, url, payload, digest, n, ref in zip(batch["id"], batch["url"], batch["payload"], batch["digest"], batch["size"], batch["refers_to"], strict=True):
                own, old = (None if x is None else int(x) for x in (i, ref))
                body = payload.encode() if old is None else b""
                one = warc_record("response" if old is None else "revisit", own, url, digest, int(n), body, date, old)
                if held and size + len(one) > ARCHIVE_BYTES:
                    yield close()
                    held.clear()
                    size = 0
                held.append(one)
                size += len(one)
        if held:
            yield close()

    return written(judged.select(F.col("id").cast("string"), "url", "payload", "digest", "size", F.col("refers_to").cast("string")).coalesce(tasks).mapInPandas(write, MANIFEST), "manifest")


RECORDS = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(spark: SparkSession, folder: str, manifest: DataFrame | None = None, payloads: bool = True) -> DataFrame:
    """The records of all archives below ``folder``, or of those that the manifest lists.

    The digest is computed anew from the payload of a response, and must be the stored one.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    if manifest is not None:
        name = lambda c: F.substring_index(c, "/", -1)
        listed = maybe_broadcast(manifest.select(name(F.col("path")).alias("_name")))
        files = files.join(listed, name(files["path"]) == F.col("_name"), "left_semi")

    def parse(batches: Iterable) -> Iterator:
        import pyarrow as pa

        def page(x: str) -> int | None:
            x = x.removeprefix("<urn:page:").removesuffix(">")
            return None if x == "null" else int(x)

        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        for batch in batches:
            for archive in batch.column(0):
                rows, size = [], 0
                for one in unpack(archive.as_py()):
                    fields, body = parse_record(one)
                    if fields["WARC-Type"] == "warcinfo":
                        continue
                    url = json.loads(fields["X-Target-URI"]) if "X-Target-URI" in fields else fields.get("WARC-Target-URI")
                    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"]
                    if kind == "response" and (hashlib.sha256(body).hexdigest() != digest or len(body) != int(fields["X-Payload-Length"])):
                        raise ValueError("a payload differs from its digest")
                    refers = page(fields["WARC-Refers-To"]) if kind == "revisit" else None
                    rows.append((page(fields["WARC-Record-ID"]), url, body if payloads else None, int(fields["X-Payload-Length"]), digest, kind, refers))
                    size += len(body) * payloads
                    if size > 4 << 20 or len(rows) >= 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return files.select("content").mapInArrow(parse, RECORDS)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written to archives in the shared folder and read back."""
    folder = new_path(spark, "archives")
    manifest = write_archives(read(spark, sf_dir, "pages"), folder)
    if not manifest.head(1):
        return spark.createDataFrame([], RECORDS).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return read_archives(spark, folder, manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""
