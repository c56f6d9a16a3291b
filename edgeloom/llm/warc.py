"""Dictionary-compressed WARC archives.

A Zstandard dictionary is trained on a bounded sample of the records.  Every
archive starts with it, in a skippable frame of magic 0x184D2A5D, and then holds
one frame a record, so a reader can start at any of them.

Records of equal payloads of at least ``least_bytes`` bytes are written once:
the row with the largest page id is a response, the others revisit it, and leave
their payloads behind before records are dealt to files.  The shared payloads
that hold over a thousandth of the pages, and all others while they are no more
than ``MOST_SHARED``, are broadcast as digests; beyond that, pages that may
share a payload are joined by digest.

The bytes go out through Spark's own writer, and so through its commit protocol
and to any file system that Spark knows: a row is a frame, and the separator
between rows is an empty skippable frame, which every reader passes over.  Files
are dealt by row, so no page, payload or host fills one.  The writer names them
``.txt``; they are renamed after the commit where ``rename`` is set, and readers
take either name, so what a crash leaves is whole.

Edge cases: a null payload is empty; a null URL has no target header; line
breaks in a URL are percent-encoded; a null page id never is the response of a
group that has an id, and if no row of a group has one, all are responses; rows
that repeat the largest id are responses too; an empty table gives no archives;
other columns are not written.
"""

from __future__ import annotations

import base64
import io
import re
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.llm.common import materialize, record_batch, short_batches, small_batches

#: Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: An empty skippable frame (magic 0x184D2A50, no bytes).
SEPARATOR = "P*M\x18\x00\x00\x00\x00"
#: Payloads of fewer bytes are always written whole.
LEAST_BYTES = 1000
#: Digests (40 bytes each, and 8 of an id) that a broadcast may hold; a digest is common from one page in so many.
MOST_SHARED, COMMON = 1_000_000, 1000
ID = re.compile(r"<urn:x-page:(-?\d+)>")


def record(page_id, url, payload: bytes | None, digest: str, refers_to, date: str, size: int | None = None) -> bytes:
    """One WARC record; a revisit, which needs no payload but its size, where ``refers_to`` is a page id."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % (len(payload) if size is None else size)
    block = http + payload if refers_to is None else http
    name = f"urn:x-page:{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {digest}')}"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train(samples: list[bytes], size: int) -> bytes:
    """A dictionary of at most ``size`` bytes; of too few samples, their own bytes."""
    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def dictionary_frame(data: bytes) -> bytes:
    packed = zstandard.ZstdCompressor(level=19).compress(data)
    return struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed


def keepers(rows: DataFrame, least_bytes: int) -> tuple[DataFrame, int, int]:
    """(digest, keeper) of the payloads that several pages share, and the pages and payload bytes in all."""
    groups = rows.groupBy("digest", F.octet_length("payload").alias("bytes")).agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n"))
    groups = materialize(groups, "payloads")
    pages, total = groups.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("bytes") * F.col("n")), F.lit(0))).first()
    shared = groups.where((F.col("n") > 1) & (F.col("bytes") >= least_bytes) & F.col("keeper").isNotNull())
    return shared.select("digest", "keeper", (F.col("n") * COMMON > pages).alias("common")), pages, total


def referred(rows: DataFrame, shared: DataFrame, least_bytes: int, most_shared: int) -> DataFrame:
    """``rows`` with ``keeper``: the page whose payload theirs equals, if any."""
    if shared.count() <= most_shared:
        return rows.join(F.broadcast(shared.select("digest", "keeper")), "digest", "left")
    common = shared.where("common").select("digest", F.col("keeper").alias("_most"))  # under COMMON rows
    met = rows.join(F.broadcast(common), "digest", "left")
    # rows that need no partner get a key of their own, so neither short nor common payloads meet in a task
    free = F.col("_most").isNotNull() | (F.octet_length("payload") < least_bytes)
    key = F.when(free, F.concat(F.lit("-"), F.monotonically_increasing_id())).otherwise(F.col("digest"))
    rest = shared.where("not common").select(F.col("digest").alias("_key"), "keeper")
    return met.withColumn("_key", key).join(rest, "_key", "left").withColumn("keeper", F.coalesce("_most", "keeper")).drop("_most", "_key")


def write_archives(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, dictionary_bytes: int = 64 << 10, samples: int = 400, sample_bytes: int = 16 << 10, bytes_per_file: int = 32 << 20, level: int = 6, date: str = "2026-01-01T00:00:00Z", rename: bool = True, most_shared: int = MOST_SHARED) -> None:
    """Write ``pages`` (page_id, url, html) as archives under ``path``, about ``bytes_per_file`` of payload in each."""
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    shared, count, total = keepers(rows, least_bytes)
    # the sample's records are cut: the dictionary is learned from the bytes that records have in common, of distinct payloads
    picked = rows.where(F.rand(7) < min(1.0, 2 * samples / max(1, count)))
    sample = picked.groupBy("digest").agg(F.min(F.struct("page_id", "url")).alias("k"), F.min(F.substring("payload", 1, sample_bytes)).alias("payload"))
    found = sorted(sample.collect(), key=lambda r: r.digest)[:samples]
    dictionary = train([record(r.k.page_id, r.k.url, bytes(r.payload), r.digest, None, date) for r in found], dictionary_bytes)
    met = referred(rows, shared, least_bytes, most_shared)
    refers = F.when(F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper"))
    met = met.select("page_id", "url", "payload", "digest", refers.alias("refers_to"), F.octet_length("payload").alias("bytes"))
    met = met.withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")))
    placed = met.repartition(max(1, -(-total // bytes_per_file)), F.xxhash64(F.monotonically_increasing_id()))
    schema = pa.schema([("value", pa.binary())])

    def run(batches):
        shared_dictionary = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        compressor, first = zstandard.ZstdCompressor(level=level, dict_data=shared_dictionary), [dictionary_frame(dictionary)] if dictionary else []
        for batch in small_batches(batches):
            out = first + [compressor.compress(record(i, u, p, d, r, date, n)) for i, u, p, d, r, n in zip(*(c.to_pylist() for c in batch.columns))]
            first = []
            yield record_batch({"value": out}, schema)

    frames = short_batches(placed).mapInArrow(run, "value binary")
    frames.select(F.col("value").cast("string")).write.option("lineSep", SEPARATOR).text(path)
    if not rename:
        return
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for f in fs.listStatus(folder):
        if (name := f.getPath().getName()).endswith(".txt"):
            fs.rename(f.getPath(), hadoop.Path(folder, name.removesuffix(".txt") + ".warc.zst"))


def records(data: bytes):
    """(headers, block) of each record of an archive, in turn."""
    at, dictionary = 0, None
    while len(data) - at >= 8 and (magic := struct.unpack_from("<I", data, at)[0]) & 0xFFFFFFF0 == 0x184D2A50:
        size = struct.unpack_from("<I", data, at + 4)[0]
        if magic == DICTIONARY_MAGIC and dictionary is None:
            held = bytes(data[at + 8 : at + 8 + size])
            dictionary = zstandard.ZstdDecompressor().decompress(held) if held[:4] == FRAME_MAGIC else held
        at += 8 + size
    opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    with io.BufferedReader(opener.stream_reader(memoryview(data)[at:], read_across_frames=True), 1 << 18) as stream:
        while line := stream.readline():
            if line.strip() != b"WARC/1.1":
                raise ValueError(f"not the start of a record: {line[:40]!r}")
            head = {}
            while (line := stream.readline().rstrip(b"\r\n")):
                name, _, value = line.decode().partition(":")
                head[name.strip().lower()] = value.strip()
            size = int(head["content-length"])
            block = stream.read(size)
            if len(block) != size or stream.read(4) != b"\r\n\r\n":
                raise ValueError(f"record {head.get('warc-record-id')} is cut short")
            yield head, block


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row a record: page_id, url, payload_bytes, payload_digest, record_type, refers_to and, if asked for, payload (null for revisits)."""
    import hashlib

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * payloads)

    def page(name: str | None) -> int | None:
        return int(m[1]) if name and (m := ID.fullmatch(name)) else None

    def batch_of(rows: list) -> pa.RecordBatch:
        return record_batch(dict(zip(schema.names, map(list, zip(*rows)))), schema)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                rows, held = [], 0
                for head, block in records(batch.column(0)[i].as_buffer()):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)[1])
                    digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
                    whole = head["warc-type"] == "response"
                    if whole and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                        raise ValueError(f"record {head['warc-record-id']} doesn't hold the payload that it names")
                    row = (page(head["warc-record-id"]), head.get("warc-target-uri"), size, digest, head["warc-type"], page(head.get("warc-refers-to")))
                    rows.append(row + ((payload if whole else None),) * payloads)
                    held += len(block) * payloads + 200
                    if held > 4 << 20:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    kinds = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{txt,warc.zst}").load(path)
    return files.select("content").mapInArrow(run, kinds)
