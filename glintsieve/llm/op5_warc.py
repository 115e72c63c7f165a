"""Operator 5: WARC archives, written with an index first and read back by coalesced byte ranges.

Each record is a gzip member of its own. A record's offset, length, URL and digest go to the index as it is written;
readers select from the index, sort by file and offset, join ranges whose gap is at most GAP bytes into
one read of at most READ bytes, and cut the records out.

Of records with equal payloads (SHA-1 and length) of at least 1000 bytes, the one with the largest page_id is a response, the
others are revisits that refer to it. A revisit keeps the HTTP header, so its Content-Length still tells the length
of the full payload.

Defined results: null html is the empty payload; smaller payloads are always responses; rows with equal page_id and
equal payload are all responses if they are the largest; a null page_id is smaller than any other and, if a group has
only such, they are all responses; a null URL is written as an empty one; other columns are ignored; an empty
table gives no file and no row.
"""

from __future__ import annotations

import base64
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glintsieve.llm.common import by_size, fresh_path, local_file, only, table, wide, written

LEAST = 1000
#: Tasks that share the work on one payload.
SALTS = 16
FILE_BYTES = 64 << 20
GAP = 64 << 10
READ = 8 << 20
DATE = "2024-01-01T00:00:00Z"

_INDEX = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("page_id", pa.int64())])
_INDEX_SQL = "file string, offset long, length long, url string, digest string, page_id long"


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_of(name: str) -> int | None:
    text = name.strip("<>").rpartition(":")[2]
    return None if text == "none" else int(text)


def clean_url(url: str | None) -> str:
    """A header's value has no line ends."""
    return (url or "").replace("\r", "%0D").replace("\n", "%0A")


def build(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record, not compressed; refers_to: the page that a revisit refers to."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {clean_url(url)}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    lines += [f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(record: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers (both with lower-case names) and payload of one record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in head.decode().split("\r\n")[1:] if ": " in x)}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, {k.lower(): v for k, v in (x.split(": ", 1) for x in http.decode().split("\r\n")[1:])}, payload


def with_responses(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest and refers_to (the response's page_id for revisits).

    Small payloads are always responses and take no part in the join; the others meet their digest's response by digest and a salt of the page,
    so the pages that share one payload are many tasks' work."""
    p = only(pages, "page_id", "url", "html").withColumn("page_id", F.col("page_id").cast("long")).withColumn("html", F.coalesce("html", F.lit("")))
    p = p.withColumn("digest", F.sha1(F.encode("html", "UTF-8"))).withColumn("payload_bytes", F.octet_length("html").cast("long"))
    large = p.filter(F.col("payload_bytes") >= LEAST)
    light = large.groupBy("digest", "payload_bytes").agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    groups = light.filter("n > 1 and response is not null").select("digest", "payload_bytes", "response", salts.alias("salt"))
    salted = large.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    is_revisit = F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    joined = salted.join(groups, ["digest", "payload_bytes", "salt"], "left").select("page_id", "url", "html", "digest", F.when(is_revisit, F.col("response")).alias("refers_to"))
    small = p.filter(F.col("payload_bytes") < LEAST).select("page_id", "url", "html", "digest", F.lit(None).cast("long").alias("refers_to"))
    return joined.unionByName(small)


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the archives into a folder and returns the index. A task's files have names of their own, so that only those of successful tasks are in the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = local_file(folder)
        task, seq, out, offset = uuid.uuid4().hex, 0, None, 0
        try:
            for whole in batches:
                for batch in by_size(whole, "html"):
                    rows: list[dict] = []
                    for x in batch.to_pylist():
                        if out is None:
                            name, offset = f"{task}-{seq:05d}.warc.gz", 0
                            out, seq = filesystem.open_output_stream(f"{root}/{name}", compression=None), seq + 1
                        packer = zlib.compressobj(4, zlib.DEFLATED, 31)
                        data = packer.compress(build(x["page_id"], x["url"], x["html"].encode(), x["digest"], x["refers_to"])) + packer.flush()
                        out.write(data)
                        rows.append({"file": f"{folder}/{name}", "offset": offset, "length": len(data), "url": x["url"], "digest": x["digest"], "page_id": x["page_id"]})
                        offset += len(data)
                        if offset >= FILE_BYTES:
                            out.close()
                            out = None
                    if out is not None:
                        out.flush()
                    yield pa.RecordBatch.from_pylist(rows, schema=_INDEX)
        finally:
            if out is not None:
                out.close()

    filesystem, root = local_file(folder)
    filesystem.create_dir(root, recursive=True)
    return with_responses(pages).mapInArrow(run, _INDEX_SQL)


def ranges(rows: list[tuple[int, int]]) -> Iterator[tuple[int, int, list[int]]]:
    """Start, end and row numbers of the reads for (offset, length) rows in ascending order."""
    start = end = -1
    held: list[int] = []
    for k, (offset, length) in enumerate(rows):
        if held and (offset - end > GAP or offset + length - start > READ):
            yield start, end, held
            held = []
        if not held:
            start = offset
        end = offset + length
        held.append(k)
    if held:
        yield start, end, held


def read_archives(index: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to and payload (null for revisits) of the records that the index selects."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files, offsets, lengths = (batch.column(n).to_pylist() for n in ("file", "offset", "length"))
            at = 0
            while at < len(files):
                to = at
                while to < len(files) and files[to] == files[at]:
                    to += 1
                filesystem, path = local_file(files[at])
                with filesystem.open_input_file(path) as file:
                    for start, end, held in ranges(list(zip(offsets[at:to], lengths[at:to]))):
                        block = file.read_at(end - start, start)
                        rows = []
                        for k in held:
                            first = offsets[at + k] - start
                            fields, http, payload = parse(zlib.decompress(block[first : first + lengths[at + k]], 31))
                            revisit = fields["warc-type"] == "revisit"
                            rows.append({
                                "page_id": page_of(fields["warc-record-id"]), "url": fields.get("warc-target-uri", ""), "payload_bytes": int(http["content-length"]),
                                "payload_digest": base64.b32decode(fields["warc-payload-digest"].partition(":")[2]).hex(), "record_type": fields["warc-type"],
                                "refers_to": page_of(fields["warc-refers-to"]) if revisit else None, "payload": None if revisit else payload,
                            })
                        yield pa.RecordBatch.from_pylist(rows, schema=_RECORDS)
                at = to

    spread = only(index, "file", "offset", "length").repartition(2 * wide(index.sparkSession), "file", F.expr("offset div 8388608")).sortWithinPartitions("file", "offset")
    return spread.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


_RECORDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes a record for each row of pages and reads all of them back; the digest and length of a response are those of the payload as read."""
    index = written(write_archives(table(spark, sf_dir, "pages"), fresh_path(spark, "warc")), "warc-index")
    back = read_archives(index)
    return back.select(
        "page_id",
        F.when(F.col("payload").isNull(), F.col("payload_bytes")).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.when(F.col("payload").isNull(), F.col("payload_digest")).otherwise(F.sha1("payload")).alias("payload_digest"),
        "record_type", "refers_to",
    )


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS m FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> m THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> m THEN m END AS refers_to
FROM g
"""
