"""WARC archives: writing with revisit records and segments, reading with segment reassembly.

Records follow WARC/1.1 (ISO 28500:2017). A block longer than a segment is cut: the first record carries
``WARC-Segment-Number: 1``, the next ones are ``continuation`` records with ``WARC-Segment-Origin-ID``, and the last
states ``WARC-Segment-Total-Length``. Reading groups continuations by origin, orders them by number, checks that
numbers are gapless and the total length holds, and decodes HTTP's chunked framing.

Only Spark's writers and readers touch the files (the text writer with the end of a record as line separator, and
``binaryFile``), so they may lie in any store. A file is held by one task while it is read; ``file_rows`` bounds its
records. Segments of one record meet in one task, other records aren't shuffled when read.

Defined results: a null html is an empty payload; a null or repeated page_id is written like any other (equal ids
and payloads revisit nothing but a larger id, so such rows come back as they were written). An empty table gives
archives without records and no rows. A broken record (wrong total length, missing segment, bad chunk, digest that
doesn't match) raises ValueError naming the record.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.common import delete, materialise, new_path, release, scratch

CRLF = "\r\n"
#: Digests that occur again are broadcast up to so many, a few megabytes; beyond, a digest's rows are dealt to SALTS tasks.
BROADCAST_ROWS, SALTS = 100_000, 16
RECORDS = "rid string, kind string, page_id long, origin string, segment int, total long, digest string, refers_to long, block binary"
PAYLOADS = "page_id long, payload binary, payload_digest string, record_type string, refers_to long"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of SHA-1: four groups of ten hex digits, each of 40 bits and so of eight base32 digits."""
    h = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(h, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def cut(data: str, size: int) -> str:
    """SQL for the pieces of a binary; an empty one has one empty piece."""
    return f"transform(sequence(0, greatest(0, (octet_length({data}) - 1) div {size})), i -> substring({data}, int(i * {size} + 1), {size}))"


def records(pages: DataFrame, segment_bytes: int, chunk_bytes: int) -> DataFrame:
    """WARC records as bytes, one row each, from rows (page_id, url, payload binary, digest, newest).

    ``newest`` is the page whose response holds an equal payload; a row with another page_id becomes a revisit.
    """
    line = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts], F.lit(CRLF))
    num = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    df = pages.withColumn("revisit", F.coalesce(F.col("newest") != F.col("page_id"), F.lit(False)))
    framed = F.expr(
        f"aggregate(filter({cut('payload', chunk_bytes)}, c -> octet_length(c) > 0), CAST('' AS BINARY), "
        "(acc, c) -> concat(acc, CAST(concat(lower(hex(octet_length(c))), '\r\n') AS BINARY), c, CAST('\r\n' AS BINARY)))"
    )
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Transfer-Encoding: chunked{CRLF}{CRLF}")).cast("binary")
    df = df.withColumn("block", F.when(F.col("revisit"), head).otherwise(F.concat(head, framed, F.lit(f"0{CRLF}{CRLF}").cast("binary"))))
    df = df.withColumn("rid", F.concat(F.lit("<urn:uuid:"), F.expr("uuid()"), F.lit(">")))
    df = df.withColumn("length", F.octet_length("block")).select("*", F.posexplode(F.expr(cut("block", segment_bytes))).alias("at", "piece"))
    many = F.col("length") > segment_bytes
    first, last = F.col("at") == 0, F.col("at") == F.expr(f"(length - 1) div {segment_bytes}")
    kind = F.when(~first, "continuation").when(F.col("revisit"), "revisit").otherwise("response")
    own = F.when(first, F.col("rid")).otherwise(F.concat(F.lit("<urn:uuid:"), F.expr("uuid()"), F.lit(">")))
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7F]", "%20")
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type: ", kind),
        line("WARC-Record-ID: ", own),
        line("WARC-Date: 2024-01-01T00:00:00Z"),
        line("WARC-Target-URI: ", uri),
        line("WARC-Source-Page: ", num(F.col("page_id"))),
        F.when(first, F.concat(line("Content-Type: application/http; msgtype=response"), line("WARC-Payload-Digest: sha1:", F.col("digest")))).otherwise(F.lit("")),
        F.when(first & F.col("revisit"), F.concat(line("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), line("WARC-Refers-To-Page: ", num(F.col("newest"))))).otherwise(F.lit("")),
        F.when(many, line("WARC-Segment-Number: ", num(F.col("at") + 1))).otherwise(F.lit("")),
        F.when(many & ~first, line("WARC-Segment-Origin-ID: ", F.col("rid"))).otherwise(F.lit("")),
        F.when(many & last, line("WARC-Segment-Total-Length: ", num(F.col("length")))).otherwise(F.lit("")),
        line("Content-Length: ", num(F.octet_length("piece"))),
        F.lit(CRLF),
    )
    return df.select(F.concat(header.cast("binary"), F.col("piece")).alias("record"))


def write_warc(pages: DataFrame, path: str, segment_bytes: int = 16 << 10, chunk_bytes: int = 4 << 10, file_rows: int = 20_000) -> None:
    """Writes one record a row of ``pages`` (page_id, url, html), and more for the segments of long ones.

    Of rows with equal payloads that with the largest page_id is the response and the others revisit it. Digests and
    ids alone are grouped. The digests that occur again are sent to all tasks if they are few; else rows meet them by a
    shuffle, rows of one digest in SALTS tasks.
    """
    df = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    df = df.withColumn("digest", base32_sha1(F.col("payload")))
    digests = pages.select("page_id", base32_sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("digest"))
    shared = materialise(digests.groupBy("digest").agg(F.max("page_id").alias("newest"), F.count("*").alias("n")).where("n > 1").drop("n"), "warc-shared")
    if shared.count() <= BROADCAST_ROWS:
        df = df.join(F.broadcast(shared), "digest", "left")
    else:
        salted = shared.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        own = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
        df = df.withColumn("_salt", own).join(salted, ["digest", "_salt"], "left").drop("_salt")
    out = records(df, segment_bytes, chunk_bytes)
    # bytes go through unchanged: a Spark string may hold any, and the text writer writes them as they are
    text = out.select(F.col("record").cast("string").alias("value"))
    text.write.option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", file_rows).text(path)
    release(shared)


def gunzip(data: bytes, step: int = 1 << 16) -> bytes:
    """All members of a gzip file, fed in small steps so that many members cost no copies of the rest."""
    out, at = [], 0
    while at < len(data):
        z = zlib.decompressobj(31)
        while not z.eof:
            if at >= len(data):
                raise ValueError("the gzip file is cut short")
            out.append(z.decompress(data[at : at + step]))
            at += min(step, len(data) - at) - len(z.unused_data)
    return b"".join(out)


def parse(content: bytes) -> Iterator[dict]:
    """Records of an archive; gzip is undone as it is read. The length of each block is its Content-Length."""
    if content[:2] == b"\x1f\x8b":
        content = gunzip(content)
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        lines = content[at:end].decode("utf-8", "replace").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(fields["content-length"])
        block = content[end + 4 : end + 4 + size]
        if len(block) != size or content[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"record {fields.get('warc-record-id')} is cut short")
        yield fields | {"block": block}
        at = end + 8 + size


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of all archives under ``path`` (columns: RECORDS), parsed file by file."""

    def rows(batches):
        number = lambda x: int(x) if x else None
        names = [c.split()[0] for c in RECORDS.split(", ")]
        schema = pa.schema([("rid", pa.string()), ("kind", pa.string()), ("page_id", pa.int64()), ("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("digest", pa.string()), ("refers_to", pa.int64()), ("block", pa.binary())])

        def batch(held):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], schema.field(k).type) for k in names], schema=schema)

        for b in batches:
            for i in range(b.num_rows):
                held, size = [], 0
                for f in parse(b.column(0)[i].as_py()):
                    own = f["warc-record-id"]
                    held.append({"rid": own, "kind": f["warc-type"], "page_id": number(f.get("warc-source-page")), "origin": f.get("warc-segment-origin-id", own), "segment": number(f.get("warc-segment-number")), "total": number(f.get("warc-segment-total-length")), "digest": f.get("warc-payload-digest", "").removeprefix("sha1:"), "refers_to": number(f.get("warc-refers-to-page")), "block": f["block"]})
                    size += len(f["block"]) + 300
                    if size > 4 << 20:
                        yield batch(held)
                        held, size = [], 0
                if held:
                    yield batch(held)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(rows, RECORDS)


def dechunk(body: bytes) -> bytes:
    """Undoes HTTP's chunked framing (RFC 9112, 7.1); chunk extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk doesn't end where it should")
        out.append(body[at : at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    chunked = any(x.lower().replace(b" ", b"") == b"transfer-encoding:chunked" for x in head.split(b"\r\n"))
    return dechunk(body) if chunked else body


def reassemble(parts: list[tuple[int | None, int | None, bytes]], rid: str) -> bytes:
    """The block from its segments (number, total length, bytes), in any order; whole records have no number."""
    if len(parts) == 1 and parts[0][0] is None:
        return parts[0][2]
    parts = sorted(parts, key=lambda p: p[0] or 0)
    if [p[0] for p in parts] != list(range(1, len(parts) + 1)):
        raise ValueError(f"record {rid}: segments {[p[0] for p in parts]} aren't 1 to {len(parts)}")
    block = b"".join(p[2] for p in parts)
    if parts[-1][1] != len(block):
        raise ValueError(f"record {rid}: {len(block)} bytes in its segments, {parts[-1][1]} stated")
    return block


def read_warc(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """(page_id, payload, payload_digest, record_type, refers_to, payload_bytes) of each response and revisit.

    ``payload`` is null for revisits, whose bytes their archive doesn't hold, and everywhere if ``keep_payload`` is
    false; payload_bytes of a revisit is that of the response with the same digest.
    """
    stored = materialise(read_records(spark, path), "warc-records")
    whole = stored.where("segment IS NULL").select("rid", "kind", "page_id", "digest", "refers_to", F.array(F.struct("segment", "total", "block")).alias("parts"))
    pieces = stored.where("segment IS NOT NULL").groupBy(F.col("origin").alias("rid")).agg(
        F.max(F.when(F.col("kind") != "continuation", F.col("kind"))).alias("kind"),
        F.max("page_id").alias("page_id"),
        F.max("digest").alias("digest"),
        F.max("refers_to").alias("refers_to"),
        F.collect_list(F.struct("segment", "total", "block")).alias("parts"),
    )

    def decode(batches):
        for b in batches:
            rows = {"page_id": b.column(2), "payload": [], "payload_digest": [], "record_type": b.column(1), "refers_to": b.column(4), "payload_bytes": []}
            for i in range(b.num_rows):
                rid, kind, stated = b.column(0)[i].as_py(), b.column(1)[i].as_py(), b.column(3)[i].as_py()
                if kind is None:
                    raise ValueError(f"record {rid} has no first segment")
                block = reassemble([(p["segment"], p["total"], p["block"]) for p in b.column(5)[i].as_py()], rid)
                payload = payload_of(block) if kind == "response" else None
                digest = stated if payload is None else base64.b32encode(hashlib.sha1(payload).digest()).decode()
                if digest != stated:
                    raise ValueError(f"record {rid}: digest {digest}, {stated} stated")
                rows["payload"].append(payload if keep_payload else None)
                rows["payload_digest"].append(digest)
                rows["payload_bytes"].append(None if payload is None else len(payload))
            types = {"page_id": pa.int64(), "payload": pa.binary(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload_bytes": pa.int64()}
            yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, types[k]) for k, v in rows.items()], names=list(rows))

    return whole.unionByName(pieces).mapInArrow(decode, PAYLOADS + ", payload_bytes long")


def with_lengths(read: DataFrame) -> DataFrame:
    """Fills in a revisit's payload_bytes from the response with its digest (one each, so rows stay as they are)."""
    of = read.where("record_type = 'response' AND payload_bytes IS NOT NULL").groupBy("payload_digest").agg(F.max("payload_bytes").alias("_b"))
    revisits = read.where("record_type = 'revisit'").join(of, "payload_digest", "left").withColumn("payload_bytes", F.col("_b")).drop("_b")
    return read.where("record_type = 'response'").unionByName(revisits.select(*read.columns))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    path = new_path(spark, "archive")
    with scratch(spark) as keep:
        write_warc(pages, path)
        read = keep(materialise(read_warc(spark, path, keep_payload=False).drop("payload"), "warc-read"))
    delete(spark, path)
    return with_lengths(read).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(encode(coalesce(html, ''))) AS h FROM pages),
d AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS newest FROM p)
SELECT page_id, octet_length(b) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
     (('0x' || substr(h, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8))) & 31 AS INTEGER), 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = newest THEN NULL ELSE newest END AS refers_to
FROM d
"""
