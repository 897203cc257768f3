"""WARC archives: a writer of one gzip member per record, and a splittable reader.

The reader's tasks take byte ranges of the files. A task scans its range for gzip's magic bytes; a candidate counts if
the member decodes and its head is a WARC version line with the needed headers; records that start inside the range are the task's own, even if they end beyond it.
Payloads are UTF-8, in which the magic's 0x8B can't follow 0x1F, so a payload that deflate stores as it is never looks like a record.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import cut, delete, forget, in_arrow, shared_path, utf8

MAGIC = b"\x1f\x8b\x08"
SPLIT_BYTES = 8 << 20
_READ = 1 << 18
#: Rows of one payload are dealt over so many tasks when their roles are looked up.
SALTS = 16


def store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, and the path in it. Hadoop's names of S3 are translated; schemes that pyarrow can't open (viewfs, wasbs) are an error."""
    scheme, sep, rest = path.partition("://")
    return pafs.FileSystem.from_uri(f"s3://{rest}" if sep and scheme in ("s3a", "s3n") else path)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | str, url: str, payload: bytes, record_type: str, payload_digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record as a gzip member. A revisit has its payload left out."""
    block = payload if record_type == "response" else b""
    # Line ends in a url would forge headers.
    url = url.replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <urn:equisift:page:{page_id}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{payload_digest}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:equisift:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def roles(pages: DataFrame, id_col: str = "page_id", text_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Adds record_type, payload_digest, refers_to: of equal payloads of at least min_bytes the greatest id is the response, others (null ids too) revisit it.

    Only (id, digests) are grouped, with a pre-aggregated maximum. Payloads that several rows have are then joined under SALTS keys each, so that rows of a payload that many pages share
    go to as many tasks; the salt is of id and partition, so null ids spread too. Columns named record_type or refers_to are replaced; others may have any names.
    """
    payload = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    names = [c for c in pages.columns if c not in ("record_type", "refers_to")]
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(id_col).alias("id"), F.sha2(payload, 256).alias("key"), F.octet_length(payload).alias("n"))
    best = rows.filter(F.col("n") >= min_bytes).groupBy("key").agg(F.max("id").alias("first"), F.count("*").alias("rows")).filter("rows > 1")
    best = best.select("key", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = rows.withColumn("salt", F.pmod(F.hash("id", F.spark_partition_id()), F.lit(SALTS))).join(best, ["key", "salt"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("id"))
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in names], F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"))


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", min_bytes: int = 0, null_ids: bool = False) -> DataFrame:
    """Writes a record per row to gzip WARC files under path; returns the manifest (file, bytes, records), itself written beside them.

    Files get names of their own and only those of tasks that succeeded are in the manifest, so a task may run again.
    Null payloads are empty, null urls too. Rows with a null id are left out, or with null_ids get record ids page:null-<a uuid>. Of rows that share an id each has its record,
    under one record id. Without rows there are no files.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.coalesce(url_col, F.lit("")).alias("url"), F.col(text_col).alias("html"))
    rows = roles(rows if null_ids else rows.filter("page_id is not null"), "page_id", "html", min_bytes)
    rows = rows.select("page_id", "url", "html", "record_type", "refers_to")

    def run(batches):
        out = name = None
        size = n = 0
        for batch in batches:
            if batch.num_rows and out is None:
                fs, root = store(path)
                fs.create_dir(root, recursive=True)
                name = f"records-{uuid.uuid4().hex}.warc.gz"
                out = fs.open_output_stream(f"{root}/{name}", compression=None)
            meta = batch.select(["page_id", "url", "record_type", "refers_to"]).to_pylist()
            for r, html in zip(meta, utf8(batch.column("html"))):
                html = html or b""
                member = record(f"null-{uuid.uuid4().hex}" if r["page_id"] is None else r["page_id"], r["url"], html, r["record_type"], digest(html), r["refers_to"])
                out.write(member)
                size += len(member)
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [f"{path}/{name}"], "bytes": [size], "records": [n]})

    return cut(rows.transform(in_arrow, run, "file string, bytes bigint, records bigint"), "warc-manifest", large=True)


def _member(file, at: int, size: int, first: bytes) -> tuple[bytes, int] | None:
    """The decoded member that begins at `at` (whose first bytes are given) and its compressed length; None if there is none."""
    z = zlib.decompressobj(31)
    out, pos, chunk = [], at, first
    checked = False
    while True:
        try:
            out.append(z.decompress(chunk))
        except zlib.error:
            return None
        pos += len(chunk)
        if not checked and sum(map(len, out)) >= 7:
            if not b"".join(out).startswith(b"WARC/1."):
                return None
            checked = True
        if z.eof:
            return (b"".join(out), pos - at - len(z.unused_data)) if checked else None
        if pos >= size:
            return None
        chunk = file.read_at(min(_READ, size - pos), pos)


def parse(data: bytes) -> dict | None:
    """Headers (lower-case names) and block of a decoded record; None if it isn't a whole record."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    if not sep:
        return None
    lines = head.decode("utf-8", "replace").split("\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = headers.get("content-length", "")
    if not {"warc-type", "warc-record-id"} <= headers.keys() or not n.isdigit() or len(rest) < int(n):
        return None
    return {"headers": headers, "block": rest[: int(n)]}


def read_split(path: str, start: int, end: int, size: int):
    """The parsed records of a file that start in [start, end)."""
    fs, where = store(path)
    with fs.open_input_file(where) as file:
        base, buffer, pos = start, b"", start
        while pos < end:
            if pos - base + 3 > len(buffer):  # read on; two bytes beyond the end may complete a magic that starts inside
                base, buffer = pos, file.read_at(min(_READ * 4, size - pos), pos)
            k = buffer.find(MAGIC, pos - base)
            if k < 0:
                if base + len(buffer) >= min(size, end + 2):
                    return
                pos = base + max(len(buffer) - 2, 1)
                continue
            at = base + k
            if at >= end:
                return
            found = _member(file, at, size, buffer[k : k + _READ] if len(buffer) - k >= 4096 or base + len(buffer) >= size else file.read_at(min(_READ, size - at), at))
            got = found and parse(found[0])
            if got:
                yield at, got
                pos = at + found[1]
                if pos - base > len(buffer):
                    base, buffer = pos, b""
            else:
                pos = at + 1


def read_warc(spark: SparkSession, manifest: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(file, offset, record_id, record_type, refers_to, url, payload_digest, payload) of each record of the manifest's files.

    payload is null for revisits. A response whose payload does not have the digest of its header fails the read.
    """
    splits = manifest.select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bytes") - 1, F.lit(split_bytes).cast("bigint"))).alias("start"))
    splits = splits.repartition(max(1, int(manifest.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 0)))

    def run(batches):
        for batch in batches:
            for s in batch.to_pylist():
                rows, size = [], 0
                for at, r in read_split(s["file"], s["start"], min(s["start"] + split_bytes, s["bytes"]), s["bytes"]):
                    h, block = r["headers"], r["block"]
                    said = h.get("warc-payload-digest", "").removeprefix("sha1:")
                    if h["warc-type"] == "response" and digest(block) != said:
                        raise ValueError(f"payload digest differs in {s['file']} at {at}")
                    rows.append((s["file"], at, h["warc-record-id"], h["warc-type"], h.get("warc-refers-to"), h.get("warc-target-uri", ""), said, None if h["warc-type"] == "revisit" else block))
                    size += len(block)
                    if size > 16 << 20:
                        yield table(rows)
                        rows, size = [], 0
                if rows:
                    yield table(rows)

    names = ["file", "offset", "record_id", "record_type", "refers_to", "url", "payload_digest", "payload"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary()]

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return splits.transform(in_arrow, run, "file string, offset bigint, record_id string, record_type string, refers_to string, url string, payload_digest string, payload binary")


def op9_warc(spark, sf_dir: str) -> DataFrame:
    archive = shared_path(spark, "warc")
    manifest = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), archive, null_ids=True)
    number = lambda c: F.nullif(F.regexp_extract(c, r"page:(-?\d+)>", 1), F.lit("")).cast("long")
    rows = read_warc(spark, manifest).select(
        number("record_id").alias("page_id"), "record_type", F.when(F.col("refers_to").isNotNull(), number(F.coalesce("refers_to", F.lit("page:0>")))).alias("refers_to"),
        "payload_digest", F.octet_length("payload").cast("long").alias("own_bytes"),
    )
    rows = cut(rows, "warc-records", large=True)
    delete(spark, archive)
    forget(manifest)
    # A revisit's full payload is that of the response it refers to; pages that share an id are told apart by the digest.
    sizes = rows.filter("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("own_bytes").alias("full_bytes"))
    # Responses need no lookup. Sizes are cut, so that the join deals both its sides and Spark can split a response that many revisit.
    again = rows.filter("record_type = 'revisit'").join(cut(sizes, "warc-sizes"), ["refers_to", "payload_digest"], "left").withColumn("own_bytes", F.col("full_bytes"))
    names = ["page_id", F.col("own_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"]
    return rows.filter("record_type = 'response'").select(*names).unionByName(again.select(*names))


#: Ids are taken as distinct and not null. DuckDB has no base32: five hex digits are four of its digits.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
r AS (SELECT page_id, strlen(payload) AS payload_bytes, sha1(payload) AS hex, max(page_id) OVER (PARTITION BY payload) AS first FROM p)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM r
"""
