"""WARC archives with revisit resolution.

Headers (id, digest, length) are shuffled by payload digest; the largest id of each digest stays a response and the others
become revisits that name it. Records go out through Spark's own text writer, so files are committed by task, survive lost
executors and may lie in any store; each file is a run of WARC/1.1 records, without a warcinfo record, which the format leaves
open. Reading takes whole files of bounded size, follows Content-Length from record to record, and joins revisits to the responses
that they name.

Defined cases: null html is an empty payload; a payload below min_bytes is never a revisit; rows that repeat a page_id keep
their own records, and where the largest page_id has a payload twice, one url is the response (rows equal in id, url and
payload all are); a null page_id never becomes a response that others name while another id has the payload; a payload that
is larger than a file's limit has a file of its own, up to the 2 GB of a cell; an empty table gives an empty result; extra
columns of the pages are not archived.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import cut, fresh_path, table

CRLF = "\r\n"
RECORD_DATE = "2024-01-01T00:00:00Z"
#: Bytes of a file at most, upper ends of the size classes, and about what a record's head takes.
FILE_BYTES, CLASS_BYTES, HEAD_BYTES = 128 << 20, (1 << 16, 1 << 20, 1 << 24), 1024
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: five hex digits are four base-32 digits."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def clean_url(url: Column) -> Column:
    """A url that cannot break a head's line."""
    return F.regexp_replace(F.coalesce(url, F.lit("")), r"[\x00-\x20]", "")


def record_id(page_id: Column, *more: Column) -> Column:
    """A urn:uuid made from what the record holds, so that a retried task writes the same one."""
    h = F.md5(F.concat_ws("/", F.lit("page"), F.coalesce(page_id.cast("string"), F.lit("null")), F.col("payload_digest"), *more))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)), F.lit(">"))


def measured(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_bytes and payload_digest of pages."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("payload"))
    return p.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", base32_sha1(F.col("payload")))


def resolve(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages with payload, payload_bytes, payload_digest, and keeper and keeper_url, which a revisit names (null for a response)."""
    p = measured(pages)
    tie = F.xxhash64("url", "payload_digest")
    heads = p.filter(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.max(F.struct("page_id", tie.alias("tie"), "url")).alias("top"), F.count("*").alias("n"))
    shared = cut(heads.filter("n > 1").select("payload_digest", F.col("top.page_id").alias("keeper"), F.col("top.tie").alias("tie"), F.col("top.url").alias("keeper_url")), "warc-shared")
    rows = p.join(shared, "payload_digest", "left")
    keeps = F.col("keeper").isNull() | (F.col("page_id").eqNullSafe(F.col("keeper")) & (F.col("tie") == tie))
    named = [F.when(~keeps, F.col(c)).alias(c) for c in ("keeper", "keeper_url")]
    return rows.select("page_id", "url", "payload", "payload_bytes", "payload_digest", *named)


def records(resolved: DataFrame) -> DataFrame:
    """One text per record: WARC head, blank line, block, and the first of the two line ends behind it."""
    http = F.concat(F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + "Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF + CRLF))
    url = clean_url(F.col("url"))
    revisit = F.col("keeper").isNotNull()
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    own = F.when(revisit, record_id(F.col("page_id"), F.lit("revisit"), F.hex(F.xxhash64("url")))).otherwise(record_id(F.col("page_id")))
    head = F.concat(
        F.lit("WARC/1.1" + CRLF + "WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit(CRLF + "WARC-Record-ID: "), own,
        F.lit(CRLF + "WARC-Date: " + RECORD_DATE + CRLF + "WARC-Target-URI: "), url,
        F.lit(CRLF + "WARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.lit(CRLF + "X-Page-Id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.when(revisit, F.concat(F.lit(CRLF + "WARC-Profile: " + REVISIT_PROFILE + CRLF + "WARC-Refers-To: "), record_id(F.col("keeper")), F.lit(CRLF + "WARC-Refers-To-Target-URI: "), clean_url(F.col("keeper_url")), F.lit(CRLF + "WARC-Refers-To-Date: " + RECORD_DATE), F.lit(CRLF + "X-Refers-To-Page: "), F.col("keeper").cast("string"))).otherwise(F.lit("")),
        F.lit(CRLF + "Content-Type: application/http; msgtype=response" + CRLF + "Content-Length: "), F.octet_length(block).cast("string"),
        F.lit(CRLF + CRLF),
    )
    return resolved.select(F.concat(head, block, F.lit(CRLF)).alias("value"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """Archives of about file_bytes at most under path, or of one record that is larger.

    Records go by size class (powers of 16), each class with as many records to a file as fit if all had its largest size.
    """
    resolved = resolve(pages, min_bytes)
    kind = lambda size: sum(((size >= limit).cast("int") for limit in CLASS_BYTES), F.lit(0))
    found = pages.select(kind(F.coalesce(F.octet_length("html"), F.lit(0))).alias("k")).distinct().collect()  # a few classes
    for k in sorted(r.k for r in found) or [0]:
        largest = CLASS_BYTES[k] if k < len(CLASS_BYTES) else file_bytes
        out = records(resolved.filter(kind(F.col("payload_bytes")) == k)).write.mode("append").option("lineSep", CRLF)
        out.option("maxRecordsPerFile", max(1, file_bytes // (largest + HEAD_BYTES))).text(path)


PARSED = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("record_type", T.StringType()), T.StructField("url", T.StringType()), T.StructField("stated_digest", T.StringType()), T.StructField("refers_to", T.LongType()), T.StructField("payload", T.StringType())])


def parse(data: bytes):
    """The records of one archive as (head fields, block)."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode("utf-8").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        n = int(head["content-length"])
        block = data[stop + 4 : stop + 4 + n]
        if len(block) < n or data[stop + 4 + n : stop + 8 + n] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} is cut short")
        yield head, block
        at = stop + 8 + n


def _parse_batches(batches):
    for batch in batches:
        for cell in batch.column("content"):
            rows, held = [], 0
            for head, block in parse(cell.as_py()):
                payload = block.partition(b"\r\n\r\n")[2].decode("utf-8") if head["warc-type"] == "response" else None
                whole = lambda k: int(head[k]) if head.get(k) else None
                rows.append((whole("x-page-id"), head["warc-type"], head["warc-target-uri"], head["warc-payload-digest"].partition(":")[2], whole("x-refers-to-page"), payload))
                held += len(block)
                if held > 4 << 20:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)


def _batch(rows):
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()), strict=True)], names=PARSED.names)


def read_archives(spark, path: str) -> DataFrame:
    """Every record of the archives as it lies there: a response has its payload, a revisit the page that it refers to."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(_parse_batches, PARSED)


def resolved_heads(found: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to: a response's from its payload, a revisit's from the response it names."""
    measured = found.select("page_id", "record_type", "refers_to", "stated_digest", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"))
    measured = cut(measured, "warc-heads")
    own = measured.filter("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    bodies = own.select(F.col("page_id").alias("__of"), "payload_bytes", "payload_digest").distinct()
    again = measured.filter("record_type = 'revisit'").drop("payload_bytes", "payload_digest")
    again = again.join(bodies, (F.col("refers_to") == F.col("__of")) & (F.col("stated_digest") == F.col("payload_digest")), "left")
    return own.unionByName(again.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


def op8_warc_revisits(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    path = fresh_path(spark, "warc")
    write_archives(pages, path)
    return resolved_heads(read_archives(spark, path))


SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body FROM pages
), h AS (
  SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS hexed, max(page_id) OVER (PARTITION BY body) AS top FROM p
), d AS (
  SELECT *, [('0x' || substr(hexed, 1 + 5 * i, 5))::BIGINT FOR i IN range(8)] AS five FROM h
)
SELECT page_id, payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((five[1 + (j // 4)] >> (15 - 5 * (j % 4))) & 31)::INT, 1) FOR j IN range(32)], '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM d
"""
