"""WARC archives with revisit records (operator 2).

Writing: every page's payload is digested once (SHA-1, base32). Only headers (id, digest, length) are shuffled by
digest; of equal payloads the largest id stays the response, the others revisit it. A digest that a third of all pages
share is first reduced within 64 or more runs and its decision goes back run by run. Payloads move once, to as many
archives as their bytes ask for. A record's text is built in the JVM and written by Spark's text writer with the WARC
record end as its line end, so archives go through the task-commit protocol to any file system that Spark can write.

Reading: archives are parsed as byte streams by their Content-Length fields and response digests are recomputed.
Revisits are resolved: each joins the response that it refers to and takes its length, after comparing digests.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbordex.llm._common import fresh_path, partitions, table, written

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Payload bytes of an archive, on average.
ARCHIVE_BYTES = 32 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(payload: Column) -> Column:
    """SHA-1 of a string's UTF-8 bytes in upper-case base32 (160 bits: 32 characters, no padding)."""
    hexes = F.sha1(payload)
    chars = []
    for i in range(8):  # 5 hex digits are 4 base32 characters
        bits = F.conv(F.substring(hexes, 5 * i + 1, 5), 16, 10).cast("int")
        chars += [F.substring(F.lit(_BASE32), F.shiftright(bits, 15 - 5 * k).bitwiseAND(31) + 1, F.lit(1)) for k in range(4)]
    return F.concat(*chars)


def resolve(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """headers (__id, __digest, __bytes) plus __refers: the largest id of the same payload, if it is another one.

    Payloads under min_bytes are never revisits. Null ids lose to all others; a group of null ids alone has none to
    refer to. Rows repeating the kept id are responses, all of them. One row per distinct (id, digest).
    """
    runs = 64
    while runs < partitions(headers.sparkSession):
        runs *= 8
    rows = headers.select("__id", "__digest", "__bytes").distinct().withColumn("__run", F.pmod(F.xxhash64("__id"), F.lit(runs)))
    first = rows.groupBy("__run", "__digest").agg(F.max("__id").alias("__best"))
    top = first.groupBy("__digest").agg(F.max("__best").alias("__keep"))
    down = first.select("__run", "__digest").join(top, "__digest")
    other = (F.col("__bytes") >= min_bytes) & F.col("__keep").isNotNull() & ~F.col("__id").eqNullSafe(F.col("__keep"))
    return rows.join(down, ["__run", "__digest"]).select("__id", "__digest", "__bytes", F.when(other, F.col("__keep")).alias("__refers"))


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def write_archives(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write one record per page to gzip archives in path and return the decisions (see resolve()).

    A null html is an empty payload; line ends and spaces in a url become %-escapes, a null url is urn:none.
    Columns of pages other than the three are not read. An empty table writes no archive.
    """
    spark = pages.sparkSession
    rows = pages.select(pages[id_col].alias("__id"), F.coalesce(pages[url_col].cast("string"), F.lit("urn:none")).alias("__url"), F.coalesce(pages[html_col], F.lit("")).alias("__html"))
    rows = rows.withColumn("__digest", sha1_base32(F.col("__html"))).withColumn("__bytes", F.octet_length("__html").cast("long"))
    headers = written(rows.select("__id", "__digest", "__bytes"), "warc-headers")
    decided = written(resolve(headers, min_bytes), "warc-decisions")
    total = headers.agg(F.sum("__bytes")).first()[0] or 0
    n = max(1, -(-total // ARCHIVE_BYTES))
    spread = F.pmod(F.xxhash64("__id", "__digest"), F.lit(n)).cast("int")
    rows, decided_n = rows.withColumn("__archive", spread).repartition(n, "__archive"), decided.withColumn("__archive", spread).repartition(n, "__archive")
    both = rows.join(decided_n, (rows["__archive"] == decided_n["__archive"]) & rows["__id"].eqNullSafe(decided_n["__id"]) & (rows["__digest"] == decided_n["__digest"]))
    url = F.replace(F.replace(F.replace(rows["__url"], F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), F.lit(" "), F.lit("%20"))
    revisit = decided_n["__refers"].isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), rows["__bytes"].cast("string"), F.lit("\r\n\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, rows["__html"]))
    more = F.when(revisit, F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), _urn(decided_n["__refers"]), F.lit("\r\n"))).otherwise("")
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), _urn(rows["__id"]),
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), url,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), rows["__digest"], F.lit("\r\n"), more,
        F.lit("Content-Type: application/http;msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block,
    )
    both.select(record.alias("value")).write.option("compression", "gzip").option("lineSep", "\r\n\r\n").text(path)
    return decided


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields in lower case, block) of each record of a WARC stream; raises ValueError where it is malformed."""
    while line := stream.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"no WARC record starts with {line[:40]!r}")
        fields: dict[str, str] = {}
        while (line := stream.readline()) != b"\r\n":
            name, colon, value = line.decode("utf-8").partition(":")
            if not colon:
                raise ValueError(f"no header field: {line[:40]!r}")
            fields[name.lower()] = value.strip()
        block = stream.read(length := int(fields["content-length"]))
        if len(block) != length or stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"record {fields.get('warc-record-id')} is cut short")
        yield fields, block


_SCHEMA = "record_id string, record_type string, target_uri string, payload_digest string, refers_to string, payload binary"


def _page(urn: str | None) -> str | None:
    value = None if urn is None else urn.removeprefix("<urn:page:").removesuffix(">")
    return None if value == "null" else value


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _SCHEMA.split(", ")]
    types = [pa.string()] * 5 + [pa.binary()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    for b in batches:
        for content in b["content"]:
            rows, held = [], 0
            for fields, block in parse(gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer()))):
                payload = block.partition(b"\r\n\r\n")[2]
                digest = fields["warc-payload-digest"].removeprefix("sha1:")
                kind = fields["warc-type"]
                if kind == "response" and digest != base64.b32encode(hashlib.sha1(payload).digest()).decode():
                    raise ValueError(f"payload of {fields['warc-record-id']} does not have the digest {digest}")
                rows.append((_page(fields["warc-record-id"]), kind, fields.get("warc-target-uri"), digest, _page(fields.get("warc-refers-to")), payload if kind == "response" else None))
                held += len(payload)
                if held > 8 << 20 or len(rows) >= 5000:
                    yield batch(rows)
                    rows, held = [], 0
            if rows:
                yield batch(rows)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives in path; payload is null for revisits. Malformed archives fail the job."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(_records, _SCHEMA)


def resolved(records: DataFrame) -> DataFrame:
    """record_id, record_type, payload_digest, refers_to, payload_bytes of every record, revisits resolved.

    A revisit whose response is missing or has another digest gets payload_bytes null.
    """
    narrow = written(records.select("record_id", "record_type", "payload_digest", "refers_to", F.octet_length("payload").cast("long").alias("__own")), "warc-records")
    responses = narrow.filter("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to"), "payload_digest").agg(F.max("__own").alias("__of"))
    # A payload that a third of all pages share is asked for once a run, and answers its revisits run by run.
    runs = max(64, partitions(records.sparkSession))
    revisits = narrow.filter("record_type = 'revisit'").withColumn("__run", F.pmod(F.xxhash64("record_id"), F.lit(runs)))
    answers = revisits.select("__run", "refers_to", "payload_digest").distinct().join(responses, ["refers_to", "payload_digest"])
    revisits = revisits.join(answers, ["__run", "refers_to", "payload_digest"], "left")
    columns = ["record_id", "record_type", "payload_digest", "refers_to"]
    return narrow.filter("record_type <> 'revisit'").select(*columns, F.col("__own").alias("payload_bytes")).unionByName(revisits.select(*columns, F.col("__of").alias("payload_bytes")))


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return resolved(read_archives(spark, path)).select(
        F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to")
    )


ORACLE = {
    "op2_warc_revisits": f"""
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, payload_bytes, array_to_string([substr('{_BASE32}', CAST(1 + ((CAST(('0x' || substr(h, 5 * (i // 4) + 1, 5)) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) AS BIGINT), 1) FOR i IN range(0, 32)], '') AS payload_digest FROM p),
k AS (SELECT payload_digest, max(page_id) AS keep FROM d GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = keep THEN NULL ELSE keep END AS refers_to
FROM d JOIN k USING (payload_digest)""",
}
QUERIES = {"op2_warc_revisits": op2_warc_revisits}
