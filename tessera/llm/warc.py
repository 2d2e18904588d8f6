"""Operator 4, WARC: writing archives, reading them, and assembling transactions.

Archives are gzipped WARC/1.0 files. Spark's text source writes and reads them as raw bytes: the
writer's line end is the two CRLFs between records; the reader splits there and puts a record
together again by its Content-Length, in the order of the file, so payloads may hold anything.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import chain, groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import ensure_checkpoint_dir, table

END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
#: Smaller payloads are never revisits.
REVISIT_LEAST = 1000
RECORD = "record_id string, warc_type string, target_uri string, concurrent_to string, refers_to string, payload_digest string, http_head string, payload binary"


def uri(kind: str, key: Column, row: Column) -> Column:
    """A record id of its own for each row of pages: its page_id and its place."""
    return F.concat(F.lit(f"<urn:page:{kind}:"), F.coalesce(key.cast("string"), F.lit("null")), F.lit(":"), row.cast("string"), F.lit(">"))


def record(kind: str, headers: list[tuple[str, Column]], body: Column) -> Column:
    """A WARC record without the CRLFs after it; a null header is left out."""
    lines = [F.lit(f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Date: {DATE}\r\n")]
    lines += [F.coalesce(F.concat(F.lit(f"{k}: "), v, F.lit("\r\n")), F.lit("")) for k, v in headers]
    return F.concat(*lines, F.lit("Content-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body)


def write_warc(pages: DataFrame, path: str) -> None:
    """Writes a request, a response or revisit, and a metadata record for each row of pages (page_id, url, html).

    Of rows with equal payloads of REVISIT_LEAST bytes or more those with the largest page_id are
    responses and the others revisit one of them, rows with a null page_id too; where all are null,
    all are responses. Every row has record ids of its own, by its page_id and its place in the
    table, so null and repeated page_ids and repeated rows stay apart; pages should be a stored table,
    whose places are the same in each scan. A null html is an empty payload, a null url has no
    target. Equal payloads are found by digest and length: the largest id of each is a partial
    aggregate, and a digest that holds many rows is joined with one row.
    """
    html = F.coalesce("html", F.lit(""))
    clean = F.regexp_replace(F.col("url"), r"[\r\n]", "")
    df = pages.select("page_id", F.monotonically_increasing_id().alias("row"), clean.alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("sha1"), F.octet_length(html).cast("long").alias("n"))
    same = df.where(F.col("n") >= REVISIT_LEAST).groupBy("sha1", "n").agg(F.max(F.struct("page_id", "row")).alias("first"))
    df = df.join(same, ["sha1", "n"], "left").withColumn("revisit", F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id")))
    own = lambda kind: uri(kind, F.col("page_id"), F.col("row"))
    me, head = own("response"), F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(END))
    get = F.concat(F.lit("GET / HTTP/1.1\r\nUser-Agent: tessera"), F.lit(END))
    target, digest = ("WARC-Target-URI", F.col("url")), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1"))
    http = lambda of: ("Content-Type", F.lit(f"application/http; msgtype={of}"))
    profile = ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"))
    said = F.when(F.col("revisit"), record("revisit", [("WARC-Record-ID", me), target, digest, ("WARC-Refers-To", uri("response", F.col("first.page_id"), F.col("first.row"))), profile, http("response")], head)).otherwise(record("response", [("WARC-Record-ID", me), target, digest, http("response")], F.concat(head, "html")))
    asked = record("request", [("WARC-Record-ID", own("request")), ("WARC-Concurrent-To", me), target, http("request")], get)
    about = record("metadata", [("WARC-Record-ID", own("metadata")), ("WARC-Concurrent-To", me), target, ("Content-Type", F.lit("application/warc-fields"))], F.concat(F.lit("pageId: "), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit("\r\npayloadBytes: "), F.col("n").cast("string"), F.lit("\r\n")))
    out = df.select(F.concat(asked, F.lit(END), said, F.lit(END), about).alias("value"))
    out.write.option("lineSep", END).option("compression", "gzip").text(path)


HEADER = re.compile(rb"([A-Za-z-]+):[ \t]*([^\r\n]*)")


def parse_records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of one file from its bytes split at each END: (headers by lower-case name, block)."""
    sep, head = END.encode(), None
    while head is not None or (head := next(pieces, None)) is not None:
        if not head.startswith(b"WARC/"):
            head = None
            continue
        headers = {k.decode("latin-1").lower(): v.decode("utf-8", "replace") for k, v in HEADER.findall(head)}
        length = headers.get("content-length", "0").strip()
        want, parts, have = int(length) if length.isdigit() else 0, [], -len(sep)
        while have < want:
            piece = next(pieces, None)
            if piece is None:
                break
            parts.append(piece)
            have += len(piece) + len(sep)
        block = sep.join(parts)
        yield headers, block[:want]
        # a block that ends in a line end meets END one line early: what follows is the next record
        head = block[want:].removeprefix(sep) or None


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """RECORD rows of all archives under path; payload is the block without its HTTP head (null for a block without one).

    A gzipped archive is one task's stream, read record by record. A broken record ends at its file's
    end, wherever Spark puts the next file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sep, names = END.encode(), ["record_id", "warc_type", "target_uri", "concurrent_to", "refers_to", "payload_digest", "http_head", "payload"]
        keys = ["warc-record-id", "warc-type", "warc-target-uri", "warc-concurrent-to", "warc-refers-to", "warc-payload-digest"]
        rows: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            kinds = [pa.string()] * 7 + [pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

        pieces = ((f, x) for b in batches for f, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        archives = (parse_records(x for _, x in own) for _, own in groupby(pieces, itemgetter(0)))
        for headers, block in chain.from_iterable(archives):
            head = body = None
            if headers.get("content-type", "").startswith("application/http"):
                head, _, body = block.partition(sep)
                head = head.decode("utf-8", "replace")
            else:
                body = block
            rows.append((*(headers.get(k) for k in keys), head, body))
            size += len(block) + 500
            if size > 8 << 20:
                yield out()
                rows, size = [], 0
        yield out()

    lines = spark.read.option("lineSep", END).text(path)
    return lines.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value")).mapInArrow(run, RECORD)


def assemble(records: DataFrame, *carried: str) -> DataFrame:
    """One row per capture: record_id, warc_type, target_uri, refers_to, payload_digest, http_head, the
    `carried` columns of its response or revisit, and the nested arrays requests and metadata.

    Requests and metadata join by their concurrent-to identifier; each side is one shuffle by that
    key, and the arrays hold what one capture has. A capture without either has empty arrays, records
    that point nowhere are no capture. Repeated record ids are captures of their own.
    """
    main = records.where(F.col("warc_type").isin("response", "revisit")).select("record_id", "warc_type", "target_uri", "refers_to", "payload_digest", "http_head", *carried)
    side = records.where(F.col("warc_type").isin("request", "metadata") & F.col("concurrent_to").isNotNull())
    one = F.struct("record_id", "http_head", *[c for c in carried if c in records.columns])
    nested = lambda kind: F.collect_list(F.when(F.col("warc_type") == kind, one))
    by = side.groupBy(F.col("concurrent_to").alias("record_id")).agg(nested("request").alias("requests"), nested("metadata").alias("metadata"))
    out = main.join(by, "record_id", "left")
    empty = lambda c: F.coalesce(c, F.array().cast(by.schema[c].dataType))
    return out.withColumns({"requests": empty("requests"), "metadata": empty("metadata")})


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/warc-{uuid.uuid4().hex}"
    write_warc(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    number = lambda c: F.regexp_extract(c, r":(-?\d+):\d+>$", 1).try_cast("long")
    read = read_warc(spark, path).select("record_id", "warc_type", "target_uri", "concurrent_to", "refers_to", "payload_digest", "http_head", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("n"))
    captures = assemble(read, "sha1", "n")
    revisit = F.col("warc_type") == "revisit"
    said = F.regexp_extract("http_head", r"(?i)content-length: *(\d+)", 1).try_cast("long")
    return captures.select(
        number("record_id").alias("page_id"),
        F.when(revisit, said).otherwise(F.col("n")).alias("payload_bytes"),
        F.when(revisit, F.regexp_replace("payload_digest", "^sha1:", "")).otherwise(F.col("sha1")).alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        F.when(revisit, number("refers_to")).alias("refers_to"),
        F.size("requests").alias("n_requests"),
        F.size("metadata").alias("n_metadata"),
    )
