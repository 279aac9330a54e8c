"""WARC archives: writing with revisits, and reading by boundary-chain verification.

Writing: of the pages with equal payloads of ``least_bytes`` or more the one with the largest id is a response record, the others are
revisit records that name it and hold no payload. Spark's text writer puts the records into files, with the blank lines that end a
record as its line separator, so any store works and only committed files are seen. Files are gzipped unless told otherwise; places are
those in the unpacked bytes.

Reading: Spark's text reader cuts files at blank lines, so that a large file that is not packed is read in splits by many tasks and no
task holds a file. A piece that starts with the magic and holds only fields after it may be a record's head; it is emitted as a
candidate with the place where its successor must begin if it is one. Places are sums of the pieces' lengths, first within a split,
then over a file's splits. Which candidates are records is settled by pointer jumping from each file's start: after each doubling twice as many
successors are known to be reachable. A magic inside a payload is never reached. Payloads are taken up only then: of most
records one piece, whose digest the scan has made; a payload with blank lines of its own is put together from its pieces. A chain that does not
end at the file's end, a payload that is not what its record says, or a revisit of no such response is an error and not skipped.

Edge cases: a null html is an empty payload; a null url is an empty target; a null id is kept as such, and makes its page a response only
if no equal payload has an id; rows that repeat an id and a payload are all responses if they have the largest id; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import fresh_path, ship, stored, table
from .spread import looked_up

MAGIC = b"WARC/1.0\r\n"
DATE = "2024-01-01T00:00:00Z"
#: Before the payload of a response stands the head of the server's answer.
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_END = "\r\n\r\n"
#: What shows that a piece is no head: a line that does not start as a field, or half a line break.
_NO_FIELD = r"\r\n(?![A-Za-z-]+: )|(?<!\r)\n|\r(?!\n)"
#: Records of a file at most.
FILE_RECORDS = 2000


def _urn(page: int | None) -> str:
    return f"<urn:page:{'null' if page is None else page}>"


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A record without the blank lines that end it."""
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    body = HTTP if revisit else HTTP + payload
    lines = [
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_urn(page)}" if not revisit else f"WARC-Record-ID: {_urn(page)[:-1]}:revisit>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Refers-To: {_urn(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"] if revisit else []),
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    return MAGIC + "\r\n".join(lines).encode() + b"\r\n\r\n" + body


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for page, url, html, digest, response, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            name = base64.b32encode(bytes.fromhex(digest)).decode()
            out.append(record(page, url, (html or "").encode(), name, response, revisit))
        yield pa.record_batch([pa.array(out, pa.binary()).cast(pa.string())], ["value"])


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", file_records: int = FILE_RECORDS, compression: str = "gzip") -> None:
    """Write a record for each page to archives under ``path``."""
    ship(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    equal = rows.where(F.octet_length("html") >= least_bytes).groupBy("digest").agg(F.max("id").alias("response"), F.count("*").alias("n")).where("n > 1 and response is not null")
    told = looked_up(rows, stored(equal, "equal-payloads"), ["digest"], "n", pages.count()).withColumn("revisit", F.col("response").isNotNull() & ~F.col("id").eqNullSafe(F.col("response")))
    lines = told.select("id", "url", "html", "digest", "response", "revisit").mapInArrow(_records, "value string")
    lines.write.option("lineSep", _END).option("maxRecordsPerFile", file_records).option("compression", compression).text(path)


def _steady(spark: SparkSession, **settings: str) -> SparkSession:
    """A session with the same settings in which Spark packs splits into tasks alike at every scan, whatever executors come and go between."""
    other = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if name.startswith("spark.sql.") and spark.conf.isModifiable(name):
            other.conf.set(name, value)
    other.conf.set("spark.sql.files.minPartitionNum", spark.conf.get("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism)))
    for name, value in settings.items():
        other.conf.set(f"spark.sql.files.{name}", value)
    return other


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, stored_size, pos, value) of what lies between blank lines; ``pos`` ascends within a file's split, which starts at ``block``."""
    lines = spark.read.option("lineSep", _END).option("pathGlobFilter", "part-*").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("stored_size"), F.monotonically_increasing_id().alias("pos"), F.col("value").cast("binary").alias("value"))


def candidates(parts: DataFrame) -> DataFrame:
    """(file, pos, piece_at) of all pieces, and of those that may be heads: at, after, fields, size and digest of the two pieces behind."""
    # A payload that ends in a line break leaves it to the next piece, or to one of its own at the file's end.
    shift = F.when(F.substring("value", 1, 2 + len(MAGIC)) == F.lit(b"\r\n" + MAGIC), 2).otherwise(0)
    text = F.expr("substring(value, 1 + shift)").cast("string")
    head = (F.expr(f"substring(value, 1 + shift, {len(MAGIC)})") == F.lit(MAGIC)) & ~text.rlike(_NO_FIELD)
    span = F.octet_length("value").cast("long") + F.when(F.col("value") == F.lit(b"\r\n"), 0).otherwise(len(_END))
    told = parts.withColumn("shift", shift).select("file", "block", "stored_size", "pos", "shift", F.octet_length("value").cast("long").alias("size"), span.alias("span"), F.sha1("value").alias("digest"), F.when(head, text).alias("head"))
    order = Window.partitionBy("file", "block").orderBy("pos")
    behind = lambda c, k: F.lead(c, k).over(order)
    own = told.select("*", (F.sum("span").over(order) - F.col("span")).alias("inner"), *[behind(c, k).alias(f"{c}{k}") for k in (1, 2) for c in ("size", "digest")])
    splits = told.groupBy("file", "block").agg(F.sum("span").alias("bytes"))
    whole = Window.partitionBy("file")
    base = splits.select("file", "block", (F.sum("bytes").over(whole.orderBy("block")) - F.col("bytes")).alias("base"), F.sum("bytes").over(whole).alias("file_size"))
    placed = own.join(base, ["file", "block"])
    field = lambda name: F.regexp_extract("head", rf"\r\n{name}: ([^\r\n]*)", 1)
    at = F.col("base") + F.col("inner")
    length = F.try_to_number(field("Content-Length"), F.lit("999999999999999999")).cast("long")
    return placed.select(
        "file", "pos", "stored_size", "file_size", at.alias("piece_at"), (at + F.col("shift")).alias("at"), (at + F.col("size") + length + 2 * len(_END)).alias("after"), length.alias("length"), "size1", "digest1", "size2", "digest2",
        field("WARC-Type").alias("record_type"), field("Content-Type").startswith("application/http").alias("http"), field("WARC-Payload-Digest").alias("told"),
        *[F.nullif(F.regexp_extract("head", rf"\r\n{name}: <urn:page:(-?\d+)", 1), F.lit("")).cast("long").alias(c) for name, c in (("WARC-Record-ID", "page_id"), ("WARC-Refers-To", "refers_to"))],
        F.try_to_number(field("X-Payload-Length"), F.lit("999999999999999999")).cast("long").alias("payload_length"),
    )


def reachable(at: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, int]:
    """Which candidates the chain from place 0 reaches, by pointer jumping, and where the chain ends.

    ``at`` ascends. In round k each reached candidate reaches the one 2**k successors on.
    """
    n = len(at)
    k = np.searchsorted(at, after)
    leap = np.where((k < n) & (at[np.minimum(k, n - 1)] == after), k, n)
    leap = np.append(leap, n)
    reached = np.zeros(n + 1, bool)
    if n and at[0] == 0:
        reached[0] = True
        while True:
            new = reached.copy()
            new[leap[reached]] = True
            leap = leap[leap]
            if (new == reached).all() and (leap == n).all():
                break
            reached = new
    reached = reached[:n]
    return reached, int(after[reached].max(initial=0))


def _verified(block: pa.Table) -> pa.Table:
    """The places of a file's candidates that the chain from its start reaches."""
    block = block.sort_by("at")  # its first row is there only so that a file without candidates is seen
    kept, end = reachable(block.column("at").to_numpy()[1:], block.column("after").to_numpy()[1:])
    if end != block.column("file_size")[0].as_py():
        raise ValueError(f"{block.column('file')[0].as_py()}: the chain of records ends at {end}, not at the file's end")
    return block.filter(pa.array([False, *kept.tolist()])).select(["file", "at"])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record of the archives under ``path``."""
    ship(spark)
    parts = pieces(_steady(spark), path)  # scanned twice, and joined by the places of the pieces
    found = stored(candidates(parts), "pieces")
    torn = stored(found.where("not endswith(file, '.gz') and file_size <> stored_size").select("file").distinct(), "torn")
    if not torn.isEmpty():
        # A split began amid several line breaks and took other pairs of them for blank lines: such a file is read in one piece, as a packed one is.
        whole = pieces(_steady(spark, maxPartitionBytes=str(1 << 50)), path)
        again = fresh_path(spark, "pieces")
        candidates(whole).write.parquet(again)
        found = stored(found.join(torn, "file", "left_anti").union(spark.read.schema(found.schema).parquet(again).join(torn, "file", "left_semi")), "pieces")
        values = fresh_path(spark, "torn-values")
        whole.select("file", "pos", "value").write.parquet(values)
        parts = parts.select("file", "pos", "value").join(torn, "file", "left_anti").union(spark.read.parquet(values).join(torn, "file", "left_semi"))
    heads = found.where("after is not null")
    start = found.groupBy("file").agg(F.max("file_size").alias("file_size")).where("file_size > 0").select("file", F.lit(-1).cast("long").alias("at"), F.lit(-1).cast("long").alias("after"), "file_size")  # so that a file without a head is seen
    reached = heads.select("file", "at", "after", "file_size").union(start).groupBy("file").applyInArrow(_verified, "file string, at long")
    records = stored(heads.join(reached, ["file", "at"]), "records")
    _check_revisits(records)
    # Of a response, the payload lies behind the server's head; most are one piece, whose digest is known.
    skip = F.when(F.col("http"), F.col("size1") + len(_END)).otherwise(F.lit(0))
    one = F.when(F.col("http"), F.col("size2")).otherwise(F.col("size1"))
    told = records.withColumn("revisit", F.col("record_type") == "revisit").withColumn("whole", F.col("revisit") | F.coalesce(F.col("length") == skip + one, F.lit(False)))
    simple = told.where("whole").select("file", "at", "page_id", "record_type", "refers_to", "told", "revisit", "payload_length", F.when(F.col("revisit"), F.col("payload_length")).otherwise(one).alias("payload_bytes"), F.when(F.col("http"), F.col("digest2")).otherwise(F.col("digest1")).alias("digest"))
    rest = told.where("not whole")
    if not rest.isEmpty():
        simple = simple.union(_put_together(parts, found, told))
    return simple.mapInArrow(_checked, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def _check_revisits(records: DataFrame) -> None:
    """An error if a revisit does not name a response with its digest and length. Many revisits of one response are reduced to one before they move."""
    size = F.coalesce("payload_length", F.lit(-1)).alias("payload_length")  # a record of another writer may not tell it
    claims = records.where("record_type = 'revisit'").select(F.col("refers_to").alias("page"), "told", size).distinct()
    responses = records.where("record_type <> 'revisit'").select(F.col("page_id").alias("page"), "told", size).distinct()
    lost = claims.join(responses, ["page", "told", "payload_length"], "left_anti").limit(1).collect()
    if lost:
        raise ValueError(f"a revisit of page {lost[0].page} says {lost[0].told} of {lost[0].payload_length} bytes, which no response of that page is")


def _put_together(parts: DataFrame, found: DataFrame, records: DataFrame) -> DataFrame:
    """The payloads that hold blank lines themselves or lie in two splits: each of their pieces is sent to its record."""
    heads = records.select("file", "at", F.col("at").alias("record"), "whole")
    last = Window.partitionBy("file").orderBy("at")
    owned = found.select("file", "pos", "at").join(heads, ["file", "at"], "left").select("file", "pos", "at", F.col("record").isNotNull().alias("head"), *[F.last(c, True).over(last).alias(c) for c in ("record", "whole")])
    inside = owned.where("not whole and not head").join(parts.select("file", "pos", "value"), ["file", "pos"])
    blocks = inside.groupBy("file", F.col("record").alias("at")).agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("parts"))
    kept = ["file", "at", "page_id", "record_type", "refers_to", "told", "revisit", "payload_length"]
    return records.join(blocks, ["file", "at"]).select(*kept, "length", "http", "parts").mapInArrow(_joined, "file string, at long, page_id long, record_type string, refers_to long, told string, revisit boolean, payload_length long, payload_bytes long, digest string")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):  # a record at a time: its pieces may be many
            b = batch.slice(k, 1)
            length, http, parts = (c[0].as_py() for c in b.columns[8:])
            block = b"".join(bytes(p["value"]) + _END.encode() for p in parts)[:length]
            payload = block.partition(_END.encode())[2] if http else block
            yield pa.record_batch([*b.columns[:8], pa.array([len(payload)], pa.int64()), pa.array([hashlib.sha1(payload).hexdigest()])], [*b.schema.names[:8], "payload_bytes", "digest"])


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        file, at, page, kind, refers, told, revisit, length, size, digest = (c.to_pylist() for c in b.columns)
        told = [t.removeprefix("sha1:") for t in told]
        for k, (t, d) in enumerate(zip(told, digest, strict=True)):
            if not revisit[k] and (t != base64.b32encode(bytes.fromhex(d)).decode() or length[k] not in (None, size[k])):
                raise ValueError(f"{file[k]}: the payload of the record at {at[k]} is not what the record says")
        yield pa.record_batch([pa.array(page, pa.int64()), pa.array(size, pa.int64()), pa.array(told, pa.string()), pa.array(kind, pa.string()), pa.array([r if v else None for r, v in zip(refers, revisit, strict=True)], pa.int64())], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "archives")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path)


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages), g AS (
  SELECT page_id, octet_length(encode(payload)) AS payload_bytes, sha1(payload) AS h, max(page_id) OVER (PARTITION BY payload) AS first FROM p
), d AS (SELECT *, list_transform(range(0, 8), lambda k: ('0x' || substr(h, (1 + 5 * k)::BIGINT, 5))::BIGINT) AS parts FROM g)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(flatten(list_transform(parts, lambda v: [v // 32768, v // 1024 % 32, v // 32 % 32, v % 32])), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + k, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""
