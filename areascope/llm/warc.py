"""WARC archives with revisit resolution: duplicate payloads are stored once.

Writing. Headers (id, address, digest, length), not payloads, are grouped by payload digest; of records with equal payloads
of at least ``MIN_BYTES`` bytes the one with the largest id is the response (ties: the largest address), and the others become
revisit records that name it. Pages that are equal in every column are one header with a count: one of them is the response, so
nothing has to tell them apart. Every page becomes a WARC/1.1 record with fresh headers; a revisit has no payload. Archives are
written by Spark's own text writer: a record is the string of its header block, an empty line and the payload, and the line
separator is the CR LF CR LF that ends a WARC record. Files are gzip streams. So archives go wherever
Spark can write, by the commit protocol that survives lost executors.

Reading. Archive files are read by Spark's text reader with the same separator, and the pieces of a file, in their order, are
put together by Content-Length: a task holds a batch of pieces and a record, whatever the size of the file. ``resolve`` joins
revisit records to the responses that they refer to, by record id and digest, and gives them the columns of the response that the
caller wants (the payload, or only what was computed from it); a popular response is met by adaptive execution's skew handling.

Scale: the headers are stored once and move 60 bytes a page; of a payload, each writing task sends one copy to the response.
No group is gathered.

Defined results: a null payload is empty; null ids and addresses are written as empty headers and read back as
null; a page repeated with its id and a long payload becomes one response and revisits of the same id;
an empty table gives no archive file and an empty result; other columns are not archived.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areascope.llm.common import map_arrow, text_or_empty
from areascope.session import materialize

#: Smallest payload that is stored once; the format's line ends; the time in fresh headers.
MIN_BYTES, EOL, SEPARATOR, DATE = 1000, "\r\n", b"\r\n\r\n", "2026-01-01T00:00:00Z"
#: Records of an archive file; a file is read by one task, as a stream.
FILE_RECORDS = 2000
#: Bytes of payload in a batch that the reader gives on.
BATCH_BYTES = 8_000_000
READ_SCHEMA = ("record_id string, type string, page_id bigint, url string, digest string, refers_to_record string, "
               "refers_to bigint, payload_bytes bigint, payload binary")


def _record_id(*cols) -> Column:
    h = F.md5(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("-")) for c in cols]))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def classify(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
             min_bytes: int = MIN_BYTES) -> DataFrame:
    """(page_id, url, payload, digest, payload_bytes, type, record_id, refers_to, refers_url, refers_to_record): one row for each
    page; a revisit's payload is null. The record id of a response that others can refer to follows from its page; other
    records, which nothing names, get a random one."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
                        text_or_empty(html).alias("payload"))
    rows = rows.withColumn("digest", F.sha1(F.col("payload").cast("binary"))) \
        .withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    long_rows = rows.where(F.col("payload_bytes") >= min_bytes)
    headers = materialize(long_rows.groupBy("digest", "page_id", "url").agg(
        F.count("*").alias("n"), F.first("payload_bytes").alias("payload_bytes")), "headers")
    top = F.max(F.struct("page_id", "url")).alias("top")
    # stored, so that both sides of the join are plain reads and a popular digest can be split
    shared = materialize(headers.groupBy(F.col("digest").alias("shared")).agg(top, F.sum("n").alias("pages")).where("pages > 1")
                         .drop("pages"), "shared")
    is_top = F.col("page_id").eqNullSafe(F.col("top.page_id")) & F.col("url").eqNullSafe(F.col("top.url"))
    revisits = headers.join(shared, F.col("digest") == F.col("shared")) \
        .withColumn("n", F.col("n") - is_top.cast("long")).where("n > 0") \
        .withColumn("each", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    responses = long_rows.groupBy("digest").agg(top, F.first("payload").alias("payload"), F.first("payload_bytes").alias("payload_bytes"))

    def record(df: DataFrame, kind: str, record_id: Column, refers: bool = False, **columns: Column) -> DataFrame:
        none = F.lit(None)
        response = _record_id(F.col("top.page_id"), F.col("top.url"), F.col("digest")) if refers else none.cast("string")
        return df.select(*[columns.get(c, F.col(c)).alias(c) for c in ("page_id", "url", "payload", "digest", "payload_bytes")],
                         F.lit(kind).alias("type"), record_id.alias("record_id"),
                         (F.col("top.page_id") if refers else none.cast("long")).alias("refers_to"),
                         (F.col("top.url") if refers else none.cast("string")).alias("refers_url"), response.alias("refers_to_record"))

    random_id = F.concat(F.lit("<urn:uuid:"), F.expr("uuid()"), F.lit(">"))
    own = {"page_id": F.col("top.page_id"), "url": F.col("top.url")}
    return record(responses, "response", _record_id(own["page_id"], own["url"], F.col("digest")), **own) \
        .unionAll(record(rows.where(F.col("payload_bytes") < min_bytes), "response", random_id)) \
        .unionAll(record(revisits, "revisit", random_id, True, payload=F.lit(None).cast("string")))


def _line(name: str, value) -> Column:
    """A header line; line ends inside a value are written as spaces."""
    return F.concat(F.lit(name + ": "), F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), "[\\r\\n]", " "), F.lit(EOL))


def write_archives(records: DataFrame, path: str, date: str = DATE, file_records: int = FILE_RECORDS) -> None:
    """Write classified records as WARC files."""
    revisit = F.col("type") == "revisit"
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    none = F.lit("")
    head = F.concat(
        F.lit("WARC/1.1" + EOL), F.concat(F.lit("WARC-Type: "), "type", F.lit(EOL)),
        _line("WARC-Record-ID", F.col("record_id")), F.lit(f"WARC-Date: {date}{EOL}"),
        _line("WARC-Target-URI", F.col("url")), _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.when(revisit, F.concat(
            F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" + EOL),
            _line("WARC-Refers-To", F.col("refers_to_record")),
            _line("WARC-Refers-To-Target-URI", F.col("refers_url")), _line("X-Refers-To-Page", F.col("refers_to")))).otherwise(none),
        _line("X-Page", F.col("page_id")), _line("X-Payload-Length", F.col("payload_bytes")),
        F.lit("Content-Type: text/html" + EOL), _line("Content-Length", F.octet_length(body)))
    records.select(F.concat(head, F.lit(EOL), body).alias("value")).write.mode("overwrite") \
        .option("lineSep", EOL + EOL).option("maxRecordsPerFile", file_records).option("compression", "gzip").text(path)


def _record(head: dict, body: bytes) -> tuple:
    """A record as in READ_SCHEMA; a digest that is not the payload's is an error."""
    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = head["WARC-Type"]
    if kind == "response" and hashlib.sha1(body).hexdigest() != digest:
        raise ValueError(f"payload digest differs in {head['WARC-Record-ID']}")
    number = [int(x) if x else None for x in (head.get("X-Page", ""), head.get("X-Refers-To-Page", ""))]
    return (head["WARC-Record-ID"], kind, number[0], head["WARC-Target-URI"] or None, digest, head.get("WARC-Refers-To"), number[1],
            int(head["X-Payload-Length"]), body if kind == "response" else None)


def parse(pieces: Iterable[bytes]) -> Iterator[tuple]:
    """The records of archives that come as pieces between separators, in their order. A separator inside a payload only makes one
    more piece: a payload ends by its Content-Length."""
    held, head, size = bytearray(), None, 0
    for piece in pieces:
        held += piece
        held += SEPARATOR
        while True:
            if head is None:
                del held[:len(held) - len(held.lstrip(b"\r\n"))]   # a file's last separator, or the end of a payload before it
                end = held.find(SEPARATOR)
                if end < 0:
                    break
                lines = held[:end].decode("utf-8", "replace").split(EOL)
                if not lines[0].startswith("WARC/"):
                    raise ValueError("not a WARC record")
                head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
                size = int(head["Content-Length"])
                del held[:end + len(SEPARATOR)]
            if len(held) < size + len(SEPARATOR):
                break
            if held[size:size + len(SEPARATOR)] != SEPARATOR:
                raise ValueError(f"length differs in {head['WARC-Record-ID']}")
            yield _record(head, bytes(held[:size]))
            del held[:size + len(SEPARATOR)]
            head = None
    if head is not None or held.strip(b"\r\n"):
        raise ValueError("an archive ends inside a record")


def read_archives(spark, path: str) -> DataFrame:
    """The records of all archives, as in READ_SCHEMA; revisits without payload."""
    files = spark.read.option("pathGlobFilter", "*.gz").option("lineSep", SEPARATOR.decode()).text(path)
    names = [c.split()[0] for c in READ_SCHEMA.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for record in parse(piece.as_py() for batch in batches for piece in batch.column(0)):
            held.append(record)
            size += len(record[-1] or b"")
            if size > BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)

    return map_arrow(files.select(F.col("value").cast("binary").alias("piece")), run, READ_SCHEMA)


def resolve(records: DataFrame, found: Sequence[str] = ("payload",)) -> DataFrame:
    """Read records with the columns ``found`` of revisits taken from the responses that they refer to."""
    originals = records.where("type = 'response'").select(F.col("record_id").alias("original"), F.col("digest").alias("found_digest"),
                                                          *[F.col(c).alias(f"found_{c}") for c in found if c != "digest"])
    revisits = records.where("type = 'revisit'").join(
        originals, (F.col("refers_to_record") == F.col("original")) & (F.col("digest") == F.col("found_digest")), "left")
    return records.where("type <> 'revisit'").unionAll(
        revisits.select(*[F.col(f"found_{c}").alias(c) if c in found else c for c in records.columns]))
