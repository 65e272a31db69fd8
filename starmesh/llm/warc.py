"""WARC archives: writing captures, reading them back, and assembling transactions.

A capture is a request, a response (or a revisit, where another capture has an equal payload) and
a metadata record; the request and the metadata name the response they are concurrent to. Records
are written through Spark's text writer, whose line separator is the two line ends that close a
WARC record, so files go wherever Spark can write. They are read as a stream of pieces between
such line ends, from which records are put together by their Content-Length: a reader holds one
record at a time. Transactions are joined through WARC-Concurrent-To.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, stored

CRLF = "\r\n"
#: Records per file, so that files are read in parallel.
RECORDS_PER_FILE = 3_000
#: Payloads of fewer bytes are always stored.
REVISIT_BYTES = 1_000
DATE = "1970-01-01T00:00:00Z"


def _line(name: str, value: Column | str) -> Column:
    value = F.lit(value) if isinstance(value, str) else value
    return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))


def _record(kind: Column | str, record_id: Column, block: Column, lines: list[Column], content_type: str) -> Column:
    """A record without the two line ends that close it."""
    size = F.octet_length(block).cast("string")
    return F.concat(F.lit(f"WARC/1.1{CRLF}"), _line("WARC-Type", kind), _line("WARC-Record-ID", record_id), _line("WARC-Date", DATE), *lines, _line("Content-Type", content_type), _line("Content-Length", size), F.lit(CRLF), block)


def _sure(text: Column) -> Column:
    """A header's value: control characters are percent-encoded as %20."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x1F\x7F]", "%20")


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_bytes: int = REVISIT_BYTES) -> None:
    """Writes three records per row to gzip-compressed WARC files in path.

    The payload is the text's UTF-8 bytes; null counts as empty. Of rows with equal payloads of
    at least revisit_bytes bytes, those with the largest id are stored as responses and the others
    as revisits that refer to one of them; all else are responses. Rows with a null id are always
    stored. Every row is a capture of its own, also if it repeats another: it has a number, which
    is stored before anything refers to it. An empty table writes no record; other columns are ignored.
    """
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), _sure(F.col(url_col)).alias("url"), payload.alias("payload"))
    key = F.when((F.octet_length("payload") >= revisit_bytes) & F.col("page_id").isNotNull(), F.unhex(F.sha2("payload", 256)))
    rows = stored(rows.select("page_id", "url", "payload", F.sha1(F.col("payload").cast("binary")).alias("sha1"), key.alias("key"), F.monotonically_increasing_id().alias("row_no")), "warc-rows")
    # Equal payloads are counted by digest before the shuffle; only those that occur again matter.
    again = rows.where("key is not null").groupBy("key").agg(F.max("page_id").alias("first"), F.min("page_id").alias("least"), F.max(F.struct("page_id", "row_no"))["row_no"].alias("first_no")).where("first != least")
    again = stored(again.select("key", "first", "first_no"), "warc-again")
    again = F.broadcast(again) if again.limit(REPEATED + 1).count() <= REPEATED else again
    rows = rows.join(again, "key", "left")
    named = lambda page, no: F.concat_ws("-", F.coalesce(F.col(page).cast("string"), F.lit("none")), F.col(no).cast("string"))
    of = lambda what, name=named("page_id", "row_no"): F.concat(F.lit("<urn:capture:"), name, F.lit(f":{what}>"))
    revisit = F.coalesce(F.col("first") != F.col("page_id"), F.lit(False))
    uri = _line("WARC-Target-URI", F.col("url"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length("payload").cast("string"), F.lit(CRLF + CRLF))
    digest = _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1")))
    refers = F.when(revisit, F.concat(_line("WARC-Refers-To", of("response", named("first", "first_no"))), _line("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise("")
    response = _record(F.when(revisit, "revisit").otherwise("response"), of("response"), F.when(revisit, http).otherwise(F.concat(http, "payload")), [uri, digest, refers], "application/http; msgtype=response")
    request = _record("request", of("request"), F.concat(F.lit("GET "), F.col("url"), F.lit(f" HTTP/1.1{CRLF}{CRLF}")), [uri, _line("WARC-Concurrent-To", of("response"))], "application/http; msgtype=request")
    about = _record("metadata", of("metadata"), F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(CRLF)), [uri, _line("WARC-Concurrent-To", of("response"))], "application/warc-fields")
    out = rows.select(F.explode(F.array(request, response, about)).alias("value"))
    out.write.option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


#: Repeated payloads that may be broadcast, once they have been counted.
REPEATED = 200_000
RECORD = "record_id string, type string, concurrent_to string, refers_to string, uri string, page_id long, payload_bytes long, payload_digest string, claimed_digest string, payload binary"


class Records:
    """Puts records together from the pieces that the two line ends after them, or inside them, part."""

    def __init__(self):
        self.held, self.headers, self.need = bytearray(), None, 0

    def feed(self, piece: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
        """(headers in lower case, block) of the records that are whole with this piece."""
        self.held += piece
        self.held += b"\r\n\r\n"
        while True:
            if self.headers is None:
                start = 0
                while self.held[start : start + 2] == b"\r\n":
                    start += 2
                del self.held[:start]
                end = self.held.find(b"\r\n\r\n")
                if end < 0:
                    return
                first, *lines = bytes(self.held[:end]).decode("utf-8", "replace").split("\r\n")
                if not first.startswith("WARC/"):
                    raise ValueError(f"no WARC record: {first[:60]!r}")
                self.headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
                self.need = int(self.headers["content-length"])
                del self.held[: end + 4]
            if len(self.held) < self.need + 4:
                return
            headers, block = self.headers, bytes(self.held[: self.need])
            del self.held[: self.need + 4]
            self.headers = None
            yield headers, block


def _told(h: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    """A row of RECORD."""
    kind, page, size, digest, body = h["warc-type"], None, None, None, None
    claimed = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if kind in ("response", "revisit"):
        head, _, body = block.partition(b"\r\n\r\n")
        if kind == "response":
            size, digest = len(body), hashlib.sha1(body).hexdigest()
        else:  # its payload is the other record's; the headers kept say how long it is
            size = next((int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
            digest, body = claimed, None
    elif kind == "metadata":
        page = next((int(v) for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n")) if k == "page-id" and v.strip() != "none"), None)
    return h["warc-record-id"], kind, h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), page, size, digest, claimed, body if with_payload else None


def _read(with_payload: bool):
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = [pa.string()] * 5 + [pa.int64()] * 2 + [pa.string()] * 2 + [pa.binary()]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, records, rows, size = None, Records(), [], 0
        for batch in batches:
            for name, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name != file:
                    file, records = name, Records()
                for headers, block in records.feed(piece):
                    rows.append(_told(headers, block, with_payload))
                    size += len(block)
                    if size > READ_BYTES:
                        yield table(rows)
                        rows, size = [], 0
            yield table(rows)
            rows, size = [], 0

    return run


#: Bytes of blocks after which a reader hands its rows on.
READ_BYTES = 8 << 20


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """One row per record of the WARC files in path: gzip files, whose names end with z, and plain ones.

    A record may lie across any split, so a file is read by one task: gzip files as a stream, plain
    ones, which Spark's text reader would split, in one piece of at most 2 GB. A name that begins with
    _ or . is passed over; a folder without files gives an empty result.
    """
    read = lambda kind, names: spark.read.format(kind).option("recursiveFileLookup", "true").option("pathGlobFilter", names)
    packed = read("text", "[!_.]*z").option("lineSep", CRLF + CRLF).load(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece"))
    plain = read("binaryFile", "[!_.]*[!z]").load(path).select(F.col("path").alias("file"), F.col("content").alias("piece"))
    return packed.union(plain).mapInArrow(_read(payload), RECORD)


def transactions(records: DataFrame) -> DataFrame:
    """One nested row per capture: record_id, page_id, request, response, metadata.

    Requests and metadata are joined to the response or revisit that they are concurrent to. A
    capture without one of them has null there; records that repeat an id, as a file that is read
    twice has them, are one record. Clashing column names cannot occur: records have fixed columns.
    """
    side = lambda kind: records.where(F.col("type") == kind).groupBy(F.col("concurrent_to").alias("record_id")).agg(F.min_by(F.struct("record_id", "uri", "page_id"), "record_id").alias(kind))
    captured = records.where("type in ('response', 'revisit')").select("record_id", F.struct("type", "uri", "payload_bytes", "payload_digest", "claimed_digest", "refers_to", "payload").alias("response")).dropDuplicates(["record_id"])
    out = captured.join(side("request"), "record_id", "left").join(side("metadata"), "record_id", "left")
    return out.select("record_id", "metadata.page_id", "request", "response", "metadata")


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes pages to WARC files in the shared folder, reads them back and assembles captures:
    page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    path = shared_dir(spark, "warc")
    write_warc(pages, path, id_col, url_col, payload_col)
    captured = transactions(read_warc(spark, path, payload=False))
    refers = F.regexp_extract("response.refers_to", r"^<urn:capture:(-?\d+)-\d+:response>$", 1).cast("long")
    return captured.select("page_id", F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"), F.col("response.type").alias("record_type"), F.when(F.col("response.type") == "revisit", refers).alias("refers_to"))
