"""WARC archives with revisit resolution.

Finding revisits: headers (payload digest, length, id) are shuffled by digest to find,
for every payload of at least ``LEAST_BYTES`` that several records hold, the record
with the largest id.  That one becomes a response; the others become revisit records
with fresh headers that refer to it, and carry no payload.  Where at most
``BROADCAST_ROWS`` payloads are held several times, they go to all tasks and no body
is shuffled; where there are more, records are joined with them by digest, which
shuffles each body once.

Writing: every record is a gzip member of its own, as readers that seek by record
need.  Members go out through Spark's own text writer: any file system that Spark
knows will do, and the committer drops what a lost executor had begun.  The writer's
record separator is an empty gzip member, which every gzip reader passes over.  A file
is closed after about ``FILE_BYTES`` of payload, by the mean length of a record.

Reading: the separator cannot occur inside a member of text (its second and third
byte are not UTF-8, and deflate leaves no run of it by any chance worth counting), so
that Spark's text reader hands out record after record and no task ever holds a file.
A record is parsed by Content-Length, so a payload may hold anything.  ``resolve``
joins revisits to their responses.

Defined cases: a null html counts as an empty payload; a null URL gives the
record's own urn as target; line ends in URLs are percent-encoded; rows that
repeat the largest id of a payload are responses each; a row with a null id can be
a revisit but is never referred to (payloads that only such rows hold are
responses); an empty table gives no records; further columns do not clash since
only id, URL and html are read.
"""

from __future__ import annotations

import gzip
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BATCH_BYTES, map_arrow, materialise, scratch_path, table

LEAST_BYTES = 1000
#: Payload bytes of a file, about, and the most payloads that are sent to all tasks.
FILE_BYTES, BROADCAST_ROWS = 256 << 20, 100_000
LEVEL = 6
#: Between members: a gzip member that holds nothing.  Latin-1 keeps its bytes.
EMPTY = gzip.compress(b"", mtime=0)
_TEXT = {"lineSep": EMPTY.decode("latin-1"), "encoding": "ISO-8859-1"}
DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"
END = CRLF + CRLF
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "record_id string, record_type string, target_uri string, payload_digest string, refers_to string, payload_bytes long, payload binary"


def _urn(page: Column) -> Column:
    return F.concat(F.lit("urn:page:"), F.coalesce(page.cast("string"), F.lit("none")))


def originals(headers: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """Per payload that several records hold: digest, length and the largest id."""
    large = headers.filter(F.col("size") >= least)
    held = large.groupBy("digest", "size").agg(F.max("id").alias("original"), F.count(F.lit(1)).alias("n"))
    return held.filter("n > 1 AND original IS NOT NULL").select("digest", "size", "original")


def _member(record: bytes) -> bytes:
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return pack.compress(record) + pack.flush()


def _members(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([_member(x.as_py().encode("utf-8")) for x in b.column(0)], pa.binary())], names=["member"])


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_BYTES) -> None:
    """Write deduplicated archives of ``pages`` below ``path``."""
    body = F.coalesce(F.col(f"`{html}`"), F.lit(""))
    rows = pages.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{url}`").alias("url"), body.alias("body"))
    rows = rows.withColumns({"digest": F.sha1(F.col("body").cast("binary")), "size": F.octet_length("body").cast("long")})
    headers = materialise(rows.select("id", "digest", "size"), "headers")
    found = materialise(originals(headers, least), "originals")
    small = found.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    mean = headers.agg(F.avg("size")).first()[0] or 0.0
    # records under the least length meet nothing: null keys keep them out of the join
    joined = rows.withColumn("of", F.when(F.col("size") >= least, F.col("digest"))).join((F.broadcast(found) if small else found).withColumnsRenamed({"digest": "of", "size": "of_size"}), "of", "left").drop("of", "of_size")
    revisit = F.col("original").isNotNull() & ~F.col("id").eqNullSafe(F.col("original"))
    uri = F.regexp_replace(F.regexp_replace(F.coalesce("url", _urn(F.col("id"))), "\r", "%0D"), "\n", "%0A")
    http = F.concat(F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + "Content-Length: "), F.col("size").cast("string"), F.lit(END))
    length = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.octet_length("body"))
    refers = F.when(revisit, F.concat(F.lit(f"WARC-Profile: {_PROFILE}{CRLF}WARC-Refers-To-Date: {DATE}{CRLF}WARC-Refers-To: <"), _urn(F.col("original")), F.lit(">" + CRLF))).otherwise("")
    head = F.concat(
        F.lit("WARC/1.1" + CRLF + "WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit(CRLF + "WARC-Record-ID: <"), _urn(F.col("id")), F.lit(">" + CRLF + f"WARC-Date: {DATE}" + CRLF + "WARC-Target-URI: "), uri,
        F.lit(CRLF + "WARC-Payload-Digest: sha1:"), F.col("digest"), F.lit(CRLF), refers,
        F.lit("Content-Type: application/http; msgtype=response" + CRLF + "Content-Length: "), length.cast("string"), F.lit(END),
    )
    record = F.concat(head, http, F.when(revisit, "").otherwise(F.col("body")), F.lit(END))
    members = map_arrow(joined.select(record.alias("record")), _members, "member binary").select(F.col("member").cast("string").alias("value"))
    members.write.options(**_TEXT).option("maxRecordsPerFile", max(1, int(FILE_BYTES / (mean + 1000)))).text(path)


def parse(data: bytes):
    """Records of uncompressed WARC data as (headers, block)."""
    at = 0
    while at < len(data):
        cut = data.index(b"\r\n\r\n", at)
        lines = data[at:cut].decode("utf-8").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start = cut + 4
        stop = start + int(headers["content-length"])
        yield headers, data[start:stop]
        at = stop + 4


def read(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Records of the archives that ``write`` left below ``path``; payloads only where
    asked for."""

    def run(batches):
        for b in batches:
            out, held = [], 0
            for member in b.column(0):
                for h, block in parse(zlib.decompress(member.as_py(), 31)):
                    payload = block.partition(b"\r\n\r\n")[2]
                    response = h["warc-type"] == "response"
                    out.append((h["warc-record-id"].strip("<>"), h["warc-type"], h["warc-target-uri"], h["warc-payload-digest"].partition(":")[2], h.get("warc-refers-to", "").strip("<>") or None, len(payload) if response else None, payload if response and payloads else None))
                    held += len(payload) if payloads else 0
                if held > BATCH_BYTES:
                    yield _batch(out)
                    out, held = [], 0
            yield _batch(out)

    members = spark.read.options(**_TEXT).text(path).select(F.col("value").cast("binary").alias("member"))
    return map_arrow(members, run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())]
    columns = list(zip(*rows)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds)], names=[n for n, _ in kinds])


def resolve(records: DataFrame) -> DataFrame:
    """Records with the length and payload of what they hold or refer to.  A revisit
    finds its response by payload digest and record id; only responses that some
    revisit names take part in the join."""
    responses = records.filter("record_type = 'response'")
    revisits = records.filter("record_type <> 'response'")
    named = revisits.select(F.col("payload_digest").alias("t_digest"), F.col("refers_to").alias("t_id")).distinct()
    plain = responses.select(F.col("record_id").alias("t_id"), F.col("payload_digest").alias("t_digest"), F.col("payload_bytes").alias("t_bytes"), F.col("payload").alias("t_payload"))
    targets = plain.join(named, ["t_id", "t_digest"], "left_semi").groupBy("t_id", "t_digest").agg(F.first("t_bytes").alias("t_bytes"), F.first("t_payload").alias("t_payload"))
    joined = revisits.join(targets, (F.col("refers_to") == F.col("t_id")) & (F.col("payload_digest") == F.col("t_digest")), "left")
    filled = joined.select("record_id", "record_type", "target_uri", "payload_digest", "refers_to", F.col("t_bytes").alias("payload_bytes"), F.col("t_payload").alias("payload"))
    return responses.unionByName(filled)


def page_of(record: Column) -> Column:
    return F.regexp_extract(record, "^urn:page:(-?[0-9]+)$", 1).try_cast("long")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write(table(spark, sf_dir, "pages"), path)
    rows = resolve(materialise(read(spark, path), "records"))
    return rows.select(page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of(F.col("refers_to")).alias("refers_to"))
