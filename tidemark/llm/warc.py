"""WARC archives of pages: written by Spark, normalised from whole-file gzip to one member a record, and read back by index.

1. ``write`` decides by digest which pages repeat an earlier payload and lets Spark's text sink write the records: the two line
   breaks that end a record are the sink's line separator, and its gzip codec makes each archive one gzip stream.  Spark's
   commit protocol keeps lost executors from leaving half archives.
2. ``normalise`` inflates each archive once, as a stream, and rewrites every record as a gzip member of its own; the sidecar
   index has each member's archive, offset and length.  An archive is written under a name of its own for each attempt, so
   only archives of attempts that succeeded are in the index, and no two attempts write one file.
3. ``read`` opens any record by the index alone.

Archives may be longer than memory: neither step holds more than one chunk, or where a payload is asked for one record.
Files are reached by URI through pyarrow's file systems (local or mounted folders, HDFS and the common object stores).
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import settled, shared_folder, trim

#: Payloads of fewer bytes are never revisited.
LEAST_BYTES = 100
#: The pages have no time of their own.
DATE = "2024-01-01T00:00:00Z"
RECORD_END = "\r\n\r\n"
CHUNK = 1 << 20
#: Rows of a batch that is handed back to Spark, and bytes of payloads in it.
ROWS, PAYLOADS = 4096, 8 << 20
#: A record's headers must end within so many bytes.
HEADER_BYTES = 1 << 20
GZIP = 31
LEVEL = 6
RECORDS_A_FILE = 1_000_000

INDEX = "archive string, record long, offset long, length long, record_id string, record_type string, target_uri string, payload_digest string"


def classify(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, record_type and refers_to.

    Of pages whose payloads are equal and have ``least`` bytes or more, those with the smallest id are responses and all
    others revisit it.  A null payload is empty; a null id counts as the largest; rows that repeat the smallest id are all
    responses.  Payloads travel once, to their digest; a frequent one is a skewed join key, which Spark splits, and short
    payloads have keys of their own.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), html.alias("html"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("html").cast("long"), "payload_digest": F.sha2(F.col("html").cast("binary"), 256)})
    long = rows.where(F.col("payload_bytes") >= least)
    several = long.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    several = settled(several.select(F.col("payload_digest").alias("repeated"), "first"), "repeats")
    alone = F.concat(F.lit("-"), F.col("page_id").cast("string"), F.lit("-"), F.xxhash64("url"))
    rows = rows.withColumn("at", F.when(F.col("payload_bytes") >= least, F.col("payload_digest")).otherwise(F.coalesce(alone, F.lit("-"))))
    rows = rows.join(several, F.col("at") == F.col("repeated"), "left")
    again = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first")))
    return rows.select(
        "page_id", "url", "html", "payload_bytes", "payload_digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"),
    )


def _record(date: str) -> Column:
    """A page's record, without the line breaks behind it.  What could end a header line early is percent-encoded in the URL."""
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    uri = F.coalesce(F.replace(F.replace(F.trim("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), F.lit(""))
    again = F.col("record_type") == "revisit"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    body = F.when(again, http).otherwise(F.concat(http, F.col("html")))
    lines = [
        F.concat(F.lit("WARC/1.1\r\nWARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), name("page_id")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("payload_digest")),
        F.when(again, F.concat(F.lit("WARC-Refers-To: "), name("refers_to"))),
        F.when(again, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(RECORD_END), body)


def write(pages: DataFrame, folder: str, least: int = LEAST_BYTES, date: str = DATE) -> None:
    """Writes a record for every page into whole-file gzip archives in ``folder``: one archive for each partition of the classified pages.

    ``page_id``, ``url`` and ``html`` are used, other columns ignored; nulls, ties and repeated rows as in ``classify``; a
    null URL is an empty one; an empty table gives archives without records, or none.
    """
    records = classify(pages, least).select(_record(date).alias("value"))
    records.write.option("compression", "gzip").option("lineSep", RECORD_END).option("maxRecordsPerFile", RECORDS_A_FILE).text(folder)


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def inflated(stream) -> Iterator[bytes]:
    """What a gzip file of one or several members holds, in chunks; one that breaks off is refused."""
    member, pending = None, b""
    while chunk := pending or stream.read(CHUNK):
        pending = b""
        member = member or zlib.decompressobj(GZIP)
        data = member.decompress(chunk, CHUNK)
        while True:
            if data:
                yield data
            if member.eof or not member.unconsumed_tail:
                break
            data = member.decompress(member.unconsumed_tail, CHUNK)
        if member.eof:
            pending, member = member.unused_data, None
    if member is not None:
        raise ValueError("a gzip stream breaks off")


def parse(header: bytes) -> dict[str, str]:
    """Fields of a record's header, names in lower case.  The first line must name a WARC version."""
    first, *lines = header.decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict, Iterator[bytes]]]:
    """Header fields and pieces of each record (header, body and the breaks behind it).  The pieces must be used up before the next record."""
    held = b""
    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if len(held) > HEADER_BYTES:
                raise ValueError("a record's header does not end")
            more = next(chunks, None)
            if more is None:
                if held.strip():
                    raise ValueError("a record's header breaks off")
                return
            held += more
        fields = parse(held[:end].lstrip(b"\r\n"))
        need = end + 4 + int(fields["content-length"])

        def pieces(left: int = need + 4) -> Iterator[bytes]:
            nonlocal held
            while len(held) < left:
                left -= len(held)
                if held:
                    yield held
                held = next(chunks, None)
                if held is None:
                    raise ValueError("a record breaks off")
            piece, held = held[:left], held[left:]
            if not piece.endswith(b"\n"):
                raise ValueError("a record is longer or shorter than it says")
            yield piece

        yield fields, pieces()


def _put(out, data: bytes) -> int:
    out.write(data)
    return len(data)


def _rewritten(source: str, folder: str) -> Iterator[tuple]:
    """Writes the records of one archive as members of a new one; a row of the index for each."""
    files, path = _open(source)
    name = f"{folder.rstrip('/')}/{uuid.uuid4().hex}.warc.gz"
    out_files, out_path = _open(name)
    offset = 0
    with files.open_input_stream(path, compression=None) as stream, out_files.open_output_stream(out_path, compression=None) as out:
        for i, (fields, pieces) in enumerate(records(inflated(stream))):
            press, length = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP), 0
            for piece in pieces:
                length += _put(out, press.compress(piece))
            length += _put(out, press.flush())
            digest = fields.get("warc-payload-digest")
            yield name, i, offset, length, fields.get("warc-record-id"), fields.get("warc-type"), fields.get("warc-target-uri"), digest
            offset += length


def normalise(spark: SparkSession, source: str, folder: str) -> DataFrame:
    """Rewrites all archives (``*.gz``) below ``source`` into ``folder`` and returns the index, which lies there as well, in ``index``.

    One row a record: archive, record (number within it from 0), offset, length, record_id, record_type, target_uri and
    payload_digest as the header has them.  An archive that breaks off, or holds something else than records, is refused.
    A file without records gives no rows; a folder without archives an empty index.
    """
    files, path = _open(folder)
    files.create_dir(path, recursive=True)

    def run(batches):
        sources = (x for batch in batches for x in batch.column(0).to_pylist())
        yield from _batches((row for x in sources for row in _rewritten(x, folder)), INDEX)
        trim()

    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("path")
    archives.mapInArrow(run, INDEX).write.parquet(f"{folder.rstrip('/')}/index")
    return spark.read.schema(INDEX).parquet(f"{folder.rstrip('/')}/index")


_KINDS = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}


def _batches(rows: Iterator[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of ``ROWS`` rows or ``PAYLOADS`` bytes in the last column."""
    names, kinds = zip(*(x.split() for x in schema.split(", ")))
    some, weight = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, k in zip(zip(*some), kinds)], list(names))

    for row in rows:
        some.append(row)
        weight += len(row[-1] or b"")
        if len(some) == ROWS or weight > PAYLOADS:
            yield batch()
            some, weight = [], 0
    if some:
        yield batch()


def _page(name: str | None) -> int | None:
    number = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number.lstrip("-").isdigit() else None


FOUND = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, payload binary"


def read(index: DataFrame, payloads: bool = False) -> DataFrame:
    """Reads every record of the index: page_id, payload_bytes, payload_digest (SHA-256, bare lower-case hex), record_type, refers_to, target_uri, payload.

    Size and digest of a response are those of the payload as read, which must be the ones that its headers say; a revisit
    holds no payload and keeps what its headers say of it.  ``payload`` is null unless ``payloads`` asks for it; see
    ``resolved`` for those of revisits.  Rows of the index may be any subset, in any order.
    """
    def one(member: bytes) -> tuple:
        fields, pieces = next(records(iter([zlib.decompress(member, GZIP)])))
        _, _, block = b"".join(pieces).lstrip(b"\r\n").partition(b"\r\n\r\n")
        http, _, body = block[: int(fields["content-length"])].partition(b"\r\n\r\n")
        said = int(dict(line.lower().split(b": ", 1) for line in http.split(b"\r\n")[1:])[b"content-length"])
        digest = fields["warc-payload-digest"].removeprefix("sha256:")
        again = fields["warc-type"] == "revisit"
        if not again and (said != len(body) or digest != hashlib.sha256(body).hexdigest()):
            raise ValueError(f"{fields['warc-record-id']}: the payload is not the one its headers describe")
        return _page(fields["warc-record-id"]), said, digest, fields["warc-type"], _page(fields.get("warc-refers-to")), fields.get("warc-target-uri"), body if payloads and not again else None

    def members(batches) -> Iterator[bytes]:
        opened, file = None, None
        for batch in batches:
            for archive, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if archive != opened:
                    if file is not None:
                        file.close()
                    files, path = _open(archive)
                    opened, file = archive, files.open_input_file(path)
                file.seek(offset)
                yield file.read(length)
        if file is not None:
            file.close()

    def run(batches):
        yield from _batches(map(one, members(batches)), FOUND)

    return index.select("archive", "offset", "length").mapInArrow(run, FOUND)


def resolved(found: DataFrame) -> DataFrame:
    """The rows of ``read(..., payloads=True)`` with the payloads of revisits taken from the responses they refer to.

    Rows that share an id and payload give one response for this; a revisit whose response is not among the rows keeps null.
    """
    sent = found.where("record_type = 'response'").groupBy("page_id", "payload_digest").agg(F.first("payload").alias("sent"))
    sent = sent.select(F.col("page_id").alias("to"), F.col("payload_digest").alias("as"), "sent")
    rows = found.join(sent, (F.col("refers_to") == F.col("to")) & (F.col("payload_digest") == F.col("as")), "left")
    return rows.withColumn("payload", F.coalesce("payload", "sent")).select(found.columns)


def round_trip(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """Writes archives of all pages into the shared folder, normalises them and reads them back."""
    spark = pages.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write(pages, f"{folder}/whole", least)
    index = normalise(spark, f"{folder}/whole", f"{folder}/records")
    delete(spark, f"{folder}/whole")
    return read(index).drop("payload", "target_uri")


def delete(spark: SparkSession, folder: str) -> None:
    """Deletes a folder on whatever file system Spark reaches it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
