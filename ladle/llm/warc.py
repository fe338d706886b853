"""WARC archives: writing pages as transactions, reading records, and assembling captures.

A capture is a request, a response or revisit, and metadata, which name each other by
WARC-Concurrent-To. Archives are files of gzip members, one per record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ladle.llm.storage import bound_batches, left_join_hot, materialize, new_path

#: Record ids are name-based UUIDs below this one.
NAMESPACE = uuid.UUID("6f1d7c1e-6a3e-5b0f-9f3c-2a4d0c8f7b11")
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payload digests that occur more than once are broadcast up to this number (about 100 bytes each).
BROADCAST_DIGESTS = 100_000
#: gzip level of a record.
LEVEL = 3
#: Uncompressed bytes of records handed to Spark at a time.
BATCH_BYTES = 1 << 20

RECORD = "record_id string, type string, concurrent_to string, refers_to string, target_uri string, date string, payload_digest string, payload_bytes long, fields map<string,string>, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(*name: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, '|'.join(map(str, name)))}>"


def record(kind: str, record_id: str, block: bytes, content_type: str, **headers: str | None) -> bytes:
    """The bytes of one record; headers are given with _ for -, those that are None stay out."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}"]
    # a line break in a value would end the header
    lines += [f"{k.replace('_', '-')}: {v.replace('%', '%25').replace(chr(13), '%0D').replace(chr(10), '%0A') if k == 'WARC_Target_URI' and (chr(13) in v or chr(10) in v) else v}" for k, v in headers.items() if v is not None]
    lines += [f"Content-Type: {content_type}", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def transaction(page_id: int | None, url: str | None, payload: bytes, first: int | None, date: str) -> list[bytes]:
    """Request, response or revisit, and metadata of one page. first: the page whose response has this payload."""
    sha = digest(payload)
    own = _record_id("capture", page_id, sha)
    same = first is None or first == page_id
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    common = {"WARC_Date": date, "WARC_Target_URI": url}
    fields = b"" if page_id is None else f"page-id: {page_id}\r\n".encode()
    named = {"WARC_Payload_Digest": f"sha1:{sha}"}
    if not same:
        named |= {"WARC_Profile": REVISIT, "WARC_Refers_To": _record_id("capture", first, sha)}
    return [
        record("request", _record_id("request", page_id, sha), b"GET / HTTP/1.1\r\n\r\n", "application/http; msgtype=request", **common, WARC_Concurrent_To=own),
        record("response" if same else "revisit", own, head + payload if same else head, "application/http; msgtype=response", **common, **named),
        record("metadata", _record_id("metadata", page_id, sha), fields, "application/warc-fields", **common, WARC_Concurrent_To=own),
    ]


def _write(directory: str, date: str):
    def run(batches):
        context = TaskContext.get()
        uri = f"{directory}/pages-{context.partitionId():06d}-{context.taskAttemptId()}.warc.gz"
        out, n = None, 0
        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, html, first = (batch.column(k)[i].as_py() for k in range(4))
                if out is None:
                    fs, path = pa.fs.FileSystem.from_uri(uri)
                    fs.create_dir(path.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(path, compression=None)
                for data in transaction(page_id, url, (html or "").encode(), first, date):
                    out.write(gzip.compress(data, LEVEL, mtime=0))
                    n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([n], pa.int64())], ["path", "n_records"])

    return run


def write_warc(pages: DataFrame, directory: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_payload_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes a transaction per row of pages, and returns the manifest (path, n_records), a row per archive.

    The payload is the html in UTF-8, empty for a null. Of rows with equal payloads of at least
    min_payload_bytes, those with the smallest id are responses and the others revisits of it; smaller payloads are
    all responses. Rows without an id are responses where no row with an id has their payload. A line break in
    a url is percent-encoded. Up to BROADCAST_DIGESTS repeated digests, rows are written where they are read and only digests are shuffled;
    beyond it rows are dealt out by digest, but for those of a digest with a large share of all rows. A task writes under a name
    of its own, and only the names in the manifest count. Other columns are not looked at.
    """
    bound_batches(pages.sparkSession)
    directory = directory or new_path(pages.sparkSession, "warc")
    given = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    sha = F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary"))
    long_enough = F.octet_length(F.coalesce(F.col("html"), F.lit(""))) >= min_payload_bytes
    repeated = materialize(given.where(long_enough).select("id", sha.alias("sha")).groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first", "n"), "digests")
    named = given.withColumn("sha", F.when(long_enough, sha))
    n, total = repeated.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    planned = named.join(F.broadcast(repeated.drop("n")), "sha", "left") if n <= BROADCAST_DIGESTS else left_join_hot(named, repeated, "sha", "n", total)
    return materialize(planned.select("id", "url", "html", "first").mapInArrow(_write(directory, date), "path string, n_records long"), "manifest")


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an uncompressed stream. Header names are lower-cased; of a repeated one the first counts."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers.setdefault(name.strip().lower(), value.strip())
        yield headers, stream.read(int(headers.get("content-length", 0)))


def _fields(block: bytes) -> dict[str, str]:
    lines = (line.partition(":") for line in block.decode("utf-8", "replace").splitlines() if ":" in line)
    return {name.strip().lower(): value.strip() for name, _, value in lines}


def _row(headers: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    kind = headers.get("warc-type")
    named = headers.get("warc-payload-digest", "")
    sha, size, fields, payload = named.partition(":")[2] or None, None, None, None
    if kind in ("response", "revisit") and headers.get("content-type", "").startswith("application/http"):
        head, _, body = block.partition(b"\r\n\r\n")
        fields = _fields(head.partition(b"\r\n")[2])
        if kind == "response":
            payload, size, found = body, len(body), digest(body)
            if sha and sha != found:
                raise ValueError(f"{headers['warc-record-id']}: the payload doesn't have its digest")
            sha = found
        else:
            size = int(fields["content-length"]) if fields.get("content-length", "").isdigit() else None
    elif kind == "metadata":
        fields = _fields(block)
    return headers.get("warc-record-id"), kind, headers.get("warc-concurrent-to"), headers.get("warc-refers-to"), headers.get("warc-target-uri"), headers.get("warc-date"), sha, size, fields, payload if with_payload else None


_ARROW = [pa.string()] * 7 + [pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary()]


def _read(with_payload: bool):
    names = [x.split()[0] for x in RECORD.split(", ")]

    def run(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                fs, path = pa.fs.FileSystem.from_uri(uri)
                with fs.open_input_stream(path, compression=None) as source:
                    rows, size = [], 0
                    for headers, block in parse(io.BufferedReader(gzip.GzipFile(fileobj=source, mode="rb"), 1 << 16)):
                        rows.append(_row(headers, block, with_payload))
                        size += len(block)
                        if size >= BATCH_BYTES or len(rows) >= 2000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW)], names)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW)], names)

    return run


def read_warc(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the archives named in the column path, a row per record (see RECORD).

    An archive is read as a stream, so that memory holds one record and one batch. The digest and size of a response
    are those of the payload as read, and a digest in its header that differs is an error; those of a revisit are as
    its headers say. fields: the HTTP headers of a capture, the lines of metadata."""
    n = max(1, archives.count())
    return archives.select("path").repartition(n).mapInArrow(_read(with_payload), RECORD)


def _numbered(records: DataFrame, key: str) -> DataFrame:
    return records.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy("record_id")))


def _nested(prefix: str, *names: str) -> Column:
    return F.when(F.col(f"{prefix}_record_id").isNotNull(), F.struct(*[F.col(f"{prefix}_{n}").alias(n) for n in names])).alias(prefix)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: (record_id, record_type, target_uri, date, refers_to, payload_digest, payload_bytes, payload, request, metadata).

    A request and metadata belong to the response or revisit that their WARC-Concurrent-To names, or that
    names them by its own. A capture without them has null there; requests without a capture make no row.
    Where records share ids, as those of repeated pages do, they are paired in order, each one once.
    The records are written out first, as several joins read them.
    """
    records = materialize(records, "records")
    captures = _numbered(records.where("type in ('response', 'revisit')"), "record_id").withColumnRenamed("record_id", "id")
    named = captures.where("concurrent_to is not null").groupBy("concurrent_to").agg(F.min("id").alias("by_capture")).withColumnRenamed("concurrent_to", "named_id")
    out = captures
    for kind in ("request", "metadata"):
        own = records.where(F.col("type") == kind).join(named.hint("merge"), F.col("record_id") == F.col("named_id"), "left").withColumn("of", F.coalesce("by_capture", "concurrent_to")).where("of is not null")
        own = _numbered(own, "of").select("of", "nth", *[F.col(c).alias(f"{kind}_{c}") for c in ("record_id", "target_uri", "fields")])
        # archives compress well: a join must not go by the size of their files and broadcast the records
        out = out.join(own.hint("merge"), (out["id"] == own["of"]) & (out["nth"] == own["nth"]), "left").drop(own["of"], own["nth"])
    return out.select(F.col("id").alias("record_id"), F.col("type").alias("record_type"), "target_uri", "date", "refers_to", "payload_digest", "payload_bytes", "payload", _nested("request", "record_id", "target_uri"), _nested("metadata", "record_id", "fields"))


def with_referred(captures: DataFrame, field: str = "page-id") -> DataFrame:
    """Adds page_id, from the metadata field, and refers_to_page: the page_id of the response that a revisit refers to, null where that isn't there.

    The captures are written out without payloads first. The revisits of a response that many refer to stay where they are."""
    paged = captures.withColumn("page_id", F.col("metadata.fields")[field].cast("long"))
    links = materialize(paged.select("record_type", "record_id", "refers_to", "page_id"), "links")
    asked = links.where("record_type = 'revisit' and refers_to is not null").groupBy("refers_to").agg(F.count("*").alias("n"))
    pages = links.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to")).agg(F.min("page_id").alias("refers_to_page"))
    referred = materialize(asked.join(pages.hint("merge"), "refers_to"), "referred")
    total = referred.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    revisits = left_join_hot(paged.where("record_type = 'revisit'"), referred, "refers_to", "n", total)
    return paged.where("record_type = 'response'").withColumn("refers_to_page", F.lit(None).cast("long")).unionByName(revisits)
