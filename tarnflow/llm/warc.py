"""WARC derivatives: each response record gives a metadata and a plain-text conversion record that refer to it."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from bisect import bisect_left
from itertools import accumulate, groupby

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnflow.llm.common import blank_to_empty, slices, table
from tarnflow.llm.html_extract import text_of

#: Fixed values of the WARC format.
VERSION, END = "WARC/1.1", "\r\n\r\n"
FIELDS = "application/warc-fields"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the namespace of names that are URLs
CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)
META_CHARSET = re.compile(rb"""<meta[^>]{0,200}?charset\s*=\s*["']?([\w.:-]+)""", re.I)
CHUNK = re.compile(rb"[ \t]*([0-9a-fA-F]+)[^\r\n]*\r?\n")
NAMED = {"WARC-Type": "record_type", "WARC-Record-ID": "record_id", "WARC-Date": "date", "WARC-Target-URI": "target_uri", "WARC-Refers-To": "refers_to", "Content-Type": "content_type", "WARC-Block-Digest": "block_digest", "WARC-Payload-Digest": "payload_digest", "Content-Length": "length"}

#: Derivatives that a task holds before it hands them on.
HELD_ROWS, HELD_BYTES = 256, 4 << 20

RECORD = T.StructType([
    T.StructField("record_id", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.StringType()),
    T.StructField("target_uri", T.StringType()), T.StructField("date", T.StringType()), T.StructField("content_type", T.StringType()),
    T.StructField("block_digest", T.StringType()), T.StructField("payload_digest", T.StringType()), T.StructField("length", T.LongType()), T.StructField("block", T.BinaryType()),
])


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    """The same urn for the same parts, so that a task that runs again names its records alike."""
    return f"<urn:uuid:{uuid.uuid5(SPACE, chr(0).join(parts))}>"


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, header fields and payload of an HTTP response; a block without a header is all payload."""
    head, gap, payload = block.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"HTTP/"):
        return "", [], block
    first, *lines = head.decode("latin-1").split("\r\n")
    fields: list[tuple[str, str]] = []
    for line in lines:
        if line[:1] in (" ", "\t") and fields:
            fields[-1] = (fields[-1][0], f"{fields[-1][1]} {line.strip()}")
        else:
            name, _, value = line.partition(":")
            fields.append((name.strip(), value.strip()))
    return first, fields, payload


def unchunked(payload: bytes) -> bytes:
    """The content of a chunked payload; what comes after a broken chunk is left out, a payload without chunks stays."""
    at, parts = 0, []
    while m := CHUNK.match(payload, at):
        size = int(m[1], 16)
        if not size:
            return b"".join(parts)
        parts.append(payload[m.end() : m.end() + size])
        at = m.end() + size
        at += 2 if payload.startswith(b"\r\n", at) else 1 if payload.startswith(b"\n", at) else 0
    return b"".join(parts) if parts else payload


def _inflated(data: bytes, window: int) -> bytes:
    """As much as can be inflated; members follow one another in gzip."""
    out = []
    while data:
        stream = zlib.decompressobj(window)
        try:
            out.append(stream.decompress(data))
        except zlib.error:
            if not out and window == zlib.MAX_WBITS:  # deflate without its frame, as some servers send it
                return _inflated(data, -zlib.MAX_WBITS)
            break
        data = stream.unused_data if window > zlib.MAX_WBITS else b""
    return b"".join(out)


def content_of(payload: bytes, fields: list[tuple[str, str]]) -> bytes | None:
    """The payload with its transfer and content encodings undone, last applied first; None for an encoding that isn't known here."""
    given = lambda name: [x.strip().lower() for n, v in fields if n.lower() == name for x in v.split(",")]
    for coding in reversed([*given("content-encoding"), *given("transfer-encoding")]):
        if coding == "chunked":
            payload = unchunked(payload)
        elif coding in ("gzip", "x-gzip"):
            # Crawlers that decode on the way keep the header.
            payload = _inflated(payload, zlib.MAX_WBITS | 16) if payload[:2] == b"\x1f\x8b" else payload
        elif coding == "deflate":
            payload = _inflated(payload, zlib.MAX_WBITS) or payload
        elif coding == "zstd":
            try:
                payload = zstandard.ZstdDecompressor().decompressobj().decompress(payload)
            except zstandard.ZstdError:
                return None
        elif coding not in ("identity", ""):
            return None
    return payload


def decode(payload: bytes, content_type: str) -> str:
    """Text by the charset of the header, else of a byte order mark, else of the page, else UTF-8; unknown or broken charsets are UTF-8."""
    found = CHARSET.search(content_type)
    name = found[1] if found else ""
    if not name:
        marked = META_CHARSET.search(payload[:1024])
        name = "utf-8-sig" if payload.startswith(b"\xef\xbb\xbf") else "utf-16" if payload[:2] in (b"\xff\xfe", b"\xfe\xff") else marked[1].decode() if marked else "utf-8"
    try:
        return payload.decode(name, "replace")
    except (LookupError, ValueError):  # ValueError: names that aren't text encodings, or codecs that can't replace
        return payload.decode("utf-8", "replace")


def derive(source_id: str | None, uri: str, date: str, block: bytes) -> list[tuple[str, str, str, str, str, bytes]]:
    """Record type, id, content type, block digest, source's payload digest and block of both derivatives."""
    status, fields, payload = split_http(block)
    kind = next((v for n, v in fields if n.lower() == "content-type"), "")
    source, whole_block = digest(payload), digest(block)
    content = content_of(payload, fields)
    text = ""
    if content is not None:
        is_text = not kind or "html" in kind.lower() or kind.lower().startswith("text/")
        text = decode(content, kind) if is_text else ""
        if "html" in kind.lower() or (not kind and "<" in text):
            text = text_of(text)
    told = [("source-record", source_id or ""), ("source-block-digest", whole_block), ("source-payload-digest", source), ("source-payload-length", str(len(payload))), ("source-status", status), *((f"source-header-{n.lower()}", v) for n, v in fields)]
    meta = "".join(f"{n}: {v}\r\n" for n, v in told).encode()
    plain = text.encode("utf-8", "replace")
    # Without an id the source's content names the derivatives.
    named = [source_id] if source_id else ["", uri, date, whole_block]
    return [
        ("metadata", record_id("metadata", *named), FIELDS, digest(meta), source, meta),
        ("conversion", record_id("conversion", *named), "text/plain; charset=utf-8", digest(plain), source, plain),
    ]


def responses_of_pages(pages: DataFrame, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Response records of raw pages, with ``page_id``: the block is an HTTP response that carries the html."""

    def run(batches):
        for batch in slices(batches):
            rows = []
            for key, url, html in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), batch.column("html").to_pylist()):
                body = html.encode("utf-8", "replace")
                block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
                rows.append((record_id("response", str(key), url or "", date), "response", None, url, date, "application/http; msgtype=response", digest(block), digest(body), len(block), block))
            yield _batch(batch.column("page_id"), rows)

    src = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), blank_to_empty(F.col(html_col)).alias("html"))
    return src.mapInArrow(run, T.StructType([src.schema["page_id"], *RECORD.fields]))


def _batch(key: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    records = _records(rows)
    return pa.RecordBatch.from_arrays([key, *records.columns], ["page_id", *records.schema.names])


def derivative_records(responses: DataFrame, key: str = "page_id") -> DataFrame:
    """Two records per response: ``metadata`` and ``conversion``, in the columns of a record and the response's key.

    Both keep the target URI and date, refer to the response by its id, and carry the digest of its payload; the metadata's fields
    repeat the source's digests, status line and every header field in order.  The text comes from the payload with its transfer and content
    encodings undone (gzip, deflate, zstd, chunked).  One pass without a shuffle, a few records in memory at a time.

    Records of other types give nothing.  Null blocks are empty; null URIs and dates stay null.  A response without an id gives derivatives that refer to
    nothing and are named by its URI, date and block.  Payloads that aren't text, or in an encoding not known here, convert to an empty text; damaged ones to
    what can be read.  Repeated responses give repeated derivatives with equal ids.  An empty table gives no rows; other columns are ignored.
    """

    def run(batches):
        for batch in slices(batches):
            rows: list[tuple] = []
            owner: list[int] = []
            held = 0
            for i, (source, uri, date, block) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("record_id", "target_uri", "date", "block")))):
                for kind, rid, content, block_digest, payload_digest, data in derive(source, uri or "", date or "", block or b""):
                    rows.append((rid, kind, source, uri, date, content, block_digest, payload_digest, len(data), data))
                    owner.append(i)
                    held += len(data)
                if len(rows) >= HELD_ROWS or held >= HELD_BYTES:
                    yield _batch(batch.column("page_id").take(pa.array(owner)), rows)
                    rows, owner, held = [], [], 0
            yield _batch(batch.column("page_id").take(pa.array(owner, pa.int64())), rows)

    src = responses.where(F.col("record_type") == "response").select(F.col(key).alias("page_id"), "record_id", "target_uri", "date", "block")
    return src.mapInArrow(run, T.StructType([src.schema["page_id"], *RECORD.fields]))


# Files


def serialise(record: dict) -> bytes:
    """A record as it stands in a WARC file, without the two line ends that close it."""
    head = "\r\n".join([VERSION, *(f"{name}: {record[c]}" for name, c in NAMED.items() if record[c] is not None)])
    return head.encode("utf-8", "replace") + END.encode() + (record["block"] or b"")


def parse_record(data: bytes) -> tuple[dict, int]:
    """A record from its version on, and how many bytes of its block are missing; what follows the block is ignored.

    A record without a readable Content-Length takes all there is but the closing line ends.
    """
    head, _, block = data.partition(END.encode())
    record: dict = dict.fromkeys(RECORD.names)
    known = {n.lower(): c for n, c in NAMED.items()}
    fields: list[list[str]] = []
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and fields:
            fields[-1][1] += f" {line.strip()}"
        else:
            name, _, value = line.partition(":")
            fields.append([name.strip().lower(), value.strip()])
    for name, value in fields:
        if name in known and record[known[name]] is None:
            record[known[name]] = value
    size = record["length"]
    if size is not None and size.isascii() and size.isdigit():
        record["length"] = int(size)
        missing = max(0, record["length"] - len(block))
        block = block[: record["length"]]
    else:
        block, missing = block.removesuffix(END.encode()), 0
        record["length"] = len(block)
    record["block"] = block
    return record, missing


def assemble(pieces: list[bytes], last: bool) -> tuple[list[dict], list[bytes]]:
    """Records of the pieces between separators, and the pieces of a record that goes on in the next ones.

    A block may hold separators, so pieces are joined until it has its length.  In the ``last`` pieces of a file a record that never has it is cut off
    at the next separator.
    """
    out: list[dict] = []
    ends = list(accumulate(len(END) + 5 + len(p) for p in pieces))
    at = 0
    while at < len(pieces):
        head = pieces[at] if pieces[at].startswith(b"WARC/") else b"WARC/" + pieces[at]
        record, missing = parse_record(head)
        past = at + 1
        if missing:
            past = bisect_left(ends, ends[at] + missing) + 1
            if past > len(pieces):
                if not last:
                    break
                past = at + 1
            else:
                record, _ = parse_record((END.encode() + b"WARC/").join([head, *pieces[at + 1 : past]]))
        if record["record_type"] is not None:
            out.append(record)
        at = past
    return out, pieces[at:]


def parse(data: bytes) -> list[dict]:
    """The records of an uncompressed WARC file."""
    return assemble(data.split(END.encode() + b"WARC/"), True)[0]


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files, plain or gzip (a member a record or one for all), in the columns of a record.

    Spark's text source cuts the files at the line ends before a version, so plain files are read in splits and any store that Spark reads will do.  A
    block that holds such a separator is put together again within its split; a record cut off by its file's end keeps what there is.
    """

    def run(batches):
        name, waiting = None, []
        for batch in batches:
            found: list[dict] = []
            pieces = zip(batch.column("file").to_pylist(), batch.column("value").to_pylist())
            for file, own in groupby(pieces, key=lambda x: x[0]):
                if file != name:
                    found += assemble(waiting, True)[0]
                    name, waiting = file, []
                records, waiting = assemble([*waiting, *(p for _, p in own)], False)
                found += records
            yield _records([tuple(r[c] for c in RECORD.names) for r in found])
        yield _records([tuple(r[c] for c in RECORD.names) for r in assemble(waiting, True)[0]])

    text = spark.read.option("lineSep", END + "WARC/").text(path)
    return text.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file")).mapInArrow(run, RECORD)


def _records(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * len(RECORD)
    types = [{"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[f.dataType.simpleString()] for f in RECORD]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], RECORD.names)


def write_warc(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """WARC files, one a partition; blocks may hold any bytes.

    With gzip each record is a member of its own, so that it can be read from its place in the file; the line ends that close it are the next
    member.  Spark's text writer puts them between the records as its separator.
    """
    zipped = compression == "gzip"
    if not zipped and compression != "none":
        raise ValueError(f"compression is gzip or none, not {compression}")

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                data = serialise(row)
                yield pa.RecordBatch.from_arrays([pa.array([gzip.compress(data, mtime=0) if zipped else data], pa.binary())], ["value"])

    end = gzip.compress(END.encode(), mtime=0).decode("latin-1") if zipped else END
    raw = records.select(*RECORD.names).mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    raw.write.option("encoding", "ISO-8859-1").option("lineSep", end).option("compression", "none").text(path)
    # The text writer's own ending would keep Spark from unpacking them.
    spark = records.sparkSession
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in files.listStatus(folder):
        name = status.getPath().getName()
        if name.endswith(".txt"):
            files.rename(status.getPath(), folder.suffix(f"/{name.removesuffix('.txt')}.warc{'.gz' if zipped else ''}"))


def op2_derivative_records(spark, sf_dir: str) -> DataFrame:
    out = derivative_records(responses_of_pages(table(spark, sf_dir, "pages")))
    return out.withColumn("block_text", F.col("block").cast("string")).drop("block")
