"""WARC records: encodings, broken input, files read and written, derivatives against a plain computation."""

import gzip
import hashlib
import zlib
from base64 import b32encode

import pytest
import zstandard

from tarnflow.llm import warc

HTML = "<html><body><nav>menu</nav><article><p>Grüße &amp; more</p><p>Second</p></article></body></html>"
TEXT = "Grüße & more\nSecond"


def http(body, **fields):
    head = "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in fields.items())
    return f"HTTP/1.1 200 OK\r\n{head}\r\n".encode() + body


def chunked(data, size=7):
    parts = [data[i : i + size] for i in range(0, len(data), size)]
    return b"".join(f"{len(p):x};x=y\r\n".encode() + p + b"\r\n" for p in parts) + b"0\r\n\r\n"


raw = HTML.encode()
packed = gzip.compress(raw)
deflater = zlib.compressobj(wbits=-15)
bare = deflater.compress(raw) + deflater.flush()
KIND = "text/html; charset=utf-8"
BLOCKS = {
    "plain": (http(raw, Content_Type=KIND), TEXT),
    "gzip": (http(packed, Content_Type=KIND, Content_Encoding="gzip"), TEXT),
    "two members": (http(gzip.compress(raw[:50]) + gzip.compress(raw[50:]), Content_Type=KIND, Content_Encoding="x-gzip"), TEXT),
    "said to be gzip": (http(raw, Content_Type=KIND, Content_Encoding="gzip"), TEXT),
    "deflate": (http(zlib.compress(raw), Content_Type=KIND, Content_Encoding="deflate"), TEXT),
    "bare deflate": (http(bare, Content_Type=KIND, Content_Encoding="deflate"), TEXT),
    "zstd": (http(zstandard.compress(raw), Content_Type=KIND, Content_Encoding="zstd"), TEXT),
    "chunked": (http(chunked(raw), Content_Type=KIND, Transfer_Encoding="chunked"), TEXT),
    "chunked gzip": (http(chunked(packed), Content_Type=KIND, Content_Encoding="gzip", Transfer_Encoding="chunked"), TEXT),
    "said to be chunked": (http(raw, Content_Type=KIND, Transfer_Encoding="chunked"), TEXT),
    "cut gzip": (http(gzip.compress(b"<p>" + b"word " * 5000)[:60], Content_Type=KIND, Content_Encoding="gzip"), None),
    "unknown encoding": (http(raw, Content_Type=KIND, Content_Encoding="br"), ""),
    "latin": (http(HTML.encode("latin-1"), Content_Type="text/html; charset=iso-8859-1"), TEXT),
    "charset of the page": (http(b"<meta charset='iso-8859-1'>" + HTML.encode("latin-1"), Content_Type="text/html"), TEXT),
    "mark": (http(b"\xef\xbb\xbf" + raw, Content_Type="text/html"), TEXT),
    "idna": (http(raw, Content_Type="text/html; charset=idna"), TEXT),
    "undefined": (http(raw, Content_Type="text/html; charset=undefined"), TEXT),
    "hex": (http(raw, Content_Type="text/html; charset=hex"), TEXT),
    "no charset of this name": (http(raw, Content_Type="text/html; charset=nope-1"), TEXT),
    "text": (http("a\n b".encode(), Content_Type="text/plain"), "a\n b"),
    "image": (http(b"\x89PNG\xff", Content_Type="image/png"), ""),
    "no header": (b"only < words", "only < words"),
    "surrogates": (http(b"<p>&#xD800;x", Content_Type=KIND), "�x"),
    "empty": (b"", ""),
    "none": (None, ""),
}


def digest(data):
    return "sha1:" + b32encode(hashlib.sha1(data).digest()).decode()


@pytest.fixture(scope="module")
def responses(spark):
    rows = [(i, f"<urn:{name}>", "response", f"http://x/{i}", "2020-01-01T00:00:00Z", None if b is None else bytearray(b), "clash", "clash") for i, (name, (b, _)) in enumerate(BLOCKS.items())]
    rows += [(100, None, "response", "http://x/a", None, bytearray(BLOCKS["plain"][0]), "", ""), (101, None, "response", None, None, bytearray(BLOCKS["text"][0]), "", ""), (102, "<urn:q>", "request", "", "", bytearray(b"GET"), "", "")]
    return spark.createDataFrame(rows, "page_id long, record_id string, record_type string, target_uri string, date string, block binary, refers_to string, kind string").repartition(3)


def test_derivatives(responses):
    source = {r["page_id"]: r for r in responses.collect()}
    got = warc.derivative_records(responses).collect()
    assert len(got) == 2 * (len(BLOCKS) + 2) and len({r["record_id"] for r in got}) == len(got)
    texts = dict(enumerate(want for _, want in BLOCKS.values())) | {100: TEXT, 101: "a\n b"}
    for r in got:
        s, data = source[r["page_id"]], bytes(r["block"])
        block = bytes(s["block"] or b"")
        head, gap, payload = block.partition(b"\r\n\r\n")
        payload = payload if gap and head.startswith(b"HTTP/") else block
        assert (r["refers_to"], r["target_uri"], r["date"]) == (s["record_id"], s["target_uri"], s["date"])
        assert (r["length"], r["block_digest"], r["payload_digest"]) == (len(data), digest(data), digest(payload))
        if r["record_type"] == "conversion":
            want = texts[r["page_id"]]
            assert data.decode() == want if want is not None else data.startswith(b"word")
        else:
            fields = [line.split(": ", 1) for line in data.decode().split("\r\n")[:-1]]
            assert [f for f in fields if f[0].startswith("source-header-")] == [[f"source-header-{n.lower()}", v] for n, v in (x.split(": ", 1) for x in head.decode("latin-1").split("\r\n")[1:])] if payload is not block else True
            assert ["source-block-digest", digest(block)] in fields and ["source-payload-length", str(len(payload))] in fields


def _same(a, b):
    rows = lambda df: sorted(tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in df.select(*warc.RECORD.names).collect())
    key = lambda r: tuple((x is None, x) for x in r)
    return sorted(rows(a), key=key) == sorted(rows(b), key=key)


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_files_round_trip(spark, tmp_path, compression):
    nested = b"x\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\n\r\n\r\n\r\n\r\nWARC/ \xff\xfe\x00"
    rows = [("<a>", "response", None, "http://ü/", "d", "t", None, None, len(b), bytearray(b)) for b in (nested, b"", b"\r\n\r\n", bytes(range(256)) * 300, "é".encode() * 9)]
    rows += [("<b>", "metadata", "<a>", None, None, None, "sha1:X", "sha1:Y", 3, bytearray(b"abc"))]
    df = spark.createDataFrame(rows, warc.RECORD)
    path = str(tmp_path / "w")
    warc.write_warc(df.repartition(2), path, compression)
    assert _same(warc.read_warc(spark, path), df)
    if compression == "none":
        old = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "30000")
        try:
            assert _same(warc.read_warc(spark, path), df)
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    for file in (tmp_path / "w").glob("part-*"):
        data = file.read_bytes()
        if compression == "gzip":
            members = []
            while data:
                stream = zlib.decompressobj(31)
                members.append(stream.decompress(data))
                data = stream.unused_data
            assert all(m.startswith(b"WARC/1.1\r\n") or m == b"\r\n\r\n" for m in members)
            data = b"".join(members)
        assert len(warc.parse(data)) == data.count(b"WARC/1.1\r\n")


def test_foreign_and_broken_files(spark, tmp_path):
    one = b"WARC/1.0\r\nWARC-Type: response\r\nwarc-record-id: <1>\r\nWARC-Target-URI: http://\r\n folded\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    no_length = b"WARC/1.0\r\nWARC-Type: resource\r\n\r\nno length\r\n\r\n"
    wrong = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <3>\r\nContent-Length: 99999\r\n\r\nshort\r\n\r\n"
    cut = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <4>\r\nContent-Length: 50\r\n\r\nends he"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(one + no_length) + gzip.compress(wrong + one) + gzip.compress(cut))
    (tmp_path / "b.warc").write_bytes(one + b"WARC/1.0\r\nnothing\r\n\r\n\r\n\r\n" + cut)
    got = sorted((r["record_id"] or "", bytes(r["block"]), r["target_uri"]) for r in warc.read_warc(spark, str(tmp_path)).collect())
    hello = ("<1>", b"hello", "http:// folded")
    assert [(i, b, u) for i, b, u in got if i == "<1>"] == [hello] * 3
    assert sorted((i, b.removesuffix(b"\r\n\r\n")) for i, b, _ in got if i != "<1>") == [("", b"no length"), ("<3>", b"short"), ("<4>", b"ends he"), ("<4>", b"ends he")]
    derived = warc.derivative_records(warc.read_warc(spark, str(tmp_path)), key="record_id")
    assert derived.where("record_type = 'conversion' AND block = cast('hello' AS binary)").count() == 3
