"""WARC records against an independent reader, and odd archives."""

import gzip
import hashlib
import io
import uuid
import zlib
from base64 import b32encode

from streetlink.llm import warc
from streetlink.llm.html_extract import visible_text
from streetlink.llm.warc import decoded_body, derivatives_of, derive, from_bytes, make_record, op6_warc, read_warc, record_id, response_of, responses, to_bytes, write_warc

PAGES = [(1, "http://a.example/x", "<p>Hello &amp; bye</p><script>x</script>"), (2, "http://b.example/", None), (3, None, "é\r\n\r\nWARC/1.1"), (1, "http://a.example/x", "<p>Hello &amp; bye</p><script>x</script>"), (None, None, None), (None, None, None), (4, "http://a.example/\r\ny", "<div>" + "long page " * 100_000)]


def sha(data):
    return "sha1:" + b32encode(hashlib.sha1(data).digest()).decode()


def plain_derivatives(pages):
    """What op6 must give, made straight from the pages: rows without ids, and how many ids there are."""
    rows = []
    for page_id, url, html in pages:
        payload = (html or "").encode()
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
        about = f"status: HTTP/1.1 200 OK\r\nhttp-content-type: text/html; charset=utf-8\r\nhttp-content-length: {len(payload)}\r\npayload-length: {len(payload)}\r\n".encode()
        text = visible_text(html).encode()
        rows += [("metadata", url or "", sha(payload), sha(block), sha(about), len(about)), ("conversion", url or "", sha(payload), sha(block), sha(text), len(text))]
    return sorted(rows)


def test_the_query_against_a_plain_version(spark, tmp_path):
    frame = spark.createDataFrame([(*p, "x", 1) for p in PAGES], "page_id long, url string, html string, block string, `text key` int").repartition(3)
    frame.write.parquet(f"{tmp_path}/pages.parquet")
    got = op6_warc(spark, str(tmp_path)).collect()
    assert sorted((r.warc_type, r.url, r.source_payload_digest, r.source_block_digest, r.block_digest, r.n_bytes) for r in got) == plain_derivatives(PAGES)
    assert len({r.record_id for r in got}) == 2 * len(PAGES) and len({r.refers_to for r in got}) == len(PAGES)
    by_id = {r.record_id: r for r in got}
    assert all(by_id[r.concurrent_to].concurrent_to == r.record_id and by_id[r.concurrent_to].refers_to == r.refers_to for r in got)
    assert all(uuid.UUID(r.record_id[10:-1]) for r in got)
    single = [r for r in got if r.url == "http://b.example/"]
    assert {r.refers_to for r in single} == {record_id("response", "2", "http://b.example/")}  # no place in an id that is one of its kind
    assert derive(responses(frame.limit(0))).count() == 0


def test_files_are_written_and_read_again(spark, tmp_path):
    made = derive(responses(spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(2)))
    files = write_warc(made, f"{tmp_path}/out").collect()
    assert sum(f.records for f in files) == 2 * len(PAGES) and all(open(f.file, "rb").read(2) == b"\x1f\x8b" for f in files)
    assert write_warc(made, f"file://{tmp_path}/out").count() == len(files)  # written again, under the same names
    again = read_warc(spark, f"{tmp_path}/out/*.warc.gz").collect()
    key = lambda r: (r.record_id, bytes(r.block), [(h.name, h.value) for h in r.headers])
    assert sorted(map(key, again)) == sorted(map(key, made.collect()))


def test_each_member_is_one_whole_record():
    records = [response_of(*p) for p in PAGES]
    data = b"".join(gzip.compress(to_bytes(r)) for r in records)
    stream, heads = io.BytesIO(data), 0
    while stream.tell() < len(data):
        z = zlib.decompressobj(31)
        member = z.decompress(data[stream.tell() :])
        stream.seek(len(data) - len(z.unused_data))
        assert member.startswith(b"WARC/1.1\r\n") and member.endswith(b"\r\n\r\n")
        heads += 1
    assert heads == len(PAGES)


def test_malformed_records_are_left_out():
    good = [to_bytes(response_of(i, f"http://x/{i}", f"<p>WARC/1.1 in page {i}")) for i in range(3)]
    bad = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: twelve\r\n\r\nWARC/1.0 hello\r\n\r\n"
    none = b"WARC/1.1\r\nWARC-Type: response\r\n\r\nhello\r\n\r\n"
    want = [list(from_bytes(g))[0] for g in good]
    assert [len(list(from_bytes(g))) for g in good] == [1, 1, 1]
    assert list(from_bytes(good[0] + bad + good[1] + none + good[2] + good[0][:-40])) == want
    assert list(from_bytes(b"")) == list(from_bytes(b"\x00WARC/")) == list(from_bytes(bad)) == []


def test_bodies_are_decoded():
    html = b"<p>caf\xe9</p>"
    zipped = gzip.compress(html)
    chunked = b"".join(b"%x;x=y\r\n%s\r\n" % (len(zipped[i : i + 7]), zipped[i : i + 7]) for i in range(0, len(zipped), 7)) + b"0\r\n\r\n"
    raw = zlib.compressobj(wbits=-15)
    raw = raw.compress(html) + raw.flush()
    for head, body in (
        ("Content-Encoding: gzip\r\nTransfer-Encoding: chunked", chunked),
        ("content-encoding: deflate", zlib.compress(html)),
        ("content-encoding: deflate", raw),
        ("Transfer-Encoding: chunked", html),  # does not fit: taken as it is
        ("Content-Encoding: br", html),
    ):
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=latin-1\r\n{head}\r\n\r\n".encode() + body
        meta, text = derivatives_of(make_record("response", "<urn:x>", "http://x", "2020-01-01T00:00:00Z", "application/http", block))
        assert text["block"] == "café".encode() and dict((h["name"], h["value"]) for h in text["headers"])["WARC-Source-Payload-Digest"] == sha(body)
    assert decoded_body({"content-encoding": "gzip"}, b"") == b"" and decoded_body({"content-encoding": "gzip"}, zipped[:9]) == zipped[:9]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\n\x89PNG"
    assert [r["warc_type"] for r in derivatives_of(make_record("response", "<urn:x>", None, "2020", "application/http", block))] == ["metadata"]
    assert warc._plain("text/plain; charset=nonsense", b"<p>as it is") == "<p>as it is"
