"""WARC 1.1 records: reading, writing, and a builder of derivatives.

From each response record come a metadata record (what was fetched: the source's
HTTP headers and digests) and, if its content is text, a conversion record (the
page as plain text). Both name the response they come from in WARC-Refers-To and
keep its target, date and payload digest; ids follow from the source's id, so a
rerun or a retried task makes the same records. Chunked bodies and gzip or deflate
encodings are undone first; digests are those of the source as it is.

Defined cases: a response without a record id, or without an HTTP header block,
is not a response and gives no derivatives (``derive`` passes over other record
types); an empty payload converts to an empty text; null html is an empty
payload; a body that does not decode as its headers say is taken as it is; content
that is not text gives a metadata record only. Repeated rows of pages are
responses of their own: their ids also have the row's place, and so differ. In a
file, a record whose headers do not say its length, or that the file's end cuts
off, is left out, and reading goes on at the next version line after an empty
line. An empty table gives no records; other columns do not matter.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .html_extract import visible_text
from .store import materialize, table
from .words import map_arrow

SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:streetlink:warc")
RECORD = "warc_type string, record_id string, target_uri string, date string, refers_to string, content_type string, headers array<struct<name:string,value:string>>, block binary"
RECORD_COLUMNS = ("warc_type", "record_id", "target_uri", "date", "refers_to", "content_type", "headers", "block")
#: The synthetic pages carry no time of fetching.
EPOCH = "1970-01-01T00:00:00Z"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, chr(31).join(parts))}>"


def _clean(value: str) -> str:
    """A header value stays on its line."""
    return " ".join(value.split("\r")).replace("\n", " ").strip()


def make_record(kind: str, rid: str, uri: str | None, date: str, content_type: str, block: bytes, refers_to: str | None = None, extra: list[tuple[str, str]] = ()) -> dict:
    headers = [("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Date", date)]
    if uri is not None:
        headers.append(("WARC-Target-URI", _clean(uri)))
    if refers_to:
        headers.append(("WARC-Refers-To", refers_to))
    headers += [*((k, _clean(v)) for k, v in extra), ("WARC-Block-Digest", digest(block)), ("Content-Type", content_type), ("Content-Length", str(len(block)))]
    return {"warc_type": kind, "record_id": rid, "target_uri": uri, "date": date, "refers_to": refers_to, "content_type": content_type, "headers": [{"name": k, "value": v} for k, v in headers], "block": block}


def to_bytes(record: dict) -> bytes:
    head = "".join(f"{h['name']}: {h['value']}\r\n" for h in record["headers"])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + record["block"] + b"\r\n\r\n"


VERSION = re.compile(rb"(?:\A|(?<=\n\r\n)|(?<=\n\n))WARC/[0-9]")


def from_bytes(data: bytes) -> Iterator[dict]:
    """The records of an uncompressed WARC file."""
    at = 0
    while start := VERSION.search(data, at):
        at = start.start()
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        headers: list[dict] = []
        for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            if line[:1] in (" ", "\t") and headers:
                headers[-1]["value"] += " " + line.strip()
            elif ":" in line:
                name, _, value = line.partition(":")
                headers.append({"name": name.strip(), "value": value.strip()})
        get = {h["name"].lower(): h["value"] for h in headers}
        size = get.get("content-length", "")
        if not re.fullmatch("[0-9]{1,18}", size) or end + 4 + int(size) > len(data):
            at += 5
            continue
        block = data[end + 4 : end + 4 + int(size)]
        yield {"warc_type": get.get("warc-type"), "record_id": get.get("warc-record-id"), "target_uri": get.get("warc-target-uri"), "date": get.get("warc-date"), "refers_to": get.get("warc-refers-to"), "content_type": get.get("content-type"), "headers": headers, "block": block}
        at = end + 4 + int(size)


def unzip_members(data: bytes) -> bytes:
    """A file of gzip members, one a record, or plain."""
    out = []
    while data[:2] == b"\x1f\x8b":
        z = zlib.decompressobj(31)
        out.append(z.decompress(data) + z.flush())
        data = z.unused_data
    return b"".join(out) + data if out else data


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of .warc and .warc.gz files (up to 2 GB each), one task a file."""

    def rows(it: Iterator[dict]) -> Iterator[dict]:
        for r in it:
            yield from from_bytes(unzip_members(bytes(r["content"])))

    return map_arrow(spark.read.format("binaryFile").load(path).select("content"), rows, RECORD, flush=512)


def write_warc(records: DataFrame, path: str) -> DataFrame:
    """Write records as .warc.gz files, a gzip member a record and a file a partition:
    (file, records, bytes) of each.

    A file appears under its name when it is whole; a retried task writes it again.
    The path may be in any store that pyarrow opens by its URI; on a cluster it must
    be one that all executors share.
    """

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        store, folder = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        task = TaskContext.get()
        name = f"{folder}/part-{task.partitionId():05d}.warc.gz"
        draft = f"{folder}/.part-{task.partitionId():05d}.{task.taskAttemptId()}"
        count = size = 0
        out = None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for r in batch.slice(at, 256).to_pylist():
                    if out is None:
                        store.create_dir(folder, recursive=True)
                        out = store.open_output_stream(draft)
                    member = gzip.compress(to_bytes(r), mtime=0)
                    out.write(member)
                    count, size = count + 1, size + len(member)
        if out is not None:
            out.close()
            store.move(draft, name)
            yield pa.RecordBatch.from_pylist([{"file": name, "records": count, "bytes": size}])

    return materialize(records.select(*RECORD_COLUMNS).mapInArrow(run, "file string, records long, bytes long"), "warc-files")


def response_of(page_id, url: str | None, html: str | None, copy: int | None = None) -> dict:
    """A page as a response; copy tells repeated rows apart."""
    payload = (html or "").encode("utf-8", "surrogatepass")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    rid = record_id("response", str(page_id), url or "", *([] if copy is None else [str(copy)]))
    return make_record("response", rid, url or "", EPOCH, "application/http; msgtype=response", head + payload, extra=[("WARC-Payload-Digest", digest(payload))])


def _unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0].strip() or b"x", 16)
        if not size:
            return b"".join(out)
        chunk = body[end + 2 : end + 2 + size]
        if len(chunk) < size:
            raise ValueError("cut off")
        out.append(chunk)
        at = end + 2 + size + 2


def decoded_body(fields: dict[str, str], payload: bytes) -> bytes:
    """The content of a body, or the body as it is if its headers do not fit it."""
    body = payload
    try:
        if "chunked" in fields.get("transfer-encoding", "").lower():
            body = _unchunked(body)
        for coding in reversed(fields.get("content-encoding", "").lower().split(",")):
            if coding.strip() in ("gzip", "x-gzip"):
                body = zlib.decompress(body, 31) if body else body
            elif coding.strip() == "deflate" and body:
                try:
                    body = zlib.decompress(body)
                except zlib.error:
                    body = zlib.decompress(body, -15)
    except (ValueError, zlib.error):
        return payload
    return body


def _plain(kind: str, body: bytes) -> str | None:
    """Content as plain text; None if it isn't text."""
    media, _, rest = kind.partition(";")
    media = media.strip().lower()
    found = re.search(r"charset\s*=\s*[\"']?([^\s;\"']+)", rest, re.I)
    try:
        text = body.decode(found[1] if found else "utf-8", "replace")
    except LookupError:
        text = body.decode("utf-8", "replace")
    if not media or "html" in media or "xml" in media:
        return visible_text(text)
    return text if media.startswith("text/") or media in ("application/json", "application/javascript") else None


def derivatives_of(response: dict) -> list[dict]:
    """The metadata and the conversion record of a response, or none."""
    if response["warc_type"] != "response" or not response["record_id"]:
        return []
    head, cut, payload = bytes(response["block"]).partition(b"\r\n\r\n")
    if not cut or not head.startswith(b"HTTP/"):
        return []
    rid, uri, date = response["record_id"], response["target_uri"], response["date"]
    get = {h["name"].lower(): h["value"] for h in response["headers"]}
    status, *lines = head.decode("utf-8", "replace").split("\r\n")
    fields = [(k.strip().lower(), v.strip()) for k, cut, v in (f.partition(":") for f in lines) if cut]
    body = decoded_body(dict(fields), payload)
    text = _plain(dict(fields).get("content-type", ""), body)
    source = [("WARC-Source-Payload-Digest", get.get("warc-payload-digest") or digest(payload)), ("WARC-Source-Block-Digest", get.get("warc-block-digest") or digest(bytes(response["block"])))]
    about = [("status", status), *((f"http-{k}", v) for k, v in fields), ("payload-length", str(len(payload)))]
    block = "".join(f"{k}: {_clean(v)}\r\n" for k, v in about).encode("utf-8", "surrogatepass")
    meta_id, text_id = record_id("metadata", rid), record_id("conversion", rid)
    if text is None:
        return [make_record("metadata", meta_id, uri, date, "application/warc-fields", block, rid, source)]
    return [
        make_record("metadata", meta_id, uri, date, "application/warc-fields", block, rid, [*source, ("WARC-Concurrent-To", text_id)]),
        make_record("conversion", text_id, uri, date, "text/plain; charset=utf-8", text.encode("utf-8", "surrogatepass"), rid, [*source, ("WARC-Concurrent-To", meta_id)]),
    ]


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages as response records, with their page_id.

    Rows that repeat another are found by a hash, one long a row; where there are
    any, they are marked by a join, which the planner broadcasts if they are few.
    """

    def rows(it: Iterator[dict]) -> Iterator[dict]:
        for r in it:
            yield {"page_id": r["page_id"], **response_of(r["page_id"], r["url"], r["html"], r["copy"])}

    narrow = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    key = F.xxhash64(F.coalesce("page_id", F.lit(-1)), F.coalesce("url", F.lit("")), F.coalesce("html", F.lit("")))
    twice = materialize(narrow.select(key.alias("key")).groupBy("key").count().filter("count > 1").select("key"), "repeated-pages")
    if twice.isEmpty():
        marked = narrow.withColumn("copy", F.lit(None).cast("long"))
    else:
        marked = narrow.withColumn("key", key).join(twice.withColumn("repeated", F.lit(True)), "key", "left")
        marked = marked.withColumn("copy", F.when(F.col("repeated"), F.monotonically_increasing_id())).select("page_id", "url", "html", "copy")
    return map_arrow(marked, rows, "page_id long, " + RECORD, flush=1024)


def derive(records: DataFrame) -> DataFrame:
    """Metadata and conversion records of all responses among records; other columns go."""

    def rows(it: Iterator[dict]) -> Iterator[dict]:
        for r in it:
            yield from derivatives_of(r)

    return map_arrow(records.select(*RECORD_COLUMNS), rows, RECORD, flush=1024)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per derived record, with the digests that tie it to its source."""
    records = derive(responses(table(spark, sf_dir, "pages")))
    header = lambda n: F.filter("headers", lambda h: h["name"] == n)[0]["value"]
    return records.select("warc_type", "record_id", "refers_to", header("WARC-Concurrent-To").alias("concurrent_to"), F.col("target_uri").alias("url"), header("WARC-Source-Payload-Digest").alias("source_payload_digest"), header("WARC-Source-Block-Digest").alias("source_block_digest"), header("WARC-Block-Digest").alias("block_digest"), F.octet_length("block").cast("long").alias("n_bytes"))
