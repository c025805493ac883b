"""WARC archives: writing with revisits and segments, reading with reassembly.

A page becomes a response record, its html as an HTTP body in chunked framing. A page whose payload
another record holds already becomes a revisit, without a body. A block longer than ``segment_bytes``
is cut: the first part stays the response, the rest are continuation records, in archives of
their own. The reader brings the parts together by the record that they continue, in the order of
their segment numbers, checks the total length, and decodes HTTP as the bytes pass by, so that
no block need fit in memory as a whole.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import zlib
from uuid import NAMESPACE_URL, uuid4, uuid5

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prunecluster.llm.batches import as_bytes, map_rows, task_number
from prunecluster.llm.token_file import opened
from prunecluster.storage import RunTables

VERSION = "WARC/1.1"
#: Payloads below this are always stored.
REVISIT_BYTES = 1000
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK = 8192
MANIFEST = "path string, n_records long"
RECORDS = (
    "record_id string, page_id long, kind string, payload_bytes long, digest string, target string, "
    "origin string, segment long, total long, data binary, problem string"
)


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = []
    for start in range(0, len(payload), size):
        part = payload[start : start + size]
        parts += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join(parts) + b"0\r\n\r\n"


def record(headers: list[tuple[str, object]], block: bytes, level: int = 4) -> bytes:
    """One record as a gzip member."""
    lines = [VERSION, *(f"{k}: {v}" for k, v in headers if v is not None), f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(level, wbits=31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def record_id(*parts) -> str:
    return f"<urn:uuid:{uuid5(NAMESPACE_URL, '/'.join(map(str, parts)))}>"


def header_value(text: str | None) -> str | None:
    """A value that stays on its line."""
    return None if text is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


class HttpPayload:
    """Length and SHA-1 of the payload of an HTTP response that is fed in parts of any size."""

    def __init__(self):
        self.sha1, self.size, self.held = hashlib.sha1(), 0, b""
        self.step, self.left, self.framed = "head", 0, False

    def _take(self, data: bytes) -> None:
        self.sha1.update(data)
        self.size += len(data)

    def feed(self, data: bytes) -> None:
        data, at = self.held + data, 0
        while at < len(data):
            if self.step == "head":
                end = data.find(b"\r\n\r\n", at)
                if end < 0:
                    break
                head = data[at:end].lower()
                self.framed = re.search(rb"\r\ntransfer-encoding:[^\r]*\bchunked\b", head) is not None
                self.step, at = ("size" if self.framed else "body"), end + 4
            elif self.step == "body":
                self._take(data[at:])
                at = len(data)
            elif self.step == "size":
                end = data.find(b"\r\n", at)
                if end < 0:
                    break
                self.left = int(data[at:end].split(b";")[0].strip() or b"x", 16)
                self.step, at = ("chunk" if self.left else "trailer"), end + 2
            elif self.step == "chunk":
                part = data[at : at + self.left]
                self._take(part)
                at, self.left = at + len(part), self.left - len(part)
                if not self.left:
                    self.step = "line"
            elif self.step == "line":
                if len(data) - at < 2:
                    break
                if data[at : at + 2] != b"\r\n":
                    raise ValueError("a chunk does not end where its size says")
                self.step, at = "size", at + 2
            elif self.step == "trailer":
                end = data.find(b"\r\n", at)
                if end < 0:
                    break
                self.step, at = ("done" if end == at else "trailer"), end + 2
            else:
                raise ValueError("bytes after the last chunk")
        self.held = data[at:]

    def problem(self) -> str | None:
        return None if self.step in ("done", "body") and not self.held else f"the block ends in its {self.step}"


def read_records(stream):
    """(headers, reader) of each record; reader(n) gives up to n bytes of the block."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"a record starts with {line[:40]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        left = int(headers["content-length"])

        def read(n: int) -> bytes:
            nonlocal left
            data = stream.read(min(n, left))
            left -= len(data)
            return data

        yield headers, read
        while left and read(1 << 16):
            pass


def _pages(pages: DataFrame) -> DataFrame:
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")
    ).withColumn("row_key", F.xxhash64("page_id", "url", "html"))


def _revisits(pages: DataFrame, run: RunTables, least: int) -> DataFrame:
    """Rows whose payload the row with the largest page_id stores: (page_id, row_key, model struct)."""

    def make(batches):
        for batch in batches:
            for page_id, key, html in zip(batch.column("page_id").to_pylist(), batch.column("row_key").to_pylist(), as_bytes(batch.column("html"))):
                if html and len(html) >= least:
                    yield page_id, key, hashlib.sha256(html).hexdigest(), len(html)

    marks = run.write(map_rows(pages.select("page_id", "row_key", "html"), make, "page_id long, row_key long, sha256 string, n long"), "marks")
    key = ["sha256", "n"]
    models = marks.groupBy(*key).agg(F.max(F.struct("page_id", "row_key")).alias("model"), F.count("*").alias("rows")).filter("rows > 1")
    return (
        marks.join(models, key).filter(~F.struct("page_id", "row_key").eqNullSafe(F.col("model")))
        .select(F.col("page_id").alias("id"), F.col("row_key").alias("rk"), F.col("model.page_id").alias("to_id"), F.col("model.row_key").alias("to_key")).distinct()
    )


def write_archives(pages: DataFrame, folder: str, run: RunTables, segment_bytes: int, least: int = REVISIT_BYTES, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes a record for each row, and returns the manifest of the archives that count."""
    rows = _pages(pages)
    revisits = run.write(_revisits(rows, run, least), "revisits")
    dealt = rows.join(
        revisits.hint("shuffle_hash"), (F.col("row_key") == F.col("rk")) & F.col("page_id").eqNullSafe(F.col("id")), "left"
    ).select("page_id", "url", "html", "row_key", F.col("rk").isNotNull().alias("again"), "to_id", "to_key")

    def make(batches):
        system, path = opened(folder)
        system.create_dir(path, recursive=True)
        stem, files = f"part-{task_number():06d}-{uuid4().hex}", {}

        def put(kind: str, data: bytes) -> None:
            if kind not in files:
                name = f"{stem}-{kind}.warc.gz"
                sink = system.open_output_stream(f"{path}/{name}", compression=None)
                sink.write(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(stem, kind)), ("WARC-Date", date)], b"format: WARC File Format 1.1\r\n"))
                files[kind] = [name, sink, 0]
            files[kind][1].write(data)
            files[kind][2] += 1

        copy = 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "row_key", "again", "to_id", "to_key")]
            for page_id, url, key, again, to_id, to_key, html in zip(*columns, as_bytes(batch.column("html"))):
                payload = html or b""
                # Rows that repeat page_id, url and html have records of their own; any may stand for them all.
                own = record_id(page_id, key)
                copy += 1
                common = [("WARC-Record-ID", own), ("WARC-Date", date), ("WARC-Target-URI", header_value(url)), ("X-Page-ID", page_id), ("X-Record-Copy", f"{stem}-{copy}")]
                digest = ("WARC-Payload-Digest", "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode())
                http = ("Content-Type", "application/http; msgtype=response")
                if again:
                    put("main", record([("WARC-Type", "revisit"), *common, digest, ("WARC-Refers-To", record_id(to_id, to_key)), ("WARC-Profile", PROFILE), http], HTTP_HEAD))
                    continue
                block = HTTP_HEAD + chunked(payload)
                parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
                number = ("WARC-Segment-Number", 1 if len(parts) > 1 else None)
                put("main", record([("WARC-Type", "response"), *common, digest, number, http], parts[0]))
                for n, part in enumerate(parts[1:], 2):
                    total = len(block) if n == len(parts) else None
                    put("more", record([("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(stem, copy, n)), ("WARC-Date", date), ("WARC-Segment-Number", n), ("WARC-Segment-Origin-ID", own), ("X-Record-Copy", f"{stem}-{copy}"), ("WARC-Segment-Total-Length", total)], part))
        for name, sink, n in files.values():
            sink.close()
            yield f"{folder}/{name}", n

    return run.write(map_rows(dealt, make, MANIFEST), "manifest")


def _hex(digest: str | None) -> str | None:
    name, _, value = (digest or "").partition(":")
    if name.lower() != "sha1":
        return None
    return value.lower() if len(value) == 40 else base64.b32decode(value.upper()).hex()


def _parse(manifest: DataFrame) -> DataFrame:
    """A row for each record, complete responses decoded; parts of cut blocks keep their bytes."""

    def make(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, inside = opened(path)
                with system.open_input_stream(inside, compression=None) as raw, gzip.GzipFile(fileobj=raw) as plain:
                    for headers, read in read_records(io.BufferedReader(plain, 1 << 16)):
                        kind, number = headers.get("warc-type"), headers.get("warc-segment-number")
                        if kind not in ("response", "revisit", "continuation"):
                            continue
                        own, page = headers.get("warc-record-id"), headers.get("x-page-id")
                        page = int(page) if page else None
                        digest = _hex(headers.get("warc-payload-digest"))
                        copy = headers.get("x-record-copy", "")
                        if kind == "revisit":
                            yield own, page, kind, None, digest, headers.get("warc-refers-to"), None, None, None, None, None
                        elif number:
                            origin = (own if kind == "response" else headers.get("warc-segment-origin-id", "")) + copy
                            total = headers.get("warc-segment-total-length")
                            data = b"".join(iter(lambda: read(1 << 20), b""))
                            yield own, page, "segment", None, digest, None, origin, int(number), int(total) if total else None, data, None
                        else:
                            body = HttpPayload()
                            for data in iter(lambda: read(1 << 20), b""):
                                body.feed(data)
                            yield (own, page, kind, body.size, body.sha1.hexdigest(), None, None, None, None, None, _verdict(body, digest))

    count = max(1, manifest.count())
    return map_rows(manifest.select("path").repartition(count), make, RECORDS, weigh=lambda row: len(row[9] or b""))


def _verdict(body: HttpPayload, digest: str | None) -> str | None:
    if body.problem():
        return body.problem()
    return "the payload is not that of its digest" if digest and body.sha1.hexdigest() != digest else None


def reassemble(segments: DataFrame) -> DataFrame:
    """Responses from their segments, streamed in order; only one part of one block is in memory."""

    def make(batches):
        def finish(first, body, size, total, gap):
            own, page, digest = first
            problem = (
                "a segment is missing" if gap or total is None
                else f"{size} bytes where {total} are said" if size != total else _verdict(body, digest)
            )
            return own, page, "response", body.size, body.sha1.hexdigest(), None, None, None, None, None, problem

        origin, first, body, size, last, total, gap = None, (None, None, None), HttpPayload(), 0, 0, None, False
        for batch in batches:
            names = ("origin", "segment", "total", "record_id", "page_id", "digest", "data")
            for key, number, says, own, page, digest, data in zip(*(batch.column(n).to_pylist() for n in names)):
                if key != origin:
                    if origin is not None:
                        yield finish(first, body, size, total, gap)
                    origin, first, body, size, last, total, gap = key, (None, None, None), HttpPayload(), 0, 0, None, False
                if number == 1:
                    first = own, page, digest
                gap |= number != last + 1
                last, size = number, size + len(data)
                total = says if says is not None else total
                if not gap:
                    body.feed(data)
        if origin is not None:
            yield finish(first, body, size, total, gap)

    ordered = segments.repartition("origin").sortWithinPartitions("origin", "segment")
    return map_rows(ordered, make, RECORDS)


def read_archives(manifest: DataFrame, run: RunTables) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, problem of every response and revisit."""
    records = run.write(_parse(manifest), "records")
    responses = run.write(
        records.filter("kind = 'response'").union(reassemble(records.filter("kind = 'segment'"))), "responses"
    )
    targets = responses.groupBy(F.col("record_id").alias("target")).agg(
        F.max("page_id").alias("refers_to"), F.max("payload_bytes").alias("size"), F.max("digest").alias("stored")
    )
    again = records.filter("kind = 'revisit'").drop("payload_bytes").join(targets, "target", "left").select(
        "page_id", F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to",
        F.when(F.col("size").isNull(), "the record that it revisits is missing")
        .when(F.col("stored") != F.col("digest"), "the record that it revisits has another payload").alias("problem"),
    )
    stored = responses.select(
        "page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"),
        F.lit(None).cast("long").alias("refers_to"), "problem",
    )
    return stored.union(again)


def warc_round_trip(pages: DataFrame, segment_bytes: int = 1 << 15, least: int = REVISIT_BYTES) -> DataFrame:
    """Writes all pages as WARC archives and reads them back: one row per page.

    page_id, payload_bytes, payload_digest (SHA-1 in hex), record_type, refers_to, problem (null where
    the archive is sound). A null html is an empty payload; a null url leaves out the target. A null
    page_id is smaller than any other. Of rows that repeat page_id, url and html, all have the verdict
    of one: responses if that id stores the payload, else revisits. An empty table gives no archives
    and no rows. Other columns are not read.
    """
    run = RunTables(pages.sparkSession)
    return read_archives(write_archives(pages, f"{run.root}/warc", run, segment_bytes, least), run)
