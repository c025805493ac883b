import gzip
import hashlib
import io
import random

import pytest

from prunecluster.llm import warc as w
from prunecluster.storage import RunTables

BIG = "<p>é" + "long page " * 9000
ROWS = [
    (1, "http://a/\r\nX: y", "x" * 1000), (2, None, "x" * 1000), (9, "http://b", "x" * 1000), (3, "u", "x" * 999), (4, "u", "x" * 999),
    (5, "u", None), (6, "u", ""), (7, "u", BIG), (8, "u", BIG), (10, "u", BIG + "!"), (11, "u", "é" * 500), (12, "u", "é" * 500),
    (13, "u", "WARC/1.1\r\n\r\n0\r\n\r\n" * 100),
]
COLUMNS = "page_id long, url string, html string, record_id string, kind int"


def expected(rows):
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        model = max((j for j, _, h in rows if (h or "") == (html or "")))
        again = len(body) >= 1000 and model != i
        out.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", model if again else None, None))
    return sorted(out)


@pytest.mark.parametrize("segment_bytes", [100, 4096, 1 << 20])
def test_round_trip(spark, segment_bytes):
    pages = spark.createDataFrame([(*r, "x", 1) for r in ROWS], COLUMNS).repartition(3)
    found = sorted(map(tuple, w.warc_round_trip(pages, segment_bytes).collect()))
    assert found == expected(ROWS)


def test_null_ids_repeated_rows_and_no_rows(spark):
    rows = [(None, "u", "y" * 2000), (None, "u", "y" * 2000), (4, "v", "z" * 3000), (4, "v", "z" * 3000), (2, "v", "z" * 3000)]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], COLUMNS)
    found = w.warc_round_trip(pages, 512).collect()
    assert sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to, r.problem) for r in found) == [
        (0, 2000, "response", None, None), (0, 2000, "response", None, None), (2, 3000, "revisit", 4, None),
        (4, 3000, "response", None, None), (4, 3000, "response", None, None),
    ]
    assert w.warc_round_trip(pages.limit(0)).count() == 0


def test_bytes_of_records():
    data = w.record([("WARC-Type", "response"), ("WARC-Date", None)], b"abc") + w.record([("WARC-Type", "revisit")], b"")
    plain = gzip.decompress(data)
    assert plain.startswith(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n")
    read = [(h["warc-type"], get(99)) for h, get in w.read_records(io.BytesIO(plain))]
    assert read == [("response", b"abc"), ("revisit", b"")]
    assert [h["warc-type"] for h, _ in w.read_records(io.BytesIO(plain))] == ["response", "revisit"]


@pytest.mark.parametrize("seed", range(20))
def test_framing_in_parts_of_any_size(seed):
    rng = random.Random(seed)
    payload = rng.randbytes(rng.randint(0, 5000)) + b"\r\n0\r\n\r\n" * rng.randint(0, 3)
    block = w.HTTP_HEAD + w.chunked(payload, rng.randint(1, 900))
    body = w.HttpPayload()
    while block:
        n = rng.randint(1, 50)
        body.feed(block[:n])
        block = block[n:]
    assert body.problem() is None and body.size == len(payload) and body.sha1.hexdigest() == hashlib.sha1(payload).hexdigest()


def test_bodies_without_framing_and_broken_ones():
    body = w.HttpPayload()
    body.feed(b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\nabc")
    assert (body.size, body.problem()) == (3, None)
    cut = w.HttpPayload()
    cut.feed(w.HTTP_HEAD + b"5\r\nab")
    assert cut.problem()
    with pytest.raises(ValueError):
        w.HttpPayload().feed(w.HTTP_HEAD + b"1\r\nabc\r\n")


def test_segments_are_checked(spark):
    block = w.HTTP_HEAD + w.chunked(b"payload")
    digest = hashlib.sha1(b"payload").hexdigest()

    def parts(origin, numbers, total):
        cut = {1: block[:40], 2: block[40:70], 3: block[70:]}
        return [(f"r{origin}", 5, "segment", None, digest if n == 1 else None, None, origin, n, total if n == 3 else None, bytearray(cut[n]), None) for n in numbers]

    rows = parts("good", [3, 1, 2], len(block)) + parts("hole", [1, 3], len(block)) + parts("end", [1, 2], 0) + parts("size", [1, 2, 3], 7)
    found = {r.record_id: r for r in w.reassemble(spark.createDataFrame(rows, w.RECORDS).repartition(3)).collect()}
    assert found["rgood"].problem is None and found["rgood"].digest == digest and found["rgood"].payload_bytes == 7
    assert all(found[k].problem for k in ("rhole", "rend", "rsize"))


def test_archives_hold_segments(spark):
    pages = spark.createDataFrame([(*r, "x", 1) for r in ROWS], COLUMNS).repartition(2)
    run = RunTables(spark)
    manifest = w.write_archives(pages, f"{run.root}/warc", run, 4096)
    kinds = [r.kind for r in w._parse(manifest).collect()]
    assert kinds.count("segment") > 20 and kinds.count("revisit") == 4
    paths = [r.path for r in manifest.collect()]
    assert any(p.endswith("-more.warc.gz") for p in paths)
