"""Archives written and read back, and damaged ones."""

import gzip
import io

import pytest

from sievework.llm import warc
from sievework.llm.common import shared_folder

BIG = "<p>" + "word " * 30_000 + "</p>"
ROWS = [
    (1, "http://a/1", "<p>x</p>"), (2, "http://a/2", "<p>x</p>"), (3, None, None), (4, "u\r\nX: y", ""), (5, "http://ü/5", BIG),
    (6, "http://a/6", BIG), (7, "http://a/7", "é\r\n0\r\n\r\n" * 900), (None, "http://a/8", "<p>x</p>"), (None, "n", "alone"), (1, "again", "<p>x</p>"),
]


def pages(spark, rows=ROWS):
    return spark.createDataFrame([(*r, 0, "k") for r in rows], "page_id long, url string, html string, number int, digest string")


def read_back(spark, df, **options):
    paths = warc.write(df, shared_folder(spark, "test-warc"), **options)
    return paths, warc.reassemble(warc.read_records(spark, paths))


def test_round_trip(spark):
    _, back = read_back(spark, pages(spark), segment_bytes=1000, chunk_bytes=77)
    got = sorted((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or 0, r.complete) for r in back.collect())
    first = {"<p>x</p>": 1, BIG: 5, "": 3, "é\r\n0\r\n\r\n" * 900: 7, "alone": None}
    want = []
    for page_id, _, html in ROWS:
        payload = (html or "").encode()
        origin = first[html or ""]
        revisit = origin is not None and page_id != origin
        want.append((page_id or 0, len(payload), warc.digest(payload), "revisit" if revisit else "response", origin if revisit else 0, True))
    assert got == sorted(want)


def test_small_payloads_are_responses(spark):
    _, back = read_back(spark, pages(spark), least_bytes=100)
    assert {r.page_id for r in back.where("record_type = 'revisit'").collect()} == {6}


def test_a_lost_segment_is_told(spark):
    paths, _ = read_back(spark, pages(spark), segment_bytes=1000)
    whole = [p for p in paths if "continued" not in p]
    back = {r.page_id: r.complete for r in warc.reassemble(warc.read_records(spark, whole)).collect() if r.record_type == "response"}
    assert back[5] is False and back[7] is False and back[1] is True


def test_empty_table(spark):
    paths, back = read_back(spark, pages(spark).limit(0))
    assert paths == [] and back.count() == 0


def test_framing():
    body = bytes(range(256)) * 9
    for size in (1, 7, 4096):
        assert warc.unchunked(warc.chunked(body, size)) == (body, True)
    assert warc.unchunked(b"") == (b"", False)
    assert warc.unchunked(b"5;name=v\r\nhello\r\n0\r\nTrailer: x\r\n\r\n") == (b"hello", True)
    assert warc.unchunked(b"5\r\nhel") == (b"", False)
    assert warc.unchunked(b"zz\r\n") == (b"", False)


def test_a_record_cut_short():
    data = warc.record("response", "1", b"abc") + warc.record("response", "2", b"defg")
    assert [(b, f.get(warc.CUT)) for f, b in warc.records(io.BytesIO(data))] == [(b"abc", None), (b"defg", None)]
    assert [(b, f.get(warc.CUT)) for f, b in warc.records(io.BytesIO(data[:-6]))] == [(b"abc", None), (b"de", "4")]
    for size in range(len(data)):
        found = list(warc.records(io.BytesIO(data[:size])))
        assert all(warc.CUT not in f for f, _ in found[:-1]) and len(found) <= 2
    packed = gzip.compress(data)
    with gzip.open(io.BytesIO(packed[:-20])) as stream:
        assert [b for _, b in warc.records(stream)][:1] == [b"abc"]


@pytest.mark.parametrize("less", [1, 9, 40, 200])
def test_an_archive_cut_short_gives_incomplete_rows(spark, tmp_path, less):
    """The last record stays a row, and is not complete."""
    pages = spark.createDataFrame([(i, f"u{i}", "<html>" + "x" * 300 + str(i)) for i in range(5)], "page_id long, url string, html string").coalesce(1)
    (path,) = warc.write(pages, str(tmp_path), least_bytes=0)
    raw = gzip.open(path).read()
    short = raw.rstrip(b"\r\n")[:-less]
    with gzip.open(path, "wb") as f:
        f.write(short)
    rows = warc.reassemble(warc.read_records(spark, [path])).collect()
    assert len(rows) == 5 and sorted(r.complete for r in rows) == [False, True, True, True, True]
