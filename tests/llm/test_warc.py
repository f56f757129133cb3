import gzip
import hashlib
import io

import pytest

from feedgate.llm import warc


def expected(rows):
    best = {}
    for page, _, html in rows:
        if len((html or "").encode()) >= 1000 and page is not None:
            best[html] = max(page, best.get(html, page))
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        first = best.get(html, page)
        again = len(data) >= 1000 and first is not None and first != page
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", first if again else None))
    return out


ROWS = [
    (1, "http://a/ü?x=1", "ä" * 600), (4, None, "ä" * 600), (2, "http://b", "ä" * 600), (3, "u\r\nWARC-Type: x", None),
    (5, "http://c", ""), (6, "http://d", "short"), (7, "http://e", "short"), (8, "http://f", "x" * 1000), (8, "http://f", "x" * 1000),
    (None, "http://g", "x" * 1000), (None, "http://h", "lonely " * 400), (9, "http://i", "WARC/1.1\r\n\r\n" * 5000), (0, "j", "\x00😀" * 99_999),
]


def test_round_trip(spark):
    frame = spark.createDataFrame([(*r, "k") for r in ROWS], "page_id long, url string, html string, digest string").repartition(3)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, warc.round_trip(frame).collect()), key=key) == sorted(expected(ROWS), key=key)
    assert warc.round_trip(frame.limit(0)).count() == 0


def test_chunks_carry_running_digests(spark):
    frame = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    chunks = warc.read_chunks(warc.write_archives(frame), chunk_bytes=1000).collect()
    records = {}
    for c in sorted(chunks, key=lambda c: (c.archive, c.record_no, c.chunk_no)):
        records.setdefault((c.archive, c.record_no), []).append(c)
    assert len(records) == len(ROWS)
    for parts in records.values():
        assert [p.chunk_no for p in parts] == list(range(len(parts)))
        assert [p.is_last for p in parts] == [False] * (len(parts) - 1) + [True]
        assert max(len(p.chunk) for p in parts) <= 1000
        if parts[0].record_type == "response":
            seen = b""
            for p in parts:
                seen += bytes(p.chunk)
                assert (p.payload_bytes, p.payload_digest) == (len(seen), hashlib.sha1(seen).hexdigest())
    longest = max(records.values(), key=len)
    assert b"".join(bytes(p.chunk) for p in longest).decode() == max((r[2] or "" for r in ROWS), key=lambda t: len(t.encode()))


def test_small_archives_and_damage(spark, monkeypatch):
    out = io.BytesIO()
    text = "payload " * 300
    data = text.encode()
    warc.write_record(out, 1, "http://a", text, len(data), hashlib.sha1(data).hexdigest(), None)
    plain = gzip.decompress(out.getvalue())
    assert list(warc.read_archive(io.BytesIO(plain), "a", 100))[-1]["payload_bytes"] == len(data)
    with pytest.raises(ValueError):
        list(warc.read_archive(io.BytesIO(plain.replace(b"payload", b"PAYLOAD", 1)), "a", 100))
    with pytest.raises(ValueError):
        list(warc.read_archive(io.BytesIO(plain[:-200]), "a", 100))


def test_whole_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = [tuple(r) for r in pages.select("page_id", "url", "html").collect()]
    assert sorted(map(tuple, warc.round_trip(pages).collect())) == sorted(expected(rows))
