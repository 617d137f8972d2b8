import base64
import gzip
import hashlib

import pytest

from tessera.llm import warc


def b32(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


PAGES = [(3, "http://a/ b", "<p>é\r\n\r\nWARC/1.0</p>"), (1, None, "same"), (2, "http://c", "same"), (9, "http://c", "same"), (4, "x", None), (5, "x", ""), (6, "", "x" * 200000), (7, "u", "same\r\n\r\n"), (8, "u", "one"), (8, "u", "one"), (10, "u", "漢字\n")]


def brute(pages, least):
    first = {}
    for i, _, h in pages:
        first[h or ""] = min(i, first.get(h or "", i))
    out = []
    for i, _, h in pages:
        n = len((h or "").encode())
        again = n >= least and first[h or ""] != i
        out.append((i, n, b32(h), "revisit" if again else "response", first[h or ""] if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least,version", [(0, 1), (4, 2), (5, 1)])
def test_pages(spark, least, version):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 AS id", "2 AS digest", "3 AS value")
    got = warc.archive_pages(df.repartition(3), min_dedup=least, version=version)
    assert sorted(map(tuple, got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr) == brute(PAGES, least)
    assert warc.archive_pages(df.limit(0)).count() == 0


def test_arc_versions_and_lengths():
    v2 = "2 0 x\n" + warc.FIELDS[2] + "\n"
    data = (f"filedesc://x 0.0.0.0 20010203040506 text/plain 200 - - 0 x {len(v2)}\n{v2}\n" + "http://u 1.2.3.4 20010203 text/html 200 - - 7 x 11\nHello\nWorld\n").encode()
    (r,) = warc.read_arc(data)
    assert r["version"] == 2 and r["content"] == b"Hello\nWorld" and r["Result-code"] == "200"
    header, block = warc.to_warc(r, "k")
    (h, b), = warc.read_warc(header + block + b"\r\n\r\n")
    assert h["warc-type"] == "resource" and h["warc-date"] == "2001-02-03T00:00:00Z" and b == b"Hello\nWorld" and h["warc-payload-digest"] == f"sha1:{b32('Hello' + chr(10) + 'World')}"
    with pytest.raises(ValueError):
        list(warc.read_arc(data[:-8]))
    with pytest.raises(ValueError):
        list(warc.read_arc(data.replace(b"200 - - 7 x", b"7 x")))


def test_ids_that_are_no_numbers_and_large_pages(spark, monkeypatch):
    monkeypatch.setattr(warc, "SIZES", [(100, 3), (1000, 2), (1 << 62, 1)])
    pages = [(f"p{i}", "u", "x" * (i * 37) if i % 3 else "same") for i in range(40)]
    got = warc.archive_pages(spark.createDataFrame(pages, "page_id string, url string, html string"))
    assert sorted(map(tuple, got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr) == brute(pages, 0)


def test_files_are_whole_archives(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    warc.write_archive(df, str(tmp_path / "w"))
    records = [r for f in (tmp_path / "w").glob("*.gz") for r in warc.read_warc(gzip.decompress(f.read_bytes()))]
    assert len(records) == len(PAGES)


def test_pages_without_an_id(spark):
    pages = [(None, "u", "same"), (None, "u", "same"), (3, "u", "same"), (4, "u", "same"), (None, "u", None)]
    got = warc.archive_pages(spark.createDataFrame(pages, "page_id long, url string, html string"))
    kinds = sorted(((x.page_id, x.record_type, x.refers_to) for x in got.collect()), key=str)
    assert kinds == sorted([(None, "response", None), (None, "response", None), (3, "response", None), (4, "revisit", 3), (None, "response", None)], key=str)
