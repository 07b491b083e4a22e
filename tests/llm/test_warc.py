import gzip
import hashlib
from pathlib import Path

from pairloom.llm import warc
from pairloom.storage import new_path


def pages(spark):
    big = "<p>" + "text ä " * 40_000
    rows = [
        (1, "https://www.example.com/a?b=1#c", "x" * 200), (2, "http://example.com:8080/A", "x" * 200),
        (3, None, "x" * 200), (4, "http://[bad", "short"), (5, "ftp://a.b/\r\nX: y", "short"), (6, "", None),
        (7, "http://example.com/a", big), (7, "http://example.com/a", big), (9, "mailto:a@b", "HTTP/1.1\r\n\r\n" * 30),
        (None, "http://example.com/n", "x" * 200), (None, "http://n/", "y" * 200), (8, "http://example.com/a", ""),
    ]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS digest")


def want(rows):
    out = []
    for key, _, html in rows:
        payload = (html or "").encode()
        same = [k for k, _, h in rows if h == html and k is not None]
        first = min(same) if len(payload) >= 100 and same else None
        revisit = first is not None and first != key
        out.append((key, len(payload), hashlib.sha256(payload).hexdigest(),
                    "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


def test_round_trip(spark):
    rows, table = pages(spark)
    assert sorted((tuple(r) for r in warc.archive_digests(table).collect()), key=repr) == want(rows)
    assert warc.archive_digests(table.where("page_id < 0")).count() == 0


def test_files_and_index(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 2)
    rows, table = pages(spark)
    folder = new_path(spark, "test-archives")
    warc.write_archives(table, folder)
    names = [p for p in Path(folder.removeprefix("file:")).rglob("part-*") if not p.name.endswith(".crc")]
    whole = b"".join(gzip.open(p).read() for p in names)
    assert whole.count(b"WARC/1.0\r\n") == len(rows)
    captures = warc.read_captures(spark, folder)
    index = warc.build_index(captures)
    directory = index.select("shard", "block", "first_key", "last_key").collect()
    assert len(directory) > 3
    urls = spark.createDataFrame([("http://EXAMPLE.com/a",), ("http://none/",), (None,)], "url string")
    entries = warc.look_up(index, urls)
    found = sorted(r.page_id for r in warc.read_records(spark, folder, entries).collect())
    assert found == [3, 6, 7, 7, 8]
    records = {r.page_id: r for r in warc.read_records(spark, folder, captures).collect()}
    assert bytes(records[4].payload) == b"short" and records[2].payload is None and records[2].refers_to == 1


def test_keys():
    assert warc.host_key("https://www.Example.com/A?q=1#f") == "com,example)/A?q=1"
    assert warc.host_key("http://example.com:8080") == "com,example:8080)/"
    assert warc.host_key("http://a.b:80/x").startswith("b,a)/x")
    assert warc.host_key(None) == "" and warc.host_key("http://[bad") == "http://[bad"
