import gzip
import hashlib
from collections import Counter

from skyledger.llm import warc


def plain(rows):
    first = {}
    for i, _, h in rows:
        data = (h or "").encode()
        if len(data) >= 100 and i is not None:
            first[data] = min(first.get(data, i), i)
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        f = first.get(data)
        again = f is not None and f != i
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", f if again else None))
    return Counter(out)


def test_given_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    assert Counter(tuple(r) for r in warc.capture_rows(pages).collect()) == plain(rows)


def test_odd_rows(frame, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    long, hot = "é" * 300_000, "same page " * 20
    rows = [(i, f"http://a.example.com/{i % 4}", hot) for i in range(40, 80)] + [(i, "http://a.example.com/same", f"small {i % 2}") for i in range(10)]
    rows += [(100, None, None), (101, "", ""), (102, "no url\twith\ttabs\nand % lines", long), (None, "http://x.example/é?q=1#frag", hot), (None, None, None), (50, "http://a.example.com/2", hot), (40, "http://other/", hot)]
    df = frame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, size int", 4)
    assert Counter(tuple(r) for r in warc.capture_rows(df).collect()) == plain(rows)
    assert warc.capture_rows(df.limit(0)).count() == 0


def test_keys(spark):
    urls = ["https://user@WWW.Example.com:8080/a/b?x=1#top", "http://h", "mailto:x", None, ""]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(warc.reversed_host_key(warc.F.col("u")).alias("k")).collect()
    assert [r.k for r in got] == ["com:8080,example,www)/a/b?x=1", "h)", ")mailto:x", "", ")"]


def test_archives_are_plain_gzip_warc(frame, tmp_path):
    pages = frame([(1, "http://a/1", "x" * 200), (2, "http://a/2", "x" * 200)], "page_id long, url string, html string", 1)
    lines = warc.write_archives(pages, str(tmp_path)).collect()
    data = b"".join(gzip.open(f).read() for f in sorted({r.file for r in lines}))
    assert data.count(b"WARC/1.1\r\n") == 2 and data.count(b"x" * 200) == 1 and b"WARC-Refers-To: <urn:page:1>" in data
    parts = warc.build_index(warc.cut(frame([tuple(r) for r in lines], warc._LINE)), str(tmp_path))
    reader = warc.Reader(parts)
    (line,) = reader.find("a)/1", 1)
    assert warc.parse_record(reader.read(line[3], int(line[4]), int(line[5])))["payload"] == b"x" * 200
    assert reader.find("a)/1", 2) == [] and reader.find("zzz", None) == []
