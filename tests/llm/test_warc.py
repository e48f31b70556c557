import base64
import gzip
import hashlib

import pytest

from newsmill.llm import warc


def sha(t):
    return base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()


def brute(rows):
    best = {}
    for p, _, h in rows:
        best[h or ""] = max(best.get(h or "", -1), -1 if p is None else p)
    used, out = set(), []
    for p, _, h in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        top = best[h or ""]
        first = (-1 if p is None else p) == top and (h or "") not in used
        if first:
            used.add(h or "")
        out.append((str(p), len((h or "").encode()), sha(h), "response" if first else "revisit", str(None if first or top == -1 else top)))
    return sorted(out)


def test_round_trip_of_odd_pages(spark):
    pages = [(i, f"http://h{i}.example/a b", t) for i, t in enumerate(["<p>é😀</p>", "x\r\n\r\ny", "WARC/1.1\r\nContent-Length: 5\r\n\r\n", "", "filedesc://x 1\n", "<p>é😀</p>", "a" * 3_000_000, "\n\n", "x\r\n\r\ny"])]
    pages += [(30, "filedesc://page.arc", "of that url"), (31, "filedesc://page.arc 0.0.0.0 1 text/plain 5", "x\n\n")]
    pages += [(20, None, None), (21, "", ""), (None, "http://n.example", "<p>é😀</p>"), (None, None, "alone"), (5, "http://h5.example/a b", "<p>é😀</p>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    got = warc.archive(df).collect()
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got) == brute(pages)
    assert warc.archive(df.limit(0)).count() == 0


def test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    df = df.unionByName(df.limit(20).withColumn("page_id", df.page_id + 1000))
    got = warc.archive(df).collect()
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got) == brute([(r.page_id, r.url, r.html) for r in df.collect()])


def test_versions_members_and_lengths():
    def doc(v, url, body):
        mid = "200 SUM - 0 f.arc " if v == 2 else ""
        return f"{url} 1.2.3.4 20010203040506 text/html {mid}{len(body)}\n".encode() + body + b"\n"

    for v, names in ((1, warc.V1), (2, warc.V2)):
        head = f"{v} 0 x\n{names}\n".encode()
        first = f"filedesc://f.arc 0.0.0.0 20010203040506 text/plain {'200 - - 0 f.arc ' if v == 2 else ''}{len(head)}\n".encode() + head + b"\n"
        parts = [first, doc(v, "http://a/", b"HTTP/1.0 200 OK\r\n\r\nfiledesc://b"), doc(v, "http://b/x y", b"line\nhttp://c/ 1 2 3 4\n")]
        for data in (gzip.compress(b"".join(parts)), b"".join(map(gzip.compress, parts))):
            got = list(warc.arc_records(data))
            assert [(u, d) for _, u, _, d, _ in got] == [("http://a/", "20010203040506"), ("http://b/x y", "20010203040506")]
            assert got[1][-1] == b"line\nhttp://c/ 1 2 3 4\n"


def test_records_that_are_no_http(spark, tmp_path):
    """dns, ftp and bare records become resources of their declared type; equal ones revisits with an empty block."""
    web = b"HTTP/1.0 200 OK\nContent-Type: text/html\n\n<p>lf</p>\n\nmore"
    docs = [("dns:a.example", "text/dns", "20010203040506", b"a.example. 1 IN A 1.2.3.4\r\n\r\nrest"), ("ftp://f.example/x", "application/zip", "200102030405", b"\x00PK\xff\n"), ("dns:b.example", "text/dns", "2001", b"a.example. 1 IN A 1.2.3.4\r\n\r\nrest"), ("http://w.example/", "text/html", "20010203040506", web), ("http://bare.example/", "text/plain", "20010203040506", b"HTTP/ is a protocol"), ("ftp://f.example/lf", "text/html", "20010203040506", b"<p>lf</p>\n\nmore"), ("dns:none", "text/dns", "20010203040506", b"")]
    (tmp_path / "arc").mkdir()
    for i, (v, names) in enumerate([(1, warc.V1), (2, warc.V2)]):
        mid = "200 - - 0 f.arc " if v == 2 else ""
        head = f"{v} 0 x\n{names}\n".encode()
        data = f"filedesc://f{i}.arc 0.0.0.0 20010203040506 text/plain {mid}{len(head)}\n".encode() + head + b"\n"
        for url, kind, date, body in docs:
            data += f"{url} {'-' if 'dns' in url else '9.8.7.6'} {date} {kind} {mid}{len(body)}\n".encode() + body + b"\n"
        (tmp_path / "arc" / f"part-0000{i}.arc.gz").write_bytes(gzip.compress(data))
    warc.convert(spark, str(tmp_path / "arc"), str(tmp_path / "warc"))
    back = warc.read_warc(spark, str(tmp_path / "warc")).collect()
    assert sum(r.kind == "warcinfo" for r in back) == 2
    got = [r for r in back if r.kind != "warcinfo"]
    payload = {u: b"<p>lf</p>\n\nmore" if b is web else b for u, _, _, b in docs}
    assert len(got) == 2 * len(docs)
    whole = [r for r in got if r.kind != "revisit"]
    assert len(whole) == len(set(payload.values())) == len({r.payload_digest for r in whole})
    by_id = {r.id: r for r in whole}
    for r in got:
        assert r.payload_digest == base64.b32encode(hashlib.sha1(payload[r.uri]).digest()).decode()
        assert r.payload_bytes == len(payload[r.uri])
        assert r.kind == "revisit" or r.type == ("application/http; msgtype=response" if r.uri == "http://w.example/" else {u: k for u, k, _, _ in docs}[r.uri])
        assert r.kind != "revisit" or by_id[r.refers_to_id].payload_digest == r.payload_digest
    dates = {r.uri: r.date for r in got}
    assert dates["ftp://f.example/x"] == "2001-02-03T04:05:00Z" and dates["dns:b.example"] == "2001-01-01T00:00:00Z"
    fields = [f for p in (tmp_path / "warc").glob("*.gz") for f in warc.warc_records(p.read_bytes())]
    infos = {f["warc-record-id"]: b for f, b in fields if f["warc-type"] == "warcinfo"}
    assert sorted(b.split(b"version ")[1] for b in infos.values()) == [b"1\r\n", b"2\r\n"]
    assert all(f["warc-warcinfo-id"] in infos for f, _ in fields if f["warc-type"] != "warcinfo")
    assert all(("warc-ip-address" in f) == ("dns" not in f["warc-target-uri"]) for f, _ in fields if f["warc-type"] != "warcinfo")


def test_a_damaged_digest_is_an_error(spark, tmp_path):
    warc.write_arc(spark.createDataFrame([(1, "http://a.example", "text")], "page_id long, url string, html string"), str(tmp_path / "arc"))
    warc.convert(spark, str(tmp_path / "arc"), str(tmp_path / "warc"))
    (tmp_path / "bad").mkdir()
    for p in (tmp_path / "warc").glob("*.gz"):
        (tmp_path / "bad" / p.name).write_bytes(gzip.compress(gzip.decompress(p.read_bytes()).replace(b"text", b"test")))
    with pytest.raises(Exception, match="digest of"):
        warc.read_warc(spark, str(tmp_path / "bad")).collect()
