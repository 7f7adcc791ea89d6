import hashlib
from collections import defaultdict

import duckdb
import pytest

from tallyweave.llm import archives
from tallyweave.llm.sql import ORACLE


def _hold(rows, got):
    groups = defaultdict(list)
    for page, html in rows:
        raw = (html or "").encode()
        groups[hashlib.sha256(raw).hexdigest(), len(raw)].append(page)
    want = []
    for (digest, n), ids in groups.items():
        first = min(ids)
        want += [(i, n, digest, "revisit" if n >= 100 and i != first else "response", first if n >= 100 and i != first else None) for i in ids]
    assert sorted(tuple(r) for r in got) == sorted(want)


CASES = [(1, None), (2, ""), (3, "x" * 99), (4, "x" * 99), (5, "x" * 100), (6, "x" * 100), (7, "é" * 50), (9, "é" * 50), (8, "a\r\n\r\nb\n" * 40), (11, "a\r\n\r\nb\n" * 40), (12, "日本" * 900_000), (13, "\x00\x01" * 60), (14, "WARC/1.1\r\n\r\n" * 20), (15, "1 0 x\nURL\n" * 30)]


def test_pages_there_and_back(spark):
    rows = [(i, u, h, "x", "y") for (i, h), u in zip(CASES, ["http://e.example/a b", None, "", *["http://e.example/é\n"] * 11])]
    df = spark.createDataFrame([*rows, (None, "u", "h" * 200, "x", "y")], "page_id long, url string, html string, payload string, record_id string").repartition(3)
    _hold(CASES, archives.convert(df).collect())
    assert archives.convert(df.where("false")).isEmpty()


@pytest.mark.parametrize("version", [1, 2])
def test_arc_records(spark, version):
    df = spark.createDataFrame([(i, f"http://e.example/{i}", h) for i, h in CASES], "page_id long, url string, html string").coalesce(1)
    arcs = archives.pages_to_arc(df, version, "20200102030405")
    assert bytes(arcs.first()[0]).startswith(f"filedesc://pages.arc 0.0.0.0 20200102030405 text/plain {'200 - - 0 pages.arc ' if version == 2 else ''}".encode())
    rows = {r["page_id"]: r for r in archives.arc_records(arcs).collect()}
    for i, h in CASES:
        raw = (h or "").encode()
        assert bytes(rows[i]["payload"]) == raw and rows[i]["payload_digest"] == hashlib.sha256(raw).hexdigest() and rows[i]["date"] == "2020-01-02T03:04:05Z"
    assert len({r["record_id"] for r in rows.values()}) == len(CASES)


def test_declared_lengths_are_kept():
    good = b"filedesc://a 0.0.0.0 20200101000000 text/plain 71\n1 0 x\nURL IP-address Archive-date Content-type Archive-length\n" + b" " * 9
    with pytest.raises(ValueError):
        list(archives.parse_arc(good[:40] + b"text/plain 5\n9 0 x\n"))
    block = b"1 0 x\nURL IP-address Archive-date Content-type Archive-length\n"
    arc = b"filedesc://a 0.0.0.0 20200101000000 text/plain %d\n" % len(block) + block + b"\nhttp://e 1.1.1.1 20200101000000 text/html 500\nshort"
    with pytest.raises(ValueError, match="cut short"):
        list(archives.parse_arc(arc))


def test_warc_bodies_survive(spark):
    df = spark.createDataFrame([(i, f"http://e.example/{i}", h) for i, h in CASES], "page_id long, url string, html string")
    path = archives.new_path(spark, "warc-test")
    archives.write_warc(archives.to_warc(archives.arc_records(archives.pages_to_arc(df))), path, per_file=4)
    rows = archives.read_warc(spark, path).collect()
    html = dict(CASES)
    assert len(rows) == len(CASES)
    assert all(bytes(r["payload"]) == (html[r["page_id"]] or "").encode() for r in rows if r["record_type"] == "response")


def test_repeated_and_unnamed_rows(spark, tmp_path):
    html = "same page " * 20
    rows = [(5, "http://e/5", html), (2, "http://e/2", html), (2, "http://e/2", html), (None, None, html), (7, "http://e/7", "x"), (7, "http://e/7", "x"), (8, None, "y" * 200_000), (9, None, "y" * 200_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    got = sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in archives.convert(df, unnamed=True).collect())
    assert got == sorted([("2", "response", None), ("2", "revisit", 2), ("5", "revisit", 2), ("None", "revisit", 2), ("7", "response", None), ("7", "response", None), ("8", "response", None), ("9", "revisit", 8)])
    df.write.parquet(str(tmp_path / "pages.parquet"))
    rows = duckdb.sql(ORACLE["op8_archives"].replace("FROM pages", f"FROM '{tmp_path}/pages.parquet/*.parquet'")).fetchall()
    assert sorted((str(r[0]), r[3], r[4]) for r in rows) == got


def test_archives_of_other_makers(spark):
    fields = " ".join(archives.ARC_FIELDS[1])
    doc = b"HTTP/1.0 200 OK\r\nContent-Type: text/html\r\n\r\n<p>old</p>"
    body = f"1 0 other\n{fields}\n".encode()
    arc = b"filedesc://old.arc 0.0.0.0 19990101000000 text/plain %d\n" % len(body) + body + (b"\nhttp://old.example/ 1.2.3.4 19990203040506 text/html %d\n" % len(doc) + doc) * 2
    records = archives.arc_records(spark.createDataFrame([(arc,)], "archive binary"))
    path = archives.new_path(spark, "warc-old")
    archives.write_warc(archives.to_warc(records, least=5), path)
    rows = sorted(archives.read_warc(spark, path).collect(), key=lambda r: r["record_type"])
    assert [(r["page_id"], r["record_type"], r["url"], r["date"]) for r in rows] == [(None, t, "http://old.example/", "1999-02-03T04:05:06Z") for t in ("response", "revisit")]
    assert bytes(rows[0]["payload"]) == b"<p>old</p>" and rows[1]["refers_to_id"] == rows[0]["record_id"] and rows[0]["payload_digest"] == rows[1]["payload_digest"]


def _legacy(spark, *records, version=1, maker="1 0 Old Crawl"):
    """An archive of (url, type, document) in the way of old crawlers."""
    fields = archives.ARC_FIELDS[version]
    body = f"{maker}\n{' '.join(fields)}\n".encode()
    extra = ["200", "-", "-", "0", "x.arc"] if version == 2 else []
    out = " ".join(["filedesc://old-1.arc", "0.0.0.0", "19990203040506", "text/plain", *extra, str(len(body))]).encode() + b"\n" + body
    for url, mime, doc in records:
        out += b"\n" + " ".join([url, "1.2.3.4", "19990203040506", mime, *extra, str(len(doc))]).encode() + b"\n" + doc
    return spark.createDataFrame([(out,)], "archive binary")


LEGACY = {
    "http://e/lf": ("text/html", b"HTTP/1.0 200 OK\nContent-Type: text/html\nX: 1\n\n<p>bare\r\n\r\nline</p>", "response", b"<p>bare\r\n\r\nline</p>"),
    "http://e/mixed": ("text/html", b"HTTP/1.0 200 OK\r\nA: b\n\r\nbody\n\n", "response", b"body\n\n"),
    "http://e/latin": ("text/html", b"HTTP/1.1 200 Tr\xe8s bien\r\nX-N: \xff\xfe\xe9\r\n\r\n\x80\xff raw", "response", b"\x80\xff raw"),
    "http://e/headless": ("text/html", b"<html>HTTP/0.9 had no header\n\nnone</html>", "resource", b"<html>HTTP/0.9 had no header\n\nnone</html>"),
    "http://e/only-header": ("text/html", b"HTTP/1.0 304 Not Modified\nX: y\n", "response", b""),
    "http://e/empty": ("no-type", b"", "resource", b""),
    "dns:e.example": ("text/dns", b"19990203040506\ne.example. 300 IN A 1.2.3.4\n\n", "resource", b"19990203040506\ne.example. 300 IN A 1.2.3.4\n\n"),
    "ftp://e/file": ("application/octet-stream", b"\x00\x01HTTP/1.0 \xff", "resource", b"\x00\x01HTTP/1.0 \xff"),
}


@pytest.mark.parametrize("version", [1, 2])
def test_legacy_archives(spark, version):
    arcs = _legacy(spark, *((u, m, d) for u, (m, d, _, _) in LEGACY.items()), ("http://e/a b  c", "text/html", b"HTTP/1.0 200 OK\n\nspaces"), version=version, maker=f"{version} 0 Old Crawl")
    records = archives.arc_records(arcs, info=True)
    found = {r["url"]: r for r in records.collect()}
    for url, (_, doc, kind, payload) in LEGACY.items():
        r = found[url]
        assert (r["kind"], bytes(r["payload"])) == (kind, payload) and bytes(r["http"]) + payload == doc
        assert r["payload_digest"] == hashlib.sha256(payload).hexdigest() and r["payload_bytes"] == len(payload)
    assert bytes(found["http://e/a%20b%20%20c"]["payload"]) == b"spaces" and found["filedesc://old-1.arc"]["kind"] == "warcinfo"
    path = archives.new_path(spark, "warc-legacy")
    archives.write_warc(archives.to_warc(records, least=1), path)
    back = archives.read_warc(spark, path).collect()
    got = {r["url"]: r for r in back}
    assert len(back) == len(LEGACY) + 2
    for url, (_, _, kind, payload) in LEGACY.items():
        assert (got[url]["record_type"], bytes(got[url]["payload"])) == (kind, payload)
    info = got[None]
    assert info["record_type"] == "warcinfo" and bytes(info["payload"]) == f"converted-from: old-1.arc\r\narc-version: {version}\r\norigin: Old Crawl\r\n".encode()
    # headers and documents stand in the file as they came
    import zlib

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).collect()
    whole = b"".join(zlib.decompress(bytes(f["content"]), 31) for f in files if f["path"].endswith(".gz"))
    assert all(doc in whole for _, doc, _, _ in LEGACY.values()) and b"WARC-Filename: old-1.arc\r\n" in whole and b"Content-Type: text/dns\r\n" in whole
