"""Legacy ARC archives turned into WARC archives, and WARC archives read back.

An ARC file begins with a version block that says which fields a record's header line has (version 1: five, version 2: ten);
the last is the declared length. Each record becomes a WARC record with an identifier made from its contents, an ISO time, a
type and digests. Records of equal payload are one response, that of the smallest page_id, and revisits of it.

What an HTTP server sent is a response, its header byte for byte as it was, whatever the line ends and character set; the header
ends at the first empty line, or is all there is. Anything else, such as DNS answers, FTP files or documents sent without a
header, is a resource of its declared type, its payload the whole document. The version block becomes a warcinfo record that
names the archive, its version and its maker. A URL that has spaces takes what its header line has too many of.

Defined cases: null html is an empty payload; a null or empty url becomes urn:page:<page_id>, and white space in a url is
percent-encoded; rows with a null page_id are left out, or with `unnamed` are records without a page, which come after all
others when a response is chosen; rows that share a page_id, and rows alike in every column, are records of their own, told
apart by their archive and where they are in it: one is the response, the others revisit it; payloads below `least` bytes are
always responses; archives of other makers have no page_ids, and records of other types than responses and revisits are passed
on as they are; an empty table gives no records; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import mapped, new_path

#: The fields of an ARC header line, by version.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, kind string, url string, ip string, date string, mime string, http binary, payload binary, payload_bytes long, payload_digest string, record_id string"
#: Where an HTTP header ends; old servers send bare line feeds.
_EMPTY_LINE = re.compile(rb"\r?\n\r?\n")
_STATUS = re.compile(rb"(?:HTTP/\d|ICY )", re.I)
_PART = 1 << 20
#: Payload bytes below which a page is in a class, and records in one file of the class: files of 128 MB at most, or of one record.
FILES = [(1 << 17, 1000), (1 << 21, 60), (1 << 25, 4), (1 << 62, 1)]


def _arc_url(url, page_id) -> str:
    return re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url) if isinstance(url, str) and url else f"urn:page:{page_id}"


def pages_to_arc(pages: DataFrame, version: int | None = None, date: str = "20240101000000", unnamed: bool = False) -> DataFrame:
    """One column `archive` of ARC files of about a megabyte, numbered so that no two are alike. version: 1, 2, or None for both in turn."""

    def write(frames):
        number = serial = 0
        part = TaskContext.get().partitionId()

        def block(records: list[bytes], v: int) -> bytes:
            nonlocal serial
            body = f"{v} 0 tallyweave\n{' '.join(ARC_FIELDS[v])}\nserial {part}-{serial}\n".encode()
            serial += 1
            tail = ["200", "-", "-", "0", "pages.arc"] if v == 2 else []
            return " ".join(["filedesc://pages.arc", "0.0.0.0", date, "text/plain", *tail, str(len(body))]).encode() + b"\n" + body + b"".join(records)

        for frame in frames:
            records, size, out = [], 0, []
            for page_id, url, html in zip(frame["page_id"], frame["url"], frame["html"], strict=True):
                page_id = None if pd.isna(page_id) else int(page_id)
                named = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
                v = version or 1 + number % 2
                payload = html.encode("utf-8", "surrogatepass") if isinstance(html, str) else b""
                doc = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n{named}\r\n".encode() + payload
                offset = str(sum(map(len, records)) if len(records) < 2 else size)
                extra = ["200", f"{zlib.crc32(payload):08x}", "-", offset, "pages.arc"] if v == 2 else []
                head = " ".join([_arc_url(url, page_id), "0.0.0.0", date, "text/html", *extra, str(len(doc))])
                records.append(b"\n" + head.encode("utf-8", "surrogatepass") + b"\n" + doc)
                size += len(doc)
                if size > _PART:
                    out.append(block(records, v))
                    records, size, number = [], 0, number + 1
            if records:
                out.append(block(records, version or 1 + number % 2))
                number += 1
            yield pd.DataFrame({"archive": out})

    rows = pages if unnamed else pages.where("page_id is not null")
    # ids as text: a column of whole numbers and nulls would become floats
    rows = rows.select(F.col("page_id").cast("long").cast("string").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return mapped(rows, write, "archive binary")


def http_parts(doc: bytes) -> tuple[bytes, bytes]:
    """The header of what an HTTP server sent, with the empty line, and the payload."""
    end = _EMPTY_LINE.search(doc)
    return (doc[: end.end()], doc[end.end() :]) if end else (doc, b"")


def parse_arc(data: bytes, info: bool = False):
    """(fields, network document) of each record of an ARC file, by the header its version block declares; with info of that block too."""
    end = data.index(b"\n")
    first = data[:end].decode("utf-8", "surrogatepass").split(" ")
    size = int(first[-1])
    version, declared = data[end + 1 : end + 1 + size].decode().split("\n")[:2]
    fields = declared.split(" ")
    if fields != ARC_FIELDS.get(int(version.split(" ")[0])):
        raise ValueError(f"not an ARC version block: {version!r}, {declared!r}")
    if info:
        yield dict(zip(fields, [first[0], *first[1:4], *[""] * (len(fields) - 5), first[-1]], strict=True)), data[end + 1 : end + 1 + size]
    at = end + 1 + size
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.index(b"\n", at)
        values = data[at:end].decode("utf-8", "surrogatepass").rstrip("\r").split(" ")
        values = [" ".join(values[: len(values) - len(fields) + 1]), *values[len(values) - len(fields) + 1 :]] if len(values) > len(fields) else values
        if len(values) != len(fields):
            raise ValueError(f"an ARC header line of {len(values)} fields: {values[:3]}")
        head = dict(zip(fields, values, strict=True))
        size = int(head["Archive-length"])
        if end + 1 + size > len(data):
            raise ValueError(f"the record of {values[0]} is cut short")
        yield head, data[end + 1 : end + 1 + size]
        at = end + 1 + size


def _made_of(head: dict, doc: bytes) -> tuple[str, str, bytes, bytes]:
    """kind, type of contents, HTTP header and payload of an ARC record."""
    url = head["URL"]
    if url.lower().startswith("filedesc:"):
        version, *_ = doc.decode("utf-8", "replace").split("\n")
        number, _, maker = version.partition(" ")
        return "warcinfo", "application/warc-fields", b"", f"converted-from: {url[11:]}\r\narc-version: {number}\r\norigin: {maker.partition(' ')[2]}\r\n".encode()
    if url.lower().startswith(("dns:", "ftp:")) or not _STATUS.match(doc):
        return "resource", head["Content-type"], b"", doc
    return "response", head["Content-type"], *http_parts(doc)


def arc_records(archives: DataFrame, info: bool = False) -> DataFrame:
    """The records of the ARC files in column `archive`, with WARC types, identifiers, times and digests; info: those of their version blocks too."""

    def read(frames):
        for frame in frames:
            for data in frame["archive"]:
                rows = []
                whole = bytes(data)
                made = hashlib.sha256(whole).hexdigest()
                for number, (head, doc) in enumerate(parse_arc(whole, info)):
                    kind, mime, http, payload = _made_of(head, doc)
                    page = re.search(rb"\nX-Page-Id: (-?\d+)", http)
                    d = head["Archive-date"].ljust(14, "0")
                    date = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"
                    digest = hashlib.sha256(payload).hexdigest()
                    ident = uuid.UUID(bytes=hashlib.sha256(f"{made} {number} {head['URL']} {date} {digest}".encode("utf-8", "surrogatepass")).digest()[:16], version=5)
                    rows.append((int(page[1]) if page else None, kind, re.sub(r"\s", lambda m: f"%{ord(m[0]):02X}", head["URL"]), head["IP-address"], date, mime, http, payload, len(payload), digest, f"<urn:uuid:{ident}>"))
                out = pd.DataFrame(rows, columns=[c.split()[0] for c in RECORD.split(", ")])
                # from the rows: with nulls pandas has made floats of them
                out["page_id"] = pd.array([r[0] for r in rows], dtype="Int64")
                yield out

    return mapped(archives.select("archive"), read, RECORD)


def to_warc(records: DataFrame, least: int = 100) -> DataFrame:
    """Column `record`: WARC records. Of responses of equal payloads of `least` bytes or more that of the smallest page_id stays one.

    Headers and payloads are put together as strings of bytes, which Spark neither checks nor changes.
    """
    key = F.struct(F.col("page_id").isNull().alias("unnamed"), "page_id", "record_id", "url")
    large = (F.col("payload_bytes") >= least) & (F.col("kind") == "response")
    firsts = records.where(large).groupBy("payload_digest").agg(F.min(key).alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("payload_digest").alias("same"), "first")
    joined = records.join(firsts, (F.col("payload_digest") == F.col("same")) & large, "left")
    revisit = F.coalesce(F.col("first.record_id") != F.col("record_id"), F.lit(False))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))
    http = F.col("http").cast("string")
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload").cast("string")))
    size = F.octet_length("http") + F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    extra = F.when(revisit, F.concat(line("WARC-Refers-To", F.col("first.record_id")), line("WARC-Refers-To-Target-URI", F.col("first.url")), line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit(""))
    about = F.when(F.col("kind") == "warcinfo", line("WARC-Filename", F.substring_index("url", "/", -1))).otherwise(F.concat(line("WARC-Target-URI", F.col("url")), line("WARC-IP-Address", F.col("ip"))))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(revisit, "revisit").otherwise(F.col("kind"))), line("WARC-Record-ID", F.col("record_id")), line("WARC-Date", F.col("date")), about,
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")), extra, line("Content-Type", F.when(F.col("kind") == "response", "application/http; msgtype=response").otherwise(F.col("mime"))), line("Content-Length", size), F.lit("\r\n"),
    )
    return joined.select(F.concat(head, block, F.lit("\r\n\r\n")).alias("record"))


def write_warc(records: DataFrame, path: str, per_file: int = 1000) -> None:
    """Writes the records as gzipped WARC files of `per_file` records at most; Spark's text writer adds the last line feed."""
    text = records.select(F.expr("substring(record, 1, char_length(record) - 1)").alias("value"))
    fast = text.write.option("lineSep", "\n").option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED")
    fast.option("maxRecordsPerFile", per_file).text(path)


def parse_warc(data: bytes):
    """(headers, block) of each record of a WARC file."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")
        if not lines[0].startswith("WARC/1."):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        head = dict(x.split(": ", 1) for x in lines[1:])
        size = int(head["Content-Length"])
        if data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"the length of {head['WARC-Record-ID']} is wrong")
        yield head, data[end + 4 : end + 4 + size]
        at = end + 8 + size


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, record_id, record_type, url, date, payload, payload_bytes, payload_digest, refers_to_id from WARC files."""

    def read(frames):
        for frame in frames:
            for content in frame["content"]:
                unzip, left, parts = None, bytes(content), []
                while left:  # an archive may have a gzip member for each record
                    unzip = zlib.decompressobj(31)
                    parts.append(unzip.decompress(left))
                    left = unzip.unused_data
                rows = []
                for head, block in parse_warc(b"".join(parts)):
                    kind = head["WARC-Type"]
                    http, payload = http_parts(block) if kind in ("response", "revisit") else (b"", block)
                    page, size = (re.search(rb"\n" + x + rb": (-?\d+)", http, re.I) for x in (b"X-Page-Id", b"Content-Length"))
                    digest = head.get("WARC-Payload-Digest", "")
                    if kind == "revisit":
                        payload, n = None, int(size[1]) if size else None
                    else:
                        found, n = hashlib.sha256(payload).hexdigest(), len(payload)
                        if digest.startswith("sha256:") and digest != f"sha256:{found}":
                            raise ValueError(f"the digest of {head['WARC-Record-ID']} is wrong")
                        digest = digest or f"sha256:{found}"
                    rows.append((int(page[1]) if page else None, head["WARC-Record-ID"], kind, head.get("WARC-Target-URI"), head["WARC-Date"], payload, n, digest.removeprefix("sha256:") or None, head.get("WARC-Refers-To")))
                columns = ["page_id", "record_id", "record_type", "url", "date", "payload", "payload_bytes", "payload_digest", "refers_to_id"]
                out = pd.DataFrame(rows, columns=columns)
                for name in ("page_id", "payload_bytes"):
                    out[name] = pd.array([r[columns.index(name)] for r in rows], dtype="Int64")
                yield out

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("content")
    return mapped(files, read, "page_id long, record_id string, record_type string, url string, date string, payload binary, payload_bytes long, payload_digest string, refers_to_id string")


def convert(pages: DataFrame, unnamed: bool = False) -> DataFrame:
    """Pages through ARC to WARC and back: page_id, payload_bytes, payload_digest, record_type, refers_to (a page_id)."""
    path = new_path(pages.sparkSession, "warc")
    # equal payloads are of equal size, so each class of sizes is converted by itself and its files are bounded
    size = F.coalesce(F.octet_length(F.col("html").cast("string")), F.lit(0))
    which = F.lit(len(FILES) - 1)
    for i in range(len(FILES) - 2, -1, -1):
        which = F.when(size < FILES[i][0], i).otherwise(which)
    for i in sorted(r[0] for r in pages.select(which.alias("i")).distinct().collect()) or [0]:
        write_warc(to_warc(arc_records(pages_to_arc(pages.where(which == i), unnamed=unnamed), info=True)), f"{path}/{i}", FILES[i][1])
    back = read_warc(pages.sparkSession, path).where("record_type in ('response', 'revisit')").select("page_id", "record_id", "record_type", "payload_bytes", "payload_digest", "refers_to_id")
    # only responses that are referred to take part: few, and one row each
    named = back.where("refers_to_id is not null").select(F.col("refers_to_id").alias("id")).distinct()
    responses = back.where("record_type = 'response'").select(F.col("record_id").alias("id"), F.col("page_id").alias("refers_to")).join(named, "id", "left_semi").dropDuplicates(["id"])
    return back.join(responses, F.col("refers_to_id") == F.col("id"), "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
