"""Legacy archives: pages written as ARC files, converted into WARC files, and read back.

The converter parses the version block of each ARC file (version 1: URL, address, date, type, length; version 2 adds
result code, checksum, location, offset and filename), reads each document by its declared length and synthesises the
WARC fields: an identifier from file and offset, a WARC-Date from the date, the record type, block and payload digests.
A version block becomes a warcinfo record, to which the records of its file refer; a document that begins with an HTTP
head becomes a response, any other (dns, ftp, bare bodies) a resource of its declared type, whose payload is the whole
block. Of equal payloads one record stays whole, that of the largest page id; the others become revisits of it, with
their HTTP head as block, or an empty one.

Archives are whole-file gzip text parts that Spark writes and lists, so any store that Spark reaches will do. A task
holds one compressed file of its input split's size and decompresses it as a stream. Two rounds of parsing spare a
copy of the payloads: the first yields digests only, and the decision about a record is joined by (file, offset).

A compressed file is one value, so one beyond spark.sql.sources.binaryFile.maxLength (2 GiB) is an error, not a loss;
write_arc's files are as large as the partitions of its pages.

Defined results: a null html is an empty payload; a null url becomes `about:blank`; null page ids are ordered first
(they are responses only where a payload has no other); repeated rows stay records of their own; an empty table gives
no archives and no rows; other columns aren't read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsmill.llm.common import shared_dir, stage

V1 = "URL IP-address Archive-date Content-type Archive-length"
V2 = "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
HOME = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
#: Bytes that a batch of parsed records holds before it is handed on.
BATCH = 4 << 20


def digest(data: bytes) -> str:
    """Upper-case base32 SHA-1, as archives name payloads."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def write_arc(pages: DataFrame, at: str) -> None:
    """One ARC file for each partition of pages; every other file is of version 2."""
    rows = pages.select("page_id", F.coalesce("url", F.lit("about:blank")).alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("html"), F.spark_partition_id().alias("part"))

    def records(batches):
        started = False
        for batch in batches:
            out = []
            for page, url, html, part in (x for i in range(0, batch.num_rows, 256) for x in zip(*(c.to_pylist() for c in batch.slice(i, 256).columns), strict=True)):
                v2 = part % 2 == 1
                if not started:
                    body = (f"{2 if v2 else 1} 0 newsmill\n" + (V2 if v2 else V1) + "\n").encode()
                    out.append(f"filedesc://pages-{part:05d}.arc 0.0.0.0 20240101000000 text/plain ".encode() + (f"200 - - 0 pages-{part:05d}.arc ".encode() if v2 else b"") + f"{len(body)}\n".encode() + body)
                    started = True
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n" + ("" if page is None else f"X-Page-Id: {page}\r\n") + "\r\n"
                block = head.encode() + html
                day = f"202401{1 + (page or 0) // 86400 % 28:02d}{(page or 0) // 3600 % 24:02d}{(page or 0) // 60 % 60:02d}{(page or 0) % 60:02d}"
                fields = [re.sub(r"\s", "%20", url) or "about:blank", "0.0.0.0", day, "text/html"]
                if v2:
                    fields += ["200", digest(html), "-", "0", f"pages-{part:05d}.arc"]
                out.append(" ".join([*fields, str(len(block))]).encode() + b"\n" + block)
                if sum(map(len, out[-64:])) >= BATCH or len(out) >= 512:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                    out = []
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    text = rows.mapInArrow(records, "record binary").select(F.col("record").cast("string"))
    text.write.option("compression", "gzip").option("lineSep", "\n").text(at)


class _Stream:
    """Lines and stretches of a gzip file, whole or in members, without the whole being in memory."""

    def __init__(self, data: bytes):
        self.data, self.at, self.gone = memoryview(data), 0, 0
        self.buf, self.pos = b"", 0  # what is unpacked, and how far it has been taken
        self.z = zlib.decompressobj(31)

    def _more(self) -> bool:
        while self.at < len(self.data) or self.z.unconsumed_tail or self.z.unused_data:
            if self.z.eof:
                self.at -= len(self.z.unused_data)
                self.z = zlib.decompressobj(31)
            piece = self.z.unconsumed_tail or self.data[self.at : self.at + 65536]
            if not self.z.unconsumed_tail:
                self.at += len(piece)
            got = self.z.decompress(piece, 1 << 20)
            if got:
                self.buf, self.pos = self.buf[self.pos :] + got, 0
                return True
        return False

    def take(self, n: int) -> bytes:
        if len(self.buf) - self.pos < n:  # beyond what is unpacked: pieces are joined once
            parts, have = [self.buf[self.pos :]], len(self.buf) - self.pos
            self.buf, self.pos = b"", 0
            while have < n and self._more():
                parts.append(self.buf)
                have += len(self.buf)
                self.buf = b""
            self.buf = b"".join(parts)
        data = self.buf[self.pos : self.pos + n]
        self.pos += len(data)
        self.gone += len(data)
        return data

    def line(self) -> bytes | None:
        while (i := self.buf.find(b"\n", self.pos)) < 0:
            if not self._more():
                return self.take(len(self.buf) - self.pos) or None
        return self.take(i + 1 - self.pos)


def arc_entries(data: bytes):
    """(kind, offset, url, address, date, type, block) of all records of an ARC file, the version block (warcinfo) first.

    Fields go by the names that the version block declares. Only a file's first record is that block; a document may have
    any url, filedesc: ones included.
    """
    s, names = _Stream(data), None
    while True:
        at, line = s.gone, s.line()
        if line is None:
            return
        if not line.strip():
            continue
        fields = line.decode("utf-8", "replace").rstrip("\r\n").split(" ")
        if names is None:
            if not fields[0].startswith("filedesc://"):
                raise ValueError(f"no version block at the start of an ARC file: {line[:60]!r}")
            block = s.take(int(fields[-1]))
            body = block.decode("utf-8", "replace").replace("\r\n", "\n").split("\n")
            names = body[1].split(" ")
            if body[0].split(" ")[0] not in ("1", "2"):
                raise ValueError(f"ARC version {body[0]!r}")
            yield "warcinfo", at, fields[0], fields[1], fields[2], fields[3], block
            continue
        # a URL may hold blanks in old files: the fixed fields are counted from the end
        rest = len(names) - 1
        got = dict(zip(names, [" ".join(fields[:-rest]), *fields[-rest:]], strict=True))
        block = s.take(int(got["Archive-length"]))
        yield "response" if _split(block)[1] else "resource", at, got["URL"], got["IP-address"], got["Archive-date"], got["Content-type"], block


def arc_records(data: bytes):
    """(offset, url, address, date, block) of an ARC file's documents."""
    return ((at, url, address, date, block) for kind, at, url, address, date, _, block in arc_entries(data) if kind != "warcinfo")


def _split(block: bytes) -> tuple[dict, bytes, bytes]:
    """HTTP fields, head and payload of a block; no head where it doesn't begin with one that ends."""
    end = re.search(rb"\r?\n\r?\n", block) if block.startswith(b"HTTP/") else None
    if not end:
        return {}, b"", block
    head = block[: end.end()]
    pairs = (x.split(":", 1) for x in head.decode("latin-1").splitlines()[1:] if ":" in x)
    return {k.lower(): v.strip() for k, v in pairs}, head, block[end.end() :]


def when(date: str) -> str:
    """A WARC-Date of an ARC date of 14 digits, or of the fewer that old files have (what is missing is its least value)."""
    d = re.sub("[^0-9]", "", date)
    d = d + "19700101000000"[len(d) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def _page(fields: dict) -> int | None:
    """The page id that write_arc put into a head."""
    page = fields.get("x-page-id", "")
    return int(page) if re.fullmatch("-?[0-9]{1,18}", page) else None


def _name(path: str) -> str:
    """A file's stable name: the number of its part, without the writer's random suffix."""
    return re.sub(r".*(part-\d+).*", r"\1", path)


def _in_batches(rows, kinds: pa.Schema, weight):
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weight(row)
        if size >= BATCH or len(held) >= 5000:
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], schema=kinds)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], schema=kinds)


INDEX = pa.schema([("file", pa.string()), ("at", pa.int64()), ("page_id", pa.int64()), ("digest", pa.string()), ("size", pa.int64())])
FULL = pa.schema([("file", pa.string()), ("at", pa.int64()), ("kind", pa.string()), ("url", pa.string()), ("address", pa.string()), ("date", pa.string()), ("type", pa.string()), ("block", pa.binary())])
BACK = pa.schema([("id", pa.string()), ("kind", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to_id", pa.string()), ("uri", pa.string()), ("date", pa.string()), ("type", pa.string())])


def _files(spark: SparkSession, at: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(at).select("path", "content")


def _parse(files: DataFrame, rows_of, kinds: pa.Schema, weight) -> DataFrame:
    ddl = ", ".join(f"{f.name} {'long' if f.type == pa.int64() else str(f.type)}" for f in kinds)

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                yield from _in_batches(rows_of(path.as_py(), content.as_py()), kinds, weight)

    return files.mapInArrow(run, ddl)


def _index_rows(path, content):
    for at, _, _, _, block in arc_records(content):
        fields, _, payload = _split(block)
        yield _name(path), at, _page(fields), digest(payload), len(payload)


def _full_rows(path, content):
    for kind, at, url, address, date, mime, block in arc_entries(content):
        yield _name(path), at, kind, url, address, date, mime, block


def _record_id(file: str, at: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(HOME, f'{file}:{at}')}>"


def _record(file, at, kind, url, address, date, mime, block, to_file, to_at) -> bytes:
    """A WARC record of an ARC record; a revisit where another record (to_file, to_at) holds its payload."""
    _, head, payload = _split(block) if kind == "response" else ({}, b"", block)
    if kind == "warcinfo":
        made = {"software": "newsmill", "format": "WARC File Format 1.1", "isPartOf": url, "description": f"converted from an ARC file of version {block[:1].decode('latin-1')}"}
        body, mime = "".join(f"{k}: {v}\r\n" for k, v in made.items()).encode(), "application/warc-fields"
        named = [("WARC-Filename", f"{file.rsplit('/', 1)[-1].removesuffix('.gz')}.warc.gz")]
    else:
        body = block if to_file is None else head
        mime = "application/http; msgtype=response" if head else mime
        named = [("WARC-Target-URI", url), ("WARC-IP-Address", "" if address in ("0.0.0.0", "-") else address), ("WARC-Warcinfo-ID", _record_id(file, 0))]
        if to_file is not None:
            named += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _record_id(to_file, to_at))]
        named += [("WARC-Payload-Digest", f"sha1:{digest(payload)}")]
    fields = [("WARC-Type", kind if to_file is None else "revisit"), ("WARC-Record-ID", _record_id(file, at)), ("WARC-Date", when(date)), *named]
    fields += [("WARC-Block-Digest", f"sha1:{digest(body)}"), ("Content-Type", mime if body or to_file is None else ""), ("Content-Length", str(len(body)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v) + "\r\n").encode() + body


def convert(spark: SparkSession, arc: str, to: str, least: int = 0) -> None:
    """ARC files into WARC files. Records of equal payloads of `least` bytes or more become one whole record and revisits."""
    index = stage(_parse(_files(spark, arc), _index_rows, INDEX, lambda r: 100), "arc-index")
    first = index.where(F.col("size") >= least).groupBy("digest").agg(F.max(F.struct("page_id", "file", "at")).alias("best"))
    decided = index.join(first, "digest").where((F.col("file") != F.col("best.file")) | (F.col("at") != F.col("best.at")))
    decided = decided.where(F.col("size") >= least).select("file", "at", F.col("best.file").alias("to_file"), F.col("best.at").alias("to_at"))
    full = _parse(_files(spark, arc), _full_rows, FULL, lambda r: len(r[-1]))
    rows = full.join(decided, ["file", "at"], "left").select("file", "at", "kind", "url", "address", "date", "type", "block", "to_file", "to_at")
    rows = rows.coalesce(max(1, index.select("file").distinct().count()))  # as many WARC files as there are ARC files at most

    def write(batches):
        for batch in batches:
            out = []
            for row in (x for i in range(0, batch.num_rows, 256) for x in zip(*(c.to_pylist() for c in batch.slice(i, 256).columns), strict=True)):
                out.append(_record(*row))
                if sum(map(len, out[-64:])) >= BATCH or len(out) >= 512:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                    out = []
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    text = rows.mapInArrow(write, "record binary").select(F.col("record").cast("string"))
    text.write.option("compression", "gzip").option("lineSep", "\r\n\r\n").text(to)


def warc_records(data: bytes):
    """(fields, block) of each record of a WARC file, by declared lengths."""
    s = _Stream(data)
    while (line := s.line()) is not None:
        if not line.strip():
            continue
        if not line.startswith(b"WARC/1."):
            raise ValueError(f"no WARC record at {s.gone}: {line[:60]!r}")
        fields = {}
        while (line := s.line()) is not None and line.strip():
            k, _, v = line.decode().partition(":")
            fields[k.strip().lower()] = v.strip()
        yield fields, s.take(int(fields["content-length"]))


def _back_rows(path, content):
    for fields, block in warc_records(content):
        kind, mime, named = fields["warc-type"], fields.get("content-type"), fields.get("warc-payload-digest", "").removeprefix("sha1:")
        http, _, payload = _split(block) if (mime or "").startswith("application/http") else ({}, b"", block)
        whole = kind in ("response", "resource")
        if fields["warc-block-digest"] != f"sha1:{digest(block)}" or whole and digest(payload) != named:
            raise ValueError(f"digest of {fields['warc-record-id']} in {path}")
        yield fields["warc-record-id"], kind, _page(http), len(payload) if whole else None, named or None, fields.get("warc-refers-to"), fields.get("warc-target-uri"), fields["warc-date"], mime


def read_warc(spark: SparkSession, at: str) -> DataFrame:
    """One row for each record: id, kind, page_id, payload_bytes, payload_digest, refers_to_id, uri, date, type.

    Digests are verified. Payloads of revisits stand in the records that they refer to, so theirs are resolved there; a
    revisit whose payload isn't in the archives, or has another digest, has no payload_bytes.
    """
    back = stage(_parse(_files(spark, at), _back_rows, BACK, lambda r: 300), "warc-index")
    held = back.where("kind IN ('response', 'resource')").select(F.col("id").alias("refers_to_id"), "payload_digest", F.col("payload_bytes").alias("held_bytes"))
    seen = back.where("kind = 'revisit'").join(held, ["refers_to_id", "payload_digest"], "left").withColumn("payload_bytes", F.col("held_bytes"))
    return back.where("kind <> 'revisit'").unionByName(seen.drop("held_bytes"))


def archive(pages: DataFrame, least: int = 0) -> DataFrame:
    """Pages through ARC and WARC files and back: a row for each page, revisits resolved to their response's page."""
    spark = pages.sparkSession
    at = f"{shared_dir(spark)}/archive-{uuid.uuid4().hex}"
    write_arc(pages, f"{at}/arc")
    convert(spark, f"{at}/arc", f"{at}/warc", least)
    back = stage(read_warc(spark, f"{at}/warc").where("kind <> 'warcinfo'"), "warc-pages")
    seen = back.where("kind = 'response'").select(F.col("id").alias("refers_to_id"), F.col("page_id").alias("refers_to"))
    rows = back.where("kind = 'response'").withColumn("refers_to", F.lit(None).cast("long")).unionByName(back.where("kind = 'revisit'").join(seen, "refers_to_id", "left"))
    return rows.select("page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), "refers_to")
