"""ZIP-packaged WARC archives: a writer, and a reader that range-reads records without extraction.

An archive is a ZIP file of stored members: `archive/data.warc.gz`, one gzip member a record, and
`indexes/index.cdxj`, one line a record with its place. The reader takes the end of the file, follows the ZIP64
locator if there is one, walks the central directory, finds where stored members begin, and reads the index; records
are then fetched by byte range, neighbours in one request. Without an index the member is walked record by record.
Files are reached through Arrow's file systems by URI, so any store that Arrow knows will do.

Of records with equal payloads of at least `revisit_bytes` bytes, the one with the largest page_id is the response and the
others revisit it. The largest id is found by a pre-aggregated maximum per SHA-1 digest and joined back; the join is
a plain one, which adaptive execution splits where one payload holds a great part of the rows. A task writes its
archive under an attempt's name and moves it into place, so a task that runs again leaves one archive.

Archives of other writers are read too: any record type, record ids of any form (page_id is null where an id isn't a page's), payloads without a
SHA-1 digest, bare resources, classic and JSON indexes, plain or compressed, and members without one.

Cases: a null page is an empty payload. A very long page is one record, read in one range. A null url is written as `urn:none`. Rows that repeat page_id and payload are
all responses. A null page_id is less than all others; a group of null ids alone is all responses. An
empty table gives archives without records or none. Other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import struct
import zipfile
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import column, new_path, partitions, stage, table

WARC, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
DATE = "2024-01-01T00:00:00Z"
RANGE_BYTES = 4 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PAGE = "urn:x-page:"


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


# ---- records ------------------------------------------------------------------------------------------------------------


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None = None, revisit: bool = False) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = re.sub(r"[\s\x00-\x1f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "urn:none")
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{_PAGE}{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{_PAGE}{'' if refers_to is None else refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(raw: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in raw.decode("utf-8", "replace").split("\r\n")[1:])}


def _plain(value: str | None) -> str | None:
    return value.strip("<> ") if value is not None else None


def _page(identity: str | None) -> int | None:
    """The page that a record id of this writer names."""
    number = (identity or "").removeprefix(_PAGE)
    return int(number) if (identity or "").startswith(_PAGE) and number else None


def parse(raw: bytes) -> dict:
    """One record's type, ids, url, payload (None for revisits), its bytes and digest; SHA-1 digests of payloads are verified."""
    end = raw.index(b"\r\n\r\n")
    head = _headers(raw[:end])
    block = raw[end + 4 : end + 4 + int(head["content-length"])]
    kind, identity, original = head.get("warc-type", "").lower(), _plain(head.get("warc-record-id")), _plain(head.get("warc-refers-to"))
    if block[:5] == b"HTTP/":
        cut = block.find(b"\r\n\r\n")
        http, payload = (_headers(block[:cut]), block[cut + 4 :]) if cut >= 0 else (_headers(block), b"")
    else:
        http, payload = {}, block
    label, _, digest = head.get("warc-payload-digest", "").partition(":")
    if kind == "revisit":
        size, payload = http.get("content-length", ""), None
        size = int(size) if size.isdigit() else None
    else:
        size, own = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if kind == "response" and label.lower() == "sha1" and digest.upper() not in (own, base64.b32decode(own).hex().upper()):
            raise ValueError(f"payload of {identity} differs from its digest")
        label, digest = "sha1", own
    return {
        "page_id": _page(identity), "url": _plain(head.get("warc-target-uri")), "payload": payload, "payload_bytes": size, "payload_digest": digest.upper() if label.lower() == "sha1" else None,
        "record_type": kind, "refers_to": _page(original) if kind == "revisit" else None, "record_id": identity, "refers_to_record": original,
    }


# ---- ZIP directory ------------------------------------------------------------------------------------------------------


def directory(f) -> dict[str, tuple[int, int]]:
    """Stored members of an open file: name -> (where the data begins, length). Reads the file's end, its directories and the members' local headers only."""
    size = f.size()
    tail_at = max(0, size - 65557 - 20)
    tail = f.read_at(size - tail_at, tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of a central directory")
    count, length, at = struct.unpack_from("<HII", tail, end + 10)
    locator = end - 20
    if locator >= 0 and tail[locator : locator + 4] == b"PK\x06\x07":
        where = struct.unpack_from("<Q", tail, locator + 8)[0]
        record64 = f.read_at(56, where)
        if record64[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of a central directory where its locator points")
        count, length, at = struct.unpack_from("<QQQ", record64, 32)
    raw, p, out = f.read_at(length, at), 0, {}
    for _ in range(count):
        if raw[p : p + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, = struct.unpack_from("<H", raw, p + 10)
        packed, plain, n, m, k = struct.unpack_from("<IIHHH", raw, p + 20)
        local, = struct.unpack_from("<I", raw, p + 42)
        name = raw[p + 46 : p + 46 + n].decode("utf-8")
        extra, q = raw[p + 46 + n : p + 46 + n + m], 0
        while q + 4 <= len(extra):
            kind, own = struct.unpack_from("<HH", extra, q)
            if kind == 1:
                values = list(struct.unpack_from(f"<{own // 8}Q", extra, q + 4))
                plain = values.pop(0) if plain == 0xFFFFFFFF else plain
                packed = values.pop(0) if packed == 0xFFFFFFFF else packed
                local = values.pop(0) if local == 0xFFFFFFFF else local
            q += 4 + own
        p += 46 + n + m + k
        if method:
            continue  # a compressed member has no ranges to read
        a, b = struct.unpack_from("<HH", f.read_at(30, local), 26)
        out[name] = (local + 30 + a + b, packed)
    return out


def walk(f, at: int, length: int, gzipped: bool):
    """(offset, length) of every record of a member, by reading it through."""
    end, p, keep = at + length, at, b""
    base = at  # of keep[0]
    while base < end:
        used = None
        if gzipped:
            d = zlib.decompressobj(31)
            d.decompress(keep)
            done = d.eof
            while not done and p < end:
                more = f.read_at(min(1 << 20, end - p), p)
                p += len(more)
                keep += more
                d.decompress(more)
                done = d.eof
            if not done:
                raise ValueError("a record ends with its member")
            used = len(keep) - len(d.unused_data)
        else:
            while (cut := keep.find(b"\r\n\r\n")) < 0 and p < end:
                more = f.read_at(min(1 << 16, end - p), p)
                p += len(more)
                keep += more
            used = cut + 4 + int(_headers(keep[:cut])["content-length"]) + 4
            while len(keep) < used:
                more = f.read_at(used - len(keep), p)
                p += len(more)
                keep += more
        yield base, used
        base, keep = base + used, keep[used:]


def _index_entries(lines: str):
    """(file name, offset, length) of every line of a JSON or a classic index; its first line tells a classic one's columns."""
    columns = "N b a m s k r M S V g".split()
    for line in lines.splitlines():
        fields = line.split()
        if not fields or line.startswith("!"):
            continue
        if fields[0] == "CDX":
            columns = fields[1:]
        elif (cut := line.find("{")) >= 0:
            entry = json.loads(line[cut:])
            yield entry["filename"], int(entry["offset"]), int(entry["length"]) if "length" in entry else None
        else:
            entry = dict(zip(columns, fields, strict=False))
            yield entry["g"], int(entry["V"]), int(entry["S"]) if entry.get("S", "-").isdigit() else None


def locate(f) -> list[tuple[int, int]]:
    """(offset, length) of every record of an archive, from its indexes where there are any that give lengths."""
    members, found = directory(f), {}
    for name, (at, length) in members.items():
        if name.startswith("indexes/") and name.removesuffix(".gz").endswith((".cdxj", ".cdx")):
            raw = f.read_at(length, at)
            for member, offset, own in _index_entries((gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw).decode()):
                found.setdefault(f"archive/{member.rpartition('/')[2]}", set()).add((offset, own))
    out = []
    for name, (at, length) in members.items():
        if name.startswith("archive/"):
            own = found.get(name)
            if own and all(n is not None for _, n in own):
                out += [(at + offset, n) for offset, n in own]
            else:
                out += walk(f, at, length, name.endswith(".gz"))
    return sorted(out)


class _Stream:
    """An output stream that only goes on."""

    def __init__(self, f):
        self.f, self.write, self.flush = f, f.write, lambda: None


# ---- operators ----------------------------------------------------------------------------------------------------------


def with_originals(pages: DataFrame, page_id: str, url: str, page: str, revisit_bytes: int) -> DataFrame:
    rows = pages.select(column(page_id).cast("long").alias("page_id"), column(url).cast("string").alias("url"), F.encode(F.coalesce(column(page).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    largest = rows.groupBy("digest").agg(F.max("page_id").alias("original"))
    out = rows.join(largest, "digest")
    revisit = (F.length("payload") >= revisit_bytes) & F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    return out.withColumn("revisit", revisit)


def write(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", page: str = "html", revisit_bytes: int = 0) -> DataFrame:
    """Writes one archive per task under path; returns the written manifest (archive, records)."""

    def pack(batches):
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}.zip"
        store, folder = _store(path)
        own = f"{folder}/.{name}.{task.taskAttemptId()}"
        store.create_dir(folder, recursive=True)
        count, at, index = 0, 0, io.StringIO()
        with store.open_output_stream(own) as sink:
            with zipfile.ZipFile(_Stream(sink), "w", zipfile.ZIP_STORED, allowZip64=True) as z:
                with z.open(WARC, "w", force_zip64=True) as member:
                    for batch in batches:
                        for digest, i, u, payload, original, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                            name32 = base64.b32encode(digest).decode()
                            c = zlib.compressobj(1, zlib.DEFLATED, 31)
                            raw = c.compress(record(i, u, payload, name32, original, revisit)) + c.flush()
                            member.write(raw)
                            index.write(f"{'' if i is None else i} {DATE} " + json.dumps({"filename": WARC.split("/")[1], "offset": at, "length": len(raw), "digest": name32}) + "\n")
                            at += len(raw)
                            count += 1
                with z.open(INDEX, "w", force_zip64=True) as member:
                    member.write(index.getvalue().encode())
        store.move(own, f"{folder}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([f"{path}/{name}"]), pa.array([count], pa.int64())], names=["archive", "records"])

    rows = with_originals(pages, page_id, url, page, revisit_bytes).select("digest", "page_id", "url", "payload", "original", "revisit")
    return stage(pages.sparkSession, rows.mapInArrow(pack, "archive string, records long"), "archives")


def ranges(archives: DataFrame, archive: str = "archive") -> DataFrame:
    """(archive, offset, lengths): neighbouring records up to RANGE_BYTES together."""

    def find(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                store, name = _store(uri)
                with store.open_input_file(name) as f:
                    found = locate(f)
                offsets, lengths, own = [], [], []
                for k, (at, n) in enumerate(found):
                    if own and (at != sum_end or sum(own) + n > RANGE_BYTES):  # noqa: F821
                        lengths.append(own)
                        own = []
                    if not own:
                        offsets.append(at)
                    own.append(n)
                    sum_end = at + n
                if own:
                    lengths.append(own)
                yield pa.RecordBatch.from_arrays([pa.array([uri] * len(offsets), pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.list_(pa.int64()))], names=["archive", "offset", "lengths"])

    return archives.select(archive).mapInArrow(find, "archive string, offset long, lengths array<long>")


def read(archives: DataFrame, archive: str = "archive", payloads: bool = False) -> DataFrame:
    """Every record of the archives: page_id, payload_bytes, payload_digest, record_type, refers_to, and url, the records' ids and payload if asked for."""
    fields = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    fields += [("url", pa.string()), ("record_id", pa.string()), ("refers_to_record", pa.string()), ("payload", pa.binary())] * payloads

    def fetch(batches):
        for batch in batches:
            for uri, at, lengths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, name = _store(uri)
                with store.open_input_file(name) as f:
                    raw, p, rows = f.read_at(sum(lengths), at), 0, []
                for n in lengths:
                    own = raw[p : p + n]
                    p += n
                    rows.append(parse(zlib.decompress(own, 31) if own[:2] == b"\x1f\x8b" else own))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in fields], names=[k for k, _ in fields])

    spread = ranges(archives, archive).repartition(partitions(archives.sparkSession))
    kinds = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    return spread.mapInArrow(fetch, ", ".join(f"{k} {kinds[t]}" for k, t in fields))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(write(table(spark, sf_dir, "pages"), new_path(spark, "warc")))


SQL = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
w AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS original FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(5 * (3 - i % 4) AS BIGINT)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = original THEN NULL ELSE original END AS refers_to
FROM w
"""
