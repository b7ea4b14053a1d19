"""WARC archives: written by Spark's own text writer, read back by a reader that salvages what damage leaves.

A record's payload is stored once: later records of an equal payload are revisits that name it by digest. Each record is a gzip member of its own; the writer's line
separator is an empty gzip member, so files are plain concatenations of members that any gzip or WARC reader takes, and they go to any store Spark can write. The text writer
and cast("string") take bytes as they are: neither checks that they are UTF-8, which the round trip of the tests relies on and would show. Files are closed by bytes.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import settle, stash
from .components import sized

_EMPTY_MEMBER = gzip.compress(b"", mtime=0)
_CUT = "gzip: the member doesn't end"
_VERSION = re.compile(rb"WARC/[0-9]+\.[0-9]+\r\n")
RECORD = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("kind", T.StringType()),  # record, or gap: quarantined bytes
        T.StructField("length", T.LongType()),  # bytes in the file
        T.StructField("reason", T.StringType()),  # of a gap
        T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
        T.StructField("payload", T.BinaryType()),  # the body of an HTTP response, else the whole block
        T.StructField("payload_bytes", T.LongType()),  # both worked out from the payload read, not from headers
        T.StructField("payload_digest", T.StringType()),
    ]
)
#: A file is closed once it has so many bytes.
FILE_BYTES = 256 << 20


def classify(pages: DataFrame, *, page_id: str = "page_id", html: str = "html", url: str | None = None, least: int = 0) -> DataFrame:
    """page_id, url, payload (UTF-8; null html is empty), payload_bytes, payload_sha1 (20 bytes), record_type, refers_to, and the key that tells a page's records apart
    with that of the record referred to (key, refers_key).

    Of pages with equal payloads of at least least bytes the one of the smallest page_id is a response, the others are revisits of it;
    a null page_id comes last, and pages of the same smallest id are all responses. Smaller payloads are all responses. Rows equal in id, url and payload give equal records.
    """
    payload = F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{page_id}`").alias("page_id"), (F.col(f"`{url}`").cast("string") if url else F.lit(None).cast("string")).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_sha1": F.unhex(F.sha1("payload"))})
    rows = rows.withColumn("key", F.lower(F.hex(F.xxhash64(F.coalesce("url", F.lit("")), "payload_sha1"))))
    # only digests are grouped, with partial sums before the exchange; a digest of its own needs no partner. As a table of its own the
    # rest is broadcast if it is small, and otherwise joined so that a common digest can be split.
    first = F.min(F.struct(F.isnull("page_id"), "page_id", "key"))
    groups = stash(rows.groupBy("payload_sha1").agg(first.alias("f"), F.count("*").alias("n")).where("n > 1").select("payload_sha1", F.col("f.page_id").alias("first"), F.col("f.key").alias("first_key")), "copies")
    joined = rows.join(groups, "payload_sha1", "left")
    again = (F.col("payload_bytes") >= least) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select(
        "page_id", "url", "payload", "payload_bytes", "payload_sha1", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"), "key", F.when(again, F.col("first_key")).alias("refers_key")
    )


def record_bytes(headers: list[tuple[str, str]], block: bytes, compress: bool = True) -> bytes:
    """One record as written: version line, headers, block, two line ends; a gzip member if compressed."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))]) + "\r\n"
    record = head.encode() + block + b"\r\n\r\n"
    return gzip.compress(record, 6, mtime=0) if compress else record


def write_warc(classified: DataFrame, path: str, *, date: str = "1970-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> None:
    """Writes classify()'s rows as gzipped WARC files under path, in folders part=n: a task begins a new file once one has file_bytes. A response is an HTTP response
    whose body is the payload; its target is the url, or urn:page: and the id."""
    settle(classified.sparkSession)
    src = classified.select(F.col("page_id").cast("string"), F.when(F.col("record_type") == "response", F.col("payload")).alias("payload"), "payload_bytes", "payload_sha1", "record_type", F.col("refers_to").cast("string"), "url", "key", "refers_key")
    name = lambda page, key: f"<urn:page:{quote(page, safe='') if page is not None else ''}:{key}>"

    def encode(batches):
        part, held = 0, 0
        for b in batches:
            out, parts = [], []
            for page, payload, n, sha, kind, refers, url, key, refers_key in zip(*(c.to_pylist() for c in b.columns), strict=True):
                uri = "".join(c for c in url or "" if c > " ") or f"urn:page:{quote(page or '', safe='')}"
                headers = [("WARC-Type", kind), ("WARC-Record-ID", name(page, key)), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{base64.b32encode(sha).decode()}")]
                if kind == "revisit":
                    headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", name(refers, refers_key))]
                    block = b""
                else:
                    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n + payload
                    headers += [("Content-Type", "application/http; msgtype=response"), ("WARC-Block-Digest", f"sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}")]
                out.append(record_bytes(headers, block))
                parts.append(part)
                held += len(out[-1]) + len(_EMPTY_MEMBER)
                if held >= file_bytes:
                    part, held = part + 1, 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(parts, pa.int32())], names=["member", "part"])

    members = src.mapInArrow(encode, "member binary, part int").select(F.col("member").cast("string"), "part")
    members.write.partitionBy("part").option("lineSep", _EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)


def body(headers: dict[str, str], block: bytes) -> bytes:
    """What an HTTP response carries; of other blocks the whole."""
    if headers.get("content-type", "").startswith("application/http") and (at := block.find(b"\r\n\r\n")) >= 0:
        return block[at + 4 :]
    return block


class Marks:
    """Where marks stand in data. A place once found is kept until the search has passed it, so looking for marks is linear in all."""

    def __init__(self, data: bytes):
        self.data, self.at = data, {}

    def next(self, mark: bytes, begin: int) -> int:
        """The mark's first place at begin or after it, or -1. begin must not go back."""
        at = self.at.get(mark, 0)
        if at is not None and at <= begin:
            found = self.data.find(mark, begin)
            at = self.at[mark] = found if found >= 0 else None
        return -1 if at is None else at


def _parse(data: bytes, at: int, marks: Marks) -> tuple[dict[str, str], bytes, int] | str:
    """Headers, block and length of the record that begins at a place of data, or what is wrong."""
    if not (m := _VERSION.match(data, at)):
        return "no version line"
    if (stop := marks.next(b"\r\n\r\n", m.end() - 2)) < 0:
        return "headers don't end"
    if (again := marks.next(b"\r\nWARC/", m.end() - 2)) >= 0 and again < stop:
        return "another version line before the headers end"
    headers = {}
    for line in data[m.end() : stop].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return "a header without a colon"
        headers[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not re.fullmatch(r"[0-9]{1,18}", n := headers.get("content-length", "")):
        return "no content length"
    begin, end = stop + 4, stop + 4 + int(n)
    if data[end : end + 4] != b"\r\n\r\n":
        return "the length doesn't fit"
    block = data[begin:end]
    if (want := headers.get("warc-block-digest", "")).startswith("sha1:") and base64.b32encode(hashlib.sha1(block).digest()).decode() != want[5:]:
        return "the digest doesn't fit"
    return headers, block, end + 4 - at


def _inflate(data: bytes, at: int) -> tuple[bytes, int, str | None]:
    """What the member at a place of data inflates to, where it ends, and None; of a damaged one all that comes out before the damage shows, and what is wrong."""
    z, out, k, step = zlib.decompressobj(31), [], at, 1 << 16
    view = memoryview(data)
    while k < len(data):
        try:
            out.append(z.decompress(view[k : k + step]))
        except zlib.error as e:
            if step == 1:
                return b"".join(out), k, f"gzip: {e}"
            # the failed call kept what it had inflated: this piece once more, byte by byte
            z = zlib.decompressobj(31)
            for p in range(at, k, step):
                z.decompress(view[p : p + step])
            step = 1
            continue
        k = min(k + step, len(data))
        if z.eof:
            return b"".join(out), k - len(z.unused_data), None
    return b"".join(out), len(data), _CUT


def _reach(data: bytes, at: int, n: int) -> int:
    """Where the bytes end that the first n (2 at least) inflated bytes of the member at a place of data come from."""
    z, view, left = zlib.decompressobj(31), memoryview(data), n - 1
    while left:
        piece = view[at : at + (1 << 16)]
        left -= len(z.decompress(piece, left))
        at += len(piece) - len(z.unconsumed_tail)
    # the last one by single bytes, since a call that reads on can meet the damage
    if z.decompress(b"", 1):
        return at
    while not z.decompress(view[at : at + 1], 1):
        at += 1
    return at + 1


def _proven(row: tuple) -> bool:
    return row[1] == "gap" or row[4].get("warc-block-digest", "").startswith("sha1:")


def salvage(data: bytes, inside: int = 0) -> Iterator[tuple[int, str, int, str | None, dict | None, bytes | None]]:
    """All intact records of an archive (gzip members or plain, even mixed) as (offset, "record", length, None, headers, block), and each run of
    bytes that no intact record has as (offset, "gap", length, reason, None, None), in order. After a failed check the search goes on one byte
    farther, at the next member's magic or version line, so damage costs no record that is whole itself.

    What a member inflates to is searched in the same way (inside: how many members deep, two at most), up to where damage shows. Its records, and gaps between
    them, have the offset and length of the member, of a damaged one up to its last intact record. If a damaged member shows no bad
    record, any of it may be changed: its records without a digest are no intact ones."""
    at, gap, reason, marks = 0, None, None, Marks(data)
    while at < len(data):
        rows, after = [], at + 1
        if inside < 2 and data.startswith(b"\x1f\x8b", at):
            member, end, why = _inflate(data, at)
            rows = list(salvage(member, inside + 1))
            if why and why != _CUT and all(r[1] == "record" for r in rows):
                rows = [r if _proven(r) else (r[0], "gap", r[2], "no digest in a damaged member", None, None) for r in rows]
            last = max((r[0] + r[2] for r in rows if r[1] == "record"), default=0)
            if last or not (member or why):
                end = _reach(data, at, last) if why else end
                rows = [r for r in rows if not why or r[0] < last]
                found = True
            else:
                found, why = False, why or rows[0][3]
        else:
            one = _parse(data, at, marks) if _VERSION.match(data, at) else "no record begins here"
            found, why = (False, one) if isinstance(one, str) else (True, None)
            if found:
                rows, end = [(0, "record", one[2], None, one[0], one[1])], at + one[2]
        if found:
            if gap is not None and gap < at:
                yield gap, "gap", at - gap, reason, None, None
            for begin, kind, n, bad, headers, block in rows:
                yield at, kind, end - at, bad and f"{bad}, {n} inflated bytes from {begin}", headers, block
            at, gap = end, None
            if not why:
                continue
            after = end
        if gap is None:
            gap, reason = at, why
        nexts = [p for p in (marks.next(b"\x1f\x8b\x08", after), marks.next(b"WARC/", after)) if p >= 0]
        at = min(nexts, default=len(data))
    if gap is not None and gap < len(data):
        yield gap, "gap", len(data) - gap, reason, None, None


def read_warc(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Every intact record and every quarantined gap of the archives under path and its folders (see RECORD). A file is one task's work; the files of write_warc have FILE_BYTES and one
    record at most. A foreign file over 2 GB, Spark's bound on a cell, is an error and not passed over. An empty folder gives no rows."""
    settle(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "content")

    def read(batches):
        schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("kind", pa.string()), ("length", pa.int64()), ("reason", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows, held = [], 0
                for offset, kind, n, reason, headers, block in salvage(content.as_py()):
                    payload = body(headers, block) if headers is not None else None
                    of_payload = (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()) if payload is not None else (None, None)
                    rows.append((name, offset, kind, n, reason, list(headers.items()) if headers is not None else None, payload, *of_payload))
                    held += len(block or b"")
                    if held > 4 << 20 or len(rows) >= 1024:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    return files.mapInArrow(read, RECORD)


def gaps(archive: DataFrame) -> DataFrame:
    """The quarantine log: file, offset, length, reason."""
    return archive.where("kind = 'gap'").select("file", "offset", "length", "reason")


def quarantine(archive: DataFrame, path: str) -> int:
    """Writes the quarantine log to path and returns how many gaps it has; without any, nothing is written."""
    found = gaps(archive)
    n = found.count()
    if n:
        found.write.parquet(path)
    return n


def catalogue(archive: DataFrame) -> DataFrame:
    """page_id (text), payload_bytes, payload_digest, record_type and refers_to (text) of every record of write_warc's. Size and digest are those of payloads read; a
    revisit has those of a response with the digest that it names, or none if no such response was read."""
    page = lambda name: F.nullif(F.url_decode(F.regexp_extract(F.col("headers")[name], "^<urn:page:([^:>]*):", 1)), F.lit(""))
    header = lambda name: F.col("headers")[name]
    records = archive.where("kind = 'record'").select(
        page("warc-record-id").alias("page_id"), "payload_bytes", "payload_digest", header("warc-type").alias("record_type"), page("warc-refers-to").alias("refers_to"), F.regexp_replace(header("warc-payload-digest"), "^sha1:", "").alias("named")
    )
    again, others = records.where("record_type = 'revisit'"), records.where("record_type <> 'revisit' OR record_type IS NULL")
    wanted = stash(again.select(F.col("named").alias("payload_digest")).distinct(), "named")
    known = stash(others.join(sized(wanted), "payload_digest", "left_semi").groupBy("payload_digest").agg(F.max("payload_bytes").alias("payload_bytes")), "originals")
    again = again.drop("payload_bytes", "payload_digest").join(sized(known.withColumnRenamed("payload_digest", "__digest")), F.col("named") == F.col("__digest"), "left").withColumn("payload_digest", F.col("__digest"))
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return others.select(cols).unionByName(again.select(cols))


def resolve(archive: DataFrame) -> DataFrame:
    """Records with payloads filled in: a revisit gets that of the response it refers to (null if that one was lost)."""
    records = archive.where("kind = 'record'").select(F.col("headers")["warc-record-id"].alias("record_id"), F.col("headers")["warc-type"].alias("record_type"), F.col("headers")["warc-refers-to"].alias("refers_to"), "payload")
    responses = records.where("record_type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("payload").alias("__original")).dropDuplicates(["refers_to"])
    return records.join(responses, "refers_to", "left").select("record_id", "record_type", "refers_to", F.when(F.col("record_type") == "revisit", F.col("__original")).otherwise(F.col("payload")).alias("payload"))
