"""WARC archives: a writer, and a sequential reader that frames, decompresses and verifies record by record.

Archives are real .warc.gz files with one gzip member for each record, written by the tasks themselves through
pyarrow's file systems (file, hdfs, s3 and others by the path's scheme). Their names hold the task's attempt, and the
list of archives is a table that Spark commits: a task that runs again, perhaps with its rows in another order, writes
archives of its own, and those of attempts that were lost or beaten stand in no list. The reader holds one record's
block and a chunk of compressed bytes at a time. It takes records of any type and origin: header lines that go on in
the next line, HTTP messages without a length or in chunks, digests of other algorithms or none.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import new_path, small, stage

#: An archive ends with the record that reaches so many compressed bytes.
ARCHIVE_BYTES = 64 << 20
CHUNK = 1 << 16
#: Rows of a group of copies are dealt over so many partitions where the groups are too many to send to each task.
SALTS = 16
_DATE = "2024-01-01T00:00:00Z"
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode("ascii")


def _header_text(value: str) -> str:
    """A header's value: line ends, which no URL may hold, would break the framing and are percent-encoded."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(kind: str, key: str, uri: str, payload: bytes, refers_to: str | None) -> bytes:
    """One record. A revisit keeps the HTTP header, whose Content-Length tells the payload's size, without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode("ascii")
    block = http + payload if kind == "response" else http
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{key}>", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {_header_text(uri)}", f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {_REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode("utf-8") + block + b"\r\n\r\n"


def members(stream, chunk: int = CHUNK) -> Iterator["Member"]:
    """The gzip members of a stream, to be read one after the other."""
    rest = b""
    while True:
        rest = rest or stream.read(chunk)
        if not rest:
            return
        member = Member(stream, rest, chunk)
        yield member
        rest = member.finish()


class Member:
    """Decompresses one gzip member as far as it is asked to."""

    def __init__(self, stream, data: bytes, chunk: int):
        self._stream, self._chunk, self._inflate, self._data, self._out = stream, chunk, zlib.decompressobj(31), data, b""

    def _fill(self) -> bool:
        if self._inflate.eof:
            return False
        if not self._data:
            self._data = self._stream.read(self._chunk)
            if not self._data:
                raise ValueError("the archive ends within a gzip member")
        self._out += self._inflate.decompress(self._data, self._chunk)
        self._data = self._inflate.unconsumed_tail
        return True

    def line(self) -> bytes:
        """Up to and with the next line end."""
        while (at := self._out.find(b"\r\n")) < 0:
            if not self._fill():
                raise ValueError("a record's header has no end")
        out, self._out = self._out[: at + 2], self._out[at + 2 :]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        """Exactly n bytes, in pieces."""
        while n:
            if not self._out and not self._fill():
                raise ValueError("a record is shorter than its Content-Length")
            piece, self._out = self._out[:n], self._out[n:]
            n -= len(piece)
            if piece:
                yield piece

    def finish(self) -> bytes:
        """Check that nothing follows in the member; the stream's bytes after it."""
        while not self._out and self._fill():
            pass
        if self._out:
            raise ValueError("a record is longer than its Content-Length")
        return self._inflate.unused_data


def agrees(stated: str | None, data: bytes) -> bool:
    """Whether data has the digest stated as algorithm:value (base32 or hexadecimal; bare ones are SHA-1).

    Nothing stated, and an algorithm that isn't known, can't disagree.
    """
    algorithm, _, value = (stated or "").strip().rpartition(":")
    algorithm = algorithm.lower().replace("-", "") or "sha1"
    if not value or algorithm not in hashlib.algorithms_guaranteed or algorithm.startswith("shake"):
        return True
    raw = hashlib.new(algorithm, data).digest()
    return value.lower() == raw.hex() or value.upper().rstrip("=") == base64.b32encode(raw).decode("ascii").rstrip("=")


def fields(lines: list[str]) -> dict[str, str]:
    """Headers by lower-case names; a line that starts with white space goes on from the one before."""
    out: dict[str, str] = {}
    name = ""
    for line in lines:
        if line[:1] in (" ", "\t") and name:
            out[name] = f"{out[name]} {line.strip()}"
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def unchunked(body: bytes) -> bytes:
    """The content of a chunked HTTP body; a body that isn't whole chunks stays as it is."""
    pieces, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        try:
            n = int(body[at:end].partition(b";")[0], 16)
        except ValueError:
            return body
        if n == 0:
            return b"".join(pieces)
        if n < 0 or body[end + 2 + n : end + 4 + n] != b"\r\n":
            return body
        pieces.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n
    return body


def payload(headers: dict[str, str], block: bytes) -> tuple[bytes | None, int | None, bool]:
    """(payload, its full size, whether size and digest agree with the headers) of a record.

    Of an HTTP message the payload is its body, without the marks of chunks; of resource and conversion records it is
    the block; other records have none. A revisit's payload isn't there: its size is what the kept HTTP header
    states, if it does. A record marked as truncated may be shorter than stated and differ from its digest.
    """
    kind, stated = headers.get("warc-type", ""), headers.get("warc-payload-digest")
    if kind in ("resource", "conversion"):
        return block, len(block), "warc-truncated" in headers or agrees(stated, block)
    http = headers.get("content-type", "").lower().startswith("application/http")
    if kind not in ("response", "request", "revisit") or not http:
        return None, None, True
    head, _, body = block.partition(b"\r\n\r\n")
    told = fields(head.decode("utf-8", "replace").split("\r\n")[1:])
    length = told.get("content-length", "")
    size = int(length) if length.isascii() and length.isdigit() else None
    if kind == "revisit":
        return None, size, True
    raw, chunked = body, "chunked" in told.get("transfer-encoding", "").lower()
    if chunked:
        body = unchunked(body)
    whole = chunked or size is None or len(body) == size
    return body, len(body), "warc-truncated" in headers or (whole and (agrees(stated, body) or (chunked and agrees(stated, raw))))


def read_records(stream, chunk: int = CHUNK) -> Iterator[dict]:
    """Headers (lower-case names), block, and whether the digests agree, for each record in turn."""
    for member in members(stream, chunk):
        if not member.line().startswith(b"WARC/1."):
            raise ValueError("not a WARC record")
        lines = []
        while (line := member.line()) != b"\r\n":
            lines.append(line[:-2].decode("utf-8", "replace"))
        headers = fields(lines)
        if not headers.get("content-length", "").isdigit():
            raise ValueError("a record without Content-Length")
        block = b"".join(member.take(int(headers["content-length"])))
        if b"".join(member.take(4)) != b"\r\n\r\n":
            raise ValueError("a record doesn't end with two line ends")
        yield {"headers": headers, "block": block, "block_ok": agrees(headers.get("warc-block-digest"), block)}


def write_archives(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write rows (key, url, html, record_type, refers_to: strings) as archives in folder; the list (path, n_records) of them, stored."""

    def run(batches):
        task = TaskContext.get().partitionId()
        fs, base = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        number, name, out, written, count = 0, "", None, 0, 0
        attempt = TaskContext.get().taskAttemptId()
        done = []

        def close():
            out.close()
            done.append((f"{folder}/{name}", count))

        for batch in batches:
            for key, url, html, kind, refers_to in zip(*(batch.column(c).to_pylist() for c in ("key", "url", "html", "record_type", "refers_to")), strict=True):
                if out is None:
                    name = f"pages-{task:06d}-{attempt}-{number:05d}.warc.gz"
                    out, written, count = fs.open_output_stream(f"{base}/{name}", compression=None), 0, 0
                pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = record(kind, key, url, html.encode("utf-8"), refers_to)
                data = pack.compress(data) + pack.flush()
                out.write(data)
                written += len(data)
                count += 1
                if written >= archive_bytes:
                    close()
                    out, number = None, number + 1
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], names=["path", "n_records"])

    return stage(rows.select("key", "url", "html", "record_type", "refers_to").mapInArrow(run, "path string, n_records long"), "archives")


_READ = "path string, record_id string, record_type string, uri string, refers_to string, payload_digest string, payload_bytes long, payload binary, digests_ok boolean"


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records of the archives listed in column path, one archive after the other in a task.

    payload_bytes is the full payload's size: of a revisit as the kept HTTP header states it, null where there is no
    payload or no size. payload holds responses' alone; payload_digest is what the record states, without its
    algorithm if that is SHA-1. digests_ok: the block's digest and, where the payload is there, its size and digest
    agree with the headers. Headers that a record lacks are null.
    """

    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, name = pa.fs.FileSystem.from_uri(path)
                rows: list[tuple] = []
                held = 0
                with fs.open_input_stream(name, compression=None, buffer_size=None) as stream:
                    for r in read_records(stream):
                        h = r["headers"]
                        data, size, ok = payload(h, r["block"])
                        stated = h.get("warc-payload-digest")
                        shown = data if with_payload and h.get("warc-type") == "response" else None
                        rows.append((path, h.get("warc-record-id"), h.get("warc-type"), h.get("warc-target-uri"), h.get("warc-refers-to"), stated and stated.removeprefix("sha1:"), size, shown, ok and r["block_ok"]))
                        held += len(shown or b"")
                        if held > 8 << 20 or len(rows) >= 5000:
                            yield _records(rows)
                            rows, held = [], 0
                yield _records(rows)

    n = max(1, min(archives.count(), 100_000))
    return archives.select("path").repartition(n, "path").mapInArrow(run, _READ)


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 6 + [pa.int64(), pa.binary(), pa.bool_()]
    names = [x.split()[0] for x in _READ.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, html) as rows for write_archives.

    Of rows with equal payloads of at least least_bytes bytes, those with the smallest page_id are responses, and the
    others revisit it; all smaller payloads are responses. Rows that share that smallest page_id are responses all.
    A null page_id is never the smallest unless its group has no other; a null html is empty; a null url is ''.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("sha"), F.octet_length(html).alias("size"))
    copied = rows.where(F.col("size") >= least_bytes).groupBy("sha", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    copied = stage(copied.select("sha", "size", "first"), "copied-payloads")
    if small(copied) is not copied:
        joined = rows.join(small(copied), ["sha", "size"], "left")
    else:
        salted = copied.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["sha", "size", "salt"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select(F.coalesce(F.col("page_id").cast("string"), F.lit("none")).alias("key"), "url", "html", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first").cast("string")).alias("refers_to"))


def page_id(record_id: Column) -> Column:
    """The page_id in a record id of ours."""
    return F.regexp_extract(record_id, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")


def round_trip(spark: SparkSession, pages: DataFrame, least_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Write pages to archives and read them back: page_id, url, payload_bytes, payload_digest, record_type, refers_to, digests_ok.

    One record for each row, repeated rows too; no rows write no archive and give no rows.
    """
    archives = write_archives(with_revisits(pages, least_bytes), folder or new_path(spark, "warc"))
    out = read_archives(archives, with_payload=False)
    return out.select(page_id(F.col("record_id")).alias("page_id"), F.col("uri").alias("url"), "payload_bytes", "payload_digest", "record_type", page_id(F.col("refers_to")).alias("refers_to"), "digests_ok")
