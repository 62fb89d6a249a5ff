"""WARC archives: write records, revisits of equal payloads included, and read them back as chunk rows.

Equal payloads are found by their SHA-1, computed in the JVM; the largest key of each digest is one aggregation with
partial sums before its shuffle.  Each task then writes one archive, a gzip member per record, under a temporary
name that is renamed when it is complete, so a task that is run again only replaces its own file.  Reading streams:
a payload passes as rows of ``(record, chunk)`` of bounded size with the digest so far, so that no record is ever held
whole by the reader.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from io import BufferedReader

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Workspace

CHUNK = 1 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def _open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_id(key: object) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'record:{key}')}"


def plan_records(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least: int = 0) -> DataFrame:
    """``(id, url, payload, digest, first, alone)``: first is the key of the record that holds an equal payload, itself included.

    Payloads of fewer than ``least`` bytes are their own.  Null payloads are empty; of repeated rows with the largest
    key each holds the payload (``alone`` is false then); a null key never is another's ``first``.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload")).withColumn("digest", F.unhex(F.sha1("payload")))
    counted = rows.filter(F.length("payload") >= least).groupBy("digest", "id").agg(F.count("*").alias("n"))
    most = counted.groupBy("digest").agg(F.max(F.struct("id", "n")).alias("most")).select("digest", F.col("most.id").alias("first"), (F.col("most.n") == 1).alias("alone"))
    joined = rows.join(most, "digest", "left")
    held = F.length("payload") >= least
    return joined.withColumns({"first": F.when(held, F.coalesce("first", "id")).otherwise(F.col("id")), "alone": F.coalesce(held & F.col("alone") & F.col("id").isNotNull(), F.lit(False))})


def _head(kind: str, fields: list[tuple[str, str]], block: int) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *[f"{k}: {v}" for k, v in fields], f"Content-Length: {block}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def _clean(url: str | None) -> str:
    return "".join(c for c in url or "" if c >= " " and c != "\x7f")


def write_archives(records: DataFrame, folder: str, date: str | None = None, level: int = 4) -> DataFrame:
    """Writes ``plan_records`` rows, when it is asked, and returns ``(file, records, bytes)``, one row per archive.

    Every record has an identifier of its own: a payload's only holder one that others can refer to, any other record
    one made of its archive's name and its place there.
    """
    stamp = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches):
        fs, base = _open_fs(folder)
        fs.create_dir(base, recursive=True)
        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}.warc.gz"
        temporary = f"{base}/.{name}.{context.taskAttemptId()}"
        n = size = 0
        with fs.open_output_stream(temporary, compression=None) as out:

            def member(*parts: bytes) -> int:
                pack = zlib.compressobj(level, zlib.DEFLATED, 31)
                written = 0
                for part in parts:
                    for k in range(0, len(part), CHUNK):
                        written += out.write(pack.compress(part[k : k + CHUNK])) or 0
                out.write(pack.flush())
                return written

            info = b"software: tidemark\r\nformat: WARC File Format 1.1\r\n"
            member(_head("warcinfo", [("WARC-Record-ID", f"<{record_id(name)}>"), ("WARC-Date", stamp), ("Content-Type", "application/warc-fields")], len(info)), info, b"\r\n\r\n")
            for batch in batches:
                for key, url, payload, digest, first, alone in zip(*batch.columns, strict=True):
                    key, first, payload, alone, digest = key.as_py(), first.as_py(), payload.as_py(), alone.as_py(), base32_sha1(digest.as_py())
                    own = f"{digest}:{key}" if alone and first == key else f"{name}:{n}"
                    shared = [("WARC-Record-ID", f"<{record_id(own)}>"), ("WARC-Date", stamp), ("WARC-Target-URI", _clean(url.as_py())), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("X-Key", "" if key is None else str(key))]
                    if first == key:
                        member(_head("response", shared, len(_HTTP) + len(payload)), _HTTP, payload, b"\r\n\r\n")
                    else:
                        more = [*([("WARC-Refers-To", f"<{record_id(f'{digest}:{first}')}>")] if alone else []), ("WARC-Profile", _PROFILE), ("X-Refers-To-Key", str(first)), ("X-Payload-Length", str(len(payload)))]
                        member(_head("revisit", [*shared, *more], len(_HTTP)), _HTTP, b"\r\n\r\n")
                    n += 1
            size = out.tell()
        if fs.get_file_info(f"{base}/{name}").type != pafs.FileType.NotFound:  # of an attempt that was lost afterwards
            fs.delete_file(f"{base}/{name}")
        fs.move(temporary, f"{base}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], names=["file", "records", "bytes"])

    return records.select("id", "url", "payload", "digest", "first", "alone").mapInArrow(run, "file string, records long, bytes long")


class _Members:
    """The decompressed bytes of a file of gzip members (or of a plain file), read on and on."""

    def __init__(self, source, chunk: int):
        self.source, self.chunk, self.buffer, self.ended = source, chunk, bytearray(), False
        first = source.read(2)
        self.plain, self.rest = first != b"\x1f\x8b", first
        self.unpack = None if self.plain else zlib.decompressobj(31)

    def _more(self) -> bool:
        raw, self.rest = self.rest or self.source.read(self.chunk), b""
        if not raw:
            self.ended = True
            return False
        if self.plain:
            self.buffer += raw
            return True
        self.buffer += self.unpack.decompress(raw, self.chunk)
        if self.unpack.eof:
            self.rest, self.unpack = self.unpack.unused_data, zlib.decompressobj(31)
        else:
            self.rest = self.unpack.unconsumed_tail
        return True

    def take(self, n: int) -> bytes:
        """Up to ``n`` bytes, fewer only at the end."""
        while len(self.buffer) < n and self._more():
            pass
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out

    def line(self) -> bytes | None:
        while (at := self.buffer.find(b"\n")) < 0:
            if len(self.buffer) > 1 << 20:
                raise ValueError("a header line of over 1 MiB")
            if not self._more():
                return None
        return self.take(at + 1).rstrip(b"\r\n")


def read_records(source: BufferedReader, chunk: int = CHUNK) -> Iterator[tuple[dict[str, str], int, bytes, int, str, bool]]:
    """``(headers, chunk number, data, payload bytes so far, digest so far, is last)`` of each record's payload.

    The HTTP head of a response is no part of its payload; a record without payload gives one empty chunk.
    """
    data = _Members(source, min(chunk, 1 << 16))
    while (line := data.line()) is not None:
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        headers = {}
        while line := data.line():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        left = int(headers["content-length"])
        if headers.get("content-type", "").startswith("application/http"):
            while left > 0 and (line := data.line()) is not None:
                left -= len(line) + 2
                if not line:
                    break
        number, so_far, sha = 0, 0, hashlib.sha1(usedforsecurity=False)
        while True:
            part = data.take(min(chunk, left))
            left -= len(part)
            if left and not part:
                raise ValueError("an archive ends within a record")
            so_far += len(part)
            sha.update(part)
            yield headers, number, part, so_far, base32_sha1(sha.digest()), not left
            number += 1
            if not left:
                break
        data.take(4)


def read_chunks(spark: SparkSession, files: DataFrame, chunk: int = CHUNK, with_data: bool = True) -> DataFrame:
    """The chunked record table of the archives named in ``files(file)``.

    One row per payload chunk: ``(file, record_id, record_key, record_type, url, refers_to, chunk, is_last, payload_bytes,
    payload_digest, data)``; the byte count and the digest are those up to and with this chunk;
    of a revisit, bytes and digest are those of the payload that it stands for.  A payload that does not match the
    digest in its head is an error.
    """
    names = ["file", "record_id", "record_key", "record_type", "url", "refers_to", "chunk", "is_last", "payload_bytes", "payload_digest", "data"]
    types = [pa.string()] * 6 + [pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.binary()]

    def run(batches):
        for batch in batches:
            for file in batch.column(0).to_pylist():
                fs, path = _open_fs(file)
                rows, held = [], 0
                with fs.open_input_stream(path, compression=None) as source:
                    for head, number, part, so_far, digest, last in read_records(source, chunk):
                        kind = head.get("warc-type")
                        if kind not in ("response", "revisit"):
                            continue
                        revisit = kind == "revisit"
                        size = int(head.get("x-payload-length", 0)) if revisit else so_far
                        said = head.get("warc-payload-digest", "")
                        if not revisit and last and said.startswith("sha1:") and said != f"sha1:{digest}":
                            raise ValueError(f"{file}: the payload of {head['warc-record-id']} is not what its digest says")
                        digest = said.removeprefix("sha1:") if revisit else digest
                        rows.append((file, head["warc-record-id"].strip("<>"), head.get("x-key") or None, kind, head.get("warc-target-uri"), head.get("x-refers-to-key"), number, last, size, digest, part if with_data else None))
                        held += len(part)
                        if held > 8 * CHUNK or len(rows) >= 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    n = max(1, files.count())
    schema = "file string, record_id string, record_key string, record_type string, url string, refers_to string, chunk long, is_last boolean, payload_bytes long, payload_digest string, data binary"
    return files.select("file").repartition(min(n, 4 * spark.sparkContext.defaultParallelism), "file").mapInArrow(run, schema)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, folder: str | None = None, with_data: bool = True) -> DataFrame:
    """Writes the rows as archives (below the shared folder, if none is given) and returns the chunk rows read back.

    An empty table writes empty archives and gives no rows; further columns are ignored.
    """
    ws = Workspace(pages.sparkSession, "warc")
    files = ws.table(write_archives(plan_records(pages, id_col, url_col, payload_col, least), folder or f"{ws.path}/archives"), "files")
    return read_chunks(pages.sparkSession, files, with_data=with_data)
