"""WARC archives of pages: written by tasks, read back record by record.

One record is one gzip member. Pages with equal payloads are stored once: the one with
the largest id is a response, the others are revisits that name it. Which is which is
settled on digests; texts move once, to the task that writes them, by page id. Every
attempt of a task writes files under names of its own, and only files listed by a
finished task are read, so a lost executor leaves nothing half-written in the result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from .shared import new_folder, staged

ARCHIVE_BYTES = 32 << 20  # payload after which a task begins another archive
CHUNK = 1 << 18  # bytes read, and at most decompressed, at a time
HEAD_BYTES = 1 << 16  # longest record head that is accepted
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value
_PLAIN = "!#$%&'()*+,/:;=?@[]~-._"


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI; without a scheme, or with file:, a local path."""
    local = re.sub(r"^file:/*", "/", path)
    return (fs.LocalFileSystem(), local) if local.startswith("/") else fs.FileSystem.from_uri(path)


def base32_of(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def name_of(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def id_of(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


def record(page_id, url: str | None, payload: bytes, size: int, digest: str, refers_to) -> bytes:
    """A response, or a revisit (without payload) if ``refers_to`` is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name_of(page_id)}", f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {quote(url, safe=_PLAIN)}"] if url else []), f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_of(hashlib.sha1(block).digest())}",
        *([] if refers_to is None else [f"WARC-Refers-To: {name_of(refers_to)}", f"WARC-Profile: {PROFILE}"]),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def plan(pages: DataFrame, least: int) -> DataFrame:
    """(page_id, sha1, refers_to): one row per page id and payload; null: a response."""
    marks = pages.select("page_id", "sha1", "size").distinct()
    most = marks.filter(F.col("size") >= least).groupBy("sha1").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).filter("n > 1")
    joined = marks.join(most, "sha1", "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))
    return joined.select("page_id", "sha1", refers.alias("refers_to"))


def write(pages: DataFrame, least: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html", folder: str | None = None) -> DataFrame:
    """Write a record per row; ``path, records, bytes`` of the archives (a staged table).

    ``folder`` is shared by all executors; by default one in spark.checkpoint.dir. Of
    equal payloads of at least ``least`` bytes, the one with the largest id is a response
    and the rest refer to it; rows that share that id are all responses. A null html is an
    empty payload, a null url is left out, a null id is an empty one and never referred
    to. An empty table writes nothing. Other columns are not read.
    """
    text = F.coalesce(pages[html].cast("string"), F.lit("")).cast("binary")
    rows = pages.select(pages[page_id].cast("long").alias("page_id"), pages[url].cast("string").alias("url"), text.alias("payload"))
    rows = rows.withColumns({"sha1": F.unhex(F.sha1("payload")), "size": F.octet_length("payload").cast("long")})
    kinds = plan(rows, least).withColumnsRenamed({"page_id": "p", "sha1": "d"})
    rows = rows.join(kinds, rows["page_id"].eqNullSafe(kinds["p"]) & (rows["sha1"] == kinds["d"]))
    folder = folder or new_folder(pages, "warc")
    store, root = store_of(folder)
    store.create_dir(root, recursive=True)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = store_of(folder)
        out, path, held, done = None, "", 0, []
        n = 0
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "sha1", "size", "refers_to")]
            for i in range(batch.num_rows):
                page, link, payload, sha1, size, refers = (c[i].as_py() for c in columns)
                if out is None:
                    path, n, held = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(path, compression=None)
                out.write(member(record(page, link, payload if refers is None else b"", size, base32_of(sha1), refers)))
                n, held = n + 1, held + len(payload)
                if held >= ARCHIVE_BYTES:
                    out.close()
                    done.append((path, n, held))
                    out = None
        if out is not None:
            out.close()
            done.append((path, n, held))
        a, b, c = zip(*done) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.int64()), pa.array(c, pa.int64())], ["path", "records", "bytes"])

    # The scheme is kept: readers get back what they can open.
    scheme = "" if isinstance(store, fs.LocalFileSystem) else folder.split("://")[0] + "://"
    listed = rows.select("page_id", "url", "payload", "sha1", "size", "refers_to").mapInArrow(put, "path string, records long, bytes long")
    return staged(listed.select(F.concat(F.lit(scheme), "path").alias("path"), "records", "bytes"))


def members(stream) -> Iterator[Iterator[bytes]]:
    """The gzip members of a stream, each as its decompressed pieces."""
    rest = stream.read(CHUNK)
    while rest:
        unpacker = zlib.decompressobj(31)

        def parts() -> Iterator[bytes]:
            nonlocal rest
            while not unpacker.eof:
                if not rest:
                    rest = stream.read(CHUNK)
                    if not rest:
                        raise ValueError("the archive ends within a member")
                piece = unpacker.decompress(rest, CHUNK)
                rest = unpacker.unused_data if unpacker.eof else unpacker.unconsumed_tail
                if piece:
                    yield piece

        pieces = parts()
        yield pieces
        for _ in pieces:  # what the reader left
            pass
        if not rest:
            rest = stream.read(CHUNK)


def parse(pieces: Iterator[bytes], keep_payload: bool) -> dict:
    """One record, framed by its content length, with both digests verified."""
    def until(mark: bytes, data: bytes) -> tuple[bytes, bytes]:
        while mark not in data:
            if len(data) > HEAD_BYTES or not (more := next(pieces, b"")):
                raise ValueError("a record has no complete head")
            data += more
        head, _, data = data.partition(mark)
        return head, data

    head, data = until(b"\r\n\r\n", b"")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/1."):
        raise ValueError("a member does not begin with a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    if not fields.get("content-length", "").isdigit():
        raise ValueError("a record has no content length")
    left, whole, body, kept, size = int(fields["content-length"]), hashlib.sha1(), hashlib.sha1(), [], 0
    length = left
    http = None if fields.get("content-type", "").startswith("application/http") else b""
    before = b""
    while left:
        data = data or next(pieces, b"")
        if not data:
            raise ValueError("a record is shorter than its content length")
        piece, data = data[:left], data[left:]
        left -= len(piece)
        whole.update(piece)
        if http is None:
            before += piece
            if b"\r\n\r\n" in before:
                http, _, piece = before.partition(b"\r\n\r\n")
            elif len(before) > HEAD_BYTES or not left:
                raise ValueError("a block has no complete HTTP head")
            else:
                continue
        body.update(piece)
        size += len(piece)
        if keep_payload:
            kept.append(piece)
    while (more := next(pieces, b"")):
        data += more
        if len(data) > 4:
            break
    if data != b"\r\n\r\n":
        raise ValueError("a record is longer than its content length")
    if fields.get("warc-block-digest") != f"sha1:{base32_of(whole.digest())}":
        raise ValueError("the block's digest differs")
    kind, digest = fields.get("warc-type"), base32_of(body.digest())
    if kind == "revisit":
        digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
        said = re.search(rb"(?im)^content-length:\s*(\d+)", http or b"")
        size = int(said[1]) if said else None
    elif fields.get("warc-payload-digest") != f"sha1:{digest}":
        raise ValueError("the payload's digest differs")
    uri = fields.get("warc-target-uri")
    return {"page_id": id_of(fields.get("warc-record-id")), "url": None if uri is None else unquote(uri), "record_type": kind, "payload_digest": digest, "payload_bytes": size,
            "refers_to": id_of(fields.get("warc-refers-to")), "block_bytes": length, "payload": b"".join(kept) if keep_payload and kind != "revisit" else None}


SCHEMA = ("page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, "
          "block_bytes long, payload binary, path string, error string")


def read(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """One row per record of the archives in ``archives.path``; ``payloads`` adds the bytes.

    Each archive is read by one task from front to end, in pieces, so memory follows the
    longest payload at most (nothing grows without ``payloads``). A record that is broken
    gives a row with ``error``; a broken member also ends its archive. A null path is
    skipped; no archives give no rows.
    """
    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.string()]

        def batch_of(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds)], names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, local = store_of(path)
                rows, held = [], 0
                with store.open_input_stream(local, compression=None) as stream:
                    try:
                        for pieces in members(stream):
                            try:
                                rows.append(parse(pieces, payloads) | {"path": path})
                            except ValueError as e:
                                rows.append({"path": path, "error": str(e)})
                            held += len(rows[-1].get("payload") or b"")
                            if len(rows) >= 1000 or held >= CHUNK * 16:
                                yield batch_of(rows)
                                rows, held = [], 0
                    except (ValueError, zlib.error) as e:
                        rows.append({"path": path, "error": str(e)})
                yield batch_of(rows)

    paths = archives.select("path").filter("path IS NOT NULL")
    n = paths.count()
    return paths.repartition(max(1, min(n, 10_000))).mapInArrow(take, SCHEMA)
