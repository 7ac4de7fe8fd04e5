"""WARC archives: written by tasks, one gzip member per record, and read back in sequence.

Records with equal payloads are stored once: the one with the smallest id is a response, the
others are revisits that refer to it and carry the payload's digest and length only. The reader
inflates members piece by piece, frames blocks by their content length and verifies
every digest there is; a damaged archive raises an error. It takes archives of other writers too.

Each task writes archives under names of its own in a folder that all executors reach, and
returns their names. Only archives named by tasks that ended well are read, so a lost
task leaves at most files that nobody reads. Folders may be any that pyarrow.fs opens.

Defined cases: a null payload is an empty one; a null or empty address is left out; a null id
gives an empty record id and is read back as null, and a payload's smallest id is
taken among ids that are not null; rows that repeat the smallest id are all responses; an
empty table gives no archive and an empty result; very long payloads are split by nothing but
the reader's pieces.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from musterline.llm.common import by_value, kept, new_folder
from musterline.operators.skew import add_split, copy_per_split, hot_keys

ARCHIVE_BYTES = 64 << 20
PIECE = 1 << 16
# Longest headers of a record or a response.
MOST_HEAD = 1 << 20
# Digest algorithms of the format that can be verified.
ALGORITHMS = ("md5", "sha1", "sha256", "sha384", "sha512")
# A payload of more rows than this (and a ten-thousandth of all) is split over tasks.
SPLIT_ROWS = 10_000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BATCH_ROWS, BATCH_BYTES = 2_000, 8 << 20

by_value(sys.modules[__name__])


def base32_sha1(content: bytes) -> str:
    return base64.b32encode(hashlib.sha1(content).digest()).decode()


def address(url: str) -> str:
    """The address on one header line: control characters and blanks are escaped."""
    return "".join(f"%{ord(c):02X}" if ord(c) <= 32 or ord(c) == 127 else c for c in url)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member: a response, or a revisit if it refers to another record."""
    revisit = refers_to is not None
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url:
        lines.append(f"WARC-Target-URI: {address(url)}")
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    head = "\r\n".join(lines).encode() + b"\r\n\r\n"
    return packer.compress(head + block + b"\r\n\r\n") + packer.flush()


def members(stream) -> Iterator[Iterator[bytes]]:
    """Each gzip member of a stream as an iterator of inflated pieces."""
    held = stream.read(PIECE)
    while held:
        inflate = zlib.decompressobj(31)

        def pieces() -> Iterator[bytes]:
            nonlocal held
            while not inflate.eof:
                if not held:
                    raise ValueError("the archive ends inside a record")
                yield inflate.decompress(held, PIECE)
                held = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
                if not held and not inflate.eof:
                    held = stream.read(PIECE)

        yield pieces()
        if not inflate.eof:
            raise ValueError("a record was not read to its end")
        held = held or stream.read(PIECE)


class _Record:
    """Bytes of one member: headers first, then as many as a length says."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held = pieces, b""

    def _more(self) -> bytes:
        for piece in self.pieces:
            if piece:
                return piece
        raise ValueError("a record is shorter than its content length")

    def headers(self) -> dict[str, str]:
        while b"\r\n\r\n" not in self.held:
            if len(self.held) > MOST_HEAD:
                raise ValueError("a record has no end of its headers")
            self.held += self._more()
        head, self.held = self.held.split(b"\r\n\r\n", 1)
        return header_fields(head)

    def take(self, length: int) -> Iterator[bytes]:
        while length:
            if not self.held:
                self.held = self._more()
            piece, self.held = self.held[:length], self.held[length:]
            length -= len(piece)
            yield piece

    def close(self) -> None:
        rest = self.held + b"".join(self.pieces)
        if rest != b"\r\n\r\n":
            raise ValueError("a record does not end where its content length says")


def header_fields(head: bytes) -> dict[str, str]:
    """Fields by lower-case name, the first line under "". Folded lines are put together."""
    lines: list[str] = []
    for line in head.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and len(lines) > 1:
            lines[-1] += " " + line.strip()
        else:
            lines.append(line)
    pairs = (line.split(":", 1) for line in lines[1:] if ":" in line)
    return {"": lines[0]} | {name.strip().lower(): value.strip() for name, value in pairs}


class Chunks:
    """Takes the chunk marks of a chunked body off, piece by piece."""

    def __init__(self):
        self.held, self.left, self.sound, self.ended = b"", 0, True, False

    def feed(self, piece: bytes) -> bytes:
        out, self.held = [], self.held + piece
        while self.sound and not self.ended and self.held:
            if self.left > 2:
                taken = self.held[: self.left - 2]
                out.append(taken)
                self.held, self.left = self.held[len(taken) :], self.left - len(taken)
            elif self.left:
                # The line end after a chunk.
                if len(self.held) < self.left:
                    break
                self.sound = self.held[: self.left] == b"\r\n"[2 - self.left :]
                self.held, self.left = self.held[self.left :], 0
            elif b"\r\n" in self.held:
                size, self.held = self.held.split(b"\r\n", 1)
                try:
                    number = int(size.split(b";")[0], 16)
                except ValueError:
                    self.sound = False
                    break
                self.ended, self.left = number == 0, number + 2 if number else 0
            elif len(self.held) > MOST_HEAD:
                self.sound = False
            else:
                break
        return b"".join(out)


class Digest:
    """Compares bytes with what a digest field says, if its algorithm is known."""

    def __init__(self, field: str | None):
        name, _, self.value = (field or "").partition(":")
        name = name.strip().lower().replace("-", "")
        self.hash = hashlib.new(name) if self.value and name in ALGORITHMS else None

    def update(self, piece: bytes) -> None:
        if self.hash is not None:
            self.hash.update(piece)

    def agrees(self) -> bool:
        if self.hash is None:
            return True
        digest, value = self.hash.digest(), self.value.strip()
        # Base32 with or without its padding, or hexadecimal.
        return value.lower() == digest.hex() or value.upper().rstrip("=") == base64.b32encode(
            digest
        ).decode().rstrip("=")


def _page(name: str | None) -> int | None:
    number = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if re.fullmatch(r"-?[0-9]{1,18}", number) else None


def _length(field: str | None) -> int | None:
    return int(field) if re.fullmatch("[0-9]+", field or "") else None


def read_records(stream, with_payload: bool = True) -> Iterator[dict]:
    """The records of an archive in order, each verified by the digests that it has.

    Any archive of versions 0.17 to 1.1 with one gzip member per record: ids of any form, all record
    types, digests in several algorithms or none, folded headers, chunked bodies. The payload
    of an HTTP response is its body (chunk marks taken off), of any other record its whole
    block; a payload digest may be that of either form of a chunked body. Blocks pass through
    piece by piece and are held only if the payload is asked for.
    """
    for pieces in members(stream):
        source = _Record(pieces)
        head = source.headers()
        if not head[""].startswith("WARC/"):
            raise ValueError(f"not a record: {head['']!r}")
        length = _length(head.get("content-length"))
        if length is None:
            raise ValueError(f"no content length in {head.get('warc-record-id')}")
        kind = head.get("warc-type", "").lower()
        http = head.get("content-type", "").lower().startswith("application/http")
        whole = Digest(head.get("warc-block-digest"))
        sent, plain = (Digest(head.get("warc-payload-digest")) for _ in range(2))
        sha1, size, payload = hashlib.sha1(), 0, bytearray()
        fields, chunks, start = None if http else {}, None, b""
        for piece in source.take(length):
            whole.update(piece)
            if fields is None:
                start += piece
                if b"\r\n\r\n" not in start:
                    if len(start) > MOST_HEAD:
                        fields, piece = {}, start
                    else:
                        continue
                else:
                    first, piece = start.split(b"\r\n\r\n", 1)
                    fields = header_fields(first)
                    if "chunked" in fields.get("transfer-encoding", "").lower():
                        chunks = Chunks()
            sent.update(piece)
            body = chunks.feed(piece) if chunks else piece
            plain.update(body)
            sha1.update(body)
            size += len(body)
            if with_payload:
                payload += body
        source.close()
        name = head.get("warc-record-id")
        if not whole.agrees():
            raise ValueError(f"block digest differs in {name}")
        revisit = kind == "revisit"
        if not revisit and not (sent.agrees() or plain.agrees()):
            raise ValueError(f"payload digest differs in {name}")
        if revisit:
            # The payload is that of the record referred to; its length may be told.
            size = _length((fields or {}).get("content-length"))
            digest = head.get("warc-payload-digest", "").partition(":")[2] or None
        else:
            digest = base64.b32encode(sha1.digest()).decode()
        yield {
            "page_id": _page(name),
            "url": head.get("warc-target-uri", "").removeprefix("<").removesuffix(">") or None,
            "payload_bytes": size,
            "payload_digest": digest,
            "record_type": kind,
            "refers_to": _page(head.get("warc-refers-to")),
            "record_id": name,
            "refers_to_id": head.get("warc-refers-to"),
            "date": head.get("warc-date"),
            "payload": bytes(payload) if with_payload and not revisit else None,
        }


def _open(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(folder)


def with_first(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Adds `payload` and `first`, the smallest id among rows with the same payload.

    Only payloads that occur more than once are joined back; `first` is null for all others
    and for payloads under `least_bytes`.
    """
    own = pages.select(
        "page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")
    ).withColumn("sha", F.sha1("payload"))
    repeated = kept(
        own.where(F.octet_length("payload") >= least_bytes)
        .groupBy("sha")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1")
    )
    # Equal payloads may be a third of all rows: they are spread over several tasks.
    hot = hot_keys(repeated, ["sha"], "n", SPLIT_ROWS)
    first = copy_per_split(repeated.drop("n"), hot, ["sha"])
    # Small payloads may share a digest with none but equal ones, so the digest is enough.
    found = add_split(own, hot, ["sha"], "page_id").join(first, ["sha", "split"], "left")
    return found.select("page_id", "url", "payload", "first")


def write(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write one record per row (page_id, url, payload, first); returns the archives written."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(folder)
        system.create_dir(base, recursive=True)
        stream, name, size, records = None, "", 0, 0

        def done() -> pa.RecordBatch:
            stream.close()
            return pa.RecordBatch.from_pydict(
                {"archive": [name], "records": [records], "bytes": [size]}
            )

        for batch in batches:
            for row in batch.to_pylist():
                if stream is None:
                    name, size, records = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    stream = system.open_output_stream(f"{base}/{name}", compression=None)
                first = row["first"]
                refers = first if first is not None and first != row["page_id"] else None
                member = record(row["page_id"], row["url"], row["payload"], refers)
                stream.write(member)
                size, records = size + len(member), records + 1
                if size >= archive_bytes:
                    yield done()
                    stream = None
        if stream is not None:
            yield done()

    rows = pages.select("page_id", "url", "payload", "first")
    return kept(rows.mapInArrow(pack, "archive string, records long, bytes long"))


def read(archives: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The records of the named archives, one archive after the other in each task.

    `archives` has their names under `folder` in a column archive: those that `write` returns, or any
    list. page_id and refers_to are null where ids are not of the form that `write` gives;
    record_id and refers_to_id are the ids as they stand.
    """
    numbers = ("page_id", "payload_bytes", "refers_to")
    names = "page_id url payload_bytes payload_digest record_type refers_to record_id refers_to_id date".split()
    schema = ", ".join(f"{name} {'long' if name in numbers else 'string'}" for name in names)
    kinds = [pa.int64() if name in numbers else pa.string() for name in names]
    if with_payload:
        names, schema, kinds = [*names, "payload"], schema + ", payload binary", [*kinds, pa.binary()]

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(folder)
        layout = pa.schema(list(zip(names, kinds)))

        def made(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{n: r[n] for n in names} for r in rows], layout)

        for batch in batches:
            for name in batch["archive"].to_pylist():
                rows, size = [], 0
                with system.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for row in read_records(stream, with_payload):
                        rows.append(row)
                        size += len(row["payload"] or b"") if with_payload else 0
                        if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                            yield made(rows)
                            rows, size = [], 0
                if rows:
                    yield made(rows)

    return archives.select("archive").mapInArrow(unpack, schema)


def round_trip(
    spark: SparkSession, pages: DataFrame, least_bytes: int = 0, with_payload: bool = True
) -> DataFrame:
    """Write all pages into a new shared folder and read the archives back."""
    folder = new_folder(spark, "warc")
    archives = write(with_first(pages, least_bytes), folder)
    return read(archives, folder, with_payload)
