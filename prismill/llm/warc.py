"""WARC archives: written, normalised from one gzip stream per file to one member per record, indexed, and read by offset.

An archive that is one gzip stream can only be read from its start. `normalise` inflates such a stream once, piece by piece,
writes every record as a gzip member of its own and a sidecar with each record's offset, so that later readers open a record
anywhere in the file and share a large file between tasks. Files are written under names of their own attempt; only the
files of the returned table count, so a repeated task leaves at most a file that nobody reads.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from prismill.llm.text import require
from prismill.session import durable

PIECE = 1 << 20  # bytes read or inflated at once
PER_FILE = 1 << 30  # bytes of records in an archive
SPAN = 64 << 20  # bytes of an archive that one task reads by its index
MOST_TASKS = 4096  # tasks that archives are dealt to
SMALL = 100_000  # repeated payloads whose list (digest and id) is sent to all tasks; a longer one is joined by shuffles
SALTS, HOT = 64, 1000  # parts of a hot payload's rows; a payload is hot with 1 / HOT of all rows
# Fixed values of the format.
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "<urn:x-page:{}>"


class BrokenArchive(ValueError):
    """Bytes that are no WARC record."""


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, as every executor sees it."""
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def with_types(pages: DataFrame, least: int) -> DataFrame:
    """(id, url, payload, first) of (id, url, payload): `first` is the smallest id with the same payload, if it repeats.

    Payloads are only shuffled where many repeat. Those of a hot group are then spread over SALTS parts, and its one row of
    the other side is repeated for them.
    """
    keyed = pages.withColumn("digest", F.unhex(F.sha2("payload", 256)))
    sized = keyed.where(F.octet_length("payload") >= least)
    groups = durable(sized.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    repeated, rows = groups.agg(F.count(F.lit(1)), F.sum("n")).first()
    out = ["id", "url", F.when(F.col("first").isNull() | F.col("id").eqNullSafe(F.col("first")), F.col("payload")).alias("payload"), "first", F.octet_length("payload").cast("bigint").alias("size"), F.sha1("payload").alias("sha1")]
    if repeated <= SMALL:
        return keyed.join(F.broadcast(groups.drop("n")), "digest", "left").select(*out)
    # At most HOT digests.
    hot = [r.digest for r in groups.where(F.col("n") * HOT >= max(rows, HOT)).select("digest").collect()]
    salt = F.when(F.col("digest").isin(hot), F.pmod(F.xxhash64("id", "url"), F.lit(SALTS))).otherwise(0) if hot else F.lit(0)
    spread = F.when(F.col("digest").isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))) if hot else F.array(F.lit(0))
    groups = groups.select("digest", "first", F.explode(spread).alias("salt"))
    return keyed.withColumn("salt", salt.cast("int")).join(groups, ["digest", "salt"], "left").select(*out)


def record_bytes(page, url: str | None, payload: bytes | None, first, size: int, sha1: str, date: str) -> bytes:
    """One record. A revisit holds the response's HTTP header, with the length of the payload it leaves out."""
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (payload or b"")
    head = {
        "WARC-Type": "response" if payload is not None else "revisit", "WARC-Record-ID": RECORD.format("" if page is None else page), "WARC-Date": date,
        "WARC-Payload-Digest": f"sha1:{digest}", "WARC-Block-Digest": f"sha1:{sha1_base32(block)}", "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block)),
    }
    if url is not None:
        head["WARC-Target-URI"] = quote(url, safe="%:/?#[]@!$&'()*+,;=~")
    if payload is None:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": RECORD.format(first)}
    return "\r\n".join([VERSION, *(f"{k}: {v}" for k, v in head.items()), "", ""]).encode() + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, per_file: int = PER_FILE, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """(path, records): archives below `folder` with one record per page, each archive one gzip stream.

    * Of the pages whose equal payloads have at least `least` bytes, the one with the smallest id is a response and the
      others revisit it. Pages that repeat this id as well are responses too. A page without an id revisits the page that
      has one; where none has, each is a response. Null payloads are empty; a null url has no target.
    * Control characters, blanks and non-ASCII of an url are percent-encoded. Other columns are not written.
    * No pages: no archives. A payload is held in memory whole, an archive never.
    """
    require(pages, id_col, url_col, payload_col)
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = with_types(pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")), least)

    def run(batches: Iterator[pa.RecordBatch]):
        store, base = place(folder)
        store.create_dir(base, recursive=True)
        out, done, name, part = None, [], None, TaskContext.get().partitionId()
        written = records = 0

        def finish():
            nonlocal out
            out.write(squeeze.flush())
            out.close()
            done.append((name, records))
            out = None

        for batch in batches:
            for page, url, data, first, size, sha1 in zip(*(batch.column(c).to_pylist() for c in ("id", "url", "payload", "first", "size", "sha1"))):
                if out is None:
                    name, written, records = f"{folder}/whole-{part:05d}-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out, squeeze = store.open_output_stream(f"{base}/{name.rsplit('/', 1)[1]}", compression=None), zlib.compressobj(1, zlib.DEFLATED, 31)
                data = record_bytes(page, url, data, first, size, sha1, date)
                out.write(squeeze.compress(data))
                written, records = written + len(data), records + 1
                if written >= per_file:
                    finish()
        if out is not None:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["path", "records"])

    return durable(rows.mapInArrow(run, "path string, records long"))


class Inflated:
    """The bytes of a file, inflated piece by piece if it is gzip of one member or many."""

    def __init__(self, raw):
        self.raw, self.buffer, self.at, self.ended, self.broken = raw, b"", 0, False, False
        first = raw.read(PIECE)
        self.squeezed = first[:2] == b"\x1f\x8b"
        self.inflater = zlib.decompressobj(31)
        self.source = first
        if not first:
            self.ended = True

    def more(self) -> bool:
        """Append what the next piece holds; False at the end."""
        while not self.ended:
            piece = self.source or self.raw.read(PIECE)
            self.source = b""
            if not self.squeezed:
                self.ended = not piece
                out = piece
            elif not piece:
                # An open member at the end of the file is cut off.
                self.ended, out = True, b""
                self.broken = not self.inflater.eof
            else:
                try:
                    if self.inflater.eof:
                        # Zeros may pad the end of a member.
                        piece = piece.lstrip(b"\0")
                        if not piece:
                            continue
                        self.inflater = zlib.decompressobj(31)
                    out = self.inflater.decompress(piece, PIECE)
                    self.source = self.inflater.unconsumed_tail or self.inflater.unused_data
                except zlib.error:
                    self.ended, self.broken, out = True, True, b""
            if out:
                self.buffer = self.buffer[self.at :] + out
                self.at = 0
                return True
        return False

    def line(self, limit: int = 1 << 16) -> bytes | None:
        """The next line without its end; None at the end of the file."""
        while (end := self.buffer.find(b"\n", self.at)) < 0:
            if len(self.buffer) - self.at > limit or not self.more():
                if self.at == len(self.buffer):
                    return None
                raise BrokenArchive("a header line without an end")
        line, self.at = self.buffer[self.at : end], end + 1
        return line.rstrip(b"\r")

    def pieces(self, n: int) -> Iterator[bytes]:
        """The next n bytes."""
        while n:
            if self.at == len(self.buffer) and not self.more():
                raise BrokenArchive("the file ends inside a record")
            piece = self.buffer[self.at : self.at + n]
            self.at += len(piece)
            n -= len(piece)
            yield piece


def read_header(stream: Inflated) -> tuple[bytes, dict[str, str]] | None:
    """(bytes, fields by lower-case name) of the next record's header; None at the end. Folded lines are joined."""
    line = stream.line()
    while line == b"":
        line = stream.line()
    if line is None:
        return None
    if not line.startswith(b"WARC/"):
        raise BrokenArchive(f"no WARC record begins with {line[:40]!r}")
    lines, fields, last = [line], {}, None
    while line := stream.line():
        lines.append(line)
        if line[:1] in b" \t" and last:
            fields[last] += " " + line.decode("utf-8", "replace").strip()
            continue
        name, _, value = line.decode("utf-8", "replace").partition(":")
        last = name.strip().lower()
        fields[last] = value.strip()
    if line is None or not fields.get("content-length", "").isdigit():
        raise BrokenArchive("a header without an end or a length")
    return b"\r\n".join([*lines, b"", b""]), fields


def normalise(archives: DataFrame, folder: str, path_col: str = "path", level: int = 6) -> DataFrame:
    """(source, path, index, records, complete): each archive with every record as a gzip member of its own.

    * The input is inflated once from front to end; neither an archive nor a record is held whole. Plain files and files
      of many members are taken as well. `index` is the sidecar: a JSON line per record with its offset and length in
      `path`, type, id, target and payload digest.
    * `complete` is false where the input is cut off or damaged: the records before that place are kept. An empty file is a
      complete archive without records. Null paths are left out; a path that repeats is normalised each time.
    """
    require(archives, path_col)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for source in batch.column("path").to_pylist():
                store, inner = place(source)
                target, base = place(folder)
                target.create_dir(base, recursive=True)
                name = f"members-{uuid.uuid4().hex}.warc.gz"
                offset, records, complete = 0, 0, True
                with store.open_input_stream(inner, compression=None) as raw, target.open_output_stream(f"{base}/{name}", compression=None) as out, target.open_output_stream(f"{base}/{name}.cdxj", compression=None) as index:
                    stream = Inflated(raw)
                    # Members of one record each are short: they are kept until they are whole, up to a piece, then written on.
                    while True:
                        try:
                            head = read_header(stream)
                            if head is None:
                                complete &= not stream.broken
                                break
                            squeeze, length, held = zlib.compressobj(level, zlib.DEFLATED, 31), 0, []
                            held.append(squeeze.compress(head[0]))
                            for piece in stream.pieces(int(head[1]["content-length"])):
                                held.append(squeeze.compress(piece))
                                if sum(map(len, held)) >= PIECE:
                                    length += sum(map(len, held))
                                    out.write(b"".join(held))
                                    held = []
                            held.append(squeeze.compress(b"\r\n\r\n") + squeeze.flush())
                        except BrokenArchive:
                            complete = False
                            break
                        out.write(b"".join(held))
                        length += sum(map(len, held))
                        field = head[1].get
                        line = {"offset": offset, "length": length, "type": field("warc-type"), "id": field("warc-record-id"), "uri": field("warc-target-uri"), "digest": field("warc-payload-digest")}
                        index.write(json.dumps(line).encode() + b"\n")
                        offset, records = offset + length, records + 1
                path = f"{folder}/{name}"
                yield pa.RecordBatch.from_pylist([{"source": source, "path": path, "index": f"{path}.cdxj", "records": records, "complete": complete}])

    files = durable(archives.where(F.col(path_col).isNotNull()).select(F.col(path_col).cast("string").alias("path")))
    # A stream has no second entry, so a file is a task's least share; each has a task of its own up to a few thousand.
    return durable(files.repartition(min(MOST_TASKS, max(1, files.count()))).mapInArrow(run, "source string, path string, index string, records long, complete boolean"))


def read_index(normalised: DataFrame) -> DataFrame:
    """(path, offset, length, type, id, uri, digest) from the sidecars of `normalise`."""
    kinds = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("id", pa.string()), ("uri", pa.string()), ("digest", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for path, index in zip(batch.column("path").to_pylist(), batch.column("index").to_pylist()):
                store, inner = place(index)
                rest = b""
                with store.open_input_stream(inner, compression=None) as lines:
                    while piece := lines.read(PIECE):
                        *whole, rest = (rest + piece).split(b"\n")
                        yield pa.RecordBatch.from_pylist([{"path": path} | json.loads(line) for line in whole], kinds)

    return normalised.select("path", "index").mapInArrow(run, "path string, offset long, length long, type string, id string, uri string, digest string")


def payload_of(block: bytes) -> tuple[bytes, dict[str, str]]:
    """(body, header fields by lower-case name) of an HTTP block."""
    head, _, body = block.partition(b"\r\n\r\n")
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return body, {name.strip().lower(): value.strip() for name, _, value in pairs}


def read_records(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """(type, id, uri, refers_to, payload_bytes, payload_digest, payload) of the records that an index names.

    * Each record is opened at its offset, so that the records of one archive spread over tasks. A record whose bytes don't
      give the payload digest of its header raises BrokenArchive.
    * A revisit has no payload; its size is that of the HTTP header it keeps, its digest that of its own header.
    * `with_payload` false leaves the payload out, which has been read and checked all the same.
    """
    kinds = pa.schema([("type", pa.string()), ("id", pa.string()), ("uri", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]):
        store = handle = opened = None
        for batch in batches:
            rows, held = [], 0
            for path, offset, length in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "length"))):
                if path != opened:
                    if handle is not None:
                        handle.close()
                    store, inner = place(path)
                    handle, opened = store.open_input_file(inner), path
                handle.seek(offset)
                data = zlib.decompress(handle.read(length), 31)
                head, _, rest = data.partition(b"\r\n\r\n")
                fields = {n.strip().lower(): v.strip() for n, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}
                body, http = payload_of(rest[: int(fields["content-length"])])
                digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
                kind = fields.get("warc-type")
                if kind != "revisit" and digest and digest != sha1_base32(body):
                    raise BrokenArchive(f"{path} at {offset}: the payload is not that of its digest")
                size = int(http.get("content-length", 0)) if kind == "revisit" else len(body)
                rows.append((kind, fields.get("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-refers-to"), size, digest, body if with_payload and kind != "revisit" else None))
                held += len(body) if with_payload else 0
                if held >= 16 * PIECE:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows), kinds)], schema=kinds)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows), kinds)], schema=kinds)
        if handle is not None:
            handle.close()

    spans = index.repartition(F.col("path"), F.floor(F.col("offset") / SPAN)).sortWithinPartitions("path", "offset")
    out = spans.select("path", "offset", "length").mapInArrow(run, "type string, id string, uri string, refers_to string, payload_bytes long, payload_digest string, payload binary")
    return out if with_payload else out.drop("payload")


def page_of(record: str):
    """The page id in a record's name."""
    number = F.regexp_extract(record, r"^<urn:x-page:(-?\d+)>$", 1)
    return F.when(number != "", number.cast("bigint"))
