"""WARC archives: writing them, and normalising whole-file gzip streams into one member per record with an offset index.

An archive that was compressed as one stream cannot be entered in the middle. The normaliser inflates such a stream once,
from front to back, rewrites every record as a gzip member of its own and writes down where each begins. From then on any
record can be read by itself, and an archive can be read by many tasks.

Tasks write files to a shared folder, each attempt under a name of its own, and report the names as rows of a
table that Spark commits. So what counts is what the table names: a lost executor's unfinished files are never read.
Records pass through in pieces, however long they are.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import scratch, settle
from .common import slices, small_batches

#: An archive is closed once so many bytes, before compression, are in it.
ROLL_BYTES = 1 << 30
PIECE = 1 << 18
LEVEL = 1
GZIP = 16 + zlib.MAX_WBITS
#: The date of records whose capture time is not known.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = re.compile(r"<urn:x-row:(.*)>")

_INDEX = "archive string, record int, start long, bytes long, type string, id string, uri string, payload_digest string, refers_to string"
_READ = "id string, type string, uri string, refers_to string, payload_bytes long, payload_digest string, whole boolean"


def store(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder or file; a name without a scheme is a path."""
    if ":" not in folder.split("/")[0]:
        return fs.LocalFileSystem(), folder
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder))


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(row_id: int | None, uri: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A response with its payload, or a revisit with the headers only; both name the payload's digest and length."""
    name = "null" if row_id is None else row_id
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:x-row:{name}>", f"WARC-Date: {DATE}"]
    if uri is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri))
    head.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:x-row:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def _written(folder: str, roll_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = store(folder)
        files.create_dir(top, recursive=True)
        out = name = packer = None
        records = size = 0

        def close():
            out.write(packer.flush())
            out.close()
            return pa.RecordBatch.from_pydict({"archive": [name], "records": pa.array([records], pa.int64()), "size": pa.array([size], pa.int64())})

        for batch in slices(batches, 64):
            for row_id, uri, payload, refers_to, revisit in zip(*(batch[c].to_pylist() for c in ("id", "uri", "payload", "refers_to", "revisit"))):
                if out is not None and size >= roll_bytes:
                    yield close()
                    out = None
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, packer, records, size = files.open_output_stream(f"{top}/{name}", compression=None), zlib.compressobj(LEVEL, wbits=GZIP), 0, 0
                data = record(row_id, uri, (payload or "").encode(), refers_to, revisit)
                out.write(packer.compress(data))
                records, size = records + 1, size + len(data)
        if out is not None:
            yield close()

    return run


class Inflated:
    """A gzip stream of one or several members, inflated once from front to back."""

    def __init__(self, source, size: int | None = None):
        self.source, self.left, self.held, self.more, self.unpacker = source, size, b"", b"", zlib.decompressobj(GZIP)
        self.begun = False

    def _fill(self) -> bool:
        """More inflated bytes to ``held``; False at the end."""
        while True:
            if not self.more:
                n = PIECE if self.left is None else min(PIECE, self.left)
                self.more = self.source.read(n) if n else b""
                if self.left is not None:
                    self.left -= len(self.more)
                if not self.more:
                    # a member is over when its trailer has been read and found right
                    if self.begun and not self.unpacker.eof:
                        self.held += (rest := self.unpacker.flush())
                        if not rest:
                            raise ValueError("the stream is cut off")
                        return True
                    return False
                self.begun = True
            if self.unpacker.eof:
                self.unpacker = zlib.decompressobj(GZIP)
            data = self.unpacker.decompress(self.more, PIECE)
            self.more = self.unpacker.unconsumed_tail or self.unpacker.unused_data
            if data:
                self.held += data
                return True

    def head(self) -> bytes | None:
        """The header lines up to the empty line, without it; None at the end. Empty lines before them are skipped."""
        while True:
            self.held = self.held.lstrip(b"\r\n")
            at = self.held.find(b"\r\n\r\n")
            if at >= 0:
                out, self.held = self.held[:at], self.held[at + 4 :]
                return out
            if not self._fill():
                if self.held:
                    raise ValueError("the stream ends within a record's headers")
                return None

    def body(self, n: int) -> Iterator[bytes]:
        """The next ``n`` bytes, in pieces."""
        while n:
            if not self.held and not self._fill():
                raise ValueError("the stream ends within a record")
            piece, self.held = self.held[:n], self.held[n:]
            n -= len(piece)
            yield piece


def fields(head: bytes) -> dict[str, str]:
    """Header fields by name in lower case; a line that begins with white space continues the one before."""
    lines = re.sub(rb"\r\n[ \t]+", b" ", head).decode("utf-8", errors="replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def _row_id(value: str | None) -> str | None:
    found = _ID.fullmatch(value or "")
    return None if not found or found[1] == "null" else found[1]


def _normalised(folder: str, target: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = store(folder)
        out_files, out_top = store(target)
        out_files.create_dir(out_top, recursive=True)
        for batch in batches:
            for archive in batch["archive"].to_pylist():
                name, rows = f"{uuid.uuid4().hex}.warc.gz", []
                with (
                    files.open_input_stream(f"{top}/{archive}", compression=None) as source,
                    out_files.open_output_stream(f"{out_top}/{name}", compression=None) as out,
                    out_files.open_output_stream(f"{out_top}/{name}.cdx", compression=None) as sidecar,
                ):
                    stream, place, number = Inflated(source), 0, 0
                    while (head := stream.head()) is not None:
                        f = fields(head)
                        packer, begin = zlib.compressobj(LEVEL, wbits=GZIP), place
                        place += out.write(packer.compress(head + b"\r\n\r\n"))
                        for piece in stream.body(int(f["content-length"])):
                            place += out.write(packer.compress(piece))
                        place += out.write(packer.compress(b"\r\n\r\n") + packer.flush())
                        row = (name, number, begin, place - begin, f.get("warc-type"), _row_id(f.get("warc-record-id")), f.get("warc-target-uri"),
                               f.get("warc-payload-digest"), _row_id(f.get("warc-refers-to")))
                        sidecar.write(("\t".join("-" if x is None else str(x) for x in row) + "\n").encode())
                        rows.append(row)
                        number += 1
                        if len(rows) == 4096:
                            yield _index_rows(rows)
                            rows = []
                if rows:
                    yield _index_rows(rows)

    return run


def _index_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), *[pa.string()] * 5]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [c.split()[0] for c in _INDEX.split(", ")])


def _members(folder: str):
    """Reads single records by the offset index; a response's digest is computed anew from its payload."""

    def one(opened, start: int, size: int):
        opened.seek(start)
        stream = Inflated(opened, size)
        f = fields(stream.head())
        hashed, n, held, past = hashlib.sha1(), 0, b"", False
        for piece in stream.body(int(f["content-length"])):
            if not past:
                held += piece
                at = held.find(b"\r\n\r\n")
                if at < 0:
                    continue
                past, http, piece = True, held[:at], held[at + 4 :]
            hashed.update(piece)
            n += len(piece)
        named = f.get("warc-payload-digest", "").partition(":")[2]
        if f["warc-type"] == "revisit":
            length = re.search(rb"(?i)\r\nContent-Length: *(\d+)", http)
            n, found = int(length[1]), named
        else:
            found = base64.b32encode(hashed.digest()).decode()
        return (_row_id(f.get("warc-record-id")), f["warc-type"], f.get("warc-target-uri"), _row_id(f.get("warc-refers-to")), n, found, found == named)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = store(folder)
        name = opened = None
        for batch in slices(batches, 1024):
            rows = []
            for archive, start, size in zip(*(batch[c].to_pylist() for c in ("archive", "start", "bytes"))):
                if archive != name:
                    if opened:
                        opened.close()
                    name, opened = archive, files.open_input_file(f"{top}/{archive}")
                rows.append(one(opened, start, size))
            kinds = [*[pa.string()] * 4, pa.int64(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [c.split()[0] for c in _READ.split(", ")])

    return run


def write_archives(pages: DataFrame, folder: str, row_id: str, uri: str, payload: str, least: int = 0, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write a record per row to archives, each one gzip stream; returns the table of archives (``archive, records, size``).

    Of rows with equal payloads of at least ``least`` bytes, those with the largest id are responses and the others revisit
    it; all smaller payloads are responses. Only digests and ids are grouped, so a payload with many copies is
    no hot group of payloads. Null payload is empty, a null id is smaller than any other.
    """
    rows = small_batches(pages).select(
        F.col(row_id).cast("long").alias("id"), F.col(uri).cast("string").alias("uri"), F.coalesce(F.col(payload), F.lit("")).alias("payload")
    ).withColumn("sha", F.sha2("payload", 256))
    # written, so that the join has a shuffle of its own, in which the rows of a payload with many copies can be split
    copies = settle(rows.filter(F.octet_length("payload") >= least).groupBy("sha").agg(F.max("id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    known = F.coalesce("id", F.lit(-1))
    revisits = (
        rows.select("sha", "id").join(copies, "sha").filter("refers_to IS NOT NULL AND NOT (id <=> refers_to)")
        .select("sha", known.alias("known"), "refers_to").distinct()
    )
    typed = rows.withColumn("known", known).join(revisits, ["sha", "known"], "left")
    plan = typed.select("id", "uri", "payload", "refers_to", F.col("refers_to").isNotNull().alias("revisit"))
    return settle(plan.mapInArrow(_written(folder, roll_bytes), "archive string, records long, size long"))


def normalise(archives: DataFrame, folder: str, target: str) -> DataFrame:
    """Rewrite archives (column ``archive``, names in ``folder``) with one gzip member per record; returns the offset index.

    A file ``<archive>.cdx`` beside each archive holds its part of the index. A task takes whole archives, as a stream
    can only be inflated from its start. A stream that is cut off ends the job with an error, and so does another number of
    records than ``archives`` states, if it has a column ``records``.
    """
    n = archives.count()
    index = settle(archives.select("archive").repartition(max(n, 1)).mapInArrow(_normalised(folder, target), _INDEX))
    if "records" in archives.columns:
        stated, found = archives.agg(F.sum("records")).first()[0] or 0, index.count()
        if stated != found:
            raise ValueError(f"{found} records in archives of {stated}")
    return index


def read_members(index: DataFrame, folder: str, tasks: int | None = None) -> DataFrame:
    """Read the records of an offset index back, each member by itself; ``whole`` tells that a payload has its digest."""
    tasks = tasks or int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = index.select("archive", "start", "bytes").repartitionByRange(tasks, "archive", "start").sortWithinPartitions("archive", "start")
    return ranges.mapInArrow(_members(folder), _READ)


def round_trip(pages: DataFrame, row_id: str = "page_id", uri: str = "url", payload: str = "html", least: int = 0, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """One row per input row, from archives that were written, normalised and read back.

    Columns ``page_id, payload_bytes, payload_digest`` (of the full payload), ``record_type``, ``refers_to`` (the id of
    the response that a revisit stands for) and ``uri``. Rows that repeat id and payload are alike. Null payload is
    empty, null ids and addresses stay null, other columns are ignored, and an empty table gives none.
    """
    folder = f"{scratch(pages.sparkSession)}/apexframe-warc-{uuid.uuid4().hex}"
    archives = write_archives(pages, f"{folder}/streams", row_id, uri, payload, least, roll_bytes)
    index = normalise(archives, f"{folder}/streams", f"{folder}/members")
    found = read_members(index, f"{folder}/members")
    checked = F.when(F.col("whole"), F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("damaged record "), F.coalesce("id", F.lit("null")))))
    return found.select(
        F.col("id").cast("long").alias("page_id"), "payload_bytes", checked.alias("payload_digest"), F.col("type").alias("record_type"),
        F.col("refers_to").cast("long").alias("refers_to"), "uri",
    )
