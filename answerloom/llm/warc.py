"""Web archives: gzip members written per record, and a reader that splits the files anywhere."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerloom.session import work_folder
from answerloom.llm.tables import partitions, stored

MAGIC = b"\x1f\x8b\x08"
#: Fixed values of the format.
VERSION, PROFILE = b"WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE_URN = "urn:page:"
#: Bytes read from a file at once, and given to the decoder at once.
READ_BYTES, FEED_BYTES = 1 << 20, 1 << 14
#: Reading tasks of an archive, at most, for each partition of the shuffle width.
TASKS_PER_PARTITION = 8

RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def file_system(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The store a shared folder is in and the path there."""
    parts = urlsplit(uri)
    return (pa.fs.LocalFileSystem(), parts.path) if parts.scheme in ("", "file") else pa.fs.FileSystem.from_uri(uri)


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record as a gzip member. A revisit (``refers_to`` given) carries the HTTP headers and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<{PAGE_URN}{'' if page_id is None else page_id}>",
        "WARC-Date": date, "WARC-Payload-Digest": f"sha1:{digest}",
        "Content-Type": "application/http;msgtype=response", "Content-Length": str(len(block)),
    }
    if url is not None:
        fields["WARC-Target-URI"] = quote(url, safe="%/:=&?~#+!$,;'@()*[]")
    if refers_to is not None:
        fields |= {"WARC-Refers-To": f"<{PAGE_URN}{refers_to}>", "WARC-Profile": PROFILE}
    head = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + b"\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head + block + b"\r\n\r\n") + packer.flush()


def parse_record(data: bytes) -> dict:
    """A decoded record to the columns of ``RECORD``. Raises ValueError where it isn't whole or its digest is wrong."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}
    block = rest[: int(fields["content-length"])]
    if len(block) != int(fields["content-length"]):
        raise ValueError("a record ends early")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    number = lambda name: int(x) if (x := fields.get(name, "").strip("<>").removeprefix(PAGE_URN)) else None
    whole, digest = fields["warc-type"] == "response", fields["warc-payload-digest"].removeprefix("sha1:")
    if whole and (len(payload) != size or sha1_base32(payload) != digest):
        raise ValueError("a payload differs from its digest")
    return {
        "page_id": number("warc-record-id"), "url": fields.get("warc-target-uri"), "record_type": fields["warc-type"],
        "payload_bytes": size, "payload_digest": digest, "refers_to": number("warc-refers-to"), "payload": payload if whole else None,
    }


class Members:
    """Gzip members of an open file, read piece by piece."""

    def __init__(self, file) -> None:
        self.file, self.size, self.base, self.held = file, file.size(), 0, b""

    def bytes_at(self, at: int, n: int) -> bytes:
        """Up to ``n`` bytes from ``at`` on; one stretch of the file is held."""
        n = min(n, self.size - at)
        if not self.base <= at <= at + n <= self.base + len(self.held):
            self.file.seek(at)
            self.base, self.held = at, self.file.read(max(n, READ_BYTES))
        return self.held[at - self.base : at - self.base + n]

    def begins_at(self, at: int) -> bool:
        """Whether the member at ``at`` decodes to the first line of a record."""
        try:
            return zlib.decompressobj(31).decompress(self.bytes_at(at, FEED_BYTES), 64).startswith(b"WARC/1.")
        except zlib.error:
            return False

    def find(self, at: int, end: int) -> int:
        """The first member that begins in [at, end), else ``end``."""
        while at < end:
            data = self.bytes_at(at, min(end - at, READ_BYTES - len(MAGIC)) + len(MAGIC) - 1)
            k = data.find(MAGIC)
            if k < 0:
                at += max(1, len(data) - len(MAGIC) + 1)
            elif at + k >= end:
                return end
            elif self.begins_at(at + k):
                return at + k
            else:
                at += k + 1
        return end

    def read(self, at: int) -> tuple[bytes, int]:
        """The decoded member at ``at`` and where the next begins."""
        unpacker, out = zlib.decompressobj(31), []
        while not unpacker.eof:
            data = self.bytes_at(at, FEED_BYTES)
            if not data:
                raise zlib.error("a member ends early")
            out.append(unpacker.decompress(data))
            at += len(data) - len(unpacker.unused_data)
        return b"".join(out), at


def records_in(file, start: int, end: int) -> Iterator[dict]:
    """Records that begin in [start, end), even where they end later. After a damaged one, the next header is looked for."""
    members = Members(file)
    at = members.find(start, min(end, members.size))
    while at < min(end, members.size):
        try:
            data, following = members.read(at)
            yield parse_record(data)
            at = following if following >= min(end, members.size) or members.begins_at(following) else members.find(following, min(end, members.size))
        except (zlib.error, ValueError, KeyError, StopIteration):
            at = members.find(at + 1, min(end, members.size))


def write_archives(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", file_bytes: int = 1 << 30) -> DataFrame:
    """Write a record per page to ``*.warc.gz`` files in a new shared folder; (path, size, records) of each.

    Payload: the html in UTF-8 (null: empty). Of equal payloads of at least ``min_bytes`` bytes, the
    page with the largest id is a response, the others revisit it; all others are responses. Equal
    means SHA-256 and length. Each task writes files under names of its own and lists them when
    they are complete, so what a lost task left behind is read by nobody.

    Repeated rows with the largest id are all responses, and so is a page without an id.
    """
    folder = work_folder(pages.sparkSession)
    payload = F.coalesce(F.col(html).cast("string"), F.lit(""))
    keyed = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("html")).select(
        "page_id", "url", "html", F.sha2("html", 256).alias("sha"), F.octet_length("html").alias("n")
    )
    # Grouped by digest and length, then joined by digest alone: both sides of the join are plain
    # exchanges, so a payload that very many pages share is split over tasks.
    newest = keyed.filter(F.col("n") >= min_bytes).groupBy("sha", "n").agg(F.max("page_id").alias("newest")).select("sha", "newest")
    rows = keyed.join(newest, "sha", "left").select(
        "page_id", "url", "html", F.when((F.col("n") >= min_bytes) & (F.col("page_id") < F.col("newest")), F.col("newest")).alias("refers_to")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = file_system(folder)
        out, name, size, count = None, "", 0, 0

        def closed() -> pa.RecordBatch:
            out.close()
            store.move(f"{path}/{name}.part", f"{path}/{name}")
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "size": pa.array([size], pa.int64()), "records": pa.array([count], pa.int64())})

        for batch in batches:
            for i in range(batch.num_rows):
                if out is None:
                    store.create_dir(path, recursive=True)
                    name, size, count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{path}/{name}.part", compression=None)
                page, link, text, refers = (batch.column(c)[i].as_py() for c in range(4))
                body = text.encode()
                size += out.write(data := record_bytes(page, link, body, sha1_base32(body), refers, date)) or len(data)
                count += 1
                if size >= file_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return stored(rows.mapInArrow(write, "path string, size long, records long"))


def read_archives(files: DataFrame, split_bytes: int = 16 << 20) -> DataFrame:
    """Records of the listed (path, size) files, columns as in ``RECORD``.

    Tasks take byte ranges of ``split_bytes``. In its range a task looks for gzip's magic bytes,
    takes the first that decodes to a record's header, and reads on from there: it owns the records
    that begin inside, wherever they end. A damaged record is skipped, and the next one found in the
    same way. Only the piece being read is held, besides one record.
    """
    ranges = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias("start"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for row in batch.to_pylist():
                store, path = file_system(row["path"])
                with store.open_input_file(path) as file:
                    held, size = [], 0
                    for record in records_in(file, row["start"], row["start"] + split_bytes):
                        held.append(record)
                        size += len(record["payload"] or b"") + 200
                        if size >= READ_BYTES:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_pylist(held, schema)

    # A range is much work and little data: the number of tasks is stated, as partitions of so few bytes would be merged.
    n_ranges = files.agg(F.sum(F.ceil(F.greatest(F.col("size"), F.lit(1)) / split_bytes))).first()[0] or 1
    tasks = min(int(n_ranges), TASKS_PER_PARTITION * partitions(files.sparkSession))
    return ranges.repartition(tasks, "path", "start").mapInArrow(read, RECORD)
