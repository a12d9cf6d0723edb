"""WARC archives: a writer and a sequential reader of gzip members.

Writing: every record is one gzip member. Of equal payloads of at least ``min_revisit`` bytes the one with the largest
page id becomes a response, the others become revisits that name it; the choice is one grouping over digests, which
is combined before the shuffle, and a join. Each task writes its own archives under a name that no other attempt
uses; only archives listed in the committed manifest count, so a lost or repeated task leaves no double records.

Reading: the manifest's archives are dealt over the tasks; a task reads a file in blocks, unpacks member by member
with one incremental zlib object each, frames the record by its content length and checks the digests of block and
payload while it reads. A payload is never held unless asked for.

Defined cases: a null html is an empty payload; a null page id stays null and never refers to itself; rows with the
same largest page id are all responses; an empty table gives no archive and no row; other columns are not written.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tabloom.sources.runtime import scratch_path

MIN_REVISIT = 1000
#: A task begins a new archive after so many packed bytes.
ARCHIVE_BYTES = 64 << 20
LEVEL = 6
BLOCK = 1 << 18
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_control = re.compile(r"[\x00-\x20\x7f]")


def open_file(path: str, mode: str):
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path)
    if mode == "r":
        return system.open_input_stream(place, compression=None)
    system.create_dir(place.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(place, compression=None)


def digest_label(data_sha1: bytes) -> str:
    return "sha1:" + base64.b32encode(data_sha1).decode()


# ---- one record -------------------------------------------------------------------------------


def record_bytes(page_id, url: str | None, payload: bytes, refers_to=None, revisit: bool = False) -> bytes:
    """A response record (HTTP head and payload) or a revisit record (HTTP head only)."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>",
        f"WARC-Date: {DATE}", f"WARC-Block-Digest: {digest_label(hashlib.sha1(block).digest())}",
        f"WARC-Payload-Digest: {digest_label(hashlib.sha1(payload).digest())}", "Content-Type: application/http; msgtype=response"]
    if url:
        lines.append("WARC-Target-URI: " + _control.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if page_id is not None:
        lines.append(f"Page-Id: {page_id}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"Refers-To-Page-Id: {refers_to}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def pack(record: bytes, level: int = LEVEL) -> bytes:
    """One gzip member."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


class Member:
    """The bytes of one gzip member, unpacked as they are asked for."""

    def __init__(self, stream, first: bytes):
        self.stream, self.raw, self.z, self.data = stream, first, zlib.decompressobj(31), b""

    def more(self) -> bool:
        """Unpacks another stretch; false at the member's end."""
        while not self.z.eof:
            if not self.raw:
                self.raw = self.stream.read(BLOCK)
                if not self.raw:
                    raise ValueError("the archive ends inside a member")
            got = self.z.decompress(self.raw, BLOCK)
            self.raw = self.z.unconsumed_tail if not self.z.eof else self.z.unused_data
            if got:
                self.data += got
                return True
        return False

    def until(self, mark: bytes) -> bytes:
        """What stands before the mark, however long it is; a member without it is an error."""
        seen = 0
        while (at := self.data.find(mark, seen)) < 0:
            seen = max(0, len(self.data) - len(mark) + 1)
            if not self.more():
                raise ValueError("a head without end")
        out, self.data = self.data[:at], self.data[at + len(mark):]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.data and not self.more():
                raise ValueError("the record is shorter than its content length")
            out, self.data = self.data[:n], self.data[n:]
            n -= len(out)
            yield out


def fields_of(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.decode("utf-8").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def read_records(stream, keep_payload: bool = False) -> Iterator[dict]:
    """All records in order: their head fields, ``payload_bytes``, ``payload_sha1`` and, if asked for, ``payload``."""
    left = b""
    while left or (left := stream.read(BLOCK)):
        member = Member(stream, left)
        head = member.until(b"\r\n\r\n")
        if not head.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        fields = fields_of(head)
        n = int(fields["content-length"])
        block, payload, kept = hashlib.sha1(), hashlib.sha1(), []
        http, seen, in_payload = b"", 0, False
        for part in member.take(n):
            block.update(part)
            if not in_payload:
                http += part
                at = http.find(b"\r\n\r\n")
                if at < 0:
                    continue
                in_payload, part, http = True, http[at + 4:], http[:at]
            payload.update(part)
            seen += len(part)
            if keep_payload:
                kept.append(part)
        for _ in member.take(4):
            pass
        if member.data or member.more():
            raise ValueError("a member holds more than its record")
        left = member.raw
        if fields.get("warc-block-digest", digest_label(block.digest())) != digest_label(block.digest()):
            raise ValueError("the block does not match its digest")
        said = fields.get("warc-payload-digest")
        if fields["warc-type"] == "revisit":
            seen, sha1 = int(fields_of(http)["content-length"]), base64.b32decode(said.removeprefix("sha1:"))
        else:
            sha1 = payload.digest()
            if said and said != digest_label(sha1):
                raise ValueError("the payload does not match its digest")
        yield fields | {"payload_bytes": seen, "payload_sha1": sha1.hex()} | ({"payload": b"".join(kept)} if keep_payload else {})


# ---- tables -----------------------------------------------------------------------------------


def with_revisits(pages: DataFrame, min_revisit: int = MIN_REVISIT, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page id, url, payload and the page id that a revisit refers to (null: response)."""
    payload = F.encode(F.coalesce(F.col(f"`{html}`"), F.lit("")), "UTF-8")
    key = F.sha2(payload, 256)
    large = F.octet_length(payload) >= min_revisit
    heads = (pages.select(F.col(f"`{page_id}`").alias("_head"), key.alias("_key")).where(large)
             .groupBy("_key").agg(F.max("_head").alias("_head"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"))
    rows = pages.select(F.col(f"`{page_id}`").alias("_id"), F.col(f"`{url}`").cast("string").alias("_url"), payload.alias("_payload"), F.when(large, key).alias("_key"))
    head = F.when(F.col("_id").isNull() | (F.col("_id") != F.col("_head")), F.col("_head"))
    return rows.join(heads, "_key", "left").select("_id", "_url", "_payload", head.alias("_refers"))


def write_archives(pages: DataFrame, folder: str | None = None, min_revisit: int = MIN_REVISIT, archive_bytes: int = ARCHIVE_BYTES, **names) -> DataFrame:
    """Writes the archives and returns the committed manifest: path, n_records, n_bytes."""
    import pyarrow as pa

    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")

    def write(batches):
        path, out, n, size = None, None, 0, 0
        for batch in batches:
            for i in range(batch.num_rows):
                page, url, payload, refers = (c[i].as_py() for c in batch.columns)
                if out is None:
                    path, n, size = f"{folder}/archives/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = open_file(path, "w")
                made = pack(record_bytes(page, url, payload, refers, refers is not None))
                out.write(made)
                n, size = n + 1, size + len(made)
                if size >= archive_bytes:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"path": [path], "n_records": [n], "n_bytes": [size]})
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "n_records": [n], "n_bytes": [size]})

    made = with_revisits(pages, min_revisit, **names).mapInArrow(write, "path string, n_records bigint, n_bytes bigint")
    made.write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def read_archives(manifest: DataFrame, id_type: str = "bigint") -> DataFrame:
    """One row per record of the listed archives, in no particular order."""
    import pyarrow as pa

    def read(batches):
        for batch in batches:
            for path, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, n = [], 0
                with open_file(path, "r") as stream:
                    for r in read_records(stream):
                        rows.append((r.get("page-id"), r["payload_bytes"], r["payload_sha1"], r["warc-type"], r.get("refers-to-page-id")))
                        n += 1
                        if len(rows) >= 10_000:
                            yield as_batch(rows)
                            rows = []
                if n != expected:
                    raise ValueError(f"{path}: {n} records, {expected} written")
                yield as_batch(rows)

    def as_batch(rows):
        cells = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], ["page", "payload_bytes", "payload_digest", "record_type", "refers"])

    # One task for each archive: their number is known, so nothing is merged because the list itself is small.
    place = F.row_number().over(Window.orderBy("path")) - 1
    dealt = manifest.select("path", "n_records", place.alias("_place")).repartitionById(max(1, manifest.count()), F.col("_place")).drop("_place")
    found = dealt.mapInArrow(
        read, "page string, payload_bytes bigint, payload_digest string, record_type string, refers string")
    return found.select(F.col("page").cast(id_type).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers").cast(id_type).alias("refers_to"))


def round_trip(spark: SparkSession, pages: DataFrame, **options) -> DataFrame:
    """Writes the pages as archives in the shared folder and reads them back."""
    return read_archives(write_archives(pages, **options), pages.schema[options.get("page_id", "page_id")].dataType.simpleString())
