"""A deterministic sharded writer of WARC archives, and their reader.

Records are range-sorted by page_id. Each range is written by one task as gzip members, one
per record, and rolled into a new file when the compressed size reaches a bound. Headers,
lengths and digests are made anew for every record; dates and record names follow from the
data, so the same table gives the same bytes. A file is written under a temporary name and
renamed when complete; the manifest, which Spark commits as a table, names the files that count.

Records with equal payloads of a least size are written once: that with the largest page_id
is the response, the others are revisits that name it.

Defined results: a null html is an empty payload. Rows without page_id come first and refer
to a page like others; nothing refers to them: copies that all lack page_id are all responses.
Rows with equal page_id and payload are all responses if theirs is the largest. A null url is
empty. Other columns play no part. An empty table gives no files.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resolver_audit.llm.storage import broadcast_if_small, file_system, shared_folder, stored

#: Fixed values of the WARC 1.1 format.
_VERSION = b"WARC/1.1\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2000-01-01T00:00:00Z"

SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def sha1_label(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_name(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def page_of(name: str) -> int | None:
    number = name.removeprefix("<urn:x-page:").removesuffix(">")
    return None if number == "none" else int(number)


def clean(url: str | None) -> str:
    """A url as a header value: no line ends, percent signs for what is not printable ASCII."""
    return "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record, before compression."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if refers_to is not None else http + payload
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": record_name(page_id),
        "WARC-Date": _DATE,
        "WARC-Target-URI": clean(url),
        "WARC-Payload-Digest": sha1_label(payload),
        "WARC-Block-Digest": sha1_label(block),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(block),
    }
    if refers_to is not None:
        head |= {"WARC-Refers-To": record_name(refers_to), "WARC-Profile": _PROFILE}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return _VERSION + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def compressed(data: bytes, level: int) -> bytes:
    """One gzip member without a time stamp."""
    out = zlib.compressobj(level, zlib.DEFLATED, 31)
    return out.compress(data) + out.flush()


def members(source, piece: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a file, each decompressed; a member is held at a time."""
    inflate, held = zlib.decompressobj(31), []
    while data := source.read(piece):
        while data:
            held.append(inflate.decompress(data))
            data = b""
            if inflate.eof:
                yield b"".join(held)
                data, inflate, held = inflate.unused_data, zlib.decompressobj(31), []
    if held and any(held):
        raise ValueError("the last record is not complete")


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record; a wrong length or block digest is an error."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] + "\r\n" != _VERSION.decode():
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n" or sha1_label(block) != headers["WARC-Block-Digest"]:
        raise ValueError("length or digest of a record does not match")
    return headers, block


def row_of(data: bytes) -> tuple[int | None, int, str, str, int | None]:
    """page_id, payload_bytes, payload_digest, record_type, refers_to."""
    headers, block = parsed(data)
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(http.rpartition(b"Content-Length: ")[2])
    digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = headers["WARC-Type"]
    if kind == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("length or digest of a payload does not match")
    refers_to = page_of(headers["WARC-Refers-To"]) if kind == "revisit" else None
    return page_of(headers["WARC-Record-ID"]), length, digest, kind, refers_to


@dataclass(frozen=True)
class WarcArchive:
    """least: bytes of a payload from which equal ones are written once. roll: compressed bytes of a
    file. level: of compression."""

    least: int = 1000
    roll: int = 64 << 20
    level: int = 6

    def targets(self, pages: DataFrame) -> DataFrame:
        """(copy_digest, copy_bytes, target) of payloads that several rows share."""
        payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
        return (
            pages.select("page_id", F.sha1(payload).alias("copy_digest"), F.octet_length(payload).alias("copy_bytes"))
            .filter(F.col("copy_bytes") >= self.least)
            .groupBy("copy_digest", "copy_bytes")
            .agg(F.max(F.col("page_id").cast("long")).alias("target"), F.count(F.lit(1)).alias("n"))
            .filter("n > 1")
            .drop("n")
        )

    def write(self, pages: DataFrame, folder: str) -> DataFrame:
        """Writes the archive; returns the manifest (file, first, n_records, n_bytes, sha1)."""
        targets = broadcast_if_small(stored(self.targets(pages), "warc-targets"))
        payload = F.coalesce(F.col("html"), F.lit(""))
        plain = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("html"))
        named = plain.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn(
            "bytes", F.octet_length("html")
        )
        same = (F.col("digest") == F.col("copy_digest")) & (F.col("bytes") == F.col("copy_bytes"))
        revisit = F.when(~F.col("target").eqNullSafe(F.col("page_id")), F.col("target"))
        ordered = (
            named.join(targets, same, "left")
            .select("page_id", "url", "html", "digest", revisit.alias("refers_to"))
            .repartitionByRange(F.col("page_id").asc_nulls_first())
            .sortWithinPartitions(F.col("page_id").asc_nulls_first(), "digest", "url")
            .drop("digest")
        )
        system, path = file_system(folder)
        system.create_dir(path, recursive=True)
        roll, level = self.roll, self.level

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shard = Shard(folder, roll, level)
            for batch in batches:
                for at in range(batch.num_rows):
                    row = {n: batch.column(n)[at].as_py() for n in ("page_id", "url", "html", "refers_to")}
                    if (done := shard.add(row)) is not None:
                        yield done
            if (done := shard.close()) is not None:
                yield done

        return stored(
            ordered.mapInArrow(write, "file string, first string, n_records long, n_bytes long, sha1 string"), "warc-manifest"
        )

    def read(self, manifest: DataFrame, folder: str) -> DataFrame:
        """A row for each record of the files that the manifest names."""

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            system, path = file_system(folder)
            for batch in batches:
                for name, n in zip(batch.column("file").to_pylist(), batch.column("n_records").to_pylist(), strict=True):
                    rows, seen = [], 0
                    with system.open_input_stream(f"{path}/{name}", compression=None) as source:
                        for data in members(source):
                            rows.append(row_of(data))
                            seen += 1
                            if len(rows) == 1000:
                                yield _batch(rows)
                                rows = []
                    if seen != n:
                        raise ValueError(f"{name} has {seen} records and not {n}")
                    yield _batch(rows)

        files = max(1, manifest.count())
        return manifest.repartition(files).mapInArrow(read, SCHEMA)

    def round_trip(self, pages: DataFrame) -> DataFrame:
        folder = shared_folder(pages.sparkSession, "warc")
        return self.read(self.write(pages, folder), folder)


class Shard:
    """The files of one range of records."""

    def __init__(self, folder: str, roll: int, level: int):
        self.system, self.path = file_system(folder)
        self.roll, self.level, self.out = roll, level, None

    def add(self, row: dict) -> pa.RecordBatch | None:
        """A manifest row when this record began a new file and so ended the last."""
        data = compressed(record(row["page_id"], row["url"], row["html"].encode(), row["refers_to"]), self.level)
        done = self.close() if self.out is not None and self.size + len(data) > self.roll else None
        if self.out is None:
            self.first = "none" if row["page_id"] is None else f"{row['page_id']:020d}"
            self.temporary = f"{self.path}/.tmp-{uuid.uuid4().hex}"
            self.out = self.system.open_output_stream(self.temporary, compression=None)
            self.size = self.n = 0
            self.sha1 = hashlib.sha1()
        self.out.write(data)
        self.sha1.update(data)
        self.size += len(data)
        self.n += 1
        return done

    def close(self) -> pa.RecordBatch | None:
        if self.out is None:
            return None
        self.out.close()
        self.out = None
        # Rolled files of one page_id (repeated rows) differ in content, so their digest is part of the name.
        name = f"pages-{self.first}-{self.sha1.hexdigest()[:12]}.warc.gz"
        self.system.move(self.temporary, f"{self.path}/{name}")
        values = ([name], [self.first], [self.n], [self.size], [self.sha1.hexdigest()])
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
        arrays = [pa.array(v, k) for v, k in zip(values, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names=["file", "first", "n_records", "n_bytes", "sha1"])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    columns = zip(*rows, strict=True) if rows else ((),) * 5
    arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return pa.RecordBatch.from_arrays(arrays, names=names)
