"""WARC archives compressed by a Zstandard dictionary that stands in front.

Each task writes one archive: the dictionary, trained on the first megabytes of
records that the task gets (rows are dealt by hash of their payload, so these are
a random part of it), goes into a skippable frame at the head; each record is
then a frame of its own, readable by its offset. A file is written under a name
of its own attempt and renamed, so a task that runs again replaces its archive
and readers see whole files only.

Payloads of `least` bytes or more that are equal are stored once: the record of
the smallest page_id is a response, the others are revisits that name it. Digest
and length in their headers are those of the full payload.

A null html is an empty payload; smaller payloads are never revisits. Rows that
repeat the smallest page_id of a payload are all responses. A null page_id is
written without an id and is a revisit if another page has the payload. A null
url is empty. Control characters of a url are escaped. Empty tables write no
archive. Other columns are not written.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sunlattice.llm.common import prepare, shared_dir

#: Fixed value: magic number of the skippable frame that holds a dictionary.
DICTIONARY_MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def decide(pages: DataFrame, least: int = 100) -> DataFrame:
    """page_id, url, html, digest, size, refers_to of each row of pages; refers_to null: a response."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"), F.octet_length(html).cast("long").alias("size"))
    copies = rows.filter(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    joined = rows.join(copies, "digest", "left")
    return joined.select("page_id", "url", "html", "digest", "size", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page_id, url, payload: bytes, digest: str, size: int, refers_to) -> bytes:
    """One WARC record; a revisit has the HTTP headers only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(page_id, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or '', safe=''':/?#[]@!$&'()*+,;=%~-._''')}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(samples: list[bytes], size: int) -> zstandard.ZstdCompressionDict:
    """Trained on the samples, or their raw bytes where there are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[:size].ljust(8, b"\0"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class Archive:
    """Writes records to an open file: dictionary frame, then a frame a record."""

    def __init__(self, out, train_bytes: int, dict_bytes: int, level: int):
        self.out, self.train_bytes, self.dict_bytes, self.level = out, train_bytes, dict_bytes, level
        self.held: list[bytes] = []
        self.size = 0
        self.press = None

    def add(self, rec: bytes) -> None:
        if self.press is None:
            self.held.append(rec)
            self.size += len(rec)
            if self.size >= self.train_bytes:
                self._begin()
        else:
            self.out.write(self.press.compress(rec))

    def _begin(self) -> None:
        # Long records count by their first part in training only.
        d = dictionary([r[: 1 << 16] for r in self.held], self.dict_bytes)
        raw = d.as_bytes()
        self.out.write(struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw)
        self.press = zstandard.ZstdCompressor(level=self.level, dict_data=d, write_checksum=True)
        for r in self.held:
            self.out.write(self.press.compress(r))
        self.held = []

    def close(self) -> None:
        if self.press is None and self.held:
            self._begin()


def write(pages: DataFrame, path: str, least: int = 100, train_bytes: int = 1 << 20, dict_bytes: int = 1 << 15, level: int = 3) -> DataFrame:
    """Write archives to the folder `path`, seen by all executors; a row an archive: file, records, bytes."""
    prepare(pages.sparkSession)

    def run(batches):
        where, folder = fs.FileSystem.from_uri(path)
        context = TaskContext.get()
        final = f"{folder}/part-{context.partitionId():06d}.warc.zst"
        own = f"{final}.{context.taskAttemptId()}"
        archive, n = None, 0
        for batch in batches:
            for page_id, url, html, digest, size, refers in zip(*(c.to_pylist() for c in batch.columns)):
                if archive is None:
                    where.create_dir(folder, recursive=True)
                    out = where.open_output_stream(own, compression=None)
                    archive = Archive(out, train_bytes, dict_bytes, level)
                archive.add(record(page_id, url, html.encode(), digest, size, refers))
                n += 1
        if archive is not None:
            archive.close()
            length = out.tell()
            out.close()
            where.move(own, final)
            yield pa.RecordBatch.from_arrays([pa.array([final.rsplit("/", 1)[1]]), pa.array([n], pa.int64()), pa.array([length], pa.int64())], ["file", "records", "bytes"])

    return decide(pages, least).mapInArrow(run, "file string, records long, bytes long")


def records(stream):
    """Headers (a dict) and block of each record of an open archive, one at a time."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != DICTIONARY_MAGIC:
        raise ValueError("the archive does not begin with a dictionary frame")
    raw = stream.read(size)
    kind = zstandard.DICT_TYPE_FULLDICT if raw[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    press = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=kind))
    text = press.stream_reader(stream, read_across_frames=True)
    held = b""
    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            more = text.read(1 << 16)
            if not more:
                if held:
                    raise ValueError("the archive ends within a record")
                return
            held += more
        lines = held[:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        head = dict(x.split(": ", 1) for x in lines[1:])
        need = end + 4 + int(head["Content-Length"]) + 4
        parts, have = [held], len(held)
        while have < need:
            more = text.read(max(1 << 16, need - have))
            if not more:
                raise ValueError("the archive ends within a record")
            parts.append(more)
            have += len(more)
        held = b"".join(parts)
        yield head, held[end + 4 : need - 4]
        held = held[need:]


def read(spark: SparkSession, path: str, files: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of each record of the archives (column file).

    Payloads of responses are hashed again and must agree with their headers.
    """

    def run(batches):
        where, folder = fs.FileSystem.from_uri(path)
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                with where.open_input_stream(f"{folder}/{name}", compression=None) as stream:
                    for head, block in records(stream):
                        http, payload = block.split(b"\r\n\r\n", 1)
                        size = int(http.rsplit(b"Content-Length: ", 1)[1])
                        digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                        if head["WARC-Type"] == "response" and (len(payload), hashlib.sha256(payload).hexdigest()) != (size, digest):
                            raise ValueError(f"{name}: payload of {head['WARC-Record-ID']} is damaged")
                        page, refers = (int(head[k]) if k in head else None for k in ("X-Page-ID", "X-Refers-To-Page-ID"))
                        rows.append((page, head["WARC-Target-URI"], size, digest, head["WARC-Type"], refers))
                        if len(rows) >= 4096:
                            yield _batch(rows, names)
                            rows = []
                yield _batch(rows, names)

    return files.select("file").mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)


def round_trip(pages: DataFrame, least: int = 100) -> DataFrame:
    """Write the pages to a new folder of the shared place and read all archives back."""
    spark = pages.sparkSession
    path = shared_dir(spark, "warc")
    written = write(pages, path, least)
    # A row an archive; archives are read in parallel.
    files = sorted(r.file for r in written.select("file").collect())
    listed = spark.createDataFrame([(f,) for f in files], "file string")
    return read(spark, path, listed.repartition(max(1, len(files)))).drop("url")
