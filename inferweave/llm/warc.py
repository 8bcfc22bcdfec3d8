"""Dictionary-compressed WARC archives.

Every archive begins with a skippable frame that holds a Zstandard dictionary, trained on the first records of that
archive (SAMPLE_RECORDS or SAMPLE_BYTES of them at most, and of each at most SAMPLE_PART bytes, so memory is bounded);
then each record is one frame of its own, compressed with the dictionary, so that any record can be read alone, at the
offset that the reader gives. Where the records are too few to train on, pieces of them are trained on, and where even
that is too little, the records' beginnings are the dictionary's content as they are. Archives are written straight to the shared
folder under names that hold the task attempt, and a manifest of the attempts that succeeded says which files count:
tasks can be repeated at any time.

Records with equal payloads of MIN_REVISIT bytes or more are stored once, the others as revisits that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inferweave.llm.common import fresh_path, joined, local_path, materialize, rows_of, ship_package, table

MIN_REVISIT = 1000
#: Bytes of compressed records after which a task begins another archive.
ARCHIVE_BYTES = 128 << 20
SAMPLE_RECORDS, SAMPLE_BYTES, SAMPLE_PART, DICTIONARY_BYTES = 400, 2 << 20, 128 << 10, 64 << 10
LEVEL = 3
SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528
#: A payload that at least so many pages share is joined by broadcast; above SHARES x HEAVY pages, one that a SHARES-th of them share.
HEAVY, SHARES = 2000, 10_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Pages carry no time of their own.
DATE = "1970-01-01T00:00:00Z"


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def page_of(urn: str) -> int | None:
    value = urn[len("<urn:page:") : -1]
    return None if value == "null" else int(value)


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, n: int, refers_to: int | None) -> bytes:
    """One WARC/1.1 record: response, or revisit (without the payload) if refers_to is set. digest: SHA-1 in hex."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if " " < c else f"%{ord(c):02X}" for c in url))
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    head.append(f"X-Payload-Length: {n}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    block = http if revisit else http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode("utf-8") + block + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block; the block must have the length that the headers state."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    n = int(headers["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return headers, rest[:n]


def learn_dictionary(records: list[bytes]):
    """A Zstandard dictionary for records like these, which are one or more."""
    import zstandard

    sample = [r[:SAMPLE_PART] for r in records]
    for part, size in ((None, DICTIONARY_BYTES), (256, DICTIONARY_BYTES), (256, 8 << 10), (64, 1 << 10)):
        pieces = sample if part is None else [r[i : i + part] for r in sample for i in range(0, len(r), part)]
        try:
            return zstandard.train_dictionary(size, pieces, k=256 if part is None else 32, d=8)
        except zstandard.ZstdError:  # too few samples for this size
            continue
    return zstandard.ZstdCompressionDict(b"".join(sample)[:DICTIONARY_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class ArchiveWriter:
    """Writes records to a stream, the dictionary first."""

    def __init__(self, stream):
        self.stream, self.waiting, self.waiting_bytes = stream, [], 0
        self.compressor, self.written, self.records = None, 0, 0

    def add(self, record: bytes) -> None:
        self.records += 1
        if self.compressor:
            self._put(self.compressor.compress(record))
            return
        self.waiting.append(record)
        self.waiting_bytes += len(record)
        if len(self.waiting) >= SAMPLE_RECORDS or self.waiting_bytes >= SAMPLE_BYTES:
            self._begin()

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.written += len(data)

    def _begin(self) -> None:
        import zstandard

        dictionary = learn_dictionary(self.waiting)
        data = dictionary.as_bytes()
        self._put(struct.pack("<II", SKIPPABLE, len(data)) + data)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True)
        for record in self.waiting:
            self._put(self.compressor.compress(record))
        self.waiting = []

    def finish(self) -> None:
        if not self.compressor:
            self._begin()
        self.stream.close()


def read_frames(stream) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each frame but the dictionary's; one frame is in memory at a time."""
    import zstandard

    decompressor, at = zstandard.ZstdDecompressor(), 0
    while start := stream.read(4):
        (magic,) = struct.unpack("<I", start)
        if magic == SKIPPABLE:
            (n,) = struct.unpack("<I", stream.read(4))
            decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(stream.read(n)))
            at += 8 + n
            continue
        if magic != FRAME:
            raise ValueError("not a Zstandard frame")
        flags = stream.read(1)
        single, check = flags[0] >> 5 & 1, flags[0] >> 2 & 1
        size = (not single) + (0, 1, 2, 4)[flags[0] & 3] + ((1 if single else 0), 2, 4, 8)[flags[0] >> 6]
        parts = [start, flags, stream.read(size)]
        last = False
        while not last:
            head = stream.read(3)
            value = int.from_bytes(head, "little")
            last = bool(value & 1)
            parts += [head, stream.read(1 if value >> 1 & 3 == 1 else value >> 3)]
        if check:
            parts.append(stream.read(4))
        frame = b"".join(parts)
        yield at, decompressor.decompress(frame)
        at += len(frame)


def read_record(stream, offset: int) -> bytes:
    """The one record at an offset of a seekable archive: nothing is read but the dictionary and that record's frame."""
    (magic, n) = struct.unpack("<II", stream.read(8))
    dictionary = struct.pack("<II", magic, n) + stream.read(n)
    stream.seek(offset)
    return next(read_frames(_Joined(dictionary, stream)))[1]


class _Joined:
    """Some bytes and then a stream."""

    def __init__(self, first: bytes, stream):
        self.first, self.stream = io.BytesIO(first), stream

    def read(self, n: int) -> bytes:
        out = self.first.read(n)
        return out if out or not n else self.stream.read(n)


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes pages (page_id, url, html, refers_to) to archives in folder; the manifest: archive, records, bytes."""
    ship_package(pages.sparkSession)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task = TaskContext.get()
        system, base = local_path(folder)
        system.create_dir(base, recursive=True)
        writer, name, done = None, "", []
        for columns in rows_of(batches, "page_id", "url", "html", "refers_to"):
            for page_id, url, html, refers_to in zip(*columns, strict=True):
                if writer is None:
                    name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(done)}-{uuid.uuid4().hex[:8]}.warc.zst"
                    # the records are compressed already; by its name alone the file would be compressed once more
                    writer = ArchiveWriter(system.open_output_stream(f"{base}/{name}", compression=None))
                payload = (html or "").encode("utf-8")
                writer.add(build_record(page_id, url, payload, hashlib.sha1(payload).hexdigest(), len(payload), refers_to))
                if writer.written >= ARCHIVE_BYTES:
                    writer.finish()
                    done.append((f"{folder}/{name}", writer.records, writer.written))
                    writer = None
        if writer is not None:
            writer.finish()
            done.append((f"{folder}/{name}", writer.records, writer.written))
        cols = list(zip(*done, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["archive", "records", "bytes"])

    out = pages.select("page_id", "url", "html", "refers_to").mapInArrow(run, "archive string, records bigint, bytes bigint")
    return materialize(out, "manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """A row per record: page_id, payload_bytes, payload_digest, record_type, refers_to, archive, offset. Payloads must match their digests."""
    ship_package(manifest.sparkSession)

    def rows(uri: str) -> Iterator[tuple]:
        system, path = local_path(uri)
        with system.open_input_stream(path, compression=None, buffer_size=1 << 20) as stream:
            for offset, record in read_frames(stream):
                headers, block = parse_record(record)
                digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                n, kind = int(headers["X-Payload-Length"]), headers["WARC-Type"]
                if kind == "response":
                    payload = block.partition(b"\r\n\r\n")[2]
                    if len(payload) != n or hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"{headers['WARC-Record-ID']} in {uri} doesn't match its digest")
                refers_to = page_of(headers["WARC-Refers-To"]) if kind == "revisit" else None
                yield page_of(headers["WARC-Record-ID"]), n, digest, kind, refers_to, uri, offset

    types = ("bigint", "bigint", "string", "string", "bigint", "string", "bigint")
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive", "offset")

    def run(batches):
        import pyarrow as pa

        kinds = [pa.int64() if t == "bigint" else pa.string() for t in types]
        batch = lambda out: pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=list(names))
        for (uris,) in rows_of(batches, "archive"):
            for uri in uris:
                out = []
                for row in rows(uri):
                    out.append(row)
                    if len(out) == 5000:
                        yield batch(out)
                        out = []
                if out:
                    yield batch(out)

    files = manifest.select("archive").repartition(max(1, manifest.count()))
    return files.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in zip(names, types, strict=True)))


def with_revisits(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) with refers_to: the largest page_id of equal payloads of MIN_REVISIT bytes or more, null for that page itself.

    Only payloads that occur twice or more are joined, by digest. Those that very many pages share are broadcast
    (SHARES entries at most), so that no task gets all of their pages.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    keyed = pages.select("page_id", "url", "html", F.sha2(payload, 256).alias("_sha"), F.octet_length(payload).alias("_n"))
    repeated = keyed.where(F.col("_n") >= MIN_REVISIT).groupBy("_sha").agg(F.max("page_id").alias("_keeper"), F.count("*").alias("_m")).where("_m > 1")
    repeated = materialize(repeated, "repeated")
    heavy = max(HEAVY, (repeated.agg(F.sum("_m")).first()[0] or 0) // SHARES)
    out = joined(keyed, repeated.withColumnRenamed("_m", "rows"), ["_sha"], ["page_id", "url"], "left", heavy)
    return out.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("_keeper")), F.col("_keeper")).alias("refers_to"))


def checked_revisits(records: DataFrame) -> DataFrame:
    """records (of read_archives) if every revisit has the length and digest of a response that it refers to; else it is an error."""
    key = ["payload_bytes", "payload_digest"]
    claimed = records.where("record_type = 'revisit'").select(F.col("refers_to").alias("page_id"), *key).distinct()
    held = records.where("record_type = 'response'").select("page_id", *key)
    if lost := claimed.join(held, ["page_id", *key], "left_anti").take(1):
        raise ValueError(f"a revisit refers to {lost[0].page_id}, which has no response with its digest")
    return records


def archive_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes pages to archives and reads these back, payloads checked against digests and revisits against what they refer to: a row per page.

    Null html is the empty payload. Rows that repeat a page_id are records of their own; where they hold the largest
    page_id of their payload, each is a response. A null page_id is less than any other and refers to the largest like
    the rest; payloads that only such rows have are responses. A null url gives a record without a target. No rows:
    no archives and no rows.
    """
    folder = folder or fresh_path(pages.sparkSession, "warc")
    return checked_revisits(materialize(read_archives(write_archives(with_revisits(pages), folder)), "records"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through dictionary-compressed archives in the shared folder."""
    return archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
k AS (SELECT payload, max(page_id) AS keeper FROM p WHERE strlen(payload) >= 1000 GROUP BY payload HAVING count(*) > 1)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, sha1(payload) AS payload_digest,
       CASE WHEN keeper IS NOT NULL AND page_id IS DISTINCT FROM keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM keeper THEN keeper END AS refers_to
FROM p LEFT JOIN k USING (payload)
"""
