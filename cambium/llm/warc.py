"""WARC archives in Zstandard frames: one frame for each record, the dictionary in a leading skippable frame.

Tasks write archives to the shared folder under names of their own attempt, and
the table that write_archives() returns names those of the attempts that counted:
what a task that ran again or was lost has left is never mistaken for a part of
the result. Tasks open the archives that the table names, decode them frame by
frame, and compare the records of each with the number written. A trailing
skippable frame has the number of records too, so an archive that is cut anywhere
is told from a whole one.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, maybe_in, read, scratch, sliced, utf8

SKIPPABLE = 0x184D2A5D
#: The frame that ends an archive: the number of its records in 8 bytes.
COUNT = 0x184D2A5E
FRAME = 0xFD2FB528
LEVEL = 3
DICTIONARY_BYTES = 16 << 10
#: Records of an archive that its dictionary is trained on.
SAMPLE = 200
#: An archive is closed once it is at least so long.
ARCHIVE_BYTES = 16 << 20
#: Bytes of an archive given to the decoder at once; what follows a frame in them is looked at again.
READ_BYTES = 16 << 10
#: Payloads of repeated content up to so many are broadcast, more are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Shares into which the pages of a repeated payload are dealt.
SALTS = 16
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")

RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


class WarcError(ValueError):
    """An archive that doesn't hold to the format."""


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id} {digest}')}>"


def encode_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response with its payload, or, with `refers_to`, a revisit without; the HTTP header has the payload's length in both."""
    digest, revisit = digest_of(payload), refers_to is not None
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if not revisit:
        block += payload
    header = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{digest_of(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        header.append("WARC-Target-URI: " + re.sub(r"[\x00-\x1f\x7f%]", lambda m: f"%{ord(m[0]):02X}", url))
    if page_id is not None:
        header.append(f"X-Page-Id: {page_id}")
    if revisit:
        header += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-Id: {refers_to}"]
    return "\r\n".join(header).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers_of(data: bytes) -> tuple[str, dict[str, str]]:
    try:
        first, *lines = data.decode().split("\r\n")
    except UnicodeDecodeError as error:
        raise WarcError("headers aren't UTF-8") from error
    pairs = [line.partition(": ") for line in lines]
    if not all(colon for _, colon, _ in pairs):
        raise WarcError("a header line has no colon")
    return first, {name.lower(): value for name, _, value in pairs}


def number_of(header: dict[str, str], name: str) -> int | None:
    """A header's number, None without it."""
    value = header.get(name)
    if value is not None and not re.fullmatch(r"-?[0-9]{1,19}", value):
        raise WarcError(f"{name} isn't a number: {value[:40]}")
    return None if value is None else int(value)


def decode_record(data: bytes) -> tuple:
    """The fields of RECORD, after checking version, headers, lengths and digests; a revisit has no payload."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    version, header = headers_of(head)
    if not gap or version not in ("WARC/1.0", "WARC/1.1"):
        raise WarcError("not a WARC record")
    if missing := [n for n in ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest") if n not in header]:
        raise WarcError(f"missing headers: {missing}")
    length = number_of(header, "content-length")
    block = rest[:length]
    if length < 0 or len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise WarcError(f"Content-Length is {length}, but {len(rest) - 4} bytes follow")
    if "warc-block-digest" in header and header["warc-block-digest"] != f"sha1:{digest_of(block)}":
        raise WarcError("the block's digest differs")
    http, gap, payload = block.partition(b"\r\n\r\n")
    size = number_of(headers_of(http)[1], "content-length")
    if size is None or size < 0:
        raise WarcError("the HTTP header has no length")
    kind, digest = header["warc-type"], header["warc-payload-digest"].removeprefix("sha1:")
    if kind not in ("response", "revisit") or not gap:
        raise WarcError(f"a record of type {kind}")
    if kind == "response" and (len(payload) != size or digest_of(payload) != digest):
        raise WarcError("the payload's length or digest differs")
    page_id, refers_to = number_of(header, "x-page-id"), number_of(header, "x-refers-to-page-id")
    url = header.get("warc-target-uri")
    url = None if url is None else re.sub(r"%(0[0-9A-F]|1[0-9A-F]|7F|25)", lambda m: chr(int(m[1], 16)), url)
    return page_id, url, size, digest, kind, refers_to, payload if kind == "response" else None


class ArchiveWriter:
    """The bytes of archives: each gets its dictionary from its own first records."""

    def __init__(self):
        self.waiting: list[bytes] = []
        self.parts: list[bytes] = []
        self.size = 0
        self.records = 0
        self.compressor: zstandard.ZstdCompressor | None = None

    def add(self, record: bytes) -> None:
        self.records += 1
        if self.compressor is None:
            self.waiting.append(record)
            if len(self.waiting) >= SAMPLE:
                self._begin()
        else:
            self._frame(record)

    def _frame(self, record: bytes) -> None:
        frame = self.compressor.compress(record)
        self.parts.append(frame)
        self.size += len(frame)

    def _begin(self) -> None:
        try:
            trained = zstandard.train_dictionary(DICTIONARY_BYTES, self.waiting, level=LEVEL)
        except zstandard.ZstdError:  # too few or too short records to train on
            trained = None
        if trained is not None:
            data = trained.as_bytes()
            self.parts.append(struct.pack("<II", SKIPPABLE, len(data)) + data)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_checksum=True, write_content_size=True)
        for record in self.waiting:
            self._frame(record)
        self.waiting = []

    def close(self) -> bytes:
        if self.waiting:
            self._begin()
        data = b"".join([*self.parts, struct.pack("<IIQ", COUNT, 8, self.records)])
        self.__init__()
        return data


def read_archive(data: bytes, counted: bool = True) -> Iterator[bytes]:
    """The records of an archive, one for each frame; other skippable frames are passed over.

    WarcError if a frame is cut or broken, if the last frame's number of
    records differs, or, with `counted`, if there is no such frame at the end.
    """
    decompressor, view, at, first = zstandard.ZstdDecompressor(), memoryview(data), 0, True
    records, ended = 0, False
    while at < len(data):
        magic = int.from_bytes(data[at : at + 4], "little")
        if 0x184D2A50 <= magic <= 0x184D2A5F:
            content = at + 8
            end = content + int.from_bytes(data[at + 4 : content], "little")
            if len(data) < content or len(data) < end:
                raise WarcError("a skippable frame is cut short")
            if first and magic == SKIPPABLE:
                decompressor = _with_dictionary(data[content:end])
            if magic == COUNT:
                if ended or end - content != 8 or int.from_bytes(data[content:end], "little") != records:
                    raise WarcError(f"the archive doesn't have {records} records")
                ended = True
            at = end
        elif magic == FRAME:
            if ended:
                raise WarcError("records after the last frame")
            one, parts = decompressor.decompressobj(), []
            try:
                while not one.eof:
                    if at >= len(data):
                        raise WarcError("a frame is cut short")
                    parts.append(one.decompress(view[at : at + READ_BYTES]))
                    at += READ_BYTES
            except zstandard.ZstdError as error:
                raise WarcError("a frame is broken") from error
            at = min(at, len(data)) - len(one.unused_data)
            records += 1
            yield b"".join(parts)
        else:
            raise WarcError(f"no frame at byte {at}")
        first = False
    if counted and not ended:
        raise WarcError("the archive has no end")


def _with_dictionary(raw: bytes) -> zstandard.ZstdDecompressor:
    """A decompressor with a dictionary, itself compressed or not."""
    try:
        if raw[:4] == struct.pack("<I", FRAME):
            raw = zstandard.ZstdDecompressor().decompress(raw)
        return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    except zstandard.ZstdError as error:
        raise WarcError("the dictionary is broken") from error


def choose_responses(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", html_col: str = "html", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """`pages` with __refers: for records that revisit another with an equal payload, its id; else null.

    Beyond `broadcast_rows` repeated payloads, pages whose payload is surely not
    among them stay where they are, by a filter of bounded size; the others meet
    their group by digest and a salt, so pages of one payload are spread over tasks.
    """
    hashed = pages.withColumn("__digest", F.sha1(F.coalesce(F.col(html_col), F.lit("")).cast("binary")))
    groups = cut(
        hashed.where(F.octet_length(F.coalesce(F.col(html_col), F.lit(""))) >= least_bytes)
        .groupBy("__digest").agg(F.max(id_col).alias("__last"), F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n")
    )
    if groups.limit(broadcast_rows + 1).count() <= broadcast_rows:
        found = hashed.join(F.broadcast(groups), "__digest", "left")
    else:
        asked = maybe_in(hashed, F.xxhash64("__digest"), groups.select(F.xxhash64("__digest").alias("__group")), "__group")
        salted = groups.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = asked.where("__maybe").drop("__maybe").withColumn("__salt", F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int")).join(salted, ["__digest", "__salt"], "left").drop("__salt")
        found = met.unionByName(asked.where("NOT __maybe").drop("__maybe"), allowMissingColumns=True)
    return found.withColumn("__refers", F.when(F.col(id_col) < F.col("__last"), F.col("__last"))).drop("__digest", "__last")


def arrow_uri(folder: str) -> str:
    """A folder as Arrow names it, of a path or of a URI as Spark names it."""
    scheme, colon, rest = folder.partition(":")
    if not colon or "/" in scheme:
        return f"file://{folder}"
    if scheme == "file":
        return f"file:///{rest.lstrip('/')}"
    return f"{ {'s3a': 's3', 's3n': 's3'}.get(scheme, scheme)}:{rest}"


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record for each row to archives in `folder`; one row (path, records, bytes) for each archive.

    Of rows with equal payloads of at least `least_bytes`, that with the largest
    id is a response and the others revisit it; rows that share that id, and
    rows without id, are responses too. Null html is an empty payload; null
    urls and ids have no header. Each time the table is computed archives are
    written, so cut it before it is used twice; drop_stale() removes those that
    it doesn't name.
    """
    named = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    chosen = choose_responses(named, least_bytes).select("page_id", "url", "html", F.col("__refers").cast("long"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(arrow_uri(folder))
        store.create_dir(root, recursive=True)
        task, writer, out = TaskContext.get(), ArchiveWriter(), []
        count = 0

        def close() -> None:
            nonlocal count
            name = f"{root}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(out):05d}.warc.zst"
            data = writer.close()
            with store.open_output_stream(f"{name}.tmp") as file:
                file.write(data)
            store.move(f"{name}.tmp", name)
            out.append((name, count, len(data)))
            count = 0

        for batch in sliced(batches, 2):
            for page_id, url, html, refers in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                writer.add(encode_record(page_id, url, html or b"", refers))
                count += 1
                if writer.size >= ARCHIVE_BYTES:
                    close()
        if count:
            close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], ["path", "records", "bytes"])

    return chosen.mapInArrow(write, "path string, records long, bytes long")


def archives(spark, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)


def records_of(data: bytes, counted: bool, expected: int | None = None) -> Iterator[pa.RecordBatch]:
    """The records of an archive in batches of some 4 MB; WarcError after the last if there aren't `expected` ones."""
    names = [x.split()[0] for x in RECORD.split(", ")]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    rows: list[tuple] = []
    size = n = 0
    for record in read_archive(data, counted):
        rows.append(decode_record(record))
        size, n = size + len(record), n + 1
        if size > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
    if expected is not None and n != expected:
        raise WarcError(f"{expected} records were written, but {n} are read")


def read_archives(spark, folder: str, counted: bool = True) -> DataFrame:
    """The records (RECORD) of all archives in a folder. An archive that breaks the format fails the job; check_archives() tells which.

    `counted` archives end in a frame that has their number of records, as
    those of write_archives() do; without it, archives that were cut between
    two frames can't be told from whole ones.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                yield from records_of(data.as_py(), counted)

    return archives(spark, folder).select("content").mapInArrow(decode, RECORD)


def read_written(written: DataFrame, folder: str) -> DataFrame:
    """The records (RECORD) of the archives in `folder` that `written`, the cut table of write_archives(), names, and of no others.

    The job fails if an archive is missing, breaks the format, or has another number of records than was written.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(arrow_uri(folder))
        for batch in batches:
            for path, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_file(f"{root}/{path.rpartition('/')[2]}") as file:
                    data = file.read()
                yield from records_of(data, True, records)

    return written.select("path", "records").mapInArrow(decode, RECORD)


def drop_stale(written: DataFrame, folder: str) -> DataFrame:
    """Remove the archives in `folder` that `written` doesn't name, as attempts of tasks that didn't count leave them; their paths."""

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(arrow_uri(folder))
        for batch in batches:
            for name in batch.column(1).to_pylist():
                if store.get_file_info(f"{root}/{name}").type == fs.FileType.File:  # not when the task runs again
                    store.delete_file(f"{root}/{name}")
            yield batch.select(["path"])

    name = F.substring_index("path", "/", -1)
    there = archives(written.sparkSession, folder).select("path", name.alias("name"))
    return cut(there.join(written.select(name.alias("name")), "name", "left_anti").select("path", "name").mapInArrow(remove, "path string"))


def check_archives(spark, folder: str, counted: bool = True) -> DataFrame:
    """path, records that can be read, and error (null if there is none) of each archive in a folder."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                records, said = 0, None
                try:
                    for record in read_archive(data, counted):
                        decode_record(record)
                        records += 1
                except WarcError as error:
                    said = str(error)
                rows.append((path, records, said))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string()), strict=True)], ["path", "records", "error"])

    return archives(spark, folder).select("path", "content").mapInArrow(check, "path string, records long, error string")


def op7_warc(spark, sf_dir):
    folder = scratch(spark, "warc")
    written = cut(write_archives(read(spark, sf_dir, "pages"), folder))
    return read_written(written, folder).drop("url", "payload")


def _sql() -> str:
    # Each 5 bytes of the digest, 10 hexadecimal digits, make 8 letters.
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    code = (
        "array_to_string(list_transform(range(0, 32), lambda i: "
        f"substr('{letters}', CAST((CAST('0x' || substr(h, CAST((i // 8) * 10 + 1 AS INTEGER), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS INTEGER)) & 31 AS INTEGER) + 1, 1)), '')"
    )
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), g AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, octet_length(encode(html)) AS payload_bytes, {code} AS payload_digest,
       CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < last THEN last END AS refers_to
FROM g
"""


SQL = _sql()
