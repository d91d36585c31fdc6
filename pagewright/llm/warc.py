"""WARC archives: writing, resolving revisits, and reading back.

``write_archives`` stores one ``response`` record per page.  ``resolve`` shuffles only the records' headers by
payload digest and finds the original of every repeated payload; ``rewrite`` copies the archives with fresh
headers, repeated payloads as ``revisit`` records; ``read_archives`` parses the result.  Every record is a gzip
member of its own, so that a reader can start at any offset of the index.

Null html is an empty payload, a null url becomes ``urn:page:<page_id>``.  Among equal payloads the smallest page_id
is the original; null page_ids come last, ties go to the first record in (file, offset).  Repeated rows are records
of their own.  An empty table gives empty archives and no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.blobs import RollingWriter, open_fs
from pagewright.llm.common import drop, parts, scratch, stored

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
LEVEL = 3
FILE_BYTES = 32 << 20
INDEX = "page_id long, url string, payload_bytes long, payload_digest string, file string, offset long, length long"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def clean_uri(url: str | None, page_id: int | None) -> str:
    """A header-safe target: blanks and control characters are percent-encoded."""
    if not url:
        return f"urn:page:{page_id}"
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def record_id(*key) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, '|'.join(map(str, key)))}>"


def member(headers: list[tuple[str, object]], block: bytes, level: int = LEVEL) -> bytes:
    """One record as a gzip member."""
    head = "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None)
    pack = zlib.compressobj(level, wbits=31)
    data = f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    return pack.compress(data) + pack.flush()


def http_head(n: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()


def records(stream, size: int = 1 << 18) -> Iterator[bytes]:
    """The decompressed records of an archive, one gzip member at a time."""
    data, unpack, out = b"", zlib.decompressobj(wbits=31), []
    while True:
        if not data:
            data = stream.read(size)
            if not data:
                break
        out.append(unpack.decompress(data))
        data = unpack.unused_data
        if unpack.eof:
            yield b"".join(out)
            unpack, out = zlib.decompressobj(wbits=31), []
    if out:
        raise ValueError("the archive ends inside a record")


def parsed(record: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers, HTTP head and payload of a record; lengths and digest are checked."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    http, _, payload = block.partition(b"\r\n\r\n")
    return headers, http, payload


def _number(text: str | None) -> int | None:
    return None if text is None else int(text)


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes a ``response`` record for every row and returns the index, unmaterialised."""

    def write(batches):
        task = TaskContext.get()
        out = RollingWriter(folder, f"pages-{task.partitionId():06d}-{task.taskAttemptId():08d}", ".warc.gz", FILE_BYTES)
        for b in batches:
            ids, urls, rows = b.column(0).to_pylist(), b.column(1).to_pylist(), []
            for i, u, h in zip(ids, urls, b.column(2)):
                payload = h.cast(pa.binary()).as_py() or b""
                sha, target = digest_of(payload), clean_uri(u, i)
                headers = [("WARC-Type", "response"), ("WARC-Record-ID", record_id("source", i, sha, target)), ("WARC-Target-URI", target), ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha1:{sha}"), ("Content-Type", "application/http; msgtype=response"), ("X-Page-Id", i)]
                chunk = member(headers, http_head(len(payload)) + payload)
                rows.append((i, target, len(payload), sha, *out.append(chunk), len(chunk)))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()))] if rows else [pa.array([], t) for t in (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())], ["page_id", "url", "payload_bytes", "payload_digest", "file", "offset", "length"])
        out.close()

    return pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html")).mapInArrow(write, INDEX)


def resolve(index: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """The index with ``origin``: null for a response, else the original's page_id, url, file and offset.

    One partial aggregate by digest finds the originals, and only digests that occur twice are joined back; both
    sides of that join are plain shuffles, so a digest with a third of all records is split by adaptive execution.
    """
    first = F.struct(F.col("page_id").isNull().alias("unnamed"), "page_id", "file", "offset", "url")
    origins = index.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.min(first).alias("origin"), F.count("*").alias("n"))
    origins = stored(origins.where("n > 1").select(F.col("payload_digest").alias("origin_digest"), "origin"), folder)
    own = (F.col("origin.file") == F.col("file")) & (F.col("origin.offset") == F.col("offset"))
    joined = index.join(origins, (F.col("payload_digest") == F.col("origin_digest")) & (F.col("payload_bytes") >= min_bytes), "left")
    return joined.select(*index.columns, F.when(~own, F.col("origin")).alias("origin"))


def rewrite(resolved: DataFrame, source: str, folder: str, tasks: int) -> DataFrame:
    """Copies the archives of ``source`` with fresh headers and returns the new index's files and sizes.

    Records are dealt out in ranges of (file, offset), so each task reads stretches of the archives from front to back.
    """

    def write(batches):
        task = TaskContext.get()
        out = RollingWriter(folder, f"dedup-{task.partitionId():06d}-{task.taskAttemptId():08d}", ".warc.gz", FILE_BYTES)
        fs, root = open_fs(source)
        name, stream = None, None
        for b in batches:
            rows = []
            for r in b.to_pylist():
                sha, origin = r["payload_digest"], r["origin"]
                headers = [("WARC-Type", "revisit" if origin else "response"), ("WARC-Record-ID", record_id("fresh", r["file"], r["offset"])), ("WARC-Target-URI", r["url"]), ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha1:{sha}"), ("Content-Type", "application/http; msgtype=response"), ("X-Page-Id", r["page_id"])]
                if origin:
                    headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id("fresh", origin["file"], origin["offset"])), ("WARC-Refers-To-Target-URI", origin["url"]), ("WARC-Refers-To-Date", DATE), ("X-Refers-To-Page-Id", origin["page_id"])]
                    block = http_head(r["payload_bytes"])
                else:
                    if r["file"] != name:
                        name, stream = r["file"], fs.open_input_file(f"{root}/{r['file']}")
                    stream.seek(r["offset"])
                    _, http, payload = parsed(zlib.decompress(stream.read(r["length"]), wbits=31))
                    block = http + b"\r\n\r\n" + payload
                chunk = member(headers, block)
                rows.append((out.append(chunk)[0], len(chunk)))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.string()), pa.array([x[1] for x in rows], pa.int64())], ["file", "length"])
        out.close()

    dealt = resolved.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(write, "file string, length long")


def read_archives(files: DataFrame, folder: str) -> DataFrame:
    """Parses every archive named in ``files.file``; the digest of each stored payload is computed again."""

    def read(batches):
        fs, root = open_fs(folder)
        for b in batches:
            for name in b.column(0).to_pylist():
                rows = []
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for record in records(stream):
                        h, http, payload = parsed(record)
                        sha, kind = h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Type"]
                        n = int(http.decode().split("Content-Length: ")[1].split("\r\n")[0])
                        if kind == "response" and (digest_of(payload) != sha or len(payload) != n):
                            raise ValueError(f"{name}: a payload differs from its digest")
                        rows.append((_number(h.get("X-Page-Id")), n, sha, kind, _number(h.get("X-Refers-To-Page-Id")), h["WARC-Record-ID"], h.get("WARC-Refers-To"), name))
                types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "refers_to_record", "archive"]
                for at in range(0, len(rows), 4096):
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[at : at + 4096]), types)], names)

    return files.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, refers_to_record string, archive string")


def deduplicated_archives(spark: SparkSession, pages: DataFrame, min_bytes: int = 0) -> tuple[DataFrame, str]:
    """The whole operator: the records read back from the deduplicated archives, and those archives' folder."""
    top = scratch(spark, "warc")
    index = stored(write_archives(pages, f"{top}/source"), f"{top}/index")
    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = parts(total, 8 << 20)
    resolved = resolve(index, f"{top}/origins", min_bytes)
    written = stored(rewrite(resolved, f"{top}/source", f"{top}/dedup", tasks), f"{top}/written")
    drop(spark, f"{top}/source", f"{top}/index", f"{top}/origins")
    files = written.groupBy("file").agg(F.sum("length").alias("bytes"))
    n_files = max(1, files.count())
    return read_archives(files.repartitionByRange(n_files, "file").select("file"), f"{top}/dedup"), f"{top}/dedup"
