"""WARC archives with a two-level capture index: sorted keys in compressed blocks, a sparse directory of blocks."""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallycast.llm.queries import query, table
from tallycast.session import scratch_path

BLOCK_LINES = 500  # index lines of a block at most
BLOCK_BYTES = 8 << 20  # archive bytes after which a block ends
SMALL_GROUPS = 200_000  # groups of equal payloads (under 100 bytes each) up to which they are broadcast
DATE = "1970-01-01T00:00:00Z"  # pages carry no time of capture
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DIRECTORY = "part int, block int, first_key string, last_key string, offset bigint, length bigint, records int"


def capture_key(url: Column) -> Column:
    """Sort key of an address: host names reversed, without user, port and a leading www, then path and query.

    Controls and spaces become %20, a fragment is dropped, a null address has the key of an empty one.
    """
    url = F.coalesce(url, F.lit(""))
    scheme = r"^[A-Za-z][A-Za-z0-9+.\-]*://"
    host = F.lower(F.regexp_extract(url, scheme + r"([^/?#]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^[^@]*@", ""), r":\d*$", ""), r"^www\d*\.", "")
    rest = F.regexp_replace(F.regexp_replace(url, scheme + "[^/?#]*", ""), "#.*$", "")
    path = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.regexp_replace(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), path), r"[\x00-\x20\x7F]", "%20")


def payload_digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page: str | None, digest: str) -> str:
    return f"<urn:page:{quote(page, safe='')}>" if page is not None else f"<urn:capture:{digest}>"


def _page(name: str) -> str | None:
    from urllib.parse import unquote

    return unquote(name[10:-1]) if name.startswith("<urn:page:") else None


def record(page: str | None, url: str | None, payload: bytes, refers_to: str | None, revisit: bool) -> tuple[bytes, str]:
    """One gzip member with a response, or with a revisit that has the HTTP header but no payload; and the digest."""
    digest = payload_digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page, digest)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~' + chr(39))}", f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(refers_to, digest)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    whole = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    return packer.compress(whole) + packer.flush(), digest


def parse(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC header, HTTP header and payload of one record; lengths and the payload's digest must agree."""
    whole = zlib.decompress(member, 31)
    head, _, rest = whole.partition(b"\r\n\r\n")
    warc = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    size = int(warc["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError(f"record {warc['WARC-Record-ID']}: wrong length")
    http_head, _, payload = rest[:size].partition(b"\r\n\r\n")
    http = dict(line.split(": ", 1) for line in http_head.decode().split("\r\n")[1:])
    if warc["WARC-Type"] == "response" and (warc["WARC-Payload-Digest"] != f"sha1:{payload_digest(payload)}" or int(http["Content-Length"]) != len(payload)):
        raise ValueError(f"record {warc['WARC-Record-ID']}: wrong payload")
    return warc, http, payload


def _file(folder: str, part: int, kind: str) -> tuple[arrow_fs.FileSystem, str]:
    system, base = arrow_fs.FileSystem.from_uri(folder)
    return system, f"{base}/part-{part:06d}.{kind}"


class _Output:
    """A file under a name of this attempt until it is complete: a repeated task replaces a file by an equal one."""

    def __init__(self, folder: str, part: int, kind: str):
        self.system, self.path = _file(folder, part, kind)
        self.hidden = f"{self.path}.{TaskContext.get().taskAttemptId()}.part"
        self.stream, self.size = self.system.open_output_stream(self.hidden, compression=None), 0

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def commit(self) -> None:
        self.stream.close()
        self.system.move(self.hidden, self.path)


def _write_part(rows: Iterator[tuple], folder: str, part: int) -> list[tuple]:
    """Write the archive, index and directory of one key range; returns the directory's rows."""
    archive = index = None
    directory: list[tuple] = []
    lines: list[str] = []
    keys: list[str] = []
    started = 0

    def close() -> None:
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        data = packer.compress("\n".join(lines).encode()) + packer.flush()
        directory.append((part, len(directory), keys[0], keys[-1], index.size, len(data), len(lines)))
        index.write(data)
        lines.clear()
        keys.clear()

    for key, page, url, payload, refers_to, revisit in rows:
        if archive is None:
            archive, index = _Output(folder, part, "warc.gz"), _Output(folder, part, "cdx.gz")
        data, digest = record(page, url, payload, refers_to, revisit)
        entry = {"page": page, "digest": digest, "type": "revisit" if revisit else "response", "offset": archive.size, "length": len(data)}
        lines.append(f"{key} {json.dumps(entry)}")
        keys.append(key)
        archive.write(data)
        if len(lines) >= BLOCK_LINES or archive.size - started >= BLOCK_BYTES:
            close()
            started = archive.size
    if archive is None:
        return []
    if lines:
        close()
    sparse = _Output(folder, part, "dir.json")
    sparse.write(json.dumps(directory).encode())
    for output in (archive, index, sparse):
        output.commit()
    return directory


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) under ``folder``, a URI; returns the block directory.

    Of equal payloads of at least ``least_bytes``, the row with the smallest id is the response, others are revisits
    that refer to it; rows that share this smallest id are responses all.  Pages are range-partitioned and sorted by
    (capture key, id), so a file holds one range of keys in order, beside its index: blocks of sorted lines, each
    compressed by itself, and a directory line per block.  A null html is empty; a null id is never referred to unless
    a group has no other, and then the group has responses only; a null address has an empty key.
    """
    system, base = arrow_fs.FileSystem.from_uri(folder)
    system.create_dir(base, recursive=True)
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("hash", F.sha2("payload", 256))
    groups = rows.filter(F.octet_length("payload") >= least_bytes).groupBy("hash").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    groups = groups.filter("n > 1 AND first IS NOT NULL").select("hash", "first")
    few = groups.limit(SMALL_GROUPS + 1).count() <= SMALL_GROUPS
    joined = rows.join(F.broadcast(groups) if few else groups, "hash", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    ready = joined.select(
        capture_key(F.col("url")).alias("key"), "page_id", "hash", F.col("page_id").cast("string").alias("page"), "url", "payload",
        F.col("first").cast("string").alias("refers_to"), revisit.alias("revisit"),
    )
    order = ["key", "page_id", "hash"]
    ordered = ready.repartitionByRange(*order).sortWithinPartitions(*order, "url").select("key", "page", "url", "payload", "refers_to", "revisit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = (tuple(value.as_py() for value in row) for batch in batches for row in zip(*batch.columns))
        found = _write_part(fields, folder, TaskContext.get().partitionId())
        if found:
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32())
            names = ["part", "block", "first_key", "last_key", "offset", "length", "records"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names)

    ordered.mapInArrow(run, DIRECTORY).write.parquet(f"{folder}/directory")
    return read_directory(pages.sparkSession, folder)


def read_directory(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(DIRECTORY).parquet(f"{folder}/directory")


def _block(folder: str, part: int, offset: int, length: int) -> list[str]:
    """Index lines of one block, by a range read."""
    system, path = _file(folder, part, "cdx.gz")
    with system.open_input_file(path) as f:
        return zlib.decompress(f.read_at(length, offset), 31).decode().split("\n")


CAPTURE = "page string, payload_bytes bigint, payload_digest string, record_type string, refers_to string"


def _capture(warc: dict[str, str], http: dict[str, str]) -> tuple:
    refers = _page(warc["WARC-Refers-To"]) if "WARC-Refers-To" in warc else None
    return _page(warc["WARC-Record-ID"]), int(http["Content-Length"]), warc["WARC-Payload-Digest"][5:], warc["WARC-Type"], refers


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


_NAMES = ["page", "payload_bytes", "payload_digest", "record_type", "refers_to"]
_KINDS = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]


def read_captures(spark: SparkSession, folder: str) -> DataFrame:
    """``(page, payload_bytes, payload_digest, record_type, refers_to)`` of every record, read by way of the index.

    A task takes directory rows, reads each block of the index and then its records, one at a time; archives
    follow the index's order, so these range reads run through a file.  Responses are checked against their digest.
    """
    spread = 4 * spark.sparkContext.defaultParallelism  # a number: by size, Spark would put the narrow rows in one task
    blocks = read_directory(spark, folder).select("part", "block", "offset", "length").repartition(spread, "part", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                system, path = _file(folder, part, "warc.gz")
                rows = []
                with system.open_input_file(path) as f:
                    for line in _block(folder, part, offset, length):
                        entry = json.loads(line.split(" ", 1)[1])
                        warc, http, _ = parse(f.read_at(entry["length"], entry["offset"]))
                        rows.append(_capture(warc, http))
                yield _batch(rows, _NAMES, _KINDS)

    return blocks.mapInArrow(run, CAPTURE)


@lru_cache(maxsize=8)
def _directory(folder: str, part: int) -> list:
    system, path = _file(folder, part, "dir.json")
    with system.open_input_file(path) as f:
        return json.loads(f.read())


def find(folder: str, bounds: list[tuple[int, str, str]], key: str) -> Iterator[tuple[dict, dict[str, str], dict[str, str], bytes]]:
    """Records of one capture key: binary search over files, then blocks, then lines; only then range reads.

    ``bounds`` has (part, first key, last key) of each file in order.  A key of many captures may run over
    several blocks and files.
    """
    for part, first, _ in bounds[bisect_left(bounds, key, key=lambda b: b[2]) :]:
        if first > key:
            return
        blocks = _directory(folder, part)
        system, path = _file(folder, part, "warc.gz")
        for _, _, first, _, offset, length, _ in blocks[bisect_left(blocks, key, key=lambda b: b[3]) :]:
            if first > key:
                break
            lines = _block(folder, part, offset, length)
            for line in lines[bisect_left(lines, key, key=lambda text: text.split(" ", 1)[0]) :]:
                name, entry = line.split(" ", 1)
                if name != key:
                    break
                entry = json.loads(entry)
                with system.open_input_file(path) as f:
                    yield entry, *parse(f.read_at(entry["length"], entry["offset"]))


def lookup(urls: DataFrame, folder: str) -> DataFrame:
    """``(url, page, payload_bytes, payload_digest, record_type, refers_to, html)`` of the captures of each ``url``.

    ``html`` is the payload of a response, null for a revisit.  Only one row per file (its first and last key) goes to
    the driver and the tasks; directories and blocks are read by the tasks that need them.  Addresses without
    a capture give no row.
    """
    files = read_directory(urls.sparkSession, folder).groupBy("part").agg(F.min("first_key"), F.max("last_key")).orderBy("part")
    bounds = [tuple(r) for r in files.collect()]
    wanted = urls.select("url", capture_key(F.col("url")).alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for url, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for _, warc, http, payload in find(folder, bounds, key):
                    html = payload.decode() if warc["WARC-Type"] == "response" else None
                    yield _batch([(url, *_capture(warc, http), html)], ["url", *_NAMES, "html"], [pa.string(), *_KINDS, pa.string()])

    return wanted.mapInArrow(run, f"url string, {CAPTURE}, html string")


@query("op5_warc_archives")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), folder)
    found = read_captures(spark, folder)
    return found.select(
        F.col("page").cast("bigint").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("bigint").alias("refers_to")
    )
