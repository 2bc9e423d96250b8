"""Web pages in WARC archives, and archives back to pages: long records lie in segments, payloads in chunked framing.

Writing: each page becomes a record, gzipped on its own, in files of bounded size. Of pages with equal payloads (of at least
`min_bytes`) the one with the smallest id is a response, the others are revisits that refer to it; shorter
payloads are all responses. A response's payload is sent in chunks as HTTP frames it; a block above `segment_bytes` is cut
into a first segment and continuation records, which may lie in the next file.

Reading: a task streams its files record by record and checks each block's digest. Continuation records of all files are
grouped by the record they continue, ordered by segment number, their total length is verified, and the joined block's
chunked framing is decoded; the payload must have the digest that the record states. A group holds one payload.

Only files that the manifest names are read, so what a lost task left behind is no part of the archive. Copies of one payload
are dealt over SALTS places by page id; each place's smallest id is found first, then the smallest of all.

A null html is an empty payload, a null url gives no target. Null ids come after all others when the response is chosen; a
repeated id with an equal payload is a revisit of itself. Ids are written as text and read as `key_type`. Other columns are not
written. An empty table gives an archive without files.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from brinewave.llm.rows import named
from brinewave.session import cut_lineage, job_dir

# Fixed values of the format.
VERSION, DATE, GAP = "WARC/1.1", "1970-01-01T00:00:00Z", b"\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
SALTS = 64
CHUNK, SEGMENT, FILE = 1 << 13, 1 << 16, 32 << 20
#: Compressed bytes of archive files that one task reads.
TASK_BYTES = 128 << 20


# ---- records


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def chunked(payload: bytes, size: int) -> bytes:
    """The payload in HTTP's chunked framing."""
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload out of the framing; extensions of chunks and trailers are passed over."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if len(body) < at + size + 2 or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is cut short")
        out.append(body[at : at + size])
        at += size + 2


def split_http(block: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and body of an HTTP message."""
    head, _, body = block.partition(GAP)
    lines = head.decode("latin-1").split("\r\n")[1:]
    return {n.strip().lower(): v.strip() for n, _, v in (x.partition(":") for x in lines)}, body


def payload_of(block: bytes) -> bytes:
    headers, body = split_http(block)
    return unchunked(body) if headers.get("transfer-encoding", "").lower() == "chunked" else body


def page_urn(key: str | None, digest: str, more: str = "") -> str:
    return ":".join(["<urn:page-none" if key is None else f"<urn:page:{quote(key, safe='')}", digest, *([more] if more else [])]) + ">"


def page_key(urn: str | None) -> str | None:
    found = re.match(r"<urn:page:([^:>]*):", urn or "")
    return unquote(found[1]) if found else None


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member of its own."""
    stated = [*headers, ("WARC-Date", DATE), ("WARC-Block-Digest", "sha1:" + base32_sha1(block)), ("Content-Length", str(len(block)))]
    head = VERSION + "\r\n" + "".join(f"{n}: {v}\r\n" for n, v in stated) + "\r\n"
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress(head.encode()) + press.compress(block) + press.compress(GAP) + press.flush()


def records(headers: list[tuple[str, str]], block: bytes, segment: int) -> Iterator[bytes]:
    """A record, or its segments: the first carries its headers, the last the total length."""
    if len(block) <= segment:
        yield record(headers, block)
        return
    origin = dict(headers)["WARC-Record-ID"]
    for number, at in enumerate(range(0, len(block), segment), 1):
        last = [("WARC-Segment-Total-Length", str(len(block)))] if at + segment >= len(block) else []
        mine = [("WARC-Segment-Number", str(number)), *last]
        if number > 1:
            own = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Segment-Origin-ID", origin)]
        yield record([*(headers if number == 1 else own), *mine], block[at : at + segment])


def parsed(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of every record of a stream; blocks must have their stated digest."""
    buffer = bytearray()

    def more() -> bool:
        data = next(chunks, None)
        buffer.extend(data or b"")
        return data is not None

    while True:
        while (end := buffer.find(GAP)) < 0:
            if not more():
                if buffer.strip():
                    raise ValueError("the archive ends within a record")
                return
        version, *lines = bytes(buffer[:end]).decode().lstrip("\r\n").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("no record begins here")
        headers = {n.strip().lower(): v.strip() for n, _, v in (x.partition(":") for x in lines)}
        size = int(headers["content-length"])
        while len(buffer) < end + 4 + size + 4:
            if not more():
                raise ValueError("the archive ends within a record")
        block = bytes(buffer[end + 4 : end + 4 + size])
        del buffer[: end + 4 + size + 4]
        stated = headers.get("warc-block-digest")
        if stated and stated != "sha1:" + base32_sha1(block):
            raise ValueError(f"the block of {headers.get('warc-record-id')} has another digest")
        yield headers, block


def inflated(raw: Iterator[bytes]) -> Iterator[bytes]:
    """The content of gzip members, one after the other."""
    press = zlib.decompressobj(31)
    for data in raw:
        while data:
            yield press.decompress(data)
            data = press.unused_data
            if press.eof:
                press = zlib.decompressobj(31)


# ---- files


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), path)


def file_records(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of a file, read as a stream; plain if its name does not end in .gz."""
    system, inner = _opened(path)
    with system.open_input_stream(inner, compression=None) as f:
        raw = iter(lambda: f.read(1 << 20), b"")
        yield from parsed(inflated(raw) if path.endswith(".gz") else raw)


class Files:
    """The files of one task: a new one where the last has grown to its size."""

    def __init__(self, folder: str, most: int):
        self.folder, self.most, self.out, self.made = folder, most, None, []

    def add(self, data: bytes) -> None:
        if self.out is None:
            name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
            system, inner = _opened(f"{self.folder}/{name}")
            self.out = system.open_output_stream(inner, compression=None)
            self.made.append([f"{self.folder}/{name}", 0, 0])
        self.out.write(data)
        self.made[-1][1] += 1
        self.made[-1][2] += len(data)
        if self.made[-1][2] >= self.most:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def _written(folder: str, chunk: int, segment: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Files(folder, most)
        for batch in batches:
            for key, url, payload, size, sha1, response, unique, first in zip(*batch.columns):
                key, sha1, unique = key.as_py(), sha1.as_py(), unique.as_py()
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                headers = [("WARC-Payload-Digest", "sha1:" + digest), ("Content-Type", "application/http; msgtype=response")]
                if (target := url.as_py()) is not None:
                    headers.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", target)))
                if response.as_py():
                    name = page_urn(key, digest, "" if unique else uuid.uuid4().hex)
                    block = (HTTP + "Transfer-Encoding: chunked\r\n\r\n").encode() + chunked(payload.as_py(), chunk)
                    headers = [("WARC-Type", "response"), ("WARC-Record-ID", name), *headers]
                else:
                    name, origin = page_urn(key, digest, uuid.uuid4().hex), page_urn(first.as_py(), digest)
                    block = f"{HTTP}Content-Length: {size.as_py()}\r\n\r\n".encode()
                    headers = [("WARC-Type", "revisit"), ("WARC-Record-ID", name), ("WARC-Refers-To", origin), ("WARC-Profile", REVISIT_PROFILE), *headers]
                for data in records(headers, block, segment):
                    files.add(data)
        files.close()
        if files.made:
            names, counts, sizes = zip(*files.made)
            yield pa.RecordBatch.from_pydict({"file": names, "records": pa.array(counts, pa.int64()), "bytes": pa.array(sizes, pa.int64())})

    return run


def _decided(pages: DataFrame, key: str, url: str, html: str, min_bytes: int) -> DataFrame:
    """Pages with their digest, whether they are a response, and the id that revisits refer to; payloads of responses only.

    The pages move once, by digest and salt, which the smallest ids share.
    """
    payload = F.coalesce(named(html), F.lit("")).cast("binary")
    salt = F.pmod(F.xxhash64(named(key)), F.lit(SALTS)).cast("int")
    rows = pages.select(named(key).alias("key"), named(url).alias("url"), payload.alias("payload"), F.sha1(payload).alias("sha1"), salt.alias("salt"))
    order = F.struct(F.col("key").isNull().alias("none"), "key")
    places = rows.groupBy("sha1", "salt").agg(F.min(order).alias("at"))
    least = places.groupBy("sha1").agg(F.min("at").alias("first"))
    firsts = places.join(least, "sha1").select("sha1", "salt", "first")
    number = F.row_number().over(Window.partitionBy("sha1", "salt").orderBy(F.col("key").asc_nulls_last()))
    joined = rows.withColumn("number", number).join(firsts, ["sha1", "salt"])
    size = F.octet_length("payload").cast("long")
    shared = size >= min_bytes
    response = ~shared | ((F.col("number") == 1) & F.col("key").eqNullSafe(F.col("first.key")))
    marked = joined.select("key", "url", "payload", size.alias("size"), "sha1", response.alias("response"), shared.alias("unique"), F.col("first.key").alias("first"))
    text = [F.col(c).cast("string").alias(c) for c in ("key", "url")]
    return marked.select(*text, F.when(F.col("response"), F.col("payload")).alias("payload"), "size", "sha1", "response", "unique", F.col("first").cast("string").alias("first"))


def write(
    pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0, chunk: int = CHUNK, segment: int = SEGMENT, most: int = FILE
) -> None:
    """Archive files of about `most` compressed bytes in folder/archive, and folder/manifest, which names them."""
    system, inner = _opened(f"{folder}/archive")
    system.create_dir(inner, recursive=True)
    made = _decided(pages, key, url, html, min_bytes).mapInArrow(_written(f"{folder}/archive", chunk, segment, most), "file string, records long, bytes long")
    made.write.parquet(f"{folder}/manifest")


ROW = "record_id string, kind string, url string, digest string, refers string, payload_bytes long, payload binary, origin string, number long, total long, block binary"
ARROW_ROW = pa.schema(
    [("record_id", pa.string()), ("kind", pa.string()), ("url", pa.string()), ("digest", pa.string()), ("refers", pa.string()), ("payload_bytes", pa.int64())]
    + [("payload", pa.binary()), ("origin", pa.string()), ("number", pa.int64()), ("total", pa.int64()), ("block", pa.binary())]
)


def _finished(row: dict, block: bytes, payloads: bool) -> dict:
    """A record's row with its block decoded; a response's payload must have the stated digest."""
    if row["kind"] == "revisit":
        row["payload_bytes"] = int(split_http(block)[0]["content-length"])
        return row
    payload = payload_of(block)
    found = base32_sha1(payload)
    if row["digest"] not in (None, found):
        raise ValueError(f"the payload of {row['record_id']} has another digest")
    return row | {"digest": found, "payload_bytes": len(payload), "payload": payload if payloads else None}


def _number(headers: dict[str, str], name: str) -> int | None:
    return int(headers[name]) if name in headers else None


def _read(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for batch in batches:
            for path in batch.column("file").to_pylist():
                for headers, block in file_records(path):
                    kind = headers["warc-type"]
                    if kind not in ("response", "revisit", "continuation"):
                        continue
                    row = dict.fromkeys(ARROW_ROW.names) | {
                        "record_id": headers["warc-record-id"], "kind": kind, "url": headers.get("warc-target-uri"),
                        "digest": headers.get("warc-payload-digest", "").removeprefix("sha1:") or None, "refers": headers.get("warc-refers-to"),
                    }
                    number = _number(headers, "warc-segment-number")
                    if number is None:
                        row = _finished(row, block, payloads)
                    else:
                        origin = headers["warc-record-id"] if number == 1 else headers["warc-segment-origin-id"]
                        row |= {"origin": origin, "number": number, "total": _number(headers, "warc-segment-total-length"), "block": block}
                    out.append(row)
                    held += 500 + len(row["block"] or row["payload"] or b"")
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(out, schema=ARROW_ROW)
                        out, held = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=ARROW_ROW)

    return run


def _joined(payloads: bool):
    """Segments of a record, in order, to its row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for origin, parts in zip(batch.column("origin").to_pylist(), batch.column("parts")):
                parts = parts.as_py()
                block, total = b"".join(p["block"] for p in parts), parts[-1]["total"]
                if [p["number"] for p in parts] != list(range(1, len(parts) + 1)) or total is None:
                    raise ValueError(f"segments of {origin} are missing or repeated")
                if total != len(block):
                    raise ValueError(f"the segments of {origin} hold {len(block)} bytes, not {total}")
                row = dict.fromkeys(ARROW_ROW.names) | {"record_id": origin} | {c: parts[0][c] for c in ("kind", "url", "digest", "refers")}
                yield pa.RecordBatch.from_pylist([_finished(row, block, payloads)], schema=ARROW_ROW)

    return run


def read_files(files: DataFrame, payloads: bool = False, key_type: str = "long") -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to (and payload, null for revisits, if asked for) of the
    files named in `file` (with their `bytes`)."""
    spark = files.sparkSession
    count, total = files.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    tasks = max(-(-total // TASK_BYTES), min(count, 2 * spark.sparkContext.defaultParallelism), 1)
    found = cut_lineage(files.select("file").repartition(tasks).mapInArrow(_read(payloads), ROW))
    segments = found.where("number is not null")
    parts = F.sort_array(F.collect_list(F.struct("number", "total", "kind", "url", "digest", "refers", "block"))).alias("parts")
    grouped = segments.groupBy("origin").agg(parts).mapInArrow(_joined(payloads), ROW)
    every = found.where("number is null").unionByName(grouped)

    @F.arrow_udf("string")
    def key_of(urns: pa.Array) -> pa.Array:
        return pa.array([page_key(u) for u in urns.to_pylist()], pa.string())

    return every.select(
        key_of("record_id").cast(key_type).alias("page_id"), "url", "payload_bytes", F.col("digest").alias("payload_digest"),
        F.col("kind").alias("record_type"), key_of("refers").cast(key_type).alias("refers_to"), *(["payload"] if payloads else []),
    )


def read(spark: SparkSession, folder: str, **options) -> DataFrame:
    """The pages of an archive that `write` made."""
    return read_files(spark.read.schema("file string, records long, bytes long").parquet(f"{folder}/manifest"), **options)


def write_and_read(pages: DataFrame, **options) -> DataFrame:
    """Write to a new folder in the shared one and read that back."""
    folder = f"{job_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write(pages, folder, **options)
    return read(pages.sparkSession, folder)
