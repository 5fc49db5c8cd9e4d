"""WARC archives: whole-file gzip streams rewritten with every record as its own member, beside an index of offsets (operator 12)."""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import MOST_BROADCAST, partition_id, shared_path, stored

#: Payloads of fewer bytes are always written whole.
LEAST_BYTES = 1000
#: An archive file is closed after the record that fills it to so many bytes.
FILE_BYTES = 64 << 20
#: Index lines in a member of a sidecar.
INDEX_LINES = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PAGE = "urn:page:"
_END = b"\r\n\r\n"
#: A gzip member without content; like that of any record of less than 16 MB, its last byte is zero.
_EMPTY = zlib.compressobj(wbits=31).flush()


# writing


def deduplicated(pages: DataFrame, least: int = LEAST_BYTES) -> tuple[DataFrame, DataFrame]:
    """The pages whose payload is written (page_id, url, html, digest, bytes), and those that revisit another (page_id, url, digest, bytes, refers_to).

    Of pages with equal payloads of ``least`` bytes or more, that with the largest page_id is written and the others revisit it; rows that
    share that page_id too are all written. A null html is an empty payload; rows without a page_id come before all others, and are written where no equal row has one.

    Payloads don't move: digests and ids find the copies, and what revisits is left out of the scan, by a broadcast up to a bound, by a shuffled join beyond it.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumns({"digest": F.sha1("html"), "bytes": F.octet_length("html").cast("long")})
    facts = stored(rows.where(F.col("bytes") >= least).select("page_id", "url", "digest", "bytes"), "payloads")
    last = facts.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("copies")).where("copies > 1 AND refers_to IS NOT NULL")
    last = stored(last.drop("copies"), "copied", short=True)
    revisits = stored(facts.join(last, "digest").where("NOT page_id <=> refers_to").select("page_id", "url", "digest", "bytes", "refers_to"), "revisits", short=True)
    names = revisits.select(F.col("page_id").alias("other_id"), F.col("digest").alias("other_digest")).distinct()
    if revisits.count() <= MOST_BROADCAST:
        names = F.broadcast(names)
    return rows.join(names, F.col("page_id").eqNullSafe(F.col("other_id")) & (F.col("digest") == F.col("other_digest")), "left_anti"), revisits


def _header(kind: Column, *more: Column) -> Column:
    """A record's header lines up to Content-Length; no value of a line can hold a line end."""
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7f]", "%20")
    page = F.concat(F.lit(f"<{_PAGE}"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))
    lines = ["WARC/1.1\r\nWARC-Type: ", kind, "\r\nWARC-Record-ID: ", page, "\r\nWARC-Target-URI: ", uri, "\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Payload-Digest: sha1:", F.col("digest"), *more]
    return F.concat(*(F.lit(x) if isinstance(x, str) else x for x in lines))


def records(written: DataFrame, revisits: DataFrame) -> DataFrame:
    """One ``record`` for each page, without the two line ends that close it: HTTP responses, and revisits with the response's head alone."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))

    def whole(head: Column, *block: Column) -> Column:
        length = sum((F.octet_length(b) for b in block[1:]), F.octet_length(block[0]))
        return F.concat(head, F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), length.cast("string"), F.lit("\r\n\r\n"), *block)

    refers = F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: <{_PAGE}"), F.col("refers_to").cast("string"), F.lit(">"))
    responses = written.select(whole(_header(F.lit("response")), http, F.col("html")).alias("record"))
    return responses.unionByName(revisits.select(whole(_header(F.lit("revisit"), refers), http).alias("record")))


def write_streams(found: DataFrame, path: str) -> None:
    """Writes ``found`` (record) as archives that are one gzip stream each, a file for each partition."""
    found.select("record").write.option("lineSep", _END.decode()).option("compression", "gzip").text(path)


# normalising


@contextmanager
def _open_files(spark: SparkSession, most: int) -> Iterator[None]:
    """Within it, a task keeps up to ``most`` files of partitioned output open instead of sorting its rows by file: they are written in the order they come."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, most)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.decode("utf-8", "replace").partition(":") for line in head.split(b"\r\n")[1:])}


class _Records:
    """Cuts a stream of bytes into WARC records: bytes go in as they come, whole records with their closing line ends come out."""

    def __init__(self) -> None:
        self.held, self.need = bytearray(), 0

    def add(self, data: bytes) -> Iterator[bytes]:
        self.held += data
        while len(self.held) >= self.need:
            lead = next((i for i, c in enumerate(self.held) if c not in _END), len(self.held))
            del self.held[:lead]  # more line ends between records than two
            end = self.held.find(_END)
            if end < 0:
                self.need = len(self.held) + 1
                return
            head = bytes(self.held[:end])
            length = _fields(head).get("content-length", "")
            if not head.startswith(b"WARC/") or not re.fullmatch("[0-9]+", length):
                raise ValueError(f"not a WARC record: {head[:80]!r}")
            self.need = end + 4 + int(length) + 4
            if len(self.held) < self.need:
                return
            record = bytes(self.held[: self.need])
            del self.held[: self.need]
            self.need = 0
            yield record

    def rest(self) -> bytes:
        """What is left at the stream's end: the last record where only its line ends lack, or else b""."""
        left = bytes(self.held).strip(b"\r\n")
        if left and len(self.held) < self.need - 4:
            raise ValueError(f"the stream ends within a record: {left[:80]!r}")
        return bytes(self.held[: self.need - 4]) + _END if left else b""


def parsed(record: bytes) -> dict:
    """A record's type, page, payload length and digest, as its header has them."""
    head, _, block = record.partition(_END)
    own = _fields(head)
    kind, page, other = own.get("warc-type"), *(re.fullmatch(rf"<{_PAGE}(-?[0-9]+)>", own.get(k, "")) for k in ("warc-record-id", "warc-refers-to"))
    http, _, payload = block.partition(_END) if own.get("content-type", "").startswith("application/http") else (b"", b"", block)
    length = int(_fields(http).get("content-length", "0") or 0) if kind == "revisit" else max(0, int(own["content-length"]) - (len(block) - len(payload)))
    return {"id": own.get("warc-record-id"), "page_id": page and int(page[1]), "uri": own.get("warc-target-uri"), "record_type": kind, "payload_bytes": length, "payload_digest": own.get("warc-payload-digest", "").removeprefix("sha1:"), "refers_to": other and int(other[1]), "payload": payload[:length]}


def member(record: bytes, level: int = 6) -> bytes:
    """A record as a gzip member of its own. One whose last byte (the length's highest) isn't zero is followed by an empty member, so that all that is written ends in a zero byte."""
    squeeze = zlib.compressobj(level, wbits=31)
    out = squeeze.compress(record) + squeeze.flush()
    return out if out[-1] == 0 else out + _EMPTY


def normalise(spark: SparkSession, streams: str, path: str, file_bytes: int = FILE_BYTES, level: int = 6) -> None:
    """Rewrites the gzip archives at ``streams`` (a folder or pattern) under ``path``: each record a member of its own in ``kind=archive``, each file's index in ``kind=index`` under the same segment and part number.

    Each file is inflated once, as a stream; a task holds one record and one batch. The index is written in the same pass, as gzip members of JSON
    lines with each record's id, page, address, type, payload and place. Archives end after ``file_bytes``. Files that already have a member for each
    record, and files without a record, do as well; a stream that breaks off or holds something else stops the job with the bytes in question.

    Spark's own writer commits the files, so a task that runs again leaves nothing twice. It ends each row by a separator, here the zero byte that closes each member.
    """
    lines = spark.read.option("lineSep", "\n").text(streams)
    lines = lines.select(F.col("value").cast("binary").alias("line"), F.xxhash64("_metadata.file_path").alias("file"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, file, segment, offset, index, out = _Records(), None, 0, 0, [], []
        held = 0

        def put(kind: str, data: bytes) -> None:
            nonlocal held
            out.append((data[:-1], kind, segment))
            held += len(data)

        def indexed() -> None:
            if index:
                put("index", member("".join(json.dumps(x) + "\n" for x in index).encode()))
                index.clear()

        def add(record: bytes) -> None:
            nonlocal offset, segment
            data = member(record, level)
            put("archive", data)
            index.append({k: v for k, v in parsed(record).items() if k != "payload"} | {"offset": offset, "length": len(data)})
            offset += len(data)
            if len(index) == INDEX_LINES or offset >= file_bytes:
                indexed()
            if offset >= file_bytes:
                segment, offset = segment + 1, 0

        def rows() -> pa.RecordBatch:
            nonlocal held
            columns = list(zip(*out, strict=True)) or [[]] * 3
            out.clear()
            held = 0
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.string(), pa.int32()), strict=True)], ["value", "kind", "segment"])

        def ended() -> None:
            if last := cut.rest():
                add(last)

        for batch in batches:
            files = batch.column(1).to_numpy()
            at = 0
            while at < len(files):
                if files[at] != file:
                    ended()
                    cut, file = _Records(), files[at]
                end = at + int((files[at:] == file).argmin() or len(files) - at)
                for record in cut.add(b"\n".join([*batch.column(0).slice(at, end - at).to_pylist(), b""])):
                    add(record)
                    if held >= 1 << 22:
                        yield rows()
                at = end
        ended()
        indexed()
        yield rows()

    found = lines.mapInArrow(run, "value binary, kind string, segment int")
    with _open_files(spark, 4096):
        found.select(F.col("value").cast("string").alias("value"), "kind", "segment").write.partitionBy("kind", "segment").option("lineSep", "\0").text(path)


# reading

_INDEX = "part int, segment int, offset long, length long, id string, page_id long, uri string, record_type string, payload_bytes long, payload_digest string, refers_to long"
_READ = "part int, segment int, offset long, length long, page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
_SCHEMAS = {"index": _INDEX, "read": _READ}


def _files(spark: SparkSession, path: str, kind: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    if "kind" not in files.columns:  # nothing was written
        files = files.withColumns({"kind": F.lit(kind), "segment": F.lit(0)})
    return files.where(F.col("kind") == kind).select(F.regexp_extract("path", r"part-(\d+)-[^/]*$", 1).cast("int").alias("part"), "segment", "content")


def _members(data: memoryview, at: int = 0) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of each member that holds anything; an empty one belongs to the one before."""
    held = None
    while at < len(data):
        inflate = zlib.decompressobj(wbits=31)
        content, used = bytearray(), at
        while not inflate.eof:
            if used >= len(data):
                raise ValueError("an archive ends within a member")
            piece = data[used : used + (1 << 20)]
            content += inflate.decompress(piece)
            used += len(piece) - len(inflate.unused_data)
        if content:
            if held:
                yield held
            held = (at, used - at, bytes(content))
        elif held:
            held = (held[0], used - held[0], held[2])
        at = used
    if held:
        yield held


def _batch(schema: str, rows: list[dict]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [f.split() for f in _SCHEMAS[schema].split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds[t]) for n, t in fields], [n for n, _ in fields])


def _mapped(files: DataFrame, schema: str, rows_of: Callable[..., Iterator[dict]]) -> DataFrame:
    """What ``rows_of`` makes of each file's row, in batches of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                part, segment, content, *more = (batch.column(k)[i] for k in range(batch.num_columns))
                for row in rows_of(memoryview(content.as_buffer()), *(x.as_py() for x in more)):
                    out.append(row | {"part": part.as_py(), "segment": segment.as_py()})
                    held += 200 + len(row.get("payload") or b"")
                    if held >= 1 << 22:
                        yield _batch(schema, out)
                        out, held = [], 0
        yield _batch(schema, out)

    return files.mapInArrow(run, _SCHEMAS[schema])


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The sidecars of ``normalise``'s archives: where each record stands (part, segment, offset, length) and what its header says."""

    def rows_of(data: memoryview) -> Iterator[dict]:
        for _, _, lines in _members(data):
            yield from map(json.loads, lines.decode().splitlines())

    return _mapped(_files(spark, path, "index"), "index", rows_of)


def _record(at: int, length: int, content: bytes) -> dict:
    """A record as it is read: a response's length and digest are its payload's own, a revisit's those its header names. A payload that isn't what the header says stops the job."""
    own = parsed(content)
    if own["record_type"] != "revisit":
        digest = hashlib.sha1(own["payload"], usedforsecurity=False).hexdigest()
        if own["payload_digest"] not in ("", digest):
            raise ValueError(f"{own['id']}: the payload's digest is {digest}, not {own['payload_digest']}")
        own |= {"payload_bytes": len(own["payload"]), "payload_digest": digest}
    return own | {"offset": at, "length": length}


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """All records of ``normalise``'s archives, whole or without their payloads, member by member."""

    def rows_of(data: memoryview) -> Iterator[dict]:
        for x in _members(data):
            yield _record(*x) | ({} if payloads else {"payload": None})

    return _mapped(_files(spark, path, "archive"), "read", rows_of)


def fetch(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The records at the places of ``wanted``, rows of the index. Up to a bound the places go to the tasks that read, and only the members asked for are inflated; beyond it all records are read and joined."""
    places = wanted.select("part", "segment", "offset", "length").distinct()
    if places.count() > MOST_BROADCAST:
        return read_archives(spark, path, True).join(places.drop("length"), ["part", "segment", "offset"], "left_semi")

    def rows_of(data: memoryview, own: list[dict]) -> Iterator[dict]:
        for place in own:
            yield from (_record(*x) for x in [next(_members(data, place["offset"]))])

    by_file = places.groupBy("part", "segment").agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("own"))
    return _mapped(_files(spark, path, "archive").join(F.broadcast(by_file), ["part", "segment"]).select("part", "segment", "content", "own"), "read", rows_of)


def write_and_read(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) as whole-file gzip archives, normalises them, and reads every record back: part, segment, offset, length, page_id, record_type, payload_bytes, payload_digest, refers_to. Repeated rows are records each; an empty table gives archives without records."""
    spark = pages.sparkSession
    streams, archives = shared_path(spark, "streams"), shared_path(spark, "archives")
    write_streams(records(*deduplicated(pages, least)), streams)
    normalise(spark, streams, archives)
    return read_archives(spark, archives).drop("payload")


ORACLE_SQL = """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
         q AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest, max(page_id) OVER (PARTITION BY html) AS last FROM p)
    SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to
    FROM q
"""
