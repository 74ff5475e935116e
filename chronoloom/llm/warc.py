"""WARC archives with a two-level capture index.

Pages are written in order of their reversed-host URL key, one archive file
per task, each record a gzip member of its own. Index lines in the same order
are compressed in blocks, and a sparse directory per archive holds the first
key of each block. A lookup binary-searches the archives' first keys, the
directory and the block, and then reads one byte range of the archive.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm.common import materialize, open_fs, shared_folder, sized_broadcast, table

MIN_REVISIT_BYTES, BLOCK_LINES = 1000, 512
#: Repeated digests (about 100 bytes each) that are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 200_000
CAPTURED = "1970-01-01T00:00:00Z"
END = b"\r\n"


def url_key(url: Column) -> Column:
    """com,example,www)/path?query of a URL: the host lower-cased and reversed by labels; empty for null."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    host = F.regexp_extract(text, r"^[^:/?#]*://([^/?#]*)", 1)
    rest = F.regexp_replace(text, r"^[^:/?#]*://[^/?#]*", "")
    return F.when(text == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(F.lower(host), r"\.")), ","), F.lit(")"), rest))


def header_value(s: str) -> str:
    return re.sub(r"[\x00-\x20\x7f-\U0010ffff]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode("utf-8", "replace")), s)


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, is_revisit: bool, refers_url: str | None) -> bytes:
    """One WARC record; a revisit carries the response's HTTP header but not its body."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if is_revisit else http + payload
    urn = lambda x: "<urn:page:" + header_value(json.dumps(x).replace("%", "\\u0025")) + ">"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: {urn(page_id)}",
        f"WARC-Date: {CAPTURED}",
        f"WARC-Target-URI: {header_value(url or '')}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
    ]
    if is_revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {urn(refers_to)}", f"WARC-Refers-To-Target-URI: {header_value(refers_url or '')}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return END.join(x.encode() for x in head) + END * 2 + block + END * 2


def parse_record(data: bytes) -> dict:
    """Fields of one record; a response's payload digest is computed again and must equal its header."""
    head, _, rest = data.partition(END * 2)
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(END * 2)
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged payload in record {fields['WARC-Record-ID']}")
    urn = lambda x: json.loads(re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), x.removeprefix("<urn:page:").removesuffix(">"))) if x else None
    return {
        "id": urn(fields["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": digest, "record_type": kind,
        "refers_to": urn(fields.get("WARC-Refers-To")), "payload": payload if kind == "response" else None,
    }


@dataclass
class Archive:
    """A written archive: its folder, and one row per task's files (directory, first and last key), in key order."""

    folder: str
    parts: list[dict]
    id_type: str


def planned(pages: DataFrame, id_col: str, url_col: str, html_col: str, min_bytes: int) -> DataFrame:
    """(id, url, key, payload, digest, is_revisit, refers_to, refers_url) of each page."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"key": url_key(F.col("url")), "digest": F.sha1(F.col("payload").cast("binary")), "size": F.octet_length("payload")})
    large = rows.filter(F.col("size") >= min_bytes).groupBy("digest", "size").agg(F.count("*").alias("c"), F.max(F.struct("id", "url")).alias("top"))
    twice = materialize(large.filter("c > 1").select(F.col("digest").alias("_d"), F.col("size").alias("_n"), "top"), "digests")
    both = rows.join(sized_broadcast(twice, BROADCAST_ROWS), (F.col("digest") == F.col("_d")) & (F.col("size") == F.col("_n")), "left")
    revisit = F.col("top.id").isNotNull() & ~F.col("id").eqNullSafe(F.col("top.id"))
    return both.select(
        "id", "url", "key", "payload", "digest", revisit.alias("is_revisit"), F.when(revisit, F.col("top.id")).alias("refers_to"), F.when(revisit, F.col("top.url")).alias("refers_url")
    )


def write_archive(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_REVISIT_BYTES) -> Archive:
    """Write records, index blocks and directories of pages under a shared folder.

    Of payloads of at least min_bytes that are equal, the one with the largest
    id is the response and the others are revisits; where all their ids are
    null, or for equal ids, each is a response. A null payload is empty, a null
    url has the empty key. File names hold the task attempt, so a repeated task
    leaves the files of its lost attempt unused.
    """
    spark = pages.sparkSession
    folder = folder or shared_folder(spark, "warc")
    rows = planned(pages, id_col, url_col, html_col, min_bytes)
    kind = rows.schema["id"].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = open_fs(folder)
        store.create_dir(top, recursive=True)
        task = TaskContext.get()
        name = f"{task.partitionId():05d}-{task.taskAttemptId()}"
        lines, directory, first, last, at, offset, count = [], [], None, None, 0, 0, 0
        out = index = None

        def flush() -> None:
            nonlocal lines, at
            if lines:
                data = zlib.compress("\n".join(lines).encode())
                directory.append([*json.loads(lines[0])[:2], at, len(data)])
                index.write(data)
                at, lines = at + len(data), []

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                page_id, url, key, payload, digest, is_revisit, refers_to, refers_url = r
                if out is None:
                    out, index = store.open_output_stream(f"{top}/{name}.warc.gz", compression=None), store.open_output_stream(f"{top}/{name}.idx", compression=None)
                    first = [key, page_id]
                last = [key, page_id]
                c = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = c.compress(record(page_id, url, payload.encode(), digest, refers_to, is_revisit, refers_url)) + c.flush()
                out.write(data)
                lines.append(json.dumps([key, page_id, offset, len(data)]))
                offset, count = offset + len(data), count + 1
                if len(lines) == BLOCK_LINES:
                    flush()
        if out is not None:
            flush()
            out.close()
            index.close()
            with store.open_output_stream(f"{top}/{name}.dir", compression=None) as f:
                f.write(zlib.compress(json.dumps(directory).encode()))
            row = [[name], [json.dumps(first)], [json.dumps(last)], [count]]
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], names=["name", "first", "last", "n"])

    ordered = rows.repartitionByRange("key", "id").sortWithinPartitions("key", "id")
    written = materialize(ordered.mapInArrow(kernel, "name string, first string, last string, n bigint"), "archive")
    # one row per writing task, whatever the number of pages
    parts = [{"name": r.name, "first": json.loads(r.first), "last": json.loads(r.last)} for r in written.collect()]
    return Archive(folder, sorted(parts, key=lambda p: rank(*p["first"])), kind)


def rank(key: str, page_id) -> tuple:
    """The order in which Spark sorts (key, id): by bytes of the key, null ids first."""
    return key.encode("utf-8", "surrogatepass"), page_id is not None, page_id if page_id is not None else 0


class Searcher:
    """Lookups in one archive; holds one directory and one decompressed block at a time."""

    def __init__(self, archive: Archive):
        self.store, self.top = open_fs(archive.folder)
        self.parts = archive.parts
        self.firsts = [rank(*p["first"]) for p in archive.parts]
        self.part, self.block, self.files = None, None, {}

    def read(self, name: str, at: int, size: int) -> bytes:
        if name not in self.files:
            if len(self.files) > 8:
                self.files.pop(next(iter(self.files))).close()
            self.files[name] = self.store.open_input_file(f"{self.top}/{name}")
        return bytes(self.files[name].read_at(size, at))

    def open_part(self, i: int) -> None:
        if self.part != i:
            with self.store.open_input_stream(f"{self.top}/{self.parts[i]['name']}.dir", compression=None) as f:
                self.directory = json.loads(zlib.decompress(f.read()))
            self.part, self.block, self.starts = i, None, [rank(*d[:2]) for d in self.directory]

    def open_block(self, i: int, j: int) -> None:
        self.open_part(i)
        if self.block != j:
            data = self.read(f"{self.parts[i]['name']}.idx", *self.directory[j][2:])
            self.lines = [json.loads(x) for x in zlib.decompress(data).decode().split("\n")]
            self.block, self.ranks = j, [rank(*x[:2]) for x in self.lines]

    def find(self, key: str, page_id) -> Iterator[dict]:
        """Every capture with this key and id: a run of equal lines may go on over blocks and archives."""
        want = rank(key, page_id)
        i = max(0, bisect.bisect_left(self.firsts, want) - 1)
        while i < len(self.parts) and self.firsts[i] <= want:
            self.open_part(i)
            j = max(0, bisect.bisect_left(self.starts, want) - 1)
            while j < len(self.directory) and self.starts[j] <= want:
                self.open_block(i, j)
                k = bisect.bisect_left(self.ranks, want)
                while k < len(self.ranks) and self.ranks[k] == want:
                    _, _, at, size = self.lines[k]
                    yield parse_record(zlib.decompress(self.read(f"{self.parts[i]['name']}.warc.gz", at, size), 31))
                    k += 1
                j += 1
            i += 1


def lookup(spark: SparkSession, archive: Archive, wanted: DataFrame, with_payload: bool = False) -> DataFrame:
    """Captures of each distinct (key, id) of wanted, read through the index.

    Requests are range-partitioned and sorted like the archive, so that a task
    opens few files and each index block once.
    """
    names = ["id", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["payload"] if with_payload else [])]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Searcher(archive)
        for batch in batches:
            kind = batch.column(1).type
            kinds = [kind, pa.int64(), pa.string(), pa.string(), kind, pa.binary()]
            rows, size = [], 0
            for key, page_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for found in search.find(key, page_id):
                    rows.append(found)
                    size += found["payload_bytes"] if with_payload else 0
                    if size > 1 << 25:
                        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=False)], names=names)
                        rows, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=False)], names=names)

    schema = f"id {archive.id_type}, payload_bytes bigint, payload_digest string, record_type string, refers_to {archive.id_type}" + (", payload binary" if with_payload else "")
    # as many tasks as archives: requests are small but each costs a read, so their bytes mustn't decide the number
    asked = wanted.select("key", "id").distinct().repartitionByRange(max(1, len(archive.parts)), "key", "id").sortWithinPartitions("key", "id")
    return asked.mapInArrow(kernel, schema)


def op4_warc(spark, sf_dir: str) -> DataFrame:
    """Write all pages, then look every page up in the archives."""
    pages = table(spark, sf_dir, "pages")
    archive = write_archive(pages)
    wanted = pages.select(url_key(F.col("url")).alias("key"), F.col("page_id").alias("id"))
    return lookup(spark, archive, wanted).withColumnRenamed("id", "page_id")


ORACLE = """with p as (select page_id, coalesce(html, '') as body, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes from pages),
  d as (select page_id, payload_bytes, sha1(body) as payload_digest,
    case when payload_bytes >= 1000 then max(page_id) over (partition by sha1(body), payload_bytes) else page_id end as top from p)
  select page_id, payload_bytes, payload_digest, case when page_id = top then 'response' else 'revisit' end as record_type,
    case when page_id <> top then top end as refers_to from d"""
