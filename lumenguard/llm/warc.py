"""WARC archives of captures, and their index by an external merge.

Writing: of captures with equal payloads (of ``least_revisit`` bytes or more) the one with the greatest page_id is a response,
the others are revisits that refer to it. Groups are found on digests alone, reduced in each task first; the pages then move once,
by page_id. Each task sorts its captures by URL key and time and writes them, one gzip member each, to an archive of its own in a
shared folder, through the file system that the folder's address names. Its index rows are a locally sorted run. Runs are written as a table,
and only archives that it names count, so what a lost or repeated task left behind is never read.

Index: runs are dealt by ranges of (URL key, time, page_id), so a URL with very many captures takes several ranges; there are enough of them
for about ``RANGE_ROWS`` rows each at most, whatever the size of the index. Each range has a slice of every run, still sorted, in
columns, and merges them by a tree of losers that has a few rows of each slice as objects at a time. Ranges follow one another, and with their sizes summed
every capture gets its place in the global order and in the history of its URL.

Reading goes through the archives member by member, archives dealt over all tasks.

Nulls: a null html is an empty payload; a null url is archived without target and has an empty key; a null page_id is written as ``null`` and is
a response. Rows with equal page_id and payload are both what that page is. Empty pages give an empty result. Other columns don't matter. An archive
is read and written record by record, so it may be of any size.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import new_path, staged
from .url_filter import after_scheme, host_of, path_of

RANGE_ROWS, MERGE_BATCH = 500_000, 2_000
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = re.compile(rb"<urn:x-page:(-?\d+|null)>")
INDEX = "url_key string, captured long, page_id long, record_type string, digest string, file string, offset long, length long"


def url_key(url: Column) -> Column:
    """Labels of the host from last to first, then path and query."""
    query = F.regexp_extract(after_scheme(url), r"\?[^#]*", 0)
    return F.coalesce(F.concat(F.array_join(F.reverse(F.split(host_of(url), r"\.")), ","), F.lit(")"), path_of(url), query), F.lit(""))


def planned(pages: DataFrame, captured: Column, least_revisit: int) -> DataFrame:
    """(page_id, url, html, url_key, captured, refers_to), refers_to being null for responses."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), captured.alias("captured"), F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).alias("size"))
    light = rows.select("page_id", "digest", "size").distinct()
    first = light.where(F.col("size") >= least_revisit).groupBy("digest").agg(F.max("page_id").alias("response"))
    other = light.join(first, "digest").where(F.col("page_id") < F.col("response")).select(F.col("page_id").alias("r_id"), F.col("digest").alias("r_digest"), F.col("response").alias("refers_to"))
    both = rows.join(other, (F.col("page_id") == F.col("r_id")) & (F.col("digest") == F.col("r_digest")), "left")
    return both.select("page_id", "url", "html", url_key(F.col("url")).alias("url_key"), "captured", "refers_to")


def record(page_id: int | None, url: str | None, payload: bytes, captured: int, refers_to: int | None) -> tuple[bytes, str]:
    """A WARC record and the payload's digest."""
    name = lambda i: f"<urn:x-page:{'null' if i is None else i}>"
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    date = datetime.datetime.fromtimestamp(captured, datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {name(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n", digest


def place(folder: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def write(captures: DataFrame, folder: str) -> DataFrame:
    """Write ``planned`` captures below ``folder``; the index rows of all archives, staged."""
    names = [x.split()[0] for x in INDEX.split(", ")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, out, file, at = None, None, "", 0
        for b in batches:
            rows = []
            for page_id, url, html, key, captured, refers_to in zip(*[b.column(c) for c in ("page_id", "url", "html", "url_key", "captured", "refers_to")], strict=True):
                if out is None:
                    fs, root = place(folder)
                    fs.create_dir(root, recursive=True)
                    file = f"{uuid.uuid4().hex}.warc.gz"
                    out = fs.open_output_stream(f"{root}/{file}", compression=None)
                raw, digest = record(page_id.as_py(), url.as_py(), html.as_py().encode("utf-8", "surrogatepass"), captured.as_py(), refers_to.as_py())
                pack = zlib.compressobj(3, zlib.DEFLATED, 31)
                member = pack.compress(raw) + pack.flush()
                out.write(member)
                rows.append((key.as_py(), captured.as_py(), page_id.as_py(), "response" if refers_to.as_py() is None else "revisit", digest, file, at, len(member)))
                at += len(member)
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
        if out is not None:
            out.close()

    return staged(captures.sortWithinPartitions("url_key", "captured", "page_id").mapInArrow(each, INDEX), "cdx")


class LoserTree:
    """Merges sorted iterators: each inner node keeps the loser of its match, so a new item climbs one path."""

    def __init__(self, runs: list[Iterator], key: Callable) -> None:
        self.runs, self.key, self.n = runs, key, len(runs)
        self.heads = [next(r, None) for r in runs]
        self.losers = [-1] * max(self.n, 1)
        for i in range(self.n):
            self.climb(i)

    def beats(self, a: int, b: int) -> bool:
        """An empty seat of the first matches beats all; an exhausted run loses to all."""
        if a < 0 or b < 0:
            return a < 0
        if self.heads[a] is None or self.heads[b] is None:
            return self.heads[a] is not None
        return (self.key(self.heads[a]), a) < (self.key(self.heads[b]), b)

    def climb(self, winner: int) -> None:
        node = (winner + self.n) // 2
        while node > 0:
            if self.beats(self.losers[node], winner):
                winner, self.losers[node] = self.losers[node], winner
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator:
        while self.n and self.losers[0] >= 0 and (head := self.heads[self.losers[0]]) is not None:
            yield head
            i = self.losers[0]
            self.heads[i] = next(self.runs[i], None)
            self.climb(i)


def sort_key(row: tuple) -> tuple:
    """Strings as UTF-8, and null ids first, as Spark orders them."""
    return row[0].encode("utf-8", "surrogatepass"), row[1], row[2] is not None, row[2] or 0


def merged(index: DataFrame) -> DataFrame:
    """The index in global order: with ``place`` from 0, and ``capture_no`` from 1 in the history of its URL key."""
    names = [x.split()[0] for x in INDEX.split(", ")]

    def rows_of(run: pa.Table) -> Iterator[tuple]:
        for b in run.to_batches(max_chunksize=MERGE_BATCH):  # a run's rows become objects a few at a time
            yield from zip(*[b.column(c).to_pylist() for c in names], strict=True)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [b for b in batches if b.num_rows]
        if not tables:
            return
        rows = pa.Table.from_batches(tables)
        part = rows.column("part")[0].as_py()
        files = rows.column("file").combine_chunks()
        cuts = [0, *(pc.indices_nonzero(pc.not_equal(files[1:], files[:-1])).to_numpy() + 1).tolist(), len(files)]  # rows come by run, each in its order
        tree = iter(LoserTree([rows_of(rows.slice(s, e - s)) for s, e in zip(cuts, cuts[1:], strict=False)], sort_key))
        at = 0
        while out := list(islice(tree, MERGE_BATCH)):
            columns = [pa.array(c, rows.schema.field(n).type) for c, n in zip(zip(*out, strict=True), names, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([part] * len(out), pa.int32()), pa.array(range(at, at + len(out)), pa.int64())], [*names, "part", "at"])
            at += len(out)

    parts = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-index.count() // RANGE_ROWS))
    slices = index.repartitionByRange(parts, "url_key", "captured", "page_id").sortWithinPartitions("file", "offset")
    rows = staged(slices.withColumn("part", F.spark_partition_id()).mapInArrow(each, f"{INDEX}, part int, at long"), "captures")
    sums = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row for each range
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    placed = rows.join(sums.select("part", before.alias("b")), "part").withColumn("place", F.col("b") + F.col("at"))
    starts = placed.groupBy("url_key").agg(F.min("place").alias("f"))
    return placed.join(starts, "url_key").select(*names, "place", (F.col("place") - F.col("f") + 1).alias("capture_no"))


def parsed(raw: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, intact) of a record."""
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
    block = block[: int(fields[b"Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    page = lambda x: None if (i := ID.fullmatch(x)[1]) == b"null" else int(i)
    kind, digest = fields[b"WARC-Type"].decode(), fields[b"WARC-Payload-Digest"].decode().removeprefix("sha1:")
    intact = kind == "revisit" or (len(payload) == size and base64.b32encode(hashlib.sha1(payload).digest()).decode() == digest)
    return page(fields[b"WARC-Record-ID"]), size, digest, kind, page(fields[b"WARC-Refers-To"]) if kind == "revisit" else None, intact


def members(stream: pa.NativeFile) -> Iterator[bytes]:
    """Gzip members one by one."""
    rest = b""
    while data := rest or stream.read(1 << 20):
        unpack, out = zlib.decompressobj(31), []
        while not unpack.eof:
            if not data and not (data := stream.read(1 << 20)):
                raise EOFError("an archive ends inside a record")
            out.append(unpack.decompress(data))
            data = b""
        rest = unpack.unused_data
        yield b"".join(out)


def read(spark: SparkSession, index: DataFrame, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of all records in the archives that ``index`` names."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file in b.column("file").to_pylist():
                fs, root = place(folder)
                rows = []
                with fs.open_input_stream(f"{root}/{file}", compression=None) as stream:
                    for raw in members(stream):
                        *row, intact = parsed(raw)
                        if not intact:
                            raise ValueError(f"{file}: the payload of page {row[0]} has another digest or length than its record says")
                        rows.append(tuple(row))
                        if len(rows) == 5_000:
                            yield batch(rows)
                            rows = []
                if rows:
                    yield batch(rows)

    files = staged(index.select("file").distinct(), "files")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(parts).mapInArrow(each, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archived_and_read(pages: DataFrame, captured: Column, least_revisit: int = 0) -> tuple[DataFrame, DataFrame]:
    """(records read back, merged index)."""
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    index = write(planned(pages, captured, least_revisit), folder)
    return read(spark, index, folder), merged(index)
