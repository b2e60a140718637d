"""WARC archives: writing with revisits, reading, and capture histories by an external index merge."""

from __future__ import annotations

import base64
import gzip
import hashlib
import itertools
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.common import cut, shared_dir

END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
INDEX = "urlkey string, captured string, page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, file string, offset long, length long"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column: 15 hexadecimal digits are 12 base-32 digits."""
    sha = F.sha1(payload)
    digits = [F.lpad(F.conv(F.substring(sha, at, n), 16, 32), n * 4 // 5, "0") for at, n in ((1, 15), (16, 15), (31, 10))]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def url_key(url: str) -> str:
    """A sort-friendly key: host labels reversed, no scheme, www, port 80/443 or fragment; lower case; sorted query."""
    found = re.match(r"(?:[a-z][a-z0-9+.-]*:)?(?://)?([^/?#]*)([^?#]*)(?:\?([^#]*))?", url.strip().lower())
    host, path, query = found[1], found[2] or "/", found[3]
    host = re.sub(r":(?:80|443)$", "", host.rpartition("@")[2])
    labels = re.sub(r"^www\d*\.", "", host).split(".")
    return f"{','.join(reversed(labels))}){path}" + (f"?{'&'.join(sorted(query.split('&')))}" if query else "")


def dedup_captures(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Decide which captures are responses and which revisit an equal payload.

    Of captures with equal payloads of at least least_bytes bytes, the one with the largest page_id is the response.
    Null html is an empty payload; null page_ids come before all others; rows equal in both payload and
    page_id are all responses. The group's largest id is found by a partial aggregate and joined back, so a payload that a
    third of all pages share is split like any skewed join.
    """
    p = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("payload"))
    p = p.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": base32_sha1(F.col("payload").cast("binary"))})
    tops = p.where(F.col("payload_bytes") >= least_bytes).groupBy(F.col("payload_digest").alias("of")).agg(F.max("page_id").alias("top"))
    p = p.join(tops, (F.col("payload_digest") == F.col("of")) & (F.col("payload_bytes") >= least_bytes), "left")
    revisit = F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    return p.select("page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("top")).alias("refers_to"))


def write_warc(pages: DataFrame, path: str, least_bytes: int = 0, file_bytes: int = 32 << 20) -> None:
    """Write one WARC/1.1 record per page into gzip files of about file_bytes of text under path, by Spark's text writer.

    A record ends with two line ends, which is the writer's line separator, so each file is a plain WARC file that
    other readers take too. A revisit carries no payload; it names the full payload's digest and size. Without a
    capture time in the table, page_id seconds after 2000-01-01 stand for it. Control characters and spaces in a
    URL are written percent-coded; a null URL is empty. A file holds as many records as make file_bytes on average; one with very long pages
    is as much longer, and reading it back (whole, by Spark's binary files) bounds a file at 2 GiB unpacked or packed.
    """
    records = dedup_captures(pages, least_bytes)
    total, n = pages.agg(F.coalesce(F.sum(F.octet_length("html")), F.lit(0)), F.count("*")).first()
    url = F.coalesce(F.col("url"), F.lit(""))
    for code in (*range(33), 127):
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    seconds = F.pmod(F.coalesce(F.col("page_id"), F.lit(0)), F.lit(3_000_000_000))
    date = lambda c: F.date_format(F.timestamp_seconds(F.lit(946_684_800) + c), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    is_revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit(HTTP), F.col("payload_bytes").cast("string"), F.lit(END))
    block = F.when(is_revisit, http).otherwise(F.concat(http, F.col("payload")))
    refers = F.when(is_revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), name(F.col("refers_to")))).otherwise("")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.col("record_type"), F.lit("\r\nWARC-Target-URI: "), url, F.lit("\r\nWARC-Date: "), date(seconds),
        F.lit("\r\nWARC-Record-ID: "), name(F.col("page_id")), F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.lit("\r\nWARC-Payload-Length: "), F.col("payload_bytes").cast("string"), refers,
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END),
    )
    # The payloads move once, in the join that finds revisits; its partitions are written as they are.
    spread = records.select(F.concat(head, block).alias("value")).write.option("lineSep", END).option("compression", "gzip")
    spread.option("maxRecordsPerFile", max(1, file_bytes * n // max(total, 1))).text(path)


def read_records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers by lower-case name, block) of each record of an uncompressed WARC file."""
    at = 0
    while (start := data.find(b"WARC/", at)) >= 0:
        body = data.index(b"\r\n\r\n", start) + 4
        lines = data[start : body - 4].decode().split("\r\n")[1:]
        headers = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        stop = body + int(headers["content-length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"WARC record at {start} doesn't end where its Content-Length says")
        yield start, stop + 4 - start, headers, data[body:stop]
        at = stop + 4


def capture(file: str, offset: int, length: int, headers: dict[str, str], block: bytes) -> tuple:
    """The index row of a record; a response's size and digest are computed from its bytes and checked."""
    size, digest = int(headers["warc-payload-length"]), headers["warc-payload-digest"].removeprefix("sha1:")
    if headers["warc-type"] == "response":
        payload = block[block.index(b"\r\n\r\n") + 4 :]
        found = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if found != (size, digest):
            raise ValueError(f"payload of {headers['warc-record-id']} doesn't match its digest")
    number = lambda name: int(x) if (x := headers.get(name, "").removeprefix("<urn:page:").rstrip(">")) else None
    return url_key(headers["warc-target-uri"]), headers["warc-date"], number("warc-record-id"), headers["warc-type"], size, digest, number("warc-refers-to"), file, offset, length


def sort_key(row: tuple) -> tuple:
    """URL key, time, page_id (null first), file, offset."""
    return row[0], row[1], row[2] is not None, row[2] or 0, row[7], row[8]


def loser_tree_merge(runs: Iterable[Iterable[tuple]]) -> Iterator[tuple]:
    """Merge sorted runs of index rows, holding one row of each: each inner node keeps the loser of its match, and a new head
    replays one path to the top."""
    rest = [iter(r) for r in runs]
    k = len(rest)
    over = (1,)  # above every (0, key)
    rows: list[tuple | None] = [next(r, None) for r in rest]
    head = [over if r is None else (0, *sort_key(r)) for r in rows]
    losers = [0] * max(k, 1)

    def build(node: int) -> int:
        if node >= k:
            return node - k
        a, b = build(2 * node), build(2 * node + 1)
        win, lose = (a, b) if head[a] <= head[b] else (b, a)
        losers[node] = lose
        return win

    if not k:
        return
    top = build(1) if k > 1 else 0
    while head[top] != over:
        yield rows[top]
        rows[top] = next(rest[top], None)
        head[top] = over if rows[top] is None else (0, *sort_key(rows[top]))
        node = (top + k) // 2
        while node >= 1 and k > 1:
            if head[losers[node]] < head[top]:
                top, losers[node] = losers[node], top
            node //= 2


#: Runs that are merged at once, and rows of a batch.
FAN_IN, BATCH = 64, 10_000


class Spool:
    """The sorted runs of one task, spilled to an unnamed local file batch by batch and read back one batch of each at a time.

    FAN_IN runs of a level are merged into one of the next level as soon as they are there, so the open batches, the entries kept of runs and the files they come from
    stay bounded however many archives there are; a row is merged once a level.
    """

    def __init__(self) -> None:
        self.file, self.levels, self.schema = tempfile.TemporaryFile(), [], None
        self.name, self.places = None, []

    def spill(self, batch: pa.RecordBatch) -> tuple[int, int]:
        raw = batch.serialize()
        place = self.file.seek(0, 2), raw.size
        self.file.write(raw)
        return place

    def add(self, batch: pa.RecordBatch) -> None:
        """Rows come run after run."""
        names = batch.column("run").dictionary_encode()
        at = names.indices.to_numpy(zero_copy_only=False)
        batch = batch.drop_columns(["run"])
        self.schema = batch.schema
        cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)] if len(at) else [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            name = names.dictionary[int(at[a])].as_py()
            if name != self.name:
                self.close()
                self.name = name
            self.places.append(self.spill(batch.slice(a, b - a)))

    def close(self) -> None:
        """The run at hand is whole."""
        run, level, self.places = self.places, 0, []
        while run:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < FAN_IN:
                return
            run = [self.spill(b) for b in self.batches(loser_tree_merge(map(self.run, self.levels[level])))]
            self.levels[level] = []
            level += 1

    def run(self, places: list[tuple[int, int]]) -> Iterator[tuple]:
        for start, size in places:
            self.file.seek(start)
            batch = pa.ipc.read_record_batch(pa.py_buffer(self.file.read(size)), self.schema)
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def batches(self, rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        while part := list(itertools.islice(rows, BATCH)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), self.schema, strict=True)], schema=self.schema)

    def merged(self) -> Iterator[pa.RecordBatch]:
        """All rows in order; of each level fewer than FAN_IN runs are left."""
        self.close()
        return self.batches(loser_tree_merge(self.run(r) for level in self.levels for r in level))


def index_runs(spark: SparkSession, path: str) -> DataFrame:
    """One locally sorted run of captures per archive file. Files are read whole; the writer bounds their size."""

    def parse(batches: Iterable) -> Iterator:
        import pandas as pd

        for batch in batches:
            for file, data in zip(batch["path"], batch["content"], strict=True):
                rows = sorted((capture(file, *r) for r in read_records(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else bytes(data))), key=sort_key)
                frame = pd.DataFrame(rows, columns=[c.split()[0] for c in INDEX.split(", ")]).astype({"page_id": "Int64", "refers_to": "Int64"})
                yield frame.assign(run=file)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(parse, f"{INDEX}, run string")


def capture_history(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """All captures in the archives under path, ordered by URL key and time over the whole result.

    The runs are dealt by ranges of (URL key, time, page_id), so even one URL's captures split. Each task spills its slices of the
    runs to local disk as they come and merges them with loser trees in passes of at most FAN_IN runs, a batch of each in memory. Ranges are
    sized by Spark. Rows equal in all of URL, time and page_id come in the order of file and offset.
    """
    runs = cut(index_runs(spark, path), "runs")
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The order within a run is sort_key's: Spark orders text by bytes and Python by code points, which is the same, and nulls first.
    dealt = runs.repartitionByRange(n, "urlkey", "captured", "page_id", "file", "offset").sortWithinPartitions("run", "urlkey", "captured", "page_id", "file", "offset")

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spool = Spool()
        for batch in batches:
            spool.add(batch)
        yield from spool.merged()

    return dealt.mapInArrow(merge, INDEX)


def op8_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives are written to the shared folder, read back and merged; an empty table gives an empty result."""
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return capture_history(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = {
    "op8_warc_archives": """
        with p as (select page_id, coalesce(html, '') as payload from pages),
        d as (select page_id, strlen(payload) as payload_bytes, sha1(payload) as sha, max(page_id) over (partition by payload) as top from p),
        b as (select *, list_aggregate(list_transform(range(40), lambda i: format('{:04b}', instr('0123456789abcdef', sha[i + 1]) - 1)), 'string_agg', '') as bits from d)
        select page_id, payload_bytes,
            list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                1 + list_sum(list_transform(range(5), lambda j: (bits[5 * i + j + 1])::int * (16 >> j::int)))::int, 1)), 'string_agg', '') as payload_digest,
            case when page_id = top then 'response' else 'revisit' end as record_type,
            case when page_id <> top then top end as refers_to
        from b"""
}
