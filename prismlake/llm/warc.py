"""WARC archives of pages, and an index of their captures by external merge.

A page is a record; of records with equal payloads the last page's is the response, and the others revisit it, without a payload. A
Spark data source writes records as gzip members to archives in a shared folder, and reads archives record by record, checking
digests. What a task reads is a run of captures, sorted where it was read; runs are written, dealt by ranges of URL key and time, and
merged in each range by a tree of losers, which gives all captures in one order: each URL's history stands together, by time.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import uuid
import zlib
from base64 import b32decode, b32encode
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import quote, unquote_to_bytes

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from prismlake.llm.common import copies, fresh, kept, key_of, new_path, size_bins, small, spread_join
from prismlake.llm.media import LIST, ArchiveWriter, Written, _open
from prismlake.ordering import placed
from prismlake.shipping import ship

#: Payloads of fewer bytes are responses, whatever they equal.
LEAST_BYTES = 1000
#: Bytes of an archive after which a task begins another, and of the index that a range holds.
ARCHIVE, RANGE = 32 << 20, 16 << 20
#: Pages that are repeated or revisit others, whose keys are sent to all executors at most.
KEYS = 1_000_000
#: A URL's host, and its path and query.
PARTS = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^#]*)"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WRITTEN = "page_id bigint, url string, at bigint, payload binary, n_bytes bigint, digest binary, refers boolean, refers_to bigint"
READ = "page_id bigint, url string, at bigint, payload_bytes bigint, payload_digest string, record_type string, refers boolean, refers_to bigint, archive string, offset bigint"
ORDER = ["url_key", "at", "page_id", "payload_digest", "record_type", "archive", "offset"]


def url_key(url: Column) -> Column:
    """The key of a URL's history: the host's labels from the last to the first, then the path and query, in lower case; without scheme, user, port and fragment."""
    host, rest = F.regexp_extract(url, PARTS, 1), F.regexp_extract(url, PARTS, 2)
    labels = F.array_join(F.reverse(F.split(F.lower(host), r"\.")), ",")
    found = F.concat(labels, F.lit(")"), F.when(F.startswith(rest, F.lit("/")), F.lower(rest)).otherwise(F.concat(F.lit("/"), F.lower(rest))))
    return F.when(F.regexp_like(url, F.lit(PARTS)), found).otherwise(F.lower(F.coalesce(url, F.lit(""))))


def record_id(page_id: int | None, digest: bytes, copy: str) -> str:
    """<urn:capture:page:digest:copy>, unique if copy is; that of a response, to which others refer, is `first`."""
    return f"<urn:capture:{'none' if page_id is None else page_id}:{digest.hex()}:{copy}>"


def _digest_text(digest: bytes) -> str:
    return f"sha1:{b32encode(digest).decode()}"


def _uri(url: str) -> str:
    """With what may not stand in a header as percent codes, and so the percent sign itself."""
    return quote(url, safe="!#$&'()*+,/:;=?@[]-._~")


def _time(at: int) -> str:
    """Seconds since 1970 as the date of a record."""
    return f"{np.datetime64(at, 's')}Z"


def record(page_id: int | None, url: str | None, at: int, payload: bytes, n_bytes: int, digest: bytes, refers: bool, refers_to: int | None) -> bytes:
    """A WARC 1.1 record: a response with its payload, or a revisit with the headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http if refers else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest, uuid.uuid4().hex if refers or n_bytes < LEAST_BYTES else 'first')}",
        f"WARC-Date: {_time(at)}",
        f"Capture-Seconds: {at}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_uri(url)}")
    if refers:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_id(refers_to, digest, 'first')}"]
    lines += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: {_digest_text(digest)}", f"WARC-Block-Digest: {_digest_text(hashlib.sha1(block).digest())}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The columns of READ but the place, and the payload; ValueError if the record is damaged."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/1."):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    block = rest[: int(headers["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n" or _digest_text(hashlib.sha1(block).digest()) != headers["warc-block-digest"]:
        raise ValueError("damaged block")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(next(x.partition(b":")[2] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")))
    kind, digest = headers["warc-type"], headers["warc-payload-digest"]
    refers = kind == "revisit"
    if not refers and (len(payload) != length or _digest_text(hashlib.sha1(payload).digest()) != digest):
        raise ValueError("damaged payload")
    page = lambda name: None if (found := headers[name].split(":")[2]) == "none" else int(found)
    url = headers.get("warc-target-uri")
    return {
        "page_id": page("warc-record-id"), "url": None if url is None else unquote_to_bytes(url).decode(), "at": int(headers["capture-seconds"]), "payload_bytes": length,
        "payload_digest": b32decode(digest.removeprefix("sha1:")).hex(), "record_type": kind, "refers": refers, "refers_to": page("warc-refers-to") if refers else None, "payload": payload,
    }


class WarcWriter(ArchiveWriter):
    """Each record is a gzip member of its own, so it can be read by its offset; archives are listed once Spark commits them."""

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, folder = _open(self.path)
        system.create_dir(folder, recursive=True)
        done: list[tuple[str, int]] = []
        held = io.BytesIO()

        def put() -> None:
            name = f"{uuid.uuid4().hex}.warc.gz"
            with system.open_output_stream(f"{folder}/{name}", compression=None) as out:
                out.write(held.getbuffer())
            done.append((name, held.getbuffer().nbytes))

        names = [x.split()[0] for x in WRITTEN.split(", ")]
        for batch in iterator:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in names]
            for i in range(batch.num_rows):
                held.write(gzip.compress(record(*(c[i].as_py() for c in columns)), 6, mtime=0))
                if held.tell() > self.size:
                    put()
                    held = io.BytesIO()
        if held.tell():
            put()
        return Written(done)


@dataclass
class Archive(InputPartition):
    name: str


def members(stream, step: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of the gzip members of a stream, of which only one is held at a time."""
    data, at, start = b"", 0, 0
    unzip, out = zlib.decompressobj(31), []
    while True:
        if not data:
            data = stream.read(step)
            if not data:
                break
        out.append(unzip.decompress(data))
        if unzip.eof:
            rest = unzip.unused_data
            at += len(data) - len(rest)
            yield start, b"".join(out)
            data, start, unzip, out = rest, at, zlib.decompressobj(31), []
        else:
            at += len(data)
            data = b""
    if out or start != at:
        raise ValueError("the archive ends within a member")


class WarcReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def partitions(self) -> list[Archive]:
        """From the list of archives alone."""
        system, folder = _open(self.path)
        with system.open_input_stream(f"{folder}/{LIST}") as f:
            return [Archive(name) for name, _ in json.loads(f.read())]

    def read(self, partition: Archive | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        system, folder = _open(self.path)
        rows: list[dict] = []
        with system.open_input_stream(f"{folder}/{partition.name}", compression=None) as f:
            for offset, raw in members(f):
                found = parse(raw)
                del found["payload"]
                rows.append(found | {"archive": partition.name, "offset": offset})
                if len(rows) == 10_000:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)


_KINDS = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}


def _batch(rows: list[dict]) -> pa.RecordBatch:
    names = [x.split() for x in READ.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], _KINDS[kind]) for n, kind in names], names=[n for n, _ in names])


class WarcArchives(DataSource):
    """Format `warc_archives`: writes the columns WRITTEN, reads READ. Options: `path`, of any file system that Arrow opens, and `archiveBytes`."""

    @classmethod
    def name(cls) -> str:
        return "warc_archives"

    def schema(self) -> str:
        return READ

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], int(self.options.get("archiveBytes", ARCHIVE)))

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"])


def records(pages: DataFrame) -> DataFrame:
    """The rows to write, WRITTEN, for pages (page_id, url, at: long, payload: binary, not null).

    Only keys of pages are shuffled, and payloads of rows that are repeated as they are: pages that neither revisit another nor
    are repeated are written where they are read. Of equal payloads of LEAST_BYTES or more the response is that of the largest page_id,
    then url, then time (none: least); of rows repeated as they are, one.
    """
    n_bytes = F.length("payload").cast("long")
    own = pages.select("page_id", "url", "at", "payload", n_bytes.alias("n_bytes"), F.unhex(F.sha1("payload")).alias("digest"))
    place = F.struct("page_id", "url", "at")
    sizes = own.select("digest", "n_bytes", place.alias("place"))
    alike = kept(sizes.where(F.col("n_bytes") >= LEAST_BYTES).groupBy("digest", "n_bytes", "place").agg(F.count("*").alias("n")), "captures")
    best = kept(alike.groupBy("digest").agg(F.max("place").alias("best"), F.sum("n").alias("all")).where(F.col("all") > 1).drop("all"), "responses")
    rows = alike.count()
    twins = kept(spread_join(alike, best, "digest", [], rows).withColumn("leads", F.to_json("place").eqNullSafe(F.to_json("best"))), "twins")
    # all but one of a place's rows revisit, and all rows of the other places
    again = twins.withColumn("n", F.col("n") - F.when(F.col("leads"), 1).otherwise(0)).where("n > 0")
    again = kept(again, "revisits")
    total = again.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    revisits = copies(again, "n", "copy", total).select(
        "place.page_id", "place.url", "place.at", F.lit(b"").alias("payload"), "n_bytes", "digest", F.lit(True).alias("refers"), F.col("best.page_id").alias("refers_to")
    )
    key, other, leads = fresh(own, "_key", "_other", "_leads")
    keyed = lambda d, p: F.concat(F.hex(d), F.to_json(p))
    odd = twins.where("n > 1 OR NOT leads").select(keyed("digest", F.col("place")).alias(other), F.col("leads").alias(leads))
    large = own.withColumn(key, keyed("digest", place)).where(F.col("n_bytes") >= LEAST_BYTES)
    marked = large.join(small(kept(odd, "odd"), KEYS), F.col(key) == F.col(other), "left")
    columns = [*own.columns, F.lit(False).alias("refers"), F.lit(None).cast("long").alias("refers_to")]
    once = marked.where(F.col(leads).isNull()).select(*columns)
    repeated = marked.where(F.col(leads)).dropDuplicates([key]).select(*columns)
    few = own.where(F.col("n_bytes") < LEAST_BYTES).select(*columns)
    return few.union(once).union(repeated).union(revisits)


def write(pages: DataFrame, path: str, **options: int) -> DataFrame:
    """Writes records of pages (page_id, url, at, payload) to archives at path, and returns the table that reads them back, READ."""
    spark: SparkSession = ship(pages.sparkSession)
    spark.dataSource.register(WarcArchives)
    records(pages).write.format("warc_archives").mode("append").options(**options).save(path)
    return spark.read.format("warc_archives").options(**options).load(path)


class LoserTree:
    """Merges sorted sequences: the winner's next entry is played against the losers on its way to the root, log k games an entry."""

    def __init__(self, runs: Sequence[Iterator[tuple]]):
        self.runs = runs
        n = 1
        while n < len(runs):
            n *= 2
        self.heads: list[tuple | None] = [next(r, None) for r in runs] + [None] * (n - len(runs))
        self.losers = [-1] * n
        self.winner = self._play(1, n)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or x < y or (x == y and a < b))

    def _play(self, node: int, n: int) -> int:
        """The winner below a node, whose losers are set on the way; leaves are n, n + 1 …"""
        if node >= n:
            return node - n
        a, b = self._play(2 * node, n), self._play(2 * node + 1, n)
        won, lost = (a, b) if self._before(a, b) else (b, a)
        self.losers[node] = lost
        return won

    def __iter__(self) -> Iterator[tuple]:
        n = len(self.losers)
        while (head := self.heads[self.winner]) is not None:
            yield head
            at = self.winner
            self.heads[at] = next(self.runs[at], None)
            node = (at + n) // 2
            while node:
                if self._before(self.losers[node], at):
                    self.losers[node], at = at, self.losers[node]
                node //= 2
            self.winner = at


def _runs(keys: list[tuple]) -> list[range]:
    """The places of the longest ascending stretches: the runs that a range got, one after another."""
    starts = [0, *(i for i in range(1, len(keys)) if keys[i] < keys[i - 1]), len(keys)]
    return [range(a, b) for a, b in zip(starts, starts[1:], strict=False) if a < b]


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range's captures in order, from the sorted runs that it consists of."""
    found = list(batches)  # RANGE bytes or so
    if not found:
        return
    table = pa.Table.from_batches(found).combine_chunks()
    low = lambda x: (x is not None, x)  # noqa: E731  none first
    columns = [table.column(c).to_pylist() for c in ORDER]
    columns = [[low(x) for x in c] for c in columns]
    keys = list(zip(*columns, strict=True))
    tree = LoserTree([((keys[i], i) for i in run) for run in _runs(keys)])
    order = [i for _, i in tree]
    yield from table.take(pa.array(order, pa.int64())).to_batches(max_chunksize=10_000)


def merged(captures: DataFrame) -> DataFrame:
    """captures (READ and url_key) with `position`, from 1, in the order of ORDER; kept.

    Runs are what a task reads of the archives, sorted there; the ranges that they are dealt to are cut by all columns of the
    order, of which archive and offset differ in each record, so not even the captures of one URL and time need one task.
    """
    ship(captures.sparkSession)
    runs = kept(captures.sortWithinPartitions(*ORDER), "runs")
    held, n = runs.agg(F.coalesce(F.sum(F.octet_length("url") + F.octet_length("url_key") + 200), F.lit(0)), F.count("*")).first()
    ranges = max(1, -(-held // RANGE), size_bins(n, 100_000, 1))
    dealt = runs.repartitionByRange(ranges, *ORDER)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in runs.schema)
    return placed(dealt.mapInArrow(_merge, schema), "position")


def histories(pages: DataFrame, path: str, **options: int) -> DataFrame:
    """All captures of pages, written to archives at path and read back: READ with url_key, position (in the order of all) and capture (in its URL's history), from 1.

    pages: page_id, url, at (seconds since 1970, long) and payload (binary); other columns are not read, whatever their names. A null
    url has no header and an empty key; a null page_id is the least; a null time is 0; a null payload is empty. Repeated rows are a
    record each, of which one is the response; an empty table gives an empty one. Payloads pass one at a time, whatever their size.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("at", F.lit(0)).cast("long").alias("at"), F.coalesce("payload", F.lit(b"")).alias("payload"))
    table = write(own, path, **options)
    found = merged(table.withColumn("url_key", url_key(F.col("url"))))
    keyed = found.withColumn("key", key_of("url_key"))
    first = keyed.groupBy("key").agg(F.min("position").alias("first"))
    out = spread_join(keyed, first, "key", [], found.count())
    return out.withColumn("capture", F.col("position") - F.col("first") + 1).drop("key", "first")


def op12_warc_index(spark, sf_dir: str) -> DataFrame:
    """Pages have no time of capture; their ids, by 2^32, count as seconds."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    at = F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(1 << 32))
    found = histories(pages.select("page_id", "url", at.alias("at"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")), new_path(spark, "warc"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "capture", "position")


OP12_SQL = f"""
WITH p AS (
    SELECT page_id, url, coalesce(html, '') AS html, regexp_extract(url, '{PARTS}', 1) AS host, regexp_extract(url, '{PARTS}', 2) AS rest, regexp_matches(url, '{PARTS}') AS parted FROM pages
),
k AS (
    SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS payload_digest, ((coalesce(page_id, 0) % 4294967296) + 4294967296) % 4294967296 AS ts,
        CASE WHEN parted THEN array_to_string(list_reverse(string_split(lower(host), '.')), ',') || ')' || CASE WHEN starts_with(rest, '/') THEN '' ELSE '/' END || lower(rest) ELSE lower(coalesce(url, '')) END AS url_key,
        row_number() OVER (PARTITION BY html ORDER BY page_id DESC NULLS LAST, url DESC NULLS LAST) AS r, max(page_id) OVER (PARTITION BY html) AS latest
    FROM p
),
t AS (
    SELECT *, CASE WHEN payload_bytes >= {LEAST_BYTES} AND r > 1 THEN 'revisit' ELSE 'response' END AS record_type FROM k
)
SELECT page_id, payload_bytes, payload_digest, record_type, CASE WHEN record_type = 'revisit' THEN latest END AS refers_to, url_key,
    row_number() OVER (PARTITION BY url_key ORDER BY ts, page_id NULLS FIRST, payload_digest, record_type) AS capture,
    row_number() OVER (ORDER BY url_key, ts, page_id NULLS FIRST, payload_digest, record_type) AS position
FROM t
"""
