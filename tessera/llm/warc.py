"""WARC archives with an external index merge.

Each writing task makes archives of gzip members, one per record, and locally sorted runs of index lines (URL key, time, id, place). The runs are
merged by a loser tree, range by range of (URL key, time, id), with a bounded fan-in over as many passes as it takes; what comes
out is the globally ordered history of captures: (range, position) orders them all, however often one URL was captured. Records are
read back by that index, archive by archive.

Archives and runs live in the shared store of the session; file names are unique to a task attempt, and only files that a
finished attempt reports to the driver are read, so lost executors and repeated attempts do no harm.

Null payloads are empty, null URLs are the empty URL. Rows with a null id are responses, and nothing refers to them. Repeated rows of one id and payload are
responses all, or revisits all.
"""

from __future__ import annotations

import bisect
import datetime
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .common import scratch, stored, temporary

#: Payloads below this many bytes are never deduplicated. Entries of a run, index entries between two marks of its sparse index, runs that are
#: merged at once, entries that a merging task is meant to make, places in the sample for so many entries, and rows that a scan of pages holds at once.
LEAST_BYTES, RUN_ENTRIES, MARK_EVERY, FAN_IN, RANGE_ENTRIES, SPLIT_SAMPLE, VECTOR_ROWS = 100, 100_000, 256, 64, 20_000, 16, 64
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = 1_704_067_200  # pages carry no time; captures follow their ids, a second each
FIRST_SECOND, LAST_SECOND = 0, 253_402_300_799  # of the years 1970 and 9999
NULL_ID = -(1 << 63)  # null ids are captured at the first second of the epoch, before others of it


def url_key(url: str | None) -> str:
    """Sort key of a URL: host labels in reverse, then path and query, without scheme, `www.` and default port; blanks and controls are escaped."""
    url = (url or "").strip()
    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").removeprefix("www.")
        port = f":{parts.port}" if parts.port not in (None, 80, 443) else ""
    except ValueError:
        return quote(url, safe="%/:?=&#[]@!$'()*+,;~")
    rest = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return quote(",".join(reversed(host.split("."))) + port + ")" + rest, safe="%/:?=&#[]@!$'()*+,;~")


def stamp(page_id: int | None) -> tuple[str, str]:
    """Fixed-width time of a capture, for the index and for the record. Ids beyond what four-digit years hold get the first or
    last second that they do; captures of one second are in order of their ids."""
    t = datetime.datetime.fromtimestamp(min(max(EPOCH + (page_id or 0), FIRST_SECOND), LAST_SECOND), datetime.UTC)
    return t.strftime("%Y%m%d%H%M%S"), t.strftime("%Y-%m-%dT%H:%M:%SZ")


def record(page_id: int | None, url: str | None, payload: bytes | None, digest: str, size: int, refers_to: int | None) -> bytes:
    """A response record, or a revisit record without payload where refers_to is given."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http + (payload or b"") if refers_to is None else http
    head = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": f"<urn:x-page:{page_id}>", "WARC-Target-URI": quote(url or "", safe="%/:?=&#[]@!$'()*+,;~"), "WARC-Date": stamp(page_id)[1], "WARC-Payload-Digest": f"sha256:{digest}"}
    if refers_to is not None:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:x-page:{refers_to}>"}
    head |= {"Content-Type": "application/http;msgtype=response", "Content-Length": len(block)}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


HEADER = re.compile(rb"([^\r\n:]+): ?([^\r\n]*)\r\n")


def parse_record(raw: bytes) -> dict:
    """What a record says and what its payload is; the digest of a response is computed anew and held against the record."""
    end = raw.index(b"\r\n\r\n") + 2
    if not raw.startswith(b"WARC/1."):
        raise ValueError("not a WARC record")
    head = {k.decode(): v.decode() for k, v in HEADER.findall(raw, raw.index(b"\n") + 1, end)}
    block = raw[end + 2 : end + 2 + int(head["Content-Length"])]
    body = block.index(b"\r\n\r\n") + 4
    http = {k.decode().lower(): v.decode() for k, v in HEADER.findall(block, block.index(b"\n") + 1, body - 2)}
    size, digest = int(http["content-length"]), head["WARC-Payload-Digest"].removeprefix("sha256:")
    payload = block[body:]
    number = lambda s: None if s in ("None", "null") else int(s)
    if head["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("payload does not match its digest")
    return {
        "page_id": number(head["WARC-Record-ID"][len("<urn:x-page:") : -1]), "url": head["WARC-Target-URI"], "payload_bytes": size, "payload_digest": digest, "record_type": head["WARC-Type"],
        "refers_to": number(head["WARC-Refers-To"][len("<urn:x-page:") : -1]) if "WARC-Refers-To" in head else None, "payload": payload,
    }


def digest_of(payload: str) -> Column:
    return F.sha2(F.col(payload).cast("binary"), 256)


def revisits(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """(page_id, digest, refers_to) of payloads of pages that an earlier page has."""
    seen = pages.where(F.col("page_id").isNotNull() & (F.octet_length("html") >= least)).select("page_id", digest_of("html").alias("digest"))
    first = seen.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").select("digest", "refers_to")
    first = stored(first, "first")  # its size decides on the join: few copies are broadcast, so no rows are sorted for them
    return seen.join(first, "digest").where("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct()


Entry = tuple[str, str, int, str, int, int]  # key, time, id, archive, offset, length


def write_run(entries: Iterable[Entry], base: str) -> str:
    """A run and its sparse index, from entries that come in order; only the marks are held."""
    store, path = fs.FileSystem.from_uri(base)
    name = f"{path}/run-{uuid.uuid4().hex}"
    marks, at = [], 0
    with store.open_output_stream(name) as out:
        for k, e in enumerate(entries):
            line = ("\t".join(map(str, e)) + "\n").encode()
            if k % MARK_EVERY == 0:
                marks.append((e[:3], at))
            out.write(line)
            at += len(line)
    with store.open_output_stream(f"{name}.marks") as out:
        out.write(json.dumps({"marks": marks, "size": at}).encode())
    return name


Place = tuple[str, str, int]  # key, time, id
MANIFEST = "run string, entries long, sample array<struct<key:string,time:string,id:bigint>>"
PLACES = pa.list_(pa.struct([("key", pa.string()), ("time", pa.string()), ("id", pa.int64())]))


def write_archives(pages: DataFrame, base: str) -> list[Row]:
    """Write all records; a row per run, for the merge. Pages have page_id, url, html and refers_to.

    The rows are of the attempts that finished, and go to the driver, not into files of one row for each task. Their sample of places is in
    proportion to the entries, at least a place a run.
    """
    step = max(1, RANGE_ENTRIES // SPLIT_SAMPLE)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(base)
        store.create_dir(path, recursive=True)
        entries: list[Entry] = []
        out, archive, at = None, "", 0

        def finish() -> pa.RecordBatch:
            out.close()
            entries.sort()
            name, n = write_run(entries, base), len(entries)
            start = zlib.crc32(repr(entries[0][:3]).encode()) % min(step, n)  # another one for each run, or the places of all lie together
            sample = [dict(zip(("key", "time", "id"), e, strict=False)) for e in entries[start::step]]
            entries.clear()
            return pa.record_batch([pa.array([name]), pa.array([n], pa.int64()), pa.array([sample], PLACES)], ["run", "entries", "sample"])

        for batch in batches:
            for page_id, url, html, refers_to in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if out is None:
                    archive, at = f"{path}/part-{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(archive, compression=None)
                payload = html or b""
                packer = zlib.compressobj(4, zlib.DEFLATED, 31)
                member = packer.compress(record(page_id, url, payload, hashlib.sha256(payload).hexdigest(), len(payload), refers_to)) + packer.flush()
                out.write(member)
                entries.append((url_key(url), stamp(page_id)[0], NULL_ID if page_id is None else page_id, archive, at, len(member)))
                at += len(member)
                if len(entries) >= RUN_ENTRIES:
                    yield finish()
                    out = None
        if out is not None:
            yield finish()

    return pages.select("page_id", "url", "html", "refers_to").mapInArrow(run, MANIFEST).collect()


def read_run(store: fs.FileSystem, name: str, low: Place | None, high: Place | None) -> Iterator[Entry]:
    """Entries of a run from low to before high, read from the mark before low on, in buffered pieces."""
    with store.open_input_stream(f"{name}.marks") as f:
        marks = json.loads(f.read())
    keys = [tuple(k) for k, _ in marks["marks"]]
    start = marks["marks"][max(0, bisect.bisect_left(keys, low) - 1)][1] if low is not None and keys else 0
    with store.open_input_file(name) as f:
        f.seek(start)
        rest = b""
        while piece := f.read(1 << 16):
            *lines, rest = (rest + piece).split(b"\n")
            for line in lines:
                key, time, ident, archive, offset, length = line.decode().split("\t")
                place = (key, time, int(ident))
                if low is not None and place < low:
                    continue
                if high is not None and place >= high:
                    return
                yield key, time, int(ident), archive, int(offset), int(length)


def merge(runs: list[Iterator[Entry]]) -> Iterator[Entry]:
    """K-way merge by a loser tree: inner nodes hold the loser of their match, and a new head replays only its own path to the root."""
    k = len(runs)
    if not k:
        return
    heads: list[Entry | None] = [next(r, None) for r in runs]

    def beats(a: int, b: int) -> bool:
        x, y = heads[a], heads[b]
        return y is None or x is not None and (x, a) < (y, b)

    losers, winner = [0] * k, [0] * (2 * k)
    for node in range(2 * k - 1, 0, -1):
        if node >= k:
            winner[node] = node - k
        else:
            a, b = winner[2 * node], winner[2 * node + 1]
            winner[node], losers[node] = (a, b) if beats(a, b) else (b, a)
    best = winner[1]
    while heads[best] is not None:
        yield heads[best]
        heads[best] = next(runs[best], None)
        node = (best + k) // 2
        while node:
            if beats(losers[node], best):
                best, losers[node] = losers[node], best
            node //= 2


INDEX = "range long, position long, url_key string, time string, page_id long, archive string, offset long, length long"


def merge_runs(spark: SparkSession, manifest: list[Row], base: str) -> DataFrame:
    """The index of all runs in global order of (range, position)."""
    total = sum(r["entries"] for r in manifest)
    sample = sorted(tuple(k) for r in manifest for k in r["sample"])
    n_ranges = max(1, min(-(-total // RANGE_ENTRIES), len(set(sample))))
    cuts = sorted({sample[len(sample) * k // n_ranges] for k in range(1, n_ranges)})
    ranges = list(zip([None, *cuts], [*cuts, None], strict=True))
    names = [r["run"] for r in manifest]
    while len(names) > FAN_IN:  # a pass that leaves a run for each FAN_IN of them

        def shorten(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store, _ = fs.FileSystem.from_uri(base)
            for batch in batches:
                for group in batch.column(1).to_pylist():
                    entries = merge([read_run(store, name, None, None) for name in group])
                    yield pa.record_batch([pa.array([write_run(entries, base)])], ["run"])

        groups = [(k, names[k : k + FAN_IN]) for k in range(0, len(names), FAN_IN)]
        tasks = spark.createDataFrame(groups, "k long, runs array<string>").repartitionByRange(len(groups), "k")
        names = [r["run"] for r in tasks.mapInArrow(shorten, "run string").collect()]

    def final(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(base)
        fields = ["range", "position", "url_key", "time", "page_id", "archive", "offset", "length"]
        for batch in batches:
            for number, *ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                low, high = (None if end is None else (end["key"], end["time"], end["id"]) for end in ends)
                rows, position = [], 0
                for e in merge([read_run(store, name, low, high) for name in names]):
                    rows.append((number, position, *e[:2], None if e[2] == NULL_ID else e[2], *e[3:]))
                    position += 1
                    if len(rows) == 2000:
                        yield index_batch(rows, fields)
                        rows = []
                if rows:
                    yield index_batch(rows, fields)

    place = "struct<key:string,time:string,id:bigint>"
    tasks = spark.createDataFrame([(k, *r) for k, r in enumerate(ranges)], f"k long, low {place}, high {place}").repartitionByRange(len(ranges), "k")
    return tasks.mapInArrow(final, INDEX)


def index_batch(rows: list[tuple], fields: list[str]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], fields)


RECORDS = "range long, position long, url_key string, time string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_records(index: DataFrame, base: str) -> DataFrame:
    """The records behind index rows, archive by archive from front to back; (range, position) is their order in the history."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(base)
        name, source = None, None
        for batch in batches:
            rows = batch.to_pylist()
            found = []
            for row in rows:
                if row["archive"] != name:
                    if source is not None:
                        source.close()
                    name = row["archive"]
                    source = store.open_input_file(name)
                raw = zlib.decompress(source.read_at(row["length"], row["offset"]), 31)
                found.append({f: v for f, v in parse_record(raw).items() if f != "payload"})
            columns = {c: [r[c] for r in rows] for c in ("range", "position", "url_key", "time")}
            columns |= {c: [f[c] for f in found] for c in ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")}
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.record_batch([pa.array(v, k) for v, k in zip(columns.values(), kinds, strict=True)], list(columns))
        if source is not None:
            source.close()

    # an archive holds at most RUN_ENTRIES records
    return index.repartition("archive").sortWithinPartitions("archive", "offset").mapInArrow(run, RECORDS)


@contextmanager
def few_rows_at_once(spark: SparkSession) -> Iterator[None]:
    """Inside, scans hold VECTOR_ROWS rows of a column at once, not thousands, as pages may be long."""
    name = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(VECTOR_ROWS))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def archive_and_read(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """Write, merge the index and read back: the history of captures in global order of (range, position)."""
    spark = pages.sparkSession
    base = scratch(spark, "warc")
    own = pages.select("page_id", "url", "html")
    with few_rows_at_once(spark), temporary(spark):  # the tables of copies go
        again = stored(revisits(own, least), "revisits")
        manifest = write_archives(own.withColumn("digest", digest_of("html")).join(again, ["page_id", "digest"], "left"), base)
    return read_records(merge_runs(spark, manifest, base), base)
