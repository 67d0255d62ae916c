"""WARC archives with an index of capture histories, merged from sorted runs.

Pages become WARC records, equal payloads a response and its revisits. Each record is a gzip member
of its own, so that its offset and length in the archive are enough to read it; Spark's text writer
puts members into files and an empty member between them. Reading an archive back gives one run of
captures, sorted by URL key and time. A range of the key gets its stretch of each run, in the run's
order, and merges the stretches with trees of losers, FAN_IN at a time.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from itertools import batched
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, cut, lean, shared_folder

END = "\r\n\r\n"
#: A row of the writer holds the members of records of about so many bytes; a file holds so many rows.
#: A file, which is read back as a whole, is no more than their product and one long record.
CHUNK_BYTES, CHUNKS_PER_FILE = 1 << 20, 16
#: What the writer puts behind each row: a gzip member without content.
BETWEEN = gzip.compress(b"", mtime=0)
#: Payloads of fewer bytes are always responses.
LEAST_BYTES = 0
CAPTURES_PER_RANGE, FAN_IN = 20_000, 64
#: Shared digests that go to all tasks, about 40 bytes each; beyond it they are joined, hot ones salted.
MOST_SHARED, SALTS = 200_000, 16
#: Captures carry no time of their own: page n is taken to be fetched n seconds after this; a null or
#: negative id counts as 0 and one above LATEST as LATEST, so that years have four digits.
EPOCH, LATEST = datetime(2024, 1, 1, tzinfo=timezone.utc), 10**10


def url_key(url: str | None) -> str:
    """Host labels turned round, then path and query; without scheme, ``www.``, port and fragment."""
    parts = urlsplit((url or "").strip().lower()) if url and url.count("[") == url.count("]") else urlsplit("")
    host = (parts.netloc.rpartition("@")[2].partition(":")[0]).removeprefix("www.")
    return f"{','.join(reversed(host.split('.')))}){parts.path or '/'}{'?' + parts.query if parts.query else ''}"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, html: str | None, original: int | None) -> str:
    """One record without its closing line ends; a revisit has headers only."""
    body = html or ""
    payload = body.encode()
    revisit = original is not None
    when = EPOCH + timedelta(seconds=max(0, min(page_id or 0, LATEST)))
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {when:%Y-%m-%dT%H:%M:%SZ}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=chr(37) + '!#$&()*+,/:;=?@[]~' + chr(39))}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{original}>"]
    lines += ["Content-Type: text/html; charset=utf-8", f"X-Payload-Length: {len(payload)}", f"Content-Length: {0 if revisit else len(payload)}"]
    return "\r\n".join(lines) + END + ("" if revisit else body)


def members(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each gzip member that is not empty."""
    at = 0
    while at < len(data):
        if data.startswith(BETWEEN, at):
            at += len(BETWEEN)
            continue
        reader, parts, end, step = zlib.decompressobj(wbits=31), [], at, 4096
        while not reader.eof:  # in growing steps, as what a step holds of the next member is copied
            if end >= len(data):
                raise ValueError(f"the member at byte {at} is cut short")
            parts.append(reader.decompress(data[end : end + step]))
            end, step = min(len(data), end + step), 2 * step
        end -= len(reader.unused_data)
        yield at, end - at, b"".join(parts)
        at = end


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record."""
    head = data.index(END.encode())
    version, *lines = data[:head].decode().split("\r\n")
    headers = dict(x.split(": ", 1) for x in lines)
    stop = head + 4 + int(headers["Content-Length"])
    if not version.startswith("WARC/") or data[stop:] != END.encode():
        raise ValueError(f"no record ends at byte {stop}")
    return headers, data[head + 4 : stop]


class LoserTree:
    """Merges sorted runs: each match keeps its loser, so the next least item costs log2(runs) comparisons."""

    def __init__(self, runs: list[Iterator]):
        self.runs, self.size = runs, max(1, len(runs))
        self.heads = [next(r, None) for r in runs] or [None]
        self.losers = [-1] * self.size
        for k in range(self.size):
            self._play(k)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and x <= y)

    def _play(self, k: int) -> None:
        winner, node = k, (k + self.size) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0:  # nobody has come to this match yet
                self.losers[node] = winner
                return
            if not self._before(winner, other):
                winner, self.losers[node] = other, winner
            node //= 2
        self.winner = winner

    def __iter__(self) -> Iterator:
        while (best := self.heads[self.winner]) is not None:
            yield best
            k = self.winner
            self.heads[k] = next(self.runs[k], None)
            self._play(k)


def write(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Writes one record per page into archives of gzip members under ``folder``."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    keyed = rows.withColumn("sha", F.unhex(F.sha1(F.col("html").cast("binary"))))
    # only payloads that more than one page has; the others need no original
    shared = cut(keyed.where(F.octet_length("html") >= LEAST_BYTES).groupBy("sha").agg(F.max("page_id").alias("original"), F.count("*").alias("n")).where("n > 1").select("sha", "original"))
    if shared.count() <= MOST_SHARED:
        met = keyed.join(F.broadcast(shared), "sha", "left")
    else:
        salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int").alias("salt")
        copies = shared.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        met = keyed.select("*", salt).join(copies, ["sha", "salt"], "left")
    told = met.select("page_id", "url", "html", F.when(F.coalesce(F.col("page_id") < F.col("original"), F.col("original").isNotNull()), F.col("original")).alias("original"))

    def build(batches: Batches) -> Batches:
        for batch in batches:
            out, waiting, size = [], [], 0
            for row in zip(*batch.columns, strict=True):
                waiting.append(gzip.compress((record(*(x.as_py() for x in row)) + END).encode(), 6, mtime=0))
                size += len(waiting[-1])
                if size >= CHUNK_BYTES:
                    out.append(b"".join(waiting))
                    waiting, size = [], 0
            if waiting:
                out.append(b"".join(waiting))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    # Latin-1 takes the separator's bytes as they are; a value's bytes are never encoded
    members = told.mapInArrow(lean(build), "value binary").select(F.col("value").cast("string"))
    members.write.option("lineSep", BETWEEN.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", CHUNKS_PER_FILE).text(folder)


_CAPTURE = "url_key string, captured_at string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, length long"


def captures(pages: DataFrame, folder: str) -> DataFrame:
    """One row per record of the archives, each archive's in order of URL key, time and page."""

    def scan(batches: Batches) -> Batches:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                run, name = [], path.rpartition("/")[2]
                for offset, length, data in members(content.as_py()):
                    h, payload = parsed(data)
                    known = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    if h["WARC-Type"] == "response" and digest(payload) != known:
                        raise ValueError(f"{path}: the payload at byte {offset} does not match its digest")
                    page, of = (x.removeprefix("<urn:page:").removesuffix(">") for x in (h["WARC-Record-ID"], h.get("WARC-Refers-To", "")))
                    run.append((url_key(h.get("WARC-Target-URI")), h["WARC-Date"], int(page) if page else None, int(h["X-Payload-Length"]), known, h["WARC-Type"], int(of) if of else None, name, offset, length))
                run.sort(key=_order)
                for part in batched(run, 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), _SCHEMA.types, strict=True)], _NAMES)

    files = pages.sparkSession.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return files.select("path", "content").mapInArrow(lean(scan), _CAPTURE)


_NAMES = [f.split()[0] for f in _CAPTURE.split(", ")]
_SCHEMA = pa.schema([(f.split()[0], pa.string() if f.endswith("string") else pa.int64()) for f in _CAPTURE.split(", ")])


def _order(x: tuple) -> tuple:
    return x[0], x[1], x[2] is None, x[2] or 0, x[7], x[8]


def merged(runs: list[Iterator]) -> Iterator:
    """The sorted runs as one; more than FAN_IN of them in several levels of trees."""
    while len(runs) > FAN_IN:
        runs = [iter(LoserTree(list(some))) for some in batched(runs, FAN_IN)]
    return iter(LoserTree(runs))


def histories(found: DataFrame) -> DataFrame:
    """Captures in global order of (merge_range, merge_position): URL key, then time, then page.

    A task gets the captures of one range of that order, about CAPTURES_PER_RANGE, run by run and
    each run's in order, as Spark's own sort has left them.
    """
    ranges = max(1, -(-found.count() // CAPTURES_PER_RANGE))
    names, schema = _NAMES, _SCHEMA

    def merge(batches: Batches) -> Batches:
        runs: list[list[tuple]] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if not runs or runs[-1][-1][7] != row[7]:
                    runs.append([])
                runs[-1].append(row)
        part, done = TaskContext.get().partitionId(), 0
        for rows in batched((row for _, row in merged([((_order(x), x) for x in run) for run in runs])), 10_000):
            yield _numbered(rows, names, schema, part, done)
            done += len(rows)

    order = ["url_key", "captured_at", F.col("page_id").asc_nulls_last()]
    ranged = found.repartitionByRange(ranges, *order, "archive", "offset").sortWithinPartitions("archive", *order, "offset")
    return ranged.mapInArrow(lean(merge), f"{_CAPTURE}, merge_range int, merge_position long")


def _numbered(rows: list[tuple], names: list[str], schema: pa.Schema, part: int, first: int) -> pa.RecordBatch:
    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)]
    return pa.RecordBatch.from_arrays([*columns, pa.array([part] * len(rows), pa.int32()), pa.array(range(first, first + len(rows)), pa.int64())], [*names, "merge_range", "merge_position"])


def archive(pages: DataFrame, folder: str | None = None, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes all pages as WARC records, reads the archives back and merges their index.

    One row per page: page_id, payload_bytes, payload_digest, record_type, refers_to, url_key,
    captured_at, archive, offset, length, merge_range, merge_position. Null html is an empty payload. Of
    equal payloads the largest page_id is the response (rows that repeat it too); a page without an
    id revisits it. Null URLs sort first, under the key of an empty host; two captures that
    agree in key, time and page stand in order of archive and offset. An empty table gives no rows;
    other columns are ignored.
    """
    folder = folder or f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write(pages, folder, page_id, url, html)
    return histories(cut(captures(pages, folder)))
