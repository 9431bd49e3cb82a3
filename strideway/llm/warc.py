"""WARC archives of web captures, with a globally ordered index by external merge.

Writing: each task appends records, one gzip member each, to archives of bounded size in the shared folder,
and keeps their index entries as locally sorted runs. Archives have names that no other attempt of
a task uses, and only entries of attempts that succeeded are read: a lost executor leaves a file
that nothing refers to. Index: entries are dealt out by ranges of URL key and time, and in each
range the runs are merged by a loser tree, so that ranges in order hold every capture history in
order. Reading follows the index into the archives and checks every payload against its digest.

Of captures with equal payloads of at least `least` bytes the one with the smallest key is the
response; the others are revisits, which carry the HTTP header alone.

Cases: a null payload is empty; a null URL is archived as urn:null; captures without a key are
revisits where an equal payload has one, else responses; rows repeated with the response's key are
responses too; an empty table writes no archive; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideway.llm.common import arrow_map, materialise, shared_dir, slices

#: Bytes of an archive after which the next one begins; entries of a run; entries of a range of the merged index, about.
ARCHIVE, RUN, RANGE = 64 << 20, 20_000, 20_000
ENTRY = "urlkey string, ts string, key long, kind string, archive string, offset long, length long"


def url_key(url: str | None) -> str:
    """The host's labels from the last to the first, then path and query, in lower case."""
    rest = (url or "urn:null").split("#", 1)[0].split("://", 1)[-1].lower()
    host, slash, path = rest.partition("/")
    host = host.rsplit("@", 1)[-1].removesuffix(":80").removesuffix(":443").removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")/" + path


def record_id(key: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'capture:{key}')}>"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(key: int | None, url: str | None, ts: str, payload: bytes, revisit: bool, first: int | None) -> bytes:
    """One WARC record, not compressed."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    target = "".join(c if c > " " else f"%{ord(c):02X}" for c in url) if url else "urn:null"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(key)}",
        f"WARC-Date: {ts}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if key is not None:
        head.append(f"X-Capture-Key: {key}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(first)}", f"X-Refers-To-Key: {first}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Headers (lower case) of one record, with its payload under `payload` and the HTTP header's length under `http_length`."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    out: dict = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(out["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    sizes = [x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    return out | {"payload": payload, "http_length": int(sizes[0])}


class LoserTree:
    """Merges sorted iterators: inner nodes hold the losers of their matches, so each step replays one path."""

    def __init__(self, runs: list[Iterator]):
        self.runs = runs
        self.k = max(1, len(runs))
        self.heads = [next(r, None) for r in runs] or [None]
        self.tree = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _beats(self, a: int, b: int) -> bool:
        """Whether run a goes before run b; -1 stands for a run before all, an ended run is after all."""
        if a < 0 or b < 0:
            return a < 0
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and x is not None
        return (x, a) < (y, b)

    def _play(self, i: int) -> None:
        winner, node = i, (i + self.k) // 2
        while node:
            if self._beats(self.tree[node], winner):
                self.tree[node], winner = winner, self.tree[node]
            node //= 2
        self.tree[0] = winner

    def __iter__(self):
        while (head := self.heads[w := self.tree[0]]) is not None:
            yield head
            self.heads[w] = next(self.runs[w], None)
            self._play(w)


def decided(pages: DataFrame, key: str, url: str, payload: str, time: Column, least: int) -> DataFrame:
    """(key, url, ts, payload, first, revisit) of every row."""
    rows = pages.select(
        F.col(key).cast("long").alias("key"),
        F.col(url).alias("url"),
        F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"),
        F.coalesce(F.col(payload), F.lit("")).alias("payload"),
    ).withColumn("sha", F.sha2("payload", 256))
    several = rows.groupBy("sha").agg(F.min("key").alias("first"), F.count("*").alias("n")).filter("n > 1").select("sha", "first")
    joined = rows.join(several, "sha", "left")
    again = F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first")) & (F.octet_length("payload") >= least)
    return joined.select("key", "url", "ts", "payload", F.when(again, F.col("first")).alias("first"), again.alias("revisit"))


def write(pages: DataFrame, time: Column, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 0) -> DataFrame:
    """Archive every row; the index entries, in runs that are each sorted: (run, urlkey, ts, key, kind, archive, offset, length)."""
    top = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"

    def run(batches):
        place, path = fs.FileSystem.from_uri(top)
        place.create_dir(path, recursive=True)
        out, name, at, entries = None, "", 0, []

        def flush():
            runs = uuid.uuid4().hex
            entries.sort(key=lambda e: (e[0], e[1], e[2] is None, e[2] or 0))
            cols = list(zip(*entries, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([runs] * len(entries)), *(pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True))], ["run", "urlkey", "ts", "key", "kind", "archive", "offset", "length"])
            entries.clear()

        for b in slices(batches, "payload", 4 << 20):
            for k, u, ts, body, first, revisit in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if out is None:
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = place.open_output_stream(f"{path}/{name}", compression=None)
                press = zlib.compressobj(1, zlib.DEFLATED, 31)
                member = press.compress(record(k, u, ts, body.encode(), revisit, first)) + press.flush()
                out.write(member)
                entries.append((url_key(u), ts, k, "revisit" if revisit else "response", f"{top}/{name}", at, len(member)))
                at += len(member)
                if at >= ARCHIVE:
                    out.close()
                    out = None
                if len(entries) >= RUN:
                    yield from flush()
        if out is not None:
            out.close()
        if entries:
            yield from flush()

    found = decided(pages, key, url, payload, time, least)
    # Written down at once: running the tasks again would write other archives.
    return materialise(arrow_map(found, run, f"run string, {ENTRY}"), "warc-runs")


def history(runs: DataFrame) -> DataFrame:
    """The entries of all runs in the order of URL key, time and key: (range, place, ...), ordered by both."""
    n = max(1, -(-runs.count() // RANGE))
    order = ["urlkey", "ts", "key"]
    dealt = runs.repartitionByRange(n, *order).sortWithinPartitions("run", *[F.col(c).asc_nulls_last() for c in order])

    def merge(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        kept: dict[str, list] = {}
        for b in batches:  # a range: about RANGE entries
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                kept.setdefault(row[0], []).append(row[1:])
        tree = LoserTree([iter([((e[0], e[1], e[2] is None, e[2] or 0), e) for e in r]) for r in kept.values()])
        merged = [e for _, e in tree]
        for at in range(0, len(merged), 10_000):
            some = merged[at : at + 10_000]
            cols = list(zip(*some, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(some), pa.int32()), pa.array(range(at, at + len(some)), pa.int64()), *(pa.array(c, f.type) for c, f in zip(cols, schema, strict=True))],
                ["range", "place", *schema.names],
            )

    schema = pa.schema([("urlkey", pa.string()), ("ts", pa.string()), ("key", pa.int64()), ("kind", pa.string()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
    return arrow_map(dealt, merge, f"range int, place long, {ENTRY}")


def read(index: DataFrame) -> DataFrame:
    """(key, url, ts, record_type, payload_bytes, payload_digest, refers_to, payload) of the records that an index refers to."""
    entries = index.select("archive", "offset", "length")
    n = max(1, min(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), 10_000))
    dealt = entries.repartition(n, "archive").sortWithinPartitions("archive", "offset")
    names = ["key", "url", "ts", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]

    def run(batches):
        name, file = None, None
        for b in batches:
            rows, size = [], 0
            for archive, offset, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if archive != name:
                    if file:
                        file.close()
                    place, path = fs.FileSystem.from_uri(archive)
                    name, file = archive, place.open_input_file(path)
                file.seek(offset)
                r = parse(zlib.decompress(file.read(length), 31))
                digest = r["warc-payload-digest"].removeprefix("sha1:")
                if r["warc-type"] == "response" and (base32_sha1(r["payload"]) != digest or len(r["payload"]) != r["http_length"]):
                    raise ValueError(f"damaged record at {offset} of {archive}")
                key, refers = r.get("x-capture-key"), r.get("x-refers-to-key")
                url = r["warc-target-uri"]
                rows.append((key and int(key), None if url == "urn:null" else url, r["warc-date"], r["warc-type"], r["http_length"], digest, refers and int(refers), r["payload"]))
                size += len(r["payload"])
                if size > 4 << 20:
                    yield packed(rows)
                    rows, size = [], 0
            if rows:
                yield packed(rows)
        if file:
            file.close()

    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def packed(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return arrow_map(dealt, run, "key long, url string, ts string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")
