"""Byte-level BPE encoding and decoding by overlapping chunks.

A text is pre-tokenised in chunks that overlap. A pre-token depends only on what follows its
start, so once a boundary of one chunk's pre-tokens is also one of the next chunk's, both agree
from there on: the chunks are stitched at the first such boundary. Pre-tokens are then encoded
each on its own. Texts of one chunk are encoded where they are; only longer ones are dealt out.
Decoding concatenates the bytes of the tokens.

Cases: a null or empty text has no tokens; other columns are ignored, whatever their names;
repeated rows and repeated or null keys each give their own row; an empty table gives none.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideway.llm.common import arrow_map, materialise, slices

#: Characters of a chunk, and how far it reaches into the next one.
CHUNK, OVERLAP = 32_768, 512
#: Characters before a chunk's end from which its pre-tokens may differ from the text's: the pattern looks at most this far past a token.
MARGIN = 3


class Pieces(dict):
    """pre-token -> its ids as little-endian unsigned 32-bit integers; bounded."""

    def __init__(self, encode, most: int):
        super().__init__()
        self._encode, self._most = encode, most

    def __missing__(self, piece: str) -> bytes:
        found = np.asarray(self._encode(piece), "<u4").tobytes()
        if len(self) >= self._most:
            self.clear()
        self[piece] = found
        return found


class Codec:
    """ranks_path: a file of base64 token and rank on each line; pattern: what splits a text into pre-tokens."""

    def __init__(self, ranks_path: str, pattern: str, cache: int = 50_000):
        import regex
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        # The pattern takes each pre-token whole; splitting is done here.
        merge = tiktoken.Encoding("pieces", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(pattern)
        self.ids = Pieces(merge.encode_ordinary, cache)
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.ids.__getitem__, self.split.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def chunk(self, text: str, last: bool) -> tuple[np.ndarray, list[str]]:
        """Boundaries from the chunk's start that hold in the whole text if the first does, and the pre-tokens between them."""
        pieces = self.split.findall(text)
        ends = np.cumsum([0, *map(len, pieces)])
        n = len(pieces) if last else int(ends[1:].searchsorted(len(text) - MARGIN, "right"))
        return ends[: n + 1], pieces[:n]


@lru_cache(maxsize=4)
def codec(ranks_path: str, pattern: str) -> Codec:
    return Codec(ranks_path, pattern)


def stitch(c: Codec, chunks: list[tuple[np.ndarray, bytes, np.ndarray]], text: str) -> bytes:
    """Ids of a text. chunks, by start: (boundaries from the text's start, ids of all pieces, where in them each boundary lies)."""
    out: list[bytes] = []
    pos = 0
    for k, (bounds, ids, at_byte) in enumerate(chunks):
        # Carry on one pre-token at a time until a boundary is also this chunk's; most often that is at once, as the one before has been cut where they agree.
        at = int(bounds.searchsorted(pos))
        while at == len(bounds) or bounds[at] != pos:
            if pos >= len(text):
                return b"".join(out)
            if at == len(bounds):  # beyond what this chunk knows
                break
            piece = c.split.match(text, pos)[0]
            out.append(c.ids[piece])
            pos += len(piece)
            at = int(bounds.searchsorted(pos))
        if at == len(bounds):
            continue
        stop = len(bounds) - 1
        if k + 1 < len(chunks):
            common = np.intersect1d(bounds[at:], chunks[k + 1][0], assume_unique=True)
            if len(common):
                stop = int(bounds.searchsorted(common[0]))
        out.append(ids[at_byte[at] : at_byte[stop]])
        pos = int(bounds[stop])
    while pos < len(text):
        piece = c.split.match(text, pos)[0]
        out.append(c.ids[piece])
        pos += len(piece)
    return b"".join(out)


def cut(text: str, chunk: int, overlap: int):
    for start in range(0, max(1, len(text)), chunk):
        end = start + chunk + overlap
        yield start, text[start:end], end >= len(text)
        if end >= len(text):
            return


def encode(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(key, ids): ids holds the tokens of the whole text as little-endian unsigned 32-bit integers."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    is_long = F.length("text") > chunk

    def whole(batches):
        c = codec(ranks_path, pattern)
        for b in slices(batches, "text", 4 << 20):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.encode(t) for t in b.column(1).to_pylist()], pa.binary())], ["key", "ids"])

    def to_chunks(batches):
        for b in slices(batches, "text", 1 << 20):
            for row in range(b.num_rows):
                t = b.column(1)[row].as_py()
                found = list(cut(t, chunk, overlap))
                n = len(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b.column(0)[row].as_py()] * n, b.schema.field(0).type), pa.array([b.column(2)[row].as_py()] * n, pa.int64()), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.string()), pa.array([x[2] for x in found], pa.bool_())],
                    ["key", "row", "start", "piece", "last"],
                )

    def tokenise(batches):
        c = codec(ranks_path, pattern)
        for b in slices(batches, "piece", 1 << 20):
            bounds, ids, counts = [], [], []
            for start, t, last in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                ends, pieces = c.chunk(t, last)
                found = [c.ids[p] for p in pieces]
                bounds.append((ends + start).astype("<i8").tobytes())
                ids.append(b"".join(found))
                counts.append(np.asarray([len(x) for x in found], "<i4").tobytes())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(bounds, pa.binary()), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], ["key", "row", "start", "piece", "bounds", "ids", "counts"])

    def join(part: pa.Table) -> pa.Table:
        c = codec(ranks_path, pattern)
        part = part.sort_by("start")
        bounds, ids, counts = (part.column(n).to_pylist() for n in ("bounds", "ids", "counts"))
        # A pre-token is known by its boundary alone: no object for each of them.
        chunks = [(np.frombuffer(b, "<i8"), x, np.concatenate([[0], np.cumsum(np.frombuffer(n, "<i4"))])) for b, x, n in zip(bounds, ids, counts, strict=True)]
        pieces = part.column("piece").to_pylist()
        whole_text = "".join([*(p[:chunk] for p in pieces[:-1]), pieces[-1]])
        return pa.table({"key": part.column("key").slice(0, 1), "ids": pa.array([stitch(c, chunks, whole_text)], pa.binary())})

    short = arrow_map(rows.filter(~is_long), whole, f"key {kind}, ids binary")
    # The row numbers tell apart long texts with the same key; they are written down before anything depends on them.
    cut_up = materialise(arrow_map(rows.filter(is_long).withColumn("row", F.monotonically_increasing_id()), to_chunks, f"key {kind}, row long, start long, piece string, last boolean"), "bpe-chunks")
    spread = cut_up.repartition(F.col("row"), F.col("start"))
    known = arrow_map(spread, tokenise, f"key {kind}, row long, start long, piece string, bounds binary, ids binary, counts binary")
    long = known.groupBy("row").applyInArrow(join, f"key {kind}, ids binary")
    return short.unionByName(long).withColumnRenamed("key", key)


def decode(tokens: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """tokens with a further column decoded: the bytes that the ids stand for."""
    kept = tokens.select(key, ids)

    def run(batches):
        c = codec(ranks_path, pattern)
        for b in slices(batches, ids, 4 << 20):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([c.decode(x or b"") for x in b.column(1).to_pylist()], pa.binary())], [*b.schema.names, "decoded"])

    return arrow_map(kept, run, f"{kept.schema[key].name} {kept.schema[key].dataType.simpleString()}, {ids} binary, decoded binary")


def digests(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of what decode() returns."""
    return tokens.select(key, (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
