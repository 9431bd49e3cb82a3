"""What the operators of this package share: shared tables, Arrow maps, word rules."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strideway.session import prepare, shared_top

#: The characters that part words, as bytes: blank, tab, line feed, vertical tab, form feed, return.
SPACE = b" \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    # Documents vary from one word to many thousands: Arrow batches are bounded by bytes, not by rows.
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    return shared_top(spark)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, and outlives any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    spark.sparkContext.__dict__.setdefault("_strideway_written", []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession) -> int:
    """Delete what materialise() has written in this application; for when no result of it will be read any more. Returns the number of tables."""
    paths = spark.sparkContext.__dict__.pop("_strideway_written", [])
    jvm = spark.sparkContext._jvm
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return len(paths)


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the bytes of one column stay near `most`; one row is never cut. A column of whole numbers tells its rows' bytes by itself, as for texts that are compressed."""
    import numpy as np

    for b in batches:
        if not b.num_rows:
            continue
        c = b.column(b.schema.get_field_index(column))
        off = np.concatenate([[0], np.cumsum(c.to_numpy())]) if pa.types.is_integer(c.type) else offsets(c)
        first = 0
        while first < b.num_rows:
            last = max(first + 1, int((off - off[first]).searchsorted(most, "right")) - 1)
            last = min(last, b.num_rows)
            yield b.slice(first, last - first)
            first = last


def offsets(column: pa.Array):
    """Byte offsets of a string or binary column, one more than rows, as int64."""
    import numpy as np

    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def raw_bytes(column: pa.Array):
    """(all bytes of the column as uint8, offsets from 0); a null is empty."""
    import numpy as np

    off = offsets(column)
    buf = column.buffers()[2]
    data = np.frombuffer(buf, np.uint8)[off[0] : off[-1]] if buf is not None else np.empty(0, np.uint8)
    if column.null_count:  # a null may cover bytes
        sizes = np.where(np.asarray(column.is_valid()), np.diff(off), 0)
        if sizes.sum() != len(data):
            keep = np.repeat(np.asarray(column.is_valid()), np.diff(off))
            data = data[keep]
        off = np.concatenate([[0], np.cumsum(sizes)])
        return data, off
    return data, off - off[0]


def texts(column: pa.Array) -> list[bytes]:
    """Each text as UTF-8 bytes; a null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name] for f in schema], schema=schema)


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def row_id(key: str, text: str) -> Column:
    """What tells rows apart where keys are null or repeated: key and digest of the text, in the order of keys, null last."""
    return F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.md5(text_of(text)).alias("digest"))


def rows_of(docs: DataFrame, ids: DataFrame, key: str, text: str) -> DataFrame:
    """The rows of docs whose row_id() is among ids (id), as they are. No key is hot: null ones are dealt out by their texts."""
    same = docs[key].eqNullSafe(ids["id"]["key"]) & (F.md5(F.coalesce(docs[text], F.lit(""))) == ids["id"]["digest"])
    return docs.join(ids, same, "left_semi")
