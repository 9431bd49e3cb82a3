import os

import pyarrow as pa

from strideway.llm import common


def test_tables_are_written_and_dropped(spark):
    common.drop_tables(spark)
    df = common.materialise(spark.range(5), "five")
    path = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert df.count() == 5 and os.path.isdir(path)
    assert common.drop_tables(spark) == 1 and not os.path.exists(path)


def test_slices_and_bytes():
    rows = ["a" * 10, None, "", "é", "b" * 100, "c"]
    b = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(rows)], ["i", "t"])
    parts = list(common.slices(iter([b, b.slice(2, 0), b.slice(3)]), "t", 20))
    assert [x for p in parts for x in p.column(0).to_pylist()] == [0, 1, 2, 3, 4, 5, 3, 4, 5]
    for p in parts:
        data, off = common.raw_bytes(p.column(1))
        assert [data[a:c].tobytes() for a, c in zip(off[:-1], off[1:])] == [(t or "").encode() for t in p.column(1).to_pylist()] == common.texts(p.column(1))
