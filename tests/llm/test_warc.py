import base64
import hashlib
import random
from heapq import merge

import pytest
from pyspark.sql import functions as F

from strideway.llm import warc
from strideway.llm.queries import ORACLES, op5_warc
from tests.llm.oracle import same

SCHEMA = "page_id long, url string, html string, key string, ts string, archive int"
def when():
    return F.timestamp_seconds(F.lit(0) + F.coalesce("page_id", F.lit(0)))



def expected(rows, least=0):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        f = first.get(h or "")
        again = f is not None and i != f and len(raw) >= least
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", f if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 6])
def test_round_trip(spark, least):
    rnd = random.Random(8)
    rows = [(i, f"http://h{i % 7}.org/{i % 11}?a b\n", rnd.choice(["", None, "x\r\n\r\ny", "WARC/1.1\r\n", "é" * 9, f"own {i}"])) for i in range(90)]
    rows += [(200, None, "z" * 300_000), (201, "u", "z" * 300_000), (None, "u", "x\r\n\r\ny"), (None, "u", "alone"), (5, "again", rows[5][2])]
    pages = spark.createDataFrame([(*r, "", "", 1) for r in rows], SCHEMA).repartition(5)
    index = warc.history(warc.write(pages, when(), least=least))
    got = warc.read(index).collect()
    assert sorted(((r.key, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected(rows, least)
    html = {(i, h or "") for i, _, h in rows}
    assert all((r.key, bytes(r.payload).decode()) in html for r in got if r.record_type == "response")
    order = [(r.urlkey, r.ts, r.key is None, r.key or 0) for r in index.orderBy("range", "place").collect()]
    assert order == sorted(order) and len(order) == len(rows)


def test_no_pages(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert warc.read(warc.history(warc.write(none, when()))).count() == 0


def test_loser_tree():
    rnd = random.Random(2)
    for k in range(0, 9):
        runs = [sorted(rnd.randrange(50) for _ in range(rnd.randrange(0, 20))) for _ in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs])) == list(merge(*runs))


def test_query(spark, sf):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert sorted((tuple(r) for r in op5_warc(spark, sf).collect()), key=str) == expected(rows)


def test_query_against_sql(spark):
    for sf in ("/root/testdata/sf0.01", "/root/testdata/sf0.1"):
        same(op5_warc(spark, sf), ORACLES["op5_warc"], sf)
