import math
import random

from pyspark.sql import functions as F

from strideway.llm import topk
from strideway.llm.queries import ORACLES, op1_top_k
from tests.llm.oracle import same

SCHEMA = "vec_id long, embedding array<float>, key string, rank string, q int"


def plain(rows, k, every, scale=256):
    ok = [(i, [math.floor(scale * x) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    queries = {}
    for i, v in ok:
        if i % every == 0:
            queries[i] = min(queries.get(i, v), v)
    for q, v in queries.items():
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q and len(w) == len(v))[:k]
        out |= {(q, r + 1, i, max(-(2**63), min(2**63 - 1, -s))) for r, (s, i) in enumerate(best)}
    return out


def run(spark, rows, k, every, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    got = topk.top_k(df, F.col("vec_id") % every == 0, k, **kw).collect()
    assert len(got) == len(set(got))
    return {tuple(r) for r in got}


def test_ties_odd_vectors_and_blocks(spark):
    rnd = random.Random(6)
    rows = [(i, [rnd.choice([-0.5, 0.0, 0.25, 0.5]) for _ in range(3)], "", "", 1) for i in range(120)]
    rows += [(i, [0.5, 0.5, 0.5], "", "", 1) for i in range(200, 260)]
    rows += [(300, None, "", "", 1), (310, [None, 1.0, 1.0], "", "", 1), (320, [math.nan, 1.0, 1.0], "", "", 1), (330, [math.inf, 0.0, 0.0], "", "", 1), (None, [0.5] * 3, "", "", 1)]
    rows += [(340, [1.0, 2.0], "", "", 1), (341, [1.0, 1.0], "", "", 1), (350, [], "", "", 1)]
    want = plain(rows, 5, 10)
    assert run(spark, rows, 5, 10) == want
    assert run(spark, rows, 5, 10, block=4) == want
    assert run(spark, rows, 5, 10, group=7) == want
    again = [*rows, (0, [0.5, 0.5, 0.5], "", "", 1), (0, [-0.5, 0.5, 0.5], "", "", 1), (1, [0.5, 0.5, 0.5], "", "", 1), rows[4], rows[4]]
    df = spark.createDataFrame(again, SCHEMA)
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 10 == 0, 5).collect())
    assert set(got) == plain(again, 5, 10) and all(len([x for x in got if x[:2] == r[:2]]) == 1 for r in got)


def test_large_components_and_few_rows(spark):
    rows = [(0, [3e7, -3e7], "", "", 1), (1, [1e7, 1e7], "", "", 1), (2, [3e7, 1.0], "", "", 1), (50, [2e5, 1e5], "", "", 1)]
    assert run(spark, rows, 5, 50) == plain(rows, 5, 50)
    assert run(spark, rows[:1], 5, 50) == set() and run(spark, [], 5, 50) == set()


def test_query_against_sql(spark):
    for sf in ("/root/testdata/sf0.01", "/root/testdata/sf0.1"):
        same(op1_top_k(spark, sf), ORACLES["op1_top_k"], sf)
