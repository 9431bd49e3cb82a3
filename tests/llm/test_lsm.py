import hashlib
import random
import re

from strideway.llm import lsm
from strideway.llm.queries import ORACLES, op4_exact_dedup
from tests.llm.oracle import same

SCHEMA = "doc_id long, text string, keep string, n string, digest string, sha256 string"


def rows():
    rnd = random.Random(2)
    out = [(i, rnd.choice(["a b c", "ab c", "a\nb\tc", "é é", "éé", "x", "", "  ", None, "unique %d" % i])) for i in range(300)]
    return out + [(1000, "long " * 40000), (1001, "long" * 40000), (1001, "long" * 40000), (None, "x"), (None, "lonely")]


def test_groups_and_distinct(spark):
    docs = spark.createDataFrame([(d, t, "", "", "", "") for d, t in rows()], SCHEMA)
    best, count = {}, {}
    for d, t in rows():
        norm = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        k = (-len(t or ""), lsm.LAST if d is None else d)
        best[norm], count[norm] = min(best.get(norm, k), k), count.get(norm, 0) + 1
    want = sorted(((d, k if (k := best[n][1]) != lsm.LAST else None, count[n], hashlib.sha256(n.encode()).hexdigest()) for d, t in rows() for n in [re.sub(r"[\x20\x09-\x0D]", "", t or "")]), key=str)
    got = lsm.exact_groups(docs).collect()
    assert sorted(((r.doc_id, r.keep, r.n, r.sha256) for r in got), key=str) == want
    assert all(r.kept == (r.doc_id == r.keep) for r in got)
    left = lsm.distinct(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id for r in left.collect()), key=str) == sorted(((k[1] if k[1] != lsm.LAST else None) for k in best.values()), key=str)
    assert lsm.exact_groups(docs.limit(0)).count() == 0 and lsm.distinct(docs.limit(0)).count() == 0


def test_index_levels_and_filters():
    rnd = random.Random(1)
    index, want = lsm.Index(memtable=10, fanout=3), {}
    for _ in range(2000):
        d, m, k = lsm.digest(bytes([rnd.randrange(200)])), -rnd.randrange(5), rnd.randrange(99)
        index.add(d, m, k)
        was = want.get(d, (m, k, 0))
        want[d] = (*min(was[:2], (m, k)), was[2] + 1)
    assert all(index.find(d) == (d, *w) for d, w in want.items()) and index.find(lsm.digest(b"none")) is None
    assert index.compact() == sorted((d, *w) for d, w in want.items())


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    same(op4_exact_dedup(spark, sf), ORACLES["op4_exact_dedup"], sf)


def test_small_memtables_runs_and_buckets(spark, monkeypatch):
    """Flushed runs and buckets of a few rows, and a filter that lets all through, give the same groups."""
    docs = spark.createDataFrame([(d, t, "", "", "", "") for d, t in rows()], SCHEMA)
    want = sorted((tuple(r) for r in lsm.exact_groups(docs).collect()), key=str)
    monkeypatch.setattr(lsm, "BUCKET", 7)
    monkeypatch.setattr(lsm, "MOST_BITS", 64)
    assert sorted((tuple(r) for r in lsm.exact_groups(docs).collect()), key=str) == want


def test_runs_hold_each_digest_once():
    import pyarrow as pa

    rnd = random.Random(3)
    entries = [(bytes([rnd.randrange(5)]) * 16, -rnd.randrange(9), rnd.randrange(50), 1) for _ in range(200)]
    best = {d: (*min(e[1:3] for e in entries if e[0] == d), sum(e[3] for e in entries if e[0] == d)) for d, *_ in entries}
    batches = [lsm._entries(sorted(entries)[i : i + 30]) for i in range(0, 200, 30)]
    got = [tuple(r.values()) for b in lsm._compacted(iter(batches)) for r in pa.Table.from_batches([b]).to_pylist()]
    assert got == sorted((d, *v) for d, v in best.items())
