import random

import corpus_pipeline as cp
import numpy as np

from strideway.llm import jaccard
from strideway.llm.lsm import distinct
from tests.llm.test_simhash import SCHEMA


def sets(text):
    w = text.lower().split()
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def roots(docs):
    """{doc: smallest doc of its component of pairs of 0.8 or more} for [(doc, text)]."""
    of, root = [sets(t) for _, t in docs], list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(of[i] & of[j])
            if both and 5 * both >= 4 * (len(of[i]) + len(of[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {d: docs[find(i)][0] for i, (d, _) in enumerate(docs)}


def test_stage_leaves_no_near_copies(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        docs = distinct(spark.read.parquet(f"{sf}/documents.parquet"))
        stage = dict(cp.STAGES)["SimHash near-dedup"]
        first = cp.near(spark, docs, sf)
        want = set(roots(sorted((r.doc_id, r.text or "") for r in first.collect())).values())
        got = stage(spark, docs, sf)
        assert got.columns == docs.columns and {r.doc_id for r in got.collect()} == want
        assert len(want) < first.count()


def test_chains_hubs_and_odd_texts(spark):
    rnd = random.Random(6)
    base = [str(rnd.randrange(10**6)) for _ in range(200)]
    docs = [(900 - i, " ".join(base[3 * i : 3 * i + 120])) for i in range(20)]  # a chain: the ends share little
    docs += [(i, " ".join(["hub"] * 3 + base[:i] + ["X"] + base[i:])) for i in range(60)]
    docs += [(i, t) for i, t in ((2000, ""), (2001, ""), (2002, "one Two"), (2003, "ONE  two"), (2004, "one"), (2005, "w " * 3000))]
    rows = spark.createDataFrame([(d, t, "", "", "", 1) for d, t in docs] + [(None, "one two", "", "", "", 1)], SCHEMA)
    comp = roots(sorted(docs))
    left = jaccard.one_of_each(rows)
    assert left.columns == rows.columns
    assert {r.doc_id for r in left.collect()} == set(comp.values()) - {2001}  # texts without words are the same node
    assert jaccard.one_of_each(rows.limit(0)).count() == 0


def test_large_groups_go_by_tiles(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", 5)
    test_chains_hubs_and_odd_texts(spark)


def test_bands_of_pairs_at_the_limit():
    rng = np.random.default_rng(2)
    miss = 0
    for _ in range(500):
        x = rng.integers(0, 2**63, 220).astype(np.uint64)
        got = jaccard.bands([np.sort(x[:180]), np.sort(np.concatenate([x[:160], x[180:200]]))])
        miss += not (got[0] == got[1]).any()
    assert miss == 0
