import random
import re

import numpy as np
import xxhash

from strideway.llm import jaccard, simhash
from strideway.llm.links import components
from strideway.llm.queries import op8_simhash

SCHEMA = "doc_id long, text string, fp string, component string, key string, u int"


def plain(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    sh = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(fps, radius=3):
    """{doc: smallest doc reachable} for [(doc, fp)]."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i][1] ^ fps[j][1]).count("1") <= radius:
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(fps):
        low[find(i)] = min(low.get(find(i), d), d)
    return {d: low[find(i)] for i, (d, _) in enumerate(fps)}


def check(rows, docs):
    want = [(d, plain(t)) for d, t in docs]
    comp = groups(want)
    got = {(r.doc_id, int(r.fingerprint, 16) if isinstance(r.fingerprint, str) else r.fingerprint, r.component_id) for r in rows}
    assert len(rows) == len(docs) and got == {(d, f, comp[d]) for d, f in want}


def test_whole_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(op8_simhash(spark, sf).collect(), docs)


def test_odd_texts_and_small_tiles(spark):
    rnd = random.Random(3)
    base = [rnd.choice(["aa", "Bb", "c,", "dé", "e"]) for _ in range(300)]
    docs = [(i, " ".join(base[:k] + ["X"] + base[k:])) for i, k in enumerate(range(0, 300, 7))]
    docs += [(500, ""), (501, None), (502, " \t\n"), (503, "one"), (504, "one two"), (505, "w " * 30000), (506, "one")]
    rows = spark.createDataFrame([(d, t, "", "", "", 1) for d, t in docs], SCHEMA)
    out = simhash.near_groups(rows).collect()
    want = [(d, plain(t)) for d, t in docs]
    comp = groups(want)
    assert {(r.doc_id, r.fp & (2**64 - 1), r.component) for r in out} == {(d, f, comp[d]) for d, f in want}
    assert simhash.near_groups(rows.limit(0)).count() == 0
    kept = simhash.one_of_each(rows)
    assert kept.columns == rows.columns and {r.doc_id for r in kept.collect()} == set(comp.values())
    # tiles of a few fingerprints: the same components
    rng = np.random.default_rng(1)
    seeds = rng.integers(-(2**63), 2**63, 40)
    fps = sorted({int(s) ^ (1 << int(a)) ^ (1 << int(b)) for s in seeds for a, b in rng.integers(0, 62, (12, 2))})
    links = simhash.near_links(spark.createDataFrame([(f,) for f in fps], "fp long"), tile=3)
    top = {r.u: r.v for r in components(links).collect()}
    want = groups([(f, f & (2**64 - 1)) for f in fps])
    assert {f: top.get(f, f) for f in fps} == want


def test_components_of_a_path_and_a_hub(spark):
    path = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7, 7)]
    got = {r.u: r.v for r in components(spark.createDataFrame(path, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{1000 + i: 1000 for i in range(1, 50)}}


def test_links_without_a_node(spark):
    links = [(1, None), (None, None), (3, 2), (2, 3), (3, 2), (5, 5)]
    assert [tuple(r) for r in components(spark.createDataFrame(links, "u long, v long")).collect()] == [(3, 2)]
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_null_keys_and_repeated_rows(spark):
    docs = [(3, "a b c d"), (3, "a b c d"), (None, "a b c d"), (None, "alone in its own words here"), (9, "x y z")]
    rows = spark.createDataFrame([(d, t, "", "", "", 1) for d, t in docs], SCHEMA)
    got = sorted(((r.doc_id, r.component) for r in simhash.near_groups(rows).collect()), key=str)
    assert got == sorted([(3, 3), (3, 3), (None, 3), (None, None), (9, 9)], key=str)
    odd = [*docs, (20, "p q r s"), (21, "p q r s"), (21, "words of no other text at all")]
    rows = spark.createDataFrame([(d, t, "", "", "", 1) for d, t in odd], SCHEMA)
    for one_of_each in (simhash.one_of_each, jaccard.one_of_each):
        got = one_of_each(rows)
        assert got.columns == rows.columns
        assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([odd[0], odd[1], odd[3], odd[4], odd[5], odd[7]], key=str)


def test_fingerprint_of_many_shingles():
    t = " ".join(str(i % 977) for i in range(9000))
    assert simhash.fingerprint(t.encode()) == plain(t)
