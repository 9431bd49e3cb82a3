import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strideway.llm import automaton, repeats, suffixes
from strideway.llm import minimizers as M
from strideway.llm.queries import ORACLES, op2_substring_dedup, op9_suffix_array
from tests.llm.oracle import same

SCHEMA = "doc_id long, text string, doc string, tag string, kept string, spans int"
LAST = 2**63 - 1


def plain_words(rows, w):
    """rows in order -> (key, words, removed, kept)."""
    split = [(LAST if d is None else d, i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, (d, t) in enumerate(rows)]
    first = {}
    for d, i, words in sorted(split, key=lambda x: x[:2]):
        for k in range(len(words) - w + 1):
            first.setdefault(tuple(words[k : k + w]), (d, i, k))
    out = []
    for d, i, words in split:
        gone = [False] * len(words)
        for k in range(len(words) - w + 1):
            if first[tuple(words[k : k + w])] != (d, i, k):
                gone[k : k + w] = [True] * w
        out.append((None if d == LAST else d, len(words), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(words, gone) if not g).encode()).hexdigest()))
    return sorted(out, key=str)


def plain_bytes(rows, w):
    raw = [(d, (t or "").encode()) for d, t in rows]
    seen = {}
    for _, b in raw:
        for k in range(len(b) - w + 1):
            seen[b[k : k + w]] = seen.get(b[k : k + w], 0) + 1
    out = []
    for d, b in raw:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - w + 1):
            if seen[b[k : k + w]] > 1:
                gone[k : k + w] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rnd = random.Random(seed)
    words = ["a", "bb", "ccc", "é", "the", "Of", "x,", "12"] + ["w%d" % i for i in range(300)]
    passage = [[rnd.choice(words) for _ in range(rnd.randrange(10, 90))] for _ in range(12)]
    rows = []
    for i in range(120):
        body = []
        for _ in range(rnd.randrange(0, 5)):
            body += rnd.choice(passage) if rnd.random() < 0.5 else [rnd.choice(words) for _ in range(rnd.randrange(1, 60))]
        rows.append((i, rnd.choice([" ", "  ", "\n"]).join(body)))
    base = [rnd.choice(words) for _ in range(150)]
    for i in range(30):  # near copies
        some = list(base)
        some[rnd.randrange(150)] = "edit%d" % i
        rows.append((1000 + i, " ".join(some)))
    rows += [(2000 + i, " ".join(base)) for i in range(10)]
    rows += [(3000, ""), (3001, None), (3002, " \t"), (3003, "same " * 400), (3004, "same " * 21), (3005, "ab " * 333), (3006, "q" * 450), (3007, "one"), (3008, "x" * 199 + "é" + "x" * 300)]
    return rows


def run(spark, rows, op, least, columns, **kw):
    df = spark.createDataFrame([(d, t, "", "", "", 1) for d, t in rows], SCHEMA).coalesce(1)
    return sorted(((r.doc, *(r[c] for c in columns), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in op(df, least, **kw).collect()), key=str)


@pytest.mark.parametrize(("most", "levels"), [(automaton.MOST, 6), (1000, 6), (100, 1), (30, 0)])
def test_words(spark, monkeypatch, most, levels):
    monkeypatch.setattr(repeats, "LEVELS", levels)
    rows = corpus(1)
    assert run(spark, rows, automaton.remove_repeated, 20, ["n_units", "n_removed"], most=most) == plain_words(rows, 20)
    if levels != 6 or most > 1000:
        assert run(spark, rows, automaton.remove_repeated, 5, ["n_units", "n_removed"], most=most) == plain_words(rows, 5)


@pytest.mark.parametrize(("most", "levels"), [(suffixes.MOST, 6), (10_000, 6), (1000, 1), (300, 0)])
def test_bytes(spark, monkeypatch, most, levels):
    monkeypatch.setattr(repeats, "LEVELS", levels)
    rows = corpus(2)
    assert run(spark, rows, suffixes.remove_repeated, 200, ["n_units", "n_removed", "n_spans"], most=most) == plain_bytes(rows, 200)
    if levels != 6 or most > 10_000:
        assert run(spark, rows, suffixes.remove_repeated, 75, ["n_units", "n_removed", "n_spans"], most=most) == plain_bytes(rows, 75)


@pytest.mark.parametrize("u", [repeats.Units(20, 8, 512, True, 4096), repeats.Units(200, 32, 4096, False, 32_768)])
def test_a_document_that_joins_all_others_makes_no_large_shard(spark, sf, u):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r.text]
    rows = [(0, "\n".join(t for _, t in rows)), *rows]
    docs = repeats.numbered(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    segs = spark.createDataFrame(repeats.arrow_map(docs, repeats._segments(u), repeats.CUT).toPandas())
    keys = repeats.sharded(segs, u)
    held = segs.join(keys, "key").groupBy("shard").agg(F.sum(F.col("n") + u.window - 1).alias("size"), F.countDistinct("key").alias("keys"), F.max("total").alias("total"))
    all_units = segs.agg(F.sum(F.col("n") + u.window - 1)).first()[0]
    got = held.collect()
    # What is over a shard's limit is a single key, whose total says into how many parts it goes.
    assert all(r["size"] == r.total for r in got) and all(r["keys"] == 1 for r in got if r["size"] > u.most)
    assert max(r["size"] for r in got) < 0.05 * all_units


def test_a_part_hands_on_one_of_each_window():
    body = b" ".join(b"w%d" % i for i in range(40))
    other = b"x " + b" ".join(body.split()[:20])
    names = ["shard", "part", "doc", "tag", "start", "n", "cuts", "whole", "body"]
    for whole in (True, False):
        rows = [(1, 0, d, 0, 0, len(t.split()) - 19, [0], whole, t) for d, t in enumerate([body, body, other])]
        got = [r for x in automaton._compare(20)(iter([pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], pa.schema([*((n, pa.int64()) for n in names[:6]), ("cuts", pa.list_(pa.int64())), ("whole", pa.bool_()), ("body", pa.binary())]))])) for r in x.to_pylist()]
        assert [(r["doc"], np.frombuffer(r["spans"], "<i8").tolist()) for r in got if r["spans"] is not None] == [(1, [0, 21]), (2, [1, 2])]
        assert [(r["doc"], r["start"], r["n"], r["body"]) for r in got if r["body"] is not None] == ([] if whole else [(0, 0, 21, body), (2, 0, 1, b" ".join(other.split()[:20]))])
        rows = [(1, 0, d, 0, 5, len(t) - 49, [0, 7], whole, t) for d, t in enumerate([body, body, other])]
        got = [r for x in suffixes._compare(50)(iter([pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], pa.schema([*((n, pa.int64()) for n in names[:6]), ("cuts", pa.list_(pa.int64())), ("whole", pa.bool_()), ("body", pa.binary())]))])) for r in x.to_pylist()]
        m = len(body) - 49
        assert [(r["doc"], np.frombuffer(r["spans"], "<i8").tolist()) for r in got if r["spans"] is not None] == [(0, [5, 5 + m]), (1, [5, 5 + m]), (2, [7, 7 + len(other) - 51])]
        assert [(r["doc"], r["start"], r["n"]) for r in got if r["body"] is not None] == ([] if whole else [(0, 5, m), (2, 5, 2)])


def test_repeated_and_null_keys(spark):
    text = " ".join("k%d" % i for i in range(70))
    rows = [(1, text), (1, text), (None, text), (None, "other " + text), (0, "tail " + text)]
    assert run(spark, rows, automaton.remove_repeated, 20, ["n_units", "n_removed"]) == plain_words(rows, 20)
    assert run(spark, rows, suffixes.remove_repeated, 100, ["n_units", "n_removed", "n_spans"]) == plain_bytes(rows, 100)
    assert run(spark, [], automaton.remove_repeated, 20, []) == [] and run(spark, [], suffixes.remove_repeated, 200, []) == []


def test_known_reference(spark):
    rnd = random.Random(3)
    ref = [" ".join("r%d" % rnd.randrange(50) for _ in range(80)) for _ in range(5)]
    rows = [(1, "before " + ref[0] + " after"), (2, "r1 r2 r3"), (3, None), (None, " ".join(ref[1].split()[10:40]) + " end")]
    df = spark.createDataFrame([(d, t, "", "", "", 1) for d, t in rows], SCHEMA)
    known = spark.createDataFrame([(t,) for t in [*ref, None]], "text string")
    got = {r.doc: (r.n_removed, bytes(r.kept)) for r in automaton.remove_known(df, known).collect()}
    assert got == {1: (80, b"before after"), 2: (0, b"r1 r2 r3"), 3: (0, b""), None: (30, b"end")}
    with pytest.raises(ValueError):
        automaton.remove_known(df, known, most_words=10)
    assert automaton.remove_known(df.limit(0), known).count() == 0
    twice = {(r.doc, r.n_removed): n for r, n in Counter(automaton.remove_known(df.unionByName(df), known.limit(0)).select("doc", "n_removed").collect()).items()}
    assert twice == {(d, 0): 2 for d in (1, 2, 3, None)}


def test_long_texts_come_in_parts(monkeypatch):
    monkeypatch.setattr(M, "PIECE", 4096)
    rnd = random.Random(4)
    for u in (repeats.Units(20, 8, 512, True, 1), repeats.Units(200, 32, 4096, False, 1)):
        text = " ".join(rnd.choice(["alpha", "b", "cc", "é"]) for _ in range(9000))
        units = text.split() if u.words else text.encode()
        n = len(units) - u.window + 1
        b = pa.RecordBatch.from_arrays([pa.array([text])], ["text"])
        seen = np.zeros(n, int)
        keys = {}
        for _, grams, bounds, first in repeats._pieces(b, u):
            s = M.segments(grams, bounds, u.window, u.gram)
            for start, m, key in zip(s.start + first[0], s.n, s.key):
                seen[start : start + m] += 1
                for k in range(start, start + m):
                    keys.setdefault(tuple(units[k : k + u.window]), set()).add(int(key))
        assert (seen == 1).all()
        assert all(len(k) == 1 for k in keys.values())


def test_suffix_array_is_sorted():
    rnd = random.Random(5)
    for alphabet in (b"ab", b"a", b"abcdefgh "):
        passages = [bytes(rnd.choice(alphabet) for _ in range(rnd.randrange(70, 400))) for _ in range(8)]
        passages += passages[:2]
        t = np.frombuffer(b"".join(passages) + b"\x00" + b"\xff" * 200, np.uint8)
        wanted = np.zeros(len(t), bool)
        wanted[: len(t) - 201] = True
        sa = suffixes.suffix_array(t, wanted, 64)
        raw = t.tobytes()
        keys = [raw[i : i + 64] for i in sa.tolist()]
        assert sorted(sa.tolist()) == list(range(len(t) - 201)) and keys == sorted(keys)
        shared = [next((k for k in range(64) if a[k] != b[k]), 64) for a, b in zip(keys, keys[1:])]
        assert suffixes.common_prefixes(t, sa, 64).tolist() == shared


def test_automaton_finds_every_substring():
    rnd = random.Random(6)
    for _ in range(30):
        seqs = [[rnd.choice("ab") for _ in range(rnd.randrange(1, 20))] for _ in range(3)]
        a = automaton.Automaton()
        for s in seqs:
            a.add(s)
        probe = [rnd.choice("abc") for _ in range(40)]
        have = {tuple(s[i : i + 4]) for s in seqs for i in range(len(s) - 3)}
        want = [i >= 3 and tuple(probe[i - 3 : i + 1]) in have for i in range(40)]
        assert a.matches(probe, 4).tolist() == want


def test_whole_tables(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in op2_substring_dedup(spark, sf).collect()), key=str) == plain_words(rows, 20)
    assert sorted((tuple(r) for r in op9_suffix_array(spark, sf).collect()), key=str) == plain_bytes(rows, 200)


def test_queries_against_sql(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        for f in (op2_substring_dedup, op9_suffix_array):
            same(f(spark, sf), ORACLES[f.__name__], sf)
