import base64
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from strideway.llm import bpe

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def truth():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def run(spark, rows, **kw):
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, key string")
    out = bpe.decode(bpe.encode(docs, RANKS, P.PATTERN, **kw), RANKS, P.PATTERN).collect()
    return sorted(((r.doc_id if r.doc_id is not None else -1, np.frombuffer(r.ids, "<u4").tolist(), bytes(r.decoded)) for r in out), key=str)


def expected(truth, rows):
    return sorted(((d if d is not None else -1, truth.encode_ordinary(t or ""), (t or "").encode()) for d, t, *_ in rows), key=str)


def test_chunks_agree_with_the_library(spark, truth):
    rnd = random.Random(5)
    alphabet = ["a", "B", " ", "  ", "\n", "'re", "'", "'s", "9", "é", "漢", "!", "?!", "\t", "word", " the", "\U0001f600", "\r\n", " "]
    rows = [(i, "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(0, 400))), "x", "y") for i in range(60)]
    rows += [(100, "a" * 5000, "", ""), (101, " " * 3000 + "x", "", ""), (102, ("x" * 90 + " ") * 50, "", ""), (103, "'" * 999 + "re", "", "")]
    rows += [(7, "", "", ""), (8, None, "", ""), (None, "null key", "", ""), (0, "twice", "", ""), (0, "twice", "", ""), (9, "twice long " * 40, "", ""), (9, "twice long " * 40, "", "")]
    assert run(spark, rows, chunk=64, overlap=16) == expected(truth, rows)


def test_a_long_text_of_many_chunks(spark, truth):
    rnd = random.Random(8)
    text = "".join(rnd.choice(["some words ", "\n\n", "12345", " " * 700, "漢字", "x" * 900]) for _ in range(3000))
    rows = [(1, text, "", ""), (2, "", "", "")]
    assert run(spark, rows, chunk=4096, overlap=64) == expected(truth, rows)


def test_empty(spark):
    assert run(spark, []) == []


def test_real_texts(spark, truth, sf):
    from strideway.llm.queries import op6_byte_bpe
    import hashlib

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op6_byte_bpe(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = truth.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(docs[r.doc_id].encode()).hexdigest())
