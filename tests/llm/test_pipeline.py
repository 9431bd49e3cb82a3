import re
import zlib
from collections import Counter

import corpus_pipeline as cp
from strideway.llm import langid
from strideway.llm.queries import op6_byte_bpe
from tests.llm.test_simhash import groups, plain


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.collect()

    kept = cp.language(spark, docs, sf)
    assert kept.columns == docs.columns
    a = kept.collect()
    labelled = [r for r in rows if r.lang and zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    assert labelled
    model = langid.train(docs.filter(~cp.held_out()))
    ok = dict(zip((r.doc_id for r in rows), langid.judge(model, [r.text for r in rows])[2]))
    assert {r.doc_id for r in a} == {d for d, x in ok.items() if x}
    assert len(a) >= 0.98 * sum(1 for r in rows if r.text and re.search(r"[^\W\d_]", r.text))

    b = cp.exact(spark, kept, sf).collect()
    best = {}
    for r in a:
        norm = re.sub(r"[\x20\x09-\x0D]", "", r.text)
        best[norm] = min(best.get(norm, (-len(r.text), r.doc_id)), (-len(r.text), r.doc_id))
    assert {r.doc_id for r in b} == {d for _, d in best.values()} and len(b) == len(best)

    left = spark.createDataFrame(b, docs.schema)
    c = cp.near(spark, left, sf).collect()
    comp = groups([(r.doc_id, plain(r.text)) for r in b])
    assert sorted(r.doc_id for r in c) == sorted(set(comp.values()))

    left = spark.createDataFrame(c, docs.schema)
    d = cp.mixture(spark, left, sf).collect()
    n = Counter(r.doc_id for r in d)
    assert max(n.values()) <= 3 and set(n) <= {r.doc_id for r in c}
    taken = {r.doc_id: r for r in cp.mixing.plan(left).collect()}
    assert all(n.get(i, 0) == int(r.taken / r.size + 0.5) for i, r in taken.items() if r.size)

    whole = {r.doc_id: r for r in op6_byte_bpe(spark, sf).collect()}
    got = cp.tokens(spark, spark.createDataFrame(d, docs.schema), sf).collect()
    assert Counter(r.doc_id for r in got) == n and all(r == whole[r.doc_id] for r in got)


def test_odd_documents(spark, sf):
    schema = "doc_id long, text string, lang string, source string, n_chars long, size long, kept string, key int"
    odd = [(1, None, None, None, 0, 1, "", 1), (2, "", "en", "a", 0, 1, "", 1), (3, "the word " * 30000, "en", "a", 1, 1, "", 1), (4, "the other text is here", "en", None, 1, 1, "", 1), (4, "the other text is here", "en", None, 1, 1, "", 1), (None, "one more the text", None, "b", 1, 1, "", 1)]
    for rows in (odd, []):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in cp.STAGES[:-1]:
            after = stage(spark, docs, sf)
            assert after.columns == docs.columns
            docs = spark.createDataFrame(after.collect(), schema)
        assert cp.tokens(spark, docs, sf).count() == docs.count()
        if rows:
            assert docs.filter("doc_id in (1, 2)").count() == 0 and docs.count() > 0
