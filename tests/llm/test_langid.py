import zlib

from pyspark.sql import functions as F

from strideway.llm import langid
from strideway.llm.queries import op3_language_id

SCHEMA = "doc_id long, text string, lang string, score string, key string"


def rows():
    out = []
    for i in range(60):
        out.append((i, "the cat and the dog are with this thing " * (1 + i % 5), "en", "", ""))
        out.append((100 + i, "der hund und die katze sind nicht schön " * (1 + i % 5), "de", "", ""))
    return out


def test_learns_and_handles_odd_texts(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    model = langid.train(docs)
    odd = [(1, None), (2, ""), (3, "123 ... !!"), (4, "the dog"), (4, "die katze und der hund"), (None, "the thing " * 50000), (5, "漢字")]
    got = {(r.doc_id, r.lang_pred) for r in langid.predict(spark.createDataFrame([(*x, "", "", "") for x in odd], SCHEMA), model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "de"), (None, "en")} <= got
    kept = langid.accepted(spark.createDataFrame([(*x, "", "", "") for x in odd], SCHEMA), model)
    assert kept.columns == ["doc_id", "text", "lang", "score", "key"] and kept.filter("doc_id in (1, 2, 3)").count() == 0


def test_rejects_what_was_not_learned_and_keeps_mixtures(spark):
    import random

    rnd = random.Random(1)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [r for r in docs.collect() if r.text and langid.LETTER.search(r.text)]
    for labels in (["de", "en", "es", "fr"], ["de", "en"]):
        some = docs.filter(docs.lang.isin(labels))
        model = langid.train(some)
        assert 0 < model.strange < model.familiar <= 1 and 0.002 < model.temperature < 20
        for letters in ("абвгдежзиклмнопрстуфхцчшщыэюя", "αβγδεζηθικλμνξοπρστυφχψω", "".join(map(chr, range(0x4E00, 0x5600))), "bcdfghjklmnpqrstvwxz"):
            texts = [" ".join("".join(rnd.choices(letters, k=rnd.randrange(2, 9))) for _ in range(rnd.randrange(5, 80))) for _ in range(100)]
            assert not langid.judge(model, texts)[2].any()
        clean = [r.text for r in rows if r.lang in labels]
        assert langid.judge(model, clean)[2].mean() > 0.995
        by = {x: [r.text for r in rows if r.lang == x][:40] for x in labels}
        mixed = [" ".join(a.split()[:50] + b.split()[:50]) for a, b in zip(by["de"], by["en"])]
        assert langid.judge(model, mixed)[2].all()


def test_no_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "text", None, "", "")], SCHEMA)
    model = langid.train(docs)
    assert [r.lang_pred for r in langid.predict(docs, model).collect()] == ["und"]
    assert langid.predict(docs.limit(0), model).count() == 0


def test_ties_go_to_the_first_label():
    import numpy as np

    model = langid.Model(["b", "c"], np.zeros((1 << langid.BUCKET_BITS, 2)), np.zeros(2), 1.0, 0.0)
    names, score, _ = langid.judge(model, ["word", "", None])
    assert names == ["b", "und", "und"] and score.tolist() == [0.5, 0, 0]


def test_subwords_stay_inside_their_text():
    import numpy as np

    texts = ["ab", "", None, "abc d", "x", "Über-größe 12"]
    ids, n = langid.subwords(texts)
    parts = np.split(ids, np.cumsum(n)[:-1])
    for t, p in zip(texts, parts, strict=True):
        alone, m = langid.subwords([t])
        assert m[0] == len(p) and (np.asarray(alone) == p).all()


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = op3_language_id(spark, sf).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(got) == len(truth)
    held = [r for r in got if r.held_out and r.lang_pred != "und"]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_scores_against_a_plain_version(spark):
    """Whole texts, learned from and judged: means over all subwords, however long a text is."""
    import numpy as np

    docs = spark.createDataFrame(rows() + [(500, "the long cat " * 4000, "en", "", "")], SCHEMA)
    model = langid.train(docs)
    for text in ("the dog", "die katze und der hund " * 3000, "Thing, 12 und"):
        ids, n = langid.subwords([text])
        z = np.zeros(len(model.labels)) + model.bias
        for i in ids:
            z = z + model.scores[i] / n[0]
        z = z / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        names, score, _ = langid.judge(model, [text])
        assert names == [model.labels[int(p.argmax())]] and abs(score[0] - p.max()) < 1e-9
    some, weight = langid.counted(["the the the cat", None, ""])[0]
    ids, _ = langid.subwords(["the the the cat"])
    assert dict(zip(some.tolist(), weight.tolist())) == {i: ids.tolist().count(i) for i in set(ids.tolist())}


def test_pipeline_rejects_planted_foreign_texts(spark, sf):
    """Texts in letters that no label has go, the others stay."""
    import random

    import corpus_pipeline as cp

    rnd = random.Random(4)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    planted = [(10**6 + i, " ".join("".join(rnd.choices(letters, k=rnd.randrange(2, 9))) for _ in range(60)), None, "planted", 0) for i in range(15) for letters in ["абвгдежзиклмнопрст", "αβγδεζηθικλμνξοπρ", "".join(map(chr, range(0x3041, 0x3090)))][i % 3 :][:1]]
    both = docs.unionByName(spark.createDataFrame(planted, "doc_id long, text string, lang string, source string, n_chars long").select(*[F.col(c).cast(docs.schema[c].dataType) for c in docs.columns]))
    kept = {r.doc_id for r in cp.language(spark, both, sf).select("doc_id").collect()}
    assert not kept & {p[0] for p in planted}
    some = {r.doc_id for r in docs.collect() if r.text and len(r.text) > 200 and langid.LETTER.search(r.text)}
    assert len(kept & some) >= 0.98 * len(some)
