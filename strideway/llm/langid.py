"""Language identification: averaged hashed subword embeddings under a linear softmax.

Subwords are runs of three or four bytes of the lower-cased text that don't reach over a word's
end; each hashes to a bucket with an embedding. A text's embedding is the mean over all its
subwords, wherever they stand, so whole texts count. Training is stochastic gradient descent in
numpy over a bounded, hash-chosen sample of labelled rows. A held-back tenth of the sample sets a
temperature (calibration) and what a text is rejected by: its confidence, and its share of known
subwords, which training has met. A text in no learned language hits known buckets by chance only and is
rejected however sure the softmax is; one of several learned languages is unsure, but all known, and stays.

As softmax is linear in the embedding, prediction keeps embedding x weights: one small row of
scores for each bucket, of fixed size.

Cases: a null text or one without a letter is `und` with score 0 and rejected; with no labelled
row at all every text is `und`, and one with a letter is accepted, as nothing speaks against it; rows are judged one by one, so repeated rows, repeated or null
keys keep their own; of labels with the same score the first by code point wins; an empty table gives none; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideway.llm.common import arrow_map, slices

UNKNOWN = "und"
#: Mean size of a text beyond which embeddings learn no faster.
RATE_SIZE = 768
BUCKET_BITS = 16
#: How buckets and counts of a text are sent.
KINDS = ("<u2", "<u4")
LETTER = regex.compile(r"\p{L}")
#: Blanks, digits and ASCII punctuation end a word.
BREAKS = bytes(32 if i < 128 and not chr(i).isalpha() else i for i in range(256))


@dataclass
class Model:
    labels: list[str]
    scores: np.ndarray  # (buckets, labels)
    bias: np.ndarray
    temperature: float
    threshold: float
    #: Buckets that training has met; the share of them from which an unsure text is accepted; and below which any is rejected.
    seen: np.ndarray | None = None
    familiar: float = 0.0
    strange: float = 0.0


def subwords(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every subword, number of subwords of each text)."""
    raw = [(t or "").lower().encode().translate(BREAKS) for t in texts]
    joined = b" " + b"  ".join(raw) + b"   "  # two blanks part texts, so that no subword reaches over
    b = np.frombuffer(joined, np.uint8)
    ends = np.cumsum([len(x) + 2 for x in raw])
    n = len(b) - 3
    wide = b.astype(np.uint32)
    three = wide[:n] | wide[1 : n + 1] << np.uint32(8) | wide[2 : n + 2] << np.uint32(16)
    inner = b[1 : n + 1] != 32
    four_ok = np.flatnonzero(inner & (b[2 : n + 2] != 32))
    three_ok = np.flatnonzero(inner)
    mix, shift = np.uint32(0x9E3779B1), np.uint32(32 - BUCKET_BITS)
    h3 = three[three_ok] * mix >> shift
    h4 = (three[four_ok] | wide[four_ok + 3] << np.uint32(24)) * np.uint32(0x85EBCA6B) >> shift
    c3, c4 = three_ok.searchsorted(ends - 1), four_ok.searchsorted(ends - 1)
    starts3, starts4 = np.concatenate([[0], c3[:-1]]), np.concatenate([[0], c4[:-1]])
    counts = (c3 - starts3) + (c4 - starts4)
    out = np.empty(len(h3) + len(h4), np.uint32)
    to = np.concatenate([[0], np.cumsum(counts)[:-1]])
    for h, starts, c, base in ((h3, starts3, c3, to), (h4, starts4, c4, to + (c3 - starts3))):
        out[np.arange(len(h)) + np.repeat(base - starts, c - starts)] = h
    return out, counts


def means(rows: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Mean of the rows of each text's subwords; 0 for a text without any."""
    out = np.zeros((len(counts), rows.shape[1]))
    some = np.flatnonzero(counts)
    if len(some):
        starts = np.concatenate([[0], np.cumsum(counts)])[some]
        out[some] = np.add.reduceat(rows[ids], starts, axis=0) / counts[some, None]
    return out


def logits(model: Model, texts: list[str | None]) -> np.ndarray:
    """Mean score of each label over the subwords of each text."""
    return means(model.scores, *subwords(texts)) + model.bias


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def counted(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, how often each) of the subwords of each text."""
    ids, n = subwords(texts)
    return [np.unique(part, return_counts=True) for part in np.split(ids, np.cumsum(n)[:-1])]


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[str], *, dims: int = 16, epochs: int = 12, rate: float = 0.5, minibatch: int = 32, most_rejected: float = 0.001, seed: int = 7) -> Model:
    """Train on rows of (buckets, counts). Deterministic for rows in a given order. threshold and familiar are what a share most_rejected of held-back rows is below; strange is half way from familiar to the share that chance gives."""
    names = sorted(set(labels))
    y = np.asarray([names.index(x) for x in labels], int)
    sizes = np.asarray([max(1, c.sum(dtype=np.int64)) for _, c in rows])
    share = [(c / n).astype(np.float32) for (_, c), n in zip(rows, sizes, strict=True)]  # weights of a text's mean
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    held, left = order[: len(order) // 10], order[len(order) // 10 :]
    emb = rng.normal(0, 0.1, (1 << BUCKET_BITS, dims))
    w, bias = rng.normal(0, 0.1, (dims, len(names))), np.zeros(len(names))
    weight = len(y) / (len(names) * np.maximum(1, np.bincount(y, minlength=len(names))))
    steps, step = max(1, epochs * -(-len(left) // minibatch)), 0
    slot = np.zeros(1 << BUCKET_BITS, np.int64)
    for _ in range(epochs):
        left = rng.permutation(left)
        for at in range(0, len(left), minibatch):
            pick = left[at : at + minibatch]
            flat = np.concatenate([rows[i][0] for i in pick])
            met = np.unique(flat)
            slot[met] = np.arange(len(met))
            part = np.zeros((len(pick), len(met)))
            part[np.repeat(np.arange(len(pick)), [len(rows[i][0]) for i in pick]), slot[flat]] = np.concatenate([share[i] for i in pick])
            mean = part @ emb[met]
            p = softmax(mean @ w + bias)
            p[np.arange(len(pick)), y[pick]] -= 1
            p *= weight[y[pick]][:, None] / len(pick)
            lr = rate * (1 - step / steps)
            back = p @ w.T
            # Each subword's share of the gradient is small; embeddings get a rate in proportion to the mean size of a text, up to RATE_SIZE.
            emb[met] -= lr * min(RATE_SIZE, sizes[pick].mean()) * (part.T @ back)
            w -= lr * mean.T @ p
            bias -= lr * p.sum(0)
            step += 1
    model = Model(names, emb @ w, bias, 1.0, 0.0)
    if len(held):
        model.seen = np.zeros(1 << BUCKET_BITS, bool)
        for i in left:
            model.seen[rows[i][0]] = True
        model.familiar = float(np.quantile([(model.seen[rows[i][0]] * share[i]).sum() if len(share[i]) else 1.0 for i in held], most_rejected))
        chance = model.seen.mean()
        model.strange = float(chance + max(0.0, model.familiar - chance) / 2)
    if len(held) and len(names) > 1:
        z = np.stack([share[i] @ model.scores[rows[i][0]] if len(share[i]) else np.zeros(len(names)) for i in held]) + bias
        # Targets short of 1, as by Platt: rows that are all told apart have a best temperature above 0.
        aim = np.full((len(held), len(names)), 1 / (len(held) + 2) / (len(names) - 1))
        aim[np.arange(len(held)), y[held]] = 1 - 1 / (len(held) + 2)
        grid = np.geomspace(0.002, 20, 121)
        loss = [-(aim * np.log(softmax(z / t) + 1e-300)).sum(1).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
        model.threshold = float(np.quantile(softmax(z / model.temperature).max(1), most_rejected))
    return model


def bucket_of(key: Column) -> Column:
    return F.crc32(key.cast("string"))


def train(rows: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", per_label: int = 1200, seed: int = 7, **kw) -> Model:
    """Learn from rows with a label: all words of at most per_label rows of each label on average, chosen by a hash of the key. The driver gets the buckets and counts of those rows, so its memory is bounded by per_label times the number of labels, which are languages."""
    rows = rows.filter(F.col(label).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"), F.col(label).cast("string").alias("label"))
    counts = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model([], np.zeros((1 << BUCKET_BITS, 0)), np.zeros(0), 1.0, 0.0)
    # A share of each label's rows by hash: no sort and no label's rows in one place.
    share = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, per_label / n))])
    place = F.pmod(F.xxhash64(F.lit(seed), F.coalesce("key", F.lit(""))), F.lit(1_000_003)) / 1_000_003
    chosen = rows.filter(place < share[F.col("label")])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1 << 20):
            got = counted(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *(pa.array([x[i].astype(kind).tobytes() for x in got], pa.binary()) for i, kind in enumerate(KINDS))], ["key", "label", "ids", "counts"])

    drawn = "key string, label string, ids binary, counts binary"
    got = arrow_map(chosen, draw, drawn).collect()
    if not got:  # hashes of a few rows may all miss
        got = arrow_map(rows.limit(per_label), draw, drawn).collect()
    got.sort(key=lambda r: (r.key or "", r.label, r.ids, r.counts))
    # Arrays are views of what came, which is all that the driver holds of the sample.
    return fit([tuple(np.frombuffer(x, kind) for x, kind in zip((r.ids, r.counts), KINDS, strict=True)) for r in got], [r.label for r in got], seed=seed, **kw)


def judge(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(label, calibrated probability, accepted) of each text; of labels that tie, the first by code point."""
    known = np.asarray([t is not None and LETTER.search(t) is not None for t in texts], bool)
    if not model.labels:
        return [UNKNOWN] * len(texts), np.zeros(len(texts)), known
    ids, counts = subwords(texts)
    p = softmax((means(model.scores, ids, counts) + model.bias) / model.temperature)
    best = p.argmax(1)
    score = np.where(known, p[np.arange(len(texts)), best], 0.0)
    share = means(model.seen[:, None], ids, counts)[:, 0] if model.seen is not None else np.ones(len(texts))
    ok = known & (share >= model.strange) & ((score >= model.threshold) | (share >= model.familiar))
    return [model.labels[i] if k else UNKNOWN for i, k in zip(best, known, strict=True)], score, ok


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score, accepted) of every row."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # buckets x labels: fixed size

    def run(batches):
        m = sent.value
        for b in slices(batches, "text", 1 << 18):
            names, score, ok = judge(m, b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(ok)], ["key", "lang_pred", "score", "accepted"])

    return arrow_map(rows, run, f"key {docs.schema[key].dataType.simpleString()}, lang_pred string, score double, accepted boolean").withColumnRenamed("key", key)


def accepted(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of docs whose language is known well enough, as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches):
        m = sent.value
        for b in slices(batches, text, 1 << 18):
            yield b.filter(pa.array(judge(m, b.column(at).to_pylist())[2]))

    return docs.mapInArrow(run, docs.schema)
