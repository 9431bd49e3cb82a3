"""Removal of repeated word passages by suffix automata of reference shards.

Two uses. remove_known() takes a reference of bounded size: its shards' automata are broadcast and
documents are streamed past them; maximal spans that match at least `least` words of the reference go.
remove_repeated() has the corpus itself as reference, which has no bound: there, each shard's
automaton is built by the task that streams the shard's passages, as sending every automaton to
every document would take time with the square of the corpus (see repeats for how passages find
their shard). Passages come in document order; one that has a window not seen before is added to
the automaton, and a window goes if its words also start earlier. A passage shared by too many documents for one
automaton meets several, each of which hands on what it hasn't seen before.

Words are whatever [^\\x20\\x09-\\x0D]+ matches, unchanged. Cases: a null or empty text has no words;
texts shorter than a window lose nothing; rows that share a key are documents of their own, in the
order of the table, so a repeated row loses what the row before it has; a null key comes last; an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideway.llm.common import arrow_map, slices, texts
from strideway.llm.repeats import Units, between, covered, found_batch, numbered, ranges_of, remaining, removed, repeated, runs_of, word_edges

#: Words of a reference shard, and the largest reference that is broadcast.
SHARD_WORDS, MOST_WORDS = 100_000, 5_000_000
#: Words of a shard of the corpus as its own reference.
MOST = 1 << 17


class Automaton:
    """Suffix automaton of several word sequences. A state stands for the word strings that end at the same places; `first` is the smallest such place.

    Most states have one transition, which stands in two arrays (word, to); further ones are in `more`."""

    def __init__(self):
        self.ids: dict[bytes, int] = {}
        self.word, self.to = array("i", [-1]), array("i", [0])
        self.more: dict[int, dict[int, int]] = {}
        self.link, self.length, self.first = array("i", [-1]), array("i", [0]), array("i", [-1])
        self.words = 0

    def _next(self, state: int, w: int) -> int:
        """The state after w, or -1."""
        if self.word[state] == w:
            return self.to[state]
        more = self.more.get(state)
        return more.get(w, -1) if more else -1

    def _lead(self, state: int, w: int, to: int) -> None:
        if self.word[state] in (-1, w):
            self.word[state], self.to[state] = w, to
        else:
            self.more.setdefault(state, {})[w] = to

    def _state(self, length: int, first: int, link: int, word: int = -1, to: int = 0) -> int:
        for x, v in ((self.length, length), (self.first, first), (self.link, link), (self.word, word), (self.to, to)):
            x.append(v)
        return len(self.link) - 1

    def add(self, words: list[bytes]) -> int:
        """Add a sequence; returns the place of its first word. Places go on from one sequence to the next."""
        link, length, ids = self.link, self.length, self.ids
        base, last = self.words, 0
        for at, word in enumerate(words, base):
            w = ids.setdefault(word, len(ids))
            q = self._next(last, w)
            if q >= 0:
                last = q if length[q] == length[last] + 1 else self._clone(last, w, q)
                continue
            cur = self._state(length[last] + 1, at, 0)
            p = last
            while p >= 0 and (q := self._next(p, w)) < 0:
                self._lead(p, w, cur)
                p = link[p]
            if p >= 0:
                link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
            last = cur
        self.words = base + len(words)
        return base

    def _clone(self, p: int, w: int, q: int) -> int:
        c = self._state(self.length[p] + 1, self.first[q], self.link[q], self.word[q], self.to[q])
        if q in self.more:
            self.more[c] = dict(self.more[q])
        self.link[q] = c
        while p >= 0 and self._next(p, w) == q:
            self._lead(p, w, c)
            p = self.link[p]
        return c

    def matches(self, words: list[bytes], window: int, before: int | None = None) -> np.ndarray:
        """For each word, whether the window that ends with it is in the automaton; with `before`, whether it ends there at an earlier place than before + the word's index."""
        word, to, more, link, length, first = self.word, self.to, self.more, self.link, self.length, self.first
        state = size = 0
        out = bytearray(len(words))
        for i, w in enumerate(map(self.ids.get, words)):
            if w is None:
                state = size = 0
                continue
            while True:
                if word[state] == w:
                    step = to[state]
                    break
                step = more[state].get(w, -1) if state in more else -1
                if step >= 0 or not state:
                    break
                state = link[state]
                size = length[state]
            if step < 0:
                size = 0
                continue
            state, size = step, size + 1
            if size >= window:
                while length[link[state]] >= window:
                    state = link[state]
                size = min(size, length[state])
                out[i] = before is None or first[state] < before + i
        return np.frombuffer(out, np.uint8).astype(bool)


def _compare(window: int):
    """Passages of a shard in document order -> which of their windows were there before; of a part of a shard also the others, to be handed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, auto = None, Automaton()
        for b in slices(batches, "body", 1 << 20):
            gone, on = [], []
            for s, part, doc, tag, start, whole, body in zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 3, 4, 7, 8)), strict=True):
                if (s, part) != shard:
                    shard, auto = (s, part), Automaton()
                words = body.split()
                ends = auto.matches(words, window) if auto.words else np.zeros(len(words), bool)
                if not ends[window - 1 :].all():
                    ends = auto.matches(words, window, auto.add(words))
                again = ends[window - 1 :]
                if again.any():
                    gone.append((doc, tag, ranges_of(again, start)))
                if not whole and not again.all():
                    edges = word_edges(np.frombuffer(body, np.uint8))
                    on += [(doc, tag, s, start + a, z - a, between(body, edges, a, z + window - 1)) for a, z in runs_of(~again).tolist()]
            if gone or on:
                yield found_batch(gone, on)

    return run


def remove_repeated(docs: DataFrame, least: int = 20, key: str = "doc_id", text: str = "text", most: int = MOST) -> DataFrame:
    """(doc, n_units, n_removed, n_spans, kept): documents without the words covered by a window of `least` words that also starts earlier; kept words are joined by a blank. Windows are judged on the whole input. most: words of an automaton."""
    u = Units(window=least, gram=8 if least >= 16 else 1, block=512, words=True, most=most)
    rows = numbered(docs, key, text)
    return removed(rows, repeated(rows, u, _compare(least)), u)


def remove_known(docs: DataFrame, reference: DataFrame, least: int = 20, key: str = "doc_id", text: str = "text", most_words: int = MOST_WORDS) -> DataFrame:
    """(doc, n_units, n_removed, n_spans, kept): documents without what matches `least` words or more of a reference, which may hold most_words words at most (else ValueError: use remove_repeated on the union).

    Every row is judged alone, so repeated rows and keys each give a row; a null key stays null; an empty reference removes nothing, empty docs give no rows."""
    spark = docs.sparkSession
    size = reference.agg(F.sum(F.size(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+")))).first()[0] or 0
    if size > most_words:
        raise ValueError(f"the reference has {size} words; {most_words} may be broadcast")
    shards: list[list[list[bytes]]] = [[]]
    count = 0
    for r in reference.select(F.coalesce(F.col(text), F.lit("")).alias("t")).toLocalIterator():
        words = r.t.encode().split()
        if count + len(words) > SHARD_WORDS and shards[-1]:
            shards.append([])
            count = 0
        shards[-1].append(words)
        count += len(words)
    sent = [spark.sparkContext.broadcast(_built(s)) for s in shards]
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(2**63 - 1)).alias("doc"), F.col(text).alias("text"))

    def run(batches):
        autos = [s.value for s in sent]
        for b in slices(batches, "text", 2 << 20):
            out = []
            for t in texts(b.column(1)):
                words = t.split()
                ends = np.zeros(len(words), bool)
                for a in autos:
                    ends |= a.matches(words, least)
                gone = covered([ranges_of(ends[least - 1 :])], len(words), least)
                out.append((len(words), int(gone.sum()), len(runs_of(gone)), remaining(t, word_edges(np.frombuffer(t, np.uint8)), gone)))
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary())], ["doc", "n_units", "n_removed", "n_spans", "kept"])

    return arrow_map(rows, run, "doc long, n_units long, n_removed long, n_spans long, kept binary").withColumn("doc", F.nullif("doc", F.lit(2**63 - 1)))


def _built(sequences: list[list[bytes]]) -> Automaton:
    a = Automaton()
    for s in sequences:
        a.add(s)
    return a
