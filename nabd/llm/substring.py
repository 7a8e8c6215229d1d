"""Substring dedup with suffix automata of reference shards.

A window is `span` consecutive words. Words covered by a window that also starts in a document with
a smaller doc_id are removed; windows are judged on the input.

Sending every shard's automaton past every document would be quadratic. So each window is routed
by its smallest hash of `GRAM` words (equal windows have the same one): routes that only one
document has are dropped, and the stretches of text around the others are gathered by route. A
route is a reference shard. Its rows arrive in doc_id order: a document's stretches are streamed
through the suffix automaton of all earlier documents for matching statistics, and enter it
afterwards. Where the match is `span` words or longer its words are covered. Memory holds the
distinct stretches of one route. Exact copies of an earlier text are folded first. A route of more
than `HOT` documents is split into its windows, and each task sends on a stretch it has met before without its words, as repeated.

Null and empty texts have no words; rows without a doc_id are neither earlier nor later and stay as
they are. Rows that repeat a doc_id are one document: they lose nothing to each other. Extra columns
are kept by `dedup`. Empty tables give empty results.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nabd.llm.common import packed, slices, unpacked
from nabd.plans.staging import release, stage

SPAN = 13
GRAM = 4
HOT = 10_000
_KNOWN_WORDS = 500_000
_KNOWN_STRETCHES = 200_000


class Automaton:
    """Suffix automaton of several word sequences, extended one after another."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, words: list) -> None:
        last = 0
        for word in words:
            last = self._extend(last, word)

    def _extend(self, last: int, word) -> int:
        after, link, length = self.next, self.link, self.length
        if word in after[last]:
            old = after[last][word]
            return old if length[old] == length[last] + 1 else self._clone(last, word, old)
        new = len(after)
        after.append({})
        length.append(length[last] + 1)
        link.append(0)
        state = last
        while state >= 0 and word not in after[state]:
            after[state][word] = new
            state = link[state]
        if state >= 0:
            old = after[state][word]
            fits = length[old] == length[state] + 1
            link[new] = old if fits else self._clone(state, word, old)
        return new

    def _clone(self, state: int, word, old: int) -> int:
        after, link, length = self.next, self.link, self.length
        copy = len(after)
        after.append(dict(after[old]))
        length.append(length[state] + 1)
        link.append(link[old])
        link[old] = copy
        while state >= 0 and after[state].get(word) == old:
            after[state][word] = copy
            state = link[state]
        return copy

    def covered(self, words: list, span: int) -> list[tuple[int, int]]:
        """Maximal ranges of `words` covered by matches of at least `span` words."""
        after, link, length = self.next, self.link, self.length
        state = match = 0
        out: list[tuple[int, int]] = []
        for i, word in enumerate(words):
            while state and word not in after[state]:
                state = link[state]
                match = length[state]
            if word in after[state]:
                state = after[state][word]
                match += 1
            if match >= span:
                start = i - span + 1
                if out and out[-1][1] >= start:
                    out[-1] = (out[-1][0], i + 1)
                else:
                    out.append((start, i + 1))
        return out


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def window_routes(words: list[bytes], known: dict, span: int = SPAN) -> np.ndarray:
    """For each window the smallest hash of its GRAM-word grams, as signed longs."""
    n = len(words)
    if n < span:
        return np.empty(0, np.int64)
    if len(known) > _KNOWN_WORDS:
        known.clear()
    h = np.fromiter(map(known.__getitem__, words), np.uint64, n)
    grams = n - GRAM + 1
    g = np.zeros(grams, np.uint64)
    for i in range(GRAM):
        g = g * np.uint64(0x9E3779B97F4A7C15) + h[i : i + grams]
    g ^= g >> np.uint64(29)
    g *= np.uint64(0xBF58476D1CE4E5B9)
    g ^= g >> np.uint64(32)
    wide, reach = span - GRAM + 1, 1
    while reach < wide:  # windows of doubling width, the last step overlapping
        step = min(reach, wide - reach)
        g = np.minimum(g[:-step], g[step:])
        reach += step
    return g.view(np.int64)


def _words(text: bytes | None) -> list[bytes]:
    return (text or b"").split()


def _text_id(text: bytes | None) -> int:
    return xxhash.xxh64_intdigest(text or b"") >> 1


def routes(docs: DataFrame, span: int) -> DataFrame:
    """(route, doc_id): the distinct window routes of each document."""

    def batches(rows: Iterator[pa.RecordBatch]):
        known = _WordHashes()
        for batch in slices(rows):
            ids, found = [], []
            texts = batch.column("text").cast(pa.binary())
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                own = np.unique(window_routes(_words(text.as_py()), known, span))
                found.append(own)
                ids.append(np.full(len(own), doc, np.int64))
            if found:
                columns = [pa.array(np.concatenate(found)), pa.array(np.concatenate(ids))]
                yield pa.RecordBatch.from_arrays(columns, ["route", "doc_id"])

    return docs.mapInArrow(batches, "route long, doc_id long")


def stretches(marked: DataFrame, span: int) -> DataFrame:
    """(route, doc_id, text_id, start, end, words): the text around each shared route.

    `marked` has doc_id, text, the document's shared routes as (route, hot), or null, and whether it is a
    copy of an earlier one, hence repeated as a whole. Windows that follow each other on one route are
    one stretch; windows of a hot route are cut apart and routed by their words. A stretch that this task has met in a smaller doc_id is known to be repeated: its
    words are left out, so a common passage leaves a task about once.
    """
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    names = ["route", "doc_id", "text_id", "start", "end", "words"]

    def batches(rows: Iterator[pa.RecordBatch]):
        known, met = _WordHashes(), {}
        for batch in slices(rows, 64):
            out: list[tuple] = []
            texts = batch.column("text").cast(pa.binary())
            names_of = ("doc_id", "shared", "copy")
            docs, marks_of, copies = (batch.column(c).to_pylist() for c in names_of)
            for doc, text, shared, copy in zip(docs, texts, marks_of, copies, strict=True):
                if shared is None and not copy:
                    continue
                text = text.as_py()
                words = _words(text)
                if copy:
                    if len(words) >= span:
                        out.append((doc, doc, _text_id(text), 0, len(words), None))
                    continue
                own = window_routes(words, known, span)
                marks = {s["route"]: s["hot"] for s in shared}
                starts = np.flatnonzero(np.isin(own, np.fromiter(marks, np.int64, len(marks))))
                if not len(starts):
                    continue
                name = _text_id(text)
                cut = np.flatnonzero((np.diff(starts) > 1) | (np.diff(own[starts]) != 0)) + 1
                pieces = []
                for part in np.split(starts, cut):
                    first, last, route = int(part[0]), int(part[-1]), int(own[part[0]])
                    if marks[route]:
                        pieces += [(None, s, s + span) for s in range(first, last + 1)]
                    else:
                        pieces.append((route, first, last + span))
                for route, a, b in pieces:
                    piece = b" ".join(words[a:b])
                    if route is None:
                        route = xxhash.xxh64_intdigest(piece) >> 1
                    if met.get(piece, doc) < doc:
                        out.append((route, doc, name, a, b, None))
                    else:
                        met[piece] = doc
                        out.append((route, doc, name, a, b, piece))
            if len(met) > _KNOWN_STRETCHES:
                met.clear()
            columns = zip(*out, strict=True) if out else [[] for _ in names]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names
            )

    return marked.mapInArrow(
        batches, "route long, doc_id long, text_id long, start int, end int, words binary"
    )


def _match(span: int):
    """Stream the rows of each route, in doc_id order, through its growing automaton."""

    def batches(rows: Iterator[pa.RecordBatch]):
        key = doc = automaton = None
        inside, waiting = set(), []
        names = ("route", "doc_id", "text_id", "start", "end", "words")
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        for batch in rows:
            out: list[tuple[int, int, int, int]] = []
            columns = (batch.column(c).to_pylist() for c in names)
            for route, this, name, start, end, text in zip(*columns, strict=True):
                if route != key:
                    key, doc, automaton = route, this, None
                    inside, waiting = set(), []
                elif this != doc:  # what the last document brought is earlier from here on
                    doc = this
                    for earlier in waiting:
                        if earlier not in inside:
                            inside.add(earlier)
                            automaton = automaton or Automaton()
                            automaton.add(earlier.split())
                    waiting = []
                if text is None or text in inside:
                    out.append((this, name, start, end))
                    continue
                if automaton:
                    found = automaton.covered(text.split(), span)
                    out += [(this, name, start + a, start + b) for a, b in found]
                waiting.append(text)
            columns = zip(*out, strict=True) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["doc_id", "text_id", "start", "end"],
            )

    return batches


def _copies(docs: DataFrame) -> DataFrame:
    """doc_ids all of whose texts are those of documents with smaller ids (by a 128-bit hash)."""
    texts = docs.select("doc_id", F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"))
    first = texts.groupBy("a", "b").agg(F.min("doc_id").alias("first"))
    return (
        texts.join(first, ["a", "b"])
        .groupBy("doc_id")
        .agg(F.max("first").alias("last"))
        .filter("last < doc_id")
        .select("doc_id")
    )


def repeated_spans(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """(doc_id, text_id, start, end): word ranges that also occur in an earlier document.

    `docs` has doc_id and text alone. Its join by doc_id is the one that `_kept` does, so that one
    shuffle of the texts serves both.
    """
    named = docs.filter("doc_id is not null")
    every = stage(routes(named, span), "routes")
    # A document has a route once, so a count of one is a route that nobody shares.
    shared = every.groupBy("route").agg(F.count("*").alias("n")).filter("n > 1")
    # Staged without the routes that nobody shares; the whole table can then go before texts are moved.
    marks = stage(every.join(shared.select("route", (F.col("n") > HOT).alias("hot")), "route"), "marks")
    release(every)
    marks = marks.groupBy(F.col("doc_id").alias("_id")).agg(
        F.collect_set(F.struct("route", "hot")).alias("shared")  # no more than the document has windows
    )
    copies = _copies(named).select(F.col("doc_id").alias("_id"), F.lit(True).alias("copy"))
    marks = marks.join(copies, "_id", "full").withColumn("shared", F.when(F.col("copy").isNull(), F.col("shared")))
    marked = docs.join(marks, F.col("doc_id") == F.col("_id"), "left").drop("_id")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stretches(marked, span).repartition(parts, "route").sortWithinPartitions("route", "doc_id")
    return dealt.mapInArrow(_match(span), "doc_id long, text_id long, start int, end int")


def _kept(docs: DataFrame, span: int) -> DataFrame:
    """`docs` with `_spans`, the removed ranges of its doc_id."""
    spans = repeated_spans(docs.select("doc_id", "text"), span)
    spans = spans.groupBy(F.col("doc_id").alias("_id")).agg(
        F.collect_list(F.struct("text_id", "start", "end")).alias("_spans")
    )
    return docs.join(spans, F.col("doc_id") == F.col("_id"), "left").drop("_id")


def _removed(text: bytes | None, spans: list | None) -> tuple[list[bytes], np.ndarray]:
    words = _words(text)
    gone = np.zeros(len(words), bool)
    if spans:
        name = _text_id(text)
        for s in spans:
            if s["text_id"] == name:
                gone[s["start"] : s["end"]] = True
    return words, gone


def dedup(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """`docs` with repeated spans removed; a text that loses words keeps the rest joined by spaces."""
    rows_of = packed(docs, "doc_id", "text")
    columns = rows_of.columns

    def batches(rows: Iterator[pa.RecordBatch]):
        for batch in slices(rows):
            out = []
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for text, spans in zip(texts, batch.column("_spans").to_pylist(), strict=True):
                words, gone = _removed(text, spans)
                if gone.any():
                    text = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
                out.append(text)
            new = pa.array(out, pa.binary()).cast(pa.string())
            arrays = [new if c == "text" else batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays(arrays, columns)

    kept = _kept(rows_of, span).mapInArrow(batches, rows_of.schema)
    return kept.select(*unpacked(docs.columns, "doc_id", "text"))


def digest(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document."""

    def batches(rows: Iterator[pa.RecordBatch]):
        for batch in slices(rows):
            counts, lost, digests = [], [], []
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for text, spans in zip(texts, batch.column("_spans").to_pylist(), strict=True):
                words, gone = _removed(text, spans)
                kept = [w for w, g in zip(words, gone, strict=True) if not g] if gone.any() else words
                counts.append(len(words))
                lost.append(len(words) - len(kept))
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            arrays = [pa.array(counts, pa.int64()), pa.array(lost, pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *arrays], ["doc_id", "n_words", "n_removed", "kept_sha256"]
            )

    texts = docs.select("doc_id", "text")
    return _kept(texts, span).mapInArrow(
        batches, "doc_id long, n_words long, n_removed long, kept_sha256 string"
    )
