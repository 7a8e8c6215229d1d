"""Toxicity by a weighted finite-state pattern grammar over clauses.

Small transducers each read the token classes of a clause: negation (the words after "not" count
less), reported speech (after "said" or inside quotes), target (an address makes an insult count
more) and threat (a threat verb before a target). They are composed into one machine whose state
is the tuple of their states; its output is the weight of the clause. A lexical transducer maps a
word to its class by whole word or by stem, with any ending.

Insult arcs are learned from labelled rows: grams (words and stems) that mark toxic documents,
chosen greedily until every toxic document is explained several times, so words that merely
accompany one copied document do not enter. A logistic curve over the clause weights of a document
turns them into a score. Both are fitted on `max_training_rows` labelled rows at most, chosen by a
seeded hash; the machine itself reads every clause of every document.

Null and empty texts have no clauses and get the score of a document without findings. Repeated
rows are scored alike; a document labelled twice counts as toxic if any label says so, and null
labels are left out. Without labels of both kinds the built-in words and a fixed curve are used.
Extra columns are kept; columns named `score` or `predicted` are replaced.
"""

import heapq
import itertools
import math
import re
import sys
import unicodedata
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nabd.llm.common import slices, with_columns
from nabd.plans.staging import stage

MAX_TRAINING_ROWS = 20_000
STEM_LENGTHS = (4, 5, 6)
COVER = 5

WORDS = {
    "insult": "idiot idiots moron morons stupid pathetic worthless disgusting scum loser losers trash",
    "threat": "kill hurt destroy beat stab shoot burn crush attack murder",
    "target": "you your yours youre he him she her they them their this these u",
    "negation": "not no never neither nor isnt arent wasnt dont doesnt didnt cannot without nicht nie pas jamais",
    "report": "said says wrote writes called calls quoted claimed claims according sagte schrieb dijo dit",
}
BUILT_IN_WEIGHT = 2.0
NEGATED, REPORTED, TARGETED, THREAT_WEIGHT = 0.4, 0.5, 1.25, 1.5
NEGATION_REACH = 3

_MARKS = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c)[0] == "M")
#: A word begins with a letter and goes on over letters and combining marks.
_TOKEN = re.compile(rf"[^\W\d_]+(?:[{_MARKS}]+[^\W\d_]*)*|[.!?;:\n,\"“”«»]")
#: The same for texts without marks, several times as fast.
_PLAIN, _MARK = re.compile(r"[^\W\d_]+|[.!?;:\n,\"“”«»]"), frozenset(_MARKS)
_QUOTES, _ENDS = set('"“”«»'), set(".!?;\n")


def tokens_of(text: str) -> list[str]:
    """Words and clause marks, in order; arcs are learned from and matched on these."""
    text = text.lower()
    plain = text.isascii() or _MARK.isdisjoint(text)
    return (_PLAIN if plain else _TOKEN).findall(text)


@dataclass(frozen=True)
class Machine:
    """A transducer over token classes: moves[state, class] = next state; gain[state] scales."""

    start: int
    moves: dict
    gain: dict = field(default_factory=dict)

    def move(self, state, kind):
        return self.moves.get((state, kind), self.moves.get((state, "*"), state))


NEGATION = Machine(
    0,
    {(s, "negation"): NEGATION_REACH for s in range(NEGATION_REACH + 1)}
    | {(s, "*"): max(0, s - 1) for s in range(NEGATION_REACH + 1)},
    {s: NEGATED for s in range(1, NEGATION_REACH + 1)},
)
REPORTED_SPEECH = Machine(
    0,
    {(0, "report"): 1, (0, "quote"): 2, (1, "quote"): 2, (2, "quote"): 0},
    {1: REPORTED, 2: REPORTED},
)
TARGET = Machine(0, {(0, "target"): 1}, {1: TARGETED})
THREAT = Machine(0, {(0, "threat"): 1, (1, "target"): 2, (2, "*"): 0})
MACHINES = (NEGATION, REPORTED_SPEECH, TARGET, THREAT)
KINDS = ("other", "insult", "threat", "target", "negation", "report", "quote")


def compose(machines: Sequence[Machine] = MACHINES):
    """Product of the machines: (state, kind) -> (next state, insult gain, threat gain)."""
    start = tuple(m.start for m in machines)
    numbers, table, open_states = {start: 0}, {}, [start]
    while open_states:
        state = open_states.pop()
        for kind in KINDS:
            after = tuple(m.move(s, kind) for m, s in zip(machines, state, strict=True))
            if after not in numbers:
                numbers[after] = len(numbers)
                open_states.append(after)
            gains = (m.gain.get(s, 1.0) for m, s in zip(machines, state, strict=True))
            gain = math.prod(gains)
            threat = gain if after[-1] == 2 else 0.0
            table[numbers[state], kind] = (numbers[after], gain if kind == "insult" else 0.0, threat)
    return table


class Grammar:
    """The composed machine with its lexical transducer."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.table = compose()
        self.kinds = {w: (k, BUILT_IN_WEIGHT) for k, ws in WORDS.items() for w in ws.split()}
        self.kinds |= dict.fromkeys(_QUOTES, ("quote", 0.0))
        self.kinds |= {w: ("insult", weight) for w, weight in words.items()}
        self.stems = stems
        self.known: dict[str, tuple | None] = {}

    def kind(self, token: str):
        """Class and weight, or None for a token that no transducer reads."""
        if token not in self.known:
            if len(self.known) > 1_000_000:
                self.known.clear()
            found = self.kinds.get(token)
            for n in sorted(STEM_LENGTHS, reverse=True):
                found = found or (("insult", self.stems[token[:n]]) if token[:n] in self.stems else None)
            self.known[token] = found
        return self.known[token]

    def clause_weights(self, text: str) -> list[float]:
        """Weight of each clause that has any."""
        tokens = tokens_of(text)
        kind = self.kind
        if not any((k := kind(t)) and k[0] in ("insult", "threat") for t in set(tokens)):
            return []
        found, state, weight = [], 0, 0.0
        for token in itertools.chain(tokens, "."):
            if token in _ENDS:
                if weight:
                    found.append(weight)
                state, weight = 0, 0.0
                continue
            name, own = kind(token) or ("other", 0.0)
            state, insult, threat = self.table[state, name]
            weight += insult * own + threat * THREAT_WEIGHT
        return found

    def features(self, text: str | None) -> tuple[float, float, float]:
        """What the curve reads: bounded strongest clause, sum over clauses, and any at all."""
        weights = self.clause_weights(text or "")
        if not weights:
            return 0.0, 0.0, 0.0
        return min(max(weights), 20.0) / 4, math.log1p(sum(weights)), 1.0


@dataclass(frozen=True)
class Model:
    words: dict[str, float]
    stems: dict[str, float]
    curve: tuple[float, ...] = (-3.0, 1.0, 0.5, 2.5)

    def score(self, grammar: Grammar, text: str | None) -> float:
        z = self.curve[0] + sum(c * x for c, x in zip(self.curve[1:], grammar.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(id, toxic, text) of at most `max_rows` labelled, not held-out documents."""
    chosen = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    texts = docs.filter("text is not null").select("doc_id", "text")
    # At most max_rows pairs of numbers: a broadcast of proven size.
    return texts.join(F.broadcast(chosen), "doc_id").select(F.col("doc_id").alias("id"), "toxic", "text")


def _grams(rows: DataFrame) -> DataFrame:
    """(id, toxic, gram): distinct words, and stems marked by a final '*', of each row."""

    def cut(batches):
        for batch in slices(batches):
            words = [[w for w in set(tokens_of(t.as_py())) if w[0].isalpha()] for t in batch.column("text")]
            arrays = [batch.column("id"), batch.column("toxic"), pa.array(words, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "toxic", "token"])

    def stems_of(n: int) -> Column:
        long_enough = F.filter("token", lambda w: F.length(w) >= n)
        return F.transform(long_enough, lambda w: F.concat(F.substring(w, 1, n), F.lit("*")))

    stems = [stems_of(n) for n in STEM_LENGTHS]
    every = F.array_distinct(F.concat("token", *stems))
    id_type = dict(rows.dtypes)["id"]
    cut_rows = rows.select("id", "toxic", "text").mapInArrow(cut, f"id {id_type}, toxic int, token array<string>")
    return cut_rows.select("id", "toxic", F.explode(every).alias("gram"))


def fit(docs: DataFrame, labels: DataFrame, max_training_rows: int = MAX_TRAINING_ROWS) -> Model:
    """Learn insult arcs and the curve from labelled rows outside the held-out fold."""
    rows = stage(training_rows(docs, labels, max_training_rows), "toxic-rows")
    counts = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    toxic, clean = counts.get(1, 0), counts.get(0, 0)
    if not toxic or not clean:
        return Model({}, {})
    grams = _grams(rows)
    bad, good = F.sum("toxic"), F.sum(1 - F.col("toxic"))
    support = max(3, math.ceil(0.01 * toxic))
    marks = (
        grams.groupBy("gram").agg(bad.alias("bad"), good.alias("good"))
        .filter((F.col("bad") >= support) & (F.col("good") * 19 <= F.col("bad")))
    )
    # A gram marks a hundredth of the toxic rows, so there are at most 100 times as many as an
    # average one of them has; with the bound on rows, that is what the driver and a broadcast hold.
    marks = stage(marks, "toxic-grams")
    found = {r["gram"]: (r["bad"], r["good"]) for r in marks.collect()}
    pairs = grams.filter("toxic = 1").join(F.broadcast(marks.select("gram")), "gram")
    places: dict[str, set[int]] = {}
    for r in pairs.select("gram", "id").distinct().toLocalIterator():
        places.setdefault(r["gram"], set()).add(r["id"])
    words, stems = {}, {}
    for gram in _cover(places, support):
        b, g = found[gram]
        weight = math.log((b + 0.5) / (toxic + 1)) - math.log((g + 0.5) / (clean + 1))
        (stems if gram.endswith("*") else words)[gram.rstrip("*")] = min(weight, 6.0)
    draft = Model(words, stems)

    def features(batches):
        grammar = Grammar(words, stems)
        for batch in slices(batches):
            values = [grammar.features(t.as_py()) for t in batch.column("text")]
            columns = [pa.array([v[i] for v in values], pa.float64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *columns], ["y", "a", "b", "c"])

    seen = rows.select("toxic", "text").mapInArrow(features, "y int, a double, b double, c double").toPandas()
    x = np.column_stack([np.ones(len(seen)), seen[["a", "b", "c"]].to_numpy()])
    return Model(draft.words, draft.stems, _logistic(x, seen["y"].to_numpy(float)))


def _cover(places: dict[str, set[int]], support: int) -> list[str]:
    """Grams by the toxic documents they newly explain; each document wants COVER of them."""
    need = dict.fromkeys(set().union(*places.values()) if places else (), COVER)
    chosen: list[str] = []
    # Gains only fall, so a gram whose gain still holds when it comes first is the best of all.
    queue = [(-len(ids), -len(g.rstrip("*")), g) for g, ids in places.items()]
    heapq.heapify(queue)
    while queue:
        before, length, gram = heapq.heappop(queue)
        stem = gram.rstrip("*")
        if any(stem.startswith(kin) or kin.startswith(stem) for kin in (c.rstrip("*") for c in chosen)):
            continue
        gain = sum(need[i] > 0 for i in places[gram])
        if gain < support:
            continue
        if gain < -before:
            heapq.heappush(queue, (-gain, length, gram))
            continue
        chosen.append(gram)
        for i in places[gram]:
            need[i] -= 1
    return chosen


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Ridge logistic regression by Newton steps; the intercept is not shrunk."""
    beta = np.zeros(x.shape[1])
    penalty = ridge * np.diag([1e-3] + [1.0] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (y - p) - penalty @ beta
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, gradient)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


def with_score(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with `score`; only the text is read for it."""
    columns = [c for c in docs.columns if c.lower() != "score"]

    def scored(batches):
        grammar = Grammar(model.words, model.stems)
        for batch in slices(batches):
            scores = [model.score(grammar, t.as_py()) for t in batch.column("text")]
            names = [*batch.schema.names, "score"]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names)

    kept = docs.select(*columns)
    schema = T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType())])
    return kept.mapInArrow(scored, schema)


def with_prediction(docs: DataFrame, model: Model) -> DataFrame:
    return with_columns(with_score(docs, model), {"predicted": (F.col("score") >= 0.5).cast("int")})


def reject_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """`docs` without those predicted toxic, with the columns of `docs`."""
    model = fit(docs, labels, **options)
    row = docs.select("text", F.struct(*docs.columns).alias("_nabd_row"))
    return with_score(row, model).filter("score < 0.5").select("_nabd_row.*")


def digest(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = fit(docs, labels, **options)
    return with_prediction(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted"
    )
