"""Periodic run detection: block convolution at dyadic scales.

A run is a stretch of consecutive words with smallest period q, at least max(6, 4 q) words long,
that no neighbouring word extends. At scale L the words are cut into blocks of L. A run whose
period lies between two and four thirds of L holds a whole block and that block's copy a period
on, so the block recurs, without a mismatch, at that distance. All distances of a scale are tested
at once: the sum of squared differences between a block and every place of the window that follows
it is a correlation, taken by an exact number-theoretic transform. It is exact because the sum is
smaller than the product of the primes it is taken by. Zeros are seeds; each is extended word by
word as long as words a distance apart are equal. Scales double, so every period has one.

A word that a stretch holds fewer than four times is in none of its runs, so texts are first cut at
such words; what is left is numbered afresh, which keeps the numbers, and the sums, small.

Each text is worked on by itself, in the task that reads its row: nothing is shuffled. Very long
texts are transformed in slices of a bounded number of cells. Null and empty texts have no words,
no runs, and an empty collapsed text. Repeated rows are answered repeatedly. Extra columns are kept,
except that columns named as the results are replaced. Empty tables give empty results.
"""

import itertools
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from nabd.llm.common import WORD, slices, words

#: A run has at least so many words, and so many times its period.
LEAST, TIMES = 6, 4
#: Primes k * 2^n + 1 below 2^31 with a primitive root of each.
PRIMES = ((2013265921, 31), (1811939329, 13), (469762049, 3))
#: Numbers that one transform holds at a time.
CELLS = 1 << 19
#: Passes that cut texts at words too rare for a run; more would only make stretches shorter still.
CUTS = 4


def _powers(base: int, count: int, p: int) -> np.ndarray:
    """base^0 ... base^(count - 1) modulo p, by doubling."""
    out = np.ones(count, np.uint64)
    have = 1
    while have < count:
        step = np.uint64(pow(base, have, p))
        more = out[: min(have, count - have)] * step % np.uint64(p)
        out[have : have + len(more)] = more
        have += len(more)
    return out


def _forward(a: np.ndarray, p: int, root: int) -> np.ndarray:
    """Transform of the columns; results are in bit-reversed order."""
    size, prime = len(a), np.uint64(p)
    half = size // 2
    while half:
        turn = _powers(pow(root, (p - 1) // (2 * half), p), half, p)[:, None]
        v = a.reshape(size // (2 * half), 2, half, -1)
        out = np.empty_like(v)
        out[:, 0] = (v[:, 0] + v[:, 1]) % prime
        out[:, 1] = (v[:, 0] + (prime - v[:, 1])) % prime * turn % prime
        a, half = out.reshape(size, -1), half // 2
    return a


def _inverse(a: np.ndarray, p: int, root: int) -> np.ndarray:
    """Undo `_forward`: from bit-reversed order back to places."""
    size, prime = len(a), np.uint64(p)
    half = 1
    while half < size:
        turn = _powers(pow(pow(root, -1, p), (p - 1) // (2 * half), p), half, p)[:, None]
        v = a.reshape(size // (2 * half), 2, half, -1)
        turned = v[:, 1] * turn % prime
        out = np.empty_like(v)
        out[:, 0] = (v[:, 0] + turned) % prime
        out[:, 1] = (v[:, 0] + (prime - turned)) % prime
        a, half = out.reshape(size, -1), half * 2
    return a * np.uint64(pow(size, -1, p)) % prime


def mismatch_free(blocks: np.ndarray, windows: np.ndarray, shifts: int) -> np.ndarray:
    """[shift, column]: does the column's block equal its window from `shift` on?

    Sums of squared differences are taken modulo as many primes as make their product larger.
    """
    size, width = len(blocks), len(windows)
    largest = int(max(blocks.max(), windows.max()))
    bound, product = size * largest * largest, 1
    zero = np.ones((shifts, blocks.shape[1]), bool)
    for p, root in PRIMES:
        prime = np.uint64(p)
        turned = np.zeros_like(windows)
        b, v = blocks % prime, windows % prime
        turned[0] = b[0]
        turned[width - size + 1 :] = b[:0:-1]
        both = _forward(turned, p, root) * _forward(v, p, root) % prime
        cross = _inverse(both, p, root)[:shifts]
        own = (b * b % prime).sum(0) % prime
        summed = np.zeros((shifts + size, blocks.shape[1]), np.uint64)
        np.cumsum((v * v % prime)[: shifts + size - 1], axis=0, out=summed[1:])
        squares = (summed[size:] - summed[:shifts]) % prime
        zero &= (own + squares + np.uint64(2) * (prime - cross)) % prime == 0
        product *= p
        if product > bound:
            return zero
    raise ValueError(f"a text is too long for sums below {product}")


def scale_of(size: int) -> tuple[int, int]:
    """The smallest and largest period whose runs hold a block of `size` and its copy."""
    return -(-(2 * size - 1) // 3), (4 * size - 2) // 3


def _stretches(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, starts, ends): stretches that a run may lie in, their words numbered from 1."""
    for _ in range(CUTS):
        inside = ids >= 0
        edge = np.diff(np.concatenate(([0], inside.astype(np.int8), [0])))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        owner = np.repeat(np.arange(len(starts)), ends - starts)
        words_of = owner * (int(ids.max(initial=0)) + 1) + ids[inside]
        kinds, which, counts = np.unique(words_of, return_inverse=True, return_counts=True)
        rare = (counts[which] < TIMES) | ((ends - starts)[owner] < LEAST)
        if not rare.any():
            break
        ids = ids.copy()
        ids[np.flatnonzero(inside)[rare]] = -1
    inside = ids >= 0
    edge = np.diff(np.concatenate(([0], inside.astype(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    owner = np.repeat(np.arange(len(starts)), ends - starts)
    words_of = owner * (int(ids.max(initial=0)) + 1) + ids[inside]
    kinds, which = np.unique(words_of, return_inverse=True)
    first = np.searchsorted(kinds, np.arange(len(starts)) * (int(ids.max(initial=0)) + 1))
    values = np.zeros(len(ids), np.uint64)
    values[inside] = which - first[owner] + 1
    return values, starts, ends


def _seeds(values, starts, ends, size):
    """Yield (place, distance, stretch end and start) of blocks of `size` that recur at this scale."""
    low, high = scale_of(size)
    use = ends - starts >= max(LEAST, TIMES * low)
    starts, ends = starts[use], ends[use]
    if not len(starts):
        return
    count = (ends - starts - low) // size
    at = np.repeat(starts, count)
    at = at + size * (np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count))
    limit, least = np.repeat(ends, count), np.repeat(starts, count)
    width, shifts = 2 * size, high - low + 1
    rows = max(1, CELLS // width)
    for k in range(0, len(at), rows):
        a, e = at[k : k + rows], limit[k : k + rows]
        blocks = values[a + np.arange(size)[:, None]]
        place = a + low + np.arange(width)[:, None]
        stranger = values.max() + np.uint64(1)  # equal to no word: what follows the stretch
        windows = np.where(place < e, values[np.minimum(place, len(values) - 1)], stranger)
        shift, column = np.nonzero(mismatch_free(blocks, windows, shifts))
        yield a[column], shift + low, least[k : k + rows][column], e[column]


def _equal(values: np.ndarray, here: int, there: int, most: int, step: int) -> int:
    """For how many places, at most `most`, words from `here` and `there` on in a direction are equal."""
    done, look = 0, 32
    while done < most:
        n = min(look, most - done)
        a, b = here + step * done, there + step * done
        if step > 0:
            same = values[a : a + n] == values[b : b + n]
        else:
            same = values[a - n + 1 : a + 1][::-1] == values[b - n + 1 : b + 1][::-1]
        if not same.all():
            return done + int(np.argmin(same))
        done, look = done + n, look * 2
    return done


def find_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run in a row of word numbers; -1 equals nothing."""
    values, starts, ends = _stretches(ids)
    found: dict[tuple[int, int], int] = {}
    # For each place the period and end of a run that holds it: inside it, multiples say nothing new.
    period_at = np.zeros(len(ids), np.int64)
    end_at = np.zeros(len(ids), np.int64)
    longest = int((ends - starts).max(initial=0))
    size = 2
    while max(LEAST, TIMES * scale_of(size)[0]) <= longest:
        parts = list(_seeds(values, starts, ends, size))
        at, far, low, high = (np.concatenate(c) for c in zip(*parts, strict=True))
        period = np.maximum(period_at[at], 1)
        known = (period_at[at] > 0) & (far % period == 0) & (at + size + far <= end_at[at])
        at, far, low, high = at[~known], far[~known], low[~known], high[~known]
        order = np.lexsort((at, far))
        at, far, low, high = at[order], far[order], low[order], high[order]
        chained = (far[1:] == far[:-1]) & (at[1:] - at[:-1] == size)  # one stretch holds both blocks
        heads = np.flatnonzero(np.concatenate(([True], ~chained))) if len(at) else []
        last = (0, 0)
        for i in heads:
            a, q = int(at[i]), int(far[i])
            if last[0] == q and a < last[1]:
                continue
            end = a + size
            end += _equal(values, end, end + q, int(high[i]) - end - q, 1)
            start = a - _equal(values, a - 1, a - 1 + q, a - int(low[i]), -1)
            last = (q, end)
            length = end + q - start
            if length >= max(LEAST, TIMES * q) and (start, length) not in found:
                found[start, length] = q  # periods come in ascending order, so this is the smallest
                period_at[start : start + length] = q
                end_at[start : start + length] = start + length
        size *= 2
    return sorted((start, length, q) for (start, length), q in found.items())


def runs_of_texts(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of several texts, each a list of words, found together."""
    numbers: defaultdict = defaultdict(itertools.count().__next__)
    lengths = [len(t) for t in texts]
    ids = np.full(sum(lengths) + len(texts), -1, np.int64)  # a gap after each text
    edges = np.cumsum([0, *(n + 1 for n in lengths)])
    for text, n, start in zip(texts, lengths, edges, strict=False):
        ids[start : start + n] = np.fromiter((numbers[w] for w in text), np.int64, n)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, length, period in find_runs(ids):
        k = int(np.searchsorted(edges, start, "right")) - 1
        out[k].append((start - int(edges[k]), length, period))
    return out


def collapse(text: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words but for those that some run holds after its first period, joined by one space."""
    kept, at = [], 0
    dropped = sorted((start + period, start + length) for start, length, period in runs)
    for low, high in dropped:
        kept += text[at:low]
        at = max(at, high)
    return b" ".join(kept + text[at:])


def with_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with `n_words`, `runs` (start, length, period; by start, then period) and
    `collapsed`, the text with only the first period of each run left of it."""
    names = ("n_words", "runs", "collapsed")
    kept = docs.drop(*[c for c in docs.columns if c.lower() in names])
    added = "n_words long, runs array<struct<start:long, length:long, period:long>>, collapsed string"
    schema = StructType(kept.schema.fields + StructType.fromDDL(added).fields)
    run = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))

    def batches(rows):
        for batch in slices(rows):
            texts = [(t or b"").split() for t in batch.column(text).cast(pa.binary()).to_pylist()]
            runs = runs_of_texts(texts)
            short = [collapse(t, r).decode() for t, r in zip(texts, runs, strict=True)]
            cells = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in own] for own in runs]
            columns = [
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array(cells, run),
                pa.array(short, pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], schema.names)

    return kept.mapInArrow(batches, schema)


def looped(docs: DataFrame) -> DataFrame:
    """(doc_id, text): a tenth of the texts, drawn by their doc_id's CRC, repeat a part to their end.

    Rows without a doc_id have no CRC and keep their text.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    parts, g = words(F.col("text")), F.floor(h / 10)
    n = F.size(parts)
    start = F.pmod(g, n).cast("int")
    period = (F.floor((n - start) / (3 + F.pmod(g, F.lit(8)))) + 1).cast("int")
    part = F.slice(parts, start + 1, period)  # shorter than a period only where the text ends
    whole = F.flatten(F.array_repeat(part, F.ceil((n - start) / period).cast("int")))
    repeated = F.array_join(F.slice(F.concat(F.slice(parts, F.lit(1), start), whole), 1, n), " ")
    changed = (F.pmod(h, F.lit(10)) == 0) & F.col("text").rlike(WORD)
    return docs.select(
        "doc_id", F.when(changed, repeated).otherwise(F.col("text")).alias("text")
    )


def digest(docs: DataFrame) -> DataFrame:
    """Counts, the run of greatest length over period, and digests of runs and collapsed text."""
    found = with_runs(looped(docs.select("doc_id", "text")))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))

    def better(best: Column, r: Column) -> Column:
        # Exact: length / period is compared by cross products; ties keep the earlier run.
        more = best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
        return F.when(more, r).otherwise(best)

    kind = "struct<start:bigint,length:bigint,period:bigint>"
    best = F.aggregate("runs", F.lit(None).cast(kind), better)
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )
