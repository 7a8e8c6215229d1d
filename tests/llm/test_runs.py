"""Periodic runs against a scan of every period."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from nabd.llm import runs


def scan(words):
    """Runs found period by period, word by word."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            length = i + q - start
            if length >= max(6, 4 * q):
                found.setdefault((start, length), q)
            i += 1
    return sorted((s, n, q) for (s, n), q in found.items())


def looped_by_hand(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is None or not n or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def some_text(rng, letters="abcdefgh"):
    words = []
    for _ in range(rng.randint(0, 6)):
        part = [rng.choice(letters) for _ in range(rng.randint(1, 9))]
        words += (part * rng.randint(1, 9))[: rng.randint(1, 80)]
        words += [rng.choice(letters) for _ in range(rng.randint(0, 6))]
    return words


@pytest.mark.parametrize("letters", ["ab", "abcdefgh", "abcdefghijklmnopqrstuvwxyz"])
def test_runs_are_those_of_a_scan(letters):
    rng = random.Random(letters)
    for _ in range(80):
        texts = [[w.encode() for w in some_text(rng, letters)] for _ in range(rng.randint(1, 6))]
        assert runs.runs_of_texts(texts) == [scan(t) for t in texts]


def test_long_texts_and_many_slices(monkeypatch):
    rng = random.Random(2)
    part = [b"%d" % rng.randrange(10**6) for _ in range(700)]
    fibonacci, longer = [b"a"], [b"a", b"b"]
    while len(longer) < 3000:
        fibonacci, longer = longer, longer + fibonacci
    texts = [(part * 5)[:3300], longer, [b"a"] * 2999, [b"a"] * 9 + [b"b"] + [b"a"] * 9]
    want = [scan(t) for t in texts]
    assert want[0] == [(0, 3300, 700)] and want[2] == [(0, 2999, 1)]
    assert runs.runs_of_texts(texts) == want
    monkeypatch.setattr(runs, "CELLS", 64)
    assert runs.runs_of_texts(texts[2:]) == want[2:]


def test_transform_is_exact_beyond_one_prime():
    rng = np.random.default_rng(1)
    # Differences whose squares add up to a multiple of the first prime must not pass for equal.
    p = runs.PRIMES[0][0]
    a = next(x for x in range(1, math.isqrt(p)) if math.isqrt(p - x * x) ** 2 == p - x * x)
    b = math.isqrt(p - a * a)
    blocks = np.array([[1], [1]], np.uint64)
    windows = np.array([[1 + a], [1 + b], [1], [1]], np.uint64)
    assert runs.mismatch_free(blocks, windows, 3)[:, 0].tolist() == [False, False, True]
    values = rng.integers(1, 1 << 30, (64, 3), dtype=np.uint64)
    got = runs.mismatch_free(values[:16], values, 40)
    assert got[0].all() and not got[1:].any()


ROWS = "doc_id long, text string, runs int, N_WORDS string, collapsed date, start string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    out = [(i, " ".join(some_text(rng))) for i in range(120)]
    out += [(200, None), (201, ""), (202, " \t\n"), (203, "x " * 20000), (None, "a b " * 9), (205, "é é " * 8)]
    out += [out[3], out[3], (3, "a a a a a a"), (26, "w")]
    return out


def test_digest(spark, rows):
    docs = spark.createDataFrame([(i, t, 1, "x", None, "y") for i, t in rows], ROWS)
    want = []
    for doc_id, text in rows:
        words = looped_by_hand(doc_id, text)
        found = scan(words)
        lost = {i for s, n, q in found for i in range(s + q, s + n)}
        best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        kept = b" ".join(w for i, w in enumerate(words) if i not in lost)
        milli = 1000 * best[1] // best[2] if found else None
        digests = hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()
        want.append((doc_id, len(found), *best, milli, *digests, len(words)))
    got = runs.digest(docs).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 5
    assert runs.digest(docs.limit(0)).count() == 0


def test_with_runs_keeps_other_columns(spark, rows):
    docs = spark.createDataFrame([(i, t, 1, "x", None, "y") for i, t in rows], ROWS)
    out = runs.with_runs(docs)
    assert out.columns == ["doc_id", "text", "start", "n_words", "runs", "collapsed"]
    row = out.filter("doc_id = 203").first()
    assert row["collapsed"] == "x" and row["start"] == "y" and row["n_words"] == 20000
    assert [tuple(r) for r in row["runs"]] == [(0, 20000, 1)]
    assert out.filter(F.size("runs") == 0).filter("doc_id between 200 and 202").count() == 3
    other = docs.select(F.col("text").alias("body"))
    assert runs.with_runs(other, "body").filter("body is null").first()["collapsed"] == ""
