"""Each training-data operator against brute force, a round trip, recall or held-out accuracy."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from nabd.llm import (
    ann,
    chat,
    decontaminate,
    language,
    lines,
    mixing,
    sharding,
    simhash,
    substring,
    toxicity,
)
from nabd.llm.queries import HOSTILE

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, shard int"


def make(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    data = [(i, t, "en", s, len(t or ""), "extra", 1) for i, t, s in rows]
    return spark.createDataFrame(data, DOCS)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocabulary = ["w%d" % i for i in range(60)] + ["Größe", "the", "The,", "of"]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 3, 12, 13, 40, 90])))) for i in range(60)]
    passage = " ".join(rng.choices(vocabulary, k=30))
    rows += [(100 + i, rows[i][1] + "\n" + passage + "\t" + rows[i + 1][1]) for i in range(12)]
    rows += [(200 + i, rows[40][1]) for i in range(5)] + [(300, None), (301, ""), (302, " \n\t ")]
    rows += [rows[3], rows[3], rows[65]]
    near = rows[50][1].split() or ["a"]
    rows += [(400 + i, " ".join([*near[:i], "x", *near[i + 1 :]])) for i in range(0, len(near), 7)]
    return [(i, t, rng.choice(["a", "b", "é", None])) for i, t in rows] + [(None, passage, "a")]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return make(spark, texts).cache()


def ordered(rows):
    return sorted(map(tuple, rows), key=str)


def test_mixing(spark, docs, texts):
    out = mixing.digest(docs).collect()
    sizes = [len((t or "").encode().split()) for _, t, _ in texts]
    assert sorted(r["size"] for r in out) == sorted(sizes)
    own = {}
    for (_, _, s), n in zip(texts, sizes, strict=True):
        own[s] = own.get(s, 0) + n
    names = sorted((s for s in own if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    pool, full = 1.5 * sum(sizes), set()
    while True:
        rate = (pool - sum(2 * own[s] for s in full)) / sum(weight[s] for s in names if s not in full)
        more = {s for s in names if s not in full and rate * weight[s] > 2 * own[s]}
        if not more:
            break
        full |= more
    target = {s: 2.0 * own[s] if s in full else rate * weight[s] for s in names}
    got = {}
    for r in mixing.mix(docs).collect():
        assert 0 <= r["copies"] <= 2 and r["source_size"] == own[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]])
        got[r["source"]] = got.get(r["source"], 0) + r["copies"] * r["size"]
    assert all(abs(got[s] - target[s]) <= 1 for s in names)
    assert ordered(out) == ordered(mixing.digest(docs.repartition(7)).collect())
    assert mixing.mixed_documents(docs).columns == docs.columns


@pytest.mark.parametrize("window", [1, 40, 1 << 16])
def test_fit_counts_is_best(window):
    rng = random.Random(window)
    for _ in range(60):
        lengths = rng.sample(range(1, 30), rng.randint(1, 5))
        counts = [rng.randint(1, 6) for _ in lengths]
        budget = rng.randint(0, sum(n * c for n, c in zip(lengths, counts, strict=True)))
        taken = mixing.fit_counts(lengths, counts, budget, window)
        assert all(0 <= t <= c for t, c in zip(taken, counts, strict=True))
        got = sum(t * n for t, n in zip(taken, lengths, strict=True))
        if window >= 1 << 16:  # the whole budget is left to dynamic programming
            sums = {0}
            for n, c in zip(lengths, counts, strict=True):
                sums = {s + k * n for s in sums for k in range(c + 1)}
            assert got == max(s for s in sums if s <= budget)
        assert got <= budget


def removed_by_hand(rows, span):
    first, out = {}, []
    split = [(i, (t or "").encode().split()) for i, t, _ in rows]
    for i, w in split:
        for s in range(len(w) - span + 1 if i is not None else 0):
            key = tuple(w[s : s + span])
            first[key] = min(first.get(key, i), i)
    for i, w in split:
        gone = set()
        for s in range(len(w) - span + 1 if i is not None else 0):
            if first[tuple(w[s : s + span])] < i:
                gone.update(range(s, s + span))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return ordered(out)


@pytest.mark.parametrize("hot", [2, 10_000])
def test_substring_dedup(docs, texts, hot, monkeypatch):
    monkeypatch.setattr(substring, "HOT", hot)
    assert ordered(substring.digest(docs).collect()) == removed_by_hand(texts, 13)
    kept = substring.dedup(docs)
    assert kept.schema.names == docs.columns and kept.count() == docs.count()


def test_automaton_covers_what_is_repeated():
    rng = random.Random(1)
    for _ in range(200):
        known = [rng.choices("ab", k=rng.randint(0, 12)) for _ in range(3)]
        text = rng.choices("abc", k=20)
        automaton = substring.Automaton()
        for k in known:
            automaton.add(k)
        hit = set()
        for s in range(len(text) - 3):
            if any(k[i : i + 4] == text[s : s + 4] for k in known for i in range(len(k) - 3)):
                hit.update(range(s, s + 4))
        assert {i for a, b in automaton.covered(text, 4) for i in range(a, b)} == hit


def test_line_dedup(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    base = [rng.choices(words, k=rng.randint(1, 20)) for _ in range(15)]
    rows = []
    for i in range(40):
        cut = [[w if rng.random() > 0.06 else rng.choice(words) for w in rng.choice(base)] for _ in range(5)]
        rows.append((i, "\n".join(" ".join(c).upper() if rng.random() < 0.3 else " ".join(c) for c in cut) + "\n", "a"))
    rows += [(50, None, "a"), (51, "", None), (52, "\n \n", "a"), (None, rows[0][1], "a")]
    found = [(i, k, frozenset(x.lower().split())) for i, t, _ in rows for k, x in enumerate((t or "").split("\n"))]
    found = [f for f in found if f[2]]
    place = lambda f: (f[0] is not None, f[0] or 0, f[1])  # noqa: E731  nulls first
    near = lambda a, b: 10 * len(a & b) >= 8 * len(a | b)
    want = {i: [0, 0, [], 0] for i, _, _ in rows}
    sets = {f[2] for f in found}
    for f in found:
        w = want[f[0]]
        w[0] += 1
        w[3] += sum(near(f[2], s) for s in sets if s != f[2])
        if any(near(f[2], g[2]) and place(g) < place(f) for g in found):
            w[1] += 1
            w[2].append(f[1])
    want = [(i, a, b, ",".join(map(str, sorted(c))), d) for i, (a, b, c, d) in want.items()]
    got = lines.digest(make(spark, rows)).select("doc_id", "n_lines", "n_removed", "removed_lines", "n_links")
    assert ordered(got.collect()) == ordered(want)
    assert lines.dedup(make(spark, rows)).count() == len(rows)


def test_line_dedup_of_rows_that_share_an_id(spark):
    rows = [(None, "a b c d e", "a"), (None, "p q r s t", "a"), (9, "p q r s t u", "a")]
    rows += [(20, "f g h i j", "a"), (20, "k l m n o", "a"), (21, "k l m n o v", "a"), (22, "f g h i j w", "a")]
    rows += [(None, "keep this one\nq r s t p", "a"), (None, "x1 x2 x3\ny1 y2 y3 y4", "a")]
    for data in (rows, rows[::-1]):
        out = {r["doc_id"]: tuple(r)[1:] for r in lines.digest(make(spark, data)).collect()}
        assert out == {
            9: (1, 1, "0", 1),
            20: (2, 0, "", 2),
            21: (1, 1, "0", 1),
            22: (1, 1, "0", 1),
            None: (6, 1, "1", 2),
        }
        kept = ordered((r["doc_id"], r["text"]) for r in lines.dedup(make(spark, data)).collect())
        gone = {"p q r s t u", "k l m n o v", "f g h i j w"}
        cut = {"keep this one\nq r s t p": "keep this one"}
        assert kept == ordered((i, "" if t in gone else cut.get(t, t)) for i, t, _ in data)


def test_line_dedup_of_many_near_copies(spark, monkeypatch):
    """Links of near copies are all counted, and the copies do not meet pair by pair."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [rng.sample(words, 40), rng.sample(words, 12), rng.sample(words, 70)]
    base.append(base[0][:34] + base[2][:6])  # near the first, so links lead from one group to the other
    rows = []
    for i in range(360):
        line = [rng.choice(words) if rng.random() < 0.04 else w for w in base[i % 4]]
        if i % 7 == 0:
            line += rng.sample(words, rng.randint(1, 8))
        rows.append((rng.choice([i, i, i, 7, None]), " ".join(line) + "\n" + " ".join(rng.sample(words, 9)), "a"))
    found = [(i, k, frozenset(x.split())) for i, t, _ in rows for k, x in enumerate(t.split("\n"))]
    place = lambda f: (f[0] is not None, f[0] or 0, f[1])  # noqa: E731  nulls first
    sets = {f[2] for f in found}
    near = {s: [t for t in sets if s != t and 10 * len(s & t) >= 8 * len(s | t)] for s in sets}
    earliest = {s: min(place(f) for f in found if f[2] == s) for s in sets}
    want = {i: [0, 0, set(), 0] for i, _, _ in rows}
    for f in found:
        w = want[f[0]]
        w[0] += 1
        w[3] += len(near[f[2]])
        if min(earliest[s] for s in (f[2], *near[f[2]])) < place(f):
            w[1] += 1
            w[2].add(f[1])
    want = [(i, a, b, ",".join(map(str, sorted(c))), d) for i, (a, b, c, d) in want.items()]
    made, stage = {}, lines.stage

    def counting(df, name):
        out = stage(df, name)
        made[name] = out.count()
        return out

    monkeypatch.setattr(lines, "stage", counting)
    assert ordered(map(tuple, lines.digest(make(spark, rows)).collect())) == ordered(want)
    assert sum(map(len, near.values())) > 10_000 and made["line-members"] > 200
    assert made["line-pairs"] < 3_000


def test_toxicity_learns_and_reads_clauses(spark):
    rng = random.Random(2)
    plain = [f"word{i}" for i in range(80)]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        tokens = rng.choices(plain, k=30)
        if toxic:
            tokens[rng.randrange(30)] = "zorkling" + rng.choice(["s", "", "ed"])
            tokens[rng.randrange(30)] = "idiot"
        rows.append((i, " ".join(tokens), "a"))
        labels.append((i, int(toxic)))
    label_rows = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    docs = make(spark, [*rows, (900, None, "a"), (901, "", "a")])
    out = {r["doc_id"]: r for r in toxicity.digest(docs, label_rows).collect()}
    held = [i for i, _ in labels if out[i]["held_out"]]
    assert held and all(out[i]["predicted"] == (i % 4 == 0) for i in held)
    assert out[900]["score"] == out[901]["score"] < 0.5
    kept = toxicity.reject_toxic(docs, label_rows)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} >= {900, 901}
    empty = label_rows.limit(0)
    assert toxicity.digest(docs, empty).count() == docs.count()


@pytest.mark.parametrize("insult", ["zo\u0301rkle\u0301d", "\u0926\u0941\u0937\u094d\u091f", "z" + "qxv" * 15])
def test_toxicity_learns_the_words_it_matches(spark, insult):
    rng = random.Random(2)
    plain = [f"w{a}{b}" for a in "abcdefgh" for b in "abcdefgh"]
    rows = [(i, " ".join(rng.choices(plain, k=20) + [insult] * (i % 4 == 0)), "a") for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")
    out = toxicity.digest(make(spark, rows), labels).collect()
    assert all(r["predicted"] == (r["doc_id"] % 4 == 0) for r in out)


def test_grammar_scores_clauses():
    grammar = toxicity.Grammar({}, {"blorp": 2.0})
    weight = lambda t: sum(grammar.clause_weights(t))
    assert weight("you are an idiot") > weight("idiot") > weight("not an idiot") > 0
    assert weight("they said idiot") < weight("you idiot") and weight('"idiot"') < weight("idiot")
    assert weight("I will kill you") > 0 and weight("kill. you") == 0
    assert weight("blorping") == weight("blorp") > 0 == weight("fine words")


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_decontamination(spark, docs, texts):
    items = [(1, texts[60][1]), (2, texts[61][1][:80]), (3, "W1 The"), (3, "the"), (None, "of"), (4, None), (5, "...")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for item, text in items:
        w = WORD.findall((text or "").translate(LOWER))
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    want = []
    for doc, text, _ in texts:
        w = WORD.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for n in range(1, 11):
            for i in range(len(w) - n + 1):
                if (held := windows.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= held - {None}
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        want.append((doc, len(w), len(hit), len(found), digest, bool(hit)))
    out = decontaminate.digest(docs, benchmark)
    assert ordered(out.collect()) == ordered(want)
    clean = decontaminate.clean_documents(docs, benchmark)
    assert clean.columns == docs.columns and clean.count() == sum(not w[5] for w in want)
    assert decontaminate.clean_documents(docs, benchmark.limit(0)).count() == docs.count()


def test_language(spark):
    rng = random.Random(4)
    sounds = {"aa": ["bra", "dil", "tom"], "bb": ["xqu", "zve", "kjo"]}
    text = lambda g: " ".join("".join(rng.choices(sounds[g], k=3)) for _ in range(30))
    training = spark.createDataFrame([(i, text(g), g) for i, g in enumerate(["aa", "bb"] * 40)], "doc_id long, text string, lang string")
    rows = [(i, f"http://h{i % 3}.{g}.org/x", f"<html lang='{g}'><p>{text(g)}</p><script>{text('aa')}</script>") for i, g in enumerate(["aa", "bb"] * 30)]
    rows += [(100, "http://h0.aa.org/", None), (101, None, None), (102, "junk", ""), (103, "http://q.bb.org", "<html lang='bb'>")]
    out = {r["page_id"]: r for r in language.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), training).collect()}
    assert all(out[i]["lang"] == ["aa", "bb"][i % 2] for i in range(60))
    assert out[100]["lang"] == "aa" and out[103]["lang"] == "bb" and out[100]["text_lang"] is None
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out.values())
    none = language.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), training.limit(0))
    assert {r["lang"] for r in none.collect()} == {None}


def test_no_language_is_lost_among_large_ones(spark):
    rng = random.Random(2)
    letters = {"aa": "abcdefgh", "bb": "ijklmnop", "cc": "qrstuvwx", "dd": "yzäöüßéè"}
    text = lambda g, n: " ".join("".join(rng.choices(letters[g], k=5)) for _ in range(n))
    rows = [(i, text(g, 200), g) for i, g in enumerate(["aa", "bb", "cc"] * 100)] + [(900 + i, text("dd", 9), "dd") for i in range(3)]
    training = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(training, training_rows=40, grams=400)
    assert model.langs == ["aa", "bb", "cc", "dd"]
    pages = [(k, None, f"<p>{text(g, 30)}</p>") for k, g in enumerate("aa bb cc dd dd".split())]
    found = language.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), training, model)
    assert [r["text_lang"] for r in sorted(found.collect())] == "aa bb cc dd dd".split()
    sure = language.identify(
        spark.createDataFrame(pages, "page_id long, url string, html string"), training, model, most_grams=1
    )
    assert all(a["score"] <= b["score"] for a, b in zip(sorted(sure.collect()), sorted(found.collect()), strict=True))


def test_language_fusion_by_hand(spark):
    """One posterior, from its parts: text, prior of the host, declared language, suffix."""
    training = spark.createDataFrame([(1, "aba bab", "aa"), (2, "xyx yxy", "bb")], "doc_id long, text string, lang string")
    model = language.fit(training)
    pages = [(1, "http://h.aa/1", "<html lang=aa>aba"), (2, "http://h.aa/2", "<html lang=aa>xyx"), (3, "http://k.bb/", "<html lang=bb>yxy")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    ll = {i: np.array(model.likelihood(t)[1]) * model.likelihood(t)[0] / 5 for i, t in ((1, "aba"), (2, "xyx"), (3, "yxy"))}
    p = {i: np.exp(v - v.max()) / np.exp(v - v.max()).sum() for i, v in ll.items()}
    every = p[1] + p[2] + p[3]
    prior = (every + 1) / (every.sum() + 2)
    mates = p[2]  # page 1 is judged without its own share
    domain = (mates + 4 * prior) / (mates.sum() + 4)
    host = (mates + 4 * domain) / (mates.sum() + 4)
    seen = every - p[1]
    told = (mates + 1) / (seen + 1 * 3)  # two declared values, two suffixes, and one unseen
    z = ll[1] + np.log(host) + 2 * np.log(told)
    want = np.exp(z - z.max()).max() / np.exp(z - z.max()).sum()
    got = {r["page_id"]: r for r in language.identify(frame, training, model).collect()}
    assert got[1]["score"] == pytest.approx(want) and got[1]["lang"] == model.langs[int(np.argmax(z))]


def test_chat_round_trip(spark):
    odd = [HOSTILE, "a\\<|b\\\\<\\|\n", "<", "|x<\\n>\n<|im_end|>\n", "", None, "é😀\\"]
    rng = random.Random(6)
    rows = [(c, t, rng.choice(["user", "assistant", "r\n<|\\", None]), rng.choice(odd)) for c in range(40) for t in range(c % 6)]
    rows += [(90, 0, "system", "s"), (90, 1, "user", "u"), (90, 2, "assistant", "a"), (91, 0, "assistant", "a"), (None, None, "user", "u")]
    conversations = {}
    for c, t, r, x in rows:
        conversations.setdefault(c, []).append(((t is not None, t), r or "", x or ""))
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r["conv_id"]: r for r in chat.digest(frame).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert out.keys() == conversations.keys()
    for c, turns in conversations.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert out[c]["turns_sha256"] == sha("".join(f"{r}\n{x}\n" for _, r, x in turns))
        assert (out[c]["loss_chars"], out[c]["loss_sha256"], out[c]["n_turns"]) == (len(loss), sha(loss), len(turns))
    assert out[90]["valid"] and not out[91]["valid"]
    assert chat.digest(frame.limit(0)).count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(900, 12))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(5, vectors[5].tolist())]
    rows += [(2000, None), (2020, [0.0] * 12), (2040, [math.nan] * 12), (2060, [None] * 12), (None, [1.0] * 12), (2080, [1.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    usable = ann.stage(ann.usable(frame), "v")
    index = ann.stage(ann.build_index(usable, shard_rows=400), "i")
    out = ann.search(index, usable.filter("vec_id % 20 = 0"), 20, ef=64).toPandas()
    hits = 0
    for q, part in out.groupby("query_id"):
        scores = vectors @ vectors[q]
        scores[q] = -np.inf
        best = set(np.argsort(-scores)[:20])
        part = part.sort_values("rank")
        assert list(part["rank"]) == list(range(1, 21))
        assert np.allclose(part["score"], vectors[part["vec_id"]] @ vectors[q], rtol=1e-12)
        assert (np.diff(part["score"]) <= 0).all()
        hits += len(best & set(part["vec_id"]))
    assert out["query_id"].nunique() == 45 and hits >= 0.9 * 45 * 20
    assert ann.digest(frame.filter("vec_id < 10")).filter("query_id = 0").count() == 9
    assert ann.digest(frame.limit(0)).count() == 0


@pytest.mark.parametrize("groups", [[100] * 40, [1300] + [1] * 2600])
def test_nearest_among_copies(spark, groups):
    """Recall where vectors have many copies, and where one has a third of the rows; ties by id."""
    rng = np.random.default_rng(9)
    vectors = np.repeat(rng.normal(size=(len(groups), 12)), groups, axis=0)
    vectors = vectors[rng.permutation(len(vectors))]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    out = ann.digest(frame).toPandas()
    hits = 0
    for q, part in out.groupby("query_id"):
        scores = np.round(vectors @ vectors[q], 9)
        scores[q] = -np.inf
        best = np.lexsort((np.arange(len(scores)), -scores))[:20]
        assert q not in set(part["vec_id"]) and len(part) == 20
        hits += len(set(best) & set(part["vec_id"]))
    assert out["query_id"].nunique() == -(-len(vectors) // 20) and hits >= 0.98 * 20 * out["query_id"].nunique()


def print_of(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(docs, texts):
    prints = {}
    for i, t, _ in texts:
        prints.setdefault(i, set()).add(print_of(t))
    every = sorted({p for ps in prints.values() for p in ps})
    group = {p: p for p in every}
    for a in every:
        for b in every:
            if (a ^ b).bit_count() <= 4 and group[a] != group[b]:
                old, new = group[b], group[a]
                group = {p: new if g == old else g for p, g in group.items()}
    least = {}
    for i, ps in prints.items():
        for p in ps:
            if i is not None:
                least[group[p]] = min(least.get(group[p], i), i)
    want = [(i, f"{print_of(t):016x}", least.get(group[print_of(t)])) for i, t, _ in texts]
    assert ordered(simhash.digest(docs).collect()) == ordered(want)
    kept = [r["doc_id"] for r in simhash.dedup(docs).collect()]
    assert sorted(i for i in kept if i is not None) == sorted({w[2] for w in want if w[2] is not None and w[0] == w[2]})


def test_simhash_links_rows_without_an_id(spark, monkeypatch):
    monkeypatch.setattr(simhash, "with_fingerprint", lambda docs, shingle: docs.select("doc_id", "fp"))
    one_bit, four_bits, far = 1 << 20, 0x1 | 1 << 17 | 1 << 33 | 1 << 50, 0x0F0F0F0F0F0F0F0F
    # null - 7 by four bits; 3 - null - 5 by four and one bit, 3 and 5 farther apart; a null pair alone.
    rows = [(7, 0), (None, four_bits), (3, far), (None, far ^ four_bits), (5, far ^ four_bits ^ one_bit)]
    rows += [(None, -1), (None, ~one_bit), (8, 0x00FF00FF00FF00FF), (None, 0x00FF00FF00FF00FF)]
    docs = spark.createDataFrame(rows, "doc_id long, fp long")
    out = {r["fp"]: r["component_id"] for r in simhash.with_components(docs).collect()}
    assert out == dict(zip([fp for _, fp in rows], [7, 7, 3, 3, 3, None, None, 8, 8], strict=True))


@pytest.mark.parametrize("distance", [1, 2, 3, 4, 5])
def test_simhash_links_all_distances(spark, distance):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(20)]
    prints = set(base)
    for b in base:
        for k in [*range(1, 7)] * 4:
            prints.add(b ^ sum(1 << x for x in rng.sample(range(64), k)))
    rows = [(i, p - (1 << 64) if p >> 63 else p, i) for i, p in enumerate(sorted(prints))]
    classes = spark.createDataFrame(rows, "id long, fp long, component long")
    got = {(r["a"], r["b"]) for r in simhash.segment_links(classes, distance).collect()}
    ids = sorted(prints)
    near = {(i, j) for i in range(len(ids)) for j in range(i + 1, len(ids)) if (ids[i] ^ ids[j]).bit_count() <= distance}
    assert got == near


def test_simhash_keys_are_not_broadcast(spark):
    """The keyed rows are many times what Spark takes them for, and must not pass through the driver."""
    rng = random.Random(4)
    fps = [rng.getrandbits(64) - (1 << 63) for _ in range(40)]
    fps += [fp ^ 0b1011 for fp in fps]
    classes = spark.createDataFrame([(fp, fp) for fp in fps], "fp long, component long")
    links = simhash.segment_links(classes, 4)
    assert len(links.collect()) == 40
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("distance", [1, 2, 3, 4, 7])
def test_simhash_pairs_are_taken_once(distance):
    masks, before = simhash.index_masks(distance)
    rng = random.Random(3)
    for _ in range(3000):
        d = sum(1 << b for b in rng.sample(range(64), rng.randint(1, distance)))
        assert sum(not d & m and all(d & e for e in bs) for m, bs in zip(masks, before)) == 1


@pytest.mark.parametrize("limit", [50, 400, 5000, 1 << 30])
def test_sharding(docs, texts, limit):
    out = sharding.digest(docs, max_bytes=limit).collect()
    assert sorted(r["bytes"] for r in out) == sorted(len((t or "").encode()) for _, t, _ in texts)
    shards = {}
    for r in out:
        shards.setdefault(r["shard"], []).append(r)
    names = [s.split(".")[0] for s in shards]
    for name, rows in shards.items():
        total = sum(r["bytes"] for r in rows)
        assert {r["shard_bytes"] for r in rows} == {total} and (total <= limit or len(rows) == 1)
    assert not any(a != b and b.startswith(a) for a in names for b in names)
    assert sharding.with_shard(docs, max_bytes=limit).count() == len(out)
    assert {tuple(r)[:1] + (r["shard"].split(".")[0],) for r in out} == split_whole(docs, limit)


def split_whole(docs, limit):
    """(doc_id, leading bits), splitting only what is over the limit and holds two hashes."""
    hashed = docs.select("doc_id", F.xxhash64(F.lit(sharding.SEED), "doc_id"), F.octet_length("text"))
    rows = [(i, format(h % (1 << 64), "064b"), n or 0) for i, h, n in hashed.collect()]
    found, open_buckets = set(), [("", rows)]
    while open_buckets:
        bits, bucket = open_buckets.pop()
        if sum(r[2] for r in bucket) > limit and len({r[1] for r in bucket}) > 1:
            for bit in "01":
                half = [r for r in bucket if r[1].startswith(bits + bit)]
                if half:
                    open_buckets.append((bits + bit, half))
        else:
            found |= {(r[0], bits) for r in bucket}
    return found


def test_sharding_of_one_hot_id(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES", 7)
    rows = [(None, "same text", "a")] * 60 + [(None, f"t{i}" * (i % 9), "a") for i in range(80)]
    rows += [(None, None, "a")] * 3 + [(None, "x" * 250, "a"), (None, "y" * 80, "b"), (5, "z", None)]
    docs = make(spark, rows).withColumn("size", F.col("n_chars") + 1)
    out = sharding.with_shard(docs, max_bytes=100).collect()
    assert ordered((r["doc_id"], r["text"], r["size"]) for r in out) == ordered(
        (i, t, len(t or "") + 1) for i, t, _ in rows
    )
    shards = {}
    for r in out:
        shards.setdefault((r["shard"], r["shard_bytes"]), []).append(len(r["text"] or ""))
    assert len(shards) == len({s for s, _ in shards})
    for (_, size), own in shards.items():
        assert size == sum(own) and (size <= 100 or len(own) == 1)
    small = sum(len(t or "") for i, t, _ in rows if i is None and len(t or "") <= 50)
    assert len(shards) <= small / 50 + 5


def test_extra_columns_of_any_name(spark, texts):
    names = (
        "_size _hash _id _gone _lines _spans _path _at _at8 _row rest c c0 _nabd_key _nabd_row _nabd_a size copies "
        "target source_size id line n"
    ).split()
    rows = [(i, t, s) for i, t, s in texts]
    data = [(i, t, s, *[f"{n}{k}" for n in names]) for k, (i, t, s) in enumerate(rows)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(60)], "doc_id long, toxic int")
    items = spark.createDataFrame([(1, "no such words in any text of these")], "item_id long, text string")
    own = {r["_size"]: tuple(r)[3:] for r in docs.collect()}
    for out in (
        lines.dedup(docs),
        substring.dedup(docs),
        decontaminate.clean_documents(docs, items),
        toxicity.reject_toxic(docs, labels),
        simhash.dedup(docs),
        mixing.mixed_documents(docs),
        sharding.with_shard(docs, max_bytes=300).drop("shard", "shard_bytes"),
    ):
        assert out.columns == docs.columns
        kept = out.collect()
        assert kept and all(own[r["_size"]] == tuple(r)[3:] for r in kept)
    assert mixing.mix(docs).count() == len(rows)


def test_mix_does_not_depend_on_the_order_of_rows(spark):
    """Rows without an id or of one id, all of one length, told apart by their text or another column."""
    rows = [(None, f"w{i} x y", "a", i) for i in range(40)] + [(7, "p q r", "a", i) for i in range(40)]
    rows += [(i, "one two three", "b", i) for i in range(40)]
    columns = "doc_id long, text string, source string, place int"
    weights = (1.0, 2.0)
    once = [
        ordered(mixing.mixed_documents(spark.createDataFrame(data, columns).repartition(n), weights=weights).collect())
        for data, n in ((rows, 1), (rows[::-1], 5))
    ]
    assert once[0] == once[1] and 0 < len(once[0]) < 2 * len(rows)


def test_very_long_texts(spark):
    rng = random.Random(8)
    long = " ".join(f"w{rng.randrange(1 << 20)}" for _ in range(200_000))
    cut = long.rsplit(" ", 20)[0]
    rows = [(1, long, "a"), (2, "start " + long, "a"), (3, "short text", "b"), (4, cut, "a")]
    docs = make(spark, rows)
    counts = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring.digest(docs).collect()}
    assert counts == {1: (200_000, 0), 2: (200_001, 200_000), 3: (2, 0), 4: (199_980, 199_980)}
    item = spark.createDataFrame([(1, " ".join(long.split()[-10:]))], "item_id long, text string")
    hits = {r["doc_id"]: r["n_hit"] for r in decontaminate.digest(docs, item).collect()}
    assert hits == {1: 10, 2: 10, 3: 0, 4: 0}
    found = {r["doc_id"]: (r["n_removed"], r["n_links"]) for r in lines.digest(docs).collect()}
    assert found == {1: (0, 2), 2: (1, 2), 3: (0, 0), 4: (1, 2)}
    groups = {r["doc_id"]: r["component_id"] for r in simhash.digest(docs).collect()}
    assert groups[1] == groups[2] == groups[4] == 1 and groups[3] == 3
    assert {r["size"] for r in mixing.digest(docs).collect()} == {200_000, 200_001, 2, 199_980}
    assert {r["shard_bytes"] for r in sharding.digest(docs, max_bytes=1000).collect()} >= {len(long), len("short text")}
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 5)], "doc_id long, toxic int")
    assert all(0 <= r["score"] <= 1 for r in toxicity.digest(docs, labels).collect())


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    for out in (
        mixing.digest(none),
        substring.digest(none),
        lines.digest(none),
        toxicity.digest(none, labels),
        decontaminate.digest(none, items),
        simhash.digest(none),
        simhash.dedup(none),
        sharding.digest(none),
    ):
        assert out.count() == 0


def test_pipeline_keys_of_fingerprints_are_not_broadcast(spark, sf, monkeypatch):
    plans, staged = [], simhash.stage

    def stage(df, name="stage"):
        if name == "links":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return staged(df, name)

    monkeypatch.setattr(simhash, "stage", stage)
    docs = corpus_pipeline.read(spark, sf, "documents").limit(60)
    assert corpus_pipeline.simhash_stage(spark, docs, sf).count()
    assert plans and all("SortMergeJoin" in p and "Broadcast" not in p for p in plans)


def test_pipeline(spark, sf):
    """Each stage against a plain reading of its rule, on what the one before kept."""
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "mixing", "sharding"]
    docs = corpus_pipeline.read(spark, sf, "documents")
    labels, items = (corpus_pipeline.read(spark, sf, name) for name in ("labels", "benchmark"))
    columns, kept = docs.columns, {}
    for name, function in corpus_pipeline.STAGES:
        kept[name] = before = corpus_pipeline.stage(docs, "test")
        docs = function(spark, before, sf)
        assert docs.columns == (columns if name != "sharding" else [*columns, "shard", "shard_bytes"])
    last = docs.collect()
    rows = {name: [tuple(r) for r in df.collect()] for name, df in kept.items()}
    scores = {r["doc_id"]: r["score"] for r in toxicity.digest(kept["toxicity"], labels).collect()}
    assert ordered(rows["simhash_near_dedup"]) == ordered(r for r in rows["toxicity"] if scores[r[0]] < 0.5)

    ids, prints = [], []
    for r in rows["simhash_near_dedup"]:
        ids.append(r[0])
        prints.append(fingerprint_of(r[1]))
    lead = {i: i for i in ids}

    def top(i):
        while lead[i] != i:
            i = lead[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                low, high = sorted((top(ids[a]), top(ids[b])))
                lead[high] = low
    heads = {top(i) for i in ids}
    assert ordered(rows["benchmark_decontamination"]) == ordered(r for r in rows["simhash_near_dedup"] if r[0] in heads)

    windows = set()
    for r in items.collect():
        w = WORD.findall((r["text"] or "").translate(LOWER))
        n = min(10, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1) if w}
    spans = {len(w) for w in windows}

    def clean(text):
        w = WORD.findall((text or "").translate(LOWER))
        return not any(tuple(w[i : i + n]) in windows for n in spans for i in range(len(w) - n + 1))

    assert ordered(rows["mixing"]) == ordered(r for r in rows["benchmark_decontamination"] if clean(r[1]))

    copies = {(r["doc_id"], r["text"]): r for r in mixing.mix(kept["mixing"]).collect()}
    want = [r for r in rows["mixing"] for _ in range(copies[r[0], r[1]]["copies"])]
    assert ordered(rows["sharding"]) == ordered(want)
    # These budgets are within the window of the knapsack, so no other choice comes closer below them.
    for source, target in {r["source"]: r["target"] for r in copies.values()}.items():
        sizes = [len((r[1] or "").encode().split()) for r in rows["mixing"] if r[3] == source]
        every = int(target // sum(sizes))
        budget, sums = round(target - every * sum(sizes)), 1
        for n in sizes:
            sums |= sums << n
        best = every * sum(sizes) + max(s for s in range(budget + 1) if sums >> s & 1)
        taken = sum(len((r[1] or "").encode().split()) for r in rows["sharding"] if r[3] == source)
        assert budget <= mixing.WINDOW and taken == best

    assert ordered(tuple(r)[:5] for r in last) == ordered(rows["sharding"])
    assert {(r["doc_id"], r["shard"].split(".")[0]) for r in last} == split_whole(kept["sharding"], sharding.MAX_BYTES)
    assert corpus_pipeline.run(spark, sf).count() == len(last)


def fingerprint_of(text):
    w = (text or "").translate(LOWER).encode().split()
    shingles = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([b" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
