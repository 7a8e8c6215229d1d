"""Operators on small hand-worked posts, brute-force checks, and properties."""

import math
import random
import re
import tempfile
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from nabd import fixed_values as fv
from nabd.functions import text as tx
from nabd.operators import (
    clean,
    dedup,
    density,
    graph,
    influence,
    match,
    near,
    network,
    sentiment,
    stats,
    topics,
)
from nabd.operators.grouping import FewGroups, SharedRows, top_k
from nabd.plans import staging
from nabd.plans.staging import release, stage, staging_root
from nabd.sources.sample import sample_posts


def ids(df):
    return sorted(r.post_id for r in df.select("post_id").collect())


def test_stats_fallbacks(make_posts):
    posts = make_posts({"text": "a", "likes": 2}, {"text": "b", "retweets": 2, "replies": 1})
    assert tuple(stats.overall_stats(posts).first()) == (2, 2, 50)
    assert tuple(stats.overall_stats(posts.limit(0)).first()) == (0, 0, 0)
    known = make_posts(
        {"user_id": "u", "user_followers": 7}, {"user_id": "u", "user_followers": 7}, {"user_id": None}
    )
    assert tuple(stats.overall_stats(known).first()) == (3, 1, 14)
    assert tuple(stats.overall_stats(known, approximate=True).first()) == (3, 1, 14)


def test_breakdown(make_posts):
    posts = make_posts(*[{"source_dataset": s} for s in ("a", "a", "", None, "b")])
    assert stats.breakdown_map(posts).first()[0] == {"a": 2, "b": 1}


def test_dedup_modes(make_posts):
    posts = make_posts(*[{"text": t} for t in ("b", "أ", "ا", "b", "", None, "B", "!")])
    assert ids(dedup.dedup_by_hash(posts)) == [0, 1, 2, 4, 6, 7]
    assert ids(dedup.dedup_by_hash(posts, "normalized")) == [0, 1, 4, 7]
    assert ids(dedup.dedup_exact(posts)) == [0, 1, 7]
    once = dedup.dedup_by_hash(posts)
    assert ids(dedup.dedup_by_hash(once)) == ids(once)


def greedy_near(texts, threshold, cap=fv.NEAR_VOCABULARY):
    """The rule in plain Python, all pairs."""
    norm = [t.lower() for t in texts]
    words = [re.findall(r"\b\w\w+\b", t) for t in norm]
    grams = [Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])]) for w in words]
    valid = [i for i, t in enumerate(norm) if t]
    cf, df = Counter(), Counter()
    for i in valid:
        cf.update(grams[i])
        df.update(grams[i].keys())
    vocabulary = set(sorted(cf, key=lambda t: (-cf[t], t))[:cap])
    n = len(valid)
    vectors = {}
    for i in valid:
        v = {t: c * (math.log((1 + n) / (1 + df[t])) + 1) for t, c in grams[i].items() if t in vocabulary}
        length = math.sqrt(sum(x * x for x in v.values()))
        vectors[i] = {t: x / length for t, x in v.items()}
    kept = []
    for i in valid:
        a = vectors[i]
        if all(sum(x * vectors[k].get(t, 0.0) for t, x in a.items()) < threshold for k in kept):
            kept.append(i)
    return kept


def near_texts(seed, n):
    """Many variants of few texts, exact copies, a chain of drifting texts, and texts without words."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.randint(3, 40))] for _ in range(12)]
    drift = [rng.choice(vocabulary) for _ in range(30)]
    out = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.35:
            words = list(bases[0])
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        elif kind < 0.6:
            words = list(rng.choice(bases))
            if rng.random() < 0.5:
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        elif kind < 0.8:
            drift[rng.randrange(len(drift))] = rng.choice(vocabulary)
            words = list(drift)
        elif kind < 0.85:
            words = ["!"]
        elif kind < 0.87:
            words = []
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.randint(1, 6))]
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize(
    "seed, threshold, cap, width", [(1, 0.92, 10000, 16), (2, 0.7, 10000, 2), (3, 0.8, 40, 1)]
)
def test_near_dedup_equals_brute_force(make_posts, monkeypatch, seed, threshold, cap, width):
    monkeypatch.setattr(near, "_FIRST_WIDTH", width)
    texts = near_texts(seed, 200)
    posts = make_posts(*[{"text": t} for t in texts])
    got = ids(near.dedup_near(posts, threshold, cap))
    want = greedy_near(texts, threshold, cap)
    wordless = {i for i, t in enumerate(texts) if t == "!"}
    assert set(got) == set(want) and wordless <= set(got)


@pytest.mark.parametrize("seed, threshold, width", [(4, 0.92, 16), (5, 0.7, 2), (6, 0.8, 1)])
def test_near_dedup_over_all_terms_equals_brute_force(make_posts, monkeypatch, seed, threshold, width):
    monkeypatch.setattr(near, "_FIRST_WIDTH", width)
    monkeypatch.setattr(near, "_TEXTS_AT_ONCE", 7)
    texts = near_texts(seed, 120) + [f"été {i} été {i} أحمد solo{i} other{i}" for i in range(10, 20)]
    got = ids(near.dedup_near(make_posts(*[{"text": t} for t in texts]), threshold))
    assert got == sorted(set(greedy_near(texts, threshold, None)) | {i for i, t in enumerate(texts) if t == "!"})


def test_near_dedup_decides_only_what_may_be_similar(make_posts, monkeypatch):
    """Texts of which most words are their own are kept without a vector; so are texts of a few shared words."""
    own = [" ".join(f"w{i}x{k}" for k in range(20)) + " shared words" for i in range(6)]
    copies = [" ".join(f"copy{k}" for k in range(60)), " ".join(f"copy{k}" for k in range(61))]
    decided, seen = near._decided, set()

    def rounds(vectors, *args):
        seen.update(r.post_id for r in vectors.select("post_id").collect())
        return decided(vectors, *args)

    monkeypatch.setattr(near, "_decided", rounds)
    got = ids(near.dedup_near(make_posts(*[{"text": t} for t in own + copies])))
    assert got == [0, 1, 2, 3, 4, 5, 6] and seen == {6, 7}


def test_near_dedup_takes_rows_of_one_id_as_one_post(make_posts):
    words = [f"word{k}" for k in range(120)]
    rows = [(0, words[:60]), (0, words[60:]), (1, words), (2, words[:60]), (3, ["few", "words"]), (3, ["few", "words"])]
    got = ids(near.dedup_near(make_posts(*[{"post_id": i, "text": " ".join(w)} for i, w in rows])))
    assert got == [0, 0, 3, 3]


@pytest.mark.parametrize("n", [64, 500])
def test_near_dedup_of_drifting_texts(make_posts, n):
    """Each text is a window moved on by one word, so each is similar to its neighbours alone."""
    texts = [" ".join(f"word{i + k}" for k in range(20)) for i in range(n)]
    got = ids(near.dedup_near(make_posts(*[{"text": t} for t in texts])))
    assert got == greedy_near(texts, fv.NEAR_THRESHOLD, None)


@pytest.mark.parametrize("walked", [0, 12, 1 << 20])
def test_parts_are_decided_alike_by_walks_and_rounds(spark, walked):
    """A chain, a dense group and a random part: what greedy first-wins removes, however it is found."""
    rng = random.Random(6)
    pairs = {(i, i + 1) for i in range(24)} | {(a, b) for b in range(30, 42) for a in range(30, b)}
    pairs |= {tuple(sorted(rng.sample(range(50, 90), 2))) for _ in range(60)}
    removed = set()
    for post in range(90):
        if any(head not in removed for head, other in pairs if other == post):
            removed.add(post)
    df = spark.createDataFrame(sorted(pairs), "head long, post_id long")
    assert set(ids(near._resolve(df, walked))) == removed


def test_near_dedup_of_few(make_posts):
    assert ids(near.dedup_near(make_posts({"text": ""}))) == []
    assert ids(near.dedup_near(make_posts({"text": "ab cd"}))) == [0]
    assert ids(near.dedup_near(make_posts({"text": ""}, {"text": "ab cd"}))) == [1]


def test_keyword_filter(make_posts):
    posts = make_posts({"text": "المَكْتَبَة"}, {"text": "Book"}, {"text": None})
    assert ids(match.keyword_filter(posts, ["مكتبه"])) == [0]
    assert ids(match.keyword_filter(posts, ["bOOK", " "])) == [1]
    assert ids(match.keyword_filter(posts, [" ", ""])) == [0, 1, 2]
    assert ids(match.keyword_filter(posts, [])) == [0, 1, 2]
    assert ids(match.keyword_filter(posts, ["َ"])) == [0, 1, 2]


def test_date_filter(make_posts):
    days = ["2024-01-01", "2024-01-05T10:00:00", "bad", None, "2024-01-09"]
    posts = make_posts(*[{"created_at": d} for d in days])
    assert ids(match.date_filter(posts, "2024-01-05", "2024-01-05")) == [1, 2, 3]
    assert ids(match.date_filter(posts, None, "2024-01-05")) == [0, 1, 2, 3]
    assert ids(match.date_filter(posts)) == [0, 1, 2, 3, 4]


REQUEST = (
    "request_id string, keywords array<string>, dataset_ids array<string>, "
    "date_from string, date_to string"
)


def test_matches_are_those_of_every_pair(spark, make_posts):
    rows = [
        {"text": t, "source_dataset": s}
        for t, s in [
            ("abc", "x"), ("xabcx", "y"), ("ab", "x"), ("a", "y"), ("الكتاب", "x"), ("كِتاب", None),
            ("", "y"), (None, "x"), ("ABCD", "x"), ("xabcx", "x"),
        ]
    ]
    requests = spark.createDataFrame(
        [
            ("k3", ["abc", "zz"], None, None, None),
            ("k2", ["ab"], ["x"], None, None),
            ("k1", ["a"], ["y", "x"], None, None),
            ("ar", ["كتاب"], None, None, None),
            ("all", None, None, None, None),
            ("y", [" "], ["y"], None, None),
            ("mark", ["َ"], None, None, None),
            ("bad", ["a"], None, "soon", None),
        ],
        REQUEST,
    )
    posts = make_posts(*rows)
    prepared = match.prepare_requests(requests)

    def key(s):
        return tx_key(s or "")

    table = str.maketrans(fv.SEARCH_LETTERS) | {ord(c): None for c in fv.SEARCH_MARKS}

    def tx_key(s):
        return s.translate(table).lower()

    want = []
    for r in requests.filter("request_id <> 'bad'").collect():
        kws = [tx_key(k) for k in r.keywords or [] if k.strip()]
        for i, row in enumerate(rows):
            inside = not r.dataset_ids or row["source_dataset"] in r.dataset_ids
            if inside and (not kws or any(k in key(row["text"]) for k in kws)):
                want.append((r.request_id, i))
    matched = match.match_requests(posts, prepared)
    pairs = matched.join(match.class_requests(matched, prepared), "_class")
    assert sorted((r.request_id, r.post_id) for r in pairs.collect()) == sorted(want)
    bad = prepared.filter("bad_dates").collect()
    assert [r.request_id for r in bad] == ["bad"]


def test_dedup_is_per_set_of_datasets(spark, make_posts):
    """A copy in another dataset must not hide a post from a request that never sees the copy."""
    posts = make_posts(
        {"text": "same", "source_dataset": "x"},
        {"text": "same", "source_dataset": "y"},
        {"text": "same", "source_dataset": "y"},
    )
    requests = spark.createDataFrame(
        [("both", ["same"], None, None, None), ("y", ["same"], ["y"], None, None)], REQUEST
    )
    selected = match.select_posts(posts, match.prepare_requests(requests))
    got = {(r.post_id, r.request_id) for r in selected.pairs().collect()}
    assert got == {(0, "both"), (1, "y")}


def test_keywords_are_monotone(spark, sf):
    posts = sample_posts(spark, sf)
    few = set(ids(match.keyword_filter(posts, ["user_3"])))
    more = set(ids(match.keyword_filter(posts, ["user_3", "the"])))
    assert few <= more


def test_influencers_by_hand(make_posts):
    posts = make_posts(
        {"user_id": "u1", "user_handle": "A", "user_followers": 100, "likes": 30, "text": "x @BO"},
        {"user_id": "u1", "user_handle": "A", "user_followers": 90, "retweets": 20, "text": "x"},
        {"user_id": "u2", "user_handle": "@bo", "user_followers": 50, "replies": 100, "text": "x"},
        {"text": "nobody"},
    ).withColumn("mentions", tx.mentions(F.col("text")))
    rows = influence.detect_influencers(posts).orderBy("rank").collect()
    got = [(r.handle, r.followers, r.influence, r.total_posts, r.avg_engagement) for r in rows]
    assert got == [("@bo", 50, 0.75, 1, 2.0), ("@A", 100, 0.7, 2, 0.5)]


def test_influencers_without_authors(make_posts):
    posts = make_posts({"text": "@bob @al"}, {"text": "@bob"}, {"text": "x"})
    posts = posts.withColumn("mentions", tx.mentions(F.col("text")))
    rows = influence.detect_influencers(posts).orderBy("rank").collect()
    assert [(r.handle, r.influence, r.total_posts) for r in rows] == [("@bob", 1.0, 2), ("@al", 0.5, 1)]
    assert influence.detect_influencers(posts.filter("post_id = 2")).count() == 0


def test_network_by_hand(make_posts):
    posts = make_posts({"text": "@aa @bb"}, {"user_handle": "@AA", "text": "@aa @bb"}, {"user_handle": "@"})
    posts = posts.withColumn("mentions", tx.mentions(F.col("text")))
    activity = {r.handle: r.activity for r in network.node_activity(posts).collect()}
    assert activity == {"aa": 3, "bb": 2}
    nodes, edges = network.interaction_network(posts)
    records = {r.handle: (r.id, r.size, r.group) for r in nodes.collect()}
    assert records == {"@aa": ("1", 5, "user"), "@bb": ("2", 3, "user")}
    assert [(r.source, r.target, r.weight) for r in edges.collect()] == [("1", "2", 3)]
    single = network.edges_among(posts, network.top_nodes(posts), double_count=False)
    assert [(r.src, r.dst, r.weight) for r in single.collect()] == [("aa", "bb", 2)]


def test_degree_sum_is_twice_the_weight(spark, sf):
    posts = sample_posts(spark, sf).withColumn("mentions", tx.mentions(F.col("text")))
    edges = network.mention_edges(posts)
    total = edges.agg(F.sum("weight")).first()[0]
    assert network.weighted_degree(edges).agg(F.sum("degree")).first()[0] == 2 * total


def graph_frames(spark, nodes, edges):
    return (
        spark.createDataFrame([(n,) for n in nodes], "id string"),
        spark.createDataFrame(edges, "source string, target string"),
    )


def test_graph_metrics_by_hand(spark):
    nodes, edges = graph_frames(
        spark, "abcd", [("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("b", "b")]
    )
    assert tuple(graph.graph_metrics(nodes, edges).first()) == (0.5, 0.75, 2)
    assert tuple(graph.graph_metrics(nodes, edges.limit(0)).first()) == (0.0, 0.0, 0)


def test_graph_against_plain_python(spark):
    rng = random.Random(5)
    nodes = [f"n{i:03d}" for i in range(120)]
    edges = [tuple(rng.sample(nodes, 2)) for _ in range(90)]
    edges += [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60, 110)]  # a long path
    edges += [("n000", n) for n in nodes[1:25]]  # a hub
    near_to = {n: set() for n in nodes}
    for a, b in edges:
        near_to[a].add(b)
        near_to[b].add(a)
    label, triangle = {}, {}
    for n in nodes:
        if n not in label:
            todo = [n]
            while todo:
                x = todo.pop()
                if x not in label:
                    label[x] = n
                    todo += near_to[x]
        links = sum(1 for a in near_to[n] for b in near_to[n] if a < b and b in near_to[a])
        if links:
            triangle[n] = links
    frames = graph_frames(spark, nodes, edges)
    pairs = graph.simple_edges(frames[1])
    got = {r.id: r.component for r in graph.component_labels(frames[0], pairs).collect()}
    assert got == label
    assert {r.id: r.triangles for r in graph.triangles(pairs).collect()} == triangle


def test_topics_prune_overlaps(spark):
    scores = spark.createDataFrame(
        [("data", 9.0), ("big data", 5.0), ("cloud", 4.0), ("c", 3.0)], "term string, score double"
    )
    rows = topics.top_phrases(scores, n_topics=3).orderBy("rank").collect()
    assert [(r.label, r.weight) for r in rows] == [("data", 100), ("cloud", 44)]


def tfidf_scores(texts, cap):
    words = [re.findall(r"\b\w\w+\b", " ".join(t for t in x.split() if t not in fv.STOP_WORDS)) for x in texts]
    words = [w for w in words if w]
    grams = [Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])]) for w in words]
    cf, df = Counter(), Counter()
    for g in grams:
        cf.update(g)
        df.update(g.keys())
    n = len(grams)
    wanted = max(2, n // 100)
    if max(df.values()) < wanted:
        wanted = 1
    vocabulary = set(sorted((t for t in cf if df[t] >= wanted), key=lambda t: (-cf[t], t))[:cap])
    score = Counter()
    for g in grams:
        v = {t: c * (math.log((1 + n) / (1 + df[t])) + 1) for t, c in g.items() if t in vocabulary}
        length = math.sqrt(sum(x * x for x in v.values()))
        for t, x in v.items():
            score[t] += x / length
    return score


@pytest.mark.parametrize("cap", [2000, 25])
def test_phrase_scores_equal_plain_python(make_posts, cap):
    texts = near_texts(7, 120) + ["single words here"]
    posts = make_posts(*[{"text": t, "lang": "ab"[i % 2]} for i, t in enumerate(texts)])
    documents = topics.topic_documents(posts, F.col("text"), ["lang", "post_id"])
    got = {r.term: r.score for r in topics.phrase_scores(documents, (), cap).collect()}
    assert got == pytest.approx(dict(tfidf_scores(texts, cap)))
    for keys in (("lang",), FewGroups(("lang",), 2)):
        rows = topics.phrase_scores(documents, keys, cap).collect()
        for lang, part in (("a", texts[0::2]), ("b", texts[1::2])):
            got = {r.term: r.score for r in rows if r.lang == lang}
            assert got == pytest.approx(dict(tfidf_scores(part, cap)))


def test_topics_of_one_document(make_posts):
    posts = make_posts({"text": "red blue red"})
    rows = topics.extract_topics(posts, text=F.col("text")).orderBy("rank").collect()
    assert rows[0].label == "red" and rows[0].weight == 100
    assert topics.extract_topics(make_posts({"text": "، ؟"}), text=F.col("text")).count() == 0
    with pytest.raises(ValueError):
        topics.extract_topics(posts, method="other")


def dbscan(vectors, radius, least):
    """Clusters by definition, all pairs: vector id -> smallest core id; outliers are absent."""
    units = {i: np.array(v, float) / np.linalg.norm(v) for i, v in vectors.items()}
    near = {i: [j for j in units if units[i] @ units[j] >= 1 - radius - 1e-9] for i in units}
    core = {i for i in units if len(near[i]) >= least}
    found = {}
    for start in sorted(core):
        waiting = [start] if start not in found else []
        while waiting:
            i = waiting.pop()
            if i not in found:
                found[i] = start
                waiting += [j for j in near[i] if j in core]
    for i in set(units) - core:
        if reached := [j for j in near[i] if j in core]:
            found[i] = found[min(reached, key=lambda j: (-round(float(units[i] @ units[j]), 12), j))]
    return found


@pytest.mark.parametrize("radius, least, block", [(0.05, 4, 16), (0.3, 3, 512)])
def test_density_clusters_equal_brute_force(spark, monkeypatch, radius, least, block):
    """500 vectors: dense groups, a chain between two of them, copies, and stragglers."""
    monkeypatch.setattr(density, "_BLOCK", block)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    vectors = [centres[i % 6] + rng.normal(scale=0.12, size=8) for i in range(330)]
    vectors += [centres[0] * (1 - t) + centres[1] * t for t in np.linspace(0, 1, 40)]
    vectors += [vectors[7]] * 60 + list(rng.normal(size=(70, 8)))
    rows = [(i, "ab"[i % 2], [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(900, "a", None), (901, "a", [0.0] * 8), (902, None, rows[0][2])]
    df = spark.createDataFrame(rows, "post_id long, g string, embedding array<double>")
    want = {}
    for g in "ab":
        own = {i: v for i, key, v in rows if key == g and i < 900}
        want |= dbscan(own, radius, least)
    got = density.density_clusters(df, ("g",), radius, least).collect()
    assert {r.post_id: r.cluster for r in got} == want and 0 < len(want) < 500
    whole = density.density_clusters(df.filter("post_id < 900"), (), radius, least).collect()
    assert {r.post_id: r.cluster for r in whole} == dbscan({i: v for i, _, v in rows if i < 900}, radius, least)
    assert density.density_clusters(df.limit(0), ("g",)).count() == 0


def test_density_sends_a_vector_to_no_more_blocks_than_its_group_has(spark, monkeypatch):
    """A radius that rules out no cell: 400 vectors in two groups, blocks of 100, so two cells."""
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(400, 6))
    rows = [(i, "ab"[i % 2], [float(x) for x in v]) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "post_id long, g string, embedding array<double>")
    placed, seen = density._placed, []
    monkeypatch.setattr(density, "_BLOCK", 100)
    monkeypatch.setattr(density, "_CHUNK", 7)
    monkeypatch.setattr(density, "_VISITING", 300)
    monkeypatch.setattr(density, "_placed", lambda p, pivots, r: seen.append(len(pivots)) or placed(p, pivots, r))
    got = density.density_clusters(df, ("g",), 0.9, 5).collect()
    assert seen == [2]
    want = {}
    for g in "ab":
        want |= dbscan({i: v for i, key, v in rows if key == g}, 0.9, 5)
    assert {r.post_id: r.cluster for r in got} == want


def test_class_terms_read_their_texts_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def noted(text):
        read.add(1)
        return text

    rows = [(i % 3, f"sun{i % 2} beach trip") for i in range(30)]
    found = spark.createDataFrame(rows, "cluster long, text string").select("cluster", noted("text").alias("document"))
    assert topics.class_terms(found).count() == 12
    assert read.value == 30


def test_density_topics_leave_outliers_out(make_posts, spark):
    texts = ["apple fruit"] * 6 + ["engine motor"] * 4 + ["lonely words"]
    vectors = [[1.0, 0.01 * i, 0.0] for i in range(6)] + [[0.0, 1.0, 0.01 * i] for i in range(4)] + [[0.0, -1.0, -1.0]]
    data = [(i, v) for i, v in enumerate(vectors)]
    posts = make_posts(*[{"text": t, "lang": "en"} for t in texts]).join(
        spark.createDataFrame(data, "post_id long, embedding array<double>"), "post_id"
    )
    found = topics.extract_topics(
        posts, ("lang",), 5, "density", text=F.col("text"), radius=0.1, min_neighbours=3
    )
    got = [(r.lang, r["rank"], r.label, r.weight) for r in found.orderBy("rank").collect()]
    assert got == [("en", 1, "apple fruit", 100), ("en", 2, "engine motor", 67)]


def test_cluster_topics(spark, make_posts):
    rows = [{"text": f"{'sun beach' if i % 3 else 'snow ski'} trip {i}"} for i in range(120)]
    posts = make_posts(*rows).withColumn(
        "embedding", F.when(F.col("post_id") % 3 > 0, F.array(F.lit(1.0), F.lit(0.0))).otherwise(
            F.array(F.lit(0.0), F.lit(1.0))
        )
    )
    found = topics.extract_topics(posts, n_topics=2, method="cluster", text=F.col("text")).orderBy("rank")
    rows = found.collect()
    assert [r.weight for r in rows] == [100, 50]
    assert "snow" in rows[1].label or "ski" in rows[1].label
    partly = posts.withColumn("embedding", F.when(F.col("post_id") < 60, F.col("embedding")))
    again = topics.extract_topics(partly, n_topics=2, method="cluster", text=F.col("text"))
    assert [r.weight for r in again.orderBy("rank").collect()] == [100, 50]
    few = topics.extract_topics(posts.limit(5), n_topics=2, method="cluster", text=F.col("text"))
    assert few.count() > 0


def test_top_k_slices_large_k(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("g"), F.col("id").alias("v"))
    best = top_k(df, ["g"], [F.desc("v")], 1500, spread_by="v")
    assert best.count() == 3000 and best.filter("g = 0").agg(F.min("v")).first()[0] == 4998 - 2 * 1499


def test_model_sentiment(make_posts):
    posts = make_posts({"text": "great"}, {"text": "bad"}, {"text": "plain"})

    def good():
        return lambda texts: [("LABEL_2" if t == "bad" else "neg", 0.9) for t in texts]

    def broken():
        raise RuntimeError("no model")

    def fails_once():
        def predict(texts):
            if "bad" in list(texts):
                raise RuntimeError("no answer")
            return [("pos", 0.9) for _ in texts]

        return predict

    def run(make):
        scored = sentiment.with_model_sentiment(posts, make, F.col("text"), batch_size=1, staged=stage)
        return [r.sentiment for r in scored.orderBy("post_id").collect()]

    assert run(good) == ["negative", "positive", "negative"]
    assert run(broken) == run(fails_once) == ["positive", "negative", "neutral"]


def test_model_runs_once_a_row_and_failures_are_named(make_posts, tmp_path):
    posts = make_posts(*[{"text": f"text number {i}"} for i in range(40)])
    calls = str(tmp_path)

    def make(bad):
        def predict(texts):
            for _ in texts:
                tempfile.NamedTemporaryFile(dir=calls, delete=False).close()
            if bad and any(t.endswith(" 7") for t in texts):
                raise ValueError("number seven")
            return [("positive", 0.5)] * (len(texts) - (bad is None))

        return lambda: predict

    def scored(bad):
        rows = sentiment.with_model_sentiment(posts, make(bad), F.col("text"), batch_size=4).collect()
        return {r.sentiment for r in rows}, {r.model_error for r in rows}

    assert scored(False) == ({"positive"}, {None})
    assert len(list(tmp_path.iterdir())) == 40
    assert scored(True) == ({"neutral"}, {"ValueError: number seven"})
    assert len(list(tmp_path.iterdir())) == 80
    (reason,) = scored(None)[1]
    assert "answers to" in reason


def test_shares_and_timeline_add_up(spark, sf):
    scored = sentiment.with_lexicon_sentiment(clean.valid_posts(clean.clean_posts(sample_posts(spark, sf))))
    shares = sentiment.sentiment_shares(scored).first()
    assert sum(shares) == pytest.approx(100, abs=0.03)
    dated = scored.filter(F.try_to_date("created_at").isNotNull()).count()
    days = sentiment.sentiment_timeline(scored)
    assert days.select(F.sum(F.col("positive") + F.col("neutral") + F.col("negative"))).first()[0] == dated


def test_partition_count_does_not_matter(spark, sf):
    """The same answers with 1 and 13 shuffle partitions."""
    posts = sample_posts(spark, sf).withColumn("mentions", tx.mentions(F.col("text")))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    try:
        for n in (1, 13):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append(
                (
                    sorted(map(tuple, influence.detect_influencers(posts, ("lang",)).collect())),
                    sorted(map(tuple, topics.extract_topics(posts, text=F.col("text")).collect())),
                    ids(dedup.dedup_exact(posts)),
                )
            )
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]


def test_staging_without_a_named_folder(spark, monkeypatch):
    monkeypatch.setattr(staging, "_DIR", "spark.nabd.not.set")
    root = staging_root(spark)
    assert root.startswith(tempfile.gettempdir()) and staging_root(spark) == root
    assert stage(spark.range(3)).count() == 3

    class Cluster:
        conf = spark.conf
        sparkContext = type("Context", (), {"master": "yarn"})

    with pytest.raises(ValueError):
        staging_root(Cluster())


def test_staging(spark):
    assert staging_root(spark)
    df = stage(spark.range(5), "test")
    assert df.count() == 5
    release(df)
    assert stage(spark.range(0), "empty").count() == 0


def test_near_duplicates_release_what_the_rounds_do_not_read(make_posts, spark, monkeypatch):
    staged, open_tables, seen = near.stage, [], []
    freed, decided = near.release, near._decided

    def stage(df, name="stage"):
        open_tables.append(name)
        return staged(df, name)

    def release(df):
        for name in {f.split("/nabd-")[1].split("/")[0].rsplit("-", 1)[0] for f in df.inputFiles()}:
            open_tables.remove(name)
        freed(df)

    def rounds(*args):
        seen.extend(open_tables)
        return decided(*args)

    for name, f in (("stage", stage), ("release", release), ("_decided", rounds)):
        monkeypatch.setattr(near, name, f)
    rows = [{"text": t} for t in ("one two three", "one two three", "one, two three", "four five six", "!", "x y")]
    got = {r.post_id for r in near.dedup_near(make_posts(*rows)).collect()}
    assert got == {0, 3, 4, 5}
    assert not {"near_texts", "near_distinct", "near_vectors"} & set(seen) and "vectors" in seen
    assert "heads" not in open_tables


def test_words_of_any_length_are_found_without_moving_texts(spark, make_posts):
    """Keywords that share their first characters are told apart by all of them, not by the texts."""
    texts = ["", None, "1234567", "x 12345 12346y", "😀ab", "?ab", "ab😀", "the then theng\nthe", "a" * 40]
    texts += ["0123456789abcdefghij", "0123456789abcdefghi", "b0123456789abcdef", "мир " + chr(0x4E10) + chr(0x4E11) * 3]
    posts = make_posts(*[{"text": t} for t in texts]).unionByName(make_posts({"text": "the"}).withColumn("post_id", F.lit(None).cast("long")))
    words = ["1", "12", "123", "1234", "12345", "12346", "12347", "?ab", "😀", "😀a", "ab😀", "b😀", "the", "then", "thenx"]
    words += ["a" * n for n in (1, 2, 3, 4, 15, 16)] + ["0123456789abcdef", "\nthe", "n t", "ми", "мир"]
    many = [chr(0x4E00 + i) + tail for i in range(300) for tail in ("", chr(0x4E11), chr(0x4E11) * 2)]
    longer = ["0123456789abcdefghij", "0123456789abcdefgxxx", "a" * 17, "a" * 41]
    for chosen in (words, words + many, words + longer, longer, ["1"], ["12"], []):
        found = match.post_words(posts, spark.createDataFrame([(w,) for w in chosen], "k string"))
        moved = "Contains(" in found._jdf.queryExecution().toString()
        assert moved == any(len(w) > 16 for w in chosen)
        got = {r.post_id: r["_words"] for r in found.collect()}
        assert got.pop(None) == []
        assert got == {i: sorted(w for w in chosen if w in (t or "")) for i, t in enumerate(texts)}


@pytest.mark.parametrize("slots", [64, topics.SLOTS])
def test_likely_terms_give_the_vocabulary_of_all_terms(spark, make_posts, monkeypatch, slots):
    """However many terms share a slot; with small groups, groups that share no term, and nulls."""
    monkeypatch.setattr(topics, "SLOTS", max(slots, 1024))
    if slots < 1024:
        plain = topics._slot
        monkeypatch.setattr(topics, "_slot", lambda *a: F.pmod(plain(*a), F.lit(slots)))
    texts = near_texts(3, 300)
    rows = [{"text": t, "lang": "ab"[i % 2]} for i, t in enumerate(texts)]
    rows += [{"text": f"lone{i} word{i}", "lang": "c"} for i in range(3)]
    rows += [{"text": "alone here alone", "lang": "d"}, {"text": "no language here"}, {"text": "x"}]
    posts = make_posts(*rows)
    documents = topics.topic_documents(posts, F.col("text"), ["lang", "post_id"])
    full = topics.with_terms(documents)
    for keys in ((), ("lang",), FewGroups(("lang",), 4)):
        likely, found = topics.frequent_terms(documents, keys)
        order = [*keys, "term"]
        expected = topics.vocabulary(full, keys).select(*order, "df", "cf", "n")
        got = found.select(*expected.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))
        scores = (topics.phrase_scores(d, keys).select(*order, "score").collect() for d in (documents, full))
        new, old = ({tuple(r)[:-1]: r.score for r in s} for s in scores)
        assert new == pytest.approx(old)
    counted = [d.select(F.sum(F.size("terms"))).first()[0] for d in (topics.frequent_terms(documents)[0], full)]
    assert counted[0] < counted[1] or slots == 64


def test_terms_of_groups_that_share_rows(spark, make_posts):
    """A set of rows serves a large request and a small one, whose terms have a lower limit."""
    texts = near_texts(5, 260) + ["rare one", "rare two", "odd three"]
    posts = make_posts(*[{"text": t} for t in texts])
    set_id = F.when(F.col("post_id") < 260, "big").when(F.col("post_id") < 262, "pair").otherwise("last")
    documents = topics.topic_documents(posts.withColumn("set_id", set_id), F.col("text"), ["set_id", "post_id"])
    sets = [("big", "all"), ("pair", "all"), ("last", "all"), ("pair", "two"), ("last", "one"), ("pair", "few"), ("last", "few")]
    members = spark.createDataFrame(sets, "set_id string, request_id string")
    keys = SharedRows(("request_id",), 4, members)
    rows = topics.phrase_scores(documents, keys).collect()
    for request in ("all", "two", "one", "few"):
        held = {s for s, r in sets if r == request}
        alone = documents.filter(F.col("set_id").isin(*held)).drop("set_id")
        expected = {r.term: r.score for r in topics.phrase_scores(topics.with_terms(alone)).collect()}
        assert {r.term: r.score for r in rows if r.request_id == request} == pytest.approx(expected)


def test_terms_are_counted_over_all_documents_once(make_posts, monkeypatch):
    counts, counted = [], topics.term_statistics
    monkeypatch.setattr(topics, "term_statistics", lambda *a: counts.append(1) or counted(*a))
    staged, stage_ = [], topics.stage
    monkeypatch.setattr(topics, "stage", lambda df, name="stage": staged.append((name, df.columns)) or stage_(df, name))
    posts = make_posts(*[{"text": t} for t in near_texts(9, 60)])
    assert topics.extract_topics(posts, text=F.col("text")).count() > 0
    assert counts == [1] and ("documents", ["post_id", "words"]) in staged
