"""The whole analysis, its plans, and the streaming jobs."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from nabd import fixed_values as fv
from nabd.functions import text as tx
from nabd.functions.dates import post_day
from nabd.operators import dedup, match, network, stats, topics
from nabd.operators.clean import clean_posts, valid_posts
from nabd.operators.report import join_topics, recommendations, summary
from nabd.operators.sentiment import sentiment_timeline, with_lexicon_sentiment
from nabd.plans import staging
from nabd.plans.analysis import analyze, completed_results, enriched_posts
from nabd.plans.staging import stage
from nabd.schema import EDGES, INFLUENCERS, NODES, POST, REQUEST, TIMELINE, TOPICS
from nabd.sources import control, versioned
from nabd.sources.sample import sample_posts, sample_requests
from nabd.streaming import jobs


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def report_row(spark, **values):
    base = {
        "total_posts": 50, "total_users": 1234, "sentiment_positive": 0.0, "sentiment_neutral": 60.0,
        "sentiment_negative": 40.0, "keywords": [], "top_topics": [], "top_influencers": [],
        "sentiment_timeline": [],
    } | values
    kinds = (
        "total_posts bigint, total_users bigint, sentiment_positive double, sentiment_neutral double, "
        "sentiment_negative double, keywords array<string>, "
        f"top_topics {TOPICS}, top_influencers {INFLUENCERS}, sentiment_timeline {TIMELINE}"
    )
    order = [k.split()[0] for k in kinds.replace("array<struct<", "").split(", ")]
    df = spark.createDataFrame([tuple(base[c] for c in order)], kinds)
    return df.select(summary().alias("s"), recommendations().alias("r")).first()


def test_report_texts(spark):
    row = report_row(spark)
    assert row.r == [fv.ADVICE_FEW_POSTS, fv.ADVICE_NEGATIVE.format(neg="40.0", topic=fv.ADVICE_MAIN_TOPIC)]
    assert row.s == (
        fv.SUMMARY_COUNTS.format(posts="50", keywords=fv.SUMMARY_NO_KEYWORDS, users="1,234")
        + " "
        + fv.SUMMARY_TONE.format(tone=fv.TONE_NAMES["neutral"], pos="0.0", neg="40.0", neu="60.0")
    )
    assert report_row(spark, total_posts=0).s == fv.SUMMARY_EMPTY
    calm = report_row(spark, total_posts=100, sentiment_negative=35.0, sentiment_positive=60.0)
    assert calm.r == [fv.ADVICE_DEFAULT]
    full = report_row(
        spark,
        total_posts=12345,
        sentiment_positive=60.25,
        sentiment_neutral=30.0,
        sentiment_negative=9.75,
        keywords=["a", "b", "c", "d", "e", "f"],
        top_topics=[("x", 100), ("y", 50), ("z", 10)],
        top_influencers=[("@a", 1, 0.125, 1, 0.0), ("@b", 1, 0.1, 1, 0.0)],
        sentiment_timeline=[("2024-01-0%d" % i, 1, 0, 0) for i in (1, 2, 3)],
    )
    assert '"a"، "b"، "c"، "d"، "e"' in full.s and '"f"' not in full.s
    assert "12,345" in full.s and "60.2%" in full.s and "9.8%" in full.s and "0.12." in full.s
    assert "x، y وz." in full.s
    assert full.r == [
        fv.ADVICE_POSITIVE.format(pos="60.2"),
        fv.ADVICE_INFLUENCERS.format(handles="@a، @b"),
        fv.ADVICE_FOCUS.format(topics="x, y, z"),
        fv.ADVICE_TREND,
    ]


def test_topic_list(spark):
    df = spark.createDataFrame([([],), (["a"],), (["a", "b"],), (list("abcdef"),)], "l array<string>")
    got = [r[0] for r in df.select(join_topics(F.col("l"))).collect()]
    assert got == ["", "a", "a وb", "a، b، c، d وe"]


@pytest.fixture(scope="module")
def results(spark, sf):
    return {r.request_id: r for r in analyze(sample_posts(spark, sf), sample_requests(spark)).collect()}


def test_every_request_gets_a_row(results):
    assert sorted(results) == ["r1", "r2", "r3", "r4", "r5", "r6"]
    none = results["r4"]
    assert none.status == "failed" and none.total_posts == 0 and none.summary == fv.SUMMARY_EMPTY
    assert none.top_topics == [] and none.network_nodes == [] and none.datasets_used == {}
    assert none.error_message == fv.ERROR_TOO_FEW.format(posts=0, minimum=20)
    good = results["r2"]
    assert good.status == "completed" and good.error_message is None
    assert sum(good.datasets_used.values()) == good.total_posts
    assert len(good.top_topics) == 8 and good.top_topics[0].weight == 100
    assert [n.id for n in good.network_nodes] == [str(i + 1) for i in range(len(good.network_nodes))]


def test_one_request_alone_gives_the_same_row(spark, sf, results):
    alone = analyze(sample_posts(spark, sf), sample_requests(spark).filter("request_id = 'r2'")).first()
    assert alone == results["r2"]


def test_failures_name_their_reason(spark, make_posts):
    posts = make_posts({"text": "no arabic here", "source_dataset": "x"})
    requests = spark.createDataFrame(
        [
            ("missing", None, ["gone"], None),
            ("invalid", None, ["x"], None),
            ("invalid_all", ["q"], None, None),
            ("dates", None, None, "soon"),
        ],
        "request_id string, keywords array<string>, dataset_ids array<string>, date_from string",
    )
    got = {r.request_id: r.error_message for r in analyze(posts, requests).collect()}
    assert got["missing"] == fv.ERROR_NO_ROWS
    assert got["invalid"] == got["invalid_all"] == fv.ERROR_NO_VALID_ROWS
    assert got["dates"].startswith(fv.ERROR_PREFIX)
    empty = {r.request_id: r.error_message for r in analyze(posts.limit(0), requests).collect()}
    assert empty["invalid_all"] == empty["invalid"] == fv.ERROR_NO_ROWS


def test_selection_runs_in_the_jvm_and_filters_below_dedup(spark, sf):
    posts = sample_posts(spark, sf)
    chosen = match.full_filter(posts, ["the"], "2024-01-01", "2024-01-20")
    text = plan(stats.overall_stats(chosen))
    assert "Python" not in text and "CartesianProduct" not in text
    lines = text.splitlines()
    dedup_depth = next(i for i, x in enumerate(lines) if "functions=[min(post_id" in x)
    assert any("Contains(" in x for x in lines[dedup_depth:])
    for df in (
        network.node_activity(posts.withColumn("mentions", tx.mentions(F.col("text")))),
        dedup.dedup_by_hash(posts),
        match.match_requests(posts, match.prepare_requests(sample_requests(spark))),
    ):
        assert "Python" not in plan(df)
        assert "CartesianProduct" not in plan(df) and "NestedLoop" not in plan(df)


def test_dedup_shuffles_only_keys_before_the_join(spark, sf):
    text = plan(dedup.dedup_by_hash(sample_posts(spark, sf)))
    assert "HashAggregate(keys=[_key" in text and "SortAggregate" not in text


def test_ranked_limits_cut_before_the_shuffle(spark, sf):
    posts = sample_posts(spark, sf).withColumn("mentions", tx.mentions(F.col("text")))
    assert "WindowGroupLimit" in plan(network.top_nodes(posts, ("lang",)))
    assert "TakeOrderedAndProject" in plan(network.top_nodes(posts))


def test_topic_vocabulary_is_broadcast(spark, sf):
    documents = topics.topic_documents(sample_posts(spark, sf), F.col("text"), ["post_id"])
    vocab = topics.vocabulary(documents)
    assert "BroadcastHashJoin" in plan(topics.term_weights(documents, vocab))


def test_results_table_replaces_by_request(spark, tmp_path):
    path = str(tmp_path / "results")
    first = spark.createDataFrame([("a", 1), ("b", 1)], "request_id string, n int")
    control.save_results(first, path)
    control.save_results(first.filter("request_id = 'a'").withColumn("n", F.lit(2)), path)
    got = {(r.request_id, r.n) for r in control.read_results(spark, path, first.schema).collect()}
    assert got == {("a", 2), ("b", 1)}


def test_versioned_tables(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "table")
    schema = "k string, n int"
    assert versioned.read(spark, path, schema).count() == 0
    many = spark.range(100_000).select(F.concat(F.lit("r"), "id").alias("k"), F.lit(1).alias("n"))
    versioned.upsert(many, path, "k")
    files = list(Path(path).glob("v-*/*/*.parquet"))
    assert len(files) == versioned.BUCKETS and versioned.read(spark, path, schema).count() == 100_000

    before = versioned.read(spark, path, schema)  # a reader that began before the next change
    change = spark.createDataFrame([("r5", 2), ("new", 2), (None, 2)], schema)
    versioned.upsert(change, path, "k")
    versioned.upsert(change, path, "k")
    assert before.filter("n = 2").count() == 0 and before.count() == 100_000
    after = versioned.read(spark, path, schema)
    assert after.count() == 100_001 and {r.k for r in after.filter("n = 2").collect()} == {"r5", "new"}

    def fails(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:  # the files are written, the commit is not
        m.setattr(versioned, "_commit", fails)
        with pytest.raises(OSError):
            versioned.upsert(spark.createDataFrame([("r6", 3)], schema), path, "k")
    assert versioned.read(spark, path, schema).filter("n = 3").count() == 0
    with pytest.raises(RuntimeError):  # a second writer that began with the same version
        versioned._commit(spark, path, 2, {})
    monkeypatch.setattr(versioned, "KEPT_VERSIONS", 2)
    versioned.upsert(spark.createDataFrame([("r7", 4)], schema), path, "k")
    assert versioned._versions(spark, path) == [2, 3]
    assert versioned.read(spark, path, schema).count() == 100_001


def test_timeline_is_replaced_day_by_day(spark, sf, tmp_path):
    posts = sample_posts(spark, sf)
    paths = [str(tmp_path / n) for n in ("in", "out", "marks")]
    posts.repartition(3).write.parquet(paths[0])
    daily = jobs.timeline_stream(jobs.read_posts(spark, paths[0], maxFilesPerTrigger="1"))

    def run():
        jobs.write_timeline(daily, paths[1], paths[2], {"availableNow": True}).awaitTermination()
        return jobs.read_timeline(spark, paths[1], daily.schema)

    def batch(rows):
        return sorted(map(tuple, sentiment_timeline(with_lexicon_sentiment(valid_posts(clean_posts(rows)))).collect()))

    first = run()
    assert sorted(map(tuple, first.collect())) == batch(posts)
    posts.filter("post_id < 20").write.mode("append").parquet(paths[0])
    assert sorted(map(tuple, run().collect())) == batch(posts.unionByName(posts.filter("post_id < 20")))
    assert sorted(map(tuple, first.collect())) == batch(posts)  # still readable as it was


def test_request_stream(spark, sf, tmp_path):
    """Requests arrive in two files; results, status, notices and audit rows follow."""
    inbox, out, marks = (str(tmp_path / n) for n in ("inbox", "out", "marks"))
    (tmp_path / "inbox").mkdir()

    def drop(name, *requests):
        lines = [json.dumps({"user_id": "u", "title": "T", "status": "pending"} | r) for r in requests]
        (tmp_path / "inbox" / name).write_text("\n".join(lines))

    def run():
        query = jobs.process_requests(
            spark, sample_posts(spark, sf), inbox, out, marks, {"availableNow": True}
        )
        query.awaitTermination()
        return {r.request_id for r in control.read_results(spark, f"{out}/results", "request_id string").collect()}

    drop("1.json", {"request_id": "q1", "keywords": ["the"]}, {"request_id": "q2", "keywords": ["zzzz"]})
    assert run() == {"q1"}
    drop("2.json", {"request_id": "q3", "keywords": []}, {"request_id": "q4", "status": "completed"})
    assert run() == {"q1", "q3"}
    status = control.current_status(spark.read.parquet(f"{out}/status")).collect()
    assert {(r.request_id, r.status, r.progress) for r in status} == {
        ("q1", "completed", 100), ("q2", "failed", 0), ("q3", "completed", 100),
    }
    seen = {(r.request_id, r.status) for r in spark.read.parquet(f"{out}/status").collect()}
    assert {("q1", "collecting"), ("q1", "analyzing"), ("q1", "completed")} <= seen
    assert spark.read.parquet(f"{out}/notifications").count() == 2
    audit = spark.read.parquet(f"{out}/audit").collect()
    assert sorted(r.action for r in audit) == ["ANALYSIS_COMPLETED"] * 2 + ["ANALYSIS_FAILED"]
    done = json.loads(next(r.metadata for r in audit if r.entity_id == "q1"))
    assert done["total_posts"] > 0 and done["datasets_used"]

    # Sent again: the completed one is answered from the log, the failed one is tried once more.
    drop(
        "3.json",
        {"request_id": "q1", "keywords": ["the"], "created_at": "2024-01-02T00:00:00Z"},
        {"request_id": "q2", "keywords": ["the"], "created_at": "2024-01-01T00:00:00Z"},
        {"request_id": "q2", "keywords": ["zzzz"], "created_at": "2024-01-02T00:00:00Z"},
    )

    def answers():
        rows = spark.read.parquet(f"{out}/admissions").collect()
        return sorted((r.batch_id, r.request_id, r.admission) for r in rows)

    for _ in range(2):
        assert run() == {"q1", "q2", "q3"}
        assert answers() == [
            (0, "q1", "queued"), (0, "q2", "queued"), (1, "q3", "queued"),
            (2, "q1", "already_completed"), (2, "q2", "queued"),
        ]
        assert spark.read.parquet(f"{out}/audit").count() == 4
        assert spark.read.parquet(f"{out}/notifications").count() == 3
        (Path(marks) / "commits" / "2").unlink()  # as if the job had died: the batch is repeated
        (Path(marks) / "commits" / ".2.crc").unlink(missing_ok=True)


def test_result_columns(spark, sf):
    shown = completed_results(analyze(sample_posts(spark, sf), sample_requests(spark)))
    assert shown.columns == [
        "request_id", "total_posts", "total_users", "total_reach", "sentiment_positive",
        "sentiment_neutral", "sentiment_negative", "top_topics", "top_influencers",
        "sentiment_timeline", "network_nodes", "network_edges", "summary", "recommendations",
    ]
    kinds = {f.name: f.dataType.simpleString() for f in shown.schema.fields}
    assert (kinds["top_topics"], kinds["network_nodes"], kinds["network_edges"]) == (TOPICS, NODES, EDGES)
    assert {f.name for f in POST.fields} >= {"post_id", "text"} and "dataset_ids" in REQUEST.names


def test_appended_batch_replaces_itself(spark, tmp_path):
    rows = spark.createDataFrame([("a",), ("b",)], "request_id string")
    for batch_id in (0, 1, 1):
        control.append(rows, f"{tmp_path}/log", batch_id)
    assert spark.read.parquet(f"{tmp_path}/log").count() == 4


def test_scope_deletes_what_it_staged(spark):
    with staging.scope(spark):
        table = staging.stage(spark.range(3).toDF("id"), "scoped")
        (folder,) = {f.rsplit("/", 1)[0].removeprefix("file:").replace("//", "/") for f in table.inputFiles()}
        assert table.count() == 3 and Path(folder).exists()
    assert not Path(folder).exists()


def test_posts_shared_by_many_requests_are_worked_on_once(spark, sf):
    """Three hundred requests for two keywords: posts, term counts and sets stay as few as for two."""
    posts = sample_posts(spark, sf)
    rows = [(f"q{i:03}", ["the"] if i % 2 else ["user_3", "User_3"], None) for i in range(300)]
    rows.append(("none", ["zzzz-none"], None))
    requests = spark.createDataFrame(rows, "request_id string, keywords array<string>, date_from string")
    enriched = enriched_posts(posts, stage(match.prepare_requests(requests), "requests"))
    assert enriched.posts.count() == enriched.posts.select("post_id").distinct().count()
    assert "terms" in enriched.posts.columns and enriched.sets.count() <= 4
    assert enriched.twins.select("twin").distinct().count() == 3
    got = {r.request_id: r.asDict() for r in analyze(posts, requests).collect()}
    assert len(got) == 301
    for i in range(300):
        alike = got[f"q{i:03}"]
        assert {**alike, "request_id": ""} == {**got[f"q00{i % 2}"], "request_id": ""}
    alone = {r.request_id: r.asDict() for r in analyze(posts, requests.filter("request_id in ('q000', 'q001')")).collect()}
    assert alone == {k: got[k] for k in ("q000", "q001")}


def test_user_sketches_merge_to_those_of_the_whole(spark, sf):
    posts = sample_posts(spark, sf)
    daily = stage(stats.daily_user_sketches(posts, ("lang",)), "sketches")
    assert daily.count() == posts.select("lang", post_day(F.col("created_at"))).dropna().distinct().count()
    dated = posts.filter(post_day(F.col("created_at")).isNotNull())
    exact = {r.lang: r.n for r in dated.groupBy("lang").agg(F.countDistinct("user_id").alias("n")).collect()}
    merged = {r.lang: r.users for r in stats.users_between(daily, ("lang",)).collect()}
    whole = dated.groupBy("lang").agg(F.hll_sketch_estimate(stats.user_sketch()[0]).alias("n"))
    assert merged == {r.lang: r.n for r in whole.collect()}
    error = 3 * 1.04 / 2 ** (stats.LOG_BUCKETS / 2)
    assert all(abs(merged[k] - n) <= error * n + 1 for k, n in exact.items())
    early = stats.users_between(daily, ("lang",), last="2024-01-10").collect()
    assert all(r.users <= merged[r.lang] for r in early)
    approximate = stats.overall_stats(posts, ("lang",), approximate=True)
    counted = stats.overall_stats(posts, ("lang",))
    pairs = approximate.select("lang", F.col("total_users").alias("a")).join(counted, "lang").collect()
    assert all(abs(r.a - r.total_users) <= error * r.total_users + 1 for r in pairs)


def test_arriving_posts_are_several_files_a_batch(spark, sf, monkeypatch, tmp_path):
    """Three batches, and none of them the work of a single task."""
    monkeypatch.setattr(entry.staging, "staging_path", lambda _, name: f"{tmp_path}/{name}")
    posts, sink, marks = entry._arriving(spark, sf, "few")
    assert len(list((tmp_path / "few_in").glob("*.parquet"))) == 3 * spark.sparkContext.defaultParallelism
    query = posts.writeStream.format("parquet").option("checkpointLocation", marks)
    query = query.trigger(availableNow=True).start(sink)
    query.awaitTermination()
    assert [p["numInputRows"] > 0 for p in query.recentProgress if p["numInputRows"]] == [True] * 3
    assert spark.read.parquet(sink).count() == entry.sample_posts(spark, sf).count()


def test_phrase_scores_stage_counted_terms(spark, sf, monkeypatch):
    staged, stage = [], entry.staging.stage
    monkeypatch.setattr(entry.staging, "stage", lambda df, name="stage": staged.append(df.columns) or stage(df, name))
    assert entry.phrase_scores(spark, sf).count() > 0
    assert staged == [["post_id", "terms"]]
