"""Readers, catalog, caps, control tables."""

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from nabd.sources import catalog, control, readers, sample
from nabd.sources.catalog import CATALOG, Dataset

FIELDS = {"text": "tweet", "likes": "fav", "user_id": "uid", "lang": "lg", "label": "y"}


def meta(path, kind, **more):
    return Dataset(id="d", path=str(path), file_format=kind, fields=FIELDS, **more)


def rows(df, *names):
    return [tuple(r) for r in df.select(*names).collect()]


def test_csv_quotes_newlines_gzip_and_bad_bytes(spark, tmp_path):
    body = (
        'tweet,fav,uid,y\n"one, ""two""\nthree",5,u1,1\n  ,7,u2,0\n padded ,x,,\n'
    ).encode() + b"bad \xff byte,3.7,u3,1\n"
    plain, packed = tmp_path / "a.csv", tmp_path / "a.csv.gz"
    plain.write_bytes(body)
    packed.write_bytes(gzip.compress(body))
    want = [
        ('one, "two"\nthree', 5, "u1", "ar", "1", "d"),
        ("padded", 0, None, "ar", None, "d"),
        ("bad � byte", 0, "u3", "ar", "1", "d"),
    ]
    for path in (plain, packed):
        posts = readers.read_dataset(spark, meta(path, "csv"))
        assert rows(posts, "text", "likes", "user_id", "lang", "label", "source_dataset") == want


def test_csv_without_line_breaks_can_be_split(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("tweet,fav\nhello,1\nthere,2\n")
    posts = readers.read_dataset(spark, meta(path, "csv"), multiline=False)
    assert rows(posts, "text", "likes") == [("hello", 1), ("there", 2)]


def test_jsonl_lines(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    lines = [
        json.dumps({"tweet": " hi ", "fav": 5.9, "uid": 7, "lg": "en", "y": 1}),
        "",
        '{"tweet": "cut',
        json.dumps({"tweet": "text", "fav": "5.9", "lg": None}),
        json.dumps({"tweet": 5}),
        json.dumps([1, 2]),
        json.dumps({"tweet": "big", "fav": 9_000_000_000, "y": "a"}),
        json.dumps({"tweet": "last without newline", "fav": " 12 "}),
    ]
    path.write_text("\n".join(lines))
    posts = readers.read_dataset(spark, meta(path, "jsonl"))
    assert rows(posts, "text", "likes", "user_id", "lang", "label") == [
        ("hi", 5, "7", "en", "1"),
        ("text", 0, None, None, None),
        ("big", 9_000_000_000, None, "ar", "a"),
        ("last without newline", 12, None, "ar", None),
    ]


def test_parquet_types(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.sql("SELECT ' a ' AS tweet, 3.9D AS fav, 12L AS uid, 1 AS y").write.parquet(path)
    posts = readers.read_dataset(spark, meta(path, "parquet"))
    assert rows(posts, "text", "likes", "user_id", "label") == [("a", 3, "12", "1")]
    number = spark.sql("SELECT 5 AS tweet")
    assert readers.to_canonical(number, meta(path, "parquet")).count() == 0


def test_pushdown_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.sql("SELECT 'a' AS tweet, 1 AS fav, 2 AS unused").write.parquet(path)
    posts = readers.read_dataset(spark, meta(path, "parquet")).select("text")
    plan = posts._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<tweet:string>" in plan


def test_unknown_format_and_missing_path(spark):
    with pytest.raises(ValueError):
        readers.read_dataset(spark, meta("x", "xml"))
    with pytest.raises(ValueError):
        readers.read_dataset(spark, Dataset(id="d"))


def test_union_skips_what_it_cannot_read(spark, tmp_path):
    files = []
    for name, n in (("a", 4), ("b", 3)):
        path = str(tmp_path / name)
        spark.range(n).selectExpr(f"concat('{name}', id) AS text").coalesce(1).write.parquet(path)
        files.append(Dataset(id=name, path=path, file_format="parquet"))
    files.insert(1, Dataset(id="gone", path=str(tmp_path / "none"), file_format="parquet"))
    skipped = []
    merged = readers.union_datasets(spark, files, ["b", "gone", "nope", "a"], skipped=skipped)
    ordered = [r.text for r in merged.orderBy("post_id").collect()]
    assert ordered == ["b0", "b1", "b2", "a0", "a1", "a2", "a3"]
    assert [s[0] for s in skipped] == ["gone"]

    def capped(total, each):
        df = readers.union_datasets(spark, files, ["b", "a"], total, each)
        return [r.text for r in df.orderBy("post_id").collect()]

    assert capped(5, None) == ["b0", "b1", "b2", "a0", "a1"]
    assert capped(None, 2) == ["b0", "b1", "a0", "a1"]
    assert capped(3, 2) == ["b0", "b1", "a0"]
    assert capped(0, 0) == ordered
    with pytest.raises(ValueError):
        readers.union_datasets(spark, files, ["nope"])


def test_catalog(spark):
    assert [d.id for d in catalog.resolve(CATALOG)] == ["ajgt", "arabic_sentiment_corpus", "metooma"]
    assert [d.id for d in catalog.resolve(CATALOG, ["x", "brad"])] == ["brad"]
    with pytest.raises(ValueError):
        catalog.resolve(CATALOG, ["x"])
    assert catalog.find(CATALOG, "oclar").fields == {"text": "pred_0", "label": "pred_1"}
    frame = catalog.catalog_frame(spark)
    assert frame.agg(F.sum("size_estimate_rows")).first()[0] == 1_206_700
    reviews = catalog.list_datasets(frame, domain="reviews", source="huggingface")
    assert {r.id for r in reviews.collect()} == {"hard", "labr", "oclar", "brad"}
    assert catalog.list_datasets(frame, only_with_timestamp=True).count() == 0
    assert catalog.list_datasets(frame, only_with_user_metadata=True).count() == 0
    asked = spark.createDataFrame([("brad",), ("x",)], "id string")
    assert [r.id for r in catalog.known_ids(asked, frame).collect()] == ["brad"]
    assert [r.id for r in catalog.unknown_ids(asked, frame).collect()] == ["x"]
    with pytest.raises(ValueError):
        Dataset(id="d", domain="sports")


def test_spread_leaves_large_inputs_alone(spark):
    small = spark.range(10)
    assert readers.spread(small.coalesce(1)).rdd.getNumPartitions() > 1
    large = spark.range(1 << 40)
    assert readers.spread(large) is large


def test_status_log(spark):
    changes = spark.createDataFrame(
        [("a", "collecting", 10, None), ("b", "completed", 50, None)],
        "request_id string, status string, progress int, error_message string",
    )
    events = control.status_event(changes)
    got = {r.request_id: r for r in events.collect()}
    assert got["b"].progress == 100 and got["b"].completed_at == got["b"].updated_at
    assert got["a"].completed_at is None
    log = spark.createDataFrame(
        [("a", "collecting", 10, "slow", 1), ("a", "analyzing", 35, None, 2)],
        "request_id string, status string, progress int, error_message string, t int",
    ).select("*", F.timestamp_seconds("t").alias("updated_at"), F.lit(None).cast("timestamp").alias("completed_at"))
    now = control.current_status(log).first()
    assert (now.status, now.progress, now.error_message) == ("analyzing", 35, "slow")


def test_csv_folder_with_other_column_order_fails(spark, tmp_path):
    (tmp_path / "a.csv").write_text("review,author\nhello,u1\n")
    (tmp_path / "b.csv").write_text("author,review\nu2,world\n")
    with pytest.raises(Exception, match="(?i)header"):
        readers.read_csv(spark, str(tmp_path)).collect()


def test_unreadable_dataset_raises_unless_skipping_is_asked_for(spark, tmp_path):
    gone = [d.at(str(tmp_path / "none"), "parquet") for d in CATALOG[:1]]
    with pytest.raises(Exception, match="(?i)path"):
        readers.union_datasets(spark, gone, [gone[0].id])
    skipped = []
    assert readers.union_datasets(spark, gone, [gone[0].id], skipped=skipped).count() == 0
    assert [name for name, _ in skipped] == [gone[0].id]


@pytest.mark.parametrize("total, each", [(None, 37), (150, None), (100, 45), (1, None), (10_000, 10_000)])
def test_caps_take_the_smallest_ids(spark, monkeypatch, total, each):
    """Ids as input splits number them: dense within a split, far apart between splits."""
    monkeypatch.setattr(readers, "_RANGES", 8)
    rng = random.Random(3)
    rows = [(split << 33 | i, rng.choice("abc")) for split in (0, 1, 5, 900) for i in range(60)]
    posts = spark.createDataFrame([(i, s, "x") for i, s in rows] + [(-1, None, "y")], "post_id long, source_dataset string, text string")
    left, want = total or 10**9, []
    for name in "bca":
        own = sorted(i for i, s in rows if s == name)[: min(left, each or 10**9)]
        left -= len(own)
        want += own
    got = readers.capped(posts, ["b", "c", "a"], total, each)
    assert sorted(r.post_id for r in got.collect()) == sorted(want)
    executed = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in executed and "Exchange hashpartitioning" not in executed


def test_sample_posts_move_a_text_once(spark, tmp_path):
    tables = {
        "documents": (
            "doc_id long, text string, lang string, source string, n_chars long",
            [(i, f"text {i}", "en", "src1", 10 + i) for i in (0, 1, 1, 2, 3, 4)] + [(None, "no id", "fr", None, None)],
        ),
        "events": (
            "event_id long, ts timestamp, user_id long, value double",
            [(0, None, 7, 1.5), (5, None, 7, 2.5), (5, None, 8, None), (6, None, 9, 1.0), (15, None, None, 3.5)]
            + [(-5, None, 7, 1.0), (None, None, 7, 4.0)],
        ),
        "customer": ("c_custkey long, c_acctbal double", [(7, 20.7), (7, -1.0), (9, 5.0), (None, 6.0)]),
        "labels": ("doc_id long, quality int", [(1, 1), (1, 0), (2, None), (4, 1), (9, 1), (None, 0)]),
    }
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        posts = sample.sample_posts(spark, str(tmp_path))
        nodes, joins = [posts._jdf.queryExecution().sparkPlan()], []
        while nodes:
            node = nodes.pop()
            nodes += [node.children().apply(i) for i in range(node.children().size())]
            if "Join" in node.nodeName():
                joins.append("text#" in node.output().toString())
        plain = spark.sql(
            sample.POSTS_SQL, **{name: sample.table(spark, str(tmp_path), name) for name in sample.TABLES}
        )
        assert sorted(map(str, posts.collect())) == sorted(map(str, plain.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert len(joins) == 3 and sum(joins) == 1
