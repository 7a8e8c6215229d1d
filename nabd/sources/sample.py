"""Posts and requests derived from the generated test tables, in SQL that two engines share."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nabd.functions.values import with_computed

TABLES = ("documents", "events", "customer", "labels")

POSTS_SQL = """
SELECT d.doc_id AS post_id,
  concat(CASE WHEN d.n_chars % 5 = 0 THEN concat('RT @User_', CAST(d.n_chars * 7 % 40 AS STRING), ': ') ELSE '' END,
         CASE d.n_chars % 4 WHEN 0 THEN 'مَكْتَبَة رائع ' WHEN 1 THEN 'أحمد سيء جدا ' WHEN 2 THEN 'إلى المدينة ٢٠٢٤ ' ELSE '' END,
         d.text,
         CASE WHEN d.n_chars % 3 = 0 THEN concat(' @user_', CAST(d.n_chars * 11 % 40 AS STRING), ' @User_', CAST(d.n_chars * 13 % 40 AS STRING)) ELSE '' END,
         CASE WHEN d.n_chars % 6 = 0 THEN ' #Big_Data!!!! https://ex.com/a?b=1' ELSE '' END) AS text,
  CASE WHEN d.doc_id % 7 = 6 THEN NULL WHEN d.doc_id % 50 = 3 THEN 'n/a' ELSE substring(CAST(e.ts AS STRING), 1, 19) END AS created_at,
  CASE WHEN d.doc_id % 10 = 9 THEN NULL ELSE CAST(e.user_id AS STRING) END AS user_id,
  CASE WHEN d.doc_id % 10 = 9 THEN NULL ELSE concat('@User_', CAST(e.user_id % 40 AS STRING)) END AS user_handle,
  CAST(floor(greatest(coalesce(c.c_acctbal, 0.0), 0.0)) AS BIGINT) AS user_followers,
  CAST(floor(coalesce(e.value, 0.0)) AS BIGINT) AS likes,
  CAST(d.n_chars % 17 AS BIGINT) AS retweets,
  CAST(d.doc_id % 7 AS BIGINT) AS replies,
  d.lang AS lang, CAST(l.quality AS STRING) AS label, d.source AS source_dataset
FROM {documents} d
LEFT JOIN {events} e ON e.event_id = d.doc_id * 5
LEFT JOIN {customer} c ON c.c_custkey = e.user_id
LEFT JOIN {labels} l ON l.doc_id = d.doc_id
"""

# The same rows with a text moved once, by doc_id, behind the joins of the narrow tables: `event_id = doc_id * 5`
# holds for one doc_id, if for any. Events and labels meet by it in an outer join, so rows multiply as above.
_POST_COLUMNS, _FROM, _ = POSTS_SQL.partition("FROM {documents}")
ATTACHED_POSTS_SQL = f"""{_POST_COLUMNS}{_FROM} d
LEFT JOIN (
  SELECT coalesce(e.doc_id, l.doc_id) AS doc_id, struct(e.ts, e.user_id, e.value) AS e,
    struct(c.c_acctbal) AS c, struct(l.quality) AS l
  FROM (SELECT event_id DIV 5 AS doc_id, ts, user_id, value FROM {{events}} WHERE event_id % 5 = 0) e
  LEFT JOIN {{customer}} c ON c.c_custkey = e.user_id
  FULL OUTER JOIN {{labels}} l ON l.doc_id = e.doc_id
) a ON a.doc_id = d.doc_id
"""

# Every event as a post of its user.
EVENT_POSTS_SQL = """
SELECT e.event_id AS post_id, e.event_type AS event_type, CAST(e.ts AS STRING) AS created_at,
  CAST(e.user_id AS STRING) AS user_id,
  CAST(floor(greatest(coalesce(c.c_acctbal, 0.0), 0.0)) AS BIGINT) AS user_followers,
  CAST(floor(coalesce(e.value, 0.0)) AS BIGINT) AS likes,
  CAST(length(e.props) AS BIGINT) AS retweets, CAST(e.event_id % 7 AS BIGINT) AS replies
FROM {events} e LEFT JOIN {customer} c ON c.c_custkey = e.user_id
"""

# request_id, keywords, datasets (by name), first day, last day
REQUESTS = (
    ("r1", ["مكتبة", "أَحْمَد"], None, "2024-01-03", "2024-01-10"),
    ("r2", ["The"], None, None, None),
    ("r3", ["User_3"], ["src1", "src2", "src3"], "2024-01-05", None),
    ("r4", ["zzzz-none"], None, None, None),
    ("r5", None, ["src4"], None, None),
    ("r6", ["the"], ["src1", "src2", "src3"], None, "2024-01-20"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sample_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = {name: table(spark, sf_dir, name) for name in TABLES}
    posts = spark.sql(ATTACHED_POSTS_SQL, **frames)
    # Built once per row, after the join has spread the rows over the cores.
    return with_computed(posts, "text", F.col("text")).select(*posts.columns)


def event_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = {name: table(spark, sf_dir, name) for name in ("events", "customer")}
    return spark.sql(EVENT_POSTS_SQL, **frames)


def sample_requests(spark: SparkSession) -> DataFrame:
    schema = (
        "request_id string, keywords array<string>, dataset_ids array<string>, "
        "date_from string, date_to string"
    )
    return spark.createDataFrame([tuple(r) for r in REQUESTS], schema)


def nation_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per nation: a handle and one of the sample's Arabic or French words."""
    return table(spark, sf_dir, "nation").selectExpr(
        "concat('n', n_nationkey) AS request_id",
        "array(concat('user_', n_nationkey), "
        "CASE n_nationkey % 3 WHEN 0 THEN 'رائع' WHEN 1 THEN 'le' ELSE 'ing' END) AS keywords",
        "CAST(NULL AS array<string>) AS dataset_ids",
        "CASE WHEN n_nationkey % 2 = 0 THEN '2024-01-02' END AS date_from",
        "CASE WHEN n_nationkey % 4 = 0 THEN '2024-01-25' END AS date_to",
    )


def order_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control rows from orders: one request per order with a status by the order's status."""
    return table(spark, sf_dir, "orders").selectExpr(
        "CAST(o_orderkey AS string) AS request_id",
        "CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(o_custkey AS string) END AS user_id",
        "o_orderpriority AS title",
        "CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'completed' "
        "WHEN 'P' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'collecting' ELSE NULL END END AS status",
        "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey % 100 AS int) END AS progress",
        "CASE WHEN o_orderkey % 11 = 0 THEN 'failed before' END AS error_message",
        "o_orderdate AS created_at",
        "o_orderdate AS updated_at",
    )


def order_keyword_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per order: a keyword of one to three letters, a handle, or digits, by its key."""
    return table(spark, sf_dir, "orders").selectExpr(
        "concat('o', o_orderkey) AS request_id",
        "array(CASE o_orderkey % 5 WHEN 0 THEN substring('etaoinshrdlu', 1 + o_orderkey % 12, 1) "
        "WHEN 1 THEN substring('theandingionere', 1 + o_orderkey % 13, 3) "
        "WHEN 2 THEN substring('heanrestndou', 1 + o_orderkey % 11, 2) "
        "WHEN 3 THEN concat('User_', o_orderkey % 40) ELSE CAST(o_orderkey AS string) END) AS keywords",
        "CASE WHEN o_orderkey % 4 = 0 THEN array(concat('src', o_orderkey % 8)) END AS dataset_ids",
        "CAST(NULL AS string) AS date_from",
        "CAST(NULL AS string) AS date_to",
    )


def nation_request_batches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Requests of nations as they arrive: all of them, each twice; then every other one again, some
    new ones, and some that are not pending. Every sixth has a day that cannot be read."""
    first = table(spark, sf_dir, "nation").selectExpr(
        "concat('n', n_nationkey) AS request_id",
        "CASE WHEN n_nationkey % 5 > 0 THEN CAST(n_regionkey AS string) END AS user_id",
        "n_name AS title",
        "array(concat('user_', n_nationkey)) AS keywords",
        "CASE WHEN n_nationkey % 6 = 0 THEN 'soon' END AS date_from",
        "'pending' AS status",
        "timestamp '2024-02-01' AS created_at",
        "n_nationkey",
    )
    later = first.withColumns({"title": F.lit("later"), "created_at": F.col("created_at") + F.expr("interval 1 day")})
    new = first.filter("n_nationkey % 3 = 0").withColumns(
        {
            "request_id": F.concat(F.lit("m"), "n_nationkey"),
            "status": F.when(F.col("n_nationkey") % 2 == 0, "pending").otherwise("completed"),
        }
    )
    second = first.filter("n_nationkey % 2 = 0").unionByName(new)
    return first.unionByName(later).drop("n_nationkey"), second.drop("n_nationkey")
