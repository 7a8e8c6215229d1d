"""Column layouts shared by sources, operators and plans."""

from pyspark.sql import types as T

COUNTERS = ("user_followers", "likes", "retweets", "replies")

CANONICAL_POST = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("created_at", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("user_handle", T.StringType()),
        *[T.StructField(name, T.LongType()) for name in COUNTERS],
        T.StructField("lang", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("source_dataset", T.StringType()),
    ]
)

POST = T.StructType([T.StructField("post_id", T.LongType()), *CANONICAL_POST.fields])

REQUEST = T.StructType(
    [
        T.StructField("request_id", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("keywords", T.ArrayType(T.StringType())),
        T.StructField("platforms", T.ArrayType(T.StringType())),
        T.StructField("analysis_type", T.StringType()),
        T.StructField("date_from", T.StringType()),
        T.StructField("date_to", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("progress", T.IntegerType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("completed_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
        T.StructField("dataset_ids", T.ArrayType(T.StringType())),
    ]
)

TOPICS = "array<struct<label:string,weight:int>>"
INFLUENCERS = (
    "array<struct<handle:string,followers:bigint,influence:double,"
    "total_posts:bigint,avg_engagement:double>>"
)
TIMELINE = "array<struct<day:string,positive:bigint,neutral:bigint,negative:bigint>>"
NODES = "array<struct<id:string,handle:string,size:int,group:string>>"
EDGES = "array<struct<source:string,target:string,weight:bigint>>"
