import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


POST_FIELDS = (
    "post_id long, text string, created_at string, user_id string, user_handle string, "
    "user_followers long, likes long, retweets long, replies long, lang string, label string, "
    "source_dataset string"
)


@pytest.fixture(scope="session")
def make_posts(spark):
    """Posts from dicts; anything left out is null, counters are 0."""
    names = [f.split()[0] for f in POST_FIELDS.split(", ")]
    zero = {"user_followers", "likes", "retweets", "replies"}

    def build(*rows):
        data = [
            tuple(r.get(n, i if n == "post_id" else 0 if n in zero else None) for n in names)
            for i, r in enumerate(rows)
        ]
        return spark.createDataFrame(data, POST_FIELDS)

    return build
