"""Rankings of targets with more references than a read of the newest ones gives."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from socialspark.operators import aggregate, ranking

AT = datetime(2024, 1, 1)
TAG = "event_id string, pubkey string, kind int, created_at timestamp_ntz, tag_key string, tag_value string"
NOTES = [("hot", "ann", AT), ("cold", "bob", AT), ("none", "bob", AT)]


@pytest.fixture
def tags(spark):
    """730 likes of one note, each of 650 people once or twice, one of them tagged twice, and one reply from each of 510."""
    likes = [(f"l{i:04d}", f"p{i % 650}", 7, AT + timedelta(seconds=i), "e", "hot") for i in range(730)]
    replies = [(f"r{i:04d}", f"p{i}", 1111 if i % 2 else 1, AT + timedelta(seconds=i), "e", "hot") for i in range(510)]
    return spark.createDataFrame([*likes, likes[0], *replies, ("x", "p1", 7, AT, "e", "cold"), ("y", "p1", 7, AT, "q", "cold")], TAG)


@pytest.fixture
def notes(spark):
    return spark.createDataFrame(NOTES, "id string, pubkey string, created_at timestamp_ntz")


def test_scores_count_all_references(spark, tags, notes):
    terms = (ranking.Term("references", "likes", 1.0), ranking.Term("references", "replies", 1000.0))
    nothing = spark.createDataFrame([], "event_id string, metric string, value double"), spark.createDataFrame([], "pubkey string, score double, followers long")
    got = ranking.weighted_scores(notes, terms, tags, nothing[1], nothing[0], F.lit(AT).cast("timestamp_ntz"))
    assert {r.id: r.score for r in got.collect()} == {"hot": 650 + 510_000, "cold": 1, "none": 0}
    counted = ranking.by_references(notes, tags, "COUNT", "event_id")
    assert {r.id: r.score for r in counted.collect()} == {"hot": 730, "cold": 1, "none": 0}


def test_a_read_of_the_newest_references_still_stops_at_its_number(tags, notes):
    got = aggregate.references_per_target(notes, tags)
    assert {r.target_id: r.n for r in got.collect()} == {"hot": 500, "cold": 1, "none": 0}
