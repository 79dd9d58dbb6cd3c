"""Contacts folded by pairs of blocks of users, against the join of contacts."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from proxigraph.operators import pipeline

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def events(spark):
    r = random.Random(4)
    rows = [(1 if r.random() < 0.3 else r.randrange(12), 1_700_000_000_000_000 + r.choice((0, 1, 299_999_999, 300_000_000)) + r.randrange(40) * 150_000_000) for _ in range(500)]
    return spark.createDataFrame([*rows, (None, 1), (3, None)], "user_id long, t long").select("user_id", F.timestamp_micros("t").alias("ts")).cache()


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(params=[(1, 1_000_000), (3, 40)])
def sizes(request, monkeypatch):
    monkeypatch.setattr(pipeline, "SMALL_BLOCK", 500 // request.param[0])
    monkeypatch.setattr(pipeline, "SLICE", request.param[1])


def test_sessions_of_pairs(spark, events, sizes):
    assert rows(pipeline.pair_sessions(events)) == rows(pipeline.sessionize(pipeline.contacts(events), ["u1", "u2"]))
    assert pipeline.pair_sessions(events.limit(0)).count() == 0


def test_counts_of_pairs(spark, events, sizes):
    assert rows(pipeline.pair_counts(events)) == rows(pipeline.contacts(events).groupBy("u1", "u2").count())


@pytest.mark.parametrize("name", ["meeting_rows", "pairs_canonical", "sessionize_pair"])
def test_contacts_are_not_shuffled(spark, name):
    assert "Join" not in entry.queries()[name](spark, D)._jdf.queryExecution().toString()
