"""Planning operators against plain Python, and every query against its SQL where the tables are present."""

import os

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandline import queries
from strandline.functions import ids, text
from strandline.operators import shards, windows

NOW = 1706745600000
TABLES = "/root/testdata/sf0.001"


def test_paths():
    assert text.output_path("out.jsonl", "123", False) == "out-123.jsonl"
    assert text.output_path("out.jsonl", "123", True) == "out.jsonl"
    assert text.output_path("a/{channel}.x", "1", False) == "a/1.x"


def test_large_numbers_in_names_and_sizes(spark):
    r = spark.range(1).select(text.chunk_name(F.lit("é/x"), F.lit(1234567)).alias("n"), text.fmt_bytes(F.lit(3 * 1024**4)).alias("b"), text.fmt_count(F.lit(-2_400_000)).alias("c"), text.half_up(F.lit(-2.5)).alias("h")).first()
    assert (r.n, r.b, r.c, r.h) == ("__x-1234567.json", "3 TB", "-2.4M", -2)


def dense(spark, probes, p, start=NOW - 10 * 86_400_000):
    channel = ids.ms_to_id(start)
    df = spark.createDataFrame([(channel, t, r, i) for i, (t, r) in enumerate(probes)], "channel bigint, t bigint, rate double, seq int")
    got = shards.density_shards(spark.createDataFrame([(channel,)], "channel bigint"), df, NOW, p).orderBy("shard").collect()
    return channel, got


def test_density_follows_the_rate(spark):
    start = NOW - 10 * 86_400_000
    probes = [(start + k * 86_400_000 // 4, 1e-6 if k < 24 else 1e-4) for k in range(1, 40)]
    channel, got = dense(spark, probes, 4)
    assert [r.strategy for r in got] == ["density"] * 4
    assert got[0].after == channel
    assert all(a.before == b.after for a, b in zip(got, got[1:], strict=False))
    assert sum(ids.id_to_ms(r.after) >= start + 6 * 86_400_000 for r in got) >= 3


@pytest.mark.parametrize("probes", [[], [(NOW - 86_400_000, 1.0)], [(NOW - 86_400_000, 0.0), (NOW - 80_000_000, 0.0)], [(NOW - 86_400_000, float("nan")), (1, 1.0)]])
def test_density_falls_back_to_equal_time(spark, probes):
    _, got = dense(spark, probes, 3)
    assert [r.strategy for r in got] == ["equal-time"] * 3


def test_short_history_is_one_shard(spark):
    channel = ids.ms_to_id(NOW - 86_400_000)
    got = shards.equal_shards(spark.createDataFrame([(channel,)], "channel bigint"), NOW, 6).collect()
    assert [(r.after, r.before) for r in got] == [(channel, ids.ms_to_id(NOW + 60_000))]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 40 * 86_400_000), min_size=1, max_size=30), st.integers(1, 12), st.integers(8, 40))
def test_every_id_lies_in_one_shard(spark, offsets, p, days):
    start = NOW - days * 86_400_000
    numbers = [ids.ms_to_id(min(start + o, NOW)) + i for i, o in enumerate(offsets)]
    channel = ids.ms_to_id(start)
    made = shards.equal_shards(spark.createDataFrame([(channel,)], "channel bigint"), NOW, p)
    rows = spark.createDataFrame([(channel, n) for n in numbers], "channel bigint, id_num bigint")
    assert sorted(r.id_num for r in shards.assign(rows, made).collect()) == sorted(numbers)


def test_window_bounds(spark):
    df = spark.createDataFrame([(5,), (10,), (20,)], "n bigint")
    assert [r.n for r in df.where(windows.in_window(F.col("n"), 5, 20)).collect()] == [5, 10]
    assert [r.n for r in df.where(windows.in_window(F.col("n"), 5, 20, False)).collect()] == [10]


def test_coverage_gaps(spark):
    df = spark.createDataFrame([("a", 0, 10), ("a", 5, 8), ("a", 12, 20), ("b", 0, 5)], "channel_id string, after bigint, before bigint")
    assert [tuple(r) for r in windows.coverage_gaps(df).collect()] == [("a", 10, 12)]


def rows_of(columns, rows):
    show = lambda v: None if v is None or v != v else round(v, 6) if isinstance(v, float) else v
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(repr([show(r[i]) for i in order]) for r in rows)


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="needs the synthetic tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_matches_its_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(TABLES):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{TABLES}/{f}'")
    df = queries.QUERIES[name](spark, TABLES)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = c.execute(queries.ORACLES[name])
    assert got == rows_of([x[0] for x in cur.description], cur.fetchall())
