"""An image is as long as its log: no image is left out, whatever its mutations take."""

import duckdb
import pytest
from pyspark.sql import functions as F

from varlens import queries as engine
from varlens.operators import logstore
from varlens.sources.scratch import spread

from .conftest import DATA
from .test_large_images import plan
from .test_queries import rows

QUERIES = ["header_crc", "replay_full", "decode_roundtrip", "replay_anchored", "compact_state", "compact_roundtrip"]


@pytest.fixture(scope="module")
def long_logs(tmp_path_factory):
    """One image with a log of over 256 KiB and variables of over 32 KiB, and a short one."""
    folder = tmp_path_factory.mktemp("events")
    props = "repeat(chr(97 + (event_id % 26)::INT), 40)"
    duckdb.sql(f"COPY (SELECT event_id, TIMESTAMP '2024-01-01' + to_seconds(event_id) AS ts, CASE WHEN event_id < 2500 THEN 1 ELSE 9 END AS user_id, 'type' || event_id % 701 AS event_type, 1.0 AS value, {props} AS props FROM range(2510) t(event_id)) TO '{folder}/events.parquet'")
    return str(folder)


@pytest.mark.parametrize("name", QUERIES)
def test_long_logs_equal_sql(spark, long_logs, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{long_logs}/events.parquet'")
    got, want = engine.queries()[name](spark, long_logs).toPandas(), con.sql(engine.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and len(got) > 1
    assert rows(got, columns) == rows(want, columns)


def test_fixed_sizes_still_refuse(spark, long_logs):
    log = engine.wire_log(spark, long_logs)
    fixed = logstore.encode_images(log.limit(0).drop("op"), log, 1 << 18, 1 << 15).orderBy("image_id").collect()
    assert [(r.status, r.content and len(r.content)) for r in fixed] == [("Full", None), ("OK", 1 << 18)]
    sized = logstore.encode_images(log.limit(0).drop("op"), log, None, None).select("status", (F.length("content") % 4096).alias("rest")).collect()
    assert [tuple(r) for r in sized] == [("OK", 0)] * 2


def test_replays_take_many_images_in_a_task(spark, sf_dir):
    for name in ("compact_roundtrip", "replay_full", "append_outcomes"):
        assert "Groups" not in plan(engine.queries()[name](spark, sf_dir))


def test_ids_are_dealt_to_all_tasks(spark):
    ids = spark.range(100).select((F.col("id") % 50).alias("image_id")).distinct()
    assert spread(ids).mapInArrow(lambda batches: batches, "image_id long").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert "BroadcastExchange" not in plan(engine.queries()["append_outcomes"](spark, DATA))
