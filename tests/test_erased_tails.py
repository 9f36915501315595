"""Flash volumes without their erased tails stand for whole ones and are no longer than their records."""

import pytest
from pyspark.sql import functions as F

from varlens import format_queries, queries
from varlens.operators import flash

from .test_large_images import plan

SIZE = 1 << 14


@pytest.fixture(scope="module")
def volumes(spark):
    ids = spark.range(3).select(F.col("id").alias("image_id"), F.lit(SIZE).alias("size"), F.lit(4096).alias("block"), F.lit("normal").alias("layout"))
    return [flash.initialized(ids, whole).drop("status") for whole in (True, False)]


def padded(df):
    return {r.image_id: bytes(r.content) + b"\xff" * r.asDict().get("erased", 0) for r in df.collect()}


def test_same_bytes_with_and_without_tails(spark, volumes):
    names = F.encode(F.concat(F.lit("n"), (F.col("id") % 7).cast("string")), "UTF-16LE")
    data = F.when(F.col("id") % 5 == 0, F.unhex(F.lit(""))).otherwise(F.unhex(F.repeat(F.lit("FF"), (F.col("id") % 90 + 1).cast("int"))))
    changes = spark.range(900).select((F.col("id") % 2).alias("image_id"), F.col("id").alias("place"), F.lit(7).alias("attributes"), F.unhex(F.lit("00" * 16)).alias("guid"), names.alias("name_wire"), data.alias("data"))
    whole, short = (flash.changed(v, changes) for v in volumes)
    said = [sorted((r.image_id, r.place, r.outcome) for r in x.where("place IS NOT NULL").collect()) for x in (whole, short)]
    assert said[0] == said[1] and {"Written", "Deleted", "Absent", "Full"} <= {r[2] for r in said[0]}
    whole, short = (x.where("content IS NOT NULL").drop("place", "outcome") for x in (whole, short))
    assert padded(whole) == padded(short) and {len(c) for c in padded(short).values()} == {SIZE}
    assert short.where("image_id = '2'").first().erased == SIZE - 100
    assert sorted(map(tuple, flash.stores(whole).collect())) == sorted(map(tuple, flash.stores(short).collect()))
    assert sorted(map(str, flash.records(whole).collect())) == sorted(map(str, flash.records(short).collect()))
    keep = flash.records(short).where("state = 63").withColumn("place", F.col("rec_offset"))
    kept = [flash.rewritten(v, None, keep) for v in (whole, short)]
    assert padded(kept[0]) == padded(kept[1]) and {r.status for r in kept[1].collect()} == {"OK"}
    again = [flash.changed(v.drop("status"), changes) for v in kept]
    assert padded(again[0].where("content IS NOT NULL")) == padded(again[1].where("content IS NOT NULL"))


def test_queries_carry_records_alone(spark, sf_dir):
    longest = format_queries.flash_images(spark, sf_dir).agg(F.max(F.length("content")), F.min(F.length("content") + F.col("erased"))).first()
    assert longest[0] < format_queries.FLASH_SIZE // 4 and longest[1] == format_queries.FLASH_SIZE
    assert "Groups" not in plan(queries.queries()["flash_outcomes"](spark, sf_dir))
