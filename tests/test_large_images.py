"""Images are long rows: they are read a few at a time, judged where they lie and never broadcast."""

from pyspark.sql import functions as F

from varlens.operators import flash
from varlens.sources import scratch

NAMES = ["spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxBytesPerBatch"]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_flash_records_are_found_in_their_rows(spark):
    blank = flash.initialized(spark.range(2).select(F.col("id").alias("image_id"), F.lit(4096).alias("size"), F.lit(4096).alias("block"), F.lit("normal").alias("layout"))).select("image_id", "content")
    assert "Join" not in plan(flash.records(blank))
    change = blank.select("image_id", F.lit(0).alias("place"), F.lit(7).alias("attributes"), F.unhex(F.lit("00" * 16)).alias("guid"), F.encode(F.lit("n"), "UTF-16LE").alias("name_wire"), F.encode(F.lit("v"), "UTF-8").alias("data"))
    assert [(r.place, r.outcome, r.content) for r in flash.changed(blank, change, False).collect()] == [(0, "Written", None)] * 2
    whole = flash.changed(blank, change).where("content IS NOT NULL").select("image_id", "content")
    assert [bytes(r.data) for r in flash.records(whole).collect()] == [bytes(r.data) for r in flash.records(whole, flash.stores(whole)).collect()] == [b"v"] * 2


def test_image_tables_are_read_in_small_batches(spark):
    blanks = spark.range(3).select("id", F.encode(F.repeat(F.lit("0"), 8192), "UTF-8").alias("content"))
    for name in NAMES:
        spark.conf.unset(name)
    assert scratch.written_images(blanks, "test").count() == 3
    assert [spark.conf.get(name) for name in NAMES] == [str(scratch.IMAGE_ROWS), str(scratch.IMAGE_BYTES)]
    spark.conf.set(NAMES[0], "99")
    scratch.image_batches(spark)
    assert spark.conf.get(NAMES[0]) == "99"
    spark.conf.unset(NAMES[0])
