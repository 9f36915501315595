"""Store images as rows."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import image_batches

MOST_IMAGE_BYTES = 16 << 20


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """images(image_id, path, length, status, content) of all files under path.

    Images have 16 MiB at most; a larger file has the status Bounds and no content, which isn't read.
    """
    image_batches(spark)
    files = spark.read.format("binaryFile").load(path)
    small, large = files.where(F.col("length") <= MOST_IMAGE_BYTES), files.where(F.col("length") > MOST_IMAGE_BYTES).select("path", "length")
    name = F.sha2(F.col("path"), 256).alias("image_id")
    fine = small.select(name, "path", "length", F.lit("OK").alias("status"), "content")
    return fine.unionByName(large.select(name, "path", "length", F.lit("Bounds").alias("status"), F.lit(None).cast("binary").alias("content")))


def detected(images: DataFrame) -> DataFrame:
    """images with format: logstore if a header's magic stands at 0 or at a power of two from 512 to 65536, flash for a firmware volume, else unknown."""
    at = [0, *(1 << k for k in range(9, 17))]
    magic = F.exists(F.array(*map(F.lit, at)), lambda o: F.coalesce(F.hex(F.substring("content", o + 1, F.lit(4))) == "45465653", F.lit(False)))
    flash = F.hex(F.substring("content", 41, 4)) == "5F465648"
    return images.withColumn("format", F.when(magic, "logstore").when(flash, "flash").otherwise("unknown"))
