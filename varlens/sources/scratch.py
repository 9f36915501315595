"""Places that every executor can reach, for tables written to cut lineage."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: This process's folder below the shared one: runs side by side don't meet, and each removes its own tables alone.
RUN = f"varlens-{uuid.uuid4().hex}"
_made: set[str] = set()
#: Images in a batch of Parquet's reader, and bytes in one of Arrow.
IMAGE_ROWS, IMAGE_BYTES = 16, 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a local session gets one of this process; a
    cluster, whose executors could not reach it, is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master.split("[")[0] != "local":
            raise ValueError(f"spark.checkpoint.dir is not set; executors of {master} need a shared folder")
        base = "file://" + tempfile.mkdtemp(prefix="varlens-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """This run's folder, made when it is first asked for and removed when the driver's JVM ends."""
    base = f"{shared_dir(spark)}/{RUN}"
    if base not in _made:
        fs, path = _hadoop(spark, base)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _made.add(base)
    return base


def _hadoop(spark: SparkSession, path: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def there(spark: SparkSession, path: str) -> bool:
    fs, where = _hadoop(spark, path)
    return fs.exists(where)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: lost executors don't bring back what lies before."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def image_batches(spark: SparkSession) -> None:
    """Let Spark's readers and Python tasks take few images at a time, each of which has up to 16 MiB: Parquet's batches
    have 4096 rows by default, whatever their bytes. Settings of the session stay."""
    for name, value in (("spark.sql.parquet.columnarReaderBatchSize", IMAGE_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", IMAGE_BYTES)):
        if name not in spark.conf.getAll:
            spark.conf.set(name, str(value))


def written_images(df: DataFrame, name: str) -> DataFrame:
    """written() of rows with images: pages and row groups are cut by bytes after each row, and read in small batches."""
    image_batches(df.sparkSession)
    path = new_path(df.sparkSession, name)
    checks = {f"parquet.{part}.size.row.check.{end}": "1" for part in ("page", "block") for end in ("min", "max")}
    df.write.options(compression="zstd", **checks).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(ids: DataFrame) -> DataFrame:
    """Rows of short ids dealt to as many tasks as a shuffle has: images are made of them, and by the ids' bytes Spark would
    put all of them into one task."""
    # by another hash than a shuffle's own, or Spark takes the rows as dealt already
    return ids.repartition(int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("image_id"))


def drop_paths(spark: SparkSession) -> None:
    """Remove the tables that this process has written below the shared folder; DataFrames over them can't be read any more."""
    fs, path = _hadoop(spark, run_dir(spark))
    fs.delete(path, True)
    _made.clear()
