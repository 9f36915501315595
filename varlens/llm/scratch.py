"""Written tables, broadcasts of a checked size, names and batches that fit."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import drop_paths, new_path, shared_dir, there, written  # noqa: F401  as the operators use them

#: A table is broadcast up to this many rows and bytes.
MOST_ROWS, MOST_BYTES = 500_000, 32 << 20


def row_bytes(schema: T.StructType) -> Column:
    """About the bytes of a row: those of strings, binaries and arrays as they are, eight for anything else."""
    size: Column = F.lit(0).cast("long")
    for f in schema.fields:
        col = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(col), F.lit(0))
        elif isinstance(f.dataType, T.ArrayType):
            size = size + 8 * F.coalesce(F.size(col), F.lit(0))
        else:
            size = size + 8
    return size


def small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if counting shows that it has MOST_ROWS rows and MOST_BYTES bytes at most; beyond that joins shuffle it."""
    n, size = df.select(row_bytes(df.schema).alias("b")).limit(MOST_ROWS + 1).agg(F.count("*"), F.sum("b")).first()
    return F.broadcast(df) if n <= MOST_ROWS and (size or 0) <= MOST_BYTES else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it differ from all columns of df."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        out.append(name)
    return out


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Give Arrow batches of texts fewer rows than Spark's default, as some texts are long; a session that has set a number keeps it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if name not in spark.conf.getAll:
        spark.conf.set(name, str(rows))
