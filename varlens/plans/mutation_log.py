"""Mutation logs over the table events: one image for each few users and each run of events.

So images grow in number with the users and the events, and none holds more than a run, whoever it is of.
Columns: image_id, seq (gapless from 0 in each image), guid, name, data, op, attributes.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Users of an image, and events of a run; image_id is the run's number times RUNS plus that of the users.
USERS, RUN, RUNS = 8, 1 << 16, 1 << 24


def image() -> Column:
    return F.floor(F.col("event_id") / RUN) * RUNS + F.floor(F.col("user_id") / USERS)


def _log(events: DataFrame, word: Column) -> DataFrame:
    k = F.col("event_id") % 5
    seq = F.row_number().over(Window.partitionBy("image_id").orderBy("ts", "event_id")) - 1
    op = F.when(k == 0, "DELETE").when(k.isin(1, 2), "APPEND").otherwise("SET")
    # as a column first: Spark then knows that a shuffle by image has each key's rows together
    return events.withColumn("image_id", image()).select(
        "image_id", seq.cast("bigint").alias("seq"), F.col("user_id").alias("guid"), F.col("event_type").alias("name"),
        F.when(k == 0, "").otherwise(F.col("props")).alias("data"), op.alias("op"), (word + F.when(k.isin(1, 2), 64).otherwise(0)).cast("int").alias("attributes"),
    )


def base_log(events: DataFrame) -> DataFrame:
    """All attributes NV|BS|RT, so that no rule depends on what was accepted before."""
    return _log(events, F.lit(7))


def rules_log(events: DataFrame) -> DataFrame:
    """Attributes that break each of the rules now and then."""
    e = F.col("event_id")
    return _log(events, F.when(e % 17 == 0, 3).when(e % 23 == 0, 39).when(e % 29 == 0, 263).when(e % 31 == 0, 15).otherwise(7))


def base_log_sql() -> str:
    return _SQL.format(word="7", image=IMAGE_SQL)


def rules_log_sql() -> str:
    return _SQL.format(word="(CASE WHEN event_id % 17 = 0 THEN 3 WHEN event_id % 23 = 0 THEN 39 WHEN event_id % 29 = 0 THEN 263 WHEN event_id % 31 = 0 THEN 15 ELSE 7 END)", image=IMAGE_SQL)


#: image() in SQL.
IMAGE_SQL = f"(event_id // {RUN}) * {RUNS} + user_id // {USERS}"

_SQL = """SELECT {image} AS image_id, row_number() OVER (PARTITION BY {image} ORDER BY ts, event_id) - 1 AS seq,
 user_id AS guid, event_type AS name, CASE WHEN event_id % 5 = 0 THEN '' ELSE props END AS data,
 CASE event_id % 5 WHEN 0 THEN 'DELETE' WHEN 1 THEN 'APPEND' WHEN 2 THEN 'APPEND' ELSE 'SET' END AS op,
 CAST({word} + (CASE WHEN event_id % 5 IN (1, 2) THEN 64 ELSE 0 END) AS INTEGER) AS attributes FROM events"""
