"""Replay of an ordered mutation log into live state.

Only boundaries and the image's capacity are global to an image; state is per key. Where attributes
never change, replay is a window over each key; with all rules it is a fold over each key's history,
which the format bounds (an image has at most 16 MiB).
"""

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import rules

KEY = ["image_id", "guid", "name"]


def by_key() -> WindowSpec:
    return Window.partitionBy(*KEY).orderBy("seq")


def so_far() -> WindowSpec:
    return by_key().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def window_verdicts(log: DataFrame) -> DataFrame:
    """The log with accepted and epoch (how often the key was set or deleted so far), for constant attributes.

    A DELETE is refused if the key's last operation left nothing: none, a DELETE, or appends of nothing
    since. An APPEND of nothing is accepted and makes nothing.
    """
    rows = log.withColumn("epoch", F.sum(F.when(F.col("op") != "APPEND", 1).otherwise(0)).over(so_far()))
    makes = (F.col("op") == "SET") | ((F.col("op") == "APPEND") & (F.length("data") > 0))
    rows = rows.withColumns({"made": F.max(F.when(makes, F.col("seq"))).over(so_far()), "gone": F.max(F.when(F.col("op") == "DELETE", F.col("seq"))).over(so_far())})
    before = rows.withColumns({"made": F.lag("made").over(by_key()), "gone": F.lag("gone").over(by_key())})
    there = F.col("made").isNotNull() & (F.coalesce("gone", F.lit(-1)) < F.col("made"))
    return before.withColumn("accepted", (F.col("op") != "DELETE") | there).drop("made", "gone")


def window_live(log: DataFrame) -> DataFrame:
    """Live variables by windows: image_id, guid, name, attributes, data, born_seq, last_seq."""
    rows = log.withColumn("epoch", F.sum(F.when(F.col("op") != "APPEND", 1).otherwise(0)).over(so_far()))
    last = Window.partitionBy(*KEY)
    rows = rows.withColumns({"newest": F.max("epoch").over(last), "gone": F.max(F.when(F.col("op") == "DELETE", F.col("seq"))).over(last)})
    made = (F.col("op") != "DELETE") & ((F.col("op") == "SET") | (F.length("data") > 0)) & (F.col("seq") > F.coalesce("gone", F.lit(-1)))
    newest = lambda c: F.when(F.col("epoch") == F.col("newest"), c)  # noqa: E731  the value is made of these, the key's birth may lie before
    keys = rows.where(made).dropna(subset=KEY).groupBy(*KEY).agg(
        F.sort_array(F.collect_list(newest(F.struct("seq", "data")))).alias("p"), F.max(newest(F.col("seq"))).alias("last_seq"),
        F.min(newest(F.col("attributes").bitwiseAND(F.lit(~64)))).alias("attributes"), F.min("seq").alias("born_seq"),
    )
    return keys.where("last_seq IS NOT NULL").select(*KEY, "attributes", F.array_join(F.col("p.data"), "").alias("data"), "last_seq", "born_seq")


#: Operations of a key that are folded at a time: each append to an array copies it.
PART = 64


def fold(log: DataFrame) -> DataFrame:
    """Each key's final state and outcomes: attributes and data (null: not there), born_seq, outcomes (seq, error)."""
    history = F.sort_array(F.collect_list(F.struct("seq", "op", "attributes", "data")))
    keys = log.groupBy(*KEY).agg(history.alias("h"))
    none = lambda kind: F.lit(None).cast(kind)
    empty = F.array().cast("array<struct<seq:bigint,error:string>>")
    state = lambda s, out: F.struct(s[0].alias("attributes"), s[1].alias("data"), s[2].alias("born"), out.alias("out"))
    start = state((none("int"), none("string"), none("bigint")), empty)

    def step(s: Column, x: Column) -> Column:
        stored = s["attributes"].isNotNull()
        judged = F.transform(F.array(rules.verdict(x["op"], x["attributes"], F.length(x["data"]), stored, s["attributes"])), lambda e: apply(s, x, e, stored))
        return judged[0]

    def apply(s: Column, x: Column, error: Column, stored: Column) -> Column:
        ok, word = error == "OK", x["attributes"].bitwiseAND(F.lit(~64))
        keep, gone = ~ok | ((x["op"] == "APPEND") & (F.length(x["data"]) == 0)), x["op"] == "DELETE"
        data = F.when(keep, s["data"]).when(gone, F.lit(None)).when((x["op"] == "APPEND") & stored, F.concat(s["data"], x["data"])).otherwise(x["data"])
        word = F.when(keep, s["attributes"]).when(gone, F.lit(None)).otherwise(word).cast("int")
        born = F.when(keep, s["born"]).when(gone, F.lit(None)).otherwise(F.coalesce(s["born"], x["seq"])).cast("bigint")
        return state((word, data, born), F.array_append(s["out"], F.struct(x["seq"].cast("bigint").alias("seq"), error.alias("error"))))

    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("h") - 1) / PART).cast("int")), lambda p: F.slice("h", p * PART + 1, PART))
    both = lambda done, now: F.struct(done.alias("done"), now.alias("now"))
    more = lambda s, part: both(F.array_append(s["done"], s["now"]["out"]), F.aggregate(part, state([s["now"][c] for c in ("attributes", "data", "born")], empty), step))
    whole = F.aggregate(parts, both(F.array().cast("array<array<struct<seq:bigint,error:string>>>"), start), more)
    s = keys.select(*KEY, whole.alias("s"))
    outcomes = F.flatten(F.array_append("s.done", F.col("s.now.out")))
    return s.select(*KEY, "s.now.attributes", "s.now.data", F.col("s.now.born").alias("born_seq"), outcomes.alias("outcomes"))


def fold_outcomes(folded: DataFrame) -> DataFrame:
    return folded.select(*KEY, F.explode("outcomes").alias("o")).select(*KEY, "o.seq", "o.error")


def fold_live(folded: DataFrame) -> DataFrame:
    return folded.where("attributes IS NOT NULL").select(*KEY, "attributes", "data", "born_seq")


def occupancy(log: DataFrame, name_bytes: Column, data_bytes: Column) -> DataFrame:
    """Bytes of the working set after each accepted mutation of a log of constant attributes: image_id, seq, delta, used.

    A key's entry has 48 bytes, its name and its data, padded to 8. Sums run over each image in order.
    """
    rows = window_verdicts(log)
    in_epoch = Window.partitionBy(*KEY, "epoch").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    grown = F.sum(F.when(F.col("op") == "DELETE", 0).otherwise(data_bytes)).over(in_epoch)
    held = F.max(F.when((F.col("op") == "SET") | (data_bytes > 0), 1).otherwise(0)).over(in_epoch)
    size = F.floor((name_bytes + F.col("grown") + 48 + 7) / 8).cast("bigint") * 8
    rows = rows.withColumns({"grown": grown, "held": F.when(F.col("op") == "DELETE", 0).otherwise(held)}).withColumn("size", F.when(F.col("held") == 1, size).otherwise(0))
    rows = rows.withColumn("delta", F.col("size") - F.coalesce(F.lag("size").over(by_key()), F.lit(0)))
    image = Window.partitionBy("image_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select("image_id", "seq", F.col("delta").cast("bigint").alias("delta"), F.sum("delta").over(image).cast("bigint").alias("used"))
