"""Queries over live state and record versions: lookup, order, capacity, resolution, routing, copies."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import policy

KEY = ["image_id", "guid", "name"]


def point_get(live: DataFrame, image_id: int, guid: int, name: str) -> DataFrame:
    return live.where((F.col("image_id") == image_id) & (F.col("guid") == guid) & (F.col("name") == name))


def sized_get(live: DataFrame, capacity: Column) -> DataFrame:
    """Each value with the status of a read into a buffer of that capacity."""
    size = F.octet_length("data").cast("bigint")
    return live.withColumn("size", size).withColumn("status", F.when(capacity < size, "BufferTooSmall").otherwise("Success"))


def enumerated(live: DataFrame) -> DataFrame:
    """live with place: 1, 2, ... in order of guid and name within each image."""
    return live.withColumn("place", F.row_number().over(Window.partitionBy("image_id").orderBy("guid", "name")).cast("bigint"))


def next_key(live: DataFrame, order: list[str]) -> DataFrame:
    """Each key with the one that follows it in an order; the last one has status NotFound."""
    w = Window.partitionBy("image_id").orderBy(*order)
    return live.select(*KEY, F.lead("guid").over(w).alias("next_guid"), F.lead("name").over(w).alias("next_name")).withColumn("status", F.when(F.col("next_guid").isNull(), "NotFound").otherwise("Success"))


def cursor(live: DataFrame, cursors: DataFrame, order: list[str], unknown: str) -> DataFrame:
    """The key after each cursor (image_id, guid, name); an unknown cursor gives the status `unknown`."""
    found = cursors.select(*KEY).join(next_key(live, order), KEY, "left")
    return found.withColumn("status", F.coalesce("status", F.lit(unknown)))


def stored_order(live: DataFrame) -> DataFrame:
    """live with ordinal: replacing keeps a key's place, deleting closes the gap, setting again appends."""
    return live.withColumn("ordinal", F.row_number().over(Window.partitionBy("image_id").orderBy("born_seq")).cast("bigint"))


def entry_size(name_bytes: Column, data_bytes: Column) -> Column:
    return F.floor((name_bytes + data_bytes + 48 + 7) / 8).cast("bigint") * 8


def store_capacity(used: DataFrame, checkpoint_capacity: int, log_used: Column, log_capacity: int) -> DataFrame:
    """UEFI capacity of each image: what a checkpoint can hold, and the lesser of its and the log's free bytes."""
    free = F.least(F.lit(checkpoint_capacity) - F.col("used"), F.lit(log_capacity) - log_used)
    return used.withColumns({"capacity": F.lit(checkpoint_capacity - 96).cast("bigint"), "remaining": free.cast("bigint")})


def log_query(used: DataFrame, log_capacity: int, checkpoint_capacity: int) -> DataFrame:
    """The kernel's definition: log capacity, free log bytes, largest value."""
    return used.withColumns({"capacity": F.lit(log_capacity).cast("bigint"), "remaining": (F.lit(log_capacity) - F.col("log_bytes")).cast("bigint"), "largest": F.lit(max(0, checkpoint_capacity - 146)).cast("bigint")})


def resolve(records: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """The live version of each key: the first ADDED record in physical order, else the last one in transition."""
    added = F.col("state") == policy.ADDED
    order = Window.partitionBy(*keys).orderBy(added.desc(), F.when(added, F.col("rec_offset")).otherwise(-F.col("rec_offset")))
    return records.where(F.col("state").isin(policy.ADDED, policy.IN_TRANSITION)).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def reclaimed(resolved: DataFrame, start: Column) -> DataFrame:
    """Offsets of the kept records after a reclaim, all of them ADDED."""
    before = Window.partitionBy("image_id").orderBy("rec_offset").rowsBetween(Window.unboundedPreceding, -1)
    return resolved.withColumn("new_offset", (start + F.coalesce(F.sum("length").over(before), F.lit(0))).cast("bigint")).withColumn("state", F.lit(policy.ADDED))


def needs_reclaim(free: Column, capacity: Column) -> Column:
    """Strictly less than a quarter of the area, rounded up, is free."""
    return free < F.ceil(capacity / 4)


def change_outcomes(log: DataFrame) -> DataFrame:
    """Outcome of each Set or Delete of a flash store, by the version that the key's change before it left."""
    order = Window.partitionBy(*KEY).orderBy("seq")
    delete = (F.col("op") == "DELETE") | (F.length("data") == 0)
    rows = log.withColumn("now", F.when(~delete, F.struct("attributes", "data"))).withColumn("before", F.lag("now").over(order))
    same = F.col("before").isNotNull() & ~delete & (F.col("before") == F.col("now"))
    outcome = F.when(same, "Unchanged").when(delete & F.col("before").isNull(), "Absent").when(delete, "Deleted").otherwise("Written")
    return rows.withColumn("outcome", outcome).drop("now", "before")


def select_header(candidates: DataFrame) -> DataFrame:
    """The valid header of the highest generation of each image; of equal ones the first."""
    order = Window.partitionBy("image_id").orderBy(F.desc("generation"), "header_offset")
    return candidates.where("valid").withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def chain_checked(records: DataFrame, first_hash: Column) -> DataFrame:
    """Records (image_id, seq, hash, prev_hash) with link_ok and whether they lie before the first break (kept)."""
    order = Window.partitionBy("image_id").orderBy("seq")
    ok = F.col("prev_hash") == F.coalesce(F.lag("hash").over(order), first_hash)
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return records.withColumn("link_ok", ok).withColumn("kept", F.min("link_ok").over(so_far))


def routed(keys: DataFrame, name_routes: DataFrame, guid_routes: DataFrame, default: str = "firmware") -> DataFrame:
    """keys with route: that of the name rule, else that of the guid rule, else the default. Rule tables are small dimensions."""
    rows = keys.join(name_routes.withColumnRenamed("route", "_name"), ["guid", "name"], "left").join(guid_routes.withColumnRenamed("route", "_guid"), "guid", "left")
    return rows.withColumn("route", F.coalesce("_name", "_guid", F.lit(default))).drop("_name", "_guid")


def merged(managed: DataFrame, overlay: DataFrame, firmware: DataFrame) -> DataFrame:
    """One listing: the overlay before the store before firmware, for each key; keys the store manages hide firmware's."""
    tagged = [df.select(*KEY, "data", F.lit(rank).alias("rank"), F.lit(name).alias("origin")) for rank, (name, df) in enumerate((("overlay", overlay), ("store", managed), ("firmware", firmware)))]
    rows = tagged[0].unionByName(tagged[1]).unionByName(tagged[2])
    return rows.groupBy(*KEY).agg(F.min(F.struct("rank", "origin", "data")).alias("m")).select(*KEY, "m.origin", "m.data")


def mirrored(primary: DataFrame, spare: DataFrame) -> DataFrame:
    """The decision for each image_id of two tables of copies (image_id, valid, content)."""
    both = primary.select("image_id", F.col("valid").alias("p"), F.col("content").alias("pc")).join(spare.select("image_id", F.col("valid").alias("s"), F.col("content").alias("sc")), "image_id", "full")
    return both.select("image_id", policy.mirror_decision(F.col("p"), F.col("s"), F.col("pc").eqNullSafe(F.col("sc"))).alias("decision"))


def duplicates(rows: DataFrame, keys: list[str] = KEY) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def discovered(candidates: DataFrame) -> DataFrame:
    """How many candidates carry each wanted uuid: unique, missing or duplicate; malformed if one of them has a broken
    table (column malformed, where there is one), as its identity can't be told then."""
    broken = F.max(F.coalesce("malformed", F.lit(False))) if "malformed" in candidates.columns else F.lit(False)
    found = candidates.groupBy("uuid").agg(F.count("device").alias("matches"), broken.alias("_broken"))
    status = F.when(F.col("_broken"), "malformed").when(F.col("matches") == 0, "missing").when(F.col("matches") == 1, "unique").otherwise("duplicate")
    return found.withColumn("status", status).drop("_broken")


def budgeted(rows: DataFrame, most_rows: int, most_bytes: int) -> DataFrame:
    """Rows (image_id, place, size) taken in order while they fit: one too large is skipped, a later small one may fit.

    Greedy, so no running sum tells it; an image has a few hundred rows here, folded in one expression.
    """
    images = rows.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("place", "size"))).alias("r"))
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("bytes"), F.array().cast("array<bigint>").alias("taken"))
    fits = lambda s, x: (s["n"] < most_rows) & (s["bytes"] + x["size"] <= most_bytes)
    step = lambda s, x: F.struct(
        (s["n"] + F.when(fits(s, x), 1).otherwise(0)).cast("bigint").alias("n"), (s["bytes"] + F.when(fits(s, x), x["size"]).otherwise(0)).cast("bigint").alias("bytes"),
        F.when(fits(s, x), F.array_append(s["taken"], x["place"].cast("bigint"))).otherwise(s["taken"]).alias("taken"),
    )
    return images.select("image_id", F.aggregate("r", start, step).alias("s"), F.size("r").alias("all")).select("image_id", "s.n", "s.bytes", F.explode("s.taken").alias("place"), (F.col("s.n") < F.col("all")).alias("truncated"))


def as_of(log: DataFrame, keys: Column) -> DataFrame:
    """A log of constant attributes with the value that its last accepted mutation before each record left in the keys
    for which keys holds (one key an image): what a later write is checked against. After a deletion there is none."""
    from .replay import window_verdicts

    so_far = Window.partitionBy(*KEY, "epoch").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = window_verdicts(log).withColumn("_k", keys)
    held = F.max(F.when((F.col("op") == "SET") | ((F.col("op") == "APPEND") & (F.length("data") > 0)), 1).otherwise(0)).over(so_far)
    value = F.array_join(F.collect_list(F.when(F.col("_k") & (F.col("op") != "DELETE"), F.col("data"))).over(so_far), "")
    rows = rows.withColumns({"_held": held, "_value": value})
    left = F.when(F.col("_k") & F.col("accepted"), F.struct(F.when((F.col("op") != "DELETE") & (F.col("_held") == 1), F.col("_value")).alias("v")))
    before = Window.partitionBy("image_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("as_of", F.last(left, ignorenulls=True).over(before)["v"]).drop("_k", "_held", "_value", "accepted", "epoch")


def inspection(verdicts: DataFrame, live: DataFrame, log_bytes: Column) -> DataFrame:
    """A diagnostic row for each image: live variables, accepted and rejected mutations, log bytes."""
    counts = verdicts.groupBy("image_id").agg(F.sum(F.col("accepted").cast("bigint")).alias("accepted"), F.sum((~F.col("accepted")).cast("bigint")).alias("rejected"), F.sum(log_bytes).cast("bigint").alias("log_bytes"))
    alive = live.groupBy("image_id").agg(F.count("*").alias("variables"))
    return counts.join(alive, "image_id", "left").withColumn("variables", F.coalesce("variables", F.lit(0)))


def anchored(counts: DataFrame, anchors: DataFrame) -> DataFrame:
    """Images (image_id, authenticated) against their monotonic anchors: a lower count than the anchor is a rollback."""
    rows = counts.join(anchors, "image_id", "left")
    behind = F.col("authenticated") < F.coalesce("anchor", F.lit(0))
    return rows.withColumns({"status": F.when(behind, "Rollback").otherwise("OK"), "next_anchor": F.greatest("authenticated", F.coalesce("anchor", F.lit(0)))})


def dump_rows(live: DataFrame) -> DataFrame:
    """name, guid, attributes and data of live variables, the binary ones as hex."""
    return live.select("image_id", F.hex(F.encode("name", "UTF-16LE")).alias("name"), "guid", "attributes", F.hex(F.encode("data", "UTF-8")).alias("data"))


def dumped(live: DataFrame, path: str) -> None:
    """dump_rows() without their image as tab-separated files, one for each partition."""
    dump_rows(live).drop("image_id").write.csv(path, sep="\t", mode="overwrite")
