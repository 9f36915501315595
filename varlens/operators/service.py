"""Reads and writes through routes: the managed store, its volatile overlay, and firmware."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import policy
from . import views

KEY = views.KEY
#: Fixed limits: a value, the overlay's bytes, runtime variables, captured firmware variables and bytes, units of a name.
MOST_VALUE, OVERLAY_BYTES, MOST_VARIABLES, MOST_CAPTURED, CAPTURED_BYTES, MOST_NAME = 65_536, 65_536, 512, 256, 512 * 1024, 256


def routed_get(keys: DataFrame, overlay: DataFrame, store: DataFrame, firmware: DataFrame) -> DataFrame:
    """keys (KEY, route) with origin, data and status of a read: a managed key from the overlay, else the store; any other from firmware alone."""
    rows = keys
    for name, df in (("overlay", overlay), ("store", store), ("firmware", firmware)):
        rows = rows.join(df.select(*KEY, F.struct("data").alias(f"_{name}")), KEY, "left")
    managed = F.col("route") == "store"
    found = F.when(managed, F.coalesce("_overlay", "_store")).otherwise(F.col("_firmware"))
    origin = F.when(found.isNull(), None).when(~managed, "firmware").when(F.col("_overlay").isNotNull(), "overlay").otherwise("store")
    return rows.withColumns({"origin": origin, "data": found["data"], "status": F.when(found.isNull(), "NotFound").otherwise("Success")}).drop("_overlay", "_store", "_firmware")


def quota(store: DataFrame, overlay: DataFrame, captured: DataFrame, most: int = MOST_VARIABLES) -> DataFrame:
    """Runtime variables of each image over the three sets (columns image_id, attributes), and whether one more fits."""
    rows = store.select("image_id", "attributes").unionAll(overlay.select("image_id", "attributes")).unionAll(captured.select("image_id", "attributes"))
    counts = rows.groupBy("image_id").agg(F.sum(policy.has(F.col("attributes"), policy.RT).cast("bigint")).alias("runtime"))
    return counts.withColumn("open", F.col("runtime") < most)


def overlay_use(overlay: DataFrame) -> DataFrame:
    """Bytes and number of each image's overlay values; a name counts with its NUL."""
    size = (F.length("name") + 1) * 2 + F.octet_length("data")
    return overlay.groupBy("image_id").agg(F.sum(size).cast("bigint").alias("overlay_bytes"), F.count("*").alias("overlay_count"))


def set_verdict(attributes: Column, size: Column, held: Column, held_size: Column, units: Column, runtime: Column, overlay_bytes: Column, overlay_count: Column, volatile_route: Column, most: int = MOST_VARIABLES) -> Column:
    """What a set of a managed key ends with: the first broken rule, else Overlay or Store, where it goes.

    held: the stored attributes or null, units: 16-bit units of the name.
    """
    has, append = policy.has, policy.APPEND
    deleting, new = policy.deleting(attributes, size), held.isNull()
    volatile = F.when(new, ~has(attributes, policy.NV)).otherwise(~has(held, policy.NV))
    used = overlay_bytes - F.when(new, 0).otherwise((units + 1) * 2 + held_size) + (units + 1) * 2 + size
    return (
        F.when((units < 1) | (units >= MOST_NAME), "InvalidParameter")
        .when(~policy.only(attributes, 0x6F), "Unsupported")
        .when(has(attributes, policy.RT) & ~has(attributes, policy.BS), "InvalidParameter")
        .when(deleting & new, "NotFound")
        .when(~deleting & ~has(attributes, policy.BS), "InvalidParameter")
        .when(~deleting & (size > MOST_VALUE), "OutOfResources")
        .when(~deleting & ~new & (held != attributes.bitwiseAND(F.lit(~append))), "InvalidParameter")
        .when(~deleting & new & has(attributes, policy.RT) & (runtime >= most), "OutOfResources")
        .when(volatile & ~deleting & ~policy.overlay_allowed(attributes), "Unsupported")
        .when(volatile & ~volatile_route, "Unsupported")
        .when(volatile & ~deleting & ((used > OVERLAY_BYTES) | (new & (overlay_count >= most))), "OutOfResources")
        .when(volatile, "Overlay")
        .otherwise("Store")
    )


def requested(requests: DataFrame, store: DataFrame, overlay: DataFrame, captured: DataFrame, most: int = MOST_VARIABLES) -> DataFrame:
    """requests (KEY, route, volatile_route, attributes, size) with outcome, each against the sets as they are (KEY, attributes, data).

    Keys that don't route to the store are firmware's to decide.
    """
    both = overlay.select(*KEY, F.lit(0).alias("rank"), "attributes", "data").unionByName(store.select(*KEY, F.lit(1).alias("rank"), "attributes", "data"))
    held = both.groupBy(*KEY).agg(F.min(F.struct("rank", "attributes", F.octet_length("data").alias("n"))).alias("h")).select(*KEY, F.col("h.attributes").alias("held"), F.col("h.n").alias("held_size"))
    rows = requests.join(held, KEY, "left").join(quota(store, overlay, captured).drop("open"), "image_id", "left").join(overlay_use(overlay), "image_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    said = set_verdict(*map(F.col, ("attributes", "size", "held", "held_size")), F.length("name"), zero("runtime"), zero("overlay_bytes"), zero("overlay_count"), F.col("volatile_route"), most)
    return rows.select(*requests.columns, F.when(F.col("route") != "store", "Firmware").otherwise(said).alias("outcome"))


def captured(firmware: DataFrame, most: int = MOST_CAPTURED, most_bytes: int = CAPTURED_BYTES) -> DataFrame:
    """Firmware variables (image_id, place, route, attributes, name, data) that a runtime index copies, with truncated.

    Those that the route leaves on firmware and that have runtime access, in order while they fit; a name or
    value beyond the limits is left out and counts as truncated. An image of which nothing is copied has no row.
    """
    size = (32 + (F.length("name") + 1) * 2 + F.octet_length("data") + 7).cast("bigint")
    fits = F.length("name").between(1, MOST_NAME - 1) & (F.octet_length("data") <= MOST_VALUE)
    rows = firmware.where((F.col("route") != "store") & policy.has(F.col("attributes"), policy.RT))
    return views.budgeted(rows.select("image_id", "place", F.when(fits, size).otherwise(most_bytes + 1).alias("size")), most, most_bytes)


def listed(store: DataFrame, overlay: DataFrame, firmware: DataFrame) -> DataFrame:
    """Keys in the order of an enumeration: the store's and the overlay's as they are, then firmware's that aren't managed, once each.

    firmware has route; part is 0 for managed keys and 1 for firmware's.
    """
    managed = store.select(*KEY).unionAll(overlay.select(*KEY)).withColumn("part", F.lit(0))
    return managed.unionAll(firmware.where("route <> 'store'").select(*KEY).distinct().withColumn("part", F.lit(1)))


def next_size(name_units: Column, capacity: Column) -> tuple[Column, Column]:
    """(bytes that the next name needs with its NUL, status) for a buffer of capacity bytes."""
    needed = (name_units + 1) * 2
    return needed, F.when(name_units.isNull(), "NotFound").when(capacity < needed, "BufferTooSmall").otherwise("Success")


def still_there(deleted: DataFrame, live: DataFrame) -> DataFrame:
    """Keys that were deleted, with Device for those that a reload still finds, else Success."""
    found = live.select(*KEY).distinct().withColumn("_there", F.lit(True))
    return deleted.join(found, KEY, "left").withColumn("status", F.when(F.col("_there"), "Device").otherwise("Success")).drop("_there")


def differences(one: DataFrame, other: DataFrame) -> DataFrame:
    """Rows that only one of two listings has, as often as it has more of them, with side."""
    return one.exceptAll(other).withColumn("side", F.lit("left")).unionByName(other.exceptAll(one).withColumn("side", F.lit("right")))
