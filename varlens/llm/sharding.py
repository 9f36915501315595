"""Sharding over fixed virtual slots.

A record's key hashes into one of SLOTS virtual slots, now and for ever. A versioned slot map says
which shard each slot belongs to; growing or rebalancing edits the map, never the hash, so only the
rows of edited slots move. The map has SLOTS rows at most, whatever the corpus holds.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import there, written

SLOTS = 4096
#: Parts that a slot's rows are dealt into to be numbered.
SALTS = 256
MAP = "version long, vslot int, shard int"


def vslot(key: Column, slots: int = SLOTS) -> Column:
    """The virtual slot of a key; a null key has one too."""
    return F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.lit(""))), F.lit(slots)).cast("int")


def first_map(shards: int, slots: int = SLOTS) -> list[tuple[int, int, int]]:
    """Version 1: slots dealt to shards in turn, so that shard counts of slots differ by one at most."""
    return [(1, s, s % shards) for s in range(slots)]


def grown(rows: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The next version with one more shard, which takes its fair share of slots from the fullest shards.

    No other slot changes hands. Which slots move depends on the map alone, never on the data.
    """
    owned: dict[int, list[int]] = {}
    for _, slot, shard in rows:
        owned.setdefault(shard, []).append(slot)
    new, moved = len(owned), set()
    for _ in range(len(rows) // (new + 1)):
        giver = max(owned, key=lambda s: (len(owned[s]), -s))
        moved.add(owned[giver].pop())
    return [(v + 1, slot, new if slot in moved else shard) for v, slot, shard in rows]


def rebalanced(rows: list[tuple[int, int, int]], slot_bytes: dict[int, int], tolerance: float = 0.05) -> list[tuple[int, int, int]]:
    """The next version, edited until no shard holds more than (1 + tolerance) of the mean bytes or no move helps.

    Each edit gives the largest slot that still fits from the fullest shard to the emptiest. A slot is
    never split: one above the mean stays alone at best.
    """
    where = {slot: shard for _, slot, shard in rows}
    load = {shard: 0 for shard in where.values()}
    for slot, shard in where.items():
        load[shard] += slot_bytes.get(slot, 0)
    most = (1 + tolerance) * sum(load.values()) / max(1, len(load))
    for _ in range(len(rows)):
        top, low = max(load, key=lambda s: (load[s], -s)), min(load, key=lambda s: (load[s], s))
        fits = [(slot_bytes.get(s, 0), s) for s, shard in where.items() if shard == top and 0 < slot_bytes.get(s, 0) < load[top] - load[low]]
        if load[top] <= most or not fits:
            break
        half = (load[top] - load[low]) / 2
        size, slot = min(fits, key=lambda x: (abs(x[0] - half), x[1]))
        where[slot] = low
        load[top], load[low] = load[top] - size, load[low] + size
    return [(v + 1, slot, where[slot]) for v, slot, _ in rows]


def map_table(spark: SparkSession, rows: list[tuple[int, int, int]]) -> DataFrame:
    return spark.createDataFrame(rows, MAP)


def save_map(spark: SparkSession, rows: list[tuple[int, int, int]], path: str) -> None:
    """Add one version of a map to the table at path; older versions stay readable, and a version is written once."""
    version = rows[0][0]
    if version in {r.version for r in stored_maps(spark, path).select("version").distinct().collect()}:
        raise ValueError(f"version {version} of the slot map at {path} is there already")
    map_table(spark, rows).coalesce(1).write.mode("append").parquet(path)


def stored_maps(spark: SparkSession, path: str) -> DataFrame:
    """All versions of the map at path; none where nothing is stored yet."""
    return spark.read.schema(MAP).parquet(path) if there(spark, path) else map_table(spark, [])


def load_map(spark: SparkSession, path: str, version: int | None = None) -> list[tuple[int, int, int]]:
    """A version of the map, the latest by default: SLOTS rows."""
    df = stored_maps(spark, path)
    version = version or df.agg(F.max("version")).first()[0]
    return sorted((r.version, r.vslot, r.shard) for r in df.where(F.col("version") == version).collect())


def slot_bytes(sized: DataFrame) -> DataFrame:
    """Rows and bytes of each virtual slot (columns vslot and size in, at most SLOTS rows out)."""
    return sized.groupBy("vslot").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))


def sized_rows(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text plus 1), text_crc32 and vslot of each row; a null text has no bytes."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select("doc_id", (F.octet_length(raw).cast("long") + 1).alias("size"), F.crc32(raw).alias("text_crc32"), vslot(F.col("doc_id")).alias("vslot"))


def shard_rows(docs: DataFrame, maps: dict[str, list[tuple[int, int, int]]], sizes: DataFrame | None = None) -> DataFrame:
    """Each row with its shard under each of the maps (name of the column -> map), and its place in the shard of the first
    one (slot: gapless from 0). sizes (slot_bytes()) adds vslot_bytes, the bytes of the row's virtual slot.

    Rows of a virtual slot are dealt into SALTS parts whatever they hold, and counted in them; a part begins
    where the parts before it end. So no task holds a shard or all rows of one id. Which part a row is in is
    written down first, so that a task that runs again finds it there. Equal ids share a slot; repeated rows
    have a place each; null and empty texts have size 1, very long ones count whole; an empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    rows = written(sized_rows(docs).withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")), "sized-rows")
    slots = None
    for name, rows_ in maps.items():
        one = map_table(spark, rows_).select("vslot", F.col("shard").alias(name))
        slots = one if slots is None else slots.join(one, "vslot")
    if sizes is not None:
        slots = slots.join(sizes.select("vslot", F.col("bytes").alias("vslot_bytes")), "vslot", "left")
    rows = rows.join(F.broadcast(slots), "vslot")  # SLOTS rows
    shard = next(iter(maps))
    groups = rows.groupBy(shard, "vslot", "salt").agg(F.count("*").alias("n"))  # SLOTS * SALTS rows at most
    before = Window.partitionBy(shard).orderBy("vslot", "salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("vslot", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy("vslot", "salt").orderBy("doc_id", "text_crc32", "size"))
    return rows.withColumn("place", place).join(groups, ["vslot", "salt"]).withColumn("slot", F.col("base") + F.col("place") - 1)
