"""Registered queries of the engine and the DuckDB SQL that each must equal."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import policy, wire
from .operators import descriptors, logstore, replay, views
from .plans import mutation_log as ml
from .sources.scratch import written_images

PHONE_CHECKPOINT, PHONE_LOG = 131_072, 778_240
_FOUND: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}

BASE, RULES = f"base AS ({ml.base_log_sql()})", f"rules AS ({ml.rules_log_sql()})"
#: Live variables of the base log, by windows.
LIVE = (
    BASE
    + """, ep AS (SELECT *, sum(CASE WHEN op <> 'APPEND' THEN 1 ELSE 0 END) OVER (PARTITION BY image_id, guid, name ORDER BY seq) AS epoch FROM base),
 ep2 AS (SELECT *, max(epoch) OVER (PARTITION BY image_id, guid, name) AS newest, max(CASE WHEN op = 'DELETE' THEN seq END) OVER (PARTITION BY image_id, guid, name) AS gone FROM ep),
 made AS (SELECT * FROM ep2 WHERE op <> 'DELETE' AND (op = 'SET' OR length(data) > 0) AND seq > coalesce(gone, -1)),
 live AS (SELECT p.image_id, p.guid, p.name, CAST(7 AS INTEGER) AS attributes, string_agg(p.data, '' ORDER BY p.seq) AS data, max(p.seq) AS last_seq, min(b.born) AS born_seq
  FROM made p JOIN (SELECT image_id, guid, name, min(seq) AS born FROM made GROUP BY ALL) b USING (image_id, guid, name) WHERE p.epoch = p.newest GROUP BY p.image_id, p.guid, p.name)"""
)
#: The rules log folded by a recursive query over each key's ordinal.
FOLD = (
    "RECURSIVE "
    + RULES
    + """, o AS (SELECT *, row_number() OVER (PARTITION BY image_id, guid, name ORDER BY seq) AS k FROM rules),
 f AS (SELECT image_id, guid, name, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS INTEGER) AS st, CAST(NULL AS VARCHAR) AS val, CAST(NULL AS VARCHAR) AS error FROM (SELECT DISTINCT image_id, guid, name FROM rules)
  UNION ALL SELECT image_id, guid, name, k, seq,
   CASE WHEN error <> 'OK' OR (op = 'APPEND' AND length(data) = 0) THEN st WHEN op = 'DELETE' THEN NULL ELSE attributes & ~64 END,
   CASE WHEN error <> 'OK' OR (op = 'APPEND' AND length(data) = 0) THEN val WHEN op = 'DELETE' THEN NULL WHEN op = 'APPEND' AND st IS NOT NULL THEN val || data ELSE data END, error
  FROM (SELECT o.*, f.st, f.val, CASE
    WHEN (f.st IS NOT NULL AND f.st & 4 = 0) OR (o.attributes <> 0 AND o.attributes & 4 = 0) THEN 'WriteProtected'
    WHEN o.attributes & 176 <> 0 OR (f.st IS NOT NULL AND f.st & 176 <> 0) THEN 'SecurityViolation'
    WHEN o.attributes & ~111 <> 0 THEN 'Unsupported'
    WHEN o.op <> 'DELETE' AND o.attributes & 7 <> 7 THEN 'InvalidParameter'
    WHEN (o.op = 'APPEND') <> (o.attributes & 64 <> 0) THEN 'InvalidParameter'
    WHEN f.st IS NOT NULL AND (o.attributes & ~64) <> f.st AND NOT (o.op = 'DELETE' AND o.attributes = 0) THEN 'InvalidParameter'
    WHEN (o.op = 'DELETE' AND length(o.data) > 0) OR (o.op = 'SET' AND length(o.data) = 0) THEN 'InvalidParameter'
    WHEN o.op = 'DELETE' AND f.st IS NULL THEN 'NotFound' ELSE 'OK' END AS error
    FROM f JOIN o ON o.image_id = f.image_id AND o.guid = f.guid AND o.name = f.name AND o.k = f.k + 1)),
 lastk AS (SELECT image_id, guid, name, max(k) AS k FROM f GROUP BY ALL),
 rlive AS (SELECT f.image_id, f.guid, f.name, f.st AS attributes, f.val AS data FROM f JOIN lastk USING (image_id, guid, name, k) WHERE st IS NOT NULL)"""
)


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        _FOUND[f.__name__] = (f, sql)
        return f

    return add


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ml.base_log(events(spark, sf_dir))


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ml.rules_log(events(spark, sf_dir))


def utf16_size(name: str) -> F.Column:
    return (2 * F.length(name)).cast("bigint")


@query(f"WITH {LIVE} SELECT image_id, guid, name, attributes, data FROM live")
def live_list(spark, sf_dir):
    return replay.window_live(base(spark, sf_dir)).select("image_id", "guid", "name", "attributes", "data")


@query(f"""WITH {BASE}, v AS (SELECT *, max(CASE WHEN op = 'SET' OR (op = 'APPEND' AND length(data) > 0) THEN seq END) OVER w AS made, max(CASE WHEN op = 'DELETE' THEN seq END) OVER w AS gone FROM base
 WINDOW w AS (PARTITION BY image_id, guid, name ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
 SELECT image_id, CAST(sum(CASE WHEN op <> 'DELETE' OR (made IS NOT NULL AND coalesce(gone, -1) < made) THEN 1 ELSE 0 END) AS BIGINT) AS accepted,
 CAST(sum(CASE WHEN op <> 'DELETE' OR (made IS NOT NULL AND coalesce(gone, -1) < made) THEN 0 ELSE 1 END) AS BIGINT) AS rejected FROM v GROUP BY image_id""")
def replay_counts(spark, sf_dir):
    rows = replay.window_verdicts(base(spark, sf_dir))
    return rows.groupBy("image_id").agg(F.sum(F.col("accepted").cast("bigint")).alias("accepted"), F.sum((~F.col("accepted")).cast("bigint")).alias("rejected"))


@query(f"WITH {FOLD} SELECT image_id, error, count(*) AS n FROM f WHERE k > 0 GROUP BY image_id, error")
def replay_rules_errors(spark, sf_dir):
    return replay.fold_outcomes(replay.fold(rules(spark, sf_dir))).groupBy("image_id", "error").agg(F.count("*").alias("n"))


@query(f"WITH {FOLD} SELECT image_id, guid, name, attributes, data FROM rlive")
def live_rules_list(spark, sf_dir):
    return replay.fold_live(replay.fold(rules(spark, sf_dir))).drop("born_seq")


@query(f"WITH {LIVE} SELECT image_id, guid, name, data FROM live WHERE image_id = 0 AND guid = 3 AND name = 'purchase'")
def point_get(spark, sf_dir):
    log = views.point_get(base(spark, sf_dir), 0, 3, "purchase")  # before the replay: only this key's history is read on
    return replay.window_live(log).select("image_id", "guid", "name", "data")


@query(f"WITH {LIVE} SELECT image_id, guid, name, octet_length(encode(data)) AS size, CASE WHEN 16 < octet_length(encode(data)) THEN 'BufferTooSmall' ELSE 'Success' END AS status FROM live")
def sized_get(spark, sf_dir):
    return views.sized_get(replay.window_live(base(spark, sf_dir)), F.lit(16)).select("image_id", "guid", "name", "size", "status")


@query(f"WITH {LIVE} SELECT image_id, guid, name, row_number() OVER (PARTITION BY image_id ORDER BY guid, name) AS place FROM live")
def enumerate_sorted(spark, sf_dir):
    return views.enumerated(replay.window_live(base(spark, sf_dir))).select("image_id", "guid", "name", "place")


@query(f"WITH {LIVE} SELECT image_id, guid, name, lead(guid) OVER w AS next_guid, lead(name) OVER w AS next_name, CASE WHEN lead(guid) OVER w IS NULL THEN 'NotFound' ELSE 'Success' END AS status FROM live WINDOW w AS (PARTITION BY image_id ORDER BY guid, name)")
def next_name(spark, sf_dir):
    return views.next_key(replay.window_live(base(spark, sf_dir)), ["guid", "name"])


@query(f"""WITH {LIVE}, n AS (SELECT image_id, guid, name, lead(guid) OVER w AS next_guid, lead(name) OVER w AS next_name FROM live WINDOW w AS (PARTITION BY image_id ORDER BY born_seq)),
 c AS (SELECT DISTINCT image_id, guid, CASE WHEN guid % 7 = 0 THEN 'unknown' ELSE name END AS name FROM live)
 SELECT c.image_id, c.guid, c.name, next_guid, next_name, CASE WHEN n.guid IS NULL THEN 'InvalidParameter' WHEN next_guid IS NULL THEN 'NotFound' ELSE 'Success' END AS status FROM c LEFT JOIN n ON c.image_id = n.image_id AND c.guid = n.guid AND c.name = n.name""")
def cursor_stored(spark, sf_dir):
    live = replay.window_live(base(spark, sf_dir))
    asked = live.select("image_id", "guid", F.when(F.col("guid") % 7 == 0, "unknown").otherwise(F.col("name")).alias("name")).distinct()
    return views.cursor(live, asked, ["born_seq"], "InvalidParameter")


@query(f"WITH {LIVE} SELECT image_id, guid, name, born_seq, row_number() OVER (PARTITION BY image_id ORDER BY born_seq) AS ordinal FROM live")
def stored_order(spark, sf_dir):
    return views.stored_order(replay.window_live(base(spark, sf_dir))).select("image_id", "guid", "name", "born_seq", "ordinal")


@query(f"WITH {RULES} SELECT image_id, seq, guid, name, attributes FROM rules WHERE attributes & 4 <> 0")
def runtime_visible(spark, sf_dir):
    return rules(spark, sf_dir).where(policy.runtime_visible(F.col("attributes"))).select("image_id", "seq", "guid", "name", "attributes")


ENTRY = "((2 * length(name) + octet_length(encode(data)) + 48 + 7) // 8) * 8"
RECORD = "((2 * length(name) + octet_length(encode(data)) + 76 + 32 + 7) // 8) * 8"


@query(f"""WITH {LIVE}, u AS (SELECT image_id, sum({ENTRY}) + 96 AS used FROM live GROUP BY image_id), l AS (SELECT image_id, sum({RECORD}) AS log_bytes FROM base GROUP BY image_id)
 SELECT image_id, CAST({PHONE_CHECKPOINT - 96} AS BIGINT) AS capacity, CAST(least({PHONE_CHECKPOINT} - used, {PHONE_LOG} - log_bytes) AS BIGINT) AS remaining FROM u JOIN l USING (image_id)""")
def capacity_nv(spark, sf_dir):
    log = base(spark, sf_dir)
    used = replay.window_live(log).groupBy("image_id").agg((F.sum(views.entry_size(utf16_size("name"), F.octet_length("data"))) + 96).alias("used"))
    logged = log.groupBy("image_id").agg(F.sum(wire.log_record_size(utf16_size("name"), F.octet_length("data"))).alias("log_bytes"))
    return views.store_capacity(used.join(logged, "image_id"), PHONE_CHECKPOINT, F.col("log_bytes"), PHONE_LOG).select("image_id", "capacity", "remaining")


@query(f"WITH {BASE} SELECT image_id, CAST({PHONE_LOG} AS BIGINT) AS capacity, CAST({PHONE_LOG} - sum({RECORD}) AS BIGINT) AS remaining, CAST({PHONE_CHECKPOINT - 146} AS BIGINT) AS largest FROM base GROUP BY image_id")
def capacity_log(spark, sf_dir):
    logged = base(spark, sf_dir).groupBy("image_id").agg(F.sum(wire.log_record_size(utf16_size("name"), F.octet_length("data"))).alias("log_bytes"))
    return views.log_query(logged, PHONE_LOG, PHONE_CHECKPOINT).drop("log_bytes")


@query(f"WITH {LIVE} SELECT image_id, CAST(65536 - sum((length(name) + 1) * 2 + octet_length(encode(data))) AS BIGINT) AS remaining FROM live GROUP BY image_id")
def capacity_volatile(spark, sf_dir):
    live = replay.window_live(base(spark, sf_dir))
    return live.groupBy("image_id").agg((F.lit(65536) - F.sum((F.length("name") + 1) * 2 + F.octet_length("data"))).cast("bigint").alias("remaining"))


OCC = (
    BASE
    + """, e AS (SELECT *, sum(CASE WHEN op <> 'APPEND' THEN 1 ELSE 0 END) OVER (PARTITION BY image_id, guid, name ORDER BY seq) AS epoch FROM base),
 g AS (SELECT *, CASE WHEN op = 'DELETE' OR max(CASE WHEN op = 'SET' OR (op = 'APPEND' AND length(data) > 0) THEN 1 ELSE 0 END) OVER w = 0 THEN 0
   ELSE CAST((2 * length(name) + sum(CASE WHEN op = 'DELETE' THEN 0 ELSE length(data) END) OVER w + 48 + 7) // 8 * 8 AS BIGINT) END AS size FROM e
   WINDOW w AS (PARTITION BY image_id, guid, name, epoch ORDER BY seq)),
 d AS (SELECT image_id, seq, CAST(size - coalesce(lag(size) OVER (PARTITION BY image_id, guid, name ORDER BY seq), 0) AS BIGINT) AS delta FROM g),
 occ AS (SELECT image_id, seq, delta, CAST(sum(delta) OVER (PARTITION BY image_id ORDER BY seq) AS BIGINT) AS used FROM d)"""
)


@query(f"WITH {OCC} SELECT * FROM occ")
def occupancy_running(spark, sf_dir):
    return replay.occupancy(base(spark, sf_dir), utf16_size("name"), F.octet_length("data"))


@query(f"WITH {OCC} SELECT image_id, min(CASE WHEN used > 2000 THEN seq END) AS first_full, CASE WHEN max(used) > 2000 THEN 'Full' ELSE 'OK' END AS status FROM occ GROUP BY image_id")
def first_full(spark, sf_dir):
    rows = replay.occupancy(base(spark, sf_dir), utf16_size("name"), F.octet_length("data"))
    return rows.groupBy("image_id").agg(F.min(F.when(F.col("used") > 2000, F.col("seq"))).alias("first_full"), F.when(F.max("used") > 2000, "Full").otherwise("OK").alias("status"))


@query(f"WITH {BASE} SELECT image_id, seq, CAST({RECORD} AS BIGINT) AS record_bytes, CAST({ENTRY} AS BIGINT) AS entry_bytes FROM base")
def record_lengths(spark, sf_dir):
    n, d = utf16_size("name"), F.octet_length("data")
    return base(spark, sf_dir).select("image_id", "seq", wire.log_record_size(n, d).alias("record_bytes"), wire.checkpoint_entry_size(n, d).alias("entry_bytes"))


#: Record versions of a flash store: physical offsets by running lengths, states by position.
RECORDS = (
    BASE
    + """, r0 AS (SELECT *, CAST((2 * length(name) + 2 + octet_length(encode(data)) + 32 + 3) // 4 * 4 AS BIGINT) AS length FROM base),
 recs AS (SELECT image_id, guid, name, data, length, CAST(100 + coalesce(sum(length) OVER (PARTITION BY image_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rec_offset,
  CASE seq % 7 WHEN 0 THEN 63 WHEN 1 THEN 62 WHEN 2 THEN 61 WHEN 3 THEN 127 WHEN 4 THEN 60 WHEN 5 THEN 62 ELSE 255 END AS state FROM r0),
 res AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, guid, name ORDER BY state DESC, CASE WHEN state = 63 THEN rec_offset ELSE -rec_offset END) AS n FROM recs WHERE state IN (62, 63)) WHERE n = 1)"""
)


def records(spark, sf_dir) -> DataFrame:
    length = wire.align(utf16_size("name") + 2 + F.octet_length("data") + 32, 4)
    before = Window.partitionBy("image_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    state = F.element_at(F.array(*map(F.lit, (63, 62, 61, 127, 60, 62, 255))), (F.col("seq") % 7 + 1).cast("int"))
    rows = base(spark, sf_dir).withColumn("length", length)
    return rows.select("image_id", "guid", "name", "data", "length", (F.coalesce(F.sum("length").over(before), F.lit(0)) + 100).cast("bigint").alias("rec_offset"), state.alias("state"))


@query(f"WITH {RECORDS} SELECT image_id, guid, name, data, rec_offset, state FROM res")
def resolve_versions(spark, sf_dir):
    return views.resolve(records(spark, sf_dir)).drop("length")


@query(f"WITH {RECORDS} SELECT image_id, guid, name, rec_offset, CAST(100 + coalesce(sum(length) OVER (PARTITION BY image_id ORDER BY rec_offset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS new_offset, 63 AS state FROM res")
def reclaim_offsets(spark, sf_dir):
    return views.reclaimed(views.resolve(records(spark, sf_dir)), F.lit(100)).select("image_id", "guid", "name", "rec_offset", "new_offset", "state")


@query(f"""WITH {RECORDS}, s AS (SELECT image_id, 65536 - (max(rec_offset + length) - 100) AS free FROM recs GROUP BY image_id), k AS (SELECT image_id, sum(length) AS scratch FROM res GROUP BY image_id)
 SELECT image_id, CAST(free AS BIGINT) AS free, CAST(scratch AS BIGINT) AS scratch, free < 16384 AS needs_reclaim FROM s JOIN k USING (image_id)""")
def needs_reclaim(spark, sf_dir):
    rows = records(spark, sf_dir)
    free = rows.groupBy("image_id").agg((F.lit(65536) - (F.max(F.col("rec_offset") + F.col("length")) - 100)).cast("bigint").alias("free"))
    kept = views.resolve(rows).groupBy("image_id").agg(F.sum("length").cast("bigint").alias("scratch"))
    return free.join(kept, "image_id").withColumn("needs_reclaim", views.needs_reclaim(F.col("free"), F.lit(65536)))


@query(f"""WITH {BASE}, b AS (SELECT image_id, guid, name, seq, op, CASE WHEN op = 'DELETE' THEN '' WHEN seq % 3 = 0 THEN 'same' ELSE data END AS data FROM base),
 l AS (SELECT *, lag(CASE WHEN data <> '' THEN data END) OVER (PARTITION BY image_id, guid, name ORDER BY seq) AS before FROM b)
 SELECT image_id, seq, guid, name, CASE WHEN data <> '' AND before = data THEN 'Unchanged' WHEN data = '' AND before IS NULL THEN 'Absent' WHEN data = '' THEN 'Deleted' ELSE 'Written' END AS outcome FROM l""")
def outcomes_edk2(spark, sf_dir):
    data = F.when(F.col("op") == "DELETE", "").when(F.col("seq") % 3 == 0, "same").otherwise(F.col("data"))
    rows = base(spark, sf_dir).withColumns({"data": data, "attributes": F.lit(7)})
    return views.change_outcomes(rows).select("image_id", "seq", "guid", "name", "outcome")


HEADERS = f"h AS (SELECT {ml.IMAGE_SQL} AS image_id, CASE WHEN event_id % 2 = 0 THEN 0 ELSE 4096 END AS header_offset, event_id // 4 AS generation, event_id % 11 <> 0 AS valid FROM events)"


@query(f"WITH {HEADERS} SELECT image_id, header_offset, generation FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY generation DESC, header_offset) AS n FROM h WHERE valid) WHERE n = 1")
def header_select(spark, sf_dir):
    e = F.col("event_id")
    rows = events(spark, sf_dir).select(ml.image().alias("image_id"), F.when(e % 2 == 0, 0).otherwise(4096).alias("header_offset"), F.floor(e / 4).alias("generation"), (e % 11 != 0).alias("valid"))
    return views.select_header(rows).select("image_id", "header_offset", "generation")


#: A hash for each record over what it holds; each names its predecessor's, but for some broken ones.
CHAIN = BASE + """, hs AS (SELECT image_id, seq, sha256(image_id || '|' || seq || '|' || guid || '|' || name || '|' || op || '|' || data) AS hash FROM base),
 ch AS (SELECT *, CASE WHEN seq % 97 = 96 THEN 'broken' ELSE coalesce(lag(hash) OVER (PARTITION BY image_id ORDER BY seq), 'checkpoint') END AS prev_hash FROM hs),
 ck AS (SELECT *, prev_hash = coalesce(lag(hash) OVER (PARTITION BY image_id ORDER BY seq), 'checkpoint') AS link_ok FROM ch)"""  # fmt: skip


def chain(spark, sf_dir) -> DataFrame:
    hashed = base(spark, sf_dir).select("image_id", "seq", F.sha2(F.concat_ws("|", "image_id", "seq", "guid", "name", "op", "data"), 256).alias("hash"))
    previous = F.coalesce(F.lag("hash").over(Window.partitionBy("image_id").orderBy("seq")), F.lit("checkpoint"))
    return views.chain_checked(hashed.withColumn("prev_hash", F.when(F.col("seq") % 97 == 96, "broken").otherwise(previous)), F.lit("checkpoint"))


@query(f"WITH {CHAIN} SELECT image_id, seq, hash, link_ok FROM ck")
def hash_chain_ok(spark, sf_dir):
    return chain(spark, sf_dir).select("image_id", "seq", "hash", "link_ok")


@query(f"WITH {CHAIN}, k AS (SELECT *, min(CASE WHEN link_ok THEN 1 ELSE 0 END) OVER (PARTITION BY image_id ORDER BY seq) AS good FROM ck) SELECT image_id, CAST(sum(good) AS BIGINT) AS kept, count(*) AS records, CASE WHEN min(good) = 1 THEN 'Clean' ELSE 'Torn' END AS log_end FROM k GROUP BY image_id")
def torn_prefix(spark, sf_dir):
    return chain(spark, sf_dir).groupBy("image_id").agg(F.sum(F.col("kept").cast("bigint")).alias("kept"), F.count("*").alias("records"), F.when(F.min("kept"), "Clean").otherwise("Torn").alias("log_end"))


@query(f"""WITH {LIVE}, nr AS (SELECT DISTINCT guid, 'click' AS name, CASE WHEN guid % 2 = 0 THEN 'store' ELSE 'firmware' END AS route FROM live WHERE guid % 3 = 0), gr AS (SELECT DISTINCT guid, 'store' AS route FROM live WHERE guid % 5 < 3)
 SELECT l.image_id, l.guid, l.name, coalesce(nr.route, gr.route, 'firmware') AS route FROM live l LEFT JOIN nr ON l.guid = nr.guid AND l.name = nr.name LEFT JOIN gr ON l.guid = gr.guid""")
def route_keys(spark, sf_dir):
    live = replay.window_live(base(spark, sf_dir)).select("image_id", "guid", "name")
    guids = live.select("guid").distinct()
    names = guids.where("guid % 3 = 0").select("guid", F.lit("click").alias("name"), F.when(F.col("guid") % 2 == 0, "store").otherwise("firmware").alias("route"))
    return views.routed(live, names, guids.where("guid % 5 < 3").select("guid", F.lit("store").alias("route")))


SETS = LIVE + """, ov AS (SELECT image_id, guid, name, 'overlay' AS data FROM live WHERE guid % 4 = 0), st AS (SELECT image_id, guid, name, data FROM live WHERE guid % 3 <> 0),
 fw AS (SELECT image_id, guid, name, 'fw:' || name AS data FROM live)"""  # fmt: skip


def sets(spark, sf_dir):
    live = replay.window_live(base(spark, sf_dir)).select("image_id", "guid", "name", "data")
    return live.where("guid % 3 <> 0"), live.where("guid % 4 = 0").withColumn("data", F.lit("overlay")), live.withColumn("data", F.concat(F.lit("fw:"), "name"))


@query(f"""WITH {SETS}, u AS (SELECT *, 0 AS r, 'overlay' AS origin FROM ov UNION ALL SELECT *, 1, 'store' FROM st UNION ALL SELECT *, 2, 'firmware' FROM fw)
 SELECT image_id, guid, name, origin, data FROM (SELECT *, row_number() OVER (PARTITION BY image_id, guid, name ORDER BY r) AS n FROM u) WHERE n = 1""")
def merged_listing(spark, sf_dir):
    return views.merged(*sets(spark, sf_dir))


@query(f"WITH {SETS} SELECT image_id, guid, name, data FROM fw WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.image_id = fw.image_id AND st.guid = fw.guid AND st.name = fw.name)")
def firmware_suppressed(spark, sf_dir):
    store, _, firmware = sets(spark, sf_dir)
    return firmware.join(store, views.KEY, "left_anti")


@query("""WITH p AS (SELECT user_id AS image_id, count(*) % 5 <> 0 AS valid, min(props) AS content FROM events WHERE user_id % 9 <> 0 GROUP BY user_id),
 s AS (SELECT user_id AS image_id, count(*) % 3 <> 0 AS valid, CASE WHEN user_id % 2 = 0 THEN min(props) ELSE max(props) END AS content FROM events WHERE user_id % 7 <> 0 GROUP BY user_id)
 SELECT coalesce(p.image_id, s.image_id) AS image_id, CASE WHEN p.valid AND s.valid AND p.content = s.content THEN 'Unchanged' WHEN p.valid THEN 'Mirror' WHEN s.valid THEN 'Restore' ELSE 'Invalid' END AS decision FROM p FULL JOIN s ON p.image_id = s.image_id""")
def mirror_decide(spark, sf_dir):
    rows = events(spark, sf_dir).groupBy(F.col("user_id").alias("image_id")).agg(F.count("*").alias("n"), F.min("props").alias("low"), F.max("props").alias("high"))
    primary = rows.where("image_id % 9 <> 0").select("image_id", (F.col("n") % 5 != 0).alias("valid"), F.col("low").alias("content"))
    spare = rows.where("image_id % 7 <> 0").select("image_id", (F.col("n") % 3 != 0).alias("valid"), F.when(F.col("image_id") % 2 == 0, F.col("low")).otherwise(F.col("high")).alias("content"))
    return views.mirrored(primary, spare)


NAMES = "x AS (SELECT event_id, CASE user_id % 4 WHEN 0 THEN 'global' WHEN 1 THEN 'image' WHEN 2 THEN 'shim' ELSE 'other' END AS space, list_extract(['PK','KEK','db','dbx','dbt','dbr','MokList','MokSBState','SecureBoot','SetupMode','OsRecoveryOrder','OsRecovery0001','pk'], CAST(event_id % 13 + 1 AS INTEGER)) AS key FROM events)"


def names(spark, sf_dir) -> DataFrame:
    pick = F.element_at(F.array(*map(F.lit, ("PK", "KEK", "db", "dbx", "dbt", "dbr", "MokList", "MokSBState", "SecureBoot", "SetupMode", "OsRecoveryOrder", "OsRecovery0001", "pk"))), (F.col("event_id") % 13 + 1).cast("int"))
    u = F.col("user_id") % 4
    return events(spark, sf_dir).select("event_id", F.when(u == 0, "global").when(u == 1, "image").when(u == 2, "shim").otherwise("other").alias("space"), pick.alias("key"))


@query(f"""WITH {NAMES} SELECT event_id, space, key, CASE WHEN space = 'shim' AND key IN ('MokList', 'MokListX', 'MokSBState', 'MokDBState', 'MokIgnoreDB', 'MokListTrusted') THEN 'boot_services_only'
 WHEN space = 'global' AND key IN ('SecureBoot', 'SetupMode', 'AuditMode', 'DeployedMode') THEN 'policy'
 WHEN (space = 'global' AND key IN ('PK', 'KEK')) OR (space = 'image' AND key IN ('db', 'dbx', 'dbt', 'dbr')) THEN 'secure_boot_key' END AS protection FROM x""")
def protected_names(spark, sf_dir):
    return names(spark, sf_dir).withColumn("protection", policy.protection(F.col("space"), F.col("key")))


@query(f"""WITH {NAMES} SELECT event_id, CASE WHEN space = 'global' AND key = 'PK' THEN 'PlatformKey' WHEN space = 'global' AND key = 'KEK' THEN 'KeyExchangeKey' WHEN space = 'global' AND key = 'OsRecoveryOrder' THEN 'OsRecovery'
 WHEN space = 'image' AND key IN ('db', 'dbx', 'dbt', 'dbr') THEN upper(key[1]) || key[2:] ELSE 'Private' END AS role FROM x""")
def roles(spark, sf_dir):
    return names(spark, sf_dir).select("event_id", policy.role(F.col("space"), F.col("key")).alias("role"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'Deployed' WHEN event_id % 3 = 0 THEN 'Audit' WHEN event_id % 2 = 0 THEN 'Setup' ELSE 'User' END AS mode FROM events")
def secure_boot_mode(spark, sf_dir):
    bit = lambda n: (F.col("event_id") % n == 0).cast("int")
    return events(spark, sf_dir).select("event_id", policy.mode(bit(2), bit(3), bit(5)).alias("mode"))


AUTHS = """a AS (SELECT event_id, CAST(list_extract([39, 103, 135, 199, 7, 55, 167, 295], CAST(event_id % 8 + 1 AS INTEGER)) AS BIGINT) AS attributes, CASE WHEN event_id % 8 IN (2, 3) THEN 'Authentication3' ELSE 'Authentication2' END AS descriptor,
 CASE WHEN event_id % 8 IN (2, 3) THEN NULL WHEN event_id % 19 = 0 THEN 0 ELSE event_id % 100 END AS time, event_id % 3 <> 0 AS stored,
 CASE WHEN event_id % 13 = 0 THEN CAST(7 AS BIGINT) WHEN event_id % 8 IN (2, 3) THEN 135 ELSE 39 END AS sa, CASE WHEN event_id % 29 = 0 THEN NULL ELSE (event_id * 7) % 100 END AS st, event_id % 4 AS size FROM events)"""


def requests(spark, sf_dir) -> DataFrame:
    e = F.col("event_id")
    word = F.element_at(F.array(*map(F.lit, (39, 103, 135, 199, 7, 55, 167, 295))), (e % 8 + 1).cast("int")).cast("bigint")
    third = (e % 8).isin(2, 3)
    return events(spark, sf_dir).select(
        "event_id", word.alias("attributes"), F.when(third, "Authentication3").otherwise("Authentication2").alias("descriptor"), F.when(third, None).when(e % 19 == 0, 0).otherwise(e % 100).alias("time"),
        (e % 3 != 0).alias("stored"), F.when(e % 13 == 0, 7).when(third, 135).otherwise(39).cast("bigint").alias("sa"), F.when(e % 29 == 0, None).otherwise(e * 7 % 100).alias("st"), (e % 4).alias("size"),
    )


PLAN = "CASE WHEN size = 0 AND attributes & 64 <> 0 THEN 'Append' WHEN size = 0 THEN 'Delete' WHEN attributes & 64 <> 0 AND stored THEN 'Append' ELSE 'Replace' END"
SELECTED = "CASE WHEN attributes & ~255 <> 0 THEN 'Attributes' WHEN attributes & 16 <> 0 THEN 'Descriptor' WHEN attributes & 160 = 32 THEN 'Authentication2' WHEN attributes & 160 = 128 THEN 'Authentication3' ELSE 'Descriptor' END"


@query(f"WITH {AUTHS} SELECT event_id, {PLAN} AS plan FROM a")
def auth_plan(spark, sf_dir):
    return requests(spark, sf_dir).select("event_id", policy.plan(F.col("attributes"), F.col("size"), F.col("stored")).alias("plan"))


@query(f"""WITH {AUTHS}, c AS (SELECT *, {SELECTED} AS sel FROM a) SELECT event_id, CASE WHEN sel IN ('Attributes', 'Descriptor') THEN sel WHEN sel <> descriptor THEN 'Descriptor' WHEN attributes & 64 <> 0 AND sel = 'Authentication3' THEN 'AppendWrite'
 WHEN stored AND sa <> attributes & ~64 THEN 'AttributeChange' WHEN time IS NULL THEN {PLAN} WHEN time = 0 AND attributes & 64 = 0 THEN 'TimeStamp' WHEN attributes & 64 <> 0 OR NOT stored THEN {PLAN} WHEN st IS NULL THEN 'MissingTimeStamp' WHEN time <= st THEN 'Stale' ELSE {PLAN} END AS result FROM c""")
def auth_check(spark, sf_dir):
    c = F.col
    return requests(spark, sf_dir).select("event_id", policy.auth_check(c("attributes"), c("descriptor"), c("time"), c("stored"), c("sa"), c("st"), c("size")).alias("result"))


@query("""SELECT event_id, (year(ts), month(ts), day(ts), hour(ts), minute(ts), CAST(second(ts) AS BIGINT)) > lag((year(ts), month(ts), day(ts), hour(ts), minute(ts), CAST(second(ts) AS BIGINT))) OVER (PARTITION BY user_id ORDER BY event_id) AS later FROM events""")
def time_order(spark, sf_dir):
    t = F.struct(*[F.expr(f"{part}(ts)").alias(part) for part in ("year", "month", "day", "hour", "minute", "second")])
    return events(spark, sf_dir).select("event_id", (t > F.lag(t).over(Window.partitionBy("user_id").orderBy("event_id"))).alias("later"))


@query(f"WITH {BASE} SELECT image_id, guid, name, count(*) AS copies FROM base GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return views.duplicates(base(spark, sf_dir))


@query("SELECT user_id AS uuid, count(CASE WHEN event_id % 40 = 0 THEN event_id END) AS matches, CASE count(CASE WHEN event_id % 40 = 0 THEN event_id END) WHEN 0 THEN 'missing' WHEN 1 THEN 'unique' ELSE 'duplicate' END AS status FROM events GROUP BY user_id")
def discover_unique(spark, sf_dir):
    return views.discovered(events(spark, sf_dir).select(F.col("user_id").alias("uuid"), F.when(F.col("event_id") % 40 == 0, F.col("event_id")).alias("device")))


@query(f"""WITH RECURSIVE {BASE}, r AS (SELECT image_id, seq + 1 AS k, length(data) * 40 + 20 AS size FROM base), f AS (SELECT DISTINCT image_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS bytes, FALSE AS took FROM r
 UNION ALL SELECT r.image_id, r.k, CASE WHEN f.n < 60 AND f.bytes + r.size <= 16384 THEN f.n + 1 ELSE f.n END, CASE WHEN f.n < 60 AND f.bytes + r.size <= 16384 THEN f.bytes + r.size ELSE f.bytes END, f.n < 60 AND f.bytes + r.size <= 16384 FROM f JOIN r ON r.image_id = f.image_id AND r.k = f.k + 1)
 SELECT image_id, k - 1 AS place FROM f WHERE took""")
def capture_budget(spark, sf_dir):
    rows = base(spark, sf_dir).select("image_id", F.col("seq").alias("place"), (F.length("data") * 40 + 20).cast("bigint").alias("size"))
    return views.budgeted(rows, 60, 16384).select("image_id", "place")


@query(f"""WITH {BASE}, ep AS (SELECT *, sum(CASE WHEN op <> 'APPEND' THEN 1 ELSE 0 END) OVER (PARTITION BY image_id, guid, name ORDER BY seq) AS epoch FROM base),
 x AS (SELECT *, guid % 8 = 3 AND name = 'purchase' AS k, string_agg(CASE WHEN op <> 'DELETE' THEN data END, '') OVER w AS value, max(CASE WHEN op = 'SET' OR (op = 'APPEND' AND length(data) > 0) THEN 1 ELSE 0 END) OVER w AS held,
  max(CASE WHEN op = 'SET' OR (op = 'APPEND' AND length(data) > 0) THEN seq END) OVER b AS made, max(CASE WHEN op = 'DELETE' THEN seq END) OVER b AS gone FROM ep
  WINDOW w AS (PARTITION BY image_id, guid, name, epoch ORDER BY seq), b AS (PARTITION BY image_id, guid, name ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 y AS (SELECT *, CASE WHEN k AND (op <> 'DELETE' OR (made IS NOT NULL AND coalesce(gone, -1) < made)) THEN CASE WHEN op <> 'DELETE' AND held = 1 THEN '=' || value ELSE '-' END END AS event FROM x),
 z AS (SELECT image_id, seq, last_value(event IGNORE NULLS) OVER (PARTITION BY image_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM y)
 SELECT image_id, seq, CASE WHEN e[1] = '=' THEN e[2:] END AS as_of FROM z""")
def key_as_of(spark, sf_dir):
    return views.as_of(base(spark, sf_dir), (F.col("guid") % 8 == 3) & (F.col("name") == "purchase")).select("image_id", "seq", "as_of")


@query(f"""WITH {LIVE}, v AS (SELECT *, max(CASE WHEN op = 'SET' OR (op = 'APPEND' AND length(data) > 0) THEN seq END) OVER w AS made, max(CASE WHEN op = 'DELETE' THEN seq END) OVER w AS was_gone FROM base
 WINDOW w AS (PARTITION BY image_id, guid, name ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), a AS (SELECT *, op <> 'DELETE' OR (made IS NOT NULL AND coalesce(was_gone, -1) < made) AS accepted FROM v),
 c AS (SELECT image_id, CAST(count(*) FILTER (WHERE accepted) AS BIGINT) AS accepted, CAST(count(*) FILTER (WHERE NOT accepted) AS BIGINT) AS rejected, CAST(sum({RECORD}) AS BIGINT) AS log_bytes FROM a GROUP BY image_id)
 SELECT c.*, coalesce(n, 0) AS variables FROM c LEFT JOIN (SELECT image_id, count(*) AS n FROM live GROUP BY image_id) USING (image_id)""")
def inspect_images(spark, sf_dir):
    log = base(spark, sf_dir)
    return views.inspection(replay.window_verdicts(log), replay.window_live(log), wire.log_record_size(utf16_size("name"), F.octet_length("data")))


@query("""WITH c AS (SELECT user_id AS image_id, count(*) AS authenticated FROM events GROUP BY user_id), a AS (SELECT image_id, CAST(60 + image_id % 20 AS BIGINT) AS anchor FROM c WHERE image_id % 5 <> 0)
 SELECT c.image_id, authenticated, CASE WHEN authenticated < coalesce(anchor, 0) THEN 'Rollback' ELSE 'OK' END AS status, greatest(authenticated, coalesce(anchor, 0)) AS next_anchor FROM c LEFT JOIN a ON a.image_id = c.image_id""")
def anchor_check(spark, sf_dir):
    counts = events(spark, sf_dir).groupBy(F.col("user_id").alias("image_id")).agg(F.count("*").alias("authenticated"))
    anchors = counts.where("image_id % 5 <> 0").select("image_id", (F.col("image_id") % 20 + 60).cast("bigint").alias("anchor"))
    return views.anchored(counts, anchors).drop("anchor")


def wire_log(spark, sf_dir) -> DataFrame:
    """The base log with keys and values as they are stored: image_id, place, op, attributes, guid, name_wire, data."""
    return base(spark, sf_dir).select(
        F.col("image_id").cast("string").alias("image_id"), F.col("seq").alias("place"), "op", F.col("attributes").cast("bigint").alias("attributes"), F.unhex(F.md5(F.col("guid").cast("string"))).alias("guid"),
        wire.name_bytes(F.col("name")).alias("name_wire"), F.encode("data", "UTF-8").alias("data"),
    )


def image_rows(spark, sf_dir, capacity: int | None = None) -> DataFrame:
    """An encoded image for each image of the base log: an empty checkpoint and a log of its mutations, all of them, as long as they are."""
    log = wire_log(spark, sf_dir)
    return written_images(logstore.encode_images(log.limit(0).drop("op"), log, None, capacity).drop("status"), "images")


@query(f"WITH {BASE} SELECT CAST(image_id AS VARCHAR) AS image_id, seq, name, data, op, attributes FROM base")
def decode_roundtrip(spark, sf_dir):
    return logstore.mutations(image_rows(spark, sf_dir)).select("image_id", "seq", wire.lossy_text(F.unhex("name")).alias("name"), F.decode(F.unhex("data"), "UTF-8").alias("data"), "op", "attributes")


@query(f"WITH {BASE} SELECT CAST(image_id AS VARCHAR) AS image_id, CAST(h.o AS BIGINT) AS header_offset, CAST(CASE h.o WHEN 0 THEN 1 ELSE 0 END AS INTEGER) AS generation, 'OK' AS status, h.o = 0 AS selected FROM (SELECT DISTINCT image_id FROM base), (SELECT unnest([0, 4096]) AS o) h")
def header_crc(spark, sf_dir):
    rows = logstore.headers(image_rows(spark, sf_dir))
    return rows.select("image_id", "header_offset", F.col("generation").cast("int").alias("generation"), "status", "selected")


#: A smaller limit than the format's, so that some images have more variables than an index takes.
INDEXED = 30


@query(f"""WITH {LIVE}, n AS (SELECT image_id, count(*) AS n FROM live GROUP BY image_id) SELECT CAST(image_id AS VARCHAR) AS image_id, 'OK' AS status, row_number() OVER (PARTITION BY image_id ORDER BY md5(guid::VARCHAR), name) - 1 AS place, name, data FROM live JOIN n USING (image_id) WHERE n <= {INDEXED}
 UNION ALL SELECT CAST(image_id AS VARCHAR), 'OutOfResources', NULL, NULL, NULL FROM n WHERE n > {INDEXED}""")
def index_roundtrip(spark, sf_dir):
    live = replay.window_live(base(spark, sf_dir))
    rows = live.select("image_id", F.unhex(F.md5(F.col("guid").cast("string"))).alias("guid"), wire.name_bytes(F.col("name")).alias("name_wire"), "attributes", F.encode("data", "UTF-8").alias("data"))
    found = descriptors.index_variables(descriptors.index_images(rows, most=INDEXED))
    return found.select("image_id", "status", "place", wire.lossy_text(F.col("name_wire")).alias("name"), F.decode("data", "UTF-8").alias("data"))


def _every() -> dict:
    from . import format_queries, service_queries  # noqa: F401  they add theirs to _FOUND

    return _FOUND


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in _every().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _every().items() if sql}
