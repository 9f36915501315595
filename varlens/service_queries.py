"""Registered queries over the routed service: reads, writes, quotas, listings, targets, statuses."""

from pyspark.sql import functions as F

from .format_queries import picked
from .functions import policy
from .operators import descriptors, replay, service, views
from .queries import LIVE, RULES, SETS, base, events, query, rules, sets

#: Routes of keys in these queries: some GUIDs go to the store, some of those allow volatile values.
ROUTE = "CASE WHEN guid % 5 < 3 THEN 'store' ELSE 'firmware' END"


def route():
    return F.when(F.col("guid") % 5 < 3, "store").otherwise("firmware")


@query(f"""WITH {SETS}, k AS (SELECT image_id, guid, name, {ROUTE} AS route FROM live), j AS (SELECT k.*, ov.data AS o, st.data AS s, fw.data AS f FROM k LEFT JOIN ov USING (image_id, guid, name) LEFT JOIN st USING (image_id, guid, name) LEFT JOIN fw USING (image_id, guid, name))
 SELECT image_id, guid, name, route, CASE WHEN route = 'firmware' THEN CASE WHEN f IS NOT NULL THEN 'firmware' END WHEN o IS NOT NULL THEN 'overlay' WHEN s IS NOT NULL THEN 'store' END AS origin,
 CASE WHEN route = 'firmware' THEN f ELSE coalesce(o, s) END AS data, CASE WHEN CASE WHEN route = 'firmware' THEN f ELSE coalesce(o, s) END IS NULL THEN 'NotFound' ELSE 'Success' END AS status FROM j""")
def service_get(spark, sf_dir):
    store, overlay, firmware = sets(spark, sf_dir)
    keys = replay.window_live(base(spark, sf_dir)).select("image_id", "guid", "name").withColumn("route", route())
    return service.routed_get(keys, overlay, store, firmware)


#: A smaller quota than the format's, so that images reach it.
QUOTA = 60
WORDS = "list_extract([7, 6, 3, 71, 0, 5, 263, 2], CAST(seq % 8 + 1 AS INTEGER))"


@query(f"""WITH {SETS}, rules AS (SELECT * FROM ({RULES[RULES.index("(") + 1 : -1]})), rt AS (SELECT image_id, count(*) AS runtime FROM (SELECT image_id FROM st UNION ALL SELECT image_id FROM ov UNION ALL SELECT image_id FROM fw WHERE guid % 5 >= 3) GROUP BY image_id),
 ou AS (SELECT image_id, sum((length(name) + 1) * 2 + 7) AS used, count(*) AS n FROM ov GROUP BY image_id),
 q AS (SELECT r.image_id, r.seq, r.guid, r.name, {ROUTE.replace("guid", "r.guid")} AS route, r.guid % 2 = 0 AS vol, CAST({WORDS.replace("seq", "r.seq")} AS BIGINT) AS a, CASE WHEN r.seq % 23 = 0 THEN 70000 ELSE length(r.data) END AS size FROM rules r),
 h AS (SELECT q.*, CASE WHEN ov.data IS NOT NULL THEN 6 WHEN st.data IS NOT NULL THEN 7 END AS held, coalesce(octet_length(encode(ov.data)), octet_length(encode(st.data))) AS held_size, coalesce(rt.runtime, 0) AS runtime, coalesce(ou.used, 0) AS used, coalesce(ou.n, 0) AS n
  FROM q LEFT JOIN ov USING (image_id, guid, name) LEFT JOIN st USING (image_id, guid, name) LEFT JOIN rt ON rt.image_id = q.image_id LEFT JOIN ou ON ou.image_id = q.image_id),
 v AS (SELECT *, a = 0 OR (size = 0 AND a & 64 = 0) AS del, held IS NULL AS fresh, CASE WHEN held IS NULL THEN a & 1 = 0 ELSE held & 1 = 0 END AS volatile, used - CASE WHEN held IS NULL THEN 0 ELSE (length(name) + 1) * 2 + held_size END + (length(name) + 1) * 2 + size AS after_ FROM h)
 SELECT image_id, seq, CASE WHEN route <> 'store' THEN 'Firmware' WHEN a & ~111 <> 0 THEN 'Unsupported' WHEN a & 4 <> 0 AND a & 2 = 0 THEN 'InvalidParameter' WHEN del AND fresh THEN 'NotFound' WHEN NOT del AND a & 2 = 0 THEN 'InvalidParameter' WHEN NOT del AND size > 65536 THEN 'OutOfResources'
  WHEN NOT del AND NOT fresh AND held <> a & ~64 THEN 'InvalidParameter' WHEN NOT del AND fresh AND a & 4 <> 0 AND runtime >= {QUOTA} THEN 'OutOfResources' WHEN volatile AND NOT del AND NOT (a & ~7 = 0 AND a & 2 <> 0) THEN 'Unsupported' WHEN volatile AND NOT vol THEN 'Unsupported'
  WHEN volatile AND NOT del AND (after_ > 65536 OR (fresh AND n >= {QUOTA})) THEN 'OutOfResources' WHEN volatile THEN 'Overlay' ELSE 'Store' END AS outcome FROM v""")
def service_set(spark, sf_dir):
    store, overlay, firmware = sets(spark, sf_dir)
    words = lambda df, n: df.withColumn("attributes", F.lit(n).cast("bigint"))
    size = F.when(F.col("seq") % 23 == 0, 70000).otherwise(F.length("data"))
    asked = rules(spark, sf_dir).select("image_id", "seq", "guid", "name", route().alias("route"), (F.col("guid") % 2 == 0).alias("volatile_route"), picked(F.col("seq"), 7, 6, 3, 71, 0, 5, 263, 2).cast("bigint").alias("attributes"), size.alias("size"))
    taken = words(firmware.where(route() != "store"), 7)
    return service.requested(asked, words(store, 7), words(overlay, 6), taken, QUOTA).select("image_id", "seq", "outcome")


@query(f"WITH {SETS} SELECT image_id, CAST(count(*) AS BIGINT) AS runtime, count(*) < 512 AS open FROM (SELECT image_id FROM st UNION ALL SELECT image_id FROM ov UNION ALL SELECT image_id FROM fw WHERE guid % 5 >= 3) GROUP BY image_id")
def runtime_quota(spark, sf_dir):
    store, overlay, firmware = sets(spark, sf_dir)
    words = lambda df, n: df.withColumn("attributes", F.lit(n).cast("bigint"))
    return service.quota(words(store, 7), words(overlay, 6), words(firmware.where(route() != "store"), 7))


@query(f"""WITH {RULES}, w AS (SELECT image_id, seq, CAST({WORDS} AS BIGINT) AS a, length(data) AS size FROM rules) SELECT image_id, seq, CASE WHEN a & 64 <> 0 THEN 'APPEND' WHEN a = 0 OR size = 0 THEN 'DELETE' ELSE 'SET' END AS abi,
 CASE WHEN a = 0 OR (size = 0 AND a & 64 = 0) THEN 'DELETE' WHEN a & 64 <> 0 THEN 'APPEND' ELSE 'SET' END AS service, CASE WHEN size = 0 THEN 'DELETE' ELSE 'SET' END AS tool FROM w""")
def front_operations(spark, sf_dir):
    a, size = picked(F.col("seq"), 7, 6, 3, 71, 0, 5, 263, 2).cast("bigint"), F.length("data")
    return rules(spark, sf_dir).select("image_id", "seq", *[policy.operation(a, size, front).alias(front) for front in ("abi", "service", "tool")])


ERRORS = ["OK", "Full", "NotFound", "InvalidParameter", "Name", "Unsupported", "SecurityViolation", "Rollback", "WriteProtected", "Locked", "Checksum", "Record"]


@query(f"""WITH e AS (SELECT event_id, list_extract({ERRORS}, CAST(event_id % 12 + 1 AS INTEGER)) AS error FROM events), s AS (SELECT *, CASE WHEN error = 'OK' THEN NULL WHEN error = 'Full' THEN 'OutOfResources' WHEN error IN ('InvalidParameter', 'Name') THEN 'InvalidParameter' WHEN error IN ('SecurityViolation', 'Rollback') THEN 'SecurityViolation'
 WHEN error IN ('WriteProtected', 'Locked') THEN 'WriteProtected' WHEN error IN ('NotFound', 'Unsupported') THEN error ELSE 'Corrupt' END AS service FROM e)
 SELECT event_id, service, CAST(CASE service WHEN 'InvalidParameter' THEN 2 WHEN 'Unsupported' THEN 3 WHEN 'WriteProtected' THEN 8 WHEN 'OutOfResources' THEN 9 WHEN 'NotFound' THEN 14 WHEN 'SecurityViolation' THEN 26 WHEN 'Corrupt' THEN 33 END AS INTEGER) AS efi,
 CAST(CASE WHEN error = 'OK' THEN NULL WHEN error = 'Full' THEN 9 WHEN error = 'WriteProtected' THEN 8 WHEN error = 'SecurityViolation' THEN 26 WHEN error = 'Unsupported' THEN 3 WHEN error IN ('Name', 'InvalidParameter') THEN 2 WHEN error = 'NotFound' THEN 14 ELSE 7 END AS INTEGER) AS abi FROM s""")
def status_codes(spark, sf_dir):
    error = picked(F.col("event_id"), *ERRORS)
    told = policy.service_error(error)
    return events(spark, sf_dir).select("event_id", told.alias("service"), policy.efi_status(told).alias("efi"), policy.abi_status(error).alias("abi"))


@query("SELECT event_id, CASE WHEN list_extract([4096, 512, 1000, 0], CAST(event_id % 4 + 1 AS INTEGER)) IN (4096, 512) AND event_id % 3 <> 0 AND event_id % 7 <> 0 THEN 'OK' ELSE 'InvalidParameter' END AS status, event_id % 5 = 0 OR length(props) = 9 AS same_size, 0 AS tier FROM events")
def manifest_match(spark, sf_dir):
    e = F.col("event_id")
    unit, size = picked(e, 4096, 512, 1000, 0), e + 8192
    status = policy.manifest_status(size, unit, size + F.when(e % 3 == 0, 1).otherwise(0), unit * F.when(e % 7 == 0, 2).otherwise(1) + F.when((e % 7 == 0) & (unit == 0), 1).otherwise(0))
    content = F.encode("props", "UTF-8")
    return events(spark, sf_dir).select("event_id", status.alias("status"), policy.size_matches(content, F.when(e % 5 == 0, F.length(content)).otherwise(9)).alias("same_size"), policy.posture_tier().alias("tier"))


CAPTURED, CAPTURED_BYTES = 12, 700


@query(f"""WITH RECURSIVE {SETS}, c AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY guid, name) AS place FROM fw), r AS (SELECT image_id, place, 32 + (length(name) + 1) * 2 + octet_length(encode(data)) + 7 AS size, row_number() OVER (PARTITION BY image_id ORDER BY place) AS k FROM c WHERE guid % 5 >= 3),
 f AS (SELECT DISTINCT image_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS bytes, FALSE AS took, CAST(0 AS BIGINT) AS place FROM r
 UNION ALL SELECT r.image_id, r.k, CASE WHEN f.n < {CAPTURED} AND f.bytes + r.size <= {CAPTURED_BYTES} THEN f.n + 1 ELSE f.n END, CASE WHEN f.n < {CAPTURED} AND f.bytes + r.size <= {CAPTURED_BYTES} THEN f.bytes + r.size ELSE f.bytes END, f.n < {CAPTURED} AND f.bytes + r.size <= {CAPTURED_BYTES}, r.place FROM f JOIN r ON r.image_id = f.image_id AND r.k = f.k + 1)
 SELECT image_id, place, (SELECT count(*) FROM r WHERE r.image_id = f.image_id) > (SELECT count(*) FROM f g WHERE g.image_id = f.image_id AND took) AS truncated FROM f WHERE took""")
def firmware_captured(spark, sf_dir):
    firmware = views.enumerated(sets(spark, sf_dir)[2]).select("image_id", "place", route().alias("route"), F.lit(7).cast("bigint").alias("attributes"), "name", "data")
    return service.captured(firmware, CAPTURED, CAPTURED_BYTES).select("image_id", "place", "truncated")


@query(f"WITH {SETS} SELECT image_id, guid, name, 0 AS part FROM st UNION ALL SELECT image_id, guid, name, 0 FROM ov UNION ALL SELECT DISTINCT image_id, guid, name, 1 FROM fw WHERE guid % 5 >= 3")
def service_listing(spark, sf_dir):
    store, overlay, firmware = sets(spark, sf_dir)
    return service.listed(store, overlay, firmware.withColumn("route", route()))


@query(f"WITH {LIVE}, n AS (SELECT image_id, guid, name, lead(name) OVER (PARTITION BY image_id ORDER BY guid, name) AS next_name FROM live) SELECT image_id, guid, name, CAST((length(next_name) + 1) * 2 AS INTEGER) AS needed, CASE WHEN next_name IS NULL THEN 'NotFound' WHEN (length(next_name) + 1) * 2 > 12 THEN 'BufferTooSmall' ELSE 'Success' END AS status FROM n")
def next_sizing(spark, sf_dir):
    needed, status = service.next_size(F.length("next_name"), F.lit(12))
    return views.next_key(replay.window_live(base(spark, sf_dir)), ["guid", "name"]).select("image_id", "guid", "name", needed.alias("needed"), status.alias("status"))


@query(f"WITH {LIVE} SELECT DISTINCT b.image_id, b.guid, b.name, CASE WHEN l.image_id IS NULL THEN 'Success' ELSE 'Device' END AS status FROM base b LEFT JOIN live l ON l.image_id = b.image_id AND l.guid = b.guid AND l.name = b.name WHERE b.op = 'DELETE'")
def deletions_verified(spark, sf_dir):
    log = base(spark, sf_dir)
    return service.still_there(log.where("op = 'DELETE'").select("image_id", "guid", "name").distinct(), replay.window_live(log))


@query(f"WITH {LIVE}, a AS (SELECT image_id, guid, name, data FROM live WHERE guid % 7 <> 0), b AS (SELECT image_id, guid, name, CASE WHEN guid % 11 = 0 THEN data || '!' ELSE data END AS data FROM live WHERE guid % 5 <> 0) SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'right' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)")
def listing_differences(spark, sf_dir):
    live = replay.window_live(base(spark, sf_dir)).select("image_id", "guid", "name", "data")
    return service.differences(live.where("guid % 7 <> 0"), live.where("guid % 5 <> 0").withColumn("data", F.when(F.col("guid") % 11 == 0, F.concat("data", F.lit("!"))).otherwise(F.col("data"))))


@query("""WITH d AS (SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'File' ELSE 'Partition' END AS kind, user_id AS target, event_id % 3 AS extra FROM events), t AS (SELECT DISTINCT user_id AS target FROM events WHERE user_id % 4 <> 0),
 s AS (SELECT id, kind, extra, CASE WHEN t.target IS NULL THEN 'missing' WHEN kind = 'Partition' AND d.target % 5 = 0 THEN 'ambiguous' WHEN kind = 'File' AND d.target % 5 = 1 THEN 'not regular' WHEN extra = 1 THEN 'size' WHEN d.target % 3 = 0 THEN 'image' ELSE 'OK' END AS status FROM d LEFT JOIN t ON t.target = d.target)
 SELECT id, status, CASE WHEN id % 9 = 0 THEN CASE WHEN id % 5 = 0 THEN 'already selected' WHEN id % 7 = 0 THEN 'already exists' ELSE 'create and select' END WHEN status <> 'OK' THEN 'refuse: ' || status WHEN id % 5 = 0 AND id % 4 <> 0 THEN 'already selected' WHEN id % 5 = 0 THEN 'replace' ELSE 'select' END AS plan FROM s""")
def target_plans(spark, sf_dir):
    e, u = F.col("event_id"), F.col("user_id")
    rows = events(spark, sf_dir)
    known = rows.select("user_id").distinct().where("user_id % 4 <> 0")
    wanted = rows.select(e.alias("id"), F.lit("esp").alias("volume"), F.when(e % 2 == 0, "File").otherwise("Partition").alias("kind"), u.alias("partition_uuid"), (F.lit(4096) + e % 3 % 2).alias("store_size"), F.concat(F.lit("p"), u).alias("path"))
    files = known.select(F.lit("esp").alias("volume"), F.concat(F.lit("p"), u).alias("path"), (u % 5 != 1).alias("regular"), F.lit(4096).alias("size"), (u % 3 != 0).alias("image_ok"))
    partitions = known.select(u.alias("uuid"), F.lit(4096).alias("size"), (u % 3 != 0).alias("image_ok"))
    found = descriptors.targets(wanted, files, partitions.unionAll(partitions.where("uuid % 5 = 0")))
    i = F.col("id")
    return found.select("id", "status", descriptors.selection_plan(F.col("status"), i % 5 == 0, i % 4 == 0, i % 7 == 0, i % 9 == 0).alias("plan"))


@query("WITH t AS (SELECT event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY event_type, event_id) AS old FROM events) SELECT event_id, greatest(ts, old) AS time FROM t")
def append_times(spark, sf_dir):
    from pyspark.sql import Window

    old = F.lag("ts").over(Window.partitionBy("user_id").orderBy("event_type", "event_id"))
    return events(spark, sf_dir).select("event_id", policy.later_time(old, F.col("ts")).alias("time"))


@query("SELECT user_id AS uuid, count(CASE WHEN event_id % 40 = 0 THEN event_id END) AS matches, CASE WHEN max(CASE WHEN event_id % 61 = 0 THEN 1 ELSE 0 END) = 1 THEN 'malformed' WHEN count(CASE WHEN event_id % 40 = 0 THEN event_id END) = 0 THEN 'missing' WHEN count(CASE WHEN event_id % 40 = 0 THEN event_id END) = 1 THEN 'unique' ELSE 'duplicate' END AS status FROM events GROUP BY user_id")
def discover_malformed(spark, sf_dir):
    e = F.col("event_id")
    return views.discovered(events(spark, sf_dir).select(F.col("user_id").alias("uuid"), F.when(e % 40 == 0, e).alias("device"), (e % 61 == 0).alias("malformed")))
