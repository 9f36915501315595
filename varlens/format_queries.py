"""Registered queries over store formats: flash volumes, log images, descriptors and wire fields."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import policy, wire
from .operators import descriptors, flash, logstore, replay, views
from .queries import BASE, ENTRY, LIVE, OCC, RECORD, base, events, image_rows, query, wire_log
from .sources import images as sources
from .sources.scratch import spread, written_images

FLASH_SIZE = 1 << 18
#: Sets and deletes of a flash store by the base log: appends are sets there.
OUTCOMES = (
    BASE
    + """, fl AS (SELECT *, lag(data) OVER (PARTITION BY image_id, guid, name ORDER BY seq) AS prev, lead(data) OVER (PARTITION BY image_id, guid, name ORDER BY seq) AS following FROM base),
 fo AS (SELECT CAST(image_id AS VARCHAR) AS image_id, guid, name, seq, data, CASE WHEN data = '' AND coalesce(prev, '') = '' THEN 'Absent' WHEN data = '' THEN 'Deleted' WHEN prev = data THEN 'Unchanged' ELSE 'Written' END AS outcome FROM fl)"""
)
FLASH_RECORD = "((2 * length(name) + 2 + octet_length(encode(data)) + 32 + 3) // 4 * 4)"


def flash_changes(spark, sf_dir, contents: bool) -> DataFrame:
    log = wire_log(spark, sf_dir).withColumn("attributes", F.lit(7))
    blank = flash.initialized(log.select("image_id").distinct().select("image_id", F.lit(FLASH_SIZE).alias("size"), F.lit(4096).alias("block"), F.lit("normal").alias("layout")), whole=False)
    return flash.changed(blank.select("image_id", "content", "erased"), log, contents)


def flash_images(spark, sf_dir) -> DataFrame:
    return written_images(flash_changes(spark, sf_dir, True).where("content IS NOT NULL").select("image_id", "content", "erased"), "flash-images")


@query(f"WITH {OUTCOMES} SELECT image_id, seq, outcome FROM fo")
def flash_outcomes(spark, sf_dir):
    return flash_changes(spark, sf_dir, False).where("place IS NOT NULL").select("image_id", F.col("place").alias("seq"), "outcome")


@query(f"""WITH {OUTCOMES}, w AS (SELECT *, lead(outcome) OVER (PARTITION BY image_id, guid, name ORDER BY seq) AS then_ FROM fo WHERE outcome IN ('Written', 'Deleted'))
 SELECT image_id, CASE then_ WHEN 'Written' THEN 60 WHEN 'Deleted' THEN 61 ELSE 63 END AS state, count(*) AS n FROM w WHERE outcome = 'Written' GROUP BY ALL""")
def flash_states(spark, sf_dir):
    rows = flash.records(flash_images(spark, sf_dir))
    return rows.groupBy("image_id", F.col("state").cast("int").alias("state")).agg(F.count("*").alias("n"))


@query(f"WITH {OUTCOMES} SELECT image_id, name, data FROM (SELECT *, row_number() OVER (PARTITION BY image_id, guid, name ORDER BY seq DESC) AS n FROM fo) WHERE n = 1 AND data <> ''")
def flash_live(spark, sf_dir):
    live = views.resolve(flash.records(flash_images(spark, sf_dir)), ["image_id", "guid", "name_wire"])
    return live.select("image_id", wire.lossy_text(F.col("name_wire")).alias("name"), F.decode("data", "UTF-8").alias("data"))


@query(f"WITH {OUTCOMES} SELECT image_id, CAST({FLASH_SIZE - 100} AS BIGINT) AS capacity, CAST({FLASH_SIZE - 100} - coalesce(sum({FLASH_RECORD}) FILTER (WHERE outcome = 'Written'), 0) AS BIGINT) AS free FROM fo GROUP BY image_id")
def flash_space(spark, sf_dir):
    images = flash_images(spark, sf_dir)
    return flash.free_space(flash.stores(images), flash.records(images)).select("image_id", "capacity", "free")


@query(f"WITH {OUTCOMES}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, guid, name ORDER BY seq DESC) AS n FROM fo) WHERE n = 1 AND data <> '') SELECT image_id, CAST({FLASH_SIZE - 100} - sum({FLASH_RECORD}) AS BIGINT) AS free, count(*) AS records FROM l GROUP BY image_id")
def flash_reclaimed(spark, sf_dir):
    images = flash_images(spark, sf_dir)
    live = views.resolve(flash.records(images), ["image_id", "guid", "name_wire"]).withColumn("place", F.col("rec_offset"))
    after = flash.rewritten(images, None, live).where("status = 'OK'").select("image_id", "content", "erased")
    after = written_images(after, "reclaimed")
    rows = flash.records(after)
    counts = rows.groupBy("image_id").agg(F.count("*").alias("records"))
    return flash.free_space(flash.stores(after), rows).join(counts, "image_id").select("image_id", "free", "records")


BLANKS = "b AS (SELECT DISTINCT user_id AS id, list_extract([8192, 10240, 12000, 2048, 65536], CAST(user_id % 5 + 1 AS INTEGER)) AS size, list_extract([1024, 512, 1000], CAST(user_id % 3 + 1 AS INTEGER)) AS capacity, list_extract([512, 1024, 100, 512], CAST(user_id % 4 + 1 AS INTEGER)) AS block FROM events)"


def picked(column, *values):
    return F.element_at(F.array(*map(F.lit, values)), (column % len(values) + 1).cast("int"))


@query(f"""WITH {BLANKS} SELECT CAST(id AS VARCHAR) AS image_id, CASE WHEN size < (block + capacity) * 2 THEN 'Bounds' WHEN block NOT IN (512, 1024) OR capacity < block OR capacity % block <> 0 OR size % block <> 0 THEN 'Header' ELSE 'OK' END AS status,
 CASE WHEN size < (block + capacity) * 2 OR block NOT IN (512, 1024) OR capacity < block OR capacity % block <> 0 OR size % block <> 0 THEN NULL ELSE CAST(size AS BIGINT) END AS bytes, CASE WHEN bytes IS NULL THEN NULL ELSE CAST(2 AS BIGINT) END AS headers, CASE WHEN bytes IS NULL THEN NULL ELSE CAST(0 AS BIGINT) END AS variables FROM b""")
def blank_images(spark, sf_dir):
    u = F.col("user_id")
    rows = events(spark, sf_dir).select(u).distinct().select(u.alias("image_id"), picked(u, 8192, 10240, 12000, 2048, 65536).alias("image_size"), picked(u, 1024, 512, 1000).alias("capacity"), picked(u, 512, 1024, 100, 512).alias("block"))
    made = written_images(logstore.initialized(rows), "blank-images")
    whole = made.where("status = 'OK'").select("image_id", "content")
    heads = logstore.headers(whole).where("status = 'OK'").groupBy("image_id").agg(F.count("*").alias("headers"))
    held = logstore.replayed(whole).where("status = 'OK'").select("image_id", F.size("variables").cast("bigint").alias("variables"))
    return made.join(heads, "image_id", "left").join(held, "image_id", "left").select("image_id", "status", F.length("content").cast("bigint").alias("bytes"), "headers", "variables")


@query(f"WITH {LIVE}, n AS (SELECT image_id, count(*) AS n FROM base GROUP BY image_id) SELECT CAST(n.image_id AS VARCHAR) AS image_id, CAST(2 AS BIGINT) AS generation, CAST(4096 AS BIGINT) AS header_offset, n.n AS next_sequence, (SELECT count(*) FROM live WHERE live.image_id = n.image_id) AS variables, CAST(0 AS BIGINT) AS log_records, TRUE AS stable FROM n")
def compact_state(spark, sf_dir):
    after = written_images(logstore.compacted(image_rows(spark, sf_dir)).select("image_id", "content"), "compacted")
    again = logstore.compacted(after).select("image_id", F.sha2("content", 256).alias("again"))
    rows = logstore.parts(after).select("image_id", "generation", "header_offset", wire.uint("checkpoint", 16, 8).cast("bigint").alias("next_sequence"), wire.uint("checkpoint", 12, 4).alias("variables"), (~wire.filled(F.col("log"), 0)).cast("bigint").alias("log_records"))
    same = after.select("image_id", F.sha2("content", 256).alias("once")).join(again, "image_id").select("image_id", (F.col("once") == F.col("again")).alias("stable"))
    return rows.join(same, "image_id")


@query(f"WITH {LIVE} SELECT CAST(image_id AS VARCHAR) AS image_id, row_number() OVER (PARTITION BY image_id ORDER BY born_seq) - 1 AS ordinal, name, data, CAST(attributes AS BIGINT) AS attributes FROM live")
def compact_roundtrip(spark, sf_dir):
    slots = logstore.parts(logstore.compacted(image_rows(spark, sf_dir)).select("image_id", "content")).select("image_id", F.col("checkpoint").alias("data"))
    rows = logstore.checkpoint_variables(slots).where("status = 'OK' AND ordinal IS NOT NULL")
    return rows.select("image_id", "ordinal", wire.lossy_text(F.col("name_wire")).alias("name"), F.decode("data", "UTF-8").alias("data"), "attributes")


@query(f"""WITH {OCC}, full_ AS (SELECT image_id, min(CASE WHEN used + 96 > 4096 THEN seq END) AS full_at FROM occ GROUP BY image_id), v AS (SELECT *, max(CASE WHEN op = 'SET' OR (op = 'APPEND' AND length(data) > 0) THEN seq END) OVER w AS made, max(CASE WHEN op = 'DELETE' THEN seq END) OVER w AS gone FROM base
 WINDOW w AS (PARTITION BY image_id, guid, name ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), a AS (SELECT v.image_id, seq, op <> 'DELETE' OR (made IS NOT NULL AND coalesce(gone, -1) < made) AS accepted FROM v)
 SELECT CAST(a.image_id AS VARCHAR) AS image_id, CASE WHEN max(full_at) IS NULL THEN 'OK' ELSE 'Full' END AS status, CAST(count(*) FILTER (WHERE accepted AND seq < coalesce(full_at, 1000000000)) AS BIGINT) AS accepted FROM a JOIN full_ ON a.image_id = full_.image_id GROUP BY a.image_id""")
def replay_full(spark, sf_dir):
    return logstore.replayed(image_rows(spark, sf_dir, capacity=4096)).select("image_id", "status", "accepted")


@query(f"WITH {BASE} SELECT DISTINCT CAST(image_id AS VARCHAR) AS image_id, CASE WHEN image_id % 3 > 0 THEN 'Rollback' ELSE 'OK' END AS status, CAST(0 AS BIGINT) AS authenticated FROM base")
def replay_anchored(spark, sf_dir):
    images = image_rows(spark, sf_dir)
    anchors = images.select("image_id", (F.col("image_id").cast("long") % 3).alias("anchor"))
    return logstore.replayed(images, anchors).select("image_id", "status", "authenticated")


APPEND_ROOM, APPEND_SLOT = (1 << 16) - 8192 - 2 * 8192, 8192


@query(f"""WITH RECURSIVE {BASE}, r AS (SELECT image_id, seq + 1 AS k, length(name) + length(CAST(seq AS VARCHAR)) AS units, length(props_) AS size FROM (SELECT *, repeat(CASE WHEN data = '' THEN 'x' ELSE data END, CAST(1 + seq % 40 AS INTEGER)) AS props_ FROM base)),
 z AS (SELECT image_id, k, CAST((2 * units + size + 108 + 7) // 8 * 8 AS BIGINT) AS rec, CAST((2 * units + size + 48 + 7) // 8 * 8 AS BIGINT) AS ent FROM r),
 f AS (SELECT DISTINCT image_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS log, CAST(96 AS BIGINT) AS used, FALSE AS took FROM r
 UNION ALL SELECT z.image_id, z.k, CASE WHEN f.log + rec <= {APPEND_ROOM} AND f.used + ent <= {APPEND_SLOT} THEN f.log + rec ELSE f.log END, CASE WHEN f.log + rec <= {APPEND_ROOM} AND f.used + ent <= {APPEND_SLOT} THEN f.used + ent ELSE f.used END, f.log + rec <= {APPEND_ROOM} AND f.used + ent <= {APPEND_SLOT} FROM f JOIN z ON z.image_id = f.image_id AND z.k = f.k + 1)
 SELECT CAST(image_id AS VARCHAR) AS image_id, k - 1 AS place, CASE WHEN took THEN 'OK' ELSE 'Full' END AS error FROM f WHERE k > 0""")
def append_outcomes(spark, sf_dir):
    log = base(spark, sf_dir)
    data = F.repeat(F.when(F.col("data") == "", "x").otherwise(F.col("data")), (F.col("seq") % 40 + 1).cast("int"))
    changes = log.select("image_id", F.col("seq").alias("place"), F.lit("SET").alias("op"), F.lit(7).alias("attributes"), F.unhex(F.md5(F.col("guid").cast("string"))).alias("guid"), wire.name_bytes(F.concat("name", F.col("seq").cast("string"))).alias("name_wire"), F.encode(data, "UTF-8").alias("data"))
    blank = logstore.initialized(spread(log.select("image_id").distinct()).select("image_id", F.lit(1 << 16).alias("image_size"), F.lit(APPEND_SLOT).alias("capacity"), F.lit(4096).alias("block")))
    return logstore.appended(written_images(blank.select("image_id", "content"), "blank-images"), changes)[1]


BACKINGS = """d AS (SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'Partition' ELSE 'File' END AS kind, list_extract([4096, 512, 100, 1024, 131072], CAST(event_id % 5 + 1 AS INTEGER)) AS unit, event_id % 50 AS units,
 CASE WHEN event_id % 3 = 0 AND event_id % 7 <> 6 THEN '' ELSE list_extract(['EFI/store.img', '/abs', 'a//b', 'efi/EFVS/store.cfg', 'a/../b', 'ok.bin', 'a b'], CAST(event_id % 7 + 1 AS INTEGER)) END AS path FROM events),
 ds AS (SELECT *, CASE WHEN unit NOT IN (4096, 512, 1024) OR units < 2 OR (kind = 'Partition' AND path <> '') OR (kind = 'File' AND path NOT IN ('EFI/store.img', 'ok.bin')) THEN 'InvalidParameter' ELSE 'OK' END AS status FROM d)"""


def backings(spark, sf_dir) -> DataFrame:
    e = F.col("event_id")
    kind = F.when(e % 3 == 0, "Partition").otherwise("File")
    path = F.when((e % 3 == 0) & (e % 7 != 6), "").otherwise(picked(e, "EFI/store.img", "/abs", "a//b", "efi/EFVS/store.cfg", "a/../b", "ok.bin", "a b"))
    unit, uuid = picked(e, 4096, 512, 100, 1024, 131072), F.unhex(F.md5(e.cast("string")))
    return events(spark, sf_dir).select(e.alias("id"), kind.alias("kind"), path.alias("path"), descriptors.encoded_backing(kind, uuid, uuid, unit * (e % 50), unit, path).alias("bytes"))


@query(f"WITH {BACKINGS} SELECT id, status, kind, CAST(unit * units AS BIGINT) AS store_size, CAST(unit AS BIGINT) AS write_unit, path, md5(CAST(id AS VARCHAR)) AS uuid FROM ds")
def backing_roundtrip(spark, sf_dir):
    b = descriptors.backing(F.col("bytes"))
    return backings(spark, sf_dir).select("id", b.alias("b")).select("id", "b.status", "b.kind", F.col("b.store_size").cast("bigint").alias("store_size"), "b.write_unit", "b.path", F.lower(F.hex("b.store_uuid")).alias("uuid"))


@query(f"WITH {BACKINGS} SELECT id, CASE WHEN status <> 'OK' THEN status WHEN id % 6 IN (2, 4, 5) THEN 'Unsupported' ELSE 'OK' END AS status, CAST(id % 6 AS BIGINT) AS capabilities, CAST(id AS BIGINT) AS anchor, CAST(0 AS BIGINT) AS tier FROM ds")
def config_table_roundtrip(spark, sf_dir):
    t = descriptors.config_table(descriptors.encoded_config_table(F.col("id") % 6, F.col("id"), F.col("bytes")))
    return backings(spark, sf_dir).select("id", t.alias("t")).select("id", "t.status", "t.capabilities", F.col("t.anchor").cast("bigint").alias("anchor"), "t.tier")


@query(f"WITH {BACKINGS} SELECT id, CASE WHEN id % 11 = 0 THEN 'unconfigured' WHEN id % 13 = 0 THEN 'Bounds' ELSE status END AS status FROM ds")
def selector_status(spark, sf_dir):
    e = F.col("id")
    content = F.when(e % 11 == 0, None).when(e % 13 == 0, F.substring("bytes", 1, 319)).otherwise(F.col("bytes"))
    return backings(spark, sf_dir).select("id", descriptors.selected_backing(content).alias("status"))


def times(e) -> list:
    return [wire.le(e % 30 + 2000, 2), wire.le(e % 14, 1), wire.le(e % 31 + 1, 1), wire.le(e % 25, 1), wire.le(e % 60, 1), wire.le(e % 60, 1), wire.le(F.lit(0), 1), wire.le(F.lit(0), 4), wire.le(F.lit(0), 2), wire.le(F.lit(0), 1), wire.le(F.lit(0), 1)]


TIME_OK = "event_id % 14 BETWEEN 1 AND 12 AND event_id % 25 < 24"


def certificate(e):
    revision, kind = F.when(e % 17 == 0, 0x0100).otherwise(descriptors.REVISION), F.when(e % 19 == 0, 1).otherwise(descriptors.EFI_GUID_KIND)
    return [wire.le(F.when(e % 29 == 0, 20).otherwise(32), 4), wire.le(revision, 2), wire.le(kind, 2), F.unhex(F.lit(descriptors.PKCS7)), wire.le(e, 8)]


CERTIFICATE = "WHEN event_id % 29 = 0 THEN 'Length' WHEN event_id % 23 = 0 THEN 'Truncated' WHEN event_id % 17 = 0 THEN 'Invalid' WHEN event_id % 19 = 0 THEN 'CertificateType'"


@query(f"WITH s AS (SELECT event_id, props, CASE WHEN NOT ({TIME_OK}) THEN 'TimeStamp' {CERTIFICATE} ELSE 'OK' END AS status FROM events) SELECT event_id, status, CASE WHEN status = 'OK' THEN props END AS value, CASE WHEN status = 'OK' THEN CAST(2000 + event_id % 30 AS INTEGER) END AS year FROM s")
def auth2_descriptors(spark, sf_dir):
    e = F.col("event_id")
    whole = F.concat(*times(e), *certificate(e), F.encode("props", "UTF-8"))
    rows = events(spark, sf_dir).select("event_id", F.when(e % 23 == 0, F.substring(whole, 1, 30)).otherwise(whole).alias("payload"))
    return rows.select("event_id", descriptors.auth2(F.col("payload")).alias("p")).select("event_id", "p.status", F.decode("p.value", "UTF-8").alias("value"), "p.time.year")


@query(f"""WITH s AS (SELECT event_id, props, CASE WHEN event_id % 31 = 0 OR event_id % 37 = 0 THEN 'Invalid' WHEN event_id % 23 = 0 THEN 'Truncated' WHEN NOT ({TIME_OK}) THEN 'TimeStamp' {CERTIFICATE} ELSE 'OK' END AS status FROM events)
 SELECT event_id, status, CASE WHEN status = 'OK' THEN props END AS value, CASE WHEN status = 'OK' THEN 'TimeStamp' END AS kind FROM s""")
def auth3_descriptors(spark, sf_dir):
    e = F.col("event_id")
    head = F.concat(wire.le(F.when(e % 31 == 0, 2).otherwise(1), 1), wire.le(F.when(e % 37 == 0, 3).otherwise(1), 1), wire.le(F.lit(58), 4), wire.le(F.lit(0), 4))
    whole = F.concat(head, *times(e), *certificate(e), F.encode("props", "UTF-8"))
    rows = events(spark, sf_dir).select("event_id", F.when(e % 23 == 0, F.substring(whole, 1, 40)).otherwise(whole).alias("payload"))
    return rows.select("event_id", descriptors.auth3(F.col("payload")).alias("p")).select("event_id", "p.status", F.decode("p.value", "UTF-8").alias("value"), "p.kind")


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'logstore' WHEN 1 THEN 'flash' WHEN 2 THEN 'logstore' ELSE 'unknown' END AS format FROM events")
def detect_formats(spark, sf_dir):
    e = F.col("event_id") % 4
    zeros = lambda n: F.unhex(F.lit("00" * n))
    content = F.when(e == 0, F.concat(F.lit("EFVS").cast("binary"), zeros(60))).when(e == 1, F.concat(zeros(40), F.lit("_FVH").cast("binary"), zeros(20))).when(e == 2, F.concat(zeros(1024), F.lit("EFVS").cast("binary"))).otherwise(F.encode("props", "UTF-8"))
    return sources.detected(events(spark, sf_dir).select("event_id", content.alias("content"))).select("event_id", "format")


@query("""WITH w AS (SELECT event_id, event_id % 512 AS a, event_id % 3 AS size FROM events) SELECT event_id, a & ~15 = 0 AND a & 3 = 3 AS flash, a & ~7 = 0 AND a & 2 <> 0 AS overlay, a = 0 OR (size = 0 AND a & 64 = 0) AS deleting FROM w""")
def attribute_rules(spark, sf_dir):
    a, size = (F.col("event_id") % 512).cast("bigint"), F.col("event_id") % 3
    return events(spark, sf_dir).select("event_id", policy.writable_flash(a).alias("flash"), policy.overlay_allowed(a).alias("overlay"), policy.deleting(a, size).alias("deleting"))


NAMES = ["41004200", "", "00D8", "3DD800DE", "41000000", "3DD84100", "00DC4200", "4100C3"]
VALID, LOSSY = [True, False, False, True, False, False, False, False], ["AB", "", "�", "😀", "A\0", "�A", "�B", "A"]


@query(f"SELECT event_id, list_extract({[str(v).lower() for v in VALID]}::BOOLEAN[], CAST(event_id % 8 + 1 AS INTEGER)) AS valid, CASE event_id % 8 {' '.join(f'WHEN {k} THEN ' + (chr(39) + x + chr(39) if chr(0) not in x else chr(39) + 'A' + chr(39) + ' || chr(0)') for k, x in enumerate(LOSSY))} END AS text FROM events")
def wire_names(spark, sf_dir):
    raw = F.unhex(picked(F.col("event_id"), *NAMES))
    return events(spark, sf_dir).select("event_id", wire.valid_name(raw).alias("valid"), wire.lossy_text(raw).alias("text"))


@query("""WITH g AS (SELECT event_id, md5(CAST(event_id AS VARCHAR)) AS h FROM events) SELECT event_id, h[7:8] || h[5:6] || h[3:4] || h[1:2] || '-' || h[11:12] || h[9:10] || '-' || h[15:16] || h[13:14] || '-' || h[17:20] || '-' || h[21:32] AS guid, TRUE AS same,
 CAST(event_id AS BIGINT) AS attributes, event_id % 10 <> 0 AS parsed FROM g""")
def wire_guids(spark, sf_dir):
    e = F.col("event_id")
    raw = F.unhex(F.md5(e.cast("string")))
    text = wire.guid_text(raw)
    word = F.concat(F.when(e % 2 == 0, "0x").otherwise(""), F.hex(e))
    odd = wire.parse_attributes(F.when(e % 10 == 0, F.concat(word, F.lit("g"))).otherwise(word))
    return events(spark, sf_dir).select("event_id", text.alias("guid"), (wire.guid_bytes(text) == raw).alias("same"), wire.parse_attributes(word).alias("attributes"), odd.isNotNull().alias("parsed"))


@query(f"SELECT event_id, {TIME_OK} AS valid, FALSE AS zero, CAST(event_id % 14 AS INTEGER) AS month, CAST(event_id % 60 AS INTEGER) AS second FROM events")
def wire_times(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", F.concat(*times(F.col("event_id"))).alias("stored")).select("event_id", wire.efi_time(F.col("stored"), 0).alias("t"))
    t = F.col("t")
    return rows.select("event_id", wire.time_is_valid(t).alias("valid"), wire.time_is_zero(t).alias("zero"), t["month"].alias("month"), t["second"].alias("second"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(CAST('18446744073709551615' AS HUGEINT) - event_id % 4 + 1 AS VARCHAR) END AS following FROM events")
def sequence_next(spark, sf_dir):
    highest = F.lit("18446744073709551615").cast("decimal(20,0)")
    return events(spark, sf_dir).select("event_id", wire.checked_next((highest - F.col("event_id") % 4).cast("decimal(20,0)")).cast("string").alias("following"))


@query(f"WITH {LIVE} SELECT image_id, array_to_string(list_transform(string_split(name, ''), lambda c: hex(encode(c)) || '00'), '') AS name, guid, attributes, hex(encode(data)) AS data FROM live")
def dumped_rows(spark, sf_dir):
    return views.dump_rows(replay.window_live(base(spark, sf_dir)))
