"""Images: encoding and decoding round trips, cuts at every byte, flash records."""

import struct

import pytest
from pyspark.sql import functions as F

from varlens.functions import wire
from varlens.operators import flash, logstore, replay, views
from varlens.sources import images as sources

GUID = bytes(range(16))


@pytest.fixture(scope="module")
def encoded(spark):
    name = lambda s: s.encode("utf-16-le")
    first = [("i", 0, 7, GUID, name("key"), b"one"), ("i", 1, 7, GUID, name("選択𝄞"), b"")]
    log = [("i", 0, "SET", 7, GUID, name("key"), b"two"), ("i", 1, "APPEND", 71, GUID, name("key"), b"+"), ("i", 2, "DELETE", 7, GUID, name("gone"), b""), ("i", 3, "SET", 7, GUID, name("new"), b"n")]
    cp = spark.createDataFrame(first, "image_id string, place long, attributes long, guid binary, name_wire binary, data binary")
    lg = spark.createDataFrame(log, "image_id string, place long, op string, attributes long, guid binary, name_wire binary, data binary")
    return bytes(logstore.encode_images(cp, lg, 8192, 1024, 512).first().content)


def table(spark, contents):
    return spark.createDataFrame([(str(k), bytes(c)) for k, c in enumerate(contents)], "image_id string, content binary")


def test_round_trip(spark, encoded):
    df = table(spark, [encoded])
    chosen = logstore.headers(df).where("selected").collect()
    assert [(r.header_offset, r.generation, r.block_size) for r in chosen] == [(0, 1, 512)]
    rows = logstore.checkpoint_variables(logstore.parts(df).select("image_id", F.col("checkpoint").alias("data"))).collect()
    assert [(r.status, bytes(r.name_wire).decode("utf-16-le"), bytes(r.data)) for r in rows] == [("OK", "key", b"one"), ("OK", "選択𝄞", b"")]
    got = logstore.mutations(df).orderBy("seq").collect()
    assert [(r.op, bytes.fromhex(r.data)) for r in got] == [("SET", b"two"), ("APPEND", b"+"), ("DELETE", b""), ("SET", b"n")]
    live = replay.window_live(logstore.mutations(df))
    assert {bytes.fromhex(r.name).decode("utf-16-le"): bytes.fromhex(r.data) for r in live.collect()} == {"key": b"two+", "new": b"n"}
    once = logstore.compacted(df).first()
    after = table(spark, [once.content])
    assert once.status == "OK" and logstore.mutations(after).count() == 0
    assert [(r.header_offset, r.generation) for r in logstore.headers(after).where("selected").collect()] == [(512, 2)]
    assert bytes(logstore.compacted(after).first().content) == bytes(once.content)  # a clean image keeps its bytes
    held = logstore.checkpoint_variables(logstore.parts(after).select("image_id", F.col("checkpoint").alias("data"))).orderBy("ordinal").collect()
    assert [(bytes(r.name_wire).decode("utf-16-le"), bytes(r.data)) for r in held] == [("key", b"two+"), ("選択𝄞", b""), ("new", b"n")]
    assert logstore.checkpoint_head(bytes(logstore.parts(after).first().checkpoint))[0] == 4  # the sequence goes on
    stale = bytes(once.content)[: 2 * 512 + 2 * 1024] + encoded[2 * 512 + 2 * 1024 :]
    assert logstore.mutations(table(spark, [stale])).count() == 0  # the old log names another checkpoint


def test_an_emptied_image_stays_an_image(spark):
    blank = logstore.initialized(spark.createDataFrame([("e", 8192, 1024, 512)], "image_id string, image_size long, capacity long, block long")).first()
    name = "only".encode("utf-16-le")
    changes = spark.createDataFrame([("0", 0, "SET", 7, GUID, name, b"x"), ("0", 1, "DELETE", 7, GUID, name, b"")], "image_id string, place long, op string, attributes long, guid binary, name_wire binary, data binary")
    images, outcomes = logstore.appended(table(spark, [blank.content]), changes)
    assert [r.error for r in outcomes.orderBy("place").collect()] == ["OK", "OK"]
    after = logstore.compacted(images).collect()
    assert [r.status for r in after] == ["OK"] and logstore.checkpoint_head(bytes(after[0].content)[2048:3072])[0] == 2


def test_boot_only_values_go_through_compaction(spark, encoded):
    name = lambda s: s.encode("utf-16-le")
    asked = [("SET", 3, name("boot"), b"b"), ("SET", 7, name("key"), b"after"), ("SET", 7, name("boot"), b"c"), ("SET", 3, name("key"), b"d"), ("DELETE", 0, name("boot"), b""), ("SET", 11, name("hr"), b"e")]
    changes = spark.createDataFrame([("0", k, op, a, GUID, n, v) for k, (op, a, n, v) in enumerate(asked)], "image_id string, place long, op string, attributes long, guid binary, name_wire binary, data binary")
    images, outcomes = logstore.appended(table(spark, [encoded]), changes, boot=True)
    assert [r.error for r in outcomes.orderBy("place").collect()] == ["OK", "OK", "InvalidParameter", "InvalidParameter", "OK", "Unsupported"]
    state = logstore.replayed(images).first()
    assert {bytes(v.name_wire).decode("utf-16-le"): bytes(v.data) for v in state.variables} == {"key": b"after", "選択𝄞": b"", "new": b"n"}


def test_a_later_smaller_change_may_still_fit(spark):
    blank = logstore.initialized(spark.createDataFrame([("e", 4096, 1024, 512)], "image_id string, image_size long, capacity long, block long")).first()
    sizes = [600, 700, 10]  # the log has 1024 bytes: the second doesn't fit, the third does
    changes = spark.createDataFrame([("0", k, "SET", 7, GUID, f"v{k}".encode("utf-16-le"), b"y" * n) for k, n in enumerate(sizes)], "image_id string, place long, op string, attributes long, guid binary, name_wire binary, data binary")
    assert [r.error for r in logstore.appended(table(spark, [blank.content]), changes)[1].orderBy("place").collect()] == ["OK", "Full", "OK"]


def test_every_byte_of_a_checkpoint_counts(spark, encoded):
    flips = [encoded[:at] + bytes([encoded[at] ^ 1]) + encoded[at + 1 :] for at in range(1024, 1024 + 216, 7)]
    assert {r.status for r in logstore.replayed(table(spark, flips)).collect()} <= {"Checkpoint", "Checksum"}


def test_every_cut_and_flip_keeps_a_prefix(spark, encoded):
    start = 2 * 512 + 2 * 1024
    ends = [start]
    while encoded[ends[-1] : ends[-1] + 4] == b"EFVR":
        ends.append(ends[-1] + struct.unpack_from("<I", encoded, ends[-1] + 4)[0])
    cuts = [encoded[:at].ljust(len(encoded), b"\0") for at in range(start, ends[-1] + 1)]
    counts = {int(r.image_id): r["count"] for r in logstore.mutations(table(spark, cuts)).groupBy("image_id").count().collect()}
    for k in range(len(cuts)):
        whole = sum(start + k >= e for e in ends[1:])
        # zeros that the cut leaves out of a record's end are there all the same
        assert counts.get(k, 0) in (whole, whole + (cuts[k] == encoded[: ends[min(whole + 1, len(ends) - 1)]].ljust(len(encoded), b"\0")))
    flips = [encoded[:at] + bytes([encoded[at] ^ 1]) + encoded[at + 1 :] for at in range(ends[1], ends[2])]
    counts = {int(r.image_id): r["count"] for r in logstore.mutations(table(spark, flips)).groupBy("image_id").count().collect()}
    assert set(counts.values()) == {1} and len(counts) == len(flips)


def test_headers_fail_closed(spark, encoded):
    broken = [encoded[:at] + bytes([encoded[at] ^ 0xFF]) + encoded[at + 1 :] for at in range(64)]
    chosen = {int(r.image_id): r.header_offset for r in logstore.headers(table(spark, broken)).where("selected").collect()}
    assert chosen == {k: 512 for k in range(64)}  # header B takes over, whatever byte of A is bad


def flash_image(records: bytes, size: int = 1024) -> bytes:
    head = bytearray(bytes(16) + bytes.fromhex(flash.VOLUME) + struct.pack("<Q", size) + b"_FVH" + bytes(4) + struct.pack("<HHHBB", 72, 0, 0, 0, 2) + struct.pack("<IIII", 1, size, 0, 0))
    struct.pack_into("<H", head, 50, -sum(struct.unpack("<36H", head)) % 65536)
    store = bytes.fromhex(flash.NORMAL) + struct.pack("<I", size - 72) + b"\x5a\xfe" + bytes(6)
    return (bytes(head) + store + records).ljust(size, b"\xff")


def flash_record(state: int, name: str, data: bytes) -> bytes:
    wire_name = name.encode("utf-16-le") + b"\0\0"
    raw = b"\xaa\x55" + bytes([state, 0]) + struct.pack("<III", 7, len(wire_name), len(data)) + GUID + wire_name + data
    return raw.ljust((len(raw) + 3) // 4 * 4, b"\xff")


def test_flash_store(spark):
    body = flash_record(0x3E, "a", b"old") + flash_record(0x3F, "a", b"new") + flash_record(0x3C, "b", b"x")
    images = [flash_image(body), flash_image(body[:-4] + b"\0\0\0\0" + b"\x11\x22\x33\x44"), b"\0" * 1024, flash_image(b"")[:50] + b"\1\1" + flash_image(b"")[52:]]
    df = table(spark, images)
    areas = flash.stores(df)
    assert {r.image_id: r.status for r in areas.collect()} == {"0": "OK", "1": "OK", "2": "FvSignature", "3": "FvChecksum"}
    rows = flash.records(df, areas)
    assert [(r.state, bytes(r.data)) for r in rows.where("image_id = '0'").orderBy("rec_offset").collect()] == [(0x3E, b"old"), (0x3F, b"new"), (0x3C, b"x")]
    assert rows.where("status <> 'OK'").select("image_id", "status").collect() == [("1", "RecordSignature")]
    free = {r.image_id: (r.capacity, r.free) for r in flash.free_space(areas, rows).collect()}
    assert free["0"] == (1024 - 100, 1024 - 100 - len(body))


def test_detection_and_files(spark, encoded, tmp_path):
    (tmp_path / "a.img").write_bytes(encoded)
    (tmp_path / "b.img").write_bytes(flash_image(b""))
    (tmp_path / "c.img").write_bytes(b"\xa5" * 512 + encoded[512:])
    (tmp_path / "d.img").write_bytes(b"text")
    with (tmp_path / "e.img").open("wb") as f:
        f.truncate((16 << 20) + 1)
    read = sources.read_images(spark, str(tmp_path))
    assert [(r.path[-5], r.content) for r in read.where("status = 'Bounds'").collect()] == [("e", None)]
    rows = sources.detected(read.where("status = 'OK'"))
    assert {r.path[-5]: r.format for r in rows.collect()} == {"a": "logstore", "b": "flash", "c": "logstore", "d": "unknown"}


def test_wire_functions(spark):
    row = spark.createDataFrame([(bytes(range(1, 17)), "8be4df61-93ca-11d2-aa0d-00e098032b8c", "0x7F")], "b binary, g string, a string")
    got = row.select(
        wire.uint("b", 0, 2).alias("u2"), wire.uint("b", 1, 4).alias("u4"), wire.uint("b", 8, 8).cast("string").alias("u8"), wire.uint("b", 14, 4).alias("past"), wire.guid_text(wire.guid_bytes(F.col("g"))).alias("g"),
        wire.parse_attributes(F.col("a")).alias("a"), F.hex(wire.le(F.lit(258), 4)).alias("le"), wire.align(F.lit(9), 8).alias("al"), wire.valid_name(F.unhex(F.lit("00D8"))).alias("lone"), wire.valid_name(wire.name_bytes(F.lit("選択𝄞"))).alias("ok"),
        wire.checksum16(F.col("b"), 16).alias("sum"), wire.filled(F.unhex(F.lit("FFFF")), 255).alias("full"),
    ).first()
    assert (got.u2, got.u4, got.u8, got.past) == (0x0201, 0x05040302, str(int.from_bytes(bytes(range(9, 17)), "little")), None)
    assert (got.g, got.a, got.le, got.al, got.lone, got.ok, got.full) == ("8be4df61-93ca-11d2-aa0d-00e098032b8c", 127, "02010000", 16, False, True, True)
    assert got["sum"] == sum(struct.unpack("<8H", bytes(range(1, 17)))) % 65536


def test_checked_append(spark, encoded):
    name = lambda s: s.encode("utf-16-le")
    start = 2 * 512 + 2 * 1024
    torn = encoded[: start + 600] + b"\x07" + encoded[start + 601 :]
    df = table(spark, [encoded, torn])
    rows = [(i, k, *r) for i in ("0", "1") for k, r in enumerate([("SET", 7, GUID, name("key"), b"three"), ("DELETE", 7, GUID, name("none"), b""), ("SET", 3, GUID, name("boot"), b"x"), ("APPEND", 71, GUID, name("new"), b"!"), ("SET", 7, GUID, name("big"), b"y" * 5000)])]
    changes = spark.createDataFrame(rows, "image_id string, place long, op string, attributes long, guid binary, name_wire binary, data binary")
    images, outcomes = logstore.appended(df, changes)
    got = {(r.image_id, r.place): r.error for r in outcomes.collect()}
    assert got == {**{("0", k): e for k, e in enumerate(("OK", "NotFound", "WriteProtected", "OK", "Full"))}, **{("1", k): "Record" for k in range(5)}}
    live = replay.window_live(logstore.mutations(images).where("image_id = '0'"))
    assert {bytes.fromhex(r.name).decode("utf-16-le"): bytes.fromhex(r.data) for r in live.collect()} == {"key": b"three", "new": b"n!"}
    after = {r.image_id: bytes(r.content) for r in images.collect()}
    assert after["1"] == torn and after["0"][:start] == encoded[:start]


def test_reclaim(spark):
    body = flash_record(0x3E, "a", b"old") + flash_record(0x3F, "a", b"new") + flash_record(0x3C, "b", b"x") + flash_record(0x3E, "c", b"t")
    df = table(spark, [flash_image(body)])
    areas = flash.stores(df)
    live = views.resolve(flash.records(df, areas).withColumnRenamed("name_wire", "name")).select("image_id", F.col("rec_offset").alias("place"), "attributes", "guid", F.col("name").alias("name_wire"), "data")
    out = flash.rewritten(df, areas, live)
    rows = flash.records(out.select("image_id", "content"), flash.stores(out.select("image_id", "content"))).orderBy("rec_offset").collect()
    assert [(r.status, r.state, bytes(r.data)) for r in rows] == [("OK", 0x3F, b"new"), ("OK", 0x3F, b"t")]
