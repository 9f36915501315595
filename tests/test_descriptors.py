"""Descriptors, authentication prefixes and the runtime index: whole ones, and each rule broken."""

import struct

from pyspark.sql import functions as F

from varlens.functions import wire
from varlens.operators import descriptors as d


def backing(kind=2, path=b"EFI/store.img", size=65536, unit=4096, store=b"\1" * 16, part=b"\2" * 16, magic=b"EFVB", tail=b""):
    return magic + struct.pack("<HHB7x", 1, 320, kind) + store + part + struct.pack("<QIHH", size, unit, len(path), 0) + (path + tail).ljust(256, b"\0")


def statuses(spark, rows, column):
    df = spark.createDataFrame([(k, bytes(r)) for k, r in enumerate(rows)], "k int, b binary")
    return [r.s for r in df.select("k", column(F.col("b"))["status"].alias("s")).orderBy("k").collect()]


def test_backing_rules(spark):
    cases = [
        (backing(), "OK"), (backing(1, b""), "OK"), (backing(path=b"efi/EFVS/Store.cfg"), "InvalidParameter"), (backing(path=b"/a"), "InvalidParameter"), (backing(path=b"a//b"), "InvalidParameter"), (backing(path=b"a/../b"), "InvalidParameter"),
        (backing(path=b"a./b"), "InvalidParameter"), (backing(path=b"a b"), "InvalidParameter"), (backing(path=b""), "InvalidParameter"), (backing(1), "InvalidParameter"), (backing(3), "Header"), (backing(magic=b"EFVX"), "Header"), (backing(tail=b"x"), "Header"),
        (backing(unit=513), "InvalidParameter"), (backing(unit=256), "InvalidParameter"), (backing(size=4096), "InvalidParameter"), (backing(size=32 << 20), "InvalidParameter"), (backing(store=bytes(16)), "InvalidParameter"), (backing()[:-1], "Bounds"), (backing(path=b".hidden/x-1_2.img"), "OK"),
    ]
    assert statuses(spark, [c for c, _ in cases], d.backing) == [s for _, s in cases]


def test_config_table_rules(spark):
    table = lambda caps=0, tier=0, version=2, inner=None: b"EFVT" + struct.pack("<HHB3xIQ8x", version, 352, tier, caps, 7) + (inner or backing())
    cases = [(table(), "OK"), (table(3), "OK"), (table(1), "OK"), (table(2), "Unsupported"), (table(4), "Unsupported"), (table(tier=1), "Unsupported"), (table(version=1), "Header"), (table(inner=backing(3)), "Header"), (table()[:100], "Bounds")]
    assert statuses(spark, [c for c, _ in cases], d.config_table) == [s for _, s in cases]


def cert(data=b"c", revision=0x200, kind=0xEF1, guid=bytes.fromhex(d.PKCS7), size=None):
    return struct.pack("<IHH", 24 + len(data) if size is None else size, revision, kind) + guid + data


def time(year=2024, month=2, day=31, hour=1, pad=0, nano=0, zone=0):
    return struct.pack("<HBBBBBBIhBB", year, month, day, hour, 2, 3, pad, nano, zone, 0, 0)


def test_time_based_descriptor(spark):
    cases = [
        (time() + cert() + b"value", "OK"), (bytes(16) + cert(), "OK"), (time(month=13) + cert(), "TimeStamp"), (time(pad=1) + cert(), "TimeStamp"), (time(nano=5) + cert(), "TimeStamp"), (time(zone=60) + cert(), "TimeStamp"), (time()[:9], "Truncated"),
        (time() + cert(size=20), "Length"), (time() + cert(b""), "Length"), (time() + cert(size=99), "Truncated"), (time() + cert(revision=1), "Invalid"), (time() + cert(kind=1), "CertificateType"), (time() + cert(guid=bytes(16)), "CertificateType"),
    ]
    assert statuses(spark, [c for c, _ in cases], d.auth2) == [s for _, s in cases]
    row = spark.createDataFrame([(cases[0][0],)], "b binary").select(d.auth2(F.col("b")).alias("a")).first().a
    assert bytes(row.value) == b"value" and bytes(row.certificate) == b"c" and (row.time.year, row.time.day) == (2024, 31)


def test_enhanced_descriptor(spark):
    def make(kind=1, second=None, flags=0, body=None, version=1, size=None):
        second = time() if second is None else second
        body = cert() if body is None else body
        return bytes([version, kind]) + struct.pack("<II", 10 + len(second) + len(body) if size is None else size, flags) + second + body + b"new"

    nonce = struct.pack("<I", 3) + b"abc"
    cases = [
        (make(), "OK"), (make(2, nonce), "OK"), (make(flags=1, body=cert(b"n") + cert(b"s")), "OK"), (make(version=2), "Invalid"), (make(3), "Invalid"), (make(flags=2), "Invalid"), (make(size=9), "Length"), (make(size=999), "Truncated"),
        (make(2, struct.pack("<I", 0)), "Invalid"), (make(2, struct.pack("<I", 900)), "Truncated"), (make(body=cert() + b"x"), "Length"), (make(flags=1), "Truncated"), (make(second=time(hour=24)), "TimeStamp"), (b"\1\1", "Truncated"),
    ]
    assert statuses(spark, [c for c, _ in cases], d.auth3) == [s for _, s in cases]
    row = spark.createDataFrame([(cases[1][0],)], "b binary").select(d.auth3(F.col("b")).alias("a")).first().a
    assert (row.kind, bytes(row.nonce), bytes(row.value)) == ("Nonce", b"abc", b"new")


def test_index_round_trip_and_corruption(spark):
    name = lambda s: s.encode("utf-16-le")
    rows = [("i", b"\2" * 16, name("b"), 7, b"1"), ("i", b"\1" * 16, name("選択"), 7, b""), ("i", b"\1" * 16, name("a"), 4, b"22"), ("i", b"\1" * 16, name("boot"), 3, b"hidden")]
    df = spark.createDataFrame(rows, "image_id string, guid binary, name_wire binary, attributes long, data binary")
    content = bytes(d.index_images(df).first().content)
    got = d.index_variables(spark.createDataFrame([("i", content)], "image_id string, content binary")).orderBy("place").collect()
    assert [(bytes(r.name_wire).decode("utf-16-le"), bytes(r.data)) for r in got] == [("a", b"22"), ("選択", b""), ("b", b"1")]
    used = struct.unpack_from("<I", content, 8)[0]
    broken = [content[:-8], content[:8] + struct.pack("<I", used - 8) + content[12:], content[:12] + struct.pack("<I", 4) + content[16:], b"X" + content[1:], content[:88] + struct.pack("<I", 3) + content[92:], content[:72] + (content[72:112] * 2)]
    rows = d.index_variables(spark.createDataFrame([(str(k), b) for k, b in enumerate(broken)], "image_id string, content binary")).collect()
    assert {r.status for r in rows} == {"Corrupt"} and len(rows) == len(broken)


def test_signing_input(spark):
    row = spark.range(1).select(d.signing_input(wire.name_bytes(F.lit("db")), F.unhex(F.lit("00" * 16)), F.lit(39), F.unhex(F.lit("AA" * 16)), F.lit("v").cast("binary")).alias("x")).first()
    assert bytes(row.x) == "db".encode("utf-16-le") + bytes(16) + struct.pack("<I", 39) + b"\xaa" * 16 + b"v"
