"""Runtime indexes are built and read in one pass over the images, with no Python call for each of them."""

import struct

import pytest
from pyspark.sql import functions as F

from varlens import queries as engine
from varlens.operators import descriptors as d

from .test_large_images import plan

FIELDS = "image_id long, guid binary, name_wire binary, attributes long, data binary"


def encoded(rows, truncated, capacities):
    """An index by the format's text, of (guid, name, attributes, data) in order."""
    body = b""
    for guid, name, attributes, data in rows:
        raw = guid + struct.pack("<III", attributes, len(name) + 2, len(data)) + bytes(4) + name + b"\0\0" + data
        raw += bytes(-len(raw) % 8)
        body += raw[:28] + struct.pack("<I", len(raw)) + raw[32:]
    return b"FSVRIDX1" + struct.pack("<IIII6Q", 72 + len(body), len(rows), truncated, 0, *capacities) + body


def test_roundtrip_shuffles_once_and_runs_python_once(spark, sf_dir):
    text = plan(engine.queries()["index_roundtrip"](spark, sf_dir))
    assert "FlatMapGroups" not in text and "Join" not in text
    assert (text.count("Exchange hashpartitioning"), text.count("MapInArrow"), text.count("Scan parquet")) == (1, 1, 1)


def test_bytes_limits_and_status(spark):
    name = lambda s: s.encode("utf-16-le")
    few = [(b"\1" * 16, name("b"), 7, b"1" * 9), (b"\1" * 16, name("Ă"), 4, b""), (b"\1" * 16, name("ȁ"), 2**31 + 4, b"\0"), (b"\xff" * 16, name("a"), 7, b"22")]
    rows = [(0, *r) for r in reversed(few)] + [(0, b"\0" * 16, name("boot"), 3, b"hidden")]
    rows += [(1, b"\1" * 16, name(str(k)), 7, b"") for k in range(5)]  # one more than may be
    rows += [(2, b"\1" * 16, name("n"), 7, bytes(d.MOST_VALUE)), (3, b"\1" * 16, name("n"), 7, bytes(d.MOST_VALUE + 1))]
    capacities = (1, 2, 3, 2**64 - 1, 5, 6)
    built = d.index_images(spark.createDataFrame(rows, FIELDS), capacities, True, most=4)
    got = {r.image_id: (r.status, r.content and bytes(r.content)) for r in built.collect()}
    assert got == {"0": ("OK", encoded(few, 1, capacities)), "1": ("OutOfResources", None), "2": ("OK", encoded([rows[-2][1:]], 1, capacities)), "3": ("OutOfResources", None)}
    read = d.index_variables(built.where("image_id <> '2'")).orderBy("image_id", "place").collect()
    assert [(r.image_id, r.status, r.place) for r in read] == [("0", "OK", k) for k in range(4)] + [("1", "OutOfResources", None), ("3", "OutOfResources", None)]
    assert [(bytes(r.guid), bytes(r.name_wire), r.attributes, bytes(r.data)) for r in read[:4]] == few


def test_two_mebibytes_at_most(spark):
    # 31 values of 64 KiB and one that fills the rest to the byte, or is eight bytes too long
    rest = d.MOST_INDEX_BYTES - d.INDEX_HEADER - 31 * (d.INDEX_RECORD + 8 + d.MOST_VALUE) - d.INDEX_RECORD - 8
    size = F.when(F.col("n") < 31, d.MOST_VALUE).otherwise(F.col("image_id") * 8 + rest)
    rows = spark.range(2).withColumnRenamed("id", "image_id").select("image_id", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("n"))
    rows = rows.select("image_id", F.unhex(F.lpad("n", 32, "0")).alias("guid"), F.encode(F.lit("abc"), "UTF-16LE").alias("name_wire"), F.lit(7).alias("attributes"), F.encode(F.repeat(F.lit("x"), size.cast("int")), "UTF-8").alias("data"))
    built = d.index_images(rows).orderBy("image_id").collect()
    assert [(r.status, len(r.content or b"")) for r in built] == [("OK", d.MOST_INDEX_BYTES), ("OutOfResources", 0)]


def test_variables_without_a_part_are_no_gap(spark):
    for hole in range(3):
        row = [b"\1" * 16, "n".encode("utf-16-le"), 7, b"v"]
        row[hole + (hole == 2)] = None
        with pytest.raises(Exception, match="lacks its guid, name or data"):
            d.index_images(spark.createDataFrame([(0, b"\1" * 16, b"a\0", 7, b""), (0, *row)], FIELDS)).collect()
