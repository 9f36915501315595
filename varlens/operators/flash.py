"""Flash stores: a firmware volume with a variable store of state-bit records.

Volume and store headers are column expressions; records delimit themselves, so one pass over an image
emits them (SC1, SC2 of the inventory); resolution, reclaim and sizes are relations over the rows.

Images are image_id and content. With a column erased that many erased bytes follow the content and aren't
carried along: a volume is mostly erased, and shuffles would have to sort all of it.
"""

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import policy, wire
from .batches import batched, gathered, values

#: GUIDs as stored (fixed values): the volume's file system, and the two record layouts' store signatures.
VOLUME = "8D2BF1FF96768B4CA9852747075B4F50"
NORMAL, AUTHENTICATED = "1636CFDD7532644198B6FE85707FFE7D", "782CF3AA7B949A43A1802E144EC37792"
#: A blank volume's attributes: read, write and erase polarity, as stored (fixed value).
VOLUME_ATTRIBUTES = 0x00000E36
HEADER_SIZE = {"normal": 32, "authenticated": 60}
VOLUME_HEADER, STORE_HEADER = 72, 28


def stores(images: DataFrame) -> DataFrame:
    """image_id, status, layout, start and end of each image's record area."""
    return _opened(images).drop(*_bytes(images))


def _bytes(images: DataFrame) -> list[str]:
    return ["content", "erased"] if "erased" in images.columns else ["content"]


def _opened(images: DataFrame, areas: DataFrame | None = None) -> DataFrame:
    """images with status, layout, start and end of the record area; those of areas, if given, are joined without a broadcast of contents.

    The volume's header length and 16-bit sum, its block map's total and the store's size, format and
    state are checked in that order; the first that fails is the status.
    """
    held = _bytes(images)
    if areas is not None:
        return images.select("image_id", *held).hint("merge").join(areas.select("image_id", "status", "layout", "start", "end"), "image_id")
    content = F.col("content")
    size = F.greatest(wire.uint(content, 48, 2), F.lit(VOLUME_HEADER)).cast("int") + STORE_HEADER  # as far as headers go
    # Lambdas copy each binary that they name: they get the headers alone.
    area = wire.let(F.struct(F.substring(content, F.lit(1), size).alias("c"), _length(held).alias("n")), _area)
    return images.select("image_id", *held, area.alias("area")).select("image_id", *held, "area.*")


def _length(held: list[str]) -> Column:
    return F.length("content") + (F.col("erased") if "erased" in held else F.lit(0))


def _area(x: Column) -> Column:
    """status, layout, start and end of the record area of an image of n bytes that begins with c."""
    c, n = x["c"], x["n"]

    def checked(y: Column) -> Column:
        volume, at, signature, size = y["volume"], y["at"], y["signature"], y["size"]
        words = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(at / 2) - 1, F.lit(0))), lambda k: F.conv(F.concat(F.substring(y["head"], (4 * k + 3).cast("int"), F.lit(2)), F.substring(y["head"], (4 * k + 1).cast("int"), F.lit(2))), 16, 10).cast("bigint"))
        total = F.aggregate(words, F.lit(0).cast("bigint"), lambda a, w: (a + w) % 65536)
        pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((at - 56) / 8) - 2, F.lit(0))), lambda k: wire.uint(c, (k * 8 + 56).cast("int"), 4) * wire.uint(c, (k * 8 + 60).cast("int"), 4))
        mapped = F.aggregate(pairs, F.lit(0).cast("bigint"), lambda a, w: a + F.coalesce(w, F.lit(0)))
        layout = F.when(signature == NORMAL, "normal").when(signature == AUTHENTICATED, "authenticated")
        status = (
            F.when(F.hex(wire.span(c, 40, 4)) != "5F465648", "FvSignature").when(F.hex(wire.span(c, 16, 16)) != VOLUME, "FvGuid").when(volume != n, "Bounds")
            .when((at < 72) | (at % 2 != 0) | (at > n), "Bounds").when(total != 0, "FvChecksum").when(mapped != volume, "BlockMap")
            .when(layout.isNull(), "StoreSignature").when(F.hex(wire.span(c, at + 20, 2)) != "5AFE", "StoreState").when((size < STORE_HEADER) | (at + size > n), "Bounds").otherwise("OK")
        )
        return F.struct(F.coalesce(status, F.lit("Bounds")).alias("status"), layout.alias("layout"), (at + STORE_HEADER).cast("bigint").alias("start"), (at + size).cast("bigint").alias("end"))

    at = wire.uint(c, 48, 2).cast("int")
    read = lambda at: F.struct(at.alias("at"), wire.uint(c, 32, 8).alias("volume"), F.hex(c).alias("head"), F.hex(wire.span(c, at, 16)).alias("signature"), wire.uint(c, at + 16, 4).alias("size"))
    return wire.let(at, lambda at: wire.let(read(at), checked))


def records(images: DataFrame, areas: DataFrame | None = None) -> DataFrame:
    """Records of the areas with status OK: rec_offset, rec_end, state, attributes, guid, name_wire, data.

    The scan ends at the first erased word. A record that breaks a rule ends it too, with a row that has
    the rule as status and no fields. areas are those of stores(images), found here where they aren't given.
    """

    types = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int16(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    schema = pa.schema([(str(k), t) for k, t in enumerate(types)])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched(((i["image_id"], *r) for i in values(batches) for r in _scanned(i["layout"], i["start"], i["end"], i["content"])), schema)

    rows = _opened(images, areas).where("status = 'OK'").select(F.col("image_id").cast("string"), "layout", "start", "end", "content")
    return rows.mapInArrow(task, "image_id string, status string, rec_offset long, rec_end long, state short, attributes long, guid binary, name_wire binary, data binary")


def _scanned(layout: str, at: int, end: int, data: bytes) -> Iterator[tuple]:
    """The records of one area: status, offset, end, state, attributes, guid, name, value."""
    head = HEADER_SIZE[layout]
    while at < end and data[at : at + 2] not in (b"\xff\xff", b""):  # erased bytes may be left out
        status = None
        if end - at < head or data[at : at + 2] != b"\xaa\x55":
            status = "RecordSignature"
        else:
            state, attributes = data[at + 2], struct.unpack_from("<I", data, at + 4)[0]
            name, value = struct.unpack_from("<II", data, at + head - 24)
            stop = at + (head + name + value + 3) // 4 * 4
            wire_name = data[at + head : at + head + name - 2]
            if state not in policy.LEGAL_STATES:
                status = "RecordState"
            elif name < 4 or name % 2:
                status = "Name"
            elif stop > end:
                status = "Bounds"
            elif state not in (0x7F, 0xFF) and data[at + head + name - 2 : at + head + name] != b"\0\0":
                status = "Name"
        if status:
            yield (status, at, *[None] * 6)
            return
        yield "OK", at, stop, state, attributes, data[at + head - 16 : at + head], wire_name, data[at + head + name : at + head + name + value]
        at = stop


def free_space(areas: DataFrame, rows: DataFrame) -> DataFrame:
    """capacity and free bytes of each area."""
    used = rows.where("status = 'OK'").groupBy("image_id").agg(F.max("rec_end").alias("append"))
    out = areas.where("status = 'OK'").join(used, "image_id", "left")
    return out.select("image_id", (F.col("end") - F.col("start")).alias("capacity"), (F.col("end") - F.coalesce("append", "start")).alias("free"))


def _record(layout: str, attributes: int, guid: bytes, name: bytes, data: bytes) -> bytes:
    """A record in state ADDED."""
    wire_name = name + b"\0\0"
    middle = b"" if layout == "normal" else bytes(28)
    raw = struct.pack("<HBBI", 0x55AA, policy.ADDED, 0, attributes) + middle + struct.pack("<II", len(wire_name), len(data)) + guid + wire_name + data
    return raw.ljust((len(raw) + 3) // 4 * 4, b"\xff")


def initialized(images: DataFrame, whole: bool = True) -> DataFrame:
    """Blank volumes: image_id, status (StoreSize or OK) and content of rows image_id, size, block, layout (normal, authenticated).

    Those that aren't whole have the headers as content, and erased.
    """
    size, block = F.col("size").cast("bigint"), F.col("block").cast("bigint")
    fits = (size >= VOLUME_HEADER + STORE_HEADER) & (size % 4 == 0) & (block > 0) & (size % block == 0)
    signature = F.when(F.col("layout") == "normal", F.unhex(F.lit(NORMAL))).otherwise(F.unhex(F.lit(AUTHENTICATED)))
    blank = lambda n: F.unhex(F.lit("00" * n))
    blocks_ = F.floor(size / block).cast("bigint")
    fixed = sum(struct.unpack("<36H", bytes(16) + bytes.fromhex(VOLUME) + bytes(8) + b"_FVH" + struct.pack("<IHHHBB", VOLUME_ATTRIBUTES, VOLUME_HEADER, 0, 0, 0, 2) + bytes(16)))
    words = lambda x: x % 65536 + F.floor(x / 65536)  # noqa: E731  of a number below 2**32
    check = (F.lit(2 << 32) - fixed - words(size) - words(blocks_) - words(block)) % 65536
    head = F.concat(
        blank(16), F.unhex(F.lit(VOLUME)), wire.le(size, 8), F.lit("_FVH").cast("binary"), wire.le(F.lit(VOLUME_ATTRIBUTES), 4), wire.le(F.lit(VOLUME_HEADER), 2), wire.le(check, 2), blank(3), F.unhex(F.lit("02")), wire.le(blocks_, 4), wire.le(block, 4), blank(8),
    )
    store = F.concat(signature, wire.le(size - VOLUME_HEADER, 4), F.unhex(F.lit("5AFE")), blank(6))
    erased = (size - VOLUME_HEADER - STORE_HEADER).cast("int")
    content = F.concat(head, store, F.unhex(F.repeat(F.lit("FF"), erased))) if whole else F.concat(head, store)
    made = images.select(F.col("image_id").cast("string").alias("image_id"), F.when(fits, "OK").otherwise("StoreSize").alias("status"), F.when(fits, content).alias("content"), F.when(fits, erased).cast("bigint").alias("erased"))
    return made.drop("erased") if whole else made


def changed(images: DataFrame, changes: DataFrame, contents: bool = True) -> DataFrame:
    """Sets and deletes written to flash images: outcome rows (image_id, place, outcome) and, with contents, one row with each image's content.

    changes: image_id, place, attributes, guid, name_wire, data; empty data deletes. A set appends a record
    and retires the live ones of its key: they pass through transition (a state bit cleared before, one
    after); a delete clears the deletion bit of all live ones. What is refused, Full among it, leaves the
    image as it was, and a set of what is stored already writes nothing.
    """
    held_bytes = _bytes(images)
    state = _opened(images).withColumn("image_id", F.col("image_id").cast("string"))
    asked = changes.select(F.col("image_id").cast("string").alias("image_id"), F.col("place").cast("long").alias("place"), F.col("attributes").cast("long").alias("attributes"), "guid", "name_wire", "data")

    def write(i: dict) -> Iterator[tuple]:
        status, content, live, at = i["status"], bytearray(i["content"]), {}, i["start"]
        length = len(content) + i.get("erased", 0)
        for broken, offset, end, kept, word, guid, name, data in _scanned(i["layout"], at, i["end"], i["content"]) if status == "OK" else ():
            if broken != "OK":
                status = broken
                break
            at = end
            if kept in (policy.ADDED, policy.IN_TRANSITION):
                live.setdefault((guid, name), []).append((offset, kept, word, data))

        def retire(held: list, mask: int) -> None:
            for offset, *_ in held:
                content[offset + 2] &= mask

        def outcome(r: dict) -> str:
            nonlocal at
            key = r["guid"], r["name_wire"]
            held, word, data = live.get(key, []), r["attributes"], r["data"] or b""
            if not valid_units(r["name_wire"]):
                return "Name"
            if word & 0xB0 or any(h[2] & 0xB0 for h in held):
                return "AuthenticatedWrite"
            if word & ~0x0F or word & 3 != 3:
                return "UnsupportedAttributes"
            if not data:
                retire(held, 0xFD)
                return "Deleted" if live.pop(key, None) else "Absent"
            added = [h for h in held if h[1] == policy.ADDED] or held[-1:]  # the version that a reader gets
            if added and added[0][2:] == (word, data):
                return "Unchanged"
            record = _record(i["layout"], word, *key, data)
            if at + len(record) > i["end"]:
                return "Full"
            retire(held, 0xFE)
            content[at : at + len(record)] = record
            live[key] = [(at, policy.ADDED, word, data)]
            at += len(record)
            retire(held, 0xFD)
            return "Written"

        for r in sorted(i["changes"] or (), key=lambda r: r["place"]):
            yield i["image_id"], r["place"], outcome(r) if status == "OK" else status, *[None] * len(held_bytes)
        if contents:
            yield i["image_id"], None, None, bytes(content), *([length - len(content)] if "erased" in held_bytes else [])

    schema = pa.schema([("image_id", pa.string()), ("place", pa.int64()), ("outcome", pa.string()), *_BYTES[: len(held_bytes)]])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched((row for i in values(batches) for row in write(i)), schema)

    every = gathered(asked, "changes").withColumnRenamed("image_id", "of")
    rows = state.hint("merge").join(every, F.col("image_id").eqNullSafe(F.col("of")), "left").drop("of")
    return rows.mapInArrow(task, ", ".join(["image_id string, place long, outcome string, content binary", "erased long"][: len(held_bytes)]))


_BYTES = [("content", pa.binary()), ("erased", pa.int64())]


def valid_units(name: bytes) -> bool:
    """wire.valid_name() of one row."""
    text = name.decode("utf-16-le", "replace")
    return 0 < len(name) <= 65534 and "\0" not in text and text.encode("utf-16-le") == name


def rewritten(images: DataFrame, areas: DataFrame | None, keep: DataFrame) -> DataFrame:
    """Images whose record area holds the rows of keep (image_id, place, attributes, guid, name_wire, data) alone, in order.

    With the resolved versions of a store this is a reclaim: every live variable once, all ADDED. Rows that
    don't fit are an error (Full), and the image then stays as it was. areas as in records.
    """

    held = _bytes(images)

    def write(i: dict) -> tuple:
        content, length = i["content"], len(i["content"]) + i.get("erased", 0)
        body = b"".join(_record(i["layout"], r["attributes"], r["guid"], r["name_wire"], r["data"]) for r in sorted(i["keep"] or (), key=lambda r: r["place"]))
        full = len(body) > i["end"] - i["start"]
        if not full:
            after = content[i["end"] :]
            body = body.ljust(i["end"] - i["start"], b"\xff") if after or "erased" not in held else body
            content = content[: i["start"]] + body + after
        return i["image_id"], "Full" if full else "OK", content, *([length - len(content)] if "erased" in held else [])

    schema = pa.schema([("image_id", pa.string()), ("status", pa.string()), *_BYTES[: len(held)]])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched(map(write, values(batches)), schema)

    state = _opened(images, areas).where("status = 'OK'").select(F.col("image_id").cast("string").alias("image_id"), "layout", "start", "end", *held)
    rows = gathered(keep.select("image_id", F.col("place").cast("bigint").alias("place"), F.col("attributes").cast("bigint").alias("attributes"), "guid", "name_wire", "data"), "keep").withColumnRenamed("image_id", "of")
    every = state.hint("merge").join(rows, F.col("image_id").eqNullSafe(F.col("of")), "left").drop("of")
    return every.mapInArrow(task, ", ".join(["image_id string, status string, content binary", "erased long"][: len(held)]))
