"""Fixed descriptors, authentication prefixes and the runtime index."""

import struct
from collections.abc import Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import policy, wire
from ..functions.wire import span, uint

BACKING_SIZE, TABLE_SIZE, MOST_STORE_BYTES = 320, 352, 16 << 20
#: The descriptor's own place, which no store may take, and what a path's parts look like (fixed values).
SELECTOR_PATH = "efi/efvs/store.cfg"
PATH_PART = r"(?=.{1,255}(?:/|$))(?!\.{1,2}(?:/|$))[A-Za-z0-9_.-]*[A-Za-z0-9_-]"
#: Certificate header: revision, kind, PKCS#7 type (fixed values).
REVISION, EFI_GUID_KIND, PKCS7 = 0x0200, 0x0EF1, "9DD2AF4ADF68EE498AA9347D375665A7"
INDEX_MAGIC, INDEX_HEADER, INDEX_RECORD = b"FSVRIDX1", 72, 32
MOST_INDEX_BYTES, MOST_NAME_UNITS, MOST_VALUE, MOST_VARIABLES = 2 << 20, 256, 65_536, 512
#: Variables read from indexes in a batch.
INDEX_ROWS = 4096


def backing(data: Column, at: int = 0) -> Column:
    """A backing descriptor of 320 bytes as a struct with status: Bounds, Header, InvalidParameter or OK."""
    return wire.let(span(data, at, BACKING_SIZE), _backing)


def _backing(b: Column) -> Column:
    size, unit, length = uint(b, 48, 8), uint(b, 56, 4), uint(b, 60, 2)
    kind = uint(b, 8, 1)
    raw = F.substring(b, F.lit(65), F.least(length, F.lit(256)).cast("int"))
    path = F.decode(raw, "ISO-8859-1")
    rest = F.substring(b, (length + 65).cast("int"), F.lit(256))
    header = (F.hex(span(b, 0, 4)) == "45465642") & (uint(b, 4, 2) == 1) & (uint(b, 6, 2) == BACKING_SIZE) & wire.filled(span(b, 9, 7), 0) & wire.filled(span(b, 62, 2), 0) & kind.isin(1, 2) & (length <= 256) & wire.filled(rest, 0)
    fine = ~wire.filled(span(b, 16, 16), 0) & ~wire.filled(span(b, 32, 16), 0) & unit.between(512, 65536) & (unit.bitwiseAND(unit - 1) == 0) & (size >= unit * 2) & (size <= MOST_STORE_BYTES) & (size % unit == 0)
    placed = F.when(kind == 1, length == 0).otherwise(path.rlike(f"^{PATH_PART}(?:/{PATH_PART})*$") & (F.lower(path) != SELECTOR_PATH))
    status = F.when(b.isNull(), "Bounds").when(~header, "Header").when(~(fine & placed), "InvalidParameter").otherwise("OK")
    return F.struct(F.when(kind == 1, "Partition").when(kind == 2, "File").alias("kind"), span(b, 16, 16).alias("store_uuid"), span(b, 32, 16).alias("partition_uuid"), size.alias("store_size"), unit.alias("write_unit"), path.alias("path"), status.alias("status"))


def encoded_backing(kind: Column, store_uuid: Column, partition_uuid: Column, store_size: Column, write_unit: Column, path: Column) -> Column:
    """A backing descriptor's 320 bytes (kind Partition or File; null path: none), with no check: backing() tells its status."""
    raw = F.encode(F.coalesce(path, F.lit("")), "ISO-8859-1")
    zeros = lambda n: F.unhex(F.lit("00" * n))
    code = F.when(kind == "Partition", 1).otherwise(2)
    filler = F.unhex(F.repeat(F.lit("00"), F.greatest(F.lit(256) - F.length(raw), F.lit(0)).cast("int")))
    return F.concat(F.lit("EFVB").cast("binary"), wire.le(F.lit(1), 2), wire.le(F.lit(BACKING_SIZE), 2), wire.le(code, 1), zeros(7), store_uuid, partition_uuid, wire.le(store_size, 8), wire.le(write_unit, 4), wire.le(F.length(raw), 2), zeros(2), raw, filler)


def encoded_config_table(capabilities: Column, anchor: Column, backing_bytes: Column) -> Column:
    """A configuration table's 352 bytes around an encoded backing descriptor."""
    zeros = lambda n: F.unhex(F.lit("00" * n))
    return F.concat(F.lit("EFVT").cast("binary"), wire.le(F.lit(2), 2), wire.le(F.lit(TABLE_SIZE), 2), wire.le(policy.posture_tier(), 1), zeros(3), wire.le(capabilities, 4), wire.le(anchor, 8), zeros(8), backing_bytes)


def selected_backing(selector: Column) -> Column:
    """status of a selector file's content (null: there is none): unconfigured, Bounds for any size but a descriptor's, else the descriptor's own."""
    return F.when(selector.isNull(), "unconfigured").when(F.length(selector) != BACKING_SIZE, "Bounds").otherwise(backing(selector)["status"])


def targets(descriptors_: DataFrame, files: DataFrame, partitions: DataFrame) -> DataFrame:
    """Descriptors (id, volume, kind, partition_uuid, store_size, path) against what is there: status of each.

    files: volume, path, regular, size, image_ok; partitions: uuid, size, image_ok. A target is missing,
    ambiguous (two partitions of one identity), not regular, of another size, no valid image, or OK.
    """
    found = files.select("volume", "path", F.col("regular").alias("_regular"), F.col("size").alias("_file"), F.col("image_ok").alias("_file_ok"))
    known = partitions.groupBy(F.col("uuid").alias("partition_uuid")).agg(F.count("*").alias("_n"), F.min("size").alias("_part"), F.min("image_ok").alias("_part_ok"))
    rows = descriptors_.join(found, ["volume", "path"], "left").join(known, "partition_uuid", "left")
    is_file = F.col("kind") == "File"
    size, ok = F.when(is_file, F.col("_file")).otherwise(F.col("_part")), F.when(is_file, F.col("_file_ok")).otherwise(F.col("_part_ok"))
    status = F.when(size.isNull(), "missing").when(~is_file & (F.col("_n") > 1), "ambiguous").when(is_file & ~F.col("_regular"), "not regular").when(size != F.col("store_size"), "size").when(~ok, "image").otherwise("OK")
    return rows.select("id", status.alias("status"))


def selection_plan(status: Column, selected: Column, replace: Column, exists: Column, provision: Column) -> Column:
    """What provisioning (a new target) or selecting (one that is there) does: its plan or the reason it refuses.

    status: the target's, selected: a selector is there already, exists: something is at a new target's place.
    """
    return (
        F.when(provision & selected, "already selected").when(provision & exists, "already exists").when(provision, "create and select")
        .when(status != "OK", F.concat(F.lit("refuse: "), status)).when(selected & ~replace, "already selected").when(selected, "replace").otherwise("select")
    )


def config_table(data: Column) -> Column:
    """A configuration table of 352 bytes as a struct with status; version 1 is refused."""
    return wire.let(span(data, 0, TABLE_SIZE), _config_table)


def _config_table(t: Column) -> Column:
    header = (F.hex(span(t, 0, 4)) == "45465654") & (uint(t, 4, 2) == 2) & (uint(t, 6, 2) == TABLE_SIZE) & wire.filled(span(t, 9, 3), 0) & wire.filled(span(t, 24, 8), 0)
    read = F.struct(t.isNull().alias("cut"), header.alias("header"), uint(t, 8, 1).alias("tier"), uint(t, 12, 4).alias("capabilities"), uint(t, 16, 8).alias("anchor"), backing(t, 32).alias("backing"))

    def parsed(x: Column) -> Column:
        bump_alone = x["capabilities"].bitwiseAND(F.lit(3)) == 2
        allowed = (x["tier"] == 0) & (x["capabilities"] <= 3) & ~bump_alone
        status = F.when(x["cut"], "Bounds").when(~x["header"], "Header").when(x["backing"]["status"] != "OK", x["backing"]["status"]).when(~allowed, "Unsupported").otherwise("OK")
        return F.struct(*[x[c].alias(c) for c in ("tier", "capabilities", "anchor", "backing")], status.alias("status"))

    return wire.let(read, parsed)


def _certificate(data: Column, at: Column) -> tuple[Column, Column]:
    """(length of the certificate block at a place, its first broken rule or null)."""
    size = uint(data, at, 4)
    error = (
        F.when(size.isNull(), "Truncated").when(size < 24, "Length").when(at + size > F.length(data), "Truncated").when(uint(data, at + 4, 2) != REVISION, "Invalid")
        .when(uint(data, at + 6, 2) != EFI_GUID_KIND, "CertificateType").when(size == 24, "Length").when(F.hex(span(data, at + 8, 16)) != PKCS7, "CertificateType")
    )
    return size, error


def _time_error(data: Column, at: Column | int) -> Column:
    def error(t: Column) -> Column:
        plain = (t["pad1"] == 0) & (t["pad2"] == 0) & (t["nanosecond"] == 0) & (t["zone"] == 0) & (t["daylight"] == 0)
        return F.when(t["pad2"].isNull(), "Truncated").when(~(plain & (wire.time_is_zero(t) | wire.time_is_valid(t))), "TimeStamp")

    return wire.let(wire.efi_time(data, at), error)


def auth2(payload: Column) -> Column:
    """A time-based descriptor: time, certificate, value and status (the first broken rule or OK)."""

    def parsed(x: Column) -> Column:
        cut = lambda start, n: F.when(x["status"] == "OK", F.substring(payload, start.cast("int"), n))
        size = x["size"]
        return F.struct(
            F.when(x["status"] == "OK", wire.efi_time(payload, 0)).alias("time"), cut(F.lit(41), (size - 24).cast("int")).alias("certificate"),
            cut(size + 17, F.length(payload)).alias("value"), x["status"].alias("status"),
        )

    size, broken = _certificate(payload, F.lit(16))
    return wire.let(F.struct(size.alias("size"), F.coalesce(_time_error(payload, 0), broken, F.lit("OK")).alias("status")), parsed)


AUTH3 = "kind string, time binary, nonce binary, updates_certificate boolean, value binary, status string"


def _certificate_end(data: bytes, at: int) -> tuple[int, str | None]:
    if len(data) - at < 4:
        return at, "Truncated"
    (size,) = struct.unpack_from("<I", data, at)
    block = data[at : at + size]
    if size < 24:
        return at, "Length"
    if len(block) < size:
        return at, "Truncated"
    revision, kind = struct.unpack_from("<HH", block, 4)
    if revision != REVISION:
        return at, "Invalid"
    if kind != EFI_GUID_KIND:
        return at, "CertificateType"
    if size == 24:
        return at, "Length"
    return at + size, None if block[8:24].hex().upper() == PKCS7 else "CertificateType"


def _plain_time(t: bytes) -> bool:
    """A time without pads, nanoseconds, zone and daylight: zero or in range."""
    year, month, day, hour, minute, second = struct.unpack_from("<HBBBBB", t)
    return not any(t[7:]) and (not any(t) or (1900 <= year <= 9999 and 1 <= month <= 12 and 1 <= day <= 31 and hour < 24 and minute < 60 and second < 60))


def _enhanced(data: bytes) -> tuple:
    """One enhanced descriptor; its parts lie one behind the other, each telling its size."""
    bad = lambda status: (None, None, None, None, None, status)
    if len(data) < 10:
        return bad("Truncated")
    version, kind, size, flags = struct.unpack_from("<BBII", data)
    if version != 1 or kind not in (1, 2) or flags > 1:
        return bad("Invalid")
    if size < 10:
        return bad("Length")
    if size > len(data):
        return bad("Truncated")
    head, time, nonce = data[:size], None, None
    if kind == 1:
        time, at = head[10:26], 26
        if len(time) < 16:
            return bad("Truncated")
        if not _plain_time(time):
            return bad("TimeStamp")
    else:
        count = int.from_bytes(head[10:14], "little")
        nonce, at = head[14 : 14 + count], 14 + count
        if len(head) < 14 or len(nonce) < count:
            return bad("Truncated")
        if not count:
            return bad("Invalid")
    for _ in range(1 + flags):  # the new certificate, if there is one, then the signing one
        at, error = _certificate_end(head, at)
        if error:
            return bad(error)
    return bad("Length") if at != size else ("TimeStamp" if kind == 1 else "Nonce", time, nonce, bool(flags), data[size:], "OK")


def auth3(payload: Column) -> Column:
    """An enhanced descriptor as a struct: kind, time or nonce, whether it carries a new certificate, value, status.

    Where a part begins depends on all before it, so this is an Arrow function instead of an expression.
    """

    @F.pandas_udf(AUTH3)
    def parsed(raw: pd.Series) -> pd.DataFrame:
        rows = [_enhanced(bytes(x)) if x is not None else (*[None] * 5, "Truncated") for x in raw]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in AUTH3.split(", ")])

    return parsed(payload)


def signing_input(name: Column, guid: Column, attributes: Column, descriptor: Column, value: Column, nonce: Column | None = None, certificate: Column | None = None) -> Column:
    """The bytes that a signature covers: name, guid, attributes, the descriptor's covered part, value, and where the
    descriptor has them the stored nonce and the new certificate."""
    more = [F.coalesce(x, F.unhex(F.lit(""))) for x in (nonce, certificate) if x is not None]
    return F.concat(name, guid, wire.le(attributes, 4), descriptor, value, *more)


def index_images(variables: DataFrame, capacities: tuple[int, ...] = (0,) * 6, truncated: bool = False, most: int = MOST_VARIABLES) -> DataFrame:
    """A runtime index (image_id, status, content) of each image's runtime variables, sorted by guid and 16-bit units.

    A snapshot has 512 variables (most) and 2 MiB at most; more of either gives a row of status
    OutOfResources without content, as does a value over 64 KiB. truncated tells readers that firmware
    variables were left out; capacities are the stored triples (size, remaining, largest value) of both classes.
    """

    length, name = F.length("data"), F.concat("name_wire", F.unhex(F.lit("0000")))
    rows = variables.where(policy.runtime_visible(F.col("attributes"))).withColumn("size", wire.align(INDEX_RECORD + F.length(name) + length, 8))
    in_order = Window.partitionBy("image_id").orderBy("guid", "order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("order", wire.name_sort_key(F.col("name_wire"))).withColumns({"place": F.row_number().over(in_order), "upto": F.sum("size").over(in_order)})
    record = F.rpad(F.concat("guid", *[wire.le(x, 4) for x in (F.col("attributes"), F.length(name), length, F.col("size"))], name, "data"), F.col("size").cast("int"), F.unhex(F.lit("00")))
    fits = (F.col("place") <= most) & (INDEX_HEADER + F.col("upto") <= MOST_INDEX_BYTES) & (length <= MOST_VALUE)
    whole = F.col("guid").isNotNull() & F.col("name_wire").isNotNull() & F.col("data").isNotNull()
    lacking = F.raise_error(F.lit("a variable of an index lacks its guid, name or data"))
    # no bytes are gathered of variables that don't fit, however many an image has
    rows = rows.select("image_id", "place", "size", fits.alias("fits"), F.when(~whole, lacking).when(fits, record).alias("record"))
    built = rows.groupBy("image_id").agg(F.bool_and("fits").alias("fits"), F.count("*").alias("n"), F.sum("size").alias("size"), F.expr("listagg(record) WITHIN GROUP (ORDER BY place)").alias("body"))
    head = F.concat(F.lit(INDEX_MAGIC), wire.le(F.col("size") + INDEX_HEADER, 4), wire.le(F.col("n"), 4), F.lit(struct.pack("<II6Q", truncated, 0, *capacities)))
    return built.select(F.col("image_id").cast("string").alias("image_id"), F.when(F.col("fits"), "OK").otherwise("OutOfResources").alias("status"), F.when(F.col("fits"), F.concat(head, "body")).alias("content"))


def index_head(images: DataFrame) -> DataFrame:
    """What runtime indexes (image_id, content) say of themselves: variables, truncated, and the two triples of capacities."""
    names = [f"{kind}_{part}" for kind in ("nv", "volatile") for part in ("size", "remaining", "largest")]
    numbers = [uint("content", 24 + 8 * k, 8).alias(name) for k, name in enumerate(names)]
    return images.select("image_id", uint("content", 12, 4).alias("variables"), (uint("content", 16, 4) != 0).alias("truncated"), *numbers)


def index_variables(images: DataFrame) -> DataFrame:
    """Variables of runtime indexes (image_id, content): status, place, guid, attributes, name_wire, data.

    An index that breaks a rule gives one row with the status Corrupt. Images may have a status: one that isn't OK,
    such as index_images gives those without an index, gives one row with it.
    """

    def parse(data: bytes | None) -> list[tuple] | None:
        if data is None or len(data) < INDEX_HEADER or data[:8] != INDEX_MAGIC:
            return None
        used, count = struct.unpack_from("<II", data, 8)
        if not INDEX_HEADER <= used <= min(len(data), MOST_INDEX_BYTES) or count > MOST_VARIABLES:
            return None
        rows, keys, at = [], set(), INDEX_HEADER
        for place in range(count):
            if used - at < INDEX_RECORD:
                return None
            attributes, name, value, size = struct.unpack_from("<IIII", data, at + 16)
            end = at + INDEX_RECORD + name
            if size % 8 or INDEX_RECORD + name + value > size or at + size > used or name < 4 or name % 2 or name > 2 * MOST_NAME_UNITS or value > MOST_VALUE or not attributes & policy.RT or data[end - 2 : end] != b"\0\0":
                return None
            key = data[at : at + 16], data[at + INDEX_RECORD : end - 2]
            units = key[1].decode("utf-16-le", "replace")
            if key in keys or "\0" in units or units.encode("utf-16-le") != key[1]:
                return None
            keys.add(key)
            rows.append((place, key[0], attributes, key[1], data[end : end + value]))
            at += size
        return rows if at == used else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for image, status, data in zip(*(c.to_pylist() for c in batch.columns)):
                rows = parse(data) if status == "OK" else None
                if rows is None:
                    yield (image, "Corrupt" if status == "OK" else status, *[None] * 5)
                else:
                    yield from ((image, "OK", *r) for r in rows)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = read(batches)
        types = (pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary())
        while out := list(islice(rows, INDEX_ROWS)):
            yield pa.record_batch([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], [str(k) for k in range(7)])

    status = F.col("status") if "status" in images.columns else F.lit("OK")
    return images.select(F.col("image_id").cast("string"), status, "content").mapInArrow(task, "image_id string, status string, place long, guid binary, attributes long, name_wire binary, data binary")
