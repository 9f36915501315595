"""Fixed-width fields and sizes of the wire formats, as column expressions over BINARY."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Order in which hex digit pairs of a GUID's text follow those of its mixed-endian bytes (fixed value).
_GUID_PAIRS = (3, 2, 1, 0, None, 5, 4, None, 7, 6, None, 8, 9, None, 10, 11, 12, 13, 14, 15)
#: Hex of a valid UTF-16LE name: no NUL unit, every surrogate in a pair (fixed value).
UTF16_NAME = r"^(?:(?!0000)[0-9A-F]{2}(?!D[89A-F])[0-9A-F]{2}|[0-9A-F]{2}D[89AB][0-9A-F]{2}D[C-F])+$"


def span(data: Column | str, offset: Column | int, size: Column | int) -> Column:
    """size bytes from offset; null where they aren't all there."""
    data = F.col(data) if isinstance(data, str) else data
    offset, size = (x if isinstance(x, Column) else F.lit(x) for x in (offset, size))
    return F.when((offset >= 0) & (offset + size <= F.length(data)), F.substring(data, offset + 1, size))


def uint(data: Column | str, offset: Column | int, size: int) -> Column:
    """An unsigned little-endian integer: BIGINT up to four bytes, DECIMAL(20,0) for eight."""
    pairs = F.hex(span(data, offset, size))
    big_endian = F.concat(*[F.substring(pairs, 2 * k + 1, 2) for k in reversed(range(size))])
    return F.conv(big_endian, 16, 10).cast("bigint" if size <= 4 else "decimal(20,0)")


def let(value: Column, body) -> Column:
    """body(value) with the value's expression written once, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def le(value: Column, size: int) -> Column:
    """An integer as size little-endian bytes."""
    digits = F.lpad(F.hex(value.cast("bigint")), 2 * size, "0")
    return F.unhex(F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size))]))


def checked_next(sequence: Column) -> Column:
    """The sequence number after one of eight bytes; null where that has nine."""
    following = sequence.cast("decimal(20,0)") + F.lit(1)
    return F.when(following < F.lit("18446744073709551616").cast("decimal(21,0)"), following.cast("decimal(20,0)"))


def align(value: Column, to: int) -> Column:
    """The next multiple of to."""
    return F.floor((value + (to - 1)) / to).cast("bigint") * to


def log_record_size(name_bytes: Column, data_bytes: Column) -> Column:
    """Bytes of a log record: 76 of header, name and data, padded to 8, and a 32-byte hash."""
    return align(name_bytes + data_bytes + 76 + 32, 8)


def checkpoint_entry_size(name_bytes: Column, data_bytes: Column) -> Column:
    return align(name_bytes + data_bytes + 48, 8)


def guid_text(guid: Column) -> Column:
    """The canonical text of 16 mixed-endian GUID bytes."""
    pairs = F.lower(F.hex(guid))
    return F.concat(*[F.lit("-") if k is None else F.substring(pairs, 2 * k + 1, 2) for k in _GUID_PAIRS])


def guid_bytes(text: Column) -> Column:
    """Mixed-endian bytes of a GUID's text, null for other texts."""
    ok = text.rlike("^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$")
    plain = F.regexp_replace(text, "-", "")
    order = [k for k in _GUID_PAIRS if k is not None]
    return F.when(ok, F.unhex(F.concat(*[F.substring(plain, 2 * order.index(k) + 1, 2) for k in range(16)])))


def name_bytes(text: Column) -> Column:
    return F.encode(text, "UTF-16LE")


def lossy_text(wire: Column) -> Column:
    """A UTF-16LE name as text: lone surrogates become U+FFFD, an odd last byte is dropped."""
    units = F.regexp_replace(F.hex(wire), "(..)(..)?", "$1$2 ")
    pairs = r"([0-9A-F]{2}D[89AB]) ([0-9A-F]{2}D[C-F]) "
    marked = F.regexp_replace(F.regexp_replace(units, pairs, "<$1$2>"), "(?<![0-9A-F<])[0-9A-F]{2}D[89A-F] ", "FDFF ")
    return F.decode(F.unhex(F.regexp_replace(F.regexp_replace(marked, "(?<![0-9A-F])[0-9A-F]{2} ", ""), "[<> ]", "")), "UTF-16LE")


def valid_name(wire: Column) -> Column:
    """A non-empty UTF-16LE name without NUL units or lone surrogates, of 65534 bytes at most."""
    return F.coalesce(F.hex(wire).rlike(UTF16_NAME) & (F.length(wire) <= 65534), F.lit(False))


def name_sort_key(wire: Column) -> Column:
    """Bytes that order as the name's 16-bit units do."""
    return F.unhex(F.regexp_replace(F.hex(wire), "(..)(..)", "$2$1"))


def parse_attributes(text: Column) -> Column:
    """`0x7`, `07` or `7`, always hexadecimal; null for others."""
    return F.when(text.rlike("^(0[xX])?[0-9A-Fa-f]{1,8}$"), F.conv(F.regexp_replace(text, "^0[xX]", ""), 16, 10).cast("bigint"))


def checksum16(data: Column, size: int) -> Column:
    """Sum of 16-bit little-endian words modulo 65536 over the first size bytes."""
    total: Column = F.lit(0)
    for k in range(0, size, 2):
        total = total + uint(data, k, 2)
    return total % 65536


def filled(data: Column, byte: int) -> Column:
    """Whether every byte is the given one (true for no bytes)."""
    return data == F.unhex(F.repeat(F.lit(f"{byte:02X}"), F.length(data)))


def efi_time(data: Column, offset: Column | int) -> Column:
    """A 16-byte EFI_TIME as a struct; its first seven fields order as times do."""
    at = lambda k: (offset if isinstance(offset, Column) else F.lit(offset)) + k
    parts = (("year", 0, 2), ("month", 2, 1), ("day", 3, 1), ("hour", 4, 1), ("minute", 5, 1), ("second", 6, 1), ("nanosecond", 8, 4), ("zone", 12, 2), ("daylight", 14, 1), ("pad1", 7, 1), ("pad2", 15, 1))
    return F.struct(*[uint(data, at(o), n).cast("int").alias(name) for name, o, n in parts])


def time_is_zero(t: Column) -> Column:
    """The time of a platform without a clock."""
    return t["year"] + t["month"] + t["day"] + t["hour"] + t["minute"] + t["second"] + t["nanosecond"] + t["zone"] + t["daylight"] == 0


def time_is_valid(t: Column) -> Column:
    """In range field by field; 31 February is."""
    ok = t["year"].between(1900, 9999) & (t["daylight"] <= 1)
    for name, low, high in (("month", 1, 12), ("day", 1, 31), ("hour", 0, 23), ("minute", 0, 59), ("second", 0, 59), ("nanosecond", 0, 999_999_999)):
        ok = ok & t[name].between(low, high)
    return ok & ((t["zone"] == 2047) | (t["zone"] <= 1440) | (t["zone"] >= 65536 - 1440))
