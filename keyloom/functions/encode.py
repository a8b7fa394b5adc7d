"""Key encodings as column expressions that stay within code generation, and their twins for literal values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Alphabets and the constants of 32-bit FNV-1a.
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
ORDERED64 = "-0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz"
CSV64 = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/"
FNV_START, FNV_PRIME, MASK = 2166136261, 16777619, 0xFFFFFFFF


class EncodeError(ValueError):
    """A value that an encoding cannot hold."""


def _long(c: Column | int) -> Column:
    return (c if isinstance(c, Column) else F.lit(c)).cast("bigint")


# Decimal slots ---------------------------------------------------------------------------------------------------


def _check_slots(slots: Sequence[int]) -> None:
    if any(d < 1 for d in slots) or sum(slots) > 18:
        raise EncodeError(f"slots {list(slots)} must be positive and fit into 18 digits")


def pack(columns: Sequence[Column], slots: Sequence[int]) -> Column:
    """Integers side by side in decimal slots; a value longer than its slot loses its last digits; negative ones raise."""
    _check_slots(slots)
    out, left = F.lit(0).cast("bigint"), sum(slots)
    for c, d in zip(columns, slots, strict=True):
        left -= d
        text = _long(c).cast("string")
        trimmed = F.when(F.length(text) > d, F.substring(text, 1, d).cast("bigint")).otherwise(_long(c))
        out = out + F.when(_long(c) < 0, F.raise_error(F.lit("a negative value cannot be packed")).cast("bigint")).otherwise(trimmed) * F.lit(10**left)
    return out


def unpack(packed: Column, slots: Sequence[int]) -> list[Column]:
    _check_slots(slots)
    ends = [sum(slots[i + 1 :]) for i in range(len(slots))]
    return [_div(packed, 10**e) % F.lit(10**d) for e, d in zip(ends, slots, strict=True)]


def _div(c: Column, by: int) -> Column:
    """Whole-number division, without a detour over doubles."""
    return F.call_function("div", _long(c), F.lit(by).cast("bigint"))


def pack_value(values: Sequence[int], slots: Sequence[int]) -> int:
    out = 0
    for v, d in zip(values, slots, strict=True):
        if v < 0:
            raise EncodeError("a negative value cannot be packed")
        out = out * 10**d + int(str(v)[:d])
    return out


def unpack_value(packed: int, slots: Sequence[int]) -> list[int]:
    out = []
    for d in reversed(slots):
        packed, v = divmod(packed, 10**d)
        out.append(v)
    return out[::-1]


def key_slots(slots: Sequence[int], budget: int = 18) -> list[int]:
    """Slots of a packed key; a last slot of 0 takes the digits that are left."""
    left = budget - sum(slots[:-1]) if slots and slots[-1] == 0 else 0
    out = [*slots[:-1], left] if slots and slots[-1] == 0 else list(slots)
    _check_slots(out)
    return out


# Text keys -------------------------------------------------------------------------------------------------------


def base62(c: Column) -> Column:
    """The token of an integer: no leading zeros, empty for values up to 0. Its order is not that of the numbers."""
    v, digits = _long(c), []
    for i in range(10, -1, -1):
        digits.append(F.substring(F.lit(BASE62), (_div(v, 62**i) % F.lit(62)).cast("int") + 1, F.lit(1)))
    return F.when(v <= 0, F.lit("")).otherwise(F.ltrim(F.concat(*digits), F.lit("0")))


def base62_value(v: int) -> str:
    out = ""
    while v > 0:
        v, d = divmod(v, 62)
        out = BASE62[d] + out
    return out


def concat_key(columns: Sequence[tuple[Column, str]]) -> Column:
    """Tokens of (column, Spark type) joined by underscores, those at the end that are empty left out."""
    tokens = [base62(c) if t in ("bigint", "int", "smallint") else F.coalesce(c.cast("string"), F.lit("")) for c, t in columns]
    return F.rtrim(F.concat_ws("_", *[F.coalesce(t, F.lit("")) for t in tokens]), F.lit("_"))


def ordered64(c: Column, width: int) -> Column:
    """Fixed width and ascending alphabet: the order of texts is that of the numbers. Values that do not fit raise."""
    if not 1 <= width <= 11:
        raise EncodeError("a width is from 1 to 11")
    v = _long(c)
    digits = [F.substring(F.lit(ORDERED64), F.shiftright(v, 6 * i).bitwiseAND(F.lit(63).cast("bigint")).cast("int") + 1, F.lit(1)) for i in range(width - 1, -1, -1)]
    fits = (v >= 0) if width == 11 else (v >= 0) & (v < F.lit(64**width))
    return F.when(v.isNull() | fits, F.concat(*digits)).otherwise(F.raise_error(F.concat(F.lit("value does not fit: "), v.cast("string"))))


def ordered64_value(v: int, width: int) -> str:
    if v < 0 or v >= 64**width or v >= 2**63:
        raise EncodeError(f"{v} does not fit into width {width}")
    return "".join(ORDERED64[(v >> (6 * i)) & 63] for i in range(width - 1, -1, -1))


def ordered64_decode(text: str) -> int:
    out = 0
    for c in text:
        out = out * 64 + ORDERED64.index(c)
    return out


def composite_key(parts: Sequence[Column]) -> Column:
    """Parts joined by number signs; a text part must not hold one."""
    checked = [F.when(F.contains(p.cast("string"), F.lit("#")), F.raise_error(F.lit("a key part holds a number sign"))).otherwise(p.cast("string")) for p in parts]
    return F.concat_ws("#", *checked)


def csv64_value(v: int) -> str:
    out, n = "", abs(v)
    while n:
        n, d = divmod(n, 64)
        out = CSV64[d] + out
    return ("-" if v < 0 else "") + (out or CSV64[0])


def csv64_decode(text: str) -> int:
    out = 0
    for c in text.lstrip("-"):
        out = out * 64 + CSV64.index(c)
    return -out if text.startswith("-") else out


def csv64(c: Column) -> Column:
    v = F.abs(_long(c))
    digits = [F.substring(F.lit(CSV64), F.shiftright(v, 6 * i).bitwiseAND(F.lit(63).cast("bigint")).cast("int") + 1, F.lit(1)) for i in range(10, -1, -1)]
    body = F.ltrim(F.concat(*digits), F.lit(CSV64[0]))
    return F.concat(F.when(_long(c) < 0, F.lit("-")).otherwise(F.lit("")), F.when(body == "", F.lit(CSV64[0])).otherwise(body))


def from_csv64(c: Column) -> Column:
    digits = F.filter(F.split(F.ltrim(c, F.lit("-")), ""), lambda x: x != "")
    n = F.aggregate(digits, F.lit(0).cast("bigint"), lambda a, x: a * 64 + (F.instr(F.lit(CSV64), x) - 1).cast("bigint"))
    return F.when(c.startswith("-"), -n).otherwise(n)


# Hashes ----------------------------------------------------------------------------------------------------------


def _fold(octets: list[Column], start: Column | None = None) -> Column:
    h = _long(FNV_START) if start is None else start
    for b in octets:
        h = (h.bitwiseXOR(b) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(MASK))
    return h


def _signed(h: Column) -> Column:
    return F.when(h >= F.lit(1 << 31), h - F.lit(1 << 32)).otherwise(h).cast("int")


def _octets(c: Column, width: int) -> list[Column]:
    return [F.shiftright(_long(c), 8 * i).bitwiseAND(F.lit(255).cast("bigint")) for i in range(width)]


def hash_tuple(columns: Sequence[Column], widths: Sequence[int] | None = None) -> Column:
    """32-bit FNV-1a of integers, each as little-endian octets (eight, or its own width) and a zero octet."""
    octets: list[Column] = []
    for k, c in enumerate(columns):
        octets += [*_octets(c, widths[k] if widths else 8), F.lit(0).cast("bigint")]
    return _signed(_fold(octets))


def hash_values(columns: Sequence[tuple[Column, str]]) -> Column:
    """The same of (column, Spark type) of any scalar type: integers at their own width, others as their text's octets."""
    h = _long(FNV_START)
    for c, t in columns:
        if t in ("bigint", "int", "smallint", "tinyint"):
            h = _fold(_octets(c, {"bigint": 8, "int": 4, "smallint": 2, "tinyint": 1}[t]), h)
        else:
            text = F.hex(c.cast("string").cast("binary"))
            octets = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1)), F.lit(2)), lambda i: F.conv(F.substring(text, i, F.lit(2)), 16, 10).cast("bigint"))
            h = F.when(F.length(text) == 0, h).otherwise(F.aggregate(octets, h, lambda a, b: (a.bitwiseXOR(b) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(MASK))))
        h = _fold([F.lit(0).cast("bigint")], h)
    return _signed(h)


def fnv(data: bytes) -> int:
    h = FNV_START
    for b in data:
        h = ((h ^ b) * FNV_PRIME) & MASK
    return h


def _to_signed(h: int) -> int:
    return h - (1 << 32) if h >= 1 << 31 else h


def hash_tuple_value(values: Sequence[int]) -> int:
    return _to_signed(fnv(b"".join(v.to_bytes(8, "little", signed=True) + b"\0" for v in values)))


def hash_values_value(values: Sequence[tuple[int | str, str]]) -> int:
    width = {"bigint": 8, "int": 4, "smallint": 2, "tinyint": 1}
    return _to_signed(fnv(b"".join((v.to_bytes(width[t], "little", signed=True) if t in width else str(v).encode()) + b"\0" for v, t in values)))


def basic_hash(text: str) -> int:
    """A positive hash of a name, 1 instead of 0."""
    return fnv(text.encode()) or 1


# Weeks, times and slots ------------------------------------------------------------------------------------------


def week_monday(code: Column) -> Column:
    """The unix day of the Monday of an ISO week YYWW from 2000 on; 0 for codes that are none."""
    c = code.cast("int")
    year, week = (F.lit(2000) + F.floor(c / F.lit(100))).cast("int"), c % F.lit(100)
    monday = F.unix_date(F.date_trunc("week", F.make_date(year, F.lit(1), F.lit(4))).cast("date")) + (week - 1) * 7
    return F.when((c > 0) & week.between(1, 53), monday.cast("int")).otherwise(F.lit(0))


def week_code(day: Column) -> Column:
    """YYWW of the ISO week of a date."""
    d = day.cast("date")
    return (F.pmod(F.extract(F.lit("YEAROFWEEK"), d).cast("int"), F.lit(100)) * 100 + F.weekofyear(d)).cast("int")


def week_index(code: Column) -> Column:
    return F.floor(week_monday(code) / F.lit(7)).cast("int")


def half_seconds(ts: Column) -> Column:
    """A time as half the seconds since 2001-09-09, in 32 bits."""
    return F.call_function("div", F.unix_timestamp(ts.cast("timestamp")) - F.lit(1_000_000_000), F.lit(2).cast("bigint")).cast("int")


def from_half_seconds(c: Column) -> Column:
    return F.timestamp_seconds(_long(c) * 2 + F.lit(1_000_000_000))


def slot_key(partition: Column, table_id: int) -> Column:
    """The partition before 14 bits of the table's id, in 64 bits: partitions from 2^17 on leave 32."""
    return _long(partition) * F.lit(1 << 14) + F.lit(table_id)


def slot_of(record_id: Column) -> Column:
    return F.pmod(_long(record_id), F.lit(256)).cast("int")


def stored_version(version: Column) -> Column:
    """A version in 16 bits; 0 means unknown, so it becomes 1."""
    v = F.pmod(_long(version), F.lit(65536)).cast("int")
    return F.when(v == 0, F.lit(1)).otherwise(v)


def with_suffix(sequence: Column, digits: int, seed: int) -> Column:
    """A sequence number followed by random digits; the seed is an argument, so that a rerun gives the same."""
    return _long(sequence) if not digits else _long(sequence) * F.lit(10**digits) + F.floor(F.rand(seed) * F.lit(10**digits)).cast("bigint")
