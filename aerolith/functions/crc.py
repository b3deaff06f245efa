"""The datalink checksum as a column expression: CCITT polynomial, most significant bit first, from 0xFFFF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POLYNOMIAL, START, GOOD = 0x1021, 0xFFFF, 0x1D0F  # fixed values


def _table() -> list[int]:
    out = []
    for byte in range(256):
        crc = byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ (POLYNOMIAL if crc & 0x8000 else 0)) & 0xFFFF
        out.append(crc)
    return out


def crc16(data: Column, start: Column | int = START) -> Column:
    """The checksum of an ASCII text or of bytes given as hexadecimal pairs by `hex_pairs`."""
    table = F.expr(f"array({', '.join(map(str, _table()))})")
    step = lambda crc, byte: F.shiftleft(crc, 8).bitwiseAND(0xFFFF).bitwiseXOR(F.get(table, F.shiftright(crc, 8).bitwiseXOR(byte).bitwiseAND(255)))
    return F.aggregate(data, F.lit(start).cast("int") if isinstance(start, int) else start, step)


def text_bytes(text: Column) -> Column:
    """The bytes of an ASCII text as an array of integers."""
    return F.transform(F.split(text, ""), lambda c: F.ascii(c))


def hex_bytes(digits: Column) -> Column:
    """The bytes of a text of hexadecimal pairs as an array of integers."""
    return F.transform(F.regexp_extract_all(digits, F.lit("([0-9A-Fa-f]{2})"), 1), lambda p: F.conv(p, 16, 10).cast("int"))


def sound(text: Column, check: Column) -> Column:
    """Whether a text and its four checksum digits agree."""
    return crc16(F.concat(text_bytes(text), hex_bytes(check))) == GOOD
