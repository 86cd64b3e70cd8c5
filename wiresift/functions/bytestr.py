"""Byte-exact text: one character per byte.

Spark's string functions count characters. Decoding a payload as ISO-8859-1
gives each byte its own character, so positions and lengths are in bytes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def byte_text(payload: Column) -> Column:
    """BINARY to a string with one character per byte."""
    return F.decode(payload, "ISO-8859-1")


def text_bytes(text: Column) -> Column:
    """Inverse of :func:`byte_text`."""
    return F.encode(text, "ISO-8859-1")


def hex_digits(raw: Column, size: int) -> Column:
    """Hex digits of the first ``size`` bytes, to read numbers from with :func:`uint`."""
    return F.hex(F.substring(raw, 1, size))


def uint(digits: Column, first: Column | int, width: int) -> Column:
    """Big-endian unsigned number of ``width`` bytes from byte ``first`` (0-based) of hex digits."""
    start = F.lit(first * 2 + 1) if isinstance(first, int) else first * 2 + 1
    return F.conv(F.substring(digits, start, F.lit(width * 2)), 16, 10).cast("bigint")


def be_bytes(value: Column, width: int) -> Column:
    """Big-endian BINARY of ``width`` bytes."""
    return F.unhex(F.lpad(F.hex(value.cast("bigint")), width * 2, "0"))


def dotted(digits: Column, first: int) -> Column:
    """Dotted IPv4 address at byte ``first`` of hex digits."""
    return F.concat_ws(".", *[
        F.conv(F.substring(digits, (first + i) * 2 + 1, 2), 16, 10) for i in range(4)])


def dotted_bytes(address: Column) -> Column:
    """Four bytes of a dotted IPv4 address."""
    parts = F.split(address, r"\.")
    return F.concat(*[be_bytes(F.get(parts, F.lit(i)).cast("bigint"), 1) for i in range(4)])
